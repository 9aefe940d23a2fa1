"""Differential checks against DuckDB (oracle SQL) used by tests and the driver."""
