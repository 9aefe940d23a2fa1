"""Operators for large text corpora: deduplication, decontamination, scoring,
packing, attribution and secret scans. Nothing else in the library imports
this package."""
