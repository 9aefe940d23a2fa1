"""End-to-end products composed from the operators, and the product registry."""
