"""stockboard: material and supplier analytics as Spark DataFrame operators.

Subpackages:
  sources    – reading tables, entity views, scans, generators, graph tables, snapshots
  functions  – Column expressions and predicate builders
  operators  – filters, aggregates, keyed table operators, paging, contracts
  plans      – end-to-end products and the product registry
  streaming  – (nothing: the reference has no streams; see its docstring)

``python -m stockboard`` runs a product or a registered query from the shell.
"""
__version__ = "0.1.0"
