"""Training-data operators: scoring, near-duplicate joins, search, mixing and token output.

Nothing else in the package imports this subpackage.
"""
