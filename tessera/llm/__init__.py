"""Training-data operators: one module per operator, queries and SQL in ``registry``.

Nothing outside this package imports it.
"""
