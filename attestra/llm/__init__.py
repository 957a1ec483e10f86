"""Training-data operators: one module per problem, queries and SQL in ``queries``.

Nothing outside this package imports it; deleting the folder leaves the rest of the library whole.
"""
