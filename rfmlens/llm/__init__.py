"""Operators of a training-data pipeline over text, vectors and URLs.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface and the thin registered query that applies
it to its whole table; ``catalog`` lists the queries and their SQL.
"""
