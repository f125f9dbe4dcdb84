"""Operators of a large-scale training-data pipeline over the tables `documents` and `pages`.

Nothing else in the library imports this subpackage. `queries` holds the registered queries.
"""
