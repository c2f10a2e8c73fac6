"""Operators of a training-data pipeline over documents, pages and conversations.

Each module holds one operator with its own interface; ``queries`` registers
them over the given tables. Nothing outside this package imports it.
"""

from .queries import ORACLE, QUERIES  # noqa: F401
