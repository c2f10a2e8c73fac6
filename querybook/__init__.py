"""Registered queries: every operator over the given tables, with SQL twins."""

from . import (  # noqa: F401
    annotating, catalogs, corpus, generating, ingest, parsing, ranks, statistics, streams,
    texts, viewing,
)
from .base import ORACLE, QUERIES  # noqa: F401
