"""Column helpers for text, with the string rules of Python's ``str``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The 29 code points ``str.isspace`` accepts.
PY_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set as a Java regex class (plain \s covers ASCII only).
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_WS = r"[^\s\x1c-\x1f\x85\p{Z}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pystrip(c: Column | str) -> Column:
    """``str.strip()``; Spark's ``trim`` alone strips only U+0020."""
    return F.btrim(col(c), F.lit(PY_SPACES))


def fold(c: Column | str) -> Column:
    """Lower-cased and stripped: the form labels are compared in."""
    return pystrip(F.lower(col(c)))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(F.length(pystrip(c)) == 0, F.lit(True))


def first_token(c: Column | str) -> Column:
    """First whitespace-separated token, empty for blank text."""
    return F.regexp_extract(col(c), NOT_WS + "+", 0)


def first_char(c: Column | str) -> Column:
    """First character of the folded text; only that character is lowered."""
    head = F.substring(F.ltrim(col(c), F.lit(PY_SPACES)), 1, 1)
    return F.substring(F.lower(head), 1, 1)


def token_count(c: Column | str) -> Column:
    """Number of whitespace-separated tokens, 0 for blank text."""
    return F.size(F.array_remove(F.split(col(c), WS + "+"), ""))


def word_tokens(c: Column | str) -> Column:
    """Lower-cased runs of ``[a-z0-9]``, the token form ROUGE uses."""
    return F.array_remove(F.split(F.lower(col(c)), "[^a-z0-9]+"), "")
