"""Word-level normal forms shared by the operators.

A word is a run of letters or digits of any script, lower-cased; everything else parts words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_words(text: Column | str) -> Column:
    """The words of ``text`` parted by single spaces ('' if it has none, null stays null)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def is_blank(text: Column | str) -> Column:
    """True for null and for texts of white space only (of any script)."""
    c = F.col(text) if isinstance(text, str) else text
    return c.isNull() | ~c.rlike(r"[^\s\p{Z}\x{200B}\x{FEFF}]")


def norm_id(c: Column | str) -> Column:
    """An identifier trimmed and in lower case; blank becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    x = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(x != "", x)
