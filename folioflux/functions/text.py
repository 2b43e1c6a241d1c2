"""Text columns with Unicode-aware white space, built from JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.isspace sees it: Spark's trim takes only U+0020 and \s only ASCII.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column | str) -> Column:
    """True for null, empty and all-white-space text."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def words(c: Column | str) -> Column:
    """Words between white space; no empty words; null gives null."""
    return F.filter(F.split(col(c), rf"{SPACE}+"), lambda w: F.length(w) > 0)


def alnum_count(c: Column | str) -> Column:
    return F.length(F.regexp_replace(col(c), r"[^\p{L}\p{N}]", ""))


def norm_id(c: Column | str) -> Column:
    """An id whatever its spelling: lower-case hex digits only; nothing left gives null."""
    x = F.regexp_replace(F.lower(col(c)), "[^0-9a-f]", "")
    return F.when(F.length(x) > 0, x)


def norm_role(c: Column | str) -> Column:
    x = F.lower(strip(c))
    return F.when(F.length(x) > 0, x)
