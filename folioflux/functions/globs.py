"""Path patterns as regular expressions, compiled once on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_regex(glob: str) -> str:
    """Anchored: ** crosses separators, **/ may be empty, * and ? stay within a segment."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
            i += 1
    return f"^{out}$"


def name_regex(glob: str) -> str:
    """As fnmatch has it: * and ? cross separators; [abc] and [!abc] are sets."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + f"[{'^' + body[1:] if body[0] == '!' else body}]", end + 1
            continue
        out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return f"^{out}$"


def first_match(path: str, patterns: list[tuple[str, str]]) -> Column:
    """The name of the first pattern that takes the path; null if none does."""
    c = F.col(path)
    out = F.lit(None).cast("string")
    for name, glob in reversed(patterns):
        out = F.when(c.rlike(path_regex(glob)), name).otherwise(out)
    return out
