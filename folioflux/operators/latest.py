"""The row that holds among several deliveries of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per ``keys``: the one with the largest ``order`` (nulls last), further ties by the
    other columns, so the result is the same on every run.

    max(struct) combines before the shuffle, so a key delivered very often moves one row per task.
    Null keys form a group of their own. Keeps all columns, in the given order. Empty in, empty out.
    """
    kinds = dict(df.dtypes)
    rest = [c for c in df.columns if c not in keys and c != order]
    ranked = F.struct(F.col(f"`{order}`"), *[F.col(f"`{c}`") for c in rest if "map<" not in kinds[c] and "variant" not in kinds[c]])
    every = F.struct(F.col(f"`{order}`"), *[F.col(f"`{c}`") for c in rest])
    maps = any("map<" in kinds[c] or "variant" in kinds[c] for c in rest)  # these have no order of their own
    held = F.max_by(every, ranked) if maps else F.max(ranked)
    out = df.groupBy(*[f"`{k}`" for k in keys]).agg(held.alias("__held"))
    return out.select(*[F.col(f"`{c}`") if c in keys else F.col("__held").getField(c).alias(c) for c in df.columns])
