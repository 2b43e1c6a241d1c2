"""Continuous periods and gaps of overlapping intervals, for entities of any size.

Rows are range-sorted over all partitions by (entity, start), so one entity may fill many
partitions. A first scan leaves one summary per partition (its last entity with the last island);
the driver combines these few rows in order into the state that enters each partition; a second
scan starts from that state and labels the islands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.session import shared_dir, shuffle_partitions

State = tuple[tuple, int, int] | None  # entity, start and end of its last island


def _scan(batch: pa.RecordBatch, n_keys: int, carry: State) -> tuple[State, list, list]:
    """Islands and gaps of one sorted batch after ``carry``; the carried island is the first row,
    so an island over a seam comes out again with the same start and its later end."""
    keys = [batch.column(i) for i in range(n_keys)]
    s = batch.column(n_keys).to_numpy(zero_copy_only=False).astype(np.int64)
    e = batch.column(n_keys + 1).to_numpy(zero_copy_only=False).astype(np.int64)
    if carry is not None:
        keys = [pa.concat_arrays([pa.array([v], type=k.type), k]) for v, k in zip(carry[0], keys)]
        s, e = np.concatenate([[carry[1]], s]), np.concatenate([[carry[2]], e])
    n = len(s)
    fresh = np.zeros(n, dtype=bool)
    fresh[0] = True
    for k in keys:
        if n > 1:
            a, b = k.slice(1), k.slice(0, n - 1)
            differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            nulls = pc.not_equal(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
            fresh[1:] |= differs | nulls
    seg = np.cumsum(fresh)
    values, rank = np.unique(e, return_inverse=True)
    top = values[np.maximum.accumulate(seg * len(values) + rank) % len(values)]  # running maximum within the entity
    before = np.empty(n, dtype=np.int64)
    before[0], before[1:] = s[0], top[:-1]
    gap = ~fresh & (s > before)
    first = np.flatnonzero(fresh | gap)
    last = np.append(first[1:], n) - 1
    g = np.flatnonzero(gap)
    at = lambda rows: [k.take(pa.array(rows)) for k in keys]
    periods = [*at(first), pa.array(s[first]), pa.array(top[last])]
    gaps = [*at(g), pa.array(before[g]), pa.array(s[g])]
    state = (tuple(k[n - 1].as_py() for k in keys), int(s[first[-1]]), int(top[n - 1]))
    return state, periods, gaps


def _combine(carry: State, one: dict) -> State:
    """The state after a partition: ``one`` has its last island seen without what came before."""
    key, start, end = one["key"], one["start"], one["end"]
    if carry is None or carry[0] != key:
        return key, start, end
    return key, (carry[1] if carry[2] >= start else start), max(carry[2], end)


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, partitions: int | None = None) -> DataFrame:
    """Rows (keys..., kind, start, end): each ``period`` is a longest stretch without uncovered time,
    each ``gap`` lies between two periods of one entity. Touching intervals belong together.

    A row with a null bound or an end not after its start covers nothing and is left out. Null keys
    are an entity like any other. Repeated rows, ties, nesting and an empty table are fine; columns
    beside the named ones are ignored.
    """
    spark = df.sparkSession
    shared_dir(spark)
    n = partitions or shuffle_partitions(spark)
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{k}`").alias(m) for k, m in zip(keys, names)], F.col(f"`{start}`").cast("long").alias("s"), F.col(f"`{end}`").cast("long").alias("e")).filter("e > s").distinct()  # equal rows cannot be split by a range sort
    order = [*names, "s", "e"]
    # Both scans must see the same partitions: the range bounds are drawn anew each time a plan runs.
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint()
    width = len(names)
    kinds = ", ".join(f"{m} {t}" for m, t in rows.dtypes if m in names)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, schema = None, None
        for batch in batches:
            if batch.num_rows:
                schema = batch.schema
                state, _, _ = _scan(batch, width, state)
        if state is not None:
            cols = [pa.array([v], type=schema.field(i).type) for i, v in enumerate(state[0])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([state[1]]), pa.array([state[2]]), pa.array([TaskContext.get().partitionId()], pa.int32())], [*names, "s", "e", "pid"])

    entering: dict[int, State] = {}
    state: State = None
    for r in sorted(rows.mapInArrow(summarise, f"{kinds}, s long, e long, pid int").collect(), key=lambda r: r.pid):  # one row per partition
        entering[r.pid] = state
        state = _combine(state, {"key": tuple(r[m] for m in names), "start": r.s, "end": r.e})

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = entering.get(TaskContext.get().partitionId())
        for batch in batches:
            if batch.num_rows:
                state, periods, gaps = _scan(batch, width, state)
                for kind, cols in (("period", periods), ("gap", gaps)):
                    yield pa.RecordBatch.from_arrays([*cols[:width], pa.array([kind] * len(cols[0]), pa.string()), *cols[width:]], [*names, "kind", "s", "e"])

    pieces = rows.mapInArrow(label, f"{kinds}, kind string, s long, e long")
    whole = pieces.groupBy(*names, "kind", "s").agg(F.max("e").alias("e"))
    return whole.select(*[F.col(m).alias(k) for k, m in zip(keys, names)], "kind", F.col("s").alias(start), F.col("e").alias(end))
