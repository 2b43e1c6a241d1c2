"""The span at work at each moment: one sweep over range-sorted ends of spans.

Starts and ends of spans are range-sorted over all partitions by (key, time), so a key with very many
spans fills many partitions, evenly, however its spans overlap. A partition stands for a stretch of its
key's time. A span is seen where it starts and where it ends; the partitions that it covers wholly in
between are put together from nodes of a binary tree over the partitions, at most two a level. Of the
spans of one node all cover the same stretch, so only the strongest counts: what crosses partitions is
one row per node, whatever the number of spans.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.session import partitions_for, shared_dir

#: Rows a partition is swept with in memory.
PART_ROWS = 400_000


def nodes_between(lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """(level, number) of the nodes of a binary tree that make up the leaves lo to hi - 1."""
    level = 0
    while lo < hi:
        if lo % 2:
            yield level, lo
            lo += 1
        if hi % 2:
            hi -= 1
            yield level, hi
        lo, hi, level = lo // 2, hi // 2, level + 1


def sweep(start: np.ndarray, end: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Time in which each span is the strongest open one. Strengths are distinct."""
    got = np.zeros(len(start), dtype=np.int64)
    order = np.argsort(start, kind="stable")
    begin, last, top = start[order].tolist(), end.tolist(), (-strength).tolist()
    open_: list[tuple[int, int]] = []
    now = 0
    for i, s in zip([*order.tolist(), -1], [*begin, None]):
        while open_ and (s is None or now < s):
            j = open_[0][1]
            until = last[j] if s is None else min(last[j], s)
            if until > now:
                got[j] += until - now
                now = until
            if last[j] <= now:
                heapq.heappop(open_)
        if i >= 0:
            now = s
            heapq.heappush(open_, (top[i], i))
    return got


def strongest_time(df: DataFrame, key: str, span: str, start: str, end: str, depth: str, label: str, out: str, partitions: int | None = None) -> DataFrame:
    """(key, label, out): per key and label the time in which a span of that label was the strongest of
    those open: the deepest, then the shortest, then the one with the largest id.

    Spans with a null bound, or that do not end after they start, take no time; a null depth is the
    least, a null id the smallest; a null key or label is one of its own. Other columns are ignored."""
    spark = df.sparkSession
    shared_dir(spark)
    n = F.col(end) - F.col(start)
    d = df.filter(n > 0).select(F.col(key).alias("k"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), F.coalesce(F.col(depth).cast("long"), F.lit(-1)).alias("d"), F.coalesce(F.col(span), F.lit("")).alias("i"), F.col(label).alias("l"))
    # of spans with the same bounds the strongest alone can ever be at work
    d = d.groupBy("k", "s", "e").agg(F.max(F.struct("d", "i", "l")).alias("x")).select("k", "s", "e", "x.*")
    rows = d.select(F.explode(F.array("s", "e")).alias("t"), "*").checkpoint()
    rows = rows.repartitionByRange(partitions or partitions_for(rows, PART_ROWS), "k", "t").sortWithinPartitions("k", "t").checkpoint()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                pid = pa.array([TaskContext.get().partitionId()], pa.int32())
                yield pa.RecordBatch.from_arrays([pid, b.column(1).slice(0, 1), b.column(0).slice(0, 1)], ["pid", "k", "t"])
                return

    kind = dict(d.dtypes)
    # One row per partition that holds rows, in order; those without rows are skipped.
    heads = sorted(rows.mapInArrow(first, f"pid int, k {kind['k']}, t long").collect(), key=lambda r: r.pid)
    pids = [r.pid for r in heads]
    begins = [((r.k is not None, r.k), r.t) for r in heads]

    def bounds(k, pos: int) -> tuple[int, int]:
        """Stretch of time of key ``k`` that leaf ``pos`` stands for."""
        k = (k is not None, k)
        goes_on = pos + 1 < len(begins) and begins[pos + 1][0] == k
        return begins[pos][1] if begins[pos][0] == k else -(2**63), begins[pos + 1][1] if goes_on else 2**63 - 1

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = bisect_right(pids, TaskContext.get().partitionId()) - 1
        for b in batches:
            t = b.select(["k", "t", "s", "e", "d", "i", "l"]).to_pandas()
            t = t[t.t == t.s]
            found = []
            for x in t.itertuples(index=False):
                # only the last key of a partition goes on in the next
                k = (x.k is not None, x.k)
                if pos + 2 < len(begins) and begins[pos + 1][0] == begins[pos + 2][0] == k and x.e >= begins[pos + 2][1]:
                    at = bisect_right(begins, (k, x.e)) - 1  # where it ends
                    found += [(level, node, x.e - x.s, x.d, x.i, x.l) for level, node in nodes_between(pos + 1, at)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, f)) for f in found], schema=schema)

    schema = pa.schema([("level", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("d", pa.int64()), ("i", pa.string()), ("l", pa.string())])
    best = rows.mapInArrow(whole, "level int, node long, n long, d long, i string, l string").groupBy("level", "node").agg(F.max(F.struct("d", (-F.col("n")).alias("m"), "i", "l")).alias("x"))
    covers = {(r.level, r.node): tuple(r.x) for r in best.collect()} if len(heads) > 2 else {}  # under two rows per partition

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        pos = bisect_right(pids, TaskContext.get().partitionId()) - 1
        t = pa.Table.from_batches(got).to_pandas(integer_object_nulls=True)
        for k, g in t.groupby("k", dropna=False, sort=False):
            k = None if pd.isna(k) else k
            lo, hi = bounds(k, pos)
            s, e = g.s.to_numpy(dtype=np.int64), g.e.to_numpy(dtype=np.int64)
            at = g.t.to_numpy(dtype=np.int64)
            # a span that starts and ends here has two rows; its start counts
            own = (at == s) | (s < lo)
            g, s, e = g[own], s[own], e[own]
            more = [covers[level, pos >> level] for level in range(64) if (level, pos >> level) in covers]
            s = np.append(np.maximum(s, lo), np.full(len(more), lo, dtype=np.int64))
            e = np.append(np.minimum(e, hi), np.full(len(more), hi, dtype=np.int64))
            size = np.append((g.e - g.s).to_numpy(dtype=np.int64), np.array([-x[1] for x in more], dtype=np.int64))
            deep = np.append(g.d.to_numpy(dtype=np.int64), np.array([x[0] for x in more], dtype=np.int64))
            ids, labels = [*g.i, *(x[2] for x in more)], [*g.l, *(x[3] for x in more)]
            rank = np.empty(len(ids), dtype=np.int64)
            rank[np.lexsort((np.unique(np.array(ids, dtype=object), return_inverse=True)[1], -size, deep))] = np.arange(len(ids))
            took = pd.Series(sweep(s, e, rank)).groupby(pd.Series(labels, dtype=object), dropna=False, sort=False).sum()
            took = took[took > 0]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(took), got[0].schema.field("k").type), pa.array([None if pd.isna(x) else x for x in took.index], pa.string()), pa.array(took.to_numpy(), pa.int64())], ["k", "l", "n"])

    done = rows.mapInArrow(work, f"k {kind['k']}, l string, n long")
    return done.groupBy(F.col("k").alias(key), F.col("l").alias(label)).agg(F.sum("n").alias(out))
