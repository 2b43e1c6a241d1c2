"""Running totals per key over data of any size, without a window over a whole key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.session import shared_dir, shuffle_partitions


def running_totals(df: DataFrame, key: str, order: list[str], value: str, out: str = "before", partitions: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same key that come earlier by ``order``.

    Rows are range-sorted by key and order, so a key may fill many partitions; each partition leaves
    the sum of its last key, the driver combines these few numbers in order, and a second scan adds
    them. Null values count 0; a null key is a key; ties keep some order, the totals stay a valid
    sequence. A column named ``out`` is replaced. Empty in, empty out. ``value`` must be whole numbers."""
    spark = df.sparkSession
    shared_dir(spark)
    df = df.drop(out)
    by = [f"`{c}`" for c in (key, *order)]
    rows = df.repartitionByRange(partitions or shuffle_partitions(spark), *by).sortWithinPartitions(*by).checkpoint()
    k, v = df.columns.index(key), df.columns.index(value)

    def scan(b: pa.RecordBatch, carry):
        """Totals before each row of a batch, and (key, sum) after it."""
        keys = b.column(k)
        n = np.asarray(pc.fill_null(b.column(v), 0).cast(pa.int64()))
        code = np.zeros(len(n), dtype=bool)
        if len(n) > 1:
            a, c = keys.slice(1), keys.slice(0, len(n) - 1)
            code[1:] = np.asarray(pc.fill_null(pc.not_equal(a, c), False)) | np.asarray(pc.not_equal(pc.is_null(a), pc.is_null(c)))
        total = np.cumsum(n) - n
        first = np.maximum.accumulate(np.where(code, np.arange(len(n)), 0))
        total = total - total[first]
        if carry is not None and carry[0] == keys[0].as_py():
            total[first == 0] += carry[1]
        return total, (keys[len(n) - 1].as_py(), int(total[-1] + n[-1]))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, first, kind = None, None, None
        for b in batches:
            if b.num_rows:
                if carry is None:
                    first, kind = b.column(k)[0].as_py(), b.schema.field(k).type
                _, carry = scan(b, carry)
        if carry is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], kind), pa.array([carry[0]], kind), pa.array([carry[1]], pa.int64())], ["pid", "first", "last", "total"])

    kind = dict(df.dtypes)[key]
    entering, carry = {}, None
    for r in sorted(rows.mapInArrow(summarise, f"pid int, first {kind}, last {kind}, total long").collect(), key=lambda r: r.pid):  # one row per partition
        entering[r.pid] = carry
        carry = (r.last, r.total + (carry[1] if carry is not None and carry[0] == r.last == r.first else 0))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = entering.get(TaskContext.get().partitionId())
        for b in batches:
            if b.num_rows:
                total, carry = scan(b, carry)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total)], [*b.schema.names, out])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{out}` long"
    return rows.mapInArrow(add, schema)
