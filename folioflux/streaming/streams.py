"""Structured Streaming forms of the ledgers: tailing, refusing duplicates, pairing, folding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tail(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """New files of JSON lines as they come. Lines that are no rows of the schema are dropped; a file
    counts once it is whole."""
    raw = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)
    return raw.select(F.from_json("value", schema).alias("r")).filter("r is not null").select("r.*")


def refuse_duplicates(stream: DataFrame, ledger: str, refused: str, key: str, checkpoint: str):
    """Appends each row whose key is new to the ledger, others to ``refused``. A batch that runs again
    after a failure appends nothing twice: rows carry their batch, and a batch that is there is left
    out."""

    def write(batch: DataFrame, n: int) -> None:
        s = batch.sparkSession
        p = s._jvm.org.apache.hadoop.fs.Path(ledger)
        there = p.getFileSystem(s._jsc.hadoopConfiguration()).exists(p)
        b = batch.groupBy(key).agg(F.count("*").alias("__n"), F.first(F.struct(*batch.columns)).alias("__r"))
        one = b.select("__r.*", "__n").withColumn("__batch", F.lit(n))
        old = s.read.parquet(ledger).filter(F.col("__batch") != n).select(key) if there else one.select(key).limit(0)
        if there and not s.read.parquet(ledger).filter(F.col("__batch") == n).isEmpty():
            return
        one.join(old, key, "left_anti").drop("__n").write.mode("append").parquet(ledger)
        one.join(old, key, "left_semi").drop("__n").unionByName(one.filter("__n > 1").join(old, key, "left_anti").drop("__n")).write.mode("append").parquet(refused)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pair(stream: DataFrame, idle: str = "30 days") -> DataFrame:
    """Open and close events (id, event, at timestamp) to (id, opened, closed, state) as they come: a
    row when an id opens (open), one when it closes (closed), one for a close without an opening
    (unopened) or a second opening (reopened). State of an id goes when it closes or after ``idle``."""
    days = int(idle.split()[0]) * 86_400_000

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opened = state.get[0] if state.exists else None
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "opened": [pd.Timestamp(opened, unit="ms")], "closed": [pd.NaT], "state": ["expired"]})
            return
        rows = pd.concat(list(batches)).sort_values(["at", "event"], ascending=[True, False])
        for e, at in zip(rows["event"], rows["at"]):
            if e == "open":
                out.append((key[0], at if opened is None else pd.Timestamp(opened, unit="ms"), pd.NaT, "open" if opened is None else "reopened"))
                opened = int(at.timestamp() * 1000) if opened is None else opened
            elif opened is None:
                out.append((key[0], pd.NaT, at, "unopened"))
            else:
                out.append((key[0], pd.Timestamp(opened, unit="ms"), at, "closed"))
                opened = None
        if opened is None:
            if state.exists:
                state.remove()
        else:
            state.update((opened,))
            state.setTimeoutDuration(days)
        yield pd.DataFrame(out, columns=["id", "opened", "closed", "state"])

    return stream.groupBy("id").applyInPandasWithState(fold, "id string, opened timestamp, closed timestamp, state string", "opened long", "append", "ProcessingTimeTimeout")


def latest_states(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The state of each key as a fold of its events, in complete mode."""
    return stream.groupBy(key).agg(F.max_by(value, order).alias(value), F.count("*").alias("events"))
