"""What the operators need from the session: the shared folder and tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset on one machine (tests), an own
    one; on a cluster that is an error, as executors share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_folioflux_dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark._folioflux_dir = tempfile.mkdtemp(prefix="folioflux-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a compressed table in the shared folder and reads it again: cuts lineage,
    survives lost executors, and keeps column pruning, unlike an RDD checkpoint. The table stays until
    :func:`release` or the end of the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _TABLES:
        atexit.register(_release_all)
    _TABLES.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_TABLES: list[tuple[SparkSession, str]] = []


def release(spark: SparkSession) -> None:
    """Deletes the tables written so far; frames that read them are of no use afterwards."""
    fs = spark._jvm.org.apache.hadoop.fs
    for own, path in [t for t in _TABLES if t[0] is spark]:
        at = fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _TABLES.remove((own, path))


def _release_all() -> None:
    for spark in {id(s): s for s, _ in _TABLES}.values():
        if spark.sparkContext._jsc is not None:
            release(spark)
    for _, path in _TABLES:  # the context was stopped before: what lies on this machine or a mounted folder
        shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, rows_each: int) -> int:
    """Partitions for a range sort: those of the session, or more where one would hold over ``rows_each``
    rows; counts the rows, so ``df`` should be a table."""
    return max(shuffle_partitions(df.sparkSession), -(-df.count() // rows_each))
