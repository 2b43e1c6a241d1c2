"""Sinks: documents published whole or not at all, inventories, manifests, table files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(df: DataFrame, path: str, *by: str) -> None:
    """Writes beside the target and renames once: readers see all or nothing; an existing target is
    refused, never replaced."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise FileExistsError(path)
    stage = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}")
    try:
        df.write.partitionBy(*by).parquet(stage.toString())
        if fs.exists(target) or not fs.rename(stage, target):
            raise FileExistsError(path)
    finally:
        fs.delete(stage, True)


def append_ledger(df: DataFrame, path: str, key: str) -> int:
    """Appends rows with a new key to a parquet ledger; a key that is there with other content is
    refused with the whole batch. Returns the number appended."""
    from folioflux.operators.ledgers import append_once

    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df.write.parquet(path)
        return df.count()
    new, refused = append_once(spark.read.parquet(path), df, key)
    if not refused.isEmpty():
        raise ValueError(f"{key} already in the ledger with other content")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256, media_type) of the files below a folder."""
    from folioflux.sources.readers import files

    kinds = {"txt": "text/plain", "md": "text/markdown", "json": "application/json", "csv": "text/csv", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "parquet": "application/vnd.apache.parquet"}
    m = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return files(spark, path).select("path", "size", "sha256", F.coalesce(F.try_element_at(m, F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))), F.lit("application/octet-stream")).alias("media_type"))


def inventory_faults(declared: DataFrame, found: DataFrame) -> DataFrame:
    """(path, fault): declared and found files compared: missing, undeclared, size, sha256, repeated or
    unsafe paths."""
    d = declared.groupBy("path").agg(F.count("*").alias("n"), F.first("size").alias("s"), F.first("sha256").alias("h"))
    f = found.select("path", F.col("size").alias("s2"), F.col("sha256").alias("h2"))
    j = d.join(f, "path", "full")
    fault = F.when(F.col("n").isNull(), "undeclared").when(F.col("path").rlike(r"^/|(^|/)\.\.(/|$)|\\|^$"), "unsafe-path").when(F.col("n") > 1, "repeated").when(F.col("h2").isNull(), "missing").when(F.col("s") != F.col("s2"), "size").when(F.col("h") != F.col("h2"), "sha256")
    return j.select("path", fault.alias("fault")).filter("fault is not null")


def manifest_faults(m: DataFrame) -> DataFrame:
    """(doc_sha256, fault) of manifests (doc_sha256, schema, status, page_count, pages<number, anchor>):
    pages must be exactly 1..n and each anchor that of its page."""
    from folioflux.operators.pages import page_anchor

    numbers = F.array_sort(F.transform("pages", lambda p: p.number))
    want = F.when(F.col("page_count") > 0, F.sequence(F.lit(1), F.col("page_count"))).otherwise(F.array().cast("array<int>"))
    wrong = F.exists("pages", lambda p: ~F.coalesce(p.anchor == page_anchor(F.col("doc_sha256"), p.number), F.lit(False)))
    rules = [(~F.coalesce(F.col("status") == "complete", F.lit(False)), "status"), (~F.coalesce(numbers == want, F.lit(False)), "pages"), (F.coalesce(wrong, F.lit(True)), "anchor")]
    return m.select("doc_sha256", F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for c, k in rules]), lambda x: x.isNotNull())).alias("fault"))


def manifest_json(df: DataFrame, *cols: str) -> DataFrame:
    """One JSON text per row, nulls kept."""
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").option("quoteAll", "false").option("escape", '"').csv(path)
