"""Page rows of the two page tables, each page once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inspection_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(origin, doc_sha256, page_number, text) of text layers, one row per inspection: no page text is
    shuffled to find repeated ones, the operators give one result for equal pages."""
    i = spark.read.parquet(f"{sf}/inspections.parquet").filter("page_texts is not null")
    return i.select(F.lit("inspections").alias("origin"), "doc_sha256", F.posexplode("page_texts").alias("at", "text")).select("origin", "doc_sha256", (F.col("at") + 1).cast("long").alias("page_number"), "text")


def recovered_pages(spark: SparkSession, sf: str) -> DataFrame:
    r = spark.read.parquet(f"{sf}/recovered_pages.parquet")
    return r.select(F.lit("recovered_pages").alias("origin"), "doc_sha256", F.col("page_number").cast("long").alias("page_number"), "text")


def all_pages(spark: SparkSession, sf: str) -> DataFrame:
    return inspection_pages(spark, sf).unionByName(recovered_pages(spark, sf))


#: A text of plain ASCII needs no look by the operators on characters.
NOT_ASCII = r"[^\x00-\x7f]"
