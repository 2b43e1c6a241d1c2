"""Queries of the text problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.llm import contamination, lookalikes, mixture, mojibake, scans, toxicity
from folioflux.llm.pages import all_pages, inspection_pages

PAGE = ["origin", "doc_sha256", "page_number"]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.Scan(all_pages(spark, sf)).cases()


def p2_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as continuous paragraphs."""
    return scans.Scan(all_pages(spark, sf)).repaired()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.faults(all_pages(spark, sf), "text", PAGE).distinct()


def p4_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every page in its consistent form."""
    return lookalikes.consistent_form(all_pages(spark, sf), "text").select(*PAGE, "form", F.concat_ws(",", "kinds").alias("kinds")).distinct()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.restore(inspection_pages(spark, sf), "text", PAGE[1:]).select(*PAGE[1:], "state").distinct()


def p5_restored(spark: SparkSession, sf: str) -> DataFrame:
    """The garbled pages with their text restored."""
    return mojibake.restore(inspection_pages(spark, sf), "text", PAGE[1:]).distinct()


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet"), "doc_id", "text", "item_id", "text")


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    """Per test item the documents it leaked into; items that did not leak have none."""
    items = spark.read.parquet(f"{sf}/eval_items.parquet").select("item_id", "task", "split")
    n = p6_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("n"))
    return items.join(n, "item_id", "left").select("item_id", "task", "split", F.coalesce("n", F.lit(0)).alias("documents"))


def _mixture(spark: SparkSession, sf: str) -> mixture.Mixture:
    import public_tokenizers as vocabularies

    return mixture.Mixture(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/mix_targets.parquet"), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The chosen records with their repeats."""
    return _mixture(spark, sf).chosen()


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixture(spark, sf).shares()


def p7_slots(spark: SparkSession, sf: str) -> DataFrame:
    """The mixture itself, block by block and shard by shard."""
    return _mixture(spark, sf).slots


def p7_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What holds of every mixture, per source: blocks used more often than allowed, blocks used twice in one
    pass, and whether the actual share is the target's to half a percent."""
    m = _mixture(spark, sf)
    uses = m.slots.groupBy("source", "block").agg(F.count("*").alias("n"), F.countDistinct("pass").alias("passes"))
    u = uses.join(F.broadcast(m.sources.select("source", "max_repeats")), "source").groupBy("source").agg(F.count_if(F.col("n") > F.col("max_repeats")).alias("over_cap"), F.count_if(F.col("n") > F.col("passes")).alias("twice_in_pass"))
    near = F.abs(F.col("actual_share") - F.col("target_share")) <= 0.005
    return m.shares().join(u, "source", "left").select("source", "max_repeats", F.coalesce("over_cap", F.lit(0)).alias("over_cap"), F.coalesce("twice_in_pass", F.lit(0)).alias("twice_in_pass"), near.alias("share_met"))


def _scores(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/content_labels.parquet"))
    return toxicity.scores(docs, model, "doc_id", "text", list(keep))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.filter(F.array(*[F.when(F.col(k) > 0, F.lit(k)) for k in toxicity.KINDS]), lambda x: x.isNotNull())
    return _scores(spark, sf).select("doc_id", F.explode(kinds).alias("kind"))


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The score of every document for each kind."""
    return _scores(spark, sf)


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rate of each kind per source, sources whatever their spelling."""
    s = _scores(spark, sf, "source").withColumn("source", F.coalesce(mixture.normal_source("source"), F.lit("unknown")))
    return s.groupBy("source").agg(F.count("*").alias("documents"), *[F.avg((F.col(k) > 0).cast("double")).alias(f"{k}_rate") for k in toxicity.KINDS])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_repaired": p2_repaired, "p4_found": p4_found, "p4_forms": p4_forms, "p5_found": p5_found, "p5_restored": p5_restored, "p6_found": p6_found, "p6_items": p6_items, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_slots": p7_slots, "p7_invariants": p7_invariants, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}


def oracle_sql() -> dict[str, str]:
    return {"p7_invariants": r"SELECT regexp_replace(regexp_replace(lower(source), '^\s+|\s+$', '', 'g'), '[\s_]+', '-', 'g') source, CAST(max(max_repeats) AS BIGINT) max_repeats, CAST(0 AS BIGINT) over_cap, CAST(0 AS BIGINT) twice_in_pass, true share_met FROM mix_targets GROUP BY 1"}
