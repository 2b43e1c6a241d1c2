"""Queries of the two general problems on the ledger tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.functions.text import norm_id, norm_role
from folioflux.operators.hierarchy import descendants, resolve
from folioflux.operators.islands import periods_and_gaps
from folioflux.operators.latest import latest_by


def held_spans(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """Each span once, in its row with the largest ledger_pos; ids in one spelling."""
    s = spark.read.parquet(f"{sf}/spans.parquet")
    return latest_by(s.select(norm_id("trace_id").alias("trace_id"), norm_id("span_id").alias("span_id"), "ledger_pos", *extra), ["trace_id", "span_id"], "ledger_pos")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    s = held_spans(spark, sf, "role", "start_offset_ns", "end_offset_ns")
    s = s.withColumn("role", norm_role("role")).filter("role is not null")
    return periods_and_gaps(s, ["trace_id", "role"], "start_offset_ns", "end_offset_ns")


def p1_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Per trace and role: periods, gaps, busy and idle time."""
    f = p1_found(spark, sf)
    length = F.col("end_offset_ns") - F.col("start_offset_ns")
    of = lambda kind: F.col("kind") == kind
    return f.groupBy("trace_id", "role").agg(
        F.count_if(of("period")).alias("periods"), F.count_if(of("gap")).alias("gaps"),
        F.coalesce(F.sum(F.when(of("period"), length)), F.lit(0)).alias("busy_ns"), F.coalesce(F.sum(F.when(of("gap"), length)), F.lit(0)).alias("idle_ns"))


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    """Spans with their parent and whether they are the root span of their trace; the roots are
    joined by (trace, span), so a trace with very many spans is no hot key."""
    s = held_spans(spark, sf, "parent_span_id", "start_offset_ns").withColumn("parent", norm_id("parent_span_id"))
    b = spark.read.parquet(f"{sf}/trace_bundles.parquet")
    roots = b.select(norm_id("trace_id").alias("trace_id"), norm_id("root_span_id").alias("span_id"), F.lit(True).alias("is_root")).distinct()
    return s.join(roots, ["trace_id", "span_id"], "left")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    got = resolve(_linked(spark, sf), "trace_id", "span_id", "parent", "start_offset_ns", "is_root")
    return got.filter("kind <> 'rooted'").select("trace_id", "span_id", "kind", F.col("top").alias("top_span_id"), "depth")


def p3_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Every span with path, depth and root."""
    got = resolve(_linked(spark, sf), "trace_id", "span_id", "parent", "start_offset_ns", "is_root", with_paths=True)
    return got.select("trace_id", "span_id", "kind", F.col("top").alias("top_span_id"), "depth", F.concat_ws("/", "path").alias("path"))


def p3_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of a span and one below it, for spans whose chain ends."""
    got = resolve(_linked(spark, sf), "trace_id", "span_id", "parent", "start_offset_ns", "is_root", with_paths=True)
    return descendants(got.filter("kind in ('rooted', 'detached')"), "trace_id", "span_id")


def p3_all_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of a span and one below it, with the kind of the lower one; below a circle
    (``below_cycle``) from the first span on the circle downwards."""
    got = resolve(_linked(spark, sf), "trace_id", "span_id", "parent", "start_offset_ns", "is_root", with_paths=True)
    return descendants(got, "trace_id", "span_id", "kind")


_HELD = """held AS (SELECT * FROM (SELECT regexp_replace(lower(trace_id),'[^0-9a-f]','','g') trace_id, regexp_replace(lower(span_id),'[^0-9a-f]','','g') span_id,
  regexp_replace(lower(parent_span_id),'[^0-9a-f]','','g') parent, role, start_offset_ns, end_offset_ns,
  row_number() OVER (PARTITION BY regexp_replace(lower(trace_id),'[^0-9a-f]','','g'), regexp_replace(lower(span_id),'[^0-9a-f]','','g') ORDER BY ledger_pos DESC) rn FROM spans) WHERE rn = 1)"""
_P1 = f"""WITH {_HELD},
v AS (SELECT DISTINCT trace_id, lower(regexp_replace(role,'^\\s+|\\s+$','','g')) role, start_offset_ns s, end_offset_ns e FROM held WHERE end_offset_ns > start_offset_ns AND trim(regexp_replace(role,'\\s','','g')) <> ''),
m AS (SELECT *, max(e) OVER (PARTITION BY trace_id, role ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pm FROM v),
g AS (SELECT *, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, role ORDER BY s, e ROWS UNBOUNDED PRECEDING) k FROM m),
found AS (SELECT trace_id, role, 'period' kind, min(s) start_offset_ns, max(e) end_offset_ns FROM g GROUP BY trace_id, role, k
UNION ALL SELECT trace_id, role, 'gap', pm, s FROM m WHERE s > pm) """
P1_SQL = {
    "p1_found": _P1 + "SELECT * FROM found",
    "p1_coverage": _P1 + """SELECT trace_id, role, count(*) FILTER (kind='period') periods, count(*) FILTER (kind='gap') gaps,
  CAST(coalesce(sum(end_offset_ns-start_offset_ns) FILTER (kind='period'),0) AS BIGINT) busy_ns, CAST(coalesce(sum(end_offset_ns-start_offset_ns) FILTER (kind='gap'),0) AS BIGINT) idle_ns FROM found GROUP BY trace_id, role""",
}

_P3 = f"""WITH RECURSIVE {_HELD},
k AS (SELECT trace_id, span_id, CASE WHEN parent <> '' THEN parent END parent FROM held),
b AS (SELECT DISTINCT regexp_replace(lower(trace_id),'[^0-9a-f]','','g') trace_id, regexp_replace(lower(root_span_id),'[^0-9a-f]','','g') root FROM trace_bundles),
e AS (SELECT c.trace_id, c.span_id, p.span_id parent FROM k c LEFT JOIN k p ON c.trace_id = p.trace_id AND c.parent = p.span_id),
walk AS (SELECT trace_id, span_id, [span_id] chain, parent nxt FROM e
  UNION ALL SELECT w.trace_id, w.span_id, list_append(w.chain, w.nxt), e.parent FROM walk w JOIN e ON e.trace_id = w.trace_id AND e.span_id = w.nxt WHERE NOT list_contains(w.chain, w.nxt)),
fin AS (SELECT trace_id, span_id, chain, nxt, list_position(chain, nxt) hit FROM walk WHERE nxt IS NULL OR list_contains(chain, nxt)),
res AS (SELECT f.trace_id, f.span_id, CASE WHEN nxt IS NULL THEN CASE WHEN b.root = chain[-1] THEN 'rooted' ELSE 'detached' END WHEN hit = 1 THEN 'cycle' ELSE 'below_cycle' END kind,
  CASE WHEN nxt IS NULL THEN chain[-1] ELSE list_min(chain[hit:]) END top_span_id, CAST(CASE WHEN nxt IS NULL THEN len(chain) - 1 ELSE hit - 1 END AS BIGINT) depth, chain
  FROM fin f LEFT JOIN b ON b.trace_id = f.trace_id) """
P3_SQL = {
    "p3_found": _P3 + "SELECT trace_id, span_id, kind, top_span_id, depth FROM res WHERE kind <> 'rooted'",
    "p3_hierarchy": _P3 + "SELECT trace_id, span_id, kind, top_span_id, depth, array_to_string(list_reverse(chain[1:depth + 1]), '/') path FROM res",
    "p3_descendants": _P3 + "SELECT trace_id, chain[CAST(d + 1 AS INT)] ancestor, span_id descendant, d distance FROM res, unnest(range(1, depth + 1)) t(d) WHERE kind IN ('rooted', 'detached')",
    "p3_all_descendants": _P3 + "SELECT trace_id, chain[CAST(d + 1 AS INT)] ancestor, span_id descendant, d distance, kind FROM res, unnest(range(1, depth + 1)) t(d)",
}
