"""Queries on the execution ledgers and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflux.functions.text import norm_id, norm_role
from folioflux.operators import tracing as tr
from folioflux.operators.hierarchy import resolve
from folioflux.operators.latest import latest_by
from folioflux.operators.prefix import running_totals
from folioflux.plans.ledger_queries import held_spans

S, E = "start_offset_ns", "end_offset_ns"
COLUMNS = ["parent_span_id", "run_type", "scope", "scope_id", "category", "operation", "attempt", S, E, "outcome", "role", "model", "effort", "harness", "batch_id", "concurrency_group", "token_reference"]


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def spans(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Spans that hold and have both ends in order."""
    need = dict.fromkeys([*cols, S, E])
    return held_spans(spark, sf, *need).filter(F.col(E) >= F.col(S))


def roots(spark: SparkSession, sf: str) -> DataFrame:
    b = read(spark, sf, "trace_bundles")
    return b.select(norm_id("trace_id").alias("trace_id"), norm_id("root_span_id").alias("span_id"), F.lit(True).alias("is_root")).distinct()


def _ns(start: str, end: str) -> F.Column:
    return F.col(end) - F.col(start)


def span_interval_union(spark, sf):
    return tr.interval_union(spans(spark, sf, "category").filter("category <> 'run'"), ["trace_id"], S, E)


def span_peak_concurrency(spark, sf):
    return tr.peak_concurrency(spans(spark, sf, "category").filter("category <> 'run'"), "trace_id", S, E)


def span_group_concurrency(spark, sf):
    return tr.group_concurrency(spans(spark, sf, "concurrency_group"), "trace_id", "concurrency_group", S, E)


def span_coverage(spark, sf):
    d = spans(spark, sf, "outcome", "attempt").join(roots(spark, sf), ["trace_id", "span_id"], "left")
    return tr.coverage(d, "trace_id", S, E, F.col("is_root"), F.col("outcome") != "success", F.col("attempt") > 1)


def _deep(spark, sf, *cols):
    d = held_spans(spark, sf, "parent_span_id", S, E, *cols).withColumn("parent", norm_id("parent_span_id"))
    depth = resolve(d, "trace_id", "span_id", "parent", S).select("trace_id", "span_id", "depth")
    return d.join(depth, ["trace_id", "span_id"]).filter(F.col(E) > F.col(S))


def span_exclusive_attribution(spark, sf):
    got = tr.exclusive_attribution(_deep(spark, sf, "category"), "trace_id", "span_id", S, E, "depth", "category")
    return tr.zero_filled(got, "trace_id", "category", "exclusive_ns", tr.CATEGORIES)


def span_gate_exclusive(spark, sf):
    d = _deep(spark, sf, "category", "operation").filter("category = 'gate'")
    return tr.exclusive_attribution(d, "trace_id", "span_id", S, E, "depth", "operation").groupBy("operation").agg(F.sum("exclusive_ns").alias("exclusive_ns"))


def span_slowest_topk(spark, sf):
    d = spans(spark, sf, "operation").withColumn("took_ns", _ns(S, E))
    return d.select("trace_id", "span_id", "operation", "took_ns", tr.format_elapsed("took_ns").alias("took")).orderBy(F.desc("took_ns"), "span_id", "trace_id").limit(10)


def span_slowest_per_phase(spark, sf):
    """The 20 slowest spans of each scope, by time, operation and place."""
    d = spans(spark, sf, "scope", "operation").withColumn("took_ns", _ns(S, E))
    w = Window.partitionBy("scope").orderBy(F.desc("took_ns"), "operation", "trace_id", "span_id")
    return d.withColumn("rank", F.row_number().over(w)).filter("rank <= 20").select("scope", "rank", "operation", "trace_id", "span_id", "took_ns")


def span_attempt_summary(spark, sf):
    d = spans(spark, sf, "category", "operation", "role", "attempt", "outcome").filter("category <> 'run'").withColumn("role", norm_role("role"))
    return tr.attempt_summary(d, ["operation", "role"], S, E)


def span_role_breakdown(spark, sf):
    """Attempts of each role and the waits of that role right below them."""
    d = spans(spark, sf, "category", "role", "outcome", "harness", "model", "parent_span_id").withColumn("role", norm_role("role")).filter("role is not null")
    own = d.filter("category = 'intelligence'")
    g = own.groupBy("role").agg(F.count("*").alias("attempt_count"), F.count_if(F.col("outcome") != "success").alias("failed_attempts"), F.sum(_ns(S, E)).alias("total_duration_ns"), F.concat_ws(",", F.array_sort(F.collect_set("harness"))).alias("harnesses"), F.concat_ws(",", F.array_sort(F.collect_set("model"))).alias("models"))
    waits = d.filter("category = 'wait'").withColumn("parent", norm_id("parent_span_id")).join(own.select("trace_id", "role", F.col("span_id").alias("parent")), ["trace_id", "role", "parent"], "left_semi")
    both = own.withColumn("what", F.lit("active")).unionByName(waits.drop("parent").withColumn("what", F.lit("wait")))
    u = tr.interval_union(both, ["trace_id", "role", "what"], S, E).groupBy("role").agg(*[F.coalesce(F.sum(F.when(F.col("what") == w, F.col("union_ns"))), F.lit(0)).alias(c) for w, c in (("active", "active_union_ns"), ("wait", "orchestrator_wait_ns"))])
    return g.join(u, "role", "left").na.fill(0, ["active_union_ns", "orchestrator_wait_ns"])


def span_p95_limits(spark, sf):
    """95 % rank of the durations of complete samples by role, venue, model and effort, and the limit
    recommended from it. Complete: successful, of a role, with a duration that is not negative."""
    d = spans(spark, sf, "category", "role", "harness", "model", "effort", "outcome", "duration_ns").filter("outcome = 'success' and category = 'intelligence' and duration_ns >= 0")
    for c in ("harness", "model", "effort"):
        d = d.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("default")))
    g = tr.nearest_rank(d.withColumn("role", norm_role("role")).filter("role is not null"), ["role", "harness", "model", "effort"], "duration_ns", 0.95, 5)
    return g.select("role", F.col("harness").alias("venue"), "model", "effort", "samples", F.col("p").cast("long").alias("p95_ns"), F.greatest(F.lit(60_000_000_000), F.ceil(F.col("p") * 1.5).cast("long")).alias("limit_ns"))


def span_token_references(spark, sf):
    d = held_spans(spark, sf, "token_reference").filter("token_reference is not null")
    t = F.col("token_reference")
    return d.groupBy(t["ledger"].alias("ledger"), t["cycle_id"].alias("cycle_id"), t["role"].alias("role")).agg(F.concat_ws(",", F.array_sort(F.collect_set("span_id"))).alias("span_ids"))


def span_batch_metrics(spark, sf):
    """Each trace as a batch. Its operations are put into the form batches have: the attempts of a role are
    a member's, a merge by that role commits the member, sets it apart if cancelled, lacks telemetry if
    interrupted. A member goes by the first eight digits of its role's digest."""
    d = spans(spark, sf, "category", "operation", "role", "attempt", "outcome").withColumn("role", norm_role("role"))
    root = d.join(roots(spark, sf), ["trace_id", "span_id"]).groupBy("trace_id").agg(F.max(_ns(S, E)).alias("makespan_ns"))
    named = F.col("role").isNotNull()
    verb = F.when(F.col("outcome") == "cancelled", "batch.quarantine.").when(F.col("outcome") == "interrupted", "batch.telemetry-incomplete.").otherwise("batch.commit.")
    prefix = F.when(named & (F.col("category") == "intelligence"), "role.cycle.").when(named & (F.col("operation") == "merge.batch"), verb)
    d = d.withColumn("operation", F.coalesce(F.concat(prefix, F.left(F.md5("role"), F.lit(8))), "operation"))
    return tr.batch_metrics(d.join(roots(spark, sf), ["trace_id", "span_id"], "left_anti"), root, "trace_id", S, E)


def span_recent_traces(spark, sf):
    """The five latest traces of each scope, oldest first."""
    b = read(spark, sf, "trace_bundles").select(norm_id("trace_id").alias("trace_id"), "scope", "scope_id", "finalized_at").distinct()
    w = Window.partitionBy("scope", "scope_id").orderBy(F.desc("finalized_at"), F.desc("trace_id"))
    return b.withColumn("back", F.row_number().over(w)).filter("back <= 5")


def span_trace_report(spark, sf):
    """One row per trace: scope, time, spans, categories and outcome of the root."""
    d = spans(spark, sf, "category", "outcome", "batch_id").join(roots(spark, sf), ["trace_id", "span_id"], "left")
    root = F.col("is_root")
    g = d.groupBy("trace_id").agg(F.count("*").alias("spans"), F.max(F.when(root, F.col("outcome"))).alias("outcome"), F.max(F.when(root, _ns(S, E))).alias("makespan_ns"), F.countDistinct("category").alias("categories"), F.count_if(F.col("outcome") == "timeout").alias("timeouts"), F.count_distinct("batch_id").alias("batches"))
    b = read(spark, sf, "trace_bundles").select(norm_id("trace_id").alias("trace_id"), "scope", "scope_id", "finalized_at").distinct()
    return b.join(g, "trace_id").select("trace_id", "scope", "scope_id", "finalized_at", "spans", "outcome", "makespan_ns", "categories", "timeouts", "batches")


def span_rebased(spark, sf):
    """Offsets from the first span of the same kind of run in each trace."""
    d = spans(spark, sf, "run_type")
    first = d.groupBy("trace_id", "run_type").agg(F.min(S).alias("origin"))
    return d.join(first, ["trace_id", "run_type"]).select("trace_id", "span_id", "run_type", (F.col(S) - F.col("origin")).alias("start_ns"), (F.col(E) - F.col("origin")).alias("end_ns"))


def span_wait_parents(spark, sf):
    """Waits directly below an intelligence span."""
    d = held_spans(spark, sf, "parent_span_id", "category", "operation").withColumn("parent", norm_id("parent_span_id"))
    p = d.filter("category = 'intelligence'").select("trace_id", F.col("span_id").alias("parent"))
    return d.filter("category = 'wait'").join(p, ["trace_id", "parent"], "left_semi").select("trace_id", "span_id", "operation")


def span_wait_reclassified(spark, sf):
    """Waits that count to an intelligence span anywhere above them, per trace, where the chain ends."""
    d = held_spans(spark, sf, "parent_span_id", "category", S, E).withColumn("parent", norm_id("parent_span_id"))
    up = tr.ancestors(d, "trace_id", "span_id", "parent", S).filter("kind in ('rooted', 'detached')")
    waits = d.filter(f"category = 'wait' and {E} > {S}").select("trace_id", "span_id", _ns(S, E).alias("n"))
    intel = d.filter("category = 'intelligence'").select("trace_id", F.col("span_id").alias("ancestor"))
    below = up.join(intel, ["trace_id", "ancestor"], "left_semi").select("trace_id", "span_id").distinct()
    return waits.join(below, ["trace_id", "span_id"], "left_semi").groupBy("trace_id").agg(F.count("*").alias("waits"), F.sum("n").alias("wait_ns"))


def span_review_passes(spark, sf):
    """Passes of reviewers and critics with both counts of findings, numbered by role within a trace."""
    d = held_spans(spark, sf, "category", "role", "findings_reported", "actionable_findings", S).withColumn("role", norm_role("role"))
    d = d.filter("category = 'intelligence' and role in ('reviewer', 'critic') and findings_reported is not null and actionable_findings is not null")
    d = d.withColumns({"key": F.concat_ws("|", "trace_id", "role"), "one": F.lit(1).cast("long")})
    n = running_totals(d, "key", [S, "span_id"], "one")
    return n.select("trace_id", "span_id", "role", "findings_reported", "actionable_findings", (F.col("before") + 1).cast("int").alias("pass"))


def span_violations(spark, sf):
    """The rules each delivered span breaks."""
    d = read(spark, sf, "spans").withColumn("codes", tr.span_violations())
    return d.filter(F.size("codes") > 0).select("ledger_pos", F.array_join("codes", ",").alias("codes"))


def span_bundle_violations(spark, sf):
    """Traces whose spans break the rules of a bundle: not one root at offset 0, parents missing, or
    children outside their parent."""
    d = held_spans(spark, sf, "parent_span_id", "category", S, E).withColumn("parent", norm_id("parent_span_id"))
    p = d.select("trace_id", F.col("span_id").alias("parent"), F.col(S).alias("ps"), F.col(E).alias("pe"), F.lit(True).alias("there"))
    j = d.join(p, ["trace_id", "parent"], "left")
    g = j.groupBy("trace_id").agg(
        F.count_if(F.col("parent").isNull()).alias("roots"), F.count_if(F.col("parent").isNull() & ((F.col(S) != 0) | (F.col("category") != "run"))).alias("bad_roots"),
        F.count_if(F.col("parent").isNotNull() & F.col("there").isNull()).alias("lost_parents"), F.count_if(F.coalesce((F.col(S) < F.col("ps")) | (F.col(E) > F.col("pe")), F.lit(False))).alias("outside_parent"))
    return g.filter("roots <> 1 or bad_roots > 0 or lost_parents > 0 or outside_parent > 0")


def span_redelivered(spark, sf):
    """Spans delivered more than once and whether the deliveries differ."""
    s = read(spark, sf, "spans")
    k = s.select(norm_id("trace_id").alias("trace_id"), norm_id("span_id").alias("span_id"), F.concat_ws("|", "operation", "outcome", F.col(S).cast("string"), F.coalesce(F.col(E).cast("string"), F.lit("-"))).alias("body"))
    return k.groupBy("trace_id", "span_id").agg(F.count("*").alias("deliveries"), F.countDistinct("body").alias("versions")).filter("deliveries > 1")


def span_category_projection(spark, sf):
    """United time per trace and category; categories may overlap."""
    return tr.interval_union(spans(spark, sf, "category"), ["trace_id", "category"], S, E)


def run_reports(spark, sf):
    """Managed runs with the report of their trace; runs without one stay, marked incomplete."""
    m = _runs(spark, sf)
    r = span_trace_report(spark, sf).select("trace_id", "spans", "makespan_ns", F.lit(True).alias("reported"))
    return m.join(r, "trace_id", "left").select("run_id", "trace_id", "lifecycle_state", "spans", "makespan_ns", F.coalesce("reported", F.lit(False)).alias("complete"))


def _runs(spark, sf):
    m = read(spark, sf, "managed_runs").withColumn("trace_id", norm_id("trace_id"))
    return latest_by(m.select("run_id", "cycle_id", "scope", "scope_id", "run_type", "operation", "batch_id", "trace_id", "updated_at", "lifecycle_state", "persistence_state", "error_code"), ["run_id"], "updated_at")


def run_unreported(spark, sf):
    """Runs that name no trace, or one that is not in the ledger."""
    b = read(spark, sf, "trace_bundles").select(norm_id("trace_id").alias("trace_id")).distinct()
    return _runs(spark, sf).join(b, "trace_id", "left_anti").select("run_id", "trace_id", "lifecycle_state")


def run_retention(spark, sf):
    """Runs past their time by the latest update of the table: 14 days in the state persisted, else 90."""
    m = _runs(spark, sf).withColumn("at", tr.epoch_ns("updated_at"))
    now = m.agg(F.max("at").alias("now"))
    days = F.when(F.col("lifecycle_state") == "persisted", 14).otherwise(90)
    return m.filter(F.col("at") < now.scalar() - days * F.lit(86_400_000_000_000)).select("run_id", "lifecycle_state", "updated_at")


def run_states(spark, sf):
    m = _runs(spark, sf)
    return m.groupBy("run_type", "lifecycle_state").agg(F.count("*").alias("runs"), F.count("error_code").alias("errors"), F.count("batch_id").alias("batched"))


def run_checkpoint_links(spark, sf):
    """Reports of checkpoints with the other project reports of their batch, and the cycles expected in the
    batch that none of those covers."""
    d = spans(spark, sf, "run_type", "batch_id").join(roots(spark, sf), ["trace_id", "span_id"])
    b = read(spark, sf, "trace_bundles").select(norm_id("trace_id").alias("trace_id"), (F.col("scope") == "project").alias("project")).groupBy("trace_id").agg(F.bool_or("project").alias("project"))
    r = d.groupBy("trace_id").agg(F.max("run_type").alias("run_type"), F.max("batch_id").alias("batch_id"), F.max(_ns(S, E)).alias("n")).filter("batch_id is not null").join(b, "trace_id")
    # Counted per batch and per batch and cycle, less the checkpoint itself: no pairs of reports are formed.
    child = r.filter("project")
    sums = child.groupBy("batch_id").agg(F.count("*").alias("all"), F.sum("n").alias("work"))
    m = _runs(spark, sf).filter("cycle_id is not null")
    links = m.select("trace_id", "cycle_id").distinct().join(child.select("trace_id", "batch_id"), "trace_id").groupBy("batch_id", "cycle_id").agg(F.count("*").alias("n"), F.min("trace_id").alias("only"))
    want = m.filter("batch_id is not null").select("batch_id", "cycle_id").distinct().join(links, ["batch_id", "cycle_id"], "left").filter("n is null or n = 1")
    want = want.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("cycle_id", "only"))).alias("open"))
    j = r.filter("run_type = 'checkpoint'").join(sums, "batch_id", "left").join(want, "batch_id", "left")
    mine = F.col("project").cast("long")
    missing = F.transform(F.filter("open", lambda x: x.only.isNull() | (x.only == F.col("trace_id"))), lambda x: x.cycle_id)
    return j.select(F.col("batch_id").alias("checkpoint_id"), F.col("trace_id").alias("outer_trace_id"), F.col("n").alias("outer_makespan_ns"), (F.coalesce("all", F.lit(0)) - mine).alias("children"), (F.coalesce("work", F.lit(0)) - mine * F.col("n")).alias("summed_child_work_ns"), F.coalesce(F.array_join(missing, ","), F.lit("")).alias("missing_child_cycles"))


def park_intervals(spark, sf):
    return tr.parks(read(spark, sf, "park_events")).drop("start_ns", "end_ns")


def park_totals(spark, sf):
    return tr.park_totals(tr.parks(read(spark, sf, "park_events")))


def park_violations(spark, sf):
    """Parks whose events are not one opening followed by one closing of the same park in the same boot."""
    e = read(spark, sf, "park_events").select("park_id", "event", "at", "boot_id", "phase_id", "reason").distinct()
    of = lambda kind, x: F.min(F.when(F.col("event") == kind, x))
    who = F.concat_ws("|", F.coalesce("phase_id", F.lit("-")), F.coalesce("reason", F.lit("-")))
    g = e.groupBy("park_id").agg(F.count_if(F.col("event") == "open").alias("opens"), F.count_if(F.col("event") == "close").alias("closes"), of("open", F.col("at")).alias("o"), of("close", F.col("at")).alias("c"), F.countDistinct("boot_id").alias("boots"), F.countDistinct(who).alias("names"))
    rules = [(F.col("opens") != 1, "not-one-opening"), (F.col("closes") > 1, "closed-again"), (F.col("closes") == 0, "still-open"), (F.col("c") < F.col("o"), "closed-before"), (F.col("boots") > 1, "other-boot"), (F.col("names") > 1, "other-identity")]
    codes = F.concat_ws(",", *[F.when(c, F.lit(k)) for c, k in rules])
    return g.select("park_id", "opens", "closes", codes.alias("codes")).filter("codes <> ''")


def phase_index(spark, sf):
    """Phases by the day of their first trace, with the phase before and after, in semantic order:
    dotted numbers by their parts, names after them."""
    d = held_spans(spark, sf, "operation", "started_at").filter(F.col("operation").startswith("phase."))
    g = d.groupBy(F.substring("operation", 7, 200).alias("phase")).agg(F.min("started_at").alias("first"), F.count("*").alias("traces"))
    parts = F.transform(F.split("phase", r"\."), lambda x: F.lpad(x, 12, "0"))
    key = F.when(F.col("phase").rlike(r"^\d+(\.\d+)*$"), F.concat(F.lit("0"), F.array_join(parts, "."))).otherwise(F.concat(F.lit("1"), F.col("phase")))
    w = Window.orderBy("key")  # one row per phase, not per span
    return g.withColumn("key", key).select("phase", F.substring("first", 1, 10).alias("day"), F.concat(F.substring("first", 1, 7), F.lit("-w"), (F.floor((F.substring("first", 9, 2).cast("int") - 1) / 7) + 1).cast("string")).alias("week"), "traces", F.lag("phase").over(w).alias("before"), F.lead("phase").over(w).alias("after"))


_N = "regexp_replace(lower({0}),'[^0-9a-f]','','g')"
_T, _I, _P = _N.format("trace_id"), _N.format("span_id"), _N.format("parent_span_id")
H = f"""h AS (SELECT * EXCLUDE (trace_id, span_id, rn, role, parent_span_id), tid trace_id, sid span_id, nullif(pid,'') parent, nullif(lower(regexp_replace(role,'^\\s+|\\s+$','','g')),'') role, role raw_role
  FROM (SELECT *, {_T} tid, {_I} sid, {_P} pid, row_number() OVER (PARTITION BY {_T}, {_I} ORDER BY ledger_pos DESC) rn FROM spans) WHERE rn = 1),
v AS (SELECT *, start_offset_ns s, end_offset_ns e FROM h WHERE end_offset_ns >= start_offset_ns)"""
R = f"r AS (SELECT DISTINCT {_T} trace_id, {_N.format('root_span_id')} span_id FROM trace_bundles)"


def _union(rows: str, keys: str, out: str = "u") -> str:
    return f"""{out}0 AS (SELECT DISTINCT {keys}, s, e FROM {rows}), {out}1 AS (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pm FROM {out}0 WHERE e > s),
{out} AS (SELECT {keys}, CAST(sum(greatest(0, e - greatest(s, coalesce(pm, s)))) AS BIGINT) union_ns FROM {out}1 GROUP BY ALL)"""


def _peak(rows: str, keys: str, out: str = "p") -> str:
    return f"""{out}0 AS (SELECT {keys}, s t, 1 d FROM {rows} UNION ALL SELECT {keys}, e, -1 FROM {rows}), {out}1 AS (SELECT {keys}, sum(d) OVER (PARTITION BY {keys} ORDER BY t, d ROWS UNBOUNDED PRECEDING) n FROM {out}0),
{out} AS (SELECT {keys}, CAST(greatest(0, max(n)) AS BIGINT) peak FROM {out}1 GROUP BY ALL)"""


_DEPTH = f"""{R}, k AS (SELECT trace_id, span_id, parent FROM h), walk AS (SELECT trace_id, span_id, [span_id] chain, parent nxt FROM k UNION ALL SELECT w.trace_id, w.span_id, list_append(w.chain, w.nxt), k.parent FROM walk w JOIN k ON k.trace_id = w.trace_id AND k.span_id = w.nxt WHERE NOT list_contains(w.chain, w.nxt)),
fin AS (SELECT w.trace_id, w.span_id, chain, CASE WHEN k.span_id IS NULL THEN len(chain) - 1 ELSE list_position(chain, nxt) - 1 END depth, k.span_id IS NULL ends FROM walk w LEFT JOIN k ON k.trace_id = w.trace_id AND k.span_id = w.nxt WHERE w.nxt IS NULL OR k.span_id IS NULL OR list_contains(chain, nxt)),
dp AS (SELECT trace_id, span_id, s, e, category, operation, depth FROM v JOIN fin USING (trace_id, span_id) WHERE e > s)"""


def _exclusive(rows: str, label: str) -> str:
    return f"""pt AS (SELECT DISTINCT trace_id, t FROM (SELECT trace_id, s t FROM {rows} UNION ALL SELECT trace_id, e FROM {rows})), atm AS (SELECT trace_id, t, lead(t) OVER (PARTITION BY trace_id ORDER BY t) u FROM pt),
hit AS (SELECT a.trace_id, a.t, a.u, {label}, row_number() OVER (PARTITION BY a.trace_id, a.t ORDER BY depth DESC, e - s, span_id DESC) rn FROM atm a JOIN {rows} d ON d.trace_id = a.trace_id AND d.s <= a.t AND d.e >= a.u WHERE a.u IS NOT NULL),
x AS (SELECT trace_id, {label}, CAST(sum(u - t) AS BIGINT) exclusive_ns FROM hit WHERE rn = 1 GROUP BY ALL)"""


_RUNS = f"""m AS (SELECT * EXCLUDE (trace_id, rn), nullif({_T},'') trace_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY updated_at DESC NULLS LAST) rn FROM (SELECT DISTINCT * FROM managed_runs)) WHERE rn = 1)"""
_REPORT = f"""{R}, b AS (SELECT DISTINCT {_T} trace_id, scope, scope_id, finalized_at FROM trace_bundles),
g AS (SELECT v.trace_id, count(*) spans, max(outcome) FILTER (r.span_id IS NOT NULL) outcome, max(e - s) FILTER (r.span_id IS NOT NULL) makespan_ns, count(DISTINCT category) categories, count(*) FILTER (outcome = 'timeout') timeouts, count(DISTINCT batch_id) batches FROM v LEFT JOIN r USING (trace_id, span_id) GROUP BY v.trace_id),
rep AS (SELECT b.trace_id, b.scope, b.scope_id, finalized_at, spans, outcome, makespan_ns, categories, timeouts, batches FROM b JOIN g USING (trace_id))"""
_EPOCH = "(epoch_us(CAST({0} AS TIMESTAMP)) * 1000)"
_PARKS = f"""pe AS (SELECT DISTINCT park_id, phase_id, reason, event, boot_id, monotonic_ns, {_EPOCH.format('"at"')} at_ns FROM park_events WHERE park_id IS NOT NULL),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY park_id ORDER BY at_ns, boot_id, monotonic_ns) rn FROM pe WHERE event = 'open') WHERE rn = 1), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY park_id ORDER BY at_ns, boot_id, monotonic_ns) rn FROM pe WHERE event = 'close') WHERE rn = 1),
pk AS (SELECT o.park_id, o.phase_id, o.reason, o.boot_id, o.monotonic_ns start_ns, c.monotonic_ns end_ns, o.at_ns opened_ns, c.at_ns closed_ns, CASE WHEN o.boot_id = c.boot_id THEN c.monotonic_ns - o.monotonic_ns ELSE c.at_ns - o.at_ns END duration_ns, coalesce(o.boot_id = c.boot_id, false) exact,
  CASE WHEN c.park_id IS NULL THEN 'open' WHEN o.boot_id = c.boot_id THEN 'monotonic' ELSE 'calendar' END AS "method" FROM o LEFT JOIN c USING (park_id))"""
_HEX, _TOK = "'[0-9a-f]{32}'", "'[A-Za-z0-9][A-Za-z0-9._:/+-]{0,127}'"
_RULES = [
    ("schema", "coalesce(schema = 'execution_span.v1', false)"), ("trace_id", f"coalesce(regexp_full_match(trace_id, {_HEX}), false)"), ("span_id", f"coalesce(regexp_full_match(span_id, {_HEX}), false)"), ("parent_span_id", f"parent_span_id IS NULL OR regexp_full_match(parent_span_id, {_HEX})"),
    ("run_type", f"coalesce(regexp_full_match(run_type, {_TOK}), false)"), ("scope", "coalesce(scope IN ('engine','project','catalog'), false)"), ("scope_id", f"coalesce(regexp_full_match(scope_id, {_TOK}), false)"), ("category", "coalesce(category IN ('run','intelligence','gate','reconciliation','wait'), false)"),
    ("operation", f"coalesce(regexp_full_match(operation, {_TOK}), false)"), ("attempt", "coalesce(attempt >= 1, false)"), ("times", "coalesce(start_offset_ns >= 0 AND end_offset_ns >= start_offset_ns, false)"), ("duration", "coalesce(duration_ns = end_offset_ns - start_offset_ns, false)"),
    ("outcome", "coalesce(outcome IN ('success','error','timeout','cancelled','interrupted'), false)"), ("exit_code", "exit_code IS NULL OR NOT coalesce((outcome = 'success' AND exit_code <> 0) OR (outcome = 'timeout' AND exit_code <> 124) OR (outcome IN ('error','cancelled','interrupted') AND exit_code = 0), false)"),
    ("timeout", "CASE WHEN outcome = 'timeout' THEN coalesce(timeout_kind IN ('command','first-event','idle','hard') AND timeout_ns >= 1, false) ELSE timeout_kind IS NULL AND timeout_ns IS NULL END")]
_CODES = "array_to_string(list_filter([" + ",".join(f"CASE WHEN NOT ({ok}) THEN '{name}' END" for name, ok in _RULES) + "], lambda x: x IS NOT NULL), ',')"
_TAKE = "CASE WHEN t < 60000 THEN format('{}.{:03d}s', t // 1000, t % 1000) WHEN t // 3600000 > 0 THEN format('{}h {}m {}s', t // 3600000, t // 60000 % 60, t // 1000 % 60) ELSE format('{}m {}s', t // 60000, t // 1000 % 60) END"

SQL = {
    "span_interval_union": f"WITH {H}, q AS (SELECT * FROM v WHERE category <> 'run'), {_union('q', 'trace_id')} SELECT * FROM u",
    "span_peak_concurrency": f"WITH {H}, q AS (SELECT * FROM v WHERE category <> 'run'), {_peak('q', 'trace_id')} SELECT * FROM p",
    "span_group_concurrency": f"""WITH {H}, q AS (SELECT * FROM v WHERE concurrency_group IS NOT NULL), {_union('q', 'trace_id, concurrency_group')}, {_peak('q', 'trace_id, concurrency_group')},
g AS (SELECT trace_id, concurrency_group, count(*) spans, CAST(sum(e - s) AS BIGINT) summed_ns, max(e) - min(s) window_ns FROM q GROUP BY ALL)
SELECT g.*, coalesce(union_ns, 0) union_ns, summed_ns - coalesce(union_ns, 0) overlap_ns, peak, CASE WHEN window_ns > 0 THEN summed_ns / window_ns ELSE 0.0 END ratio FROM g LEFT JOIN u USING (trace_id, concurrency_group) LEFT JOIN p USING (trace_id, concurrency_group)""",
    "span_coverage": f"""WITH {H}, {R}, vr AS (SELECT v.*, r.span_id IS NOT NULL is_root FROM v LEFT JOIN r USING (trace_id, span_id)), q1 AS (SELECT * FROM vr WHERE NOT is_root), q2 AS (SELECT * FROM q1 WHERE outcome <> 'success'), q3 AS (SELECT * FROM q1 WHERE attempt > 1), {_union('q1', 'trace_id', 'a')}, {_union('q2', 'trace_id', 'b')}, {_union('q3', 'trace_id', 'c')},
g AS (SELECT trace_id, max(e - s) FILTER (is_root) makespan_ns FROM vr GROUP BY 1) SELECT g.trace_id, makespan_ns, coalesce(a.union_ns, 0) covered_ns, greatest(makespan_ns - coalesce(a.union_ns, 0), 0) unattributed_ns, coalesce(b.union_ns, 0) failed_ns, coalesce(c.union_ns, 0) retried_ns FROM g LEFT JOIN a USING (trace_id) LEFT JOIN b USING (trace_id) LEFT JOIN c USING (trace_id)""",
    "span_exclusive_attribution": f"WITH RECURSIVE {H}, {_DEPTH}, {_exclusive('dp', 'category')} SELECT t.trace_id, c.category, coalesce(exclusive_ns, 0) exclusive_ns FROM (SELECT DISTINCT trace_id FROM dp) t CROSS JOIN (SELECT unnest({list(tr.CATEGORIES)}) category) c LEFT JOIN x USING (trace_id, category)",
    "span_gate_exclusive": f"WITH RECURSIVE {H}, {_DEPTH}, gt AS (SELECT * FROM dp WHERE category = 'gate'), {_exclusive('gt', 'operation')} SELECT operation, CAST(sum(exclusive_ns) AS BIGINT) exclusive_ns FROM x GROUP BY 1",
    "span_slowest_topk": f"WITH {H} SELECT trace_id, span_id, operation, took_ns, {_TAKE} took FROM (SELECT trace_id, span_id, operation, e - s took_ns, (e - s) // 1000000 t FROM v ORDER BY 4 DESC, span_id, trace_id LIMIT 10)",
    "span_slowest_per_phase": f"WITH {H} SELECT * FROM (SELECT scope, CAST(row_number() OVER (PARTITION BY scope ORDER BY e - s DESC, operation, trace_id, span_id) AS INT) rank, operation, trace_id, span_id, e - s took_ns FROM v) WHERE rank <= 20",
    "span_attempt_summary": f"WITH {H} SELECT operation, role, count(*) spans, max(attempt) max_attempt, count(*) FILTER (outcome <> 'success') failed, CAST(sum(e - s) AS BIGINT) summed_ns FROM v WHERE category <> 'run' GROUP BY ALL HAVING count(*) > 1 OR max(attempt) > 1",
    "span_role_breakdown": f"""WITH {H}, q AS (SELECT * FROM v WHERE role IS NOT NULL AND category = 'intelligence'), w AS (SELECT * FROM v WHERE role IS NOT NULL AND category = 'wait' AND EXISTS (SELECT 1 FROM q WHERE q.trace_id = v.trace_id AND q.span_id = v.parent AND q.role = v.role)), {_union('q', 'trace_id, role', 'a')}, {_union('w', 'trace_id, role', 'b')},
g AS (SELECT role, count(*) attempt_count, count(*) FILTER (outcome <> 'success') failed_attempts, CAST(sum(e - s) AS BIGINT) total_duration_ns, coalesce(string_agg(DISTINCT harness, ',' ORDER BY harness), '') harnesses, coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '') models FROM q GROUP BY 1)
SELECT g.*, coalesce(x.n, 0) active_union_ns, coalesce(y.n, 0) orchestrator_wait_ns FROM g LEFT JOIN (SELECT role, CAST(sum(union_ns) AS BIGINT) n FROM a GROUP BY 1) x USING (role) LEFT JOIN (SELECT role, CAST(sum(union_ns) AS BIGINT) n FROM b GROUP BY 1) y USING (role)""",
    "span_p95_limits": f"""WITH {H} SELECT role, venue, model, effort, samples, p95_ns, greatest(60000000000, CAST(ceil(p95_ns * 1.5) AS BIGINT)) limit_ns FROM (SELECT role, coalesce(nullif(harness, ''), 'default') venue, coalesce(nullif(model, ''), 'default') model, coalesce(nullif(effort, ''), 'default') effort, count(*) samples, quantile_disc(duration_ns, 0.95) p95_ns FROM v WHERE outcome = 'success' AND category = 'intelligence' AND role IS NOT NULL AND duration_ns >= 0 GROUP BY 1, 2, 3, 4) WHERE samples >= 5""",
    "span_token_references": f"WITH {H} SELECT token_reference.ledger AS ledger, token_reference.cycle_id AS cycle_id, token_reference.role AS role, string_agg(DISTINCT span_id, ',' ORDER BY span_id) span_ids FROM h WHERE token_reference IS NOT NULL GROUP BY 1, 2, 3",
    "span_batch_metrics": f"""WITH {H}, {R}, rt AS (SELECT trace_id, max(e - s) span FROM v JOIN r USING (trace_id, span_id) GROUP BY 1),
d AS (SELECT trace_id, s, e, e - s n, attempt, outcome, CASE WHEN role IS NOT NULL AND category = 'intelligence' THEN left(md5(role), 8) END who, CASE WHEN role IS NOT NULL AND category <> 'intelligence' AND operation = 'merge.batch' THEN left(md5(role), 8) END merged FROM v WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.trace_id = v.trace_id AND r.span_id = v.span_id)),
mq AS (SELECT * FROM d WHERE who IS NOT NULL), {_union('mq', 'trace_id')}, {_peak('mq', 'trace_id')},
k AS (SELECT trace_id, count(DISTINCT merged) FILTER (outcome = 'success') committed, count(DISTINCT merged) FILTER (outcome = 'cancelled') quarantined, count(DISTINCT merged) FILTER (outcome = 'interrupted') lacking FROM d GROUP BY 1),
per AS (SELECT trace_id, who, count(*) tries, max(attempt) top, bool_and(outcome <> 'success') lost, sum(n) AS "work", min(s) s, max(e) e, EXISTS (SELECT 1 FROM d c WHERE c.trace_id = mq.trace_id AND c.merged = mq.who AND c.outcome = 'success') done FROM mq GROUP BY ALL),
m AS (SELECT trace_id, count(*) launched, count(*) FILTER (lost) failed, count(*) FILTER (tries > 1 OR top > 1) retried, CAST(sum("work") AS BIGINT) summed, CAST(coalesce(sum("work") FILTER (done), 0) AS BIGINT) good, max(e) - min(s) win FROM per GROUP BY 1)
SELECT trace_id, span batch_makespan_ns, coalesce(launched, 0) launched_members, coalesce(committed, 0) committed_members, coalesce(quarantined, 0) quarantined_members, coalesce(failed, 0) failed_members, coalesce(retried, 0) retried_members, coalesce(lacking, 0) telemetry_incomplete_members, coalesce(summed, 0) summed_member_work_ns, coalesce(good, 0) committed_member_work_ns,
CASE WHEN committed > 0 THEN span // committed END wall_clock_per_committed_work_unit_ns, CASE WHEN coalesce(committed, 0) = 0 THEN 'no committed members' END wall_clock_per_committed_work_unit_reason, coalesce(union_ns, 0) member_active_union_ns, coalesce(win, 0) member_window_ns, coalesce(summed, 0) - coalesce(union_ns, 0) overlap_ns, coalesce(peak, 0) peak_concurrency,
CASE WHEN win > 0 THEN summed / win END member_work_to_window_ratio, CASE WHEN span <> 0 THEN coalesce(good, 0) / span END observed_parallel_speedup, CASE WHEN span = 0 THEN 'zero batch makespan' END observed_parallel_speedup_reason FROM rt LEFT JOIN k USING (trace_id) LEFT JOIN m USING (trace_id) LEFT JOIN u USING (trace_id) LEFT JOIN p USING (trace_id)""",
    "span_recent_traces": f"WITH b AS (SELECT DISTINCT {_T} trace_id, scope, scope_id, finalized_at FROM trace_bundles) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scope, scope_id ORDER BY finalized_at DESC, trace_id DESC) AS INT) back FROM b) WHERE back <= 5",
    "span_trace_report": f"WITH {H}, {_REPORT} SELECT * FROM rep",
    "span_rebased": f"WITH {H} SELECT trace_id, span_id, run_type, s - min(s) OVER w start_ns, e - min(s) OVER w end_ns FROM v WINDOW w AS (PARTITION BY trace_id, run_type)",
    "span_wait_parents": f"WITH {H} SELECT trace_id, span_id, operation FROM h w WHERE category = 'wait' AND EXISTS (SELECT 1 FROM h p WHERE p.category = 'intelligence' AND p.trace_id = w.trace_id AND p.span_id = w.parent)",
    "span_wait_reclassified": f"WITH RECURSIVE {H}, {_DEPTH}, up AS (SELECT trace_id, span_id, unnest(chain[2:]) anc FROM fin WHERE ends) SELECT trace_id, count(*) waits, CAST(sum(e - s) AS BIGINT) wait_ns FROM v WHERE category = 'wait' AND e > s AND EXISTS (SELECT 1 FROM up JOIN h i ON i.trace_id = up.trace_id AND i.span_id = up.anc WHERE i.category = 'intelligence' AND up.trace_id = v.trace_id AND up.span_id = v.span_id) GROUP BY 1",
    "span_review_passes": f"WITH {H} SELECT trace_id, span_id, role, findings_reported, actionable_findings, CAST(row_number() OVER (PARTITION BY trace_id, role ORDER BY start_offset_ns, span_id) AS INT) pass FROM h WHERE category = 'intelligence' AND role IN ('reviewer','critic') AND findings_reported IS NOT NULL AND actionable_findings IS NOT NULL",
    "span_violations": f"SELECT ledger_pos, codes FROM (SELECT ledger_pos, {_CODES} codes FROM spans) WHERE codes <> ''",
    "span_bundle_violations": f"""WITH {H}, g AS (SELECT c.trace_id, count(*) FILTER (c.parent IS NULL) roots, count(*) FILTER (c.parent IS NULL AND (c.start_offset_ns <> 0 OR c.category <> 'run')) bad_roots, count(*) FILTER (c.parent IS NOT NULL AND p.span_id IS NULL) lost_parents,
count(*) FILTER (coalesce(c.start_offset_ns < p.start_offset_ns OR c.end_offset_ns > p.end_offset_ns, false)) outside_parent FROM h c LEFT JOIN h p ON p.trace_id = c.trace_id AND p.span_id = c.parent GROUP BY 1) SELECT * FROM g WHERE roots <> 1 OR bad_roots > 0 OR lost_parents > 0 OR outside_parent > 0""",
    "span_redelivered": f"SELECT {_T} trace_id, {_I} span_id, count(*) deliveries, count(DISTINCT concat_ws('|', operation, outcome, start_offset_ns, coalesce(CAST(end_offset_ns AS VARCHAR), '-'))) versions FROM spans GROUP BY 1, 2 HAVING count(*) > 1",
    "span_category_projection": f"WITH {H}, {_union('v', 'trace_id, category')} SELECT * FROM u",
    "run_reports": f"WITH {H}, {_REPORT}, {_RUNS} SELECT run_id, m.trace_id, lifecycle_state, spans, makespan_ns, rep.trace_id IS NOT NULL complete FROM m LEFT JOIN rep ON rep.trace_id = m.trace_id",
    "run_unreported": f"WITH {_RUNS} SELECT run_id, trace_id, lifecycle_state FROM m WHERE trace_id IS NULL OR trace_id NOT IN (SELECT {_T} FROM trace_bundles)",
    "run_retention": f"WITH {_RUNS} SELECT run_id, lifecycle_state, updated_at FROM m, (SELECT max({_EPOCH.format('updated_at')}) n FROM m) WHERE {_EPOCH.format('updated_at')} < n - CASE WHEN lifecycle_state = 'persisted' THEN 14 ELSE 90 END * 86400000000000",
    "run_states": f"WITH {_RUNS} SELECT run_type, lifecycle_state, count(*) runs, count(error_code) errors, count(batch_id) batched FROM m GROUP BY 1, 2",
    "run_checkpoint_links": f"""WITH {H}, {R}, {_RUNS}, q AS (SELECT trace_id, max(run_type) run_type, max(batch_id) batch_id, max(e - s) n FROM v JOIN r USING (trace_id, span_id) GROUP BY 1), rp AS (SELECT q.*, project FROM q JOIN (SELECT {_T} trace_id, bool_or(scope = 'project') project FROM trace_bundles GROUP BY 1) USING (trace_id) WHERE batch_id IS NOT NULL),
ch AS (SELECT o.trace_id, count(*) n, CAST(sum(c.n) AS BIGINT) AS "work" FROM rp o JOIN rp c ON c.batch_id = o.batch_id AND c.trace_id <> o.trace_id AND c.project GROUP BY 1), lk AS (SELECT DISTINCT o.trace_id, m.cycle_id FROM rp o JOIN rp c ON c.batch_id = o.batch_id AND c.trace_id <> o.trace_id AND c.project JOIN m ON m.trace_id = c.trace_id WHERE m.cycle_id IS NOT NULL),
ms AS (SELECT o.trace_id, string_agg(DISTINCT m.cycle_id, ',' ORDER BY m.cycle_id) c FROM rp o JOIN m ON m.batch_id = o.batch_id LEFT JOIN lk ON lk.trace_id = o.trace_id AND lk.cycle_id = m.cycle_id WHERE m.cycle_id IS NOT NULL AND lk.cycle_id IS NULL GROUP BY 1)
SELECT o.batch_id checkpoint_id, o.trace_id outer_trace_id, o.n outer_makespan_ns, coalesce(ch.n, 0) children, coalesce(ch.work, 0) summed_child_work_ns, coalesce(ms.c, '') missing_child_cycles FROM rp o LEFT JOIN ch USING (trace_id) LEFT JOIN ms USING (trace_id) WHERE o.run_type = 'checkpoint'""",
    "park_intervals": f"WITH {_PARKS} SELECT * EXCLUDE (start_ns, end_ns) FROM pk",
    "park_totals": f"""WITH {_PARKS}, z AS (SELECT * FROM pk WHERE phase_id IS NOT NULL), q1 AS (SELECT phase_id, boot_id, start_ns s, end_ns e FROM z WHERE exact), q2 AS (SELECT phase_id, opened_ns s, closed_ns e FROM z WHERE closed_ns IS NOT NULL), {_union('q1', 'phase_id, boot_id', 'a')}, {_union('q2', 'phase_id', 'b')},
g AS (SELECT phase_id, count(*) parks, bool_and(exact) exact, bool_or(duration_ns IS NULL) op FROM z GROUP BY 1), am AS (SELECT phase_id, CAST(sum(union_ns) AS BIGINT) n FROM a GROUP BY 1)
SELECT phase_id, parks, CASE WHEN op THEN 'incomplete' WHEN exact THEN 'monotonic-union' ELSE 'calendar-union-cross-boot' END AS "method", CASE WHEN NOT op THEN CASE WHEN exact THEN coalesce(am.n, 0) ELSE coalesce(b.union_ns, 0) END END total_ns FROM g LEFT JOIN am USING (phase_id) LEFT JOIN b USING (phase_id)""",
    "park_violations": """WITH e AS (SELECT DISTINCT park_id, event, "at" tm, boot_id, phase_id, reason FROM park_events), g AS (SELECT park_id, count(*) FILTER (event = 'open') opens, count(*) FILTER (event = 'close') closes, min(tm) FILTER (event = 'open') o, min(tm) FILTER (event = 'close') c, count(DISTINCT boot_id) boots, count(DISTINCT coalesce(phase_id, '-') || '|' || coalesce(reason, '-')) names FROM e GROUP BY 1)
SELECT * FROM (SELECT park_id, opens, closes, concat_ws(',', CASE WHEN opens <> 1 THEN 'not-one-opening' END, CASE WHEN closes > 1 THEN 'closed-again' END, CASE WHEN closes = 0 THEN 'still-open' END, CASE WHEN c < o THEN 'closed-before' END, CASE WHEN boots > 1 THEN 'other-boot' END, CASE WHEN names > 1 THEN 'other-identity' END) codes FROM g) WHERE codes <> ''""",
    "phase_index": f"""WITH {H}, g AS (SELECT substr(operation, 7) phase, min(started_at) f, count(*) traces FROM h WHERE starts_with(operation, 'phase.') GROUP BY 1), k AS (SELECT *, CASE WHEN regexp_full_match(phase, '\\d+(\\.\\d+)*') THEN '0' || array_to_string(list_transform(string_split(phase, '.'), lambda x: lpad(x, 12, '0')), '.') ELSE '1' || phase END AS k FROM g)
SELECT phase, substr(f, 1, 10) AS "day", substr(f, 1, 7) || '-w' || CAST((CAST(substr(f, 9, 2) AS INT) - 1) // 7 + 1 AS VARCHAR) AS week, traces, lag(phase) OVER (ORDER BY k) AS "before", lead(phase) OVER (ORDER BY k) AS "after" FROM k""",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}
