"""Analytics over execution spans: coverage, concurrency, attribution, attempts, batches, limits.

A trace may hold a third of all spans. Where a result needs the order of a trace's spans (unions,
running sums) it goes through the range-sorted operators; everything else is plain partial
aggregation or an equi join.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.operators.hierarchy import resolve
from folioflux.operators.islands import periods_and_gaps
from folioflux.operators.prefix import running_totals
from folioflux.operators.sweep import strongest_time

CATEGORIES = ("run", "intelligence", "gate", "reconciliation", "wait")
OUTCOMES = ("success", "error", "timeout", "cancelled", "interrupted")
SCOPES = ("engine", "project", "catalog")
TIMEOUT_KINDS = ("command", "first-event", "idle", "hard")
PARK_REASONS = ("approval", "decision", "manual-check", "environment-action", "acceptance", "required-input")


def interval_union(df: DataFrame, keys: list[str], start: str, end: str, out: str = "union_ns") -> DataFrame:
    """Time covered per key; touching and overlapping intervals count once."""
    p = periods_and_gaps(df, keys, start, end).filter("kind = 'period'")
    return p.groupBy(*[f"`{k}`" for k in keys]).agg(F.sum(F.col(end) - F.col(start)).alias(out))


def peak_concurrency(df: DataFrame, key: str, start: str, end: str, out: str = "peak") -> DataFrame:
    """Most intervals open at once per key; an interval that ends when another starts does not
    overlap it. Intervals with a null bound are left out."""
    at = df.select(F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e")).filter("s is not null and e is not null")
    events = at.select("k", F.col("s").alias("t"), F.lit(1).cast("long").alias("d")).unionByName(at.select("k", F.col("e").alias("t"), F.lit(-1).cast("long").alias("d")))
    # one row per moment: what ends there goes before what starts there, so only the sum counts
    run = running_totals(events.groupBy("k", "t").agg(F.sum("d").alias("d")), "k", ["t"], "d")
    return run.groupBy(F.col("k").alias(key)).agg(F.greatest(F.max(F.col("before") + F.col("d")), F.lit(0)).alias(out))


def group_concurrency(df: DataFrame, key: str, group: str, start: str, end: str) -> DataFrame:
    """Per key and group: count, summed and united time, window, overlap, peak and summed-to-window
    ratio (0 for an empty window)."""
    one = F.concat_ws("\x01", key, group)
    d = df.filter(F.col(group).isNotNull() & (F.col(end) >= F.col(start))).withColumn("kg", one)
    base = d.groupBy("kg", key, group).agg(F.count("*").alias("spans"), F.sum(F.col(end) - F.col(start)).alias("summed_ns"), (F.max(end) - F.min(start)).alias("window_ns"))
    out = base.join(interval_union(d, ["kg"], start, end), "kg", "left").join(peak_concurrency(d, "kg", start, end), "kg", "left")
    out = out.withColumn("union_ns", F.coalesce("union_ns", F.lit(0)))
    return out.select(key, group, "spans", "summed_ns", "window_ns", "union_ns", (F.col("summed_ns") - F.col("union_ns")).alias("overlap_ns"), "peak", F.when(F.col("window_ns") > 0, F.col("summed_ns") / F.col("window_ns")).otherwise(F.lit(0.0)).alias("ratio"))


def coverage(df: DataFrame, key: str, start: str, end: str, root: Column, failed: Column, retried: Column) -> DataFrame:
    """Per key: makespan of the root, time covered by the other spans, what is unattributed, and the time
    under failed and under repeated ones of them. One range sort serves the three unions."""
    z = lambda c: F.coalesce(c, F.lit(False))
    base = df.groupBy(key).agg(F.max(F.when(root, F.col(end) - F.col(start))).alias("makespan_ns"))
    what = F.filter(F.array(F.lit("covered_ns"), F.when(z(failed), F.lit("failed_ns")), F.when(z(retried), F.lit("retried_ns"))), lambda x: x.isNotNull())
    parts = interval_union(df.filter(~z(root)).select(key, start, end, F.explode(what).alias("what")), [key, "what"], start, end)
    g = parts.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("what") == c, F.col("union_ns"))), F.lit(0)).alias(c) for c in ("covered_ns", "failed_ns", "retried_ns")])
    j = base.join(g, key, "left").na.fill(0, ["covered_ns", "failed_ns", "retried_ns"])
    return j.select(key, "makespan_ns", "covered_ns", F.greatest(F.col("makespan_ns") - F.col("covered_ns"), F.lit(0)).alias("unattributed_ns"), "failed_ns", "retried_ns")


def exclusive_attribution(df: DataFrame, key: str, span: str, start: str, end: str, depth: str, label: str, partitions: int | None = None) -> DataFrame:
    """Per key and label the time in which a span of that label was the one at work: among those open the
    deepest, then the shortest, then the one with the largest id. See :mod:`folioflux.operators.sweep`."""
    return strongest_time(df, key, span, start, end, depth, label, "exclusive_ns", partitions)


def zero_filled(df: DataFrame, key: str, label: str, value: str, labels: tuple[str, ...]) -> DataFrame:
    """A row for each of a fixed list of labels under every key, 0 where there was none."""
    pivot = df.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col(label) == x, F.col(value))), F.lit(0)).alias(x) for x in labels])
    return pivot.select(key, F.explode(F.array(*[F.struct(F.lit(x).alias(label), F.col(f"`{x}`").alias(value)) for x in labels])).alias("r")).select(key, f"r.{label}", f"r.{value}")


def ancestors(df: DataFrame, key: str, span: str, parent: str, position: str, is_root: str | None = None) -> DataFrame:
    """(key, span, ancestor, distance, kind) for every span above another, from hierarchy paths; below a
    circle (kind below_cycle) up to its first span on the circle."""
    got = resolve(df, key, span, parent, position, is_root, with_paths=True)
    up = got.select(key, F.col(span), "kind", F.col("depth").alias("d"), F.posexplode("path").alias("at", "ancestor"))
    return up.filter(F.col("ancestor") != F.col(span)).select(key, span, "ancestor", (F.col("d") - F.col("at")).cast("long").alias("distance"), "kind")


def attempt_summary(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Operations tried more than once, by count or by attempt number."""
    g = df.groupBy(*by).agg(F.count("*").alias("spans"), F.max("attempt").alias("max_attempt"), F.count_if(F.col("outcome") != "success").alias("failed"), F.sum(F.col(end) - F.col(start)).alias("summed_ns"))
    return g.filter("spans > 1 or max_attempt > 1")


def nearest_rank(df: DataFrame, by: list[str], value: str, share: float, at_least: int) -> DataFrame:
    """(by..., samples, p): the smallest value below or at which at least ``share`` of the group lies;
    groups of fewer than ``at_least`` rows have none. Null values do not count; null keys are keys.

    The rank comes from a range sort over all partitions: an exact percentile aggregate would hold all
    values of a group in one task."""
    k = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    # equal values are counted first: a range sort cannot split them
    rows = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("p")).agg(F.count("*").alias("__one")).withColumn("__k", k)
    n = rows.groupBy("__k").agg(F.sum("__one").alias("samples")).filter(F.col("samples") >= at_least)
    ranked = running_totals(rows, "__k", ["p"], "__one", "__before")
    want = F.ceil(F.lit(Decimal(str(share))) * F.col("samples")).cast("long")
    return ranked.join(n, "__k").filter((F.col("__before") < want) & (want <= F.col("__before") + F.col("__one"))).select(*by, "samples", "p")


def batch_metrics(children: DataFrame, roots: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The 18 figures of each batch. ``roots``: (key, makespan_ns), one row per batch; ``children``: the
    spans below the root with category, operation, attempt and outcome. A member is an intelligence span of
    operation role.cycle.<8 hex digits>, its attempts those of the same digits; batch.commit.<member>
    that succeeded commits it, batch.quarantine.<member> sets it apart, batch.telemetry-incomplete.<member>
    tells that its figures lack something. Committed work is that of all attempts of committed members."""
    took = F.col(end) - F.col(start)
    op = F.col("operation")
    named = lambda prefix: F.when(op.startswith(prefix), F.substr(op, F.lit(len(prefix) + 1)))
    cycle = F.when(F.col("category") == "intelligence", F.nullif(F.regexp_extract(op, "^role\\.cycle\\.([0-9a-f]{8})$", 1), F.lit("")))
    d = children.select(F.col(key), F.col(start).alias("s"), F.col(end).alias("e"), took.alias("n"), "attempt", "outcome", cycle.alias("cycle"), F.when(F.col("outcome") == "success", named("batch.commit.")).alias("commit"), named("batch.quarantine.").alias("aside"), named("batch.telemetry-incomplete.").alias("lacks"))
    mine = d.filter("cycle is not null")
    done = d.filter("commit is not null").select(key, F.col("commit").alias("cycle"), F.lit(True).alias("done")).distinct()
    per = mine.groupBy(key, "cycle").agg(F.count("*").alias("tries"), F.max("attempt").alias("top"), F.bool_and(F.col("outcome") != "success").alias("lost"), F.sum("n").alias("work"), F.min("s").alias("s"), F.max("e").alias("e"))
    m = per.join(done, [key, "cycle"], "left").groupBy(key).agg(
        F.count("*").alias("launched"), F.count_if("lost").alias("failed"), F.count_if((F.col("tries") > 1) | (F.col("top") > 1)).alias("retried"), F.sum("work").alias("summed"), F.sum(F.when(F.col("done"), F.col("work"))).alias("committed_work"), (F.max("e") - F.min("s")).alias("window"))
    marks = d.groupBy(key).agg(F.countDistinct("commit").alias("committed"), F.countDistinct("aside").alias("quarantined"), F.countDistinct("lacks").alias("incomplete"))
    j = roots.select(key, "makespan_ns").join(marks, key, "left").join(m, key, "left").join(interval_union(mine, [key], "s", "e"), key, "left").join(peak_concurrency(mine, key, "s", "e"), key, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    span, n = F.col("makespan_ns"), z("committed")
    return j.select(
        key, span.alias("batch_makespan_ns"), z("launched").alias("launched_members"), n.alias("committed_members"), z("quarantined").alias("quarantined_members"), z("failed").alias("failed_members"), z("retried").alias("retried_members"), z("incomplete").alias("telemetry_incomplete_members"),
        z("summed").alias("summed_member_work_ns"), z("committed_work").alias("committed_member_work_ns"), F.when(n > 0, F.expr("makespan_ns div committed")).alias("wall_clock_per_committed_work_unit_ns"), F.when(n == 0, "no committed members").alias("wall_clock_per_committed_work_unit_reason"),
        z("union_ns").alias("member_active_union_ns"), z("window").alias("member_window_ns"), (z("summed") - z("union_ns")).alias("overlap_ns"), z("peak").alias("peak_concurrency"), F.when(z("window") > 0, z("summed") / z("window")).alias("member_work_to_window_ratio"),
        F.when(span != 0, z("committed_work") / span).alias("observed_parallel_speedup"), F.when(span == 0, "zero batch makespan").alias("observed_parallel_speedup_reason"))


def format_elapsed(ns: Column | str) -> Column:
    """1.234s, 2m 3s or 1h 2m 3s; null for null."""
    ms = F.floor((F.col(ns) if isinstance(ns, str) else ns) / 1_000_000).cast("long")
    s = F.floor(ms / 1000).cast("long")
    m, h = F.floor(s / 60).cast("long"), F.floor(s / 3600).cast("long")
    return F.when(ms < 60_000, F.format_string("%d.%03ds", s, ms % 1000)).when(h > 0, F.format_string("%dh %dm %ds", h, m % 60, s % 60)).when(m.isNotNull(), F.format_string("%dm %ds", m, s % 60))


def epoch_ns(c: Column | str) -> Column:
    """Nanoseconds since the epoch of an ISO time in UTC with up to nine fractional digits."""
    c = F.col(c) if isinstance(c, str) else c
    base = F.unix_micros(F.try_to_timestamp(F.concat(F.regexp_extract(c, r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)", 1), F.lit("Z")))) * 1000
    return base + F.rpad(F.regexp_extract(c, r"\.(\d{1,9})Z?$", 1), 9, "0").cast("long")


def span_violations(one_id: str = "^[0-9a-f]{32}$", token: str = "^[A-Za-z0-9][A-Za-z0-9._:/+-]{0,127}$") -> Column:
    """The rules a span breaks, as an array of codes in a fixed order; empty for a valid span."""
    c = F.col
    no = lambda x: ~F.coalesce(x, F.lit(False))
    code = c("exit_code")
    rules = {
        "schema": no(c("schema") == "execution_span.v1"), "trace_id": no(c("trace_id").rlike(one_id)), "span_id": no(c("span_id").rlike(one_id)), "parent_span_id": c("parent_span_id").isNotNull() & no(c("parent_span_id").rlike(one_id)),
        "run_type": no(c("run_type").rlike(token)), "scope": no(c("scope").isin(*SCOPES)), "scope_id": no(c("scope_id").rlike(token)), "category": no(c("category").isin(*CATEGORIES)), "operation": no(c("operation").rlike(token)), "attempt": no(c("attempt") >= 1),
        "times": no((c("start_offset_ns") >= 0) & (c("end_offset_ns") >= c("start_offset_ns"))), "duration": no(c("duration_ns") == c("end_offset_ns") - c("start_offset_ns")), "outcome": no(c("outcome").isin(*OUTCOMES)),
        "exit_code": code.isNotNull() & F.coalesce(((c("outcome") == "success") & (code != 0)) | ((c("outcome") == "timeout") & (code != 124)) | (c("outcome").isin("error", "cancelled", "interrupted") & (code == 0)), F.lit(False)),
        "timeout": F.when(c("outcome") == "timeout", no(c("timeout_kind").isin(*TIMEOUT_KINDS) & (c("timeout_ns") >= 1))).otherwise(c("timeout_kind").isNotNull() | c("timeout_ns").isNotNull()),
    }
    return F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull())


def parks(events: DataFrame) -> DataFrame:
    """One row per park: its opening paired with its closing. Exact if both were in one boot, whose
    clock then gives the duration; over boots the calendar does; an open park has none."""
    e = events.select("park_id", "phase_id", "reason", "event", "boot_id", "monotonic_ns", epoch_ns("at").alias("at_ns")).filter("park_id is not null").distinct()
    pick = lambda kind: F.min(F.when(F.col("event") == kind, F.struct("at_ns", "boot_id", "monotonic_ns", "phase_id", "reason")))
    p = e.groupBy("park_id").agg(pick("open").alias("o"), pick("close").alias("c"))
    exact = F.col("c").isNotNull() & (F.col("o.boot_id") == F.col("c.boot_id"))
    took = F.when(exact, F.col("c.monotonic_ns") - F.col("o.monotonic_ns")).otherwise(F.col("c.at_ns") - F.col("o.at_ns"))
    method = F.when(F.col("c").isNull(), "open").when(exact, "monotonic").otherwise("calendar")
    return p.filter("o is not null").select("park_id", F.col("o.phase_id").alias("phase_id"), F.col("o.reason").alias("reason"), F.col("o.boot_id").alias("boot_id"), F.col("o.monotonic_ns").alias("start_ns"), F.col("c.monotonic_ns").alias("end_ns"), F.col("o.at_ns").alias("opened_ns"), F.col("c.at_ns").alias("closed_ns"), took.alias("duration_ns"), F.coalesce(exact, F.lit(False)).alias("exact"), method.alias("method"))


def park_totals(parks_: DataFrame) -> DataFrame:
    """Per phase the time parked: incomplete while one is open, the union by boot if all are exact,
    else the union by the calendar."""
    p = parks_.filter("phase_id is not null")
    state = p.groupBy("phase_id").agg(F.count("*").alias("parks"), F.bool_and("exact").alias("exact"), F.bool_or(F.col("duration_ns").isNull()).alias("open"))
    mono = interval_union(p.filter("exact"), ["phase_id", "boot_id"], "start_ns", "end_ns").groupBy("phase_id").agg(F.sum("union_ns").alias("mono"))
    cal = interval_union(p.filter("closed_ns is not null"), ["phase_id"], "opened_ns", "closed_ns", "cal")
    j = state.join(mono, "phase_id", "left").join(cal, "phase_id", "left")
    return j.select("phase_id", "parks", F.when(F.col("open"), "incomplete").when(F.col("exact"), "monotonic-union").otherwise("calendar-union-cross-boot").alias("method"), F.when(~F.col("open"), F.when(F.col("exact"), F.coalesce("mono", F.lit(0))).otherwise(F.coalesce("cal", F.lit(0)))).alias("total_ns"))
