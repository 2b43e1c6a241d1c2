from pyspark.sql import functions as F

from folioflux.operators import tracing as tr


def spans(spark, rows):
    return spark.createDataFrame(rows, "trace_id string, span_id string, s long, e long, depth int, category string, outcome string, attempt int")


ROWS = [("t", "0", 0, 100, 0, "run", "success", 1), ("t", "1", 10, 70, 1, "intelligence", "success", 1), ("t", "2", 40, 90, 1, "intelligence", "error", 2)]


def test_parallel_trace(spark):
    d = spans(spark, ROWS)
    c = tr.coverage(d, "trace_id", "s", "e", F.col("category") == "run", F.col("outcome") != "success", F.col("attempt") > 1).first()
    assert (c.makespan_ns, c.covered_ns, c.unattributed_ns, c.failed_ns, c.retried_ns) == (100, 80, 20, 50, 50)
    g = tr.group_concurrency(d.filter("category <> 'run'").withColumn("g", F.lit("g1")), "trace_id", "g", "s", "e").first()
    assert (g.summed_ns, g.window_ns, g.union_ns, g.overlap_ns, g.peak, g.ratio) == (110, 80, 80, 30, 2, 1.375)
    x = {r.category: r.exclusive_ns for r in tr.zero_filled(tr.exclusive_attribution(d, "trace_id", "span_id", "s", "e", "depth", "category"), "trace_id", "category", "exclusive_ns", tr.CATEGORIES).collect()}
    assert x == {"run": 20, "intelligence": 80, "gate": 0, "reconciliation": 0, "wait": 0}


def test_attribution_does_not_depend_on_bins(spark):
    import random

    r = random.Random(2)
    rows = [("t" if r.random() < 0.8 else "u", f"{i:03d}", a := r.randrange(500), a + r.randrange(0, 90), r.randrange(3), r.choice(tr.CATEGORIES), "success", 1) for i in range(120)]
    d = spans(spark, rows)
    want = {}
    for t in ("t", "u"):
        own = [x for x in rows if x[0] == t and x[3] > x[2]]
        pts = sorted({p for x in own for p in x[2:4]})
        for a, b in zip(pts, pts[1:]):
            hit = [x for x in own if x[2] <= a and x[3] >= b]
            if hit:
                w = max(hit, key=lambda x: (x[4], -(x[3] - x[2]), x[1]))
                want[t, w[5]] = want.get((t, w[5]), 0) + b - a
    for parts in (1, 2, 3, 7, 30):
        assert {(x.trace_id, x.category): x.exclusive_ns for x in tr.exclusive_attribution(d, "trace_id", "span_id", "s", "e", "depth", "category", parts).collect()} == want, parts


def test_attribution_over_one_long_trace(spark):
    """Nested, equal and staggered spans of one trace: time linear in their number, over all partitions."""
    n = 200_000
    i = F.col("id")
    nested = spark.range(n).select(i.alias("s"), (F.lit(4 * n) - i).alias("e"), i.alias("depth"), F.lit("nested").alias("l"))
    late = spark.range(n).select((i % 7).alias("s"), (F.lit(3 * n) + i).alias("e"), F.lit(-1).cast("long").alias("depth"), F.lit("late").alias("l"))
    same = spark.range(n).select(F.lit(5).cast("long").alias("s"), F.lit(4 * n + 9).cast("long").alias("e"), F.lit(-2).cast("long").alias("depth"), F.lit("same").alias("l"))
    d = nested.unionByName(late).unionByName(same).withColumns({"k": F.lit("t"), "i": F.monotonically_increasing_id().cast("string")})
    got = {r.l: r.n for r in tr.exclusive_attribution(d, "k", "i", "s", "e", "depth", "l", 16).select("l", F.col("exclusive_ns").alias("n")).collect()}
    assert got == {"nested": 4 * n, "same": 9}
    empty = tr.exclusive_attribution(d.limit(0), "k", "i", "s", "e", "depth", "l")
    odd = spark.createDataFrame([(None, "a", 0, 5, None, None), ("t", None, 0, 5, 1, "x"), ("t", "b", 3, 3, 9, "y"), ("t", "c", None, 4, 9, "y"), ("t", "d", 4, 6, 0, "x")], "k string, i string, s long, e long, depth int, l string")
    assert empty.count() == 0 and {tuple(r) for r in tr.exclusive_attribution(odd, "k", "i", "s", "e", "depth", "l").collect()} == {(None, None, 5), ("t", "x", 6)}


def test_batch_metrics(spark):
    a, b, c = (x * 8 for x in "abc")
    rows = [("x", "intelligence", f"role.cycle.{a}", 1, "error", 0, 10), ("x", "intelligence", f"role.cycle.{a}", 2, "success", 10, 30), ("x", "intelligence", f"role.cycle.{b}", 1, "error", 5, 25), ("x", "gate", f"role.cycle.{c}", 1, "success", 0, 90),
            ("x", "reconciliation", f"batch.commit.{a}", 1, "success", 30, 31), ("x", "reconciliation", f"batch.commit.{b}", 1, "error", 30, 31), ("x", "reconciliation", f"batch.quarantine.{b}", 1, "error", 31, 32), ("x", "reconciliation", f"batch.telemetry-incomplete.{b}", 1, "success", 32, 33)]
    ch = spark.createDataFrame(rows, "k string, category string, operation string, attempt int, outcome string, s long, e long")
    got = {r.k: r for r in tr.batch_metrics(ch, spark.createDataFrame([("x", 100), ("y", 0)], "k string, makespan_ns long"), "k", "s", "e").collect()}
    assert tuple(got["x"])[1:] == (100, 2, 1, 1, 1, 1, 1, 50, 30, 100, None, 30, 30, 20, 2, 50 / 30, 0.3, None)
    assert tuple(got["y"])[1:] == (0, 0, 0, 0, 0, 0, 0, 0, 0, None, "no committed members", 0, 0, 0, 0, None, None, "zero batch makespan")


def test_peak_ends_before_starts(spark):
    d = spark.createDataFrame([("k", 0, 5), ("k", 5, 9), ("k", 6, 7), ("k", 6, None), ("j", 3, 3)], "k string, s long, e long")
    assert {r.k: r.peak for r in tr.peak_concurrency(d, "k", "s", "e").collect()} == {"k": 2, "j": 0}


def test_parks(spark):
    b1, b2 = "boot-a", "boot-b"
    rows = [("open", "p1", "1", b1, 0, "2025-01-01T00:00:00Z"), ("close", "p1", "1", b1, 10_000_000_000, "2025-01-01T00:00:10Z"), ("open", "p2", "1", b1, 5_000_000_000, "2025-01-01T00:00:05Z"), ("close", "p2", "1", b1, 15_000_000_000, "2025-01-01T00:00:15Z"), ("close", "p2", "1", b1, 15_000_000_000, "2025-01-01T00:00:15Z"),
            ("open", "p3", "2", b1, 0, "2025-01-01T00:00:00.5Z"), ("close", "p3", "2", b2, 3, "2025-01-01T00:00:02.123456789Z"), ("open", "p4", "3", b1, 0, "2025-01-01T00:00:00Z")]
    p = tr.parks(spark.createDataFrame([(e, i, ph, "decision", b, m, at) for e, i, ph, b, m, at in rows], "event string, park_id string, phase_id string, reason string, boot_id string, monotonic_ns long, at string"))
    assert {r.park_id: (r.duration_ns, r.method) for r in p.collect()} == {"p1": (10_000_000_000, "monotonic"), "p2": (10_000_000_000, "monotonic"), "p3": (1_623_456_789, "calendar"), "p4": (None, "open")}
    assert {r.phase_id: (r.method, r.total_ns) for r in tr.park_totals(p).collect()} == {"1": ("monotonic-union", 15_000_000_000), "2": ("calendar-union-cross-boot", 1_623_456_789), "3": ("incomplete", None)}


def test_nearest_rank_and_elapsed(spark):
    import math

    for n in (1, 2, 19, 20, 21, 60):
        d = spark.createDataFrame([("g", i * 3) for i in range(n)], "g string, x long")
        assert tr.nearest_rank(d, ["g"], "x", 0.95, 1).first().p == (math.ceil(0.95 * n) - 1) * 3
    assert tr.nearest_rank(d, ["g"], "x", 0.95, 61).count() == 0
    d = spark.createDataFrame([(1_234_000_000,), (123_000_000_000,), (3_723_000_000_000,), (None,)], "n long")
    assert [r.t for r in d.select(tr.format_elapsed("n").alias("t")).collect()] == ["1.234s", "2m 3s", "1h 2m 3s", None]


def test_empty(spark):
    d = spans(spark, [])
    assert tr.peak_concurrency(d, "trace_id", "s", "e").count() == 0 and tr.exclusive_attribution(d, "trace_id", "span_id", "s", "e", "depth", "category").count() == 0 and tr.interval_union(d, ["trace_id"], "s", "e").count() == 0
