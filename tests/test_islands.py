import random

import pytest

from folioflux.operators.islands import periods_and_gaps
from folioflux.operators.latest import latest_by


def brute(rows):
    by = {}
    for k, s, e in rows:
        if s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    out = set()
    for k, v in by.items():
        merged = []
        for s, e in sorted(v):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(k, "period", s, e) for s, e in merged}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(300):
        k = r.choice(["hot"] * 6 + ["a", "b", None])
        s = r.choice([None] + [r.randrange(3000)] * 20)
        rows.append((k, s, None if s is None else r.choice([s, s - 1, None] + [s + r.choice([1, 5, 400 if r.random() < 0.1 else 9])] * 9)))
    df = spark.createDataFrame([(k, s, e, "x") for k, s, e in rows] * 2, "k string, a long, b long, kind2 string").repartition(5)
    got = [(x.k, x.kind, x.a, x.b) for x in periods_and_gaps(df, ["k"], "a", "b", partitions=[1, 3, 7, 16][seed]).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, role string, a long, b long")
    assert periods_and_gaps(df, ["k", "role"], "a", "b").count() == 0


def test_one_long_interval_covers_many_partitions(spark):
    rows = [("k", 0, 10_000)] + [("k", i * 10, i * 10 + 1) for i in range(900)] + [("k", 10_000, 10_001), ("k", 10_005, 10_006)]
    df = spark.createDataFrame(rows, "k string, a long, b long")
    got = {(x.kind, x.a, x.b) for x in periods_and_gaps(df, ["k"], "a", "b", partitions=9).collect()}
    assert got == {("period", 0, 10_001), ("gap", 10_001, 10_005), ("period", 10_005, 10_006)}


def test_latest_by_takes_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "a", "x"), (1, 2, "b", None), (None, 1, "c", "y")], "k int, pos int, `__held` string, `a.b` string")
    assert {tuple(r) for r in latest_by(df, ["k"], "pos").collect()} == {(1, 2, "b", None), (None, 1, "c", "y")}
    m = spark.createDataFrame([(1, 2, {"a": 1}), (1, 3, {"b": 2}), (2, None, None)], "k int, pos int, m map<string, int>")
    assert {(r.k, r.pos, tuple((r.m or {}).items())) for r in latest_by(m, ["k"], "pos").collect()} == {(1, 3, (("b", 2),)), (2, None, ())}
