import random

import pytest

from folioflux.operators import hierarchy
from folioflux.operators.hierarchy import descendants, resolve
from folioflux.operators.tracing import ancestors


def brute(rows):
    nodes = {(g, i): p for g, i, p, _, _ in rows}
    root = {(g, i) for g, i, _, _, r in rows if r}
    out = {}
    for g, i in nodes:
        chain, seen = [i], {i}
        while True:
            p = nodes[g, chain[-1]]
            if p is None or (g, p) not in nodes:
                out[g, i] = ("rooted" if (g, chain[-1]) in root else "detached", chain[-1], len(chain) - 1, chain[::-1])
                break
            if p in seen:
                circle = chain[chain.index(p):]
                k = chain.index(p)
                out[g, i] = ("cycle" if k == 0 else "below_cycle", min(circle), k, chain[: k + 1][::-1])
                break
            chain.append(p)
            seen.add(p)
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "g string, id string, parent string, pos long, r boolean")
    got = {(x.g, x.id): (x.kind, x.top, x.depth, x.path) for x in resolve(df, "g", "id", "parent", "pos", "r", with_paths=True, **kw).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert {k: v for k, v in got.items() if v != want[k]} == {}


@pytest.mark.parametrize("seed", range(5))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for g, size in (("a", 70), ("b", 6), ("c", 1), ("d", 12)):
        for i in range(size):
            parent = r.choice([None, f"{r.randrange(size + 2):03d}", f"{max(0, i - r.randrange(1, 4)):03d}", f"{max(0, i - 1):03d}", f"{(i + 1) % size:03d}"]) if i else r.choice([None, None, "005"])
            rows.append((g, f"{i:03d}", parent, r.choice([i, r.randrange(9)]), i == 0))
    check(spark, rows, partitions=[1, 5, 9, 7, 12][seed])


def test_circle_over_partitions_with_tails(spark):
    rows = [("g", f"{i:02d}", f"{(i + 1) % 30:02d}", i, False) for i in range(30)]
    rows += [("g", f"t{i:02d}", f"t{i - 1:02d}" if i % 10 else f"{i:02d}", i % 17, False) for i in range(30)]
    check(spark, rows, partitions=8)


def test_long_chain(spark):
    rows = [("g", f"{i:04d}", f"{i - 1:04d}" if i else None, (i * 37) % 400, i == 0) for i in range(400)]
    check(spark, rows, partitions=10)


def test_empty_and_nulls(spark):
    schema = "g string, id string, parent string, pos long, r boolean"
    assert resolve(spark.createDataFrame([], schema), "g", "id", "parent", "pos", "r").count() == 0
    got = resolve(spark.createDataFrame([(None, "a", None, 1, True), ("g", None, "a", 1, True), ("g", "a", "a", None, None), ("g", "b", None, None, True)], schema), "g", "id", "parent", "pos", "r").collect()
    assert {(x.id, x.kind, x.top, x.depth) for x in got} == {("a", "cycle", "a", 0), ("b", "rooted", "b", 0)}


def test_descendants(spark):
    df = spark.createDataFrame([("g", "r", None), ("g", "a", "r"), ("g", "b", "a"), ("g", "c", "r")], "g string, id string, parent string")
    got = {(x.ancestor, x.descendant, x.distance) for x in descendants(resolve(df, "g", "id", "parent", with_paths=True), "g", "id").collect()}
    assert got == {("r", "a", 1), ("a", "b", 1), ("r", "b", 2), ("r", "c", 1)}


@pytest.mark.parametrize("circle", [False, True])
def test_links_that_lead_everywhere_are_shortened(spark, monkeypatch, circle):
    monkeypatch.setattr(hierarchy, "PART_ROWS", 12)
    r = random.Random(9)
    names = [f"{i:03d}" for i in range(90)]
    r.shuffle(names)
    rows = [("g", names[i], names[i - 1] if i else (names[40] if circle else None), r.randrange(50), i == 0) for i in range(90)]
    check(spark, rows, partitions=6)


def test_what_hangs_below_a_circle_has_its_pairs(spark):
    df = spark.createDataFrame([("g", "x", "y", 0), ("g", "y", "x", 1), ("g", "a", "x", 2), ("g", "b", "a", 3), ("g", "r", None, 4), ("g", "c", "r", 5)], "g string, id string, parent string, pos long")
    want = {("x", "a", 1, "below_cycle"), ("a", "b", 1, "below_cycle"), ("x", "b", 2, "below_cycle"), ("r", "c", 1, "rooted")}
    got = descendants(resolve(df, "g", "id", "parent", "pos", with_paths=True), "g", "id", "kind").collect()
    assert {(x.ancestor, x.descendant, x.distance, x.kind) for x in got} == want and len(got) == 4
    up = ancestors(df, "g", "id", "parent", "pos").collect()
    assert {(x.ancestor, x.id, x.distance, x.kind) for x in up} == want and len(up) == 4
