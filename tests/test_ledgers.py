import datetime as dt
import hashlib

from pyspark.sql import functions as F

from folioflux.functions.globs import name_regex, path_regex
from folioflux.operators import ledgers as lg


def events(spark, rows):
    return spark.createDataFrame(rows, "id string, phase string, previous string, from_state string, state string, owner string")


def test_phase_events(spark):
    good = [("a", "1", None, "", "not-started", None), ("b", "1", "a", "not-started", "next", None), ("c", "1", "b", "next", "in-progress", "me"), ("c2", "1", "c", "in-progress", "in-progress", "me"), ("k", "6", None, "", "completed", None)]
    assert lg.event_violations(events(spark, good)).count() == 0
    assert {r.id for r in lg.heads(events(spark, good)).collect()} == {"c2", "k"}
    bad = [("d", "2", None, "", "planned", None), ("e", "3", "zz", "not-started", "next", None), ("f", "4", None, "", "not-started", None), ("g", "4", "f", "not-started", "next", None), ("h", "4", "f", "not-started", "completed", None), ("i", "5", "j", "not-started", "next", None), ("j", "5", "i", "next", "not-started", None), ("l", "7", None, "", "completed", None), ("m", "7", "l", "completed", "in-progress", "me")]
    got = {(r.phase, r.code) for r in lg.event_violations(events(spark, good + bad)).collect()}
    assert {("2", "illegal-transition"), ("3", "missing-predecessor"), ("3", "not-one-genesis"), ("4", "fork"), ("4", "illegal-transition"), ("5", "cycle"), ("5", "not-one-genesis"), ("7", "illegal-transition")} <= got and not {x for x in got if x[0] in "16"}
    more = events(spark, good[:3] + [("n", "1", "c", "in-progress", "completed", "you")]).withColumns({"claim": F.when(F.col("id") != "c", F.lit("x")), "release": F.lit(None).cast("string"), "acceptance": F.lit(""), "writer": F.lit("w"), "reason": F.when(F.col("id") != "b", F.lit("r"))})
    assert {(r.phase, r.code) for r in lg.event_violations(more).collect()} == {("1", "unclaimed-work"), ("1", "unreleased-handoff"), ("1", "unaccepted-completion"), ("1", "unattributed")}


def test_current_phase(spark):
    p = spark.createDataFrame([("1", []), ("2", ["1"]), ("3", ["9"])], "id string, depends_on array<string>")
    h = spark.createDataFrame([("1", "completed", None), ("2", "next", None), ("3", "next", "me"), ("9", "not-started", None)], "phase string, state string, owner string")
    assert [r.id for r in lg.current_phase(p, h, "me").collect()] == ["2"]


def test_phase_graph(spark):
    rows = [("a", "1", [], None), ("b", "3/2", ["a"], None), ("c", "1.4", ["b"], "a"), ("d", "9", ["x"], "y"), ("e", "10", ["e"], None), ("f", "11", [], "g"), ("g", "12", [], "f"), ("h", "13", ["f"], None), ("n", "14", [], None)]
    p = spark.createDataFrame(rows, "id string, order string, depends_on array<string>, parent string")
    state = {"a": "completed", "b": "next", "c": "in-progress", "d": "next", "e": "not-started", "f": "not-started", "g": "not-started", "h": "next"}
    h = spark.createDataFrame([(k, v, "me" if k == "b" else None) for k, v in state.items()], "phase string, state string, owner string")
    got = {(r.phase, r.code) for r in lg.graph_violations(p, h).collect()}
    assert got == {("c", "dependency-ordered-after"), ("c", "work-precedes-dependency"), ("a", "incomplete-child"), ("d", "unknown-dependency"), ("d", "unknown-parent"), ("e", "self-cycle"), ("e", "graph-cycle"), ("f", "graph-cycle"), ("g", "graph-cycle"), ("h", "graph-cycle"), ("n", "no-genesis"), ("d", "several-next"), ("h", "several-next")}


def test_rational_order(spark):
    d = spark.createDataFrame([("a", "1/3"), ("b", "0.333333333"), ("c", "2"), ("d", "x"), ("e", "10/3"), ("f", None), ("g", "-1"), ("h", "333333333333333/999999999999999"), ("i", "333333333333334/999999999999999"), ("k", "-4/3")], "id string, o string")
    assert [r.id for r in lg.rational_rank(d, "o", "id").orderBy("rank").collect()] == ["k", "g", "b", "a", "h", "i", "c", "e", "d", "f"]


def test_log_blocks(spark):
    text = ["preface", "## 2025-01-02 one", "body", "## 2025-01-01 two", "corrects"]
    d = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file string, pos int, line string")
    b = lg.log_blocks(d, "file", "pos", "line")
    got = b.orderBy("block").collect()
    assert [(r.header, r.backwards) for r in got] == [("## 2025-01-02 one", False), ("## 2025-01-01 two", True)] and got[0].sha256 == hashlib.sha256(b"## 2025-01-02 one\nbody").hexdigest()
    d2 = d.withColumn("line", F.when(F.col("pos") == 4, F.lit(f"corrects sha256:{got[0].sha256}")).otherwise(F.col("line")))
    c = lg.corrections(lg.log_blocks(d2, "file", "pos", "line"), "file").collect()
    assert [(r.by, r.valid) for r in c] == [(2, True)]


def test_lessons(spark):
    day = lambda n: dt.date(2025, 1, 1) + dt.timedelta(n)
    d = spark.createDataFrame([("a", "open", [(day(0),), (day(1),), (day(2),)]), ("b", "closed", [(day(0),)] * 3), ("c", "open", [(day(70),)]), ("d", "open", [])], "slug string, status string, occurrences array<struct<date: date>>")
    got = {r.slug: (r.candidate, r.aged) for r in lg.lesson_state(d, F.lit(day(100)).cast("date")).collect()}
    assert got == {"a": (True, True), "b": (False, False), "c": (False, False), "d": (False, False)}


def test_verdicts(spark):
    head = "## Verdict: REVISE\n"
    texts = ["## Verdict: APPROVED \n\nall \\\"well\\\"\\n", head + "=== quoted", " " + head + "x", "## Verdict: MAYBE\nx", head + "1: a\n2: b\n 3\tc", head + "1: a\n2: b", head + "see notes.md-12-x", "## Verdict: REVISE", None]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, b string")
    assert [r.i for r in d.filter(lg.genuine_verdict("b")).orderBy("i").collect()] == [0, 5]
    assert d.select(lg.normal_verdict("b").alias("n")).first().n == '## Verdict: APPROVED all "well" '
    f = spark.createDataFrame([("x", "p2", 2), ("x", "p1", 1), ("y", "p3", 3)], "body string, path string, line int")
    assert {(r.body, r.path) for r in lg.first_seen(f, ["body"], ["path", "line"]).collect()} == {("x", "p1"), ("y", "p3")}
    g = spark.createDataFrame([("p", "s", "k", "1", "open", "e1"), ("p", "s", "k", "1", "open", "e2"), ("p", "s", "k", "2", "closed", "e1"), ("p", "s", "k", "2", "open", "e2"), ("p", "s", "k", "3", "addressed", "e1"), ("p", "s", "k", "3", "blocked-owner", "e2")], "project string, source string, kind string, id string, state string, evidence string")
    assert {r.id for r in lg.reaimed(g).collect()} == {"1", "3"}


def test_replay(spark):
    rows, d = [], ""
    for i, b in enumerate(["a", "b", "c"], 1):
        d = hashlib.sha256((d + b).encode()).hexdigest()
        rows.append(("good", i, d, b))
    rows += [("bad", 1, rows[0][2], "a"), ("bad", 2, "0" * 64, "b"), ("hole", 1, rows[0][2], "a"), ("hole", 3, "1", "c")]
    got = {r.k: r.valid for r in lg.replay(spark.createDataFrame(rows, "k string, seq int, digest string, body string"), "k", "seq", "digest", "body").collect()}
    assert got == {"good": True, "bad": False, "hole": False}


def test_finish_and_recover(spark):
    o = spark.createDataFrame([("t", "r", None, "b", 0), ("t", "a", "r", "b", 1), ("t", "c", "a", "b", 2), ("t", "x", "r", "b", 5)], "trace_id string, span_id string, parent_span_id string, boot_id string, start_ns long")
    c = spark.createDataFrame([("t", "r", "b", 9, "success"), ("t", "x", "b", 3, "success")], "trace_id string, span_id string, boot_id string, end_ns long, outcome string")
    f = lg.finish_spans(o, c.union(c))
    assert {r.span_id: r.state for r in f.collect()} == {"r": "open-children", "a": "open", "c": "open", "x": "backwards"}
    assert {r.span_id: r.step for r in lg.recover(f).collect()} == {"c": 0, "a": 1}


def test_append_once_and_boots(spark):
    led = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new, refused = lg.append_once(led, spark.createDataFrame([("a", 1), ("b", 3), ("c", 4), ("c", 4)], "k string, v int"), "k")
    assert [tuple(r) for r in new.collect()] == [("c", 4)] and [tuple(r) for r in refused.collect()] == [("b", 3)]
    d = spark.createDataFrame([("k", "{ sec = 100 }", 1), ("k", "{ sec = 103 }", 2), ("k", "{ sec = 107 }", 3), ("k", "uuid", 4), ("k", "uuid", 5)], "k string, boot string, s long")
    assert [r.boot_group for r in lg.boot_groups(d, "k", "boot", "s").orderBy("s").collect()] == [0, 0, 1, 2, 2]


def test_json_and_fences(spark):
    d = spark.createDataFrame([('{"b": 1, "a": ["x", {"c": "y"}]}',), ('{"a": ["x", {"c": "y"}], "b": 1}',), ('{"a":1,"a":2}',), ('{"a": NaN}',), ("no",), (None,)], "j string")
    got = [r.d for r in d.select(lg.canonical_digest("j").alias("d")).collect()]
    assert got[0] == got[1] is not None and got[2:] == [None] * 4
    assert [r.s for r in d.select(lg.json_strings("j").alias("s")).collect()][:2] == [["x", "y"], ["x", "y"]]
    f = spark.createDataFrame([("a\n```py\ncode\n~~~\n```\nb",), (None,)], "t string")
    assert [r.l for r in f.select(lg.outside_fences("t").alias("l")).collect()] == [["a", "b"], [""]]


def test_engines_fail_by_row(spark):
    d = spark.createDataFrame([(1, "ok"), (2, "bad")], "i int, t string")

    def reader():
        def one(r):
            if r["t"] == "bad":
                raise ValueError("unreadable")
            return {"out": r["t"].upper()}

        return one

    got = {r.i: (r.out, r.error) for r in lg.transcribe(d, reader, ["i", "t"], "i int, out string").collect()}
    assert got == {1: ("OK", None), 2: (None, "ValueError: unreadable")}


def test_globs():
    import re

    for g, yes, no in [("a/**/b.py", ["a/b.py", "a/x/y/b.py"], ["b.py", "a/b_py"]), ("*.md", ["x.md"], ["d/x.md"]), ("d/**", ["d/x", "d/x/y"], ["e/x"]), ("f?.t", ["fa.t"], ["f/.t", "f.t"])]:
        assert all(re.match(path_regex(g), p) for p in yes) and not any(re.match(path_regex(g), p) for p in no)
    assert re.match(name_regex("t/*_[!a]"), "t/x/y_b") and not re.match(name_regex("t/*_[!a]"), "t/x_a")


def test_small_ones(spark):
    m = spark.createDataFrame([("p", "killed"), ("p", "survived"), ("q", "not_run")], "path string, outcome string")
    assert {r.path: r.rate for r in lg.mutation_tally(m).collect()} == {"p": 0.5, "q": None}
    o = spark.createDataFrame([("k", "m", "a"), ("k", "m", "b"), ("k", "n", "c"), ("k", "n", None)], "k string, name string, v string")
    assert {(r.name, r.v, r.conflict) for r in lg.observed(o, "k", "name", "v").collect()} == {("m", None, True), ("n", "c", False)}
    assert lg.blank_defaults(spark.createDataFrame([(" ",), (None,), ("x",)], "m string"), {"m": "default"}).groupBy("m").count().count() == 2
