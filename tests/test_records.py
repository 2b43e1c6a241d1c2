from pyspark.sql import functions as F

from folioflux.functions import records as rc


def one(spark, *cols):
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return r[0] if len(cols) == 1 else tuple(r)


def test_replies(spark):
    assert one(spark, *[rc.usage(F.lit(b), "input_tokens", "inputTokens") for b in ('{"inputTokens": 7}', '{"input_tokens": -1, "inputTokens": 2}', '{"input_tokens": 1.5}', "no")]) == (7, 2, None, None)
    assert one(spark, *[rc.first_text(F.lit(b)) for b in ('{"content": " ", "message": {"content": [{"type": "text", "text": "a"}, {"type": "x", "text": "b"}]}}', '{"content": "hi"}', "{}")]) == ("a", "hi", None)
    assert one(spark, *[rc.envelope_faults(F.lit(b), ["id"], ["id", "n"], ["n"]) for b in ('{"id": 1, "n": 3}', '{"n": -3, "z": 1}', "{")]) == ([], ["missing-id", "unknown-keys", "bad-n"], ["malformed"])


def test_blocks(spark):
    b = 'x\n```json\n[{"id": "old"}]\n```\n```json\n{"findings": [{"id": "F1", "severity": "high", "state": "open"}]}\n  ```\n'
    assert one(spark, rc.findings(F.lit(b)))[0].id == "F1" and one(spark, rc.findings(F.lit("none"))) is None
    t = "# Failure analysis\n" + "a" * 40 + "\n# Other\ntext\n# Failure analysis two\nshort\n"
    assert one(spark, rc.sections_of(F.lit(t), "Failure analysis")) == ["a" * 40]
    assert one(spark, *[rc.link_destination(F.lit(x)) for x in ("<a b.md> 'T'", 'c.md "Title"', "d%20e.md", "f+g.md")]) == ("a b.md", "c.md", "d e.md", "f+g.md")
    assert one(spark, rc.slug(F.lit("Über Alles: 2.0 (x)"))) == "über-alles-20-x"
    rules = [("design", "^D"), ("code", "bug")]
    assert one(spark, rc.kind_of(F.array(F.lit("D1")), F.lit("bug"), rules, "other"), rc.kind_of(F.lit(None).cast("array<string>"), F.lit("a bug"), rules, "other"), rc.kind_of(F.array(F.lit("x")), F.lit("y"), rules, "other")) == ("design", "code", "other")


def test_strips_and_identity(spark):
    assert [tuple(x) for x in one(spark, rc.strip_edges(F.lit(0), F.lit(90), F.array(F.lit(40), F.lit(70))))] == [(0, 40), (40, 70), (70, 90)]
    assert one(spark, rc.credible_headings(F.lit(3), F.lit(10)), rc.credible_headings(F.lit(4), F.lit(10))) == (True, False)
    assert one(spark, rc.prompt_identity(F.lit("a"), F.lit("b"))) == one(spark, F.sha2(F.lit("a\n\nb"), 256))


def test_tables(spark):
    d = spark.createDataFrame([(1, "see docs/a.md and ./b.py."), (2, "docs/a.mdx"), (3, None)], "i int, t string")
    p = spark.createDataFrame([("docs/a.md",), ("b.py",)], "path string")
    assert {tuple(r) for r in rc.mentions(d, "i", "t", p, "path").collect()} == {("docs/a.md", 1), ("b.py", 1)}
    c = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert [r.k for r in rc.without_launch(c, c.filter("k = 'a'"), ["k", "v"]).collect()] == ["b"]
    u, bad = rc.union_scopes({"x": c, "y": ValueError("torn"), "z": c.withColumn("w", F.lit(1))})
    assert u.count() == 4 and bad == [("y", "ValueError: torn")] and rc.union_scopes({})[0] is None
    assert rc.public(c.withColumn("_p", F.lit(1)), "v").columns == ["k"]
    r = spark.createDataFrame([("t", "a", "op", "2025-01-02"), ("u", "b", "op", "2025-01-01")], "trace_id string, run_type string, operation string, finalized_at string")
    assert rc.filter_reports(r).count() == 2 and rc.filter_reports(r, run_type="a", since="2025-01-02").count() == 1
