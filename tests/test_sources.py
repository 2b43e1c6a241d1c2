import json

import pytest

from folioflux.sources import readers as rd
from folioflux.sources import writers as wr
from folioflux.streaming import streams as st


def test_strict_ledger(spark, tmp_path):
    p = tmp_path / "l.jsonl"
    p.write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n": 2}\n')
    assert rd.jsonl_ledger(spark, str(p), "id string, n int", "id").count() == 2
    p.write_text('{"id": "a", "n": 1}\n{"id": "a", "n": 2}\n')
    with pytest.raises(Exception, match="repeated a"):
        rd.jsonl_ledger(spark, str(p), "id string, n int", "id").collect()
    p.write_text('{"id": "a", "n": 1}\n{"id": \n')
    with pytest.raises(Exception, match="malformed"):
        rd.jsonl_ledger(spark, str(p), "id string, n int").collect()
    rows, bad = rd.jsonl_tolerant(spark, str(p), "id string, n int")
    assert rows.count() == 1 and bad.count() == 1


def test_ocr_table(spark, tmp_path):
    p = tmp_path / "o.tsv"
    head = "\t".join(rd.TSV_HEADER)
    p.write_text(head + '\n5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t95.5\t"quoted\n5\t1\t1\t1\t1\t2\t0\t0\t9\t9\t-1\t\n')
    assert [(r.conf, r.text) for r in rd.ocr_tsv(spark, str(p)).orderBy("pos").collect()] == [(95.5, '"quoted'), (-1.0, "")]
    p.write_text(head + "\n5\t1\t1\t1\t1\t1\t0\t0\t9\t9\tx\ty\n")
    with pytest.raises(Exception, match="bad confidence"):
        rd.ocr_tsv(spark, str(p)).collect()
    p.write_text("a\tb\n")
    with pytest.raises(ValueError, match="not an OCR table"):
        rd.ocr_tsv(spark, str(p))


def test_reports_and_front_matter(spark, tmp_path):
    (tmp_path / "ok.xml").write_text('<testsuite><testcase classname="c" name="a" time="1.5"></testcase><testcase classname="c" name="b" time="0.5"></testcase></testsuite>')
    (tmp_path / "bad.xml").write_text('<testsuite><testcase classname="c" name="a" time="x"></testcase></testsuite>')
    got = {r.file.rsplit("/", 1)[1]: r for r in rd.junit(spark, str(tmp_path)).collect()}
    assert got["ok.xml"].total_seconds == 2.0 and got["ok.xml"].slowest[0].case == "c::a" and got["bad.xml"].total_seconds is None
    d = tmp_path / "md"
    d.mkdir()
    (d / "a.md").write_text("---\nid: 7\ntags: [x]\n---\nbody\n")
    (d / "b.md").write_text("no matter")
    pytest.importorskip("yaml")
    rows = {r.file.rsplit("/", 1)[1]: r for r in rd.front_matter(spark, str(d)).collect()}
    assert json.loads(rows["a.md"].meta) == {"id": 7, "tags": ["x"]} and rows["a.md"].body == "body\n" and rows["b.md"].meta is None
    assert {(r.pos, r.line) for r in rd.lines_of(spark, str(d / "b.md")).collect()} == {(0, "no matter")}


def test_files_inventory_and_publish(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("abc")
    (tmp_path / "in/b.bin").write_bytes(b"x" * 50)
    f = {r.path.rsplit("/", 1)[1]: r for r in rd.files(spark, str(tmp_path / "in"), max_bytes=10).collect()}
    assert f["a.txt"].sha256.startswith("ba7816bf") and f["b.bin"].status == "resource-limit" and f["b.bin"].content is None
    inv = wr.inventory(spark, str(tmp_path / "in"))
    assert {r.media_type for r in inv.collect()} == {"text/plain", "application/octet-stream"}
    found = spark.createDataFrame([("a", 1, "h"), ("b", 2, "h"), ("z", 1, "h")], "path string, size long, sha256 string")
    told = spark.createDataFrame([("a", 1, "h"), ("b", 3, "h"), ("c", 1, "h"), ("../d", 1, "h"), ("a2", 1, "h"), ("a2", 1, "h")], "path string, size long, sha256 string")
    assert {tuple(r) for r in wr.inventory_faults(told, found).collect()} == {("b", "size"), ("c", "missing"), ("../d", "unsafe-path"), ("a2", "repeated"), ("z", "undeclared")}
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("k", 1)], "k string, v int")
    wr.publish(df, out, "k")
    with pytest.raises(FileExistsError):
        wr.publish(df, out, "k")
    assert spark.read.parquet(out).count() == 1 and not list(tmp_path.glob("out.stage*"))
    led = str(tmp_path / "led")
    assert [wr.append_ledger(df, led, "k"), wr.append_ledger(df, led, "k")] == [1, 0]
    with pytest.raises(ValueError, match="other content"):
        wr.append_ledger(df.withColumn("v", df.v + 1), led, "k")


def test_manifests(spark):
    sha = "b" * 64
    a = lambda n: f"folio-pdf-{sha}-page-{n:06d}"
    rows = [(sha, "complete", 2, [(2, a(2)), (1, a(1))]), (sha, "complete", 2, [(1, a(1))]), (sha, "failed", 1, [(1, a(2))])]
    got = [r.fault for r in wr.manifest_faults(spark.createDataFrame(rows, "doc_sha256 string, status string, page_count int, pages array<struct<number: int, anchor: string>>")).collect()]
    assert sorted(got) == ["anchor", "pages", "status"]
    assert json.loads(wr.manifest_json(spark.createDataFrame([(1, None)], "a int, b string"), "a", "b").first().value) == {"a": 1, "b": None}


def test_links(spark):
    d = spark.createDataFrame([("p.html", '<h1 id="top">x</h1><a href="#top">a</a><a href="#no">b</a><a href="q.html#s">c</a><a href="https://e.org/#x">d</a><img src="i.png">'), ("q.html", '<p id="s">')], "page string, html string")
    got = rd.html_links(d, "page", "html")
    assert {(r.kind, r.value) for r in got.filter("kind = 'no-alt'").collect()} == {("no-alt", "i.png")}
    assert {r.value for r in rd.broken_links(got, "page").collect()} == {"#no", "i.png"}


def test_streams(spark, tmp_path):
    src = tmp_path / "s"
    src.mkdir()
    (src / "1.json").write_text('{"id": "a", "event": "open", "at": "2025-01-01T00:00:00Z"}\nnot json\n{"id": "b", "event": "close", "at": "2025-01-01T00:00:05Z"}\n')
    (src / "2.json").write_text('{"id": "a", "event": "close", "at": "2025-01-01T00:00:09Z"}\n{"id": "c", "event": "open", "at": "2025-01-01T00:00:07Z"}\n')
    schema = "id string, event string, at timestamp"
    q = st.pair(st.tail(spark, str(src), schema, 1).filter("id is not null")).writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.id, r.state) for r in spark.table("pairs").collect()} == {("a", "open"), ("a", "closed"), ("b", "unopened"), ("c", "open")}
    q = st.refuse_duplicates(st.tail(spark, str(src), schema, 1).filter("id is not null"), str(tmp_path / "led"), str(tmp_path / "ref"), "id", str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert {r.id for r in spark.read.parquet(str(tmp_path / "led")).collect()} == {"a", "b", "c"} and [r.id for r in spark.read.parquet(str(tmp_path / "ref")).collect()] == ["a"]
    q = st.latest_states(st.tail(spark, str(src), schema, 1).filter("id is not null"), "id", "at", "event").writeStream.format("memory").queryName("states").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.id, r.event) for r in spark.table("states").collect()} == {("a", "close"), ("b", "close"), ("c", "open")}
