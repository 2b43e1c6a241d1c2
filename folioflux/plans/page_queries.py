"""Queries on pages and documents and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflux.functions.text import alnum_count, is_blank, words
from folioflux.operators import pages as pg
from folioflux.operators.latest import latest_by


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def native_pages(spark, sf) -> DataFrame:
    """(doc_sha256, page_number, text) of the text layers, repeated inspections once."""
    i = read(spark, sf, "inspections").filter("page_texts is not null").select("doc_sha256", "page_texts").distinct()
    return i.select("doc_sha256", F.posexplode("page_texts").alias("at", "text")).select("doc_sha256", (F.col("at") + 1).cast("int").alias("page_number"), "text")


def recognised_pages(spark, sf) -> DataFrame:
    return latest_by(read(spark, sf, "recovered_pages").select("doc_sha256", "page_number", "text", "rotation", "score", "bands", "recovered_at"), ["doc_sha256", "page_number"], "recovered_at")


def doc_status(spark, sf):
    """One row per document: admitted, or why not. Failures are rows."""
    i = read(spark, sf, "inspections").select("doc_sha256", "doc_size", "openable", "needs_password", "page_count", F.size("page_texts").alias("n")).distinct()
    code = F.when(~F.coalesce("openable", F.lit(False)), "malformed").when(F.coalesce("needs_password", F.lit(False)), "password-required").when(F.col("doc_size") > 512 * 1024 * 1024, "resource-limit").when(~(F.col("n") == F.col("page_count")), "incomplete-text")
    return i.select("doc_sha256", F.when(code.isNull(), "complete").otherwise("failed").alias("status"), code.alias("code"))


def doc_text_layer(spark, sf):
    """Declared against found text layers."""
    i = read(spark, sf, "inspections").filter("page_texts is not null").select("doc_sha256", "has_text_layer", F.exists("page_texts", lambda t: ~is_blank(t)).alias("found")).distinct()
    return i.groupBy("has_text_layer", "found").agg(F.count("*").alias("documents"))


def page_selection(spark, sf):
    """Pages to recognise, recognised and outstanding."""
    n = native_pages(spark, sf)
    r = recognised_pages(spark, sf).select("doc_sha256", "page_number", F.lit(True).alias("done"))
    j = n.join(r, ["doc_sha256", "page_number"], "left")
    cand, done = pg.is_candidate("text", F.lit(0.0)), F.coalesce("done", F.lit(False))
    return j.groupBy("doc_sha256").agg(F.count("*").alias("pages"), F.count_if(cand).alias("candidates"), F.count_if(done).alias("recognised"), F.count_if(cand & ~done).alias("outstanding")).withColumn(
        "completeness", F.when(F.col("outstanding") > 0, "unrecognized-candidates").when(F.col("recognised") > 0, "complete").otherwise("not-requested"))


def page_outstanding(spark, sf):
    """Candidates without a recognised page (anti join)."""
    c = native_pages(spark, sf).filter(pg.is_candidate("text", F.lit(0.0))).select("doc_sha256", "page_number")
    return c.join(recognised_pages(spark, sf), ["doc_sha256", "page_number"], "left_anti")


def page_coverage(spark, sf):
    """Raster coverage of pages: order lines stand for image boxes on a page of 60 by 100."""
    x = read(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 6.0).alias("x0"), F.lit(10.0).alias("y0"), (F.col("l_linenumber") * 6.0 + F.col("l_quantity")).alias("x1"), (F.lit(10.0) + F.col("l_discount") * 1000).alias("y1"), F.lit(0.0).alias("a0"), F.lit(0.0).alias("b0"), F.lit(60.0).alias("a1"), F.lit(100.0).alias("b1"))
    g = pg.raster_coverage(x, ["l_orderkey"], ("x0", "y0", "x1", "y1"), ("a0", "b0", "a1", "b1"))
    return g.select("l_orderkey", F.round("coverage", 4).alias("coverage"), (F.round("coverage", 4) >= 0.5).alias("candidate"))


def page_range_lists(spark, sf):
    """Page lists parsed for every inspected document."""
    i = read(spark, sf, "inspections").filter("page_count is not null").select("doc_sha256", "page_count").distinct()
    c = F.col("page_count").cast("string")
    raw = F.when(F.col("page_count") % 4 == 0, F.lit(None)).when(F.col("page_count") % 4 == 1, F.concat(F.lit("1,1-"), c)).when(F.col("page_count") % 4 == 2, F.concat(F.lit("2 - "), c, F.lit(", 1"))).otherwise(F.concat(F.lit("2-"), (F.col("page_count") + 1).cast("string")))
    return i.select("doc_sha256", F.array_join(F.coalesce(pg.parse_pages(raw, "page_count"), F.array(F.lit(-1))).cast("array<string>"), ",").alias("pages"))


def page_runs(spark, sf):
    """Recognised pages as runs of consecutive numbers."""
    return pg.page_ranges(read(spark, sf, "recovered_pages").select("doc_sha256", "page_number"), ["doc_sha256"], "page_number")


def doc_text(spark, sf):
    """The text of each document, pages joined by form feeds, as a hash and a length."""
    t = pg.joined_text(native_pages(spark, sf), ["doc_sha256"], "page_number", "text")
    return t.select("doc_sha256", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha256"))


def doc_reader(spark, sf):
    """The reader's view of recognised documents."""
    r = recognised_pages(spark, sf).withColumn("page", pg.reader_page("page_number", "text"))
    t = pg.joined_text(r, ["doc_sha256"], "page_number", "page", by="\n\n")
    return t.select("doc_sha256", F.sha2("text", 256).alias("sha256"), F.length("text").alias("chars"))


def page_anchors(spark, sf):
    return native_pages(spark, sf).select("doc_sha256", "page_number", pg.page_anchor("doc_sha256", "page_number").alias("anchor"))


def _ocr_words(spark, sf):
    w = recognised_pages(spark, sf).select("doc_sha256", "page_number", F.posexplode(words("text")).alias("pos", "text")).withColumn("angle", F.explode(F.array(*[F.lit(a) for a in (0, 90, 180, 270)])))
    conf = ((F.length("text") * 37 + F.col("pos") * 13 + F.col("angle") * 7) % 100).cast("double")
    return w.select("doc_sha256", "page_number", "angle", F.lit(5).alias("level"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), F.floor(F.col("pos") / 9).cast("int").alias("line_num"), "pos", conf.alias("conf"), "text")


def ocr_scores(spark, sf):
    """Score and text of each page at each of four angles; confidences are made up from the words."""
    g = pg.recognised(_ocr_words(spark, sf), ["doc_sha256", "page_number", "angle"])
    return g.select("doc_sha256", "page_number", "angle", "score", F.sha2("text", 256).alias("text"))


def ocr_best_rotation(spark, sf):
    g = pg.recognised(_ocr_words(spark, sf), ["doc_sha256", "page_number", "angle"])
    return pg.best_rotation(g, ["doc_sha256", "page_number"]).select("doc_sha256", "page_number", "angle", "score")


def ocr_alnum(spark, sf):
    """Letters and digits per recognised page."""
    return recognised_pages(spark, sf).select("doc_sha256", "page_number", alnum_count("text").alias("alnum"))


def doc_typography(spark, sf):
    """Body and heading sizes of documents; the length of a word stands for its size."""
    d = read(spark, sf, "documents").filter("text is not null").select("doc_id", F.posexplode(F.filter(F.split("text", "[ \\n\\r\\t]+"), lambda w: F.length(w) > 0)).alias("pos", "text")).withColumn("size", F.length("text").cast("double"))
    t = pg.typography(d, "doc_id", "size", "text", "pos")
    return t.select("doc_id", "body_size", F.size("heading_sizes").alias("headings"), F.coalesce(F.get("heading_sizes", F.lit(0)), F.lit(0.0)).alias("largest"))


def page_merged_runs(spark, sf):
    """Words of recognised pages merged to runs with and without digits."""
    w = recognised_pages(spark, sf).select("doc_sha256", "page_number", F.posexplode(F.filter(F.split("text", "[ \\n\\r\\t]+"), lambda w: F.length(w) > 0)).alias("pos", "text")).withColumn("digits", F.col("text").rlike("[0-9]"))
    m = pg.merge_runs(w, ["doc_sha256", "page_number"], "pos", "digits", "text")
    return m.select("doc_sha256", "page_number", "run", "digits", "pieces", F.length("text").alias("chars"))


def page_methods(spark, sf):
    """How each page's text is had: recognised before native."""
    n = native_pages(spark, sf)
    r = recognised_pages(spark, sf).select("doc_sha256", "page_number", F.col("text").alias("ocr"))
    j = n.join(r, ["doc_sha256", "page_number"], "left")
    none = F.lit(None).cast("string")
    m = pg.resolve_method(none, F.col("ocr"), none, F.col("text"), is_blank("text"))
    return j.select("doc_sha256", "page_number", m["method"].alias("method"), F.length(m["text"]).alias("chars"))


def page_amended(spark, sf):
    """Pages of native documents, replaced by the recognised ones where there are any."""
    n = native_pages(spark, sf)
    r = recognised_pages(spark, sf).select("doc_sha256", "page_number", "text")
    return pg.upsert(n, r, ["doc_sha256", "page_number"]).select("doc_sha256", "page_number", F.length("text").alias("chars"))


def doc_word_gate(spark, sf):
    """Documents against a proposal with other words and one with other markup only."""
    d = read(spark, sf, "documents").filter("text is not null").select("doc_id", "text")
    good = F.regexp_replace("text", r"(?m)^([A-Z])", "## $1")
    g = pg.gated("text", F.array(F.concat("text", F.lit(" more")), good))
    return d.select("doc_id", g["reason"].alias("reason"), (g["text"] == good).alias("took_second"))


def page_cross_check(spark, sf):
    """Recognised pages against themselves without every seventh word."""
    r = recognised_pages(spark, sf)
    w = words("text")
    m = F.array_join(F.transform(F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda s: s.i % 7 != 6), lambda s: s.w), " ")
    c = r.select("doc_sha256", "page_number", m.alias("m"), pg.cross_check("text", m).alias("c"))
    return c.select("doc_sha256", "page_number", "c.reference_words", "c.vision_words", "c.matched_words", "c.disagreements", F.round("c.agreement", 6).alias("agreement"), pg.below_floor(F.col("c"), "m").alias("rejected"))


def doc_sizes(spark, sf):
    """Declared against found sizes of texts, by primary class."""
    d = read(spark, sf, "documents").groupBy("primary_class")
    return d.agg(F.count("*").alias("documents"), F.sum("n_chars").alias("declared"), F.sum(F.length("text").cast("long")).alias("found"), F.count_if(F.col("n_chars") != F.length("text")).alias("wrong"))


def doc_missing_files(spark, sf):
    """Files that a document includes and that did not come with it."""
    d = read(spark, sf, "documents").filter("text is not null")
    inc = F.regexp_extract_all("text", F.lit(r"\\(?:input|include|includegraphics)(?:\[[^\]]*\])?\{([^}]*)\}"), F.lit(1))
    got = d.select("doc_id", F.explode(F.array_distinct(inc)).alias("file"), "file_list")
    there = F.exists(F.coalesce("file_list", F.array().cast("array<string>")), lambda f: (f == F.col("file")) | (F.regexp_replace(f, r"\.[A-Za-z0-9]+$", "") == F.col("file")))
    return got.filter(~there).select("doc_id", "file")


def doc_file_types(spark, sf):
    """Files by media type."""
    f = read(spark, sf, "documents").select("doc_id", F.explode("file_list").alias("path"))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for x in ("tex", "text/x-tex", "pdf", "application/pdf", "png", "image/png", "bib", "text/x-bibtex", "txt", "text/plain")])
    return f.groupBy(F.coalesce(F.try_element_at(kinds, ext), F.lit("application/octet-stream")).alias("media_type")).agg(F.count("*").alias("files"), F.countDistinct("doc_id").alias("documents"))


def doc_titles(spark, sf):
    """Titles from file names."""
    f = read(spark, sf, "documents").select(F.explode("file_list").alias("path")).distinct()
    return f.select("path", pg.title_of("path").alias("title"))


def doc_first_copies(spark, sf):
    """The first document of each text, by time and id, and its copies."""
    d = read(spark, sf, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), "submitted_at")
    return d.groupBy("sha256").agg(F.min(F.struct(F.col("submitted_at").isNull().alias("n"), "submitted_at", "doc_id")).alias("f"), F.count("*").alias("copies")).select("sha256", F.col("f.doc_id").alias("doc_id"), "copies")


def doc_latest_versions(spark, sf):
    """The latest version of each paper."""
    d = read(spark, sf, "documents").filter("paper_key is not null and version is not null").select("paper_key", "version", "doc_id")
    return d.groupBy("paper_key").agg(F.max(F.struct("version", "doc_id")).alias("m"), F.count("*").alias("rows")).select("paper_key", F.col("m.version").alias("version"), F.col("m.doc_id").alias("doc_id"), "rows")


def doc_sections(spark, sf):
    """Headings with slugs, repeated slugs of a document numbered."""
    d = read(spark, sf, "documents").filter("text is not null")
    h = d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\\(?:sub)*section\*?\{([^}]*)\}"), F.lit(1))).alias("pos", "title"))
    s = h.withColumn("slug", F.regexp_replace(F.trim(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N} _-]", "")), " ", "-"))
    n = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("pos")) - 1
    return s.withColumn("n", n).select("doc_id", "pos", "title", F.when(F.col("n") > 0, F.concat("slug", F.lit("-"), F.col("n").cast("string"))).otherwise(F.col("slug")).alias("slug"))


def doc_blocks(spark, sf):
    """Blocks of lines from one section heading to the next."""
    d = read(spark, sf, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("pos", "line"))
    head = F.col("line").rlike(r"^\\(sub)*section").cast("int")
    b = d.withColumn("block", F.sum(head).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return b.groupBy("doc_id", "block").agg(F.min("pos").alias("first"), F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def doc_glob_families(spark, sf):
    """Files by the path patterns that select them, the first pattern wins."""
    from folioflux.functions.globs import first_match

    f = read(spark, sf, "documents").select(F.explode("file_list").alias("path")).distinct()
    return f.select("path", first_match("path", [("figures", "fig*/**"), ("sections", "sections/*"), ("sources", "**/*.tex"), ("rest", "**")]).alias("family"))


def label_tallies(spark, sf):
    """Judgements by week, kind and verdict with the share flagged."""
    lb = read(spark, sf, "content_labels").filter("rated_at is not null")
    day = F.dayofmonth("rated_at")
    week = F.concat(F.date_format("rated_at", "yyyy-MM"), F.lit("-w"), (F.floor((day - 1) / 7) + 1).cast("string"))
    return lb.groupBy(week.alias("week"), F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("judgements"), F.count_if(F.col("flagged") == 1).alias("flagged"))


def label_disagreements(spark, sf):
    """Documents on which raters disagree."""
    lb = read(spark, sf, "content_labels")
    g = lb.groupBy("doc_id").agg(F.countDistinct("rater").alias("raters"), F.countDistinct(F.concat_ws("|", F.col("flagged").cast("string"), F.coalesce("kind", F.lit("none")))).alias("verdicts"))
    return g.filter("verdicts > 1")


def image_hashes(spark, sf):
    """Difference hashes of the first 72 values of each vector, as on a grid of 9 by 8, in hex."""
    e = read(spark, sf, "embeddings")
    v = F.flatten(F.array_repeat("embedding", 9))
    return e.select("vec_id", F.lpad(F.lower(F.hex(pg.difference_hash(F.slice(v, 1, 72)))), 16, "0").alias("hash"))


def run_looks(spark, sf):
    """Looks of text runs; prices stand for sizes and keys for flags."""
    x = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", pg.run_look(F.col("l_quantity") / 4, F.col("l_partkey").cast("int"), F.concat(F.lit("Sans-"), F.when(F.col("l_linenumber") == 1, "Bold").otherwise("Oblique"))).alias("k"))
    return x.groupBy("k.size", "k.bold", "k.italic", "k.mono").agg(F.count("*").alias("runs"))


def doc_mentioned_files(spark, sf):
    """Documents that name a file that came with some paper, with or without its suffix."""
    from folioflux.functions.records import mentions

    d = read(spark, sf, "documents")
    return mentions(d.filter("text is not null"), "doc_id", "text", d.select(F.explode("file_list").alias("path")), "path", lambda c: F.regexp_replace(c, r"\.[A-Za-z]{2,4}$", ""))


def event_usage(spark, sf):
    """A count in the JSON of events, by either spelling."""
    from folioflux.functions.records import usage

    e = read(spark, sf, "events")
    return e.groupBy("event_type").agg(F.sum(usage("props", "kk", "k")).alias("total"), F.count(usage("props", "kk", "k")).alias("n"))


def event_interval_union(spark, sf):
    """United time of events as intervals of value times ten minutes, per user."""
    from folioflux.operators.tracing import interval_union

    e = read(spark, sf, "events").select("user_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("s"), (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") + F.floor(F.col("value") * 600).cast("long")).alias("e"))
    return interval_union(e, ["user_id"], "s", "e", "union_us")


def event_peak_concurrency(spark, sf):
    from folioflux.operators.tracing import peak_concurrency

    e = read(spark, sf, "events").select("user_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("s"), (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") + F.floor(F.col("value") * 600).cast("long")).alias("e"))
    return peak_concurrency(e, "user_id", "s", "e")


def event_p95(spark, sf):
    from folioflux.operators.tracing import nearest_rank

    return nearest_rank(read(spark, sf, "events"), ["event_type"], "value", 0.95, 1)


def page_identity(spark, sf):
    """Identity of what is read from each page: document, page and text together."""
    from folioflux.functions.records import prompt_identity

    return native_pages(spark, sf).select("doc_sha256", "page_number", prompt_identity("doc_sha256", F.col("page_number").cast("string"), "text").alias("identity"))


def page_strips(spark, sf):
    """Strips of recognised pages cut into their bands, 8,000 rows each."""
    from folioflux.functions.records import strip_edges

    r = recognised_pages(spark, sf).filter("bands >= 1")
    cuts = F.transform(F.filter(F.sequence(F.lit(0), F.col("bands") - 1), lambda i: i > 0), lambda i: i * 8000)
    return r.select("doc_sha256", "page_number", F.posexplode(strip_edges(F.lit(0), F.col("bands") * 8000, cuts)).alias("strip", "x")).select("doc_sha256", "page_number", "strip", F.col("x.from").alias("top"), F.col("x.to").alias("bottom"))


def page_block_kinds(spark, sf):
    """Blocks of recognised pages between empty lines, by kind."""
    b = recognised_pages(spark, sf).select("doc_sha256", "page_number", F.explode(F.split("text", "\n\n")).alias("b"))
    return b.groupBy(pg.block_kind(F.split("b", "\n")).alias("kind")).agg(F.count("*").alias("blocks"))


def item_tables(spark, sf):
    """Test items by task and split as a Markdown table of counts."""
    g = read(spark, sf, "eval_items").groupBy("task").agg(F.array_sort(F.collect_list("split")).alias("s"))
    row = F.array(F.col("task"), F.size(F.filter("s", lambda x: x == "test")).cast("string"), F.size("s").cast("string"))
    return g.select("task", pg.table_markdown(F.array(F.array(F.lit("task"), F.lit("test"), F.lit("all")), row)).alias("table"))


_NP = "np AS (SELECT DISTINCT doc_sha256, page_texts FROM inspections WHERE page_texts IS NOT NULL), n AS (SELECT doc_sha256, CAST(unnest(range(1, len(page_texts) + 1)) AS INT) page_number, unnest(page_texts) AS text FROM np)"
_RP = "r AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY doc_sha256, page_number ORDER BY recovered_at DESC) rn FROM recovered_pages) WHERE rn = 1)"
_BLANK = r"regexp_full_match(coalesce(text, ''), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]*')"
_SPLIT = r"list_filter(regexp_split_to_array(text, '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+'), lambda x: length(x) > 0)"
_WS = r"list_filter(regexp_split_to_array(text, '[ \n\r\t]+'), lambda x: length(x) > 0)"
_OCR = rf"""w0 AS (SELECT doc_sha256, page_number, {_SPLIT} ws FROM r), w1 AS (SELECT doc_sha256, page_number, unnest(range(0, len(ws))) pos, unnest(ws) AS text FROM w0),
w AS (SELECT *, (length(text) * 37 + pos * 13 + angle * 7) % 100 conf, pos // 9 line_num FROM w1, (VALUES (0), (90), (180), (270)) a(angle)),
l AS (SELECT doc_sha256, page_number, angle, line_num, string_agg(text, ' ' ORDER BY pos) line, sum(length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) * greatest(0, conf - 50)) score FROM w GROUP BY ALL),
g AS (SELECT doc_sha256, page_number, CAST(angle AS INT) angle, string_agg(line, chr(10) ORDER BY line_num) txt, CAST(sum(score) AS DOUBLE) score FROM l GROUP BY ALL)"""
SQL = {
    "doc_status": "SELECT DISTINCT doc_sha256, CASE WHEN code IS NULL THEN 'complete' ELSE 'failed' END status, code FROM (SELECT doc_sha256, CASE WHEN NOT coalesce(openable, false) THEN 'malformed' WHEN coalesce(needs_password, false) THEN 'password-required' WHEN doc_size > 536870912 THEN 'resource-limit' WHEN NOT (len(page_texts) = page_count) THEN 'incomplete-text' END code FROM inspections)",
    "doc_text_layer": f"SELECT has_text_layer, found, count(*) documents FROM (SELECT DISTINCT doc_sha256, has_text_layer, len(list_filter(page_texts, lambda text: NOT {_BLANK})) > 0 AS found FROM inspections WHERE page_texts IS NOT NULL) GROUP BY 1, 2",
    "page_selection": f"""WITH {_NP}, {_RP}, j AS (SELECT n.doc_sha256, {_BLANK.replace('text', 'n.text')} cand, r.doc_sha256 IS NOT NULL done FROM n LEFT JOIN r USING (doc_sha256, page_number)),
g AS (SELECT doc_sha256, count(*) pages, count(*) FILTER (cand) candidates, count(*) FILTER (done) recognised, count(*) FILTER (cand AND NOT done) outstanding FROM j GROUP BY 1) SELECT *, CASE WHEN outstanding > 0 THEN 'unrecognized-candidates' WHEN recognised > 0 THEN 'complete' ELSE 'not-requested' END completeness FROM g""",
    "page_outstanding": f"WITH {_NP} SELECT doc_sha256, page_number FROM n WHERE {_BLANK} AND NOT EXISTS (SELECT 1 FROM recovered_pages q WHERE q.doc_sha256 = n.doc_sha256 AND q.page_number = n.page_number)",
    "page_coverage": """SELECT l_orderkey, coverage, coverage >= 0.5 candidate FROM (SELECT l_orderkey, round(sum(greatest(0.0, least(l_linenumber * 6.0 + l_quantity, 60.0) - greatest(l_linenumber * 6.0, 0.0)) * greatest(0.0, least(10.0 + l_discount * 1000, 100.0) - 10.0)) / 6000.0, 4) coverage FROM lineitem GROUP BY 1)""",
    "page_range_lists": """WITH i AS (SELECT DISTINCT doc_sha256, page_count c FROM inspections WHERE page_count IS NOT NULL) SELECT doc_sha256, CASE WHEN c % 4 = 3 THEN '-1' WHEN c % 4 = 2 AND c < 2 THEN '-1' ELSE array_to_string(range(1, c + 1), ',') END pages FROM i""",
    "page_runs": "WITH d AS (SELECT DISTINCT doc_sha256, page_number p FROM recovered_pages), k AS (SELECT *, p - row_number() OVER (PARTITION BY doc_sha256 ORDER BY p) g FROM d) SELECT doc_sha256, CAST(min(p) AS BIGINT) AS \"first\", CAST(max(p) AS BIGINT) AS \"last\" FROM k GROUP BY doc_sha256, g",
    "doc_text": f"WITH {_NP} SELECT doc_sha256, CAST(length(t) AS INT) chars, sha256(t) sha256 FROM (SELECT doc_sha256, string_agg(coalesce(text, ''), chr(12) ORDER BY page_number) t FROM n GROUP BY 1)",
    "doc_reader": rf"""WITH {_RP}, p AS (SELECT doc_sha256, page_number, '## Page ' || page_number || chr(10) || chr(10) || CASE WHEN {_BLANK} THEN '{pg.PLACEHOLDER}' ELSE regexp_replace(text, '^[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+|[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+$', '', 'g') END t FROM r),
g AS (SELECT doc_sha256, string_agg(t, chr(10) || chr(10) ORDER BY page_number) t FROM p GROUP BY 1) SELECT doc_sha256, sha256(t) sha256, CAST(length(t) AS INT) chars FROM g""",
    "page_anchors": f"WITH {_NP} SELECT doc_sha256, page_number, 'folio-pdf-' || doc_sha256 || '-page-' || format('{{:06d}}', page_number) anchor FROM n",
    "ocr_scores": f"WITH {_RP}, {_OCR} SELECT doc_sha256, page_number, angle, score, sha256(txt) AS text FROM g",
    "ocr_best_rotation": f"WITH {_RP}, {_OCR} SELECT doc_sha256, page_number, angle, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_sha256, page_number ORDER BY score DESC, angle) rn FROM g) WHERE rn = 1",
    "ocr_alnum": rf"WITH {_RP} SELECT doc_sha256, page_number, CAST(length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS INT) alnum FROM r",
    "doc_typography": f"""WITH w0 AS (SELECT doc_id, {_WS} ws FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, unnest(range(0, len(ws))) pos, unnest(ws) AS text FROM w0), s AS (SELECT doc_id, CAST(length(text) AS DOUBLE) size, sum(length(text)) w, min(pos) p FROM w GROUP BY 1, 2),
b AS (SELECT doc_id, size body_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, p) rn FROM s) WHERE rn = 1) SELECT b.doc_id, body_size, CAST(count(*) FILTER (size >= body_size * 1.15) AS INT) headings, coalesce(max(size) FILTER (size >= body_size * 1.15), 0) largest FROM b JOIN s USING (doc_id) GROUP BY 1, 2""",
    "page_merged_runs": f"""WITH {_RP}, w0 AS (SELECT doc_sha256, page_number, {_WS} ws FROM r), w AS (SELECT doc_sha256, page_number, unnest(range(0, len(ws))) pos, unnest(ws) AS text FROM w0), f AS (SELECT *, regexp_matches(text, '[0-9]') digits FROM w),
c AS (SELECT *, CASE WHEN lag(digits) OVER k = digits THEN 0 ELSE 1 END nw FROM f WINDOW k AS (PARTITION BY doc_sha256, page_number ORDER BY pos)), d AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY doc_sha256, page_number ORDER BY pos ROWS UNBOUNDED PRECEDING) AS INT) run FROM c)
SELECT doc_sha256, page_number, run, digits, count(*) pieces, CAST(sum(length(text)) AS INT) chars FROM d GROUP BY ALL""",
    "page_methods": f"WITH {_NP}, {_RP} SELECT n.doc_sha256, n.page_number, CASE WHEN r.text IS NOT NULL THEN 'ocr' ELSE 'native' END AS \"method\", CAST(length(coalesce(r.text, n.text, '')) AS INT) chars FROM n LEFT JOIN r USING (doc_sha256, page_number)",
    "page_amended": f"WITH {_NP}, {_RP} SELECT doc_sha256, page_number, CAST(length(text) AS INT) chars FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_sha256 = n.doc_sha256 AND r.page_number = n.page_number) UNION ALL SELECT doc_sha256, page_number, CAST(length(text) AS INT) FROM r",
    "doc_sizes": "SELECT primary_class, count(*) documents, CAST(sum(n_chars) AS BIGINT) declared, CAST(sum(length(text)) AS BIGINT) found, count(*) FILTER (n_chars <> length(text)) wrong FROM documents GROUP BY 1",
    "doc_missing_files": r"""WITH i AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\(?:input|include|includegraphics)(?:\[[^\]]*\])?\{([^}]*)\}', 1))) file, file_list FROM documents WHERE text IS NOT NULL)
SELECT doc_id, file FROM i WHERE len(list_filter(coalesce(file_list, []), lambda f: f = file OR regexp_replace(f, '\.[A-Za-z0-9]+$', '') = file)) = 0""",
    "doc_file_types": r"SELECT CASE lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) WHEN 'tex' THEN 'text/x-tex' WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'bib' THEN 'text/x-bibtex' WHEN 'txt' THEN 'text/plain' ELSE 'application/octet-stream' END media_type, count(*) files, count(DISTINCT doc_id) documents FROM (SELECT doc_id, unnest(file_list) path FROM documents) GROUP BY 1",
    "doc_titles": r"""WITH f AS (SELECT DISTINCT unnest(file_list) path FROM documents), t AS (SELECT path, trim(regexp_replace(lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '')), '[^a-z0-9]+', ' ', 'g')) t FROM f)
SELECT path, CASE WHEN t = '' THEN 'Document' ELSE array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END title FROM t""",
    "doc_first_copies": "WITH d AS (SELECT doc_id, sha256(text) sha256, submitted_at FROM documents WHERE text IS NOT NULL) SELECT sha256, doc_id, copies FROM (SELECT *, count(*) OVER (PARTITION BY sha256) copies, row_number() OVER (PARTITION BY sha256 ORDER BY submitted_at NULLS LAST, doc_id) rn FROM d) WHERE rn = 1",
    "doc_latest_versions": "SELECT paper_key, version, doc_id, \"rows\" FROM (SELECT paper_key, version, doc_id, count(*) OVER (PARTITION BY paper_key) AS \"rows\", row_number() OVER (PARTITION BY paper_key ORDER BY version DESC, doc_id DESC) rn FROM documents WHERE paper_key IS NOT NULL AND version IS NOT NULL) WHERE rn = 1",
    "doc_sections": r"""WITH h0 AS (SELECT doc_id, regexp_extract_all(text, '\\(?:sub)*section\*?\{([^}]*)\}', 1) t FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, CAST(unnest(range(0, len(t))) AS INT) pos, unnest(t) title FROM h0),
s AS (SELECT *, replace(trim(regexp_replace(lower(title), '[^\p{L}\p{N} _-]', '', 'g')), ' ', '-') slug FROM h), q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY pos) - 1 k FROM s) SELECT doc_id, pos, title, CASE WHEN k > 0 THEN slug || '-' || k ELSE slug END slug FROM q""",
    "doc_blocks": r"""WITH l0 AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') t FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, CAST(unnest(range(0, len(t))) AS INT) pos, unnest(t) line FROM l0),
b AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(line, '^\\(sub)*section') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM l) SELECT doc_id, block, min(pos) AS "first", count(*) lines, CAST(sum(length(line)) AS BIGINT) chars FROM b GROUP BY 1, 2""",
    "doc_glob_families": r"SELECT path, CASE WHEN regexp_full_match(path, 'fig[^/]*/.*') THEN 'figures' WHEN regexp_full_match(path, 'sections/[^/]*') THEN 'sections' WHEN regexp_full_match(path, '(?:.*/)?[^/]*\.tex') THEN 'sources' ELSE 'rest' END family FROM (SELECT DISTINCT unnest(file_list) path FROM documents)",
    "label_tallies": "SELECT strftime(rated_at, '%Y-%m') || '-w' || CAST((day(rated_at) - 1) // 7 + 1 AS VARCHAR) AS \"week\", coalesce(kind, 'none') kind, count(*) judgements, count(*) FILTER (flagged = 1) flagged FROM content_labels WHERE rated_at IS NOT NULL GROUP BY 1, 2",
    "label_disagreements": "SELECT doc_id, count(DISTINCT rater) raters, count(DISTINCT concat_ws('|', CAST(flagged AS VARCHAR), coalesce(kind, 'none'))) verdicts FROM content_labels GROUP BY 1 HAVING count(DISTINCT concat_ws('|', CAST(flagged AS VARCHAR), coalesce(kind, 'none'))) > 1",
    "doc_mentioned_files": r"""WITH f AS (SELECT DISTINCT regexp_replace(unnest(file_list), '\.[A-Za-z]{2,4}$', '') path FROM documents), t AS (SELECT DISTINCT doc_id, regexp_replace(regexp_replace(unnest(regexp_extract_all(text, '[\w./-]*\w')), '^\./', ''), '\.[A-Za-z]{2,4}$', '') path FROM documents WHERE text IS NOT NULL) SELECT path, doc_id FROM t JOIN f USING (path)""",
    "event_usage": "SELECT event_type, CAST(sum(k) AS BIGINT) total, count(k) n FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events) GROUP BY 1",
    "event_interval_union": """WITH q AS (SELECT DISTINCT user_id, epoch_us(ts) s, epoch_us(ts) + CAST(floor(value * 600) AS BIGINT) e FROM events), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pm FROM q WHERE e > s) SELECT user_id, CAST(sum(greatest(0, e - greatest(s, coalesce(pm, s)))) AS BIGINT) union_us FROM m GROUP BY 1""",
    "event_peak_concurrency": """WITH q AS (SELECT user_id, epoch_us(ts) s, epoch_us(ts) + CAST(floor(value * 600) AS BIGINT) e FROM events WHERE value IS NOT NULL), v AS (SELECT user_id, s t, 1 d FROM q UNION ALL SELECT user_id, e, -1 FROM q), r AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) n FROM v) SELECT user_id, CAST(greatest(0, max(n)) AS BIGINT) peak FROM r GROUP BY 1""",
    "event_p95": "SELECT event_type, count(*) samples, quantile_disc(value, 0.95) p FROM events WHERE value IS NOT NULL GROUP BY 1",
    "page_identity": f"WITH {_NP} SELECT doc_sha256, page_number, sha256(concat_ws(chr(10) || chr(10), doc_sha256, CAST(page_number AS VARCHAR), text)) AS identity FROM n",
    "page_strips": f"WITH {_RP} SELECT doc_sha256, page_number, CAST(i AS INT) strip, CAST(i * 8000 AS INT) top, CAST((i + 1) * 8000 AS INT) bottom FROM r, unnest(range(0, bands)) t(i) WHERE bands >= 1",
    "page_block_kinds": rf"""WITH {_RP}, b AS (SELECT unnest(string_split(text, chr(10) || chr(10))) b FROM r), l AS (SELECT string_split(b, chr(10)) a FROM b), k AS (SELECT a, list_max(list_transform(a, lambda x: length(x))) f FROM l)
SELECT CASE WHEN len(list_filter(a, lambda x: regexp_matches(x, '^\s*(?:[-*•‣▪◦–]|\(?\d{{1,3}}[.)])\s+\S'))) > 0 THEN 'list' WHEN len(a) > 0 AND len(list_filter(a[:len(a) - 1], lambda x: NOT length(x) >= 0.75 * f)) = 0 THEN 'wrapped' ELSE 'lines' END kind, count(*) blocks FROM k GROUP BY 1""",
    "item_tables": "SELECT task, '| task | test | all |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || task || ' | ' || count(*) FILTER (split = 'test') || ' | ' || count(*) || ' |' AS \"table\" FROM eval_items GROUP BY task",
    "run_looks": r"SELECT size, bold, italic, mono, count(*) runs FROM (SELECT round_even(2 * (l_quantity / 4), 0) / 2 size, (CAST(l_partkey AS INT) & 16) > 0 OR l_linenumber = 1 bold, (CAST(l_partkey AS INT) & 2) > 0 OR l_linenumber <> 1 italic, (CAST(l_partkey AS INT) & 8) > 0 mono FROM lineitem) GROUP BY ALL",
}
_GATE = r"list_filter(regexp_split_to_array(translate(regexp_replace(regexp_replace({0}, '(?m)^(#{{1,6}} |- |> )', '', 'g'), '\]\([^()\s]*\)', ']', 'g'), '*`|\[]•‣▪◦●○∙·', ''), '\s+'), lambda x: x <> '' AND NOT regexp_full_match(x, '[-:]+'))"
_BIT = "CASE WHEN v[((4 * k + i) // 8) * 9 + (4 * k + i) % 8 + 1] < v[((4 * k + i) // 8) * 9 + (4 * k + i) % 8 + 2] THEN 8 >> CAST(i AS INT) ELSE 0 END"
SQL |= {
    "doc_word_gate": rf"""WITH d AS (SELECT doc_id, text, regexp_replace(text, '(?m)^([A-Z])', '## \1', 'g') good FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, {_GATE.format("text || ' more'")} = {_GATE.format('text')} a, {_GATE.format('good')} = {_GATE.format('text')} b, text = good same FROM d)
SELECT doc_id, CASE WHEN NOT a AND NOT b THEN 'words-changed' END reason, CASE WHEN a THEN false WHEN b THEN true ELSE same END took_second FROM g""",
    "image_hashes": f"SELECT vec_id, array_to_string(list_transform(range(16), lambda k: substr('0123456789abcdef', CAST(list_sum(list_transform(range(4), lambda i: {_BIT})) AS INT) + 1, 1)), '') hash FROM (SELECT vec_id, flatten([{', '.join(['embedding'] * 9)}])[1:72] v FROM embeddings)",
}
ROWS_ONLY = ["page_cross_check"]


def queries() -> dict:
    return {name: globals()[name] for name in [*SQL, *ROWS_ONLY]}
