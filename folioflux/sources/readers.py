"""Sources: ledgers of JSON lines, OCR tables, test reports, text and binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TSV_HEADER = ["level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text"]


def jsonl_ledger(spark: SparkSession, path: str, schema: str | StructType, unique: str | None = None) -> DataFrame:
    """Rows of a ledger, closed on failure: a line that is no object of the schema, or a repeated
    ``unique`` value, makes the whole read fail when it is run. Blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    s = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    s = StructType(s.fields).add("_bad", "string")
    r = lines.select(F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "value").select("r.*", "value")
    bad = F.col("_bad").isNotNull()
    first = s.fields[0].name
    r = r.withColumn(first, F.when(bad, F.raise_error(F.concat(F.lit("malformed ledger row: "), F.left("value", F.lit(80))))).otherwise(F.col(first))).drop("_bad", "value")
    if unique:
        twice = r.groupBy(unique).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(unique).alias("__u"))
        r = r.join(twice, F.col(unique) == F.col("__u"), "left").withColumn(unique, F.when(F.col("__u").isNotNull(), F.raise_error(F.concat(F.lit("repeated "), F.col("__u")))).otherwise(F.col(unique))).drop("__u")
    return r


def jsonl_tolerant(spark: SparkSession, path: str, schema: str, must_contain: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, lines that could not be read), for event streams read as far as they go. A substring
    filters the raw lines before any is parsed."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    if must_contain:
        lines = lines.filter(F.col("value").contains(must_contain))
    s = StructType.fromDDL(schema).add("_bad", "string")
    r = lines.select("line", F.from_json("value", s, {"columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    return r.filter("r is not null and r._bad is null").select("line", "r.*").drop("_bad"), r.filter("r is null or r._bad is not null").select("line", "value")


def ocr_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Words of an OCR table, tab separated and unquoted, in file order; a header other than the usual
    one or a confidence that is no number fails."""
    head = spark.read.text(path).first()
    if head is None or not set(TSV_HEADER) <= set(head.value.rstrip("\r").split("\t")):
        raise ValueError("not an OCR table")
    d = spark.read.csv(path, sep="\t", quote="", header=True, ignoreLeadingWhiteSpace=False)
    conf = F.coalesce(F.col("conf").try_cast("double"), F.raise_error(F.concat(F.lit("bad confidence "), F.coalesce("conf", F.lit("null")))).cast("double"))
    ints = [F.col(c).cast("int").alias(c) for c in TSV_HEADER[:-2]]
    return d.select(*ints, conf.alias("conf"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("pos"))


def junit(spark: SparkSession, path: str) -> DataFrame:
    """(file, total_seconds, cases, slowest): a report with any case without a valid time is no sample
    and gives nulls."""
    d = spark.read.format("xml").option("rowTag", "testcase").schema("_classname string, _name string, _time string").load(path).withColumn("file", F.input_file_name())
    t = F.col("_time").try_cast("double")
    ok = t.isNotNull() & (t >= 0) & ~F.isnan(t)
    g = d.groupBy("file").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"), F.sum(t).alias("s"), F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list(F.struct(t.alias("seconds"), F.concat_ws("::", "_classname", "_name").alias("case"))), False), 1, 5).alias("top"))
    return g.select("file", F.when(F.col("ok"), F.col("s")).alias("total_seconds"), "n", F.when(F.col("ok"), F.col("top")).alias("slowest"))


def files(spark: SparkSession, path: str, max_bytes: int | None = None, suffix: str | None = None, modified_after: str | None = None) -> DataFrame:
    """(path, size, sha256, content, status) of files; those over the cap have no content and a status."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffix:
        r = r.option("pathGlobFilter", f"*{suffix}")
    if modified_after:
        r = r.option("modifiedAfter", modified_after)
    d = r.load(path)
    over = F.col("length") > max_bytes if max_bytes is not None else F.lit(False)
    return d.select("path", F.col("length").alias("size"), F.when(~over, F.sha2("content", 256)).alias("sha256"), F.when(~over, F.col("content")).alias("content"), F.when(over, "resource-limit").otherwise("complete").alias("status"))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of whole text files, in order."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return d.select("file", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("pos", "line"))


def front_matter(spark: SparkSession, path: str) -> DataFrame:
    """(file, meta, body) of files with YAML between --- lines; meta is JSON, null where there is none
    or it is malformed."""
    import json

    def parse(s):
        import yaml

        def one(t):
            try:
                v = yaml.safe_load(t)
                return json.dumps(v, sort_keys=True, default=str) if isinstance(v, dict) else None
            except yaml.YAMLError:
                return None

        return s.map(one)

    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r\n", "\n").alias("v"))
    head = F.regexp_extract("v", r"^---\n((?s:.*?))\n---\n", 1)
    return d.select("file", F.when(F.length(head) > 0, F.pandas_udf(parse, "string")(head)).alias("meta"), F.regexp_replace("v", r"^---\n(?s:.*?)\n---\n", "").alias("body"))


def html_links(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, kind, value) of ids, links and images without a text in HTML pages."""

    def parse(s):
        from html.parser import HTMLParser

        class P(HTMLParser):
            def handle_starttag(self, tag, attrs):
                a = dict(attrs)
                if a.get("id"):
                    self.got.append({"kind": "id", "value": a["id"]})
                for k in ("href", "src"):
                    if a.get(k) is not None:
                        self.got.append({"kind": "base" if tag == "base" else "link", "value": a[k]})
                if tag == "img" and not a.get("alt"):
                    self.got.append({"kind": "no-alt", "value": a.get("src") or ""})

        def one(t):
            p = P()
            p.got = []
            p.feed(t or "")
            return p.got

        return s.map(one)

    got = F.pandas_udf(parse, "array<struct<kind: string, value: string>>")(F.col(html))
    return df.select(key, F.explode(got).alias("g")).select(key, "g.kind", "g.value")


def broken_links(links: DataFrame, key: str) -> DataFrame:
    """Links within the pages whose page or anchor is not there (anti join); links to elsewhere are left
    out. Pages are named by ``key``."""
    ids = links.filter("kind = 'id'").select(F.col(key).alias("page"), F.col("value").alias("anchor")).unionByName(links.select(F.col(key).alias("page"), F.lit("").alias("anchor"))).distinct()
    own = links.filter("kind = 'link'").filter(~F.col("value").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//"))
    t = own.select(key, "value", F.regexp_extract("value", "^([^#?]*)", 1).alias("p"), F.url_decode(F.regexp_extract("value", "#(.*)$", 1)).alias("anchor"))
    t = t.withColumn("page", F.when(F.col("p") == "", F.col(key)).otherwise(F.col("p")))
    return t.join(ids, ["page", "anchor"], "left_anti").select(key, "value")
