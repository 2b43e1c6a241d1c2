"""Expressions over records of events, replies and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.functions.text import is_blank, strip


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def usage(body: Column | str, *keys: str) -> Column:
    """The first of several spellings of a count in a JSON text that is a whole number of 0 or more."""
    def one(k: str) -> Column:
        v = F.get_json_object(_c(body), f"$.{k}")
        return F.when(v.rlike(r"^\d{1,18}$"), v.try_cast("long"))

    return F.coalesce(*[one(k) for k in keys])


def first_text(body: Column | str) -> Column:
    """The first text that is not blank among content and message.content, each a string or a list of
    text parts."""
    b = _c(body)
    parts = "array<struct<type: string, text: string>>"

    def of(path: str) -> Column:
        raw = F.get_json_object(b, path)
        listed = F.array_join(F.transform(F.filter(F.from_json(raw, parts), lambda p: p.text.isNotNull() & F.coalesce(p.type == "text", F.lit(True))), lambda p: p.text), "\n")
        t = F.when(F.trim(raw).startswith("["), listed).otherwise(raw)
        return F.when(~is_blank(t), t)

    return F.coalesce(of("$.content"), of("$.message.content"))


def findings(block: Column | str) -> Column:
    """The findings listed in the last fenced JSON of a block, an object with ``findings``; null where
    there is none."""
    fences = F.regexp_extract_all(_c(block), F.lit(r"```json\s*\n((?s:.*?))\n\s*```"), F.lit(1))
    one = "struct<id: string, severity: string, classification: string, state: string, evidence: string>"
    return F.from_json(F.try_element_at(fences, F.lit(-1)), f"findings array<{one}>")["findings"]


def sections_of(block: Column | str, title: str, at_least: int = 30) -> Column:
    """Texts under headings of a title, of at least so many characters."""
    got = F.regexp_extract_all(_c(block), F.lit(rf"(?m)^#+ *{title}[^\n]*\n((?s:.*?))(?=^#|\z)"), F.lit(1))
    return F.filter(F.transform(got, strip), lambda x: F.length(x) >= at_least)


def link_destination(raw: Column | str) -> Column:
    """Where a Markdown link points: out of <>, without its title, percent signs taken back."""
    t = strip(raw)
    plain = F.regexp_replace(F.regexp_replace(t, r"^<([^>]*)>.*$", "$1"), r"""\s+("[^"]*"|'[^']*'|\([^)]*\))$""", "")
    return F.coalesce(F.try_url_decode(F.regexp_replace(plain, r"\+", "%2B")), plain)


def slug(title: Column | str) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(_c(title)), r"[^\p{L}\p{N} _-]", "")), " ", "-")


def prompt_identity(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\n\n", *[_c(p) for p in parts]), 256)


def strip_edges(top: Column | str, bottom: Column | str, cuts: Column | str) -> Column:
    """(from, to) of the strips between the top, each cut and the bottom."""
    e = F.concat(F.array(_c(top)), _c(cuts), F.array(_c(bottom)))
    return F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda i: F.struct(F.element_at(e, i.cast("int")).alias("from"), F.element_at(e, (i + 1).cast("int")).alias("to")))


def credible_headings(large_chars: Column | str, chars: Column | str, most: float = 0.3) -> Column:
    """Whether so little of a page is in large type that it can be headings."""
    return F.coalesce(_c(large_chars) <= _c(chars) * most, F.lit(True))


def kind_of(ids: Column | str, text: Column | str, rules: list[tuple[str, str]], default: str) -> Column:
    """The first kind whose pattern is in an id, else in the text, else the default."""
    def has(p: str) -> Column:
        return F.exists(F.coalesce(_c(ids), F.array().cast("array<string>")), lambda x: x.rlike(p))

    by_id = F.coalesce(*[F.when(has(p), k) for k, p in rules])
    return F.coalesce(by_id, *[F.when(_c(text).rlike(p), k) for k, p in rules], F.lit(default))


def envelope_faults(body: Column | str, required: list[str], allowed: list[str], whole: list[str] = ()) -> Column:
    """What is wrong with a JSON object: malformed, missing or unknown keys, counts that are no whole
    numbers of 0 or more."""
    b = _c(body)
    keys = F.json_object_keys(F.when(F.try_parse_json(b).isNotNull(), b))
    bad = [F.when(keys.isNull(), "malformed")]
    bad += [F.when(~F.array_contains(keys, k), f"missing-{k}") for k in required]
    bad.append(F.when(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))) > 0, "unknown-keys"))
    bad += [F.when(F.array_contains(keys, k) & usage(b, k).isNull(), f"bad-{k}") for k in whole]
    return F.filter(F.array(*bad), lambda x: x.isNotNull())


def filter_reports(df: DataFrame, trace_id: str | None = None, run_type: str | None = None, operation: str | None = None, since: str | None = None) -> DataFrame:
    """The report filters that are given, all of them."""
    conds = [F.col(c) == v for c, v in (("trace_id", trace_id), ("run_type", run_type), ("operation", operation)) if v is not None]
    conds += [F.col("finalized_at") >= since] if since is not None else []
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def mentions(docs: DataFrame, key: str, text: str, paths: DataFrame, path: str, form=lambda c: c) -> DataFrame:
    """(path, key): texts that mention a path as a whole token, both compared in one ``form`` (say, without
    suffix). Paths are few distinct tokens of texts, so the tokens of texts are joined to them instead of
    trying every pair."""
    t = docs.select(F.col(key), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"[\w./-]*\w"), F.lit(0)))).alias("__t"))
    t = t.withColumn("__t", form(F.regexp_replace("__t", r"^\./", "")))
    return t.join(paths.select(form(F.col(path)).alias("__t")).distinct(), "__t").select(F.col("__t").alias(path), key).distinct()


def without_launch(cancelled: DataFrame, launches: DataFrame, cols: list[str]) -> DataFrame:
    """Cancelled claims whose content no launch has, compared by digest."""
    d = F.sha2(F.to_json(F.struct(*cols)), 256)
    return cancelled.withColumn("__d", d).join(launches.select(d.alias("__d")).distinct(), "__d", "left_anti").drop("__d")


def union_scopes(frames: dict[str, DataFrame | Exception]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Ledgers of several scopes as one, each row with its scope; scopes that could not be read become
    diagnostics."""
    good = {k: v.withColumn("scope_name", F.lit(k)) for k, v in frames.items() if isinstance(v, DataFrame)}
    bad = [(k, f"{type(v).__name__}: {v}") for k, v in frames.items() if isinstance(v, Exception)]
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good.values()) if good else None), bad


def public(df: DataFrame, *names: str) -> DataFrame:
    """Without named private columns and those that begin with an underscore."""
    return df.drop(*names, *[c for c in df.columns if c.startswith("_")])
