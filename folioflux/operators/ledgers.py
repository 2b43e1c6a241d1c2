"""Event-sourced state, log blocks, lessons, verdicts and other small ledgers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflux.functions.text import SPACE, is_blank
from folioflux.operators.hierarchy import resolve

#: States that may follow a state unless the caller names others; "" stands before the first.
TRANSITIONS = {
    "": ("not-started", "next", "in-progress", "completed"),  # the first event of a phase
    "not-started": ("next", "in-progress"),
    "next": ("not-started", "in-progress"),
    "in-progress": ("in-progress", "completed"),
    "completed": (),
}
# States in which a finding is still to be acted on, and marks of quoted templates.
ACTIONABLE = ("open", "addressed", "blocked-owner")
TEMPLATE_MARKS = ("[Specific issue]", "[One or two sentences", "\n## Rules", "Followed in the `REVISE` case", "=== ")


def rational(c: Column | str) -> Column:
    """(numerator, denominator) of a number written as 3, 3/4 or 1.25; null if it is none."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    frac, point = c.rlike(r"^-?\d{1,15}/[1-9]\d{0,14}$"), c.rlike(r"^-?\d{1,9}\.\d{1,9}$")
    places = F.length(F.regexp_extract(c, r"\.(\d+)$", 1))
    num = F.when(frac, F.split(c, "/")[0].try_cast("long")).when(point, F.regexp_replace(c, r"\.", "").try_cast("long")).when(c.rlike(r"^-?\d{1,15}$"), c.try_cast("long"))
    den = F.when(frac, F.get(F.split(c, "/"), F.lit(1)).try_cast("long")).when(point, F.pow(F.lit(10.0), places).cast("long")).when(num.isNotNull(), F.lit(1).cast("long"))
    return F.when(num.isNotNull(), F.struct(num.alias("n"), den.alias("d")))


def rational_key(order: Column | str) -> Column:
    """A key that sorts as the exact fractions do: the terms of the continued fraction, every second one
    negative, closed by infinity. Null for no number."""
    r = rational(order)
    start = F.struct(r["n"].alias("n"), r["d"].alias("d"), F.array().cast("array<bigint>").alias("a"))
    sign = lambda a: F.when(F.size(a) % 2 == 0, F.lit(1).cast("long")).otherwise(F.lit(-1).cast("long"))

    def step(acc: Column, _: Column) -> Column:
        n, d, a = acc["n"], acc["d"], acc["a"]
        rest = F.pmod(n, F.nullif(d, F.lit(0)))
        term = F.floor((n - rest).cast("decimal(19,0)") / F.nullif(d, F.lit(0)).cast("decimal(19,0)")).cast("long")
        return F.when(d == 0, acc).otherwise(F.struct(d.alias("n"), rest.alias("d"), F.concat(a, F.array(sign(a) * term)).alias("a")))

    # fractions of 15 digits have under 80 terms
    key = F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, step, lambda acc: F.concat(acc["a"], F.array(sign(acc["a"]) * F.lit(2**63 - 1))))
    return F.when(r.isNotNull(), key)


def rational_rank(df: DataFrame, order: str, *ties: str) -> DataFrame:
    """Adds ``rank`` by exact rational order, what is no number last. A list of phases, not a data table."""
    w = Window.orderBy(rational_key(order).asc_nulls_last(), *ties)
    return df.withColumn("rank", F.row_number().over(w))


def event_violations(events: DataFrame, transitions: dict[str, tuple[str, ...]] = TRANSITIONS) -> DataFrame:
    """(phase, code) of a ledger of events (id, phase, previous, from_state, state): not one first
    event, a predecessor that is missing or of another phase, a fork, a wrong or illegal state, a
    circle of predecessors. Where the ledger has these columns: work without owner or claim, a phase that
    changed hands without release and claim, a completion without acceptance, no writer or reason."""
    has = lambda *names: set(names) <= set(events.columns)
    e = events.select("id", "phase", "previous", F.coalesce("from_state", F.lit("")).alias("from_state"), "state", *[c for c in ("owner", "claim", "release", "acceptance", "writer", "reason") if has(c)])
    p = e.select(F.col("id").alias("previous"), F.col("phase").alias("p_phase"), F.col("state").alias("p_state"), *([F.col("owner").alias("p_owner")] if has("owner") else []))
    no = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    later = F.col("previous").isNotNull()
    j = e.join(p, "previous", "left")
    legal = F.create_map(*[x for k, v in transitions.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]) if v else F.array().cast("array<string>"))])
    rules = [
        (F.col("previous").isNotNull() & F.col("p_phase").isNull(), "missing-predecessor"), (F.col("p_phase") != F.col("phase"), "foreign-predecessor"), (F.col("p_state") != F.col("from_state"), "wrong-from-state"),
        (~F.coalesce(F.array_contains(F.try_element_at(legal, F.when(F.col("previous").isNull(), "").otherwise(F.col("from_state"))), F.col("state")), F.lit(False)), "illegal-transition")]
    if has("owner", "claim"):
        rules.append((later & (F.col("state") == "in-progress") & (no("owner") | no("claim")), "unclaimed-work"))
    if has("owner", "claim", "release"):
        rules.append((later & ~no("p_owner") & ~F.col("owner").eqNullSafe(F.col("p_owner")) & (no("release") | no("claim")), "unreleased-handoff"))
    if has("acceptance"):
        rules.append((later & (F.col("state") == "completed") & no("acceptance"), "unaccepted-completion"))
    if has("writer", "reason"):
        rules.append((no("writer") | no("reason"), "unattributed"))
    bad = j.select("phase", F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for c, k in rules]), lambda x: x.isNotNull())).alias("code"))
    forks = e.filter("previous is not null").groupBy("phase", "previous").agg(F.count("*").alias("n")).filter("n > 1").select("phase", F.lit("fork").alias("code"))
    first = e.groupBy("phase").agg(F.count_if(F.col("previous").isNull()).alias("n")).filter("n <> 1").select("phase", F.lit("not-one-genesis").alias("code"))
    loops = resolve(e, "phase", "id", "previous").filter("kind = 'cycle'").select("phase", F.lit("cycle").alias("code"))
    return bad.unionByName(forks).unionByName(first).unionByName(loops).distinct()


def heads(events: DataFrame) -> DataFrame:
    """The last event of each phase: the one that precedes none (anti join)."""
    return events.join(events.select(F.col("previous").alias("id")).filter("id is not null").distinct(), "id", "left_anti")


def current_phase(phases: DataFrame, heads_: DataFrame, owner: str) -> DataFrame:
    """The owner's ``next`` phase, else the unassigned one, with all it depends on complete."""
    state = heads_.select(F.col("phase").alias("id"), "state", "owner")
    done = heads_.filter("state = 'completed'").select(F.col("phase").alias("dep"))
    p = phases.join(state, "id").filter("state = 'next'")
    open_ = p.select("id", F.explode("depends_on").alias("dep")).join(done, "dep", "left_anti").select("id").distinct()
    ready = p.join(open_, "id", "left_anti").filter((F.col("owner") == owner) | F.col("owner").isNull())
    best = ready.agg(F.max(F.col("owner").isNotNull()).alias("own"))
    return ready.filter(F.col("owner").isNotNull() == best.scalar())


def graph_violations(phases: DataFrame, heads_: DataFrame) -> DataFrame:
    """(phase, code) of a phase graph (id, order, depends_on, parent) with the last event of each phase
    (phase, state, owner): no event, unknown or own targets, a dependency ordered after what depends on it,
    a circle, work before what it depends on is completed, completion before that of a child, and several
    phases selected next for one owner."""
    key = F.struct(rational_key("order").alias("o"), F.col("id"))
    h = heads_.select(F.col("phase").alias("id"), "state", "owner")
    p = phases.select("id", "parent", "depends_on", key.alias("key")).join(h, "id", "left")
    dep = p.select("id", "state", "key", F.explode("depends_on").alias("to"), F.lit("dependency").alias("by"))
    link = dep.unionByName(p.filter("parent is not null").select("id", "state", "key", F.col("parent").alias("to"), F.lit("parent").alias("by")))
    there = p.select(F.col("id").alias("to"), F.col("state").alias("to_state"), F.col("key").alias("to_key"), F.lit(True).alias("known"))
    j = link.join(there, "to", "left")
    works = F.col("state").isin("in-progress", "completed")
    of = F.col("by") == "dependency"
    rules = [(F.col("known").isNull() & of, "unknown-dependency"), (F.col("known").isNull() & ~of, "unknown-parent"), (F.col("id") == F.col("to"), "self-cycle"), (of & (F.col("to_key") > F.col("key")), "dependency-ordered-after"), (of & works & F.col("known") & ~F.col("to_state").eqNullSafe("completed"), "work-precedes-dependency")]
    bad = j.select(F.col("id").alias("phase"), F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for c, k in rules]), lambda x: x.isNotNull())).alias("code"))
    early = j.filter(~of & (F.col("to_state") == "completed") & ~F.col("state").eqNullSafe("completed")).select(F.col("to").alias("phase"), F.lit("incomplete-child").alias("code"))
    lost = p.filter("state is null").select(F.col("id").alias("phase"), F.lit("no-genesis").alias("code"))
    # several phases without an owner selected next are several for one owner, too
    twice = h.filter("state = 'next'").withColumn("n", F.count("*").over(Window.partitionBy("owner"))).filter("n > 1").select(F.col("id").alias("phase"), F.lit("several-next").alias("code"))
    # what is left when phases without open targets are taken away, again and again, lies on or above a circle
    left = j.filter("known").select("id", "to").distinct().checkpoint()
    n = left.count()
    while n:
        left = left.join(left.select(F.col("id").alias("to")).distinct(), "to", "left_semi").select("id", "to").checkpoint()
        n, before = left.count(), n
        if n == before:
            break
    loops = left.select(F.col("id").alias("phase"), F.lit("graph-cycle").alias("code")) if n else bad.limit(0)
    return bad.unionByName(early).unionByName(lost).unionByName(twice).unionByName(loops).distinct()


def log_blocks(lines: DataFrame, key: str, pos: str, text: str, header: str = r"^## ") -> DataFrame:
    """Blocks of a log from one header line to the next, with the digest of their text and whether the
    block's time goes back behind the one before."""
    w = Window.partitionBy(key).orderBy(pos)
    b = lines.withColumn("block", F.sum(F.col(text).rlike(header).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("block > 0")
    g = b.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x.t), "\n")
    g = g.select(key, F.col("block").cast("int").alias("block"), F.col("l")[0]["t"].alias("header"), body.alias("text"), F.sha2(body, 256).alias("sha256"), F.regexp_extract(F.col("l")[0]["t"], r"(\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d)?)?)", 1).alias("at"))
    return g.withColumn("backwards", F.coalesce(F.col("at") < F.lag("at").over(Window.partitionBy(key).orderBy("block")), F.lit(False)))


def corrections(blocks: DataFrame, key: str, pattern: str = r"corrects sha256:([0-9a-f]{64})") -> DataFrame:
    """Blocks that correct another by its digest, and whether exactly one earlier block has it."""
    c = blocks.select(key, F.col("block").alias("by"), F.regexp_extract("text", pattern, 1).alias("sha256")).filter("sha256 <> ''")
    t = blocks.select(key, "sha256", "block")
    return c.join(t, [key, "sha256"], "left").groupBy(key, "by", "sha256").agg((F.count_if(F.col("block") < F.col("by")) == 1).alias("valid"))


def lesson_state(lessons: DataFrame, as_of: Column, at_least: int = 3, days: int = 60) -> DataFrame:
    """Occurrences, last seen, candidate (open and often enough) and aged (open and long unseen)."""
    n, last = F.size("occurrences"), F.array_max(F.transform("occurrences", lambda o: o.date))
    open_ = F.col("status") == "open"
    return lessons.select("slug", "status", n.alias("occurrences"), last.alias("last_seen"), (open_ & (n >= at_least)).alias("candidate"), F.coalesce(open_ & (F.datediff(as_of, last) >= days), F.lit(False)).alias("aged"))


def normal_verdict(block: Column | str) -> Column:
    """Escaped line ends and quotes taken back, each stretch of white space one space, the first 1,500 characters."""
    t = F.replace(F.replace(F.col(block) if isinstance(block, str) else block, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return F.left(F.regexp_replace(t, rf"{SPACE}+", " "), F.lit(1500))


def genuine_verdict(block: Column | str) -> Column:
    """A verdict and no quotation: its header line alone comes first, no mark of the template stands in it,
    fewer than three lines begin with a line number, and none carries the prefix of a searched file."""
    b = F.col(block) if isinstance(block, str) else block
    lines = F.split(b, "\n")
    head = F.regexp_replace(F.get(lines, F.lit(0)), r"\s+$", "")
    # the header may be followed by empty lines, but a line must end after it
    starts = head.isin("## Verdict: APPROVED", "## Verdict: REVISE") & (F.size(lines) > 1)
    quoted = F.filter(lines, lambda x: x.rlike(r"^\s*\d+[\t:]"))
    marks = F.exists(F.array(*[F.lit(m) for m in TEMPLATE_MARKS]), lambda m: F.contains(b, m))
    return F.coalesce(starts & ~marks & (F.size(quoted) < 3) & ~b.rlike(r"\.(?:md|py|toml|yaml)-\d+-"), F.lit(False))


def first_seen(df: DataFrame, digest: list[str], order: list[str]) -> DataFrame:
    """One row per content, the first by ``order``."""
    k = F.sha2(F.to_json(F.struct(*digest)), 256)
    at = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in df.columns if c not in order and not dict(df.dtypes)[c].startswith("map")])
    return df.withColumn("key", k).groupBy("key").agg(F.min(at).alias("r")).select("key", "r.*")


def reaimed(findings: DataFrame) -> DataFrame:
    """Ids whose evidence changed among findings still to be acted on."""
    f = findings.filter(F.col("state").isin(*ACTIONABLE))
    return f.groupBy("project", "source", "kind", "id").agg(F.countDistinct("evidence").alias("evidences")).filter("evidences > 1")


def mutation_tally(mutations: DataFrame) -> DataFrame:
    """Mutants by outcome per path, and the share killed of those run."""
    g = mutations.groupBy("path").agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("killed", "survived", "timed_out", "not_run")])
    return g.withColumn("rate", F.expr("try_divide(killed + timed_out, killed + timed_out + survived)"))


def observed(df: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """The single value seen per key and name; conflicting values give null and a conflict."""
    g = df.filter(F.col(value).isNotNull()).groupBy(key, name).agg(F.collect_set(value).alias("v"))
    return g.select(key, name, F.when(F.size("v") == 1, F.col("v")[0]).alias(value), (F.size("v") > 1).alias("conflict"))


def strings_in(text: str | None) -> list[str]:
    """All strings in a JSON value, depth first; [] for what is no JSON."""
    try:
        todo = [json.loads(text or "")]
    except ValueError:
        return []
    out = []
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, list):
            todo += v[::-1]
        elif isinstance(v, dict):
            todo += list(v.values())[::-1]
    return out


def json_strings(c: Column | str) -> Column:
    return F.pandas_udf(lambda s: s.map(strings_in), "array<string>")(F.col(c) if isinstance(c, str) else c)


def canonical_digest(c: Column | str) -> Column:
    """Digest of a JSON value whatever the order of its keys; null for malformed values, repeated keys
    and numbers that are none."""

    def pairs(p):
        d = dict(p)
        if len(d) != len(p):
            raise ValueError("repeated key")
        return d

    def refuse(x):
        raise ValueError(x)

    def one(t):
        try:
            v = json.loads(t, object_pairs_hook=pairs, parse_constant=refuse)
        except (TypeError, ValueError):
            return None
        return hashlib.sha256(json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    return F.pandas_udf(lambda s: s.map(one), "string")(F.col(c) if isinstance(c, str) else c)


def outside_fences(c: Column | str) -> Column:
    """The lines of a Markdown text outside code fences."""

    def one(t):
        out, fence = [], None
        for x in (t or "").split("\n"):
            s = x.lstrip()
            mark = s[:3] if s[:3] in ("```", "~~~") else None
            if fence is None and mark:
                fence = mark
            elif fence is not None and mark == fence and not s.strip(mark[0]).strip():
                fence = None
            elif fence is None:
                out.append(x)
        return out

    return F.pandas_udf(lambda s: s.map(one), "array<string>")(F.col(c) if isinstance(c, str) else c)


def replay(rows: DataFrame, key: str, seq: str, digest: str, body: str, seed: str = "") -> DataFrame:
    """(key, rows, valid): whether each row's digest is that of the one before and its body, with
    sequence numbers from 1 without a hole.

    The digest of a row depends on the declared digest of the one before alone, so each row is checked
    against its predecessor, and the ledger holds if every row does; no group is folded in one task."""
    r = rows.select(F.col(key).alias("k"), F.col(seq).alias("s"), F.col(digest).alias("d"), F.col(body).alias("b"))
    p = r.select("k", (F.col("s") + 1).alias("s"), F.col("d").alias("p"))
    j = r.join(p, ["k", "s"], "left")
    ok = F.col("d") == F.sha2(F.concat(F.when(F.col("s") == 1, F.lit(seed)).otherwise(F.col("p")), F.col("b")), 256)
    return j.groupBy(F.col("k").alias(key)).agg(F.count("*").alias("rows"), (F.bool_and(F.coalesce(ok, F.lit(False))) & (F.countDistinct("s") == F.count("*")) & (F.min("s") == 1) & (F.max("s") == F.count("*"))).alias("valid"))


def finish_spans(opened: DataFrame, closes: DataFrame) -> DataFrame:
    """Open spans (trace_id, span_id, parent_span_id, boot_id, start_ns) with requests to close them
    (trace_id, span_id, boot_id, end_ns, outcome): (…, state) closed, open, conflict (different requests),
    open-children, other-boot or backwards. Equal requests count once."""
    c = closes.distinct().groupBy("trace_id", "span_id").agg(F.count("*").alias("n"), F.min(F.struct(F.col("boot_id").alias("b"), F.col("end_ns").alias("e"), F.col("outcome").alias("o"))).alias("c"))
    j = opened.join(c, ["trace_id", "span_id"], "left")
    kids = j.filter("c is null and parent_span_id is not null").select("trace_id", F.col("parent_span_id").alias("span_id"), F.lit(True).alias("kids")).distinct()
    j = j.join(kids, ["trace_id", "span_id"], "left")
    state = F.when(F.col("c").isNull(), "open").when(F.col("n") > 1, "conflict").when(F.col("kids"), "open-children").when(F.col("c.b") != F.col("boot_id"), "other-boot").when(F.col("c.e") < F.col("start_ns"), "backwards").otherwise("closed")
    return j.select("trace_id", "span_id", "parent_span_id", "start_ns", F.when(state == "closed", F.col("c.e")).alias("end_ns"), F.when(state == "closed", F.col("c.o")).alias("outcome"), state.alias("state"))


def recover(spans: DataFrame) -> DataFrame:
    """Open spans in the order in which they can be closed as interrupted: leaves first. ``step`` is the
    length of the longest chain of open spans below, from the depth of the open forest."""
    o = spans.filter("state = 'open'")
    up = resolve(o, "trace_id", "span_id", "parent_span_id", with_paths=True).filter("kind in ('rooted', 'detached')")
    deep = up.select("trace_id", F.posexplode("path").alias("at", "span_id"), "depth").groupBy("trace_id", "span_id").agg(F.max(F.col("depth") - F.col("at")).cast("int").alias("step"))
    return o.join(deep, ["trace_id", "span_id"]).withColumn("outcome", F.lit("interrupted"))


def append_once(ledger: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, refused): rows with a new key; rows whose key is there with other content.
    What is there already is no row of either."""
    cols = [c for c in ledger.columns if c != key]
    digest = F.sha2(F.to_json(F.struct(*cols)), 256)
    l, n = ledger.select(key, digest.alias("d0")), new.distinct().withColumn("d1", digest)
    return n.join(l, key, "left_anti").drop("d1"), n.join(l, key).filter("d0 <> d1").select(*new.columns)


def boot_groups(df: DataFrame, key: str, boot: str, start: str, tolerance: int = 5) -> DataFrame:
    """Adds ``boot_group``: equal boot ids, or boot seconds within the tolerance of a group's first,
    belong together; the first group in time order takes a row. A fold over the distinct boots of a
    key, which are few, not over its rows."""
    sec = F.regexp_extract(boot, r"sec = (\d+)", 1).try_cast("long")
    b = df.groupBy(key, boot).agg(F.min(start).alias("f"), F.first(sec).alias("s"))

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        groups: list[tuple[str, float | None]] = []
        got = []
        for name, s in p.sort_values(["f", boot])[[boot, "s"]].itertuples(index=False):
            known = s is not None and s == s
            at = next((i for i, (n, t) in enumerate(groups) if n == name or known and t is not None and abs(t - s) <= tolerance), None)
            if at is None:
                groups.append((name, float(s) if known else None))
                at = len(groups) - 1
            got.append(at)
        return p.sort_values(["f", boot]).assign(boot_group=got)[[key, boot, "boot_group"]]

    kinds = dict(df.dtypes)
    return df.join(b.groupBy(key).applyInPandas(fold, f"`{key}` {kinds[key]}, `{boot}` string, boot_group int"), [key, boot], "left")


def transcribe(pages: DataFrame, reader, columns: list[str], schema: str) -> DataFrame:
    """Runs an engine outside Spark (a program, a model, an OCR) over pages: ``reader`` takes a row as a
    dict and returns one, once per row, engines started once per task. A failure becomes a row with
    ``error`` and never ends the batch."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema + ", error string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = reader()
        for b in batches:
            out = []
            for r in b.to_pylist():
                try:
                    got = {**engine(r), "error": None}
                except Exception as e:  # noqa: BLE001
                    got = {"error": f"{type(e).__name__}: {e}"}
                out.append({n: got.get(n, r.get(n)) for n in kinds.names})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return pages.select(*columns).mapInArrow(run, schema + ", error string")


def blank_defaults(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Null and blank values to defaults."""
    for c, v in columns.items():
        df = df.withColumn(c, F.when(is_blank(c), v).otherwise(F.col(c)))
    return df


def precedence(*layers: Column) -> Column:
    """The first layer that says anything: command line over configuration over default."""
    return F.coalesce(*layers)
