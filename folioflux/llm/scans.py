"""Repairs text recovered from scanned pages: running headers and footers, page numbers, words
broken over line and page ends, misrecognised letters.

One scan of the pages leaves three small things: the lines at page edges, the word breaks, and the
words of the corpus with their counts. Headers are edge lines that repeat within a document when
digits are masked and letters that scanners confuse are folded to one stroke form, and edge lines
within a few letters of such a header that share half of its words with it; page numbers are
edge lines of nothing but a number. The corpus vocabulary decides whether a broken word is joined,
keeps its hyphen or was no break, and which frequent word a rare one was read from by the usual
confusions. No page text is shuffled and no document is gathered in one task.
"""

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.session import materialise

#: Lines looked at on either edge of a page: a header and a page number may both stand there.
EDGE = 3
#: Share of a document's pages with an edge line for it to run through the document; alternating
#: headers stand on every second page, and the first page often has none.
RUNS = 0.25
#: Letters by which a header may differ from one that runs, beyond the usual confusions.
FUZZY = 2
#: Parts into which the rows of one line form are spread where many documents have it.
SALT = 16
#: A misread form is rarer than the word by at least this factor.
RARER = 5
#: Confusions in one word at most.
ERRORS = 2
#: Misread forms that are sent to every task; with more, words meet them in a join instead.
SENT = 300_000
#: Pieces of text between white space that a task remembers.
PIECES = 200_000

# What scanners make of letters (intended, read).
CONFUSED = """
e c  c e  t f  f t  i l  l i  o 0  s 5  l 1  i 1  m rn  d cl  b 6  u ii  h b  b h  g 9  h li  in m  w vv  cl d  li h  ri n  n ri  a o  o a
rn m  z 2  b 8  q 9  v y  y v  n h  h n  u n  n u  i j  e o  o e  ti fi
"""
_PAIRS = CONFUSED.split()
PAIRS = list(zip(_PAIRS[::2], _PAIRS[1::2]))
_BACK: dict[str, list[str]] = {}
for _a, _b in PAIRS:
    _BACK.setdefault(_b, []).append(_a)
#: Confused letters end in the same strokes, whatever the confusion.
_STROKES = {"m": "lll", "n": "ll", "u": "ll", "h": "ll", "b": "ll", "6": "ll", "8": "ll", "d": "cl", "w": "vv", "i": "l", "1": "l", "t": "l", "f": "l", "r": "l", "|": "l", "j": "l", "e": "c", "o": "c", "0": "c", "a": "c", "5": "s", "9": "g", "q": "g", "y": "v", "2": "z"}
# In two steps, as letters that become one letter each are exchanged much faster: those of the strokes ll stand as n till the end.
_LETTERS = {ord(a): "n" if b == "ll" else b for a, b in _STROKES.items() if b == "ll" or len(b) == 1}
_GROUPS = [(a, b) for a, b in _STROKES.items() if len(b) > 1 and (b != "ll" or a == "n")]

_HYPHENS = "-¬‐\xad"
_LINES = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_BROKEN = re.compile(r"([^\W\d_][^\W_]*(?:-[^\W_]+)*)[-¬‐­]\s*$")
_STARTS = re.compile(r"\s*([^\W_]+(?:-[^\W_]+)*)")
_NUMBER = re.compile(r"(?:[-–—\[(|.~*\s]*)(?:p(?:age|\.|g\.)?\s*)?([0-9lIOoSB|]{1,5}|[ivxlcdm]{1,8}|[IVXLCDM]{1,8})(?:\s*(?:of|/|von|de|sur)\s*[0-9lIOoSB|]{1,5})?(?:[-–—\])|~*\s]*)", re.IGNORECASE)
_ROMAN = re.compile(r"(?=.)m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_MASK = re.compile(r"(?<![^\W_])(?:[0-9lIOoSB|]*[0-9][0-9lIOoSB|]*|[lIO|])(?![^\W_])")
#: Found in every line that _MASK changes, and faster.
_MASKED = re.compile(r"[0-9|IOl](?:(?<!l)|(?<![^\W_]l)(?![^\W_]))")
_FIVE = re.compile("[a-z]{5}")
_PAGED = re.compile(r"[0-9lIOSB|]{1,5}\s{2,}\S.*|.*\S\s{2,}[0-9lIOSB|]{1,5}")
#: Words that follow a hyphen left hanging (pre- and post-war), unless the corpus knows the whole (detect-or).
HANGING = {"and", "or", "to", "und", "oder", "bis", "et", "ou", "y", "e", "o", "i", "lub", "и", "или", "και"}


def is_number(line: str) -> bool:
    """A line of nothing but a page number, in whatever form."""
    m = _NUMBER.fullmatch(line)
    if not m:
        return False
    n = m.group(1).lower()
    return not n.isalpha() or bool(re.fullmatch("[lIO]+", m.group(1))) or bool(_ROMAN.fullmatch(n) or _ROMAN.fullmatch(n.replace("l", "i")))


def key(line: str) -> str:
    """The line with its numbers masked and confusable letters folded; "" for what is no header."""
    if line[-1] in ".!?,;:-¬‐" and not line.endswith(("Vol.", "No.")):
        return ""
    s = " ".join((_MASK.sub(" ", line) if _MASKED.search(line) else line).lower().split())
    return strokes(s) if _FIVE.search(s) or sum(map(str.isalpha, s)) >= 5 else ""


def strokes(s: str) -> str:
    """The text with confusable letters folded."""
    s = s.translate(_LETTERS)
    for a, b in _GROUPS:
        s = s.replace(a, b)
    return s


def halves(form: str) -> tuple[str, str]:
    """The first and the second half of a line form by its words."""
    w = form.split()
    return " ".join(w[: -(-len(w) // 2)]), " ".join(w[len(w) // 2 :])


def is_paged(line: str) -> bool:
    """A number set off by wide space is the page's: such a header needs no second page to be known."""
    return "  " in line and bool(_PAGED.fullmatch(line)) and key(line) != ""


def lines(text: str) -> list[str]:
    return [y for x in text.splitlines() if (y := x.strip())]


def place(i: int, n: int) -> int:
    """Place of line i of n: counted from 0 at the top, from -1 upwards at the bottom, EDGE between;
    a line of a short page belongs to the upper edge."""
    return i if i < EDGE else (i - n if n - i <= EDGE else EDGE)


def scan_page(ls: list[str]) -> tuple[list[tuple[int, str]], list[tuple[int, str, str]], list[str]]:
    """(edge lines by place, breaks within the page by place of the line, the words in lower case that
    stand at the breaks) of a page of these lines."""
    n = len(ls)
    edges = [(place(i, n), ls[i]) for i in (range(n) if n <= 2 * EDGE else (*range(EDGE), *range(n - EDGE, n)))]
    breaks, off = [], []
    for i in [i for i, x in enumerate(ls) if x[-1] in _HYPHENS]:
        x, y = ls[i], ls[i + 1] if i + 1 < n else ""
        last = x.rfind(" ") + 1
        if y and (m := _BROKEN.search(x, last)) and (q := _STARTS.match(y)):
            breaks.append((place(i, n), m.group(1), q.group(1)))
        off += (_TOKEN.findall(x[last:].lower()) or _TOKEN.findall(x.lower()))[-1:]
        low = y.lower()
        # the only word of a line that is broken itself counts there
        if (q := _TOKEN.search(low)) and not (y[-1] in _HYPHENS and not _TOKEN.search(low, q.end())):
            off.append(q.group())
    return edges, breaks, off


def page_words(text: str, forms: dict | None, fine: set[str] | None = None) -> set[tuple[int, str]]:
    """(place of the line, word in lower case) of the words of a page, broken ones left out, of those in
    ``forms`` if given. ``fine`` keeps the pieces of text that hold no form from page to page."""
    odd: set[str] = set()
    if forms is not None:
        fine = set() if fine is None else fine
        for c in {c for c in text.split() if c not in fine}:
            (fine if forms.keys().isdisjoint(_TOKEN.findall(c.lower())) else odd).add(c)
        if len(fine) > PIECES:
            fine.clear()
        if not odd:
            return set()
    out = set()
    ls = lines(text)
    n = len(ls)
    for i, x in enumerate(ls):
        if forms is not None and not any(c in x for c in odd):
            continue
        w = _TOKEN.findall(x.lower())
        if x[-1] in _HYPHENS and w:
            w = w[:-1]
        if i and ls[i - 1][-1] in _HYPHENS:
            w = w[1:]
        out |= {(place(i, n), f) for f in w if forms is None or f in forms}
    return out


class Words:
    """Counts of the words of pages in lower case, broken words left out. Pieces between white space are
    counted first, so that each is taken apart once and not wherever it stands."""

    def __init__(self):
        self.pieces: Counter = Counter()
        self.off: Counter = Counter()
        self.n: Counter = Counter()

    def add(self, text: str, off: list[str]) -> None:
        """A page and the words at its breaks."""
        self.pieces.update(text.split())
        self.off.update(off)
        if len(self.pieces) > PIECES:
            self.fold()

    def fold(self) -> None:
        for c, k in self.pieces.items():
            for w in _TOKEN.findall(c.lower()):
                self.n[w] += k
        for w, k in self.off.items():
            self.n[w] -= k
        self.pieces.clear()
        self.off.clear()

    def take(self) -> dict[str, int]:
        self.fold()
        out = {w: k for w, k in self.n.items() if k}
        self.n.clear()
        return out


def variants(word: str, errors: int = ERRORS) -> dict[str, int]:
    """Words from which this one may have been read, with the number of confusions."""
    out, now = {}, {word: 0}
    for n in range(1, errors + 1):
        new = {}
        for w, at in now.items():
            for i in range(at, len(w)):
                for size in (1, 2):
                    for a in _BACK.get(w[i : i + size], ()) if i + size <= len(w) else ():
                        v = w[:i] + a + w[i + size :]
                        if v != word and v not in out and v not in new:
                            new[v] = i + len(a)  # further errors only to the right: every set of places once
        out |= dict.fromkeys(new, n)
        now = new
    return out


class Scan:
    """What one scan of pages (origin, doc_sha256, page_number, text) tells about them.

    Repeated pages count once; null and empty pages hold nothing; pages with a null document or
    number stand alone. Line forms and pages are told apart by two independent 64-bit hashes."""

    PAGE = ["origin", "doc_sha256", "page_number"]
    _EDGES = "array<struct<at:int,line:string,k:bigint,s:bigint,a:bigint,b:bigint>>"
    _BREAKS = "array<struct<at:int,left:string,right:string>>"

    def __init__(self, pages: DataFrame, scans: tuple[str, ...] = ("recovered_pages",)):
        """``scans``: origins whose pages are scans by their nature. A document of another origin comes
        from a scan if it has a header, a page number or a broken word; in others nothing is misread."""
        self.scans = scans
        self.pages = pages.select(*self.PAGE, "text").filter("text is not null and text <> ''")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = Words()

            def flush() -> pa.RecordBatch:
                w = words.take()
                return pa.RecordBatch.from_arrays([*(pa.nulls(len(w), t) for t in types[:7]), pa.array(list(w), s), pa.array(list(w.values()), i)], names)

            for b in batches:
                e_at, e_line, e_k, e_s, e_a, e_b, e_off = [], [], [], [], [], [], [0]
                b_at, b_left, b_right, b_off = [], [], [], [0]
                starts, plain = [], []
                for o, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                    edges, breaks, off = scan_page(lines(t))
                    words.add(t, off)
                    easy = not breaks
                    for at, x in edges:
                        # 0 stands for no header form, 1 for a page number
                        number = is_number(x)
                        f = "" if number else key(x)
                        a, c = halves(f) if f else ("", "")
                        e_at.append(at)
                        e_line.append(x)
                        e_k.append(_hash(f"{o}\0{d}\0{f}") if f else 0)
                        e_s.append(_hash(f) if f else int(number))
                        e_a.append(_hash(a) if len(a) > 5 else 0)
                        e_b.append(_hash(c) if len(c) > 5 else 0)
                        easy = easy and not number and x[-1] not in _HYPHENS and "  " not in x
                    e_off.append(len(e_at))
                    for at, x, y in breaks:
                        b_at.append(at)
                        b_left.append(x)
                        b_right.append(y)
                    b_off.append(len(b_at))
                    q = _STARTS.match(edges[0][1]) if edges else None
                    starts.append(q.group(1) if q else None)
                    plain.append(easy)
                n = len(starts)
                nest = lambda off, kind, *cols: pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind.value_type)], fields=list(kind.value_type)))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], nest(e_off, types[3], e_at, e_line, e_k, e_s, e_a, e_b), nest(b_off, types[4], b_at, b_left, b_right), pa.array(starts, s), pa.array(plain, pa.bool_()), pa.nulls(n, s), pa.nulls(n, i)], names)
                if len(words.n) > PIECES:
                    yield flush()
            yield flush()

        names = [*self.PAGE, "edges", "breaks", "start", "plain", "word", "n"]
        s, i = pa.string(), pa.int64()
        types = [s, s, i, pa.list_(pa.struct([("at", pa.int32()), ("line", s), ("k", i), ("s", i), ("a", i), ("b", i)])), pa.list_(pa.struct([("at", pa.int32()), ("left", s), ("right", s)])), s, pa.bool_(), s, i]
        self.found = materialise(self.pages.mapInArrow(run, f"origin string, doc_sha256 string, page_number long, edges {self._EDGES}, breaks {self._BREAKS}, start string, plain boolean, word string, n long"))
        self._words: DataFrame | None = None
        self._forms: DataFrame | None = None

    def words(self) -> DataFrame:
        """(word, n) of the corpus, broken words left out."""
        if self._words is None:
            self._words = materialise(self.found.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
        return self._words

    @property
    def _G(self):
        """The document of a page, by a hash independent of that of the page."""
        return F.xxhash64("doc_sha256", "origin")

    def running(self) -> DataFrame:
        """(k, g): the line forms that run through their document, and those that are nearly one of them."""
        p = self.found.filter("edges is not null")
        e = p.select(self._G.alias("g"), "page_number", F.explode("edges").alias("x")).filter("x.k <> 0")
        keys = materialise(e.select("g", "page_number", "x.k", "x.s", "x.a", "x.b").groupBy("k", "g").agg(F.countDistinct("page_number").alias("n"), *[F.min(c).alias(c) for c in "sab"]))
        sizes = p.select(self._G.alias("g"), "page_number").groupBy("g").agg(F.countDistinct("page_number").alias("pages"))
        # Forms of one document need no look at others; those of many are spread, a stamp may stand on every document.
        spread = keys.groupBy("s").agg(F.count("*").alias("docs"), F.count_if(F.col("n") > 1).alias("running")).filter("docs > 1 and running > 0")
        spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salted = keys.withColumn("salt", F.pmod(F.xxhash64("g"), F.lit(SALT)).cast("int"))
        several = salted.join(spread, ["s", "salt"]).select("k", "g", "n", "docs", "running", "a", "b")
        alone = keys.filter("n > 1").join(spread.select("s", "salt").filter("salt = 0"), "s", "left_anti").select("k", "g", "n", F.lit(1).cast("long").alias("docs"), F.lit(1).cast("long").alias("running"), "a", "b")
        j = several.unionByName(alone).join(sizes, "g")
        # A line form of many documents (a stamp, say) is a header where it stands alone, too; one at the
        # edges of many documents that runs through few is a common sentence.
        runs = (F.col("n") > 1) & (F.col("n") >= RUNS * F.col("pages"))
        stamp = (F.col("running") >= 3) & (F.col("running") * 4 >= F.col("docs"))
        usual = (F.col("docs") >= 3) & (F.col("running") * 2 <= F.col("docs")) & (F.col("n") * 2 <= F.col("pages"))
        sure = materialise(j.filter((runs | stamp) & ~usual).select("k", "g", "a", "b"))
        # Misread beyond the usual confusions: forms of the same document that share a half with a header.
        half = F.explode(F.array_distinct(F.array("a", "b"))).alias("h")
        starts = sure.select("g", half).filter("h <> 0").distinct()
        # Found by hashes first: the lines themselves are read for the headers and the few forms that share a half.
        share = keys.join(sure, ["k", "g"], "left_anti").select("k", "g", half).filter("h <> 0").join(starts, ["g", "h"], "left_semi").select("k", "g").distinct()
        both = materialise(sure.select("k", "g", F.lit(True).alias("is_head")).unionByName(share.select("k", "g", F.lit(False).alias("is_head"))))
        at = materialise(e.select("g", "x.k", "x.a", "x.b", "x.line").join(both, ["k", "g"]).select("k", "g", "is_head", "a", "b", "line").distinct())
        text = F.regexp_replace(F.lower("line"), "[0-9 ]+", "")
        heads = at.filter("is_head").select("g", "a", "b", text.alias("head")).distinct().select("g", half, "head").filter("h <> 0").distinct()
        rest = at.filter("not is_head").select("k", "g", half, text.alias("line")).filter("h <> 0")
        near = rest.join(heads, ["g", "h"]).filter(F.levenshtein("line", "head", FUZZY).between(0, FUZZY) & (F.length("head") >= 8 * FUZZY)).select("k", "g")
        return sure.select("k", "g").unionByName(near).distinct()

    def facts(self) -> DataFrame:
        """Per page, one row per fact: ``line`` (a header or page number), ``break`` (within the body),
        ``tail`` (the body ends in a broken word) and ``start`` (its first word, under the page before)."""
        pid = lambda n: F.xxhash64("origin", "doc_sha256", n)
        p = self.found.filter("edges is not null").select(self._G.alias("g"), pid(F.col("page_number")).alias("pid"), pid(F.col("page_number") - 1).alias("before"), *self.PAGE, "edges", "breaks", "start", "plain")
        at = p.select("g", "pid", F.explode("edges").alias("x")).filter("x.k <> 0").select("g", "pid", "x.k", "x.at")
        heads = at.join(self.running(), ["k", "g"]).groupBy("g", "pid").agg(F.collect_set("at").alias("heads"))  # at most 2 * EDGE per page
        names = ["g", "pid", *self.PAGE, "fact", "at", "a", "b"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, i = pa.string(), pa.int64()
            kinds = [i, i, s, s, i, s, pa.int32(), s, s]
            for b in batches:
                rows = []
                for g, pid_, before, o, d, n, at, ls, numbers, b_at, left, right, heads_ in zip(*(nested(c) if pa.types.is_list(c.type) else c.to_pylist() for c in b.columns)):
                    kind = kinds_of(at, ls, numbers, heads_)
                    rows += [(g, pid_, o, d, n, "line", i, x, kind[i]) for i, x in zip(at, ls) if kind[i]]
                    body = [(i, x) for i, x in zip(at, ls) if not kind[i]]
                    end = body[-1][0] if body else None
                    rows += [(g, pid_, o, d, n, "break", i, x, y) for i, x, y in zip(b_at, left, right) if i == EDGE or i != end and not kind.get(i)]
                    if body:
                        m = body[-1][1][-1] in _HYPHENS and _BROKEN.search(body[-1][1], body[-1][1].rfind(" ") + 1)
                        if m:
                            rows.append((g, pid_, o, d, n, "tail", end, m.group(1), None))
                        q = _STARTS.match(body[0][1])
                        if q and n is not None:
                            rows.append((g, before, None, None, None, "start", None, q.group(1), None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names)

        # A plain page (no number, break or wide space at its edges, no header) is all body: only its first word counts.
        number = F.transform("edges", lambda x: (x.s == 1) & (x.k == 0))
        p = p.select("g", "pid", "before", *self.PAGE, "edges.at", "edges.line", number.alias("number"), F.col("breaks.at").alias("b_at"), "breaks.left", "breaks.right", "start", "plain").join(heads, ["g", "pid"], "left")
        plain = F.col("plain") & F.col("heads").isNull()
        none = F.lit(None).cast("string")
        easy = p.filter(plain & F.col("start").isNotNull() & F.col("page_number").isNotNull()).select("g", F.col("before").alias("pid"), none.alias("origin"), none.alias("doc_sha256"), F.lit(None).cast("long").alias("page_number"), F.lit("start").alias("fact"), F.lit(None).cast("int").alias("at"), F.col("start").alias("a"), none.alias("b"))
        rest = p.filter(~plain).select("g", "pid", "before", *self.PAGE, "at", "line", "number", "b_at", "left", "right", "heads").mapInArrow(run, "g long, pid long, origin string, doc_sha256 string, page_number long, fact string, at int, a string, b string")
        return materialise(rest.unionByName(easy))

    def misread(self, extra: DataFrame | None = None) -> DataFrame:
        """(form, word): rare forms and the frequent word each was read from, fewest confusions
        first, then the more frequent word. ``extra`` (word, n) adds forms to look at."""
        known = self.words()
        forms = known if extra is None else known.unionByName(extra).groupBy("word").agg(F.max("n").alias("n"))
        right = known.filter(F.col("n") >= RARER).filter("length(word) >= 4 and word rlike '^[^0-9]+$'").select("word", F.col("n").alias("m"))
        most, words_ = right.agg(F.max("m"), F.count("*")).first()
        # No word is frequent enough for a form as frequent as this.
        forms = forms.filter(F.lit(RARER) * F.greatest(F.col("n"), F.lit(1)) <= F.lit(most or 0))
        # What a form may have been is looked up where it is formed, if the frequent words are few enough to be sent.
        sent = self.pages.sparkSession.sparkContext.broadcast({r.word for r in right.select("word").collect()} if words_ <= SENT else None)
        types = pa.schema([("form", pa.string()), ("n", pa.int64()), ("word", pa.string()), ("errors", pa.int32())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some = sent.value
            for b in batches:
                a, n, v, e = cols = [], [], [], []
                for w, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for x, c in variants(w).items():
                        if some is None or x in some:
                            a.append(w)
                            n.append(k)
                            v.append(x)
                            e.append(c)
                    if len(a) > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types.types)], schema=types)
                        a, n, v, e = cols = [], [], [], []
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types.types)], schema=types)

        v = forms.select("word", "n").filter("length(word) >= 3").mapInArrow(run, "form string, n long, word string, errors int")
        pairs = v.join(right, "word").filter(F.col("m") >= RARER * F.greatest(F.col("n"), F.lit(1)))
        best = F.max_by("word", F.struct(-F.col("errors"), F.col("m"), F.col("word")))
        return pairs.groupBy("form").agg(best.alias("word"))

    def breaks(self, facts: DataFrame) -> DataFrame:
        """(page, at, left, right, over) of words broken over a line end within the body, or from the end of
        a page's body to the start of the next page's."""
        inside = facts.filter("fact = 'break'").select(*self.PAGE, "at", F.col("a").alias("left"), F.col("b").alias("right"), F.lit(False).alias("over"))
        starts = facts.filter("fact = 'start'").select("g", "pid", F.col("a").alias("right"))
        over = facts.filter("fact = 'tail'").select("g", "pid", *self.PAGE, "at", F.col("a").alias("left")).join(starts, ["g", "pid"])
        return inside.unionByName(over.select(*self.PAGE, "at", "left", "right", F.lit(True).alias("over"))).distinct()

    def forms(self, breaks: DataFrame) -> DataFrame:
        """The misread forms among the words of the corpus and the joined broken words; kept."""
        if self._forms is None:
            j = breaks.select(F.lower(F.concat("left", "right")).alias("word"), F.lit(0).cast("long").alias("n")).distinct()
            self._forms = materialise(self.misread(j))
        return self._forms

    def joined(self, breaks: DataFrame) -> DataFrame:
        """Breaks with ``item``, the whole word in lower case, and ``wrong`` if it was misread, too. Left out are breaks whose whole word
        the corpus does not know before a word of HANGING (the hyphen hangs) or, over a page end, before a capital (what follows may be no body)."""
        b = breaks.withColumn("over", F.col("over") & (F.substr("right", F.lit(1), F.lit(1)) != F.lower(F.substr("right", F.lit(1), F.lit(1)))))
        b = b.withColumn("left", F.lower("left")).withColumn("right", F.lower("right"))
        pair = b.select("left", "right").distinct()
        whole = materialise(pair.select("left", "right", F.concat("left", "right").alias("j"), F.concat_ws("-", "left", "right").alias("h")))
        n = self.words()
        forms = self.forms(breaks)
        w = whole.join(n.select(F.col("word").alias("j"), F.col("n").alias("nj")), "j", "left").join(n.select(F.col("word").alias("h"), F.col("n").alias("nh")), "h", "left").join(forms.select(F.col("form").alias("j"), F.col("word").alias("fixed")), "j", "left").na.fill(0, ["nj", "nh"])
        item = F.when(F.col("nh") > F.col("nj"), F.col("h")).otherwise(F.coalesce("fixed", "j"))
        known = (F.col("nh") > 0) | (F.col("nj") > 0) | F.col("fixed").isNotNull()
        wrong = (item == F.col("fixed")) & (F.length(item) >= 4)
        return b.join(w.select("left", "right", item.alias("item"), F.coalesce(wrong, F.lit(False)).alias("wrong"), known.alias("known")), ["left", "right"]).filter(F.col("known") | ~(F.col("over") | F.col("right").isin(*HANGING))).drop("known")

    def _scanned(self, facts: DataFrame) -> DataFrame:
        """The pages of documents that come from a scan."""
        by_nature = F.coalesce(F.col("origin").isin(*self.scans), F.lit(False))
        some = facts.filter("fact <> 'start'").select("g").distinct()
        others = self.pages.filter(~by_nature).withColumn("g", self._G)
        if some.count() <= SENT:  # 8 bytes each
            some = F.broadcast(some)
        return self.pages.filter(by_nature).unionByName(others.join(some, "g", "left_semi").drop("g"))

    def misread_words(self, facts: DataFrame) -> DataFrame:
        """(page, item, form): words of the body read wrongly."""
        forms = self.forms(self.breaks(facts))
        off = facts.filter("fact = 'line'").select(*self.PAGE, "at")
        pages = self._scanned(facts)
        many = forms.count()
        schema = "origin string, doc_sha256 string, page_number long, at int, form string, item string"
        if many <= SENT:
            sent = self.pages.sparkSession.sparkContext.broadcast({r.form: r.word for r in forms.collect()})  # at most SENT rows

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                get = sent.value
                fine: set[str] = set()
                for b in batches:
                    rows = [(o, d, p, at, f, get[f]) for o, d, p, t in zip(*(c.to_pylist() for c in b.columns)) for at, f in page_words(t, get, fine)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], ["origin", "doc_sha256", "page_number", "at", "form", "item"])

            s = pa.string()
            kinds = [s, s, pa.int64(), pa.int32(), s, s]
            hits = pages.mapInArrow(run, schema)
        else:

            def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    rows = [(o, d, p, at, f) for o, d, p, t in zip(*(c.to_pylist() for c in b.columns)) for at, f in page_words(t, None)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()])] if rows else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string())], ["origin", "doc_sha256", "page_number", "at", "form"])

            hits = pages.mapInArrow(every, "origin string, doc_sha256 string, page_number long, at int, form string").join(forms.select("form", F.col("word").alias("item")), "form")
        return hits.join(off, [*self.PAGE, "at"], "left_anti").select(*self.PAGE, "form", "item").distinct()

    def repaired(self) -> DataFrame:
        """(origin, doc_sha256, page_number, text) of every page as continuous readable paragraphs.
        Here page texts are joined with what is to be done on them, by the unique page."""
        facts = self.facts()
        off = facts.filter("fact = 'line'").groupBy(*self.PAGE).agg(F.collect_set("at").alias("off"))
        breaks = materialise(self.breaks(facts))
        self.forms(breaks)
        joins = self.joined(breaks).groupBy(*self.PAGE).agg(F.collect_set(F.struct("at", "left", "right", "item")).alias("joins"))
        over = self.joined(breaks.filter("over")).select("origin", "doc_sha256", (F.col("page_number") + 1).alias("page_number"), F.col("right").alias("lead")).groupBy(*self.PAGE).agg(F.max("lead").alias("lead"))
        fixes = self.misread_words(facts).groupBy(*self.PAGE).agg(F.map_from_entries(F.collect_set(F.struct("form", "item"))).alias("fixes"))
        pages = self.pages.withColumn("h", F.xxhash64("text")).dropDuplicates([*self.PAGE, "h"]).drop("h")
        all_ = pages.join(off, self.PAGE, "left").join(joins, self.PAGE, "left").join(fixes, self.PAGE, "left").join(over, self.PAGE, "left")

        def run(text: pd.Series, off: pd.Series, joins: pd.Series, fixes: pd.Series, lead: pd.Series) -> pd.Series:
            got = []
            for t, o, j, f, x in zip(text, off, joins, fixes, lead):
                got.append(rebuild(t, [] if o is None else list(o), [] if j is None else [(q["at"], q["left"], q["right"], q["item"]) for q in j], {} if f is None else dict(f), x))
            return pd.Series(got)

        return all_.select(*self.PAGE, F.pandas_udf(run, "string")("text", "off", "joins", "fixes", "lead").alias("text"))

    def cases(self) -> DataFrame:
        """(origin, doc_sha256, page_number, kind, item) of all four kinds."""
        facts = self.facts()
        lines_ = facts.filter("fact = 'line'").select(*self.PAGE, F.col("b").alias("kind"), F.col("a").alias("item"))
        breaks = materialise(self.breaks(facts))
        self.forms(breaks)
        joined = self.joined(breaks)
        kinds = F.when(F.col("wrong"), F.array(F.lit("hyphen"), F.lit("misread"))).otherwise(F.array(F.lit("hyphen")))
        words_ = joined.select(*self.PAGE, F.explode(kinds).alias("kind"), "item")
        wrong = self.misread_words(facts).select(*self.PAGE, F.lit("misread").alias("kind"), "item")
        return lines_.unionByName(words_).unionByName(wrong).distinct()


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - 2**63


def nested(lists: pa.ListArray) -> list[list]:
    """The lists of a column, empty for null, much faster than by its own method."""
    at, flat = lists.offsets.to_pylist(), lists.values.to_pylist()
    return [flat[i:j] for i, j in zip(at, at[1:])]


def kinds_of(at: list[int], ls: list[str], numbers: list[bool], heads: list[int]) -> dict[int, str | None]:
    """What each edge line is: header, pageno or None for the body. Headers and numbers stand outside
    the body: only such lines lie between them and the edge of the page."""
    kind = {i: "pageno" if number else "header" if i in heads or is_paged(x) else None for i, x, number in zip(at, ls, numbers)}
    outside = set()
    for side in (at, at[::-1]):
        for i in side[:EDGE]:
            if not kind[i]:
                break
            outside.add(i)
    return {i: kind[i] if i in outside else None for i in at}


def rebuild(text: str, off: list[int], joins: list[tuple[int, str, str, str]], fixes: dict[str, str], lead: str | None) -> str:
    """The page as paragraphs: lines at the places ``off`` go, broken words are written whole where
    they start, misread words are written as meant, and ``lead``, the end of a word that began on the
    page before, goes."""
    whole = {(a, b.lower(), c.lower()): w for a, b, c, w in joins}
    ls = [x.strip() for x in _LINES.split(text)]
    full = [i for i, x in enumerate(ls) if x]
    n = len(full)
    where = {i: place(k, n) for k, i in enumerate(full)}
    out: list[list[str]] = [[]]
    cut = lead
    for i, x in enumerate(ls):
        if not x:
            out.append([])
            continue
        if where[i] in off:
            continue
        if cut and x.lower().startswith(cut.lower()):
            x = x[len(cut) :].lstrip()
        cut = None
        m = _BROKEN.search(x)
        if m:
            word = m.group(1)
            for (a, b, c), w in whole.items():
                if a == where[i] and b == word.lower():
                    x = x[: m.start(1)] + (w if word[0].islower() else w[0].upper() + w[1:])
                    cut = c
                    break
        if fixes:
            x = _TOKEN.sub(lambda t: _like(t.group(), fixes.get(t.group().lower())), x)
        if x:
            # a word went on over an empty line: the paragraph does, too
            if not out[-1] and len(out) > 1 and out[-2] and out[-2][-1].endswith("\0"):
                out.pop()
            out[-1].append(x + ("\0" if cut else ""))
    return "\n\n".join(" ".join(p).replace("\0", "") for p in out if p)


def _like(form: str, word: str | None) -> str:
    if word is None:
        return form
    return word.upper() if sum(c.isupper() for c in form) > 1 else word[0].upper() + word[1:] if form[0].isupper() else word
