"""One consistent form for text that reads the same but holds other characters.

Each token is given the set of scripts in which it could be spelled: a letter has its own script
and those in which another letter looks like it; the sets are intersected over the token. An empty
intersection of own scripts with a non-empty one of resolved scripts is a mixed spelling, and the
letters are rewritten into the script that most of the token's letters already have. A token wholly
of look-alikes on a page of another script is a whole-script confusable, unless it stands in a phrase
of its script or is a word of it elsewhere in the corpus. Full-width and joined
forms, separate accents, invisible characters and odd spaces are normalised besides, and only
these: superscripts, signs and rightly used other scripts stay.
"""

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("width", "accent", "invisible", "space", "lookalike")

# Letters that look alike, by script, in the order Latin | Cyrillic | Greek | Armenian.
# A dot stands for no look-alike there.
ALIKE = """
a а α . | c с ϲ . | d ԁ . . | e е . . | g . . ց | h һ . հ | i і ι . | j ј ϳ . | k к κ . | l ӏ . . | n п η ո | o о ο օ | p р ρ . | q ԛ . զ | r г . . | s ѕ . . | t т τ . | u и υ ս | v ѵ ν . | w ԝ ω . | x х χ . | y у γ .
A А Α . | B В Β . | C С Ϲ . | E Е Ε . | H Н Η . | I І Ι . | J Ј Ϳ . | K К Κ . | M М Μ . | N . Ν . | O О Ο Օ | P Р Ρ . | Q Ԛ . . | S Ѕ . Տ | T Т Τ . | U . . Ս | V Ѵ . . | W Ԝ . . | X Х Χ . | Y Ү Υ . | Z . Ζ .
"""
#: Pairs that resemble each other only in part: good for a rewrite once a word is known to be mixed, no sign by themselves.
WEAK = set("кκпηгрτтиυωγχηαικτ") - set("р")
#: Letters that by themselves pass for no other script's: the weak pairs, and signs of formulas.
SIGNS = WEAK | set("νρ")
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian")
#: Further scripts with letters that look Latin; which these are is taken from Unicode's table of confusables.
FURTHER = ("Cherokee", "Lisu", "Coptic", "Deseret")
_ROWS = [r.split() for line in ALIKE.strip().splitlines() for r in line.split("|")]
#: letter -> {script: spelling there}
FORMS: dict[str, dict[str, str]] = {}
for _r in _ROWS:
    _by = {s: c for s, c in zip(SCRIPTS, _r) if c != "."}
    for _c in _by.values():
        FORMS[_c] = _by

_MARK = "̀-ͯ᪰-᫿᷀-᷿︠-︯"
_INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯﻿\U000e0000-\U000e007f"
_SPACES = "   -   　"
_WIDTH = "！-～｡-ￜ￠-￮ﬀ-ﬆﬓ-ﬗĲĳǄ-ǌǱ-ǳ"
WIDTH, MARK, INVISIBLE, SPACES = (regex.compile(f"[{x}]") for x in (_WIDTH, _MARK, _INVISIBLE, _SPACES))
_JOINED = regex.compile(rf"[{_INVISIBLE}]+")
#: Scripts and signs in which joiners belong to the spelling.
_JOINING = regex.compile(r"[\p{Arabic}\p{Syriac}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Hebrew}\p{Thai}\p{Myanmar}\p{Extended_Pictographic}️\U0001f3fb-\U0001f3ff]")
_COMPOSED = regex.compile(rf"[^\W\d_][{_MARK}]+")
_WORD = regex.compile(rf"[^\W\d_](?:[{_MARK}{_INVISIBLE}]*[^\W\d_])+")
_TOKEN = regex.compile(rf"[^\W\d_](?:[{_MARK}]*[^\W\d_])*[{_MARK}]*")
_FOREIGN = regex.compile("[" + "".join(rf"\p{{{x}}}" for x in (*SCRIPTS[1:], *FURTHER)) + "]")
_LATIN = regex.compile(r"\p{Latin}")
_RARE = regex.compile("[" + "".join(rf"\p{{{x}}}" for x in FURTHER) + "]")
ALL = (*SCRIPTS, *FURTHER)
_SCRIPT = {s: regex.compile(rf"\p{{{s}}}") for s in ALL}
_LETTERS = {s: regex.compile(rf"\p{{{s}}}+") for s in ALL}


def confusables(spark) -> tuple[tuple[str, str, str], ...]:
    """(letter, Latin letter, script) of the further scripts, by the table of Unicode confusables that comes
    with the library for Unicode in Spark's own class path. Asked once a session, in one call, on the driver.

    An error where the library is missing or its answer is not whole: with fewer letters, mixed words would
    pass for rightly spelled ones."""
    if not hasattr(spark, "_folioflux_confusables"):
        latin = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
        own = [(chr(c), x) for c in (*range(0x2C80, 0x2D00), *range(0x13A0, 0x1400), *range(0xA4D0, 0xA500), *range(0xAB70, 0xABC0), *range(0x10400, 0x10450)) for x in FURTHER if _SCRIPT[x].match(chr(c)) and chr(c).isalpha()]
        try:
            builder = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder()
        except TypeError as e:  # no such class
            raise RuntimeError(f"look-alike letters of {', '.join(FURTHER)} need com.ibm.icu.text.SpoofChecker (icu4j) in Spark's class path") from e
        looks = builder.build().getSkeleton("\n".join([*latin, *(c for c, _ in own)])).split("\n")
        if len(looks) != len(latin) + len(own):
            raise RuntimeError(f"the table of confusables answered {len(looks)} of {len(latin) + len(own)} letters")
        of: dict[str, list[str]] = {}
        for c, look in zip(latin, looks):
            of.setdefault(look, []).append(c)
        found = [(c, of[look], x) for (c, x), look in zip(own, looks[len(latin) :]) if look in of]
        if lost := [x for x in FURTHER if all(s != x for *_, s in found)]:
            raise RuntimeError(f"the table of confusables holds no look-alike letters of {', '.join(lost)}")
        # I and l look alike: the letter's case decides, capitals for letters without case
        spark._folioflux_confusables = tuple((c, ls[-1] if c.islower() else ls[0], x) for c, ls, x in found)
    return spark._folioflux_confusables


_KNOWN: set[str] = set()


def extend(letters: tuple[tuple[str, str, str], ...]) -> None:
    """Makes letters of further scripts known in this process, once."""
    new = [x for x in letters if x[0] not in _KNOWN]
    for c, latin, script in new:
        row = FORMS.setdefault(latin, {"Latin": latin})
        row.setdefault(script, c)
        FORMS[c] = {**row, script: c}
        _KNOWN.add(c)
    if new:
        for f in (_script, resolve, _spelled_in):
            f.cache_clear()


@lru_cache(maxsize=4096)
def _script(c: str) -> str:
    return next((s for s, r in _SCRIPT.items() if r.match(c)), "")  # of all scripts


@lru_cache(maxsize=200_000)
def resolve(word: str) -> tuple[str, bool]:
    """(consistent spelling, whether the word mixes scripts by look-alike letters).

    The resolved script set of a letter is its own script and those of its look-alikes; letters of
    no listed script fit anywhere. Among the scripts in the intersection the one with most own
    letters is taken, Latin on a tie. With none in the intersection the word is left alone: it
    mixes on purpose (λmax, Δt)."""
    letters = [c for c in word if c.isalpha()]
    own = [_script(c) for c in letters]
    present = {s for s in own if s}
    if len(present) < 2:
        return word, False
    fits = set(ALL)
    for c, s in zip(letters, own):
        if s:
            base = c if c in FORMS else unicodedata.normalize("NFD", c)[0]
            fits &= {s, *FORMS.get(base if s != "Latin" else c, {})}
    fits &= present
    if not fits:
        return word, False
    best = max(fits, key=lambda s: (own.count(s), s == "Latin"))
    # The letters to be rewritten must look alike fully; ΔT and other short marks are no words.
    swapped = [c for c, s in zip(letters, own) if s and s != best]
    if not any(c in FORMS and c not in WEAK for c in swapped) or best != "Latin" and (len(letters) < 3 or 2 * len(swapped) > len(letters)):
        return word, False
    return "".join(FORMS[c].get(best, c) if c in FORMS and _script(c) != best else c for c in word), True


def _visible(text: str) -> tuple[str, bool]:
    """Text without invisible characters, but for those between or beside signs that need them."""
    out, last, cut = [], 0, False
    for m in _JOINED.finditer(text):
        a, b = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if a and _JOINING.match(a) or b and _JOINING.match(b):
            continue
        out.append(text[last : m.start()])
        last, cut = m.end(), True
    return ("".join(out) + text[last:], True) if cut else (text, False)


def normalise(text: str) -> tuple[str, list[str]]:
    """(the one form, kinds of other forms found)."""
    kinds = []
    if WIDTH.search(text):
        kinds.append("width")
        text = WIDTH.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    if INVISIBLE.search(text):
        text, found = _visible(text)
        if found:
            kinds.append("invisible")
    if MARK.search(text):
        composed = _COMPOSED.sub(lambda m: unicodedata.normalize("NFC", m.group()), text)
        if composed != text:
            kinds.append("accent")
            text = composed
    if SPACES.search(text):
        kinds.append("space")
        text = SPACES.sub(" ", text)
    if _FOREIGN.search(text) and _LATIN.search(text):
        mixed = False

        def one(m) -> str:
            nonlocal mixed
            w = m.group()
            if w.isascii():
                return w
            spelled, odd = resolve(w)
            mixed = mixed or odd
            return spelled

        text = _WORD.sub(one, text)
        if mixed:
            kinds.append("lookalike")
    return text, [k for k in KINDS if k in kinds]


def _passes(word: str, script: str) -> bool:
    """Every letter looks fully like one of ``script``."""
    return all(c not in SIGNS and script in FORMS.get(c, ()) for c in word)


@lru_cache(maxsize=200_000)
def _spelled_in(word: str) -> tuple[str, bool]:
    """(the one listed script of the word, else ""; whether it could pass for another's in some case)."""
    scripts = {_script(c) for c in word}
    s = scripts.pop() if len(scripts) == 1 else ""
    return s, bool(s) and any(_passes(v, t) for v in (word, word.lower(), word.upper(), word.title()) for t in ALL if t != s)


def whole_script(text: str) -> tuple[list[tuple[int, int, str, str]], set[str]]:
    """(tokens of a normalised page that pass for words of its main script, as start, end, spelling there
    and own script; words with other than Latin letters that could pass so, rightly used here).

    A run of tokens of one script with one among them that does not pass is a phrase of that script."""
    if not _FOREIGN.search(text):
        return [], set()
    here = ALL if _RARE.search(text) else SCRIPTS
    n = {s: sum(map(len, _LETTERS[s].findall(text))) for s in here}
    main = max(here, key=n.get)
    runs: list[tuple[str, list]] = []
    for m in _TOKEN.finditer(text):
        w = m.group()
        s = "Latin" if w.isascii() else _spelled_in(w)[0]
        if s == main == "Latin":
            if runs and runs[-1][0]:
                runs.append(("", []))
            continue
        if not runs or runs[-1][0] != s:
            runs.append((s, []))
        runs[-1][1].append(m)
    odd, used = [], set()
    for s, ms in runs:
        if s and s != main and all(_passes(m.group(), main) for m in ms):
            odd += [(m.start(), m.end(), "".join(FORMS[c][main] for c in m.group()), s) for m in ms]
        elif s and s != "Latin":
            used |= {w.lower() for w in {m.group() for m in ms} if len(w) > 1 and _spelled_in(w)[1]}
    return odd, used


def known_words(df: DataFrame, text: str) -> frozenset[str]:
    """The words asked about by :func:`settle` that the corpus uses rightly; only these come to the driver."""

    more = confusables(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extend(more)
        for b in batches:
            asked, used = set(), set()
            for t in b.column(0).to_pylist():
                form = normalise(t)[0]
                odd, here = whole_script(form)
                used |= here
                asked |= {(w if s == "Latin" else form[i:j]).lower() for i, j, w, s in odd if j - i > 1}
            yield pa.RecordBatch.from_arrays([pa.array([*asked, *used], pa.string()), pa.array([True] * len(asked) + [False] * len(used), pa.bool_())], ["word", "asked"])

    got = df.select(text).filter(F.col(text).rlike("[" + "".join(rf"\p{{Is{x}}}" for x in ALL[1:]) + "]")).mapInArrow(run, "word string, asked boolean")
    return frozenset(r.word for r in got.groupBy("word").agg(F.bool_or("asked").alias("a"), F.bool_and("asked").alias("b")).filter("a and not b").collect())


def settle(form: str, known: frozenset[str]) -> str:
    """A normalised page with its whole-script confusables spelled in its main script.

    A word of its own script (``known``) stays. Single Latin letters are signs in every script, and other
    Latin tokens stay unless the corpus knows their spelling in the main script as a word."""
    odd, _ = whole_script(form)
    out, last = [], 0
    for i, j, w, s in odd:
        if (j - i > 1 and w.lower() in known) if s == "Latin" else (j - i == 1 or form[i:j].lower() not in known):
            out += [form[last:i], w]
            last = j
    return "".join(out) + form[last:] if out else form


def consistent_form(df: DataFrame, text: str, form: str = "form", kinds: str = "kinds") -> DataFrame:
    """Adds ``form`` and ``kinds`` (array of the kinds of :data:`KINDS` that occurred, in that order).

    Null text gives null and no kinds; empty text stays. Columns of those names are replaced.
    Texts of plain ASCII are their own form and never leave the JVM. Each row is a page: one job over the
    texts that hold other alphabets looks up the words of :func:`settle` first."""
    df = df.drop(form, kinds)
    plain = ~F.coalesce(F.col(text).rlike(r"[^\x00-\x7f]"), F.lit(False))

    known = known_words(df, text)
    more = confusables(df.sparkSession)

    @F.pandas_udf("struct<form string, kinds array<string>>")
    def run(s: pd.Series) -> pd.DataFrame:
        extend(more)
        got = [normalise(x) for x in s]
        return pd.DataFrame({"form": [settle(g[0], known) for g in got], "kinds": [g[1] for g in got]})

    other = df.filter(~plain).withColumn("__n", run(F.col(text))).withColumn(form, F.col("__n.form")).withColumn(kinds, F.col("__n.kinds")).drop("__n")
    return df.filter(plain).withColumn(form, F.col(text)).withColumn(kinds, F.array().cast("array<string>")).unionByName(other)


def faults(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys..., kind): the kinds of other forms in each text, found by :func:`normalise`; one row
    per kind and text. Only the keys and kinds come back from Python."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes) + ", kind string"

    more = confusables(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extend(more)
        for b in batches:
            rows, found = [], []
            for i, t in enumerate(b.column(len(keys)).to_pylist()):
                for k in normalise(t)[1]:
                    rows.append(i)
                    found.append(k)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(at) for i in range(len(keys))], pa.array(found, pa.string())], [*keys, "kind"])

    return df.select(*keys, text).filter(F.col(text).rlike(r"[^\x00-\x7f]")).mapInArrow(run, schema)
