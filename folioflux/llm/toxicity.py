"""Scores texts for abusive, hateful and sexual language.

A word is compared by a gapped subsequence string kernel: common subsequences of up to three
characters, each gap discounted, so cr*tin, c-r-e-t-i-n and crettin stay near cretin. Nyström
landmarks (words of the labelled sentences) turn the kernel into features; a sentence is the sum of
its words' features over the root of their number (the sum kernel of its words), and a linear
support vector machine per kind, trained on labelled sentences, gives its margin. The margin is a
sum over words, so each distinct word meets the landmarks once and every further occurrence is a
look-up. A text's score is that of its worst sentence; all sentences are read, comments included.

Labels are given for documents, not for sentences. As in multiple-instance learning, the sentence
of a flagged document that is most like other flagged ones is taken for the labelled one, chosen
anew after each training; a flagged document without such a sentence (a wrong label) gives none.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.toxicity_seeds import SEEDS

KINDS = ("abuse", "hate", "sexual")
#: Bounds of the labelled sample: documents per kind, and unflagged documents.
FLAGGED, UNFLAGGED = 900, 1500
LANDMARKS = 256
DECAY, ORDER = 0.6, 3

_SOFT = re.compile(r"\\-|(?<=[^\W\d_])\\(?:text[a-z]+|emph|mbox|underline)\s*\{([^{}]*)\}|\\(?:text[a-z]+|emph|mbox|underline)\s*\{([^{}]*)\}(?=[^\W\d_])")
_SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:[ .*_-][^\W_](?![^\W_])){3,}")
_MACRO = re.compile(r"\\[a-zA-Z]+\*?")
_TOKENS = re.compile(r"[^\W_]+(?:[@$*]+[^\W_]+)*|[.!?;](?=[\s}]|$)|\n")
_LEET = str.maketrans("@$0134!", "asoieai")
_LEET_SIGN = re.compile(r"[@$*0134]")
_REPEAT = re.compile(r"(.)\1{2,}")
PIECE = 24


def _spelled(m: re.Match) -> str:
    g = re.sub(r"[ .*_-]", "", m.group())
    return g if g.isalpha() else m.group()


def tokens(text: str) -> list[str]:
    """Raw words and sentence ends ("" for those) in order."""
    if "\\" in text:
        text = _MACRO.sub(" ", _SOFT.sub(lambda m: m.group(1) or m.group(2) or "", text))
    text = _SPELLED.sub(_spelled, text)
    return _TOKENS.findall(text)


def word(raw: str) -> str:
    """The form of a word that is compared: lower case, digits and signs in place of letters taken
    back, letters repeated for show once. Numbers and ends of sentences give ""."""
    if not any(c.isalpha() for c in raw):
        return ""
    w = raw.lower()
    if _LEET_SIGN.search(w):
        w = w.translate(_LEET)
    return _REPEAT.sub(r"\1", w)


def pieces(w: str) -> list[str]:
    """Whole words; very long ones in pieces, so none costs more than its length."""
    return [w[i : i + PIECE] for i in range(0, len(w), PIECE)] if len(w) > PIECE else [w]


def sentences(text: str) -> list[list[str]]:
    out, now = [], []
    for t in tokens(text):
        w = word(t)
        if w:
            now.append(w)
        elif t in ".!?;\n" and now:
            out.append(now)
            now = []
    return [*out, now] if now else out


def _codes(words: list[str]) -> np.ndarray:
    n = max(map(len, words))
    out = np.zeros((len(words), n), dtype=np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = [ord(c) for c in w]
    return out


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gapped subsequence kernels of orders 1 to 3, summed, of rows of ``a`` and ``b`` that broadcast
    against each other; codes of 0 are padding."""
    shape = np.broadcast_shapes(a.shape[:-1], b.shape[:-1])
    n, m, lam = a.shape[-1], b.shape[-1], np.float32(DECAY)
    prime = [np.zeros((m + 1, *shape), dtype=np.float32) for _ in range(ORDER)]
    prime[0][:] = 1
    total = np.zeros(shape, dtype=np.float32)
    for i in range(n):
        x = a[..., i]
        hit = [((x == b[..., j]) & (x != 0)).astype(np.float32) * (lam * lam) for j in range(m)]
        fresh = [None] * ORDER
        for p in range(ORDER):
            tail = np.zeros(shape, dtype=np.float32)
            new = np.empty_like(prime[0]) if p + 1 < ORDER else None
            if new is not None:
                new[0] = 0
            for j in range(m):
                add = hit[j] * prime[p][j]
                total += add
                if new is not None:
                    tail = tail * lam + add
                    new[j + 1] = lam * prime[p + 1][j + 1] + tail
            if new is not None:
                fresh[p + 1] = new
        for p in range(1, ORDER):
            prime[p] = fresh[p]
    return total


class Words:
    """Nyström features of words; each distinct word is computed once."""

    def __init__(self, landmarks: list[str]):
        self.codes = _codes(landmarks)
        self.own = np.sqrt(_kernel(self.codes, self.codes))
        k = self.similarity(landmarks).astype(np.float64)
        value, vector = np.linalg.eigh(k)
        self.map = vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6])

    def similarity(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.codes)), dtype=np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for k in range(0, len(order), 64):
            at = order[k : k + 64]
            c = _codes([words[i] for i in at])
            out[at] = _kernel(c[:, None, :], self.codes[None]) / np.sqrt(_kernel(c, c))[:, None] / self.own
        return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Linear support vector machine with squared hinge loss by Newton steps; the last weight is the
    intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    reg = ridge * np.eye(x.shape[1])
    reg[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(30):
        on = y * (x @ w) < 1
        xa = x[on] * weight[on, None]
        new = np.linalg.solve(reg + xa.T @ x[on], xa.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


class Model:
    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: np.ndarray):
        self.landmarks, self.weights, self.bias = landmarks, weights, bias


def _odds(flagged: list[list[list[str]]], rest: list[list[list[str]]]) -> dict[str, float]:
    """How much more often a word occurs in flagged documents, as a logarithm; words of so few
    flagged documents that chance may have put them there have none."""
    a, b = Counter(), Counter()
    for d in flagged:
        a.update({w for s in d for w in s})
    for d in rest:
        b.update({w for s in d for w in s})
    n, m = len(flagged) + 1, len(rest) + 1
    return {w: float(np.log((c - 0.5) / n / ((b[w] + 0.5) / m))) for w, c in a.items() if c >= max(2, 0.006 * n) and c / n > 3 * (b[w] + 0.5) / m}


#: Sentences of unflagged documents trained on besides those that look most like the flagged ones, and how
#: many of these are looked at a round; part of the bounded sample.
BASE, NEAREST = 3_000, 800
#: Margin from which a sentence counts to a second kind.
SECOND = 0.5
#: Added to the number of words of a sentence, so that one odd word is not a sentence.
SHORT = 3


def train(docs: list[tuple[str, list[str]]], rounds: int = 5) -> Model:
    """docs: (text, kinds its raters flagged by majority; none if not flagged)."""
    read = [(sentences(t), kinds) for t, kinds in docs]
    seeds = [(k, ws) for k, s in SEEDS for ws in sentences(s)]
    clean = [s for s, k in read if not k]
    flagged = {k: [s for s, ks in read if k in ks] for k in KINDS}
    odds = {k: _odds(flagged[k], clean) for k in KINDS}
    # Landmarks: the words that tell most about each kind, then the words of the seeds, then common ones.
    lead = [sorted(((v, w) for w, v in odds[k].items()), reverse=True)[:40] for k in KINDS]
    seed_words = Counter(w for _, ws in seeds for w in ws)
    usual = Counter(w for s in clean for ws in s for w in ws)
    marks = dict.fromkeys(p for group in ([w for xs in lead for _, w in xs], [w for w, _ in seed_words.most_common()], [w for w, _ in usual.most_common(LANDMARKS)]) for w in group for p in pieces(w))
    landmarks = list(marks)[:LANDMARKS]
    ws = Words(landmarks)

    # All distinct sentences and their features, by number.
    number: dict[tuple, int] = {}
    at = lambda s: number.setdefault(tuple(s), len(number))
    seed_at = [(k, at(s)) for k, s in seeds]
    clean_docs = Counter(i for d in clean for i in {at(s) for s in d})
    flagged_at = {k: [sorted({at(s) for s in d}) for d in flagged[k]] for k in KINDS}
    vocab = {w: i for i, w in enumerate(dict.fromkeys(w for s in number for w in s))}
    parts = list(dict.fromkeys(p for w in vocab for p in pieces(w)))
    row = dict(zip(parts, ws.similarity(parts) @ ws.map)) if parts else {}
    f = np.array([sum(row[p] for p in pieces(w)) for w in vocab], dtype=np.float32)
    keys = list(number)
    phi = np.empty((len(keys), ws.map.shape[1]), dtype=np.float32)
    for k in range(0, len(keys), 1000):
        some = keys[k : k + 1000]
        ids = np.array([vocab[w] for s in some for w in s])
        size = np.array([len(s) for s in some])
        phi[k : k + 1000] = np.add.reduceat(f[ids], np.append(0, np.cumsum(size)[:-1]), axis=0) / np.sqrt(size + SHORT)[:, None]

    rest = np.array(sorted(clean_docs), dtype=np.int64)
    base = np.random.default_rng(7).permutation(rest)[:BASE]
    weights, bias = np.zeros((len(KINDS), ws.map.shape[1])), np.zeros(len(KINDS))
    for c, kind in enumerate(KINDS):
        n, m = len(flagged_at[kind]) + 1, len(clean) + 1
        mine = Counter(i for d in flagged_at[kind] for i in d)
        # A sentence about as common in unflagged documents is not what was flagged.
        common = {i for i, k in clean_docs.items() if mine[i] / n <= 4 * k / m}
        told = {i: sum(odds[kind].get(w, 0.0) for w in set(keys[i])) / np.sqrt(len(keys[i])) for d in flagged_at[kind] for i in d}
        plus = np.array([i for k, i in seed_at if k == kind])
        minus = np.array([i for k, i in seed_at if k != kind])
        chosen: list[int] = []
        hard: set[int] = set()
        for r in range(rounds + 1):
            groups = [(plus, 1, 4.0 if len(chosen) < 40 else 1.0), (minus, -1, 4.0 if len(chosen) < 40 else 1.0), (np.array(chosen, dtype=np.int64), 1, 6.0), (base, -1, 1.0), (np.array(sorted(hard), dtype=np.int64), -1, np.array([3.0 * min(20, clean_docs[i]) for i in sorted(hard)]))]
            x = np.concatenate([phi[g] for g, _, _ in groups]).astype(np.float64)
            w = _svm(x, np.concatenate([np.full(len(g), float(y)) for g, y, _ in groups]), np.concatenate([np.broadcast_to(v, len(g)) for g, _, v in groups]))
            if r == rounds:
                break
            margin = phi @ w[:-1] + w[-1]
            chosen = []
            for d in flagged_at[kind]:
                d = [i for i in d if i not in common]
                if d:
                    # at first also by the words that flagged documents share
                    best = max(d, key=lambda i: (margin[i] + told[i] if r == 0 else margin[i], -i))
                    if told[best] > 0.5 and margin[best] > (-1.6 if r == 0 else -0.2) or margin[best] > 0.7:
                        chosen.append(best)
            near = set(chosen)
            top = rest[np.argsort(-margin[rest], kind="stable")[:NEAREST]]
            # an unflagged document may be wrongly unflagged: what looks just like the chosen stays out
            hard = {int(i) for i in (*top, *hard) if i in common or i not in near and (margin[i] < 0.8 or not told_like(keys[i], odds[kind]))}
        weights[c], bias[c] = w[:-1], w[-1]
    return Model(landmarks, weights @ ws.map.T, bias)


def told_like(s: tuple[str, ...], odds: dict[str, float]) -> bool:
    """Whether the words of a sentence are mostly those that flagged documents share."""
    return sum(w in odds for w in s) > 0.4 * len(s)


def of_kinds(margin: np.ndarray) -> np.ndarray:
    """Margins of sentences by kind: a sentence counts to the kind it is most like, and to another only if
    it is of that kind for sure, as kinds share words; else the other margin is 0 at most."""
    other = margin < margin.max(axis=1, keepdims=True)
    return np.where(other & (margin < SECOND), np.minimum(margin, 0), margin)


class Scorer:
    """Margins of sentences by per-word look-up."""

    def __init__(self, model: Model):
        self.model = model
        self.codes = Words.__new__(Words)
        self.codes.codes = _codes(model.landmarks)
        self.codes.own = np.sqrt(_kernel(self.codes.codes, self.codes.codes))
        self.clear()

    def clear(self) -> None:
        self.id: dict[str, int] = {}
        self.form: dict[str, int] = {}
        # row 0: end of a sentence, row 1: no word
        self.f = np.zeros((1024, len(KINDS) + 1), dtype=np.float32)
        self.used = 2

    def learn(self, raw: set[str]) -> None:
        forms = {t: word(t) for t in raw}
        new = [w for w in dict.fromkeys(forms.values()) if w and w not in self.form]
        parts = list(dict.fromkeys(p for w in new for p in pieces(w)))
        value = dict(zip(parts, self.codes.similarity(parts) @ self.model.weights.T)) if parts else {}
        while self.used + len(new) > len(self.f):
            self.f = np.vstack([self.f, np.zeros_like(self.f)])
        for w in new:
            self.f[self.used, :-1] = sum(value[p] for p in pieces(w))
            self.f[self.used, -1] = 1
            self.form[w] = self.used
            self.used += 1
        for t, w in forms.items():
            self.id[t] = self.form[w] if w else (0 if t in ".!?;\n" else 1)

    def score(self, texts: list[str]) -> np.ndarray:
        """Margin of the worst sentence per text and kind; texts without a word get minus ten."""
        toks = [tokens(t or "") for t in texts]
        out = np.full((len(texts), len(KINDS)), -10.0, dtype=np.float32)
        for at in range(0, len(toks), 64):
            some = toks[at : at + 64]
            if len(self.id) > 2_000_000:  # bounds a worker's memory; nothing is lost, only computed again
                self.clear()
            new = set().union(*some) - self.id.keys()
            if new:
                self.learn(new)
            for k, t in enumerate(some):
                if not t:
                    continue
                ids = np.fromiter(map(self.id.__getitem__, t), dtype=np.int64, count=len(t))
                starts = np.append(0, np.flatnonzero(ids == 0))
                sums = np.add.reduceat(self.f[ids], starts, axis=0)
                sums = sums[sums[:, -1] > 0]
                if len(sums):
                    margin = sums[:, :-1] / np.sqrt(sums[:, -1:] + SHORT) + self.model.bias
                    out[at + k] = of_kinds(margin).max(axis=0)
        return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on the bounded labelled sample: per document the kinds flagged by at least half of its
    raters. The training runs in one task; the driver gets the landmarks and their weights alone.
    Labels of unknown documents and null ids are ignored; without labels the seeds decide."""
    one = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), *[F.count_if((F.col("flagged") == 1) & (F.col("kind") == k)).alias(k) for k in KINDS])
    kinds = F.filter(F.array(*[F.when(F.col(k) * 2 >= F.col("n"), F.lit(k)) for k in KINDS]), lambda x: x.isNotNull())
    one = one.select("doc_id", kinds.alias("kinds")).withColumn("h", F.xxhash64("doc_id"))
    parts = [one.filter(F.array_contains("kinds", k)).orderBy("h", "doc_id").limit(FLAGGED) for k in KINDS]
    parts.append(one.filter(F.size("kinds") == 0).orderBy("h", "doc_id").limit(UNFLAGGED))
    pick = parts[0]
    for p in parts[1:]:
        pick = pick.unionByName(p)
    pick = pick.select("doc_id", "kinds").distinct()
    rows = docs.select("doc_id", "text").filter("text is not null").join(pick, "doc_id").select("doc_id", "text", "kinds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((i, t, list(k)) for b in batches for i, t, k in zip(*(c.to_pylist() for c in b.columns)))
        m = train([(t, k) for _, t, k in got])
        yield pa.RecordBatch.from_arrays([pa.array([m.landmarks]), pa.array([m.weights.ravel().tolist()]), pa.array([m.bias.tolist()])], ["landmarks", "weights", "bias"])

    m = rows.repartition(1).mapInArrow(run, "landmarks array<string>, weights array<double>, bias array<double>").first()
    return Model(list(m.landmarks), np.array(m.weights).reshape(len(KINDS), -1), np.array(m.bias))


_SCORERS: dict[int, Scorer] = {}


def scores(docs: DataFrame, model: Model, doc_id: str, text: str, keep: list[str] = ()) -> DataFrame:
    """(doc_id, keep..., abuse, hate, sexual): the margin of each text's worst sentence; above 0 is
    found. Null and empty texts score minus ten. Every row is scored, repeated ones too."""
    sent = docs.sparkSession.sparkContext.broadcast((model.landmarks, model.weights, model.bias))  # LANDMARKS words
    key = hash((tuple(model.landmarks), model.weights.tobytes()))
    cols = [doc_id, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _SCORERS.get(key)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[key] = Scorer(Model(*sent.value))
        for b in batches:
            got = scorer.score(b.column(len(cols)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], *(pa.array(got[:, c].astype(np.float64)) for c in range(len(KINDS)))], [*cols, *KINDS])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*cols).dtypes) + "".join(f", {k} double" for k in KINDS)
    return docs.select(*cols, text).mapInArrow(run, schema)
