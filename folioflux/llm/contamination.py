"""Finds documents that hold passages of evaluation items, fully or in part.

A passage is :data:`PASSAGE` words in a row of an item, one of which may be exchanged, or all of a
shorter item. Items and documents are cut into windows of that size. Each window gets a SimHash of
:data:`BITS` bits by sparse projection: a word votes, with its weight, on :data:`VOTES` bits only, so
exchanging one word touches at most ``2 * VOTES`` bits, and :data:`RADIUS` = ``2 * VOTES`` holds every
such window for certain, not by chance. Item fingerprints lie in several tables, one per block of bits
and with each bit of the block turned once: two fingerprints within the radius agree on at least one
entry, so the tables give every item window within it. A candidate is then decided by its exact
weighted-shingle similarity, and those similar enough by the order of their words.

The items are the stated query set: they go to every task in blocks of :data:`ITEM_CHARS`; documents
are read once per block, never shuffled and never grouped, so no source or copy is a hot key.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.operators.prefix import running_totals
from folioflux.session import materialise

PASSAGE = 16
#: Words of a passage that may be exchanged; all of a shorter item must be there.
EXCHANGED = 1
BITS, VOTES = 128, 4
RADIUS = 2 * VOTES * EXCHANGED
#: Blocks of a fingerprint. Within the radius one of them differs in at most ``RADIUS // BLOCKS`` bits, here 1.
BLOCKS = 5
#: Similarity of weighted words and word pairs at passage size. Weights lie between 1 and 2, so a
#: passage with one word exchanged keeps at least 28 of 31 shingles: 28 / (28 + 2 * 6) = 0.7.
SIMILAR = 0.7
#: Characters of items broadcast at once; a larger set takes more passes, not more memory.
ITEM_CHARS = 2_000_000
#: Windows fingerprinted, and pairs compared, at once: bounds memory, not the search.
WINDOWS, PAIRS = 1 << 14, 1 << 19
#: Words of documents looked at together.
CHUNK = 1 << 18

_ARG = r"(?:\s*\[[^\]]*\])*\s*\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
#: Markup whose argument is no part of the running text goes with it; of other commands only the name goes.
_MARKUP = re.compile(
    rf"\\(?:[a-zA-Z]*cite[a-zA-Z]*\*?|footnote|footnotemark|footnotetext|thanks|label|ref|eqref|pageref|index|input|include|includegraphics|bibliography|bibliographystyle|vspace|hspace){_ARG}"
    r"|\\(?:begin|end)\s*\{[^{}]*\}|\\-|\\[a-zA-Z]+\*?|['’‘`´]")
_WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words in lower case without markup, comment signs, citations and punctuation. Footnotes
    follow at the end, each after a mark that equals no word, so they neither break the running text
    nor go unsearched."""
    notes = []

    def one(m: re.Match) -> str:
        g = m.group()
        if len(g) == 1 or g == "\\-":
            return ""
        if g.startswith("\\footnote") and len(g) > 40:
            notes.append(g[g.index("{") + 1 : -1])
        return " "

    out = _WORDS.findall(_MARKUP.sub(one, text).lower())
    while notes:
        out.append("|")
        out += _WORDS.findall(_MARKUP.sub(one, notes.pop()).lower())
    return out


def _votes(vocab: list[str], weight: np.ndarray) -> np.ndarray:
    """A row per word: its weight, plus or minus, on the bits it votes on. Fixed by the word alone."""
    out = np.zeros((len(vocab) + 1, BITS), dtype=np.int16)  # the last row is of words no item has
    for k, x in enumerate(vocab):
        h = xxhash.xxh64_intdigest(x)
        for j in range(VOTES):
            out[k, (h >> (8 * j)) % BITS] = weight[k] * (1 if h >> (63 - j) & 1 else -1)
    return out


_TURN = np.array([xxhash.xxh64_intdigest(f"bit {i}") for i in range(BITS)], dtype=np.uint64)


class Table:
    """Item windows of one size by the blocks of their fingerprints; gives all within ``radius``."""

    def __init__(self, bits: np.ndarray, radius: int):
        self.radius, self.packed = radius, pack(bits)
        n = min(BLOCKS, radius + 1)
        if radius // n > 1:
            raise ValueError("a block is looked up with one bit turned at most")
        self.blocks, self.turns = [], radius // n
        for cut in np.array_split(np.arange(BITS), n):
            key = self.key(bits, cut)
            # each entry of the block itself, and with one of its bits turned
            turned = [key] + [np.where(bits[:, i], key - _TURN[i], key + _TURN[i]) for i in cut if self.turns]
            shift = np.uint64(64 - max(1, (len(bits) * len(turned)).bit_length()))
            slot = (np.concatenate(turned) >> shift).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            starts = np.searchsorted(slot[order], np.arange(2 ** (64 - int(shift)) + 1)).astype(np.int32)
            mask = np.zeros((1, BITS), dtype=bool)
            mask[0, cut] = True
            self.blocks.append((cut, pack(mask), shift, (order % len(bits)).astype(np.int32), starts))

    @staticmethod
    def key(bits: np.ndarray, cut: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bits), dtype=np.uint64)
        for i in cut:
            out += bits[:, i] * _TURN[i]
        return out

    def near(self, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of ``bits``, item window) of all pairs within the radius, in pieces; a pair that agrees on
        several blocks comes with the first."""
        packed, masks = pack(bits), []
        for cut, mask, shift, order, starts in self.blocks:
            slot = (self.key(bits, cut) >> shift).astype(np.int64)
            first, n = starts[slot].astype(np.int64), starts[slot + 1] - starts[slot]
            end = np.cumsum(n, dtype=np.int64)
            for lo in range(0, int(end[-1]) if len(end) else 0, PAIRS):  # a full slot is cut, too
                hi = min(lo + PAIRS, int(end[-1]))
                x = np.arange(lo, hi)
                q = np.searchsorted(end, x, side="right")
                r = order[first[q] + x - (end[q] - n[q])]
                apart = packed[q] ^ self.packed[r]
                ok = np.flatnonzero(np.bitwise_count(apart).sum(axis=1) <= self.radius)
                for m in masks:
                    ok = ok[np.bitwise_count(apart[ok] & m).sum(axis=1) > self.turns]
                if len(ok):
                    q, r = np.divmod(np.unique(q[ok] * len(self.packed) + r[ok]), len(self.packed))
                    yield q, r
            masks.append(mask)


def pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(np.uint64)


class Index:
    """Fingerprints of the windows of one block of items, and what verification needs."""

    def __init__(self, items: list[tuple[int, str]]):
        toks = [(i, w) for i, t in items if (w := words(t or ""))]
        df = Counter(x for _, w in toks for x in set(w))
        vocab = sorted(df)
        self.vocab = {x: k for k, x in enumerate(vocab)}
        n = len(toks)
        idf = np.log((n + 1) / np.array([df[x] for x in vocab] or [1]))
        #: whole numbers between 64 and 128, so window sums are exact in any order; unknown words count 64
        self.weight = np.append(np.round(64 * (1 + idf / max(1e-9, np.log(n + 1)))), 64).astype(np.int64)
        self.votes = _votes(vocab, self.weight)
        self.ids = [i for i, _ in toks]
        self.flat = np.fromiter((self.vocab[x] for _, w in toks for x in w), dtype=np.int64)
        ends = np.cumsum([len(w) for _, w in toks], dtype=np.int64)
        #: size -> (windows' places in ``flat``, their items, table)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, Table]] = {}
        for size in sorted({min(PASSAGE, len(w)) for _, w in toks}):
            mine = [k for k, (_, w) in enumerate(toks) if min(PASSAGE, len(w)) == size]
            at = np.concatenate([np.arange(ends[k] - len(toks[k][1]), ends[k] - size + 1) for k in mine])
            own = np.repeat(mine, [len(toks[k][1]) - size + 1 for k in mine])
            bits = np.concatenate([self.fingerprints(self.flat, at[k : k + WINDOWS], size) for k in range(0, len(at), WINDOWS)])
            self.tables[size] = at, own, Table(bits, RADIUS if size == PASSAGE else 0)

    def fingerprints(self, w: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """SimHash, as a row of bits, of the windows of ``size`` words of ``w`` that begin at ``at``."""
        total = np.zeros((len(at), BITS), dtype=np.int16)
        for j in range(size):
            total += self.votes[w[at + j]]
        return total > 0

    def _shingles(self, win: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and word pairs of each window as numbers, and their weights, those of repeated ones 0;
        shingles with an unknown word are -1 and equal nothing."""
        n = len(self.weight)
        a, b = win[:, :-1], win[:, 1:]
        pair = np.where((a < 0) | (b < 0), -1, n + a * n + b)
        s = np.hstack([win, pair])
        g = np.hstack([self.weight[win], (self.weight[a] + self.weight[b]) // 2])
        before = np.tri(s.shape[1], k=-1, dtype=bool)
        again = ((s[:, :, None] == s[:, None, :]) & before).any(axis=2) & (s >= 0)
        return s, np.where(again, 0, g)

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact weighted Jaccard similarity of words and word pairs, row by row; ``b`` of known words."""
        x, g = self._shingles(a)
        y, h = self._shingles(b)
        both = (g * (x[:, :, None] == y[:, None, :]).any(axis=2)).sum(axis=1)
        return both / (g.sum(axis=1) + h.sum(axis=1) - both)

    def passages(self, w: np.ndarray, at: np.ndarray, r: np.ndarray, size: int) -> np.ndarray:
        """Which pairs of a document's window and an item's are the passage: similar by weighted
        shingles, and then equal word by word but for what may be exchanged."""
        out = np.zeros(len(at), dtype=bool)
        for k in range(0, len(at), 1024):
            a, b = (x[y[k : k + 1024, None] + np.arange(size)] for x, y in ((w, at), (self.flat, self.tables[size][0][r])))
            ok = self.similar(a, b) >= SIMILAR
            ok[ok] = (a[ok] == b[ok]).sum(axis=1) >= size - (EXCHANGED if size == PASSAGE else 0)
            out[k : k + 1024] = ok
        return out

    def found(self, texts: list[str]) -> list[tuple[int, int]]:
        """(number of the text, item) of every text and item of which it holds a passage."""
        get = self.vocab.get
        out: set[tuple[int, int]] = set()
        parts: list[np.ndarray] = []
        owner: list[int] = []
        held = 0
        for k, t in enumerate(texts):
            toks = words(t)
            parts.append(np.fromiter(map(get, toks, repeat(-1)), dtype=np.int64, count=len(toks)))
            parts.append(np.full(PASSAGE, -1))  # no window reaches over two texts
            owner += (k, k)
            held += len(toks)
            if held >= CHUNK or k == len(texts) - 1:
                self._search(np.concatenate(parts), np.repeat(owner, [len(p) for p in parts]), out)
                parts, owner, held = [], [], 0
        return sorted(out)

    def _search(self, w: np.ndarray, owner: np.ndarray, out: set[tuple[int, int]]) -> None:
        known = np.append(0, np.cumsum(w >= 0))
        for size, (_, own, table) in self.tables.items():
            # With more unknown words than may be exchanged a window is no passage of any item.
            least = size - (EXCHANGED if size == PASSAGE else 0)
            where = np.flatnonzero(known[size:] - known[:-size] >= least)
            for k in range(0, len(where), WINDOWS):
                at = where[k : k + WINDOWS]
                for q, r in table.near(self.fingerprints(w, at, size)):
                    ok = self.passages(w, at[q], r, size)
                    out.update(zip(owner[at[q[ok]]].tolist(), (self.ids[i] for i in own[r[ok]])))


_INDEXES: dict[str, Index] = {}


def _index(key: str, items) -> Index:
    """The index of a block of items, built once per worker."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(items.value)
    return _INDEXES[key]


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, item_chars: int = ITEM_CHARS) -> DataFrame:
    """(doc_id, item_id), one row per document and item of which it holds a passage.

    Whole texts are searched. Null and empty texts hold nothing; an item without words is in no
    document; repeated items or documents give one row. Other columns are ignored. An item shorter
    than a passage must occur whole and unchanged. At most ``item_chars`` characters of items and one
    item more are sent to the tasks at a time."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("text is not null and doc_id is not null")
    q = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).filter("item_id is not null and text is not null").distinct()
    size = q.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // item_chars))
    if parts > 1:
        q = materialise(running_totals(materialise(q.select(F.lit("").alias("all"), "item_id", "text", F.length("text").cast("long").alias("size"))), "all", ["item_id", "text"], "size"))
    out = None
    for k in range(parts):
        block = q if parts <= 1 else q.filter(F.floor(F.col("before") / item_chars) == k)
        sent = spark.sparkContext.broadcast([(r.item_id, r.text) for r in block.select("item_id", "text").collect()])  # item_chars and one item at most
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0)
                got = _index(key, sent).found(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([i for i, _ in got], pa.int64())), pa.array([i for _, i in got], pa.int64())], ["doc_id", "item_id"])

        one = docs.mapInArrow(run, "doc_id long, item_id long")
        out = one if out is None else out.unionByName(one)
    return out.distinct().select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id))
