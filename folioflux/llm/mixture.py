"""Mixes sources to target shares of the total size in tokens.

Each source's records are packed, in order, into blocks of a fixed number of tokens (a record's
place follows from running totals; a block may hold several records and a record several blocks).
For each output shard the number of blocks per source is drawn from a multinomial distribution, under
the condition that all shards together give each source its share: the shards are the leaves of a
binary tree, every node of which splits its blocks between its halves at random, so any task draws
its own shards from the root, and knows what went to the shards before, without drawing those. The
slots drawn for a source are mapped through a pseudorandom permutation of its blocks, a new one for
each pass, so no block is used more often than the number of passes; slots and blocks are then
joined by (source, index), a key of even spread whatever the size of a source.
"""

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.operators.prefix import running_totals
from folioflux.session import materialise

#: Tokens of a block.
BLOCK = 256
#: Blocks of an output shard, whatever the size of the mixture; shards drawn by a task at a time.
SHARD_BLOCKS, GROUP = 256, 64
#: Slots of one Arrow batch.
BATCH = 1 << 16
SEED = 20_250_101


def normal_source(c: str):
    """Names of sources whatever their spelling: case, surrounding white space, _ or - or space."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.col(c)), r"^\s+|\s+$", ""), r"[\s_]+", "-")


_ENCODINGS: dict[str, object] = {}


def _encoding(key: str, ranks: bytes, pattern: str):
    """The encoding of a vocabulary sent with the job, built once per worker."""
    if key not in _ENCODINGS:
        import tiktoken

        _ENCODINGS.clear()
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    return _ENCODINGS[key]


def token_counts(df: DataFrame, text: str, ranks_file: str, pattern: str, out: str = "tokens") -> DataFrame:
    """Adds the number of tokens of each text by a byte-pair vocabulary of ranks; null text has none. The
    vocabulary, a file of the driver, is sent to the tasks; its size is that of the public file."""
    with open(ranks_file, "rb") as f:
        ranks = f.read()
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    sent = df.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("long")
    def count(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            enc = _encoding(key, sent.value, pattern)
            yield pd.Series([0 if t is None else len(enc.encode_ordinary(t)) for t in s], dtype="int64")

    return df.drop(out).withColumn(out, count(F.col(text)))


def permute(i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the places ``i``: a Feistel network on the smallest
    even number of bits that holds n, walked on until the value falls below n."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([SEED, seed]).integers(0, 2**63, 6, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for k in keys:
            h = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((h >> np.uint64(33)) & mask)
        return (a << np.uint64(half)) | b

    x = once(i.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def totals(shares: np.ndarray, room: np.ndarray, total: int) -> np.ndarray:
    """Whole blocks per source that make up ``total`` in proportion, none over its room: the largest
    remainders are rounded up."""
    exact = shares * total
    out = np.minimum(np.floor(exact).astype(np.int64), room)
    for k in np.argsort(out - exact, kind="stable"):
        if out.sum() < total and out[k] < room[k] and shares[k] > 0:
            out[k] += 1
    return out


def _split(counts: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source fall among ``left`` places drawn from all without putting back; beyond a
    billion places by the normal law with the same mean and variance."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for k, c in enumerate(counts.tolist()):
        rest -= c
        if not c or not left:
            continue
        if c + rest < 1_000_000_000:
            x = int(rng.hypergeometric(c, rest, left)) if rest else left
        else:
            n = c + rest
            p = c / n
            x = round(rng.normal(left * p, (left * p * (1 - p) * (n - left) / max(1, n - 1)) ** 0.5))
        x = min(max(x, left - rest, 0), c, left)
        out[k] = x
        left -= x
    return out


def draw(counts: np.ndarray, size: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, blocks of each source in the shards before, blocks of each source in it) of the shards
    first to last - 1, of ``size`` blocks each but for the last of all."""
    total = int(counts.sum())

    def node(lo: int, hi: int, before: np.ndarray, here: np.ndarray):
        if lo >= last or hi <= first:
            return
        if hi - lo == 1:
            yield lo, before, here
            return
        mid = (lo + hi) // 2
        left = _split(here, min(mid * size, total) - lo * size, np.random.default_rng([SEED, seed, lo, hi]))
        yield from node(lo, mid, before, left)
        yield from node(mid, hi, before + left, here - left)

    if total:
        yield from node(0, -(-total // size), np.zeros_like(counts), counts)


class Mixture:
    """The plan of a mixture: ``records`` with their places, ``slots`` and the ``sources`` table.

    docs: one row per record; targets: (source, target_share, max_repeats), one row per source.
    Source names are compared by :func:`normal_source`; records with a null or unlisted source cannot
    count to a share and are not chosen, nor are records without tokens. A source with a share but
    no tokens is left out, the other shares keep their proportions, and its actual share is 0. A null
    or negative share counts 0, a null max_repeats 1. The total is the largest at which every other
    source reaches its share within its cap."""

    def __init__(self, docs: DataFrame, targets: DataFrame, ranks_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: int = 1):
        spark = docs.sparkSession
        self.block = block
        want = targets.select(normal_source("source").alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).cast("long").alias("cap")).filter("source is not null")
        want = want.groupBy("source").agg(F.max("share").alias("share"), F.max("cap").alias("cap"))
        r = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), normal_source(source).alias("source"), F.col(f"`{text}`").alias("text"))
        # Only listed sources are read to the end, and their texts leave the scan as counts.
        r = token_counts(r.join(want.select("source"), "source", "left_semi"), "text", ranks_file, pattern).drop("text").filter("tokens > 0")
        # Written first: the range bounds of the totals are sampled, which would count all tokens twice.
        self.records = materialise(running_totals(materialise(r), "source", ["doc_id"], "tokens"))
        have = self.records.groupBy("source").agg(F.sum("tokens").alias("tokens"))
        # One row per source of the targets, which the driver needs to draw; both sides are that small.
        rows = sorted(want.join(have, "source", "left").collect(), key=lambda x: x.source)
        self.names = [x.source for x in rows]
        tokens = np.array([x.tokens or 0 for x in rows], dtype=np.int64)
        self.blocks = -(-tokens // block)
        cap = np.array([x.cap for x in rows], dtype=np.int64)
        goal = np.array([x.share for x in rows], dtype=float)
        able = (self.blocks > 0) & (cap > 0) & (goal > 0)
        shares = np.where(able, goal, 0)
        shares = shares / shares.sum() if able.any() else shares
        room = np.where(able, cap * self.blocks, 0)
        total = int((room[able] / shares[able]).min()) if able.any() else 0
        drawn = totals(shares, room, total)
        self.sources = spark.createDataFrame([(n, float(g), int(c), int(t), int(b), int(d)) for n, g, c, t, b, d in zip(self.names, goal, cap, tokens, self.blocks, drawn)], "source string, target_share double, max_repeats long, tokens long, blocks long, drawn long")
        names, blocks, shards = np.array(self.names, dtype=object), self.blocks, -(-int(drawn.sum()) // SHARD_BLOCKS)
        groups = -(-shards // GROUP)
        plan = spark.range(0, groups, 1, max(1, min(groups, spark.sparkContext.defaultParallelism * 4)))

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list[np.ndarray]] = []

            def flush() -> pa.RecordBatch:
                shard, s, j, turn, at = (np.concatenate(x) for x in zip(*held))
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(names[s], pa.string()), pa.array(j), pa.array(turn + 1), pa.array(at)], ["shard", "source", "slot", "pass", "block"])

            for b in batches:
                for group in b.column(0).to_pylist():
                    for shard, start, n in draw(drawn, SHARD_BLOCKS, group * GROUP, min((group + 1) * GROUP, shards), seed):
                        for s in np.flatnonzero(n).tolist():
                            j = np.arange(start[s], start[s] + n[s])
                            turn = j // blocks[s]
                            at = np.empty(len(j), dtype=np.int64)
                            for t in np.unique(turn):
                                m = turn == t
                                at[m] = permute(j[m] % blocks[s], int(blocks[s]), (seed * 1_000_003 + s) * 1_009 + int(t))
                            held.append([np.full(len(j), shard), np.full(len(j), s), j, turn, at])
                        if len(held) * SHARD_BLOCKS > BATCH:
                            yield flush()
            if held:
                yield flush()

        #: one row per block of the mixture
        self.slots = plan.mapInArrow(slots, "shard long, source string, slot long, pass long, block long")

    def pieces(self) -> DataFrame:
        """(source, block, doc_id, doc_tokens, piece_tokens): the part of each record in each block."""
        b = F.lit(self.block)
        last = F.floor((F.col("before") + F.col("tokens") - 1) / b).cast("long")
        p = self.records.withColumn("block", F.explode(F.sequence(F.floor(F.col("before") / b).cast("long"), last)))
        size = F.least(F.col("before") + F.col("tokens"), (F.col("block") + 1) * b) - F.greatest(F.col("before"), F.col("block") * b)
        return p.select("source", "block", "doc_id", F.col("tokens").alias("doc_tokens"), size.alias("piece_tokens"))

    def used(self) -> DataFrame:
        """(source, block, uses). Slots come from a range of numbers, so their size is not to be guessed
        from it: joins with them are told not to send this side to every task."""
        return self.slots.groupBy("source", "block").agg(F.count("*").alias("uses")).hint("merge")

    def chosen(self) -> DataFrame:
        """One row per chosen record: its tokens, how often its most used part is used, and the
        tokens it contributes."""
        j = self.pieces().join(self.used(), ["source", "block"])
        return j.groupBy("source", "doc_id").agg(F.first("doc_tokens").alias("tokens"), F.max("uses").alias("repeats"), F.sum(F.col("uses") * F.col("piece_tokens")).alias("tokens_used"))

    def shares(self) -> DataFrame:
        """Per source the target and the actual share of all tokens drawn."""
        last = self.records.groupBy("source").agg((F.sum("tokens") - 1).alias("end"))
        u = self.used().join(F.broadcast(last), "source")  # one row per source of the targets
        size = F.least(F.lit(self.block), F.col("end") + 1 - F.col("block") * self.block)
        got = u.groupBy("source").agg(F.sum(F.col("uses") * size).alias("tokens_used"), F.max("uses").alias("most_repeats"))
        out = self.sources.join(got, "source", "left").na.fill(0, ["tokens_used", "most_repeats"])
        total = out.agg(F.sum("tokens_used")).scalar()
        share = F.when(total > 0, F.col("tokens_used") / total).otherwise(0.0)
        return out.select("source", "target_share", "max_repeats", "tokens", "tokens_used", "most_repeats", share.alias("actual_share"))
