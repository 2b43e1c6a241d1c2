import numpy as np
import pytest

from folioflux.llm.mixture import SHARD_BLOCKS, Mixture, _split, draw, permute, totals

vocabularies = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permutation(n):
    got = permute(np.arange(n), n, 5)
    assert sorted(got.tolist()) == list(range(n))
    if n > 100:
        assert (got != permute(np.arange(n), n, 6)).mean() > 0.9 and (got == np.arange(n)).mean() < 0.05


def test_draw_keeps_shares_and_room():
    shares, room = np.array([0.5, 0.3, 0.2, 0.0]), np.array([10_000, 10_000, 2_000, 5])
    counts = totals(shares, room, 9_999)
    assert counts.tolist() == [5_000, 3_000, 1_999, 0] or abs(counts - shares * 9_999).max() <= 1 and counts.sum() == 9_999
    every = list(draw(counts, 64, 0, 157, 1))
    assert [k for k, _, _ in every] == list(range(157)) and (sum(n for _, _, n in every) == counts).all()
    assert all(n.sum() == 64 for _, _, n in every[:-1]) and every[-1][2].sum() == 9_999 - 156 * 64
    assert all((b == sum((n for _, _, n in every[:k]), 0 * counts)).all() for k, b, _ in every)
    x = np.array([n[0] for _, _, n in every[:-1]])
    assert len(set(x.tolist())) > 8 and 2 < x.std() < 6  # drawn, not dealt: about 4 for a multinomial draw
    # any task draws its own shards
    assert [(k, b.tolist(), n.tolist()) for k, b, n in draw(counts, 64, 64, 90, 1)] == [(k, b.tolist(), n.tolist()) for k, b, n in every[64:90]]
    assert list(draw(0 * counts, 64, 0, 5, 1)) == []


def test_split_of_very_many():
    counts = np.array([10**12, 3 * 10**12, 0, 7], dtype=np.int64)
    got = _split(counts, 10**12, np.random.default_rng(1))
    assert got.sum() == 10**12 and (got <= counts).all() and abs(got[0] / 10**12 - 0.25) < 1e-5


def mix(spark, rows, targets, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")
    return Mixture(docs, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN, **kw)


def test_mixture(spark):
    rows = [(i, "word " * (20 + i % 30), " Big_Source" if i % 2 else "big-source", "x") for i in range(300)]
    rows += [(1000 + i, "some words here " * 40, "small", None) for i in range(12)]
    rows += [(2000, None, "small", None), (2001, "", "small", None), (2002, "no source", None, None), (2003, "other", "unlisted", None), (2004, "huge " * 30_000, "big-source", None)]
    m = mix(spark, rows, [("BIG SOURCE", 0.7, 1), ("small", 0.3, 5), ("missing", 0.1, 2), ("none", None, None)], block=32)
    shares = {r.source: r for r in m.shares().collect()}
    assert abs(shares["big-source"].actual_share - 0.7) < 0.02 and abs(shares["small"].actual_share - 0.3) < 0.02 and shares["missing"].actual_share == 0
    chosen = m.chosen().collect()
    assert {r.source for r in chosen} == {"big-source", "small"} and len({r.doc_id for r in chosen}) == len(chosen)
    assert max(r.repeats for r in chosen if r.source == "small") <= 5 and max(r.repeats for r in chosen if r.source == "big-source") == 1
    for s in ("big-source", "small"):
        assert sum(r.tokens_used for r in chosen if r.source == s) == shares[s].tokens_used
    assert all(r.tokens_used <= r.tokens * r.repeats for r in chosen)
    import base64

    import tiktoken
    with open(vocabularies.path("byte_bpe_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    text = {r[0]: r[1] for r in rows}
    assert all(r.tokens == len(enc.encode_ordinary(text[r.doc_id])) for r in chosen)
    slots = m.slots.collect()
    assert len({(r.source, r["pass"], r.block) for r in slots}) == len(slots)
    from collections import Counter

    n = Counter(r.shard for r in slots)
    assert all(n[k] == SHARD_BLOCKS for k in range(max(n))) and {(r.source, r.slot) for r in slots} == {(s, k) for s in {r.source for r in slots} for k in range(sum(r.source == s for r in slots))}


def test_nothing_to_mix(spark):
    m = mix(spark, [(1, "a", None, None)], [("s", 1.0, 1)])
    assert m.chosen().count() == 0 and [r.actual_share for r in m.shares().collect()] == [0.0]
