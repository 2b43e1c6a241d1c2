import random

import numpy as np
import pytest

from folioflux.llm.contamination import BITS, PASSAGE, RADIUS, SIMILAR, Index, Table, leaks, words

VOC = [f"w{i}" for i in range(300)]


def brute(docs, items):
    out = set()
    for i, it in items:
        a = words(it)
        n = min(PASSAGE, len(a))
        need = n - 1 if n == PASSAGE else n
        for d, t in docs:
            b = words(t or "")
            if n and any(sum(x == y for x, y in zip(a[p : p + n], b[q : q + n])) >= need for p in range(len(a) - n + 1) for q in range(len(b) - n + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    items = [(i, " ".join(r.choices(VOC, k=r.choice([3, 9, 16, 17, 40])))) for i in range(12)]
    docs = []
    for d in range(60):
        w = r.choices(VOC, k=r.randrange(0, 60))
        for _ in range(r.randrange(3)):
            src = words(r.choice(items)[1])
            a = r.randrange(len(src))
            piece = src[a : a + r.choice([8, 12, 15, 16, 17, 30])]
            for _ in range(r.choice([0, 1, 1, 2])):
                piece[r.randrange(len(piece))] = r.choice(VOC)
            w[len(w) // 2 : len(w) // 2] = piece
        docs.append((d, " ".join(w)))
    docs += [(60, None), (61, ""), (62, items[0][1] * 2)]
    got = leaks(spark.createDataFrame(docs * 2, "doc_id long, text string"), spark.createDataFrame(items * 2 + [(99, None), (98, "")], "item_id long, text string"), "doc_id", "text", "item_id", "text").collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == brute(docs, items)


def test_every_fingerprint_within_the_radius_is_a_candidate():
    r = random.Random(1)
    rng = np.random.default_rng(0)
    own = np.unique(rng.integers(0, 2, (400, BITS)) > 0, axis=0)
    q = own[rng.integers(0, len(own), 300)].copy()
    for row in q:
        row[r.sample(range(BITS), r.randrange(RADIUS + 4))] ^= True
    pairs = [x for a, c in Table(own, RADIUS).near(q) for x in zip(a.tolist(), c.tolist())]
    near = (q[:, None, :] ^ own[None]).sum(axis=2) <= RADIUS
    assert len(pairs) == len(set(pairs)) and set(pairs) == set(zip(*map(list, np.nonzero(near))))


def planted(seed=2, n=400):
    """Items, and per item a document with a passage of 16 words of it, one exchanged for another word of the items."""
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(r.choices(voc, k=r.randrange(16, 60)))) for i in range(n)]
    docs = []
    for _, t in items:
        w = t.split()
        a = r.randrange(len(w) - 15)
        piece = w[a : a + 16]
        piece[r.randrange(16)] = r.choice(voc)
        docs.append(" ".join([f"x{r.randrange(99)}" for _ in range(30)] + piece + ["end"] * 20))
    return items, docs


def test_the_radius_finds_what_equal_fingerprints_do_not():
    items, docs = planted()
    ix = Index(items)
    assert {(k, k) for k in range(len(docs))} <= set(ix.found(docs))
    at, own, table = ix.tables[16]
    ix.tables[16] = at, own, Table(np.concatenate([ix.fingerprints(ix.flat, at, 16)]), 0)
    assert len([1 for k, i in ix.found(docs) if k == i]) < 0.2 * len(docs)


def test_one_exchanged_word_never_leaves_the_radius():
    items, _ = planted(5)
    ix = Index(items)
    at = ix.tables[16][0]
    w, r = ix.flat, random.Random(0)
    for p in at[:: max(1, len(at) // 500)]:
        win = w[p : p + 16].copy()
        win[r.randrange(16)] = r.choice([-1, r.randrange(len(ix.vocab))])
        assert (ix.fingerprints(w, np.array([p]), 16) ^ ix.fingerprints(win, np.array([0]), 16)).sum() <= RADIUS


def test_similarity_rejects_other_orders_and_more_exchanged_words():
    items, _ = planted(3, 40)
    ix = Index(items)
    r = random.Random(4)
    w = ix.flat[:16]
    turned, half, one = w.copy(), w.copy(), w.copy()
    r.shuffle(turned)
    half[::5] = -1
    one[7] = -1
    near = [sum(((ix.fingerprints(x, np.array([0]), 16) ^ ix.fingerprints(w, np.array([0]), 16)).sum() <= RADIUS,)) for x in (turned, one)]
    assert near == [1, 1]  # both are candidates
    s = ix.similar(np.array([turned, half, one, w]), np.array([w] * 4))
    assert s[0] < SIMILAR and s[1] < SIMILAR and s[2] >= SIMILAR and s[3] == 1


def test_items_in_several_blocks(spark):
    items, docs = planted(7, 30)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, more = ({tuple(x) for x in leaks(*frame, "doc_id", "text", "item_id", "text", item_chars=n).collect()} for n in (10**6, 2000))
    assert one == more and len(one) >= 30


def test_markup_does_not_count():
    item = "Should Enwyno sell the bucket in Fenardunholm, 263 bakers will complain. It took Enwyno's dog 605 days to return."
    tex = "% Should\\footnote{See below.} {\\it Enwyno} sell~the~\\cite[p.~3]{ref1} \\textbf{bucket} in\n% Fenar\\-dunholm 263 bakers WILL complain\\footnote{x {y} z}. \\begin{quote}It took Enwynos dog \\ 605 days"
    assert words(tex) == words(item)[: len(words(tex))]
    assert Index([(5, item)]).found(["\\footnote{" + item + "}"]) == [(0, 5)]
    w = words(item)
    random.Random(3).shuffle(w)
    assert Index([(5, item)]).found([" ".join(w)]) == []


def test_no_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), none, "doc_id", "text", "item_id", "text").count() == 0
