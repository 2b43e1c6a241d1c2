import random

import numpy as np
import pytest

from folioflux.llm import toxicity as t


def gapped(s, u, p, lam=t.DECAY):
    """Sum over common subsequences of p characters, by listing them."""
    from itertools import combinations

    def features(w):
        out = {}
        for ix in combinations(range(len(w)), p):
            k = "".join(w[i] for i in ix)
            out[k] = out.get(k, 0) + lam ** (ix[-1] - ix[0] + 1)
        return out

    a, b = features(s), features(u)
    return sum(v * b.get(k, 0) for k, v in a.items())


@pytest.mark.parametrize(("a", "b"), [("cretin", "cr*tin"), ("idiot", "idiooot"), ("a", "a"), ("pig", "p*g"), ("moron", "rats"), ("abcabc", "acbacb")])
def test_kernel_is_the_gapped_subsequence_kernel(a, b):
    k = t._kernel(t._codes([a]), t._codes([b]))[0]
    assert np.isclose(k, sum(gapped(a, b, p) for p in (1, 2, 3)), rtol=1e-4)


def test_inserted_and_gapped_characters_stay_near():
    w = t.Words(["moron", "cretin", "garden", "pattern", "matrix"])
    near = w.similarity(["mo*on", "crettin", "cr-tin", "mmoron", "gardens"])
    assert near.argmax(axis=1).tolist() == [0, 1, 1, 0, 2] and near.max(axis=1).min() > 0.4


def test_words_and_sentences():
    assert t.sentences("You b@$t@rd! M0R0N. f u c k e d it, v.e.r.m.i.n and mor\\-on\n% asssss \\textit{ver}min 42") == [
        ["you", "bastard"], ["moron"], ["fucked", "it", "vermin", "and", "moron"], ["as", "vermin"]]
    assert t.sentences("") == [] and "".join(t.pieces("x" * 99)) == "x" * 99


INSULTS = ["you are a {} pig", "shut your mouth you {} idiot", "get lost {} moron", "i hope you die {} loser"]
FINE = ["the {} model converges", "we measure the {} lattice", "a pig farm in the {} valley", "results of the {} survey", "the mouth of the {} river"]
FILL = ["small", "large", "linear", "global", "local", "stupid", "modal", "sparse"]


def corpus(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = [r.choice(FINE).format(r.choice(FILL)) for _ in range(12)]
        bad = i % 3 == 0
        if bad:
            s.insert(r.randrange(12), r.choice(INSULTS).format(r.choice(FILL)))
        out.append((i, ". ".join(s) + ".", bad))
    return out


def test_held_out_accuracy(spark):
    r = random.Random(5)
    docs, held = corpus(240, 1), corpus(200, 2)
    labels = [(i, f"r{k}", int(bad ^ (r.random() < 0.08)), "abuse" if bad else None) for i, _, bad in docs for k in range(r.choice([1, 3]))] + [(None, None, None, None), (9999, "r", 1, "abuse")]
    schema = "doc_id long, text string, source string, abuse string"
    d = spark.createDataFrame([(i, x, "s", None) for i, x, _ in docs] + [(5000, None, None, None), (5001, "", None, None)], schema)
    model = t.fit(d, spark.createDataFrame(labels, "doc_id long, rater string, flagged int, kind string"))
    h = spark.createDataFrame([(i, x, "s", None) for i, x, _ in held] + [(5000, None, None, None), (5001, "", None, None), (5002, "shut your mouth you id*ot " * 9000, None, None)], schema)
    got = {x.doc_id: x for x in t.scores(h, model, "doc_id", "text", ["source"]).collect()}
    right = sum((got[i].abuse > 0) == bad for i, _, bad in held)
    assert right >= 190 and got[5000].abuse == got[5001].hate == -10 and got[5002].abuse > 0


def test_without_labels_the_seeds_hold(spark):
    model = t.train([])
    s = t.Scorer(model).score(["You are a worthless idiot. Fine.", "The bound is tight and the proof is short.", "Free porn with naked girls!"])
    assert s[0, 0] > 0 and s[1].max() < 0 and s[2, 2] > 0


def test_kinds_of_one_sentence():
    margin = np.array([[0.9, 0.6, -0.2], [0.4, 0.3, 0.1], [-1.0, -0.5, -0.7]])
    assert t.of_kinds(margin).tolist() == [[0.9, 0.6, -0.2], [0.4, 0.0, 0.0], [-1.0, -0.5, -0.7]]
