import random
from collections import Counter

import pytest

from folioflux.llm import scans
from folioflux.llm.scans import Scan, is_number, key, rebuild, variants

WORDS = "measurement reservoir approximated classifier spectrum temperature hydraulic invariant seasonal population corridor glacier estimated diffusion".split()


def pages(seed=0, docs=8, n=6):
    """Pages with planted cases, and the cases."""
    r = random.Random(seed)
    rows, want = [], set()
    for d in range(docs):
        title = f"Annals of {r.choice(WORDS)} and {r.choice(WORDS)}"
        carry = None
        for p in range(1, n + 1):
            body = [" ".join(r.choices(WORDS, k=6)) + "." for _ in range(5)]
            if carry:
                body[0] = carry + " is open. " + body[0]
                carry = None
            if r.random() < 0.7:
                w = r.choice([x for x in WORDS if len(x) > 7])
                body[1:2] = [f"here the {w[:4]}" + r.choice(["-", "¬ ", "‐"]), f"{w[4:]} is small", ""]
                want.add(("x", f"d{d}", p, "hyphen", w))
            if r.random() < 0.5:
                body.insert(len(body) - 1, "both pre-\nand post-war states, a well-\nknown case, a well-known thing.")
                want.add(("x", f"d{d}", p, "hyphen", "well-known"))
            if r.random() < 0.5:
                body.append("the diffusi0n grows.")
                want.add(("x", f"d{d}", p, "misread", "diffusion"))
            if p < n and r.random() < 0.5:
                body.append("the rest is esti-")
                carry = "mated"
                want.add(("x", f"d{d}", p, "hyphen", "estimated"))
            head = title if p != 3 else title.replace("n", "ri", 1)
            number = ["- {} -", "{}", "Page {} of 9", "[{}]"][d % 4].format(p)
            rows.append(("x", f"d{d}", p, "\n".join([head, *body, number]).replace("\n", r.choice(["\n", "\r\n"]))))
            want |= {("x", f"d{d}", p, "header", head), ("x", f"d{d}", p, "pageno", number)}
    return rows, want


def test_planted_cases_are_found(spark):
    rows, want = pages()
    rows += rows[:7] + [("x", "d0", None, "alone"), ("x", None, 1, "alone"), ("y", "e", 1, None), ("y", "e", 2, ""), ("y", "e", 3, "word " * 60_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "origin string, doc_sha256 string, page_number long, text string, kind string")
    got = Scan(df).cases().collect()
    assert len(got) == len(set(got))
    got = {tuple(x) for x in got}
    assert got == want, (got - want, want - got)


def test_repaired_text(spark):
    rows = [("x", "d", p, f"Annals of ice and snow\nThe first diffu-\nsion of page\nis estimated.\n\nA second paragraph with meas-\n- {p} -" if p < 4 else "Annals of ice and snow\nured diffusi0n ends.\n- 4 -") for p in (1, 2, 3, 4)]
    rows += [("x", "e", 9, "diffusion measured " * 30)]
    df = spark.createDataFrame(rows, "origin string, doc_sha256 string, page_number long, text string")
    got = {(r.doc_sha256, r.page_number): r.text for r in Scan(df).repaired().collect()}
    assert got["d", 3] == "The first diffusion of page is estimated.\n\nA second paragraph with measured"
    assert got["d", 4] == "diffusion ends."


def test_empty(spark):
    df = spark.createDataFrame([], "origin string, doc_sha256 string, page_number long, text string")
    assert Scan(df).cases().count() == 0 and Scan(df).repaired().count() == 0


@pytest.mark.parametrize(("line", "yes"), [("- 12 -", True), ("[67]", True), ("p. l2", True), ("Page 3 of 9", True), ("xvii", True), ("ll2", True), ("mild", False), ("alike.", False), ("7.", False), ("I did", False), ("1999 was", False)])
def test_page_numbers(line, yes):
    assert is_number(line) is yes


def test_keys_and_variants():
    assert key("Annals of scasonal ice, Vol. 4   3") == key("12   Annals of seasonal icc, Vol. l4") != ""
    assert key("systems alike.") == "" and key("12") == ""
    for bad, good in [("rneasurernent", "measurement"), ("siimmary", "summary"), ("vvith", "with"), ("c0mpiler", "compiler"), ("determmistic", "deterministic"), ("cliscarclecl", "")]:
        assert (good in variants(bad)) is bool(good)


def test_many_forms_meet_the_words_in_a_join(spark, monkeypatch):
    rows, want = pages()
    df = spark.createDataFrame(rows, "origin string, doc_sha256 string, page_number long, text string")
    monkeypatch.setattr(scans, "SENT", 0)
    assert {tuple(x) for x in Scan(df).cases().collect() if x.kind == "misread"} == {w for w in want if w[3] == "misread"}


def test_rebuild_without_work():
    assert rebuild("a b\nc\n\nd", [], [], {}, None) == "a b c\n\nd"


def test_a_broken_word_may_end_like_a_word_after_a_hanging_hyphen(spark):
    rows = [("x", "d", 1, "The old detect-\nor and sens-\n0r hold,\nboth pre-\nand post-war.\nThe end."), ("x", "e", 1, "the detector and the sensor " * 9)]
    scan = Scan(spark.createDataFrame(rows, "origin string, doc_sha256 string, page_number long, text string"))
    assert {tuple(r)[3:] for r in scan.cases().collect()} == {("hyphen", "detector"), ("hyphen", "sensor"), ("misread", "sensor")}
    got = {r.doc_sha256: r.text for r in scan.repaired().collect()}
    assert got["d"] == "The old detector and sensor hold, both pre- and post-war. The end."


def test_edges_of_three_lines_and_nearly_equal_headers(spark):
    body = "the probe measures the flow of water\nand the basin holds all of it for a day\nas the tide goes out once more again\nso nothing is left of it in the end"
    heads = ["Journal of Quiet Waters", "Tides and their Basins", "Issue of the Spring"]
    pages = []
    for n in range(1, 9):
        h = [x.replace("Basins", "Baxkns") if n == 5 else x for x in heads]
        pages.append(("recovered_pages", "d", n, "\n".join([*h, f"{body} {n * 'x'}", "Quiet Press Limited", f"page {n}", "All rights reserved"])))
    # alike but for words is no misreading
    pages.append(("recovered_pages", "d", 9, "\n".join([heads[0], heads[2], "Tides and their Rivers", body, "Quiet Press Limited", "page 9", "All rights reserved"])))
    got = scans.Scan(spark.createDataFrame(pages, "origin string, doc_sha256 string, page_number long, text string")).cases()
    found = {(r.page_number, r.kind, r.item) for r in got.filter("kind in ('header', 'pageno')").collect()}
    want = {(n, "header", x) for n in range(1, 10) for x in (heads[0], heads[2], "Quiet Press Limited", "All rights reserved")} | {(n, "pageno", f"page {n}") for n in range(1, 10)}
    want |= {(n, "header", "Tides and their Baxkns" if n == 5 else heads[1]) for n in range(1, 9)}
    assert found == want


class Taken:
    """A pattern that notes what it is applied to."""

    def __init__(self, pattern):
        self.pattern, self.to = pattern, []

    def findall(self, text):
        self.to.append(text)
        return self.pattern.findall(text)

    def search(self, *args):
        return self.pattern.search(*args)


def test_repeated_text_is_taken_apart_once(monkeypatch):
    monkeypatch.setattr(scans, "_TOKEN", taken := Taken(scans._TOKEN))
    text = "\n".join(["The flow, the (old) well-known flow."] * 9)
    words, fine = scans.Words(), set()
    for _ in range(50):
        words.add(text, [])
        assert scans.page_words(text, {"fl0w": "flow"}, fine) == set()
    assert words.take() == {"the": 900, "flow": 900, "old": 450, "well-known": 450}
    assert len(taken.to) == 2 * len(set(text.split()))


def test_words_are_counted_as_line_by_line(monkeypatch):
    monkeypatch.setattr(scans, "PIECES", 50)
    r = random.Random(5)
    parts = ["ab", "cd-e", "Fσ", "ΑΣ", "_x", "7", "¬", "-", "- ", ", ", " ", " ", "\u00a0", "\u00ad", "\n", "\r\n", "-\n", "‐\u00a0\n", "\x85", "-\x1c", "(", "."]
    words, want, forms, fine = scans.Words(), Counter(), {"ab": "x", "fσ": "y"}, set()
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randint(1, 30)))
        ls, broken, at = scans.lines(text), False, set()
        for i, x in enumerate(ls):
            w = scans._TOKEN.findall(x.lower())
            first, broken = int(broken), x[-1] in "-¬‐\xad"
            w = w[first : len(w) - broken]
            want.update(w)
            at |= {(scans.place(i, len(ls)), f) for f in w}
        words.add(text, scans.scan_page(ls)[2])
        assert scans.page_words(text, None) == at
        assert scans.page_words(text, forms, fine) == {(i, f) for i, f in at if f in forms}
    assert words.take() == want


def test_broken_words_before_odd_white_space_are_no_words(spark):
    rows = [("x", "d", 1, "The old detec-\u00a0\ntor holds.\nThe end."), ("x", "d", 2, "A sen-\x1csor, too.")]
    got = scans.Scan(spark.createDataFrame(rows, "origin string, doc_sha256 string, page_number long, text string")).words()
    assert {r.word: r.n for r in got.collect()} == {"the": 2, "old": 1, "holds": 1, "end": 1, "a": 1, "too": 1}
