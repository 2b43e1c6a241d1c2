from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from folioflux.llm import lookalikes, mojibake


@pytest.mark.parametrize(("text", "form", "kinds"), [
    ("plain text", "plain text", []),
    ("ｆｕｌｌ ﬁrst", "full first", ["width"]),
    ("résumé", "résumé", ["accent"]),
    ("x̂ hat", "x̂ hat", []),  # no composed letter: rightly a sign of its own
    ("ze​ro so­ft", "zero soft", ["invisible"]),
    ("a b　c\td", "a b c\td", ["space"]),
    ("sеnѕοr", "sensor", ["lookalike"]),
    ("двaжды чтo", "дважды что", ["lookalike"]),
    ("λmax Δt μm ΔT 16 m² 5 °C №", "λmax Δt μm ΔT 16 m² 5 °C №", []),
    ("проверка μέτρηση", "проверка μέτρηση", []),
    ("می‌خواهم", "می‌خواهم", []),
    ("\U0001f468‍\U0001f469‍\U0001f467", "\U0001f468‍\U0001f469‍\U0001f467", []),
    ("", "", []),
])
def test_one_form(text, form, kinds):
    assert lookalikes.normalise(text) == (form, kinds)
    assert lookalikes.normalise(form)[0] == form


def test_consistent_form_columns(spark):
    df = spark.createDataFrame([(1, "sеnѕοr", "x"), (2, None, None), (3, "", "y"), (4, "a" * 300_000 + " ", "z"), (4, "a", "z")], "id int, t string, form string")
    got = {r.id: r for r in lookalikes.consistent_form(df, "t").orderBy(F.length("t")).collect()}
    assert got[1].form == "sensor" and got[1].kinds == ["lookalike"] and got[2].form is None and got[2].kinds == [] and got[3].form == ""
    assert got[4].form.endswith("a ") and lookalikes.faults(df, "t", ["id"]).count() == 2
    assert lookalikes.faults(df.limit(0), "t", ["id"]).count() == 0


def test_whole_words_of_look_alikes(spark):
    pages = {
        "the \u0441\u043e\u0441\u043e grows \u0430 lot, and \u0440\u0430\u0441\u0441\u0435 ends": "the coco grows a lot, and pacce ends",
        "field \u0397 and density \u03c1 and rate \u03bd": "field H and density \u03c1 and rate \u03bd",
        "проверка: \u043e\u0441\u0430 летит, xop x A": "проверка: \u043e\u0441\u0430 летит, xop x A",
        "граница и oca растет": "граница и \u043e\u0441\u0430 растет",
        "the word \u043e\u0441\u0430 here": "the word \u043e\u0441\u0430 here",
        "The long label reads \u0397 μέθοδος here": "The long label reads \u0397 μέθοδος here",
        "it reads ошибка, \u0430 граница in the middle": "it reads ошибка, \u0430 граница in the middle",
    }
    df = spark.createDataFrame([(t,) for t in pages], "t string")
    got = {r.t: r for r in lookalikes.consistent_form(df, "t").collect()}
    assert {t: r.form for t, r in got.items()} == pages
    assert all(r.kinds == [] for r in got.values())


def test_letters_of_further_scripts(spark):
    more = lookalikes.confusables(spark)
    of = {(x, latin): c for c, latin, x in more}
    assert len(more) > 60 and of["Cherokee", "A"] == "\u13aa" and of["Lisu", "B"] == "\ua4d0"
    lookalikes.extend(more)
    mixed = "S" + of["Cherokee", "A"] + "LT and " + of["Lisu", "B"] + "OOK"
    assert lookalikes.normalise(mixed) == ("SALT and BOOK", ["lookalike"])
    rightly = "\u13e3\u13b3\u13a9 \ua4e1\ua4f3\ua4f2 and then English words follow here"
    assert lookalikes.normalise(rightly) == (rightly, [])
    assert lookalikes.normalise("двaжды чтo sеnѕοr") == ("дважды что sensor", ["lookalike"])


def _checker(skeleton):
    """A class path whose table of confusables answers so."""
    built = SimpleNamespace(build=lambda: SimpleNamespace(getSkeleton=skeleton))
    text = SimpleNamespace(SpoofChecker=SimpleNamespace(Builder=lambda: built))
    return SimpleNamespace(com=SimpleNamespace(ibm=SimpleNamespace(icu=SimpleNamespace(text=text))))


@pytest.mark.parametrize(("jvm", "says"), [
    (lambda spark: spark._jvm.no.such, "icu4j"),  # no such class there
    (lambda spark: _checker(lambda text: text[:101]), "51 of"),
    (lambda spark: _checker(lambda text: text), "no look-alike letters of Cherokee, Lisu, Coptic, Deseret"),
])
def test_no_table_of_confusables_is_an_error(spark, jvm, says):
    session = SimpleNamespace(_jvm=jvm(spark))
    for _ in range(2):  # nothing is kept of the failed call
        with pytest.raises(RuntimeError, match=says):
            lookalikes.confusables(session)


WORDS = "Größe wäre für Höhe; été déjà près; señal año; ação não; żółć długość; “quoted” isn’t—so; проверка показывает, что граница устойчивой; μέτρηση παραμένει σταθερή; 16 m² 5 °C 3 €"


@pytest.mark.parametrize("name", ["cp1252", "latin-1", "cp1250", "mac_roman", "cp437", "cp1251"])
def test_utf8_misread_comes_back(name):
    back = mojibake._BACK[name]
    for word in WORDS.split():
        bad = "".join(back[b] for b in word.encode())
        if bad != word:
            assert mojibake.repair(f"the {bad} of it") == ("restorable", f"the {word} of it"), bad
    assert mojibake.repair(WORDS) == (None, WORDS)


@pytest.mark.parametrize("times", [2, 4, 6])
def test_garbled_several_times(times):
    bad = WORDS
    for _ in range(times):
        bad = "".join(mojibake._BACK["cp1252"][b] for b in bad.encode())
    assert mojibake.repair(bad) == ("restorable", WORDS)


def test_chains_of_both_kinds():
    text = "Новая граница зависит от сезона, поэтому величина была измерена дважды"
    once = "".join(mojibake._BACK["cp1251"][b] for b in text.encode("koi8-r"))
    assert mojibake.repair(once) == ("restorable", text)
    assert mojibake.repair("".join(mojibake._BACK["cp1252"][b] for b in once.encode())) == ("restorable", text)
    assert mojibake.repair("".join(mojibake._BACK["koi8-r"][b] for b in text.encode("cp1251"))) == ("restorable", text)


@pytest.mark.parametrize("name", ["gbk", "shift_jis"])
def test_utf8_misread_as_wide(name):
    seen = 0
    for word in ("naïveté", "Größe", "isn’t", "“quoted”", "größere"):
        try:
            bad = word.encode().decode(name)
        except UnicodeDecodeError:
            continue  # such bytes are no text of that encoding
        seen += 1
        assert mojibake.repair(f"the {bad} of it") == ("restorable", f"the {word} of it")
    assert seen


@pytest.mark.parametrize(("text", "was", "read"), [
    ("Nowa głębokość była większa, a później długość może być różna", "iso8859-2", "latin-1"),
    ("Новая граница зависит от сезона, поэтому величина была измерена", "koi8-r", "cp1251"),
    ("Μετά τον έλεγχο η μέτρηση έγινε πιο γνωστή από την θερμοκρασία", "iso8859-7", "cp1252"),
])
def test_single_byte_misread(text, was, read):
    bad = "".join(mojibake._BACK[read][b] for b in text.encode(was))
    assert mojibake.repair(bad) == ("restorable", text)


@pytest.mark.parametrize("text", ["die Str?mung blieb", "costs 5 � a", "by?a d?ugo?ć", "63 € ? 3"])
def test_lost(text):
    assert mojibake.repair(text)[0] == "lost"


@pytest.mark.parametrize("text", ["", "SÃO BRÁULIO", "A ÂNCORA da série", "did you do this?Why", "wіth а mіхеd wоrd fоr thе sеnsоr аnd mоrе оf thеm іn thіs pаgе", "energy énergie étudions épaisseur " * 9, "动力 系统 联通 中文", "Why? Because. ¿Qué?", "https://a.b/c?d=e", "ЭТА ГРАНИЦА", "&amp; in code is html"[6:]])
def test_not_garbled(text):
    assert mojibake.repair(text) == (None, text)


def test_restore_rows(spark):
    df = spark.createDataFrame([(1, "FÃ¼r"), (1, "FÃ¼r"), (2, None), (3, ""), (4, "ok"), (5, "x&eacute;y")], "id int, text string")
    assert [tuple(r) for r in mojibake.restore(df, "text", ["id"]).orderBy("id").collect()] == [(1, "restorable", "Für")] * 2 + [(5, "restorable", "xéy")]
