import pytest

from pairforge.llm import p1_sentences as P1

CORPUS = [
    "Dr. Weber kam. Prof. Maier ging. Er sah z. B. das Haus. Dr. Kurz blieb.",
    "Он работал, напр. в банке. См. рис. 5. Зарплата 5 тыс. руб. в месяц. Это было в 2001 г. по плану.",
    "We met Mr. Smith. The plan, e.g. the map, is old. Prices rose vs. last year. The end came at 9 a.m. sharp.",
    "Она пришла. Мы ушли и т. п. Проект готов! Проект сдан? Проект закрыт... Студент рад! Студент ушёл.",
] * 3


def evidence(texts):
    out = {k: {} for k in P1.KINDS}
    for t in texts:
        for k, c in P1.observe(t).items():
            for w, n in c.items():
                out[k][w] = out[k].get(w, 0) + n
    return out


@pytest.fixture(scope="module")
def split():
    s = P1.Splitter(evidence(CORPUS))
    return lambda t: [t[a:b] for a, b in s.split(t)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []),
        ("  \n ", []),
        ("Без точки", ["Без точки"]),
        ("Dr. Weber kam. Er ging.", ["Dr. Weber kam.", "Er ging."]),
        ("Версия 4.2.1 вышла. Проект готов.", ["Версия 4.2.1 вышла.", "Проект готов."]),
        ("«Стенд готов. Данных мало!» — так сказал он. Проект сдан.", ["«Стенд готов. Данных мало!» — так сказал он.", "Проект сдан."]),
        ('"Why Go?" asked she. The plan is old.', ['"Why Go?" asked she.', "The plan is old."]),
        ("老师说：“资料齐全。进度很好！”大家都同意。为什么？", ["老师说：“资料齐全。进度很好！”大家都同意。", "为什么？"]),
        ("हमने लिखा। आप कौन?", ["हमने लिखा।", "आप कौन?"]),
        ("เราใช้ Java เพื่อลดเวลา ทีมงานของเรา", ["เราใช้ Java เพื่อลดเวลา", "ทีมงานของเรา"]),
        ("لماذا اخترتم؟ هدف مشروع.", ["لماذا اخترتم؟", "هدف مشروع."]),
        ("Навыки\n1. Проект готов\n2) Студент рад", ["Навыки", "1. Проект готов", "2) Студент рад"]),
        ("Это длинная строка без\nконца и начала. Проект сдан.", ["Это длинная строка без\nконца и начала.", "Проект сдан."]),
        ("Первый абзац\n\nвторой абзац", ["Первый абзац", "второй абзац"]),
        ("Проект готов!Студент рад.", ["Проект готов!", "Студент рад."]),
        ("Он назвал (см. план. Там есть всё.) это. Проект сдан.", ["Он назвал (см. план. Там есть всё.) это.", "Проект сдан."]),
    ],
)
def test_units(split, text, want):
    assert split(text) == want


def test_units_cover_everything_but_white_space(split):
    for t in [*CORPUS, "a" * 5000, "..!!??", "«" * 40, "1.\n2.\n3.", "。" * 10, "\x00 x y"]:
        s = P1.Splitter()
        spans = s.split(t)
        rest = list(t)
        for a, b in spans:
            assert 0 <= a < b <= len(t) and not t[a].isspace() and not t[b - 1].isspace()
            for i in range(a, b):
                rest[i] = " "
        assert not "".join(rest).strip() and spans == sorted(spans)


def test_table(spark):
    rows = [(1, "Проект готов. Студент рад.", "x"), (2, None, "y"), (3, " ", None), (1, "Проект готов. Студент рад.", "x")]
    df = spark.createDataFrame(rows, "text_id long, text string, sentence string")
    out = P1.sentences(df, ["text_id"]).collect()
    assert len(out) == 4 and {r["text_id"] for r in out} == {1}
    assert P1.sentences(df.where("text_id > 9"), ["text_id"]).count() == 0


def test_sides(spark):
    from pairforge.llm.common import text_sides

    rows = [(1, 5, "a", "b", 0), (1, 6, None, "c", 0), (None, 6, "z", "c", 1)]
    df = spark.createDataFrame(rows, "id_1 long, id_2 long, text_1 string, text_2 string, side int")
    assert {tuple(r) for r in text_sides(df).collect()} == {(1, 1, "a"), (2, 5, "b"), (2, 6, "c")}


def test_the_document_overrules_the_corpus():
    corpus = {P1.OPEN: {"xyz": 50}, P1.FINAL: {"xyz": 40}, P1.BARE: {"xyz": 500}}
    text = "Wir xyz. kamen hier. Er xyz. ging dort. Sie xyz. blieb. Die xyz. Weber kam."
    assert P1.Splitter(corpus).abbreviation(P1.observe(text), "xyz") == (True, True)
    assert P1.Splitter(corpus).abbreviation(P1.observe("Nichts davon."), "xyz") == (False, True)
    plain = {P1.SMALL: {"haus": 50}}
    assert P1.Splitter(plain).abbreviation(P1.observe("Das haus ist alt. Er sah das haus."), "haus") == (False, True)


def test_quotations_of_any_length_are_one_unit():
    s = P1.Splitter()
    for opening, closing in ("«»", '""', "()"):
        text = f"Er sagte {opening}" + "Das Haus ist gut. " * 150 + f"Ende.{closing} und ging weiter."
        assert s.split(text) == [(0, len(text))]
    # marks without a partner hold nothing: the paragraph, a list item or an inch end them
    for text in ("Er sagte «das. Wort ist gut.\n\nEin Satz. Noch ein Satz».", 'Ein Brett 15" lang. Ein Satz. Noch "ein" Satz.'):
        assert len(s.split(text)) >= 3


def test_evidence_is_the_same_whichever_way_it_travels(spark):
    rows = [(i, t) for i, t in enumerate(CORPUS)] + [(99, None), (98, "")]
    df = spark.createDataFrame(rows, "text_id long, text string")
    whole = evidence(CORPUS)
    for share in (1e-9, 0.02, 2.0):
        usual, light = P1.corpus_evidence(df, ["text_id"], heavy_share=share)
        rare = {r["text_id"]: r["light"] for r in light.collect()}
        for i, t in enumerate(CORPUS):
            s = P1.Splitter(usual)
            assert s.split(t, rare.get(i)) == P1.Splitter(whole).split(t)
            for w in P1.asks(t):
                assert [s._everywhere(k, w) for k in P1.KINDS] == [whole[k].get(w, 0) for k in P1.KINDS]
