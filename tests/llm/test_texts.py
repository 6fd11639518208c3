from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairforge.llm import p3_personal as P3
from pairforge.llm import p6_tokens as P6
from pairforge.llm import p8_mojibake as P8

# ---- p3

TOLD = [
    "Меня зовут Иванов П. С. Мой номер +7 (901) 123-45-67, тел. 8 (901) 765-43-21.",
    "My name is Henry Yorkin. Call my phone +44 20 7946 0497 or write to my email a.b@example.com.",
    "ФИО: Сидоров Олег Петрович. Паспорт 4509 123456, СНИЛС: 112-233-445 95. Почта: a . b [at] mail[dot]example[dot]net .",
    "Доц. М. В. Норриксов. Адрес: 123456, г. Тверь, ул. Лесная, д. 5, кв. 17. Phone (202) 555-0108.",
    "Dr Anna Rosvane, address: 26 Zannorel Street, Flat 44, Osimakin. Email: x.y@mail.example.org",
    "Соискатель Анна Викторовна Белкина, доц. Пётр Зернов, ФИО Фалин Д. Е.",
]
OTHERS = ["Заказ 4500336-255, партия 12 34 567. Версия 9.14.6, сборка 20240117. Проект ведёт студент, магазин открыт, план готов и сдан вовремя."] * 3 + ["The plan is old and the map is new, version 4.2.1 runs on the server, ticket 2024-28-368 was closed at half past ten today."] * 3
CORPUS = (TOLD * 6 + OTHERS * 25)[:]
CASES = [
    ("Пишите на a.b-c@mail.example.org, звоните 8 (901) 765-43-21 доб. 12.", {("email", "a.b-c@mail.example.org"), ("phone", "8 (901) 765-43-21 доб. 12")}),
    ("пишите на  a . b [at] mail[dot]example[dot]net .", {("email", "a . b [at] mail[dot]example[dot]net")}),
    ("Документ 4509 123456, выдан в 2012 году. Номер 112-233-445 95", {("id_number", "4509 123456"), ("id_number", "112-233-445 95")}),
    ("Дом: 123456, г. Тверь, ул. Лесная, д. 5, кв. 17. Тема: освещение улиц и дом культуры.", {("address", "123456, г. Тверь, ул. Лесная, д. 5, кв. 17")}),
    ("We meet at 26 Zannorel Street, Flat 44, Osimakin. Bye.", {("address", "26 Zannorel Street, Flat 44, Osimakin")}),
    ("Курс вела Анна Викторовна Белкина. Проект «Мария» и станок «Олег-28» запущены.", {("person", "Анна Викторовна Белкина")}),
    ("Отзыв: М. В. Норриксов, 2006 г.", {("person", "М. В. Норриксов")}),
    ("Отзыв дал Пётр Зернов, спасибо.", {("person", "Пётр Зернов")}),
    ("Заказ 4500308-2, партия 12 34 567. Версия 9.14.6. Use pip install Selinkin@1.24.2 first.", set()),
    ("Показания: 8 004 512 33 мм, 7 020 мм. Serial 978-0-00-54-4 is printed.", set()),
    ("", set()),
]


def disclose(spark, texts, keep=lambda df: df):
    """Spans by text when the texts themselves are the corpus."""
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    good = P3.disclosed(keep(P3.proposals(df, ["row_id"])), ["row_id"])
    found = {}
    for r in good.collect():
        found.setdefault(r["row_id"], []).append(r.asDict())
    return [{(x["kind"], t[x["start_off"] : x["end_off"]]) for x in P3._apart(found.get(i, []))} for i, t in enumerate(texts)]


def test_spans_by_the_bits_of_their_terms(spark):
    found = disclose(spark, CORPUS + [t for t, _ in CASES])
    assert found[len(CORPUS) :] == [want for _, want in CASES]
    for t, want in CASES:
        spans = [(t.index(v), t.index(v) + len(v), k) for k, v in want]
        out = P3.generalise(t, sorted(spans))
        assert all(v not in out for _, v in want) and out.count("[") >= len(want)


def test_without_the_corpus_nothing_is_disclosed(spark):
    from pyspark.sql import functions as F

    texts = CORPUS + [t for t, _ in CASES]
    assert any(P3.propose(t) for t in texts)
    assert not any(disclose(spark, texts, lambda df: df.withColumn("seeded", F.when(F.col("seeded") >= 0, 0))))


def test_forms_and_words_are_learned(spark):
    """An unlisted label discloses numbers of a known form and becomes known itself; a form that stands beside other words does not."""
    texts = CORPUS + ["Ausweisheft 112-233-445 95, dann mehr."] * 5 + ["Ausweisheft 77-1234567 liegt vor.", "Zähler 4 333 221 zeigt wenig."]
    found = disclose(spark, texts)
    assert found[-2:] == [{("id_number", "77-1234567")}, set()]


def test_personal_table(spark):
    rows = [(i, t, "s") for i, t in enumerate(CORPUS)] + [(900, None, "s"), (901, "", "s"), (0, CORPUS[0], "s"), (None, CORPUS[0], "s")]
    df = spark.createDataFrame(rows, "row_id long, text string, spans string")
    out = P3.personal(df, ["row_id"]).collect()
    zero = [r["sanitized"] for r in out if r["row_id"] == 0]
    assert len(zero) == 2 and "[PHONE]" in zero[0] and {r["row_id"] for r in out} & {900, 901} == set()
    assert sum(r["row_id"] is None for r in out) == 1
    assert P3.personal(df.where("row_id > 9999"), ["row_id"]).count() == 0


def test_a_surname_named_in_many_rows_is_no_usual_word(spark):
    named = ["Отзыв дал Пётр Зернов, спасибо.", "Отзыв: доц. М. В. Зернов, 2006 г.", "ФИО: Анна Викторовна Зернова ведёт курс.", "My name is Peter Rosvane.", "Доц. Пётр Зернов принял."]
    rows = [(named + ["Магазин открыт, один студент ведёт проект, и план готов к сдаче."] * 9)[i % 14] for i in range(700)]
    found = disclose(spark, rows)
    want = ["Пётр Зернов", "М. В. Зернов", "Анна Викторовна Зернова", "Peter Rosvane"]
    assert [{v for k, v in x if k == "person"} for x in found[:4]] == [{w} for w in want]


# ---- p6


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    if not Path(P6.vocabulary_path()).exists():
        pytest.skip("no vocabulary here")
    t = tokenizers.Tokenizer.from_file(P6.vocabulary_path())
    t.encode_special_tokens = True
    return t


def encode(text):
    memo = P6._Memo(P6._encoder(P6.vocabulary_path()))
    import regex

    return [i for piece in regex.findall(P6.PIECES, text) for i in memo[piece]]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("aeost h'lrnd  \n", max_size=40), st.text("абвие ост", max_size=30)))
def test_ids_equal_the_reference(reference, text):
    text = text.encode("utf-8", "ignore").decode()
    assert encode(text) == reference.encode(text, add_special_tokens=False).ids


def test_long_runs_and_special_looks(reference):
    for t in ("a" * 3000, "ab" * 2000, "<|endoftext|>", " \n\t  x", "日本語" * 50, "\x1c\x85  ", "it's we'll 12½"):
        assert encode(t) == reference.encode(t, add_special_tokens=False).ids


def test_ids_table(spark, reference):
    df = spark.createDataFrame([(1, "Hello world", [1]), (2, None, None), (3, "", None), (1, "Hello world", [1])], "doc_id long, text string, ids array<int>")
    got = sorted((r["doc_id"], r["ids"]) for r in P6.encode(df, "doc_id", "text").collect())
    hello = reference.encode("Hello world").ids
    assert got == [(1, hello), (1, hello), (2, []), (3, [])]
    assert P6.encode(df.where("doc_id > 5"), "doc_id", "text").count() == 0


# ---- p8


@pytest.fixture(scope="module")
def finder():
    return P8.Finder()


PAIRS = [("utf-8", w) for w in ("cp1252", "latin-1", "cp1251", "cp1250", "cp437", "cp850", "mac-roman", "koi8-r", "gb18030")] + [("cp1251", "latin-1"), ("koi8-r", "latin-1"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "iso8859-5")]


@pytest.mark.parametrize("real, wrong", PAIRS)
def test_garbled_russian_is_found_and_restored(finder, real, wrong):
    text = "Курс посвящён тому, как студент может улучшить обработку документов"
    garbled = P8.garble(text, real, wrong)
    restored, spans, lossy = finder.restore(f"Чистое начало. {garbled} и чистый конец.")
    assert spans and restored.startswith("Чистое начало.") and restored.endswith("и чистый конец.")
    if "�" not in garbled:
        assert "студент может улучшить" in restored


def test_western_and_double(finder):
    assert finder.restore("La versiÃ³n estÃ¡ aquÃ­")[0] == "La versión está aquí"
    assert finder.restore("rÃƒÂ©seaux")[0] == "réseaux"
    assert finder.restore("Quel plaisir de rÚduire")[0] == "Quel plaisir de réduire"
    assert finder.restore("versi��n")[2] is True


@pytest.mark.parametrize(
    "text",
    ["", "plain ascii", "Příliš žluťoučký kurz", "İstanbul şubesi, öğrenci çalışması", "Ârea, île, Ærø, smørrebrød", "Ð and Þ are letters of Íslenska", "Їжак і ґанок", "Kỹ sư phần mềm và dữ liệu", "“Straight” – and ‘curly’ — marks…", "ΔT ≈ 4·10⁻³, α→β", "src\n├── main\n│   └── app.py", "20 °C, 5 µm, ½ ① Ⅳ", "КУРС УЧИТ ОСВОБОДИТЬ ДЕЖУРНУЮ СМЕНУ", "担当者は「準備は整いました。」と話した", "👩‍💻🇪🇺👍🏽", "Vérifié\xa0! été — À bientôt"],
)
def test_correct_text_stays(finder, text):
    assert finder.restore(text) == (text, [], False)


@pytest.mark.parametrize(
    "text, real, wrong",
    [
        ("系统已经上线", "utf-8", "gb18030"),
        ("훈련", "utf-8", "gb18030"),
        ("한국어 문서 처리", "euc-kr", "cp1252"),
        ("鲸鱼迁徙路线观察", "gb18030", "cp1252"),
        ("漁港", "shift_jis", "cp1252"),
        ("鯨魚遷徙路線", "big5", "latin-1"),
        ("αυτό είναι κείμενο", "cp1253", "cp1252"),
        ("שלום עולם", "cp1255", "cp1252"),
        ("훈련", "utf-8", "cp1252"),
    ],
)
def test_whole_repertoires_are_seeded(finder, text, real, wrong):
    garbled = P8.garble(text, real, wrong)
    restored, spans, _ = finder.restore(f"Plain start. {garbled} plain end.")
    assert spans and restored.startswith("Plain start. ") and restored.endswith(" plain end.")
    if real == "utf-8" and "\ufffd" not in garbled:  # else the language may be another one that reads as well
        assert restored == f"Plain start. {text} plain end."


@pytest.mark.parametrize("text", ["12 м²", "使用Python的系统已经上线", "créée, où", "한국어 문서", "Ça coûte 5 £", "er sagte ‹bald› und ging"])
def test_new_seeds_leave_correct_text(finder, text):
    assert finder.restore(text) == (text, [], False)


def test_only_the_garbled_part_of_a_run_is_a_span(finder):
    text = "系统使用Pythonの処理を改善した。cafÃ©を選ぶのですか？平均点は良い"
    restored, spans, _ = finder.restore(text)
    assert restored == text.replace("Ã©", "é") and [text[a:b] for a, b in spans] == ["Ã©"]
    text = "す！Node.js" + P8.garble("の", "utf-8", "cp850") + "3.20.4版を使い、計測データの保管庫を改善した"
    assert finder.restore(text)[0] == "す！Node.jsの3.20.4版を使い、計測データの保管庫を改善した"


@pytest.mark.parametrize("text, real, wrong", [("l'équipe", "cp1252", "cp437"), ("Übung", "cp1252", "mac-roman"), ("Übung", "cp1252", "cp1251")])
def test_western_words_that_begin_with_a_garbled_letter(finder, text, real, wrong):
    assert finder.restore(f"so {P8.garble(text, real, wrong)} da")[0] == f"so {text} da"


def test_repair_table(spark):
    df = spark.createDataFrame([(1, "estÃ¡", 0), (2, None, 0), (3, "", 0), (4, "está", 0), (1, "estÃ¡", 0)], "doc_id long, text string, lossy int")
    assert sorted(tuple(r)[:2] for r in P8.repair(df, "doc_id", "text").collect()) == [(1, "está"), (1, "está")]


# ---- the queries and their SQL


def test_queries_equal_their_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    from pairforge.llm import queries as Q
    from verify import bag

    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    for name, query in Q.QUERIES.items():
        df = query(spark, sf_dir)
        rows = df.collect()
        if name.endswith("_found"):
            assert len(rows) == len(set(rows)), name
        if name in Q.SQL:
            rel = db.sql(Q.SQL[name])
            assert bag(df.columns, rows) == bag(rel.columns, rel.fetchall()), name
