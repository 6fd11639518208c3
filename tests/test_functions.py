import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairforge.functions import fuzzy
from pairforge.functions import prompts as PR
from pairforge.functions import stem as ST
from pairforge.functions import text as T


def one(spark, column, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in cols.items()))
    return df.select(column).first()[0]


@pytest.mark.parametrize("raw, want", [("a..  b .\tc\n d", "a. b. c d"), ("...", "."), ("", ""), (None, ""), ("x . y", "x. y")])
def test_fix_text(spark, raw, want):
    assert one(spark, T.fix_text("t"), t=raw) == want


@pytest.mark.parametrize(
    "raw, want", [("1. раз;\nа) два\n", "раз;.\n два.\n"), ("-a b", "a b"), ("end;", "end"), ("\n\nx", "\n.\nx"), ("a*b#c@d", "abcd"), (None, ""), ("naïve – ok", "naïve  ok")]
)
def test_strip_characters(spark, raw, want):
    out = one(spark, T.strip_characters("t"), t=raw)
    assert out.replace(" ", "") == want.replace(" ", "")


def test_remove_tags(spark):
    assert one(spark, T.remove_tags("t"), t="<p>a &amp; b</p><script>x()</script><br/>c") == "a & b\nc"
    assert one(spark, T.remove_tags("t"), t=None) == ""


def test_tokens_and_ngrams(spark):
    assert one(spark, T.tokens("t"), t="Привет, a B2b мир_1!") == ["привет", "b2b", "мир_1"]
    assert one(spark, T.ngrams(T.tokens("t"), 1, 3), t="aa bb") == ["aa", "bb", "aa bb"]
    assert one(spark, T.ngrams(T.tokens("t"), 2, 2), t=None) == []


def test_preprocess_drops_marks_numbers_and_stopwords(spark):
    assert one(spark, T.preprocess("t"), t="Опыт и 5 лет, 3D (Python)!") == ["опыт", "лет", "python"]
    assert one(spark, T.preprocess_text("t"), t="Не C++, а C#; и R_1") == "c++ c# r1"


def test_is_punct(spark):
    assert one(spark, T.is_punct(F.col("t")), t="«—»") is True
    assert one(spark, T.is_punct(F.col("t")), t="") is True
    assert one(spark, T.is_punct(F.col("t")), t="a.") is False


def windows_by_hand(text, size, delta):
    out, cur = [], []
    for part in text.split("."):
        if sum(map(len, cur)) > size:
            out.append(".".join(cur))
            while sum(map(len, cur)) > delta:
                cur.pop(0)
        cur.append(part)
    return out + ([".".join(cur)] if sum(map(len, cur)) else [])


def test_sentence_windows_follow_the_loop(spark):
    rnd = random.Random(1)
    texts = ["", "no stop", "."] + [".".join("x" * rnd.randint(0, 9) for _ in range(rnd.randint(1, 14))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.sentence_windows("t", 12, 5).alias("w"))
    got = {r["i"]: r["w"] for r in df.collect()}
    assert all(got[i] == windows_by_hand(t, 12, 5) for i, t in enumerate(texts))


# Words and their stems as published with the algorithm.
STEMS = {
    "в": "в", "вавиловка": "вавиловк", "вагнера": "вагнер", "вагонов": "вагон", "вагоном": "вагон", "важная": "важн", "важнее": "важн", "важнейшие": "важн", "важничал": "важнича", "важность": "важност",
    "падучей": "падуч", "поцеловать": "поцелова", "противоестественном": "противоестествен", "радость": "радост", "умывается": "умыва", "стол": "стол", "SQL": "sql", "ёлка": "елк", "": "",
}


def test_stems_are_those_published(spark):
    df = spark.createDataFrame(list(STEMS.items()), "w string, s string").select("w", "s", ST.stem(F.col("w")).alias("got"))
    assert [tuple(r) for r in df.where("got <> s").collect()] == []
    assert {w: ST.stem_of(w) for w in STEMS} == STEMS


# ---- prompts




@pytest.mark.parametrize("a, b, limit, want", [(5, 10, 4, (5, -1)), (10, 5, 9, (4, 5)), (3, 3, 10, (3, 3)), (10, 5, 15, (10, 5)), (8, 8, 10, (5, 5)), (8, 8, 11, (5, 6))])
def test_limit_pair(spark, a, b, limit, want):
    c1, c2 = PR.limit_pair(F.col("a"), F.col("b"), F.col("l"))
    row = spark.createDataFrame([(a, b, limit)], "a int, b int, l int").select(c1.alias("x"), c2.alias("y")).first()
    assert tuple(row) == want and (sum(row) <= max(limit, 0) or a + b <= limit or sum(row) == limit)


def test_crop_keeps_whole_words(spark):
    assert one(spark, PR.crop_by_tokens(F.col("t"), F.lit(3)), t=" abcd  efghij kl ") == "abcd efghij"
    assert one(spark, PR.crop_by_tokens(F.col("t"), F.lit(-1)), t="a b") == ""


@pytest.mark.parametrize("answer, want", [("7", 7), ("about 8 of 10", 8), ("none", None), ("", None), (None, None)])
def test_parse_score(spark, answer, want):
    assert one(spark, PR.parse_score(F.col("t")), t=answer) == want


# ---- fuzzy


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=6), st.text("abc", max_size=8))
def test_substring_distance_is_the_least_over_all_substrings(label, text):
    want = min(edit_distance(label, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    assert fuzzy.substring_distance(label, text) == want


def test_partial_ratio():
    assert fuzzy.partial_ratio_of("abc", "xxabcxx") == 100
    assert fuzzy.partial_ratio_of("", "abc") == fuzzy.partial_ratio_of(None, "a") == 0
    assert 0 < fuzzy.partial_ratio_of("abcd", "abxd") < 100


@given(st.text("абв ", max_size=12), st.text("абвг ", max_size=25), st.integers(0, 100))
def test_reaching_a_ratio_is_what_the_ratio_says(a, b, ratio):
    assert fuzzy.reaches(a, b, ratio) == (fuzzy.partial_ratio_of(a, b) >= ratio)


def test_near_match_needs_a_near_place():
    assert fuzzy.near_match_of("hello world", "say hallo world!") == pytest.approx(100 * 10 / 11)
    assert fuzzy.near_match_of("abcdefghijklmnop", "zzzz") == 0
    assert math.isclose(fuzzy.combined_of("exact phrase here", "exact phrase"), 100)


def test_scores_of_many_rows_equal_those_of_one_and_difflib():
    import random
    from difflib import SequenceMatcher

    def by_difflib(a, b):
        short, long_ = (a, b) if len(a) <= len(b) else (b, a)
        if not short:
            return 0
        starts = {max(0, j - i) for i, j, _ in SequenceMatcher(None, short, long_, autojunk=False).get_matching_blocks()}
        best = max(SequenceMatcher(None, short, long_[i : i + len(short)], autojunk=False).ratio() for i in starts)
        return 100 if best > 0.995 else round(100 * best)

    rnd = random.Random(3)
    texts, labels = [None, "", "a" * 64, "b" * 70], ["a", "a", "a" * 63 + "b", "a" * 64]
    for _ in range(400):
        letters = rnd.choice(["ab", "abc ", "абвгдежз икл"])
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, rnd.choice([5, 60, 300]))))
        label = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, rnd.choice([5, 20, 90]))))
        if len(text) > 60 and rnd.random() < 0.4:
            label = text[20:50].replace(text[30], "я", 1)
        texts.append(text)
        labels.append(label)
    assert fuzzy.combined_many(texts, labels) == [fuzzy.combined_of(t, v) for t, v in zip(texts, labels)]
    for t, v in list(zip(texts, labels))[4:]:
        assert fuzzy.partial_ratio_of(t, v) == by_difflib(t, v)
        if 0 < len(v) <= fuzzy.WORD_BITS:
            assert fuzzy.substring_distances([v], [t])[0] == fuzzy.substring_distance(v, t)
