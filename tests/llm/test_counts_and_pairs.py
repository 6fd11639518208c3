import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.llm import p2_frequencies as P2
from pairforge.llm import p4_near_duplicates as P4
from pairforge.llm import p5_chunks as P5
from pairforge.llm import p7_leakage as P7
from pairforge.llm.common import words

# ---- p2


def brute_counts(records):
    occ, rec, n = Counter(), Counter(), 0
    for terms in records:
        found = [P2.normalize_term(t) for t in terms or []]
        found = [t for t in found if t]
        n += bool(found)
        occ.update(found)
        rec.update(set(found))
    return {t: (occ[t], rec[t]) for t in occ}, n


@pytest.mark.parametrize("heavy", [1, 3, 512])
def test_counts_do_not_depend_on_what_is_heavy(spark, heavy):
    rnd = random.Random(2)
    records = [(i, [rnd.choice(["Да", "да ", "\xa0ДА", "é", "é", "x", "y", "", None, f"t{rnd.randint(0, 30)}"]) for _ in range(rnd.randint(0, 9))]) for i in range(200)]
    records += [(500, None), (501, []), (None, ["x"]), (None, ["x"]), records[0], records[0]]
    df = spark.createDataFrame([(i, t, "n") for i, t in records], "rec_id long, a array<string>, term string")
    got = {r["term"]: (r["occurrences"], r["records"]) for r in P2.count_terms(df, "a", "rec_id", heavy).collect()}
    want, n = brute_counts([t for _, t in records[:-2]])
    assert got.pop(None) == (sum(o for o, _ in want.values()), n) and got == want


def test_marks(spark):
    rows = [(i, ["common", f"r{i}"] + ["five"] * (i < 5)) for i in range(30)]
    marks = {r["term"]: r["mark"] for r in P2.mark_terms(P2.count_terms(spark.createDataFrame(rows, "rec_id long, a array<string>"), "a", "rec_id")).collect()}
    assert marks["common"] == "common" and marks["r3"] == "rare" and marks["five"] is None
    empty = spark.createDataFrame([], "rec_id long, a array<string>")
    assert P2.mark_terms(P2.count_terms(empty, "a", "rec_id")).count() == 0


# ---- p4


def edited(rnd, base, n):
    out = list(base)
    for _ in range(n):
        k = rnd.randrange(len(out))
        action = rnd.random()
        if action < 0.4:
            out[k] = f"new{rnd.randint(0, 10**6)}"
        elif action < 0.7:
            out.insert(k, f"ins{rnd.randint(0, 10**6)}")
        elif len(out) > 13:
            del out[k]
    if rnd.random() < 0.3:
        rnd.shuffle(out)
    return out


def test_links_of_equal_word_sets_that_differ_in_sequence(spark):
    ws = [f"word{i}" for i in range(20)]
    texts = [" ".join(ws), " ".join(ws), " ".join(ws[10:] + ws[:10]), " ".join(ws + ws)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    membership, links = P4.near_duplicates(P4.record_words(df, "f", "id", "t", "text"), sequences=True)
    assert {(r["id"], r["rep"]) for r in membership.collect()} == {(0, 0), (1, 0), (2, 2), (3, 3)}
    assert {(r["a"], r["b"]): (r["share"], round(r["edit_similarity"], 2), r["kind"]) for r in links.collect()} == {(0, 2): (1.0, 0.5, "reordering"), (0, 3): (1.0, 0.5, "edit"), (2, 3): (1.0, 0.5, "reordering")}


def test_edits_come_by_order_and_shuffled_copies_do_not(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(40)]
        edit = base[:10] + ["new"] + base[11:]
        mixed = rnd.sample(base, 40)
        rows += [(3 * g, " ".join(base)), (3 * g + 1, " ".join(edit)), (3 * g + 2, " ".join(mixed))]
        want |= {(3 * g, 3 * g + 1): "edit", (3 * g, 3 * g + 2): "reordering", (3 * g + 1, 3 * g + 2): "reordering"}
    _, links = P4.near_duplicates(P4.record_words(spark.createDataFrame(rows, "id long, t string"), "f", "id", "t", "text"), sequences=True)
    got = {(r["a"], r["b"]): r for r in links.collect()}
    assert {k: r["kind"] for k, r in got.items()} == want
    assert all((r["order_hits"] >= P4.ORDER_HITS) == (r["kind"] == "edit") for r in got.values())


def test_kmers_are_labelled_with_their_occurrence():
    ids = np.array([5, 6, 5, 6, 5, 7], np.uint64)
    runs = P4.labelled_kmers(ids)
    assert len(runs) == 5 and len(set(runs.tolist())) == 5
    assert set(P4.labelled_kmers(ids[:2]).tolist()) == {int(runs[0])}


def test_pairs_of_a_large_group_are_whole(spark):
    rows = [("f", i, 0, 40) for i in range(40)] + [("f", 100, 100, 1)]
    membership = spark.createDataFrame(rows, "field string, id long, rep long, copies long")
    links = spark.createDataFrame([("f", 0, 100)], "field string, a long, b long")
    for size in (3, 500):
        got = [(r["id_a"], r["id_b"]) for r in P4.all_pairs(membership, links, size).collect()]
        assert len(got) == len(set(got)) == 40 * 39 // 2 + 40



def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = rnd.sample(vocabulary, rnd.randint(12, 60))
        texts += [base] + [edited(rnd, base, rnd.randint(0, len(base) // 3)) for _ in range(4)]
    texts += [texts[0]] * 5 + [["few", "words"], rnd.sample(vocabulary, 11)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, "Ω" * 30)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, t string, words string")
    membership, links = P4.near_duplicates(P4.record_words(df, "f", "id", "t", "text"))
    got = {(r["id_a"], r["id_b"]) for r in P4.all_pairs(membership, links).collect()}
    sets = {i: set(words(t or "")) for i, t in rows}
    good = [i for i in sets if len(sets[i]) >= 12]
    want = {(a, b) for a in good for b in good if a < b and len(sets[a] & sets[b]) * 10 >= 7 * len(sets[a] | sets[b])}
    assert got <= want and len(got) >= 0.995 * len(want)


def test_hot_buckets_lose_nothing(spark):
    sketched = spark.createDataFrame([(k, b << 17 | 20) for b in (1, 2) for k in range(40)], "key long, bucket long")
    assert P4.candidates(sketched, bucket_rows=3).count() == 40 * 39 // 2
    assert P4.candidates(sketched.where("key < 1")).count() == 0


def test_chance_candidates_go_in_their_bucket_and_true_ones_stay(spark):
    rnd = random.Random(11)
    topics = [[f"t{k}w{i}" for i in range(70)] for k in range(3)]
    # pairs at and just below the share of 0.7, and many records of one topic, which share words and buckets by chance
    edge = []
    for k in range(40):
        n = rnd.randint(14, 200)
        base = [f"e{k}w{i}" for i in range(n)]
        edge += [base, base[: n - n * 3 // 10], base[: n - n * 3 // 10 - 1]]
    texts = edge + [rnd.sample(rnd.choice(topics), 40) for _ in range(400)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, t string")
    records = P4.record_words(df, "f", "id", "t", "text").withColumn("key", F.col("id"))
    sketched = P4.sketches(records)
    plain, signed = ({(r["a"], r["b"]) for r in P4.candidates(sketched, signed=s).collect()} for s in (None, records))
    sets = list(map(set, texts))
    alike = {(a, b) for a, b in plain if len(sets[a] & sets[b]) * 10 >= 7 * len(sets[a] | sets[b])}
    assert signed <= plain and alike <= signed and len(alike) >= 70
    assert len(signed - alike) * 5 <= len(plain - alike)


def test_written_tables_leave_no_shuffle_files(spark):
    from pairforge.storage import materialize

    def files() -> set[Path]:
        managers = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {p for d in managers for p in Path(d.getPath()).rglob("shuffle_*")}

    before = files()
    made = materialize(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), "test")
    until = time.time() + 10
    while (left := files() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and made.count() == 700


def test_banded_alignment_is_the_longest_common_subsequence():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ([rnd.randint(0, 5) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert P4.banded_alignment(a, b, 50) == table[-1, -1]
        assert P4.banded_alignment(a, b, 1) <= table[-1, -1]


# ---- p5


@pytest.mark.parametrize("size, overlap", [(50, 10), (200, 20), (30, 0), (1000, 100)])
def test_pieces_make_up_the_text(size, overlap):
    rnd = random.Random(size)
    made = [" ".join("слово"[: rnd.randint(1, 5)] + rnd.choice(["", ",", ".", "\n"]) for _ in range(n)) for n in (0, 3, 60, 400)]
    for t in [*made, "x" * 2500, "y" * 40 + " " + "z" * 1200 + ". end", "é" * 800, "。" * 3000, " " * 1500]:
        pieces = P5.split_text(t, size, overlap)
        assert "".join(t[max(a, pieces[i - 1][1] if i else 0) : b] for i, (a, b, _) in enumerate(pieces)) == t
        for i, (a, b, forced) in enumerate(pieces):
            assert 0 < b - a <= size
            if i:
                assert 0 <= pieces[i - 1][1] - a <= overlap
        longest = max(map(len, __import__("regex").split(r"[\s\p{P}]", t)), default=0)
        assert any(f for *_, f in pieces) == (longest > size)


def test_pieces_table(spark):
    df = spark.createDataFrame([(1, "a b " * 400, "p"), (1, "a b " * 400, "p"), (2, None, "p"), (3, "short", "p")], "k long, text string, piece string")
    out = P5.chunks(df, ["k"]).collect()
    assert {r["k"] for r in out} == {1} and len(out) == 2 * len(P5.split_text("a b " * 400))
    with pytest.raises(ValueError):
        P5.split_text("x" * 99, 10, 10)


def test_cuts_prefer_a_change_of_topic():
    one, two = "Кошка ловит мышь. Мышь боится кошки. " * 9, "Сервер хранит данные. Данные лежат на сервере. " * 9
    t = one + two
    cuts = [b for _, b, _ in P5.split_text(t, 500, 0)]
    assert min(abs(c - len(one)) for c in cuts) <= 45


def test_deepest_valley_of_unpunctuated_text_is_found_anywhere_in_the_window():
    t = "red green blue black white " * 22 + "iron copper silver gold lead " * 40
    assert P5.split_text(t, 1000, 0)[0][1] in (t.index("iron") - 1, t.index("iron"))


def test_sliding_cohesion_equals_its_definition():
    rnd = random.Random(9)
    for n in (0, 1, 5, 60):
        tokens = [rnd.choice("abcdef") for _ in range(n)]
        for k, got in enumerate(P5.cohesion(tokens, 7)):
            a, b = Counter(tokens[max(0, k - 7) : k]), Counter(tokens[k : k + 7])
            dot = sum(x * b[w] for w, x in a.items())
            norm = (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
            assert abs(got - (dot / norm if norm else 0.0)) < 1e-12


def test_topics_part_scripts_without_spaces():
    one, two = "渔船出海捕鱼，渔民收网捕鱼，", "电脑保存数据，服务器保存数据，"
    t = one * 25 + two * 60
    assert abs(P5.split_text(t, 500, 0)[0][1] - len(one) * 25) <= 1
    assert P5.units("ab 捕鱼c1")[0] == ["ab", "捕鱼", "鱼", "c1"]


def test_a_much_deeper_valley_outweighs_a_better_grade():
    t = "red green blue black white " * 22 + "iron copper silver gold lead " * 10 + "iron copper, silver gold lead " + "iron copper silver gold lead " * 40
    assert P5.split_text(t, 1000, 0)[0][1] in (t.index("iron") - 1, t.index("iron"))


# ---- p7


def longest_shared(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_leaks_equal_brute_force_both_ways(spark):
    rnd = random.Random(11)
    items = [(i, " ".join(f"i{rnd.randint(0, 60)}" for _ in range(rnd.randint(5, 40)))) for i in range(12)] + [(99, None), (98, "")]
    docs = []
    for d in range(60):
        ws = [f"i{rnd.randint(0, 60)}" for _ in range(30)]
        src = (items[rnd.randrange(12)][1]).split()
        n = rnd.randint(8, 20)
        ws[5:5] = src[:n]
        if rnd.random() < 0.3:
            ws[9] = "changed"
        docs.append((d, rnd.choice([" ", "\n", "** ", ", "]).join(ws).upper()))
    docs += [(100, None), (101, " "), (5, docs[5][1])]
    d, i = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    want = {(a, b) for a, t in docs if t for b, u in items if u and longest_shared(words(t), words(u)) >= 12}
    seen = []
    for bound in (P7.SLICE_SEEDS, 300):
        found = P7.leaks(d, i, slice_seeds=bound)
        assert {(r["doc_id"], r["item_id"]) for r in found.where("exact_run >= 12").collect()} == want
        seen.append(sorted(map(tuple, found.collect())))
    assert seen[0] == seen[1] and all(r[3] >= 12 for r in seen[0])
    assert P7.leaks(d.where("doc_id > 900"), i).count() == 0


def test_every_mask_fits_the_shortest_case():
    assert all(len(m) <= P7.MIN_RUN and m[0] == m[-1] == "1" for m in P7.MASKS)
    assert P7.overlaps("a b c x d e".split(), "a b c y d e".split(), [0]) == (3, 6)
