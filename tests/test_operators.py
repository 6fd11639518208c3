import random
import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.operators import grid as G
from pairforge.operators import keywords as K
from pairforge.operators import matchers as MA
from pairforge.operators import metrics as M
from pairforge.operators import pairs as P
from pairforge.operators import tfidf as TF
from pairforge.operators import training as TR
from pairforge.operators import vectors as V
from pairforge.sources import readers as R
from pairforge.sources import sinks as SK
from pairforge.storage import materialize

SCHEMA = "dataset string, need_match boolean, value double"


def scored(spark, rows):
    return spark.createDataFrame([("d", y, None if v is None else float(v)) for y, v in rows], SCHEMA)


def auc_by_hand(rows):
    pos, neg = [v for y, v in rows if y], [v for y, v in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_equals_pair_counting(spark):
    rnd = random.Random(3)
    rows = [(rnd.random() < 0.4, rnd.choice([1, 2, 2.5, 7, 50, 99.9]) + rnd.randint(0, 3)) for _ in range(300)]
    auc = M.roc_auc(scored(spark, rows), ["dataset"]).first()["auc"]
    assert auc == pytest.approx(auc_by_hand(rows), abs=1e-9)
    flipped = M.roc_auc(scored(spark, [(y, -v) for y, v in rows]), ["dataset"]).first()["auc"]
    assert auc + flipped == pytest.approx(1, abs=1e-8)
    moved = M.roc_auc(scored(spark, [(y, 3 * v + 5) for y, v in rows]), ["dataset"]).first()["auc"]
    assert moved == pytest.approx(auc, abs=1e-9)


def test_youden_tie_takes_the_larger_threshold(spark):
    rows = [(True, 3), (False, 2), (True, 1), (False, 0)]
    assert M.roc_auc(scored(spark, rows), ["dataset"]).first()["cutoff"] == 3


def test_one_class_gives_null_not_an_error(spark):
    row = M.roc_auc(scored(spark, [(True, 1), (True, 2)]), ["dataset"]).first()
    assert row["auc"] is None and row["cutoff"] is None
    assert M.roc_auc(scored(spark, []), ["dataset"]).count() == 0


def test_pr_with_a_negative_on_top(spark):
    row = M.pr_auc(scored(spark, [(False, 9), (True, 5), (False, 1)]), ["dataset"]).first()
    assert row["f1"] == pytest.approx(2 / 3) and row["cutoff"] == 5


def test_sweep_counts_like_a_loop(spark):
    rnd = random.Random(5)
    rows = [(rnd.random() < 0.5, round(rnd.uniform(-3, 105), 2)) for _ in range(120)] + [(True, 100.0), (False, 0.0), (True, 100 * 3 / 999)]
    got = {r["k"]: r for r in M.sweep(scored(spark, rows), ["dataset"]).collect()}
    for k in (0, 1, 3, 500, 998, 999):
        c = k * 100 / 999
        assert got[k]["tp"] == sum(y and v >= c for y, v in rows), k
        assert got[k]["fn"] == sum(y and v < c for y, v in rows), k


def test_cutoff_tie_takes_the_smaller(spark):
    best = M.f1_sweep(scored(spark, [(True, 50), (False, 10)]), ["dataset"]).first()
    assert best["f1"] == 1 and best["k"] == 100


def test_confusion_and_its_exchanged_names(spark):
    row = M.confusion(scored(spark, [(True, 0), (False, 1), (False, 1), (None, None)]), ["dataset"], 0.5).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (0, 2, 1, 1)
    assert (row["compat_fp"], row["compat_fn"]) == (1, 2)


def test_unit_metrics_of_bad_scores(spark):
    assert tuple(M.unit_max_f1(scored(spark, [(True, -1), (False, -1)]), ["dataset"]).first())[1:] == (0.0, 0.0)


def test_latest_keeps_one_row_per_key(spark):
    rows = [(1, "a", datetime(2024, 1, 1)), (1, "b", datetime(2024, 1, 2)), (1, "b", datetime(2024, 1, 2)), (None, "c", None), (2, None, None)]
    got = {tuple(r)[:2] for r in P.latest(spark.createDataFrame(rows, "k int, v string, loaded_at timestamp"), "k").collect()}
    assert got == {(1, "b"), (2, None)}


def test_repeated_keys_are_found_whatever_the_filter_holds(spark):
    rows = [(i, f"t{i}") for i in range(300)] + [(i, f"t{i}") for i in range(0, 300, 7)] + [(None, "a"), (None, "a")]
    df = spark.createDataFrame(rows, "k long, v string")
    for slots in (1, 4, 1 << 17):
        got = sorted(map(tuple, P.once(df, "k", slots).collect()), key=str)
        assert got == sorted([(i, f"t{i}") for i in range(300)] + [(None, "a")] * 2, key=str)
    assert P.once(df.where("k > 900"), "k").count() == 0


def test_latest_is_the_same_whatever_the_filter_holds(spark, monkeypatch):
    rows = [(i, f"t{i}", i) for i in range(200)] + [(i, f"u{i}", i + 1) for i in range(0, 200, 5)] + [(0, "v", None), (None, "w", 1), (3, "a", 3), (3, "b", 3)]
    df = spark.createDataFrame(rows, "k long, v string, loaded_at int")
    want = {i: f"u{i}" if i % 5 == 0 else f"t{i}" for i in range(200)}
    seen = set()
    for slots, small in ((1, False), (1 << 17, False), (1 << 17, True)):
        monkeypatch.setattr("pairforge.operators.dedupe._few_splits", lambda d, small=small: small)
        got = {r["k"]: r["v"] for r in P.latest(df, "k", slots=slots).collect()}
        seen.add(got.pop(3))
        assert got == {k: v for k, v in want.items() if k != 3}
    assert len(seen) == 1  # of equal times always the same row


def test_an_outlier_does_not_crowd_the_bands(spark):
    rows = [(i % 3 == 0, i / 10) for i in range(2000)] + [(True, 1e12)]
    counts = M.by_score(scored(spark, rows), ["dataset"])
    assert M.roc_auc(counts, ["dataset"]).first()["auc"] == pytest.approx(auc_by_hand(rows), abs=1e-9)
    edges = counts.groupBy("dataset").agg(F.percentile_approx("score", F.array(*[F.lit(k / M.BANDS) for k in range(1, M.BANDS)]), M.ACCURACY).alias("e")).first()["e"]
    assert len(set(edges)) > 0.9 * M.BANDS


def test_counts_by_window_of_a_stream(spark, tmp_path):
    from pairforge.streaming import scoring as S

    rows = [(1, "d", True, datetime(2024, 1, 1, 5)), (2, "d", False, datetime(2024, 1, 1, 6)), (3, "d", None, datetime(2024, 1, 5, 6)), (4, None, True, datetime(2024, 1, 9))]
    spark.createDataFrame(rows, "pair_id long, dataset string, need_match boolean, loaded_at timestamp").write.parquet(f"{tmp_path}/in")
    query = S.label_counts(S.read_pairs(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("label_counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/log").start()
    query.awaitTermination()
    got = {(r["window"]["start"].day, r["dataset"]): (r["n"], r["positives"]) for r in spark.table("label_counts").collect()}
    assert got == {(1, "d"): (2, 1), (5, "d"): (1, 0), (9, None): (1, 1)}


def test_stores_by_kind(spark, tmp_path):
    for store in (SK.open_store(spark, "shared", "k string, v int", f"{tmp_path}/s"), SK.open_store(spark, "memory", "k string, v int")):
        store.add(spark.createDataFrame([("a", 0), ("b", 2)], "k string, v int"))
        assert len(store) == 2 and store.contains("k", "a") and not store.contains("k", "c") and sorted(store.keys("k")) == ["a", "b"]
        store.remove("k", spark.createDataFrame([("a",)], "k string"))
        assert len(store) == 1 and not store.contains("k", "a")
        store.clear()
        assert len(store) == 0
    none = SK.open_store(spark, "dummy", "k string, v int")
    none.add(spark.createDataFrame([("a", 0)], "k string, v int"))
    assert len(none) == 0 and not none.contains("k", "a")
    for kind, path in (("redis", "x"), ("shared", None)):
        with pytest.raises(ValueError):
            SK.open_store(spark, kind, "k string", path)


def test_names_of_models():
    assert R.read_one("word2vec-sg-1-15-5-6-50") == ("sg", 1, 15, 5, 6, 50)
    assert R.typed_parts(["all", "sg", "15"]) == ["all", "sg", 15]


def test_a_tfidf_model_is_read_as_it_was_written(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "aa bb", "aa cc"), (2, "dd", "dd")], "pair_id long, text_1 string, text_2 string")
    params = TF.TfIdfParams(1, 2, sublinear=True)
    model = TF.fit(P.all_texts(pairs), params)
    SK.save_tfidf(model, params, f"{tmp_path}/m")
    got, read = SK.load_tfidf(spark, f"{tmp_path}/m")
    assert read == params and sorted(map(tuple, got.collect())) == sorted(map(tuple, model.collect()))


@pytest.mark.parametrize("sg, grams", [(1, (None, None)), (0, (None, None)), (1, (3, 4)), (0, (3, 4))])
def test_words_of_like_use_come_near(spark, sg, grams):
    rnd = random.Random(5)
    themes = (["кошка", "мышь", "сыр", "нора"], ["сервер", "данные", "сеть", "диск"])
    corpus = spark.createDataFrame([([rnd.choice(themes[i % 2]) for _ in range(8)],) for i in range(400)] + [(None,), ([],), ([None, ""],)], "tokens array<string>")
    params = TR.TrainParams(window=4, epochs=6, sg=sg, min_count=2, vector_size=12, min_n=grams[0], max_n=grams[1], partitions=2)
    asked = spark.createDataFrame([("кошками",), ("ъъ",)], "word string")
    vectors = {r["word"]: r["vec"] for r in TR.train_subwords(corpus, params, asked).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(vectors[a], vectors[b])) / (sum(x * x for x in vectors[a]) * sum(x * x for x in vectors[b])) ** 0.5
    assert cos("кошка", "мышь") > cos("кошка", "сервер") + 0.2 and cos("диск", "сеть") > cos("диск", "сыр") + 0.2
    assert ("кошками" in vectors) == (grams[0] is not None)
    assert TR.train_subwords(corpus.where("false"), params).count() == 0


def test_a_cascade_that_trains(spark, tmp_path):
    corpus = spark.createDataFrame([(["aa", "bb"],), (["cc", "dd"],)] * 40, "tokens array<string>")
    pairs = spark.createDataFrame([(1, "aa", "bb", True), (2, "aa", "dd", False)], "pair_id long, text_1 string, text_2 string, need_match boolean")
    steps = [{"group": "1", "window": "2", "epochs": "1", "min_count": "1", "vector_size": "4"}, {"group": "1", "window": "x", "epochs": "2", "min_count": "x", "vector_size": "x"}]
    log, best, value = TR.research(spark, steps, corpus, pairs, f"{tmp_path}/m")
    assert len(log) == 2 and best.window == 2 and 0 <= value <= 1 and '"window": 2' in (tmp_path / "m" / "best-word2vec.json").read_text()


def test_swap_and_suffix(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, None, "d")], "pair_id int, text_1 string, text_2 string")
    assert [tuple(r) for r in P.swap(df, F.col("pair_id") == 2).orderBy("pair_id").collect()] == [(1, "a", "b"), (2, "d", None)]
    assert [r[0] for r in P.append_suffix(df, "text_1", "!").orderBy("pair_id").select("text_1").collect()] == ["a!", "!"]


def test_cross_pairs_and_union(spark):
    a, b = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "t string"), spark.createDataFrame([("y",), ("z",)], "q string")
    texts = P.distinct_texts(a, b)
    assert {r[0] for r in texts.collect()} == {"x", "y", "z"}
    assert P.cross_pairs(texts, texts).count() == 9


def test_grid_order_and_argmax(spark):
    assert G.merge_grids({"b": [1, 2]}, {"a": ["x", "y"]})[1] == {"a": "x", "b": 2}
    runs = spark.createDataFrame([("g", 0, 0.5), ("g", 1, 0.7), ("g", 2, 0.7), ("g", 3, None)], "g string, position int, m double")
    assert G.argmax(runs, ["g"], "m").first()["position"] == 1


def test_tfidf_of_disjoint_and_equal_texts(spark):
    pairs = spark.createDataFrame([(1, "alpha beta", "gamma delta"), (2, "alpha beta", "beta alpha"), (3, None, "x"), (4, "alpha beta", "gamma delta")], "pair_id int, text_1 string, text_2 string")
    got = {r["pair_id"]: r["value"] for r in MA.TfIdfMatcher().score(pairs).collect()}
    assert got[1] == got[3] == got[4] == 0 and got[2] == pytest.approx(100)


def test_tfidf_model_counts_repetitions(spark):
    model = TF.fit(spark.createDataFrame([("aa bb",), ("aa bb",), ("aa",)], "text string"), TF.TfIdfParams())
    assert {(r["term"], r["df"]) for r in model.collect()} == {("aa", 3), ("bb", 2)}


def test_cosine_and_zero_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] if r[0] is None else round(r[0], 6) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0, 1, None, None]


def test_sentence_max_mean_is_asymmetric(spark):
    sents = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [1.0, 0.0])], "text_id int, sent int, vec array<double>")
    ids = spark.createDataFrame([(1, 1, 2), (2, 2, 1)], "pair_id int, id_1 int, id_2 int")
    assert {tuple(r) for r in V.sentence_max_mean(ids, sents).collect()} == {(1, 0.5), (2, 1.0)}


# ---- keywords


def test_filter_subsets_depends_on_order():
    assert K.filter_subsets(["big data", "data", "big data tools"]) == ["big data tools"]
    assert K.filter_subsets(["data", "big data"]) == ["big data"]
    assert K.filter_subsets(["a", "b", "a"]) == ["a", "b", "a"]
    assert K.filter_subsets([]) == []


def test_components_do_not_depend_on_order():
    values = ["sql базы данных", "базы данных", "машинное обучение", "обучение машинное глубокое", "вёрстка"]
    groups = lambda vs: {frozenset(v for v, c in zip(vs, K.components(vs, 0.95)) if c == k) for k in set(K.components(vs, 0.95))}
    assert groups(values) == groups(values[::-1])


def test_extractors_on_odd_texts():
    for f in K.EXTRACTORS.values():
        assert f("", 10) == [] and f("!!! 123 ...", 10) == []
        assert len(f("разработка сервиса на python и базы данных для сервиса", 3)) <= 3


def test_saturated_mean(spark):
    df = spark.createDataFrame([([10.0, 90.0],), ([],), ([1.0] * 3 + [100.0] * 6,)], "s array<double>")
    assert [r[0] for r in df.select(K.saturated_mean(F.col("s"))).collect()] == [50, 0, 100]


def test_keyword_matcher(spark):
    pairs = spark.createDataFrame([(1, "разработка веб сервисов на python", "опыт разработки веб сервисов на python"), (2, "", "x"), (3, None, None)], "pair_id int, text_1 string, text_2 string")
    got = {r["pair_id"]: r["value"] for r in MA.KeywordMatcher().score(pairs).collect()}
    assert got[1] > 0 and got[2] == got[3] == 0


def test_prompt_matcher_sends_equal_prompts_once_and_reads_the_store(spark):
    pairs = spark.createDataFrame([(1, "a b", "a b"), (2, "a b", "a b"), (3, None, "c")], "pair_id int, text_1 string, text_2 string")
    matcher = MA.PromptMatcher()
    answers = matcher.answers(pairs)
    assert answers.select("cache_key").distinct().count() == 2
    known = answers.select("cache_key").distinct().withColumn("answer", F.lit("no number"))
    assert all(r["value"] is None for r in MA.PromptMatcher(store=known).score(pairs).collect())


# ---- training, sources, sinks


def test_cascade_takes_the_best_so_far():
    steps = [{"group": "1", "window": "3", "vector_size": "10"}, {"group": "1", "window": "9"}, {"group": "2", "window": "x", "vector_size": "20"}]
    log, best, measure = TR.cascade(steps, lambda p: p.window + p.vector_size / 100)
    assert best.window == 9 and best.vector_size == 20 and len(log) == 3 and measure == pytest.approx(9.2)


def test_word2vec_is_written_once(spark, tmp_path):
    corpus = spark.createDataFrame([(["a", "b", "c", None, ""],)] * 8 + [(None,)], "tokens array<string>")
    params = TR.TrainParams(vector_size=4, epochs=1, min_count=2)
    first = TR.trained(spark, corpus, params, f"file://{tmp_path}")
    assert {r["word"] for r in first.collect()} == {"a", "b", "c"}
    assert TR.trained(spark, None, params, f"file://{tmp_path}").count() == 3
    with pytest.raises(ValueError):
        TR.train_word2vec(corpus, TR.TrainParams(sg=0))
    with pytest.raises(ValueError):
        TR.train(corpus, params, "other")


def test_named_sources(spark, tmp_path):
    (tmp_path / "d.csv").write_text('vacancy,resume,result\n"a ""q""\nline",b,1\nc,d,0\ne,f,yes\n', encoding="utf-8")
    rows = R.load_dataset(spark, "dataset_v6_r30", f"{tmp_path}/d.csv").orderBy("pair_id").collect()
    assert [r["need_match"] for r in rows] == [True, False, False] and rows[0]["title_1"] == "vacancy_0" and rows[0]["text_1"] == 'a "q"\nline'
    with pytest.raises(ValueError):
        R.load_dataset(spark, "nothing", "x.csv")
    with pytest.raises(ValueError):
        R.read_any(spark, "x.xml")


def test_model_list(spark, tmp_path):
    (tmp_path / "m.txt").write_text("header\nw2v-1-2\n\nft-3\n", encoding="utf-8")
    rows = R.read_model_names(spark, f"{tmp_path}/m.txt").collect()
    assert [(r["grp"], r["parts"]) for r in rows] == [(0, ["w2v", "1", "2"]), (1, ["ft", "3"])]


def test_keyed_store_keeps_zeros(spark, tmp_path):
    store = SK.KeyedStore(spark, f"file://{tmp_path}/store", "k string, v double")
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    assert store.misses(keys, "k").count() == 2
    store.add(spark.createDataFrame([("a", 0.0)], "k string, v double"))
    assert [r["k"] for r in store.misses(keys, "k").collect()] == ["b"] and store.get("k", "a")["v"] == 0.0
    store.clear()
    assert store.table().count() == 0


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, [1.5])], "a int, b array<double>")
    out = materialize(df)
    assert out.schema == df.schema and sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    assert materialize(df.where("a > 5")).count() == 0


def test_intermediate_tables_end_with_their_block(spark):
    from pairforge.storage import intermediates

    kept = materialize(spark.range(3))
    with intermediates():
        inside = materialize(spark.range(4))
        assert inside.count() == 4
    assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(inside.inputFiles()[0]).count()


def test_null_groups_keep_their_rows(spark):
    rows = [(None, True, 2.0), (None, False, 1.0), ("d", True, 1.0), ("d", False, 1.0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", score string")
    got = {r["dataset"]: r["auc"] for r in M.evaluate(df.select("dataset", "need_match", "value"), ["dataset"]).collect()}
    assert got == {None: 1.0, "d": 0.5}


def test_runs_share_what_they_extract_judge_and_score(spark):
    from pairforge.operators import experiments as EX

    texts = ["Разработка программного обеспечения на языке Python. Анализ данных и машинное обучение. " * k + t for k, t in ((1, "Тестирование сайтов."), (3, "Базы данных."), (9, ""))]
    rows = [(i, a, b, i % 2 == 0) for i, (a, b) in enumerate((a, b) for a in [*texts, None] for b in texts)]
    pairs = spark.createDataFrame(rows, "pair_id long, text_1 string, text_2 string, need_match boolean")
    configs = [p for tries in EX.KEYWORD_TRIES.values() for p in (tries[0], tries[-1])]
    got = {(r["run"], r["pair_id"]): list(r["top"]) for r in EX._top_scores(pairs, configs, 6).collect()}
    for n, p in enumerate(configs):
        want = {}
        for r in MA.KeywordMatcher(p).keyword_scores(pairs).collect():
            want.setdefault(r["pair_id"], []).append(r["kw_score"])
        assert {k: sorted(v, reverse=True)[:6] for k, v in want.items()} == {k: v for (run, k), v in got.items() if run == n}
    # every value is judged once, not for each of its rows
    judged = K.exclude(spark.createDataFrame([(i, "анализ данных") for i in range(9)], "id long, value string"))
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and judged.count() == 9


@pytest.mark.parametrize("sg", [0, 1])
def test_a_pass_of_the_trainer_equals_its_definition(sg):
    rng = np.random.default_rng(5)
    params = TR.TrainParams(window=4, sg=sg, vector_size=6)
    parts = [np.array([k, *rng.choice(np.arange(30, 60), rng.integers(0, 5), replace=False)]) for k in range(30)]
    sentences = [rng.integers(0, 30, n) for n in (0, 1, 2, 17, 40)]
    noise, inner, outer = np.repeat(np.arange(30), 3), rng.random((60, 6), np.float32), rng.random((30, 6), np.float32)
    got = inner.copy(), outer.copy()
    TR._shard(sentences, parts, *got, noise, params, 0.05, np.random.default_rng(1))
    draw, pairs = np.random.default_rng(1), []
    for t in sentences:
        reach = draw.integers(1, params.window + 1, len(t))
        pairs += [(w, a) for i, w in enumerate(t) if (a := [*t[max(0, i - reach[i]) : i], *t[i + 1 : i + 1 + reach[i]]])]
    order = draw.permutation(len(pairs))
    assert len(pairs) <= TR.STEP  # one step: everything is read before anything is changed
    drawn = noise[draw.integers(0, len(noise), (len(pairs), TR.NEGATIVES))]
    want, clip = (inner.astype(float), outer.astype(float)), lambda x: np.clip(x, -0.5, 0.5)
    for k, bad in zip(order, drawn):
        centre, around = pairs[k]
        read, told = ([centre], around) if sg == 1 else (around, [centre])
        rows = np.concatenate([parts[w] for w in read])
        h, back = inner[rows].mean(0), np.zeros(6)
        for targets, good in ((told, 1), (bad, 0)):
            for w in targets:
                step = 0.05 * (good - 1 / (1 + np.exp(-h @ outer[w]))) * (1 if good else len(told) / TR.NEGATIVES)
                back += step * outer[w]
                want[1][w] += clip(step * h)
        for r in rows:
            want[0][r] += clip(back / len(rows))
    for a, b in zip(got, want):
        assert np.abs(a - b).max() < 1e-4


def test_a_pass_of_the_trainer_takes_no_row_by_row_additions():
    rng = np.random.default_rng(2)
    parts = [np.array([k, *rng.integers(800, 9000, 26)]) for k in range(800)]
    sentences = [rng.integers(0, 800, 60) for _ in range(150)]
    inner, outer = rng.random((9000, 50), np.float32), np.zeros((800, 50), np.float32)
    began = time.process_time()
    TR._shard(sentences, parts, inner, outer, np.arange(800), TR.TrainParams(window=15), 0.05, rng)
    assert time.process_time() - began < 3


@pytest.mark.parametrize("grams", [False, True])
def test_a_skipgram_pass_of_whole_sentences_equals_its_definition(grams, monkeypatch):
    rng = np.random.default_rng(5)
    known = 4 * TR.STEP  # enough for one step: everything is read before anything is changed
    parts = [np.array([k, *(known + rng.choice(30, rng.integers(1, 5) if grams else 0, replace=False))]) for k in range(known)]
    inner, outer = rng.random((known + 30, 6), np.float32), rng.random((known, 6), np.float32)
    length = np.array([0, 1, 2, 17, 40, 3])
    tokens = rng.integers(0, 30, length.sum())
    monkeypatch.setattr(TR, "PIECE", 16)  # so that sentences are cut, and no pair may be lost at a cut
    got = inner.copy(), outer.copy()
    params = TR.TrainParams(window=9, vector_size=6)
    draw = np.random.default_rng(1)
    reach = np.random.default_rng(1).integers(1, params.window + 1, len(tokens))
    TR._skipgram(tokens, length, (np.array([len(p) for p in parts]), np.concatenate(parts)), *got, np.full(50, 7), params, 0.05, draw)  # one word is drawn, however often
    want = inner.astype(float), outer.astype(float)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for low, n in zip(np.cumsum(length) - length, length):
        for i in range(low, low + n):
            rows = parts[tokens[i]]
            h, back = inner[rows].mean(0), np.zeros(6)
            told = [j for j in range(max(low, i - reach[i]), min(low + n, i + reach[i] + 1)) if j != i]
            for j, step in [(tokens[j], 0.05 * (1 - sigmoid(h @ outer[tokens[j]]))) for j in told] + [(7, -0.05 * len(told) * sigmoid(h @ outer[7]))]:
                back += step * outer[j]
                if j != 7:
                    want[1][j] += step * h
            for r in rows:
                want[0][r] += np.clip(back / len(rows), -0.5, 0.5)
    others = np.arange(known) != 7  # the row of the drawn word is clipped
    assert np.abs(got[0] - want[0]).max() < 1e-4 and np.abs(got[1] - want[1])[others].max() < 1e-4


def test_rows_added_in_rounds_are_all_added():
    rng = np.random.default_rng(3)
    rows, which, values = rng.integers(0, 40, 900), rng.integers(0, 9, 900), rng.random((9, 4), np.float32)
    got, want = np.zeros((50, 4), np.float32), np.zeros((50, 4))
    TR._add_shared(got, rows, values, which)
    np.add.at(want, rows, values[which])
    assert np.abs(got - want).max() < 1e-3


def test_vectors_do_not_depend_on_the_layout_of_the_corpus(spark):
    rnd = random.Random(7)
    rows = [([rnd.choice("абвгдежзик") for _ in range(rnd.randrange(1, 12))],) for _ in range(200)]
    params = TR.TrainParams(window=3, epochs=2, min_count=2, vector_size=5, partitions=3)
    one, two = ({r["word"]: r["vec"] for r in TR.train(spark.createDataFrame(x, "tokens array<string>").repartition(n), params).collect()} for x, n in ((rows, 1), (rows[::-1], 5)))
    assert one and set(one) == set(two) and all(one[w] == pytest.approx(two[w], abs=1e-6) for w in one)


def test_tables_written_side_by_side_give_the_setting_back(spark):
    from pairforge import storage

    before, one, two = spark.conf.get(storage.SHUFFLE_CLEANUP, None), storage._cleaning(spark), storage._cleaning(spark)
    one.__enter__()
    two.__enter__()
    one.__exit__(None, None, None)
    assert spark.conf.get(storage.SHUFFLE_CLEANUP) == "true"
    two.__exit__(None, None, None)
    assert spark.conf.get(storage.SHUFFLE_CLEANUP, None) == before
