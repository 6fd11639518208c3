"""Queries that SQL cannot express, against plain Python over the same whole tables."""

import re
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from pairforge.functions import fuzzy
from pairforge.operators import keywords as K
from pairforge.operators import matchers as MA
from pairforge.operators import presets as PS
from pairforge.plans import catalog
from tests.test_functions import windows_by_hand


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    def collect(name):
        return catalog.QUERIES[name](spark, sf_dir).collect()

    return collect


@pytest.fixture(scope="module")
def rows(sf_dir):
    """The last delivery of each row of a table."""

    def read(name, key="row_id"):
        best = {}
        for r in pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist():
            if r[key] is not None and (r[key] not in best or str(r["loaded_at"]) > str(best[r[key]]["loaded_at"])):
                best[r[key]] = r
        return list(best.values())

    return read


@pytest.fixture(scope="module")
def rpd(rows):
    join = lambda *parts: ": ".join(p for p in parts if p is not None)
    return [{"pair_id": r["row_id"], "text_1": r["text_rp"] or "", "text_2": r["text_proj"] or "", "title_1": join(r["id_rp"], r["name_rp"]), "title_2": join(r["id_proj"], r["name_proj"]), "y": bool(r["need_match"])} for r in rows("rpd_dataset")]


def extracted(text, window=None):
    parts = windows_by_hand(text, *window) if window else [text]
    kws = [{"value": v, "certainty": float(c), "source": s} for part in parts for s, f in K.EXTRACTORS.items() for v, c in f(part, 10)]
    return sorted(kws, key=lambda k: -k["certainty"])


def keywords(text, params):
    kws = extracted(text, (params.window_size, params.window_delta) if params.is_window else None)
    good = [k for k in kws if not K.is_bad_phrase(k["value"]) and all(fuzzy.partial_ratio_of(b, k["value"]) < K.BLACKLIST_RATIO for b in K.BLACKLIST)]
    return K.cluster_keywords(good, params.dbscan_eps)


def keyword_value(pair, params, memo):
    one, two = (pair["text_2"], pair["text_1"]) if params.swap_texts else (pair["text_1"], pair["text_2"])
    key = (one, params.is_window, params.window_size, params.dbscan_eps)
    if key not in memo:
        memo[key] = [k["value"] for k in keywords(one, params)]
    scores = [fuzzy.combined_of(two.lower(), v) for v in memo[key]]
    scores = [s if s >= params.kw_cutoff * 100 else 0.0 for s in scores]
    if params.kw_saturation:
        scores = sorted(scores, reverse=True)[: params.saturate_value]
    return sum(scores) / len(scores) if scores else 0.0


def areas(pairs):
    """Area under the ROC curve by counting pairs."""
    pos, neg = [v for y, v in pairs if y], [v for y, v in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_sentence_windows(run, rows):
    want = {(r["row_id"], i): len(w) for r in rows("rpd_dataset") for i, w in enumerate(windows_by_hand(r["text_rp"] or "", 170, 50))}
    assert {(r["row_id"], r["window_no"]): r["letters"] for r in run("sentence_windows")} == want


def test_extracted_keywords(run, rpd):
    texts = {p["text_1"] for p in rpd}
    by_id = defaultdict(list)
    for r in run("keyword_extract"):
        by_id[r["text_id"]].append((r["place"], r["value"], r["source"], r["certainty"]))
    want = sorted(sorted((i, k["value"], k["source"], round(k["certainty"], 6)) for i, k in enumerate(extracted(t))) for t in texts)
    want = [w for w in want if w]
    assert sorted(sorted(v) for v in by_id.values()) == want
    counts = sorted(r["n"] for r in run("keyword_extract_windows"))
    assert counts == sorted(len(extracted(t, (170, 50))) for t in texts)


def test_clustered_keywords(run, rpd):
    want = sorted((k["value"], round(k["certainty"], 6), len(k["items"])) for t in {p["text_1"] for p in rpd} for k in keywords(t, MA.KeywordParams()))
    assert sorted((r["value"], r["certainty"], r["items_num"]) for r in run("keyword_cluster")) == want


def test_subsets(run, sf_dir):
    lists = {}
    for r in pq.read_table(f"{sf_dir}/documents_preprocessed.parquet").to_pylist():
        if r["rec_id"] is not None:
            lists[r["rec_id"]] = [v for v in r["preprocessed_text"] or [] if v]
    got = {r["text_id"]: r["kept"] for r in run("filter_subsets")}
    assert set(got) == {i for i, v in lists.items() if v}
    for i, kept in got.items():
        values = lists[i]
        assert kept == K.filter_subsets(values)
        # what is dropped is part of something kept, and the order stays
        assert all(any(v in k for k in kept) for v in values) and [v for v in values if v in set(kept)] == kept


def test_excluded_keywords(run, sf_dir):
    lists = {r["rec_id"]: r["preprocessed_text"] or [] for r in pq.read_table(f"{sf_dir}/documents_preprocessed.parquet").to_pylist() if r["rec_id"] is not None}
    want = defaultdict(int)
    for values in lists.values():
        for v in values:
            if v and not K.is_bad_phrase(v) and all(fuzzy.partial_ratio_of(b, v) < K.BLACKLIST_RATIO for b in K.BLACKLIST):
                want[v] += 1
    assert {r["value"]: r["n"] for r in run("exclude_keywords")} == want


def test_fuzzy_scores(run, rpd):
    assert {r["pair_id"]: r["value"] for r in run("partial_ratio")} == {p["pair_id"]: fuzzy.partial_ratio_of(p["title_1"], p["title_2"]) for p in rpd}
    assert {r["pair_id"]: r["value"] for r in run("fuzzy_match")} == {p["pair_id"]: pytest.approx(fuzzy.combined_of(p["text_2"].lower(), p["title_1"].lower()), abs=1e-6) for p in rpd}


@pytest.mark.parametrize("name, params", [("keyword_match", MA.KeywordParams()), ("keyword_match_saturated", MA.KeywordParams(kw_saturation=True, swap_texts=True))])
def test_keyword_scores(run, rpd, name, params):
    memo = {}
    want = {p["pair_id"]: pytest.approx(keyword_value(p, params, memo), abs=1e-6) for p in rpd}
    assert {r["pair_id"]: r["value"] for r in run(name)} == want


def test_answers_of_the_offline_transport(run, rows):
    def share(r):
        one, two = (set(re.findall(r"\w{2,}", (r[c] or "").lower())) for c in ("text_1", "text_2"))
        return 10.0 * round(10 * len(one & two) / max(1, len(one | two)))

    got = {r["pair_id"]: r["value"] for r in run("gpt_match")}
    every = rows("studentor_partner")
    short = [r for r in every if len(r["text_1"] or "") + len(r["text_2"] or "") < 4000]  # longer prompts are cropped
    assert set(got) == {r["row_id"] for r in every} and len(short) > 10
    assert {r["row_id"]: got[r["row_id"]] for r in short} == {r["row_id"]: share(r) for r in short}


def test_runs_of_the_keyword_search(run, rpd):
    from dataclasses import replace

    from pairforge.operators import experiments as EX

    got = run("keyword_grid")
    assert len(got) == sum(map(len, EX.KEYWORD_TRIES.values())) * EX.CUTOFF_STEPS and sum(r["best"] for r in got) == len(EX.KEYWORD_TRIES)
    memo = {}
    for r in got:
        if round(r["kw_cutoff"] * 19) in (0, 11):
            params = MA.KeywordParams(**{k: r[k] for k in ("is_window", "window_size", "window_delta", "kw_saturation", "saturate_value", "dbscan_eps", "swap_texts")}, kw_cutoff=r["kw_cutoff"])
            assert replace(params, kw_cutoff=0.725) in EX.KEYWORD_TRIES[r["trial"]]
            assert r["auc"] == pytest.approx(areas([(p["y"], keyword_value(p, params, memo)) for p in rpd]), abs=1e-6)
    for trial in EX.KEYWORD_TRIES:
        assert max(r["auc"] for r in got if r["trial"] == trial) == next(r["auc"] for r in got if r["trial"] == trial and r["best"])


def test_runs_of_the_tfidf_search(run, spark, sf_dir):
    from pairforge.operators import experiments as EX

    got = run("tfidf_config_sweep")
    first = {(r["low"], r["high"]): r["auc"] for r in got if r["stage"] == 1}
    second = [r for r in got if r["stage"] == 2]
    assert set(first) == set(EX.NGRAMS) and {(r["binary"], r["sublinear"]) for r in second} == set(EX.FLAGS)
    best = max(EX.NGRAMS, key=lambda g: (first[g], -EX.NGRAMS.index(g)))
    assert {(r["low"], r["high"]) for r in second} == {best}
    plain = next(r for r in second if not r["binary"] and not r["sublinear"])
    assert plain["auc"] == first[best]
    # the single words are those of a query that has SQL
    labels = {r["pair_id"]: r["need_match"] for r in catalog.QUERIES["pair_labels"](spark, sf_dir).where("dataset = 'dataset_v6_r30'").collect()}
    scores = {r["pair_id"]: r["value"] for r in catalog.QUERIES["tfidf_match"](spark, sf_dir).collect()}
    assert first[1, 1] == pytest.approx(areas([(labels[i], v) for i, v in scores.items()]), abs=1e-4)


def test_runs_of_all_models(run, rpd):
    got = {(r["dataset"], r["model"]): r for r in run("tuned_runs")}
    models = {"keywords", "tfidf", "gpt", "word2vec", "fastText", "sentences", "transformer"}
    assert set(got) == {(d, m) for d in PS.KEYWORDS for m in models}
    memo = {}
    want = areas([(p["y"], keyword_value(p, PS.KEYWORDS["all_examples"], memo)) for p in rpd])
    assert got["all_examples", "keywords"]["auc"] == pytest.approx(want, abs=1e-6)
    assert all(r["auc"] is None or 0 <= r["auc"] <= 1 for r in got.values())


@pytest.mark.parametrize("name", ["word2vec_match", "fasttext_match"])
def test_word_vectors(run, rpd, name):
    got = {r["pair_id"]: r["value"] for r in run(name)}
    assert set(got) == {p["pair_id"] for p in rpd} and all(v is None or -1 <= v <= 1 for v in got.values())
    equal = [p for p in rpd if p["text_1"] and p["text_1"] == p["text_2"]]
    assert all(got[p["pair_id"]] in (None, 1.0) for p in equal)
    assert any(v is not None for v in got.values())
