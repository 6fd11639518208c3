"""Searches over the parameters of models: every run of a grid with its measures, and the best runs."""

from __future__ import annotations

from dataclasses import asdict, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions import fuzzy
from pairforge.functions import text as T
from pairforge.operators import grid as G
from pairforge.operators import keywords as K
from pairforge.operators import metrics as M
from pairforge.operators import pairs as P
from pairforge.operators import tfidf as TF
from pairforge.operators.matchers import KeywordParams
from pairforge.session import spread
from pairforge.storage import materialize

# The grids of the searches.
KEYWORD_TRIES = {
    1: [KeywordParams(kw_saturation=True, dbscan_eps=eps) for eps in (0.6, 0.7, 0.8, 0.9, 1.0)],
    2: [KeywordParams(is_window=True, kw_saturation=True, window_size=size) for size in (170, 400, 500, 700)],
    3: [KeywordParams(is_window=True, kw_saturation=True, swap_texts=True, window_size=size) for size in (170, 300, 400, 500, 700)],
}
CUTOFF_STEPS = 20
NGRAMS = ((1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3))
FLAGS = tuple((binary, sublinear) for binary in (False, True) for sublinear in (False, True))


def best_by(dataset: str) -> str:
    """The measure that decides for a data set."""
    return "auprc" if dataset == "studentor_partner" else "auc"


def keyword_runs(pairs: DataFrame, tries: dict[int, list[KeywordParams]] = KEYWORD_TRIES, steps: int = CUTOFF_STEPS) -> DataFrame:
    """One row per try, parameters and keyword cutoff: ``trial``, the parameters, ``kw_cutoff``, ``position`` and all measures.

    Texts are matched once for all sets of parameters and all cutoffs share the scores; a pair without keywords
    scores 0 in every run.
    """
    pairs = materialize(pairs.select("pair_id", "text_1", "text_2", "need_match"), "pairs")
    configs = [(trial, params) for trial, runs in tries.items() for params in runs]
    spark = pairs.sparkSession
    tops = materialize(_top_scores(pairs, [p for _, p in configs], configs[0][1].saturate_value), "scores")
    cutoffs = G.cutoff_axis(spark.createDataFrame([(0.0,)], "value double"), steps).select("kw_cutoff")
    runs = spark.range(len(configs)).select(F.col("id").cast("int").alias("run"))
    # the grid: a few hundred rows. A cutoff lowers scores without changing their order, so that the largest stay the largest
    scored = pairs.select("pair_id", "need_match").crossJoin(F.broadcast(runs)).join(tops, ["run", "pair_id"], "left").crossJoin(F.broadcast(cutoffs))
    cut = F.transform("top", lambda v: K.cut_to_zero(v, F.col("kw_cutoff")))
    every = scored.select("run", "kw_cutoff", "pair_id", "need_match", F.coalesce(K.saturated_mean(cut, configs[0][1].saturate_value), F.lit(0.0)).alias("value"))
    measured = M.evaluate(every, ["run", "kw_cutoff"])
    rows = [{"run": n, "trial": trial, **{k: v for k, v in asdict(p).items() if k != "kw_cutoff"}} for n, (trial, p) in enumerate(configs)]
    return measured.join(F.broadcast(spark.createDataFrame(rows)), "run").withColumn("position", F.col("run") * steps + F.round(F.col("kw_cutoff") * (steps - 1)).cast("int")).drop("run")


def _top_scores(pairs: DataFrame, configs: list[KeywordParams], most: int) -> DataFrame:
    """``run`` (place in ``configs``), ``pair_id`` and ``top``, the ``most`` largest scores of the pair's keywords before any cutoff.

    What :meth:`KeywordMatcher.keyword_scores` gives for each set of parameters, with each distinct text extracted once for all
    windows, each value judged once and each distinct (keyword, text) scored once for all of them.
    """
    both = [P.swap(pairs) if swapped else pairs for swapped in (False, True)]
    sides = None
    for swapped, one in zip((False, True), both):
        one = one.select(F.lit(swapped).alias("swapped"), "pair_id", T.text_or_empty("text_1").alias("t1"), F.lower(T.text_or_empty("text_2")).alias("t2"))
        sides = one if sides is None else sides.unionByName(one)
    sides = materialize(sides.where(F.col("swapped").isin(sorted({p.swap_texts for p in configs}))).withColumns({"i1": F.xxhash64("t1"), "i2": F.xxhash64("t2")}), "sides")
    raw, runs = None, []
    for swapped in sorted({p.swap_texts for p in configs}):
        chosen = [(n, p, (p.window_size, p.window_delta) if p.is_window else None) for n, p in enumerate(configs) if p.swap_texts == swapped]
        windows = list(dict.fromkeys(w for _, _, w in chosen))
        runs += [(swapped, windows.index(w), n, p.dbscan_eps) for n, p, w in chosen]
        texts = sides.where(F.col("swapped") == swapped).select("swapped", "i1", F.col("t1").alias("text")).distinct()
        one = K.extract_windows(texts, windows, ["swapped", "i1"])
        raw = one if raw is None else raw.unionByName(one)
    good = K.exclude(materialize(raw, "extracted"))
    lists = good.groupBy("swapped", "window", "i1").agg(F.sort_array(F.collect_list(F.struct("pos", "value", "certainty", "source"))).alias("kws"))  # a few dozen per text

    def clustered(frames):
        for df in frames:
            rows = []
            for swapped, window, i1, kws in zip(df["swapped"], df["window"], df["i1"], df["kws"]):
                kws = list(kws)
                rows += [(n, swapped, i1, k["value"]) for s, w, n, eps in runs if (s, w) == (swapped, window) for k in K.cluster_keywords(kws, eps)]
            yield pd.DataFrame(rows, columns=["run", "swapped", "i1", "label"])

    labels = lists.mapInPandas(clustered, "run int, swapped boolean, i1 long, label string")
    asked = materialize(labels.join(sides.select("swapped", "pair_id", "i1", "i2"), ["swapped", "i1"]).select("run", "pair_id", "i2", "label"), "asked")
    # rows of a text are spread by their keywords too: many keywords are looked for in one text
    wanted = spread(asked.select("i2", "label").distinct().join(sides.select("i2", "t2").distinct(), "i2"), "i2", "label")
    found = materialize(wanted.select("i2", "label", fuzzy.combined_ratio(F.col("t2"), F.col("label")).alias("score")), "found")
    largest = F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, most)  # the keywords of one pair
    return asked.join(found, ["i2", "label"]).groupBy("run", "pair_id").agg(largest.alias("top"))


def best_keyword_runs(runs: DataFrame, key: str = "auc") -> DataFrame:
    """The best run of each try; ties fall to the first."""
    return G.argmax(runs, ["trial"], key)


def _tfidf_runs(pairs: DataFrame, corpus: DataFrame, configs: list[TF.TfIdfParams]) -> DataFrame:
    scored, models = None, {}
    for p in configs:
        grams = (p.low, p.high)
        if grams not in models:  # flags do not change what is fitted
            models[grams] = materialize(TF.fit(corpus, p), "model")
        one = TF.match(pairs, models[grams], p).select(F.lit(p.low).alias("low"), F.lit(p.high).alias("high"), F.lit(p.binary).alias("binary"), F.lit(p.sublinear).alias("sublinear"), "need_match", "value")
        scored = one if scored is None else scored.unionByName(one)
    return M.evaluate(scored, ["low", "high", "binary", "sublinear"])


def tfidf_runs(pairs: DataFrame, corpus: DataFrame | None = None, key: str = "auc") -> DataFrame:
    """The runs of both stages with their measures: all ranges of n-grams, then all flags with the best range (``stage`` 1 and 2).

    ``corpus``: texts that the models are fitted on, by default the pairs' own."""
    pairs = materialize(pairs.select("pair_id", "text_1", "text_2", "need_match"), "pairs")
    corpus = P.all_texts(pairs) if corpus is None else corpus
    plain = TF.TfIdfParams()
    first = materialize(_tfidf_runs(pairs, corpus, [replace(plain, low=low, high=high) for low, high in NGRAMS]), "runs")
    order = {grams: n for n, grams in enumerate(NGRAMS)}
    # six rows; ties fall to the range that is first in the list
    best = min(first.collect(), key=lambda r: (r[key] is None, -(r[key] or 0.0), order[r["low"], r["high"]]))
    second = _tfidf_runs(pairs, corpus, [replace(plain, low=best["low"], high=best["high"], binary=b, sublinear=s) for b, s in FLAGS])
    return first.withColumn("stage", F.lit(1)).unionByName(second.withColumn("stage", F.lit(2)))
