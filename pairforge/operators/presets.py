"""Tuned parameters by data set, and runs of many models over many data sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions import prompts as PR
from pairforge.functions import text as T
from pairforge.operators import metrics as M
from pairforge.operators import pairs as P
from pairforge.operators.matchers import KeywordMatcher, KeywordParams, Matcher, PromptMatcher, SentenceMatcher, TextVectorMatcher, TfIdfMatcher, WordVectorMatcher
from pairforge.operators.tfidf import TfIdfParams
from pairforge.operators.training import TrainParams
from pairforge.storage import materialize

# The parameters found best for each data set.
KEYWORDS = {
    "all_examples": KeywordParams(is_window=True, window_size=400, window_delta=50, kw_saturation=True, saturate_value=6, dbscan_eps=0.95, kw_cutoff=0, swap_texts=True),
    "studentor_partner": KeywordParams(is_window=True, window_size=170, window_delta=50, kw_saturation=True, saturate_value=6, dbscan_eps=0.95, kw_cutoff=0.89, swap_texts=True),
    "dataset_v6_r30": KeywordParams(is_window=True, window_size=400, window_delta=50, kw_saturation=True, saturate_value=6, dbscan_eps=0.95, kw_cutoff=0.57, swap_texts=False),
}
TFIDF = {"all_examples": TfIdfParams(1, 1), "studentor_partner": TfIdfParams(3, 3), "dataset_v6_r30": TfIdfParams(1, 1)}
WORD2VEC = {
    "all_examples": TrainParams(window=30, epochs=8, min_count=5, vector_size=50),
    "studentor_partner": TrainParams(window=15, epochs=5, min_count=6, vector_size=50),
    "dataset_v6_r30": TrainParams(window=30, epochs=8, min_count=5, vector_size=50),
}
FASTTEXT = {
    "all_examples": TrainParams(window=15, epochs=6, min_count=5, vector_size=50, min_n=3, max_n=6),
    "studentor_partner": TrainParams(window=10, epochs=5, min_count=5, vector_size=50, min_n=3, max_n=6),
    "dataset_v6_r30": TrainParams(window=15, epochs=5, min_count=5, vector_size=50, min_n=3, max_n=6),
}
PROMPT = {name: {"max_tokens": 10000, "temperature": 0.75, "model": "gpt-3.5-turbo-16k"} for name in KEYWORDS}
#: Example pairs of the prompts and the results wanted for them.
SHOTS = {"all_examples": {13: 100, 28: 100}, "studentor_partner": {18: 90, 110: 100}, "dataset_v6_r30": {}}


#: Tokens that the example pairs of a prompt may take.
SHOT_TOKENS = 2000


def prompt_shots(pairs: DataFrame, dataset: str, key: str = "pair_id") -> tuple[tuple[str, str], ...]:
    """Questions and answers of the data set's example pairs, those of them that the pairs hold."""
    wanted = SHOTS.get(dataset, {})
    if not wanted:
        return ()
    rows = P.few_shots(pairs, wanted, key).select(key, PR.make_prompt(F.col("text_1"), F.col("text_2"), SHOT_TOKENS).alias("question"), "result").orderBy(key)
    return tuple((r["question"], str(r["result"] // 10)) for r in rows.collect())  # as many rows as examples are named


def tuned(dataset: str, pairs: DataFrame | None = None, corpus: DataFrame | None = None, vectors: Callable[[str, TrainParams], DataFrame] | None = None, encode: Callable[[list[str]], list[list[float]]] | None = None) -> dict[str, Matcher]:
    """The matchers of a data set with its parameters.

    ``pairs``: where the examples of prompts are taken from; ``corpus``: the texts that TF-IDF is fitted on, by default those
    that are scored; ``vectors``: gives the word vectors for 'word2vec' or 'fastText' and their parameters; ``encode``: an
    encoder of sentences and texts. Matchers whose parts are not given are left out.
    """
    shots = prompt_shots(pairs, dataset) if pairs is not None else ()
    out: dict[str, Matcher] = {"keywords": KeywordMatcher(KEYWORDS[dataset]), "tfidf": TfIdfMatcher(TFIDF[dataset], corpus), "gpt": PromptMatcher(**PROMPT[dataset], shots=shots)}
    if vectors is not None:
        out |= {"word2vec": WordVectorMatcher(vectors("word2vec", WORD2VEC[dataset]), T.tokens), "fastText": WordVectorMatcher(vectors("fastText", FASTTEXT[dataset]), T.tokens)}
    if encode is not None:
        out |= {"sentences": SentenceMatcher(encode), "transformer": TextVectorMatcher(encode)}
    return out


def run_all(datasets: dict[str, DataFrame], matchers: dict[str, dict[str, Matcher]]) -> DataFrame:
    """One row of measures per data set and model. Every score is computed and written once; the measures of
    all runs are then one plan over the long table of scores."""
    long = None
    for dataset, pairs in datasets.items():
        for model, matcher in matchers[dataset].items():
            one = matcher.score(pairs).select(F.lit(dataset).alias("dataset"), F.lit(model).alias("model"), "need_match", F.col("value").cast("double").alias("value"))
            long = one if long is None else long.unionByName(one)
    return M.evaluate(materialize(long, "runs"), ["dataset", "model"])
