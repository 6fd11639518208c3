"""Matchers: each scores a table of pairs in bulk and adds ``value``.

``scale`` names the range of a matcher's scores; nothing rescales them.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions import fuzzy
from pairforge.functions import prompts as PR
from pairforge.functions import text as T
from pairforge.operators import keywords as K
from pairforge.operators import pairs as P
from pairforge.operators import tfidf as TF
from pairforge.operators import vectors as V
from pairforge.session import spread


class Matcher(ABC):
    """Scores pairs with ``pair_id``, ``text_1``, ``text_2``."""

    scale = (0.0, 100.0)

    @abstractmethod
    def score(self, pairs: DataFrame) -> DataFrame:
        """The pairs with ``value``."""


@dataclass(frozen=True)
class KeywordParams:
    is_window: bool = False
    window_size: int = 170
    window_delta: int = 50
    kw_saturation: bool = False
    saturate_value: int = 6
    dbscan_eps: float = 0.95
    kw_cutoff: float = 0.725
    swap_texts: bool = False


@dataclass(frozen=True)
class KeywordMatcher(Matcher):
    """Keywords of the first text looked for in the second; mean score, 0 without keywords.

    Each distinct text is extracted once and each distinct (keyword, text) scored once.
    """

    params: KeywordParams = KeywordParams()
    tagger: K.Tagger = K.tag_by_ending

    def keyword_scores(self, pairs: DataFrame) -> DataFrame:
        """``pair_id``, ``label``, ``kw_score`` before the cutoff, for the grids that share them."""
        p = self.params
        pairs = P.swap(pairs) if p.swap_texts else pairs
        sides = pairs.select("pair_id", T.text_or_empty("text_1").alias("t1"), F.lower(T.text_or_empty("text_2")).alias("t2")).withColumns({"i1": F.xxhash64("t1"), "i2": F.xxhash64("t2")})
        texts = sides.select(F.col("i1").alias("text_id"), F.col("t1").alias("text")).distinct()
        window = (p.window_size, p.window_delta) if p.is_window else None
        kws = K.keyword_pipeline(texts, eps=p.dbscan_eps, window=window, tagger=self.tagger).select(F.col("text_id").alias("i1"), F.col("value").alias("label"))
        asked = sides.select("pair_id", "i1", "i2").join(kws, "i1")
        labels = asked.select("i2", "label").distinct()
        found = spread(labels.join(sides.select("i2", "t2").distinct(), "i2"), "i2", "label").select("i2", "label", fuzzy.combined_ratio(F.col("t2"), F.col("label")).alias("kw_score"))
        return asked.join(found, ["i2", "label"]).select("pair_id", "label", "kw_score")

    def score(self, pairs: DataFrame) -> DataFrame:
        p = self.params
        cut = self.keyword_scores(pairs).withColumn("kw_score", K.cut_to_zero(F.col("kw_score"), p.kw_cutoff))
        if p.kw_saturation:
            value = K.saturated_mean(F.collect_list("kw_score"), p.saturate_value)  # the keywords of one pair
        else:
            value = F.avg("kw_score")
        values = cut.groupBy("pair_id").agg(value.alias("value"))
        return pairs.join(values, "pair_id", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


@dataclass(frozen=True)
class TfIdfMatcher(Matcher):
    """Cosine of TF-IDF vectors in percent; ``corpus`` (a column ``text``) is fitted at each call, by default the pairs' texts."""

    params: TF.TfIdfParams = TF.TfIdfParams()
    corpus: DataFrame | None = None

    def score(self, pairs: DataFrame) -> DataFrame:
        corpus = self.corpus if self.corpus is not None else P.all_texts(pairs)
        return TF.match(pairs, TF.fit(corpus, self.params), self.params)


@dataclass(frozen=True)
class WordVectorMatcher(Matcher):
    """Rounded cosine of mean word vectors in [-1, 1]; null if a side has no known word."""

    vectors: DataFrame
    tokenize: Callable = T.preprocess
    scale = (-1.0, 1.0)

    def score(self, pairs: DataFrame) -> DataFrame:
        ids = pairs.select("pair_id", F.xxhash64(T.text_or_empty("text_1")).alias("id_1"), F.xxhash64(T.text_or_empty("text_2")).alias("id_2"))
        texts = pairs.select(F.explode(F.array(T.text_or_empty("text_1"), T.text_or_empty("text_2"))).alias("text")).distinct()
        tokens = texts.select(F.xxhash64("text").alias("text_id"), self.tokenize("text").alias("tokens"))
        return pairs.join(V.mean_vector_match(ids, tokens, self.vectors), "pair_id", "left")


@dataclass(frozen=True)
class SentenceMatcher(Matcher):
    """Mean over the first text's sentences of the best cosine with the second's; ``encode`` maps a list of sentences to vectors in batches."""

    encode: Callable[[list[str]], list[list[float]]]
    scale = (-1.0, 1.0)

    def score(self, pairs: DataFrame) -> DataFrame:
        ids = pairs.select("pair_id", F.xxhash64(T.text_or_empty("text_1")).alias("id_1"), F.xxhash64(T.text_or_empty("text_2")).alias("id_2"))
        texts = pairs.select(F.explode(F.array(T.text_or_empty("text_1"), T.text_or_empty("text_2"))).alias("text")).distinct()
        sents = texts.select(F.xxhash64("text").alias("text_id"), F.posexplode(T.sent_preprocess("text")).alias("sent", "s"))
        encode = self.encode

        @F.pandas_udf("array<float>")
        def vectors(s: pd.Series) -> pd.Series:
            return pd.Series(encode(list(s)))

        coded = sents.select("s").distinct().withColumn("vec", vectors("s"))
        return pairs.join(V.sentence_max_mean(ids, sents.join(coded, "s").drop("s")), "pair_id", "left")


@dataclass(frozen=True)
class TextVectorMatcher(Matcher):
    """Cosine of whole-text vectors in percent, from any encoder."""

    encode: Callable[[list[str]], list[list[float]]]

    def score(self, pairs: DataFrame) -> DataFrame:
        encode = self.encode

        @F.pandas_udf("array<float>")
        def vectors(s: pd.Series) -> pd.Series:
            return pd.Series(encode(list(s)))

        texts = pairs.select(F.explode(F.array(T.text_or_empty("text_1"), T.text_or_empty("text_2"))).alias("text")).distinct()
        coded = texts.select(F.xxhash64("text").alias("i"), vectors(T.preprocess_text("text")).alias("v"))
        side = lambda n: coded.select(F.col("i").alias(f"_i{n}"), F.col("v").alias(f"_v{n}"))
        keyed = pairs.withColumns({"_i1": F.xxhash64(T.text_or_empty("text_1")), "_i2": F.xxhash64(T.text_or_empty("text_2"))})
        return keyed.join(side(1), "_i1").join(side(2), "_i2").withColumn("value", V.cosine(F.col("_v1"), F.col("_v2")) * 100).drop("_i1", "_i2", "_v1", "_v2")


def offline_transport(messages: list[dict]) -> str:
    """Answers without a network: the share of common words of the two texts, 0 to 10."""
    import re

    prompt = messages[-1]["content"]
    parts = re.split(r"\n\[\[[^\]]*\]\]:", prompt)
    one, two = (set(re.findall(r"\w{2,}", p.lower())) for p in (parts + ["", ""])[1:3])
    return str(round(10 * len(one & two) / max(1, len(one | two))))


@dataclass(frozen=True)
class PromptMatcher(Matcher):
    """A language model asked for 0 to 10, times ten; the transport is any function from chat messages to text.

    Equal prompts are sent once. ``store``: answers already known (``cache_key``, ``answer``); only
    misses are sent, and an answer without digits gives null.
    """

    transport: Callable[[list[dict]], str] = offline_transport
    max_tokens: int = 4010
    temperature: float = 0.75
    model: str = "gpt-3.5-turbo"
    shots: tuple[tuple[str, str], ...] = field(default=())
    store: DataFrame | None = None

    def answers(self, pairs: DataFrame) -> DataFrame:
        """``pair_id``, ``cache_key``, ``answer``."""
        used = PR.count_tokens(F.lit(PR.INIT_PROMPT)) + 4
        for question, _ in self.shots:
            used = used + PR.count_tokens(F.lit(question)) + 12
        budget = F.lit(self.max_tokens) - used
        chat = PR.messages(PR.make_prompt(F.col("text_1"), F.col("text_2"), budget), list(self.shots))
        key = PR.cache_key(F.lit("openai:"), F.lit(self.max_tokens), F.lit(self.model), F.lit(self.temperature), F.to_json(F.col("chat")))
        asked = pairs.select("pair_id", chat.alias("chat")).withColumn("cache_key", key)
        new = asked.select("cache_key", "chat").dropDuplicates(["cache_key"])
        if self.store is not None:
            new = new.join(self.store, "cache_key", "left_anti")
        transport = self.transport

        def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in frames:
                yield pd.DataFrame({"cache_key": df["cache_key"], "answer": [transport([dict(m) for m in c]) for c in df["chat"]]})

        got = new.mapInPandas(send, "cache_key string, answer string")
        if self.store is not None:
            got = got.unionByName(self.store.select("cache_key", "answer"))
        return asked.select("pair_id", "cache_key").join(got, "cache_key", "left")

    def score(self, pairs: DataFrame) -> DataFrame:
        values = self.answers(pairs).select("pair_id", (PR.parse_score(F.col("answer")) * 10).cast("double").alias("value"))
        return pairs.join(values, "pair_id", "left")


#: Names of the matchers for command lines and runs over several models.
REGISTRY: dict[str, Callable[..., Matcher]] = {"keywords": KeywordMatcher, "tfidf": TfIdfMatcher, "gpt": PromptMatcher, "word2vec": WordVectorMatcher, "fastText": WordVectorMatcher, "sentences": SentenceMatcher, "transformer": TextVectorMatcher}
