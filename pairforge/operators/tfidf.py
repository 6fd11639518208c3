"""TF-IDF over long term tables: nothing is made dense, nothing gathered on the driver but one count.

Fit and transform work on distinct texts with their multiplicities, so that a text that recurs in
many pairs is cut into terms once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions import text as T


@dataclass(frozen=True)
class TfIdfParams:
    low: int = 1
    high: int = 1
    binary: bool = False
    sublinear: bool = False
    stopwords: tuple[str, ...] = T.STOPWORDS


def terms(texts: DataFrame, params: TfIdfParams, key: str = "text_id", text: str = "text", weight: str | None = None) -> DataFrame:
    """``key``, ``term``, ``tf`` of each text; texts without terms give no row."""
    found = T.tokens(T.preprocess_text(text, params.stopwords))
    grams = found if (params.low, params.high) == (1, 1) else T.ngrams(found, params.low, params.high)
    keep = [weight] if weight else []
    return texts.select(key, *keep, F.explode(grams).alias("term")).groupBy(key, *keep, "term").agg(F.count("*").alias("tf"))


def fit(corpus: DataFrame, params: TfIdfParams, text: str = "text") -> DataFrame:
    """``term``, ``df``, ``idf`` of a corpus with repetitions; smooth idf, plus one."""
    distinct = corpus.groupBy(F.xxhash64(text).alias("text_id"), F.col(text).alias("text")).agg(F.count("*").alias("copies"))
    counts = terms(distinct, params, weight="copies").groupBy("term").agg(F.sum("copies").alias("df"))
    size = corpus.agg(F.count("*").alias("n"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    return counts.crossJoin(F.broadcast(size)).select("term", "df", idf.alias("idf"))  # the count is one row


def transform(texts: DataFrame, model: DataFrame, params: TfIdfParams, key: str = "text_id", text: str = "text") -> DataFrame:
    """``key``, ``term``, ``weight`` of unit length; terms the corpus does not know are dropped."""
    tf = F.lit(1.0) if params.binary else F.col("tf").cast("double")
    if params.sublinear:
        tf = 1 + F.log(tf)
    raw = terms(texts, params, key, text).join(model, "term").select(key, "term", (tf * F.col("idf")).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def match(pairs: DataFrame, model: DataFrame, params: TfIdfParams, key: str = "pair_id") -> DataFrame:
    """Pairs with ``value``: cosine of both texts in percent, 0 if either has no known term. Null texts are empty."""
    sides = pairs.select(key, "text_1", "text_2")
    long = sides.select(F.explode(F.array(T.text_or_empty("text_1"), T.text_or_empty("text_2"))).alias("text")).distinct()
    weights = transform(long.withColumn("text_id", F.xxhash64("text")), model, params)
    ids = pairs.select(key, F.xxhash64(T.text_or_empty("text_1")).alias("i1"), F.xxhash64(T.text_or_empty("text_2")).alias("i2"))
    a = weights.select(F.col("text_id").alias("i1"), "term", F.col("weight").alias("w1"))
    b = weights.select(F.col("text_id").alias("i2"), "term", F.col("weight").alias("w2"))
    # equal pairs of texts are scored once
    dots = ids.select("i1", "i2").distinct().join(a, "i1").join(b, ["i2", "term"]).groupBy("i1", "i2").agg(F.sum(F.col("w1") * F.col("w2")).alias("dot"))
    value = F.coalesce(F.col("dot") * 100, F.lit(0.0))
    return pairs.join(ids.join(dots, ["i1", "i2"], "left").select(key, value.alias("value")), key)
