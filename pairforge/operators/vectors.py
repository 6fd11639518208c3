"""Similarities of dense vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null if a norm is zero or a side is null."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def vocabulary(corpus: DataFrame, tokens: str, min_count: int) -> DataFrame:
    """``word``, ``n`` of words that occur often enough; null and empty words are none."""
    words = corpus.select(F.explode(tokens).alias("word")).where("word is not null and word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def mean_vectors(texts: DataFrame, vectors: DataFrame, key: str, tokens: str) -> DataFrame:
    """Mean of the vectors of a text's known tokens, as ``vec``; texts without any are left out.

    ``vectors``: ``word``, ``vec``. The mean is a JVM aggregate with partial sums.
    """
    known = texts.select(key, F.explode(tokens).alias("word")).groupBy(key, "word").agg(F.count("*").cast("double").alias("times")).join(vectors, "word")
    mean = Summarizer.metrics("mean").summary(array_to_vector(F.col("vec")), F.col("times"))
    return known.groupBy(key).agg(mean.alias("s")).select(key, vector_to_array("s.mean").alias("vec"))


def mean_vector_match(pairs: DataFrame, tokens: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pair_id``, ``value``: rounded cosine of the mean vectors; null if a side has no known word.

    ``pairs``: ``pair_id``, ``id_1``, ``id_2``; ``tokens``: ``text_id``, ``tokens``.
    """
    means = mean_vectors(tokens, vectors, "text_id", "tokens")
    side = lambda i: means.select(F.col("text_id").alias(f"id_{i}"), F.col("vec").alias(f"v{i}"))
    return pairs.join(side(1), "id_1", "left").join(side(2), "id_2", "left").select("pair_id", F.round(F.round(cosine(F.col("v1"), F.col("v2")), 9), 3).alias("value"))


def sentence_max_mean(pairs: DataFrame, sentences: DataFrame) -> DataFrame:
    """``pair_id``, ``value``: over the first text's sentences the mean of the best cosine with a sentence of the second.

    ``sentences``: ``text_id``, ``sent``, ``vec``.
    """
    side = lambda i: sentences.select(F.col("text_id").alias(f"id_{i}"), F.col("sent").alias(f"s{i}"), F.col("vec").alias(f"v{i}"))
    best = pairs.join(side(1), "id_1").join(side(2), "id_2").groupBy("pair_id", "s1").agg(F.max(cosine(F.col("v1"), F.col("v2"))).alias("best"))
    return best.groupBy("pair_id").agg(F.round(F.round(F.avg("best"), 9), 3).alias("value"))
