"""Operators on tables of text pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions import text as T
from pairforge.operators.dedupe import latest, once  # noqa: F401 - part of the operators on pairs
from pairforge.sources.readers import number_rows
from pairforge.storage import materialize

#: Texts of the first side in a block of :func:`cross_pairs`.
CROSS_BLOCK = 200
SUFFIX = " Дополнительный текст."
#: Distinct pair of columns of each side.
SIDES = (("text_1", "title_1"), ("text_2", "title_2"))


def swap(pairs: DataFrame, when: Column | None = None) -> DataFrame:
    """Exchanges the sides, titles too; ``when``: only in rows where it holds."""
    cond = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    swapped = {}
    for one, two in zip(*SIDES):
        if one in pairs.columns and two in pairs.columns:
            swapped[one] = F.when(cond, F.col(two)).otherwise(F.col(one))
            swapped[two] = F.when(cond, F.col(one)).otherwise(F.col(two))
    return pairs.withColumns(swapped)


def append_suffix(pairs: DataFrame, column: str, suffix: str = SUFFIX, when: Column | None = None) -> DataFrame:
    """Adds a sentence to a text column, everywhere or where ``when`` holds; null texts count as empty."""
    added = F.concat(T.text_or_empty(column), F.lit(suffix))
    return pairs.withColumn(column, added if when is None else F.when(when, added).otherwise(F.col(column)))


def few_shots(pairs: DataFrame, shots: dict[int, int], key: str = "pair_id") -> DataFrame:
    """The example pairs for a prompt with their wanted results."""
    found = F.lit(None).cast("int")
    for k, v in shots.items():
        found = F.when(F.col(key) == k, v).otherwise(found)
    return pairs.where(F.col(key).isin(*shots)).withColumn("result", found)


def distinct_texts(*columns: DataFrame) -> DataFrame:
    """Union without repetitions of one-column tables, as ``text``; nulls are left out."""
    out = None
    for df in columns:
        one = df.select(F.col(df.columns[0]).alias("text")).where("text is not null")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def all_texts(pairs: DataFrame, first: str = "text_1", second: str = "text_2") -> DataFrame:
    """Both text columns below each other, repetitions kept (document frequencies depend on them); nulls as empty."""
    return pairs.select(T.text_or_empty(first).alias("text")).unionAll(pairs.select(T.text_or_empty(second).alias("text")))


def cross_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Every résumé with every vacancy: this operator's result is the product by definition, so one side
    should be a chosen few. Texts are numbered in the order of their hashes; the label is true.

    The product is made block by block: the first side is cut into blocks by number and each row of the second side meets all
    blocks, so that no task holds a whole side and neither side is broadcast unchecked."""
    number = lambda df, name: number_rows(materialize(df.select("text").orderBy(F.xxhash64("text"), "text"), "texts"), name)
    a, b = number(first, "i").withColumnRenamed("text", "text_1"), number(second, "j").withColumnRenamed("text", "text_2")
    a, b = materialize(a, "first"), materialize(b, "second")
    blocks = max(1, -(-a.count() // CROSS_BLOCK))
    left = a.withColumn("_block", F.floor(F.col("i") / CROSS_BLOCK).cast("int"))
    right = b.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.join(right, "_block").select(
        "text_1", "text_2", F.concat(F.lit("Resume "), "i").alias("title_1"), F.concat(F.lit("Vacancy "), "j").alias("title_2"), F.lit(True).alias("need_match")
    )


def big_dataset(pairs: DataFrame, others: DataFrame, resume: str = "text_2", vacancy: str = "text_1") -> DataFrame:
    """The smallest résumé (a fixed choice) against all distinct vacancies of two tables."""
    vacancies = distinct_texts(pairs.select(vacancy), others.select(vacancy))
    one = pairs.where(F.col(resume).isNotNull()).agg(F.min(resume).alias("text_r"))
    return vacancies.crossJoin(F.broadcast(one)).select(F.col("text_r").alias("text_1"), F.col("text").alias("text_2"), F.lit(True).alias("need_match"))


def profile(pairs: DataFrame, *group: str) -> DataFrame:
    """Size, positives, distinct texts, mean length and quartile range of both sides."""
    one, two = F.length(T.text_or_empty("text_1")), F.length(T.text_or_empty("text_2"))
    iqr = lambda c: F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))
    return pairs.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.count_if("need_match").alias("positives"),
        # digests are shuffled, not the texts
        F.countDistinct(F.xxhash64("text_1"), F.length("text_1")).alias("unique_1"),
        F.countDistinct(F.xxhash64("text_2"), F.length("text_2")).alias("unique_2"),
        F.round(F.avg(one), 6).alias("mean_1"),
        F.round(F.avg(two), 6).alias("mean_2"),
        F.round(iqr(one), 6).alias("iqr_1"),
        F.round(iqr(two), 6).alias("iqr_2"),
    )
