"""Rows delivered again: found by narrow columns, so that only they are shuffled with all their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: 64-bit slots of the filter that tells keys which may occur more than once; bounds what is broadcast (16 bytes each).
SLOTS = 1 << 17


def split_repeated(df: DataFrame, key: str, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """``(single, perhaps repeated)`` rows with a key; the first hold each key once, rows without a key are in neither.

    Keys are counted without any other column. Those that occur more than once set a bit each in a filter of ``slots``
    64-bit slots, which is broadcast. Rows whose bit is clear are the only ones of their key; the others may share it with a
    repeated key by chance. With more repeated keys than bits all rows are among the others, which is slower and no less right.
    """
    mask = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), 64) as int))")
    place = lambda d: d.withColumns({"_slot": F.floor(F.pmod(F.xxhash64(key), F.lit(64 * slots)) / 64).cast("long"), "_mask": mask})
    keyed = df.where(F.col(key).isNotNull())
    again = keyed.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    bits = place(again).groupBy("_slot").agg(F.bit_or("_mask").alias("_bits"))
    marked = place(keyed).join(F.broadcast(bits), "_slot", "left").withColumn("_again", F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) != 0, F.lit(False)))
    return marked.where("not _again").select(df.columns), marked.where("_again").select(df.columns)


def _few_splits(df: DataFrame) -> bool:
    """Whether a table is so small that the reader gives it fewer splits than there are cores (4 MB are the least of a split)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size < df.sparkSession.sparkContext.defaultParallelism * (4 << 20)


def latest(df: DataFrame, key: str, order: str = "loaded_at", slots: int = SLOTS) -> DataFrame:
    """One row per key: the one delivered last; rows without a key are left out. Of rows with the same key and
    time the one with the smallest hash of all columns is taken, so that the choice is the same every time. A table too small
    to be read by all cores is shuffled whole, which spreads it over them for what follows; the rows are the same."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    first = lambda d: d.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    if _few_splits(df):
        return first(df.where(F.col(key).isNotNull()))
    single, repeated = split_repeated(df, key, slots)
    return single.unionByName(first(repeated))


def once(df: DataFrame, key: str, slots: int = SLOTS) -> DataFrame:
    """One row per key, any of those that hold it; rows without a key stay as they are."""
    single, repeated = split_repeated(df, key, slots)
    return single.unionByName(repeated.dropDuplicates([key])).unionByName(df.where(F.col(key).isNull()))
