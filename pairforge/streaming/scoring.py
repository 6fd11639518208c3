"""Scoring of pairs as they arrive.

Pairs delivered again within the watermark are dropped by key; what is later than that is scored
again and left to the sink's key. Any stateless column expression or bulk matcher can score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pairs(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file, with the schema of what is there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rpartition("/")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():  # a stream reads folders only
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def deduplicated(pairs: DataFrame, key: str = "pair_id", time: str = "loaded_at", delay: str = "400 days") -> DataFrame:
    """One row per key within the delay; the state is bounded by the watermark: one small row for each key of that time.
    The default suits a table that is streamed once, whose deliveries lie far apart; for a running stream give the longest time
    between two deliveries of a pair."""
    return pairs.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def score_stream(pairs: DataFrame, score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Starts a query that scores each batch and hands it to a sink with the batch number, which makes writes repeatable."""
    writer = pairs.writeStream.foreachBatch(lambda batch, number: sink(score(batch), number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def label_counts(pairs: DataFrame, time: str = "loaded_at", delay: str = "1 day", window: str = "1 day") -> DataFrame:
    """Pairs and positives by window of arrival and data set, late rows up to the delay."""
    return pairs.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, window), "dataset").agg(F.count("*").alias("n"), F.count_if("need_match").alias("positives"))
