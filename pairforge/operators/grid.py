"""Parameter grids and reports over runs."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def merge_grids(*grids: dict[str, list]) -> list[dict]:
    """Every combination of the values of all grids, keys sorted, the last key fastest."""
    merged: dict[str, list] = {}
    for g in grids:
        merged |= g
    keys = sorted(merged)
    return [dict(zip(keys, values)) for values in itertools.product(*(merged[k] for k in keys))]


def grid_frame(spark: SparkSession, *grids: dict[str, list]) -> DataFrame:
    """The combinations as rows with their ``position``; an empty grid gives one row."""
    rows = [{"position": i} | row for i, row in enumerate(merge_grids(*grids))]
    return spark.createDataFrame(rows)


def cutoff_axis(scored: DataFrame, steps: int = 20, value: str = "value") -> DataFrame:
    """Every score once per keyword cutoff of [0, 1]; scores below the cutoff (in percent) become 0.
    Scores are shared along this axis, nothing is matched again."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.round(k / F.lit(float(steps - 1)), 9))
    rows = scored.withColumn("kw_cutoff", F.explode(grid))
    return rows.withColumn(value, F.when(F.col(value) < F.col("kw_cutoff") * 100, 0.0).otherwise(F.col(value)))


def argmax(runs: DataFrame, group: list[str], metric: str, position: str = "position") -> DataFrame:
    """The row of the largest metric per group; ties fall to the smallest position, rows without metric come last."""
    w = Window.partitionBy(*group).orderBy(F.col(metric).desc_nulls_last(), F.col(position))
    return runs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def timing_report(timings: DataFrame, scenarios: list[str]) -> DataFrame:
    """Mean times of each model, one column per scenario."""
    return timings.groupBy("model").pivot("scenario", scenarios).agg(F.round(F.avg("time"), 6))
