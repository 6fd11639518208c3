"""Exact evaluation of scored pairs: curves, areas, best cutoffs, confusion.

All start from one aggregation by score (partial sums before the shuffle). Running sums over the
scores then go in two levels: sums over a fixed number of score bands, and windows within a band,
so that no task sees all scores of a group, however large one group is. The bands hold about equally many
distinct scores (their edges are quantiles), so that an outlier does not crowd all others into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.storage import materialize

#: Bands of a group, and the accuracy of their edges: the rank is off by at most 1 / ACCURACY of the scores.
BANDS = 200
ACCURACY = 20_000


def _div(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def _meet(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; without keys the other side is a single row. Spark checks sizes and chooses the way."""
    if not keys:
        return df.crossJoin(F.broadcast(other))
    for k in keys:
        other = other.withColumnRenamed(k, f"_{k}")
    same = [df[k].eqNullSafe(other[f"_{k}"]) for k in keys]
    return df.join(other, same, how).drop(*[f"_{k}" for k in keys])


def by_score(scored: DataFrame, group: list[str], y: str = "need_match", value: str = "value") -> DataFrame:
    """Positives ``p`` and negatives ``n`` of each distinct score; null labels count as negative, null scores
    are left out. The counts are written, so that what follows does not score again; a table of counts
    passes as it is, for several measures of one run."""
    if {"score", "p", "n"} <= set(scored.columns):
        return scored
    label = F.coalesce(F.col(y), F.lit(False))
    counts = scored.groupBy(*group, F.col(value).alias("score")).agg(F.sum(label.cast("long")).alias("p"), F.sum((~label).cast("long")).alias("n"))
    return materialize(counts.where("score is not null"), "counts")  # a filter before would compute each score twice


def cumulative(counts: DataFrame, group: list[str]) -> DataFrame:
    """Adds ``tp``, ``fp`` (at or above each score) and the totals ``pos``, ``neg``."""
    shares = F.array(*[F.lit(k / BANDS) for k in range(1, BANDS)])
    edges = counts.groupBy(*group).agg(F.percentile_approx(F.col("score").cast("double"), shares, ACCURACY).alias("edges"))
    # the number of edges below a score, by bisection: eight steps for 200 edges
    below = F.aggregate(F.array(*[F.lit(1 << k) for k in range(7, -1, -1)]), F.lit(0), lambda at, step: F.when((at + step <= F.size("edges")) & (F.get("edges", at + step - 1) < F.col("score")), at + step).otherwise(at))
    banded = _meet(counts, edges, group).withColumn("band", below).drop("edges")
    bands = banded.groupBy(*group, "band").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    above = Window.partitionBy(*group).orderBy(F.col("band").desc())
    whole = Window.partitionBy(*group)
    bands = bands.select(
        *group, "band", (F.sum("bp").over(above) - F.col("bp")).alias("up"), (F.sum("bn").over(above) - F.col("bn")).alias("un"), F.sum("bp").over(whole).alias("pos"), F.sum("bn").over(whole).alias("neg")
    )  # at most BANDS rows per group
    within = Window.partitionBy(*group, "band").orderBy(F.col("score").desc())
    running = banded.withColumns({"tp": F.sum("p").over(within), "fp": F.sum("n").over(within)})
    return _meet(running, bands, [*group, "band"]).select(
        *group, "score", "p", "n", (F.col("tp") + F.col("up")).alias("tp"), (F.col("fp") + F.col("un")).alias("fp"), "pos", "neg"
    )


def roc_curve(scored: DataFrame, group: list[str], **cols: str) -> DataFrame:
    """One row per distinct score: ``score``, ``fpr``, ``tpr``, and the point before it."""
    c = cumulative(by_score(scored, group, **cols), group)
    return c.select(
        *group,
        "score",
        _div(F.col("fp"), F.col("neg")).alias("fpr"),
        _div(F.col("tp"), F.col("pos")).alias("tpr"),
        _div(F.col("fp") - F.col("n"), F.col("neg")).alias("fpr_before"),
        _div(F.col("tp") - F.col("p"), F.col("pos")).alias("tpr_before"),
    )


def _best(df: DataFrame, group: list[str], metric: str, ties: Column, *keep: str) -> DataFrame:
    """The row with the largest metric per group without sorting the group: a maximum of structs."""
    row = F.struct(F.col(metric).alias("_m"), ties.alias("_t"), *keep)
    return df.where(F.col(metric).isNotNull()).groupBy(*group).agg(F.max(row).alias("b")).select(*group, F.col(f"b._m").alias(metric), *[F.col(f"b.{k}") for k in keep])


def roc_auc(scored: DataFrame, group: list[str], **cols: str) -> DataFrame:
    """``auc`` by trapezoids, and the ``cutoff`` with the largest tpr - fpr (ties: the largest score); null if a class is missing."""
    curve = roc_curve(scored, group, **cols).withColumn("diff", F.col("tpr") - F.col("fpr"))
    area = (F.col("fpr") - F.col("fpr_before")) * (F.col("tpr") + F.col("tpr_before")) / 2
    row = F.struct(F.round("diff", 12).alias("d"), F.col("score").alias("s"))
    return curve.groupBy(*group).agg(F.round(F.sum(area), 9).alias("auc"), F.max(F.when(F.col("diff").isNotNull(), row))["s"].alias("cutoff"))


def pr_curve(scored: DataFrame, group: list[str], **cols: str) -> DataFrame:
    """One row per distinct score: ``precision``, ``recall``, ``f1`` (null at 0/0), and the point before it (1 and 0 at first)."""
    c = cumulative(by_score(scored, group, **cols), group)
    tp0, fp0 = F.col("tp") - F.col("p"), F.col("fp") - F.col("n")
    out = c.select(
        *group,
        "score",
        _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _div(F.col("tp"), F.col("pos")).alias("recall"),
        F.coalesce(_div(tp0, tp0 + fp0), F.lit(1.0)).alias("precision_before"),
        _div(tp0, F.col("pos")).alias("recall_before"),
    )
    return out.withColumn("f1", _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def pr_auc(scored: DataFrame, group: list[str], **cols: str) -> DataFrame:
    """``auprc`` by trapezoids from the point (0, 1), and the best ``f1`` with its ``cutoff`` (ties: the smallest score)."""
    curve = pr_curve(scored, group, **cols)
    area = (F.col("recall") - F.col("recall_before")) * (F.col("precision") + F.col("precision_before")) / 2
    row = F.struct(F.round("f1", 12).alias("f"), (-F.col("score")).alias("s"))
    best = F.max(F.when(F.col("f1").isNotNull(), row))
    return curve.groupBy(*group).agg(F.round(F.sum(area), 9).alias("auprc"), F.round(best["f"], 9).alias("f1"), (-best["s"]).alias("cutoff"))


def sweep(scored: DataFrame, group: list[str], start: float = 0.0, stop: float = 100.0, steps: int = 1000, digits: int | None = None, **cols: str) -> DataFrame:
    """Confusion at every cutoff of an even grid (``value >= cutoff`` matches): ``k``, ``cutoff``, ``tp``, ``fp``, ``fn``, ``tn``.

    A score falls into the interval of the last cutoff it reaches; a histogram of at most ``steps``
    rows per group is then summed from the top, so the pairs are read once, not once per cutoff.
    """
    grid = lambda k: F.lit(start) + k * F.lit(stop - start) / F.lit(float(steps - 1))
    at = (lambda k: F.round(grid(k), digits)) if digits is not None else grid
    counts = by_score(scored, group, **cols)
    guess = F.floor((F.col("score") - start) * F.lit(float(steps - 1)) / F.lit(stop - start)).cast("int")
    k = F.col("k0")
    exact = F.when(F.col("score") >= at(k + 1), k + 1).when(F.col("score") >= at(k), k).otherwise(k - 1)
    hist = counts.withColumn("k0", guess).withColumn("k", F.greatest(F.lit(-1), F.least(exact, F.lit(steps - 1)))).groupBy(*group, "k").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    session = scored.sparkSession
    groups = hist.groupBy(*group).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    points = session.range(steps).select(F.col("id").cast("int").alias("k"))
    full = _meet(groups.crossJoin(F.broadcast(points)), hist, [*group, "k"], "left")
    w = Window.partitionBy(*group).orderBy(F.col("k").desc())
    tp, fp = F.sum(F.coalesce("p", F.lit(0))).over(w), F.sum(F.coalesce("n", F.lit(0))).over(w)
    return full.select(*group, "k", at(F.col("k")).alias("cutoff"), tp.alias("tp"), fp.alias("fp"), (F.col("pos") - tp).alias("fn"), (F.col("neg") - fp).alias("tn"))


def f1_sweep(scored: DataFrame, group: list[str], **cols: str) -> DataFrame:
    """The best ``f1`` over 1000 cutoffs from 0 to 100 and the first ``cutoff`` that reaches it."""
    s = sweep(scored, group, **cols).withColumn("f1", F.round(_div(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 9))
    return _best(s, group, "f1", -F.col("k"), "k", "cutoff")


def unit_max_f1(scored: DataFrame, group: list[str], steps: int = 51, **cols: str) -> DataFrame:
    """For scores up to 1: the best F1 of a grid in [0, 1], rounded to three places; 0 and 0 if none is above 0."""
    s = sweep(scored, group, 0.0, 1.0, steps, 2, **cols).withColumn("f1", F.round(_div(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 3))
    best = _best(s, group, "f1", -F.col("k"), "cutoff")
    return best.withColumn("cutoff", F.when(F.col("f1") > 0, F.col("cutoff")).otherwise(0.0))


def unit_tpr_fpr(scored: DataFrame, group: list[str], steps: int = 51, **cols: str) -> DataFrame:
    """Rounded ``tpr`` and ``fpr`` at each cutoff of the grid in [0, 1]; null where a class is missing."""
    s = sweep(scored, group, 0.0, 1.0, steps, 2, **cols)
    return s.select(*group, "k", "cutoff", F.round(_div(F.col("tp"), F.col("tp") + F.col("fn")), 3).alias("tpr"), F.round(_div(F.col("fp"), F.col("fp") + F.col("tn")), 3).alias("fpr"))


def unit_roc_auc(scored: DataFrame, group: list[str], steps: int = 51, **cols: str) -> DataFrame:
    """Area over the rounded grid points, and the first cutoff with the largest rounded tpr - fpr above 0."""
    points = unit_tpr_fpr(scored, group, steps, **cols).withColumn("diff", F.round(F.col("tpr") - F.col("fpr"), 3))
    w = Window.partitionBy(*group).orderBy("k")
    area = F.abs(F.lead("fpr").over(w) - F.col("fpr")) * (F.lead("tpr").over(w) + F.col("tpr")) / 2
    row = F.struct(F.col("diff").alias("d"), (-F.col("k")).alias("t"), F.col("cutoff").alias("c"))
    out = points.withColumn("area", area).groupBy(*group).agg(F.round(F.sum("area"), 7).alias("auc"), F.max(F.when(F.col("diff") > 0, row)).alias("b"))
    return out.select(*group, "auc", F.coalesce("b.c", F.lit(0.0)).alias("cutoff"))


def confusion(scored: DataFrame, group: list[str], cutoff: float | Column, y: str = "need_match", value: str = "value") -> DataFrame:
    """Counts at a cutoff with the usual names, precision, recall and F1; the ``compat_`` columns carry the
    exchanged names of false positives and negatives, and what follows from them."""
    label, hit = F.coalesce(F.col(y), F.lit(False)), F.coalesce(F.col(value) >= cutoff, F.lit(False))
    n = lambda c: F.count_if(c)
    out = scored.groupBy(*group).agg(n(label & hit).alias("tp"), n(~label & hit).alias("fp"), n(label & ~hit).alias("fn"), n(~label & ~hit).alias("tn"))
    rate = lambda a, b: F.round(_div(F.col(a), F.col(a) + F.col(b)), 9)
    return out.withColumns(
        {
            "precision": rate("tp", "fp"),
            "recall": rate("tp", "fn"),
            "f1": F.round(_div(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 9),
            "compat_fp": F.col("fn"),
            "compat_fn": F.col("fp"),
            "compat_precision": rate("tp", "fn"),
            "compat_recall": rate("tp", "fp"),
        }
    )


def evaluate(scored: DataFrame, group: list[str], **cols: str) -> DataFrame:
    """All measures of a run in one row per group."""
    scored = by_score(scored, group, **cols)
    out = roc_auc(scored, group, **cols).withColumnRenamed("cutoff", "cutoff_auc")
    pr = pr_auc(scored, group, **cols).select(*group, "auprc", F.col("f1").alias("f1_pr"), F.col("cutoff").alias("cutoff_pr"))
    f1 = f1_sweep(scored, group, **cols).select(*group, "f1", F.round("cutoff", 9).alias("cutoff_f1"))
    return _meet(_meet(out, pr, group), f1, group)
