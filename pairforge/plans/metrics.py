"""Queries of evaluation and data sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import text as T
from pairforge.operators import metrics as M
from pairforge.operators import pairs as P
from pairforge.session import table
from pairforge.sources import readers as R

PAIRS_SQL = "pairs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY loaded_at DESC) AS rn FROM datum WHERE pair_id IS NOT NULL) WHERE rn = 1)"
SCORED_SQL = (
    PAIRS_SQL
    + r""", toks AS (SELECT coalesce(dataset, 'none') AS dataset, pair_id, coalesce(need_match, false) AS y,
  list_distinct(regexp_extract_all(lower(coalesce(text_1, '')), '[\p{L}\p{N}_]{2,}')) AS a,
  list_distinct(regexp_extract_all(lower(coalesce(text_2, '')), '[\p{L}\p{N}_]{2,}')) AS b FROM pairs),
scored AS (SELECT dataset, pair_id, y, coalesce(round(100.0::DOUBLE * len(list_intersect(a, b)) / nullif(len(a) + len(b) - len(list_intersect(a, b)), 0), 3), 0.0::DOUBLE) AS value FROM toks)"""
)
CURVE_SQL = (
    SCORED_SQL
    + """, g AS (SELECT dataset, value AS score, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM scored GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY dataset) AS pos, sum(n) OVER (PARTITION BY dataset) AS neg
      FROM g WINDOW w AS (PARTITION BY dataset ORDER BY score DESC)),
roc AS (SELECT dataset, score, CAST(fp AS DOUBLE) / nullif(neg, 0) AS fpr, CAST(tp AS DOUBLE) / nullif(pos, 0) AS tpr,
        CAST(fp - n AS DOUBLE) / nullif(neg, 0) AS fpr0, CAST(tp - p AS DOUBLE) / nullif(pos, 0) AS tpr0 FROM c),
pr AS (SELECT dataset, score, CAST(tp AS DOUBLE) / (tp + fp) AS prec, CAST(tp AS DOUBLE) / nullif(pos, 0) AS rec,
       coalesce(CAST(tp - p AS DOUBLE) / nullif(tp - p + fp - n, 0), 1.0) AS prec0, CAST(tp - p AS DOUBLE) / nullif(pos, 0) AS rec0 FROM c),
prf AS (SELECT *, 2 * prec * rec / nullif(prec + rec, 0) AS f1 FROM pr)"""
)
_SWEEP = """, grid AS (SELECT CAST(k AS INTEGER) AS k, k * {top} / {last} AS c0 FROM range({steps}) t(k)), cut AS (SELECT k, {round} AS cutoff FROM grid),
s AS (SELECT dataset, k, cutoff, count(*) FILTER (WHERE y AND value{scale} >= cutoff) AS tp, count(*) FILTER (WHERE NOT y AND value{scale} >= cutoff) AS fp,
      count(*) FILTER (WHERE y AND value{scale} < cutoff) AS fn, count(*) FILTER (WHERE NOT y AND value{scale} < cutoff) AS tn FROM scored CROSS JOIN cut GROUP BY ALL)"""
F1_SWEEP_SQL = SCORED_SQL + _SWEEP.format(top="100.0::DOUBLE", last="999.0::DOUBLE", steps=1000, round="c0", scale="")
UNIT_SQL = SCORED_SQL + _SWEEP.format(top="1.0::DOUBLE", last="50.0::DOUBLE", steps=51, round="round(c0, 2)", scale=" / 100.0::DOUBLE")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.latest(table(spark, sf_dir, "datum"), "pair_id")


def overlap_score(df: DataFrame) -> DataFrame:
    """Share of common tokens as ``value`` from 0 to 100, 0 if both texts have none."""
    sides = F.struct(F.array_distinct(T.tokens("text_1")).alias("a"), F.array_distinct(T.tokens("text_2")).alias("b"))
    sizes = lambda s: F.struct(F.size(F.array_intersect(s["a"], s["b"])).alias("both"), (F.size(s["a"]) + F.size(s["b"])).alias("sum"))
    share = lambda n: F.when(n["sum"] == 0, 0.0).otherwise(F.round(100.0 * n["both"] / F.nullif(n["sum"] - n["both"], F.lit(0)), 3))
    return df.withColumn("value", T.let(T.let(sides, sizes), share))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = overlap_score(pairs(spark, sf_dir).select("pair_id", F.coalesce("dataset", F.lit("none")).alias("dataset"), F.coalesce("need_match", F.lit(False)).alias("need_match"), "text_1", "text_2"))
    return df.select("pair_id", "dataset", "need_match", "value")


def unit_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("value", F.col("value") / F.lit(100.0))


G = ["dataset"]
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("overlap_match", "WITH " + SCORED_SQL + " SELECT pair_id, dataset, y AS need_match, value FROM scored")
def _(spark, sf):
    return scored(spark, sf)


@query(
    "roc_auc",
    "WITH " + CURVE_SQL + """, best AS (SELECT dataset, score, row_number() OVER (PARTITION BY dataset ORDER BY round(tpr - fpr, 12) DESC NULLS LAST, score DESC) AS rn FROM roc)
SELECT r.dataset, round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 9) AS auc, max(CASE WHEN rn = 1 THEN best.score END) AS cutoff
FROM roc r JOIN best ON r.dataset = best.dataset AND r.score = best.score GROUP BY r.dataset""",
)
def _(spark, sf):
    return M.roc_auc(scored(spark, sf), G)


@query("roc_curve", "WITH " + CURVE_SQL + " SELECT dataset, score, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM roc")
def _(spark, sf):
    return M.roc_curve(scored(spark, sf), G).select("dataset", "score", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(
    "youden_cutoff",
    "WITH " + CURVE_SQL + " SELECT dataset, score AS cutoff FROM (SELECT dataset, score, row_number() OVER (PARTITION BY dataset ORDER BY round(tpr - fpr, 12) DESC, score DESC) AS rn FROM roc) WHERE rn = 1",
)
def _(spark, sf):
    return M.roc_auc(scored(spark, sf), G).select("dataset", "cutoff")


@query("pr_curve", "WITH " + CURVE_SQL + " SELECT dataset, score, round(prec, 9) AS \"precision\", round(rec, 9) AS recall, round(f1, 9) AS f1 FROM prf")
def _(spark, sf):
    return M.pr_curve(scored(spark, sf), G).select("dataset", "score", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "pr_auc",
    "WITH " + CURVE_SQL + """, best AS (SELECT dataset, f1, score, row_number() OVER (PARTITION BY dataset ORDER BY round(f1, 12) DESC NULLS LAST, score) AS rn FROM prf),
a AS (SELECT dataset, round(sum((rec - rec0) * (prec + prec0) / 2), 9) AS auprc FROM pr GROUP BY dataset)
SELECT a.dataset, auprc, round(f1, 9) AS f1, score AS cutoff FROM a JOIN best ON a.dataset = best.dataset AND rn = 1""",
)
def _(spark, sf):
    return M.pr_auc(scored(spark, sf), G)


_F1 = "round(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), {})"


@query(
    "f1_sweep",
    "WITH " + F1_SWEEP_SQL + f", b AS (SELECT *, {_F1.format(9)} AS f1 FROM s) SELECT dataset, f1, k, round(cutoff, 9) AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY f1 DESC NULLS LAST, k) AS rn FROM b) WHERE rn = 1",
)
def _(spark, sf):
    return M.f1_sweep(scored(spark, sf), G).withColumn("cutoff", F.round("cutoff", 9))


@query("cutoff_sweep", "WITH " + F1_SWEEP_SQL + " SELECT dataset, k, round(cutoff, 9) AS cutoff, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn FROM s")
def _(spark, sf):
    return M.sweep(scored(spark, sf), G).withColumn("cutoff", F.round("cutoff", 9))


@query(
    "anm_max_f1",
    "WITH " + UNIT_SQL + f", b AS (SELECT *, {_F1.format(3)} AS f1 FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY f1 DESC NULLS LAST, k) AS rn FROM b) SELECT dataset, f1, CASE WHEN f1 > 0 THEN cutoff ELSE 0.0::DOUBLE END AS cutoff FROM r WHERE rn = 1",
)
def _(spark, sf):
    return M.unit_max_f1(unit_scored(spark, sf), G)


_RATES = ", t AS (SELECT dataset, k, cutoff, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 3) AS tpr, round(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 3) AS fpr FROM s)"


@query("anm_tpr_fpr", "WITH " + UNIT_SQL + _RATES + " SELECT * FROM t")
def _(spark, sf):
    return M.unit_tpr_fpr(unit_scored(spark, sf), G)


@query(
    "anm_roc_auc",
    "WITH " + UNIT_SQL + _RATES + """, l AS (SELECT *, round(tpr - fpr, 3) AS diff, abs(lead(fpr) OVER w - fpr) * (lead(tpr) OVER w + tpr) / 2 AS area FROM t WINDOW w AS (PARTITION BY dataset ORDER BY k)),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN diff > 0 THEN diff END DESC NULLS LAST, k) AS rn FROM l)
SELECT dataset, round(sum(area), 7) AS auc, max(CASE WHEN rn = 1 THEN CASE WHEN diff > 0 THEN cutoff ELSE 0.0::DOUBLE END END) AS cutoff FROM r GROUP BY dataset""",
)
def _(spark, sf):
    return M.unit_roc_auc(unit_scored(spark, sf), G)


@query(
    "confusion_matrix",
    "WITH " + SCORED_SQL + """, k AS (SELECT dataset, count(*) FILTER (WHERE y AND value >= 12.5) AS tp, count(*) FILTER (WHERE NOT y AND value >= 12.5) AS fp,
 count(*) FILTER (WHERE y AND value < 12.5) AS fn, count(*) FILTER (WHERE NOT y AND value < 12.5) AS tn FROM scored GROUP BY dataset)
SELECT dataset, tp, fp, fn, tn, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 9) AS "precision", round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 9) AS recall,
 round(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 9) AS f1, fn AS compat_fp, fp AS compat_fn,
 round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 9) AS compat_precision, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 9) AS compat_recall FROM k""",
)
def _(spark, sf):
    return M.confusion(scored(spark, sf), G, 12.5)


@query("match_predicate", "WITH " + SCORED_SQL + ' SELECT pair_id, value >= 12.5 AS "match" FROM scored')
def _(spark, sf):
    return scored(spark, sf).select("pair_id", (F.col("value") >= 12.5).alias("match"))


@query(
    "dataset_profile",
    "WITH " + PAIRS_SQL + """, l AS (SELECT coalesce(dataset, 'none') AS dataset, need_match, text_1, text_2, length(coalesce(text_1, '')) AS a, length(coalesce(text_2, '')) AS b FROM pairs)
SELECT dataset, count(*) AS n, count(*) FILTER (WHERE need_match) AS positives, count(DISTINCT text_1) AS unique_1, count(DISTINCT text_2) AS unique_2,
 round(avg(a), 6) AS mean_1, round(avg(b), 6) AS mean_2, round(quantile_cont(a, 0.75) - quantile_cont(a, 0.25), 6) AS iqr_1, round(quantile_cont(b, 0.75) - quantile_cont(b, 0.25), 6) AS iqr_2 FROM l GROUP BY dataset""",
)
def _(spark, sf):
    return P.profile(pairs(spark, sf).withColumn("dataset", F.coalesce("dataset", F.lit("none"))), "dataset")


# ---- sources


@query(
    "pair_labels",
    """SELECT CAST('rpd_dataset' AS VARCHAR) AS dataset, row_id AS pair_id, concat_ws(': ', id_rp, name_rp) AS title_1, concat_ws(': ', id_proj, name_proj) AS title_2, coalesce(need_match, false) AS need_match
 FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC) AS rn FROM rpd_dataset WHERE row_id IS NOT NULL) WHERE rn = 1
UNION ALL SELECT 'studentor_partner', row_id, title_1, title_2, coalesce(need_match = 'TRUE', false)
 FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC) AS rn FROM studentor_partner WHERE row_id IS NOT NULL) WHERE rn = 1
UNION ALL SELECT 'dataset_v6_r30', row_id, concat('vacancy_', row_id), concat('resume_', row_id), coalesce(result = '1', false)
 FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC) AS rn FROM dataset_v6_r30 WHERE row_id IS NOT NULL) WHERE rn = 1""",
)
def _(spark, sf):
    out = None
    for name in R.TABLES:
        one = R.to_pairs(P.latest(table(spark, sf, name), "row_id"), name).select(F.lit(name).alias("dataset"), "pair_id", "title_1", "title_2", "need_match")
        out = one if out is None else out.unionByName(one)
    return out


@query("swap_pairs", "WITH " + PAIRS_SQL + " SELECT pair_id, CASE WHEN dataset <> 'all_examples' THEN title_2 ELSE title_1 END AS title_1, CASE WHEN dataset <> 'all_examples' THEN title_1 ELSE title_2 END AS title_2, md5(CASE WHEN dataset <> 'all_examples' THEN text_2 ELSE text_1 END) AS text_1, md5(CASE WHEN dataset <> 'all_examples' THEN text_1 ELSE text_2 END) AS text_2 FROM pairs")
def _(spark, sf):
    df = P.swap(pairs(spark, sf), F.col("dataset") != "all_examples")
    return df.select("pair_id", "title_1", "title_2", F.md5("text_1").alias("text_1"), F.md5("text_2").alias("text_2"))


@query("append_suffix", "WITH " + PAIRS_SQL + f" SELECT pair_id, md5(CASE WHEN pair_id = 1 THEN concat(coalesce(text_2, ''), '{P.SUFFIX}') ELSE text_2 END) AS text_2, length(concat(coalesce(text_1, ''), '{P.SUFFIX}')) AS len_1 FROM pairs")
def _(spark, sf):
    df = P.append_suffix(P.append_suffix(pairs(spark, sf), "text_2", when=F.col("pair_id") == 1), "text_1")
    return df.select("pair_id", F.md5("text_2").alias("text_2"), F.length("text_1").cast("long").alias("len_1"))


@query("few_shot_index", "WITH " + PAIRS_SQL + " SELECT pair_id, title_1, title_2, CAST(CASE pair_id WHEN 13 THEN 100 WHEN 28 THEN 90 END AS INTEGER) AS result FROM pairs WHERE pair_id IN (13, 28)")
def _(spark, sf):
    return P.few_shots(pairs(spark, sf), {13: 100, 28: 90}).select("pair_id", "title_1", "title_2", "result")


@query("union_distinct_texts", "SELECT md5(t) AS text_hash FROM (SELECT vacancy AS t FROM dataset_v6_r30 UNION SELECT text_1 FROM studentor_partner) WHERE t IS NOT NULL")
def _(spark, sf):
    return P.distinct_texts(table(spark, sf, "dataset_v6_r30").select("vacancy"), table(spark, sf, "studentor_partner").select("text_1")).select(F.md5("text").alias("text_hash"))


@query("text_corpus", "SELECT count(*) AS n, count(DISTINCT t) AS unique_texts, CAST(sum(length(t)) AS BIGINT) AS letters FROM (SELECT coalesce(text_1, '') AS t FROM studentor_partner UNION ALL SELECT coalesce(text_2, '') FROM studentor_partner)")
def _(spark, sf):
    return P.all_texts(table(spark, sf, "studentor_partner")).agg(F.count("*").alias("n"), F.countDistinct("text").alias("unique_texts"), F.sum(F.length("text")).alias("letters"))


@query("cross_pairs", "WITH v AS (SELECT vacancy AS t FROM dataset_v6_r30 UNION SELECT text_1 FROM studentor_partner), r AS (SELECT min(resume) AS r FROM dataset_v6_r30) SELECT md5(r) AS text_1, md5(t) AS text_2, true AS need_match FROM v CROSS JOIN r WHERE t IS NOT NULL")
def _(spark, sf):
    a = table(spark, sf, "dataset_v6_r30").select(F.col("vacancy").alias("text_1"), F.col("resume").alias("text_2"))
    b = table(spark, sf, "studentor_partner").select("text_1")
    return P.big_dataset(a, b).select(F.md5("text_1").alias("text_1"), F.md5("text_2").alias("text_2"), "need_match")


@query("cross_product", "SELECT md5(b.text) AS text_1, md5(v.vacancy) AS text_2, true AS need_match FROM (SELECT DISTINCT text FROM benchmark WHERE text IS NOT NULL) b CROSS JOIN (SELECT DISTINCT vacancy FROM dataset_v6_r30 WHERE vacancy IS NOT NULL) v")
def _(spark, sf):
    """Every item with every vacancy."""
    items = P.distinct_texts(table(spark, sf, "benchmark").select("text"))
    vacancies = P.distinct_texts(table(spark, sf, "dataset_v6_r30").select("vacancy"))
    return P.cross_pairs(items, vacancies).select(F.md5("text_1").alias("text_1"), F.md5("text_2").alias("text_2"), "need_match")


# ---- runs over models and data sets

_MODELS_SQL = ", models AS (SELECT dataset, 'overlap' AS model, pair_id, y, value FROM scored UNION ALL SELECT dataset, 'length', pair_id, y, value FROM (SELECT coalesce(dataset, 'none') AS dataset, pair_id, coalesce(need_match, false) AS y, round(100.0::DOUBLE * least(length(coalesce(text_1, '')), length(coalesce(text_2, ''))) / greatest(length(coalesce(text_1, '')), length(coalesce(text_2, '')), 1), 3) AS value FROM pairs))"


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two plain scorers side by side, for the runs over several models."""
    base = pairs(spark, sf_dir).select("pair_id", F.coalesce("dataset", F.lit("none")).alias("dataset"), F.coalesce("need_match", F.lit(False)).alias("need_match"), "text_1", "text_2")
    one, two = F.length(T.text_or_empty("text_1")), F.length(T.text_or_empty("text_2"))
    both = overlap_score(base).withColumn("length", F.round(100.0 * F.least(one, two) / F.greatest(one, two, F.lit(1)), 3))
    long = both.select("dataset", "pair_id", "need_match", F.explode(F.array(F.struct(F.lit("overlap").alias("model"), F.col("value")), F.struct(F.lit("length").alias("model"), F.col("length").alias("value")))).alias("m"))
    return long.select("dataset", "m.model", "pair_id", "need_match", "m.value")


@query(
    "grand_total",
    "WITH " + SCORED_SQL + _MODELS_SQL + """, g AS (SELECT dataset, model, value AS score, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM models GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER q AS pos, sum(n) OVER q AS neg FROM g WINDOW w AS (PARTITION BY dataset, model ORDER BY score DESC), q AS (PARTITION BY dataset, model)),
roc AS (SELECT *, CAST(fp AS DOUBLE) / nullif(neg, 0) AS fpr, CAST(tp AS DOUBLE) / nullif(pos, 0) AS tpr, CAST(fp - n AS DOUBLE) / nullif(neg, 0) AS fpr0, CAST(tp - p AS DOUBLE) / nullif(pos, 0) AS tpr0,
 CAST(tp AS DOUBLE) / (tp + fp) AS prec, coalesce(CAST(tp - p AS DOUBLE) / nullif(tp - p + fp - n, 0), 1.0) AS prec0 FROM c),
m AS (SELECT dataset, model, round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 9) AS auc, round(sum((tpr - tpr0) * (prec + prec0) / 2), 9) AS auprc FROM roc GROUP BY ALL)
SELECT dataset, model, auc, auprc, CAST(row_number() OVER (PARTITION BY dataset ORDER BY auc DESC NULLS LAST, model) AS INTEGER) AS place FROM m""",
)
def _(spark, sf):
    from pyspark.sql import Window

    g = ["dataset", "model"]
    long = M.by_score(models(spark, sf), g)
    out = M.roc_auc(long, g).drop("cutoff").join(M.pr_auc(long, g).select(*g, "auprc"), g)
    place = F.row_number().over(Window.partitionBy("dataset").orderBy(F.col("auc").desc_nulls_last(), "model"))
    return out.select("dataset", "model", "auc", "auprc", place.alias("place"))


@query(
    "cutoff_to_zero_grid",
    "WITH " + SCORED_SQL + ", grid AS (SELECT round(k / 19.0::DOUBLE, 9) AS kw_cutoff FROM range(20) t(k)) SELECT dataset, kw_cutoff, round(avg(CASE WHEN value < kw_cutoff * 100 THEN 0.0::DOUBLE ELSE value END), 6) AS mean_value FROM scored CROSS JOIN grid GROUP BY ALL",
)
def _(spark, sf):
    from pairforge.operators import grid as G_

    return G_.cutoff_axis(scored(spark, sf), 20).groupBy("dataset", "kw_cutoff").agg(F.round(F.avg("value"), 6).alias("mean_value"))


@query("param_grid", "SELECT CAST(w AS INTEGER) AS window_size, CAST(d AS INTEGER) AS window_delta, round(k / 19.0::DOUBLE, 9) AS kw_cutoff FROM (VALUES (120), (170), (250)) a(w), (VALUES (25), (50)) b(d), range(20) t(k)")
def _(spark, sf):
    from pairforge.operators import grid as G_

    return G_.grid_frame(spark, {"window_size": [120, 170, 250], "window_delta": [25, 50], "kw_cutoff": [round(k / 19, 9) for k in range(20)]}).drop("position")


@query(
    "grid_argmax",
    "WITH " + SCORED_SQL + """, grid AS (SELECT k, round(k / 19.0::DOUBLE, 9) AS kw_cutoff FROM range(20) t(k)),
r AS (SELECT dataset, k, kw_cutoff, count(*) FILTER (WHERE y AND value >= kw_cutoff * 100) AS tp, count(*) FILTER (WHERE NOT y AND value >= kw_cutoff * 100) AS fp, count(*) FILTER (WHERE y AND value < kw_cutoff * 100) AS fn FROM scored CROSS JOIN grid GROUP BY ALL),
f AS (SELECT *, round(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM r)
SELECT dataset, kw_cutoff, f1 FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY f1 DESC NULLS LAST, k) AS rn FROM f) WHERE rn = 1""",
)
def _(spark, sf):
    from pairforge.operators import grid as G_

    runs = M.sweep(scored(spark, sf), G, 0.0, 100.0, 20)
    f1 = F.round(2.0 * F.col("tp") / F.nullif((2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double"), F.lit(0.0)), 9)
    rows = runs.select("dataset", F.col("k").alias("position"), F.round(F.col("k") / 19.0, 9).alias("kw_cutoff"), f1.alias("f1"))
    return G_.argmax(rows, ["dataset"], "f1").select("dataset", "kw_cutoff", "f1")


@query(
    "timings_pivot",
    "SELECT kind AS model, round(avg(n_chars) FILTER (WHERE source = 'campus_portal'), 6) AS campus_portal, round(avg(n_chars) FILTER (WHERE source = 'partner_feed'), 6) AS partner_feed FROM documents GROUP BY kind",
)
def _(spark, sf):
    from pairforge.operators import grid as G_

    df = table(spark, sf, "documents").select(F.col("kind").alias("model"), F.col("source").alias("scenario"), F.col("n_chars").alias("time"))
    return G_.timing_report(df, ["campus_portal", "partner_feed"])


@query("group_by_params", "WITH " + SCORED_SQL + " SELECT dataset, y AS need_match, count(*) AS n, round(avg(value), 6) AS mean_value, max(value) AS best FROM scored GROUP BY ALL")
def _(spark, sf):
    return scored(spark, sf).groupBy("dataset", "need_match").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("best"))
