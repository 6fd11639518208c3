"""Queries of keywords, matchers, training and streams, with their SQL."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import fuzzy
from pairforge.functions import text as T
from pairforge.operators import experiments as EX
from pairforge.operators import keywords as K
from pairforge.operators import matchers as MA
from pairforge.operators import pairs as P
from pairforge.operators import training as TR
from pairforge.plans.metrics import SCORED_SQL, overlap_score
from pairforge.session import table
from pairforge.sources import readers as R
from pairforge.storage import materialize, shared_dir
from pairforge.streaming import scoring as S

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# ---- relational steps over a table of keyword-like rows: the terms of the corpus by record and place

_KW = """WITH r AS (SELECT rec_id, any_value(preprocessed_text) AS a FROM documents_preprocessed WHERE rec_id IS NOT NULL GROUP BY rec_id),
e AS (SELECT rec_id AS text_id, unnest(a) AS value, unnest(generate_series(0, len(a) - 1)) AS pos FROM r WHERE a IS NOT NULL AND len(a) > 0),
kw AS (SELECT text_id, value, pos, CASE pos % 3 WHEN 0 THEN 'SingleRank' WHEN 1 THEN 'PositionRank' ELSE 'YAKE' END AS source, round(1.0::DOUBLE / (pos % 7 + 2), 6) AS certainty, CAST(length(value) % 5 AS INTEGER) AS cluster
 FROM e WHERE value IS NOT NULL AND value <> '')"""


def keyword_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents_preprocessed").where("rec_id is not null").dropDuplicates(["rec_id"])
    e = rows.select(F.col("rec_id").alias("text_id"), F.posexplode("preprocessed_text").alias("pos", "value")).where("value is not null and value <> ''")
    source = F.when(F.col("pos") % 3 == 0, "SingleRank").when(F.col("pos") % 3 == 1, "PositionRank").otherwise("YAKE")
    return e.select("text_id", "value", "pos", source.alias("source"), F.round(1.0 / (F.col("pos") % 7 + 2), 6).alias("certainty"), (F.length("value") % 5).alias("cluster"))


@query("topk_keywords_by_tf", _KW + ", t AS (SELECT text_id, value, count(*) AS tf FROM kw GROUP BY ALL) SELECT text_id, value, tf, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY tf DESC, value) AS rn FROM t) WHERE rn <= 10")
def _(spark, sf):
    tf = keyword_rows(spark, sf).groupBy("text_id", "value").agg(F.count("*").alias("tf"))
    return K.top_keywords(tf, 10, ["text_id"], "tf").select("text_id", "value", "tf", "place")


@query("keyword_length_filter", _KW + " SELECT text_id, pos, value FROM kw WHERE length(value) < 12")
def _(spark, sf):
    return keyword_rows(spark, sf).where(F.length("value") < 12).select("text_id", F.col("pos").cast("long").alias("pos"), "value")


@query(
    "select_best_in_cluster",
    _KW + """, k AS (SELECT *, CASE source WHEN 'YAKE' THEN 1 WHEN 'PositionRank' THEN 2 ELSE 3 END AS rk FROM kw),
a AS (SELECT *, min(rk) OVER w AS fr, sum(certainty) OVER w AS total, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY text_id, cluster)),
b AS (SELECT *, max(certainty) OVER (PARTITION BY text_id, cluster) AS mx FROM a WHERE rk = fr),
c AS (SELECT *, row_number() OVER (PARTITION BY text_id, cluster ORDER BY length(value) DESC, certainty DESC, value) AS rn FROM b WHERE certainty > mx * 0.66)
SELECT text_id, cluster, value, round(least(total, 1.0::DOUBLE), 6) AS certainty, n AS items_num FROM c WHERE rn = 1""",
)
def _(spark, sf):
    return K.select_best(keyword_rows(spark, sf), ["text_id", "cluster"]).withColumn("certainty", F.round("certainty", 6))


@query("capped_certainty", _KW + " SELECT text_id, cluster, round(least(sum(certainty), 1.0::DOUBLE), 6) AS certainty, count(*) AS items_num FROM kw GROUP BY ALL")
def _(spark, sf):
    return keyword_rows(spark, sf).groupBy("text_id", "cluster").agg(F.round(F.least(F.sum("certainty"), F.lit(1.0)), 6).alias("certainty"), F.count("*").alias("items_num"))


@query("saturate_topk", _KW + ", s AS (SELECT text_id, certainty, row_number() OVER (PARTITION BY text_id ORDER BY certainty DESC) AS rn FROM kw) SELECT text_id, round(avg(certainty) * 100, 6) AS value FROM s WHERE rn <= 6 GROUP BY text_id")
def _(spark, sf):
    lists = keyword_rows(spark, sf).groupBy("text_id").agg(F.collect_list("certainty").alias("c"))
    return lists.select("text_id", F.round(K.saturated_mean(F.col("c"), 6) * 100, 6).alias("value"))


@query("cutoff_to_zero", _KW + " SELECT text_id, pos, CASE WHEN certainty * 100 < 25 THEN 0.0::DOUBLE ELSE round(certainty * 100, 6) END AS value FROM kw")
def _(spark, sf):
    return keyword_rows(spark, sf).select("text_id", F.col("pos").cast("long").alias("pos"), K.cut_to_zero(F.round(F.col("certainty") * 100, 6), 0.25).alias("value"))


@query("model_name_groups", "WITH l AS (SELECT row_number() OVER (ORDER BY item_id) AS n, CASE WHEN item_id % 7 = 0 THEN '' ELSE concat(split, '-1-', item_id) END AS value FROM benchmark), g AS (SELECT n, value, sum(CASE WHEN value = '' THEN 1 ELSE 0 END) OVER (ORDER BY n) AS grp FROM l) SELECT n, CAST(grp AS INTEGER) AS grp, value AS name FROM g WHERE value <> ''")
def _(spark, sf):
    from pyspark.sql import Window

    items = table(spark, sf, "benchmark").select("item_id", "split")
    value = F.when(F.col("item_id") % 7 == 0, "").otherwise(F.concat("split", F.lit("-1-"), "item_id"))
    # a list of model names is a short file; the items, as many at every scale, stand in for its lines
    lines = items.select(F.row_number().over(Window.orderBy("item_id")).cast("long").alias("n"), value.alias("value"))
    return R.model_names(lines).select("n", "grp", "name")


# ---- steps that SQL cannot express


def _rpd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.to_pairs(P.latest(table(spark, sf_dir, "rpd_dataset"), "row_id"), "rpd_dataset")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rpd(spark, sf_dir).select(T.text_or_empty("text_1").alias("text")).distinct().withColumn("text_id", F.xxhash64("text"))


@query("keyword_extract")
def _(spark, sf):
    return K.extract(_texts(spark, sf)).select("text_id", F.posexplode("kws").alias("place", "k")).select("text_id", "place", "k.value", "k.source", F.round("k.certainty", 6).alias("certainty"))


@query("keyword_extract_windows")
def _(spark, sf):
    return K.extract(_texts(spark, sf), window=(170, 50)).select("text_id", F.size("kws").alias("n"))


@query("keyword_cluster")
def _(spark, sf):
    return K.keyword_pipeline(_texts(spark, sf)).withColumn("certainty", F.round("certainty", 6))


@query("filter_subsets")
def _(spark, sf):
    lists = keyword_rows(spark, sf).groupBy("text_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))

    @F.pandas_udf("array<string>")
    def kept(values):
        return values.map(lambda v: K.filter_subsets(list(v)))

    return lists.select("text_id", kept("values").alias("kept"))


@query("exclude_keywords")
def _(spark, sf):
    return K.exclude(keyword_rows(spark, sf).select("text_id", "value")).groupBy("value").agg(F.count("*").alias("n"))


@query("partial_ratio")
def _(spark, sf):
    return _rpd(spark, sf).select("pair_id", fuzzy.partial_ratio(F.col("title_1"), F.col("title_2")).alias("value"))


@query("fuzzy_match")
def _(spark, sf):
    return _rpd(spark, sf).select("pair_id", F.round(fuzzy.combined_ratio(F.lower(T.text_or_empty("text_2")), F.lower("title_1")), 6).alias("value"))


@query("keyword_match")
def _(spark, sf):
    return MA.KeywordMatcher().score(_rpd(spark, sf)).select("pair_id", F.round("value", 6).alias("value"))


@query("keyword_match_saturated")
def _(spark, sf):
    return MA.KeywordMatcher(MA.KeywordParams(kw_saturation=True, swap_texts=True)).score(_rpd(spark, sf)).select("pair_id", F.round("value", 6).alias("value"))


@query("keyword_grid")
def _(spark, sf):
    """All runs of the three tries; the best of each is marked."""
    from pyspark.sql import Window

    runs = EX.keyword_runs(_rpd(spark, sf))
    best = Window.partitionBy("trial").orderBy(F.col(EX.best_by("all_examples")).desc_nulls_last(), "position")  # a hundred runs each
    return runs.withColumn("best", F.row_number().over(best) == 1)


@query("gpt_match")
def _(spark, sf):
    rows = R.to_pairs(P.latest(table(spark, sf, "studentor_partner"), "row_id"), "studentor_partner")
    return MA.PromptMatcher().score(rows).select("pair_id", "value")


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The training corpus; rows delivered again count once."""
    return P.once(table(spark, sf, "documents_preprocessed").select("rec_id", F.col("preprocessed_text").alias("tokens")), "rec_id").select("tokens")


def _vectors(spark: SparkSession, sf: str, texts: DataFrame):
    """Word vectors by kind and parameters, each trained once; those of subwords for the words of the texts (a column ``text``)."""
    corpus = materialize(_corpus(spark, sf), "corpus")
    words = materialize(texts.select(F.explode(T.tokens("text")).alias("word")).distinct(), "words")
    made: dict[tuple, DataFrame] = {}

    def get(kind: str, params: TR.TrainParams) -> DataFrame:
        if (kind, params) not in made:
            params_ = replace(params, partitions=4)
            made[kind, params] = materialize(TR.train(corpus, params_, kind, words=words), "vectors")
        return made[kind, params]

    return get


@query("tuned_runs")
def _(spark, sf):
    """Every model with its tuned parameters over every data set."""
    from pairforge.functions.encoders import hashed
    from pairforge.operators import presets as PS

    stored = {"all_examples": "rpd_dataset", "studentor_partner": "studentor_partner", "dataset_v6_r30": "dataset_v6_r30"}
    datasets = {n: materialize(R.to_pairs(P.latest(table(spark, sf, t), "row_id"), n), "pairs") for n, t in stored.items()}
    texts = None
    for pairs in datasets.values():
        texts = P.all_texts(pairs) if texts is None else texts.unionByName(P.all_texts(pairs))
    vectors, corpus, encode = _vectors(spark, sf, texts), P.all_texts(datasets["all_examples"]), hashed()
    # a training leaves cores idle between its passes and while its last shard works
    with ThreadPoolExecutor(3) as side_by_side:
        list(side_by_side.map(lambda run: vectors(*run), dict.fromkeys([*(("fastText", p) for p in PS.FASTTEXT.values()), *(("word2vec", p) for p in PS.WORD2VEC.values())])))
    return PS.run_all(datasets, {n: PS.tuned(n, pairs, corpus, vectors, encode) for n, pairs in datasets.items()})


@query("word2vec_match")
def _(spark, sf):
    from pairforge.operators import presets as PS

    pairs = _rpd(spark, sf)
    return MA.WordVectorMatcher(_vectors(spark, sf, P.all_texts(pairs))("word2vec", PS.WORD2VEC["all_examples"]), T.tokens).score(pairs).select("pair_id", "value")


@query("fasttext_match")
def _(spark, sf):
    from pairforge.operators import presets as PS

    pairs = _rpd(spark, sf)
    return MA.WordVectorMatcher(_vectors(spark, sf, P.all_texts(pairs))("fastText", PS.FASTTEXT["all_examples"]), T.tokens).score(pairs).select("pair_id", "value")


@query("stream_scores", "WITH " + SCORED_SQL + " SELECT pair_id, value FROM scored")
def _(spark, sf):
    path, out = f"{sf}/datum.parquet", f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = S.deduplicated(S.read_pairs(spark, path))
    sink = lambda df, number: df.select("pair_id", "value").write.mode("overwrite").parquet(f"{out}/batch={number}")
    S.score_stream(stream, overlap_score, sink, f"{out}-log").awaitTermination()
    return spark.read.schema("pair_id bigint, value double").parquet(f"{out}/batch=*")
