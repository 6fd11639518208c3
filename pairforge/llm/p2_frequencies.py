"""Frequency of every distinct term by heavy-light aggregation.

A bounded top-k sketch names terms that are probably heavy. They are broadcast, and their exact counts are kept in
counter arrays local to each task, so that a term which fills a third of all rows sends a few
numbers per task instead of its rows. All other terms are pre-aggregated per task and shuffled by
term. Both count tables are then put together. The sketch only routes: counts are exact for every term whatever it names.

Records delivered again are found by their ids alone; only records that may be among them are
shuffled with their terms, all others are counted where they are read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.common import MEMO_ENTRIES, arrow_map
from pairforge.operators.dedupe import once
from pairforge.session import table
from pairforge.storage import materialize

#: At most so many terms are routed to counter arrays; bounds what is sent to every task.
HEAVY_TERMS = 512
#: Light terms held by a task before it sends them on.
LIGHT_BUFFER = 200_000
RARE_BELOW = 5
COMMON_SHARE = 0.25


def normalize_term(value: str | None) -> str:
    """NFC, lower case, no surrounding white space; '' for null."""
    if value is None:
        return ""
    if not unicodedata.is_normalized("NFC", value):
        value = unicodedata.normalize("NFC", value)
    return value.lower().strip()


def heavy_terms(df: DataFrame, terms: str, k: int = HEAVY_TERMS) -> list[str]:
    """The ``k`` terms that a frequent-items sketch of fixed size finds most often."""
    found = (
        df.select(F.explode(terms).alias("t"))
        .select(F.lower(F.trim("t")).alias("t"))
        .where(F.col("t") != "")
        .agg(F.expr(f"approx_top_k(t, {k}, {8 * k})").alias("top"))
        .first()["top"]
    )
    return sorted({normalize_term(x["item"]) for x in found or []} - {""})


def count_terms(df: DataFrame, terms: str, record_id: str | None = None, heavy: int = HEAVY_TERMS) -> DataFrame:
    """Exact counts of every distinct term: ``term``, ``occurrences``, ``records``; beside them one row
    whose term is null, with all occurrences and all records that hold a term.

    ``terms`` is a column of string arrays. Null arrays, null and blank elements hold no term.
    ``record_id``: records delivered again count once; a record without id counts on its own. An
    empty table gives the row of totals alone, with zeros. Other columns are ignored.
    """
    rows = df.select(F.col(terms).alias("_terms"), (F.col(record_id) if record_id else F.lit(None).cast("long")).alias("_id"))
    heavy_list = heavy_terms(rows, "_terms", heavy)
    if record_id:
        rows = once(rows, "_id")
    shared = df.sparkSession.sparkContext.broadcast(heavy_list)

    def make():
        place = {t: i for i, t in enumerate(shared.value)}
        occ, rec = np.zeros(len(place) + 1, np.int64), np.zeros(len(place) + 1, np.int64)
        memo: dict[str, str] = {}
        light: dict[str, list[int]] = {}

        def flush():
            names, pairs = list(light), list(light.values())
            light.clear()
            return {"place": [None] * len(names), "term": names, "occurrences": [p[0] for p in pairs], "records": [p[1] for p in pairs]}

        def step(cols):
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
            for array in cols["_terms"]:
                counts = Counter()
                for raw in array or ():
                    term = memo.get(raw)
                    if term is None:
                        term = memo[raw] = normalize_term(raw)
                    if term:
                        counts[term] += 1
                if not counts:
                    continue
                rec[-1] += 1
                for term, n in counts.items():
                    occ[-1] += n
                    i = place.get(term)
                    if i is not None:
                        occ[i] += n
                        rec[i] += 1
                    elif (p := light.get(term)) is not None:
                        p[0] += n
                        p[1] += 1
                    else:
                        light[term] = [n, 1]
                if len(light) > LIGHT_BUFFER:
                    yield flush()

        def close():
            yield flush()
            yield {"place": list(range(len(occ))), "term": [None] * len(occ), "occurrences": occ.tolist(), "records": rec.tolist()}

        step.close = close
        return step

    parts = materialize(arrow_map(rows.select("_terms"), make, "place int, term string, occurrences bigint, records bigint"), "parts")
    total = lambda df, key: df.groupBy(key).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    names = df.sparkSession.createDataFrame([*enumerate(heavy_list), (len(heavy_list), None)], "place int, term string")
    heavy_counts = names.join(total(parts.where("place is not null"), "place"), "place", "left").select("term", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("records", F.lit(0)).alias("records"))
    light_counts = total(parts.where("place is null"), "term")
    return heavy_counts.unionByName(light_counts).where("term is null or occurrences > 0")


def mark_terms(counts: DataFrame, rare_below: int = RARE_BELOW, common_share: float = COMMON_SHARE) -> DataFrame:
    """Adds ``mark``: 'rare', 'common' or null to the counts of :func:`count_terms`, without its row of totals."""
    counts = materialize(counts, "terms")
    total = counts.where("term is null").first()["records"]
    mark = F.when(F.col("occurrences") < rare_below, "rare").when(F.col("records") > common_share * total, "common")
    return counts.where("term is not null").withColumn("mark", mark)


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_terms(count_terms(table(spark, sf_dir, "documents_preprocessed"), "preprocessed_text", "rec_id"))


def p2_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).where("mark is not null").select("term", "mark")


QUERIES = {"p2_found": p2_found, "p2_frequencies": p2_frequencies}

_COUNTS = r"""
WITH recs AS (SELECT rec_id, any_value(preprocessed_text) AS terms FROM documents_preprocessed
              WHERE rec_id IS NOT NULL GROUP BY rec_id
              UNION ALL SELECT rec_id, preprocessed_text FROM documents_preprocessed WHERE rec_id IS NULL),
numbered AS (SELECT row_number() OVER () AS rn, terms FROM recs),
elems AS (SELECT rn, regexp_replace(lower(nfc_normalize(e)), '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g') AS term
          FROM (SELECT rn, unnest(terms) AS e FROM numbered) WHERE e IS NOT NULL),
good AS (SELECT rn, term FROM elems WHERE term <> ''),
marked AS (SELECT term, count(*) AS occurrences, count(DISTINCT rn) AS records,
  CASE WHEN count(*) < 5 THEN 'rare'
       WHEN count(DISTINCT rn) > 0.25 * (SELECT count(DISTINCT rn) FROM good) THEN 'common' END AS mark
  FROM good GROUP BY term)
"""
SQL = {
    "p2_found": _COUNTS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p2_frequencies": _COUNTS + "SELECT term, occurrences, records, mark FROM marked",
}
