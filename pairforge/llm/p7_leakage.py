"""Evaluation passages inside training texts, by spaced-seed hashing.

Fixed masks of span ``SPAN`` cover runs of words and ignore some of them, so that a hit survives a
substituted word at an ignored place. Every run of twelve equal words holds every mask, hence no
exact passage is missed. Around each hit the overlap is extended word by word on the hit's
diagonal, with substitutions allowed, and measured both ways: the longest exact run and the
longest run with single substitutions.

The test items make up an index that is sent to every task, in slices of at most ``SLICE_SEEDS`` seeds; the
corpus is read once for each slice (once, for a benchmark of the usual size) and is never shuffled.
Few or many items, the plan is the same.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.common import arrow_map, hash64, words
from pairforge.session import table

MIN_RUN = 12
#: The seed masks; 1 is compared, 0 is ignored. Each starts and ends with 1 and spans at most MIN_RUN words.
MASKS = ("110110110111", "111001011011")
#: Seeds of the test side in a slice of the index (about 100 bytes each), which bounds what is sent to a task at once.
SLICE_SEEDS = 2_000_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: splitmix64's multipliers


def _seed_hashes(ids: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash of each window under a mask; ``ids`` are unsigned 64-bit word hashes."""
    n = len(ids) - len(mask) + 1
    out = np.full(max(n, 0), number + 1, np.uint64)
    if n <= 0:
        return out
    for k, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ ids[k : k + n]) * _M1
            out ^= out >> np.uint64(32)
    return out


def overlaps(doc: list, item: list, diagonals, min_run: int = MIN_RUN) -> tuple[int, int]:
    """Longest exact run, and longest run in which no two neighbouring words differ, over the given
    diagonals (place in the document minus place in the item)."""
    exact = tolerant = 0
    for d in diagonals:
        run = loose = good = 0
        for j in range(max(0, -d), min(len(item), len(doc) - d)):
            if doc[j + d] == item[j]:
                run += 1
                loose += 1
                good = loose
                exact, tolerant = max(exact, run), max(tolerant, good)
            else:
                loose = loose + 1 if run else 0
                run = 0
    return exact, tolerant


class SeedIndex:
    """Seed hashes of the test items with the places they stand at."""

    def __init__(self, items: list[tuple[int, str]], masks=MASKS):
        self.items = {i: words(t) for i, t in items if t}
        self.masks = masks
        self.vocabulary = {w: np.uint64(hash64(w) & (2**64 - 1)) for ws in self.items.values() for w in ws}
        rows = []
        for i, ws in self.items.items():
            ids = np.array([self.vocabulary[w] for w in ws], np.uint64)
            for m, mask in enumerate(masks):
                rows += [(int(h), i, p) for p, h in enumerate(_seed_hashes(ids, mask, m))]
        self.places: dict[int, list[tuple[int, int]]] = {}
        for h, i, p in rows:
            self.places.setdefault(h, []).append((i, p))
        self.sorted = np.array(sorted(self.places), np.uint64)

    def hits(self, ws: list[str]) -> dict[int, set[int]]:
        """Diagonals by item at which a document's seed meets an item's."""
        found: dict[int, set[int]] = {}
        if len(ws) < min(map(len, self.masks)) or not len(self.sorted):
            return found
        get, none = self.vocabulary.get, np.uint64(0)
        ids = np.array([get(w, none) for w in ws], np.uint64)
        known = ids != none
        for m, mask in enumerate(self.masks):
            n = len(ids) - len(mask) + 1
            if n <= 0:
                continue
            ok = np.ones(n, bool)
            for k, bit in enumerate(mask):
                if bit == "1":
                    ok &= known[k : k + n]
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            hs = _seed_hashes(ids, mask, m)[at]
            spot = np.searchsorted(self.sorted, hs)
            spot[spot == len(self.sorted)] = 0
            for k in np.flatnonzero(self.sorted[spot] == hs):
                for item, p in self.places[int(hs[k])]:
                    found.setdefault(item, set()).add(int(at[k]) - p)
        return found


_INDEXES: dict[str, SeedIndex] = {}


def _index(name: str, items: list[tuple[int, str]]) -> SeedIndex:
    """One index per process: that of the slice at hand, in which items go by their number."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = SeedIndex([(n, t) for n, (_, t) in enumerate(items)])
    return _INDEXES[name]


def leaks(corpus: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_run: int = MIN_RUN, slice_seeds: int = SLICE_SEEDS) -> DataFrame:
    """One row per document and item with a verified overlap: ``doc_id``, ``item_id``, ``exact_run``, ``tolerant_run``, ``item_words``.

    An overlap is verified if around a hit at least ``min_run`` words agree but for single substitutions (``tolerant_run``).
    Null, empty and blank texts have no words and no hit. Copies of a document count each; a
    document id that occurs twice reports its best overlaps once. Other columns are ignored. A single item with more than
    ``slice_seeds`` seeds makes a slice of its own.
    """
    spark = corpus.sparkSession
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item")).where("item_id is not null and item is not null")
    docs = corpus.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    # white space bounds neither, so the letters and digits bound the words and these the seeds
    size = (items.agg(F.sum(F.length("item")).alias("n")).first()["n"] or 0) * len(MASKS) / 2
    slices = max(1, -(-int(size) // slice_seeds))
    found = None
    for number in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == number) if slices > 1 else items
        rows = [(r["item_id"], r["item"]) for r in part.toLocalIterator()]
        hits = _leaks_of(docs, spark.sparkContext.broadcast(rows), min_run)
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("doc_id", "item_id").agg(F.max("exact_run").alias("exact_run"), F.max("tolerant_run").alias("tolerant_run"), F.max("item_words").alias("item_words"))


def _leaks_of(docs: DataFrame, shared, min_run: int) -> DataFrame:
    name = uuid.uuid4().hex

    def make():
        ids = [i for i, _ in shared.value]
        index = _index(name, shared.value)

        def step(cols):
            out = {k: [] for k in ("doc_id", "item_id", "exact_run", "tolerant_run", "item_words")}
            for i, t in zip(cols["doc_id"], cols["text"]):
                ws = words(t)
                for item, diagonals in index.hits(ws).items():
                    exact, tolerant = overlaps(ws, index.items[item], diagonals)
                    if tolerant >= min_run:
                        for k, v in zip(out, (i, ids[item], exact, tolerant, len(index.items[item]))):
                            out[k].append(v)
            yield out

        return step

    return arrow_map(docs, make, "doc_id bigint, item_id bigint, exact_run int, tolerant_run int, item_words int")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verified overlap, those with substitutions too."""
    return _leaks(spark, sf_dir)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where(F.col("exact_run") >= MIN_RUN).select("doc_id", "item_id")


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks}
SQL = {
    "p7_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i:i+11], ' '))) AS g FROM d WHERE len(w) >= 12),
bg AS (SELECT item_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i:i+11], ' '))) AS g FROM b WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (g)""",
}
