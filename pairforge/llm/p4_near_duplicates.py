"""Near-duplicate records by Order MinHash.

A record is the sequence of its words. Its k-mers are runs of ``KMER_WORDS`` words, each labelled with
its occurrence in the record, so that repeated runs stay apart. An order sketch takes the
``ORDER_KMERS`` labelled k-mers with the smallest hashes and hashes them in the order in which they stand
in the text: records that agree in one are edited copies with high probability. Such candidates are
verified by a banded alignment (bit-parallel longest common subsequence within a band) of their
words: what it aligns bounds the common words from below, which settles most pairs as *edits*.

The cases ignore order, and re-sorted copies have no k-mers left in order. Therefore a second, order-free
path sketches single words; what only this path finds, and what the alignment does not settle, is
verified by the exact share of common words, and is a *re-ordering* unless the alignment reaches the threshold.

Records with the same words collapse to a representative before any candidate search, so that a huge group
of copies costs one record. Where only pairs are wanted, equal sets of words are enough for that; where
edit similarities are, only equal sequences, repeated words among them. Buckets that are large all the same are salted,
and so are the groups of copies when their pairs are asked for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairforge.llm.common import MEMO_ENTRIES, arrow_map, hash64, text_sides, words
from pairforge.llm.p2_frequencies import normalize_term
from pairforge.session import table
from pairforge.storage import materialize

MIN_SHARE = 0.7
MIN_WORDS = 12
#: Words in a k-mer, k-mers in an order sketch, and order sketches of a record.
KMER_WORDS = 2
ORDER_KMERS = 3
ORDER_SKETCHES = 24
#: Order sketches in common from which a pair goes to the alignment first; about 4 are expected at a share of 0.7.
ORDER_HITS = 2
#: Smallest words in an order-free sketch, and such sketches of a record. At a share of 0.7 one of 64 agrees with
#: a probability above 0.999 for records of usual length, above 0.99 for the shortest.
SKETCH_WORDS = 6
SKETCHES = 64
#: 64-bit parts of the parity signature, by which candidates are told apart in their bucket.
PARITIES = ("q0", "q1", "q2", "q3")
#: Half the width of the alignment's band, in words.
BAND = 32
#: Members of a bucket or of a group of copies that one salt takes.
BUCKET_ROWS = 500
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: splitmix64's multipliers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def _signed(x: np.uint64) -> int:
    return int(x.view(np.int64))


def mostly_latin_or_cyrillic(text: str) -> bool:
    """True when over half of the letters are Latin or Cyrillic (Unicode blocks below 0x530 without Greek, and Latin additions)."""
    if text.isascii():
        return True
    good = bad = 0
    for ch in text:
        if ch.isalpha():
            c = ord(ch)
            if c < 0x370 or 0x400 <= c < 0x530 or 0x1C80 <= c < 0x1C90 or 0x1D00 <= c < 0x1F00 or 0x2C60 <= c < 0x2C80 or 0x2DE0 <= c < 0x2E00 or 0xA640 <= c < 0xA6A0 or 0xA720 <= c < 0xA800 or 0xFB00 <= c < 0xFB07 or 0xFF21 <= c < 0xFF5B:
                good += 1
            else:
                bad += 1
    return good > bad


def parities(x: np.ndarray) -> list[int]:
    """The parity signature of distinct words: each flips one of its bits, by its hash."""
    flips = np.bincount((_mix(x) >> np.uint64(7)).astype(np.int64) % (64 * len(PARITIES)), minlength=64 * len(PARITIES)) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64).tolist()


def record_words(df: DataFrame, field: str, record_id: str, value: str, kind: str, min_words: int = MIN_WORDS) -> DataFrame:
    """``field``, ``id``, ``words`` (hashes of the distinct words in order of appearance), ``sequence`` (all words in text
    order, as little-endian 32-bit places in ``words``; null if none is repeated), ``h1``, ``h2`` (a 128-bit hash of the set), ``s1`` (a hash of the
    sequence) and the set's :func:`parities`.

    ``kind`` is 'text' or 'terms' (an array of strings, each a term). Records with fewer than
    ``min_words`` distinct words, null ones among them, and texts of mostly other scripts are left
    out. One row per id is expected.
    """

    def make():
        memo: dict[str, int] = {}

        def step(cols):
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
            out = {k: [] for k in ("field", "id", "words", "sequence", "h1", "h2", "s1", *PARITIES)}
            for i, v in zip(cols["id"], cols["value"]):
                if v is None or (kind == "text" and not mostly_latin_or_cyrillic(v)):
                    continue
                tokens = words(v) if kind == "text" else [t for t in map(normalize_term, v) if t]
                place: dict[int, int] = {}
                sequence = []
                for t in tokens:
                    h = memo.get(t)
                    if h is None:
                        h = memo[t] = hash64(t)
                    sequence.append(place.setdefault(h, len(place)))
                if len(place) < min_words:
                    continue
                hs = list(place)
                x = np.array(hs, np.int64).view(np.uint64)
                at = np.array(sequence, np.uint32)
                for k, y in zip(out, (field, i, hs, at.astype("<u4").tobytes() if len(at) > len(hs) else None, _signed(_mix(x).sum(dtype=np.uint64)), _signed(_mix(x * _MIX_2 + np.uint64(len(hs))).sum(dtype=np.uint64)), _signed(_mix(x[at] + _mix(np.arange(1, len(at) + 1, dtype=np.uint64))).sum(dtype=np.uint64)), *parities(x))):
                    out[k].append(y)
            if out["id"]:
                yield out

        return step

    return arrow_map(df.select(F.col(record_id).cast("long").alias("id"), F.col(value).alias("value")), make, "field string, id bigint, words array<bigint>, sequence binary, h1 bigint, h2 bigint, s1 bigint, " + ", ".join(f"{q} bigint" for q in PARITIES))


def labelled_kmers(ids: np.ndarray, k: int = KMER_WORDS) -> np.ndarray:
    """Hashes of the runs of ``k`` words in text order, each with the number of its occurrence."""
    n = len(ids) - k + 1
    if n <= 0:
        return _mix(ids)
    runs = ids[:n].copy()
    for j in range(1, k):
        runs = _mix(runs) + ids[j : j + n]
    order = np.argsort(runs, kind="stable")
    same = runs[order]
    first = np.r_[True, same[1:] != same[:-1]]
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = (np.arange(n) - begin).astype(np.uint64)
    return _mix(runs + _mix(occurrence + np.uint64(1)))


def sketches(records: DataFrame, order_count: int = ORDER_SKETCHES, count: int = SKETCHES) -> DataFrame:
    """One row per record and sketch: ``key`` of the record and ``bucket``, order sketches and order-free ones together.

    The bucket's upper 47 bits hash the sketched k-mers (with the sketch's number and the field), those of order sketches in text
    order, the others without regard to it; the next bit is 1 for order sketches; the lower 16 hold the number of distinct words
    (65,535 for more), by which candidates of too different sizes go at once. 16 bytes a row are what gets shuffled.
    """

    def make():
        import pyarrow as pa

        seeds = lambda n, first: _mix(np.arange(first, first + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        kinds = ((True, ORDER_KMERS, seeds(order_count, 10_001)), (False, SKETCH_WORDS, seeds(count, 1)))
        salt = _mix(np.arange(101, 101 + ORDER_KMERS, dtype=np.uint64)) | np.uint64(1)
        low = np.uint64(0x1FFFF)
        fields: dict[str, np.uint64] = {}

        def step(cols):
            keys, buckets = [], []
            for f, key, ws, sequence in zip(cols["field"], cols["key"], cols["words"], cols["sequence"]):
                words_ = np.array(ws, np.int64).view(np.uint64)
                size = np.uint64(min(len(ws), 0xFFFF))
                field = fields.setdefault(f, np.uint64(hash64(f) & 0xFFFFFFFF) << np.uint64(8))
                for ordered, kmers, salts in kinds:
                    x = labelled_kmers(words_ if sequence is None else words_[np.frombuffer(sequence, "<u4")]) if ordered else words_
                    h = x[None, :] ^ salts[:, None]
                    h = (h ^ (h >> np.uint64(31))) * _MIX_1
                    h ^= h >> np.uint64(29)
                    n, k = len(salts), min(kmers, len(x))
                    at = np.argpartition(h, k - 1, axis=1)[:, :k] if k < len(x) else np.tile(np.arange(k), (n, 1))
                    # of places in order, a hash that minds the order; else a sum, which does not
                    picked = np.take_along_axis(h, np.sort(at, axis=1), 1)
                    picked = _mix(picked * salt[None, :k]) if ordered else _mix(picked)
                    whole = _mix(picked.sum(axis=1, dtype=np.uint64) + (np.arange(n, dtype=np.uint64) << np.uint64(1)) + field)
                    keys.append(np.full(n, key, np.int64))
                    buckets.append(((whole & ~low) | np.uint64(ordered << 16) | size).view(np.int64))
            yield {"key": pa.array(np.concatenate(keys)), "bucket": pa.array(np.concatenate(buckets))}

        return step

    return arrow_map(records.select("field", "key", "words", "sequence"), make, "key bigint, bucket bigint")


def _alike(na: Column, nb: Column, min_share: float) -> Column:
    """Whether two numbers of distinct words allow for the share at all."""
    return F.least(na, nb) >= F.greatest(na, nb) * (min_share - 1e-9)


def _near(min_share: float) -> Column:
    """Whether two parity signatures allow for the share. Each word that only one of the records has flips one bit, so the bits that
    differ are at most as many as these words: no pair that has the share is lost. Sizes of 65,535 stand for more and let all pass."""
    differ = sum((F.bit_count(F.col(q + "a").bitwiseXOR(F.col(q + "b"))) for q in PARITIES), F.lit(0))
    share = min_share - 1e-9
    return (F.greatest("wa", "wb") >= 0xFFFF) | (differ <= (F.col("wa") + F.col("wb")) * ((1 - share) / (1 + share)) + 1e-6)


def candidates(sketched: DataFrame, min_share: float = MIN_SHARE, bucket_rows: int = BUCKET_ROWS, signed: DataFrame | None = None) -> DataFrame:
    """Pairs of keys ``a`` < ``b`` of records that share a bucket and are not too different in size, with the number of shared
    order sketches (``order_hits``). ``signed``: ``key`` and the parities of each record, if pairs that cannot have the share are to go
    in their bucket. Chance pairs grow with the square of the records; with the parities hardly any of them leaves its task.

    Sketches are shuffled once, by bucket, and counted there (a bucket holds at most one of a record's sketches, hence never
    more than a small part of the rows; its rows are spilled if they are many). Buckets of one record go, and what is left is
    written. In buckets above ``bucket_rows`` each row of the one side takes one of the salts, each row of the other side all.
    """
    spread = sketched.select("key", F.shiftright("bucket", 16).alias("k"), F.col("bucket").bitwiseAND(0xFFFF).cast("int").alias("w"))
    shared = spread.withColumn("n", F.count("*").over(Window.partitionBy("k"))).where("n > 1")
    shared = shared.select("k", "key", "w", F.ceil(F.col("n") / bucket_rows).cast("int").alias("salts"))
    parts = PARITIES if signed is not None else ()
    shared = materialize(shared if signed is None else shared.join(signed.select("key", *parts), "key"), "buckets")
    left = shared.select("k", F.col("key").alias("a"), F.col("w").alias("wa"), *(F.col(q).alias(q + "a") for q in parts), F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"))
    right = shared.select("k", F.col("key").alias("b"), F.col("w").alias("wb"), *(F.col(q).alias(q + "b") for q in parts), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = left.join(right, ["k", "salt"]).where(F.col("a") < F.col("b")).where(_alike(F.col("wa"), F.col("wb"), min_share))
    if parts:
        pairs = pairs.where(_near(min_share))
    return pairs.groupBy("a", "b").agg(F.sum(F.col("k").bitwiseAND(1)).cast("int").alias("order_hits"))


def banded_alignment(a: list[int], b: list[int], band: int = BAND) -> int:
    """Length of the longest common subsequence with matches at most ``band`` places off the diagonal
    (which is drawn from start to end); bit-parallel over ``b``."""
    if not a or not b:
        return 0
    where: dict[int, int] = {}
    for j, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, slope, width = full, len(b) / len(a), (1 << (2 * band + 1)) - 1
    for i, w in enumerate(a):
        m = where.get(w)
        if m:
            start = int(i * slope) - band
            m &= width << start if start >= 0 else width >> -start
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(b) - row.bit_count()


def verify(pairs: DataFrame, records: DataFrame, min_share: float = MIN_SHARE, min_edit_similarity: float = 0.0, sequences: bool = True) -> DataFrame:
    """Keeps the pairs (``a``, ``b``, ``order_hits``) of which at least ``min_share`` of the words are common.

    Order candidates (``ORDER_HITS`` sketches in common) go to the banded alignment: if the words it aligns make up the share, the
    pair is settled and ``kind`` is 'edit'. For all others the exact share of common words decides, and ``kind`` is 'reordering'
    unless the alignment reaches the threshold. Adds ``common`` and ``united`` (numbers of words, of which ``share`` is the ratio)
    and ``edit_similarity``, the aligned part of the longer of the two sequences of all words (without ``sequences`` of the distinct words).
    """
    every = F.col("sequence") if sequences else F.lit(None).cast("binary")
    side = lambda k: records.select(F.col("key").alias(k), F.col("field").alias("f" + k), F.col("words").alias("w" + k), every.alias("s" + k))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("fa = fb")
    na, nb = F.size("wa"), F.size("wb")
    both = both.where(_alike(na, nb, min_share)).withColumn("common", F.size(F.array_intersect("wa", "wb")))
    enough = F.col("common") >= (na + nb - F.col("common")) * (min_share - 1e-9)
    both = both.where((F.col("order_hits") >= ORDER_HITS) | enough)

    def make():
        def step(cols):
            out = {k: [] for k in ("field", "a", "b", "common", "united", "edit_similarity", "order_hits", "kind")}
            for f, a, b, wa, wb, sa, sb, common, hits in zip(*(cols[k] for k in ("fa", "a", "b", "wa", "wb", "sa", "sb", "common", "order_hits"))):
                together = len(wa) + len(wb)
                aligned = banded_alignment(wa, wb)
                edit = aligned >= (together - aligned) * (min_share - 1e-9)
                if not edit and common < (together - common) * (min_share - 1e-9):
                    continue
                if sa is not None or sb is not None:  # repeated words
                    wa, wb = ([w[i] for i in np.frombuffer(q, "<u4")] if q is not None else w for w, q in ((wa, sa), (wb, sb)))
                    aligned = banded_alignment(wa, wb)
                similarity = aligned / max(len(wa), len(wb))
                if similarity >= min_edit_similarity:
                    for k, v in zip(out, (f, a, b, common, together - common, similarity, hits, "edit" if edit else "reordering")):
                        out[k].append(v)
            yield out

        return step

    return arrow_map(both.select("fa", "a", "b", "wa", "wb", "sa", "sb", "common", "order_hits"), make, "field string, a bigint, b bigint, common int, united int, edit_similarity double, order_hits int, kind string")


def grouped(records: DataFrame, sequences: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(membership, representatives)`` of written records: :func:`near_duplicates` says what they hold."""
    same = ["field", "h1", "h2", *(["s1"] if sequences else [])]
    members = records.select("id", *same)
    reps = members.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    return members.join(reps, same).select("field", "id", "rep", "copies"), reps


def near_duplicates(records: DataFrame, min_share: float = MIN_SHARE, min_edit_similarity: float = 0.0, sequences: bool = False, similarities: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """``(membership, links)`` of the records of :func:`record_words`.

    membership: ``field``, ``id``, ``rep`` (the smallest id with the same words; with ``sequences`` only
    if they stand in the same sequence) and ``copies``, the size of that group; links: ``field``, ``a``, ``b``, ``share``,
    ``edit_similarity``, ``order_hits`` (order sketches in common) and ``kind`` of verified pairs of different representatives.
    ``similarities``: whether edit similarities count repeated words (as ``sequences`` says, if not given). Empty input gives two empty tables.
    """
    records = materialize(records, "records")
    membership, reps = grouped(records, sequences)
    chosen = records.join(reps.select("field", F.col("rep").alias("id")), ["field", "id"], "left_semi").drop("h1", "h2", "s1")
    # a number of its own for each representative, fixed by being written
    chosen = materialize(chosen.withColumn("key", F.monotonically_increasing_id()), "representatives")
    pairs = materialize(candidates(sketches(chosen), min_share, signed=chosen), "candidates")  # what was shuffled for them goes before they are verified
    found = verify(pairs, chosen, min_share, min_edit_similarity, sequences if similarities is None else similarities)
    name = lambda k: chosen.select(F.col("key").alias(k), F.col("id").alias("id_" + k))
    named = found.join(name("a"), "a").join(name("b"), "b")
    share = (F.col("common") / F.col("united")).alias("share")
    return membership, named.select("field", F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), share, "edit_similarity", "order_hits", "kind")


def all_pairs(membership: DataFrame, links: DataFrame, group_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every pair of ids: those of linked representatives, and those within a group of equal records. The members of a
    group above ``group_rows`` are split by salts, so that no task makes all its pairs."""
    salts = F.ceil(F.col("copies") / group_rows).cast("int")
    salted = membership.select("field", "rep", "id", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    groups = membership.select("field", "rep", salts.alias("salts")).distinct()

    def expand(df: DataFrame, rep: str, out: str) -> DataFrame:
        """Each row of ``df`` with every member of the group of its representative, in the column ``out``."""
        wide = df.join(groups.withColumnRenamed("rep", rep), ["field", rep]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        return wide.join(salted.withColumnsRenamed({"rep": rep, "id": out}), ["field", rep, "salt"]).drop("salt")

    across = expand(expand(links.select("field", "a", "b"), "a", "x"), "b", "y").select("field", "x", "y")
    same = expand(membership.where("copies > 1").select("field", "rep", F.col("id").alias("x")), "rep", "y").where("x < y").select("field", "x", "y")
    both = across.unionByName(same)
    return both.select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def corpus_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = text_sides(table(spark, sf_dir, "datum"))
    arrays = table(spark, sf_dir, "documents_preprocessed").select("rec_id", "preprocessed_text").where("rec_id is not null").dropDuplicates(["rec_id"])
    return (
        record_words(sides.where("side = 1"), "text_1", "text_id", "text", "text")
        .unionByName(record_words(sides.where("side = 2"), "text_2", "text_id", "text", "text"))
        .unionByName(record_words(arrays, "preprocessed_text", "rec_id", "preprocessed_text", "terms"))
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pairs(*near_duplicates(corpus_records(spark, sf_dir)))


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of representatives (of equal sequences of words) and their share; :func:`p4_members` gives the records that a representative stands for."""
    links = near_duplicates(corpus_records(spark, sf_dir), sequences=True, similarities=False)[1]
    return links.select("field", "a", "b", F.round("share", 6).alias("share"))


def p4_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with what the order tells: edit or re-ordering, edit similarity, order sketches in common."""
    return near_duplicates(corpus_records(spark, sf_dir), sequences=True)[1].select("field", "a", "b", "kind", "edit_similarity", "order_hits")


def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record, its representative in ``p4_links`` and the number of records that it stands for."""
    return grouped(materialize(corpus_records(spark, sf_dir), "records"), sequences=True)[0]


QUERIES = {"p4_found": p4_found, "p4_links": p4_links, "p4_edits": p4_edits, "p4_members": p4_members}
_RECORDS = r"""
WITH texts AS (
  SELECT 'text_1' AS field, id_1 AS id, max(text_1) AS t FROM datum WHERE id_1 IS NOT NULL GROUP BY id_1
  UNION ALL SELECT 'text_2', id_2, max(text_2) FROM datum WHERE id_2 IS NOT NULL GROUP BY id_2),
latin AS (
  SELECT field, id, lower(nfc_normalize(t)) AS t FROM texts
  WHERE len(regexp_replace(t, '[^\p{Latin}\p{Cyrillic}]', '', 'g')) * 2 > len(regexp_replace(t, '[^\p{L}]', '', 'g'))),
lists AS (
  SELECT field, id, regexp_extract_all(t, '[\p{L}\p{N}]+') AS ws FROM latin
  UNION ALL
  SELECT 'preprocessed_text', rec_id, list_filter(list_transform(list_filter(any_value(preprocessed_text), lambda e: e IS NOT NULL),
    lambda e: regexp_replace(lower(nfc_normalize(e)), '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g')), lambda e: e <> '')
  FROM documents_preprocessed WHERE rec_id IS NOT NULL GROUP BY rec_id),
records AS (SELECT field, id, ws, len(list_distinct(ws)) AS n FROM lists WHERE len(list_distinct(ws)) >= 12),
members AS (SELECT field, id, min(id) OVER same AS rep, count(*) OVER same AS copies FROM records WINDOW same AS (PARTITION BY field, ws))"""
SQL = {
    "p4_found": _RECORDS
    + """, big AS (SELECT field, id, n, unnest(list_distinct(ws)) AS w FROM records)
SELECT a.field, a.id AS id_a, b.id AS id_b FROM big a JOIN big b ON a.field = b.field AND a.w = b.w AND a.id < b.id
GROUP BY a.field, a.id, b.id, a.n, b.n HAVING 10 * count(*) >= 7 * (a.n + b.n - count(*))""",
    "p4_links": _RECORDS
    + """, big AS (SELECT r.field, r.id, n, unnest(list_distinct(ws)) AS w FROM records r JOIN members m ON r.field = m.field AND r.id = m.id WHERE m.rep = r.id)
SELECT a.field, a.id AS a, b.id AS b, round(count(*) / CAST(a.n + b.n - count(*) AS DOUBLE), 6) AS share FROM big a JOIN big b ON a.field = b.field AND a.w = b.w AND a.id < b.id
GROUP BY a.field, a.id, b.id, a.n, b.n HAVING 10 * count(*) >= 7 * (a.n + b.n - count(*))""",
    "p4_members": _RECORDS + "SELECT field, id, rep, copies FROM members",
}
