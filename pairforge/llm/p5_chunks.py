"""Splitting long texts where their vocabulary changes.

Boundaries are graded by how natural they are: ends of paragraphs and lines, ends of sentences,
clause marks, white space, other punctuation. At each boundary the cosine similarity of the
unit counts in two sliding blocks tells the lexical cohesion; its depth below the peaks on both
sides marks a change of topic. Units are words, in scripts without spaces pairs of letters. From the start of a piece the
cut goes to the deepest valley among all boundaries within the size window, where each grade weighs as much as
``GRADE_DEPTH`` of depth; the next piece repeats the end of the
last one, from a word's start. Only where a window holds no boundary at all is a cut forced.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from functools import lru_cache
from math import sqrt

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.common import WORD, arrow_map, text_sides
from pairforge.session import table

SIZE = 1000
OVERLAP = 100
#: Words in each of the two blocks that are compared.
BLOCK = 24
#: Depth of a valley that a boundary one grade better makes up for.
GRADE_DEPTH = 0.5
#: A piece should fill this share of the limit before a cut of a good grade is taken.
FILL = 0.4
#: The grades of natural boundaries, the best last; each pattern's match ends at the boundary.
GRADES = (
    r"[\s\p{P}]",
    r"\s",
    r"[,;:،、；：，](?=\s|\p{Lo})",
    r"(?:(?<=[\p{L}\p{M}]{5}|[\d)%»”\"'+#])\.|[!?…。！？؟।۔])[\p{Pe}\p{Pf}\p{Pi}\"']*(?=\s+[\p{Lu}\p{Lo}\d«„“\"(¿¡]|\p{Lo})",
    r"(?<=[.!?…:;»”\"。！？؟।])[^\S\n]*\n|\n(?=[^\S\n]*(?:[•*–\-]|\d{1,3}[.)])\s)|\n[^\S\n]*\n",
)


@lru_cache(maxsize=1)
def _grade_patterns() -> list:
    return [regex.compile(g) for g in GRADES]


_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+|[^\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+")
_UNSPACED_LETTER = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")


def units(text: str) -> tuple[list[str], list[int]]:
    """What cohesion is measured on, and where each starts: words, and in scripts without spaces every pair of neighbouring letters."""
    found, starts = [], []
    for m in WORD.finditer(text):
        word, at = m.group(), m.start()
        if word.isascii() or not _UNSPACED_LETTER.search(word):
            found.append(word)
            starts.append(at)
            continue
        for part in _UNSPACED.finditer(word):
            run = part.group()
            if _UNSPACED_LETTER.match(run):
                found += [run[i : i + 2] for i in range(len(run))]
                starts += range(at + part.start(), at + part.end())
            else:
                found.append(run)
                starts.append(at + part.start())
    return found, starts


def cohesion(tokens: list[str], block: int) -> list[float]:
    """Cosine similarity of the counts of ``block`` units before and after each unit's start and the end; one sliding pass."""
    before: defaultdict[str, int] = defaultdict(int)
    after: defaultdict[str, int] = defaultdict(int)
    dot = left = right = 0
    for w in tokens[:block]:
        right += 2 * after[w] + 1
        after[w] += 1
    out = [0.0]
    n = len(tokens)
    for k in range(n):  # the unit k passes from the block after to the block before
        w = tokens[k]
        dot -= before[w]
        right -= 2 * after[w] - 1
        after[w] -= 1
        dot += after[w]
        left += 2 * before[w] + 1
        before[w] += 1
        if k >= block:
            w = tokens[k - block]
            dot -= after[w]
            left -= 2 * before[w] - 1
            before[w] -= 1
        if k + block < n:
            w = tokens[k + block]
            dot += before[w]
            right += 2 * after[w] + 1
            after[w] += 1
        out.append(dot / sqrt(left * right) if left and right else 0.0)
    return out


def _depths(sims: list[float]) -> list[float]:
    """How far each similarity lies below the nearest peak to its left and to its right."""
    left, right = list(sims), list(sims)
    for i in range(1, len(sims)):
        if sims[i - 1] >= sims[i]:
            left[i] = left[i - 1]
    for i in range(len(sims) - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            right[i] = right[i + 1]
    return [a + b - 2 * s for a, b, s in zip(left, right, sims)]


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, block: int = BLOCK) -> list[tuple[int, int, bool]]:
    """Pieces ``(start, end, forced)`` of a text: each at most ``size`` code points, together the whole
    text; each after the first starts at most ``overlap`` before the end of the one before.
    ``forced``: its end had to be cut where no boundary is left. A text within the limit is one piece,
    an empty text none."""
    n = len(text)
    if n <= size:
        return [(0, n, False)] if n else []
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    graded: dict[int, int] = {}
    for g, pattern in enumerate(_grade_patterns()):
        for m in pattern.finditer(text):
            graded[m.end()] = g
            if g == 0 and m.start():
                graded.setdefault(m.start(), 0)
    bounds = sorted(graded)
    lower = text.lower()
    tokens, starts = units(lower if len(lower) == n else text)
    sims = cohesion(tokens, block)

    def cut(start: int, after: int) -> int | None:
        """The best boundary in (after, start + size]."""
        high = bisect_right(bounds, start + size)
        low = bisect_right(bounds, max(after, start + int(size * FILL)))
        if low < high:
            inside = bounds[low:high]
            depths = _depths([sims[bisect_left(starts, p)] for p in inside])
            return inside[max(range(len(inside)), key=lambda i: (depths[i] + GRADE_DEPTH * graded[inside[i]], inside[i]))]
        return bounds[high - 1] if high and bounds[high - 1] > after else None

    pieces, start, done = [], 0, 0
    while True:
        if n - start <= size:
            pieces.append((start, n, False))
            return pieces
        end, forced = cut(start, done), False
        if end is None and start < done:
            start = done  # without an overlap the next boundary may come within reach
            if n - start <= size:
                pieces.append((start, n, False))
                return pieces
            end = cut(start, done)
        if end is None:
            end, forced = start + size, True
            while end > start + 1 and unicodedata.combining(text[end]):  # keep marks with their letter
                end -= 1
            if end == start + 1:
                end = start + size
        pieces.append((start, end, forced))
        done = end
        back = bisect_left(starts, end - overlap)
        start = starts[back] if back < len(starts) and max(end - overlap, start + 1) <= starts[back] < end else end


def chunks(df: DataFrame, keys: list[str], text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text above ``size`` code points: the ``keys``, ``piece``, ``start_off``, ``end_off``, ``forced``, ``piece_text``.

    Null texts and texts within the limit give no row; repeated rows are split each. Columns that
    are neither key nor text are left out.
    """
    kinds = {k: df.schema[k].dataType.simpleString() for k in keys}

    def make():
        def step(cols):
            out: dict[str, list] = {k: [] for k in (*keys, "piece", "start_off", "end_off", "forced", "piece_text")}
            for i, t in enumerate(cols["_text"]):
                for p, (a, b, forced) in enumerate(split_text(t, size, overlap)):
                    for k in keys:
                        out[k].append(cols[k][i])
                    for k, v in (("piece", p), ("start_off", a), ("end_off", b), ("forced", int(forced)), ("piece_text", t[a:b])):
                        out[k].append(v)
            yield out

        return step

    long = df.where(F.length(text) > size).select(*keys, F.col(text).alias("_text"))
    return arrow_map(long, make, ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", piece int, start_off int, end_off int, forced int, piece_text string")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(text_sides(table(spark, sf_dir, "datum")), ["side", "text_id"])


def p5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("side", "text_id").agg(F.max("forced").alias("forced"))


QUERIES = {"p5_found": p5_found, "p5_chunks": p5_chunks}
SQL = {
    "p5_found": r"""
WITH texts AS (
  SELECT CAST(1 AS INTEGER) AS side, id_1 AS text_id, max(text_1) AS t FROM datum WHERE id_1 IS NOT NULL GROUP BY id_1
  UNION ALL SELECT CAST(2 AS INTEGER), id_2, max(text_2) FROM datum WHERE id_2 IS NOT NULL GROUP BY id_2)
SELECT side, text_id, CAST(list_max(list_transform(regexp_split_to_array(t, '[\s\p{Z}\p{P}\x{85}]'), lambda x: length(x))) > 1000 AS INTEGER) AS forced
FROM texts WHERE length(t) > 1000""",
}
