"""Fuzzy string scores as Arrow functions: the JVM has whole-string edit distance only."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DISTANCE = 9
LEAST_LABEL = 10
MAX_TEXT = 1500


#: Longest label, and rows at once, of the distances that are computed for many rows together.
WORD_BITS = 64
ROWS = 4096


def _longest(a: str, alo: int, ahi: int, b: str, blo: int, bhi: int) -> tuple[int, int, int]:
    """Start in ``a``, start in ``b`` and length of the longest common run; of equal ones the first in ``a``, then in ``b``.
    This is the choice of ``difflib.SequenceMatcher`` without junk, found by searches of substrings."""
    at, where, size = alo, blo, 0
    i = alo
    while i + size < ahi:
        found = b.find(a[i : i + size + 1], blo, bhi)
        while found >= 0:
            at, where, size = i, found, size + 1
            if i + size >= ahi:
                break
            found = b.find(a[i : i + size + 1], found, bhi)
        i += 1
    return at, where, size


def _blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """Matching blocks as ``difflib.SequenceMatcher`` finds them, in any order; neighbouring ones are not put together."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, j, k = _longest(a, alo, ahi, b, blo, bhi)
        if k:
            found.append((i, j, k))
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if i + k < ahi and j + k < bhi:
                todo.append((i + k, ahi, j + k, bhi))
    return found


def partial_ratio_of(a: str | None, b: str | None) -> int:
    """0 to 100: how well the shorter string fits its best place in the longer one. Null or empty gives 0."""
    if not a or not b:
        return 0
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    if short in long_:
        return 100
    best = 0.0
    # the end of both strings counts as an empty block
    for start in {max(0, j - i) for i, j, _ in _blocks(short, long_)} | {len(long_) - len(short)}:
        window = long_[start : start + len(short)]
        best = max(best, 2.0 * sum(k for _, _, k in _blocks(short, window)) / (len(short) + len(window)))
    return 100 if best > 0.995 else round(100 * best)


def reaches(a: str | None, b: str | None, ratio: int) -> bool:
    """Whether :func:`partial_ratio_of` is at least ``ratio``; most strings are told apart by the letters they share."""
    if not a or not b:
        return ratio <= 0
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    common = sum((Counter(short) & Counter(long_)).values())
    # no place of the longer string matches more letters than both hold
    return round(200 * common / (len(short) + common)) >= ratio and partial_ratio_of(a, b) >= ratio


def substring_distance(label: str, text: str) -> int:
    """Least edit distance of the label to any substring of the text; bit-parallel over the label."""
    m = len(label)
    if not m:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(label):
        where[ch] = where.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for ch in text:
        eq = where.get(ch, 0)
        vertical = eq | minus
        horizontal = ((((eq & plus) + plus) ^ plus) | eq) & full
        up, down = minus | ~(horizontal | plus) & full, plus & horizontal
        score += bool(up & top) - bool(down & top)
        best = min(best, score)
        # free start: the row above the label stays zero
        up, down = up << 1 & full, down << 1 & full
        plus, minus = (down | ~(vertical | up)) & full, up & vertical
    return best


def substring_distances(labels: list[str], texts: list[str]) -> np.ndarray:
    """:func:`substring_distance` of many rows together; labels of 1 to ``WORD_BITS`` letters."""
    out = np.empty(len(labels), np.int64)
    order = sorted(range(len(labels)), key=lambda r: -len(texts[r]))
    for first in range(0, len(order), ROWS):
        rows = order[first : first + ROWS]
        letters = {c: i for i, c in enumerate(sorted({c for r in rows for c in labels[r]}), 1)}  # 0: in no label
        names = {v: i for i, v in enumerate(dict.fromkeys(labels[r] for r in rows))}
        heads = {v: i for i, v in enumerate(dict.fromkeys(texts[r] for r in rows))}
        where = np.zeros((len(names), len(letters) + 1), np.uint64)
        for v, i in names.items():
            for k, c in enumerate(v):
                where[i, letters[c]] |= np.uint64(1 << k)
        codes = np.zeros((max(map(len, heads)), len(heads)), np.int64)
        for v, i in heads.items():
            codes[: len(v), i] = [letters.get(c, 0) for c in v]
        name, head = (np.array([m[v[r]] for r in rows]) for m, v in ((names, labels), (heads, texts)))
        size = np.array([len(labels[r]) for r in rows], np.int64)
        last = (size - 1).astype(np.uint64)
        top = np.uint64(1) << last
        full = top | (top - np.uint64(1))
        plus, minus, score, best = full.copy(), np.zeros_like(full), size.copy(), size.copy()
        active = np.array([-len(texts[r]) for r in rows])  # the longest first, so that those still read come first
        one = np.uint64(1)
        for j in range(len(codes)):
            n = int(np.searchsorted(active, -j))
            p, m, f, shift = plus[:n], minus[:n], full[:n], last[:n]
            eq = where[name[:n], codes[j][head[:n]]]
            vertical = eq | m
            horizontal = ((((eq & p) + p) ^ p) | eq) & f
            up, down = m | (~(horizontal | p) & f), p & horizontal
            score[:n] += ((up >> shift) & one).astype(np.int64) - ((down >> shift) & one).astype(np.int64)
            np.minimum(best[:n], score[:n], out=best[:n])
            up, down = (up << one) & f, (down << one) & f
            plus[:n], minus[:n] = (down | ~(vertical | up)) & f, up & vertical
        out[rows] = best
    return out


def near_match_of(label: str | None, text: str | None, max_distance: int = MAX_DISTANCE, max_text: int = MAX_TEXT) -> float:
    """Share (in percent) of the label that an approximate occurrence in the head of the text keeps; 0 if none is near enough."""
    if not label or not text:
        return 0.0
    d = substring_distance(label, text[:max_text])
    return max(0.0, (len(label) - d) / len(label)) * 100 if d <= max_distance else 0.0


def combined_of(text: str | None, label: str | None) -> float:
    """The better of both scores; the approximate search is for labels above ten characters."""
    near = near_match_of(label, text) if label and len(label) > LEAST_LABEL else 0.0
    return float(near) if near >= 100 else max(float(partial_ratio_of(text, label)), near)


def combined_many(texts: Iterable[str | None], labels: Iterable[str | None]) -> list[float]:
    """:func:`combined_of` of many rows; their approximate searches run together."""
    texts, labels = list(texts), list(labels)
    out = [0.0] * len(texts)
    asked = []
    for r, (t, v) in enumerate(zip(texts, labels)):
        if t and v:
            if v in t or t in v:
                out[r] = 100.0
            elif LEAST_LABEL < len(v) <= WORD_BITS:
                asked.append(r)
            else:
                out[r] = combined_of(t, v)
    for r, d in zip(asked, substring_distances([labels[r] for r in asked], [texts[r][:MAX_TEXT] for r in asked]).tolist()):
        near = max(0.0, (len(labels[r]) - d) / len(labels[r])) * 100 if d <= MAX_DISTANCE else 0.0
        out[r] = max(float(partial_ratio_of(texts[r], labels[r])), near)
    return out


def _udf(f, kind: str):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b)])

    return run


def partial_ratio(a: Column, b: Column) -> Column:
    return _udf(partial_ratio_of, "int")(a, b)


def near_match(label: Column, text: Column) -> Column:
    return _udf(near_match_of, "double")(label, text)


def combined_ratio(text: Column, label: Column) -> Column:
    """Score of a keyword against a text. Score distinct (text, keyword) rows: the engine does not merge equal calls."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(combined_many(a, b), dtype=float)

    return run(text, label)
