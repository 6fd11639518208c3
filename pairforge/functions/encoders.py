"""An encoder that needs no model: signed feature hashing of words and their letter triples, of unit length.

It stands in where a sentence encoder plugs in; any function from a list of texts to vectors takes its place.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from math import sqrt
from zlib import crc32

_WORD = re.compile(r"\w+")


@lru_cache(maxsize=100_000)
def _features(word: str) -> tuple[int, ...]:
    marked = f"<{word}>"
    return tuple(crc32(g.encode()) for g in (word, *(marked[i : i + 3] for i in range(len(marked) - 2))))


def hashed(size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """An encoder to ``size`` dimensions; a text without words becomes the null vector."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * size
            for word in _WORD.findall(text.lower()):
                for h in _features(word):
                    v[h % size] += 1.0 if h >> 31 else -1.0
            norm = sqrt(sum(x * x for x in v))
            out.append([x / norm for x in v] if norm else v)
        return out

    return encode
