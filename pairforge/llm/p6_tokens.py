"""Encoding with a public byte-level BPE vocabulary by dynamic programming over prefixes.

A text is cut by the vocabulary's own pattern into pieces; each piece is encoded by the method:
a multi-pattern automaton over all tokens reports every token that ends at each byte, and a token
is the last one of a prefix exactly if the prefix before it is encoded and ends with a token that
is compatible with it. Two tokens are compatible if byte-pair merging of their joined bytes
yields the same two tokens, which is decided from the merge ranks along the boundary alone. The
last token of each prefix is unique, so the back-pointers from the end give the exact ids.
Pieces recur, hence each task keeps the ids of pieces it has met (a bounded memo).
"""

from __future__ import annotations

import array
import importlib.util
import json
from functools import lru_cache
from itertools import chain
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.common import MEMO_ENTRIES, arrow_map
from pairforge.session import table

#: Fixed value: the vocabulary's own splitting pattern, with the Unicode property for white space spelled out.
PIECES = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_NEVER = 1 << 60


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The file of a public vocabulary where it is installed."""
    found = importlib.util.find_spec("public_tokenizers")
    return str(Path(found.origin).with_name(name)) if found else f"/opt/tokenizers/{name}"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable bytes stand for themselves, the rest follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class PrefixEncoder:
    """Exact ids of byte strings; built once per process from the vocabulary file."""

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        alphabet, vocab = byte_alphabet(), model["vocab"]
        spell = lambda t: "".join(chr(alphabet[c]) for c in t)  # noqa: E731 - bytes as Latin-1 text, which the automaton takes
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for ch in alphabet:
            self.rank[vocab[ch]] = -1
            self.automaton.add_word(spell(ch), (vocab[ch], 1))
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole = vocab[a + b]
            self.left[whole], self.right[whole], self.rank[whole] = vocab[a], vocab[b], rank
            self.merged[vocab[a], vocab[b]] = rank
            self.automaton.add_word(spell(a + b), (whole, len(a + b)))
        self.automaton.make_automaton()
        self.known: dict[tuple[int, int], bool] = {}

    def _spine(self, token: int, child: dict[int, int]) -> list[int]:
        """From the byte at one edge of a token up to the token itself."""
        out = [token]
        while token in child:
            token = child[token]
            out.append(token)
        return out[::-1]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of ``a`` and ``b`` leaves the boundary between them.

        Merges happen in the order of their ranks, so at every moment the parts beside the boundary
        are known: the one whose next growth has the lower rank grows first. The boundary falls if the
        two parts merge before either grows; of equal pairs the leftmost goes first.
        """
        found = self.known.get((a, b))
        if found is None:
            xs, ys = self._spine(a, self.right), self._spine(b, self.left)
            i = j = 0
            found = True
            while found:
                grow_x = self.rank[xs[i + 1]] if i + 1 < len(xs) else _NEVER
                grow_y = self.rank[ys[j + 1]] if j + 1 < len(ys) else _NEVER
                join = self.merged.get((xs[i], ys[j]), _NEVER)
                if join < grow_x and join <= grow_y and join != _NEVER:
                    found = False
                elif grow_x == grow_y == _NEVER:
                    break
                elif grow_x <= grow_y:
                    i += 1
                else:
                    j += 1
            if len(self.known) > 4 * MEMO_ENTRIES:
                self.known.clear()
            self.known[a, b] = found
        return found

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        last: list[int] = [-1] * (len(data) + 1)
        size = [0] * (len(data) + 1)
        for end, (token, n) in self.automaton.iter(data):
            start = end + 1 - n
            if start == 0 or (last[start] >= 0 and self.compatible(last[start], token)):
                last[end + 1], size[end + 1] = token, n
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= size[at]
        return tuple(out[::-1])


class _Memo(dict):
    def __init__(self, encoder: PrefixEncoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encoder.encode_piece(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def _encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def encode(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key``, ``ids``: the token ids of each row's text, without special tokens.

    Null and empty texts give an empty array; text that looks like a special token is plain text.
    One row per input row; other columns are left out. ``path``: the vocabulary file, which every
    executor must be able to read.
    """
    path = path or vocabulary_path()

    def make():
        memo = _Memo(_encoder(path))
        split, get = regex.compile(PIECES).findall, memo.__getitem__

        def step(cols):
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
            flat, ends = array.array("i"), [0]
            for t in cols["_text"]:
                if t:
                    flat.extend(chain.from_iterable(map(get, split(t))))
                ends.append(len(flat))
            values = pa.array(memoryview(flat), type=pa.int32()) if len(flat) else pa.array([], pa.int32())
            yield {key: cols[key], "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values).cast(pa.list_(pa.field("element", pa.int32())))}

        return step

    kind = df.schema[key].dataType.simpleString()
    return arrow_map(df.select(F.col(key), F.col(text).alias("_text")), make, f"`{key}` {kind}, ids array<int>")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p6_ids": p6_ids}
SQL: dict[str, str] = {}
