"""Training of word vectors, and the sequential search over their parameters."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.storage import materialize, passing


@dataclass(frozen=True)
class TrainParams:
    """Parameters of word vectors: skip-gram (``sg`` 1) or continuous bag of words (0), with n-grams of ``min_n`` to ``max_n``
    letters if given. ``partitions``: shards that are trained side by side and averaged."""

    window: int = 5
    epochs: int = 5
    sg: int = 1
    min_count: int = 5
    vector_size: int = 100
    min_n: int | None = None
    max_n: int | None = None
    seed: int = 42
    partitions: int = 1

    def name(self, group: str = "model") -> str:
        parts = [group, "sg", self.sg, self.window, self.epochs, self.min_count, self.vector_size]
        return "-".join(str(p) for p in parts + [p for p in (self.min_n, self.max_n) if p is not None])


def train_word2vec(corpus: DataFrame, params: TrainParams, tokens: str = "tokens") -> DataFrame:
    """``word``, ``vec`` of a skip-gram model over token arrays; null arrays are left out."""
    if params.sg != 1:
        raise ValueError("this trainer is for skip-gram (sg=1); see train()")
    return train_subwords(corpus, replace(params, min_n=None, max_n=None), tokens=tokens)


def char_ngrams(word: str, low: int, high: int):
    """Distinct character n-grams of a word in angle brackets."""
    marked = F.concat(F.lit("<"), F.col(word), F.lit(">"))
    of = lambda n: F.when(F.length(marked) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1))), lambda i: F.substr(marked, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in range(low, high + 1)]))


#: Rows that the n-grams of letters are hashed to, words drawn against each right one, centres in a step, and the rate of learning.
BUCKETS = 20_000
NEGATIVES = 5
STEP = 256
RATE = 0.05


def _gram_rows(word: str, params: TrainParams, first: int) -> list[int]:
    """Rows of a word's n-grams behind the ``first`` rows of words."""
    if params.min_n is None or params.max_n is None:
        return []
    marked = f"<{word}>"
    grams = {marked[i : i + n] for n in range(params.min_n, params.max_n + 1) for i in range(len(marked) - n + 1)}
    return [first + crc32(g.encode()) % BUCKETS for g in sorted(grams)]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first`` to ``first + count - 1`` of every row, one after another."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _add(matrix: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds each of the values to its row of the matrix, repeated rows too; over single numbers, which is many times faster than over rows."""
    width = matrix.shape[1]
    np.add.at(matrix.reshape(-1), (rows[:, None] * width + np.arange(width)).ravel(), np.ascontiguousarray(values, matrix.dtype).ravel())


def _shard(sentences: list[np.ndarray], parts: list[np.ndarray], inner: np.ndarray, outer: np.ndarray, noise: np.ndarray, params: TrainParams, rate: float, rng: np.random.Generator) -> None:
    """One pass over the sentences of a shard, which changes both matrices in place: negative sampling, whose draws the
    contexts of a centre share. ``parts``: the rows that make up each word (itself and its n-grams)."""
    if not sentences:
        return
    part_count = np.array([len(rows) for rows in parts], np.int64)
    part_first, part_rows = np.cumsum(part_count) - part_count, np.concatenate(parts)
    tokens = np.concatenate(sentences)
    length = np.array([len(s) for s in sentences], np.int64)
    begin = np.repeat(np.cumsum(length) - length, length)
    end = begin + np.repeat(length, length)
    reach = np.concatenate([rng.integers(1, params.window + 1, n) for n in length])
    places = np.arange(len(tokens))
    left = np.maximum(begin, places - reach)
    around = np.minimum(end - 1, places + reach) - left
    centres = np.flatnonzero(around)
    order = rng.permutation(len(centres))
    sigmoid = lambda x: 1.0 / (1.0 + np.exp(-np.clip(x, -12, 12)))
    firsts = lambda n: np.cumsum(n) - n
    for at in range(0, len(order), STEP):
        chosen = centres[order[at : at + STEP]]
        count = around[chosen]
        near = _ranges(left[chosen], count)
        near += near >= np.repeat(chosen, count)  # the centre itself is left out
        each = np.ones(len(chosen), np.int64)
        # the words that are read, and those that are to be told from noise; how many of them a centre has
        read, reads, told, tells = (tokens[chosen], each, tokens[near], count) if params.sg == 1 else (tokens[near], count, tokens[chosen], each)
        rows = part_rows[_ranges(part_first[read], part_count[read])]
        held = np.add.reduceat(part_count[read], firsts(reads))
        share = (1.0 / held)[:, None]
        h = (np.add.reduceat(inner[rows], firsts(held), axis=0) * share).astype(np.float32)
        drawn = noise[rng.integers(0, len(noise), (len(chosen), NEGATIVES))]
        good, bad = outer[told], outer[drawn]
        wide = np.repeat(h, tells, axis=0)
        g = ((1.0 - sigmoid(np.einsum("cd,cd->c", wide, good))) * rate)[:, None]
        d = -sigmoid(np.einsum("bd,bkd->bk", h, bad)) * tells[:, None] / NEGATIVES * rate
        back = np.add.reduceat(g * good, firsts(tells), axis=0) + np.einsum("bk,bkd->bd", d, bad)
        _add(outer, told, np.clip(g * wide, -0.5, 0.5))
        _add(outer, drawn.ravel(), np.clip(d[..., None] * h[:, None], -0.5, 0.5).reshape(-1, h.shape[1]))
        _add(inner, rows, np.repeat(np.clip(back * share, -0.5, 0.5), held, axis=0))


def _add_shared(matrix: np.ndarray, rows: np.ndarray, values: np.ndarray, which: np.ndarray) -> None:
    """Adds ``values[which]`` to the rows like :func:`_add`, faster for thousands of rows of which few are repeated: in rounds that
    hold each row once."""
    turn = np.empty(len(matrix), np.int32)
    for _ in range(8):
        if len(rows) < 32:
            break
        place = np.arange(len(rows), dtype=np.int32)
        turn[rows] = place
        last = turn[rows] == place
        now, rest = np.flatnonzero(last), np.flatnonzero(~last)
        at = rows[now]
        matrix[at] = matrix.take(at, axis=0) + values.take(which[now], axis=0)
        rows, which = rows[rest], which[rest]
    _add(matrix, rows, values[which])


#: Centres of a sentence that are multiplied at once, and words drawn for all centres of a step together.
PIECE = 128
DRAWS = 256


def _skipgram(tokens: np.ndarray, length: np.ndarray, parts: tuple[np.ndarray, np.ndarray], inner: np.ndarray, outer: np.ndarray, noise: np.ndarray, params: TrainParams, rate: float, rng: np.random.Generator) -> None:
    """One skip-gram pass like :func:`_shard`'s over sentences one after another (``tokens``, ``length``), in matrix products.

    A step takes whole sentences of like length, of about ``STEP`` centres, fewer if the words are few, so that no row is changed many
    times from where it was; all pairs of a centre and a word in its window count. All centres of a step share its draws, which together weigh as much as in ``_shard``. ``parts``: how many rows make up each word, and the rows.
    """
    part_count, part_rows = parts
    part_first, whole = np.cumsum(part_count) - part_count, bool((part_count == 1).all())
    ends = np.cumsum(length)
    pieces = -(-length // PIECE) * (length > 1)
    low, high = np.repeat(ends - length, pieces), np.repeat(ends, pieces)
    first = low + _ranges(np.zeros_like(pieces), pieces) * PIECE
    centres = np.minimum(PIECE, high - first)
    left = np.maximum(low, first - params.window)
    beside = np.minimum(high, first + centres + params.window) - left
    places, begin, end = np.arange(len(tokens)), np.repeat(ends - length, length), np.repeat(ends, length)
    reach = rng.integers(1, params.window + 1, len(tokens))
    around = np.minimum(end - 1, places + reach) - np.maximum(begin, places - reach)
    order = rng.permutation(len(first))
    order = order[np.argsort(beside[order], kind="stable")]
    most = min(STEP, max(8, len(part_count) // 4))
    steps = np.split(order, np.flatnonzero(np.diff((np.cumsum(centres[order]) - 1) // most)) + 1)
    rate, size = np.float32(rate), inner.shape[1]
    for number in rng.permutation(len(steps)):
        p = steps[number]
        if not len(p):
            continue
        # by piece: places of centres and of words beside them, from the piece's first centre on; what only fills up is told by its mask
        at, by = np.arange(centres[p].max()), (left[p] - first[p])[:, None] + np.arange(beside[p].max())
        real, near = at < centres[p][:, None], np.arange(by.shape[1]) < beside[p][:, None]
        mine, other = first[p][:, None] + np.where(real, at, 0), first[p][:, None] + np.where(near, by, 0)
        apart = np.abs(np.where(near, by, 1 << 30).astype(np.int32)[:, None, :] - at.astype(np.int32)[:, None])
        told = (apart <= np.where(real, reach[mine], 0).astype(np.int32)[:, :, None]) & (apart > 0)
        words = tokens[mine[real]]
        if whole:
            h = inner[part_rows[words]]
        else:
            known, which = np.unique(words, return_inverse=True)
            held = part_count[known]
            rows = part_rows[_ranges(part_first[known], held)]
            share = (1 / held).astype(np.float32)[:, None]
            h = (np.add.reduceat(inner.take(rows, axis=0), np.cumsum(held) - held, axis=0) * share)[which]
        wide = np.zeros((*real.shape, size), np.float32)
        wide[real] = h
        good = outer[tokens[other]]
        g = told * rate / (1 + np.exp(np.clip(wide @ good.transpose(0, 2, 1), -12, 12)))
        drawn = noise[rng.integers(0, len(noise), DRAWS)]
        bad = outer[drawn]
        d = (around[mine[real]] * (-rate / DRAWS)).astype(np.float32)[:, None] / (1 + np.exp(np.clip(-(h @ bad.T), -12, 12)))
        back = (g @ good)[real] + d @ bad
        _add(outer, np.concatenate([tokens[other[near]], drawn]), np.clip(np.concatenate([(g.transpose(0, 2, 1) @ wide)[near], d.T @ h]), -0.5, 0.5))
        if whole:
            _add(inner, part_rows[words], np.clip(back, -0.5, 0.5))
        else:
            change = np.zeros((len(known), size), np.float32)
            _add(change, which, np.clip(back * share[which], -0.5, 0.5))
            _add_shared(inner, rows, change, np.repeat(np.arange(len(known)), held))


#: Rows of a matrix that travel together, and that the driver takes from all shards at once.
BLOCK, SENT = 2048, 8_192


def _learner(fixed, state, params: TrainParams, rate: float, epoch: int):
    """What each shard changes in one pass, by blocks of the inner (``side`` 0) and the outer (1) matrix: the first row, which rows
    are changed, by how much. Rows come ordered by shard."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (counts, rows), noise = fixed.value
        before, after, now, rng = state.value, None, None, None

        def changes() -> Iterator[pa.RecordBatch]:
            for side, (old, new) in enumerate(zip(before, after)):
                for k in range(0, len(old), BLOCK):
                    delta = new[k : k + BLOCK] - old[k : k + BLOCK]
                    touched = delta.any(1)
                    if touched.any():
                        yield pa.RecordBatch.from_pydict({"side": pa.array([side], pa.int32()), "k": pa.array([k], pa.int32()), "touched": pa.array([touched.tobytes()], pa.binary()), "delta": pa.array([delta.tobytes()], pa.binary())})

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if shards[low] != now:
                    if now is not None:
                        yield from changes()
                    now, after, rng = shards[low], [m.copy() for m in before], np.random.default_rng([params.seed, epoch, int(shards[low])])
                words = batch.column("words").slice(low, high - low)
                tokens, length = words.flatten().to_numpy().astype(np.int64), words.value_lengths().to_numpy().astype(np.int64)
                if params.sg == 1:
                    _skipgram(tokens, length, (counts, rows), *after, noise, params, rate, rng)
                else:
                    _shard(np.split(tokens, np.cumsum(length)[:-1]), np.split(rows, np.cumsum(counts)[:-1]), *after, noise, params, rate, rng)
        if now is not None:
            yield from changes()

    return learn


def train_subwords(corpus: DataFrame, params: TrainParams, words: DataFrame | None = None, tokens: str = "tokens") -> DataFrame:
    """``word``, ``vec`` of a model over words and their n-grams of letters, skip-gram or continuous bag of words.

    Each pass trains ``partitions`` shards from the same state and averages what they changed. ``words`` (a column ``word``):
    words that vectors are wanted for too, by their n-grams if the model does not know them; words without a known part are left
    out. The state (vocabulary after ``min_count``, and n-gram rows, times ``vector_size``) passes through the driver and a broadcast
    once in each pass; ``min_count`` bounds it. Null arrays, and null and empty tokens, are left out.
    """
    spark = corpus.sparkSession
    rows = corpus.select(F.filter(tokens, lambda t: t.isNotNull() & (t != "")).alias("t")).where("size(t) > 0").withColumn("shard", F.pmod(F.xxhash64("t"), F.lit(params.partitions)).cast("int"))
    rows = materialize(rows, "tokens")
    counted = materialize(rows.select(F.explode("t").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= params.min_count), "vocabulary")
    counts = counted.orderBy("word").collect()
    schema = "word string, vec array<double>"
    if not counts:
        return spark.createDataFrame([], schema)
    vocabulary = {r["word"]: k for k, r in enumerate(counts)}
    rng = np.random.default_rng(params.seed)
    size = len(vocabulary) + (BUCKETS if params.min_n is not None else 0)
    inner = ((rng.random((size, params.vector_size), np.float32) - 0.5) / params.vector_size).astype(np.float32)
    outer = np.zeros((len(vocabulary), params.vector_size), np.float32)
    weight = np.array([r["n"] for r in counts], float) ** 0.75
    noise = np.repeat(np.arange(len(counts)), np.maximum(1, np.round(weight / weight.sum() * 100_000)).astype(int))
    del counts
    each = [np.array([k, *_gram_rows(w, params, len(vocabulary))]) for w, k in vocabulary.items()]
    fixed = spark.sparkContext.broadcast(((np.array([len(r) for r in each]), np.concatenate(each)), noise))
    del each
    named = spark.sparkContext.broadcast(vocabulary)

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = named.value
        for df in frames:
            yield pd.DataFrame({"shard": df["shard"], "place": df["place"], "words": [[known[w] for w in t if w in known] for t in df["t"]]})

    coded = materialize(rows.withColumn("place", F.xxhash64("t")).mapInPandas(code, "shard int, place long, words array<int>"), "coded")
    for epoch in range(params.epochs):
        state = spark.sparkContext.broadcast((inner, outer))
        rate = RATE * (1 - epoch / params.epochs)
        # ranges of a given number give each shard a task of its own; hashes would be merged into fewer
        ordered = coded.repartitionByRange(params.partitions, "shard").sortWithinPartitions("shard", "place")
        with passing(ordered.mapInArrow(_learner(fixed, state, params, rate, epoch), "side int, k int, touched binary, delta binary"), "changes") as changes:
            for side, matrix in enumerate((inner, outer)):
                for first in range(0, len(matrix), SENT):
                    part = matrix[first : first + SENT]
                    total, times = np.zeros(part.shape), np.zeros((len(part), 1), np.int32)
                    for r in changes.where((F.col("side") == side) & (F.col("k") >= first) & (F.col("k") < first + SENT)).collect():  # a few MB from each shard
                        delta = np.frombuffer(r["delta"], np.float32).reshape(-1, params.vector_size)
                        at = slice(r["k"] - first, r["k"] - first + len(delta))
                        total[at] += delta
                        times[at, 0] += np.frombuffer(r["touched"], bool)
                    part += (total / np.maximum(times, 1)).astype(np.float32)
        state.destroy()
        spark.sparkContext._jvm.System.gc()  # else what the passes leave behind fills the driver's memory
    fixed.destroy()
    named.destroy()
    done = spark.sparkContext.broadcast((vocabulary, inner))

    def give(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, matrix = done.value
        for df in frames:
            out = []
            for w in df["word"]:
                at = ([known[w]] if w in known else []) + _gram_rows(w, params, len(known))
                if at:
                    out.append((w, matrix[at].mean(0).astype(float).tolist()))
            yield pd.DataFrame(out, columns=["word", "vec"])

    asked = counted.select("word")
    if words is not None:
        asked = asked.unionByName(words.select("word").where("word is not null")).distinct()
    return asked.mapInPandas(give, schema)


def train(corpus: DataFrame, params: TrainParams, kind: str = "word2vec", words: DataFrame | None = None, tokens: str = "tokens") -> DataFrame:
    """Vectors of the kind 'word2vec' (skip-gram or continuous bag of words) or 'fastText'."""
    if kind not in ("word2vec", "fastText"):
        raise ValueError(f"unknown kind of vectors: {kind}")
    if kind == "word2vec" and params.sg == 1:
        return train_word2vec(corpus, params, tokens)
    return train_subwords(corpus, params, words, tokens)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def trained(spark: SparkSession, corpus: DataFrame, params: TrainParams, folder: str, tokens: str = "tokens", kind: str = "word2vec") -> DataFrame:
    """The vectors of these parameters from the folder, trained and written first if they are not there."""
    path = f"{folder}/{kind}-{hashlib.md5(json.dumps(asdict(params), sort_keys=True).encode()).hexdigest()}"
    if not exists(spark, f"{path}/_SUCCESS"):
        train(corpus, params, kind, tokens=tokens).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def train_all(spark: SparkSession, corpus: DataFrame, runs: dict[str, TrainParams], folder: str, tokens: str = "tokens", kind: str | None = None) -> dict[str, DataFrame]:
    """The vectors of every run, trained where they are not there yet; runs with n-grams are of the kind 'fastText'."""
    return {name: trained(spark, corpus, p, folder, tokens, kind or ("word2vec" if p.min_n is None else "fastText")) for name, p in runs.items()}


def cascade(steps: list[dict[str, str]], evaluate: Callable[[TrainParams], float], start: TrainParams = TrainParams()) -> tuple[list[dict], TrainParams, float]:
    """Walks a scenario in order: 'x' in a cell takes the best value so far. Returns the log, the best
    parameters and their measure; equal measures keep the earlier ones."""
    best, measure, log = start, float("-inf"), []
    for row in steps:
        cells = {k: v for k, v in row.items() if k in TrainParams.__dataclass_fields__ and v not in (None, "", "x")}
        params = replace(best, **{k: int(v) for k, v in cells.items()})
        got = evaluate(params)
        if got > measure:
            best, measure = params, got
        log.append({"group": row.get("group"), "model": params.name(str(row.get("group"))), "measure": got, "best": measure})
    return log, best, measure


def research(spark: SparkSession, steps: list[dict[str, str]], corpus: DataFrame, pairs: DataFrame, folder: str, kind: str = "word2vec", tokens: str = "tokens", start: TrainParams = TrainParams()) -> tuple[list[dict], TrainParams, float]:
    """A cascade that trains: each step's vectors are trained (once, in the folder), score the pairs and are measured by the
    area under the ROC curve. The best parameters are written to the folder as JSON."""
    from pairforge.functions import text as T
    from pairforge.operators import metrics as M
    from pairforge.operators.matchers import WordVectorMatcher
    from pairforge.sources.sinks import save_json

    def measure(params: TrainParams) -> float:
        vectors = trained(spark, corpus, params, folder, tokens, kind)
        scored = WordVectorMatcher(vectors, T.tokens).score(pairs)
        return M.roc_auc(scored, []).first()["auc"] or 0.0

    log, best, value = cascade(steps, measure, start)
    save_json(spark, f"{folder}/best-{kind}.json", asdict(best) | {"measure": value})
    return log, best, value
