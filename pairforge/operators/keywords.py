"""Keyword operators: extraction, filters, clustering, subsets.

Relational steps (top n, choice of the best of a cluster, capped sums) are DataFrame plans. What
works on the few dozen keywords of one text (graph ranking, components, the order-dependent subset
filter) runs in Arrow batches with one row per text. No part-of-speech model is installed: a tagger
plugs in as a function from words to tags; the default tags by endings and is an approximation.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from math import log, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions import fuzzy
from pairforge.functions import text as T
from pairforge.functions.stem import stem_of
from pairforge.session import spread

# Order of the sources, and words that are no skill.
SOURCES = ("YAKE", "PositionRank", "SingleRank")
BLACKLIST = ("умение", "знание", "опыт", "работа", "стажировка", "практика", "студент")
# Tags that a single word must not have.
BAD_SINGLE = frozenset("ADJF ADJS COMP VERB INFN PRTF PRTS GRND NUMR ADVB NPRO PRED PREP CONJ PRCL INTJ".split())
BLACKLIST_RATIO = 92
LONGEST = 85
Tagger = Callable[[str], str]

_WORDS = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_stem = lru_cache(maxsize=50_000)(stem_of)


@lru_cache(maxsize=50_000)
def tag_by_ending(word: str) -> str:
    """A coarse tag from a word's last letters; LATN for Latin words, NOUN where nothing speaks against it."""
    w = word.lower()
    if re.fullmatch(r"[\d.\-]+", w):
        return "NUMR"
    if re.fullmatch(r"[a-z0-9+#.\-]+", w):
        return "LATN"
    if w in T.STOPWORDS:
        return "PRCL"
    for tag, ending in (("INFN", r"(?:ть|ться|ти|чь)$"), ("PRTF", r"(?:ющ|ящ|вш|нн|ем)(?:ий|ый|ая|ое|ие|ые|ого|его|ых|их|ой|ей)$"), ("ADJF", r"(?:ый|ий|ая|яя|ое|ее|ые|ие|ого|его|ому|ых|их|ую|юю)$"), ("VERB", r"(?:ет|ит|ют|ят|ал|ил|ел|ла|ло|ли|ешь|ишь)$")):
        if re.search(ending, w):
            return tag
    return "NOUN"


# ---- extraction


def _tokens(text: str) -> list[str]:
    return _WORDS.findall(text)


def _graph_scores(words: list[str], keep: list[bool], window: int, bias: dict[str, float] | None, rounds: int = 30, damping: float = 0.85) -> dict[str, float]:
    """Weighted PageRank over words that stand together within a window; ``bias``: restart weights."""
    edges: dict[str, Counter] = {}
    for i, w in enumerate(words):
        if keep[i]:
            edges.setdefault(w, Counter())
            for j in range(i + 1, min(len(words), i + window)):
                if keep[j] and words[j] != w:
                    edges[w][words[j]] += 1
                    edges.setdefault(words[j], Counter())[w] += 1
    if not edges:
        return {}
    total = sum(bias.values()) if bias else 0
    start = {w: (bias[w] / total if bias else 1 / len(edges)) for w in edges}
    rank = dict(start)
    out = {w: sum(c.values()) for w, c in edges.items()}
    # by number; a word's rank over its edges is divided once, where a count of 1, 2 or 4 gives the same bits
    place = {w: i for i, w in enumerate(edges)}
    restart, total_out = [(1 - damping) * start[w] for w in edges], [out[w] for w in edges]
    plain = [[place[v] for v in c] if set(c.values()) == {1} else None for c in edges.values()]
    counted = [[(place[v], n) for v, n in c.items()] for c in edges.values()]
    now = list(rank.values())
    for _ in range(rounds):
        part = [r / o if o else 0.0 for r, o in zip(now, total_out)]
        now = [
            base + damping * (sum([part[v] for v in one]) if one is not None else sum([n * part[v] if n in (1, 2, 4) else now[v] * n / total_out[v] for v, n in some]))
            for base, one, some in zip(restart, plain, counted)
        ]
    return dict(zip(edges, now))


def _phrases(words: list[str], keep: list[bool], most: int) -> list[tuple[str, ...]]:
    """Runs of kept words of at most ``most`` words, in order of appearance, each once."""
    runs, run = [], []
    for w, k in zip([*words, ""], [*keep, False]):
        if k:
            run.append(w)
        elif run:
            runs += [tuple(run[i : i + most]) for i in range(0, len(run), most)]
            run = []
    return list(dict.fromkeys(runs))


def extract_yake(text: str, n: int = 10, tagger: Tagger = tag_by_ending) -> list[tuple[str, float]]:
    """Statistics of single texts (case, place, frequency, spread) combined per phrase of up to two
    words. The usual score is better when lower; it is turned into a certainty between 0 and 1."""
    sentences = [_tokens(s) for s in re.split(r"[.!?\n]+", text)]
    words = [w for s in sentences for w in s]
    if not words:
        return []
    tf, capital, places, left, right = Counter(), Counter(), {}, {}, {}
    for k, s in enumerate(sentences):
        for i, w in enumerate(s):
            low = w.lower()
            tf[low] += 1
            capital[low] += i > 0 and w[:1].isupper()
            places.setdefault(low, []).append(k)
            if i:
                left.setdefault(low, set()).add(s[i - 1].lower())
                right.setdefault(s[i - 1].lower(), set()).add(low)
    mean = sum(tf.values()) / len(tf)
    spread = sqrt(sum((v - mean) ** 2 for v in tf.values()) / len(tf))
    score = {}
    for w, f in tf.items():
        p = sorted(places[w])
        position = log(log(3 + p[len(p) // 2]) + 1e-9)
        case = capital[w] / (1 + log(f))
        related = 1 + (len(left.get(w, ())) + len(right.get(w, ()))) / (2 * f) * f / max(tf.values())
        norm = f / (mean + spread)
        sent = len(set(p)) / len(sentences)
        score[w] = related * max(position, 0.05) / (case + norm / related + sent / related + 1e-9)
    found: dict[str, float] = {}
    for s in sentences:
        for i in range(len(s)):
            for size in (1, 2):
                gram = [w.lower() for w in s[i : i + size]]
                if len(gram) < size or gram[0] in T.STOPWORDS or gram[-1] in T.STOPWORDS or any(len(w) < 3 or w.isdigit() for w in gram):
                    continue
                product = 1.0
                for w in gram:
                    product *= score[w]
                key = " ".join(gram)
                found[key] = product / (1 + sum(score[w] for w in gram))
    best = sorted(found.items(), key=lambda x: (x[1], x[0]))[:n]
    return [(k, 1 / (1 + v)) for k, v in best]


def extract_position_rank(text: str, n: int = 10, tagger: Tagger = tag_by_ending) -> list[tuple[str, float]]:
    """Graph ranking with restarts weighted by early places; adjectives before nouns, up to three words."""
    words = [w.lower() for w in _tokens(text)]
    tags = [tagger(w) for w in words]
    nouns = [t in ("NOUN", "LATN") and len(w) > 2 for t, w in zip(tags, words)]
    bias: dict[str, float] = {}
    for i, w in enumerate(words):
        if nouns[i]:
            bias[w] = bias.get(w, 0) + 1 / (i + 1)
    rank = _graph_scores(words, nouns, 3, bias)
    parts = [k or t == "ADJF" for k, t in zip(nouns, tags)]
    phrases = [p for p in _phrases(words, parts, 3) if p[-1] in rank]
    return _best_phrases(phrases, rank, n)


def extract_single_rank(text: str, n: int = 10, tagger: Tagger = tag_by_ending) -> list[tuple[str, float]]:
    """Graph ranking of nouns with equal restarts; longest runs of nouns."""
    words = [w.lower() for w in _tokens(text)]
    nouns = [tagger(w) in ("NOUN", "LATN") and len(w) > 2 for w in words]
    return _best_phrases(_phrases(words, nouns, 12), _graph_scores(words, nouns, 3, None), n)


def _best_phrases(phrases: Iterable[tuple[str, ...]], rank: dict[str, float], n: int) -> list[tuple[str, float]]:
    scored = {" ".join(p): sum(rank.get(w, 0.0) for w in p) for p in phrases}
    return sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:n]


EXTRACTORS = {"YAKE": extract_yake, "PositionRank": extract_position_rank, "SingleRank": extract_single_rank}


def extract(texts: DataFrame, key: str = "text_id", text: str = "text", n: int = 10, window: tuple[int, int] | None = None, tagger: Tagger = tag_by_ending) -> DataFrame:
    """``key`` and ``kws`` (array of value, certainty, source; certainty descending) of each text.

    ``window``: (size, delta) extracts from sentence windows, results of all windows together,
    repetitions kept. Null and empty texts give an empty array. Give distinct texts: equal texts are
    not merged here.
    """
    pieces = T.sentence_windows(text, *window) if window else F.array(T.text_or_empty(text))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for parts in df["pieces"]:
                kws = [{"value": v, "certainty": float(c), "source": s} for part in parts for s, f in EXTRACTORS.items() for v, c in f(part, n, tagger)]
                out.append(sorted(kws, key=lambda k: -k["certainty"]))
            yield pd.DataFrame({key: df[key], "kws": out})

    kind = texts.schema[key].dataType.simpleString()
    return spread(texts.select(key, pieces.alias("pieces")), key).mapInPandas(run, f"`{key}` {kind}, kws array<struct<value:string,certainty:double,source:string>>")


def extract_windows(texts: DataFrame, windows: list[tuple[int, int] | None], keys: list[str], text: str = "text", n: int = 10, tagger: Tagger = tag_by_ending) -> DataFrame:
    """``keys``, ``window`` (its place in the list), ``pos``, ``value``, ``certainty``, ``source``: what :func:`extract` gives for each
    of the windows, with every distinct piece of a text extracted once."""
    pieces = F.array(*(T.sentence_windows(text, *w) if w else F.array(T.text_or_empty(text)) for w in windows))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for key, lists in zip(df[keys].itertuples(index=False, name=None), df["pieces"]):
                known: dict[str, list[tuple]] = {}
                for number, parts in enumerate(lists):
                    for part in parts:
                        if part not in known:
                            known[part] = [(v, float(c), s) for s, f in EXTRACTORS.items() for v, c in f(part, n, tagger)]
                    kws = sorted((k for part in parts for k in known[part]), key=lambda k: -k[1])
                    rows += [(*key, number, pos, *k) for pos, k in enumerate(kws)]
            yield pd.DataFrame(rows, columns=[*keys, "window", "pos", "value", "certainty", "source"])

    kinds = "".join(f"`{k}` {texts.schema[k].dataType.simpleString()}, " for k in keys)
    return spread(texts.select(*keys, pieces.alias("pieces")), *keys).mapInPandas(run, kinds + "window int, pos int, value string, certainty double, source string")


# ---- filters


def is_bad_phrase(value: str, tagger: Tagger = tag_by_ending) -> bool:
    """A single word of a bad tag, a phrase without a noun or Latin word, or one with a finite verb."""
    tags = [tagger(w) for w in _tokens(value)]
    if len(tags) == 1 and tags[0] in BAD_SINGLE:
        return True
    return not any(t in ("NOUN", "LATN") for t in tags) or "VERB" in tags


def exclude(keywords: DataFrame, value: str = "value", blacklist: tuple[str, ...] = BLACKLIST, tagger: Tagger = tag_by_ending) -> DataFrame:
    """Keyword rows without bad phrases and without likenesses of the blacklist; each distinct value is judged once."""

    @F.pandas_udf("boolean")
    def good(values: pd.Series) -> pd.Series:
        return values.map(lambda v: not is_bad_phrase(v, tagger) and not any(fuzzy.reaches(b, v, BLACKLIST_RATIO) for b in blacklist))

    # the engine would infer the filter for all rows from the join, and judge every one of them
    good = good.asNondeterministic()
    judged = spread(keywords.select(value).distinct(), value).withColumn("_good", good(value)).where("_good").drop("_good")
    return keywords.join(judged, value, "left_semi")


def top_keywords(keywords: DataFrame, n: int, group: list[str], certainty: str = "certainty", value: str = "value") -> DataFrame:
    """The n keywords of largest certainty per group; ties in the order of values."""
    w = Window.partitionBy(*group).orderBy(F.col(certainty).desc(), F.col(value))
    return keywords.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def cut_to_zero(score: Column, cutoff: float | Column) -> Column:
    """Scores below the cutoff (a share, scores are percents) count as 0."""
    return F.when(score < cutoff * 100, F.lit(0.0)).otherwise(score)


def saturated_mean(scores: Column, most: int = 6) -> Column:
    """Mean of the ``most`` largest of an array of scores, of all if there are fewer; 0 for none."""
    top = F.slice(F.sort_array(scores, asc=False), 1, most)
    return F.when(F.size(scores) > 0, F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.size(top)).otherwise(0.0)


# ---- clusters


def select_best(clustered: DataFrame, group: list[str], sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """One row per cluster: its ``value``, ``certainty`` (their sum, at most 1), ``items_num``.

    The value comes from the first source that the cluster has, among those above 0.66 of that
    source's largest certainty, and is the longest; ties go to the larger certainty, then to the value.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, sources)), F.col("source")), F.lit(0)), F.lit(len(sources) + 1))
    whole = Window.partitionBy(*group)
    rows = clustered.withColumn("_rank", rank).withColumn("_first", F.min("_rank").over(whole))
    rows = rows.withColumns({"_sum": F.sum("certainty").over(whole), "_n": F.count("*").over(whole)}).where("_rank = _first")
    rows = rows.withColumn("_max", F.max("certainty").over(whole)).where("certainty > _max * 0.66")
    w = Window.partitionBy(*group).orderBy(F.length("value").desc(), F.col("certainty").desc(), "value")
    best = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return best.select(*group, "value", F.least("_sum", F.lit(1.0)).alias("certainty"), F.col("_n").alias("items_num"))


def filter_subsets(values: list[str]) -> list[str]:
    """Walks the values in order: one that is part of a kept value is skipped, a kept value that is part
    of the new one gives way to it. Returns the given values that are kept in the end, in order."""
    kept: list[str] = []
    for v in values:
        held = False
        for i, k in enumerate(kept):
            if v in k:
                held = True
                break
            if k in v:
                kept[i] = v
                held = True
        if not held:
            kept.append(v)
    alive = set(kept)
    return [v for v in values if v in alive]


def _vectors(values: list[str]) -> list[dict[str, float]]:
    grams = []
    for v in values:
        stems = [_stem(w) for w in re.findall(r"\b\w\w+\b", v.lower())]
        grams.append(Counter(" ".join(stems[i : i + n]) for n in (1, 2, 3) for i in range(len(stems) - n + 1)))
    df = Counter(g for c in grams for g in c)
    out = []
    for c in grams:
        w = {g: n * (log((1 + len(values)) / (1 + df[g])) + 1) for g, n in c.items()}
        norm = sqrt(sum(x * x for x in w.values()))
        out.append({g: x / norm for g, x in w.items()} if norm else {})
    return out


def components(values: list[str], eps: float) -> list[int]:
    """Cluster numbers of values whose unit vectors are at most ``eps`` apart, directly or through others.
    Empty vectors are at distance 1 from others and 0 from one another."""
    vectors, parent = _vectors(values), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        parent[max(root(i), root(j))] = min(root(i), root(j))

    empty = [i for i, v in enumerate(vectors) if not v]
    for i in empty:
        join(i, empty[0])
    if eps * eps + 1e-12 >= 1 and empty and len(empty) < len(values):
        for i in range(len(values)):
            join(i, empty[0])
    if eps * eps + 1e-12 >= 2:
        full = [i for i, v in enumerate(vectors) if v]
        for i in full:
            join(i, full[0])
    # nearer than unrelated vectors are only those that share a part, which its list names
    seen: dict[str, list[int]] = {}
    for i, a in enumerate(vectors):
        shared: dict[int, float] = {}
        for g, x in a.items():
            for j in seen.setdefault(g, []):
                shared[j] = shared.get(j, 0.0) + x * vectors[j][g]
            seen[g].append(i)
        for j, dot in shared.items():
            if max(2 - 2 * dot, 0.0) <= eps * eps + 1e-12:
                join(i, j)
    numbers: dict[int, int] = {}
    return [numbers.setdefault(root(i), len(numbers)) for i in range(len(values))]


def cluster_keywords(kws: list[dict], eps: float = 0.95, sources: tuple[str, ...] = SOURCES) -> list[dict]:
    """Clusters of one text's keywords: ``value``, ``certainty``, ``items`` (v, s), certainty descending, subsets filtered."""
    kws = [k for k in kws if len(k["value"]) < LONGEST]
    if not kws:
        return []
    groups: dict[int, list[dict]] = {}
    for c, k in zip(components([k["value"] for k in kws], eps), kws):
        groups.setdefault(c, []).append(k)
    found = []
    for group in groups.values():
        group = sorted(group, key=lambda k: -k["certainty"])
        first = next((s for s in sources if any(k["source"] == s for k in group)), None)
        chosen = [k for k in group if first is None or k["source"] == first]
        most = max(k["certainty"] for k in chosen)
        near = [k for k in chosen if k["certainty"] > 0.66 * most] or chosen[:1]
        best = min(near, key=lambda k: (-len(k["value"]), -k["certainty"], k["value"]))  # the ties of select_best
        found.append({"value": best["value"], "certainty": min(sum(k["certainty"] for k in group), 1.0), "items": [{"v": k["value"], "s": k["source"]} for k in group]})
    found.sort(key=lambda k: -k["certainty"])
    alive = set(filter_subsets([k["value"] for k in found]))
    return [k for k in found if k["value"] in alive]


def keyword_pipeline(texts: DataFrame, key: str = "text_id", text: str = "text", eps: float = 0.95, n: int = 10, window: tuple[int, int] | None = None, tagger: Tagger = tag_by_ending, blacklist: tuple[str, ...] = BLACKLIST) -> DataFrame:
    """``key``, ``value``, ``certainty``, ``items_num`` of every text's keywords: extraction, filters, clusters."""
    raw = extract(texts, key, text, n, window, tagger).select(key, F.posexplode("kws").alias("pos", "k")).select(key, "pos", "k.*")
    good = exclude(raw, "value", blacklist, tagger)
    lists = good.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "value", "certainty", "source"))).alias("kws"))  # a few dozen per text
    kind = texts.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [(k, c["value"], c["certainty"], len(c["items"])) for k, kws in zip(df[key], df["kws"]) for c in cluster_keywords(list(kws), eps)]
            yield pd.DataFrame(rows, columns=[key, "value", "certainty", "items_num"])

    return lists.mapInPandas(run, f"`{key}` {kind}, value string, certainty double, items_num int")
