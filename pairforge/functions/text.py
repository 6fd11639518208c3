"""Text functions as native column expressions; nulls count as empty texts.

Patterns use Unicode properties (``\\w`` of the JVM knows ASCII alone) and no look-around, so that
the same rules can be written in SQL of other engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}_]{2,})"
WORD = r"([\p{L}\p{N}_]+)"
#: Characters that the cleaner keeps beside letters and digits.
KEPT = r"\n \-,()/\\!?;."
#: Marks dropped as tokens.
PUNCTUATION = ("!", ",", "(", ")", ";", ":", "-", "?", ".", "..", "...", '"', "/", "``", "»", "«")
#: Usual Russian words without content of their own; pass another list for other languages.
STOPWORDS = tuple(
    """и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был
него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому
этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много
разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между""".split()
)

Lemmatizer = Callable[[Column], Column]


def identity_lemma(tokens: Column) -> Column:
    """The default lemmatizer: tokens as they are. A dictionary plugs in as a function of an array column."""
    return tokens


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: str | Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text_or_empty(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def fix_text(c: str | Column) -> Column:
    """Line ends and tabs to spaces, runs of stops and spaces to one, no space before a stop."""
    out = text_or_empty(c)
    for pattern, by in (("\n", " "), (r"\.+", "."), ("\t", " "), (" +", " "), (r" \.", "."), (r"\.+ ", ". ")):
        out = F.regexp_replace(out, pattern, by)
    return out


def strip_characters(c: str | Column) -> Column:
    """Drops list marks and every character that is not a letter, digit or among ``KEPT``; a line that
    does not end with a stop gets one (also an empty line but not the first)."""
    out = text_or_empty(c)
    for pattern, by in ((r"[0-9]+\.", ""), (r"[а-яА-Я]\)", ""), ("- ", " "), ("^-", ""), (r"[;\.–·](\n?)$", "$1"), (rf"[^\p{{L}}\p{{N}}{KEPT}]", "")):
        out = F.regexp_replace(out, pattern, by)
    for _ in range(2):  # neighbouring line ends share a character, so two rounds
        out = F.regexp_replace(out, r"([^.])\n", "$1.\n")
    return out


def remove_tags(c: str | Column) -> Column:
    """Text of markup, its pieces joined by line ends: scripts, styles and comments go, the five basic entities are read."""
    out = F.regexp_replace(text_or_empty(c), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?s)(?:<[a-zA-Z/!][^>]*>)+", "\n")
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&#39;", "'"), ("&amp;", "&")):
        out = F.regexp_replace(out, entity, ch)
    return F.regexp_replace(out, r"^\n+|\n+$", "")


def words(c: str | Column) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(WORD), 1)


def tokens(c: str | Column) -> Column:
    """Words of two characters or more of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(TOKEN), 1)


def without(arr: Column, dropped: tuple[str, ...]) -> Column:
    """An array without the given values; keeps order and repetitions."""
    values = F.array(*map(F.lit, dropped)) if dropped else F.array().cast("array<string>")
    return F.filter(arr, lambda t: ~F.array_contains(values, t))


def is_punct(token: Column) -> Column:
    """All characters are punctuation; true for an empty token."""
    return token.rlike(r"^\p{P}*$")


def is_stopword(token: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    return F.lower(token).isin(*stopwords)


def pieces(c: str | Column) -> Column:
    """Words and single other signs, in order."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), 1)


def normalize(c: str | Column, *, tags=False, lower=True, characters=False, fix=True, stopwords: tuple[str, ...] | None = None) -> Column:
    """The flagged steps in their order: ends, tags, case, characters, spaces, stop words and punctuation."""
    out = strip(c)
    if tags:
        out = remove_tags(out)
    if lower:
        out = F.lower(out)
    if characters:
        out = strip_characters(out)
    if fix:
        out = fix_text(out)
    if stopwords is not None:
        values = F.array(*map(F.lit, stopwords))
        out = F.concat_ws(" ", F.filter(pieces(out), lambda t: ~F.array_contains(values, F.lower(t)) & ~is_punct(t)))
    return out


def preprocess(c: str | Column, stopwords: tuple[str, ...] = STOPWORDS, lemma: Lemmatizer = identity_lemma) -> Column:
    """Tokens for embeddings: lower case, no marks, lemmas, none that starts with a digit, no stop words."""
    found = F.filter(pieces(F.lower(text_or_empty(c))), lambda t: ~t.isin(*PUNCTUATION))
    return without(F.filter(lemma(found), lambda t: ~t.rlike("^[0-9]")), stopwords)


def preprocess_text(c: str | Column, stopwords: tuple[str, ...] = STOPWORDS, lemma: Lemmatizer = identity_lemma) -> Column:
    """A text again: lower case, stop words gone, ASCII marks deleted but ``#*+-/``, lemmas, joined by spaces."""
    kept = without(F.filter(F.split(F.lower(text_or_empty(c)), r"\s+"), lambda t: t != ""), stopwords)
    plain = F.transform(kept, lambda t: F.regexp_replace(t, r"[!\"$%&'(),.:;<=>?@\[\]\\^_`{|}~]", ""))
    return F.concat_ws(" ", F.filter(lemma(F.filter(plain, lambda t: t != "")), lambda t: t != " "))


def sentences(c: str | Column) -> Column:
    """Sentences cut after stops followed by white space."""
    marked = F.regexp_replace(text_or_empty(c), r"([.!?…]+[»”\"')]*)\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")


def sent_preprocess(c: str | Column) -> Column:
    """Sentences without marks and digits; empty ones dropped."""
    cleaned = F.transform(sentences(c), lambda s: F.regexp_replace(s, r"[^\p{L}\p{N}_\s]|[0-9]+", ""))
    return F.filter(cleaned, lambda s: s != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, also where lambdas of the body use it for every element."""
    return F.transform(F.array(value), body)[0]


def ngrams(arr: Column, low: int, high: int) -> Column:
    """Word n-grams of all sizes from ``low`` to ``high``, joined by spaces."""

    def of(a: Column, n: int) -> Column:
        last = F.size(a) - n + 1
        made = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(a, i, n), " "))
        return F.when(last >= 1, made).otherwise(F.array().cast("array<string>"))

    return let(arr, lambda a: F.concat(*[of(a, n) for n in range(low, high + 1)]))


def sentence_windows(c: str | Column, size: int = 170, delta: int = 50) -> Column:
    """Windows of pieces between full stops: before a piece is added to pieces longer than ``size`` together,
    they are emitted and their longest tail of at most ``delta`` characters starts the next window; what is left at the end is emitted."""
    parts = F.split(text_or_empty(c), r"\.")
    length = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    empty = F.array().cast("array<string>")

    def tail(cur: Column) -> Column:
        start = F.struct(empty.alias("k"), F.lit(0).alias("s"), F.lit(False).alias("done"))
        step = lambda a, x: F.when(a["done"] | (a["s"] + F.length(x) > delta), F.struct(a["k"].alias("k"), a["s"].alias("s"), F.lit(True).alias("done"))).otherwise(
            F.struct(F.concat(F.array(x), a["k"]).alias("k"), (a["s"] + F.length(x)).alias("s"), F.lit(False).alias("done"))
        )
        return F.aggregate(F.reverse(cur), start, step)["k"]

    def fold(a: Column, x: Column) -> Column:
        full = length(a["cur"]) > size
        out = F.when(full, F.concat(a["out"], F.array(F.array_join(a["cur"], ".")))).otherwise(a["out"])
        return F.struct(out.alias("out"), F.concat(F.when(full, tail(a["cur"])).otherwise(a["cur"]), F.array(x)).alias("cur"))

    done = F.aggregate(parts, F.struct(empty.alias("out"), empty.alias("cur")), fold)
    return F.when(length(done["cur"]) > 0, F.concat(done["out"], F.array(F.array_join(done["cur"], ".")))).otherwise(done["out"])
