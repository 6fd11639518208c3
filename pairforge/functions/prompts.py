"""Prompts for a language model: budgets, cropping, cache keys and answers, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairforge.functions.text import let, text_or_empty

# The texts of the prompts.
INIT_PROMPT = "You compare two texts, such as vacancies and resumes, and return integers from 0 to 10, where 0 means texts are not similar, and 10 means texts are similar"
QUERY_PROMPT = "Compare the following two texts. Return integer from 0 to 10 and nothing else, where 0 means texts have nothing in common, and 10 means texts are very similar."
LABELS = ("\n[[Text 1]]: ", "\n[[Text 2]]: ", "\n[[Similarity from 0 to 10]]:")
#: Stands in for a tokenizer: runs of up to four letters, up to three digits, single signs.
TOKEN_PATTERN = r"(\p{L}{1,4}|\p{N}{1,3}|[^\s\p{L}\p{N}])"


def count_tokens(c: Column) -> Column:
    """An estimate of a text's tokens."""
    return F.size(F.regexp_extract_all(text_or_empty(c), F.lit(TOKEN_PATTERN), 1))


def limit_pair(a: Column, b: Column, limit: Column) -> tuple[Column, Column]:
    """Two sizes cut down to a limit together. With a < b all cuts fall on the second, even below zero;
    otherwise the first is cut until it is one below the second, then both in turn, the second first."""
    over = F.greatest(F.lit(0), a + b - limit)
    lead = a - b + 1
    rest = over - lead
    first = F.when(a < b, a).when(over <= lead, a - over).otherwise(a - lead - F.floor(rest / F.lit(2)))
    second = F.when(a < b, b - over).when(over <= lead, b).otherwise(b - F.ceil(rest / F.lit(2)))
    return first.cast("int"), second.cast("int")


def crop_by_tokens(text: Column, budget: Column, count=count_tokens) -> Column:
    """The longest run of whole words from the start whose tokens fit the budget, joined by spaces."""
    words = F.filter(F.split(text_or_empty(text), r"\s+"), lambda w: w != "")
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"))

    def kept(x: Column) -> Column:
        def step(a: Column, size: Column) -> Column:
            # once a word does not fit, the budget counts as used up
            fits = a["used"] + size <= x["budget"]
            return F.struct(F.when(fits, a["used"] + size).otherwise(x["budget"] + 1).alias("used"), F.when(fits, a["n"] + 1).otherwise(a["n"]).alias("n"))

        n = F.aggregate(F.transform(x["words"], count), start, step)["n"]
        return F.array_join(F.slice(x["words"], F.lit(1), n), " ")

    return let(F.struct(words.alias("words"), budget.cast("int").alias("budget")), kept)


def make_prompt(text_1: Column, text_2: Column, max_tokens: int | Column = 3800, count=count_tokens) -> Column:
    """The question with both texts, cropped if they exceed the budget together."""
    seed = F.lit(QUERY_PROMPT + "".join(LABELS))
    budget = (F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens) - (count(seed) + 4)
    one, two = text_or_empty(text_1), text_or_empty(text_2)

    def built(x: Column) -> Column:
        c1, c2 = limit_pair(x["n1"], x["n2"], x["budget"])
        cropped = lambda t, n, c: F.when((x["n1"] + x["n2"] > x["budget"]) & (c < x[n]), crop_by_tokens(x[t], c, count)).otherwise(x[t])
        return F.concat(F.lit(QUERY_PROMPT + LABELS[0]), cropped("t1", "n1", c1), F.lit(LABELS[1]), cropped("t2", "n2", c2), F.lit(LABELS[2]))

    parts = F.struct(one.alias("t1"), two.alias("t2"), count(one).alias("n1"), count(two).alias("n2"), budget.cast("int").alias("budget"))
    return let(parts, built)


def parse_score(answer: Column) -> Column:
    """The answer as an integer, else its first run of digits; null if it has none."""
    return F.coalesce(answer.try_cast("int"), F.nullif(F.regexp_extract(answer, "([0-9]+)", 1), F.lit("")).try_cast("int"))


def cache_key(*parts: Column) -> Column:
    """A key of this engine for what was asked: the joined parts' digest."""
    return F.md5(F.concat_ws("---", *[p.cast("string") for p in parts]))


def messages(prompt: Column, shots: list[tuple[str, str]] = ()) -> Column:
    """The chat: system prompt, examples, question."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    rows = [say("system", F.lit(INIT_PROMPT))]
    for question, result in shots:
        rows += [say("user", F.lit(question)), say("assistant", F.lit(result))]
    return F.array(*rows, say("user", prompt))
