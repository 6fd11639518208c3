"""The Snowball stemmer for Russian, as published, in column expressions and for single words.

Each step cuts an ending at the end of a region of the word: RV is what follows the first vowel, R2 what follows the second
sequence of a vowel and a consonant. Of several endings the longest is cut. Words without a Russian vowel stay as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairforge.functions.text import let

# Vowels and endings of the published algorithm. Endings of a first group are cut only after а or я.
VOWELS = "аеиоуыэюя"
GERUND = (("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись"))
ADJECTIVE = ("ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
REFLEXIVE = ("ся", "сь")
VERB = (
    ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно"),
    ("ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю"),
)
NOUN = ("а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я")


def _either(endings: tuple[str, ...]) -> str:
    return "(?:" + "|".join(sorted(endings, key=lambda e: (-len(e), e))) + ")"


def _groups(two: tuple[tuple[str, ...], tuple[str, ...]], after: str = "") -> str:
    """A pattern whose first group is the а or я to be kept."""
    return f"(?:([ая]){_either(two[0])}|{_either(two[1])}){after}"


# Patterns at the end of RV, all with what stays in group 1. No engine's own features: the same in Java, RE2 and Python.
P_GERUND = _groups(GERUND) + "$"
P_REFLEXIVE = f"(){_either(REFLEXIVE)}$"
P_ADJECTIVAL = f"(?:{_groups(PARTICIPLE)})?{_either(ADJECTIVE)}$"
P_VERB = _groups(VERB) + "$"
P_NOUN = f"(){_either(NOUN)}$"
P_REGIONS = f"^([^{VOWELS}]*[{VOWELS}])(.*)$"
P_DERIVED = f"^([^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]+[{VOWELS}]+[^{VOWELS}].*?)ость?$"


def _cut(s: Column, pattern: str) -> Column:
    return F.regexp_replace(s, pattern, "$1")


def _first_change(s: Column, *steps: Column) -> Column:
    """The first of the steps that changes the text, else the text."""
    return F.coalesce(*[F.nullif(x, s) for x in steps], s)


def stem(token: Column) -> Column:
    """The stem of one word, lower-cased, ё as е."""

    def endings(rv: Column) -> Column:
        def others(r: Column) -> Column:
            return _first_change(r, _cut(r, P_ADJECTIVAL), _cut(r, P_VERB), _cut(r, P_NOUN))

        return F.regexp_replace(let(rv, lambda s: F.coalesce(F.nullif(_cut(s, P_GERUND), s), let(_cut(s, P_REFLEXIVE), others))), "и$", "")

    def tidy(rv: Column) -> Column:
        return let(rv, lambda s: _first_change(s, F.regexp_replace(F.regexp_replace(s, "ейше?$", ""), "нн$", "н"), F.regexp_replace(s, "ь$", "")))

    def whole(low: Column) -> Column:
        head = F.regexp_extract(low, P_REGIONS, 1)
        rest = let(F.regexp_extract(low, P_REGIONS, 2), endings)
        cut = F.regexp_replace(F.concat(head, rest), P_DERIVED, "$1")
        return F.when(low.rlike(f"[{VOWELS}]"), F.concat(head, tidy(F.substr(cut, F.length(head) + 1)))).otherwise(low)

    return let(F.translate(F.lower(token), "ё", "е"), whole)


def stem_tokens(tokens: Column) -> Column:
    return F.transform(tokens, stem)


def _py(pattern: str):
    compiled = re.compile(pattern)
    return lambda s: compiled.sub(lambda m: m.group(1) or "", s, count=1)


_GERUND, _REFLEXIVE, _ADJECTIVAL, _VERB, _NOUN, _DERIVED = map(_py, (P_GERUND, P_REFLEXIVE, P_ADJECTIVAL, P_VERB, P_NOUN, P_DERIVED))
_REGIONS = re.compile(P_REGIONS, re.DOTALL)


def stem_of(word: str) -> str:
    """:func:`stem` for one word, where Python works on words anyway."""
    low = word.lower().replace("ё", "е")
    m = _REGIONS.match(low)
    if not m:
        return low
    head, rv = m.groups()
    done = _GERUND(rv)
    if done == rv:
        rest = _REFLEXIVE(rv)
        done = next((x for x in (_ADJECTIVAL(rest), _VERB(rest), _NOUN(rest)) if x != rest), rest)
    done = _DERIVED(head + done.removesuffix("и"))[len(head) :]
    tidied = re.sub("нн$", "н", re.sub("ейше?$", "", done))
    return head + (tidied if tidied != done else done.removesuffix("ь"))


def stem_sql(token: str) -> str:
    """The same as an expression of SQL (RE2 patterns)."""
    low = f"replace(lower({token}), 'ё', 'е')"
    change = lambda s, *steps: "coalesce(" + ", ".join(f"nullif({x}, {s})" for x in steps) + f", {s})"
    cut = lambda s, p: f"regexp_replace({s}, '{p}', '\\1')"
    rv = f"regexp_extract(w, '{P_REGIONS}', 2)"
    rest = cut(rv, P_REFLEXIVE)
    step_1 = f"coalesce(nullif({cut(rv, P_GERUND)}, {rv}), {change(rest, cut(rest, P_ADJECTIVAL), cut(rest, P_VERB), cut(rest, P_NOUN))})"
    head = f"regexp_extract(w, '{P_REGIONS}', 1)"
    derived = cut(f"{head} || regexp_replace({step_1}, 'и$', '')", P_DERIVED)
    tail = f"substr({derived}, length({head}) + 1)"
    tidied = change("t", "regexp_replace(regexp_replace(t, 'ейше?$', ''), 'нн$', 'н')", "regexp_replace(t, 'ь$', '')")
    stemmed = f"{head} || list_transform([{tail}], lambda t: {tidied})[1]"
    return f"list_transform([{low}], lambda w: CASE WHEN regexp_matches(w, '[{VOWELS}]') THEN {stemmed} ELSE w END)[1]"
