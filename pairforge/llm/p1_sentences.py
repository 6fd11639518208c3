"""Sentence units of texts in many scripts, by document-centred disambiguation.

Whether a stop ends a sentence depends on the word before it (an abbreviation?) and on the word
after it (a name, or a word that begins sentences?). Both are learned from places where there is
no doubt: a word with a stop before a small letter is an abbreviation, a stop before a closing
quotation mark or the end of a text ends a sentence, a capital after a question mark begins one,
a capital amid a sentence is a name. Evidence of the text itself decides; only where it has none
do the counts of the whole corpus, and those of every word, however rare. Usual words (above
``HEAVY_SHARE`` of the observations, hence a bounded number) are sent to all tasks; the counts of all
others are joined to the texts that ask for them, so that evidence does not depend on the corpus's size.

Scripts have rules of their own: full stops of Chinese, Japanese, Hindi and Arabic need no white
space, Thai parts sentences by spaces between Thai letters. Quotations and brackets hold their
stops; headings, list items and blank lines end what is before them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.common import arrow_map, text_sides
from pairforge.session import table
from pairforge.storage import materialize

#: Words with at least this share of the observations of a kind are broadcast (at most 1 / HEAVY_SHARE words
#: for each of the seven kinds); the counts of all others travel by a join. The share decides the way, not the result.
HEAVY_SHARE = 5e-5

# Terminators of any script, those that need no white space after them, marks that open and close.
HARD_STOPS = "。！？｡।॥؟۔"
STOPS = ".!?…" + HARD_STOPS
OPENING = {"«": "»", "(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "“": "”", "„": "“", "‚": "‘"}
CLOSING = set(OPENING.values()) | {'"', "’"}
LIST_MARK = regex.compile(r"[^\S\n]*(?:[•*‣▪●◦·–\-]|\d{1,3}[.)]|\p{L}\))[^\S\n]+")

_STOP = regex.compile(rf"[{STOPS}]+|\n|(?<=\p{{Thai}})[^\S\n]+(?=\p{{Thai}})")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}'’\-]+")
_BEFORE = regex.compile(r"(?<![\p{L}\p{M}\p{N}])(?:(?:(?:\p{L}\p{M}*){1,2}\.[ \xa0\-]{0,2}){1,3}\p{L}\p{M}*(?:\p{L}\p{M}*)?|\p{L}[\p{L}\p{M}]{0,5})$")
_OPENERS = r"[«„“‚\"'(\[¿¡「『]*"
_SMALL_START = regex.compile(r"\p{Ll}+(?:\p{Lu}|-\p{L})")
_SHORT = regex.compile(r"(?<![\p{L}\p{M}\p{N}.\-])\p{L}[\p{L}\p{M}]{0,4}(?![\p{L}\p{M}\p{N}.])")
_TOKEN = r"((?:\p{Lu}|\p{Lo}|\p{Ll}+\p{Lu}|\p{Ll}+-\p{L})[\p{L}\p{M}\p{N}'’\-]{0,23})"
_BEGINS = regex.compile(rf"(?:\A|\n\s*\n|[?!…{HARD_STOPS}][»”“\"')\]]*\s+|(?<=\p{{Ll}}{{6}})\.\s+)\s*{_OPENERS}{_TOKEN}")
_AMID = regex.compile(rf"(?<=[\p{{Ll}}\p{{Lo}}\p{{M}}\p{{N}},;] ){_TOKEN}")
_LINE = regex.compile(r"(?:\A|(?<=\n))[^\S\n]*(\p{L}[^\n.!?…,;。]{1,38}[^\s.!?…,;:。\-–—]):?[^\S\n]*(?=\n|\Z)")
_DOT = regex.compile(r"\.(?![.!?])")
_CASELESS = regex.compile(r"(?=\p{Lo}|\p{M})[\p{Devanagari}\p{Arabic}]")
_LEFT = regex.compile(r"[\p{L}\p{M}\p{N}+#)%]+$")
#: What stands between a stop and the next word: white space and marks that open; marks that close too.
_NEXT = regex.compile(r"\s*[\s«„“‚\"'(\[¿¡「『（【《#@№§]*")
_NEXT_CLOSED = regex.compile(rf"[\s{STOPS}»)\]}}」』）】》”“‘\"’'«„‚(\[¿¡「『（【《#@№§]*")
_MARKS = regex.compile(r"[«»()\[\]「」『』（）【】《》“”„\"]|\n[^\S\n]*\n|\n(?=[^\S\n]*(?:[•*‣▪●◦·–\-]|\d{1,3}[.)]|\p{L}\))[^\S\n])")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")

#: Kinds of observations: a word with a stop before a small letter, before anything else that may begin a sentence, at a certain end; a short word without a stop; a word that begins a sentence, one amid it; a short line without a stop.
KINDS = SMALL, OPEN, FINAL, BARE, BEGINS, AMID, LINE = tuple(range(7))


def _key(found: str) -> str:
    """A word before a stop, its parts joined; a capitalised word after an abbreviation stands alone."""
    found = found.replace(" ", "").replace("\xa0", "")
    head, _, last = found.rpartition(".")
    return last if head.islower() and last[:1].isupper() else found


def observe(text: str) -> dict[int, Counter]:
    """Counts of the observations that a text gives, by kind and word."""
    out = {k: Counter() for k in KINDS}
    n = len(text)
    for m in _DOT.finditer(text):
        i = m.start()
        if i and text[i - 1] == ".":
            continue
        w = _BEFORE.search(text[max(0, i - 24) : i])
        if not w:
            continue
        key, j = _key(w.group()), i + 1
        while j < n and text[j].isspace():
            j += 1
        if j >= n or text[j] in "»”“\"」)":
            out[FINAL][key] += 1
        elif j == i + 1:
            if text[j] in ",;:":
                out[SMALL][key] += 1
        elif text[j].islower():
            if not _SMALL_START.match(text, j):
                out[SMALL][key] += 1
        elif "\n" in text[i + 1 : j] and ("\n\n" in text[i + 1 : j] or LIST_MARK.match(text, j)):
            out[FINAL][key] += 1
        else:
            out[OPEN][key] += 1
    out[BARE].update(_SHORT.findall(text))
    out[BEGINS].update(_BEGINS.findall(text))
    out[AMID].update(_AMID.findall(text))
    if "\n" in text:
        out[LINE].update(_LINE.findall(text))
    return out


def _forms(word: str) -> tuple[str, ...]:
    """A word as it stands; words in capitals, of headings and the like, as they are usually written too."""
    return (word, word.lower(), word.capitalize()) if len(word) > 1 and word.isupper() else (word,)


def _strip_line(line: str) -> str:
    return line.strip().removesuffix(":").rstrip()


def asks(text: str) -> set[str]:
    """Every word and line whose corpus counts :class:`Splitter` may look up for a text."""
    out: set[str] = set()
    n = len(text)
    for m in _STOP.finditer(text):
        i, q = m.span()
        for skipped in (_NEXT, _NEXT_CLOSED):
            w = _WORD.match(text, skipped.match(text, q).end())
            if w:
                out.update(_forms(w.group()[:24]))
        if text[i] == ".":
            before = text[max(0, i - 30) : i]
            for w in (_BEFORE.search(before[-24:]), _LEFT.search(before)):
                if w:
                    out.update(_forms(w.group()))
                    out.update(_forms(_key(w.group())))
    if "\n" in text:
        for line in map(_strip_line, text.split("\n")):
            if 0 < len(line) <= 40:
                out.add(line)
                if w := _WORD.match(line):
                    out.add(w.group()[:24])
    return out


_WIDE = tuple(f"n{k}" for k in KINDS)


def corpus_evidence(texts: DataFrame, keys: list[str], text: str = "text", heavy_share: float = HEAVY_SHARE) -> tuple[dict[int, dict[str, int]], DataFrame]:
    """``(usual, rare)``: counts of the usual words by kind, and a table with the ``keys`` of each text and ``light``,
    the counts of the rare words it asks for (``word``, ``n0`` to ``n6`` by kind).

    The texts are read once: pre-aggregated counts and the words asked for come out of the same pass
    and are written. Usual words, at most seven times ``1 / heavy_share``, are collected; all others are joined, and
    none of those can be hot, because it stands for less than that share of the observations.
    """
    kinds = {k: texts.schema[k].dataType.simpleString() for k in keys}

    def make():
        total = {k: Counter() for k in KINDS}
        empty = {k: None for k in keys}

        def flush():
            rows = [(k, w, n) for k, c in total.items() for w, n in c.items()]
            for c in total.values():
                c.clear()
            return {k: [None] * len(rows) for k in empty} | {"_kind": [r[0] for r in rows], "_word": [r[1] for r in rows], "_n": [r[2] for r in rows], "_asks": [None] * len(rows)}

        def step(cols):
            asked = []
            for t in cols["_text"]:
                for k, c in observe(t).items():
                    total[k].update(c)
                asked.append(list(asks(t)))
            none = [None] * len(asked)
            yield {k: cols[k] for k in keys} | {"_kind": none, "_word": none, "_n": none, "_asks": asked}
            if sum(map(len, total.values())) > 300_000:
                yield flush()

        def close():
            yield flush()

        step.close = close
        return step

    named = ", ".join(f"`{k}` {v}" for k, v in kinds.items())
    rows = arrow_map(texts.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text")), make, f"{named}, _kind int, _word string, _n bigint, _asks array<string>")
    rows = materialize(rows, "observed")
    counted = [F.sum(F.when(F.col("_kind") == k, F.col("_n")).otherwise(0)).alias(n) for k, n in zip(KINDS, _WIDE)]
    counts = materialize(rows.where("_word is not null").groupBy(F.col("_word").alias("word")).agg(*counted), "evidence")
    totals = counts.agg(*(F.sum(n).alias(n) for n in _WIDE)).first()
    heavy = F.lit(False)
    for n in _WIDE:
        heavy = heavy | (F.col(n) >= max(1.0, (totals[n] or 0) * heavy_share))
    usual: dict[int, dict[str, int]] = {k: {} for k in KINDS}
    for r in counts.where(heavy).toLocalIterator():
        for k, n in zip(KINDS, _WIDE):
            if r[n]:
                usual[k][r["word"]] = r[n]
    known = counts.where(heavy).select("word")
    asked = rows.where("_asks is not null").select(*keys, F.explode("_asks").alias("word")).join(F.broadcast(known), "word", "left_anti")
    light = asked.join(counts.where(~heavy), "word").groupBy(*keys).agg(F.collect_list(F.struct("word", *_WIDE)).alias("light"))
    return usual, light


class Splitter:
    """Cuts texts into sentence units with the evidence of the corpus."""

    def __init__(self, corpus: dict[int, dict[str, int]] | None = None):
        self.corpus = {k: {} for k in KINDS} | (corpus or {})
        self.rare: dict[str, tuple[int, ...]] = {}

    # ---- what is known of a word

    def _everywhere(self, kind: int, word: str) -> int:
        """A word's count in the corpus."""
        counts = self.rare.get(word)
        return counts[kind] if counts else self.corpus[kind].get(word, 0)

    def begins(self, own, word: str) -> int:
        """1: the word begins sentences, -1: it stands amid them, 0: unknown. The text itself decides if its evidence is of one kind."""
        word = word[:24]
        if len(word) > 1 and word.isupper():
            usual = word.capitalize()
            b, a = own[BEGINS][usual], own[AMID][usual]
            if not (b or a):
                b, a = self._everywhere(BEGINS, usual), self._everywhere(AMID, usual)
            if b or a:
                return (b > a) - (b < a)
            # places in texts in capitals do not show that it begins sentences; acronyms show that they stand amid
            return -(self._everywhere(AMID, word) > self._everywhere(BEGINS, word))
        b, a = own[BEGINS][word], own[AMID][word]
        begins, amid = self._everywhere(BEGINS, word), self._everywhere(AMID, word)
        if bool(b) == bool(a):
            b, a = begins, amid
        elif b and amid > 4 * begins:
            b, a = 0, 1
        elif a and begins > 4 * amid:
            b, a = 1, 0
        return (b > a) - (b < a)

    def abbreviation(self, own, word: str) -> tuple[bool, bool]:
        """Whether a word before a stop is an abbreviation, and whether it may end a sentence too.

        The text decides where it holds an unambiguous occurrence: the word with a stop before a small letter is
        an abbreviation; one that stands without a stop and ends a sentence for certain is a plain word. The corpus
        is asked only if the text has neither."""
        here = [own[k][word] for k in (SMALL, OPEN, FINAL, BARE)]
        all_ = [sum(self._everywhere(k, form) for form in _forms(word)) for k in (SMALL, OPEN, FINAL, BARE)]
        small, open_, final, bare = here
        if small >= max(1, 0.1 * (small + open_ + final)):
            return True, bool(final) or all_[2] > 0.004 * sum(all_[:3])
        if final and bare:
            return False, True
        small, open_, final, bare = map(max, all_, here) if any(all_) else here
        dots = small + open_ + final
        if not dots:
            return False, True
        letters = sum(ch.isalpha() for ch in word)
        may_end = final > 0.004 * dots
        if small >= 0.1 * dots:
            return True, may_end
        inner = "." in word
        never_bare = bare <= 0.05 * dots and (open_ >= 5 or inner or word[:1].isupper() and not (len(word) > 2 and word.isupper()))
        if (letters <= 4 or inner or word[:1].isupper() and letters <= 5) and final <= 0.004 * dots and (never_bare or dots >= 100 and word[:1].isupper()):
            return True, may_end
        return inner and letters <= 6, may_end

    # ---- structure

    @staticmethod
    def quotations(text: str) -> list[tuple[int, int]]:
        """Outermost spans between matching marks, both included, of any length. The structure tells marks without
        a partner: no quotation crosses the end of a paragraph or the start of a list item, a straight mark after a letter
        or digit opens none, and a mark that closes an outer quotation ends those inside it."""
        stack: list[tuple[str, int]] = []
        pairs = []
        for m in _MARKS.finditer(text):
            ch, i = m.group(), m.start()
            if ch[0] == "\n":
                stack.clear()
                continue
            close = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == ch), None)
            if ch == "“" and close is None or ch != "“" and ch in OPENING:
                stack.append((OPENING[ch], i))
            elif close is not None:
                pairs.append((stack[close][1], i))
                del stack[close:]
            elif ch == '"' and not (i and text[i - 1].isalnum()):
                stack.append(('"', i))
            elif ch == "”" and stack and stack[-1][0] == "“":
                pairs.append((stack.pop()[1], i))
        pairs.sort()
        out: list[tuple[int, int]] = []
        for a, b in pairs:
            if not out or a > out[-1][1]:
                out.append((a, b))
        return out

    def split(self, text: str, rare: list[dict] | None = None) -> list[tuple[int, int]]:
        """Spans of the sentence units of a text, without surrounding white space; none for a blank text.
        ``rare``: corpus counts of the rare words that the text asks for."""
        n, own = len(text), observe(text)
        self.rare = {r["word"]: tuple(r[k] for k in _WIDE) for r in rare or ()}
        spans = self.quotations(text)
        opens = [a for a, _ in spans]

        def inside(p: int) -> int:
            """The end of the quotation that holds place p, or 0."""
            k = bisect_right(opens, p) - 1
            return spans[k][1] if k >= 0 and spans[k][0] < p < spans[k][1] else 0

        ends: list[int] = []
        line = next((i for i, ch in enumerate(text) if not ch.isspace()), n)
        unit, skip = line, 0
        mark = LIST_MARK.match(text, line)
        item = bool(mark)
        if mark:
            skip = mark.end()

        def end_at(p: int, q: int) -> None:
            nonlocal unit, item
            ends.append(p)
            unit, item = q, False

        for m in _STOP.finditer(text):
            i, j = m.span()
            if i < skip:
                continue
            if text[i] == "\n" or text[i].isspace() and text[i] not in STOPS:
                q = j
                while q < n and text[q].isspace():
                    q += 1
                if q >= n:
                    break
                if text[i] != "\n":  # a space between Thai letters
                    if unit < i and not inside(i):
                        end_at(i, q)
                    skip = q
                    continue
                mark = LIST_MARK.match(text, q)
                if unit < q and (mark or text.find("\n", j, q) >= 0 or not inside(i) and self._line_ends(text, own, unit, line, i, q, item)):
                    end_at(i, q)
                line, skip = q, q
                if mark:
                    item, skip = True, mark.end()
                continue
            # a run of stops, with the marks that close after it
            closed = False
            holder = inside(i)
            while j < n:
                if text[j] in STOPS:
                    j += 1
                elif text[j] in CLOSING and (holder == j or text[j] in "”’" and not inside(j)):
                    j += 1
                    closed, holder = True, 0
                elif text[j] in " \xa0\u202f" and holder and text[j:holder].isspace() and holder - j <= 2:
                    j = holder + 1
                    closed, holder = True, 0
                else:
                    break
            if holder:
                continue
            skip = j
            q = j
            while q < n and text[q].isspace():
                q += 1
            if q >= n:
                break
            mark = LIST_MARK.match(text, q) if "\n" in text[j:q] else None
            broken = text.count("\n", j, q)
            if mark or broken > 1 or self._ends(text, own, i, j, q, closed) or broken and self._is_heading(own, self._line(text, q)):
                end_at(j, q)
            if "\n" in text[j:q]:
                line, skip = q, q
            if mark:
                item, skip = True, mark.end()
        ends.append(n)
        out, start = [], 0
        for e in ends:
            a, b = start, e
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
            start = e
        return out

    # ---- decisions

    def _next(self, text: str, q: int) -> tuple[str, str]:
        """The first letter or digit after marks that open, and its word."""
        while q < len(text) and (text[q] in "«„“‚\"'([¿¡「『（【《#@№§" or text[q] in "   " and text[q - 1] == "«"):
            q += 1
        w = _WORD.match(text, q)
        return (text[q] if q < len(text) else "", w.group() if w else "")

    def _ends(self, text: str, own, i: int, j: int, q: int, closed: bool) -> bool:
        """Whether a run of stops from i, with what closes up to j, ends a unit before q."""
        run = text[i:j]
        first, word = self._next(text, q)
        letter_case = "small" if first.islower() else "capital" if first.isupper() else "none" if first.isalpha() else "digit" if first.isdigit() else ""
        spaced = q > j
        if any(ch in HARD_STOPS for ch in run):
            return spaced and letter_case != "small" or not closed and bool(letter_case)
        if not spaced:
            if closed or letter_case not in ("capital", "none"):
                return False
            if run != ".":
                return True
            return self._glued(text, own, i, word)
        if letter_case == "small":
            known = _SMALL_START.match(word) and (self.begins(own, word) > 0 or not _SMALL_START.match(word).group().count("-"))
            if not known:
                return False
        elif not letter_case:
            return "\n" in text[j:q] or regex.match(r"\p{So}|[<`$]", text[q]) is not None
        if (closed or "…" in run or ".." in run) and word.isupper() and regex.search(r"\p{Lu}{2}\W*$", text[max(0, i - 12) : i]):
            # all in capitals, so the case of the next word tells nothing
            return len(word) > 1 and self.begins(own, word) > 0
        if text[i] != "." or text[i + 1 : i + 2] in (".", "!", "?", "…") or "!" in run or "?" in run:
            return True
        if not i:
            return False
        before = text[i - 1]
        if before.isdigit():
            number = regex.search(r"(?<![\d.,\p{L}])\d{1,2}$", text[max(0, i - 4) : i])
            if number and letter_case == "capital" and int(number.group()) <= 31:
                return self.begins(own, word) > 0
            return True
        w = _BEFORE.search(text[max(0, i - 24) : i])
        if not w:
            return True
        key = _key(w.group())
        if len(key) == 1 and (key.isupper() or not key.islower()) and not closed:
            return False  # an initial
        is_abbreviation, may_end = self.abbreviation(own, key)
        if not is_abbreviation:
            if closed or not (key.replace(".", "").isupper() and "." in key):
                return True
        if not may_end and not closed:
            return False
        if letter_case == "capital":
            known = self.begins(own, word)
            return known > 0 or "\n" in text[j:q] and (known == 0 or len(word) == 1)
        return True

    def _glued(self, text: str, own, i: int, word: str) -> bool:
        """Whether a stop without white space parts two sentences, not the parts of a name or file."""
        if len(word) < 2 or not any(ch.islower() for ch in word) and not _UNSPACED.match(word):
            return False
        left = _LEFT.search(text[max(0, i - 30) : i])
        if not left:
            return False
        known = self.begins(own, word)
        if regex.search(r"\p{Ll}{3}$", left.group()):
            is_abbreviation, may_end = self.abbreviation(own, left.group())
            return known > 0 or known == 0 and not is_abbreviation and not left.group()[0].isupper()
        return known > 0

    def _line_ends(self, text: str, own, unit: int, line: int, i: int, q: int, item: bool) -> bool:
        """Whether a line break without a stop before it, at i, ends a unit."""
        before = text[line:i].rstrip()
        if before and before[-1] in STOPS:
            return False  # decided with the stop
        first, word = self._next(text, q)
        if self._is_heading(own, before) and (not first.islower() or _SMALL_START.match(word)):
            return True
        if self._is_heading(own, self._line(text, q)):
            return True
        heading = unit == line and len(before) <= 60 and before.count(" ") <= 6 and not item
        if first.islower():
            return bool(_SMALL_START.match(word)) and (item or heading and not before[:1].islower())
        if _UNSPACED.match(first or " ") or _UNSPACED.match(before[-1:] or " ") or len(word) > 40:
            return True
        if _CASELESS.match(before[-1:] or " ") and self._unstopped_lines(text):
            return True
        known = 0 if len(word) == 1 else self.begins(own, word)
        if heading and before.endswith(":") or item and before.endswith(";"):
            return True
        if text[q] in "«„“\"(¿¡" and (heading or item):
            return True
        if len(before) > 6 and before.isupper() and word.isupper():
            return False  # a line broken within a sentence in capitals
        if heading and not before[:1].islower():
            return known > 0 or known == 0 and not first.isdigit() and before[-1:] not in ",;—–-" and self._heading(own, before)
        if item:
            return known >= 0 and before[-1:] not in ",—–"
        return known > 0 and before[-1:] not in ",;:—–-("

    @staticmethod
    def _line(text: str, q: int) -> str:
        end = text.find("\n", q)
        return text[q : end if end >= 0 else len(text)].strip()

    def _is_heading(self, own, line: str) -> bool:
        """Whether a line recurs in the corpus as a line of its own, more than as the start of sentences."""
        line = line.removesuffix(":").rstrip()
        n = self._everywhere(LINE, line) if len(line) <= 40 else 0
        return n >= 3 and n >= 0.1 * self._everywhere(BEGINS, _WORD.match(line).group()[:24] if _WORD.match(line) else "")

    @staticmethod
    def _unstopped_lines(text: str) -> bool:
        """Whether most lines of the text end without a stop, so that a line is a unit."""
        lines = [x.rstrip() for x in text.split("\n") if x.strip()]
        return len(lines) > 2 and sum(x[-1] not in STOPS for x in lines[:-1]) * 2 > len(lines) - 1

    def _heading(self, own, line: str) -> bool:
        """A short line whose last word would not stand before a name."""
        last = line.split()[-1] if line.split() else ""
        return len(last) > 3


def sentences(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The ``keys``, ``start_off``, ``end_off`` and ``sentence`` of every unit; the corpus is these very texts.

    Null, empty and blank texts have no unit; repeated rows are split each; columns that are
    neither key nor text are left out. Null keys match nothing in the join of rare words, so those texts go by
    their own evidence and the usual words alone.
    """
    usual, light = corpus_evidence(texts, keys, text)
    kinds = {k: texts.schema[k].dataType.simpleString() for k in keys}
    shared = texts.sparkSession.sparkContext.broadcast(usual)

    def make():
        split = Splitter(shared.value).split

        def step(cols):
            out: dict[str, list] = {k: [] for k in (*keys, "start_off", "end_off", "sentence")}
            for r, (t, rare) in enumerate(zip(cols["_text"], cols["_light"])):
                for a, b in split(t, rare):
                    for k in keys:
                        out[k].append(cols[k][r])
                    out["start_off"].append(a)
                    out["end_off"].append(b)
                    out["sentence"].append(t[a:b])
            yield out

        return step

    rows = texts.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text")).join(light.withColumnRenamed("light", "_light"), keys, "left")
    return arrow_map(rows, make, ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", start_off int, end_off int, sentence string")


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(materialize(text_sides(table(spark, sf_dir, "datum")).where("text is not null"), "texts"), ["side", "text_id"])


def p1_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select("side", "text_id", "start_off", "end_off")


QUERIES = {"p1_found": p1_found, "p1_sentences": p1_sentences}
SQL: dict[str, str] = {}
