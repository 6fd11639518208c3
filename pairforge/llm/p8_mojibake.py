"""Texts garbled by a wrong decoding: found by an automaton of garbled sequences, restored span by span.

For every pair of encodings (the one the bytes were written in, the one they were read with) the
whole repertoire is garbled in advance: every character of UTF-8's leads and of the East Asian encodings,
letters and letter pairs of the alphabets with one byte a letter; the sequences that come out
and do not occur in correct text are the patterns of one automaton. A hit only proposes a pair for
the word it stands in: the word is read back, and the span is replaced if what comes out is
plausible and what stood there is not. Words without a hit stay untouched, so correct text
beside garbled text is kept. Texts garbled twice are read back twice. Replacement characters tell
of bytes that are lost; such texts are reported though nothing can be restored there.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from difflib import SequenceMatcher
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.common import arrow_map
from pairforge.session import table
from pairforge.storage import materialize

#: Least share of a word among the Russian words of the corpus, and of a run of letters among all runs in them.
WORD_SHARE = 2e-5
PART_SHARE = 2e-4
#: Runs without spaces above this length are judged by the part that a reading changes.
LONG_RUN = 24

# Encodings by what they hold.
UTF8_READ_AS = ("cp1252", "latin-1", "cp1251", "cp1250", "iso8859-2", "cp437", "cp850", "cp866", "koi8-r", "mac-roman", "mac-cyrillic", "iso8859-5", "cp1253", "cp1254", "cp1257", "iso8859-15")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic")
CYRILLIC_READ_AS = ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic", "mac-roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1257", "cp1254")
EAST_ASIAN = ("gb18030", "shift_jis", "euc-jp", "big5", "euc-kr")
EAST_ASIAN_READ_AS = ("cp1252", "latin-1", "cp1251", "mac-roman", "cp437", "cp850", "koi8-r", "cp866")
WESTERN = (("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac-roman"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp1252", "cp1253"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("mac-roman", "cp1252"))
OTHER_ALPHABETS = {"cp1253": "gr", "iso8859-7": "gr", "cp1255": "he", "iso8859-8": "he", "cp1256": "ar", "iso8859-6": "ar", "cp874": "th"}
OTHER_READ_AS = ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "mac-roman", "cp437", "cp850")
ALPHABETS = {"gr": "αβγδεζηθικλμνξοπρςστυφχψωάέήίόύώ", "he": "".join(map(chr, range(0x5D0, 0x5EB))), "ar": "".join(map(chr, (*range(0x621, 0x63B), *range(0x641, 0x64B)))), "th": "".join(map(chr, (*range(0xE01, 0xE3B), *range(0xE40, 0xE4F))))}
CENTRAL = tuple((real, wrong) for real in ("cp1250", "iso8859-2", "cp1254", "cp1257") for wrong in ("cp1252", "latin-1", "cp1251", "koi8-r", "mac-roman") if real != wrong)
UTF8_READ_AS_WIDE = ("gb18030", "big5", "shift_jis", "euc-kr")

# Common words, whose letter pairs tell Russian from garbled text.
RUSSIAN_WORDS = """и в не на что он с как это по но они мы из у за вы так же от сказать этот который мочь человек один ещё бы такой только себя своё какой когда уже для вот говорить год знать или если время рука
самый стать большой даже другой наш под где дело есть раз чтобы чем глаз жизнь день потом очень хотеть при голова надо без видеть идти теперь тоже друг дом сейчас можно после слово здесь думать
место спросить через лицо хороший каждый новый должный почему сторона просто иметь сделать дверь перед нужный понимать работа машина случай между вопрос ответить значить студент преподаватель проект
система обработка требования образование компания разработка документ обучение навыки опыт проверка управление знание отчётность службе торговли прогноза показателей хранения дисциплина цели условия
ключевые результаты курс версия установлена рядом заявок методика оценки объём неделю средняя балла помогло избежать простоев улучшил рассылка руководитель научный тема площадь щётка съезд цифровой
котельной личный кабинет аналитик инженер файл настроек экономика информация необходимо предприятие возможность общество юрист эффект жюри ящик шаг чистый художник физика может жить весь ходить люди ребёнок город сильный площадка вещь объект любой съёмка выход южный ещё обычно чужой ключ узел""".split()
VOWELS, CONSONANTS = "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ"
COMMON_HAN = "的了一是不在有人我们为这中大学和使用时间项目平均成绩课程小组团队系统需要能力经验老师说部门设计开发测试优化公司点名版管理数据研修担当者試験応募必要理索引"
KANA_AND_MARKS = "".join(map(chr, [*range(0x3041, 0x3094), *range(0x30A1, 0x30F7)])) + "ー、。，！？「」“”：…（）・"
CENTRAL_LETTERS = "ąćęłńśźżčďěňřšťůžőűăşţğıāēģīķļņūųėįľĺŕ"
WESTERN_LETTERS = "àâäçèéêëîïñòóôöùûüúíáãõßøåæìÿÉÈÀÇÑÓÖÜÄÍÚÁ"

#: What :func:`corpus_words` counts: Russian words, and single letters of East Asian scripts.
_COUNTED = regex.compile(r"[а-яё]{3,}|[\p{Han}\p{Hangul}]")
_SPACES = regex.compile(r"[^ \t\r\n]+")
_LOST = "�"
#: Lines and blocks alone are a drawing.
_DRAWING = regex.compile(r"[─-▟|+\-./\\]+")


def garble(text: str, real: str, wrong: str) -> str | None:
    """What becomes of ``text`` if its bytes in ``real`` are read as ``wrong``; undefined bytes become the control characters of that number."""
    try:
        data = text.encode(real)
    except UnicodeEncodeError:
        return None
    return read(data, wrong)


def read(data: bytes, encoding: str) -> str | None:
    if encoding in UTF8_READ_AS_WIDE or encoding in EAST_ASIAN:
        return data.decode(encoding, "replace")
    return "".join(_table(encoding)[b] for b in data)


@lru_cache(maxsize=64)
def _table(encoding: str) -> list[str]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@lru_cache(maxsize=64)
def _bytes_of(encoding: str) -> dict[str, int]:
    table_ = _table(encoding)
    return {chr(b): b for b in range(0x80, 0xA0)} | {ch: b for b, ch in enumerate(table_)}


def write(text: str, encoding: str) -> bytes | None:
    """The bytes that were read as ``text``; None if a character cannot come from that encoding."""
    if encoding in UTF8_READ_AS_WIDE:
        if _LOST not in text:
            try:
                return text.encode(encoding)
            except UnicodeEncodeError:
                return None
        out = bytearray()
        for ch in text:
            if ch == _LOST:
                out += b"\xff"
                continue
            try:
                out += ch.encode(encoding)
            except UnicodeEncodeError:
                return None
        return bytes(out)
    known = _bytes_of(encoding)
    try:
        return bytes([known[ch] if ch != _LOST else 0x3F for ch in text])
    except KeyError:
        return None


# ---- plausibility

_CLASSES: dict[str, str] = {}


def _class(ch: str) -> str:
    """l, u: Latin small, capital; c, C: Russian; g: Greek; h: East Asian; a: other scripts without case; s: space; p: usual punctuation; d: digit; m: mark; x: anything else."""
    found = _CLASSES.get(ch)
    if found is None:
        o = ord(ch)
        if "a" <= ch <= "z" or ch in "ßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ" or 0x100 <= o < 0x180 and ch.islower() or 0x1EA0 <= o < 0x1F00 and ch.islower() or ch in "ươ":
            found = "l"
        elif "A" <= ch <= "Z" or (0xC0 <= o < 0x180 or 0x1EA0 <= o < 0x1F00) and ch.isupper():
            found = "u"
        elif "а" <= ch <= "я" or ch in "ёіїєґ":
            found = "c"
        elif "А" <= ch <= "Я" or ch in "ЁІЇЄҐ":
            found = "C"
        elif ch.isdigit() and o < 128:
            found = "d"
        elif 0x386 <= o < 0x3CF and o != 0x387:
            found = "g"
        elif ch in " \n\t\r":
            found = "s"
        elif o < 128 and ch.isprintable() or ch in "«»—–„“”‘’…№•¿¡\xa0،؛؟।":
            found = "p"
        elif regex.match(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]|[　-〿＀-｠￠-￯]", ch) and not "｡" <= ch <= "ﾟ":
            found = "h"
        elif regex.match(r"(?=[\p{L}\p{M}\p{N}])[\p{Thai}\p{Devanagari}\p{Arabic}\p{Hebrew}]", ch):
            found = "a"
        elif regex.match(r"\p{M}", ch):
            found = "m"
        else:
            found = "x"
        if len(_CLASSES) < 70_000:
            _CLASSES[ch] = found
    return found


#: Neighbours that words do not hold: a capital after a small letter, letters of two alphabets, a letter beside a sign.
_ODD = {"lu", "cC", "lc", "cl", "uc", "cu", "lC", "Cl", "uC", "Cu", "lx", "xl", "cx", "xc", "Cx", "xC", "ux", "xu", "xx", "xh", "hx", "lg", "gl", "cg", "gc", "Cg", "gC", "gu", "ug", "ax", "xa"} | {two for k in "lucCgh" for two in ("a" + k, k + "a")}


def usual_parts(words: dict[str, int], n: int, share: float) -> set[str]:
    """Runs of n letters that make up at least a share of all runs in the counted words."""
    counts: dict[str, int] = defaultdict(int)
    for w, k in words.items():
        for i in range(len(w) - n + 1):
            counts[w[i : i + n]] += k
    least = share * sum(counts.values())
    return {part for part, k in counts.items() if k >= least}


_RUSSIAN_PAIRS = frozenset(usual_parts(dict.fromkeys(RUSSIAN_WORDS, 1), 2, 0))


def oddity(text: str, usual: frozenset[str] = _RUSSIAN_PAIRS) -> float:
    """How odd a span of text looks: signs of no script, changes of script or of case within words, pairs of
    Cyrillic letters that are not ``usual``."""
    classes = "".join([_CLASSES.get(ch) or _class(ch) for ch in text])
    total = classes.count("x") + 0.1 * classes.count("m") + 2.0 * text.count(_LOST) + (classes[:1] == "m")
    low = text.lower()
    for i in range(len(text) - 1):
        two = classes[i] + classes[i + 1]
        if two[1] == "m" and two[0] in "spd":  # a mark without its letter
            total += 1.0
        if two in _ODD:
            total += 1.0
        if classes[i] in "cC" and classes[i + 1] in "cC" and low[i : i + 2] not in usual:
            total += 0.6
        if two in ("uu", "ll") and text[i] > "\x7f" and text[i + 1] > "\x7f":
            total += 0.8
    return total


@lru_cache(maxsize=8)
def _first_level(encoding: str) -> frozenset[str]:
    """The letters that an East Asian encoding holds as its usual ones: Han of the first level, kana, Hangul, full-width marks."""
    rows = {"gb18030": (0xA1, 0xD7), "euc-jp": (0xA1, 0xCF), "euc-kr": (0xA1, 0xC8), "big5": (0xA1, 0xC6), "shift_jis": (0x81, 0x97)}[encoding]
    out = set()
    for lead in range(rows[0], rows[1] + 1):
        for trail in range(0x40 if encoding in ("big5", "shift_jis") else 0xA1, 0xFF):
            try:
                out.add(bytes([lead, trail]).decode(encoding))
            except UnicodeDecodeError:
                continue
    return frozenset(out)


@lru_cache(maxsize=1)
def _sequences() -> dict[bytes, tuple[bool, ...]]:
    """The bytes of all characters of the East Asian encodings, and which encodings have them; of four bytes the first two."""
    out: dict[bytes, list[bool]] = {}
    for k, encoding in enumerate(EAST_ASIAN):
        for ch in map(chr, (*range(0xA1, 0xD800), *range(0xF900, 0x10000))):
            try:
                data = ch.encode(encoding)
            except UnicodeEncodeError:
                continue
            if len(data) > 1:
                out.setdefault(data[:2] if len(data) == 4 else data, [False] * len(EAST_ASIAN))[k] = True
    return {data: tuple(of) for data, of in out.items()}


# ---- patterns


def _spelled(text: str) -> str:
    """The bytes of a text as letters: the automaton looks through a node's branches one by one, of which there are few for bytes."""
    return text.encode("utf-8", "surrogatepass").decode("latin-1")


def _changed(span: str, back: str) -> tuple[str, str]:
    """Both texts without what they begin and end with alike, but for two letters beside the difference."""
    most = min(len(span), len(back))
    i = next((k for k in range(most) if span[k] != back[k]), most)
    j = next((k for k in range(most - i) if span[-1 - k] != back[-1 - k]), most - i)
    i, j = max(0, i - 2), max(0, j - 2)
    return span[i : len(span) - j], back[i : len(back) - j]


def _differences(span: str, back: str, at: int) -> list[tuple[int, int, str]]:
    """The parts of a word that its reading changes, with what replaces them; single letters that stay between two of them go along."""
    out: list[list] = []
    for op, i, j, k, m in SequenceMatcher(None, span, back, autojunk=False).get_opcodes():
        if op == "equal":
            continue
        if out and i - out[-1][1] <= 1:
            out[-1][1:] = [j, out[-1][2], m]
        else:
            out.append([i, j, k, m])
    return [(at + i, at + j, back[k:m]) for i, j, k, m in out]


class Finder:
    """The automaton over the garbled sequences of all pairs of encodings, and the reading back.

    ``words``: counts of Russian words of the corpus, which extend the built-in ones.
    """

    def __init__(self, words: dict[str, int] | None = None):
        words = words or {}
        self.usual = _RUSSIAN_PAIRS | usual_parts(words, 2, PART_SHARE)
        self.letters = frozenset(COMMON_HAN) | {w for w in words if len(w) == 1}
        patterns: dict[str, int] = defaultdict(int)
        number: dict[tuple[str, str], int] = {}

        def note(out: str, real: str, wrong: str) -> None:
            patterns[out] |= 1 << number.setdefault((real, wrong), len(number))

        def add(text, real, wrong):
            out = garble(text, real, wrong)
            if out and out != text and _LOST not in out and not out.isascii() and self._unusual(out):
                note(out, real, wrong)

        verdicts: dict[str, bool] = {}

        def unusual(data: bytes, table_: list[str], marks: list[str]) -> bool:
            """:meth:`_unusual` of the bytes as read, which the classes of the characters decide."""
            key = "".join([marks[b] for b in data])
            if key not in verdicts:
                verdicts[key] = self._unusual("".join([table_[b] for b in data]))
            return verdicts[key]

        marks_of = lambda t: [_class(ch) + ("N" if ch == "\xa0" else "" if ch > "\x7f" else "'") for ch in t]
        # UTF-8: all characters of two bytes; of those of more the first two bytes if these are odd, else the first three
        for wrong in UTF8_READ_AS:
            table_ = _table(wrong)
            marks = marks_of(table_)
            for o in range(0xA0, 0x800):
                add(chr(o), "utf-8", wrong)
            for lead in range(0xE0, 0xF5):
                for second in range({0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80), {0xED: 0xA0, 0xF4: 0x90}.get(lead, 0xC0)):
                    two = table_[lead] + table_[second]
                    if not two[1].isspace() and "x" in _class(two[0]) + _class(two[1]):
                        note(two, "utf-8", wrong)
                        continue
                    for third in range(0x80, 0xC0):
                        if unusual((lead, second, third), table_, marks):
                            note(two + table_[third], "utf-8", wrong)
        pairs = [v + k for v in VOWELS for k in CONSONANTS] + [k + v for v in VOWELS for k in CONSONANTS]
        triples = usual_parts(dict.fromkeys(RUSSIAN_WORDS, 1), 3, 0)
        more = usual_parts(words, 3, PART_SHARE) - triples
        for real in CYRILLIC:
            for wrong in CYRILLIC_READ_AS:
                if wrong != real:
                    for text in (*pairs, *triples):
                        add(text, real, wrong)
                        add(text.capitalize(), real, wrong)
                    for text in more if wrong in CYRILLIC else ():
                        add(text, real, wrong)
        for wrong in EAST_ASIAN_READ_AS:
            table_ = _table(wrong)
            marks = marks_of(table_)
            bits = [1 << number.setdefault((real, wrong), len(number)) for real in EAST_ASIAN]
            masks = {of: sum(bit for bit, has in zip(bits, of) if has) for of in set(_sequences().values())}
            for data, of in _sequences().items():
                if unusual(data, table_, marks):
                    patterns["".join([table_[b] for b in data])] |= masks[of]
        for real, name in OTHER_ALPHABETS.items():
            for wrong in OTHER_READ_AS:
                for a in ALPHABETS[name]:
                    for b in ALPHABETS[name]:
                        add(a + b, real, wrong)
                        if name == "gr":
                            add(a.upper() + b, real, wrong)
        for real, wrong in WESTERN:
            for ch in WESTERN_LETTERS:
                out = garble(ch, real, wrong)
                if out and out != ch and _class(out) not in "lpsdm":
                    for a in "abcdefghijklmnopqrstuvwxyz":
                        if out.isalpha() and out not in "µªº" or out == "‹":  # at the start of a word; other signs there are meant
                            note(out + a, real, wrong)
                        if ch.islower():
                            note(a + out, real, wrong)
        for real, wrong in CENTRAL:
            for ch in CENTRAL_LETTERS:
                out = garble(ch, real, wrong)
                if out and out != ch and out != "µ" and _class(out) not in "lpsdm":
                    for a in "abcdefghijklmnopqrstuvwxyz":
                        note(out + a, real, wrong)  # after a letter these signs are exponents too
        for wrong in UTF8_READ_AS_WIDE:
            for text in pairs:
                add(text, "utf-8", wrong)
            for ch in WESTERN_LETTERS.lower() + CENTRAL_LETTERS:
                out = garble(ch, "utf-8", wrong)
                if out and len(out) == 1 and _LOST not in out:
                    for a in "abcdefghijklmnopqrstuvwxyz":
                        note(a + out, "utf-8", wrong)
            # all other scripts: what the first two bytes of a character become; correct text in Han has
            # these signs too, but its bytes are no UTF-8
            for lead in (*range(0xCE, 0xDC), *range(0xE0, 0xF5)):
                for second in range(0x80, 0xC0):
                    try:
                        out = bytes([lead, second]).decode(wrong)
                    except UnicodeDecodeError:
                        continue
                    if len(out) == 1:
                        note(out, "utf-8", wrong)
        self.pairs = sorted(number)
        self.many = frozenset(p for p, (real, _) in enumerate(self.pairs) if real in EAST_ASIAN or real in OTHER_ALPHABETS)
        place = {number[p]: i for i, p in enumerate(self.pairs)}
        of_mask: dict[tuple[int, int], tuple] = {}
        self.automaton = ahocorasick.Automaton()
        for text, mask in patterns.items():
            value = of_mask.get((len(text), mask))
            if value is None:
                value = of_mask[len(text), mask] = (len(text), tuple(sorted(i for k, i in place.items() if mask >> k & 1)))
            self.automaton.add_word(_spelled(text), value)
        self.automaton.make_automaton()

    def _rarity(self, text: str, real: str) -> float:
        """How rare the East Asian letters are: those usual in the corpus count nothing, those of the encoding's
        second level and letters of other languages most."""
        first = _first_level(real)
        total = 0.0
        for ch in text:
            if ch > "\x7f" and ch not in self.letters:
                kana = "\u3041" <= ch <= "\u30fa"
                total += 0.3 if ch not in first else 0.05 if kana and real not in ("euc-jp", "shift_jis") else 0.0 if kana else 0.1 if real == "euc-kr" else 0.15
        return total

    @staticmethod
    def _doubt(back: str, real: str) -> float:
        """What a reading weighs less than another that is as plain: nearly any bytes read as letters of a script without case."""
        if any(real == r for r, _ in CENTRAL) and not back.isascii():
            return 0.2
        if real in ("cp1252", "cp850", "cp437", "mac-roman"):
            return 0.02 * any(ch > "\x7f" and ch.isupper() for ch in back[1:])  # within a word a small letter is more usual
        if real in OTHER_ALPHABETS:
            return (0.3 if OTHER_ALPHABETS[real] == "th" else 0.05) * sum(_class(ch) in "ag" for ch in back)
        if real in EAST_ASIAN:
            mixed = any(_class(x) + _class(y) in ("lh", "hl", "uh", "hu") for x, y in zip(back, back[1:]))
            return 0.05 * sum(ch > "\x7f" for ch in back) + 2.0 * mixed
        return 0.0

    def _inside(self, span: str, wrong: str) -> list[tuple[int, int, str]]:
        """Runs within a word without spaces whose bytes in a wide encoding are UTF-8 of usual East Asian letters."""
        data, at = [], 0
        for ch in span:
            try:
                data.append(ch.encode(wrong))
            except UnicodeEncodeError:
                data.append(b"\xff")
        out = []
        while at < len(span):
            if len(data[at]) == 2 and 0xE3 <= data[at][0] <= 0xED and 0x80 <= data[at][1] < 0xC0:
                run, end, best = b"", at, None
                while end < len(span) and len(data[end]) == 2 and all(0x80 <= b < 0xC0 or 0xE3 <= b <= 0xEF for b in data[end]):
                    run += data[end]
                    end += 1
                    try:
                        best = (end, run.decode("utf-8"))
                    except UnicodeDecodeError as error:
                        if error.reason != "unexpected end of data":
                            break
                if best:
                    known = sum(ch in self.letters or "\u3041" <= ch <= "\u30fa" for ch in best[1])
                    if known >= 2 and known * 2 >= len(best[1]) and all(_class(ch) == "h" for ch in best[1]):
                        out.append((at, *best))
                        at = best[0]
                        continue
            at += 1
        return out

    @staticmethod
    def _unusual(text: str) -> bool:
        """Whether correct text is unlikely to hold the sequence."""
        classes = "".join(map(_class, text))
        if "x" in classes:
            return True
        if set(classes) <= {"c"} or set(classes) <= {"l"} and len(text) < 2:
            return False
        if set(classes) <= set("lu"):
            return len(text) > 1 and all(ch > "\x7f" for ch in text)
        if set(classes) <= {"C"}:
            return len(text) > 2
        if "h" in classes:
            return len(text) > 1 or text in "銇銈銉锛銆"
        return any(a + b in _ODD for a, b in zip(classes, classes[1:])) or classes[0] in "lu" and text[0] > "\x7f" and "\xa0" not in text

    def _read_back(self, span: str, real: str, wrong: str) -> str | None:
        """The span's original if it was ``real`` read as ``wrong``. Characters that cannot come from
        ``wrong`` stay, and so do sequences that are no UTF-8."""
        data = write(span, wrong)
        if data is None:
            if wrong in UTF8_READ_AS_WIDE:
                return None
            known = _bytes_of(wrong)
            out, run = [], ""
            for ch in span + "\x00":
                if ch in known and ch != "\x00":
                    run += ch
                else:
                    out.append((self._read_back(run, real, wrong) or run) if run else "")
                    out.append(ch)
                    run = ""
            return "".join(out)[:-1]
        if real != "utf-8":
            return read(data, real)
        if wrong in UTF8_READ_AS_WIDE:
            return data.decode("utf-8", "replace")
        text = data.decode("utf-8", "surrogateescape")
        if any(0xDC80 <= ord(ch) < 0xDD00 for ch in text):
            table_ = _table(wrong)
            text = "".join(table_[ord(ch) - 0xDC00] if 0xDC80 <= ord(ch) < 0xDD00 else ch for ch in text)
        return text

    def _once(self, text: str) -> list[tuple[int, int, str]]:
        """Spans to replace, in order."""
        seen: dict[tuple[int, int], dict[tuple, int]] = {}
        tokens: dict[tuple[int, int], dict[int, int]] = {}
        spelled = _spelled(text)
        found = list(self.automaton.iter(spelled))
        if not found:
            return []
        letter = np.cumsum((np.frombuffer(spelled.encode("latin-1"), np.uint8) & 0xC0) != 0x80)  # of each byte, from 1
        hits = [(int(letter[end]) - n, ps) for end, (n, ps) in found]
        bounds = [m.span() for m in _SPACES.finditer(text)]
        k = 0
        for start, ps in hits:
            while k < len(bounds) and bounds[k][1] <= start:
                k += 1
            if k < len(bounds) and bounds[k][0] <= start:
                lists = seen.setdefault(bounds[k], {})
                lists[ps] = lists.get(ps, 0) + 1
        for bound, lists in seen.items():
            votes = tokens[bound] = {}
            for ps, n in lists.items():
                for p in ps:
                    votes[p] = votes.get(p, 0) + n
        total: dict[int, int] = {}
        for votes in tokens.values():
            for p, n in votes.items():
                total[p] = total.get(p, 0) + n
        chosen, wide, others = [], [], {}
        for (a, b), votes in tokens.items():
            span = text[a:b]
            drawing = _DRAWING.fullmatch(span) is not None
            own = oddity(span, self.usual)
            if "‹" in span and "›" in text and oddity(span.strip("‹›.,;:!?"), self.usual) < 0.5:
                continue  # marks of a quotation
            if own < 0.5 and not any(self.pairs[p][1] in UTF8_READ_AS_WIDE for p in votes):
                continue
            best, torn, options = None, [], {}
            for p in sorted(votes, key=lambda p: (p in self.many, -total[p], p)):
                if best and best[0][0] == 0:
                    break  # nothing can be plainer, ties go to the pair found more often, and the others are in doubt
                real, wrong = self.pairs[p]
                # letters of an East Asian encoding look plain one by one; their garbled sequences do not
                before = own + (votes[p] if wrong in UTF8_READ_AS_WIDE else 0.0)
                if before < 0.5:
                    continue
                if drawing and (real != "utf-8" or len(span) < 6):
                    continue
                if (real, wrong) in CENTRAL and total[p] < 2:
                    continue  # one sign beside a word may be meant
                back = self._read_back(span, real, wrong)
                if back is None or back == span:
                    continue
                if wrong in UTF8_READ_AS_WIDE and 2.0 * back.count(_LOST) > 0.34 * before + 0.2:
                    torn.append(wrong)
                    continue
                if real in EAST_ASIAN and total[p] < 3:
                    # two signs of a correct text may chance to be a letter's bytes; a run of usual letters alone does not
                    high = [ch for ch in back if ch > "\x7f"]
                    if len(high) < 2 or regex.search(r"[a-zA-Z]", span) or not all(ch in self.letters or ch in _first_level(real) for ch in high):
                        continue
                if len(span) > LONG_RUN:  # of a run without spaces only the part that changes counts
                    now, then = _changed(span, back)
                    before += oddity(now, self.usual) - own
                    after = oddity(then, self.usual)
                else:
                    after = 0.0 if _DRAWING.fullmatch(back) and not drawing else oddity(back, self.usual)
                if real in EAST_ASIAN:
                    after += self._rarity(back, real)
                if real == "utf-8" and after >= 1.0:  # garbled more than once
                    for again in (wrong, "cp1252", "latin-1", "cp1251"):
                        twice = self._read_back(back, real, again)
                        if twice and twice != back and (o := oddity(twice, self.usual)) < after:
                            thrice = self._read_back(twice, real, again)
                            back, after = (thrice, p3) if thrice and (p3 := oddity(thrice, self.usual)) < o else (twice, o)
                            break
                gain = before - after
                if gain >= 0.5 and after <= 0.34 * before + 0.2:
                    key = (round(after + self._doubt(back, real), 3), -total[p], p)
                    options[p] = (key, back, p, gain)
                    if best is None or key < best[0]:
                        best = (key, back, p, gain)
            if best:
                chosen.append((a, b, best[1], best[2], best[3]))
                others[a] = options
            elif torn:
                inner = max((self._inside(span, wrong) for wrong in torn), key=len)
                wide += [(a + i, a + j, back) for i, j, back in inner]
        # one weak word of a text proves nothing if its pair is found nowhere else
        def strengths():
            out: dict[int, float] = defaultdict(float)
            for _, _, _, p, gain in chosen:
                out[p] += gain if gain >= 1.0 else 0.0
            return out

        strength = strengths()
        first = max(strength, key=lambda p: (strength[p], -p), default=None)
        many = self.many
        if first is not None and any(p in many and p != first for _, _, _, p, _ in chosen):
            # nearly any bytes read as these letters: beside a stronger pair of the same text they do not count
            kept = []
            for a, b, back, p, gain in chosen:
                if p in many and p != first and (first in others[a] or strength[p] < 0.5 * strength[first]):
                    plain = [o for q, o in others[a].items() if q == p or q not in many or q == first and o[0][0] <= others[a][p][0][0] + 1.0]
                    if strength[p] < 0.5 * strength[first]:
                        plain = [o for o in plain if o[2] != p]
                    if not plain:
                        continue
                    _, back, p, gain = min(plain, key=lambda o: (o[2] != first, o[0]))
                kept.append((a, b, back, p, gain))
            chosen = kept
            strength = strengths()
        sure = lambda p, gain: strength[p] >= 6.0 or gain >= 1.0 and (strength[p] >= 2.0 or self.pairs[p][0] == "utf-8" or self.pairs[p] in WESTERN)
        return sorted(wide + [(a, b, back) for a, b, back, p, gain in chosen if sure(p, gain)])

    def restore(self, text: str) -> tuple[str, list[tuple[int, int]], bool]:
        """The restored text, the garbled spans of the given text, and whether bytes are lost."""
        if text.isascii():
            return text, [], False
        spans: list[tuple[int, int]] = []
        now = text
        for turn in range(3):
            found = self._once(now)
            if not found:
                break
            found = [x for a, b, back in found for x in _differences(now[a:b], back, a)]
            if turn == 0:
                spans = [(a, b) for a, b, _ in found]
            out, last = [], 0
            for a, b, back in found:
                out += [now[last:a], back]
                last = b
            now = "".join(out) + now[last:]
        lost = [m.span() for m in regex.finditer("�+", text)]
        if lost:
            spans = sorted({*spans, *lost})
        return now, spans, bool(lost) or _LOST in now


def corpus_words(df: DataFrame, text: str, min_share: float = WORD_SHARE) -> dict[str, int]:
    """Russian words, and Han and Hangul letters, with at least ``min_share`` of all occurrences, hence at most ``1 / min_share``.
    Garbled words are spread over too many forms to be among them."""

    def make():
        count: Counter = Counter()

        def flush():
            rows = list(count.items())
            count.clear()
            return {"word": [w for w, _ in rows], "n": [n for _, n in rows]}

        def step(cols):
            for t in cols["_text"]:
                count.update(_COUNTED.findall(t))
            if len(count) > 200_000:
                yield flush()

        def close():
            yield flush()

        step.close = close
        return step

    rows = arrow_map(df.select(F.col(text).alias("_text")).where(F.col("_text").rlike("[а-я]{3}|[\\p{IsHan}\\p{IsHangul}]")), make, "word string, n bigint")
    counts = materialize(rows.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r["word"]: r["n"] for r in counts.where(F.col("n") >= max(2, int(total * min_share))).toLocalIterator()}


def repair(df: DataFrame, key: str, text: str, words: dict[str, int] | None = None) -> DataFrame:
    """One row per garbled text: ``key``, ``restored``, ``n_spans``, ``lossy`` (1: bytes are lost, so part stays garbled).

    Null, empty, blank and correct texts give no row; repeated rows give one each. Other columns
    are left out. ``words``: those of :func:`corpus_words`, by default of these very texts.
    """
    if words is None:
        words = corpus_words(df, text)
    # built once here and sent ready-made (some 25 MB whatever the corpus holds); each process unpacks it once
    shared = df.sparkSession.sparkContext.broadcast(Finder(words))

    def make():
        finder = shared.value

        def step(cols):
            out: dict[str, list] = {key: [], "restored": [], "n_spans": [], "lossy": []}
            for i, t in zip(cols[key], cols["_text"]):
                restored, spans, lossy = finder.restore(t)
                if spans:
                    for k, v in zip(out, (i, restored, len(spans), int(lossy))):
                        out[k].append(v)
            yield out

        return step

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key), F.col(text).alias("_text")).where(F.col("_text").rlike("[^\\x00-\\x7f]"))
    return arrow_map(rows, make, f"`{key}` {kind}, restored string, n_spans int, lossy int")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_restored(spark, sf_dir).select("doc_id").distinct()


QUERIES = {"p8_found": p8_found, "p8_restored": p8_restored}
SQL: dict[str, str] = {}
