"""Personal information in free text, by information-theoretic sanitisation.

One pass over the whole corpus proposes every span that could be personal by its build: anything
shaped like an electronic address, a long number, a street with a house, a name. A proposal is
never a decision. It carries its terms: its form, the words before it, the names inside it. A few
fixed labels ("tel", "passport", "name") serve as seeds: a proposal beside the seed of its kind is
an anchor. The corpus then tells how strongly each term reveals an entity of each kind, by pointwise
mutual information in bits:

* a form, by the share of its proposals that stand beside a seed, against the kind's share of all words;
* a word before a span, by the share of all its occurrences that stand before spans whose form reveals them
  (the second word before it gives a third, so that it never suffices alone);
* a name inside a span, by the share of all its occurrences that stand in the place of a name.

A span is disclosed when the bits of its form and of the words before it together reach ``DISCLOSURE``
of the bits that naming the kind takes (minus the logarithm of its share of all words). This one
threshold holds for all five kinds and at every size; without the corpus's counts nothing is disclosed.
Disclosed spans are generalised to typed placeholders. Numbers of orders, versions or standards
have similar forms, but neither these forms nor the words beside them reveal anything.

Counting, weighing and deciding are joins of narrow rows (a proposal and its terms); texts are read
once to propose and once more to be rewritten.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.common import arrow_map
from pairforge.session import table
from pairforge.storage import materialize

KINDS = ("email", "phone", "id_number", "address", "person")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
#: Share of the bits that name a kind which a span's terms must give for the span to be disclosed.
DISCLOSURE = 0.5
#: Least share of a word's occurrences that stand before revealed spans of a kind, for the word to count, and least number of them.
TERM_SHARE = 0.15
LEAST_TOGETHER = 4
#: Least share of a word's occurrences that stand in the place of a name, for it to be one.
NAMED_SHARE = 0.2

# Labels of numbers that name one person, in the languages at hand.
ID_LABELS = r"паспорт\p{L}*|снилс|инн|огрнип|passport(?:\s+no)?|national\s+id|ssn|social\s+security(?:\s+number)?|nin|steuer-?id|steuernummer|ausweis(?:nummer)?|personalausweis|reisepass|n°\s+de\s+sécurité\s+sociale|sécurité\s+sociale|passeport|numéro\s+fiscal|dni|nie|nif|pasaporte"
# Labels of phone numbers.
PHONE_LABELS = {"tel", "tél", "telefon", "telephone", "téléphone", "teléfono", "phone", "mobile", "mobil", "móvil", "portable", "fax", "handy", "тел", "телефон", "моб", "факс"}
# Labels of electronic mail, of addresses and of names.
EMAIL_LABELS = {"e-mail", "email", "mail", "courriel", "correo", "почта", "почту", "почте", "contact", "contacto", "контакт", "контакты"}
ADDRESS_LABELS = {"адрес", "адресу", "регистрации", "проживает", "address", "live", "lives", "anschrift", "wohnhaft", "adresse", "habite", "dirección", "vivo"}
PERSON_LABELS = {"фио", "зовут", "доц", "проф", "соискатель", "dr", "prof", "mr", "mrs", "ms", "name", "applicant", "coordinator", "heiße", "ansprechpartner", "appelle", "encadrement", "llamo", "tutor", "tutora"}
# Usual given names, whose words have the build of names; others must stand beside a label or be known from there.
GIVEN = """александр алексей алиса анастасия андрей анна антон артём борис вадим валентина вера виктор владимир галина глеб григорий дарья денис дмитрий евгений егор екатерина елена иван игорь
илья ирина кирилл константин ксения лев людмила максим маргарита марина мария михаил надежда наталья никита николай нина олег ольга павел пётр полина роман светлана сергей софья степан татьяна тимур юлия юрий
adam alice anna ben charlotte daniel david edward emily emma george grace hannah henry jack james jane john kate laura lucy mark mary michael oliver oscar paul peter robert sarah simon thomas william
anja bernd felix franz hans heinz ingrid jörg jürgen karl klaus lena martin monika petra stefan ute uwe werner camille chloé claire françois hélène jean julien luc manon marie nicolas philippe pierre sophie
ana andrés carlos carmen elena francisco javier jorge josé juan lucía luis manuel maría marta miguel pablo pedro pilar sofía tomás raúl inés begoña agnès inès hugo rémi birgit colin dirk heike jana megan miles nora ruth""".split()

_SPACE = r"[ \xa0]{0,2}"
_DOT = rf"{_SPACE}\."
_COMMA = rf"{_SPACE},{_SPACE}\s?"

# ---- electronic mail
_AT = rf"(?:{_SPACE}@{_SPACE}|{_SPACE}[\[(]{_SPACE}(?:at|собака|ат|dog|arroba|arobase){_SPACE}[\])]{_SPACE})"
_POINT = rf"(?:\.| \. |{_SPACE}[\[(]{_SPACE}(?:dot|точка|punto|point|punkt){_SPACE}[\])]{_SPACE})"
EMAIL = regex.compile(rf"(?i)(?<![\p{{L}}\p{{N}}@])[\p{{L}}\p{{N}}_+\-]+(?:{_POINT}[\p{{L}}\p{{N}}_+\-]+)*{_AT}[\p{{L}}\p{{N}}\-]+(?:{_POINT}[\p{{L}}\p{{N}}\-]+)*{_POINT}[a-zа-я]{{2,}}(?![\p{{L}}\p{{N}}@])")

# ---- numbers
_SEP = r"[ \xa0  ]{0,2}[\-‐‑–./]?[ \xa0  ]{0,2}"
_EXT = rf"(?:{_SPACE},?{_SPACE}(?:доб|ext|вн|extension|durchwahl|poste)\p{{L}}*{_SPACE}\.?{_SPACE}\d{{1,6}})?"
_D = lambda n: _SEP.join([r"\d"] * n)  # noqa: E731 - n digits with single separators
PHONE_STRONG = regex.compile(
    rf"(?i)(?<![\d\p{{L}}.\-/+])(?:(?:\+{_SPACE}7|8){_SEP}\(?{_SPACE}\d{{3}}{_SPACE}\)?{_SEP}\d{{3}}{_SEP}\d{{2}}{_SEP}\d{{2}}"
    rf"|\(?{_SPACE}(?:\+|00){_SPACE}(?:1|44|49|33|34|3[0-9]|4[0-8]|3[5-8]\d|9\d|2\d){_SPACE}\)?{_SEP}\(?{_SPACE}\d{{1,4}}{_SPACE}\)?(?:{_SEP}\d){{6,9}}){_EXT}(?![\d\p{{L}}])"
)
PHONE_WEAK = regex.compile(
    rf"(?i)(?<![\d\p{{L}}.\-/+(])(?:\({_SPACE}\d{{3,5}}{_SPACE}\){_SEP}\d{{3,5}}(?:{_SEP}\d{{2,4}}){{0,2}}|\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{3,4}}|0\d{{2,4}}{_SPACE}[/ ]{_SPACE}\d{{4,5}}{_SEP}\d{{3,4}}|0\d(?:{_SEP}\d{{2}}){{4}}|0\d{{2}}{_SEP}\d{{4}}{_SEP}\d{{4}}|\d{{9,11}}){_EXT}(?![\d\p{{L}}])"
)
_BODY = r"\d(?:(?:[ \xa0\-–]{0,2}(?:№[ \xa0]{0,2})?|\.)\d){5,16}"
ID = regex.compile(rf"(?i)(?<![\p{{L}}\d.,/(+])(?P<lead>\p{{L}}{{1,2}}{_SPACE})?(?P<body>{_BODY})(?P<tail>{_SPACE}-?[a-z](?![\p{{L}}\d]))?(?![\p{{L}}\d])")
_ID_SEED = regex.compile(rf"(?i)(?<![\p{{L}}\d])(?:{ID_LABELS}){_SPACE}(?:серия{_SPACE})?[.:№#]?{_SPACE}[:.]?{_SPACE}\Z")

# ---- street addresses
_NAME = r"[\p{L}][\p{L}\-'’]{2,}"
_RU_STREET = r"(?:улица|ул|переулок|пер|проспект|просп|пр-т|пр-кт|набережная|наб|шоссе|ш|бульвар|б-р|бул|проезд|площадь|пл|тупик|аллея)"
_HOUSE = rf"(?:(?:дом|д){_SPACE}\.?{_SPACE})?\d{{1,4}}(?:{_SPACE}[\-/к]{_SPACE}\d{{1,4}}|{_SPACE}[а-яa-z](?![\p{{L}}\d]))?"
_RU_MORE = rf"(?:{_COMMA}(?:корпус|корп|к|строение|стр|квартира|кв|офис|оф|подъезд|этаж|комната|ком|лит){_SPACE}\.?{_SPACE}\d{{1,4}}\p{{L}}?)*"
ADDRESS_RU = regex.compile(
    rf"(?i)(?<![\p{{L}}\d])(?:(?P<code>\d{{6}}){_COMMA})?(?:(?P<g>(?:г|гор|город|пос|с|дер){_SPACE}\.?{_SPACE}{_NAME}){_COMMA}|(?P<city>{_NAME}){_COMMA})?"
    rf"(?:{_RU_STREET}(?:{_DOT}|(?<=\p{{L}}{{4}})|(?<=-\p{{L}}{{1,2}})){_SPACE}{_NAME}(?:{_SPACE}{_NAME})?|{_NAME}{_SPACE}(?:улица|ул|переулок|пер|проспект|пр-т|набережная|наб|шоссе|бульвар)(?!\p{{L}}){_SPACE}\.?+(?!{_SPACE}\p{{L}}))"
    rf"(?:{_COMMA}(?P<house>{_HOUSE}){_RU_MORE})?"
)
_ZIP = r"\d{4,6}"
_CITY_AFTER = rf"(?:{_COMMA}(?P<zip>{_ZIP}){_SPACE}{_NAME}(?:-{_NAME})?|{_COMMA}(?P<place>{_NAME})(?:{_SPACE}(?P<zip2>{_ZIP})(?!\d))?)?"
ADDRESS_EN = regex.compile(rf"(?i)(?<![\p{{L}}\d.@])(?:(?:apt|flat|unit|suite){_SPACE}\.?{_SPACE}\d+\p{{L}}?{_COMMA})?\d{{1,4}}\p{{L}}?{_SPACE}(?:(?:old|new|north|south|east|west){_SPACE})?{_NAME}[ \xa0]{{1,2}}(?:street|st|road|rd|lane|ln|avenue|ave|drive|dr|close|court|terrace|way|square)(?![\p{{L}}])(?:{_SPACE}\.(?={_SPACE}[,\d]|\s*$|\s*\n))?(?:{_COMMA}(?:apt|flat|unit|suite){_SPACE}\.?{_SPACE}\d+\p{{L}}?)?{_CITY_AFTER}")
ADDRESS_DE = regex.compile(rf"(?i)(?<![\p{{L}}\d])(?:[\p{{L}}\-]{{3,}}(?:straße|strasse|str{_SPACE}\.|weg|platz|allee|gasse|ufer|ring|damm)|(?:am|an der|im|zum|zur|auf dem|unter den)\s{_NAME}){_SPACE}\d{{1,4}}{_SPACE}?\p{{L}}?(?![\p{{L}}\d]){_CITY_AFTER}")
ADDRESS_FR = regex.compile(rf"(?i)(?<![\p{{L}}\d])\d{{1,4}}(?:{_SPACE}(?:bis|ter|quater))?{_SPACE},?{_SPACE}(?:rue|avenue|av|bd|boulevard|place|chemin|quai|allée|impasse|cours|route){_SPACE}\.?{_SPACE}(?:(?:des|de la|du|de|d['’]){_SPACE})?{_NAME}{_CITY_AFTER}")
ADDRESS_ES = regex.compile(rf"(?i)(?<![\p{{L}}\d])(?:calle|c{_SPACE}/|avda|avenida|av|plaza|paseo|pza|ronda|camino){_SPACE}\.?{_SPACE}(?:(?:de|del|de la){_SPACE})?{_NAME}{_SPACE},?{_SPACE}\d{{1,4}}(?!\d)(?:{_COMMA}\d{{1,2}}{_SPACE}\.?{_SPACE}[ºª°]{_SPACE}\p{{L}}(?!\p{{L}}))?{_CITY_AFTER}")
ADDRESSES = (("en", ADDRESS_EN), ("de", ADDRESS_DE), ("fr", ADDRESS_FR), ("es", ADDRESS_ES))

# ---- persons
WORD = regex.compile(r"[\p{L}][\p{L}\p{M}'’\-]*")
_PATRONYMIC = regex.compile(r"(?i)\p{L}{2,}(?:ович|евич|ьич|инична|овна|евна|ична)$")
_INITIAL = rf"\p{{L}}{_SPACE}\."
_INITIALS_AFTER = regex.compile(rf"[ \xa0]{{1,2}}\p{{Lu}}{_DOT}(?:{_SPACE}\p{{Lu}}{_DOT})?|[ \xa0]{{1,2}}\p{{Ll}}{_DOT}(?:{_SPACE}\p{{Ll}}{_DOT})?")
#: Degrees and turns of phrase that look like initials.
_DEGREE = regex.compile(rf"(?i)[кд]{_DOT}{_SPACE}\p{{L}}{{1,4}}{_DOT}{_SPACE}н{_DOT}{_SPACE}\Z|(?<!\p{{L}})(?:s{_DOT}{_SPACE}[la]|u{_DOT}{_SPACE}s|e{_DOT}{_SPACE}e){_DOT}{_SPACE}\Z")
_NO_INITIALS = regex.compile(rf"(?i)(?:т{_DOT}{_SPACE}[екпднч]|и{_DOT}{_SPACE}о|[uz]{_DOT}{_SPACE}[ab]|d{_DOT}{_SPACE}h|[ie]{_DOT}{_SPACE}[eg]|u{_DOT}{_SPACE}s){_DOT}{_SPACE}$")
_INITIALS_BEFORE = regex.compile(rf"(?<![\p{{L}}\p{{M}}\d.])(?:(?:\p{{L}}|yu|ya){_DOT}{_SPACE}){{1,2}}\Z", regex.IGNORECASE)
_MIDDLE = rf"(?:[ \xa0]\p{{L}}{_DOT})?"



_DIGITS = regex.compile(r"\d+")
_RUNS = regex.compile(r"\d+|\p{L}+|[ \xa0]+")
_NOT_DIGITS = regex.compile(r"\D+")
_BEFORE_WORD = regex.compile(r"[\p{L}][\p{L}\p{M}\-]*")
_EXTENSION = regex.compile(r"(?i)[ ,]*(?:доб|ext|вн|durchwahl|poste).*$", regex.DOTALL)
_CITY = regex.compile(r"(?:ск|град|бург|ово|ево|ино|поль|город|горск|цк|ль|нь|ва)$")
_GAPS = (" ", "  ", "\xa0", "\n")
_CUED = regex.compile(rf"[ \xa0]{{0,2}}[.:]?[ \xa0]{{1,2}}(?:(?P<s2>\p{{L}}[\p{{L}}\p{{M}}'’\-]{{2,}}){_SPACE},[ \xa0]{{1,2}}(?P<g2>\p{{L}}[\p{{L}}\p{{M}}'’\-]{{2,}})|(?P<g>\p{{L}}[\p{{L}}\p{{M}}'’\-]{{2,}})(?:[ \xa0]{{1,2}}\p{{L}}{_DOT})?[ \xa0]{{1,2}}(?P<s>\p{{L}}[\p{{L}}\p{{M}}'’\-]{{2,}}))")
_SURNAME_AFTER = regex.compile(rf"{_MIDDLE}[ \xa0]{{1,2}}(?P<s>\p{{L}}[\p{{L}}\p{{M}}'’\-]{{2,}})")
_SURNAME_COMMA = regex.compile(rf"(?P<s>\p{{L}}[\p{{L}}\p{{M}}'’\-]{{2,}}){_SPACE},[ \xa0]{{1,2}}$")
_TAIL_INITIAL = regex.compile(rf"[ \xa0]\p{{L}}{_DOT}(?=\W)")
_AT_HINT = regex.compile(rf"(?i){_AT}")
_GIVEN = frozenset(GIVEN)
#: What an address holds in any case; texts without it are not searched for one.
_RU_HINT = regex.compile(rf"(?i)(?<![\p{{L}}])(?:{_RU_STREET})(?![\p{{L}}])")
_DE_HINT = regex.compile(r"(?i)(?:straße|strasse|str[ \xa0]{0,2}\.|weg|platz|allee|gasse|ufer|ring|damm)[ \xa0]{0,2}\d|(?<!\p{L})(?:am|an der|im|zum|zur|auf dem|unter den)\s[\p{L}\-'’]{3,}[ \xa0]{0,2}\d")
_SURNAME_ENDS = tuple("ов ев ёв ин ын ова ева ёва ина ына ский цкий ская цкая енко чук юк дзе ян".split())
_PATRONYMIC_ENDS = ("ович", "евич", "ьич", "инична", "овна", "евна", "ична")


def _words_before(text: str, at: int, n: int = 2) -> list[str]:
    """The n words before a place, the nearest first."""
    return [w.lower() for w in _BEFORE_WORD.findall(text[max(0, at - 40) : at])[::-1][:n]]


def _is_russian(w: str) -> bool:
    return "а" <= w[0] <= "я" or w[0] == "ё"


def _is_surname(w: str) -> bool:
    """Whether a word has the ending of a Russian surname."""
    low = w.lower()
    return len(low) > 3 and low.endswith(_SURNAME_ENDS) and _is_russian(low)


def number_form(span: str) -> tuple[str, str]:
    """The form of a number, runs of digits by length and letters as L, and a coarser one: its first sign and the number of digits."""
    span = _EXTENSION.sub("", span)
    fine = _RUNS.sub(lambda m: " " if m.group()[0] in " \xa0" else "L" if m.group()[0].isalpha() else str(len(m.group())), span)
    digits = _NOT_DIGITS.sub("", span)
    return fine, f"{span[0] if not span[0].isalnum() else digits[0] if digits[:1] in '80' else ''}/{'L' if 'L' in fine else ''}{len(digits)}"


Proposal = tuple[str, int, int, int, str, str, list, int, list]


def propose(text: str) -> list[Proposal]:
    """Every span of a text that has the build of personal information, undecided:
    ``(kind, start, end, rank, form, coarse form, words before, seeded, names)``. Of overlapping disclosed
    spans the one of lower rank wins, then the longer one. ``names``: words with their role ('surname', 'given', 'place')
    that must be names for the span to hold."""
    out: list[Proposal] = []
    cased = any(ch.isupper() for ch in text)

    def add(kind, a, b, rank, form, coarse, labels, names=(), seeded=None):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            before = _words_before(text, a)
            out.append((kind, a, b, rank, form, coarse, before, int(bool(labels & set(before)) if seeded is None else seeded), [f"{role}:{w.lower()}" for role, w in names]))

    if _AT_HINT.search(text):
        for m in EMAIL.finditer(text):
            style = "@" if "@" in m.group() else "at"
            add("email", m.start(), m.end(), 0, f"{style}:{'.' in m.group()}:{' ' in m.group()}", style, EMAIL_LABELS)
    if any(ch.isdigit() for ch in text):
        _propose_numbers(text, add)
        _propose_addresses(text, cased, add)
    _propose_names(text, cased, add)
    return out


def _propose_numbers(text: str, add) -> None:
    for m in ID.finditer(text):
        # letters beside the number, and a last group of digits, may belong to it or not: the corpus knows the forms
        starts = {m.start(), m.start("body")}
        ends = {m.end(), m.end("body")}
        groups = [g.end() for g in _DIGITS.finditer(text, *m.span("body"))]
        if len(groups) > 1 and sum(ch.isdigit() for ch in text[m.start("body") : groups[-2]]) >= 6:
            ends.add(groups[-2])
        for a in starts:
            seeded = _ID_SEED.search(text, max(0, a - 60), a) is not None
            for b in ends:
                add("id_number", a, b, 1, number_form(text[a:b].strip())[0], "", (), seeded=seeded and b == m.end())
    for rank, pattern in ((2, PHONE_STRONG), (3, PHONE_WEAK)):
        for m in pattern.finditer(text):
            form, coarse = number_form(m.group().strip())
            if (10 if rank == 2 else 9) <= sum(ch.isdigit() for ch in _EXTENSION.sub("", m.group())) <= (15 if rank == 2 else 12):
                add("phone", m.start(), m.end(), rank, form, coarse, PHONE_LABELS, seeded=bool(PHONE_LABELS & set(_words_before(text, m.start(), 1))))


def _propose_addresses(text: str, cased: bool, add) -> None:
    for m in ADDRESS_RU.finditer(text) if _RU_HINT.search(text) else ():
        if not m.group("house"):
            continue
        start = m.start()
        if m.group("city") and (not _CITY.search(m.group("city").lower()) or text[max(0, start - 3) : start].rstrip().endswith("«")):
            start = m.end("city")
            while not text[start].isalnum():
                start += 1
        parts = "".join(k[0] for k in ("code", "g", "city") if m.group(k))
        add("address", start, m.end(), 4, f"ru:{parts}", "ru", ADDRESS_LABELS)
    for language, pattern in ADDRESSES:
        if language == "de" and not _DE_HINT.search(text):
            continue
        for m in pattern.finditer(text):
            end, place = m.end(), m.group("place")
            form = f"{language}:{'z' if m.group('zip') or m.group('zip2') else ''}"
            if place:
                after = text[end : end + 2].strip()
                if not (after[:1].isalpha() or cased and not place[0].isupper() or place.lower() in PHONE_LABELS | EMAIL_LABELS):
                    add("address", m.start(), end, 4, form, language, ADDRESS_LABELS, (("place", place),))
                end = m.start("place")
                while not (text[end - 1].isalnum() or text[end - 1] == "."):
                    end -= 1
            add("address", m.start(), end, 4, form, language, ADDRESS_LABELS)


def _propose_names(text: str, cased: bool, add) -> None:
    tokens = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
    count = len(tokens)
    shape = "Aa" if cased else "aa"
    person = lambda a, b, rank, build, names=(), russian=True: add("person", a, b, rank, f"{build}:{'ru' if russian else 'xx'}:{shape}", build, PERSON_LABELS, names)

    def gap(i: int, j: int) -> str:
        return text[tokens[i][1] : tokens[j][0]] if 0 <= i and j < count else "\n\n"

    def surname(w: str) -> bool:
        return len(w) > 2 and w.lower() not in _GIVEN and (not cased or w[0].isupper())

    for k, (a, b, w) in enumerate(tokens):
        low = w.lower()
        capital = not cased or w[0].isupper()
        if low in PERSON_LABELS or low[-7:] == "appelle":
            m = _CUED.match(text, b)
            if m:
                g, s = (m.group("g"), m.group("s")) if m.group("g") else (m.group("g2"), m.group("s2"))
                if g.lower() not in _GIVEN and g.lower() not in PERSON_LABELS and not g.lower().endswith(_PATRONYMIC_ENDS) and (not cased or g[0].isupper() and s[0].isupper()) and not _is_russian(g.lower()):
                    start = min(m.start(x) for x in ("g", "s", "g2", "s2") if m.start(x) >= 0)
                    person(start, m.end(), 54, "cued", (("surname", s), ("given", g)), False)
        if not capital or len(w) < 3:
            continue
        if low.endswith(_PATRONYMIC_ENDS) and len(w) > 5 and k and gap(k - 1, k) in _GAPS:
            given, known = tokens[k - 1], tokens[k - 1][2].lower() in _GIVEN
            if known or len(given[2]) > 2 and (not cased or given[2][0].isupper()):
                names = () if known else (("given", given[2]),)
                names += (("patronymic", w),)
                if k > 1 and gap(k - 2, k - 1) in _GAPS[:3] and _is_surname(tokens[k - 2][2]) and surname(tokens[k - 2][2]):
                    person(tokens[k - 2][0], b, 50, "sgp", (*names, ("surname", tokens[k - 2][2])))
                if gap(k, k + 1) in _GAPS and _is_surname(tokens[k + 1][2]) and surname(tokens[k + 1][2]):
                    person(given[0], tokens[k + 1][1], 51, "gps", (*names, ("surname", tokens[k + 1][2])))
                person(given[0], b, 52, "gp", names)
            continue
        if low in _GIVEN or cased and k + 1 < count and gap(k, k + 1) == " " and tokens[k + 1][2][0].isupper() and not _is_russian(low):
            known = low in _GIVEN
            need = () if known else (("given", w),)
            m = _SURNAME_AFTER.match(text, b)
            russian = _is_russian(low)
            if not (k + 1 < count and tokens[k + 1][2].lower().endswith(_PATRONYMIC_ENDS)):
                comma = _SURNAME_COMMA.search(text, max(0, a - 40), a) if known else None
                if comma and not russian and surname(comma.group("s")):
                    tail = _TAIL_INITIAL.match(text, b)
                    end = tail.end() if tail and tail.group().strip()[0].isupper() and not m else b
                    person(comma.start("s"), end, 53, "s,g", (("surname", comma.group("s")),), russian)
                elif m and surname(m.group("s")) and (not russian or _is_surname(m.group("s"))):
                    person(a, m.end(), 53 if known else 55, "gs" if known else "gs?", (*need, ("surname", m.group("s"))), russian)
                if known and russian and k and gap(k - 1, k) in _GAPS[:3] and _is_surname(tokens[k - 1][2]) and surname(tokens[k - 1][2]):
                    person(tokens[k - 1][0], b, 54, "sg", (("surname", tokens[k - 1][2]),))
            if known:
                continue
        # initials and a surname
        russian = _is_russian(low)
        if low in _GIVEN or russian and not _is_surname(w):
            continue
        m = _INITIALS_BEFORE.search(text, max(0, a - 14), a) if a and text[a - 1] in ". \xa0" and "." in text[max(0, a - 4) : a] else None
        if m and (not cased or m.group().strip()[0].isupper()) and not _DEGREE.search(text, max(0, a - 20), a):
            double = m.group().count(".") == 2
            doubt = "?" if not cased and _NO_INITIALS.search(m.group()) else ""
            person(a - len(m.group()), b, 56, f"i{1 + double}s{doubt}", (("surname", w),), russian)
        elif russian and "." in text[b + 1 : b + 7]:
            m = _INITIALS_AFTER.match(text, b)
            if m and (not cased or m.group().strip()[0].isupper()):
                doubt = "?" if not cased and _NO_INITIALS.search(m.group()) else ""
                person(a, m.end(), 57, f"si{m.group().count('.')}{doubt}", (("surname", w),))


def proposals(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """All proposals of all texts and, beside them in the same written table, the pre-aggregated counts of all words
    (``_word``, ``_n``; the other columns are null there). ``_row`` tells texts with equal keys apart."""
    kinds = {k: texts.schema[k].dataType.simpleString() for k in keys}
    columns = ("kind", "start_off", "end_off", "rank", "form", "coarse", "before", "seeded", "names")

    def make():
        words: Counter = Counter()

        def flush():
            found, counts = list(words), list(words.values())
            words.clear()
            none = [None] * len(found)
            return {k: none for k in (*keys, "_row", "_place", *columns)} | {"_word": found, "_n": counts}

        def step(cols):
            out: dict[str, list] = {k: [] for k in (*keys, "_row", "_place", *columns)}
            for i, t in enumerate(cols["_text"]):
                words.update(map(str.lower, WORD.findall(t)))
                for p, row in enumerate(propose(t)):
                    for k in keys:
                        out[k].append(cols[k][i])
                    out["_row"].append(cols["_row"][i])
                    out["_place"].append(p)
                    for c, v in zip(columns, row):
                        out[c].append(v)
            none = [None] * len(out["_row"])
            yield out | {"_word": none, "_n": none}
            if len(words) > 200_000:
                yield flush()

        def close():
            yield flush()

        step.close = close
        return step

    rows = texts.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"), F.xxhash64(text).alias("_row"))
    schema = ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", _row bigint, _place int, kind string, start_off int, end_off int, rank int, form string, coarse string, before array<string>, seeded int, names array<string>, _word string, _n bigint"
    return materialize(arrow_map(rows, make, schema), "proposals")


def disclosed(proposed: DataFrame, keys: list[str], disclosure: float = DISCLOSURE) -> DataFrame:
    """The proposals whose terms disclose them: ``keys``, ``_row``, ``kind``, ``start_off``, ``end_off``, ``rank``, ``fit``, ``bits``.

    Everything is joined on terms; the tables of forms and of revealing words are small and left to
    Spark's size check, hot words to its splitting of skewed partitions.
    """
    words = materialize(proposed.where("_word is not null").groupBy("_word").agg(F.sum("_n").alias("all_n")), "words")
    total = words.agg(F.sum("all_n").alias("n")).first()["n"] or 0
    spans = proposed.where("kind is not null")
    # the bits of forms; a form seen too seldom goes by its coarser form, if its kind has any
    fine = spans.groupBy("kind", "form", "coarse").agg(F.count("*").alias("n"), F.sum("seeded").alias("s"))
    forms = materialize(fine, "forms")
    coarse = forms.groupBy("kind", "coarse").agg(F.sum("n").alias("cn"), F.sum("s").alias("cs"))
    base = forms.groupBy("kind").agg((F.sum("s") / F.lit(max(1, total))).alias("base")).where("base > 0")
    share = F.when((F.col("n") >= LEAST_TOGETHER) | (F.col("coarse") == ""), F.col("s") / F.greatest("n", F.lit(LEAST_TOGETHER))).otherwise(F.col("cs") / F.col("cn"))
    forms = forms.join(coarse, ["kind", "coarse"]).join(base, "kind").withColumn("share", share)
    forms = forms.select("kind", "form", "coarse", F.greatest(F.lit(0.0), F.coalesce(F.log2(F.col("share") / F.col("base")), F.lit(0.0))).alias("form_bits"), (-F.log2("base") * disclosure).alias("least"))
    spans = materialize(spans.drop("_word", "_n", "seeded").join(forms, ["kind", "form", "coarse"]), "spans")
    # the bits of words before spans, from the spans that their form reveals
    beside = spans.where("form_bits >= least").select("kind", F.explode(F.array_distinct("before")).alias("_word")).groupBy("kind", "_word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TOGETHER)
    before = beside.join(words, "_word").withColumn("p", F.least(F.lit(1.0), F.col("n") / F.col("all_n"))).where(F.col("p") >= TERM_SHARE).join(base, "kind")
    leads = before.where("kind in ('phone', 'email', 'id_number')").groupBy("_word").agg(F.max("p").alias("leads"))
    before = before.select("kind", "_word", F.greatest(F.lit(0.0), F.log2(F.col("p") / F.col("base"))).alias("value"))
    # the share of each name's occurrences in the place of one
    named = spans.where("coarse != 'gs?'").select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("n")).withColumn("_word", F.substring_index("name", ":", -1))
    named = named.join(words, "_word").join(leads, "_word", "left").withColumn("value", F.col("n") / F.col("all_n"))
    # a word that rather leads to numbers is no place, however often it follows a street
    named = named.where("leads is null or leads <= value or name not like 'place:%'").select("name", "value")
    # terms of each span, weighed and put together again
    one = [*keys, "_row", "_place"]
    terms = spans.select(*one, "kind", F.posexplode("before").alias("i", "term")).unionByName(spans.select(*one, F.lit("name").alias("kind"), F.lit(-1).alias("i"), F.explode("names").alias("term")))
    known = before.withColumnRenamed("_word", "term").unionByName(named.select(F.lit("name").alias("kind"), F.col("name").alias("term"), "value"))
    weighed = terms.join(known, ["kind", "term"], "left").groupBy(*one).agg(
        F.max(F.when(F.col("i") >= 0, F.coalesce("value", F.lit(0.0)) / (1 + 2 * F.col("i")))).alias("context"), F.min(F.when(F.col("i") < 0, F.coalesce("value", F.lit(0.0)))).alias("name")
    )
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in one]
    both = spans.alias("a").join(weighed.alias("b"), same, "left")
    bits = F.col("form_bits") + F.coalesce("context", F.lit(0.0))
    good = both.where((bits >= F.col("least")) & (F.coalesce("name", F.lit(1.0)) >= NAMED_SHARE))
    # of an identity number with and without the letters beside it, the better known form is the right one
    fit = F.when(F.col("rank") == 1, F.col("form_bits")).otherwise(0.0)
    return good.select(*(F.col(f"a.{k}") for k in (*keys, "_row", "kind", "start_off", "end_off", "rank")), fit.alias("fit"), bits.alias("bits"))


def _apart(spans: list[dict]) -> list[dict]:
    """Disclosed spans of a text that do not overlap, in order: those of lower rank first, then the longer ones."""
    taken: list[dict] = []
    edges: list[int] = []  # starts of the taken spans, in order
    for x in sorted(spans, key=lambda x: (x["rank"], -x["fit"], x["start_off"] - x["end_off"], x["start_off"])):
        k = bisect_right(edges, x["start_off"])
        if (k == 0 or taken[k - 1]["end_off"] <= x["start_off"]) and (k == len(taken) or taken[k]["start_off"] >= x["end_off"]):
            edges.insert(k, x["start_off"])
            taken.insert(k, x)
    return taken


def generalise(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by the placeholder of its kind."""
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], PLACEHOLDER[kind]]
        last = b
    return "".join(out) + text[last:]


def found_spans(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``_row`` and ``spans`` (kind, start_off, end_off; apart from one another, in order) of every text with any."""
    kinds = {k: texts.schema[k].dataType.simpleString() for k in keys}
    good = disclosed(proposals(texts, keys, text), keys)
    lists = good.groupBy(*keys, "_row").agg(F.collect_set(F.struct("rank", "fit", "start_off", "end_off", "kind")).alias("spans"))

    def make():
        def step(cols):
            spans = [[{"kind": x["kind"], "start_off": x["start_off"], "end_off": x["end_off"]} for x in _apart(xs)] for xs in cols["spans"]]
            yield {k: cols[k] for k in (*keys, "_row")} | {"spans": spans}

        return step

    return arrow_map(lists, make, ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", _row bigint, spans array<struct<kind:string,start_off:int,end_off:int>>")


def personal(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The ``keys``, ``sanitized`` and ``spans`` (kind, start_off, end_off) of every text that holds personal information;
    the corpus that tells is these very texts.

    Null, empty and blank texts give no row, texts without personal information neither; repeated
    rows give one each; other columns are left out.
    """
    kinds = {k: texts.schema[k].dataType.simpleString() for k in keys}
    found = found_spans(texts, keys, text)
    rows = texts.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"), F.xxhash64(text).alias("_row")).alias("t")
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"f.{k}")) for k in (*keys, "_row")]
    both = rows.join(found.alias("f"), same).select(*(F.col(f"t.{k}") for k in keys), "_text", "spans")

    def make():
        def step(cols):
            out = [generalise(t, [(x["start_off"], x["end_off"], x["kind"]) for x in xs]) for t, xs in zip(cols["_text"], cols["spans"])]
            yield {k: cols[k] for k in (*keys, "spans")} | {"sanitized": out}

        return step

    return arrow_map(both, make, ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", sanitized string, spans array<struct<kind:string,start_off:int,end_off:int>>")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, column in (("studentor_partner", "text_1"), ("dataset_v6_r30", "resume_lem")):
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("src"), F.col("row_id").cast("long").alias("row_id"), F.col(column).alias("text"))
        parts.append(rows.where("row_id is not null and text is not null").dropDuplicates(["row_id"]))
    return materialize(parts[0].unionByName(parts[1]), "texts")


def p3_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal(_texts(spark, sf_dir), ["src", "row_id"]).select("src", "row_id", "sanitized")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_spans(_texts(spark, sf_dir), ["src", "row_id"])
    return found.select("src", "row_id", F.explode("spans").alias("s")).select("src", "row_id", "s.kind", "s.start_off", "s.end_off")


QUERIES = {"p3_found": p3_found, "p3_sanitized": p3_sanitized}
SQL: dict[str, str] = {}
