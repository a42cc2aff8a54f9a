"""Personal information in free text: found, and replaced by typed placeholders.

A text passes through transducers that rewrite it while keeping, for every character of the result, the span of
source characters it came from: look-alike and compatibility characters become plain ones, invisible ones
vanish, runs of spelled digits become digits, at and dot disguises become "@" and ".". Detectors run on the
rewritten text; what they find is mapped back and cut out of the source, so the rest of the text stays as it is.

All state is per text: whole texts are read, there is no state between rows, and the only shared table is the list of
known name parts (checked to be at most ``MOST_NAMES``).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_NAMES = 1_000_000
KINDS = ("email", "street_address", "identity_number", "phone", "name")  # earlier kinds win where spans overlap

# Letters of other scripts that look like Latin ones.
_LOOK = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαοινρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTYXIJSaoivpABEZHIKMNOPTYX", strict=True))
# Dashes.
_LOOK |= dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2212\ufe63\uff0d", "-")
# Digit words of the four languages.
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


@dataclass
class Traced:
    """A rewritten text; character i stands for source[start[i]:end[i]]. None: the identity."""

    text: str
    start: list[int] | None = None
    end: list[int] | None = None

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])

    def rewrite(self, pattern: re.Pattern, by) -> Traced:
        """Matches replaced by ``by(match)``; each new character stands for the whole match, or for its share if equally long."""
        parts, start, end, at = [], [], [], 0
        first = self.start if self.start is not None else range(len(self.text))
        last = self.end if self.end is not None else range(1, len(self.text) + 1)
        for m in pattern.finditer(self.text):
            new = by(m)
            if new is None:
                continue
            a, b = m.span()
            parts += [self.text[at:a], new]
            start += first[at:a]
            end += last[at:a]
            if len(new) == b - a:
                start += first[a:b]
                end += last[a:b]
            else:
                start += [first[a]] * len(new)
                end += [last[b - 1]] * len(new)
            at = b
        if not parts:
            return self
        parts.append(self.text[at:])
        return Traced("".join(parts), [*start, *first[at:]], [*end, *last[at:]])


_OTHER = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
_INVISIBLE = "\xad\u200b\u200c\u200d\u2060\ufeff"
_DIGIT_RUN = re.compile(rf"(?i)\b(?:{'|'.join(_DIGITS)})(?:[ ,-]{{1,2}}(?:{'|'.join(_DIGITS)})){{5,}}\b")
# Endings of domains by which spoken addresses are told from other uses of "at" and "dot".
_ENDINGS = "com|org|net|edu|gov|info|example|invalid|test|io|dev|eu|de|at|ch|fr|be|es|it|nl|uk|us|ca|au|in|mx|ar"
_SPOKEN = re.compile(
    rf"(?i)(?<![\w.@-])[\w+%-]+(?:(?:\.| dot | punkt | punto | point )[\w+%-]+)*(?: at | arroba | ät | chez )"
    rf"[a-z0-9-]+(?:(?:\.| dot | punkt | punto | point )[a-z0-9-]+)*(?:\.| dot | punkt | punto | point )(?:{_ENDINGS})(?![\w-]|\.\w)"
)
_MAIL_CUE = re.compile(r"(?i)(?:mail|write|reach|contact|address|schreib|écri|correo|adresse)\w*(?: \w+){0,3}[:,]? ?\Z")
_AT_WORDS, _DOT_WORDS = {"at", "arroba", "ät", "chez"}, {"dot", "punkt", "punto", "point"}
_AT = re.compile(r"[ ]?(?:[\[({<]\s?(?i:at|arroba|ät|chez)\s?[\])}>])[ ]?| AT (?=\S+(?: DOT |\.)\S)| @ |(?<=\w) @(?=\w)|(?<=\w)@ (?=\w+\.\w)")
_DOT = re.compile(r"[ ]?[\[({<]\s?(?i:dot|punkt|punto|point)\s?[\])}>][ ]?|(?<=\w) DOT (?=\w)")


def _plain_character(m: re.Match) -> str:
    c = m.group()
    if c in _INVISIBLE:
        return ""
    return _LOOK.get(c) or unicodedata.normalize("NFKC", c)


def plain(text: str) -> Traced:
    """Compatibility and look-alike characters made plain, invisible ones removed."""
    return Traced(text) if text.isascii() else Traced(text).rewrite(_OTHER, _plain_character)


def spelled(traced: Traced, words: list[str]) -> Traced:
    """Runs of at least six spelled digits as digits; ``words``: those of the text in lower case."""
    if sum(w in _DIGITS for w in words) < 6:
        return traced
    return traced.rewrite(_DIGIT_RUN, lambda m: "".join(_DIGITS[w.lower()] for w in re.findall(r"\w+", m.group())))


def _spoken(m: re.Match) -> str | None:
    """A spoken address with signs for its words; None where nothing but "at" and a dotted name says that it is one."""
    local, domain = re.split(r"(?i) (?:at|arroba|ät|chez) ", m.group(), maxsplit=1)
    said = re.search(r"(?i) (?:dot|punkt|punto|point) ", m.group())
    if not said and not re.search(r"[._+\d]", local) and not _MAIL_CUE.search(m.string, max(0, m.start() - 60), m.start()):
        return None
    return re.sub(r"(?i) (?:dot|punkt|punto|point) ", ".", f"{local}@{domain}")


def undisguised(traced: Traced, words: list[str]) -> Traced:
    """"at" and "dot" in their disguises as @ and point; also spoken in lower case, where an ending of a domain closes the address."""
    at, dot = not _AT_WORDS.isdisjoint(words), not _DOT_WORDS.isdisjoint(words)
    if dot:
        traced = traced.rewrite(_DOT, lambda m: ".")
    if at or "@" in traced.text:
        traced = traced.rewrite(_AT, lambda m: "@")
    return traced.rewrite(_SPOKEN, _spoken) if at else traced


_L = r"[^\W\d_]"
_WORD = rf"{_L}(?:{_L}|['’](?={_L}))*(?:-{_L}{{2,}})*"
_LOCAL = re.compile(r"[\w*](?:[\w.+%*-]*[\w*])?\Z")
_DOMAIN = re.compile(r"(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w-])")

_PHONE_CUE = re.compile(
    r"(?i)(?<!\w)(?:call(?: me)?(?: on| at)?|(?:reach|ring|dial|phone|text)(?: me| us)?(?: on| at)?|number|my number is|hotline|text|tel|tél|telefon|teléfono|téléphone|phone|mobile|móvil|handy|cell|fax|whatsapp|"
    r"ich bin unter|unter|rufen sie|rufnummer|mobil|estoy en el|llamen al|llame al|llámame al|appelez(?:-moi)? (?:le|au)|je réponds au|joignable au|contact)\b[.:]{0,2} ?:? ?\Z"
)
_INTERNATIONAL = r"(?:\(\+\d{1,3}\)|\+\d{1,3}|00\d{2})[ ./-]?(?:\(\d{1,4}\)[ ./-]?)?\d(?:[ ./-]?\d){5,11}"
_NATIONAL = r"\(\d{2,5}\)[ ./-]?\d(?:[ ./-]?\d){4,9}|\d(?:[ ./-]?\d){6,12}"
_CUED_PHONE = re.compile(rf"(?<![\w+(])(?:{_INTERNATIONAL}|{_NATIONAL})(?![\w])")
_FREE_PHONE = re.compile(
    rf"(?<![\w.,/+(=#-])(?:{_INTERNATIONAL}|(?:1[ .-])?(?:\([2-9]\d\d\) ?|[2-9]\d\d[-. ])[2-9]\d\d[-.]\d{{4}}|0\d(?:[ .]\d\d){{4}}|0\d{{2,4}}[ /-]\d{{3,4}}[ -]\d{{3,4}})(?![\w-]|\.\d)"
)
_NO_PHONE = re.compile(r"(?i)(?:part no\.?|ticket|order|batch|build|case|max|limit ?=|version|request id|checksum|=) ?$")

# What stands before an identity number.
_ID_CUES = (
    "passport", "pasaporte", "passeport", "reisepass", "ssn", "social security", "tax id", "id", "identity card", "personalausweis", "ausweisnummer", "ausweis", "steuer-id",
    "steuernummer", "sozialversicherungsnummer", "dni", "nie", "nif", "número de identidad", "documento de identidad", "número de la seguridad social", "sécurité sociale",
    "d'identité", "d’identité", "numéro fiscal", "insurance",
)
_ID_GAP = re.compile(r"(?i)\b(?:[ ]?(?:number|card|no\.?|nr\.?|n\.?[º°o]|num\.?|is|ist|es|est|lautet|[:#=]))*[ ]?")
_ID = re.compile(r"(?:[A-Z]{1,3}\d[\dA-Z]{5,}|[A-Z]{1,3}(?: \d+)+(?: [A-Z])?|\d[\d]*(?:[ .-]\d+)*(?:-?[A-Z])?)(?![\w])")

_STREET_EN = (
    r"street|st\.|st|road|rd|lane|ln|drive|dr|way|avenue|ave|terrace|close|court|ct|boulevard|blvd|place|square|crescent|row|grove|gardens|parkway|highway|mews"
)
_ADDRESSES = (
    re.compile(rf"(?i)(?<![\w.,/-])\d{{1,5}}[a-z]?,? (?:(?:north|south|east|west|[nsew]\.) )?(?!(?:road|street|way) )(?:{_WORD} )(?:{_STREET_EN})(?!\w)"),
    # several words before the kind of street, each with a capital letter
    re.compile(rf"(?<![\w.,/-])\d{{1,5}}[a-zA-Z]?,? (?:[A-ZÀ-ÖØ-Þ](?:{_L}|['’](?={_L})|\.)*[ -]){{2,4}}(?i:{_STREET_EN})(?!\w)"),
    re.compile(
        rf"(?i)(?<![\w.,/-])\d{{1,5}}[a-z]?(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|bd|boulevard|chemin|place|allée|impasse|quai|route|cours|square|passage)"
        rf"(?: (?:de la|de l['’]|des|de|du|d['’]|les|la|le))* ?(?<=[ '’]){_WORD}"
    ),
    re.compile(
        rf"(?i)(?<!\w)(?:calle|c/|plaza|pza\.|avda\.?|avenida|paseo|camino|ronda|travesía|carrer)(?: (?:de la|de los|de las|del|de))* {_WORD},?(?: (?:n\.?[º°o]|núm\.?))? \d{{1,5}}(?: ?(?:bis|[a-z]))?(?!\w)"
    ),
)
_GERMAN_KINDS = ("straße", "strasse", "str.", "weg", "platz", "gasse", "allee", "ring", "damm", "ufer", "chaussee")
_GERMAN_NUMBER = re.compile(r"(?i) \d{1,4}(?: ?[a-z])?(?!\w)")
_SPANISH_KINDS = ("calle", "c/", "plaza", "pza.", "avda", "avenida", "paseo", "camino", "ronda", "travesía", "carrer")
_GERMAN_LEAD = re.compile(rf"(?i)(?<!\w)(?:(?:am|an der|zum|zur|auf dem|auf der|unter den) )?(?:{_L}|-)+\Z|(?<!\w)(?:am|an der|zum|zur|auf dem|auf der) (?=\Z)")

_TITLE = r"(?:(?i:dr|prof|mr|mrs|ms|mx|herr|frau|mme|mlle|sra|sr|ing|dipl|don|doña)\.? )*"
_PARTICLE = r"(?:(?i:van der|van den|van|von der|von|zu|de la|de las|de los|del|de|der|den|di|da|dos|du|le|la|el|al|bin|ter) |(?i:d|l)['’])*"
_NAME = rf"(?:{_L}\. ?(?:{_L}\. ?)*{_PARTICLE}{_WORD}|{_WORD}, {_WORD}(?: {_L}\.)?|{_WORD} (?:{_L}\. )*{_PARTICLE}{_WORD})"
# Phrases that introduce a person. After a strong one any two words are a name.
_STRONG = (
    "my name is", "i spoke with", "i spoke to", "thanks to", "assigned to", "reviewer:", "reviewed by", "author:", "ich heiße", "mein name ist", "zugewiesen an", "danke an", "dank an",
    "je m'appelle", "je m’appelle", "merci à", "attribué à", "me llamo", "mi nombre es", "gracias a", "asignado a", "--",
)
_WEAK = ("laut", "selon", "según", "contact:", "thank you", "signed", "signed by", "i am called")
_CLOSINGS = (
    "best regards", "kind regards", "warm regards", "regards", "sincerely", "cheers", "mit freundlichen grüßen", "viele grüße", "beste grüße", "cordialement", "bien à vous", "un saludo",
    "saludos", "atentamente",
)
_SAYS = (" wrote", " writes", " said", " says", " schrieb", " schreibt", " sagt", " a écrit", " écrit", " escribió", " escribe", " dice")
_AFTER_CLOSING = re.compile(r",?[ \t>]*\r?\n[> \t]*(?:\r?\n[> \t]*)?")
_TITLES = re.compile(rf"[ ,]*{_TITLE}")
_COLON = re.compile(r" ?:")
_NAME_BEFORE = re.compile(rf"(?<![\w.@-])(?:{_TITLE})(?P<name>{_NAME})\Z")
_NAME_AT = re.compile(_NAME)
_INITIALS = re.compile(rf"(?<![\w.@-])(?!e\.g\.|i\.e\.|z\.[bB]\.|d\.h\.|u\.a\.|[ap]\.m\.)(?:{_L}\. ?)+{_PARTICLE}\Z")
_NO_FAMILY = re.compile(rf"(?i:{_STREET_EN})(?!\w)")
_PRODUCT = re.compile(r"[ ](?i:studio|server|cluster|core|gateway|suite|cloud|engine|platform)\b")


# Words after which two capitalised words are a person, in the four languages.
_BEFORE_PERSON = frozenset(
    "by ask tell asked told met colleague friend manager boss teammate coworker wife husband brother sister neighbour neighbor kollege kollegin freund freundin chef chefin "
    "collègue ami amie colega amigo amiga compañero compañera jefe jefa".split()
)
# More ways to close a letter.
_MORE_CLOSINGS = re.compile(r"(?i)(?<!\w)(?:yours (?:truly|sincerely|faithfully)|sincerely yours|all the best|many thanks|best wishes|liebe grüße|herzliche grüße|amicalement|bien cordialement|un abrazo|cordialmente)(?=,?[ \t>]*\r?\n)")
_CAPITALISED = rf"(?:(?![A-ZÀ-ÖØ-Þ]+\b)[A-ZÀ-ÖØ-Þ]{_L}+(?:['’-][A-ZÀ-ÖØ-Þ]?{_L}+)*)"
_SHAPED = re.compile(rf"(?<![\w.@/-])(?P<cue>{_L}+):? (?P<name>{_CAPITALISED}(?: [A-ZÀ-ÖØ-Þ]\.)* {_PARTICLE}{_CAPITALISED})(?![\w@_-])")
_ENGLISH_ENDING = re.compile(r"(?i)(?:ing|tion|ment|ness|able|ible|ware|base|work|ity)$")


def _any_known(name: str, known: dict[str, str]) -> bool:
    return any(w.lower() in known for w in re.findall(_L + "+", name))


def _folded(text: str) -> str:
    """Lower case of the same length."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(low if len(low := c.lower()) == 1 else c for c in text)


def _ends(lower: str, phrases: tuple[str, ...]) -> Iterator[int]:
    """Where the phrases end in a text, if no word character or hyphen stands before them."""
    for phrase in phrases:
        at = lower.find(phrase)
        while at >= 0:
            if not at or not (lower[at - 1].isalnum() or lower[at - 1] in "_-"):
                yield at + len(phrase)
            at = lower.find(phrase, at + 1)


def _back(text: str, end: int, more: str = "") -> int:
    """Where the run of word characters and ``more`` that ends at ``end`` begins; of any length."""
    at = end
    while at and (text[at - 1].isalnum() or text[at - 1] == "_" or text[at - 1] in more):
        at -= 1
    return at


def _words_back(text: str, end: int, words: int) -> int:
    """Where the ``words`` space-separated words before ``end`` begin; a name with titles and particles has no more than a dozen."""
    at = end
    for _ in range(words):
        at = text.rfind(" ", 0, at)
        if at < 0:
            return 0
    return at


def emails(base: Traced, words: list[str]) -> Iterator[tuple[int, int]]:
    traced = undisguised(base, words)
    text, at = traced.text, traced.text.find("@")
    while at >= 0:
        local, domain = _LOCAL.match(text, _back(text, at, ".+%*-"), at), _DOMAIN.match(text, at + 1)
        if local and domain:
            yield traced.source(local.start(), domain.end())
        at = text.find("@", at + 1)


def addresses(base: Traced, lower: str) -> Iterator[tuple[int, int]]:
    for pattern in _ADDRESSES[:-1] if not any(k in lower for k in _SPANISH_KINDS) else _ADDRESSES:
        for m in pattern.finditer(base.text):
            yield base.source(*m.span())
    for m in _GERMAN_NUMBER.finditer(base.text):
        if not lower.endswith(_GERMAN_KINDS, 0, m.start()):
            continue
        kind = next(k for k in _GERMAN_KINDS if lower.endswith(k, 0, m.start()))
        end = m.start() - len(kind)
        lead = _GERMAN_LEAD.search(base.text, max(0, _back(base.text, end, "-") - 12), end)  # the run whole, and "unter den" before it
        if lead:
            yield base.source(lead.start(), m.end())


def _enough(found: str, least: int, most: int) -> bool:
    return least <= sum(c.isdigit() for c in found) <= most


def phones(base: Traced, words: list[str]) -> Iterator[tuple[int, int]]:
    """Windows before a number are longer than the longest cue."""
    traced = spelled(base, words)
    text = traced.text
    for m in _CUED_PHONE.finditer(text):
        if _enough(m.group(), 7, 15) and _PHONE_CUE.search(text, max(0, m.start() - 40), m.start()):
            yield traced.source(*m.span())
    for m in _FREE_PHONE.finditer(text):
        if _enough(m.group(), 9, 15) and not _NO_PHONE.search(text, max(0, m.start() - 14), m.start()):
            yield traced.source(*m.span())


def identity_numbers(base: Traced, lower: str) -> Iterator[tuple[int, int]]:
    for end in _ends(lower, _ID_CUES):
        gap = _ID_GAP.match(base.text, end)
        m = gap and _ID.match(base.text, gap.end())
        if m and _enough(m.group(), 6, 18):
            yield base.source(*m.span())


def names(base: Traced, lower: str, known: dict[str, str], words: list[str]) -> Iterator[tuple[int, int]]:
    """Names after or before phrases that introduce persons; anywhere pairs of known name parts, initials before a known family name, a
    known given name before another capitalised word, and two capitalised words, neither a product nor a common word's ending, after a word for a person or one that takes one."""
    text = base.text

    def person(a: int, b: int) -> bool:
        return not _PRODUCT.match(text, b) and not _PRODUCT.search(text, a, b)

    for phrases, strong in ((_STRONG, True), (_WEAK, False)):
        for end in _ends(lower, phrases):
            m = not text[end : end + 1].isalnum() and _NAME_AT.match(text, _TITLES.match(text, end).end())
            if m and person(*m.span()) and (strong or m.group()[0].isupper() or _any_known(m.group(), known)):
                yield base.source(*m.span())
    for end in _ends(lower, _CLOSINGS):
        line = _AFTER_CLOSING.match(text, end)
        m = line and _NAME_AT.match(text, _TITLES.match(text, line.end()).end())
        if m and person(*m.span()):
            yield base.source(*m.span())
    for phrase in _SAYS:
        at = lower.find(phrase)
        while at >= 0:
            m = _COLON.match(text, at + len(phrase)) and _NAME_BEFORE.search(text, _words_back(text, at, 12), at)
            if m and person(*m.span("name")):
                yield base.source(*m.span("name"))
            at = lower.find(phrase, at + 1)
    for found in _MORE_CLOSINGS.finditer(text) if "\n" in text else ():
        line = _AFTER_CLOSING.match(text, found.end())
        m = line and _NAME_AT.match(text, _TITLES.match(text, line.end()).end())
        if m and person(*m.span()) and m.group()[0].isupper():
            yield base.source(*m.span())
    if not _BEFORE_PERSON.isdisjoint(words):
        for m in _SHAPED.finditer(text):
            parts = re.findall(_L + "+", m["name"])
            common = any(_ENGLISH_ENDING.search(w) and w.lower() not in known for w in parts) or _NO_FAMILY.fullmatch(parts[-1])
            if m["cue"].lower() in _BEFORE_PERSON and not common and person(*m.span("name")):
                yield base.source(*m.span("name"))
    for word in known.keys() & set(words):
        for m in re.finditer(rf"(?<![\w@./+-]){word}(?!\w)", lower):
            initials = known[word] == "family" and _INITIALS.search(text, _words_back(text, m.start(), 8), m.start())
            if initials and person(initials.start(), m.end()) and text[m.end() : m.end() + 1] not in ("@", "_"):
                yield base.source(initials.start(), m.end())
            pair = _NAME_AT.match(text, m.start())
            words = re.findall(_L + "{2,}", pair.group()) if pair else []
            parts = [w.lower() for w in words]
            both = len(parts) > 1 and {known[word], *(known.get(p) for p in parts[1:])} >= {"given", "family"}
            given = len(parts) > 1 and known[word] == "given" and "," not in pair.group() and words[0].istitle() and words[-1].istitle() and parts[-1] not in known
            if both or (given and not _NO_FAMILY.fullmatch(words[-1])):
                if person(*pair.span()) and text[pair.end() : pair.end() + 1] not in ("@", "_"):
                    yield base.source(*pair.span())


def find_personal(text: str, known: dict[str, str]) -> list[tuple[int, int, str]]:
    """(start, end, kind) in ``text``, ordered, without overlaps."""
    base = plain(text)
    digits = any(c.isdigit() for c in base.text)
    lower = _folded(base.text)
    words = re.findall(_L + "+", lower)
    found = [(s, "email") for s in emails(base, words)]
    if digits:
        found += [(s, "street_address") for s in addresses(base, lower)] + [(s, "identity_number") for s in identity_numbers(base, lower)]
    found += [(s, "phone") for s in phones(base, words)]
    found += [(s, "name") for s in names(base, lower, known, words)]
    rank = {k: i for i, k in enumerate(KINDS)}
    taken: list[tuple[int, int, str]] = []
    used = bytearray(len(text))
    for (a, b), kind in sorted(found, key=lambda f: (rank[f[1]], f[0][0], -f[0][1])):
        if a < b and not any(used[a:b]):
            used[a:b] = b"\x01" * (b - a)
            taken.append((a, b, kind))
    return sorted(taken)


def known_parts(names_table: DataFrame | None) -> dict[str, str]:
    """Lower-case name part to kind (given, family); a part of both kinds counts as given."""
    if names_table is None:
        return {}
    rows = names_table.where("name_part is not null and part_kind is not null").select(F.lower("name_part").alias("p"), F.lower("part_kind").alias("k")).distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} known name parts")
    known: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: r["k"]):
        known[r["p"]] = r["k"]
    return known


def personal_passages(df: DataFrame, key: str, text: str, names_table: DataFrame | None = None) -> DataFrame:
    """(key, kind, found_text, start, end): passages of each text in source characters (code points from 0).

    Null and empty texts give none; texts of any length are read whole; repeated rows give repeated passages. Extra
    columns are ignored. ``names_table``: (name_part, part_kind).
    """
    shared = df.sparkSession.sparkContext.broadcast(known_parts(names_table))

    def find(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, kind, t[a:b], a, b) for k, t in zip(batch["_k"], batch["_t"], strict=True) for a, b, kind in find_personal(t, shared.value)]
            yield pd.DataFrame(rows, columns=["_k", "kind", "found_text", "start", "end"])

    kind = dict(df.select(F.col(key).alias("_k")).dtypes)["_k"]
    rows = df.where(F.length(text) > 0).select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    return rows.mapInPandas(find, f"_k {kind}, kind string, found_text string, start int, end int").withColumnRenamed("_k", key)


def redact(df: DataFrame, text: str, names_table: DataFrame | None = None, out: str = "redacted") -> DataFrame:
    """``df`` with ``out``: the text with passages replaced by [EMAIL], [PHONE] and so on; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(known_parts(names_table))

    def replaced(t: str) -> str:
        parts, at = [], 0
        for a, b, kind in find_personal(t, shared.value):
            parts += [t[at:a], f"[{kind.upper()}]"]
            at = b
        return "".join([*parts, t[at:]])

    masked = F.pandas_udf(lambda s: s.map(replaced, na_action="ignore"), "string")
    return df.withColumn(out, masked(F.col(text)))
