"""Personal information in free text: found under its disguises and replaced by typed placeholders.

Two transducers rewrite a text and keep, for every character they put out, the place of its source: one maps homoglyphs
to the letters they imitate and drops invisible characters, the other turns spelled digits into digits and at/dot
disguises into signs. Detectors run on the result; their spans are mapped back, so the text around stays as it was.

Names are found by form and context: titles, initials, and pairs of capitalised words neither of which the texts use as
an ordinary word. What is ordinary, which words are followed by many different family names (given names, wherever they
come from), and which pairs are fixed phrases is counted over all texts first (``Lexicon``); a short list of common given
names serves where there is nothing to count.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.names import SHORT
from lorebase.llm.quality import WORDS
from lorebase.session import cut

KINDS = ("email", "phone", "id_number", "street_address", "person_name")

# letters of other scripts and the Latin letters they look like
LOOKALIKE = dict(zip("аеорсхуіјѕԁһԛԝАВЕКМНОРСТХУІЈЅαοενικυρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcxyijsdhqwABEKMHOPCTXYIJSaoevikupABEZHIKMNOPTYX", strict=True))
INVISIBLE = frozenset("​‌‍⁠﻿­")
DASHES = dict.fromkeys("‐‑‒–—−", "-") | {" ": " ", " ": " ", " ": " "}

# digits as words; one language to a line
SPOKEN = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "plus": "+",
}
_DIGIT = "|".join(sorted(SPOKEN, key=len, reverse=True))
_SPOKEN = re.compile(rf"\b(?:{_DIGIT})(?:[\s,\-]+(?:{_DIGIT})){{6,}}\b", re.I)
_ONE = re.compile(_DIGIT, re.I)
_AT = r"\s*[(\[{<]\s*(?:at|ät|arroba|arobase)\s*[)\]}>]\s*"
_DOT = r"\s*[(\[{<]\s*(?:dot|punkt|punto|point)\s*[)\]}>]\s*|\s+(?:dot|punkt|punto)\s+"
_LABEL = r"[^\W_](?:[\w\-]*[^\W_])?"
_DISGUISED = re.compile(rf"(?P<local>\w[\w.+\-]*)(?P<at>{_AT}|\s+@\s+|\s+at\s+|\s+arroba\s+)(?P<domain>{_LABEL}(?:(?:\.|{_DOT}){_LABEL})+)", re.I)
_DOTS = re.compile(_DOT, re.I)
_SPOKEN_SIGNS = frozenset("dot punkt punto arroba".split())
_HINT = re.compile(r"[(\[{<]\s*(?:at|ät|arroba|arobase|dot|punkt|punto|point)\s*[)\]}>]|\s@\s|\b(?:dot|punkt|punto|arroba)\b", re.I)



class Mapped:
    """A rewritten text with the source span of each of its characters."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end = text, None, None

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put strings in place of spans; a span's characters all stand for the whole span."""
        if not edits:
            return
        start = self.start if self.start is not None else list(range(len(self.text)))
        end = self.end if self.end is not None else list(range(1, len(self.text) + 1))
        parts, new_start, new_end, at = [], [], [], 0
        for a, b, put in edits:
            parts += [self.text[at:a], put]
            new_start += start[at:a] + [start[a]] * len(put)
            new_end += end[at:a] + [end[b - 1]] * len(put)
            at = b
        parts.append(self.text[at:])
        self.text, self.start, self.end = "".join(parts), new_start + start[at:], new_end + end[at:]


def plain_letter(c: str) -> str:
    """What a character imitates: lookalikes, wide and styled forms and dashes; accented letters stay."""
    if c in LOOKALIKE:
        return LOOKALIKE[c]
    if c in DASHES:
        return DASHES[c]
    if c in INVISIBLE:
        return ""
    if c in "ªº":
        return c
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and wide.isascii() else c


def normalised(text: str, words: set[str] | None = None) -> Mapped:
    """The text without disguises. Lookalikes are only read as Latin in words that also have Latin letters."""
    out = Mapped(text)
    if not text.isascii():
        edits = []
        for m in re.finditer(r"\S+", text):
            word = m.group()
            if word.isascii():
                continue
            latin = any(c.isascii() and c.isalpha() for c in word)
            edits += [(m.start() + i, m.start() + i + 1, p) for i, c in enumerate(word) if ord(c) > 127 and (latin or c not in LOOKALIKE) and (p := plain_letter(c)) != c]
        edits += [(m.start(), m.end(), " ") for m in re.finditer("[   ]", text)]
        out.replace(sorted(set(edits)))
    if words is None or out.start is not None:
        words = set(_WORD.findall(out.text.lower()))
    if not words.isdisjoint(SPOKEN) and _SPOKEN.search(out.text):
        out.replace([(m.start(), m.end(), "".join(SPOKEN[d.lower()] for d in _ONE.findall(m.group()))) for m in _SPOKEN.finditer(out.text)])
    if (not words.isdisjoint(_SPOKEN_SIGNS) or any(c in out.text for c in "([{<@")) and _HINT.search(out.text):
        edits = []
        for m in _DISGUISED.finditer(out.text):
            spoken_at = m["at"].strip().lower() in ("at", "arroba")
            if spoken_at and not _DOTS.search(m["domain"]):
                continue
            edits.append((m.start("at"), m.end("at"), "@"))
            edits += [(m.start("domain") + d.start(), m.start("domain") + d.end(), ".") for d in _DOTS.finditer(m["domain"])]
        out.replace(edits)
    return out


EMAIL = re.compile(r"(?<![\w.+\-])[\w](?:[\w.+\-]*[\w+])?@(?:[^\W_](?:[\w\-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w@])")
IDS = re.compile(
    r"""\b\d{3}([-\ ])\d{2}\1\d{4}\b                                        # 3-2-4
    |\b[A-Z]{2}\ ?\d{2}\ ?\d{2}\ ?\d{2}\ ?[A-D]\b                           # two letters, six digits, a letter
    |\b(?:\d{8}|[XYZ]-?\d{7})-?[A-Z]\b                                       # eight digits and a check letter
    |\b\d{4}\ \d{5}\ \d\b                                                   # 4-5-1
    |\b[A-Z]\d{3}-\d{4}-\d{4}\b                                              # letter and digits in fours
    |\bMRN[-\ ]?\d{5,}\b
    |\b[12]\ ?\d{2}\ ?(?:0[1-9]|1[0-2])\ ?\d{2}\ ?\d{3}\ ?\d{3}\ ?\d{2}\b""",
    re.X,
)
_CUE = (
    r"(?:passport|reisepass|passeport|pasaporte|driv(?:er|ing)(?:['’]?s)?\s+licen[cs]e|führerschein\w*|permis|tax\s+(?:file\s+|id\s*|identification\s+)?(?:number|no|id)|\bTFN\b|steuer-?\s?(?:id|nummer|identifikationsnummer)"
    r"|social\s+(?:security|insurance)|\bSSN\b|national\s+(?:insurance|id|identity)|\bNI\b|\bDNI\b|\bNIE\b|\bNIF\b|\bNHS\b|medicare|health\s+(?:card|insurance)|patient(?:en)?(?:\s+|-)?(?:number|no|nummer|id)|personalausweis\w*|identity\s+card|insurance\s+number)"
)
# every cue has one of these stems in it, or one of these words
_ID_STEMS = ("passport", "reisepass", "passeport", "pasaporte", "licen", "führerschein", "permis", "tax", "steuer", "social", "national", "medicare", "health", "patient", "personalausweis", "identity", "insurance")
_ID_WORDS = frozenset("tfn ssn ni dni nie nif nhs".split())
ID_SAID = re.compile(
    _CUE + r"[^\n;!?]{0,24}?[\s(:#]((?=[A-Z\d\- ]*\d)[A-Z]{0,3}-?\d(?:[\d \-/]{4,16})\d[A-Z]?|(?-i:(?=[A-Z]*\d[A-Z]*\d)[A-Z][A-Z\d]{5,11}))(?![\w])",
    re.I,
)
ACCOUNT = re.compile(r"(?<![\w.\-])[A-Z]{2}\d{2}(?:\ ?[A-Z\d]{4}){2,7}(?:\ ?[A-Z\d]{1,3})?(?![\w])")
CARD = re.compile(r"(?<![\w.\-+])\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?![\w]|[.\-]\d)")


def sound_account(text: str) -> bool:
    """Whether the check digits of an international account number hold (remainder 1 by 97)."""
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def sound_card(text: str) -> bool:
    """Whether the last digit of a card number is its check digit (Luhn)."""
    digits = [int(c) for c in text if c.isdigit()]
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0



PHONE = re.compile(
    r"""(?<![\w.+/\-])(?:
      \+\d{1,3}[\ .\-]?(?:\(0\)[\ ]?)?(?:\(\d{1,4}\)[\ ]?)?\d(?:[\ .\-/]?\d){5,12}
     |\(\d{3}\)\ ?\d{3}[-.\ ]\d{4}
     |\d{3}([-.])\d{3}\1\d{4}
     |\d{3}\ \d{3}\ \d{4}
     |\(0\d{1,4}\)[\ \-/]?\d(?:[\ \-/]?\d){5,9}
     |0[1-9]\d{0,3}[\ /\-]\d{2,8}(?:[\ \-/]?\d{2,5}){0,4}
     |0[1-9]\d{7,10}
    )(?![\w]|[-/.]\d|\ ?%)""",
    re.X,
)
_STREET = r"street|st|road|rd|lane|ln|avenue|ave|boulevard|blvd|terrace|crescent|drive|court|close|place|way|square|parade|highway|row|grove"
ADDRESS = re.compile(
    rf"""\b(?:(?:no\.?|flat|unit|apt\.?|apartment|suite)\s*\d*[a-z]?[,/]?\s*)?\d{{1,5}}[a-z]?,?\s+(?P<name>(?:[^\W\d_][\w'’\-]*\s+){{1,3}})(?:(?:{_STREET})\b|(?:st|rd|ave|blvd|ln)\.)(?:,?\s(?:apt|unit|flat|suite)\.?\s?\d+[a-z]?\b)?
    |\b(?:(?-i:[A-ZÄÖÜ])[\w\-]*\s)?[^\W\d_][\w\-]*(?:straße|strasse|str\.)\s*\d{{1,4}}(?:\s?[a-z]\b)?
    |\b[A-ZÄÖÜ][\w\-]+(?:weg|platz|allee|gasse)\s\d{{1,4}}[a-z]?\b
    |\b(?:calle|avenida|avda\.?|plaza|paseo|via|viale)\s+(?:[^\W\d_][\w'’.\-]*\s+){{1,4}}\d{{1,5}}(?:,\s*\d+º\s?\w?)?
    |\b\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|chemin|allée|impasse|quai|place)\s+(?:(?:de|du|des|la|le)\s+|d'|l')*[^\W\d_][\w'’\-]*(?:\s(?-i:[A-Z])[\w'’\-]*)*""",
    re.X | re.I,
)
# words that no street name consists of
NOT_STREET = frozenset("of and the a an to in on at is are was for by with from behind before after main more times minutes hours days weeks months years people commits rows bytes percent other small big new good way different or than as it not we you i that this of's only each per out into over under next last first".split())

# given names common in the four languages
GIVEN = frozenset(SHORT) | frozenset("anna maria laura sarah emma hannah john paul mark mary linda karen ruth clara sofia lucia carmen jose juan carlos luis miguel pedro pablo javier diego hans klaus jürgen stefan markus wolfgang monika petra sabine pierre jean marie claire sophie camille luc antoine".split())
NICK = frozenset(s for short in SHORT.values() for s in short.split()) - frozenset("al ant dot drew hen".split())
TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Doctor|Sir|Frau|Herr|Mme|Mlle|Monsieur|Madame|Señora?|Sra|Sr|Doña|Don)"
TITLES = frozenset(re.findall(r"\w+", TITLE.replace("ñora?", "ñora señor").lower())) | {"señor", "señora"}
KNOWN = GIVEN | NICK
_SINGLE = re.compile(r"\b[A-Z]\.")
_NAME = r"[^\W\d_a-zà-ÿ][^\W\d_]+(?:[-'’][^\W\d_]+)*"
TITLED = re.compile(rf"\b{TITLE}\b\.?\s+(?:{_NAME}\s+|[A-Z]\.\s*)*{_NAME}")
INITIALLED = re.compile(rf"(?<![\w.'’])(?<![\dº]\s)(?<!\b[A-Z]\s)[A-Z]\.\s?(?:[A-Z]\.\s?)?({_NAME})")
PAIR = re.compile(r"(?<![\w@.])([^\W\d_]{2,})(\s+)(?:[A-Za-z]\.?\s+)?([^\W\d_]{3,}(?:[-'’][^\W\d_]+)*)")
CAPITALS = re.compile(r"(?<![\w@.'’\-])([A-ZÀ-ÖØ-Þ][^\W\d_A-ZÀ-ÖØ-Þ]+)[ \t]+(?=([A-ZÀ-ÖØ-Þ][^\W\d_]+(?:[-'’][^\W\d_]+)*))")
TURNED = re.compile(r"(?<![\w@.])([^\W\d_]{3,}(?:[-'’][^\W\d_]+)*),\s+([^\W\d_]{2,}|[A-Z]\.)(?![\w@])")
_WORD = re.compile(r"[^\W\d_]+")
# what may stand after a given name, or open a sentence after an initial, and is no family name
NOT_FAMILY = frozenset(
    "said says told came comes called calls asked asks wants wanted lives lived went goes and or but the who whose is was were has had have will would can could does did do not also at in on of for from to with about when where that this thought thinks feels felt wrote writes likes liked prefers needs needed made makes took takes got gets gave gives kept keeps left back again today yesterday tomorrow then there here "
    "honestly correction however maybe perhaps please thanks every what why how if it its he she they we you his her their my our your since after before because while as so no yes one two three der die das und ist war hat sagt le la les et est el los las es un una que pero por".split()
)

# closed-class words that open a sentence or a noun phrase, months and days; none is part of a name
OPENERS = NOT_FAMILY | WORDS | frozenset(
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "januar februar märz mai juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag zur zum am im beim vom meine mein meinen meiner unser unsere ihr ihre sein seine eine einen einer letzte letzten nächste dieser diese dieses jede jeder "
    "mon ma mes notre nos votre vos leur leurs son sa ses ce cette ces un une des du au aux dernier dernière mis tus sus nuestra nuestro nuestras nuestros esta este estas estos última último "
    "whether these those another both either neither many most more next last first old new early late former dear hi hello hey thanks regards best".split()
)
# what places, firms and works are called by
KINDS_OF_PLACE = frozenset("hill bend park bridge river lake valley mount mountain island beach bay harbour harbor station airport hall house hotel castle church cathedral school college university hospital clinic museum library bank trust group media housing network foundation institute robotics software logistics insurance foods transport engineering holdings company inc ltd gmbh street road city town village county club team union project studio repair guide manual edition series weg platz allee gasse straße strasse hof berg see brücke kirche".split())

# the second word of product, font and theme names that begin like a person
STYLE = frozenset("dark light mono sans serif pro neo plus max mini bold italic code theme regular black classic studio".split())
THEME = re.compile(r"\b(?:theme|project|product|package|font|palette|branch|release|plugin)s?\s+(?:called\s+|named\s+)?$", re.I)
NO_PHONE = re.compile(r"\b(?:order|ticket|build|invoice|version|serial|commit|trace|port|rate|reference|case|item)s?\b[^\n.;,]{0,12}$", re.I)


def _opens(text: str, at: int) -> bool:
    """Whether a sentence begins at this place."""
    before = text[:at].rstrip()
    return not before or before[-1] in ".!?:\n"


@dataclass(frozen=True)
class Lexicon:
    """What counting over all texts tells: words used as ordinary ones, words followed by many family names, and the
    first words of pairs that are nearly always the same two words."""

    ordinary: frozenset[str] = frozenset()
    given: frozenset[str] = frozenset()
    fixed: frozenset[str] = frozenset()


NOTHING = Lexicon()


def _plain_pair(a: str, b: str, lexicon: Lexicon) -> bool:
    """Whether two capitalised words can be a given and a family name, as far as the words themselves tell."""
    if a in OPENERS or b in OPENERS or a in lexicon.ordinary or b in lexicon.ordinary or a in TITLES:
        return False
    return not (b in STYLE or a in STYLE or a in _STREETISH or b in _STREETISH or a in KINDS_OF_PLACE or b in KINDS_OF_PLACE)


def _capital_spans(text: str, lexicon: Lexicon) -> Iterator[tuple[int, int]]:
    """Pairs of capitalised words that are no ordinary words. A run of more is a title, not a name."""
    found = [(m.start(), m.end(1), m.end(2), m.group(1).lower(), m.group(2).lower(), m.group(2)) for m in CAPITALS.finditer(text)]
    first = {x[0] for x in found}
    second = {x[2] for x in found if x[3] not in OPENERS and x[3] not in lexicon.ordinary}
    for start, middle, end, a, b, family in found:
        after = end - len(family)
        if a in lexicon.fixed or not _plain_pair(a, b, lexicon) or middle in second or (after in first and b not in lexicon.given):
            continue
        if family.isupper() or THEME.search(text, max(0, start - 24), start):
            continue
        yield start, end


def _person_spans(text: str, words: frozenset[str] | set[str], lexicon: Lexicon = NOTHING) -> Iterator[tuple[int, int]]:
    if not TITLES.isdisjoint(words):
        for m in TITLED.finditer(text):
            yield m.span()
    if _SINGLE.search(text):
        for m in INITIALLED.finditer(text):
            family = m.group(1)
            if family.lower() not in NOT_FAMILY and len(family) > 3:
                yield m.span()
    yield from _capital_spans(text, lexicon)
    known, lower = KNOWN | lexicon.given, GIVEN | lexicon.given
    if known.isdisjoint(words):
        return
    at = 0
    while (m := PAIR.search(text, at)) is not None:
        given, family = m.group(1), m.group(3)
        at = m.end(1)
        low = given.lower()
        if family.lower() in NOT_FAMILY or low not in known:
            continue
        if given[0].isupper() and family[0].isupper():
            if family.lower() not in STYLE and not THEME.search(text, max(0, m.start() - 24), m.start()) and not (low == "will" and _opens(text, m.start())):
                yield m.span()
        elif low in lower and given.islower() and family.islower() and len(family) > 4 and family not in lexicon.ordinary and family not in OPENERS:
            yield m.span()
    at = 0
    while (m := TURNED.search(text, at)) is not None:
        family, given = m.group(1), m.group(2)
        at = m.end(1)
        low = family.lower()
        if given.lower() in known and given[0].isupper() and family[0].isupper() and low not in NOT_FAMILY and low not in known and low not in lexicon.ordinary and not low.endswith("ly"):
            rest = text[m.end() : m.end() + 2]
            if not (rest[:1] == " " and rest[1:2].isupper()):
                yield m.span()


LEAST_TEXTS = 3  # texts a word or pair must be in before it tells anything, and the share of all texts, which bounds the lexicon
TEXT_SHARE = 1 / 100_000


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts in all (without a word), with each word (as written with a small letter, at all) and with each pair of capitalised words, summed within a batch."""
    for batch in batches:
        small, every, pairs = Counter(), Counter(), Counter()
        for text in batch["__text"]:
            found = set(_WORD.findall(text))
            every.update({w.lower() for w in found})
            small.update({w for w in found if w[0].islower()})
            pairs.update({(a.lower(), b.lower()) for a, b in CAPITALS.findall(text) if not b.isupper()})
        rows = [(None, None, 0, len(batch))] + [(w, None, small[w], n) for w, n in every.items()] + [(a, b, 0, n) for (a, b), n in pairs.items()]
        yield pd.DataFrame(rows, columns=["a", "b", "small", "n"])


def learned(texts: DataFrame, text: str = "text") -> Lexicon:
    """The lexicon of the texts. Counts are summed per batch and before the exchange; what comes to the driver are words
    in at least TEXT_SHARE of the texts, so their number is bounded by the words of a text, whatever the rows."""
    rows = texts.filter(F.col(text).isNotNull()).select(F.col(text).alias("__text"))
    counts = cut(rows.mapInPandas(_counted, "a string, b string, small long, n long").groupBy("a", "b").agg(F.sum("small").alias("small"), F.sum("n").alias("n")))
    total = counts.filter("a IS NULL").agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_TEXTS, math.ceil(total * TEXT_SHARE))
    ordinary = counts.filter(F.col("a").isNotNull() & F.col("b").isNull() & (F.col("small") >= least) & (3 * F.col("small") >= 2 * F.col("n"))).select(F.col("a").alias("word"))
    usual = F.broadcast(ordinary)
    pairs = counts.filter(F.col("b").isNotNull() & ~F.col("a").isin(sorted(OPENERS))).join(usual.withColumnRenamed("word", "a"), "a", "left_anti")
    no_family = sorted(STYLE | _STREETISH | KINDS_OF_PLACE | OPENERS)
    pairs = pairs.join(usual.withColumnRenamed("word", "b"), "b", "left_anti")
    heads = pairs.groupBy("a").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("kinds")).filter(F.col("n") >= least)
    fixed = heads.filter((F.col("n") >= 5) & (5 * F.col("most") >= 4 * F.col("n"))).select(F.lit("fixed").alias("what"), F.col("a").alias("word"))
    named = pairs.filter(~F.col("b").isin(no_family)).groupBy("a").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("kinds")).filter(F.col("n") >= least)
    given = named.filter((F.col("kinds") >= LEAST_TEXTS) & (2 * F.col("most") < F.col("n"))).select(F.lit("given").alias("what"), F.col("a").alias("word"))
    found: dict[str, set[str]] = {"ordinary": set(), "given": set(), "fixed": set()}
    for what, word in ordinary.select(F.lit("ordinary").alias("what"), "word").union(fixed).union(given).collect():
        found[what].add(word)
    taken = TITLES | STYLE | _STREETISH | KINDS_OF_PLACE
    return Lexicon(frozenset(found["ordinary"] - GIVEN), frozenset(found["given"] - taken), frozenset(found["fixed"] - KNOWN))


def _digits(text: str) -> int:
    return sum(map(str.isdigit, text))


_PHONEISH = re.compile(r"[+(\d][\d ().\-/]{7,}\d")
_STREETISH = frozenset(_STREET.split("|")) | frozenset("calle avenida avda plaza paseo via viale rue chemin allée impasse quai".split())
_STREET_END = re.compile(r"(?:straße|strasse|str\.|weg|platz|allee|gasse)\s*\d", re.I)
_ANY_DIGIT = re.compile(r"\d")
_LONG_NUMBER = re.compile(r"\d{4}[ \-]?\d{4}")


def detect(text: str, lexicon: Lexicon = NOTHING) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the source text, in order and apart from each other.

    The words of the text decide which detectors can find anything at all; those run over the whole text.
    """
    words = set(_WORD.findall(text.lower()))
    form = normalised(text, words)
    body = form.text
    if form.start is not None:
        words = set(_WORD.findall(body.lower()))
    spans: list[tuple[int, int, str]] = []
    masked = body

    def take(found: list[tuple[int, int]], kind: str) -> None:
        nonlocal masked
        spans.extend((*form.source(a, b), kind) for a, b in found)
        for a, b in found:
            masked = masked[:a] + "\0" * (b - a) + masked[b:]

    if "@" in body:
        take([m.span() for m in EMAIL.finditer(masked)], "email")
    if _ANY_DIGIT.search(body):
        take([m.span() for m in IDS.finditer(masked)], "id_number")
        low = masked.lower()
        if not words.isdisjoint(_ID_WORDS) or any(x in low for x in _ID_STEMS):
            take([m.span(1) for m in ID_SAID.finditer(masked) if _digits(m.group(1)) >= (5 if m.group(1)[-1].isdigit() and m.group(1)[:1].isdigit() else 3)], "id_number")
        if _LONG_NUMBER.search(masked):
            take([m.span() for m in ACCOUNT.finditer(masked) if sound_account(m.group())], "id_number")
            take([m.span() for m in CARD.finditer(masked) if sound_card(m.group())], "id_number")
        if _PHONEISH.search(masked):
            take([m.span() for m in PHONE.finditer(masked) if 9 <= _digits(m.group()) <= 15 and not NO_PHONE.search(masked, max(0, m.start() - 24), m.start())], "phone")
        if not _STREETISH.isdisjoint(words) or _STREET_END.search(masked):
            take([m.span() for m in ADDRESS.finditer(masked) if not m["name"] or NOT_STREET.isdisjoint(m["name"].lower().split())], "street_address")
    take(_merged(_person_spans(masked, words, lexicon)), "person_name")
    spans.sort()
    return spans


def _merged(found: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def redact(text: str, lexicon: Lexicon = NOTHING) -> tuple[str, int]:
    """The text with [EMAIL], [PHONE], [ID_NUMBER], [STREET_ADDRESS] and [PERSON_NAME] in place of what was found, and how many."""
    parts, at, n = [], 0, 0
    for a, b, kind in detect(text, lexicon):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
            at = b
            n += 1
    return "".join([*parts, text[at:]]), n


def kinds(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, kind): one row per text and kind it contains. Null and empty texts contain nothing."""
    lexicon = texts.sparkSession.sparkContext.broadcast(learned(texts, text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, kind) for k, t in zip(b["__key"], b["__text"], strict=True) for kind in sorted({s[2] for s in detect(t, lexicon.value)})]
            yield pd.DataFrame(rows, columns=[key, "kind"])

    return texts.filter(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text")).mapInPandas(run, f"{key} long, kind string")


def redacted(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text, found): the texts with placeholders, and how many. A null text stays null, other columns are dropped."""
    lexicon = texts.sparkSession.sparkContext.broadcast(learned(texts, text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, None, 0) if t is None else (k, *redact(t, lexicon.value)) for k, t in zip(b["__key"], b["__text"], strict=True)]
            yield pd.DataFrame(rows, columns=[key, text, "found"])

    return texts.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text")).mapInPandas(run, f"{key} long, {text} string, found int")
