"""Per-document text quality statistics, the tails of their distributions, and the texts that are mostly not prose.

Statistics are computed once per text, whole texts always, and for each of its passages (what blank lines part). Their
distributions are kept as mergeable KLL quantile sketches per language. A passage is no prose where one of its statistics
lies in the lower tail: a robust z-score, against the median and the median absolute deviation of the body of its
language and of all languages, beyond the usual cut of 3.5 for such scores. The body is found on the sketch itself: it
starts at the upper of the two modes and grows until no quantile outside lies within the cut, so that junk, whatever its
share, does not widen the scale. There is no fixed threshold for any statistic.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.session import cut

# Common words by language, without articles, which lists and menus use as well.
COMMON = {
    "en": "of and to in is it that was for on with as be this but not we are or from by have has had were they if there will would can no do my your out up about what when which then than them their our been some only also am i you an before at because until who whether still must could every since after so all any nor there while said here very each other over under without beside during once named according",
    "de": "und ist nicht ich es wir zu in mit sich auf für war wie aber so noch nur auch bei nach wenn aus oder hat haben am im von was dass als man doch seit denn sollten",
    "fr": "de et est que il je nous pas en dans pour ce se qui du au avec sur sont mais ne on plus par ou été si cette avant était me aucun rien à bien comme moins",
    "es": "de y es que no en por con se lo al del para me mi su como más pero si ya son fue hay porque ha cuando estaba solo desde sin muy",
}
WORDS = frozenset(w for words in COMMON.values() for w in words.split())

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_GAP = re.compile(r"\n[^\S\n]*\n")
_ENDING = re.compile(r"[.!?…:;][\"'”’»)\]*_`]*$")
_MARKER = re.compile(r"^[^\S\n]*(?:[-+*•>]+|[a-z]\)|o|[ivx]+\.)[^\S\n]+", re.M)
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")

NAMES = ("n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "ending_share", "common_share", "repeat_share")
SCHEMA = "__key long, " + ", ".join(f"{n} double" for n in NAMES) + ", language string"


PASSAGE = ("common", "letters", "variety")
FLOORS = {"common": 0.05, "letters": 0.05, "variety": 0.5}  # smallest scale of a statistic, so that a uniform corpus puts nothing infinitely far
CUT = 3.5  # modified z-scores beyond this are outliers (Iglewicz and Hoaglin, 1993)
LEVELS = 256
LEAST = 200  # passages a language needs for a body of its own
LEARNED = 100  # common words learned for a language without a list, each in a share of LEARNED_SHARE of its texts at least
LEARNED_SHARE = 0.1


def passages(text: str, common: frozenset[str]) -> list[tuple[int, float, float, float]]:
    """(solid, common, letters, variety) of each passage: its non-blank characters, the share of common words (with half
    a word added on either side, as is usual for shares of few), the share of letters among non-blank characters, and
    the binary logarithm of its number of different words."""
    out = []
    for part in _GAP.split(text):
        solid = len("".join(part.split()))
        if solid:
            words = _WORD.findall(_MARKER.sub("", part.lower()))
            n = len(words)
            out.append((solid, (sum(map(common.__contains__, words)) + 0.5) / (n + 1), sum(map(len, words)) / solid, math.log2(len(set(words)) or 1)))
    return out


def statistics(text: str, common: frozenset[str] = WORDS) -> tuple[float, ...]:
    """The statistics of a text in the order of NAMES; a blank text has zeros."""
    solid = len("".join(text.split()))
    if not solid:
        return (0.0,) * len(NAMES)
    words = _WORD.findall(text.lower())
    n = max(1, len(words))
    lines = [line for line in map(str.strip, text.split("\n")) if line]
    letters, digits = sum(map(len, _LETTERS.findall(text))), sum(map(len, _DIGITS.findall(text)))
    return (
        float(len(words)),
        sum(map(len, words)) / n,
        (solid - letters - digits) / solid,
        digits / solid,
        sum(bool(_ENDING.search(line)) for line in lines) / len(lines),
        sum(map(common.__contains__, words)) / n,
        1 - len(set(words)) / n,
    )


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(k, *statistics(t), tag) for k, t, tag in zip(batch["__key"], batch["__text"], batch["language"], strict=True)]
        yield pd.DataFrame(rows, columns=["__key", *NAMES, "language"])


def language(col: str = "lang"):
    """Language of a tag: lower case, without region or variant; ``und`` where it is missing or no tag."""
    tag = F.regexp_extract(F.lower(F.trim(F.coalesce(col, F.lit("")))), r"^([a-z]{2,3})\b", 1)
    return F.when(tag == "", F.lit("und")).otherwise(tag)


def profiles(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per text that is neither null nor blank: key, language and the statistics of NAMES.

    Repeated rows give repeated profiles, an empty table none; other columns are not read. The key must be a whole number.
    """
    rows = docs.filter(F.col(text).rlike(r"(?U)\S")).select(F.col(key).cast("long").alias("__key"), language(lang).alias("language"), F.col(text).alias("__text"))
    measured = rows.mapInPandas(_run, SCHEMA)
    return measured.select(F.col("__key").alias(key), "language", *NAMES)


def sketches(measured: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """KLL sketches of each statistic per language, and of all languages together under '*' by merging them."""
    own = measured.groupBy("language").agg(*(F.kll_sketch_agg_double(n).alias(n) for n in names))
    every = own.select(F.lit("*").alias("language"), *names).groupBy("language").agg(*(F.kll_merge_agg_double(n).alias(n) for n in names))
    return own.unionByName(every)


def tails(measured: DataFrame, names: tuple[str, ...] = NAMES, floor: float = 0.05) -> DataFrame:
    """measured with z_<name>, the robust z-score within the language, and g_<name>, that against all languages.

    The median absolute deviation is read off the sketch as half the distance between the quartiles, and is at least
    floor times the larger of 1 and the median, so that a statistic most documents share does not make every other
    value infinitely far.
    """
    at = sketches(measured, names)
    quart = at.select("language", *(F.kll_sketch_get_quantile_double(n, F.lit(q)).alias(f"{n}_{k}") for n in names for k, q in (("a", 0.25), ("m", 0.5), ("b", 0.75))))
    # one row per language tag; their number follows the tags of the world, not the rows
    own = quart.filter("language <> '*'")
    every = quart.filter("language = '*'").drop("language").select(*(F.col(c).alias(f"all_{c}") for c in quart.columns if c != "language"))
    joined = measured.join(own, "language").join(F.broadcast(every), F.lit(True))

    def z(name: str, prefix: str):
        m, spread = F.col(f"{prefix}{name}_m"), (F.col(f"{prefix}{name}_b") - F.col(f"{prefix}{name}_a")) / 2
        return (F.col(name) - m) / F.greatest(1.4826 * spread, floor * F.greatest(F.lit(1.0), F.abs(m)))

    return joined.select(*measured.columns, *(z(n, "").alias(f"z_{n}") for n in names), *(z(n, "all_").alias(f"g_{n}") for n in names))


def learned_words(docs: DataFrame, text: str, lang: str) -> dict[str, frozenset[str]]:
    """Common words of the languages without a list: the LEARNED words that most texts have in lines shaped like a sentence,
    in a tenth of those texts at least and in two.

    Texts of the listed languages and of no language are not read. Words are counted once a text and combined before the
    exchange; what comes to the driver is LEARNED words a language, and tags have two or three letters.
    """
    rows = docs.select(language(lang).alias("language"), F.col(text).alias("text")).filter(~F.col("language").isin([*COMMON, "und"]) & F.col("text").isNotNull())
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\s*\p{Lu}[^\d|;={}<>\[\]_]*[.!?]\P{L}*$") & (F.size(F.split(F.trim(x), r"\s+")) >= 5))
    own = rows.select("language", F.array_distinct(F.regexp_extract_all(F.lower(F.array_join(lines, " ")), F.lit(r"(\p{L}+)"), F.lit(1))).alias("words"))
    own = own.filter(F.size("words") > 0)
    total = own.groupBy("language").agg(F.count("*").alias("total"))
    counts = own.select("language", F.explode("words").alias("word")).groupBy("language", "word").agg(F.count("*").alias("n")).join(F.broadcast(total), "language")
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.col("n").desc(), "word"))
    top = counts.filter(F.col("n") >= F.greatest(F.lit(2), F.col("total") * LEARNED_SHARE)).withColumn("place", place).filter(F.col("place") <= LEARNED)
    found: dict[str, set[str]] = {}
    for row in top.select("language", "word").collect():
        found.setdefault(row.language, set()).add(row.word)
    return {k: frozenset(v) for k, v in found.items()}


def passage_rows(docs: DataFrame, key: str, text: str, lang: str, learned: dict[str, frozenset[str]]) -> DataFrame:
    """__key, language and the array of passages of every text that is neither null nor blank; nothing moves."""
    known = {k: v | WORDS for k, v in learned.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[dict(zip(("solid", *PASSAGE), p, strict=True)) for p in passages(t, known.get(tag, WORDS))] for t, tag in zip(batch["__text"], batch["language"], strict=True)]
            yield pd.DataFrame({"__key": batch["__key"], "language": batch["language"], "parts": rows})

    rows = docs.filter(F.col(text).rlike(r"(?U)\S")).select(F.col(key).cast("long").alias("__key"), language(lang).alias("language"), F.col(text).alias("__text"))
    return rows.mapInPandas(run, "__key long, language string, parts array<struct<solid:int,common:double,letters:double,variety:double>>")


def body(levels: np.ndarray, floor: float, cut_: float = CUT) -> tuple[float, float]:
    """Median and scale of the body of a distribution given by its quantiles at equal steps.

    The body starts at the upper of the two groups that differ most (Otsu, 1979) and takes in what lies less than cut_
    scales below its median until it stays the same; the scale is the median absolute deviation as half the distance
    of the quartiles, made comparable to a standard deviation, and at least floor.
    """
    q = np.sort(levels)
    n = len(q)
    below = np.cumsum(q)[:-1]
    size = np.arange(1, n)
    gap = size * (n - size) * ((q.sum() - below) / (n - size) - below / size) ** 2
    low = q[int(gap.argmax()) + 1] if n > 1 and gap.max() > 0 else q[0]
    for _ in range(n):
        inside = q[q >= low]
        a, m, b = np.quantile(inside, (0.25, 0.5, 0.75))
        scale = max(floor, 1.4826 * (b - a) / 2)
        if (after := m - cut_ * scale) == low:
            break
        low = after
    return float(m), float(scale)


def bodies(parts: DataFrame) -> DataFrame:
    """(language, n, <name>_m, <name>_s): median and scale of the body of each statistic, per language and under '*'.

    parts: language and the statistics of PASSAGE. One row a language tag, of which there are at most 18,278.
    """
    at = sketches(parts, PASSAGE)
    ranks = F.array(*(F.lit((i + 0.5) / LEVELS) for i in range(LEVELS)))
    levels = at.select("language", F.kll_sketch_get_n_double("common").alias("n"), *(F.kll_sketch_get_quantile_double(n, ranks).alias(n) for n in PASSAGE))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(tag, n, *(x for name, q in zip(PASSAGE, qs, strict=True) for x in body(np.array(q, dtype=float), FLOORS[name]))) for tag, n, *qs in zip(b["language"], b["n"], *(b[x] for x in PASSAGE), strict=True)]
            yield pd.DataFrame(rows, columns=["language", "n", *(f"{x}_{k}" for x in PASSAGE for k in "ms")])

    return levels.mapInPandas(fit, "language string, n long, " + ", ".join(f"{x}_{k} double" for x in PASSAGE for k in "ms"))


def in_tail(part: Column, prefix: str) -> Column:
    """Whether a statistic of the passage lies in the lower tail of the body with this prefix."""
    lies = [(part[x] - F.col(f"{prefix}{x}_m")) / F.col(f"{prefix}{x}_s") < -CUT for x in PASSAGE]
    return lies[0] | lies[1] | lies[2]


def prose_shares(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, language, prose_share): the share of a text's non-blank characters in passages that lie in no tail.

    A passage must lie in the tail of all languages and in that of its own language, if the latter has a body of prose:
    a list of common words, at least LEAST passages, and a third of the common words all languages have at least, so
    that a tag under which there is nothing but junk has none. Null and blank texts have no row.
    """
    learned = learned_words(docs, text, lang)
    rows = cut(passage_rows(docs, key, text, lang, learned))
    flat = rows.select("language", F.explode("parts").alias("p")).select("language", *(F.col(f"p.{x}").alias(x) for x in PASSAGE))
    fitted = cut(bodies(flat))
    every = fitted.filter("language = '*'").select(*(F.col(f"{x}_{k}").alias(f"all_{x}_{k}") for x in PASSAGE for k in "ms"))
    own = fitted.filter(F.col("language").isin([*COMMON, *learned]) & (F.col("n") >= LEAST)).drop("n")
    # both sides hold one row a language tag at most
    met = rows.join(F.broadcast(every), F.lit(True)).join(F.broadcast(own), "language", "left")
    has_own = F.coalesce(F.col("common_m") >= F.col("all_common_m") / 3, F.lit(False))
    prose = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + F.when(in_tail(p, "all_") & (~has_own | in_tail(p, "")), 0).otherwise(p["solid"]))
    solid = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["solid"])
    return met.select(F.col("__key").alias(key), "language", (prose / solid).alias("prose_share"))


def junk(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, language, prose_share) of the texts of which more than half lies in passages in the tails.

    Repeated rows give repeated results, an empty table none; columns but the three named are not read.
    """
    return prose_shares(docs, key, text, lang).filter(F.col("prose_share") < 0.5)
