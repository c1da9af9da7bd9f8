"""Text analysis: analysers, keyword ranking and trigram similarity."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STOP_WORDS = frozenset(
    "a about above after again all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers "
    "him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own same she should so some such than that the their theirs them then there these "
    "they this those through to too under until up very was we were what when where which while who whom why will with you your yours".split()
)


def simple_tokens(col: Column | str) -> Column:
    """Lower-case runs of letters and digits, in order, with repeats."""
    c = F.lower(F.col(col) if isinstance(col, str) else col)
    return F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda t: t != "")


# Porter's algorithm (1980), from the published description


def _measure(stem: str) -> int:
    return len(re.findall("V+C+", _shape(stem)))


def _shape(word: str) -> str:
    out = []
    for i, c in enumerate(word):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "C")
        out.append("V" if vowel else "C")
    return "".join(out)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "C"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "CVC" and word[-1] not in "wxy"


_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def _swap(word: str, rules: str) -> str:
    for rule in sorted(rules.split(), key=lambda r: -len(r.split(":")[0])):
        end, put = rule.split(":")
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + put if _measure(stem) > 0 else word
    return word


@functools.lru_cache(maxsize=1 << 16)
def porter_stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            stem = word[: -len(end)]
            if word.endswith(end) and "V" in _shape(stem):
                if stem.endswith(("at", "bl", "iz")):
                    word = stem + "e"
                elif _double(stem) and stem[-1] not in "lsz":
                    word = stem[:-1]
                else:
                    word = stem + "e" if _measure(stem) == 1 and _cvc(stem) else stem
                break
    if word.endswith("y") and "V" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2), _STEP3)
    for end in sorted([*_STEP4.split(), "ion"], key=lambda e: -len(e)):
        if word.endswith(end):
            stem = word[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _cvc(stem)):
            word = stem
    if _measure(word) > 1 and _double(word) and word[-1] == "l":
        word = word[:-1]
    return word


def english_terms(text: str) -> list[str]:
    return [porter_stem(t) for t in re.findall(r"[^\W_]+", text.lower()) if t not in STOP_WORDS]


@F.pandas_udf(T.ArrayType(T.StringType()))
def english_tokens(texts: pd.Series) -> pd.Series:
    """Stems of the words that are no stop words; NULL stays NULL."""
    return texts.map(lambda t: None if t is None else english_terms(t))


def all_terms(tokens: Column, terms: list[str]) -> Column:
    """Whether every term occurs; no terms match nothing."""
    return F.size(F.array_except(F.array(*map(F.lit, terms)), tokens)) == 0 if terms else F.lit(False)


def _equals(term: str):
    return lambda t: t == F.lit(term)


def bm25(docs: DataFrame, tokens: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """docs with n_terms (length), and score: Robertson-Zaragoza BM25 of the query terms.

    Collection statistics are one aggregate row over all docs, joined as a scalar; term frequencies are counted in place.
    """
    sized = docs.withColumn("n_terms", F.size(tokens).cast("long"))
    for i, term in enumerate(terms):
        sized = sized.withColumn(f"__tf{i}", F.size(F.filter(tokens, _equals(term))))
    stats = sized.agg(F.count("*").alias("__n"), F.avg("n_terms").alias("__avg"), *(F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(terms))))
    scored = sized.join(F.broadcast(stats), F.lit(True))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"__tf{i}"), F.col(f"__df{i}")
        idf = F.log(1 + (F.col("__n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n_terms") / F.col("__avg")))
    return scored.withColumn("score", score).drop("__n", "__avg", *(f"__tf{i}" for i in range(len(terms))), *(f"__df{i}" for i in range(len(terms))))


def trigrams(col: Column | str) -> Column:
    """Distinct trigrams of the lower-case words, each word padded by two blanks before and one after."""
    words = simple_tokens(col)
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared over all of two sets given as arrays; 0 if both are empty."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    return jaccard(trigrams(a), trigrams(b))
