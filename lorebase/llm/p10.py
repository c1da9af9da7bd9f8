"""Queries of problem 10, text quality statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorebase.llm.quality import NAMES, WORDS, junk, profiles, prose_shares, tails
from lorebase.session import cut
from lorebase.sources.tables import table


def documents(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", "text", "lang")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return junk(documents(spark, root)).select("doc_id")


def p10_statistics(spark: SparkSession, root: str) -> DataFrame:
    return profiles(documents(spark, root))


def p10_prose(spark: SparkSession, root: str) -> DataFrame:
    return prose_shares(documents(spark, root))


def p10_scores(spark: SparkSession, root: str) -> DataFrame:
    scored = tails(cut(profiles(documents(spark, root))))
    return scored.select("doc_id", "language", *(f"z_{n}" for n in NAMES))


QUERIES = {f.__name__: f for f in (p10_found, p10_prose, p10_statistics, p10_scores)}

_COMMON = ", ".join(f"'{w}'" for w in sorted(WORDS))
SQL = {
    "p10_statistics": rf"""WITH d AS (SELECT doc_id, text, regexp_extract(lower(trim(coalesce(lang, ''))), '^([a-z]{{2,3}})\b', 1) AS tag, regexp_replace(text, '[\s\p{{Z}}]', '', 'g') AS solid FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, regexp_extract_all(lower(text), '\p{{L}}+(?:[''’]\p{{L}}+)?') AS words,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda x: x <> '') AS lines FROM d WHERE solid <> '')
SELECT doc_id, CASE WHEN tag = '' THEN 'und' ELSE tag END AS language, len(words)::DOUBLE AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::DOUBLE / greatest(1, len(words)) AS mean_word_length,
    length(regexp_replace(solid, '[\p{{L}}\d]', '', 'g'))::DOUBLE / length(solid) AS symbol_ratio,
    (length(solid) - length(regexp_replace(solid, '\d', '', 'g')))::DOUBLE / length(solid) AS digit_ratio,
    len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…:;]["\x{{27}}”’»)\]*_`]*$')))::DOUBLE / len(lines) AS ending_share,
    len(list_filter(words, lambda x: list_contains([{_COMMON}], x)))::DOUBLE / greatest(1, len(words)) AS common_share,
    1 - len(list_distinct(words))::DOUBLE / greatest(1, len(words)) AS repeat_share
FROM w""",
}
