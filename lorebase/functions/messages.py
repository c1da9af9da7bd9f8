"""Column expressions over the JSON text of session records. All of them stay in the JVM (Variant)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identifier(col: Column | str) -> Column:
    """Comparable form of an identifier: no surrounding blanks, lower case; blank counts as missing."""
    c = F.lower(F.trim(F.col(col) if isinstance(col, str) else col))
    return F.when(c != "", c)


def with_identifiers(df: DataFrame) -> DataFrame:
    return df.withColumns({"session_id": identifier("sessionId"), "msg_id": identifier("uuid"), "parent_id": identifier("parentUuid")})


def parsed(col: str) -> Column:
    """Variant of a JSON text, NULL if it cannot be read. JSON that was encoded twice is decoded twice."""
    once = f"try_parse_json({col})"
    # only a text that begins with a quote can be a string that holds JSON again
    return F.expr(f"CASE WHEN ltrim({col}) LIKE '\"%' THEN try_parse_json(try_variant_get({once}, '$', 'string')) ELSE {once} END")


def content_text(variant: str, glue: str = "\n") -> Column:
    """Text of a message: its content if that is a string, else the text of its text blocks, joined by glue.

    NULL if there is none or if it is blank. A single block in place of an array counts as one block.
    """
    content = f"try_variant_get({variant}, '$.content', 'variant')"
    return F.expr(f"""
      CASE substr(schema_of_variant({content}), 1, 5)
        WHEN 'STRIN' THEN try_variant_get({variant}, '$.content', 'string')
        WHEN 'ARRAY' THEN array_join(transform(filter(try_variant_get({variant}, '$.content', 'array<variant>'),
              b -> try_variant_get(b, '$.type', 'string') = 'text'), b -> try_variant_get(b, '$.text', 'string')), {glue!r})
        WHEN 'OBJEC' THEN CASE WHEN try_variant_get({variant}, '$.content.type', 'string') = 'text'
              THEN try_variant_get({variant}, '$.content.text', 'string') END
      END""")


def not_blank(col: Column | str) -> Column:
    """True if the text holds anything but white space (NULL counts as blank)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))
