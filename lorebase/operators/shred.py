"""Adjacency-table shredding of nested JSON records.

Every value of a record becomes one row (node, parent, label, ordinal, kind, scalar): ``node`` counts the values of its
record in document order, ``parent`` is the node of the enclosing object or array, ``label`` the field name,
``ordinal`` the place in the parent. Entity tables come from joining object nodes with their scalar children and
pivoting the labels; both meet on (record, node), so the join and the pivot are one aggregation that Spark combines
before the exchange.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_FIELDS = (("node", T.IntegerType()), ("parent", T.IntegerType()), ("label", T.StringType()), ("ordinal", T.IntegerType()), ("kind", T.StringType()), ("path", T.StringType()), ("scalar", T.StringType()))
_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}


def read_json(text: str):
    """Value of a JSON text; a string that itself holds JSON is decoded once more. ValueError if unreadable."""
    value = json.loads(text)
    if isinstance(value, str):
        try:
            inner = json.loads(value)
        except ValueError:
            return value
        return inner if isinstance(inner, (dict, list)) else value
    return value


def walk(text: str, wanted: frozenset[str] | None) -> Iterator[tuple]:
    """Nodes of one record in document order. wanted: paths to emit (None: all); numbering does not depend on it."""
    try:
        root = read_json(text)
    except (ValueError, RecursionError):
        yield (0, None, None, 0, "invalid", "", None)
        return
    count, stack = 0, [(root, None, None, 0, "")]
    while stack:
        value, parent, label, ordinal, path = stack.pop()
        node, kind = count, _KINDS[type(value)]
        count += 1
        if kind == "object":
            below = [(v, node, k, i, f"{path}.{k}" if path else k) for i, (k, v) in enumerate(value.items())]
            scalar = None
        elif kind == "array":
            inner = path + "[]"
            below = [(v, node, None, i, inner) for i, v in enumerate(value)]
            scalar = None
        else:
            below = ()
            scalar = value if kind == "string" else None if value is None else json.dumps(value)
        if wanted is None or path in wanted:
            yield (node, parent, label, ordinal, kind, path, scalar)
        stack.extend(reversed(below))


def shred(df: DataFrame, keys: Sequence[str], json_col: str, paths: Sequence[str] | None = None) -> DataFrame:
    """Adjacency table of json_col: keys plus node, parent, label, ordinal, kind, path and scalar.

    keys identify the record and are carried along. Null texts give no node, the empty or unreadable text one node of
    kind ``invalid``, repeated rows repeated nodes. paths limits the output (``content[].id``; '' is the root), as a
    projection limits columns. Columns besides keys and json_col are not read, so their names cannot clash.
    """
    wanted = None if paths is None else frozenset(paths)
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(n, t) for n, t in NODE_FIELDS)])
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            texts = batch.column(batch.num_columns - 1)
            for i in range(batch.num_rows):
                for row in walk(texts[i].as_py(), wanted):
                    at.append(i)
                    rows.append(row)
            if not rows:
                continue
            picked = pa.array(at, pa.int32())
            own = [batch.column(k).take(picked) for k in range(len(keys))]
            nodes = [pa.array([_plain(x) for x in col] if kind == pa.string() else col, kind) for col, kind in zip(zip(*rows), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*own, *nodes], names=[f.name for f in schema])

    return df.filter(F.col(json_col).isNotNull()).select(*keys, F.col(json_col).alias("__json")).mapInArrow(run, schema)


def _plain(text: str | None) -> str | None:
    """Lone surrogates, which JSON escapes allow, cannot be stored as UTF-8."""
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode()


def entities(nodes: DataFrame, keys: Sequence[str], paths: Sequence[str], labels: Sequence[str], raw: Sequence[str] = ()) -> DataFrame:
    """Flat table of the objects at paths: keys, node, parent, ordinal and one column per label with the scalar child's
    text (NULL where a child is missing, null or nested; ``kind_<label>`` tells which for labels in raw)."""
    children = [f"{p}.{name}" if p else name for p in paths for name in labels]
    here = F.col("path").isin(list(paths)) & (F.col("kind") == "object")
    rows = nodes.filter(here | F.col("path").isin(children)).withColumn("__node", F.when(here, F.col("node")).otherwise(F.col("parent")))
    child = lambda name, what: F.max(F.when(~here & (F.col("label") == name), F.col(what)))
    pivot = rows.groupBy(*keys, "__node").agg(
        F.max(here).alias("__here"),
        F.max(F.when(here, F.col("parent"))).alias("parent"),
        F.max(F.when(here, F.col("ordinal"))).alias("ordinal"),
        *(child(name, "scalar").alias(name) for name in labels),
        *(child(name, "kind").alias(f"kind_{name}") for name in raw),
    )
    return pivot.filter("__here").drop("__here").withColumnRenamed("__node", "node")
