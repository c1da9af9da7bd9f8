"""Embedding of texts by a pluggable provider, and the context an extractor sees around a chunk."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.operators.ordinals import previous
from lorebase.session import cut

BATCH = 100
Provider = Callable[[Sequence[str]], Sequence[Sequence[float] | None]]


def hashing_provider(size: int = 64) -> Provider:
    """Offline provider: signed hashes of the words, scaled to length one; a text without words has no vector."""

    def embed(texts: Sequence[str]) -> list[list[float] | None]:
        out = []
        for text in texts:
            v = np.zeros(size)
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % size] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return out

    return embed


def embedded(df: DataFrame, key: str, text: str, provider: Provider, batch: int = BATCH, attempts: int = 3, delay: float = 1.0, passing: tuple[type[Exception], ...] = (OSError, TimeoutError)) -> DataFrame:
    """(key, embedding, error): vectors of the texts in calls of at most batch texts, in order.

    A call that fails in one of the passing ways is repeated up to attempts times, after delay seconds and twice as long
    each time; any other failure is final. The texts of a failed call have no vector but the failure's text as error, and
    the job goes on. Null and empty texts have neither.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list = [None] * len(b)
            errors: list = [None] * len(b)
            at = [i for i, t in enumerate(b["__text"]) if t]
            for start in range(0, len(at), batch):
                part = at[start : start + batch]
                for attempt in range(1, attempts + 1):
                    try:
                        for i, v in zip(part, provider([b["__text"].iloc[i] for i in part]), strict=True):
                            out[i], errors[i] = v, None
                        break
                    except Exception as failure:
                        for i in part:
                            out[i], errors[i] = None, f"{type(failure).__name__}: {failure}"
                        if attempt == attempts or not isinstance(failure, passing):
                            break
                        time.sleep(delay * 2 ** (attempt - 1))
            yield pd.DataFrame({key: b["__key"], "embedding": out, "error": errors})

    return df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInPandas(run, f"{key} long, embedding array<float>, error string")


def reembedded(chunks: DataFrame, provider: Provider, text: str = "raw_content", **how) -> tuple[DataFrame, DataFrame]:
    """chunks with the provider's vectors in place of theirs, and (conversation_id, texts, vectors, outcome): a
    conversation is embedded if any of its texts got a vector, failed if it has texts and none did, else empty."""
    made = cut(embedded(chunks, "id", text, provider, **how))
    out = chunks.drop("embedding").join(made.select("id", "embedding"), "id", "left")
    has = F.coalesce(F.length(text) > 0, F.lit(False))
    counts = out.groupBy("conversation_id").agg(F.count_if(has).alias("texts"), F.count("embedding").alias("vectors"))
    outcome = F.when(F.col("vectors") > 0, "embedded").when(F.col("texts") > 0, "failed").otherwise("empty")
    return out, counts.withColumn("outcome", outcome)


def with_neighbours(df: DataFrame, group: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Adds prev_<column> and next_<column> of the rows before and after in the group, by the unique whole number order."""
    before = previous(df, [group], order, columns)
    renamed = {f"prev_{c}": f"__p_{c}" for c in columns}
    back = before.withColumnsRenamed(renamed).withColumn("__neg", -F.col(order))
    after = previous(back, [group], "__neg", columns).withColumnsRenamed({f"prev_{c}": f"next_{c}" for c in columns})
    return after.withColumnsRenamed({v: k for k, v in renamed.items()}).drop("__neg")


def model_version(model: str, prompt: Column, schema: str = "") -> Column:
    """Name of a model with a digest of the prompt it was given and of the schema its answer must have."""
    return F.concat(F.lit(f"{model}-"), F.substring(F.sha2(F.concat(prompt, F.lit("\n"), F.lit(schema)), 256), 1, 12))
