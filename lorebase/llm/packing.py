"""Filling fixed-capacity containers by minimum bin slack.

Each container takes the longest item left and then, by a bitset subset-sum over the lengths still available, the
combination that fills it best; the items are removed and the next container follows. Items are packed in random
groups of bounded size, one task each; what ends in badly filled containers is packed again across groups, until
it fits into one group. Nothing is split but items above the capacity.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.session import cut

CAPACITY = 2_048
GROUP_ROWS = 20_000
SPARE = 0.02  # a container with more unused space than this is packed again, as long as there are several groups


@lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """Byte-pair encoder of a public vocabulary in rank format; path None is the package's 50k one."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, tokens) of every text that is neither null nor blank; the whole text is encoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        for b in batches:
            yield pd.DataFrame({key: b["__key"], "tokens": [len(coder.encode_ordinary(t)) for t in b["__text"]]})

    rows = docs.filter(F.col(text).rlike(r"(?U)\S")).select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    return rows.mapInPandas(run, f"{key} long, tokens long")


def pieces(sizes: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, piece, start, tokens): one row per item, several of at most the capacity for an item above it."""
    whole = F.col("tokens") <= capacity
    number = F.when(whole, 1).otherwise(F.ceil(F.col("tokens") / capacity))
    out = sizes.filter("tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), number.cast("long") - 1)))
    return out.select(key, F.col("piece").cast("int"), (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("piece") * capacity).alias("tokens"))


def fullest(free: int, lengths: list[int], counts: dict[int, int]) -> list[tuple[int, int]]:
    """(length, times) of a combination of available items whose sum is the largest that is at most free."""
    mask, reach, layers = (1 << (free + 1)) - 1, 1, []
    for length in lengths:
        if length > free:
            continue
        left, lump = min(counts[length], free // length), 1
        while left:
            take = min(lump, left)
            layers.append((reach, length, take))
            reach = (reach | reach << length * take) & mask
            left -= take
            lump *= 2
        if reach >> free & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for before, length, take in reversed(layers):
        if not before >> at & 1:
            chosen.append((length, take))
            at -= length * take
    return chosen


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, by minimum bin slack. Items of equal size are taken in their order."""
    by_size: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        by_size.setdefault(int(sizes[i]), []).append(i)
    counts = {length: len(items) for length, items in by_size.items()}
    lengths = sorted(by_size, reverse=True)
    out, number = np.zeros(len(sizes), dtype=np.int64), 0
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        for length, times in [(longest, 1), *fullest(capacity - longest, [x for x in lengths if counts[x]], counts)]:
            for _ in range(times):
                out[by_size[length].pop()] = number
            if length != longest:
                counts[length] -= times
            else:
                counts[length] = len(by_size[length])
        lengths = [x for x in lengths if by_size[x]]
        number += 1
    return out


def _packer(key: str, capacity: int, turn: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([key, "piece"], kind="stable")
        tokens = group["tokens"].to_numpy()
        number = pack(tokens, capacity)
        used = np.bincount(number, weights=tokens).astype(np.int64)
        container = (turn << 56) + (group["__g"].to_numpy().astype(np.int64) << 24) + number
        return group.assign(container=container, used=used[number]).drop(columns="__g")

    return run


def packed(items: DataFrame, key: str, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """items(key, piece, start, tokens) with container: a number shared by items whose tokens sum to at most capacity.

    Items of no tokens should be left out before; repeated keys are items of their own; an empty table gives no row.
    """
    schema = f"{key} long, piece int, start long, tokens long, container long, used long"
    done, rest, turn, total = [], items, 0, items.count()
    while True:
        groups = max(1, -(-total // group_rows))

        # the spread over groups changes with the turn, so leftovers of one group do not meet again
        spread = rest.withColumn("__g", F.pmod(F.xxhash64(key, "piece", F.lit(turn)), F.lit(groups)).cast("long"))
        now = cut(spread.groupBy("__g").applyInPandas(_packer(key, capacity, turn), schema))
        if groups == 1:
            done.append(now)
            break
        loose = F.col("used") < capacity * (1 - SPARE)
        done.append(now.filter(~loose))
        rest = now.filter(loose).select(key, "piece", "start", "tokens")
        left = rest.count()
        if not left:
            break
        if left > 0.95 * total:  # hardly a container was filled better, as when all items are longer than half
            done.append(now.filter(loose))
            break
        total, turn = left, turn + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("used")
