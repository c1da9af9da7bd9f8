"""Evaluation passages inside training texts, by a generalised suffix automaton over words.

Passages go in blocks of about ``block_words`` words; a task builds the automaton of a block and lays it down in arrays
(about 90 bytes a word, measured in the tests). All blocks are sent to the tasks as they are and the texts are streamed through them in
one scan: the runs of known words of a batch of texts step together, and at each word the length of the longest match
that ends there is known. Blocks beyond ``scan_bytes`` of arrays make a further scan, so any number of passages can be
checked within the memory of a worker.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.session import cut

WORD = re.compile(r"[^\W_]+")
BLOCK_WORDS = 250_000
SCAN_BYTES = 512 << 20


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Automaton:
    """Generalised suffix automaton of word sequences. items(v): the sequences that contain the strings of state v."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.found: list[set[int]] = [set()]

    def _state(self, length: int, step: dict[int, int], link: int, found: set[int]) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.found.append(found)
        return len(self.step) - 1

    def _split(self, p: int, code: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q], set(self.found[q]))
        self.link[q] = clone
        while p >= 0 and self.step[p].get(code) == q:
            self.step[p][code] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, code: int) -> int:
        q = self.step[last].get(code)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, code, q)
        new, p = self._state(self.length[last] + 1, {}, 0, set()), last
        while p >= 0 and code not in self.step[p]:
            self.step[p][code] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][code]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, code, q)
        return new

    def add(self, item: int, sequence: list[str]) -> None:
        codes = [self.codes.setdefault(w, len(self.codes)) for w in sequence]
        last = 0
        for code in codes:
            last = self._extend(last, code)
        # every prefix marks its own suffixes once all states exist
        state = 0
        for code in codes:
            state, up = self.step[state][code], self.step[state][code]
            while up > 0 and item not in self.found[up]:
                self.found[up].add(item)
                up = self.link[up]

    def compact(self, least: int = 1) -> Compact:
        """The automaton in arrays; of items only those of states as long as least are kept."""
        width = max(1, len(self.codes))
        pairs = np.array([(state * width + code, to) for state, step in enumerate(self.step) for code, to in step.items()], dtype=np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        own = [sorted(items) if length >= least else [] for items, length in zip(self.found, self.length, strict=True)]
        start = np.cumsum([0, *map(len, own)])
        items = np.array([i for o in own for i in o], dtype=np.int64)
        return Compact(self.codes, pairs[:, 0].copy(), pairs[:, 1].astype(np.int32), np.array(self.link, dtype=np.int32), np.array(self.length, dtype=np.int32), start.astype(np.int32), items)


@dataclass
class Compact:
    """codes: word to number. keys and targets: transitions, sorted by state * words + code. link, length: of each state.
    start, items: the items of each state."""

    codes: dict[str, int]
    keys: np.ndarray
    targets: np.ndarray
    link: np.ndarray
    length: np.ndarray
    start: np.ndarray
    items: np.ndarray

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.targets, self.link, self.length, self.start, self.items)) + sum(len(w) + 90 for w in self.codes)

    def ends(self, texts: list[list[str]], least: int) -> tuple[np.ndarray, ...]:
        """(text, end, state, size) of each word of the texts at which a match of least words or more ends.

        Only runs of at least least known words can hold one; they start afresh and step together, the longest first.
        """
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        none = (np.zeros(0, np.int64),) * 4
        if not sizes.sum() or not len(self.keys):
            return none
        get = self.codes.get
        flat = np.fromiter((get(w, -1) for t in texts for w in t), dtype=np.int64, count=int(sizes.sum()))
        of = np.repeat(np.arange(len(texts)), sizes)
        base = np.cumsum(sizes) - sizes
        known = flat >= 0
        edge = np.r_[True, (known[1:] != known[:-1]) | (of[1:] != of[:-1])]
        first = np.flatnonzero(edge)
        run = np.diff(np.r_[first, len(flat)])
        keep = known[first] & (run >= least)
        first, run = first[keep], run[keep]
        order = np.argsort(-run, kind="stable")
        first, run = first[order], run[order]
        state, size, width = np.zeros(len(run), np.int64), np.zeros(len(run), np.int64), max(1, len(self.codes))
        out = []
        live = np.searchsorted(-run, -np.arange(int(run.max()) if len(run) else 0), side="left")  # runs longer than t
        for t, n in enumerate(live):
            s, z, c = state[:n], size[:n], flat[first[:n] + t]
            todo = np.arange(n)
            while len(todo):
                key = s[todo] * width + c[todo]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                done, todo = todo[hit], todo[~hit]
                s[done] = self.targets[at[hit]]
                z[done] += 1
                root = s[todo] == 0
                z[todo[root]] = 0
                todo = todo[~root]
                s[todo] = self.link[s[todo]]
                z[todo] = self.length[s[todo]]
            big = np.flatnonzero(z >= least)
            if len(big):
                place = first[big] + t
                out.append((of[place], place - base[of[place]] + 1, s[big].copy(), z[big].copy()))
        if not out:
            return none
        text, end, at, length = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((end, text))
        return text[order], end[order], at[order], length[order]

    def matches(self, texts: list[list[str]], least: int) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """text -> item -> spans (start, end) of at least least words shared with it; spans that touch are one."""
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for text, end, at, here in zip(*(x.tolist() for x in self.ends(texts, least)), strict=True):
            own = found.setdefault(text, {})
            while here >= least:
                for item in self.items[self.start[at] : self.start[at + 1]].tolist():
                    spans = own.setdefault(item, [])
                    if spans and spans[-1][1] >= end - here and spans[-1][0] <= end - here:
                        spans[-1] = (spans[-1][0], end)
                    elif not (spans and spans[-1][1] == end):
                        spans.append((end - here, end))
                at = int(self.link[at])
                here = int(self.length[at])
        return found


def automata(items: DataFrame, item: str, passage: str, least: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, automaton, n_words, n_bytes): a pickled automaton of each block, built by a task; equal rows count once.
    All passages of an item are in one block."""
    rows = items.filter(F.col(item).isNotNull() & F.col(passage).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(passage).alias("passage")).distinct()
    total = rows.agg(F.sum(F.regexp_count("passage", F.lit(r"[\p{L}\p{N}]+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        made, n = Automaton(), 0
        for key, text in group.sort_values(["item", "passage"])[["item", "passage"]].itertuples(index=False):
            sequence = words(text)
            made.add(int(key), sequence)
            n += len(sequence)
        laid = made.compact(least)
        return pd.DataFrame({"block": group["block"].iloc[:1], "automaton": [pickle.dumps(laid)], "n_words": [n], "n_bytes": [laid.nbytes()]})

    placed = rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    return cut(placed.groupBy("block").applyInPandas(build, "block int, automaton binary, n_words long, n_bytes long"))


def leaks(docs: DataFrame, items: DataFrame, least: int = 10, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", block_words: int = BLOCK_WORDS, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """(doc, item, longest, covered, spans): texts that share at least least consecutive words with a passage.

    longest is the longest shared run, covered the number of the text's words in such runs, spans the runs as word
    offsets. Passages shorter than least words cannot be found; null and empty texts and passages have no words.
    Repeated rows give repeated results, an empty table none, a null doc stays null; other columns are not read.
    """
    spark = docs.sparkSession
    schema = f"{doc} long, {item} long, longest int, covered int, spans array<struct<start:int,end:int>>"
    read = docs.filter(F.col(text).isNotNull()).select(F.col(doc).cast("long").alias("__doc"), F.col(text).alias("__text"))

    def scan(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            opened: list[Compact] = [pickle.loads(one.value) for one in shared]
            for whole in batches:
                for start in range(0, len(whole), 4_096):
                    batch = whole.iloc[start : start + 4_096]
                    keys, texts = batch["__doc"].tolist(), [words(t) for t in batch["__text"]]
                    rows = []
                    for one in opened:
                        for at, own in one.matches(texts, least).items():
                            rows += [(keys[at], it, max(b - a for a, b in spans), sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans]) for it, spans in own.items()]
                    yield pd.DataFrame(rows, columns=[doc, item, "longest", "covered", "spans"])

        return read.mapInPandas(run, schema)

    parts, held, size = [], [], 0
    for row in automata(items, item, passage, least, block_words).select("automaton", "n_bytes").toLocalIterator():
        if held and size + row.n_bytes > scan_bytes:
            parts.append(scan(held))
            held, size = [], 0
        held.append(spark.sparkContext.broadcast(bytes(row.automaton)))
        size += row.n_bytes
    if held:
        parts.append(scan(held))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def cleaned(docs: DataFrame, found: DataFrame, doc: str = "doc_id", text: str = "text", most: float = 0.5) -> DataFrame:
    """Texts of docs that leaked, with the shared runs cut out; text is null where the runs cover more than most of it."""
    spans = found.groupBy(doc).agg(F.flatten(F.collect_list("spans")).alias("spans"))

    @F.pandas_udf("string")
    def cut_spans(texts: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for body, own in zip(texts, runs, strict=True):
            places = [m.span() for m in WORD.finditer(body)]
            gone = {k for r in own for k in range(r["start"], r["end"])}
            if len(gone) > most * len(places):
                out.append(None)
                continue
            kept, at = [], 0
            for a, b in sorted((r["start"], r["end"]) for r in own):
                first, last = places[a][0], places[b - 1][1]
                if first > at:
                    kept.append(body[at:first])
                at = max(at, last)
            out.append("".join([*kept, body[at:]]))
        return pd.Series(out)

    return docs.select(doc, text).join(spans, doc).select(doc, cut_spans(text, "spans").alias(text))
