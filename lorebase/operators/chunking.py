"""Conversations cut into typed and scored chunks.

Turns, time gaps and the places where the greedy merge starts afresh are found with prefix sums over stretches, so a
conversation of any length is spread over many tasks; only the merge inside such a run, and the split of an oversized
chunk, are folds, and they fold over lengths, never over texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.functions.vectors import cosine_similarity

from lorebase.operators.ordinals import dense_ordinals, previous, running_sum
from lorebase.session import cut

# fixed values of the data model
GAP_MINUTES = 30
MERGE_TOKENS = 150
SPLIT_TOKENS = 600
CHARS_PER_TOKEN = 4
DECISION = r"(?iU)\b(decided|going with|chose|choosing|settled on|went with)\b"
CORRECTION = r"(?iU)\b(no not that|don't do|instead|not that|wrong|actually no)\b"
EMOTION = (
    r"(?iU)\b(feeling|felt|scared|anxious|happy|sad|overwhelmed|frustrated|exhausted|love|hate|angry|hurt|rough|struggling|excited|proud"
    r"|spiralling|shutdown|meltdown|burnout|dysregulated)\b"
)
GREETING = r"(?iU)^(hey|hi|hello|morning|afternoon|evening|g'day)\b"
TOPIC_THRESHOLD = 0.5


def tokens(text: Column | str) -> Column:
    """Estimated tokens of a text: four characters each, rounded down."""
    return F.floor(F.length(F.col(text) if isinstance(text, str) else text) / CHARS_PER_TOKEN).cast("int")


def spoken(role: Column, text: Column) -> Column:
    """A message as it stands in a chunk, without NUL characters."""
    return F.concat(F.when(role == "human", "Human: ").otherwise("Assistant: "), F.replace(text, F.lit("\0"), F.lit("")))


def turn_groups(messages: DataFrame, group: str = "session_id", order: str = "ordinal") -> DataFrame:
    """Adds turn_group: a human message opens a new turn; what precedes the first one is turn 0 or part of it."""
    opens = messages.withColumn("__open", ((F.col("role") == "human") & (F.col(order) > 0)).cast("long"))
    return running_sum(opens, [group], order, "__open", "turn_group").drop("__open")


def gap_segments(rows: DataFrame, group: str, order: str, time: str, minutes: float = GAP_MINUTES) -> DataFrame:
    """Adds after_gap and segment: a new segment after more than minutes without a row; unknown times never cut."""
    before = previous(rows, [group], order, [time])
    gap = F.col(time).cast("timestamp").cast("double") - F.col(f"prev_{time}").cast("timestamp").cast("double") > minutes * 60
    marked = before.withColumn("after_gap", F.coalesce(gap, F.lit(False))).drop(f"prev_{time}").withColumn("__g", F.col("after_gap").cast("long"))
    return running_sum(marked, [group], order, "__g", "segment").drop("__g")


def chunk_type(text: Column, human_text: Column) -> Column:
    """correction (people's words only), decision, moment (dense feeling in few words), emotional, else topic."""
    feelings = F.regexp_count(text, F.lit(EMOTION))
    small = F.length(text) < 200 * CHARS_PER_TOKEN
    return F.when(human_text.rlike(CORRECTION), "correction").when(text.rlike(DECISION), "decision").when((feelings >= 3) & small, "moment").when(feelings >= 2, "emotional").otherwise("topic")


def greets(role: Column, text: Column) -> Column:
    return (role == "human") & text.rlike(GREETING)


def significance(kind: Column, greeting: Column) -> Column:
    """3, one more for anything but a topic, one less for a greeting."""
    return F.lit(3) + F.when(kind == "topic", 0).otherwise(1) - F.when(greeting, 1).otherwise(0)


def _merge_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Greedy merge of small groups, run after run as they come in order; head is the first group of the merged one."""
    run, head, size = None, None, 0
    for batch in batches:
        heads = []
        for session, number, piece, length in zip(batch["session_id"], batch["run"], batch["piece"], batch["length"], strict=True):
            if (session, number) == run and size // CHARS_PER_TOKEN + length // CHARS_PER_TOKEN < MERGE_TOKENS:
                size += 2 + length
            else:
                run, head, size = (session, number), piece, length
            heads.append(head)
        yield pd.DataFrame({"session_id": batch["session_id"], "piece": batch["piece"], "head": heads})


def merged_pieces(places: DataFrame) -> DataFrame:
    """places with piece (turn cut at time gaps) and head, the first piece of the chunk before splitting.

    places: session_id, ordinal, role, spoken_at, length (of the message as it stands in a chunk), greets. No texts.
    """
    before = previous(places, ["session_id"], "ordinal", ["spoken_at"])
    gap = F.col("spoken_at").cast("double") - F.col("prev_spoken_at").cast("double") > GAP_MINUTES * 60
    marked = before.withColumn("after_gap", F.coalesce(gap, F.lit(False)))
    starts = marked.withColumn("__new", (F.col("after_gap") | ((F.col("role") == "human") & (F.col("ordinal") > 0))).cast("long"))
    placed = cut(running_sum(cut(starts.drop("prev_spoken_at")), ["session_id"], "ordinal", "__new", "piece").drop("__new"))
    groups = cut(placed.groupBy("session_id", "piece").agg((F.sum("length") + 2 * (F.count("*") - 1)).alias("length"), F.min_by("after_gap", "ordinal").alias("after_gap"), F.min_by("greets", "ordinal").alias("greets")))
    boot = groups.filter("piece = 0").select("session_id", F.col("greets").alias("boot"))
    ordered = previous(groups, ["session_id"], "piece", ["length"]).join(boot, "session_id")
    big = lambda c: F.floor(F.col(c) / CHARS_PER_TOKEN) >= MERGE_TOKENS
    fresh = F.col("after_gap") | big("length") | F.coalesce(big("prev_length"), F.lit(True)) | (F.col("boot") & (F.col("piece") == 1))
    runs = running_sum(cut(ordered.withColumn("__f", fresh.cast("long")).select("session_id", "piece", "length", "__f")), ["session_id"], "piece", "__f", "run")
    rows = runs.select("session_id", "run", "piece", "length").repartition("session_id", "run").sortWithinPartitions("session_id", "run", "piece")
    heads = rows.mapInPandas(_merge_runs, "session_id string, piece long, head long")
    return cut(placed.drop("after_gap").join(heads, ["session_id", "piece"]))


@F.pandas_udf(T.ArrayType(T.StringType()))
def fragments(texts: pd.Series) -> pd.Series:
    """A long message cut at blank lines into parts of at most the split size; a longer paragraph stays whole."""

    def cut_one(text: str) -> list[str]:
        if len(text) // CHARS_PER_TOKEN <= SPLIT_TOKENS:
            return [text]
        out, held, size = [], [], 0
        for paragraph in text.split("\n\n"):
            n = len(paragraph) // CHARS_PER_TOKEN
            if held and size + n > SPLIT_TOKENS:
                out.append("\n\n".join(held))
                held, size = [], 0
            held.append(paragraph)
            size += n
        return [*out, "\n\n".join(held)]

    return texts.map(cut_one)


def _fill(sizes: list[int]) -> list[int]:
    """Bin number of each of a row of sizes, filled in order up to the split size."""
    out, number, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i and held + n > SPLIT_TOKENS:
            number, held = number + 1, 0
        held += n
        out.append(number)
    return out


def _split_chunk(rows: pd.DataFrame) -> pd.DataFrame:
    """Part of each message fragment of an oversized chunk, by lengths."""
    rows = rows.sort_values(["ordinal", "fragment"])
    whole = rows.groupby("ordinal", sort=True).agg(n=("message_length", "first"), spoken=("length", "first"))
    coarse = dict(zip(whole.index, _fill([n // CHARS_PER_TOKEN for n in whole["n"]]), strict=True))
    rows["__coarse"] = [coarse[o] for o in rows["ordinal"]]
    parts, base = [], 0
    for _, own in rows.groupby("__coarse", sort=True):
        first = own.drop_duplicates("ordinal")
        if (first["length"].sum() + 2 * (len(first) - 1)) // CHARS_PER_TOKEN <= SPLIT_TOKENS:
            numbers = [0] * len(own)
        else:
            numbers = _fill([n // CHARS_PER_TOKEN for n in own["fragment_length"]])
        parts += [base + n for n in numbers]
        base += numbers[-1] + 1
    rows["part"] = parts
    return rows[["session_id", "head", "ordinal", "fragment", "part"]]


def chunked(messages: DataFrame) -> DataFrame:
    """Chunks of messages(session_id, ordinal, rec_id, role, content, spoken_at).

    Columns: session_id, head, part, start_ordinal, end_ordinal, start_message_id, end_message_id, content, chunk_type,
    significance. role is human or assistant; ordinal is dense from 0 and unique in the session; null contents should be left
    out before. Repeated messages are messages of their own; an empty table gives no chunk.
    """
    # texts are written once; everything is decided on keys and lengths, and meets them again at the end
    texts = cut(messages.select("session_id", "ordinal", "rec_id", "role", "content", "spoken_at", F.length(spoken(F.col("role"), F.col("content"))).cast("long").alias("length"), greets(F.col("role"), F.col("content")).alias("greets")))
    pieces = merged_pieces(texts.select("session_id", "ordinal", "role", "spoken_at", "length", "greets"))
    size = pieces.groupBy("session_id", "head").agg((F.sum("length") + 2 * (F.count("*") - 1)).alias("chunk_length"))
    over = (F.floor(F.col("chunk_length") / CHARS_PER_TOKEN) > SPLIT_TOKENS).alias("over")
    placed = cut(pieces.join(size, ["session_id", "head"]).select("session_id", "head", "ordinal", over))
    full = placed.join(texts.select("session_id", "ordinal", "rec_id", "role", "content", "length"), ["session_id", "ordinal"])
    # only oversized chunks see the splitter, and there only long messages are cut
    whole = full.filter("NOT over").select("session_id", "head", "ordinal", F.lit(0).alias("fragment"), "rec_id", "role", F.col("content").alias("text"), F.lit(0).alias("part"))
    cuts = full.filter("over").select("*", F.posexplode(fragments("content")).alias("fragment", "text"))
    narrow = cuts.select("session_id", "head", "ordinal", "fragment", F.length("content").cast("long").alias("message_length"), "length", F.length("text").cast("long").alias("fragment_length"))
    parts = narrow.groupBy("session_id", "head").applyInPandas(_split_chunk, "session_id string, head long, ordinal long, fragment int, part int")
    rows = whole.unionByName(cuts.join(parts, ["session_id", "head", "ordinal", "fragment"]).select(whole.columns))
    line = F.struct("ordinal", "fragment", "rec_id", "role", "text")
    out = rows.groupBy("session_id", "head", "part").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    said = lambda x: spoken(x["role"], x["text"])
    content = F.array_join(F.transform("lines", said), "\n\n")
    human = F.array_join(F.transform(F.filter("lines", lambda x: x["role"] == "human"), lambda x: x["text"]), " ")
    first, last = F.element_at("lines", 1), F.element_at("lines", -1)
    out = out.select("session_id", "head", "part", first["ordinal"].alias("start_ordinal"), last["ordinal"].alias("end_ordinal"), first["rec_id"].alias("start_message_id"), last["rec_id"].alias("end_message_id"), content.alias("content"), human.alias("human"), greets(first["role"], first["text"]).alias("greeting"))
    out = out.withColumn("chunk_type", chunk_type(F.col("content"), F.col("human")))
    return out.withColumn("significance", significance(F.col("chunk_type"), F.col("greeting"))).drop("human", "greeting")


def topic_pairs(chunks: DataFrame, group: str, order: str, vector: str = "embedding", threshold: float = TOPIC_THRESHOLD) -> DataFrame:
    """Neighbouring chunks with vectors: similarity to the one before and is_boundary (below threshold)."""
    known = dense_ordinals(chunks.filter(F.col(vector).isNotNull()), [group], order, "__place")
    pairs = previous(known, [group], "__place", [vector]).filter(F.col(f"prev_{vector}").isNotNull())
    near = pairs.withColumn("similarity", cosine_similarity(F.col(f"prev_{vector}"), F.col(vector)))
    return near.withColumn("is_boundary", F.col("similarity") < threshold).drop(f"prev_{vector}", "__place")


# contractions and pronouns, lower case, and what stands for them (fixed values)
PRONOUNS = {
    "i'm": "{speaker} is", "i've": "{speaker} has", "i'll": "{speaker} will", "i'd": "{speaker} would",
    "you're": "{partner} is", "you've": "{partner} has", "you'll": "{partner} will", "you'd": "{partner} would",
    "mine": "{speaker}'s", "yours": "{partner}'s", "my": "{speaker}'s", "your": "{partner}'s", "myself": "{speaker}", "yourself": "{partner}", "me": "{speaker}", "i": "{speaker}", "you": "{partner}",
}
_PRONOUN = re.compile(r"\b(?:" + "|".join(sorted(PRONOUNS, key=len, reverse=True)) + r")\b", re.I)
_CODE = re.compile(r"```[\s\S]*?```|`[^`]+`")


def resolve_pronouns(text: str, human: str, assistant: str) -> str:
    """First and second person replaced by names in a chunk's turns; code stays as it is, third person too.

    One pass over the text: a turn's prefix sets who speaks until the next one, text before any prefix is left alone.
    """
    speakers = {"Human: ": (human, assistant), "Assistant: ": (assistant, human)}
    code: list[str] = []

    def hide(m: re.Match) -> str:
        code.append(m.group())
        return f"\0{len(code) - 1}\0"

    body = _CODE.sub(hide, text).replace("’", "'").replace("‘", "'")
    out, who = [], None
    for paragraph in body.split("\n\n"):
        prefix = next((p for p in speakers if paragraph.startswith(p)), "")
        who = speakers.get(prefix, who)
        said = paragraph[len(prefix) :]
        if who is not None:
            me, you = who
            said = _PRONOUN.sub(lambda m, me=me, you=you: PRONOUNS[m.group().lower()].format(speaker=me, partner=you), said)
        out.append(prefix + said)
    return re.sub(r"\0(\d+)\0", lambda m: code[int(m.group(1))], "\n\n".join(out))


def resolved_pronouns(chunks: DataFrame, text: str = "raw_content", human: str = "User", assistant: str = "Assistant") -> DataFrame:
    """chunks with resolved: the text with names for first and second person; NULL stays NULL."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else resolve_pronouns(t, human, assistant))

    return chunks.withColumn("resolved", run(F.col(text)))
