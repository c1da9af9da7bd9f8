"""Sources and sinks: session logs, archives, direct messages, extraction results, exports, notes; and expectations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.functions.messages import content_text, identifier, not_blank, parsed
from lorebase.operators.dedupe import first_copies
from lorebase.operators.linearise import EARLIEST, TASK_ROWS, reply_places
from lorebase.operators.ordinals import dense_ordinals
from lorebase.session import cut


def session_log_lines(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, line_no, line) of every file of the pattern below folder, except in ``subagents`` folders; blank lines count.

    Large files are shared among tasks: lines are numbered inside the block a task reads, by their order there, and the
    sizes of the file's blocks before are added.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder)
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")).filter(~F.col("path").rlike("/subagents/"))
    placed = cut(rows.withColumn("__at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("path", "block").agg(F.count("*").alias("__n"))
    base = sizes.withColumn("__base", F.sum("__n").over(Window.partitionBy("path").orderBy("block")) - F.col("__n")).drop("__n")
    inside = F.row_number().over(Window.partitionBy("path", "block").orderBy("__at")) - 1
    numbered = placed.withColumn("__in", inside).join(base, ["path", "block"])
    return numbered.select("path", (F.col("__base") + F.col("__in")).cast("int").alias("line_no"), "line").filter(not_blank("line"))


def parsed_log(lines: DataFrame) -> DataFrame:
    """Records of session-log lines in the columns of the session tables; unreadable lines are left out.

    The first sessionId of a file names its records' session, else the file's own name. rec_id rises with path and line.
    """
    v = lines.withColumn("v", F.try_parse_json("line")).filter("v IS NOT NULL")
    get = lambda name, kind="string": F.expr(f"try_variant_get(v, '$.{name}', '{kind}')")
    rows = v.select("path", "line_no", get("type").alias("type"), get("sessionId").alias("sid"), get("uuid").alias("uuid"), get("parentUuid").alias("parentUuid"), get("isSidechain", "boolean").alias("isSidechain"), get("timestamp").alias("timestamp"), F.expr("to_json(try_variant_get(v, '$.message', 'variant'))").alias("message"))
    named = rows.groupBy("path").agg(F.min_by("sid", F.when(F.col("sid").isNotNull(), F.col("line_no"))).alias("first"))
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return rows.join(named, "path").withColumn("sessionId", F.coalesce("first", stem)).drop("first", "sid")


def _talk(rows: DataFrame) -> DataFrame:
    """User and assistant records of sessions that carry no tool results, with own (their key), side, role, content and spoken_at."""
    key = F.coalesce("msg_id", F.concat(F.lit("\0"), F.col("rec_id").cast("string")))
    said = rows.filter(F.col("type").isin("user", "assistant") & F.col("session_id").isNotNull())
    said = said.select("rec_id", "session_id", "msg_id", "parent_id", key.alias("own"), F.coalesce("isSidechain", F.lit(False)).alias("side"), "type", "timestamp", parsed("message").alias("v"))
    result = F.expr("exists(try_variant_get(v, '$.content', 'array<variant>'), b -> try_variant_get(b, '$.type', 'string') = 'tool_result')")
    text = F.trim(F.replace(content_text("v", "\n\n"), F.lit("\0"), F.lit("")))
    role = F.when(F.col("type") == "user", "human").otherwise("assistant").alias("role")
    return said.filter(~((F.col("type") == "user") & F.coalesce(result, F.lit(False)))).select("rec_id", "session_id", "msg_id", "parent_id", "own", "side", role, text.alias("content"), F.expr("try_cast(timestamp AS timestamp)").alias("spoken_at"))


def _once(rows: DataFrame) -> DataFrame:
    """The messages of rows, one copy each, without their order."""
    said = _talk(rows.filter(~F.coalesce("isSidechain", F.lit(False)) & F.col("message").isNotNull())).filter("content <> ''")
    return first_copies(said.select("rec_id", "session_id", "own", "role", "content", "spoken_at"), ["session_id", "own"], ["rec_id"])


def messages(rows: DataFrame) -> DataFrame:
    """Messages of session rows: session_id, rec_id, role (human, assistant), content, spoken_at and a dense ordinal.

    rows: rec_id, session_id, msg_id, parent_id, type, isSidechain, timestamp, message. Records that carry tool results,
    sidechains, unreadable ones and those without text are no messages; one copy of each record counts. The ordinal
    follows arrival; linearised() follows the replies.
    """
    return dense_ordinals(_once(rows).drop("own"), ["session_id"], "rec_id").withColumn("ordinal", F.col("ordinal").cast("long"))


def linearised(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """messages() with ordinals along the reply tree, without what hangs below sidechains.

    Roots are the records whose parent is not a user or assistant record of the session, or carries tool results, by
    arrival; children come by time (unknown first), then arrival. Records without msg_id are roots, and so is the first
    record of a loop. rec_id must be unique.
    """
    at = F.coalesce(F.unix_micros("spoken_at"), F.lit(EARLIEST))
    kept = _talk(rows).select("rec_id", "session_id", "own", "msg_id", "parent_id", "side", at.alias("at"))
    nodes = cut(first_copies(kept, ["session_id", "own"], ["rec_id"]))
    parents = nodes.filter("msg_id IS NOT NULL").select("session_id", F.col("msg_id").alias("parent_id"), F.col("rec_id").alias("parent_rec"))
    linked = nodes.withColumn("parent_id", F.when(F.col("msg_id").isNotNull(), F.col("parent_id"))).join(parents, ["session_id", "parent_id"], "left")
    placed = _once(rows).join(reply_places(linked, task_rows), ["session_id", "own"]).drop("own")
    return dense_ordinals(placed, ["session_id"], "place").drop("place").withColumn("ordinal", F.col("ordinal").cast("long"))


def conversation_names(said: DataFrame, most: int = 80) -> DataFrame:
    """(session_id, name): the first human message on one line; a long one ends at a word and in ``...``."""
    first = said.filter("role = 'human'").groupBy("session_id").agg(F.min_by("content", "ordinal").alias("text"))
    line = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    cut = F.substring(line, 1, most - 3)
    short = F.concat(F.coalesce(F.nullif(F.regexp_extract(cut, r"^(.*) [^ ]*$", 1), F.lit("")), cut), F.lit("..."))
    every = said.select("session_id").distinct().join(first, "session_id", "left")
    return every.select("session_id", F.when(F.col("text").isNull(), "Untitled conversation").when(F.length(line) <= most, line).otherwise(short).alias("name"))


def archive_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSON archives: conversations without uuid or messages are left out, ordinals are dense after that."""
    schema = "uuid string, name string, created_at string, messages array<struct<role:string,text:string>>"
    talks = spark.read.schema(schema).option("multiLine", "true").json(path).filter(F.col("uuid").isNotNull() & (F.size("messages") > 0))
    rows = talks.select(F.col("uuid").alias("session_id"), "name", F.expr("try_cast(created_at AS timestamp)").alias("spoken_at"), F.posexplode("messages").alias("at", "m"))
    role = F.when(F.col("m.role").isin("human", "user"), "human").when(F.col("m.role") == "assistant", "assistant")
    kept = rows.select("session_id", "name", "spoken_at", "at", role.alias("role"), F.trim(F.replace("m.text", F.lit("\0"), F.lit(""))).alias("content")).filter("role IS NOT NULL AND content <> ''")
    return dense_ordinals(kept, ["session_id"], "at").drop("at")


def direct_messages(said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages handed over directly: (valid with session bounds started_at and ended_at, invalid with error)."""
    error = F.when(F.col("role").isNull() | ~F.col("role").isin("human", "assistant"), "role").when(F.col("content").isNull(), "content").when(F.col("ordinal").isNull(), "ordinal").when(F.col("spoken_at").isNotNull() & F.expr("try_cast(spoken_at AS timestamp) IS NULL"), "spoken_at")
    checked = said.withColumn("error", error)
    valid = checked.filter("error IS NULL").drop("error").withColumn("spoken_at", F.expr("try_cast(spoken_at AS timestamp)"))
    bounds = valid.groupBy("session_id").agg(F.min("spoken_at").alias("started_at"), F.max("spoken_at").alias("ended_at"))
    return valid.join(bounds, "session_id"), checked.filter("error IS NOT NULL")


def unseen(batch: DataFrame, stored: DataFrame, key: str = "session_id") -> DataFrame:
    """Conversations of a batch that are not stored: the first row of each key, keys without regard to case."""
    first = first_copies(batch.withColumn("__k", identifier(key)), ["__k"], [key])
    return first.join(stored.select(identifier(key).alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def export_chunks(chunks: DataFrame, folder: str, conversations: DataFrame | None = None, done: Sequence[str] = ("extracted", "complete"), prompt: str | None = None) -> None:
    """One folder of JSON lines per conversation, in order of start_ordinal; with conversations those that are done are
    left out. A prompt is written beside them, in the folder ``_prompt``, which readers of the chunks skip."""
    spark = chunks.sparkSession
    if conversations is not None:
        finished = conversations.filter(F.col("pipeline_status").isin(list(done))).select(F.col("id").alias("conversation_id"))
        chunks = chunks.join(finished, "conversation_id", "left_anti")
    if prompt is not None:
        spark.createDataFrame([(prompt,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_prompt")
    rows = chunks.select("conversation_id", "id", "raw_content", "chunk_type", "significance", "start_ordinal")
    rows.repartition("conversation_id").sortWithinPartitions("conversation_id", "start_ordinal", "id").write.mode("overwrite").partitionBy("conversation_id").json(f"{folder}/chunks")


def extraction_results(spark: SparkSession, folder: str, pattern: str = "result_*.json", lines: bool = False) -> DataFrame:
    """Results of the files of the pattern: path, conversation_id, chunk_id, entities, relations, error (unreadable results).

    A file is one result; with lines every line is one, blank ones do not count. Very many results are better handed over
    in lines: opening a file costs more than reading its result, and tasks share large files of lines.
    """
    text = spark.read.option("wholetext", str(not lines).lower()).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder).select(F.col("_metadata.file_path").alias("path"), "value")
    files = (text.filter(not_blank("value")) if lines else text).select("path", F.try_parse_json("value").alias("v"))
    chunks = F.expr("try_variant_get(v, '$.chunks', 'array<variant>')")
    rows = files.select("path", F.expr("try_variant_get(v, '$.conversation_id', 'long')").alias("conversation_id"), F.explode_outer(chunks).alias("c"), F.col("v").isNull().alias("bad"))
    entity = "array<struct<name:string,entity_type:string,match:string,confidence:double,summary:string,reasoning:string>>"
    relation = "array<struct<source:string,target:string,relation_type:string,description:string>>"
    out = rows.select("path", "conversation_id", F.expr("try_variant_get(c, '$.chunk_id', 'long')").alias("chunk_id"), F.expr(f"try_variant_get(c, '$.entities', '{entity}')").alias("entities"), F.expr(f"try_variant_get(c, '$.relations', '{relation}')").alias("relations"), "bad")
    error = F.when(F.col("bad"), "unreadable").when(F.col("conversation_id").isNull(), "conversation_id is missing").when(F.col("chunk_id").isNull(), "chunk_id is missing")
    return out.withColumn("error", error).drop("bad")


def owned(results: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results whose chunk belongs to the conversation they name, and the others."""
    own = chunks.select(F.col("id").alias("chunk_id"), "conversation_id")
    keys = ["chunk_id", "conversation_id"]
    return results.join(own, keys, "left_semi"), results.join(own, keys, "left_anti")


def import_report(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """(conversation_id, chunks, owned, foreign, errors, entities, relations, extracted): what an import of the results
    would bring, without importing anything; extracted only where nothing failed and nothing is foreign."""
    own = chunks.select(F.col("id").alias("chunk_id"), "conversation_id", F.lit(True).alias("__own"))
    met = results.join(own, ["chunk_id", "conversation_id"], "left")
    mine, size = F.coalesce("__own", F.lit(False)), lambda c: F.coalesce(F.when(F.col("__own"), F.size(c)), F.lit(0))
    failed = F.col("error").isNotNull()
    out = met.groupBy("conversation_id").agg(
        F.count("chunk_id").alias("chunks"), F.count_if(mine & ~failed).alias("owned"), F.count_if(~mine & ~failed).alias("foreign"), F.count_if(failed).alias("errors"),
        F.sum(size("entities")).alias("entities"), F.sum(size("relations")).alias("relations"),
    )
    return out.withColumn("extracted", (F.col("errors") == 0) & (F.col("foreign") == 0) & (F.col("owned") > 0))


def appended(batch: DataFrame, said: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations of a batch that are not stored, and their messages: what one append writes."""
    fresh = unseen(batch, stored)
    keys = fresh.select(identifier("session_id").alias("__k"))
    return fresh, said.withColumn("__k", identifier("session_id")).join(keys, "__k", "left_semi").drop("__k")


def missing(asked: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The asked keys that no row has, each once."""
    return asked.select(key).filter(F.col(key).isNotNull()).distinct().join(rows.select(key), key, "left_anti")


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """(key, content) of Markdown files: the file's name and its trimmed text; empty ones are left out."""
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.md").text(folder)
    return files.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.md$", 1).alias("key"), F.trim("value").alias("content")).filter(not_blank("content"))


def violations(rows: DataFrame, name: str, unique: Sequence[Sequence[str]] = (), required: Sequence[str] = (), allowed: dict[str, Sequence] | None = None, foreign: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(table, rule, n): rows that break a constraint, counted; rules without violations have n = 0."""
    spark = rows.sparkSession
    counts = [F.count_if(F.col(c).isNull()).alias(f"{c} is null") for c in required]
    counts += [F.count_if(~F.col(c).isin(list(v))).alias(f"{c} is not allowed") for c, v in (allowed or {}).items()]
    parts = []
    if counts:
        one = rows.agg(*counts)
        parts.append(one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("n")) for c in one.columns))).alias("x")).select("x.*"))
    for keys in unique:
        parts.append(rows.groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit(f"{', '.join(keys)} repeated").alias("rule"), "n"))
    for column, (table, key) in (foreign or {}).items():
        lost = rows.filter(F.col(column).isNotNull()).join(table.select(F.col(key).alias(column)).distinct(), column, "left_anti")
        parts.append(lost.agg(F.count("*").alias("n")).select(F.lit(f"{column} has no match").alias("rule"), "n"))
    out = spark.createDataFrame([], "rule string, n long")
    for part in parts:
        out = out.unionByName(part)
    return out.select(F.lit(name).alias("table"), "rule", "n")
