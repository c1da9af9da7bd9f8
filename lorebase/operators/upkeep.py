"""Upkeep: audit runs and their log, snapshots, topic marks, reconsolidation, exports, deletions and one-time steps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.operators.chunking import TOPIC_THRESHOLD, topic_pairs
from lorebase.operators.curation import summaries
from lorebase.session import cut

LOG = "audit string, run_at timestamp, n long, findings string, error string"


def audit_log(spark: SparkSession, checks: Mapping[str, Callable[[], DataFrame]], at: str, most: int = 100) -> DataFrame:
    """One log row per check: how many findings, the first most of them as JSON, or the error. A check that fails does
    not keep the others from running. Only the counts and those few findings come to the driver."""
    rows = []
    for name, check in checks.items():
        try:
            found = cut(check())
            sample = [r.j for r in found.select(F.to_json(F.struct(*found.columns)).alias("j")).orderBy("j").limit(most).collect()]
            rows.append((name, found.count(), f"[{','.join(sample)}]", None))
        except Exception as failure:
            rows.append((name, None, None, f"{type(failure).__name__}: {str(failure).splitlines()[0]}"))
    log = spark.createDataFrame(rows, "audit string, n long, findings string, error string")
    return log.select("audit", F.lit(at).cast("timestamp").alias("run_at"), "n", "findings", "error")


def latest_audits(log: DataFrame) -> DataFrame:
    """The newest row of each audit."""
    return log.groupBy("audit").agg(F.max_by(F.struct("run_at", "n", "findings", "error"), "run_at").alias("x")).select("audit", "x.*")


def boot(entities: DataFrame, conversations: DataFrame, chunks: DataFrame, as_of: str, zone: str, days: int = 7, least: int = 3, most: int = 10) -> DataFrame:
    """(item, ref, detail): the day in a time zone, the most used of the entities updated lately, and three counts."""
    now = F.lit(as_of).cast("timestamp")
    none = F.lit(None).cast("string").alias("detail")
    today = entities.sparkSession.range(1).select(F.lit("today").alias("item"), F.lit(None).cast("long").alias("ref"), F.date_format(F.from_utc_timestamp(now, zone), "yyyy-MM-dd").alias("detail"))
    lately = entities.filter((F.col("updated_at") >= now - F.make_interval(days=F.lit(days))) & (F.col("access_count") >= least))
    top = lately.orderBy(F.col("access_count").desc(), F.col("updated_at").desc(), "id").limit(most).select(F.lit("entity").alias("item"), F.col("id").alias("ref"), F.col("name").alias("detail"))
    open_ = ~F.col("pipeline_status").isin("complete", "extracted")
    talks = conversations.agg(F.count("*").alias("conversations"), F.count_if(open_).alias("open conversations"))
    tidy = talks.select(F.explode(F.array(*(F.struct(F.lit(c).alias("item"), F.col(f"`{c}`").alias("ref")) for c in talks.columns))).alias("x")).select("x.*", none)
    return today.unionByName(top).unionByName(tidy).unionByName(chunks.agg(F.count("*").alias("ref")).select(F.lit("chunks").alias("item"), "ref", none))


def topics_raised(chunks: DataFrame, group: str, order: str, vector: str = "embedding", threshold: float = TOPIC_THRESHOLD) -> DataFrame:
    """chunks with one more significance (five at most, from 3 where unknown) for each that begins a topic."""
    starts = topic_pairs(chunks.select("id", group, vector), group, order, vector, threshold).filter("is_boundary").select("id", F.lit(True).alias("__starts"))
    out = chunks.join(starts, "id", "left")
    return out.withColumn("significance", F.when(F.col("__starts"), F.least(F.coalesce("significance", F.lit(3)) + 1, F.lit(5))).otherwise(F.col("significance"))).drop("__starts")


def with_chunks(entities: DataFrame, links: DataFrame, least: int, types: Sequence[str] | None = None) -> DataFrame:
    """entities with n_chunks, the number of their chunks, where it is at least least; of the types, if any are given."""
    counts = links.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n_chunks")).filter(F.col("n_chunks") >= least)
    rows = entities if types is None else entities.filter(F.col("entity_type").isin(list(types)))
    return rows.join(counts, "id")


def reconsolidated(entities: DataFrame, links: DataFrame, chunks: DataFrame, least: int = 1, types: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, summary) of the entities whose summary changes, and one row of counters: considered, updated, unchanged."""
    asked = with_chunks(entities, links, least, types).select("id", "name", "summary")
    own = links.join(asked.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    made = summaries(asked, own, chunks).select(F.col("entity_id").alias("id"), F.col("summary").alias("made"))
    met = cut(asked.join(made, "id", "left").withColumn("changed", F.col("made").isNotNull() & ~F.col("made").eqNullSafe(F.col("summary"))))
    counters = met.agg(F.count("*").alias("considered"), F.count_if("changed").alias("updated"), F.count_if(~F.col("changed")).alias("unchanged"))
    return met.filter("changed").select("id", F.col("made").alias("summary")), counters


def exportable(conversations: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Conversations in one of the statuses, by id."""
    return conversations.filter(F.col("pipeline_status").isin(list(statuses))).orderBy("id")


def chunk_outcomes(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(conversation_id, messages, error): how many messages can be chunked, or why none is. A conversation that cannot
    be chunked keeps no other from it: chunk the messages of those without error."""
    bad = F.col("content").isNull() | F.col("role").isNull()
    counts = messages.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    met = conversations.select(F.col("id").alias("conversation_id"), "session_id").join(counts, "session_id", "left")
    error = F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" messages without content"))).when(F.col("n").isNull(), "no messages")
    return met.withColumn("error", error).select("conversation_id", F.when(F.col("error").isNull(), F.col("n")).otherwise(0).cast("long").alias("messages"), "error")


def replaced(rows: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """rows with those of the keys in fresh replaced by fresh, as when some conversations are processed again."""
    return rows.join(fresh.select(key).distinct(), key, "left_anti").select(rows.columns).unionByName(fresh)


def cascaded(children: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """children without those whose column names a deleted id (gone: id)."""
    return children.join(gone.select(F.col("id").alias(column)), column, "left_anti")


def nulled(children: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """children with NULL in column where it names a deleted id."""
    out = children.join(gone.select(F.col("id").alias(column), F.lit(True).alias("__gone")).distinct(), column, "left")
    return out.withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).drop("__gone").select(children.columns)


def restricted(children: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """children that forbid the deletion."""
    return children.join(gone.select(F.col("id").alias(column)), column, "left_semi")


def without_keys(kv: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key-value table without the keys."""
    return kv.filter(~F.col("key").isin([k.strip() for k in keys]))


def applied_once(spark: SparkSession, log: str, steps: Mapping[str, Callable[[SparkSession], None]]) -> list[str]:
    """Run the steps the log (a folder of parquet, name and applied_at) does not hold, in order of name, each logged
    as it ends; a step that fails stops the run and is tried again next time. Gives the names of those that ran."""
    try:
        done = {r.name for r in spark.read.schema("name string, applied_at timestamp").parquet(log).select("name").collect()}
    except Exception as failure:
        if "PATH_NOT_FOUND" not in str(failure):
            raise
        done = set()
    ran = []
    for name in sorted(set(steps) - done):
        steps[name](spark)
        spark.range(1).select(F.lit(name).alias("name"), F.current_timestamp().alias("applied_at")).write.mode("append").parquet(log)
        ran.append(name)
    return ran
