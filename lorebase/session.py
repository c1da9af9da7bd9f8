"""Session set-up and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "lorebase", **conf: str) -> SparkSession:
    """A session with the settings the engine is written for; a cluster passes its own through spark-submit."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    spark = SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir. A local one is made only where all tasks run on this
    machine; on a cluster without the setting the job stops, as its executors share no local folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lorebase-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends here and the rows survive the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def exchanged(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast. Sizes are guessed from the compressed files, before lists are exploded, so
    a table that grows may seem small, and the driver would hold its rows and 34 MB more for every such join."""
    return df.hint("merge")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables, below the one all executors share."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex}"
