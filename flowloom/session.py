"""Session helpers: settings the engine relies on, and where checkpoints go."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "flowloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the options the operators assume."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    options = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # streaming flows: merge sessions before the shuffle, which thins hot keys
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    }
    options.update(conf)
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure reliable checkpoints have a home.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that one is
    always used.  Only a local master may fall back to a temporary folder.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if shared:
        # the context keeps its own sub-folder below the named one
        if current is None or shared.rstrip("/") not in current:
            context.setCheckpointDir(shared)
    elif current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="flowloom-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
