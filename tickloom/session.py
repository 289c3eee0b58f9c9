"""Session set-up, the shared scratch folder and size-checked broadcasting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tickloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # a symbol's daily history is a few thousand rows: keep it out of the spill path
        "spark.sql.windowExec.buffer.in.memory.threshold": "16384",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A private temporary folder is used only where the setting is absent and the
    session is local (tests, notebooks); on a cluster the setting is mandatory.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="tickloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), "tickloom", f"{name}-{uuid.uuid4().hex}")


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a table that outlives executors, and gives Catalyst the
    real size of the result for its join decisions.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_checked(dim: DataFrame) -> DataFrame:
    """``dim`` as a written table, so that joins are planned on the bytes it really has.

    Catalyst broadcasts it within ``spark.sql.autoBroadcastJoinThreshold`` and joins by shuffle
    beyond that, where AQE splits skewed keys. Nothing is kept in executors' memory.
    """
    return staged(dim, "dimension")
