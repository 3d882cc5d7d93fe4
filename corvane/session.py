"""Session settings and the shared folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the cluster doesn't say otherwise.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "corvane", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only where Spark runs within one process may a folder of this machine stand in."""
    if current := spark.sparkContext.getCheckpointDir():
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvane-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: rows go to the shared folder, so a lost executor costs no recomputation.

    What is read again is a new leaf. A checkpoint's own leaf takes over the plan's constraints and estimated sizes, and in a loop each round
    derives further ones from those of the round before, until the driver holds nothing else.
    """
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)._jdf
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), df.sparkSession)


def small(df: DataFrame, most_rows: int = 1_000_000, most_bytes: int = 64 << 20) -> DataFrame:
    """Marks a side for broadcast if its rows and the bytes of its strings, counted here, are within bounds; else the plain side, which is joined by shuffle."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in df.columns), F.lit(0)).cast("long")
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= most_rows and total <= most_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly where the source has too few splits to keep the cores busy, as a single small file has; else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores else df
