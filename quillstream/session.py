"""Session helpers: one place for the settings the library relies on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Results are compared in UTC; AQE splits skewed joins and sizes shuffles.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: Rows of a task of ``dealt``, about.
DEALT = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the cluster names in ``spark.checkpoint.dir``.

    Where it is unset a local session, whose executors are threads of the driver, gets a folder of its own; a cluster is asked to name one.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillstream-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: its partitions are written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to the session's number of shuffle partitions, or to more where they would have over ``DEALT`` rows each.

    So what a task holds doesn't grow with ``df``. Rows are counted for it, so ``df`` should be read plainly; a key's rows stay together.
    """
    set_to = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(set_to, -(-df.count() // DEALT)), *keys)


def local_session(name: str = "quillstream", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings the session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    folder = conf.get("spark.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='quillstream-')}"
    session = builder.config("spark.checkpoint.dir", folder).getOrCreate()
    return session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a scale-factor folder, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
