"""Replays a table as a stream: rows arrive in files, out of order by a bounded delay, and the results are a table again.

It serves back-fills and the queries that hold a stream against its batch form. All files lie in the folder
that the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.session import shared_folder


def replay(rows: DataFrame, at: str, key: str, build: Callable[[DataFrame], DataFrame], files: int = 4, delay_minutes: int = 30) -> DataFrame:
    """What ``build`` makes of ``rows`` as a stream of ``files`` micro-batches, in which a row is up to ``delay_minutes`` late.

    The delay of a row comes from the hash of ``key``. A last row, null but for a time far ahead, lets the watermark pass all others;
    what it gives has a null ``key`` and is left out. A null time is left out.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/quillstream/replay-{uuid.uuid4().hex}"
    arrival = F.unix_micros(F.col(at).cast("timestamp")) + F.pmod(F.xxhash64(key), F.lit(max(delay_minutes, 1) * 60_000_000))
    dated = rows.where(F.col(at).isNotNull()).withColumn("_arrival", arrival)
    low, high = dated.agg(F.min("_arrival"), F.max("_arrival")).first()
    span = max(1, -(-(high - low + 1) // files)) if low is not None else 1
    for k in range(files):  # one after the other, as the stream takes files by their age
        dated.where(F.floor((F.col("_arrival") - (low or 0)) / span) == k).drop("_arrival").write.parquet(f"{folder}/in/{k:04d}")
    ahead = F.timestamp_micros(F.lit((high or 0) + 400 * 86_400_000_000))
    last = spark.range(1).select(*[(ahead if f.name == at else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    last.write.parquet(f"{folder}/in/{files:04d}")
    source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 8).parquet(f"{folder}/in")
    made = build(source)
    query = made.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/out").where(F.col(key).isNotNull())


def last_rows(told: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return told.withColumn("_turn", turn).where("_turn = 1").drop("_turn")
