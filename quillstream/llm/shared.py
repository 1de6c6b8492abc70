"""The shared folder of the session, and small helpers that several operators use."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.session import shared_folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quillstream/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: lineage ends there, and a lost
    executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")
