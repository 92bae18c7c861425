"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode where the session names no shared folder, as in tests.
DEFAULT_SHARED = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder all executors share (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = DEFAULT_SHARED
    return f"{base.rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends
    there, and a lost executor costs only the tasks it was running. The table goes when the
    application ends, or earlier by ``release``."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", compression).parquet(path)
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_at = path
    return found


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        files, where = _file_system(table.sparkSession, table._written_at)
        files.delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(column: str, fold: int) -> Column:
    """True where crc32 of the id's decimal text leaves ``fold`` mod 5 (null ids: the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 5 == fold


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit("")).alias(column)
