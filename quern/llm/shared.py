"""Helpers that the training-data operators share: reading tables, stable row keys, checkpoints, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast on purpose only below this many estimated bytes; beyond it the join is left to shuffle.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where none is named (tests, one machine) a temporary one is made."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    now = sc._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quern-checkpoints-"))
        now = sc._jsc.sc().getCheckpointDir()
    return now.get()


def pinned(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends here, rows keep partition and order, and a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Written once as Parquet in the shared folder and read again: cut lineage with columns that can be pruned."""
    path = f"{shared_dir(df.sparkSession)}/quern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(seed: int, *cols: str) -> list[Column]:
    """A 128-bit key of the named columns in two longs. Rows that are equal in them have equal keys; nulls count as a value of their own."""
    marks = [F.col(c).isNull() for c in cols]
    return [F.xxhash64(F.lit(seed), *cols, *marks).alias("__k1"), F.xxhash64(F.lit(seed + 1), *marks, *reversed(cols)).alias("__k2")]


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint if rows * row_bytes is within the bound, else the table as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns whose names an operator is about to give out (compared as Spark compares them, without case)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])
