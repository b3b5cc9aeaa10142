"""Cutting lineage through the shared folder that the session names, so that lost executors cost little."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Spark's setting by which a query's shuffle files go when it ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary folder where that is unset and all runs on this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its rows and partitions fixed in the shared folder."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again."""
    return stored_parts([df])


def stored_parts(parts: Iterable[DataFrame]) -> DataFrame:
    """The rows of all parts, written as Parquet in the shared folder one part after another, and read again.

    What a part exchanged is deleted when it is written, so disk holds one part's exchanges at a time. A part should not read
    rows that are persisted."""
    path, schema, spark = None, None, None
    for number, df in enumerate(parts):
        spark, schema = df.sparkSession, df.schema
        path = path or f"{scratch_dir(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
        before = spark.conf.get(FREE, "false")
        spark.conf.set(FREE, "true")
        try:
            df.write.parquet(f"{path}/{number}")
        finally:
            spark.conf.set(FREE, before)
    return spark.read.schema(schema).parquet(*[f"{path}/{k}" for k in range(number + 1)])
