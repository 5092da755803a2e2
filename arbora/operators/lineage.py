"""Cutting lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` as checkpointed rows in the folder of ``spark.checkpoint.dir``; a folder of this session's own only if that is unset."""
    _checkpoint_dir(df)
    return df.checkpoint()


def _checkpoint_dir(df: DataFrame) -> None:
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="arbora-"))


def columnar(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as Parquet under the same folder, a folder for each value of ``by``: readers take one value's files and their own columns."""
    context = df.sparkSession.sparkContext
    _checkpoint_dir(df)
    path = f"{context._jsc.sc().getCheckpointDir().get()}/relations-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
