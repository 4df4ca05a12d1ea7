"""Tables that are worked out once and read several times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """``df``, kept in the shared folder if there is one, else in memory and on disk."""
    if df.sparkSession.conf.get("spark.checkpoint.dir", None):
        df.sparkSession.sparkContext.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir"))
        return df.checkpoint()
    return df.persist()


def filed(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, but a Parquet table, which takes less room for wide rows of like values and gives single columns."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/pitchflow-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
