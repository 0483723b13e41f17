"""Cutting lineage in iterative plans through tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

OWN_FOLDER = "/tmp/checkpoints"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the folder that spark.checkpoint.dir names."""
    spark = df.sparkSession
    folder = (spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or OWN_FOLDER).rstrip("/")
    path = f"{folder}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame, limit: int) -> DataFrame:
    """``df`` kept by the driver; for results behind a top-k, of which there are ``limit`` at most."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; put a limit before them")
    return df.sparkSession.createDataFrame(rows, df.schema)
