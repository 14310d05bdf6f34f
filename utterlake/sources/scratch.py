"""Tables that a job writes for its own later steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written once below spark.checkpoint.dir, which all tasks share (the warehouse where that is unset), and read from there."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
