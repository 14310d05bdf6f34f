"""Tolerant readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .records import read_records

__all__ = ["read_corpus", "read_csv_json", "read_jsonl", "read_records", "write_csv_json", "write_jsonl"]


def _schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType) -> DataFrame:
    """One record for each line that is a JSON object; blank, malformed and other lines are skipped."""
    schema = _schema(schema)
    lines = spark.read.text(path).where(F.trim("value").startswith("{"))
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    found = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return found.where("r._bad IS NULL").select("r.*").select(*schema.names)


def write_jsonl(df: DataFrame, path: str) -> None:
    """S3: a JSON object for each row, in UTF-8; null fields are left out."""
    df.write.mode("overwrite").json(path, encoding="UTF-8")


def read_csv_json(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], json_columns: dict[str, str]) -> DataFrame:
    """CSV with a header; cells of json_columns (name -> type) that start as JSON are parsed, others there are null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    parsed = {c: F.when(F.trim(c).rlike(r"^[{\[]"), F.from_json(c, t)) for c, t in json_columns.items()}
    return df.withColumns(parsed)


def write_csv_json(df: DataFrame, path: str) -> None:
    """CSV with a header; nested cells are written as JSON."""
    nested = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("struct", "array", "map"))}
    df.withColumns(nested).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_corpus(spark: SparkSession, folder: str, config: str, split: str) -> DataFrame:
    """Parquet files <config>/<split>-*.parquet."""
    return spark.read.parquet(f"{folder}/{config}/{split}-*.parquet")
