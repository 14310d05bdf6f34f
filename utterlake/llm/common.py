"""What the corpus operators share: table access, the shared scratch folder, and Arrow batches as flat byte arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spaces of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share; below the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: later reads don't compute them again and outlive lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many _ behind it as it takes to be no column of df."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def whole(text: str | Column) -> Column:
    """The text; null is empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def parts_for(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions as the session has them, which a job sizes to its input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose column holds at most so many bytes, one row at least; no text is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(_lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _lengths(array: pa.Array) -> np.ndarray:
    _, offsets = raw(array)
    return np.diff(offsets)


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array without nulls, and the offsets of its rows in them; nothing is copied."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def as_binary(parts: list) -> pa.Array:
    return pa.array([bytes(memoryview(np.ascontiguousarray(x))) if isinstance(x, np.ndarray) else x for x in parts], pa.binary())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
