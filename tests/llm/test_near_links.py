"""Links of near copies that share one bucket, in buckets of any number of blocks."""

import numpy as np
from pyspark.sql import functions as F

from utterlake.llm import near_dedup as N


def _docs(spark, n):
    """n documents in one bucket, unlike each other but for two: those agree in one band and in three of four registers of the others."""
    rng = np.random.default_rng(1)
    signature = rng.integers(0, 1 << 32, (n, 128), dtype=np.uint64).astype("<u4")
    signature[:, :4] = 7
    signature[-1] = signature[-2]
    signature[-1, 4::4] += 1
    bands = [[1, *(int(x) for x in rng.integers(10, 1 << 60, 31))] for _ in range(n)]
    keys = [np.sort(rng.integers(0, 1 << 60, 50, dtype=np.uint64)).astype("<u8") for _ in range(n)]
    keys[-1] = keys[-2]
    rows = [(k, 50, bands[k], bytearray(signature[k].tobytes())) for k in range(n)]
    shingled = [(k, bytearray(keys[k].tobytes()), bytearray()) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, size long, bands array<long>, signature binary"), spark.createDataFrame(shingled, "doc_id long, keys binary, counts binary")


def test_links_do_not_depend_on_the_number_of_blocks(spark):
    docs, shingled = _docs(spark, 12)
    for block in (100, 5, 1):
        found = N.near_links(docs, lambda ids: shingled.join(ids, "doc_id"), block=block)
        assert [tuple(r) for r in found.collect()] == [(10, 11)]


def test_rows_inside_a_class_only_meet_those_outside(spark):
    rows = spark.range(100).select(F.lit(1).alias("bucket"), F.col("id").alias("doc"), F.lit(1).alias("size"), F.when(F.col("id") < 3, F.col("id")).otherwise(50).alias("label"), (F.col("id") < 3).alias("outside"), F.lit(0).alias("one"))
    met = {}
    tasks = N._tasks(rows, 10).collect()
    for r in tasks:
        met.setdefault((r["low"], r["high"]), []).append((r["doc"], r["own"]))
    pairs = {(a, b) for (low, high), docs in met.items() for a, x in docs for b, y in docs if a < b and (low == high or x != y)}
    assert {(a, b) for a in range(3) for b in range(a + 1, 100)} <= pairs
    assert len(tasks) == 97 + 3 * 11
