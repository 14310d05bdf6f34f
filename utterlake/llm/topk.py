"""Exact top-k search by inner product: columnar branch and bound.

Each query first meets a bounded sample of the candidates; its k-th best score there is a floor for what can be among its k best.
Then vectors are dealt into blocks; each pair of a query block and a candidate block is a task of bounded size. In it the candidates
lie dimension by dimension; those whose length alone keeps them below the floor are not looked at. A query adds up its products for a few dimensions at a time; what the other dimensions can still add is at
most the product of the remaining lengths, so candidates whose best end is below the k-th best sure score or the floor are dropped
and the survivors are packed together before the next dimensions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts_for, scratch, table, written

SCALE = 256
STEP = 16
QUERY_BLOCK = 4096
ROW_BLOCK = 8192
#: Candidates that give the floors.
SAMPLE = 2048


def best_of(query: np.ndarray, columns: np.ndarray, masses: np.ndarray, own: int, k: int, floor: float = -np.inf, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the candidates that can be among the k best for the query; ties at the end are all kept.

    columns: dimensions by candidates, whole numbers; masses: their squared lengths; own: the place to leave out, or -1; floor: a
    score that k candidates somewhere reach.
    """
    order = np.argsort(-np.abs(query), kind="stable")
    rest = np.concatenate((np.sqrt(np.cumsum(query[order][::-1] ** 2))[::-1], [0.0]))
    alive = np.flatnonzero(rest[0] * np.sqrt(masses) * (1 + 1e-9) + 1e-6 >= floor)
    if own >= 0:
        alive = alive[alive != own]
    mass = masses[alive]
    sums = np.zeros(len(alive))
    for at in range(0, len(query), step):
        dims = order[at : at + step]
        block = columns[np.ix_(dims, alive)] if len(alive) < columns.shape[1] else columns[dims]
        sums += query[dims] @ block
        mass -= (block**2).sum(axis=0)
        if len(alive) and at + step < len(query):
            slack = rest[at + step] * np.sqrt(np.maximum(mass, 0)) * (1 + 1e-9) + 1e-6
            sure = max(floor, np.partition(sums - slack, len(alive) - k)[len(alive) - k]) if len(alive) > k else floor
            stay = sums + slack >= sure
            alive, sums, mass = alive[stay], sums[stay], mass[stay]
    if len(alive) > k:
        stay = sums >= np.partition(sums, len(alive) - k)[len(alive) - k]
        alive, sums = alive[stay], sums[stay]
    return alive, sums


def _matrix(block: pa.Table) -> np.ndarray:
    flat = block.column("values").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    values = np.asarray(flat.flatten(), np.float64)
    return values.reshape(block.num_rows, len(values) // max(1, block.num_rows))


def _pair(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    names = ["query_id", "query_at", "vec_id", "score"]
    floors = [-np.inf if f is None else f for f in queries.column("floor").to_pylist()]
    out: list[list] = [[], [], [], []]
    if queries.num_rows and rows.num_rows:
        columns, asked = np.ascontiguousarray(_matrix(rows).T), _matrix(queries)
        masses = (columns**2).sum(axis=0)
        ids, place = rows.column("vec_id").to_pylist(), {a: i for i, a in enumerate(rows.column("at").to_pylist())}
        for q, at, vector, floor in zip(queries.column("vec_id").to_pylist(), queries.column("at").to_pylist(), asked, floors, strict=True):
            found, scores = best_of(vector, columns, masses, place.get(at, -1), k, floor)
            ranked = sorted(zip((-scores).tolist(), (float("inf") if ids[i] is None else ids[i] for i in found), found.tolist(), strict=True))[:k]
            for score, _, i in ranked:
                for column, value in zip(out, (q, at, ids[i], int(-score)), strict=True):
                    column.append(value)
    return pa.table([pa.array(c, pa.int64()) for c in out], names)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the highest inner products for each row whose id is divisible by `every`.

    Components become floor(scale * x). A row is no candidate for itself; ties go to the smaller id, a null id last, and rows that
    repeat an id are rows of their own. Vectors that are null or hold null or non-finite components take no part; only vectors
    of one length are compared, so empty ones score 0 among each other. Sums up to 2**53 are exact. Fewer than k candidates give fewer rows.
    """
    spark, x = vectors.sparkSession, F.col(vector_col)
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(sound).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("values"),
        F.size(x).alias("dims"), F.monotonically_increasing_id().alias("at"),
    )
    path = scratch(spark, "topk-rows")
    rows.write.option("compression", "zstd").parquet(path)
    rows, own = (spark.read.schema(rows.schema).parquet(path) for _ in range(2))  # read twice, so that they can meet
    asked = own.where(F.col("vec_id") % every == 0)
    n, m = rows.count(), asked.count()
    across, down = max(1, -(-m // query_block)), max(1, -(-n // row_block), min(parts_for(spark), n // 1024))
    deal = lambda parts, salt: F.pmod(F.xxhash64("at", F.lit(salt)), F.lit(parts)).cast("int")
    copies = lambda name, parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(name)
    every = ["vec_id", "values", "dims", "at"]
    schema = "query_id long, query_at long, vec_id long, score long"

    def best(queries: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
        return queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(lambda a, b: _pair(a, b, k), schema)

    queries = asked.select(*every, deal(across, 0).alias("q"))
    sample = rows.where(deal(max(1, n // SAMPLE), 2) == 0).select(*every, copies("q", across))
    tried = best(queries.withColumn("floor", F.lit(None).cast("double")), sample, ["dims", "q"])
    floors = tried.groupBy(F.col("query_at").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least"))
    floors = written(floors.select("at", F.when(F.col("n") == k, F.col("least")).alias("floor")), "topk-floors")
    queries = queries.join(floors, "at", "left").select(*every, "q", "floor", copies("r", down))
    found = best(queries, rows.select(*every, deal(down, 1).alias("r"), copies("q", across)), ["dims", "q", "r"])
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "query_at").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = {
    "op8_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
