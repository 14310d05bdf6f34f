"""Exact deduplication as a stateful stream.

Every document becomes a slim arrival: digest of its normalised text, identifier and locator. A stream over the arrivals keeps,
in RocksDB state keyed by the digest and never expired, the smallest identifier with its locator and the number of arrivals.
A digest that arrived twice is a hit: the whole texts of hits are then grouped by (digest, bytes), so that texts of one digest
that differ come apart again. All of it is DataFrame work; hot groups only meet in sums with partial aggregation, or in joins
that Spark can split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, free, scratch, table, whole, written

#: State on disk; many small stores share an executor, so none reserves files ahead, and commits send changes instead of files.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(whole(text), SPACES, " ")


def first_arrivals(arrivals: DataFrame, files_per_batch: int = 2000) -> DataFrame:
    """One row for each digest of the written table arrivals(digest, row struct): the least row and the number of rows.

    The stream's state is on disk (RocksDB), its checkpoint in the shared folder; each micro-batch appends the keys it changed,
    and the latest entry of a key is its result.
    """
    spark = arrivals.sparkSession
    out, log = scratch(spark, "dedup-groups"), scratch(spark, "dedup-stream")
    held = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals.inputFiles()[0].rpartition("/")[0])
        state = stream.groupBy("digest").agg(F.min("row").alias("keeper"), F.count(F.lit(1)).alias("arrived"))
        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", log).trigger(availableNow=True)
            .foreachBatch(lambda changed, n: changed.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/n={n}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = arrivals.select("digest", F.col("row").alias("keeper"), F.lit(1).cast("long").alias("arrived"), F.lit(0).cast("long").alias("batch")).schema
    seen = spark.read.schema(schema).parquet(f"{out}/n=*") if arrivals.head(1) else spark.createDataFrame([], schema)
    return seen.groupBy("digest").agg(F.max_by("keeper", "batch").alias("keeper"), F.max_by("arrived", "batch").alias("arrived"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256)) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of spaces became one space; null is empty. The row with the smallest identifier
    stays; a null identifier comes last, and of rows repeated with one identifier a single one stays. An empty table gives no rows;
    other columns of docs are not read. digest may be any function of the text: equal digests of different texts are told apart.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("text"))
    arrivals = written(
        source.select(
            digest(F.col("text")).cast("string").alias("digest"), F.sha2("text", 256).alias("text_sha256"),
            F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.monotonically_increasing_id().alias("at"), F.input_file_name().alias("locator")).alias("row"),
        ),
        "dedup-arrivals",
    )
    groups = written(first_arrivals(arrivals), "dedup-state")
    hits = groups.where("arrived > 1").select("digest")
    found = source.withColumn("digest", digest(F.col("text")).cast("string")).join(hits, "digest", "left_semi")
    texts = written(found.withColumn("row", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.monotonically_increasing_id().alias("at"))), "dedup-hits")
    kinds = texts.select("digest", "text").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("digest")
    clashes = written(kinds, "dedup-clashes")
    alone = arrivals.join(groups, "digest").join(clashes, "digest", "left_anti")
    apart = texts.join(clashes, "digest", "left_semi")
    least = apart.groupBy("digest", "text").agg(F.min("row").alias("keeper"), F.count(F.lit(1)).alias("arrived"))
    apart = apart.join(least, ["digest", "text"]).withColumn("text_sha256", F.sha2("text", 256))
    both = alone.select("row.doc_id", "row.at", "keeper.at", "keeper.doc_id", "arrived", "text_sha256").toDF("doc_id", "at", "keep_at", "keep_id", "arrived", "text_sha256")
    both = both.unionByName(apart.select("row.doc_id", "row.at", "keeper.at", "keeper.doc_id", "arrived", "text_sha256").toDF(*both.columns))
    return both.select("doc_id", "keep_id", F.col("arrived").alias("group_size"), (F.col("at") == F.col("keep_at")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; of rows repeated with one identifier and text, one.

    Of texts that only rows with a null identifier have, one row stays.
    """
    own_id, own_sha, kept_id, kept_sha = free(docs, "__own_id", "__own_sha", "__id", "__sha")
    kept = written(exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha)), "dedup-kept")
    keyed = docs.withColumns({own_id: F.col(id_col).cast("long"), own_sha: F.sha2(normalised(text_col), 256)})
    rows = keyed.join(kept, (F.col(own_sha) == F.col(kept_sha)) & F.col(own_id).eqNullSafe(F.col(kept_id)), "left_semi")
    repeated = docs.groupBy(F.col(id_col).cast("long")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1)
    return (rows.dropDuplicates([own_id, own_sha]) if repeated else rows).drop(own_id, own_sha)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op7_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)""",
}
