"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sizes are words. A source's target is its share of all words by weight, at most a multiple of its own size; what a full source
leaves is shared anew by weight. Targets become integer numbers of equal blocks by the highest quotients, first for sources,
then for the shards of each source; in a shard, seeded order picks the blocks. A shard holds a bounded number of documents, so a
hot source is only more shards.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, free, table, whole, written

BLOCK = 64
#: Words of a shard at least, and shards over all at most: neither a shard nor their table grows into one task's burden.
SHARD_WORDS = 100_000
MOST_SHARDS = 20_000
#: A prime above any shard's number of blocks: its multiples run through all blocks before they repeat.
STRIDE = 2_654_435_761
SEED = 17
MOST = 3


def words_in(text: str | Column) -> Column:
    """The number of runs of non-spaces."""
    t = F.regexp_replace(whole(text), f"^{SPACES}", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(F.regexp_replace(t, f"{SPACES}$", ""), SPACES))).cast("long")


def capped_shares(sizes: Sequence[int], weights: Sequence[float], most: float = MOST) -> list[float]:
    """Shares of sum(sizes) by weight, none above most times its size; the excess is shared by weight among the others."""
    target, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = float(most * sizes[i])
        free = [i for i in free if i not in over]
        left = float(sum(sizes)) - sum(target)
    return target


def highest_quotients(targets: Sequence[float], seats: int, limits: Sequence[int] | None = None) -> list[int]:
    """Sainte-Laguë: seats go one by one to the highest target / (2 * seats so far + 1); ties to the earlier. limits bounds each.

    The result of the seat-by-seat rule is found by bisecting for the last quotient given, so its cost doesn't grow with seats.
    """
    limits = list(limits) if limits is not None else [seats] * len(targets)
    if not targets or max(targets) <= 0:
        return [0] * len(targets)
    taken = lambda q: [min(m, max(0, math.floor((t / q - 1) / 2) + 1)) for t, m in zip(targets, limits, strict=True)]
    low, high = max(targets) / (2.0 * seats + 3) / 1e6, max(targets) * 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(taken(mid)) > seats else (low, mid)
    got = taken(high)
    for _ in range(len(targets)):
        open_ = [i for i in range(len(targets)) if got[i] < limits[i]]
        if sum(got) >= seats or not open_:
            break
        i = max(open_, key=lambda i: (targets[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


def drawn(seed: int) -> Column:
    """A seeded hash of the identifier doc_id; of the row's place `at` where that is null, as very many rows may have none."""
    return F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("at")), F.lit(seed))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), most: int = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target (of its source), taken (words the mix takes).

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. A shard's blocks run over its documents' words in a seeded
    order; a block is taken as often as the shard's quota goes round its blocks, at most `most` times. A document takes the words
    it has in taken blocks, repeats counted, so never more than `most` times its size. The same seed gives the same mix. Empty
    texts have size 0 and take nothing; an empty table gives no rows. Rows repeated with one identifier each count; rows without one
    are dealt by their place in the input, so that many of them spread over shards as others do. Only the table
    of sources, whose number is that of distinct source names, comes to the driver.
    """
    spark = docs.sparkSession
    sized = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_in(text_col).alias("size"), F.monotonically_increasing_id().alias("at")), "mix-sizes")
    totals = sorted(((r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    if not totals:
        return sized.select("doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    sizes = [n for _, n in totals]
    targets = capped_shares(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    quotas = highest_quotients(targets, round(sum(targets) / block), [most * -(-n // block) for n in sizes])
    shard_words = max(SHARD_WORDS, sum(sizes) // MOST_SHARDS)
    plan = spark.createDataFrame(
        [(s, n, t, q, max(1, -(-n // shard_words))) for (s, n), t, q in zip(totals, targets, quotas, strict=True)],
        "source string, source_size long, target double, quota long, shards long",
    )
    own = F.col("sized.source").eqNullSafe(F.col("plan.source"))
    dealt = sized.alias("sized").join(F.broadcast(plan).alias("plan"), own).select("doc_id", "sized.source", "size", "at", "source_size", "target", "quota", F.pmod(drawn(seed), F.col("shards")).alias("shard"))
    dealt = dealt.withColumn("order", drawn(seed + 1))
    # Quotas of shards: the same rule within each source; its shards are few, and their quotients are ranked with a window.
    # Both small tables are written: what comes after would hold the whole plan behind them several times.
    shards = written(dealt.groupBy("source", "shard", "quota").agg(F.sum("size").alias("words")), "mix-shards")
    shards = shards.withColumn("blocks", F.ceil(F.col("words") / block)).withColumn("all", F.sum("words").over(W.partitionBy("source")))
    shards = shards.withColumn("ideal", F.when(F.col("all") > 0, F.col("quota") * F.col("words") / F.col("all")).otherwise(0.0)).withColumn("given", F.greatest(F.lit(0), F.least(F.col("blocks") * most, F.floor("ideal") - 1)))
    shards = shards.withColumn("sure", F.sum("given").over(W.partitionBy("source")))
    seats = shards.select("source", "shard", "quota", "blocks", "given", "ideal", "sure", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k"))
    seats = seats.where(F.col("given") + F.col("k") < F.col("blocks") * most)
    by_quotient = W.partitionBy("source").orderBy((F.col("ideal") / (2 * (F.col("given") + F.col("k")) + 1)).desc(), "shard", "k")
    won = seats.withColumn("rank", F.row_number().over(by_quotient)).where(F.col("rank") <= F.col("quota") - F.col("sure")).groupBy("source", "shard").agg(F.count(F.lit(1)).alias("more"))
    same = ["source", "shard"]
    match = lambda a, b: (F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))) & (F.col(f"{a}.shard") == F.col(f"{b}.shard"))
    quota = shards.alias("a").join(won.alias("b"), match("a", "b"), "left").where("words > 0").select("a.source", "a.shard", "words", (F.col("given") + F.coalesce("more", F.lit(0))).alias("share"))
    quota = written(quota, "mix-quotas")
    placed = dealt.where("size > 0").withColumn("end", F.sum("size").over(W.partitionBy(*same).orderBy("order", "doc_id", "at").rowsBetween(W.unboundedPreceding, 0)))
    placed = placed.withColumn("start", F.col("end") - F.col("size"))
    spans = placed.select(*same, "at", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("block"))
    inside = F.least("end", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    # A shard goes round its words as often as its share holds them; the rest are full blocks in seeded order, its short last block coming last.
    goal, full = F.col("share") * block, F.floor(F.col("p.words") / block)
    rounds = F.least(F.lit(most), F.floor(goal / F.col("p.words")))
    more = F.when(rounds >= most, F.lit(0)).otherwise(F.floor((goal - rounds * F.col("p.words")) / block + 0.5))
    rank = F.pmod(F.col("block") * F.lit(STRIDE) + F.pmod(F.xxhash64("s.source", "s.shard", F.lit(seed + 2)), F.greatest(full, F.lit(1))), F.greatest(full, F.lit(1)))
    times = rounds + F.when(F.col("block") < full, rank < more).otherwise(more > full).cast("long")
    taken = spans.withColumn("inside", inside).alias("s").join(F.broadcast(quota).alias("p"), match("s", "p")).groupBy("at").agg(F.sum(F.col("inside") * times).alias("taken"))
    return dealt.join(taken, "at", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """The rows of docs as the mix repeats them: a document stands as often as taken / size, a seeded draw rounding up or down.

    Documents without words stay once. Rows of one identifier are taken alike, by the first of them.
    """
    own_id, times, copy = free(docs, "__id", "__times", "__copy")
    found = mix(docs, seed=seed, **how)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed + 3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    often = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + draw)).cast("int")
    taken = found.groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).select(F.col("doc_id").alias(own_id), often.alias(times)).where(F.col(times) > 0)
    return docs.join(taken, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id))).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


SQL: dict[str, str] = {}
