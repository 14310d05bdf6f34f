"""Exact quantiles of large groups, found by narrowing ranges of values by counts; no task holds more than a bounded number of values."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import settled

#: Different values of a range that are put in order in one task, and ranges that a larger one is cut into.
MOST, CUTS = 200_000, 1024
LARGEST = sys.float_info.max


def order_statistics(counted: DataFrame, ranks: DataFrame, by: Sequence[str], most: int = MOST) -> DataFrame:
    """ranks(*by, k) with the k-th value, from 0, of counted(*by, value, n), whose values are different in each group.

    A rank starts with all values of its group. While the values of some range are more than `most`, ranges are cut into equal parts,
    counted, and each rank goes on with the part that holds it: parts have no more than 1/CUTS of the width, so a handful of rounds
    comes to ranges of few values or of one.
    """
    by = list(by)
    spans = counted.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("held"))
    cells = ranks.join(spans, by).withColumn("before", F.lit(0).cast("long")) if by else ranks.crossJoin(spans).withColumn("before", F.lit(0).cast("long"))
    inside = F.col("value").between(F.col("low"), F.col("high"))
    while cells.where((F.col("held") > most) & (F.col("low") < F.col("high"))).head(1):
        ranges = cells.select(*by, "low", "high").distinct()
        here = (counted.join(ranges, by) if by else counted.crossJoin(ranges)).where(inside)
        part = F.coalesce(F.least(F.floor(F.try_divide(F.col("value") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2) * CUTS), F.lit(CUTS - 1)), F.lit(0))
        cut = here.groupBy(*by, "low", "high", part.alias("part")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("held_"), F.min("value").alias("low_"), F.max("value").alias("high_"))
        cut = cut.withColumn("up_to", F.sum("n").over(W.partitionBy(*by, "low", "high").orderBy("part")))
        joined = cells.drop("held").join(cut, [*by, "low", "high"]).withColumn("left", F.col("k") - F.col("before"))
        chosen = joined.where((F.col("left") < F.col("up_to")) & (F.col("left") >= F.col("up_to") - F.col("n")))
        cells = chosen.select(*by, "k", F.col("low_").alias("low"), F.col("high_").alias("high"), F.col("held_").alias("held"), (F.col("before") + F.col("up_to") - F.col("n")).alias("before"))
    here = (counted.join(cells, by) if by else counted.crossJoin(cells)).where(inside)
    here = here.withColumn("up_to", F.col("before") + F.sum("n").over(W.partitionBy(*by, "k").orderBy("value")))
    return here.where((F.col("k") < F.col("up_to")) & (F.col("k") >= F.col("up_to") - F.col("n"))).select(*by, "k", "value")


def exact_quantiles(df: DataFrame, columns: Sequence[str], points: Sequence[float], by: Sequence[str] = (), most: int = MOST) -> DataFrame:
    """*by, name, values: for each group and column the linearly interpolated quantiles at the points, in their order.

    Nulls and NaN are left out, infinite values stand for the largest finite ones; a group without values in a column has no row for it. Groups with a null in `by` are left out, too.
    """
    by = list(by)
    number = {c: F.col(c).cast("double") for c in columns}
    finite = {c: F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST))) for c, x in number.items()}
    each = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), finite[c].alias("value")) for c in columns])).alias("e")).select(*by, "e.*").where("value IS NOT NULL")
    keys = [*by, "name"]
    counted = settled(each.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n")), "values")  # every round reads them
    sizes = counted.groupBy(*keys).agg(F.sum("n").alias("size"))
    at = F.array(*[F.struct(F.lit(i).alias("point"), (F.lit(float(p)) * (F.col("size") - 1)).alias("at")) for i, p in enumerate(points)])
    wanted = sizes.select(*keys, F.explode(at).alias("w")).select(*keys, "w.*").withColumn("low", F.floor("at")).withColumn("share", F.col("at") - F.col("low"))
    ends = wanted.select(*keys, "point", "share", F.explode(F.array(F.struct(F.col("low").alias("k"), (1 - F.col("share")).alias("weight")), F.struct(F.ceil("at").alias("k"), F.col("share").alias("weight")))).alias("e")).select(*keys, "point", "e.*")
    found = order_statistics(counted, ends.select(*keys, "k").distinct(), keys, most)
    mixed = ends.join(found, [*keys, "k"]).groupBy(*keys, "point").agg(F.sum(F.when(F.col("weight") > 0, F.col("weight") * F.col("value")).otherwise(0.0)).alias("q"))
    return mixed.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("point", "q"))), lambda x: x["q"]).alias("values"))
