"""Statistics of labelled embeddings (G1-G9). Centroids are few and are sent to all tasks; rows never meet each other but in G6's sample."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .vocabulary import dot, mean_vectors, unit

UNKNOWN = "__unknown__"


def doubles(v: str = "embedding") -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def distance(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def prepare_features(df: DataFrame, least: int = 2) -> DataFrame:
    """G1: unit vectors of labels with at least so many rows, without unknown ones."""
    known = df.where(F.col("label").isNotNull() & (F.col("label").cast("string") != UNKNOWN))
    big = known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return known.join(big.select("label"), "label", "left_semi").withColumn("embedding", unit("embedding"))


def centroids(df: DataFrame) -> DataFrame:
    """label, centroid, n."""
    found = df.groupBy("label").agg(Summarizer.mean(array_to_vector(doubles())).alias("m"), F.count(F.lit(1)).alias("n"))
    return found.select("label", vector_to_array("m").alias("centroid"), "n")


def centroid_distances(df: DataFrame) -> DataFrame:
    """a, b, distance of all pairs of different labels' centroids."""
    c = centroids(df)
    a, b = c.select(F.col("label").alias("a"), F.col("centroid").alias("ca")), c.select(F.col("label").alias("b"), F.col("centroid").alias("cb"))
    return a.crossJoin(F.broadcast(b)).where("a != b").select("a", "b", distance("ca", "cb").alias("distance"))


def distance_stats(df: DataFrame) -> DataFrame:
    """For each label: rows, mean distance to its centroid, nearest other centroid and its distance, and their ratio."""
    c = centroids(df)
    intra = df.join(c, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(distance(doubles(), F.col("centroid"))).alias("intra"))
    near = centroid_distances(df).groupBy(F.col("a").alias("label")).agg(F.min_by("b", F.struct("distance", "b")).alias("nearest"), F.min("distance").alias("nearest_distance"), F.avg("distance").alias("mean_distance"))
    return intra.join(near, "label", "left").withColumn("separation", F.when(F.col("intra") > 0, F.col("nearest_distance") / F.col("intra")))


def spherical_stats(df: DataFrame) -> DataFrame:
    """For each label of unit vectors: mean cosine within it, best cosine of its unit centroid with another, and the gap."""
    c = centroids(df).withColumn("sum2", dot("centroid", "centroid") * F.col("n") * F.col("n")).withColumn("u", unit("centroid"))
    own = c.select("label", "n", F.when(F.col("n") > 1, (F.col("sum2") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("intra"))
    pairs = c.select(F.col("label").alias("a"), F.col("u").alias("ua")).crossJoin(F.broadcast(c.select(F.col("label").alias("b"), F.col("u").alias("ub")))).where("a != b")
    near = pairs.groupBy(F.col("a").alias("label")).agg(F.max(dot("ua", "ub")).alias("nearest"))
    return own.join(near, "label", "left").withColumn("gap", F.col("intra") - F.col("nearest"))


def with_margins(df: DataFrame) -> DataFrame:
    """Rows with margin (distance to the nearest other centroid less that to their own) and its share of the sum of both."""
    every = centroids(df).agg(F.collect_list(F.struct("label", "centroid")).alias("all"))
    rows = df.select("*", doubles().alias("__v")).crossJoin(F.broadcast(every))
    d = F.transform("all", lambda c: F.struct(c["label"].alias("label"), distance(F.col("__v"), c["centroid"]).alias("d")))
    rows = rows.withColumn("__d", d)
    own = F.element_at(F.filter("__d", lambda x: x["label"] == F.col("label")), 1)["d"]
    other = F.array_min(F.transform(F.filter("__d", lambda x: x["label"] != F.col("label")), lambda x: x["d"]))
    return rows.withColumns({"margin": other - own, "normalised": (other - own) / F.greatest(other + own, F.lit(1e-12))}).drop("all", "__v", "__d")


def margin_stats(df: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """Mean, median and positive share of margins and normalised margins, and their 10 and 90 % points, all exact."""
    names = ("margin", "normalised")
    m = with_margins(df).select(*by, *names)
    means = m.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("margin") > 0).cast("int")).alias("positive"), *[F.avg(c).alias(f"{c}_mean") for c in names])
    points = exact_quantiles(m, names, (0.5, 0.1, 0.9), by)
    wide = points.groupBy(*by).agg(*[F.max(F.when(F.col("name") == c, F.col("values")[k])).alias(f"{c}_{p}") for c in names for k, p in enumerate(("median", "p10", "p90"))])
    return means.join(wide, list(by), "left") if by else means.crossJoin(wide)


def fisher_ratio(df: DataFrame) -> DataFrame:
    """Scatter between classes over scatter within them."""
    c = centroids(df)
    mean = df.select(Summarizer.mean(array_to_vector(doubles())).alias("m")).select(vector_to_array("m").alias("mu"))
    between = c.crossJoin(F.broadcast(mean)).agg(F.sum(F.col("n") * F.pow(distance("centroid", "mu"), 2)).alias("between"))
    within = df.join(c, "label").agg(F.sum(F.pow(distance(doubles(), F.col("centroid")), 2)).alias("within"))
    return between.crossJoin(within).withColumn("fisher", F.col("between") / F.col("within"))


def silhouette_cosine(df: DataFrame) -> DataFrame:
    """Label, n, mean silhouette of unit vectors by cosine distance, exact from class sums; a class of one row has 0."""
    sums = centroids(df).select("label", "n", F.transform("centroid", lambda x: x * F.col("n")).alias("s"))
    every = sums.agg(F.collect_list(F.struct("label", "n", "s")).alias("all"))
    rows = df.select("label", doubles().alias("v")).crossJoin(F.broadcast(every))
    d = F.transform("all", lambda c: F.struct(c["label"].alias("label"), c["n"].alias("n"), dot(F.col("v"), c["s"]).alias("dot")))
    rows = rows.select("label", d.alias("d"))
    own = F.element_at(F.filter("d", lambda x: x["label"] == F.col("label")), 1)
    rows = rows.select("label", own["n"].alias("n"), F.when(own["n"] > 1, (own["n"] - own["dot"]) / (own["n"] - 1)).alias("a"), F.array_min(F.transform(F.filter("d", lambda x: x["label"] != F.col("label")), lambda x: 1 - x["dot"] / x["n"])).alias("b"))
    value = F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-12))).otherwise(0.0)
    return rows.withColumn("s", value).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("silhouette"))


def silhouette_euclidean(df: DataFrame, most: int = 4000, seed: int = 0) -> DataFrame:
    """The same by Euclidean distance, on a seeded sample of at most `most` rows with one of every class at least.

    The cap is the feature: the sample is bounded, so it is sent to all tasks, which work through their own rows of it in blocks.
    """
    order = F.row_number().over(W.partitionBy("label").orderBy(F.md5(F.concat_ws("|", F.col("vec_id").cast("string"), F.lit(seed)))))
    ranked = df.withColumn("__r", order)
    sample = ranked.orderBy((F.col("__r") > 1), F.md5(F.concat_ws("|", F.col("vec_id").cast("string"), F.lit(seed)))).limit(most).select("vec_id", F.col("label").cast("string").alias("label"), doubles().alias("v"))
    every = sample.toPandas()
    x, names = np.array(every["v"].tolist(), np.float64), every["label"].to_numpy()
    kinds, code = np.unique(names, return_inverse=True)
    count = np.bincount(code)
    one = np.eye(len(kinds))[code]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = np.array(b["v"].tolist(), np.float64)
            mine = np.searchsorted(kinds, b["label"].to_numpy())
            far = np.sqrt(np.maximum((v**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * v @ x.T, 0)) @ one
            at = np.arange(len(b))
            a = far[at, mine] / np.maximum(count[mine] - 1, 1)
            rest = far / count
            rest[at, mine] = np.inf
            near = rest.min(axis=1)
            s = np.where(count[mine] > 1, (near - a) / np.maximum(np.maximum(a, near), 1e-12), 0.0)
            yield pd.DataFrame({"label": b["label"], "s": s})

    return sample.mapInPandas(scored, "label string, s double").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("silhouette"))


def mean_distance_ranks(df: DataFrame, step: int = 1) -> DataFrame:
    """Labels by mean centroid distance (ties: nearest, larger class, name); ranks 1, the last, and every step."""
    stats = distance_stats(df).select("label", "n", "mean_distance", "nearest_distance")
    ranked = stats.withColumn("rank", F.row_number().over(W.orderBy("mean_distance", "nearest_distance", F.col("n").desc(), "label"))).withColumn("labels", F.count(F.lit(1)).over(W.partitionBy()))
    return ranked.where((F.col("rank") == 1) | (F.col("rank") == F.col("labels")) | (F.pmod(F.col("rank") - 1, F.lit(step)) == 0))


def distance_table(df: DataFrame, order: Sequence) -> DataFrame:
    """Distances of the ordered labels as a wide table."""
    return centroid_distances(df).where(F.col("a").isin(list(order)) & F.col("b").isin(list(order))).groupBy("a").pivot("b", list(order)).agg(F.first("distance")).na.fill(0.0)


def pca_2d(df: DataFrame) -> tuple[DataFrame, list[float]]:
    """Rows with x and y, centred, and the shares of variance explained; signs are free."""
    mean = df.select(Summarizer.mean(array_to_vector(doubles())).alias("m")).head()["m"].toArray().tolist()
    at = F.array(*[F.lit(float(x)) for x in mean])
    data = df.withColumn("f", array_to_vector(F.zip_with(doubles(), at, lambda x, m: x - m)))
    model = PCA(k=2, inputCol="f", outputCol="p").fit(data)
    out = model.transform(data).withColumn("p", vector_to_array("p"))
    return out.select(*df.columns, F.col("p")[0].alias("x"), F.col("p")[1].alias("y")), model.explainedVariance.toArray().tolist()


#: Signs that one hash of a row gives.
SIGNS = 64


def sign_sums(key: np.ndarray, d: np.ndarray, iters: int, seed: int) -> np.ndarray:
    """Sums of d under each iteration's signs, which are bits of a hash of the row's key and of a block of SIGNS iterations."""
    out = np.empty(-(-iters // SIGNS) * SIGNS)
    for block in range(len(out) // SIGNS):
        x = key + np.uint64(((seed << 20) + block + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[block * SIGNS : (block + 1) * SIGNS] = 2.0 * (d @ bits) - d.sum()
    return out[:iters]


def paired_test(pairs: DataFrame, iters: int = 200, seed: int = 0, t: float = 0.95) -> DataFrame:
    """pairs(key, a, b): means, medians, points of the ratio a/b, shares, and sign-flip p-values of the mean difference.

    p_value is two-sided, p_lower counts flipped means no larger than the one seen, p_upper none smaller. Every batch adds up its
    own differences under each iteration's signs, which only depend on key, seed and iteration; only the sums meet.
    """
    rows = pairs.select("key", "a", "b", (F.col("a") / F.greatest("b", F.lit(1e-12))).alias("ratio"), (F.col("a") - F.col("b")).alias("d"))
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("ratio").alias("ratio_mean"),
        F.avg((F.col("a") < F.col("b")).cast("int")).alias("share_less"), F.avg((F.col("a") <= t * F.col("b")).cast("int")).alias("share_t"), F.avg("d").alias("difference"),
    )
    points = exact_quantiles(rows, ["a", "b", "ratio", "d"], (0.5, 0.1, 0.9))
    value = lambda name, k: F.max(F.when(F.col("name") == name, F.col("values")[k]))
    wide = points.agg(value("a", 0).alias("median_a"), value("b", 0).alias("median_b"), value("d", 0).alias("difference_median"), value("ratio", 0).alias("ratio_median"), value("ratio", 1).alias("ratio_p10"), value("ratio", 2).alias("ratio_p90"))

    def flipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(iters)
        for b in batches:
            total += sign_sums(b["h"].to_numpy().astype(np.uint64), b["d"].to_numpy(), iters, seed)
        yield pd.DataFrame({"i": np.arange(iters), "s": total})

    sums = rows.select("d", F.xxhash64("key").alias("h")).mapInPandas(flipped, "i long, s double").groupBy("i").agg(F.sum("s").alias("s"))
    mean, seen = F.col("s") / F.col("n"), F.col("difference")
    p = lambda c: ((F.count_if(c) + 1) / F.lit(float(iters + 1)))
    tests = sums.crossJoin(F.broadcast(stats.select("difference", "n"))).agg(p(F.abs(mean) >= F.abs(seen) - 1e-12).alias("p_value"), p(mean <= seen + 1e-12).alias("p_lower"), p(mean >= seen - 1e-12).alias("p_upper"))
    return stats.crossJoin(wide).crossJoin(tests)
