"""Label vocabularies, their similarity and groups (V1-V7)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: str | Column) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def label_inventory(df: DataFrame, columns: dict[str, str], slots: str | None = None, pos: str | None = None) -> DataFrame:
    """V1: kind, label, n and, given a position, where each is first seen; columns: kind -> column."""
    at = F.col(pos) if pos else F.lit(0)
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("label")) for k, c in columns.items()])
    if slots:
        parts = F.concat(parts, F.transform(slots, lambda s: F.struct(F.lit("slot").alias("kind"), s.alias("label"))))
    rows = df.select(at.alias("at"), F.explode(parts).alias("e")).where("e.label IS NOT NULL AND e.label != ''")
    return rows.groupBy("e.kind", "e.label").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))


def similarities(vectors: DataFrame) -> DataFrame:
    """V2: a, b, similarity of all ordered pairs of vectors(label, embedding); the vocabulary is small, so one side goes to all."""
    v = vectors.select("label", unit("embedding").alias("u"))
    return v.select(F.col("label").alias("a"), F.col("u").alias("ua")).crossJoin(F.broadcast(v.select(F.col("label").alias("b"), F.col("u").alias("ub")))).select("a", "b", dot("ua", "ub").alias("similarity"))


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """V2: confusable pairs a < b from a cosine on, most similar first."""
    return similarities(vectors).where((F.col("a") < F.col("b")) & (F.col("similarity") >= threshold)).orderBy(F.col("similarity").desc(), "a", "b")


def neighbor_map(pairs: DataFrame) -> DataFrame:
    """V2: label -> sorted neighbours, both ways."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("label")).agg(F.array_sort(F.collect_set("b")).alias("neighbors"))


def nearest_labels(vectors: DataFrame, k: int) -> DataFrame:
    """V3: the k most similar other labels of each, ranked."""
    others = similarities(vectors).where("a != b")
    return others.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.col("similarity").desc(), "b"))).where(F.col("rank") <= k)


def rule_neighbors(labels: DataFrame) -> DataFrame:
    """V3 without vectors: 10 for the same scenario and 5 for the same action, of labels(label)."""
    part = lambda c, i: F.substring_index(c, "_", i)
    a, b = labels.select(F.col("label").alias("a")), labels.select(F.col("label").alias("b"))
    score = F.when(part("a", 1) == part("b", 1), 10).otherwise(0) + F.when(part("a", -1) == part("b", -1), 5).otherwise(0)
    return a.crossJoin(F.broadcast(b)).where("a != b").withColumn("score", score).where("score > 0")


def mean_vectors(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean vector of each label, summed place by place."""
    places = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return places.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias(vector))


def soft_clusters(vectors: DataFrame, assigned: DataFrame, threshold: float = 0.6) -> DataFrame:
    """V4: label, cluster, similarity where a label's cosine with a cluster's unit centroid reaches the threshold; assigned(label, cluster)."""
    unitary = vectors.select("label", unit("embedding").alias("embedding"))
    centroids = mean_vectors(unitary.join(assigned, "label"), "cluster").select("cluster", unit("embedding").alias("c"))
    return unitary.crossJoin(F.broadcast(centroids)).select("label", "cluster", dot("embedding", "c").alias("similarity")).where(F.col("similarity") >= threshold)


def kmeans_groups(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """V5: group -> sorted labels of seeded k-means."""
    data = vectors.select("label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    found = KMeans(k=k, seed=seed).fit(data).transform(data)
    return found.groupBy(F.col("prediction").alias("grp")).agg(F.array_sort(F.collect_list("label")).alias("labels"))


def agglomerative_groups(vectors: DataFrame, n: int) -> DataFrame:
    """V6: label, grp of average-linkage groups, n in all; for a label vocabulary, whose pairs Spark computes and one group merges."""

    def merged(pairs: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pairs["a"].unique())
        at = {x: i for i, x in enumerate(names)}
        far = np.full((len(names), len(names)), np.inf)
        far[pairs["a"].map(at), pairs["b"].map(at)] = 1.0 - pairs["similarity"]
        np.fill_diagonal(far, np.inf)
        size, of = np.ones(len(names)), list(range(len(names)))
        for _ in range(max(0, len(names) - n)):
            i, j = sorted(divmod(int(np.argmin(np.round(far, 12))), len(names)))
            mean = (size[i] * far[i] + size[j] * far[j]) / (size[i] + size[j])
            far[i], far[:, i] = mean, mean
            far[i, i] = np.inf
            far[j], far[:, j] = np.inf, np.inf
            size[i] += size[j]
            of = [i if g == j else g for g in of]
        order = {g: k for k, g in enumerate(dict.fromkeys(of))}
        return pd.DataFrame({"label": names, "grp": [order[g] for g in of]})

    sims = similarities(vectors).withColumn("one", F.lit(1))
    return sims.groupBy("one").applyInPandas(merged, "label string, grp long")


def load_groups(lines: DataFrame, text: str = "value", pos: str = "pos") -> DataFrame:
    """V7: label, grp, members from lines `Group x:` and `- item`; pos is a number.

    Lines are dealt into ranges of pos; the last header is carried inside each range, and over the ranges by one row of each.
    """
    rows = lines.select(F.col(pos).alias("__pos"), F.nullif(F.regexp_extract(text, r"^\s*Group\s+([^:]+):", 1), F.lit("")).alias("g"), F.regexp_extract(text, r"^\s*-\s*(.+?)\s*$", 1).alias("label"))
    n = max(2, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = rows.agg(F.percentile_approx("__pos", [k / n for k in range(1, n)]).alias("bounds"))
    rows = rows.crossJoin(F.broadcast(bounds)).withColumn("part", F.size(F.filter("bounds", lambda x: x < F.col("__pos")))).drop("bounds")
    ends = rows.groupBy("part").agg(F.max_by("g", F.when(F.col("g").isNotNull(), F.col("__pos"))).alias("end"))
    before = ends.select("part", F.last("end", ignorenulls=True).over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    own = F.last("g", ignorenulls=True).over(W.partitionBy("part").orderBy("__pos"))
    rows = rows.withColumn("own", own).where("label != ''").join(before, "part").withColumn("grp", F.coalesce("own", "before")).where("grp IS NOT NULL").select("label", "grp")
    members = rows.groupBy("grp").agg(F.array_sort(F.collect_set("label")).alias("members"))
    return rows.join(members, "grp")


def with_own_groups(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """V7: labels with their group and members, those without one alone in their own."""
    return labels.join(groups, "label", "left").withColumns({"grp": F.coalesce("grp", "label"), "members": F.coalesce("members", F.array("label"))})
