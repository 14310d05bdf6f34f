"""Joining predictions, gold and side tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalise import ENTITY, clean, first_of
from ..functions.parsing import extract_json


def last_of(df: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Of rows with one key, the one at the last position."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), pos).alias("r")).select(*keys, "r.*")


def first_rows(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Of rows with one key, the first in order."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r")).select(*keys, "r.*")


def merge_shards(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("shard", "pos")) -> DataFrame:
    """Rows of all shards; of one key, the first shard's."""
    return first_rows(df, keys, *order)


def pending(df: DataFrame, done: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key isn't done."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def resolve_files(df: DataFrame, manifest: DataFrame, column: str = "file", folders: Sequence[str] = ("slurp_real/", "slurp_synth/")) -> DataFrame:
    """Path of each file in manifest(path): the name as it is, its basename, the folders' in order, else the first path with the basename; null if missing."""
    base = F.element_at(F.split(F.col(column), "/"), -1)
    tries = F.array(F.col(column), base, *[F.concat(F.lit(f), base) for f in folders])
    rows = df.withColumn("__row", F.monotonically_increasing_id()) if "__row" not in df.columns else df
    names = df.select(column).distinct()
    exact = names.select(column, F.posexplode(tries).alias("order", "path")).join(manifest.select("path").distinct(), "path").groupBy(column).agg(F.min_by("path", "order").alias("exact"))
    index = manifest.groupBy(F.element_at(F.split("path", "/"), -1).alias("base")).agg(F.min("path").alias("indexed"))
    found = names.withColumn("base", base).join(exact, column, "left").join(index, "base", "left").select(column, F.coalesce("exact", "indexed").alias("resolved"))
    return rows.drop("__row").join(found, column, "left")


def missing_files(resolved: DataFrame) -> DataFrame:
    """How many rows of resolve_files found no path."""
    return resolved.agg(F.count_if(F.col("resolved").isNull()).alias("missing"))


def match_gold(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Gold with the last prediction of its key; a prediction without scenario or action says `unknown`."""
    p = last_of(pred.select(F.col(key).cast("string").alias(key), "pos", "scenario", "action", "entities"), [key]).drop("pos")
    said = lambda c: F.coalesce(F.nullif(clean(c), F.lit("")), F.lit("unknown")).alias(f"pred_{c}")
    p = p.select(key, said("scenario"), said("action"), F.coalesce("entities", F.array().cast(f"array<{ENTITY}>")).alias("pred_entities"))
    g = gold.withColumn(key, F.col(key).cast("string"))
    return g.withColumnsRenamed({c: f"gold_{c}" for c in ("scenario", "action", "entities")}).join(p, key)


def not_predicted(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Number of gold keys without a prediction."""
    return gold.select(F.col(key).cast("string").alias(key)).join(pred.select(F.col(key).cast("string").alias(key)).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("not_predicted"))


def fallback_key(field: str = "file", others: Sequence[str] = ("slurp_id", "id")) -> Column:
    """The key of a prediction: the field, also where it is blank; only where it is null the first of the others that isn't blank."""
    return F.trim(F.coalesce(F.col(field).cast("string"), *[F.nullif(F.col(c).cast("string"), F.lit("")) for c in others], F.lit("")))


def match_gold_fallback(pred: DataFrame, gold: DataFrame, field: str = "file", others: Sequence[str] = ("slurp_id", "id")) -> DataFrame:
    """predictions(pos, …) with gold(key, …) by their one key, as it is or else by its basename."""
    key = fallback_key(field, others)
    tries = pred.select("pos", F.posexplode(F.array(key, F.element_at(F.split(key, "/"), -1))).alias("order", "key")).where("key != ''")
    found = tries.join(gold.select("key").distinct(), "key").groupBy("pos").agg(F.min_by("key", "order").alias("key"))
    return pred.join(found, "pos").join(gold, "key")


def not_found_fallback(pred: DataFrame, gold: DataFrame, field: str = "file", others: Sequence[str] = ("slurp_id", "id")) -> DataFrame:
    """Number of predictions that have no key or whose key no gold has."""
    key = fallback_key(field, others)
    left = pred.select("pos", key.alias("key"), F.element_at(F.split(key, "/"), -1).alias("base"))
    known = gold.select("key").distinct()
    left = left.join(known, "key", "left_anti").join(known.withColumnRenamed("key", "base"), "base", "left_anti")
    return left.agg(F.count(F.lit(1)).alias("not_found"))


def match_embedded(pred: DataFrame) -> DataFrame:
    """Rows with gold from target_label, else parsed from target; those without scenario and action are dropped."""
    label = F.coalesce(F.col("target_label"), extract_json("target", ""))
    rows = pred.withColumns({f"gold_{c}": label[c] for c in ("scenario", "action", "entities")})
    return rows.where((clean("gold_scenario") != "") & (clean("gold_action") != ""))


def enrich_recordings(rows: DataFrame, utterances: DataFrame) -> DataFrame:
    """Rows without recordings take them, and a missing sentence, from the first utterance of their id; `enriched` says which."""
    first = first_rows(utterances.select("slurp_id", "pos", "recordings", "sentence"), ["slurp_id"], "pos").select("slurp_id", F.col("recordings").alias("__recordings"), F.col("sentence").alias("__sentence"))
    bare = F.col("recordings").isNull() | (F.size("recordings") == 0)
    out = rows.join(first, "slurp_id", "left").withColumn("enriched", bare & (F.coalesce(F.size("__recordings"), F.lit(0)) > 0))
    return out.withColumns({"recordings": F.when(F.col("enriched"), F.col("__recordings")).otherwise(F.col("recordings")), "sentence": F.when(F.col("enriched"), first_of("sentence", "__sentence")).otherwise(F.col("sentence"))}).drop("__recordings", "__sentence")


def attach_manifest(rows: DataFrame, manifest: DataFrame, overwrite: bool = False) -> DataFrame:
    """rows(id, file) with the file of the first manifest(id, file, pos) row of their id; `state`: attached, kept, missing_id or missing_file."""
    first = first_rows(manifest.where(clean("id") != ""), ["id"], "pos").select("id", F.col("file").alias("__file"))
    has = clean("file") != ""
    state = F.when(has & F.lit(not overwrite), "kept").when(F.col("__file").isNull(), "missing_id").when(clean("__file") == "", "missing_file").otherwise("attached")
    out = rows.join(first, "id", "left").withColumn("state", state)
    return out.withColumn("file", F.when(F.col("state") == "attached", F.col("__file")).otherwise(F.col("file"))).drop("__file")


def join_runs(reference: DataFrame, student: DataFrame, baseline: DataFrame, key: str = "id") -> DataFrame:
    """Reference with the student's rows and, where it has them, the baseline's."""
    return reference.join(student, key).join(baseline, key, "left")


def pair_runs(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Value of two runs at the keys they share, the first row of each: id=…|file=…."""
    key = F.concat(F.lit("id="), clean("id"), F.lit("|file="), clean("file")).alias("key")
    one = lambda df, name: first_rows(df.select(key, "pos", F.col(value).alias(name)), ["key"], "pos").select("key", name)
    return one(a, "a").join(one(b, "b"), "key")


def resolve_intent(items: DataFrame, gold: DataFrame) -> DataFrame:
    """items(id, file, intent, target_intent, pred_intent) with the intent of the first source that has one: own, target, prediction, gold by id, gold by file or its basename, __unknown__."""
    base = lambda c: F.element_at(F.split(clean(c), "/"), -1)
    by_id = first_rows(gold.select(F.col("id").cast("string").alias("id"), "intent", "pos"), ["id"], "pos").select("id", F.col("intent").alias("__by_id"))
    by_file = first_rows(gold.select(base("file").alias("__base"), "intent", "pos").where("__base != ''"), ["__base"], "pos").select("__base", F.col("intent").alias("__by_file"))
    out = items.withColumns({"id": F.col("id").cast("string"), "__base": base("file")}).join(by_id, "id", "left").join(by_file, "__base", "left")
    return out.withColumn("resolved", first_of("intent", "target_intent", "pred_intent", "__by_id", "__by_file", F.lit("__unknown__"))).drop("__base", "__by_id", "__by_file")


def fill_from(rows: DataFrame, utterances: DataFrame, columns: Sequence[str], key: str = "slurp_id") -> DataFrame:
    """Empty columns (null, blank or of size 0) from the first utterance of the id; rows without n-best are dropped."""
    kinds = dict(rows.dtypes)
    first = first_rows(utterances.select(key, "pos", *columns), [key], "pos").select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    empty = lambda c: F.col(c).isNull() | (F.size(c) == 0 if kinds[c].startswith("array") else clean(c) == "")
    out = rows.where(F.size("asr_nbest") > 0).join(first, key, "left")
    return out.withColumns({c: F.when(empty(c), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).drop(*[f"__{c}" for c in columns])


def attach_nbest(rows: DataFrame, cache: DataFrame, seed: int = 0) -> DataFrame:
    """rows(id, transcript) with the cached hypotheses of their id, spaces squeezed and each once; the transcript becomes a seeded one of them."""
    texts = F.array_distinct(F.filter(F.transform("hypotheses", lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != ""))
    found = cache.select("id", texts.alias("nbest"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("long")
    out = rows.join(found, "id", "left")
    some = F.coalesce(F.size("nbest") > 0, F.lit(False))
    return out.withColumn("transcript", F.when(some, F.get("nbest", (pick % F.greatest(F.size("nbest"), F.lit(1))).cast("int"))).otherwise(F.col("transcript")))
