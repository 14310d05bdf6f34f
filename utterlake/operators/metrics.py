"""Scores of predictions against gold labels (M1-M7, M11-M19). Every function takes and returns DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalise import clean, weak_intent
from ..functions.spans import slu_counts


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def with_prf(counts: DataFrame) -> DataFrame:
    """counts(tp, fp, fn) with precision, recall and f1, each 0 where it is undefined."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def label_counts(pairs: DataFrame, gold: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """True and false positives and false negatives of each label; a wrong prediction is one for either label."""
    same = F.col(gold) == F.col(pred)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    entry = lambda label, tp, fp, fn: F.struct(label.alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    each = F.when(same, F.array(entry(F.col(gold), one, none, none))).otherwise(F.array(entry(F.col(gold), none, none, one), entry(F.col(pred), none, one, none)))
    return pairs.select(*by, F.explode(each).alias("e")).groupBy(*by, F.col("e.label").alias("label")).agg(*[F.sum(f"e.{c}").alias(c) for c in ("tp", "fp", "fn")])


def overall(counts: DataFrame, average: str = "micro", by: Sequence[str] = ()) -> DataFrame:
    """One row `overall`: scores of the summed counts (micro), or means of the labels' scores (macro)."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    if average == "micro":
        return with_prf(counts.groupBy(*by).agg(*sums).withColumn("label", F.lit("overall")))
    means = [F.avg(c).alias(c) for c in ("precision", "recall")]
    found = with_prf(counts).groupBy(*by).agg(*sums, *means).withColumn("label", F.lit("overall"))
    return found.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def label_f1(pairs: DataFrame, gold: str, pred: str, average: str = "micro", by: Sequence[str] = ()) -> DataFrame:
    """M1: label, tp, fp, fn, precision, recall, f1 of each label, and a row `overall`."""
    counts = label_counts(pairs, gold, pred, by)
    return with_prf(counts).unionByName(overall(counts, average, by))


def multiset(entities: Column) -> Column:
    """Distinct (type, filler) of an array with their numbers."""
    return F.transform(F.array_distinct(entities), lambda e: F.struct(e["type"].alias("type"), e["filler"].alias("filler"), F.size(F.filter(entities, lambda x: x == e)).alias("n")))


def count_of(entities: Column, e: Column) -> Column:
    return F.size(F.filter(entities, lambda x: (x["type"] == e["type"]) & (x["filler"] == e["filler"])))


def span_counts(matched: DataFrame, gold: str = "gold_entities", pred: str = "pred_entities", by: Sequence[str] = ()) -> DataFrame:
    """Counts by entity type, matching gold and predicted entities of a row as multisets."""
    g, p = F.col(gold), F.col(pred)
    kinds = F.array_distinct(F.concat(F.transform(g, lambda e: e["type"]), F.transform(p, lambda e: e["type"])))
    each = F.transform(
        kinds,
        lambda t: F.struct(
            t.alias("label"),
            F.aggregate(F.filter(F.array_distinct(g), lambda e: e["type"] == t), F.lit(0), lambda n, e: n + F.least(count_of(g, e), count_of(p, e))).cast("long").alias("tp"),
            F.size(F.filter(g, lambda e: e["type"] == t)).cast("long").alias("golds"),
            F.size(F.filter(p, lambda e: e["type"] == t)).cast("long").alias("preds"),
        ),
    )
    rows = matched.select(*by, F.explode(each).alias("e")).groupBy(*by, F.col("e.label").alias("label"))
    return rows.agg(F.sum("e.tp").alias("tp"), F.sum(F.col("e.preds") - F.col("e.tp")).alias("fp"), F.sum(F.col("e.golds") - F.col("e.tp")).alias("fn"))


def span_f1(matched: DataFrame, gold: str = "gold_entities", pred: str = "pred_entities", average: str = "micro") -> DataFrame:
    """M2: exact entity scores by type, and a row `overall`."""
    counts = span_counts(matched, gold, pred)
    return with_prf(counts).unionByName(overall(counts, average))


def set_counts(gold: Column, pred: Column) -> list[Column]:
    """tp, fp, fn of two arrays as sets."""
    return [F.size(F.array_intersect(gold, pred)).cast("long").alias("tp"), F.size(F.array_except(pred, gold)).cast("long").alias("fp"), F.size(F.array_except(gold, pred)).cast("long").alias("fn")]


def entity_set_f1(matched: DataFrame, gold: str = "gold_entities", pred: str = "pred_entities", by: Sequence[str] = ()) -> DataFrame:
    """M3, corpus level: scores of the summed set counts."""
    rows = matched.select(*by, *set_counts(F.col(gold), F.col(pred)))
    return with_prf(rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def row_f1(gold: Column, pred: Column) -> Column:
    """M3 of one row; 1 where both are empty."""
    tp, fp, fn = set_counts(gold, pred)
    return F.when((F.size(gold) == 0) & (F.size(pred) == 0), F.lit(1.0)).otherwise(ratio(2.0 * tp, 2 * tp + fp + fn))


def row_entity_f1(matched: DataFrame, gold: str = "gold_entities", pred: str = "pred_entities") -> DataFrame:
    return matched.withColumn("entity_f1", row_f1(F.col(gold), F.col(pred)))


def accuracies(pairs: DataFrame) -> list[Column]:
    right = lambda c: F.avg((F.col(f"gold_{c}") == F.col(f"pred_{c}")).cast("int"))
    return [F.count(F.lit(1)).alias("n"), *[right(c).alias(f"{c}_accuracy") for c in ("scenario", "action", "intent")]]


def evaluate(pairs: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """M6: n, accuracies, and entity scores from summed set counts, for each group."""
    counted = pairs.withColumns(dict(zip(("tp", "fp", "fn"), set_counts(F.col("gold_entities"), F.col("pred_entities")), strict=True)))
    return with_prf(counted.groupBy(*by).agg(*accuracies(pairs), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def compare_label_f1(pairs: DataFrame, gold: str, pred: str, models: Sequence[str], n: int) -> DataFrame:
    """M7: f1 of each label by model, worst mean first; diff is the last model's less the first's."""
    scores = with_prf(label_counts(pairs, gold, pred, ["model"])).groupBy("label").pivot("model", list(models)).agg(F.first("f1"))
    scores = scores.select("label", *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in models])
    mean = sum((F.col(m) for m in models), F.lit(0.0)) / len(models)
    return scores.withColumns({"mean": mean, "diff": F.col(models[-1]) - F.col(models[0])}).orderBy("mean", "label").limit(n)


def reward(pairs: DataFrame, scenario: float = 1.0, action: float = 1.0, intent: float = 0.5, entity: float = 1.0) -> DataFrame:
    """Comparison flags and the weighted reward of each row."""
    same = lambda c: (F.col(f"gold_{c}") == F.col(f"pred_{c}")).cast("int")
    rows = row_entity_f1(pairs).withColumns({"scenario_ok": same("scenario"), "action_ok": same("action"), "intent_ok": same("intent")})
    return rows.withColumn("reward", scenario * F.col("scenario_ok") + action * F.col("action_ok") + intent * F.col("intent_ok") + entity * F.col("entity_f1"))


def candidate_stats(pairs: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Share of rows with candidates, of rows whose candidates hold the gold intent, and accuracy given that (null without any)."""
    has, hit = F.size("candidates") > 0, F.array_contains("candidates", F.col("gold_intent"))
    right = (F.col("gold_intent") == F.col("pred_intent")).cast("int")
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(has.cast("int")).alias("with_candidates"), F.avg(hit.cast("int")).alias("gold_in_candidates"), F.avg(F.when(hit, right)).alias("accuracy_given_gold"))


def slot_names(c: str) -> Column:
    """Different slot types in lower case, without blanks and __none__."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: (x != "") & (x != "__none__")))


def success_score(rows: DataFrame, match: str = "full") -> DataFrame:
    """format_ok + match_ok + gold intent among candidates + slot coverage, and correct from 4 on.

    match: intent, full (scenario and action) or entities (full and equal entity sets).
    """
    full = (F.col("gold_scenario") == F.col("pred_scenario")) & (F.col("gold_action") == F.col("pred_action"))
    ok = {"intent": F.col("gold_intent") == F.col("pred_intent"), "full": full, "entities": full & (row_f1(F.col("gold_entities"), F.col("pred_entities")) == 1.0)}[match]
    slots, gold = slot_names("slot_candidates"), slot_names("gold_slots")
    coverage = F.when(F.size(gold) == 0, (F.size(slots) == 0).cast("double")).otherwise(F.size(F.array_intersect(gold, slots)) / F.size(F.array_distinct(gold)))
    found = rows.withColumns({"match_ok": ok, "gold_in_candidates": F.array_contains("candidates", F.col("gold_intent")), "slot_coverage": coverage})
    total = F.col("format_ok").cast("int") + F.col("match_ok").cast("int") + F.col("gold_in_candidates").cast("int") + F.col("slot_coverage")
    return found.withColumn("score", total.cast("double")).withColumn("correct", F.col("score") >= 4.0)


def rationale_coverage(rows: DataFrame) -> DataFrame:
    """Share of candidates, intents but the gold one and slot types, that have a reason which isn't blank; 1 without any.

    rows: gold_intent, candidates, slot_candidates, pairs array<struct<label,reason>>. Labels of intents have : as _, those of slot
    types no parentheses, no `slot:` before them and no upper case.
    """
    bare = lambda x: F.regexp_replace(F.lower(F.trim(F.regexp_replace(x, r"\([^)]*\)", ""))), r"^slots?\s*:\s*", "")
    reasoned = F.filter("pairs", lambda p: F.trim(F.coalesce(p["reason"], F.lit(""))) != "")
    intents = F.array_except(F.array_distinct("candidates"), F.array("gold_intent"))
    slots = F.array_distinct(F.filter(F.transform("slot_candidates", lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    covered = F.size(F.array_intersect(intents, F.transform(reasoned, lambda p: weak_intent(p["label"])))) + F.size(F.array_intersect(slots, F.transform(reasoned, lambda p: bare(p["label"]))))
    total = F.size(intents) + F.size(slots)
    return rows.withColumn("rationale_coverage", F.when(total == 0, F.lit(1.0)).otherwise(covered / total))


def candidate_bonus(rows: DataFrame, intent: float = 1.0, slot: float = 0.0, count: float = 0.0, target: int = 3) -> DataFrame:
    """Sum of a bonus for the gold intent among the candidates, one for a gold slot type among theirs, and one that falls the farther the number of intents is from the target."""
    target = max(1, target)
    near = F.greatest(F.lit(0.0), 1.0 - F.abs(F.size("candidates") - target) / float(target))
    hit = F.array_contains("candidates", F.col("gold_intent")) & (clean("gold_intent") != "")
    shared = F.arrays_overlap(slot_names("gold_slots"), slot_names("slot_candidates"))
    return rows.withColumn("bonus", intent * hit.cast("int") + slot * F.coalesce(shared, F.lit(False)).cast("int") + max(0.0, count) * near)


def format_adjusted(rows: DataFrame, bonus: float, penalty: float, column: str = "reward") -> DataFrame:
    """The reward and a bonus where format_ok, or less a penalty."""
    return rows.withColumn(column, F.col(column) + F.when(F.col("format_ok"), F.lit(bonus)).otherwise(F.lit(-penalty)))


def run_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means of reward, accuracies, the rows' entity f1 and coverage, the share of rows of full coverage, and SLU-F1 of the summed
    word and char counts of the greedy matching by distance. No rows at all give one row of zeros, unless by groups."""
    sums = {f"slu_{c}": _summed("__slu", c) for c in ("tp", "fp", "fn")}
    counted = row_entity_f1(rows).withColumn("__slu", slu_counts("gold_entities", "pred_entities")).withColumns(sums)
    means = [F.avg(c).alias(name) for c, name in (("reward", "reward"), ("entity_f1", "entity_f1"), ("rationale_coverage", "rationale_coverage"))]
    found = counted.groupBy(*by).agg(*accuracies(rows), *means, F.avg((F.col("rationale_coverage") == 1).cast("int")).alias("rationale_full"), *[F.sum(c).alias(c) for c in sums])
    found = found.select(*by, *[F.coalesce(c, F.lit(0)).alias(c) for c in found.columns if c not in by])
    p, r = (ratio(F.col("slu_tp"), F.col("slu_tp") + F.col(c)) for c in ("slu_fp", "slu_fn"))
    return found.withColumn("slu_f1", ratio(2 * p * r, p + r))


def _summed(counts: str, field: str) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda n, x: n + x[field])


def boundary_metrics(joined: DataFrame) -> DataFrame:
    """Accuracy, hierarchical recovery, and the mean contrast of the scores of gold and parent, with its number of rows.

    joined: gold_intent, parent_intent, student, baseline, scores map<string,double>. Only rows that have both scores and a parent
    have a contrast; where both are within 0 and 1, it is one of logs, from 1e-12 on.
    """
    g, p = F.try_element_at("scores", F.col("gold_intent")), F.try_element_at("scores", F.col("parent_intent"))
    named = clean("parent_intent") != ""
    log = lambda x: F.log(F.greatest(x, F.lit(1e-12)))
    contrast = F.when(named & g.isNotNull() & p.isNotNull(), F.when(g.between(0, 1) & p.between(0, 1), log(g) - log(p)).otherwise(g - p))
    missed = named & (F.col("baseline") == F.col("parent_intent")) & (F.col("parent_intent") != F.col("gold_intent"))
    right = F.col("student") == F.col("gold_intent")
    return joined.agg(
        F.count(F.lit(1)).alias("n"), F.avg(right.cast("int")).alias("accuracy"), F.count_if(missed).alias("parent_errors"), F.count_if(missed & right).alias("recovered"),
        F.avg(F.when(missed, right.cast("int"))).alias("recovery_rate"), F.avg(contrast).alias("contrast"), F.count(contrast).alias("contrast_count"),
    )


#: Words that don't count in overlaps.
STOPWORDS = "a an the and or to for of on in at by from is are was were be been being do does did have has had with as about".split()


def overlap(a: Column, b: Column) -> Column:
    """Share of the different words of a that b has, stopwords left out; 0 where either has none."""
    known = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9']+"), 0), lambda t: ~t.isin(STOPWORDS)))
    x, y = known(a), known(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))


def rationale_overlap(joined: DataFrame) -> DataFrame:
    """Mean overlap of rationale with sentence, and the number of rows."""
    return joined.agg(F.count(F.lit(1)).alias("n"), F.avg(overlap(F.col("rationale"), F.col("sentence"))).alias("overlap"))


def is_crj(strict_r: bool = False) -> Column:
    """C, J and R are there; unless strict, R may be missing where C holds one intent and one slot at most."""
    single = F.col("has_c") & (F.col("n_intents") <= 1) & (F.col("n_slots") <= 1)
    return F.col("has_c") & F.col("has_j") & (F.col("has_r") | (single & F.lit(not strict_r)))


def crj_candidates(rows: DataFrame, strict_r: bool = False) -> DataFrame:
    """Subset, n, mean, median, least, most of candidate numbers for six subsets of rows(has_c, has_r, has_j, n_intents, n_slots, has_slots); 0 for empty ones."""
    crj, slots = is_crj(strict_r), F.col("has_slots")
    subsets = {
        "intent_all": ("n_intents", F.lit(True)), "slot_all": ("n_slots", F.lit(True)), "intent_crj": ("n_intents", crj), "slot_crj": ("n_slots", crj),
        "slot_gold_has_slots_all": ("n_slots", slots), "slot_gold_has_slots_crj": ("n_slots", crj & slots),
    }
    chosen = rows.select(*[F.when(where, F.col(c)).alias(k) for k, (c, where) in subsets.items()])
    stats = lambda k: [F.count(k).alias("n"), *[F.coalesce(f(k).cast("double"), F.lit(0.0)).alias(name) for name, f in (("mean", F.avg), ("median", F.median), ("least", F.min), ("most", F.max))]]
    found = chosen.agg(*[F.struct(F.lit(k).alias("subset"), *stats(k)).alias(k) for k in subsets])
    return found.select(F.inline(F.array(*subsets)))


def crj_report(rows: DataFrame, strict_r: bool = False) -> DataFrame:
    """rows(has_c, has_r, has_j, valid_j booleans, n_intents, n_slots): how many have each part, R in its own right (r_nonempty) or
    because it may be missing (r), all three lines (strict), all that is needed (crj), a valid J, and the lesser of the last two; with shares."""
    single = F.col("has_c") & (F.col("n_intents") <= 1) & (F.col("n_slots") <= 1)
    flags = {
        "c": F.col("has_c"), "r_nonempty": F.col("has_r"), "r": F.col("has_r") | (single & F.lit(not strict_r)), "j": F.col("has_j"), "r_optional": single, "strict": F.col("has_c") & F.col("has_r") & F.col("has_j"),
        "crj": is_crj(strict_r), "valid": F.col("valid_j"),
    }
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"n_{k}") for k, c in flags.items()]).withColumn("n_crj_valid", F.least("n_crj", "n_valid"))
    return counts.withColumns({f"{k}_ratio": ratio(F.col(f"n_{k}").cast("double"), F.col("n")) for k in (*flags, "crj_valid")})


def failing(rows: DataFrame, condition: Column, n: int, pos: str = "pos", key: str = "key") -> DataFrame:
    """Keys of the first n rows that fail."""
    return rows.where(~condition).orderBy(pos).limit(n).select(*dict.fromkeys((pos, key)))


def rank_runs(runs: DataFrame, metric: str, status: str = "ok") -> DataFrame:
    """Runs that ended well, best first; a missing metric comes last."""
    good = runs.where(F.col("status") == status).withColumn("value", F.coalesce(F.col("metrics")[metric], F.lit(float("-inf"))))
    return good.withColumn("rank", F.row_number().over(W.orderBy(F.col("value").desc(), "index")))


def expand_grid(values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All combinations of the columns' array values, in order."""
    grid = values
    for c in columns:
        grid = grid.withColumn(c, F.explode(c))
    return grid.withColumn("index", F.row_number().over(W.orderBy(*columns)))


def group_advantage(rows: DataFrame, normalize: bool = True, key: str = "prompt_id") -> DataFrame:
    """(reward - mean) / (population deviation + 1e-6) within each prompt; the deviation is 1 when disabled or 0."""
    w = W.partitionBy(key)
    spread = F.stddev_pop("reward").over(w)
    scale = F.when(F.lit(not normalize) | (spread == 0), F.lit(1.0)).otherwise(spread)
    return rows.withColumn("advantage", (F.col("reward") - F.avg("reward").over(w)) / (scale + 1e-6))


def group_diversity(rows: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Different outputs, rewards and intents of each prompt, and the spread of rewards."""
    return rows.groupBy(key).agg(
        F.countDistinct("output").alias("outputs"), F.countDistinct("reward").alias("rewards"), F.countDistinct("pred_intent").alias("intents"), (F.max("reward") - F.min("reward")).alias("spread")
    )
