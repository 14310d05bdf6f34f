"""Error analysis over pairs of gold and predicted labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import accuracies, count_of, ratio
from .quantiles import exact_quantiles


def wrong(pairs: DataFrame, level: str = "intent") -> DataFrame:
    """gold and pred of the rows that are wrong at a level."""
    return pairs.where(F.col(f"gold_{level}") != F.col(f"pred_{level}")).withColumns({"gold": F.col(f"gold_{level}"), "pred": F.col(f"pred_{level}")})


def relation() -> Column:
    same = lambda c: F.col(f"gold_{c}") == F.col(f"pred_{c}")
    return F.when(same("scenario"), "same_scenario").when(same("action"), "same_action").otherwise("both")


def top_confusions(pairs: DataFrame, level: str = "intent", n: int = 20) -> DataFrame:
    """The most frequent errors with what gold and prediction share."""
    return wrong(pairs, level).groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"), F.min(relation()).alias("relation")).orderBy(F.col("n").desc(), "gold", "pred").limit(n)


def error_breakdown(pairs: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Intent errors by what differs, with percentages."""
    s, a = F.col("gold_scenario") == F.col("pred_scenario"), F.col("gold_action") == F.col("pred_action")
    found = pairs.groupBy(*by).agg(F.count_if(s & ~a).alias("action_only"), F.count_if(~s & a).alias("scenario_only"), F.count_if(~s & ~a).alias("both"), F.count_if(~(s & a)).alias("errors"))
    return found.withColumns({f"{c}_pct": 100.0 * ratio(F.col(c).cast("double"), F.col("errors")) for c in ("action_only", "scenario_only", "both")})


def entity_type_confusion(matched: DataFrame, gold: str = "gold_entities", pred: str = "pred_entities") -> DataFrame:
    """Kind (fp, fn, swap), gold type, predicted type, n; a swap is a filler found under another type."""
    g, p = F.array_except(gold, pred), F.array_except(pred, gold)
    entry = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("gold_type"), b.alias("pred_type"))
    none = F.lit(None).cast("string")
    swaps = F.flatten(F.transform(g, lambda x: F.transform(F.filter(p, lambda y: (y["filler"] == x["filler"]) & (y["type"] != x["type"])), lambda y: entry("swap", x["type"], y["type"]))))
    each = F.concat(F.transform(p, lambda y: entry("fp", none, y["type"])), F.transform(g, lambda x: entry("fn", x["type"], none)), swaps)
    return matched.select(F.explode(each).alias("e")).groupBy("e.kind", "e.gold_type", "e.pred_type").agg(F.count(F.lit(1)).alias("n"))


def confusion_clusters(pairs: DataFrame, min_count: int, level: str = "intent") -> DataFrame:
    """Undirected pairs of labels that are taken for each other at least min_count times."""
    low, high = F.least("gold", "pred"), F.greatest("gold", "pred")
    same = F.substring_index("a", "_", 1) == F.substring_index("b", "_", 1)
    found = wrong(pairs, level).groupBy(low.alias("a"), high.alias("b")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("gold") == low).alias("a_to_b"), F.count_if(F.col("gold") == high).alias("b_to_a"))
    return found.where(F.col("total") >= min_count).withColumns({"bidirectional": (F.col("a_to_b") > 0) & (F.col("b_to_a") > 0), "same_scenario": same})


def compare_confusions(pairs: DataFrame, models: Sequence[str], n: int, level: str = "intent") -> DataFrame:
    """Errors by model, most frequent in any model first; diff is the last model's less the first's."""
    table = wrong(pairs, level).groupBy("gold", "pred").pivot("model", list(models)).count()
    table = table.select("gold", "pred", *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in models])
    table = table.withColumns({"most": F.greatest(*models), "diff": F.col(models[-1]) - F.col(models[0]), "cross_scenario": F.substring_index("gold", "_", 1) != F.substring_index("pred", "_", 1)})
    return table.orderBy(F.col("most").desc(), "gold", "pred").limit(n)


def scenario_accuracy(pairs: DataFrame) -> DataFrame:
    """Intent accuracy by gold scenario and model."""
    return pairs.groupBy("gold_scenario", "model").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gold_intent") == F.col("pred_intent")).cast("int")).alias("accuracy"))


def band(wer: Column) -> Column:
    return F.when(wer == 0, "0").when(wer <= 0.2, "0-0.2").when(wer <= 0.5, "0.2-0.5").otherwise(">0.5")


def bin_stats(rows: DataFrame) -> list[Column]:
    """What bands and bins report: accuracies, and, where rows have entities or candidates, f1 of the summed multiset counts of entities,
    how many rows have candidates, how many of those the gold intent among them, and how many of these are right."""
    stats = accuracies(rows)
    if "gold_entities" in rows.columns:
        g, p = F.col("gold_entities"), F.col("pred_entities")
        shared = F.aggregate(F.array_distinct(g), F.lit(0), lambda n, e: n + F.least(count_of(g, e), count_of(p, e)))
        tp, golds, preds = F.sum(shared), F.sum(F.size(g)), F.sum(F.size(p))
        stats += [tp.alias("tp"), (preds - tp).alias("fp"), (golds - tp).alias("fn"), ratio(2.0 * tp, golds + preds).alias("slu_f1")]
    if "candidates" in rows.columns:
        has = F.col("has_c") if "has_c" in rows.columns else F.size("candidates") > 0
        hit = has & F.array_contains("candidates", F.col("gold_intent"))
        n, hits, right = F.count_if(has), F.count_if(hit), F.count_if(hit & (F.col("gold_intent") == F.col("pred_intent")))
        stats += [n.alias("c_present_n"), hits.alias("c_hit_n"), F.when(n > 0, hits / n).alias("c_hit_rate"), right.alias("c_hit_correct_n"), F.when(hits > 0, right / hits).alias("c_correct_given_hit")]
    return stats


def wer_bands(pairs: DataFrame) -> DataFrame:
    """bin_stats and errors by model and fixed band of word error rate, and in ALL; rows without a rate are left out."""
    s, a = F.col("gold_scenario") == F.col("pred_scenario"), F.col("gold_action") == F.col("pred_action")
    rows = pairs.where(F.col("wer").isNotNull()).withColumn("band", band(F.col("wer")))
    found = rows.withColumn("band", F.explode(F.array("band", F.lit("ALL")))).groupBy("model", "band")
    return found.agg(*bin_stats(rows), F.count_if(s & ~a).alias("action_only"), F.count_if(~s & a).alias("scenario_only"), F.count_if(~s & ~a).alias("both"))


def quantile_edges(values: DataFrame, column: str, bins: int, limit: float = 1.0) -> list[float]:
    """Edges of bins of equal numbers: exact, linearly interpolated quantiles of the values up to the limit, the ends put to 0 and the limit.

    No more bins than values; no edge lies below the one before it; no values give no edges.
    """
    within = values.where(F.col(column) <= limit)
    n = within.where(F.col(column).isNotNull()).count()
    if not n:
        return []
    bins = min(bins, n)
    found = exact_quantiles(within, [column], [k / bins for k in range(bins + 1)]).head()["values"]
    edges = [0.0, *found[1:-1], float(limit)]
    for k in range(1, len(edges)):
        edges[k] = max(edges[k], edges[k - 1])
    return edges


def linear_edges(width: float, limit: float = 1.0) -> list[float]:
    """Edges of one width in whole percents; the last bin ends at the limit and may be narrower."""
    step, last = round(width * 100), round(limit * 100)
    return [*[k / 100 for k in range(0, last, step)], last / 100]


def log_edges(values: DataFrame, column: str, bins: int, limit: float = 1.0, least: float = 1e-4) -> list[float]:
    """A bin for zero and what lies below the start, then bins - 1 geometric ones up to the limit.

    The start is the least positive value up to the limit, but not below `least`; where there is none, or it is not below the limit,
    one bin holds all.
    """
    found = values.where((F.col(column) > 0) & (F.col(column) <= limit)).agg(F.min(column).alias("start")).head()["start"]
    start = limit if found is None else max(least, float(found))
    if start >= limit:
        return [0.0, float(limit)]
    n = max(1, bins - 1)
    return [0.0, *[start * (limit / start) ** (k / n) for k in range(n)], float(limit)]


def wer_bins(pairs: DataFrame, edges: Sequence[float], column: str = "wer", overflow: bool = True) -> DataFrame:
    """Rows with bin, its low and high edge: [low, high), the last one closed; larger values go to an overflow bin."""
    last = len(edges) - 2
    value = F.col(column)
    index = F.when(value.isNull() | (value < edges[0]), None)
    for k in range(last + 1):
        index = index.when((value < edges[k + 1]) if k < last else (value <= edges[k + 1]), F.lit(k))
    index = index.otherwise(F.lit(last + 1) if overflow else F.lit(None))
    low = F.element_at(F.array(*[F.lit(float(x)) for x in edges]), F.col("bin") + 1)
    high = F.when(F.col("bin") <= last, F.element_at(F.array(*[F.lit(float(x)) for x in [*edges, edges[-1]]]), F.col("bin") + 2))
    return pairs.withColumn("bin", index).where("bin IS NOT NULL").withColumns({"low": low, "high": high})


def bin_metrics(binned: DataFrame, least: int = 1, edges: Sequence[float] = ()) -> DataFrame:
    """bin_stats by model and bin with at least so many rows. With edges, every model has a row for each of their bins: where it has
    too few rows, n says how many, and scores are null."""
    by = ["model", "bin", "low", "high"]
    found = binned.groupBy(*by).agg(*bin_stats(binned))
    if not edges:
        return found.where(F.col("n") >= least)
    grid = F.array(*[F.struct(F.lit(k).alias("bin"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for k, (a, b) in enumerate(zip(edges, edges[1:]))])
    every = binned.select("model").distinct().select("model", F.explode(grid).alias("b")).select("model", "b.*")
    stats = [c for c in found.columns if c not in (*by, "n")]
    full = every.join(found.drop("low", "high"), ["model", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    counts = [c for c in stats if c.endswith("_n")]
    return full.select(*by, "n", *[F.coalesce(c, F.lit(0)).alias(c) if c in counts else F.when(F.col("n") >= least, F.col(c)).alias(c) for c in stats])


def bin_table(metrics: DataFrame) -> DataFrame:
    """The metrics as text cells, ready to be written as CSV: edges with four digits (inf for none), scores with six, empty where null."""
    percent = lambda c: F.regexp_replace(F.format_string("%.1f", F.col(c) * 100), r"\.0$", "")
    label = F.when(F.col("high").isNull(), F.concat(F.lit(">"), percent("low"))).otherwise(F.concat_ws("-", percent("low"), percent("high")))
    score = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.6f", F.col(c))), F.lit("")).alias(c)
    scores = [c for c, t in metrics.dtypes if t == "double" and c not in ("low", "high")]
    rest = [score(c) if c in scores else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in metrics.columns if c not in ("model", "bin", "low", "high")]
    return metrics.select("model", label.alias("bin_label"), F.format_string("%.4f", "low").alias("bin_lo"), F.coalesce(F.when(F.col("high").isNotNull(), F.format_string("%.4f", F.col("high"))), F.lit("inf")).alias("bin_hi"), *rest)


def absorption(pairs: DataFrame, suspects: Sequence[str], level: str = "intent", n: int = 10) -> DataFrame:
    """Labels that suspects swallow: victims with their share of the suspect's wrong predictions, and what it looks like."""
    each = wrong(pairs, level).where(F.col("pred").isin(list(suspects))).groupBy("pred", "gold").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("pred")
    each = each.withColumns({"share": F.col("n") / F.sum("n").over(w), "victims": F.count(F.lit(1)).over(w), "rank": F.row_number().over(w.orderBy(F.col("n").desc(), "gold"))})
    top = F.max("share").over(w)
    return each.withColumn("diagnosis", F.when(top > 0.4, "concentration").when(F.col("victims") > 5, "trash_bin").otherwise("mixed")).where(F.col("rank") <= n)


def frequency_bias(pairs: DataFrame, level: str = "intent", n: int = 15) -> DataFrame:
    """X11: share of a label among gold and among wrong predictions, the largest of the latter first; their ratio is infinite for labels that are never gold."""
    gold = pairs.groupBy(F.col(f"gold_{level}").alias("label")).agg(F.count(F.lit(1)).alias("golds"))
    bad = wrong(pairs, level).groupBy(F.col("pred").alias("label")).agg(F.count(F.lit(1)).alias("errors"))
    totals = gold.agg(F.sum("golds").alias("all_golds")).crossJoin(bad.agg(F.sum("errors").alias("all_errors")))
    both = gold.join(bad, "label", "full_outer").na.fill(0, ["golds", "errors"]).crossJoin(F.broadcast(totals))
    shares = both.select("label", (F.col("golds") / F.col("all_golds")).alias("gold_share"), ratio(F.col("errors").cast("double"), F.col("all_errors")).alias("error_share"))
    return shares.withColumn("ratio", F.when(F.col("gold_share") > 0, F.col("error_share") / F.col("gold_share")).otherwise(F.lit(float("inf")))).orderBy(F.col("error_share").desc(), "label").limit(n)


def error_graph(pairs: DataFrame, level: str = "intent") -> DataFrame:
    """Edges gold -> pred of at least max(5, 0.5 % of errors, rounded down), with the weight that reaches pred, and whether pred is a hub."""
    edges = wrong(pairs, level).groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("weight"))
    least = edges.agg(F.greatest(F.lit(5), F.floor(F.sum("weight") * F.lit(0.005))).alias("least"))
    edges = edges.crossJoin(F.broadcast(least)).where("weight >= least").drop("least")
    into = edges.groupBy("pred").agg(F.sum("weight").alias("in_weight"))
    most = into.agg(F.max("in_weight").alias("most"))
    return edges.join(into, "pred").crossJoin(F.broadcast(most)).select("gold", "pred", "weight", "in_weight", (F.col("in_weight") > 0.2 * F.col("most")).alias("hub"))


def in_group_rate(errors: DataFrame, groups: DataFrame, trials: int = 10, seed: int = 0) -> DataFrame:
    """Share of errors(gold, pred) inside one group of groups(label, grp), the same for shuffled groups, and the lift."""
    sizes = groups.select(F.countDistinct("grp").alias("k"))
    key = lambda t: F.md5(F.concat_ws("|", "label", F.lit(seed), t))
    labels = groups.select("label", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")).crossJoin(F.broadcast(sizes))
    shuffled = labels.withColumn("grp", F.pmod(F.row_number().over(W.partitionBy("trial").orderBy(key(F.col("trial")), "label")) - 1, F.col("k")).cast("string")).select("trial", "label", "grp")
    maps = groups.select(F.lit(-1).alias("trial"), "label", F.col("grp").cast("string").alias("grp")).unionByName(shuffled)
    counted = errors.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    a, b = maps.select("trial", F.col("label").alias("gold"), F.col("grp").alias("ga")), maps.select("trial", F.col("label").alias("pred"), F.col("grp").alias("gb"))
    rates = counted.join(a, "gold").join(b, ["trial", "pred"]).groupBy("trial").agg((F.sum(F.when(F.col("ga") == F.col("gb"), F.col("n")).otherwise(0)) / F.sum("n")).alias("rate"))
    found = rates.agg(F.max(F.when(F.col("trial") == -1, F.col("rate"))).alias("rate"), F.avg(F.when(F.col("trial") >= 0, F.col("rate"))).alias("random_rate"))
    return found.withColumn("lift", ratio(F.col("rate"), F.col("random_rate")))


def in_group_confusions(errors: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """The most frequent errors inside one group, with the group's other members."""
    members = groups.groupBy("grp").agg(F.array_sort(F.collect_set("label")).alias("members"))
    counted = errors.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    own = counted.join(groups.select(F.col("label").alias("gold"), "grp"), "gold").join(groups.select(F.col("label").alias("pred"), F.col("grp").alias("other")), "pred").where("grp = other")
    return own.join(members, "grp").select("gold", "pred", "grp", "n", F.array_except("members", F.array("gold", "pred")).alias("others")).orderBy(F.col("n").desc(), "gold", "pred").limit(n)


def neighbor_ranks(errors: DataFrame, sims: DataFrame) -> DataFrame:
    """errors(gold, pred) with the rank and similarity of pred among gold's neighbours in sims(a, b, similarity); 0 is gold itself."""
    ranked = sims.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.col("similarity").desc(), "b")))
    counted = errors.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(ranked.select(F.col("a").alias("gold"), F.col("b").alias("pred"), "rank", "similarity"), ["gold", "pred"])


def neighbor_summary(ranked: DataFrame, labels: int) -> DataFrame:
    """Rates of errors at rank 1 and up to 3, 5 and 10, what chance gives, the lift, and shares from similarities .5 to .9 on."""
    total = F.sum("n")
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / total
    found = ranked.agg(total.alias("errors"), share(F.col("rank") == 1).alias("rank_1"), *[share(F.col("rank") <= k).alias(f"rank_{k}") for k in (3, 5, 10)], *[share(F.col("similarity") >= t / 10).alias(f"from_0{t}") for t in range(5, 10)])
    return found.withColumn("random_1", F.lit(1.0 / (labels - 1))).withColumn("lift", F.col("rank_1") / F.col("random_1"))


def selection_errors(rows: DataFrame, target: str = "target", output: str = "output") -> DataFrame:
    """Wrong selections (kind, gold, pred, n) parsed from lines like `Scenario Group a: x, y. Selection: x`."""
    pick = lambda c, kind: F.regexp_extract(c, rf"{kind} Group[^\n]*?Selection:\s*([^\s,.;]+)", 1)
    kinds = F.array(*[F.struct(F.lit(k.lower()).alias("kind"), pick(target, k).alias("gold"), pick(output, k).alias("pred")) for k in ("Scenario", "Action")])
    each = rows.select(F.explode(kinds).alias("e")).select("e.*").where("gold != '' AND pred != '' AND gold != pred")
    return each.groupBy("kind", "gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def expand_groups(groups: DataFrame, errors: DataFrame, k: int) -> DataFrame:
    """Label -> sorted members of its group and its k most frequent wrong predictions."""
    counted = errors.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    top = counted.withColumn("rank", F.row_number().over(W.partitionBy("gold").orderBy(F.col("n").desc(), "pred"))).where(F.col("rank") <= k).select(F.col("gold").alias("label"), F.col("pred").alias("member"))
    own = groups.join(groups.select("grp", F.col("label").alias("member")), "grp").select("label", "member")
    return own.unionByName(top).groupBy("label").agg(F.array_sort(F.collect_set("member")).alias("members"))
