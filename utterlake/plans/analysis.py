"""Queries of the error analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import errors as X
from . import views as V

MODELS = ("m0", "m1", "m2")


def _groups(spark, d):
    labels = V.pairs(spark, d).select(F.explode(F.array("gold_intent", "pred_intent")).alias("label")).distinct()
    return labels.withColumn("grp", F.substring_index("label", "_", -1))


def _errors(spark, d):
    return X.wrong(V.pairs(spark, d)).select("gold", "pred")


def _sims(spark, d):
    """A similarity of labels from their parts."""
    labels = _groups(spark, d).select("label")
    s, a = lambda c: F.substring_index(c, "_", 1), lambda c: F.substring_index(c, "_", -1)
    both = labels.select(F.col("label").alias("a")).crossJoin(F.broadcast(labels.select(F.col("label").alias("b"))))
    same = (s("a") == s("b")).cast("double") * 0.55 + (a("a") == a("b")).cast("double") * 0.4 + F.least(F.length("a"), F.length("b")) / 1000.0
    return both.withColumn("similarity", F.when(F.col("a") == F.col("b"), 1.0).otherwise(same))


def x1(spark, d):
    return X.top_confusions(V.pairs(spark, d), "intent", 25)


def x2(spark, d):
    return V.rounded(X.error_breakdown(V.pairs(spark, d)))


def x3(spark, d):
    return X.entity_type_confusion(V.entities(spark, d))


def x4(spark, d):
    return X.confusion_clusters(V.pairs(spark, d), 10)


def x5(spark, d):
    return X.compare_confusions(V.pairs(spark, d), MODELS, 20)


def x6(spark, d):
    return V.rounded(X.scenario_accuracy(V.pairs(spark, d)))


def x7(spark, d):
    return V.rounded(X.wer_bands(V.candidates(spark, d)))


def x8(spark, d):
    p = V.pairs(spark, d)
    return V.rounded(X.wer_bins(p, X.quantile_edges(p, "wer", 8)).groupBy("bin", "low", "high").agg(F.count(F.lit(1)).alias("n")))


def x8_linear(spark, d):
    return V.rounded(X.wer_bins(V.pairs(spark, d), X.linear_edges(0.25, 1.0)).groupBy("bin", "low", "high").agg(F.count(F.lit(1)).alias("n"), F.min("wer").alias("least"), F.max("wer").alias("most")))


def x8_log(spark, d):
    """A bin for what lies below the start, which is 0.013 at least, three geometric ones to 0.9, and what lies above."""
    p = V.pairs(spark, d)
    return X.wer_bins(p, X.log_edges(p, "wer", 4, 0.9, 0.013)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def x9(spark, d):
    return V.rounded(X.bin_metrics(X.wer_bins(V.candidates(spark, d), X.linear_edges(0.25, 1.0)), 20))


def x9_table(spark, d):
    """Bins of odd width, of which some have no rows, as cells of a CSV file."""
    edges = [0.0, 0.3, 0.3, 0.6, 1.0]
    return X.bin_table(X.bin_metrics(X.wer_bins(V.candidates(spark, d), edges, overflow=False), 5, edges))


def x10(spark, d):
    return V.rounded(X.absorption(V.pairs(spark, d), ["click_a0", "view_a1", "unknown_a2"]))


def x11(spark, d):
    found = X.frequency_bias(V.pairs(spark, d))
    return V.rounded(found.withColumn("ratio", F.when(F.col("ratio") < float("inf"), F.col("ratio"))))


def x12(spark, d):
    return X.error_graph(V.pairs(spark, d))


def x13(spark, d):
    return V.rounded(X.in_group_rate(_errors(spark, d), _groups(spark, d)))


def x14(spark, d):
    return X.in_group_confusions(_errors(spark, d), _groups(spark, d), 10).withColumn("others", F.array_join("others", ","))


def x15(spark, d):
    return V.rounded(X.neighbor_ranks(_errors(spark, d), _sims(spark, d)))


def x15_summary(spark, d):
    return V.rounded(X.neighbor_summary(X.neighbor_ranks(_errors(spark, d), _sims(spark, d)), 30))


def x16(spark, d):
    text = lambda s, a: F.format_string("Scenario Group g: x, y. Selection: %s.\nAction Group h: z. Selection: %s.", s, a)
    return X.selection_errors(V.pairs(spark, d).select(text("gold_scenario", "gold_action").alias("target"), text("pred_scenario", "pred_action").alias("output")))


def x17(spark, d):
    return X.expand_groups(_groups(spark, d), _errors(spark, d), 3).withColumn("members", F.array_join("members", ","))


QUERIES = {
    "x1_top_confusions": x1, "x2_error_breakdown": x2, "x3_entity_type_confusion": x3, "x4_confusion_clusters": x4, "x5_compare_confusions": x5, "x6_scenario_accuracy": x6, "x7_wer_bands": x7, "x8_wer_bins": x8, "x8_linear_bins": x8_linear, "x8_log_bins": x8_log,
    "x9_bin_metrics": x9, "x9_bin_table": x9_table, "x10_absorption": x10, "x11_frequency_bias": x11, "x12_error_graph": x12, "x13_in_group_rate": x13, "x14_in_group_confusions": x14, "x15_neighbor_ranks": x15, "x15_neighbor_summary": x15_summary, "x16_selection_errors": x16, "x17_expand_groups": x17,
}

_W = f"{V.PAIRS}, w AS (SELECT *, gold_intent AS gold, pred_intent AS pred FROM pairs WHERE gold_intent <> pred_intent)"
_G = "g AS (SELECT DISTINCT label, split_part(label, '_', 2) AS grp FROM (SELECT gold_intent AS label FROM pairs UNION SELECT pred_intent FROM pairs))"
_S = "s AS (SELECT a.label AS a, b.label AS b, CASE WHEN a.label = b.label THEN 1.0 ELSE CAST(split_part(a.label, '_', 1) = split_part(b.label, '_', 1) AS INT) * 0.55 + CAST(a.grp = b.grp AS INT) * 0.4 + least(length(a.label), length(b.label)) / 1000.0 END AS similarity FROM g a CROSS JOIN g b), rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY CAST(similarity AS DOUBLE) DESC, b) AS INT) AS rank FROM s), ew AS (SELECT gold, pred, count(*) AS n FROM w GROUP BY ALL), nr AS (SELECT gold, pred, n, rank, similarity FROM ew JOIN rk ON gold = a AND pred = b)"
_BREAK = "count_if(gold_scenario = pred_scenario AND gold_action <> pred_action) AS action_only, count_if(gold_scenario <> pred_scenario AND gold_action = pred_action) AS scenario_only, count_if(gold_scenario <> pred_scenario AND gold_action <> pred_action) AS \"both\""
_CN = "len(candidates) > 0"
_HIT = "list_contains(candidates, gold_intent)"
_STATS = f"""CAST(sum(coalesce(shared, 0)) AS BIGINT) AS tp, CAST(sum(coalesce(preds, 0)) - sum(coalesce(shared, 0)) AS BIGINT) AS fp, CAST(sum(coalesce(golds, 0)) - sum(coalesce(shared, 0)) AS BIGINT) AS fn, round(coalesce(2.0 * sum(shared) / nullif(sum(golds) + sum(preds), 0), 0), 6) AS slu_f1,
count_if({_CN}) AS c_present_n, count_if({_HIT}) AS c_hit_n, round(count_if({_HIT}) / nullif(count_if({_CN}), 0), 6) AS c_hit_rate, count_if({_HIT} AND gold_intent = pred_intent) AS c_hit_correct_n, round(count_if({_HIT} AND gold_intent = pred_intent) / nullif(count_if({_HIT}), 0), 6) AS c_correct_given_hit"""
_LINEAR = "b AS (SELECT m.*, CAST(CASE WHEN wer <= 1.0 THEN least(floor(wer / 0.25), 3) ELSE 4 END AS INT) AS bin FROM m), l2 AS (SELECT *, bin * 0.25 AS low, CASE WHEN bin < 4 THEN (bin + 1) * 0.25 END AS high FROM b)"
SQL = {
    "x1_top_confusions": f"WITH {_W} SELECT gold, pred, count(*) AS n, min(CASE WHEN gold_scenario = pred_scenario THEN 'same_scenario' WHEN gold_action = pred_action THEN 'same_action' ELSE 'both' END) AS relation FROM w GROUP BY ALL ORDER BY n DESC, gold, pred LIMIT 25",
    "x2_error_breakdown": f"""WITH {V.PAIRS}, a AS (SELECT model, {_BREAK}, count_if(gold_intent <> pred_intent) AS errors FROM pairs GROUP BY model) SELECT *, round(100 * action_only / errors, 6) AS action_only_pct, round(100 * scenario_only / errors, 6) AS scenario_only_pct, round(100 * "both" / errors, 6) AS both_pct FROM a""",
    "x3_entity_type_confusion": f"""WITH {V.ENTITIES}, gs AS (SELECT DISTINCT key, type, filler FROM ge), ps AS (SELECT DISTINCT key, type, filler FROM pe), gx AS (SELECT * FROM gs ANTI JOIN ps USING (key, type, filler)), px AS (SELECT * FROM ps ANTI JOIN gs USING (key, type, filler))
    SELECT 'fp' AS kind, NULL AS gold_type, type AS pred_type, count(*) AS n FROM px GROUP BY ALL UNION ALL SELECT 'fn', type, NULL, count(*) FROM gx GROUP BY ALL UNION ALL SELECT 'swap', gx.type, px.type, count(*) FROM gx JOIN px USING (key, filler) WHERE gx.type <> px.type GROUP BY ALL""",
    "x4_confusion_clusters": f"WITH {_W}, c AS (SELECT least(gold, pred) AS a, greatest(gold, pred) AS b, count(*) AS total, count_if(gold < pred) AS a_to_b, count_if(gold > pred) AS b_to_a FROM w GROUP BY ALL) SELECT *, a_to_b > 0 AND b_to_a > 0 AS bidirectional, split_part(a, '_', 1) = split_part(b, '_', 1) AS same_scenario FROM c WHERE total >= 10",
    "x5_compare_confusions": f"WITH {_W}, c AS (SELECT gold, pred, count_if(model = 'm0') AS m0, count_if(model = 'm1') AS m1, count_if(model = 'm2') AS m2 FROM w GROUP BY ALL) SELECT *, greatest(m0, m1, m2) AS most, m2 - m0 AS diff, split_part(gold, '_', 1) <> split_part(pred, '_', 1) AS cross_scenario FROM c ORDER BY most DESC, gold, pred LIMIT 20",
    "x6_scenario_accuracy": f"WITH {V.PAIRS} SELECT gold_scenario, model, count(*) AS n, round(avg(CAST(gold_intent = pred_intent AS INT)), 6) AS accuracy FROM pairs GROUP BY ALL",
    "x7_wer_bands": f"WITH {V.CANDIDATES}, {V.MULTISETS}, b AS (SELECT c.*, shared, golds, preds, CASE WHEN wer = 0 THEN '0' WHEN wer <= 0.2 THEN '0-0.2' WHEN wer <= 0.5 THEN '0.2-0.5' ELSE '>0.5' END AS band FROM c LEFT JOIN ms USING (key) WHERE wer IS NOT NULL), u AS (SELECT * FROM b UNION ALL SELECT * REPLACE ('ALL' AS band) FROM b) SELECT model, band, {V.ACCURACIES}, {_STATS}, {_BREAK} FROM u GROUP BY model, band",
    "x8_wer_bins": f"""WITH {V.PAIRS}, q AS (SELECT list_concat([0.0], quantile_cont(wer, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) FILTER (wer <= 1), [1.0]) AS e FROM pairs), r AS (SELECT unnest(range(0, 9)) AS bin, e FROM q), k AS (SELECT bin, e[bin + 1] AS low, e[bin + 2] AS high FROM r)
    SELECT CAST(bin AS INT) AS bin, round(low, 6) AS low, round(high, 6) AS high, count(*) AS n FROM pairs JOIN k ON CASE WHEN bin = 8 THEN wer > low ELSE wer >= low AND (wer < high OR (bin = 7 AND wer <= high)) END GROUP BY ALL""",
    "x8_log_bins": f"WITH {V.PAIRS}, s AS (SELECT greatest(0.013, min(wer) FILTER (wer > 0 AND wer <= 0.9)) AS s FROM pairs), b AS (SELECT CASE WHEN wer < s THEN 0 WHEN wer < s * pow(0.9 / s, 1 / 3.0) THEN 1 WHEN wer < s * pow(0.9 / s, 2 / 3.0) THEN 2 WHEN wer <= 0.9 THEN 3 ELSE 4 END AS bin FROM pairs CROSS JOIN s WHERE wer IS NOT NULL) SELECT CAST(bin AS INT) AS bin, count(*) AS n FROM b GROUP BY 1",
    "x8_linear_bins": f"WITH {V.PAIRS}, m AS (SELECT * FROM pairs), {_LINEAR} SELECT bin, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, count(*) AS n, round(min(wer), 6) AS least, round(max(wer), 6) AS most FROM l2 GROUP BY ALL",
    "x9_bin_metrics": f"WITH {V.CANDIDATES}, {V.MULTISETS}, m2 AS (SELECT c.*, shared, golds, preds FROM c LEFT JOIN ms USING (key)), {_LINEAR.replace('FROM m)', 'FROM m2 AS m)')} SELECT model, bin, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, {V.ACCURACIES}, {_STATS} FROM l2 GROUP BY ALL HAVING count(*) >= 20",
    "x9_bin_table": f"""WITH {V.CANDIDATES}, {V.MULTISETS}, edges AS (SELECT * FROM (VALUES (0, '0-30', '0.0000', '0.3000'), (1, '30-30', '0.3000', '0.3000'), (2, '30-60', '0.3000', '0.6000'), (3, '60-100', '0.6000', '1.0000')) AS v(bin, bin_label, bin_lo, bin_hi)),
    b AS (SELECT c.*, shared, golds, preds, CASE WHEN wer < 0.3 THEN 0 WHEN wer < 0.6 THEN 2 WHEN wer <= 1 THEN 3 END AS bin FROM c LEFT JOIN ms USING (key)), a AS (SELECT model, bin, {V.ACCURACIES}, {_STATS} FROM b GROUP BY ALL)
    SELECT k.model, bin_label, bin_lo, bin_hi, CAST(coalesce(n, 0) AS VARCHAR) AS n, {", ".join(f"CASE WHEN n >= 5 THEN coalesce(printf('%.6f', {c}), '') ELSE '' END AS {c}" for c in ("scenario_accuracy", "action_accuracy", "intent_accuracy", "slu_f1", "c_hit_rate", "c_correct_given_hit"))},
    {", ".join(f"CASE WHEN n >= 5 THEN CAST({c} AS VARCHAR) ELSE '' END AS {c}" for c in ("tp", "fp", "fn"))}, {", ".join(f"CAST(coalesce({c}, 0) AS VARCHAR) AS {c}" for c in ("c_present_n", "c_hit_n", "c_hit_correct_n"))} FROM (SELECT DISTINCT model FROM c) AS k CROSS JOIN edges LEFT JOIN a ON a.model = k.model AND a.bin = edges.bin""",
    "x10_absorption": f"""WITH {_W}, c AS (SELECT pred, gold, count(*) AS n FROM w WHERE pred IN ('click_a0', 'view_a1', 'unknown_a2') GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY pred) AS share, count(*) OVER (PARTITION BY pred) AS victims, CAST(row_number() OVER (PARTITION BY pred ORDER BY n DESC, gold) AS INT) AS rank FROM c),
    z AS (SELECT *, CASE WHEN max(share) OVER (PARTITION BY pred) > 0.4 THEN 'concentration' WHEN victims > 5 THEN 'trash_bin' ELSE 'mixed' END AS diagnosis FROM r) SELECT pred, gold, n, round(share, 6) AS share, victims, rank, diagnosis FROM z WHERE rank <= 10""",
    "x11_frequency_bias": f"""WITH {_W}, a AS (SELECT gold_intent AS label, count(*) AS golds FROM pairs GROUP BY 1), b AS (SELECT pred AS label, count(*) AS errors FROM w GROUP BY 1), j AS (SELECT coalesce(a.label, b.label) AS label, coalesce(golds, 0) / (SELECT count(*) FROM pairs) AS gs, coalesce(errors, 0) / (SELECT count(*) FROM w) AS es FROM a FULL JOIN b ON a.label = b.label),
    r AS (SELECT label, gs, es, CASE WHEN gs > 0 THEN es / gs END AS ratio FROM j) SELECT label, round(gs, 6) AS gold_share, round(es, 6) AS error_share, round(ratio, 6) AS ratio FROM r ORDER BY es DESC, label LIMIT 15""",
    "x12_error_graph": f"WITH {_W}, c AS (SELECT gold, pred, count(*) AS weight FROM w GROUP BY ALL), k AS (SELECT * FROM c WHERE weight >= greatest(5, floor(0.005 * (SELECT sum(weight) FROM c)))), i AS (SELECT pred, CAST(sum(weight) AS BIGINT) AS in_weight FROM k GROUP BY pred) SELECT gold, pred, weight, in_weight, in_weight > 0.2 * (SELECT max(in_weight) FROM i) AS hub FROM k JOIN i USING (pred)",
    "x13_in_group_rate": f"""WITH {_W}, {_G}, t AS (SELECT -1 AS trial, label, grp FROM g UNION ALL SELECT trial, label, CAST((row_number() OVER (PARTITION BY trial ORDER BY md5(label || '|0|' || trial), label) - 1) % (SELECT count(DISTINCT grp) FROM g) AS VARCHAR) FROM g CROSS JOIN (SELECT unnest(range(0, 10)) AS trial)),
    r AS (SELECT a.trial, avg(CAST(a.grp = b.grp AS INT)) AS rate FROM w JOIN t a ON gold = a.label JOIN t b ON pred = b.label AND a.trial = b.trial GROUP BY 1), f AS (SELECT max(rate) FILTER (trial = -1) AS rate, avg(rate) FILTER (trial >= 0) AS random_rate FROM r) SELECT round(rate, 6) AS rate, round(random_rate, 6) AS random_rate, round(rate / random_rate, 6) AS lift FROM f""",
    "x14_in_group_confusions": f"WITH {_W}, {_G}, c AS (SELECT gold, pred, count(*) AS n FROM w GROUP BY ALL), j AS (SELECT gold, pred, a.grp, n FROM c JOIN g a ON gold = a.label JOIN g b ON pred = b.label AND a.grp = b.grp) SELECT gold, pred, grp, n, (SELECT string_agg(label, ',' ORDER BY label) FROM g WHERE g.grp = j.grp AND label <> gold AND label <> pred) AS others FROM j ORDER BY n DESC, gold, pred LIMIT 10",
    "x15_neighbor_ranks": f"WITH {_W}, {_G}, {_S} SELECT gold, pred, n, rank, CAST(round(similarity, 6) AS DOUBLE) AS similarity FROM nr",
    "x15_neighbor_summary": f"WITH {_W}, {_G}, {_S}, a AS (SELECT CAST(sum(n) AS BIGINT) AS errors, sum(n) FILTER (rank = 1) / sum(n) AS rank_1, " + ", ".join(f"round(coalesce(sum(n) FILTER (rank <= {k}), 0) / sum(n), 6) AS rank_{k}" for k in (3, 5, 10)) + ", " + ", ".join(f"round(coalesce(sum(n) FILTER (similarity >= {t / 10}), 0) / sum(n), 6) AS from_0{t}" for t in range(5, 10)) + " FROM nr) SELECT * REPLACE (round(coalesce(rank_1, 0), 6) AS rank_1), round(1 / 29, 6) AS random_1, round(coalesce(rank_1, 0) * 29, 6) AS lift FROM a",
    "x16_selection_errors": f"WITH {V.PAIRS} SELECT 'scenario' AS kind, gold_scenario AS gold, pred_scenario AS pred, count(*) AS n FROM pairs WHERE gold_scenario <> pred_scenario GROUP BY ALL UNION ALL SELECT 'action', gold_action, pred_action, count(*) FROM pairs WHERE gold_action <> pred_action GROUP BY ALL",
    "x17_expand_groups": f"WITH {_W}, {_G}, c AS (SELECT gold, pred, row_number() OVER (PARTITION BY gold ORDER BY count(*) DESC, pred) AS r FROM w GROUP BY gold, pred), u AS (SELECT a.label, b.label AS member FROM g a JOIN g b USING (grp) UNION SELECT gold, pred FROM c WHERE r <= 3) SELECT label, string_agg(member, ',' ORDER BY member) AS members FROM u GROUP BY label",
}
