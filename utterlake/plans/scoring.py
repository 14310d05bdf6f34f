"""Queries of the metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from . import views as V

MODELS = ("m0", "m1", "m2")


def m1(spark, d):
    return V.rounded(M.label_f1(V.pairs(spark, d), "gold_intent", "pred_intent"))


def m1_macro(spark, d):
    return V.rounded(M.overall(M.label_counts(V.pairs(spark, d), "gold_scenario", "pred_scenario"), "macro"))


def m2(spark, d):
    return V.rounded(M.span_f1(V.entities(spark, d)))


def m3(spark, d):
    return V.rounded(M.entity_set_f1(V.entities(spark, d)))


def m3_row(spark, d):
    return V.rounded(M.row_entity_f1(V.matched(spark, d)).select("key", "entity_f1"))


def m6(spark, d):
    return V.rounded(M.evaluate(V.matched(spark, d)))


def m7(spark, d):
    return V.rounded(M.compare_label_f1(V.pairs(spark, d), "gold_intent", "pred_intent", MODELS, 15))


def m11(spark, d):
    return V.rounded(M.reward(V.matched(spark, d)).select("key", "scenario_ok", "action_ok", "intent_ok", "reward"))


def m12(spark, d):
    return V.rounded(M.candidate_stats(V.candidates(spark, d)))


def m13(spark, d):
    return V.rounded(M.success_score(V.candidates(spark, d)).select("key", "match_ok", "gold_in_candidates", "slot_coverage", "score", "correct"))


def m13_slots(spark, d):
    """Slot types in any case, blank or __none__."""
    n, none = F.col("n"), F.array().cast("array<string>")
    gold = F.when(n % 3 == 0, F.array(F.lit("__none__"))).otherwise(F.array(F.lit("Time"), F.lit("Place")))
    said = F.when(n % 4 == 0, F.array(F.lit("__NONE__"), F.lit(" "))).when(n % 4 == 1, F.array(F.lit(" time"))).when(n % 4 == 2, F.array(F.lit("PLACE"), F.lit("time"), F.lit("x"))).otherwise(none)
    return V.rounded(M.success_score(V.candidates(spark, d).withColumns({"gold_slots": gold, "slot_candidates": said})).select("key", "slot_coverage"))


def _reasons(spark, d):
    n, pair = F.col("n"), lambda label, reason: F.struct(label.alias("label"), reason.alias("reason"))
    said = lambda c, text: F.when(c, text).otherwise(" ")
    pairs = F.array(
        pair(F.replace("pred_intent", F.lit("_"), F.lit(":")), said(n % 5 != 0, "not said")), pair(F.lit("other_a0"), said(n % 6 != 0, "too far")),
        pair(F.lit("Slot: R (2)"), said(n % 4 != 0, "unused")), pair(F.lit("X"), F.lit("unused")), pair(F.lit("nobody"), F.lit("unused")),
    )
    return V.candidates(spark, d).withColumn("pairs", pairs)


def m14(spark, d):
    rows = M.candidate_bonus(M.rationale_coverage(_reasons(spark, d)), intent=0.5, slot=0.25, count=0.1)
    return V.rounded(M.format_adjusted(rows.withColumn("reward", F.lit(1.0)), 0.2, 0.3).select("key", "rationale_coverage", "bonus", "reward"))


def m15(spark, d):
    """Coverage of intents alone: the rows name no slot types."""
    rows = V.candidates(spark, d).withColumns({"slot_candidates": F.array().cast("array<string>"), "pairs": F.transform("reasoned", lambda x: F.struct(x.alias("label"), F.lit("why").alias("reason")))})
    return V.rounded(M.run_summary(M.rationale_coverage(M.reward(rows)), ["model"]))


def m16(spark, d):
    p = V.pairs(spark, d).withColumns({"parent_intent": F.concat_ws("_", "gold_scenario", F.lit("a0")), "student": F.col("pred_intent"), "baseline": F.when(F.col("n") % 2 == 0, F.concat_ws("_", "gold_scenario", F.lit("a0"))).otherwise(F.col("gold_intent"))})
    p = p.withColumn("scores", F.map_from_arrays(F.array_distinct(F.array("gold_intent", "parent_intent")), F.when(F.col("gold_intent") == F.col("parent_intent"), F.array((F.col("n") + 1) / 200.0)).otherwise(F.array((F.col("n") + 1) / 200.0, F.lit(0.25)))))
    return V.rounded(M.boundary_metrics(p).drop("contrast_count"))


def m16_contrast(spark, d):
    """Score maps without gold or parent, and scores that are no probabilities."""
    n = F.col("n")
    p = V.pairs(spark, d).select("gold_intent", F.when(n % 11 == 0, "").otherwise("up_a0").alias("parent_intent"), F.col("pred_intent").alias("student"), F.when(n % 2 == 0, "up_a0").alias("baseline"), "n")
    entry = lambda k, v: F.struct(k.alias("k"), v.cast("double").alias("v"))
    found = F.array_compact(F.array(F.when(n % 3 != 0, entry(F.col("gold_intent"), F.when(n % 7 == 0, 1.5 + n).otherwise((n % 2) * 0.5))), F.when(n % 5 != 0, entry(F.lit("up_a0"), F.lit(0.25)))))
    return V.rounded(M.boundary_metrics(p.withColumn("scores", F.map_from_entries(found))).select("n", "parent_errors", "contrast", "contrast_count"))


def m17(spark, d):
    return V.rounded(M.crj_report(_crj(spark, d)))


def m17_strict(spark, d):
    return V.rounded(M.crj_report(_crj(spark, d), strict_r=True))


def m16_overlap(spark, d):
    p = V.pairs(spark, d)
    return V.rounded(M.rationale_overlap(p.select(F.format_string("The %s is not for %s", "gold_intent", "pred_action").alias("rationale"), F.format_string("%s with %s", "gold_scenario", "gold_action").alias("sentence"))))


def _crj(spark, d):
    n = F.col("n")
    return V.candidates(spark, d).select("key", (n % 10 != 0).alias("has_c"), (n % 4 != 0).alias("has_r"), (n % 7 != 0).alias("has_j"), (n % 14 != 1).alias("valid_j"), (n % 3).alias("n_intents"), (n % 2).alias("n_slots"), (F.size("gold_slots") > 0).alias("has_slots"))


def m17_candidates(spark, d):
    return V.rounded(M.crj_candidates(_crj(spark, d)))


def m17_failing(spark, d):
    rows = _crj(spark, d)
    parts = {"missing_crj": M.is_crj(), "invalid_j": F.col("valid_j")}
    found = [M.failing(rows, ok, 20, "key").select(F.lit(k).alias("check"), "key") for k, ok in parts.items()]
    return found[0].unionByName(found[1])


def m18(spark, d):
    runs = V.pairs(spark, d).groupBy((F.col("n") % 20).alias("index")).agg(F.avg("wer").alias("w"), F.count(F.lit(1)).alias("c"))
    runs = runs.select("index", F.when(F.col("index") % 6 == 5, "failed").otherwise("ok").alias("status"), F.when(F.col("index") % 5 == 4, F.create_map(F.lit("x"), "w")).otherwise(F.create_map(F.lit("eval_wer"), F.round("w", 6))).alias("metrics"))
    return M.rank_runs(runs, "eval_wer").select("index", F.when(F.col("value") > float("-inf"), F.col("value")).alias("value"), "rank")


def m18_grid(spark, d):
    values = V.table(spark, d, "events").agg(F.array_sort(F.collect_set("event_type")).alias("a"), F.array_sort(F.collect_set(F.col("user_id") % 4)).alias("b"))
    return M.expand_grid(values, ["a", "b"])


def _samples(spark, d):
    return V.pairs(spark, d).select((F.col("key") % 500).alias("prompt_id"), "key", (F.col("n") % 4).cast("double").alias("reward"), "pred_intent", F.concat_ws("-", "pred_intent", (F.col("n") % 2).cast("string")).alias("output"))


def m19(spark, d):
    return V.rounded(M.group_advantage(_samples(spark, d)).select("key", "prompt_id", "advantage"), 5)


def m19_diversity(spark, d):
    return M.group_diversity(_samples(spark, d))


def w1(spark, d):
    p = V.matched(spark, d)
    parts = [M.label_f1(p, f"gold_{c}", f"pred_{c}").withColumn("level", F.lit(c)) for c in ("scenario", "action", "intent")]
    parts.append(M.span_f1(p).withColumn("level", F.lit("entity")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return V.rounded(out)


QUERIES = {
    "w1_evaluate": w1, "m1_label_f1": m1, "m1_label_f1_macro": m1_macro, "m2_span_f1": m2, "m3_entity_set_f1": m3, "m3_row_entity_f1": m3_row, "m6_evaluate": m6, "m7_compare_label_f1": m7, "m11_reward": m11,
    "m12_candidate_stats": m12, "m13_success_score": m13, "m13_slot_names": m13_slots, "m16_boundary_contrast": m16_contrast, "m14_rationale_coverage": m14, "m15_run_summary": m15, "m16_boundary_metrics": m16, "m16_rationale_overlap": m16_overlap, "m17_crj_report": m17, "m17_crj_report_strict": m17_strict, "m17_crj_candidates": m17_candidates, "m17_failing_ids": m17_failing, "m18_rank_runs": m18, "m18_expand_grid": m18_grid,
    "m19_group_advantage": m19, "m19_group_diversity": m19_diversity,
}


def _labels(level: str) -> str:
    return f"SELECT label, {V.SUMS} FROM (SELECT gold_{level} AS label, CAST(gold_{level} = pred_{level} AS INT) AS tp, 0 AS fp, CAST(gold_{level} <> pred_{level} AS INT) AS fn FROM pairs UNION ALL SELECT pred_{level}, 0, 1, 0 FROM pairs WHERE gold_{level} <> pred_{level}) GROUP BY label"


_SPANS = """gc AS (SELECT key, type, filler, count(*) AS n FROM ge GROUP BY ALL), pc AS (SELECT key, type, filler, count(*) AS n FROM pe GROUP BY ALL),
sc AS (SELECT coalesce(gc.type, pc.type) AS label, coalesce(gc.key, pc.key) AS key, least(coalesce(gc.n, 0), coalesce(pc.n, 0)) AS t, coalesce(gc.n, 0) AS g, coalesce(pc.n, 0) AS p
  FROM gc FULL JOIN pc ON gc.key = pc.key AND gc.type = pc.type AND gc.filler = pc.filler)"""
_SPAN_COUNTS = "SELECT label, CAST(sum(t) AS BIGINT) AS tp, CAST(sum(p - t) AS BIGINT) AS fp, CAST(sum(g - t) AS BIGINT) AS fn FROM sc"


def _with_overall(counts: str) -> str:
    return f"SELECT label, tp, fp, fn, {V.PRF6} FROM ({counts}) UNION ALL SELECT 'overall', tp, fp, fn, {V.PRF6} FROM (SELECT {V.SUMS} FROM ({counts}))"


def _known(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9'']+'), lambda x: NOT list_contains([{', '.join(f"'{x}'" for x in M.STOPWORDS)}], x)))"


_CRJ = "n % 10 <> 0 AND n % 7 <> 0 AND (n % 4 <> 0 OR (n % 3 <= 1 AND n % 2 <= 1))"
_SUBSETS = (
    ("intent_all", "i", "true"), ("slot_all", "s", "true"), ("intent_crj", "i", "ok"), ("slot_crj", "s", "ok"), ("slot_gold_has_slots_all", "s", "slots"), ("slot_gold_has_slots_crj", "s", "ok AND slots"),
)

SQL = {
    "w1_evaluate": f"WITH {V.MATCHED}, ks AS (SELECT DISTINCT key AS k FROM pairs), {_SPANS.replace('FROM ge', 'FROM ge JOIN ks ON key = k').replace('FROM pe', 'FROM pe JOIN ks ON key = k')} "
    + " UNION ALL ".join(f"SELECT *, '{c}' AS level FROM ({_with_overall(_labels(c))})" for c in ("scenario", "action", "intent"))
    + f" UNION ALL SELECT *, 'entity' AS level FROM ({_with_overall(_SPAN_COUNTS + ' GROUP BY label')})",
    "m1_label_f1": f"WITH {V.PAIRS} {_with_overall(_labels('intent'))}",
    "m1_label_f1_macro": f"WITH {V.PAIRS}, c AS ({_labels('scenario')}), s AS (SELECT tp, fp, fn, {V.PRF} FROM c), a AS (SELECT {V.SUMS}, avg(precision) AS p, avg(recall) AS r FROM s) SELECT 'overall' AS label, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM a",
    "m2_span_f1": f"WITH {V.ENTITIES}, {_SPANS} {_with_overall(_SPAN_COUNTS + ' GROUP BY label')}",
    "m3_entity_set_f1": f"WITH {V.MATCHED} SELECT tp, fp, fn, {V.PRF6} FROM (SELECT {V.SUMS} FROM sets)",
    "m3_row_entity_f1": f"WITH {V.MATCHED} SELECT key, round(entity_f1, 6) AS entity_f1 FROM m",
    "m6_evaluate": f"WITH {V.MATCHED}, a AS (SELECT model, {V.ACCURACIES}, {V.SUMS} FROM m GROUP BY model) SELECT *, {V.PRF6} FROM a",
    "m7_compare_label_f1": f"""WITH {V.PAIRS}, c AS (SELECT model, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT model, gold_intent AS label, CAST(gold_intent = pred_intent AS INT) AS tp, 0 AS fp, CAST(gold_intent <> pred_intent AS INT) AS fn FROM pairs
      UNION ALL SELECT model, pred_intent, 0, 1, 0 FROM pairs WHERE gold_intent <> pred_intent) GROUP BY ALL),
    s AS (SELECT model, label, {V.PRF} FROM c), t AS (SELECT label, coalesce(max(f1) FILTER (model = 'm0'), 0) AS m0, coalesce(max(f1) FILTER (model = 'm1'), 0) AS m1, coalesce(max(f1) FILTER (model = 'm2'), 0) AS m2 FROM s GROUP BY label)
    SELECT label, round(m0, 6) AS m0, round(m1, 6) AS m1, round(m2, 6) AS m2, round((m0 + m1 + m2) / 3, 6) AS mean, round(m2 - m0, 6) AS diff FROM t ORDER BY (m0 + m1 + m2) / 3, label LIMIT 15""",
    "m11_reward": f"WITH {V.MATCHED}, f AS (SELECT key, CAST(gold_scenario = pred_scenario AS INT) AS scenario_ok, CAST(gold_action = pred_action AS INT) AS action_ok, CAST(gold_intent = pred_intent AS INT) AS intent_ok, entity_f1 FROM m) SELECT key, scenario_ok, action_ok, intent_ok, round(scenario_ok + action_ok + 0.5 * intent_ok + entity_f1, 6) AS reward FROM f",
    "m12_candidate_stats": f"WITH {V.CANDIDATES}, h AS (SELECT model, len(candidates) > 0 AS has, list_contains(candidates, gold_intent) AS hit, gold_intent = pred_intent AS ok FROM c) SELECT model, count(*) AS n, round(avg(CAST(has AS INT)), 6) AS with_candidates, round(avg(CAST(hit AS INT)), 6) AS gold_in_candidates, round(avg(CAST(ok AS INT)) FILTER (hit), 6) AS accuracy_given_gold FROM h GROUP BY model",
    "m13_success_score": f"""WITH {V.CANDIDATES}, gt AS (SELECT DISTINCT key, type FROM ge), pt AS (SELECT DISTINCT key, type FROM pe),
    cov AS (SELECT coalesce(g.key, p.key) AS key, count(g.type) AS g, count(p.type) AS p, count_if(g.type IS NOT NULL AND p.type IS NOT NULL) AS b FROM gt g FULL JOIN pt p ON g.key = p.key AND g.type = p.type GROUP BY 1),
    f AS (SELECT c.key, gold_scenario = pred_scenario AND gold_action = pred_action AS match_ok, list_contains(candidates, gold_intent) AS gold_in_candidates, format_ok,
      CASE WHEN coalesce(g, 0) = 0 THEN CAST(coalesce(p, 0) = 0 AS INT) * 1.0 ELSE b / g END AS slot_coverage FROM c LEFT JOIN cov USING (key)),
    s AS (SELECT *, CAST(format_ok AS INT) + CAST(match_ok AS INT) + CAST(gold_in_candidates AS INT) + slot_coverage AS score FROM f)
    SELECT key, match_ok, gold_in_candidates, CAST(round(slot_coverage, 6) AS DOUBLE) AS slot_coverage, CAST(round(score, 6) AS DOUBLE) AS score, score >= 4 AS correct FROM s""",
    "m13_slot_names": f"WITH {V.PAIRS} SELECT key, CAST(CASE WHEN n % 3 = 0 THEN CASE WHEN n % 4 IN (0, 3) THEN 1 ELSE 0 END ELSE CASE n % 4 WHEN 1 THEN 0.5 WHEN 2 THEN 1 ELSE 0 END END AS DOUBLE) AS slot_coverage FROM pairs",
    "m16_boundary_contrast": f"""WITH {V.PAIRS}, j AS (SELECT *, CASE WHEN n % 11 = 0 THEN '' ELSE 'up_a0' END AS parent, CASE WHEN n % 3 <> 0 THEN CASE WHEN n % 7 = 0 THEN 1.5 + n ELSE (n % 2) * 0.5 END END AS g, CASE WHEN n % 5 <> 0 THEN 0.25 END AS p FROM pairs),
    f AS (SELECT parent <> '' AND n % 2 = 0 AND parent <> gold_intent AS missed, CASE WHEN parent <> '' AND g IS NOT NULL AND p IS NOT NULL THEN CASE WHEN g <= 1 THEN ln(greatest(g, 1e-12)) - ln(p) ELSE g - p END END AS contrast FROM j)
    SELECT count(*) AS n, count_if(missed) AS parent_errors, round(avg(contrast), 6) AS contrast, count(contrast) AS contrast_count FROM f""",
    "m14_rationale_coverage": f"""WITH {V.CANDIDATES}, pt AS (SELECT key, list(DISTINCT lower(type)) AS slots FROM pe GROUP BY key), gt AS (SELECT key, list(DISTINCT lower(type)) AS golds FROM ge GROUP BY key),
    r AS (SELECT c.key, n, format_ok, list_contains(candidates, gold_intent) AS hit, len(candidates) AS k, list_filter(candidates, lambda x: x <> gold_intent) AS rejected, pred_intent, coalesce(slots, []) AS slots, coalesce(golds, []) AS golds FROM c LEFT JOIN pt USING (key) LEFT JOIN gt USING (key)),
    v AS (SELECT *, len(rejected) + len(slots) AS total, len(list_filter(rejected, lambda x: (x = pred_intent AND n % 5 <> 0) OR (x = 'other_a0' AND n % 6 <> 0))) + len(list_filter(slots, lambda x: (x = 'r' AND n % 4 <> 0) OR x = 'x')) AS covered FROM r)
    SELECT key, CAST(round(CASE WHEN total = 0 THEN 1.0 ELSE covered / total END, 6) AS DOUBLE) AS rationale_coverage,
      CAST(round(CASE WHEN hit THEN 0.5 ELSE 0 END + CASE WHEN len(list_intersect(slots, golds)) > 0 THEN 0.25 ELSE 0 END + 0.1 * greatest(0.0, 1 - abs(k - 3) / 3.0), 6) AS DOUBLE) AS bonus, CAST(CASE WHEN format_ok THEN 1.2 ELSE 0.7 END AS DOUBLE) AS reward FROM v""",
    "m15_run_summary": f"""WITH RECURSIVE {V.CANDIDATES}, {V.GREEDY}, r AS (SELECT *, CAST(gold_scenario = pred_scenario AS INT) + CAST(gold_action = pred_action AS INT) + 0.5 * CAST(gold_intent = pred_intent AS INT) + entity_f1 AS reward, list_filter(candidates, lambda x: x <> gold_intent) AS rejected FROM c),
    v AS (SELECT *, CASE WHEN len(rejected) = 0 THEN 1.0 ELSE len(list_filter(rejected, lambda x: list_contains(reasoned, x))) / len(rejected) END AS cov FROM r), k AS (SELECT key, sum(tp) AS st, sum(fp) AS sf, sum(fn) AS sn FROM gc GROUP BY key),
    a AS (SELECT model, {V.ACCURACIES}, round(avg(reward), 6) AS reward, round(avg(entity_f1), 6) AS entity_f1, round(avg(cov), 6) AS rationale_coverage, round(avg(CAST(cov = 1 AS INT)), 6) AS rationale_full, round(sum(coalesce(st, 0)), 6) AS slu_tp, round(sum(coalesce(sf, 0)), 6) AS slu_fp, round(sum(coalesce(sn, 0)), 6) AS slu_fn FROM v LEFT JOIN k USING (key) GROUP BY model)
    SELECT *, round(CASE WHEN slu_tp > 0 THEN 2 * slu_tp / (2 * slu_tp + slu_fp + slu_fn) ELSE 0.0 END, 6) AS slu_f1 FROM a""",
    "m16_boundary_metrics": f"""WITH {V.PAIRS}, j AS (SELECT *, gold_scenario || '_a0' AS parent, CASE WHEN n % 2 = 0 THEN gold_scenario || '_a0' ELSE gold_intent END AS baseline FROM pairs),
    f AS (SELECT baseline = parent AND parent <> gold_intent AS missed, pred_intent = gold_intent AS ok, ln((n + 1) / 200.0) - CASE WHEN gold_intent = parent THEN ln((n + 1) / 200.0) ELSE ln(0.25) END AS contrast FROM j)
    SELECT count(*) AS n, round(avg(CAST(ok AS INT)), 6) AS accuracy, count_if(missed) AS parent_errors, count_if(missed AND ok) AS recovered, round(avg(CAST(ok AS INT)) FILTER (missed), 6) AS recovery_rate, round(avg(contrast), 6) AS contrast FROM f""",
    "m17_crj_report": f"""WITH {V.PAIRS}, f AS (SELECT n % 10 <> 0 AS c_, n % 4 <> 0 AS r_, n % 7 <> 0 AS j_, n % 14 <> 1 AS v_, n % 10 <> 0 AND n % 3 <= 1 AND n % 2 <= 1 AS o_ FROM pairs),
    a AS (SELECT count(*) AS n, count_if(c_) AS n_c, count_if(r_) AS n_r_nonempty, count_if(r_ OR o_) AS n_r, count_if(j_) AS n_j, count_if(o_) AS n_r_optional, count_if(c_ AND r_ AND j_) AS n_strict, count_if(c_ AND j_ AND (r_ OR o_)) AS n_crj, count_if(v_) AS n_valid FROM f), b AS (SELECT *, least(n_crj, n_valid) AS n_crj_valid FROM a)
    SELECT *, {", ".join(f"round(n_{k} / n, 6) AS {k}_ratio" for k in ("c", "r_nonempty", "r", "j", "r_optional", "strict", "crj", "valid", "crj_valid"))} FROM b""",
    "m17_crj_report_strict": f"""WITH {V.PAIRS}, f AS (SELECT n % 10 <> 0 AS c_, n % 4 <> 0 AS r_, n % 7 <> 0 AS j_, n % 14 <> 1 AS v_, n % 10 <> 0 AND n % 3 <= 1 AND n % 2 <= 1 AS o_ FROM pairs),
    a AS (SELECT count(*) AS n, count_if(c_) AS n_c, count_if(r_) AS n_r_nonempty, count_if(r_) AS n_r, count_if(j_) AS n_j, count_if(o_) AS n_r_optional, count_if(c_ AND r_ AND j_) AS n_strict, count_if(c_ AND j_ AND r_) AS n_crj, count_if(v_) AS n_valid FROM f), b AS (SELECT *, least(n_crj, n_valid) AS n_crj_valid FROM a)
    SELECT *, {", ".join(f"round(n_{k} / n, 6) AS {k}_ratio" for k in ("c", "r_nonempty", "r", "j", "r_optional", "strict", "crj", "valid", "crj_valid"))} FROM b""",
    "m16_rationale_overlap": f"""WITH {V.PAIRS}, t AS (SELECT 'The ' || gold_intent || ' is not for ' || pred_action AS a, gold_scenario || ' with ' || gold_action AS b FROM pairs), w AS (SELECT {_known("a")} AS a, {_known("b")} AS b FROM t)
    SELECT count(*) AS n, round(avg(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a) END), 6) AS overlap FROM w""",
    "m17_crj_candidates": f"""WITH {V.MATCHED}, f AS (SELECT n % 3 AS i, n % 2 AS s, {_CRJ} AS ok, EXISTS (SELECT 1 FROM ge WHERE ge.key = pairs.key) AS slots FROM pairs),
    u AS ({" UNION ALL ".join(f"SELECT '{k}' AS subset, {c} AS x FROM f WHERE {w}" for k, c, w in _SUBSETS)})
    SELECT subset, count(x) AS n, {", ".join(f"round(coalesce(CAST({a}(x) AS DOUBLE), 0), 6) AS {k}" for k, a in (("mean", "avg"), ("median", "median"), ("least", "min"), ("most", "max")))} FROM (SELECT unnest([{", ".join(f"'{k}'" for k, _, _ in _SUBSETS)}]) AS subset) LEFT JOIN u USING (subset) GROUP BY subset""",
    "m17_failing_ids": f"WITH {V.PAIRS} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS check, key FROM pairs WHERE NOT ({c}) ORDER BY key LIMIT 20)" for k, c in (("missing_crj", _CRJ), ("invalid_j", "n % 14 <> 1"))),
    "m18_rank_runs": f"WITH {V.PAIRS}, r AS (SELECT n % 20 AS index, round(avg(wer), 6) AS w FROM pairs GROUP BY 1), g AS (SELECT index, CASE WHEN index % 5 = 4 THEN NULL ELSE w END AS value FROM r WHERE index % 6 <> 5) SELECT index, value, CAST(row_number() OVER (ORDER BY value DESC NULLS LAST, index) AS INT) AS rank FROM g",
    "m18_expand_grid": "SELECT a, b, CAST(row_number() OVER (ORDER BY a, b) AS INT) AS index FROM (SELECT DISTINCT event_type AS a FROM events) CROSS JOIN (SELECT DISTINCT user_id % 4 AS b FROM events)",
    "m19_group_advantage": f"WITH {V.PAIRS}, s AS (SELECT key, key % 500 AS prompt_id, CAST(n % 4 AS DOUBLE) AS reward FROM pairs), w AS (SELECT *, avg(reward) OVER (PARTITION BY prompt_id) AS mu, stddev_pop(reward) OVER (PARTITION BY prompt_id) AS sd FROM s) SELECT key, prompt_id, round((reward - mu) / (CASE WHEN sd = 0 THEN 1 ELSE sd END + 1e-6), 5) AS advantage FROM w",
    "m19_group_diversity": f"WITH {V.PAIRS} SELECT key % 500 AS prompt_id, count(DISTINCT pred_intent || '-' || (n % 2)) AS outputs, count(DISTINCT n % 4) AS rewards, count(DISTINCT pred_intent) AS intents, CAST(max(n % 4) - min(n % 4) AS DOUBLE) AS spread FROM pairs GROUP BY 1",
}
