"""Queries of the parsing and normalising functions on texts whose close readings differ; each row says one of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions import parsing as P
from . import views as V


def _cases(*texts):
    """The text for each remainder of n."""
    out = F.lit(None).cast("string")
    for k, text in enumerate(texts):
        out = F.when(F.col("n") % len(texts) == k, text if not isinstance(text, str) else _named(text)).otherwise(out)
    return out


def _named(text):
    """A text with the pair's labels for <gs>, <ga>, <gi>, <ps>, <pa> and <pi>."""
    out = F.lit(text)
    for kind in "gp":
        for part, name in (("s", "scenario"), ("a", "action"), ("i", "intent")):
            out = F.replace(out, F.lit(f"<{kind}{part}>"), F.col(f"{'gold' if kind == 'g' else 'pred'}_{name}"))
    return out


def _sql(*cases):
    """CASE over the remainders of n; <gs> and the like in a case are columns."""
    def text(c):
        for kind, word in (("g", "gold"), ("p", "pred")):
            for part, name in (("s", "scenario"), ("a", "action"), ("i", "intent")):
                c = c.replace(f"<{kind}{part}>", f"{word}_{name}")
        return c

    return f"CASE n % {len(cases)} " + " ".join(f"WHEN {k} THEN {text(c)}" for k, c in enumerate(cases)) + " END"


def _flat(c):
    return F.array_join(F.transform(c, lambda e: F.concat_ws("=", e["type"], e["filler"])), ";")


def p1(spark, d):
    text = _cases('x {"scenario": "<gs>", "action": "<ga>"} y', "scenario: <gs> action=<ga>", '{scenario: "<gs>", action is off}', '} {"scenario": "<gs>"', '{"scenario": "<gs>"} {"action": "<ps>"}')
    return V.pairs(spark, d).withColumn("l", P.extract_json(text)).select("key", "l.scenario", "l.action")


def p3(spark, d):
    text = _cases(
        'J: {"scenario": "<gs>", "action": "<ga>"}\nOutput: {"scenario": "c", "action": "d"}', '{"scenario": "<gs>", "intent": "<pi>"}', '{{"final": {{"Intent": "<pi>"}}}}', 'no {bad {"action": " <ga> "}', 'J: not yet\nSLU: {"scenario": "<gs>"}',
        '```json\n{"SLOTS": [{"type": "T ", "value": 1}, {"x": "y"}]}\n``` {"scenario": "x"}', "none", '{"prediction": {"result": {"intent": "solo"}}}', 'SLU: [{"scenario": "", "action": "<pa>", "intent": "<gi>"}]',
    )
    return V.pairs(spark, d).withColumn("l", P.parse_prediction_label(text)).select("key", "l.scenario", "l.action", _flat(F.col("l.entities")).alias("entities"))


def p4(spark, d):
    text = _cases(
        'final: {"scenario": "<gs>"} final_prediction = {"action": "<ga>"} end', '{"scenario": "<gs>", "action": ""} then {"action": "<pa>"}', '{"a {"final_prediction": {"intent": "<gs>:<ga>"}}', "scenario: <gs>, action = 'off' intent=s_<pa>",
        '"{\\"scenario\\": \\"<gs>\\", \\"action\\": \\"<ga>\\"}"', '{"final": {"scenario": "error", "intent": "<pi>"}, "x": 1}', "none", 'final: soon {"x": {"scenario": "<gs>"}} final = none', 'scenario=<gs> scenario=<ps> final: action=<pa>',
    )
    return V.pairs(spark, d).withColumn("f", P.extract_final(text)).select("key", "f.label.scenario", "f.label.action", "f.method")


def p5(spark, d):
    """Rows whose own label is complete, in part or missing, with texts that say more, less or nothing."""
    n, none = F.col("n"), F.lit(None).cast(f"array<{N.ENTITY}>")
    rows = V.pairs(spark, d).select(
        "key", F.when(n % 2 == 0, F.col("gold_scenario")).alias("scenario"), F.when(n % 4 == 0, F.lit("own")).alias("action"), none.alias("entities"),
        F.when(n % 3 == 0, F.concat(F.lit('J: {"intent": "'), "pred_intent", F.lit('"}'))).when(n % 3 == 1, F.lit("nothing")).alias("raw_output"), F.when(n % 5 == 0, F.lit('{"action": "only"}')).alias("text"),
    )
    return P.recover_predictions(rows, ["raw_output", "text"]).select("key", "scenario", "action", "changed", "recovered", "unresolved")


def p8(spark, d):
    line = _cases("Intents: <gi> | <gi> | none ; Slots: Time(x|y) | date | (none) ; more", "<gi>|<pi>", "intent: <gs>:<ga>;", "")
    p = V.pairs(spark, d).withColumn("line", line)
    return p.select("key", F.array_join(P.intent_candidates("line"), "|").alias("intents"), F.array_join(P.intent_candidates("line", False), "|").alias("all_intents"), F.array_join(P.slot_candidates("line"), "|").alias("slots"))


def p9(spark, d):
    text = _cases("x\nC: Intent candidates: 1. <gs>-<ga> | alarm; 2) <pi>\nmore_names, x\n\nlater_on", "R: a_b\nno c", "c： <gi> | (Other!Name), <gi>\nR: c_d", "the intent candidates are <gi>; slot candidates: t_u")
    return P.c_block_candidates(V.pairs(spark, d).select("key", text.alias("text"), F.when(F.col("n") % 5 == 0, "C: a_b").alias("first")), ["first", "text"]).select("key", "has_c", F.array_join("candidates", "|").alias("found"))


def p10(spark, d):
    line = _cases("<gi>!why; <pi> ;!x;; a:b!c!d", "(none)", "")
    pairs = P.rationale_pairs(line)
    return V.pairs(spark, d).select("key", F.array_join(F.transform(pairs, lambda x: F.concat(x["label"], F.lit("="), x["reason"])), "|").alias("pairs"))


def p11(spark, d):
    line = _cases("C: Intents: <gs>:<ga> | '<gs>_A9' | <gs>_a9 | intent; Slots: Time(a|b)|x", "C: x y | X_Y", "<gi>", "C: ", "C: intent;time")
    return V.pairs(spark, d).select("key", P.sanitize_c_line(line).alias("line"))


def p12(spark, d):
    text = _cases('x {"scenario": "<gs>", "entities": [{"type": "t"}]} y', 'a {"x": 1} Answer: q {"y": {"z": 2}} z', " Answer: <gi> ", "plain", '```json\n{"f": 1}\n``` {"g": 2}', '```\n{"h": 1}\n```')
    return V.pairs(spark, d).select("key", P.extract_answer_json(text).alias("answer"))


def n5(spark, d):
    """Records whose final has less than the record, or is not there, with entities named by spans."""
    n, none = F.col("n"), F.lit(None).cast("string")
    entity = F.array(F.struct(F.lit("t").alias("type"), none.alias("filler"), F.when(n % 5 == 0, F.lit("by value")).alias("value"), F.array(F.lit(1), F.lit(0), F.lit(9)).alias("span")))
    final = F.when(n % 2 == 0, F.struct(F.col("gold_scenario").alias("scenario"), F.when(n % 4 == 0, F.replace("pred_intent", F.lit("_"), F.lit(":"))).alias("intent"), F.when(n % 3 == 0, entity).alias("entities")))
    rows = V.pairs(spark, d).select("key", final.alias("final"), F.lit("own").alias("scenario"), none.alias("action"), F.col("gold_intent").alias("intent"), entity.alias("entities"), F.array(F.struct(F.lit("Up").alias("surface")), F.struct(F.col("pred_scenario").alias("surface"))).alias("tokens"))
    return N.label_from_record(rows).select("key", "label.scenario", "label.action", _flat(F.col("label.entities")).alias("entities"))


def n9(spark, d):
    texts = [F.concat(F.lit(a), F.col("c_custkey")) for a in ("'massive-fr-FR-", "massive_fr_FR_", "massive-fr_fr-", "massive_fr-fr_", "id-", "fr-FR-", "massive-")]
    text = F.get(F.array(*texts), (F.col("c_custkey") % len(texts)).cast("int"))
    return V.table(spark, d, "customer").select("c_custkey", N.normalize_massive_id(text).alias("id"), N.normalize_massive_id(F.concat(F.lit("massive-a-b-c-"), "c_custkey"), "a-b-c").alias("own"))


def n12(spark, d):
    """Identifiers and files in columns, in meta, in the JSON of a rationale and in running text."""
    i, none = F.col("event_id"), F.lit(None).cast("string")
    meta = F.when(i % 5 == 1, F.struct(F.concat(F.lit("m"), "user_id").alias("id"), F.when(i % 2 == 0, F.concat(F.lit("m"), i, F.lit(".wav"))).alias("file")))
    rationale = F.when(i % 7 == 1, F.format_string('{"id": "r%s", "meta": {"filename": "n%s.wav"}}', i, i)).when(i % 7 == 2, F.format_string('{"meta": {"slurp_id": %s}}', i)).when(i % 7 == 3, F.format_string("heard audio-%s.flac twice", i)).when(i % 7 == 4, F.format_string("filename = 'q%s'", i))
    rows = V.table(spark, d, "events").select("event_id", F.when(i % 3 == 0, i.cast("string")).otherwise(F.lit(" ")).alias("id"), none.alias("filename"), meta.alias("meta"), rationale.alias("rationale_text"), F.when(i % 11 == 0, F.array(F.struct(F.concat(F.lit("rec"), i).alias("file")))).alias("recordings"))
    return N.sample_file(N.sample_id(rows, pos="event_id")).select("event_id", "sample_id", "sample_file")


def n13(spark, d):
    text = F.format_string("take\n-%s now\n 2) %s\n3.one %s two \n• dot %s\n*\n", "event_type", "event_type", "user_id", "user_id")
    return V.table(spark, d, "events").select("event_id", F.array_join(N.bullet_candidates(text), "|").alias("found"))


def n15(spark, d):
    i, none = F.col("event_id"), F.lit(None).cast("string")
    first = F.struct(F.when(i % 2 == 0, F.lit(" ")).alias("text"), F.when(i % 3 == 0, F.concat(F.lit(" "), "event_type")).alias("transcript"), none.alias("hypothesis"), F.when(i % 5 == 0, F.lit("v")).alias("value"))
    rows = V.table(spark, d, "events").select("event_id", F.when(i % 4 != 0, F.array(first)).alias("asr_hypotheses"), F.when(i % 2 == 0, F.col("event_type")).alias("sentence"), F.lit("text ").alias("text"))
    asr = N.select_input_text(rows).select("event_id", F.col("input_text").alias("best"), F.col("source").alias("best_source"))
    gold = N.select_input_text(rows, False).select("event_id", F.col("input_text").alias("gold"), F.col("source").alias("gold_source"))
    return asr.join(gold, "event_id")


QUERIES = {
    "p1_extract_json_readings": p1, "p3_parse_prediction_label_readings": p3, "p4_extract_final_readings": p4, "p5_recover_predictions_rows": p5, "p8_candidates_readings": p8, "p9_c_block_readings": p9, "p10_rationale_pairs_readings": p10,
    "p11_sanitize_c_line_readings": p11, "p12_answer_json_readings": p12, "n5_label_from_record_readings": n5, "n9_massive_id_readings": n9, "n12_sample_id_readings": n12, "n13_bullet_readings": n13, "n15_input_text_readings": n15,
}

_P = f"WITH {V.PAIRS} SELECT key, "
SQL = {
    "p1_extract_json_readings": _P + _sql("<gs>", "'none'", "<gs>", "<gs>", "<gs>") + " AS scenario, " + _sql("<ga>", "'none'", "'is'", "'none'", "<ps>") + " AS action FROM pairs",
    "p3_parse_prediction_label_readings": _P + _sql("<gs>", "<gs>", "<ps>", "''", "<gs>", "''", "'error'", "''", "''") + " AS scenario, " + _sql("<ga>", "''", "<pa>", "<ga>", "''", "''", "'error'", "'solo'", "<pa>") + " AS action, " + _sql("''", "''", "''", "''", "''", "'T=1;='", "''", "''", "''") + " AS entities FROM pairs",
    "p4_extract_final_readings": _P + _sql("''", "coalesce(nullif(<gs>, 'error'), '')", "<gs>", "coalesce(nullif(<gs>, 'error'), 's')", "<gs>", "<ps>", "''", "''", "''") + " AS scenario, " + _sql("<ga>", "<pa>", "<ga>", "<pa>", "<ga>", "<pa>", "''", "''", "<pa>") + " AS action, "
    + _sql("'final_keyword_object'", "'embedded_object'", "'embedded_final_prediction'", "'not_found'", "'top_level'", "'top_level_final'", "'not_found'", "'not_found'", "'not_found'") + " AS method FROM pairs",
    "p5_recover_predictions_rows": f"""WITH {V.PAIRS}, o AS (SELECT key, n, pred_scenario AS ps, pred_action AS pa, CASE WHEN n % 2 = 0 THEN gold_scenario ELSE '' END AS s, CASE WHEN n % 4 = 0 THEN 'own' ELSE '' END AS a FROM pairs),
r AS (SELECT *, CASE WHEN n % 3 = 0 THEN 2 ELSE -1 END AS one, CASE WHEN n % 5 = 0 THEN 1 ELSE -1 END AS two, CAST(s <> '' AS INT) + CAST(a <> '' AS INT) AS own FROM o),
x AS (SELECT *, CASE WHEN one >= two AND one >= own THEN ps WHEN two >= own THEN s ELSE s END AS ns, CASE WHEN one >= two AND one >= own THEN pa WHEN two >= own THEN 'only' ELSE a END AS na FROM r)
SELECT key, ns AS scenario, na AS action, ns <> s OR na <> a AS changed, s = '' AND a = '' AND (ns <> '' OR na <> '') AS recovered, ns IN ('', 'error', 'unknown') OR na = '' AS unresolved FROM x""",
    "p8_candidates_readings": _P + _sql("<gi>", "CASE WHEN gold_intent = pred_intent THEN <gi> ELSE <gi> || '|' || <pi> END", "<gi>", "''") + " AS intents, " + _sql("<gi> || '|' || <gi> || '|none'", "<gi> || '|' || <pi>", "<gi>", "''") + " AS all_intents, "
    + _sql("'time|date|; more'", "CASE WHEN gold_intent = pred_intent THEN <gi> ELSE <gi> || '|' || <pi> END", "'intent: ' || <gs> || ':' || <ga> || ';'", "''") + " AS slots FROM pairs",
    "p9_c_block_readings": f"WITH {V.PAIRS}, x AS (SELECT key, n, " + _sql("<gi> || '|' || <pi> || '_more_names'", "NULL", "<gi> || '|other_name'", "'the_intent_candidates_are_' || <gi>") + " AS t FROM pairs) SELECT key, t IS NOT NULL OR n % 5 = 0 AS has_c, CASE WHEN n % 5 = 0 AND (t IS NULL OR n % 4 = 3) THEN 'a_b' ELSE coalesce(t, '') END AS found FROM x",
    "p10_rationale_pairs_readings": _P + _sql("<gi> || '=why|' || <pi> || '=|=x|a:b=c!d'", "''", "''") + " AS pairs FROM pairs",
    "p11_sanitize_c_line_readings": _P + _sql("'C: Intent candidates: ' || <gi> || ' | ' || <gs> || '_A9; Slot candidates: Time(a|b)|x'", "'C: Intent candidates: x_y'", "<gi>", "'C: (none)'", "'C: Intent candidates: (none); Slot candidates: time'") + " AS line FROM pairs",
    "p12_answer_json_readings": _P + _sql("'{\"scenario\": \"' || <gs> || '\", \"entities\": [{\"type\": \"t\"}]}'", "'{\"y\": {\"z\": 2}}'", "<gi>", "'plain'", "'{\"f\": 1}'", "'{\"h\": 1}'") + " AS answer FROM pairs",
    "n5_label_from_record_readings": f"WITH {V.PAIRS} SELECT key, CASE WHEN n % 2 = 0 THEN gold_scenario ELSE 'own' END AS scenario, CASE WHEN n % 4 = 0 THEN pred_action WHEN n % 2 = 0 THEN '' ELSE gold_action END AS action, CASE WHEN n % 2 = 0 AND n % 3 <> 0 THEN '' WHEN n % 5 = 0 THEN 't=by value' ELSE 't=' || pred_scenario || ' up' END AS entities FROM pairs",
    "n9_massive_id_readings": "SELECT c_custkey, CASE c_custkey % 7 WHEN 4 THEN 'id-' WHEN 5 THEN 'fr-FR-' WHEN 6 THEN 'massive-' ELSE '' END || c_custkey AS id, CAST(c_custkey AS VARCHAR) AS own FROM customer",
    "n12_sample_id_readings": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) WHEN event_id % 5 = 1 THEN 'm' || user_id WHEN event_id % 7 = 1 THEN 'r' || event_id WHEN event_id % 7 = 2 THEN CAST(event_id AS VARCHAR) ELSE 'row_' || event_id END AS sample_id,
CASE WHEN event_id % 10 = 6 THEN 'm' || event_id || '.wav' WHEN event_id % 7 = 1 THEN 'n' || event_id || '.wav' WHEN event_id % 11 = 0 THEN 'rec' || event_id WHEN event_id % 7 = 3 THEN 'audio-' || event_id || '.flac' WHEN event_id % 7 = 4 THEN 'q' || event_id ELSE '' END AS sample_file FROM events""",
    "n13_bullet_readings": "SELECT event_id, event_type || ' now|one ' || user_id || ' two' AS found FROM events",
    "n15_input_text_readings": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 5 = 0 THEN 'v' ELSE '' END AS best, 'asr_1best' AS best_source, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'text' END AS gold, 'gold_transcript' AS gold_source FROM events",
}
