"""Queries of the normalising and parsing functions, on texts rendered from events and other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import normalise as N
from ..functions import parsing as P
from ..functions import spans as SP
from . import views as V


def rendered(spark, d):
    """Label pairs with a generated text: the R line is missing for every seventh n, J is fenced for every eleventh and broken for every thirteenth."""
    p = V.pairs(spark, d)
    n = F.col("n")
    js = F.format_string('{"scenario": "%s", "action": "%s", "entities": [{"type": "Time", "filler": " N%s "}, {"place": "P%s"}]}', "pred_scenario", "pred_action", n, n % 3)
    js = F.when(n % 13 == 0, F.regexp_replace(js, r"\}\]\}$", "")).when(n % 11 == 0, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).otherwise(js)
    c = F.format_string("Intent candidates: %s | %s | none; Slot candidates: time(a|b) | place%s", "gold_intent", "pred_intent", n % 2)
    r = F.when(n % 7 == 0, F.lit("")).otherwise(F.format_string("R: %s!not said; other:a0!too far!off\n", "pred_intent"))
    return p.withColumn("text", F.concat(F.lit("C: "), c, F.lit("\n"), r, F.lit("J: "), js))


def _utterances(spark, d):
    """Documents as utterances: all words as tokens, the whole text as sentence, spans anywhere in it."""
    docs = V.table(spark, d, "documents").withColumn("tokens", F.split(F.trim(F.col("text")), r"[\x20\x09-\x0D]+"))
    i, n = F.col("doc_id"), F.greatest(F.size("tokens"), F.lit(1))
    span = lambda at, more, t: F.struct(F.lit(t).alias("type"), F.array(at, more).alias("span"))
    at, last = ((i * 31) % n).cast("int"), (n - 1).cast("int")
    rec = lambda name, w: F.struct(name.alias("file"), w.alias("wer"), w.alias("ent_wer"), F.lit("correct").alias("status"))
    return docs.select(
        F.col("doc_id").alias("slurp_id"), F.col("doc_id").alias("pos"), F.col("text").alias("sentence"), F.col("lang").alias("scenario"), F.col("source").alias("action"), F.transform("tokens", lambda t: F.struct(t.alias("surface"))).alias("tokens"),
        F.array(span(at, last, "time"), span(((i * 7) % n).cast("int"), last + 1, "place")).alias("entities"),
        F.array(rec(F.concat(F.lit("f"), (i % 600).cast("string")), (i % 10) / 10.0), rec(F.concat(F.lit("g"), i.cast("string")), F.lit(0.5))).alias("recordings"),
    )


def n1(spark, d):
    u = _utterances(spark, d)
    modes = {m: N.span_filler("tokens", F.col("entities")[0]["span"], m) for m in ("indexed", "cased", "range")}
    return u.select("slurp_id", *[c.alias(m) for m, c in modes.items()])


def n2(spark, d):
    return N.gold_by_file(_utterances(spark, d), "cased").select("file", "slurp_id", "scenario", "sentence", "wer", _flat(F.col("entities")).alias("entities"))


def _bio(spark, d):
    e = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("x"))
    tag = lambda x: F.when(x["l_returnflag"] == "N", "O").when(x["l_linenumber"] % 3 == 0, F.concat(F.lit("B-"), x["l_returnflag"])).otherwise(F.concat(F.lit("I-"), x["l_returnflag"]))
    return e.select("key", F.transform("x", lambda x: x["l_partkey"].cast("string")).alias("tokens"), F.transform("x", tag).alias("tags"), F.transform("x", lambda x: F.when(x["l_returnflag"] == "N", "O").otherwise(x["l_returnflag"])).alias("labels"))


def _flat(c):
    return F.array_join(F.transform(c, lambda e: F.concat_ws("=", e["type"], e["filler"])), ";")


def n3(spark, d):
    return _bio(spark, d).select("key", _flat(N.bio_spans("tokens", "tags")).alias("spans"))


def n4(spark, d):
    return _bio(spark, d).select("key", _flat(N.label_runs("tokens", "labels")).alias("spans"))


def n5(spark, d):
    p = V.pairs(spark, d)
    none = F.lit(None).cast("string")
    ent = F.lit(None).cast(f"array<{N.ENTITY}>")
    rec = p.select("key", F.when(F.col("n") % 2 == 0, F.struct(F.col("gold_scenario").alias("scenario"), none.alias("action"), F.replace("gold_intent", F.lit("_"), F.lit(":")).alias("intent"), ent.alias("entities"))).alias("final"), F.lit(" ").alias("scenario"), F.when(F.col("n") % 3 == 0, F.lit("own")).alias("action"), F.when(F.col("n") % 5 == 0, F.lit("solo")).otherwise(F.col("pred_intent")).alias("intent"), ent.alias("entities"))
    return N.label_from_record(rec).select("key", "label.scenario", "label.action", F.size("label.entities").alias("entities"))


def n6(spark, d):
    p = V.pairs(spark, d).withColumn("s", F.when(F.col("n") % 2 == 0, F.col("gold_scenario")).otherwise(F.lit("")))
    a, b = N.split_massive_intent("s", F.when(F.col("n") % 3 == 0, F.col("gold_action")).otherwise(F.col("gold_intent")))
    return p.select("key", a.alias("scenario"), b.alias("action"))


def n7(spark, d):
    b = _bio(spark, d).select(F.concat(F.lit("x7-"), "key").alias("id"), F.lit("u").alias("utt"), F.lit("").alias("scenario_str"), F.concat(F.lit("s:a"), (F.col("key") % 3).cast("string")).alias("intent_str"), "tokens", F.col("tags").alias("labels"), F.when(F.col("key") % 2 == 0, F.concat(F.lit("p/q/"), "key")).alias("path"))
    return N.to_utterances(b, "fr-FR", True).select("slurp_id", "scenario", "action", "intent", F.size("tokens").alias("tokens"), _flat(F.col("entities")).alias("entities"), F.get("recordings", F.lit(0))["file"].alias("file"))


def _damaged(spark, d):
    """Texts, those of even identifiers damaged from end to end."""
    docs = V.table(spark, d, "documents").select("doc_id", "lang", "text")
    return docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text")))


def n8(spark, d):
    return N.fix_mojibake(_damaged(spark, d), "text").select("doc_id", F.sha2("text", 256).alias("digest"))


def n8_locale(spark, d):
    """Kana, kanji and Latin damaged once or twice, under three locales: in French the kanji look worse than their damaged form."""
    i, kind = F.col("event_id"), F.col("event_type")
    broken = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    text = F.when(i % 4 == 0, F.concat(F.lit("\u304b\u306a "), kind)).when(i % 4 == 1, F.concat(F.lit("\u00e9t\u00e9 "), kind)).when(i % 4 == 2, F.concat(kind, F.lit(" plain"))).otherwise(F.lit("\u6f22\u5b57"))
    rows = V.table(spark, d, "events").select("event_id", F.when(i % 3 == 0, "ja-JP").when(i % 3 == 1, "fr-FR").alias("locale"), F.when(i % 5 == 0, broken(broken(text))).otherwise(broken(text)).alias("text"))
    return N.fix_mojibake(rows, "text", "locale").select("event_id", "text")


def n9(spark, d):
    text = F.format_string("\"massive-%s-%s\"", F.when(F.col("c_custkey") % 2 == 0, "fr-FR").otherwise("de-DE"), "c_custkey")
    return V.table(spark, d, "customer").select("c_custkey", N.normalize_massive_id(text, "fr-FR").alias("id"))


def n10(spark, d):
    e = V.entities(spark, d).withColumn("gold_entities", F.transform("gold_entities", lambda e: F.struct(F.concat(F.lit(" "), e["type"]).alias("type"), F.concat(F.upper(e["filler"]), F.lit("  \t B ")).alias("filler"))))
    return e.select("key", _flat(N.normalize_entities("gold_entities")).alias("entities"))


def n11(spark, d):
    t = F.format_string("C: Intent candidates: [%s:%s] !", F.upper("event_type"), F.col("user_id"))
    return V.table(spark, d, "events").select("event_id", N.normalize_intent(F.concat_ws(":", "event_type", "user_id"), "weak").alias("weak"), N.normalize_intent(F.format_string("[%s:%s] !", F.upper("event_type"), F.col("user_id")), "strong").alias("strong"), N.normalize_intent(t, "clean").alias("clean"))


def n12(spark, d):
    i = F.col("event_id")
    e = V.table(spark, d, "events").select("event_id", F.when(i % 2 == 0, i.cast("string")).otherwise(F.lit(" ")).alias("slurp_id"), F.when(i % 3 == 0, F.concat(F.lit("x"), "user_id")).alias("id"), F.when(i % 5 == 0, F.format_string('see {"filename": "a/b-%s"}', i)).alias("rationale"))
    return N.sample_file(N.sample_id(e, pos="event_id")).select("event_id", "sample_id", "sample_file")


def n13(spark, d):
    return N.conversation_pair(V.table(spark, d, "conversations"))


def n13_bullets(spark, d):
    text = F.format_string("take\n- %s now\n 2) %s\n* one %s two\n", "event_type", "event_type", "user_id")
    return V.table(spark, d, "events").select("event_id", F.array_join(N.bullet_candidates(text), "|").alias("found"))


def n14(spark, d):
    js = F.format_string('[{"type": "Time", "filter": "%s"}, {"Place": " P%s "}, 3, "x"]', F.upper("event_type"), "user_id")
    return V.table(spark, d, "events").select("event_id", _flat(N.standard_entities(js)).alias("entities"))


def n15(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type", F.lit("b"))).alias("asr_hypotheses"), F.lit("gold text").alias("sentence"))
    return N.select_input_text(e).select("event_id", "input_text", "source")


def _label(c):
    return [c["scenario"].alias("scenario"), c["action"].alias("action"), _flat(c["entities"]).alias("entities")]


def p1(spark, d):
    return rendered(spark, d).select("key", *_label(P.extract_json("text")))


def p2(spark, d):
    return rendered(spark, d).select("key", *_label(P.parse_j("text")))


def p3(spark, d):
    return rendered(spark, d).withColumn("l", P.parse_prediction_label("text")).select("key", *_label(F.col("l")))


def p4(spark, d):
    text = F.when(F.col("n") % 3 == 0, F.format_string('so final: {"scenario": "%s", "action": "%s"} end', "gold_scenario", "gold_action")).when(F.col("n") % 3 == 1, F.format_string('{"scenario": "%s", "action": ""} then {"action": "%s"}', "gold_scenario", "gold_action")).otherwise(F.format_string("scenario: %s, action = %s", "gold_scenario", "gold_action"))
    return rendered(spark, d).withColumn("f", P.extract_final(text)).select("key", "f.label.scenario", "f.label.action", "f.method")


def p5(spark, d):
    rows = rendered(spark, d).select("key", F.when(F.col("n") % 2 == 0, F.col("gold_scenario")).alias("scenario"), F.when(F.col("n") % 4 == 0, F.col("gold_action")).alias("action"), F.lit(None).cast(f"array<{N.ENTITY}>").alias("entities"), "text")
    return P.recovery_stats(P.recover_predictions(rows, ["text"]))


def p6(spark, d):
    return rendered(spark, d).withColumn("x", P.extract_crj("text")).select("key", "x.c", "x.r", F.length("x.j").alias("j_length"), "x.valid")


def p6_apart(spark, d):
    """C, R and J lines with others between them, in two runs, and in wrong order."""
    n = F.col("n")
    second = F.when(n % 3 == 0, "C: second\nso\nR: \nR: later\nJ: j2").when(n % 3 == 1, "C: open\nR: only").otherwise("C： wide\nR: r3\nJ: j3")
    text = F.when(n % 5 == 0, "R: a\nC: b\nJ: c").otherwise(F.concat(F.format_string("C: first %s\nnote\n\nR: r1\nmore\n J: j1\n", "key"), second))
    return V.pairs(spark, d).withColumn("x", P.extract_crj(text)).select("key", "x.*")


def p7(spark, d):
    return rendered(spark, d).select("key", P.prefixed_line("text", "C").alias("c"), P.prefixed_line("text", "R").alias("r"))


def p8(spark, d):
    c = P.prefixed_line("text", "C")
    return rendered(spark, d).select("key", F.array_join(P.intent_candidates(c), "|").alias("intents"), F.array_join(P.slot_candidates(c), "|").alias("slots"))


def p9(spark, d):
    return P.c_block_candidates(rendered(spark, d).withColumn("other", F.lit("C: x")), ["other", "text"]).select("key", F.array_join("candidates", "|").alias("found"))


def p10(spark, d):
    return rendered(spark, d).select("key", F.array_join(F.transform(P.rationale_pairs(P.prefixed_line("text", "R")), lambda x: F.concat_ws("=", x["label"], x["reason"])), "|").alias("pairs"))


def p11(spark, d):
    c = P.prefixed_line("text", "C")
    return rendered(spark, d).select("key", P.sanitize_c_line(F.concat(F.lit("C: "), c)).alias("line"), F.array_join(P.reorder_candidates(P.intent_candidates(c), ["view_a1", "click_a0", "error_a3", "purchase_a2", "signup_a4"]), "|").alias("ordered"))


def p12(spark, d):
    return rendered(spark, d).select("key", F.length(P.extract_answer_json("text")).alias("size"))


def p13(spark, d):
    return P.format_output(rendered(spark, d), "text").select("key", "format_ok", F.substring_index("formatted", "\n", 2).alias("head"))


def p14(spark, d):
    line = F.format_string("step x loss=%s acc=0.%s loss=%s lr=1e-5", "user_id", "user_id", "event_id")
    return V.table(spark, d, "events").withColumn("m", P.parse_metrics(line)).select("event_id", F.col("m")["loss"].alias("loss"), F.col("m")["acc"].alias("acc"), F.size("m").alias("n"))


def p15(spark, d):
    c = V.candidates(spark, d).select("key", F.col("candidates").alias("topk"), F.array("gold_intent", "pred_intent", F.lit("other_a0")).alias("allowed"), F.col("gold_intent").alias("reference"))
    return P.validate_topk(c, 2).select("key", "reason", "valid")


def p16(spark, d):
    c = V.candidates(spark, d).select("key", F.when(F.col("n") % 3 == 0, F.replace("gold_intent", F.lit("_"), F.lit(":"))).alias("final_intent"), F.col("candidates").alias("topk"))
    return P.complete_final(c).select("key", "intent", "scenario", "action")


def p16_later(spark, d):
    """Labels whose first candidates have no intent, or that have no candidates."""
    n = F.col("n")
    topk = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 1, F.array(F.lit(None).cast("string"), F.lit(""), F.col("gold_intent"))).otherwise(F.array(F.lit(""), F.concat_ws(":", "pred_scenario", "pred_action"), F.lit("z_z")))
    return P.complete_final(V.pairs(spark, d).select("key", F.when(n % 3 == 0, " ").alias("final_intent"), topk.alias("topk")), "alarm:set").select("key", "intent", "scenario", "action")


def p17(spark, d):
    return V.table(spark, d, "events").select("event_id", P.scrub_phones(F.format_string("say  AH0 K %s IY1 CH NOTAH x", "event_type")).alias("text"))


def _spoken(spark, d):
    t = V.table(spark, d, "events")
    return t.select("event_id", F.concat_ws(" ", "event_type", F.lit("the User"), "user_id").alias("ref"), F.concat_ws(" ", F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.lit("the user"), (F.col("user_id") % 7).cast("string")).alias("hyp"))


def m8(spark, d):
    return V.rounded(_spoken(spark, d).select("event_id", D.wer("ref", "hyp").alias("wer"), D.char_distance("ref", "hyp").alias("char_distance")))


def m9(spark, d):
    return V.rounded(_spoken(spark, d).select("event_id", D.per(F.concat(F.lit("/"), F.substring("ref", 1, 4), F.lit("/")), F.substring("hyp", 1, 4)).alias("per")))


def m9_phones(spark, d):
    """Phones of several characters between slashes, brackets and spaces."""
    e, i, u = V.table(spark, d, "events"), F.col("event_id"), F.col("user_id")
    ref = F.concat(F.lit("/tʃ a/["), F.when(i % 3 == 0, "dʒ").when(i % 3 == 1, "o").otherwise(""), F.lit("]"))
    hyp = F.when(i % 10 == 9, "").otherwise(F.concat(F.when(i % 2 == 0, "tʃ/a/").otherwise("a"), F.when(u % 2 == 0, "  dʒ ").otherwise("")))
    return V.rounded(e.select("event_id", D.per(ref, hyp).alias("per")))


def m10(spark, d):
    rows = _spoken(spark, d).select("event_id", F.col("ref").alias("reference_text"), F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("array<string>")).otherwise(F.array("hyp", F.lower("ref"))).alias("asr_nbest"))
    return V.rounded(D.nbest_summary(D.nbest_report(rows)))


def m4(spark, d):
    return V.rounded(D.span_distance_f1(V.entities(spark, d), "word"))


def m5(spark, d):
    return V.rounded(D.slu_f1(V.entities(spark, d)))


def d19_far(spark, d):
    """Two of up to five texts: the first, and the farthest from it, the first of equals."""
    i = F.col("event_id")
    t = V.table(spark, d, "events").select("event_id", F.array("event_type", F.concat(F.lit(" "), F.upper("event_type")), F.when(i % 3 == 0, F.concat_ws(" ", "event_type", "user_id")), F.when(i % 2 == 0, F.lit("Four  ")).otherwise(F.lit("")), F.lit("some"), F.lit("other")).alias("n"))
    return t.select("event_id", F.array_join(SP.diverse_nbest("n", 2), "|").alias("chosen"))


def d19(spark, d):
    t = V.table(spark, d, "events").select("event_id", F.array("event_type", F.upper("event_type"), F.concat_ws(" ", "event_type", "user_id"), F.lit("something else")).alias("n"))
    return t.select("event_id", F.array_join(SP.diverse_nbest("n", 3), "|").alias("chosen"))


QUERIES = {
    "n1_span_filler": n1, "n2_gold_by_file": n2, "n3_bio_spans": n3, "n4_label_runs": n4, "n5_label_from_record": n5, "n6_split_massive_intent": n6, "n7_to_utterances": n7, "n8_fix_mojibake": n8, "n8_fix_mojibake_locale": n8_locale, "n9_normalize_massive_id": n9, "n10_normalize_entity": n10, "n11_normalize_intent": n11,
    "n12_sample_id": n12, "n13_conversation_pair": n13, "n13_bullet_candidates": n13_bullets, "n14_standard_entities": n14, "n15_select_input_text": n15, "p1_extract_json": p1, "p2_parse_j": p2, "p3_parse_prediction_label": p3, "p4_extract_final": p4, "p5_recover_predictions": p5,
    "p6_extract_crj": p6, "p6_extract_crj_apart": p6_apart, "p16_complete_final_later": p16_later, "m9_per_phones": m9_phones, "p7_prefixed_line": p7, "p8_candidates": p8, "p9_c_block_candidates": p9, "p10_rationale_pairs": p10, "p11_sanitize_c_line": p11, "p12_extract_answer_json": p12, "p13_format_output": p13, "p14_parse_metrics": p14, "p15_validate_topk": p15, "p16_complete_final": p16, "p17_scrub_phones": p17,
    "m4_span_distance_f1": m4, "m5_slu_f1": m5, "m8_wer": m8, "m9_per": m9, "m10_nbest_report": m10, "d19_diverse_nbest": d19, "d19_diverse_nbest_far": d19_far,
}

_TOK = r"t AS (SELECT *, doc_id * 31 % len(w) + 1 AS lo, doc_id * 7 % len(w) + 1 AS other FROM (SELECT doc_id, lang, text, string_split_regex(trim(text), '[\x20\x09-\x0D]+') AS w FROM documents))"
_ENT = "'time=n' || n || ';place=p' || (n % 3)"
_C = "'Intent candidates: ' || gold_intent || ' | ' || pred_intent || ' | none; Slot candidates: time(a|b) | place' || (n % 2)"
_R = "CASE WHEN n % 7 = 0 THEN '' ELSE pred_intent || '!not said; other:a0!too far!off' END"
_I = "CASE WHEN gold_intent = pred_intent THEN gold_intent ELSE gold_intent || '|' || pred_intent END"
_RUNS = """x AS (SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS i, CAST(l_partkey AS VARCHAR) AS tok, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS k, l_linenumber % 3 = 0 AS b FROM lineitem),
y AS (SELECT *, CASE WHEN k IS NOT NULL AND (lag(k) OVER w IS DISTINCT FROM k {open}) THEN 1 ELSE 0 END AS s FROM x WINDOW w AS (PARTITION BY key ORDER BY i)), z AS (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY i) AS g FROM y),
r AS (SELECT key, g, k, string_agg(tok, ' ' ORDER BY i) AS f FROM z WHERE k IS NOT NULL GROUP BY key, g, k), o AS (SELECT key, string_agg(k || '=' || f, ';' ORDER BY g) AS spans FROM r GROUP BY key) SELECT key, coalesce(spans, '') AS spans FROM (SELECT DISTINCT key FROM x) LEFT JOIN o USING (key)"""
SQL = {
    "n1_span_filler": f"WITH {_TOK} SELECT doc_id AS slurp_id, lower(w[lo] || ' ' || w[len(w)]) AS indexed, w[lo] || ' ' || w[len(w)] AS cased, array_to_string(list_slice(w, lo, len(w)), ' ') AS range FROM t",
    "n2_gold_by_file": f"WITH {_TOK}, u AS (SELECT 'f' || (doc_id % 600) AS file, (doc_id % 10) / 10.0 AS wer, 0 AS rp, t.* FROM t UNION ALL SELECT 'g' || doc_id, 0.5, 1, t.* FROM t) SELECT file, doc_id AS slurp_id, lang AS scenario, text AS sentence, CAST(wer AS DOUBLE) AS wer, 'time=' || w[lo] || ' ' || w[len(w)] || ';place=' || w[other] AS entities FROM u QUALIFY row_number() OVER (PARTITION BY file ORDER BY doc_id DESC, rp DESC) = 1",
    "n3_bio_spans": "WITH " + _RUNS.format(open="OR b"),
    "n4_label_runs": "WITH " + _RUNS.format(open=""),
    "n5_label_from_record": f"WITH {V.PAIRS} SELECT key, CASE WHEN n % 2 = 0 THEN gold_scenario WHEN n % 5 = 0 THEN '' ELSE pred_scenario END AS scenario, CASE WHEN n % 2 = 0 THEN gold_action WHEN n % 3 = 0 THEN 'own' WHEN n % 5 = 0 THEN 'solo' ELSE pred_action END AS action, 0 AS entities FROM pairs",
    "n6_split_massive_intent": f"WITH {V.PAIRS} SELECT key, CASE WHEN n % 2 = 0 THEN gold_scenario WHEN n % 3 = 0 THEN '' ELSE gold_scenario END AS scenario, gold_action AS action FROM pairs",
    "n7_to_utterances": "WITH " + _RUNS.format(open="OR b").replace("SELECT key, coalesce(spans, '') AS spans FROM (SELECT DISTINCT key FROM x) LEFT JOIN o USING (key)", "SELECT q.key AS slurp_id, 's' AS scenario, 'a' || (q.key % 3) AS action, 's_a' || (q.key % 3) AS intent, q.n AS tokens, coalesce(spans, '') AS entities, CASE WHEN q.key % 2 = 0 THEN CAST(q.key AS VARCHAR) END AS file FROM (SELECT key, CAST(count(*) AS INT) AS n FROM x GROUP BY key) q LEFT JOIN o ON o.key = q.key"),
    "n8_fix_mojibake": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "n8_fix_mojibake_locale": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'かな ' || event_type WHEN 1 THEN 'été ' || event_type WHEN 2 THEN event_type || ' plain' ELSE CASE WHEN event_id % 3 = 1 THEN 'æ¼¢å' || chr(173) || chr(151) ELSE '漢字' END END AS text FROM events",
    "n9_normalize_massive_id": "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id FROM customer",
    "n10_normalize_entity": f"WITH {V.ENTITIES}, a AS (SELECT key, string_agg(lower(gt) || '=' || lower(filler) || ' b', ';' ORDER BY pos, l_partkey, gt, filler) AS entities FROM l WHERE pos <= 4 GROUP BY key) SELECT key, coalesce(entities, '') AS entities FROM (SELECT DISTINCT key FROM l) LEFT JOIN a USING (key)",
    "n11_normalize_intent": "SELECT event_id, event_type || '_' || user_id AS weak, event_type || '_' || user_id AS strong, event_type || '_' || user_id AS clean FROM events",
    "n12_sample_id": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'x' || user_id WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE 'row_' || event_id END AS sample_id, CASE WHEN event_id % 5 = 0 THEN 'a/b-' || event_id ELSE '' END AS sample_file FROM events",
    "n13_conversation_pair": "SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS user_text, arg_min(text, turn) FILTER (role = 'assistant') AS assistant_text FROM conversations GROUP BY conv_id",
    "n13_bullet_candidates": "SELECT event_id, event_type || ' now|one ' || user_id || ' two' AS found FROM events",
    "n14_standard_entities": "SELECT event_id, 'time=' || event_type || ';place=p' || user_id AS entities FROM events",
    "n15_select_input_text": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS input_text, 'asr_1best' AS source FROM events",
    "p1_extract_json": f"WITH {V.PAIRS} SELECT key, pred_scenario AS scenario, pred_action AS action, CASE WHEN n % 13 = 0 THEN '' ELSE {_ENT} END AS entities FROM pairs",
    "p2_parse_j": f"WITH {V.PAIRS} SELECT key, CASE WHEN n % 13 <> 0 THEN pred_scenario END AS scenario, CASE WHEN n % 13 <> 0 THEN pred_action END AS action, CASE WHEN n % 13 = 0 THEN NULL ELSE {_ENT} END AS entities FROM pairs",
    "p3_parse_prediction_label": f"WITH {V.PAIRS} SELECT key, CASE WHEN n % 13 <> 0 THEN pred_scenario ELSE '' END AS scenario, CASE WHEN n % 13 <> 0 THEN pred_action ELSE '' END AS action, CASE WHEN n % 13 = 0 THEN '' ELSE 'Time= N' || n || ' ;=' END AS entities FROM pairs",
    "p4_extract_final": f"WITH {V.PAIRS} SELECT key, CASE WHEN gold_scenario = 'error' AND n % 3 <> 0 THEN '' ELSE gold_scenario END AS scenario, gold_action AS action, CASE n % 3 WHEN 0 THEN 'final_keyword_object' WHEN 1 THEN 'embedded_object' ELSE 'not_found' END AS method FROM pairs",
    "p5_recover_predictions": f"WITH {V.PAIRS}, i AS (SELECT *, n % 13 <> 0 AS parsed, n % 2 = 0 AS scenario, n % 4 = 0 AS action FROM pairs) SELECT count(*) AS rows, count_if(parsed) AS changed, count_if(parsed AND NOT scenario) AS recovered, count_if(CASE WHEN parsed THEN pred_scenario IN ('error', 'unknown') ELSE NOT action OR gold_scenario = 'error' END) AS unresolved FROM i",
    "p6_extract_crj": f"""WITH {V.PAIRS}, s AS (SELECT *, length('{{"scenario": "", "action": "", "entities": [{{"type": "Time", "filler": " N "}}, {{"place": "P"}}]}}') + length(pred_scenario) + length(pred_action) + length(CAST(n AS VARCHAR)) + 1 AS size FROM pairs) SELECT key, CASE WHEN n % 7 = 0 THEN '' ELSE {_C} END AS c, {_R} AS r, CAST(CASE WHEN n % 7 = 0 THEN 0 WHEN n % 13 = 0 THEN size - 3 WHEN n % 11 = 0 THEN 7 ELSE size END AS INT) AS j_length, n % 7 <> 0 AS valid FROM s""",
    "p7_prefixed_line": f"WITH {V.PAIRS} SELECT key, {_C} AS c, {_R} AS r FROM pairs",
    "p8_candidates": f"WITH {V.PAIRS} SELECT key, {_I} AS intents, 'time|place' || (n % 2) AS slots FROM pairs",
    "p9_c_block_candidates": f"WITH {V.PAIRS} SELECT key, {_I} AS found FROM pairs",
    "p10_rationale_pairs": f"WITH {V.PAIRS} SELECT key, CASE WHEN n % 7 = 0 THEN '' ELSE pred_intent || '=not said|other:a0=too far!off' END AS pairs FROM pairs",
    "p11_sanitize_c_line": f"WITH {V.PAIRS}, v(x, r) AS (VALUES ('view_a1', 0), ('click_a0', 1), ('error_a3', 2), ('purchase_a2', 3), ('signup_a4', 4)) SELECT key, 'C: Intent candidates: ' || replace({_I}, '|', ' | ') || ' | none; Slot candidates: time(a|b) | place' || (n % 2) AS line, CASE WHEN gold_intent = pred_intent THEN gold_intent WHEN coalesce(b.r, 6) < coalesce(a.r, 5) THEN pred_intent || '|' || gold_intent ELSE gold_intent || '|' || pred_intent END AS ordered FROM pairs LEFT JOIN v a ON a.x = gold_intent LEFT JOIN v b ON b.x = pred_intent",
    "p13_format_output": f"WITH {V.PAIRS} SELECT key, n % 13 <> 0 AND n % 7 <> 0 AS format_ok, 'C: ' || {_C} || chr(10) || 'R: ' || {_R} AS head FROM pairs",
    "p14_parse_metrics": "SELECT event_id, CAST(event_id AS DOUBLE) AS loss, CAST('0.' || user_id AS DOUBLE) AS acc, 3 AS n FROM events",
    "p15_validate_topk": f"WITH {V.CANDIDATES}, r AS (SELECT key, CASE WHEN len(candidates) <> 2 THEN 'count' WHEN len(list_filter(candidates, lambda x: x NOT IN (gold_intent, pred_intent, 'other_a0'))) > 0 THEN 'outside' WHEN NOT list_contains(candidates, gold_intent) THEN 'missing_reference' ELSE 'ok' END AS reason FROM c) SELECT key, reason, reason = 'ok' AS valid FROM r",
    "p6_extract_crj_apart": f"WITH {V.PAIRS} SELECT key, CASE WHEN n % 5 = 0 THEN '' WHEN n % 3 = 0 THEN 'second' ELSE 'first ' || key END AS c, CASE WHEN n % 5 = 0 OR n % 3 = 0 THEN '' ELSE 'r1' END AS r, CASE WHEN n % 5 = 0 THEN '' WHEN n % 3 = 0 THEN 'j2' ELSE 'j1' END AS j, n % 5 <> 0 AS valid FROM pairs",
    "p12_extract_answer_json": f"""WITH {V.PAIRS}, s AS (SELECT *, length('{{"scenario": "", "action": "", "entities": [{{"type": "Time", "filler": " N "}}, {{"place": "P"}}]}}') + length(pred_scenario) + length(pred_action) + length(CAST(n AS VARCHAR)) + 1 AS size FROM pairs) SELECT key, CAST(CASE WHEN n % 13 = 0 THEN size - length(', {{"place": "P0"}}]}}') ELSE size END AS INT) AS size FROM s""",
    "p16_complete_final_later": f"WITH {V.PAIRS}, r AS (SELECT key, CASE WHEN n % 4 = 0 THEN 'alarm_set' WHEN n % 4 = 1 THEN gold_intent ELSE pred_intent END AS intent FROM pairs) SELECT key, intent, split_part(intent, '_', 1) AS scenario, split_part(intent, '_', 2) AS action FROM r",
    "m9_per_phones": r"""WITH t AS (SELECT event_id, '/tʃ a/[' || CASE event_id % 3 WHEN 0 THEN 'dʒ' WHEN 1 THEN 'o' ELSE '' END || ']' AS r, CASE WHEN event_id % 10 = 9 THEN '' ELSE CASE WHEN event_id % 2 = 0 THEN 'tʃ/a/' ELSE 'a' END || CASE WHEN user_id % 2 = 0 THEN '  dʒ ' ELSE '' END END AS h FROM events),
    p AS (SELECT event_id, regexp_replace(replace(replace(r, 'tʃ', 'T'), 'dʒ', 'D'), '[\s/\[\]]+', '', 'g') AS r, regexp_replace(replace(replace(h, 'tʃ', 'T'), 'dʒ', 'D'), '[\s/\[\]]+', '', 'g') AS h FROM t) SELECT event_id, round(levenshtein(r, h) / length(r), 6) AS per FROM p""",
    "p16_complete_final": f"WITH {V.CANDIDATES}, r AS (SELECT key, CASE WHEN n % 3 = 0 THEN gold_intent ELSE coalesce(CASE WHEN n % 4 <> 0 THEN gold_intent END, CASE WHEN n % 3 <> 0 THEN pred_intent END, CASE WHEN n % 2 = 0 THEN 'other_a0' END, CASE WHEN n % 7 = 0 THEN 'other_a1' END, 'unknown') END AS intent FROM c) SELECT key, intent, CASE WHEN contains(intent, '_') THEN split_part(intent, '_', 1) ELSE '' END AS scenario, CASE WHEN contains(intent, '_') THEN split_part(intent, '_', 2) ELSE intent END AS action FROM r",
    "p17_scrub_phones": "SELECT event_id, 'say AH0 ' || event_type || ' IY1 NOTAH x' AS text FROM events",
    "m9_per": "SELECT event_id, round(levenshtein(r, h) / length(r), 6) AS per FROM (SELECT event_id, substring(event_type, 1, 4) AS r, CASE WHEN event_id % 2 = 0 THEN substring(event_type, 1, 4) ELSE 'the' END AS h FROM events)",
    "m8_wer": "SELECT event_id, round((CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END + CASE WHEN user_id < 7 THEN 0 ELSE 1 END) / 4, 6) AS wer, round(levenshtein(r, h) / greatest(length(r), length(h)), 6) AS char_distance FROM (SELECT event_id, user_id, lower(event_type || ' the user ' || user_id) AS r, CASE WHEN event_id % 2 = 0 THEN event_type || ' ' ELSE '' END || 'the user ' || (user_id % 7) AS h FROM events)",
    "m10_nbest_report": "WITH w AS (SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END + CASE WHEN user_id < 7 THEN 0 ELSE 1 END) / 4 AS w FROM events WHERE event_id % 10 <> 0) SELECT (SELECT count(*) FROM events) AS n, count(*) AS scored, round(avg(w), 6) AS top1_wer, 0.0::DOUBLE AS oracle_wer, round(avg(w), 6) AS gap FROM w",
    "m4_span_distance_f1": f"WITH RECURSIVE {V.ENTITIES}, {V.GREEDY}, a AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM gc WHERE kind = 'word' GROUP BY GROUPING SETS ((label), ())) SELECT coalesce(label, 'overall') AS label, round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn, {V.PRF6} FROM a",
    "m5_slu_f1": f"WITH RECURSIVE {V.ENTITIES}, {V.GREEDY}, a AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM gc GROUP BY GROUPING SETS ((label), ())) SELECT coalesce(label, 'overall') AS label, round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn, {V.PRF6} FROM a",
    "d19_diverse_nbest": "SELECT event_id, event_type || '|' || event_type || ' ' || user_id || '|something else' AS chosen FROM events",
    "d19_diverse_nbest_far": """WITH t AS (SELECT event_id, event_type AS first, list_filter([CASE WHEN event_id % 3 = 0 THEN event_type || ' ' || user_id END, CASE WHEN event_id % 2 = 0 THEN 'Four  ' ELSE '' END, 'some', 'other'], lambda x: x IS NOT NULL) AS r FROM events),
    d AS (SELECT event_id, first, unnest(r) AS x, generate_subscripts(r, 1) AS i FROM t) SELECT event_id, first || '|' || arg_max(x, levenshtein(lower(trim(x)), first) * 10 - i) AS chosen FROM d GROUP BY event_id, first""",
}
