"""Queries of sources, joins, corpus building, vocabularies and geometry."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalise import ENTITY
from ..operators import corpus as D
from ..operators import geometry as G
from ..operators import matching as J
from ..operators import vocabulary as B
from ..sources import files as S
from . import views as V


def _folder(spark, label):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _lines(spark, d):
    e = V.table(spark, d, "events")
    js = F.format_string('{"id": %s, "kind": "%s", "tags": ["%s"]}', "event_id", "event_type", "user_id")
    i = F.col("event_id") % 10
    return e.select(F.when(i == 3, F.lit("  ")).when(i == 4, F.substring(js, 1, 15)).when(i == 5, F.concat(F.lit("["), js, F.lit("]"))).otherwise(js).alias("value"))


SCHEMA = "id long, kind string, tags array<string>"


def s1(spark, d):
    path = _folder(spark, "lines")
    _lines(spark, d).write.text(path)
    return S.read_jsonl(spark, path, SCHEMA).select("id", "kind", F.array_join("tags", ",").alias("tags"))


#: Records of a file of the four forms.
FILE_RECORDS = 5000


def _read_again(spark, d):
    """Events as arrays, wrapped arrays, objects one after another and maps of records, a form for each remainder of the identifier, read again."""
    path = _folder(spark, "records")
    i = F.col("event_id")
    record = F.format_string('{"id": %s, "kind": "%s"}', "event_id", "event_type")
    named = F.when(i % 4 == 3, F.concat(F.format_string('"r%s": ', "event_id"), record)).otherwise(record)
    groups = V.table(spark, d, "events").groupBy((i % 4).alias("form"), F.floor(i / (4 * FILE_RECORDS)).alias("g")).agg(F.collect_list(named).alias("x"))
    listed = F.array_join("x", ",")
    text = F.when(F.col("form") == 0, F.concat(F.lit("["), listed, F.lit("]"))).when(F.col("form") == 1, F.concat(F.lit('{"data": ['), listed, F.lit("]}"))).when(F.col("form") == 2, F.concat(F.lit("junk "), F.array_join("x", "\n"))).otherwise(F.concat(F.lit("{"), listed, F.lit("}")))
    groups.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return S.read_records(spark, path, "id long, kind string")


def s2(spark, d):
    return _read_again(spark, d).groupBy("kind").agg(F.count("id").alias("n"))


def s2_every(spark, d):
    return _read_again(spark, d)


def s5(spark, d):
    """Rows with nested cells as CSV, read as plain text: the header and JSON in the cells."""
    e = V.table(spark, d, "events")
    path = _folder(spark, "cells")
    S.write_csv_json(e.select("event_id", F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("t")).alias("who"), F.array("event_type", F.lit("b")).alias("tags"), F.when(F.col("event_id") % 2 == 0, 'say "x", y').alias("note")), path)
    rows = spark.read.schema("event_id long, who string, tags string, note string").option("header", True).option("enforceSchema", False).option("quote", '"').option("escape", '"').csv(path)
    return rows.select("event_id", "who", "tags", "note")


def s3(spark, d):
    path = _folder(spark, "jsonl")
    S.write_jsonl(V.pairs(spark, d).select("key", "gold_intent", "wer"), path)
    return S.read_jsonl(spark, path, "key long, gold_intent string, wer double")


def s4(spark, d):
    path = _folder(spark, "csv")
    rows = V.entities(spark, d).select("key", "gold_entities", F.when(F.size("gold_entities") > 2, F.lit('say "x", y\nz')).otherwise(F.lit("plain")).alias("note"))
    S.write_csv_json(rows, path)
    return S.read_csv_json(spark, path, ["key", "gold_entities", "note"], {"gold_entities": f"array<{ENTITY}>"}).select(F.col("key").cast("long").alias("key"), F.size("gold_entities").alias("n"), F.length("note").alias("note"))


def s6(spark, d):
    path = _folder(spark, "corpus")
    V.table(spark, d, "customer").select("c_custkey", "c_name").write.parquet(f"{path}/fr-FR/train-0.parquet")
    V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name")).write.parquet(f"{path}/fr-FR/train-1.parquet")
    return S.read_corpus(spark, path, "fr-FR", "train")


def s7(spark, d):
    e = V.table(spark, d, "events").select((F.col("event_id") % 3000).alias("key"), (F.col("user_id") % 4).alias("shard"), F.col("event_id").alias("pos"), "value")
    return J.merge_shards(e, ["key"])


def s8(spark, d):
    p = V.pairs(spark, d)
    return J.pending(p.select("key", "gold_intent"), p.where("n % 3 = 0").select("key"), "key")


def _resolved(spark, d):
    p = V.table(spark, d, "part").select("p_partkey")
    k = F.col("p_partkey")
    manifest = p.select(F.when(k % 4 == 0, F.format_string("f%s.flac", k)).when(k % 4 == 1, F.format_string("slurp_real/f%s.flac", k)).when(k % 4 == 2, F.format_string("other/x/f%s.flac", k)).otherwise(F.format_string("gone-%s", k)).alias("path"))
    return J.resolve_files(p.select("p_partkey", F.format_string("some/where/f%s.flac", k).alias("file")), manifest)


def s9(spark, d):
    return _resolved(spark, d).select("p_partkey", "resolved")


def s9_missing(spark, d):
    return J.missing_files(_resolved(spark, d))


def _gold(spark, d):
    return V.matched(spark, d).select("key", F.col("gold_scenario").alias("scenario"), F.col("gold_action").alias("action"), F.col("gold_entities").alias("entities"))


def _pred(spark, d):
    m = V.matched(spark, d)
    return m.select((F.col("key") % 6000).alias("key"), F.col("key").alias("pos"), F.when(F.col("n") % 5 == 0, F.lit(" ")).otherwise(F.col("pred_scenario")).alias("scenario"), F.col("pred_action").alias("action"), F.col("pred_entities").alias("entities"))


def j1(spark, d):
    return J.match_gold(_gold(spark, d), _pred(spark, d), "key").select("key", "gold_scenario", "pred_scenario", "pred_action", F.size("pred_entities").alias("n"))


def j1_missing(spark, d):
    return J.not_predicted(_gold(spark, d), _pred(spark, d), "key")


def j2(spark, d):
    e = V.table(spark, d, "events")
    pred = e.select(F.col("event_id").alias("pos"), F.when(F.col("event_id") % 3 == 0, F.format_string("a/b/%s.flac", "user_id")).alias("file"), F.when(F.col("event_id") % 3 == 1, F.col("user_id").cast("string")).alias("slurp_id"), F.format_string("x/%s", "event_type").alias("id"))
    gold = e.select(F.explode(F.array(F.format_string("%s.flac", "user_id"), F.col("user_id").cast("string"), F.col("event_type"))).alias("key")).distinct().withColumn("size", F.length("key"))
    return J.match_gold_fallback(pred, gold).select("pos", "key", "size")


def _unknown(spark, d):
    """Predictions with an unknown or blank file and a known id, or without a file."""
    e, i = V.table(spark, d, "events"), F.col("event_id")
    pred = e.select(i.alias("pos"), F.when(i % 3 == 0, F.format_string("zz/none-%s", i)).when(i % 3 == 2, "").alias("file"), F.when(i % 3 == 0, F.col("event_type")).otherwise("").alias("slurp_id"), F.format_string("x/%s", "event_type").alias("id"))
    return pred, e.select(F.col("event_type").alias("key")).distinct()


def j2_unknown(spark, d):
    return J.match_gold_fallback(*_unknown(spark, d)).select("pos", "key")


def j2_not_found(spark, d):
    return J.not_found_fallback(*_unknown(spark, d))


def j3(spark, d):
    p = V.pairs(spark, d)
    label = F.struct(F.col("gold_scenario").alias("scenario"), F.col("gold_action").alias("action"), F.array().cast(f"array<{ENTITY}>").alias("entities"))
    target = F.when(F.col("n") % 5 == 0, F.lit("nothing")).otherwise(F.format_string('x {"scenario": "%s", "action": "%s"}', "pred_scenario", "pred_action"))
    return J.match_embedded(p.select("key", F.when(F.col("n") % 2 == 0, label).alias("target_label"), target.alias("target"))).select("key", "gold_scenario", "gold_action")


def j4(spark, d):
    rec = lambda c: F.when(c, F.array(F.struct(F.format_string("f%s", "event_id").alias("file")))).otherwise(F.array().cast("array<struct<file:string>>"))
    e = V.table(spark, d, "events")
    rows = e.select("event_id", F.col("user_id").alias("slurp_id"), rec(F.col("event_id") % 2 == 0).alias("recordings"), F.when(F.col("event_id") % 4 == 1, F.lit("")).otherwise(F.lit("own")).alias("sentence"))
    utts = e.select(F.col("user_id").alias("slurp_id"), F.col("event_id").alias("pos"), rec(F.col("user_id") % 3 != 0).alias("recordings"), F.col("event_type").alias("sentence"))
    return J.enrich_recordings(rows, utts).select("event_id", F.get("recordings", F.lit(0))["file"].alias("file"), "sentence", "enriched")


def j5(spark, d):
    e = V.table(spark, d, "events")
    rows = e.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id").cast("string")).alias("id"), F.when(F.col("event_id") % 2 == 0, F.lit("own.wav")).alias("file"))
    manifest = e.where("user_id % 3 != 0").select(F.col("user_id").cast("string").alias("id"), F.when(F.col("user_id") % 5 == 0, F.lit("")).otherwise(F.format_string("m%s.wav", "event_id")).alias("file"), F.col("event_id").alias("pos"))
    return J.attach_manifest(rows, manifest).select("event_id", "id", "file", "state")


def j6(spark, d):
    p = V.pairs(spark, d)
    return J.join_runs(p.select(F.col("key").alias("id"), "gold_intent"), p.where("n % 2 = 0").select(F.col("key").alias("id"), F.col("pred_intent").alias("student")), p.where("n % 3 = 0").select(F.col("key").alias("id"), F.col("gold_action").alias("baseline")))


def j7(spark, d):
    run = lambda m: V.pairs(spark, d).where(F.col("key") % 3 != m).select((F.col("key") % 2000).alias("id"), F.lit(None).cast("string").alias("file"), F.col("key").alias("pos"), "wer")
    return J.pair_runs(run(0), run(1), "wer")


def j8(spark, d):
    p = V.pairs(spark, d)
    none = F.lit(None).cast("string")
    items = p.select("key", F.when(F.col("n") % 4 != 3, F.col("key")).alias("id"), F.format_string("x/f%s", F.col("key") % 100).alias("file"), F.when(F.col("n") % 4 == 0, F.col("gold_intent")).alias("intent"), none.alias("target_intent"), F.when(F.col("n") % 4 == 1, F.col("pred_intent")).alias("pred_intent"))
    gold = p.where("key % 2 = 0").select(F.col("key").alias("id"), F.format_string("f%s", F.col("key") % 100).alias("file"), F.col("gold_intent").alias("intent"), F.col("key").alias("pos"))
    return J.resolve_intent(items, gold).select("key", "resolved")


def j9(spark, d):
    e = V.table(spark, d, "events")
    rows = e.select("event_id", F.col("user_id").alias("slurp_id"), F.when(F.col("event_id") % 2 == 0, F.lit(" ")).otherwise(F.lit("own")).alias("scenario"), F.when(F.col("event_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("t"))).alias("tokens"), F.when(F.col("event_id") % 5 != 0, F.array(F.lit("h"))).alias("asr_nbest"))
    utts = e.select(F.col("user_id").alias("slurp_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("scenario"), F.array("event_type").alias("tokens"))
    return J.fill_from(rows, utts, ["scenario", "tokens"]).select("event_id", "scenario", F.array_join("tokens", ",").alias("tokens"))


def j10(spark, d):
    e = V.table(spark, d, "events")
    cache = e.where("event_id % 3 != 0").select(F.col("event_id").alias("id"), F.array(F.concat(F.lit(" a  "), "event_type"), F.concat(F.lit("a "), "event_type"), F.lit("b")).alias("hypotheses"))
    return J.attach_nbest(e.select(F.col("event_id").alias("id"), F.lit("gold").alias("transcript")), cache).select("id", "transcript", F.size("nbest").alias("n"))


def _tenth(x):
    """A double to one digit as SQL rounds it: ten times the double, halves away from zero; Spark rounds its shortest decimal text."""
    scaled = F.abs(x * 10)
    whole = F.floor(scaled)
    return F.when(x < 0, -1.0).otherwise(1.0) * F.when(scaled - whole >= 0.5, whole + 1).otherwise(whole) / 10


def _utts(spark, d):
    e = V.table(spark, d, "events").select(F.col("user_id").alias("slurp_id"), "event_id", "value")
    rec = F.struct(F.format_string("f%s", "event_id").alias("file"), F.when(F.col("event_id") % 5 != 0, _tenth(F.col("value") % 1)).alias("wer"), F.when(F.col("event_id") % 3 == 0, "correct").otherwise("wrong").alias("status"))
    return e.groupBy("slurp_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", rec.alias("r")))), lambda x: x["r"]).alias("recordings")).withColumn("sentence", F.col("slurp_id").cast("string"))


def d1(spark, d):
    return D.select_recordings(_utts(spark, d)).select("slurp_id", "recording.file", "recording.wer")


def d2(spark, d):
    return D.build_items(_utts(spark, d))


def _stored(spark, d):
    """Paths of the recordings of events: a quarter is not there, a quarter in a folder."""
    i = F.col("event_id")
    return V.table(spark, d, "events").where(i % 4 != 1).select(F.when(i % 4 == 2, F.format_string("slurp_real/f%s", i)).otherwise(F.format_string("f%s", i)).alias("path"))


def d2_stored(spark, d):
    return D.build_items(_utts(spark, d), False, True, _stored(spark, d))


def d2_first(spark, d):
    return D.build_items(_utts(spark, d), False, True, _stored(spark, d), "first")


def d2_missing(spark, d):
    return D.missing_recordings(_utts(spark, d), _stored(spark, d), "all")


def d3(spark, d):
    p = V.pairs(spark, d).select((F.col("key") % 3000).alias("slurp_id"), F.col("key").alias("pos"), F.col("model").alias("mode"), F.when(F.col("n") % 2 == 0, "vanilla").otherwise("cot").alias("method"), F.when(F.col("n") % 3 == 0, F.col("pred_intent")).alias("final"), F.col("gold_intent").alias("gold_label"), F.lit("why").alias("rationale_text"))
    return D.prepare_sft(p)


def d4(spark, d):
    p = V.pairs(spark, d).select("key", F.when(F.col("n") % 2 == 0, F.col("gold_intent")).alias("c_line"), F.when(F.col("n") % 3 == 0, F.lit(" ")).otherwise(F.lit("why")).alias("r_line"), F.lit("{}").alias("j_json"))
    return D.render_target(p, "CRJ").select("key", "target")


def d5(spark, d):
    p = V.pairs(spark, d).select("key", F.lit("why").alias("rationale_text"))
    return D.mix_sources(D.expand_multitask(p).where("task_id = 1").drop("task_mode"), D.expand_multitask(p).where("task_id = 0").drop("task_mode"))


def d6(spark, d):
    groups = V.pairs(spark, d).select(F.col("gold_intent").alias("label"), F.col("gold_action").alias("grp")).where("grp != 'a3'").distinct()
    return D.render_group_target(V.pairs(spark, d).select("key", "gold_intent"), groups, "gold_intent", "Intent").select("key", "target")


def _members(spark, d):
    """Groups of each kind: intents of one action, scenarios by first letter, and all but one of the slot types."""
    p = V.pairs(spark, d)
    listed = lambda rows, kind, label, by: rows.select(F.col(label).alias("label"), by.alias("g")).distinct().withColumn("members", F.array_sort(F.collect_set("label").over(W.partitionBy("g")))).select(F.lit(kind).alias("kind"), "label", "members")
    slots = V.entities(spark, d).select(F.explode("gold_entities").alias("e")).select("e.type").where("type != 'N'")
    return listed(p, "intent", "gold_intent", F.col("gold_action")).unionByName(listed(p, "scenario", "gold_scenario", F.substring("gold_scenario", 1, 1))).unionByName(listed(slots, "slot", "type", F.lit(1)))


def _levels(spark, d):
    return V.matched(spark, d).select("key", "n", F.col("gold_scenario").alias("scenario"), F.when(F.col("n") % 6 != 0, F.col("gold_action")).alias("action"), F.col("gold_entities").alias("entities"), F.col("gold_intent").alias("intent"))


def d6_answer(spark, d):
    return D.render_answer_target(_levels(spark, d), _members(spark, d)).select("key", "target")


def d6_levels(spark, d):
    return D.render_level_target(_levels(spark, d), _members(spark, d)).select("key", "target")


def _labels(spark, d):
    return V.pairs(spark, d).select(F.col("gold_intent").alias("label")).distinct()


def d7(spark, d):
    return D.add_distractors(V.pairs(spark, d).select("key", "gold_intent"), _labels(spark, d)).select("key", F.array_join("candidates", "|").alias("candidates"))


def d7_near(spark, d):
    """Distractors from the nearest labels by rule; labels of the action a4 have one neighbour only, those of a3 none."""
    near = B.rule_neighbors(_labels(spark, d)).where("a NOT LIKE '%a3'")
    ranked = near.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.col("score").desc(), "b"))).where("r = 1 OR a NOT LIKE '%a4'")
    table = ranked.groupBy(F.col("a").alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "b"))), lambda x: x["b"]).alias("neighbors"))
    return D.add_distractors(V.pairs(spark, d).select("key", "gold_intent"), _labels(spark, d), neighbors=table).select("key", F.array_join("candidates", "|").alias("candidates"))


def d8_slots(spark, d):
    rows = V.candidates(spark, d).select("key", "gold_slots")
    full = D.slot_candidate_list(rows, ["A", "N", "R", "X", "Y"]).withColumnRenamed("candidates", "full")
    return D.slot_candidate_list(full, ["A", "N", "R", "X", "Y"], 3).select("key", F.array_join("full", "|").alias("full"), F.array_join("candidates", "|").alias("sampled"))


def d8(spark, d):
    vocabulary = [f"{s}_a{k}" for s in ("click", "error", "view") for k in range(3)]
    return D.candidate_list(V.pairs(spark, d).select("key", "gold_intent"), vocabulary).select("key", F.array_join("candidates", "|").alias("candidates"))


def d9(spark, d):
    return V.table(spark, d, "events").select("event_id", D.format_nbest(F.array("event_type", F.col("user_id").cast("string"))).alias("text"))


def d9_definitions(spark, d):
    return D.db_definitions(B.label_inventory(V.pairs(spark, d), {"scenario": "gold_scenario", "action": "gold_action"}))


def d9_template(spark, d):
    c = V.pairs(spark, d).withColumn("candidates", F.array_distinct(F.array("gold_intent", "pred_intent")))
    return D.template_rationale(c).select("key", "rationale_text")


def d10(spark, d):
    p = V.pairs(spark, d).select("key", F.when(F.col("n") % 10 != 0, F.lit("a.wav")).alias("audio_path"), F.when(F.col("n") % 2 == 0, F.lit("why")).alias("rationale"))
    return D.distill_split(p, 0.1, 7).select("key", "rationale", "split")


def d10_target(spark, d):
    """Targets with quotes and line ends in the rationale, and with the gold intent where there is no final one."""
    n = F.col("n")
    p = V.pairs(spark, d).select("key", F.lit("a.wav").alias("audio_path"), F.when(n % 2 == 0, F.lit('é "why"\n\\ so')).alias("rationale"), F.when(n % 3 == 0, F.col("pred_intent")).otherwise(" ").alias("final_intent"), "gold_intent")
    return D.distill_split(p, 0.1, 7, intents=["final_intent", "gold_intent"]).select("key", "target_text", "split")


def d11(spark, d):
    return D.sample_by_id(V.table(spark, d, "events").select("event_id", F.col("user_id").alias("slurp_id")), 0.2, 3)


def d12(spark, d):
    return D.sample_per_combo(V.candidates(spark, d).select("key", "gold_intent", "gold_slots"), 5, 1).select("key", "gold_intent", "slot")


def d13(spark, d):
    return D.cap_per_intent(V.pairs(spark, d).select("key", "gold_intent"), 20, 1)


def d13_balanced(spark, d):
    return D.balanced_subset(V.candidates(spark, d).select("key", "gold_intent", "gold_slots"), 300, 20, 1).select("key", "gold_intent", F.array_join("gold_slots", ",").alias("slots"))


def d14(spark, d):
    p = V.pairs(spark, d).select("key", F.when(F.col("n") % 3 == 0, "text").otherwise("audio").alias("kind"))
    return D.epoch_batches(p, 4, 1, 64)


def d15(spark, d):
    return D.shard(V.pairs(spark, d).select("key"), 7, "key")


def _scored(spark, d):
    p = V.candidates(spark, d)
    return p.select("key", "gold_intent", "gold_slots", ((F.col("n") % 9 == 0) & (F.col("gold_action") != "a3")).alias("correct"), (F.col("n") % 5).cast("double").alias("score"), F.round(F.col("wer"), 4).alias("reward"))


def d16(spark, d):
    return D.success_filter(_scored(spark, d)).select("key", "correct", "coverage_fallback")


def d17(spark, d):
    """All rows in order with their rank: places in sorted partitions, which are written once, and the counts of the partitions before."""
    path = _folder(spark, "ordered")
    D.order_by_difficulty(_scored(spark, d)).select("key", "score", "reward", F.monotonically_increasing_id().alias("at")).write.parquet(path)
    part = F.shiftright("at", 33)
    rows = spark.read.parquet(path).withColumns({"part": part, "own": F.col("at") - F.shiftleft(part, 33)})
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(before, "part").select("key", "score", "reward", (F.col("before") + F.col("own") + 1).alias("rank")).orderBy("rank")


def d18(spark, d):
    rows = V.table(spark, d, "customer").select(F.col("c_custkey").alias("slurp_id"), F.col("c_name").alias("rationale_text"))
    return D.derange_rationales(rows, 5)


def _hypotheses(spark, d):
    return V.table(spark, d, "events").select(F.col("event_id").alias("key"), F.array(F.concat_ws(" ", F.lit("the"), "event_type", F.lit("now")), F.concat_ws(" ", "event_type", (F.col("user_id") % 3).cast("string")), F.concat_ws(" ", F.lit("a"), "event_type", F.lit("Now"))).alias("nbest"))


def d20(spark, d):
    return D.nbest_tokens(_hypotheses(spark, d), ["the", "a"]).select("key", F.array_join("stable", ",").alias("stable"), F.array_join("unstable", ",").alias("unstable"))


def d20_signs(spark, d):
    """Hypotheses with signs, upper case, empty and null ones; every other row has two only."""
    i, kind = F.col("event_id"), F.col("event_type")
    first, second = F.format_string("The %s, NOW!", kind), F.format_string("%s it's u%s", kind, F.col("user_id") % 3)
    every = F.array(first, F.lit(""), F.lit(None).cast("string"), second, F.format_string("a %s now", kind), F.format_string("b %s", kind))
    rows = V.table(spark, d, "events").select(i.alias("key"), F.when(i % 2 == 0, F.array(first, second)).otherwise(every).alias("nbest"))
    return D.nbest_tokens(rows, ["the", "a"]).select("key", F.array_join("stable", ",").alias("stable"), F.array_join("unstable", ",").alias("unstable"))


def d21(spark, d):
    return D.nbest_ablation(_hypotheses(spark, d), [1, 2, 5]).select("key", "k", F.size("nbest").alias("n"))


def d22(spark, d):
    rows = V.table(spark, d, "events").select(F.col("event_id").alias("key"), F.concat_ws(" ", F.lit("go to the"), "event_type").alias("sentence"))
    return D.simulate_nbest(rows, 4, 1).select("key", F.size("asr_hypotheses").alias("n"), F.col("asr_hypotheses")[0]["text"].alias("first"), F.col("asr_hypotheses")[1]["text"].alias("second"))


def d23(spark, d):
    return D.label_view(V.pairs(spark, d))


def v1(spark, d):
    return B.label_inventory(V.candidates(spark, d), {"scenario": "gold_scenario", "action": "gold_action", "intent": "gold_intent"}, "gold_slots", "key")


def _label_vectors(spark, d):
    """The mean vector of each label, over all its embeddings."""
    rows = V.table(spark, d, "embeddings").where("label IS NOT NULL AND embedding IS NOT NULL")
    return B.mean_vectors(rows.select(F.col("label").cast("string").alias("label"), "embedding"))


def v2(spark, d):
    return V.rounded(B.similar_pairs(_label_vectors(spark, d), 0.3), 5)


def v3(spark, d):
    return V.rounded(B.nearest_labels(_label_vectors(spark, d), 3), 5)


def v3_rules(spark, d):
    return B.rule_neighbors(_labels(spark, d))


def v4(spark, d):
    v = _label_vectors(spark, d)
    return V.rounded(B.soft_clusters(v, v.select("label", F.pmod(F.col("label").cast("int"), F.lit(6)).alias("cluster")), 0.25), 5)


def v5(spark, d):
    return B.kmeans_groups(_label_vectors(spark, d), 5, 1).select("grp", F.size("labels").alias("n"), F.array_join("labels", ",").alias("labels"))


def v6(spark, d):
    return B.agglomerative_groups(_label_vectors(spark, d), 6)


def v7(spark, d):
    e = V.table(spark, d, "customer")
    lines = e.select(F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 5 == 0, F.format_string("Group g%s:", "c_custkey")).otherwise(F.format_string("  - %s ", "c_name")).alias("value"))
    return B.load_groups(lines).select("label", "grp", F.size("members").alias("n"))


def _features(spark, d):
    return G.prepare_features(V.table(spark, d, "embeddings").select("vec_id", "label", "embedding"))


def g1(spark, d):
    return _features(spark, d).select("vec_id", "label", F.round(F.col("embedding")[0], 5).alias("x0"))


def g2(spark, d):
    return V.rounded(G.distance_stats(_features(spark, d)), 5)


def g3(spark, d):
    return V.rounded(G.spherical_stats(_features(spark, d)), 5)


def g4(spark, d):
    return V.rounded(G.margin_stats(_features(spark, d)), 5)


def g5(spark, d):
    return V.rounded(G.fisher_ratio(_features(spark, d)), 4)


def g6(spark, d):
    return V.rounded(G.silhouette_cosine(_features(spark, d)), 5)


def g6_euclidean(spark, d):
    return V.rounded(G.silhouette_euclidean(_features(spark, d)), 5)


def g7(spark, d):
    return V.rounded(G.mean_distance_ranks(_features(spark, d), 3).select("label", "n", "mean_distance", "rank"), 5)


def g7_table(spark, d):
    return V.rounded(G.distance_table(_features(spark, d), [0, 1, 2, 3]), 5)


def g8(spark, d):
    rows, shares = G.pca_2d(_features(spark, d))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.var_samp("x"), 5).alias("var_x"), F.round(F.var_samp("y"), 5).alias("var_y")).withColumns({"share_x": F.lit(round(shares[0], 5)), "share_y": F.lit(round(shares[1], 5))})


def g9(spark, d):
    p = V.pairs(spark, d).select("key", (F.col("wer") + 0.01).alias("a"), (F.col("n") / 100.0 + 0.02).alias("b"))
    return V.rounded(G.paired_test(p, 100), 5)


QUERIES = {
    "s1_read_jsonl": s1, "s2_read_records": s2, "s2_every_record": s2_every, "s5_csv_cells": s5, "s3_write_jsonl": s3, "s4_csv_json": s4, "s6_read_corpus": s6, "s7_merge_shards": s7, "s8_pending": s8, "s9_resolve_files": s9, "s9_missing_files": s9_missing,
    "j1_match_gold": j1, "j1_not_predicted": j1_missing, "j2_match_gold_fallback": j2, "j2_match_unknown_file": j2_unknown, "j2_not_found": j2_not_found, "j3_match_embedded": j3, "j4_enrich_recordings": j4, "j5_attach_manifest": j5, "j6_join_runs": j6, "j7_pair_runs": j7, "j8_resolve_intent": j8, "j9_fill_from": j9, "j10_attach_nbest": j10,
    "d1_select_recordings": d1, "d2_build_items": d2, "d2_stored_items": d2_stored, "d2_first_existing": d2_first, "d2_missing_recordings": d2_missing, "d3_prepare_sft": d3, "d4_render_target": d4, "d5_multitask": d5, "d6_render_group_target": d6, "d6_answer_target": d6_answer, "d6_level_target": d6_levels, "d7_add_distractors": d7, "d7_nearest_distractors": d7_near, "d8_candidate_list": d8, "d8_slot_candidates": d8_slots, "d9_format_nbest": d9, "d9_db_definitions": d9_definitions, "d9_template_rationale": d9_template, "d10_distill_split": d10, "d10_target_text": d10_target, "d11_sample_by_id": d11, "d12_sample_per_combo": d12,
    "d13_cap_per_intent": d13, "d13_balanced_subset": d13_balanced, "d14_epoch_batches": d14, "d15_shard": d15, "d16_success_filter": d16, "d17_order_by_difficulty": d17, "d18_derange_rationales": d18, "d20_nbest_tokens": d20, "d20_nbest_tokens_signs": d20_signs, "d21_nbest_ablation": d21, "d22_simulate_nbest": d22, "d23_label_view": d23,
    "v1_label_inventory": v1, "v2_similar_pairs": v2, "v3_nearest_labels": v3, "v3_rule_neighbors": v3_rules, "v4_soft_clusters": v4, "v5_kmeans_groups": v5, "v6_agglomerative_groups": v6, "v7_load_groups": v7,
    "g1_prepare_features": g1, "g2_distance_stats": g2, "g3_spherical_stats": g3, "g4_margin_stats": g4, "g5_fisher_ratio": g5, "g6_silhouette_cosine": g6, "g6_silhouette_euclidean": g6_euclidean, "g7_mean_distance_ranks": g7, "g7_distance_table": g7_table, "g8_pca_2d": g8, "g9_paired_test": g9,
}

_P = V.PAIRS
_VEC = "y0 AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL), y1 AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM y0 GROUP BY ALL), w0 AS (SELECT CAST(label AS VARCHAR) AS label, list(m ORDER BY i) AS e FROM y1 GROUP BY 1), v AS (SELECT label, list_transform(e, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(e, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS u FROM w0), s AS (SELECT a.label AS a, b.label AS b, list_dot_product(a.u, b.u) AS similarity FROM v a CROSS JOIN v b)"


def _draw(text: str) -> str:
    return f"CAST('0x' || substring(md5({text}), 1, 8) AS BIGINT)"


_F = "f0 AS (SELECT vec_id, label, embedding AS e, count(*) OVER (PARTITION BY label) AS k FROM embeddings WHERE label IS NOT NULL), f AS (SELECT vec_id, label, list_transform(e, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(e, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS u FROM f0 WHERE k >= 2), x AS (SELECT vec_id, label, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM f), c0 AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM c0 GROUP BY label), nn AS (SELECT label, count(*) AS n FROM f GROUP BY label), dd AS (SELECT a.label AS a, b.label AS b, list_distance(a.c, b.c) AS d FROM c a JOIN c b ON a.label <> b.label)"
_M = "mg0 AS (SELECT vec_id, f.label, c.label AS other, list_distance(u, c) AS d FROM f CROSS JOIN c), mg AS (SELECT vec_id, label, min(d) FILTER (other = label) AS own, min(d) FILTER (other <> label) AS oth FROM mg0 GROUP BY ALL), ms AS (SELECT *, oth - own AS margin, (oth - own) / greatest(oth + own, 1e-12) AS normalised FROM mg)"
_Q = ", ".join(f"round(avg({c}), 5) AS {c}_mean, round(median({c}), 5) AS {c}_median, round(quantile_cont({c}, 0.1), 5) AS {c}_p10, round(quantile_cont({c}, 0.9), 5) AS {c}_p90" for c in ("margin", "normalised"))

_REC = "r AS (SELECT user_id, event_id, CASE WHEN event_id % 5 <> 0 THEN round(value % 1, 1) END AS wer, event_id % 3 = 0 AS ok, CASE event_id % 4 WHEN 1 THEN NULL WHEN 2 THEN 'slurp_real/f' || event_id ELSE 'f' || event_id END AS path FROM events)"
_LEV = f"""{V.MATCHED}, li AS (SELECT gold_action AS t, '[''' || string_agg(DISTINCT gold_intent, ''', ''' ORDER BY gold_intent) || ''']' AS i FROM pairs GROUP BY 1), ls AS (SELECT gold_scenario[1] AS c, '[''' || string_agg(DISTINCT gold_scenario, ''', ''' ORDER BY gold_scenario) || ''']' AS s FROM pairs GROUP BY 1),
lt AS (SELECT '[''' || string_agg(DISTINCT type, ''', ''' ORDER BY type) || ''']' AS m FROM ge WHERE type <> 'N'), ty AS (SELECT key, string_agg('Slot Group ' || CASE WHEN type = 'N' THEN '[''N'']' ELSE m END || ' Selection: ' || type, ' | ' ORDER BY type) AS slots FROM (SELECT DISTINCT key, type FROM ge) CROSS JOIN lt GROUP BY key),
en AS (SELECT key, string_agg('{{"type": "' || gt || '", "filler": "' || filler || '"}}', ', ' ORDER BY pos, l_partkey, gt, filler) AS es FROM l WHERE pos <= 4 GROUP BY key),
lev AS (SELECT p.key, p.gold_intent, p.gold_scenario, CASE WHEN n % 6 <> 0 THEN p.gold_action ELSE '' END AS a, i, s, slots, '{{"scenario": "' || p.gold_scenario || '", "action": "' || CASE WHEN n % 6 <> 0 THEN p.gold_action ELSE '' END || '", "entities": [' || coalesce(es, '') || ']}}' AS answer FROM pairs p JOIN li ON t = p.gold_action JOIN ls ON c = p.gold_scenario[1] LEFT JOIN ty USING (key) LEFT JOIN en USING (key))"""


def _rank(rows: str, key: str, seed: int) -> str:
    return f"(SELECT *, row_number() OVER (ORDER BY md5(CAST({key} AS VARCHAR) || '|{seed}'), {key}) AS rank FROM {rows})"


SQL = {
    "s9_missing_files": "SELECT count(*) FILTER (p_partkey % 4 = 3) AS missing FROM part",
    "d2_stored_items": f"WITH {_REC}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ok DESC, coalesce(wer, 1e9), event_id) AS k FROM r) SELECT user_id AS slurp_id, 'audio' AS kind, path AS file, CAST(user_id AS VARCHAR) AS transcript FROM p WHERE k = 1 AND path IS NOT NULL",
    "d2_first_existing": f"WITH {_REC} SELECT user_id AS slurp_id, 'audio' AS kind, arg_min(path, event_id) AS file, CAST(user_id AS VARCHAR) AS transcript FROM r WHERE path IS NOT NULL GROUP BY user_id",
    "d2_missing_recordings": f"WITH {_REC} SELECT count(*) AS missing FROM (SELECT *, bool_or(ok) OVER (PARTITION BY user_id) AS any_ok FROM r) WHERE path IS NULL AND (ok OR NOT any_ok)",
    "d6_answer_target": f"WITH {_LEV} SELECT key, 'Group: ' || i || chr(10) || 'Selection: ' || gold_intent || chr(10) || 'Answer: ' || answer AS target FROM lev",
    "d6_level_target": f"WITH {_LEV} SELECT key, CASE WHEN a <> '' THEN 'Intent Group: ' || i || ' Selection: ' || gold_intent || chr(10) ELSE '' END || 'Scenario Group: ' || s || ' Selection: ' || gold_scenario || chr(10) || 'Action Group: [''' || a || '''] Selection: ' || a || chr(10) || coalesce(slots, 'Slot: None') || chr(10) || 'Answer: ' || answer AS target FROM lev",
    "d7_nearest_distractors": f"WITH {_P}, l AS (SELECT DISTINCT gold_intent AS label, gold_scenario AS s, gold_action AS t FROM pairs), nb AS (SELECT x.label AS a, y.label AS b, row_number() OVER (PARTITION BY x.label ORDER BY CASE WHEN x.s = y.s THEN 10 ELSE 0 END + CASE WHEN x.t = y.t THEN 5 ELSE 0 END DESC, y.label) AS r FROM l x JOIN l y ON x.label <> y.label AND (x.s = y.s OR x.t = y.t) WHERE x.t <> 'a3'), o AS (SELECT key, label FROM pairs JOIN l ON label <> gold_intent LEFT JOIN nb ON nb.a = gold_intent AND nb.b = label AND r <= CASE WHEN gold_action = 'a4' THEN 1 ELSE 5 END QUALIFY row_number() OVER (PARTITION BY key ORDER BY r IS NULL, md5(key || '|' || label || '|0'), label) <= 2), u AS (SELECT key, label FROM o UNION ALL SELECT key, gold_intent FROM pairs) SELECT key, string_agg(label, '|' ORDER BY md5(key || '|' || label || '|0-order'), label) AS candidates FROM u GROUP BY key",
    "d8_slot_candidates": f"WITH {_P}, {V.ENTITIES}, g AS (SELECT key, gt AS x, row_number() OVER (PARTITION BY key ORDER BY min((pos, l_partkey, gt, filler))) AS r FROM l WHERE pos <= 4 GROUP BY key, gt), w AS (SELECT pairs.key, x.x, x.i, md5(pairs.key || '|' || x.x || '|0') AS h, r FROM pairs CROSS JOIN (VALUES ('A', 1), ('N', 2), ('R', 3), ('X', 4), ('Y', 5)) x(x, i) LEFT JOIN g ON g.key = pairs.key AND g.x = x.x) SELECT key, string_agg(x, '|' ORDER BY coalesce(r, 10), i) AS full, array_to_string(list_slice(list(x ORDER BY coalesce(r, 10), h, x), 1, 3), '|') AS sampled FROM w GROUP BY key",
    "d10_target_text": f"WITH {_P}, k AS (SELECT * FROM pairs) SELECT key, '{{\"rationale\": \"' || CASE WHEN n % 2 = 0 THEN 'é \\\"why\\\"\\n\\\\ so' ELSE 'No rationale.' END || '\", \"intent\": \"' || CASE WHEN n % 3 = 0 THEN pred_intent ELSE gold_intent END || '\"}}' AS target_text, CASE WHEN rank <= floor((SELECT count(*) FROM k) * 0.1) THEN 'eval' ELSE 'train' END AS split FROM {_rank('k', 'key', 7)}",
    "s1_read_jsonl": "SELECT event_id AS id, event_type AS kind, CAST(user_id AS VARCHAR) AS tags FROM events WHERE event_id % 10 NOT IN (3, 4, 5)",
    "s2_read_records": "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1",
    "s2_every_record": "SELECT event_id AS id, event_type AS kind FROM events",
    "s5_csv_cells": """SELECT event_id, '{"u":' || user_id || ',"t":"' || event_type || '"}' AS who, '["' || event_type || '","b"]' AS tags, CASE WHEN event_id % 2 = 0 THEN 'say "x", y' END AS note FROM events""",
    "j2_match_unknown_file": "SELECT event_id AS pos, event_type AS key FROM events WHERE event_id % 3 = 1",
    "j2_not_found": "SELECT count(*) FILTER (event_id % 3 <> 1) AS not_found FROM events",
    "d20_nbest_tokens_signs": "SELECT event_id AS key, event_type AS stable, CASE WHEN event_id % 2 = 0 THEN 'it''s,now,u' || (user_id % 3) ELSE 'b,it''s,u' || (user_id % 3) END AS unstable FROM events",
    "s3_write_jsonl": f"WITH {_P} SELECT key, gold_intent, wer FROM pairs",
    "s4_csv_json": f"WITH {V.ENTITIES}, g AS (SELECT key, count_if(pos <= 4) AS k FROM l GROUP BY key) SELECT key, CAST(k AS INT) AS n, CASE WHEN k > 2 THEN length('say \"x\", y' || chr(10) || 'z') ELSE 5 END AS note FROM g",
    "s6_read_corpus": "SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier",
    "s7_merge_shards": "SELECT key, shard, pos, value FROM (SELECT event_id % 3000 AS key, user_id % 4 AS shard, event_id AS pos, value, row_number() OVER (PARTITION BY event_id % 3000 ORDER BY user_id % 4, event_id) AS r FROM events) WHERE r = 1",
    "s8_pending": f"WITH {_P} SELECT key, gold_intent FROM pairs WHERE n % 3 <> 0",
    "s9_resolve_files": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'f' || p_partkey || '.flac' WHEN 1 THEN 'slurp_real/f' || p_partkey || '.flac' WHEN 2 THEN 'other/x/f' || p_partkey || '.flac' END AS resolved FROM part",
    "j1_match_gold": f"WITH {V.MATCHED}, pe2 AS (SELECT key AS k, count(*) AS c FROM pe GROUP BY key), p AS (SELECT key % 6000 AS key, arg_max(CASE WHEN n % 5 = 0 THEN 'unknown' ELSE pred_scenario END, key) AS pred_scenario, arg_max(pred_action, key) AS pred_action, max(key) AS k FROM m GROUP BY 1) SELECT CAST(m.key AS VARCHAR) AS key, m.gold_scenario, p.pred_scenario, p.pred_action, CAST(coalesce(c, 0) AS INT) AS n FROM m JOIN p ON m.key = p.key LEFT JOIN pe2 ON pe2.k = p.k",
    "j1_not_predicted": f"WITH {_P} SELECT count(*) AS not_predicted FROM pairs WHERE key NOT IN (SELECT key % 6000 FROM pairs)",
    "j2_match_gold_fallback": "WITH k AS (SELECT event_id AS pos, CASE event_id % 3 WHEN 0 THEN user_id || '.flac' WHEN 1 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS key FROM events) SELECT pos, key, CAST(length(key) AS INT) AS size FROM k",
    "j3_match_embedded": f"WITH {_P} SELECT key, CASE WHEN n % 2 = 0 THEN gold_scenario ELSE pred_scenario END AS gold_scenario, CASE WHEN n % 2 = 0 THEN gold_action ELSE pred_action END AS gold_action FROM pairs WHERE n % 2 = 0 OR n % 5 <> 0",
    "j4_enrich_recordings": "WITH u AS (SELECT user_id, arg_min(event_id, event_id) AS e, arg_min(event_type, event_id) AS t FROM events GROUP BY user_id), r AS (SELECT event_id, e, t, event_id % 2 = 0 AS own, event_id % 4 = 1 AS blank, event_id % 2 <> 0 AND user_id % 3 <> 0 AS enriched FROM events JOIN u USING (user_id)) SELECT event_id, CASE WHEN own THEN 'f' || event_id WHEN enriched THEN 'f' || e END AS file, CASE WHEN NOT blank THEN 'own' WHEN enriched THEN t ELSE '' END AS sentence, enriched FROM r",
    "j5_attach_manifest": "WITH m AS (SELECT user_id, min(event_id) AS e FROM events WHERE user_id % 3 <> 0 GROUP BY user_id), r AS (SELECT event_id, event_id % 2 = 0 AS has, CASE WHEN event_id % 7 <> 0 THEN user_id END AS id FROM events) SELECT event_id, CAST(id AS VARCHAR) AS id, CASE WHEN has THEN 'own.wav' WHEN m.user_id % 5 <> 0 THEN 'm' || e || '.wav' END AS file, CASE WHEN has THEN 'kept' WHEN m.user_id IS NULL THEN 'missing_id' WHEN m.user_id % 5 = 0 THEN 'missing_file' ELSE 'attached' END AS state FROM r LEFT JOIN m ON r.id = m.user_id",
    "j6_join_runs": f"WITH {_P} SELECT key AS id, gold_intent, pred_intent AS student, CASE WHEN n % 3 = 0 THEN gold_action END AS baseline FROM pairs WHERE n % 2 = 0",
    "j7_pair_runs": f"WITH {_P}, a AS (SELECT key % 2000 AS id, arg_min(wer, key) AS a FROM pairs WHERE key % 3 <> 0 GROUP BY 1), b AS (SELECT key % 2000 AS id, arg_min(wer, key) AS b FROM pairs WHERE key % 3 <> 1 GROUP BY 1) SELECT 'id=' || id || '|file=' AS key, a, b FROM a JOIN b USING (id)",
    "j8_resolve_intent": f"WITH {_P}, g AS (SELECT key % 100 AS f, arg_min(gold_intent, key) AS i FROM pairs WHERE key % 2 = 0 GROUP BY 1) SELECT key, CASE WHEN n % 4 = 0 THEN gold_intent WHEN n % 4 = 1 THEN pred_intent WHEN n % 4 = 2 AND key % 2 = 0 THEN gold_intent ELSE coalesce(i, '__unknown__') END AS resolved FROM pairs LEFT JOIN g ON f = key % 100",
    "j9_fill_from": "WITH u AS (SELECT user_id, arg_min(event_type, event_id) AS t FROM events GROUP BY user_id) SELECT event_id, CASE WHEN event_id % 2 = 0 THEN t ELSE 'own' END AS scenario, CASE WHEN event_id % 3 = 0 THEN t ELSE 't' END AS tokens FROM events JOIN u USING (user_id) WHERE event_id % 5 <> 0",
    "j10_attach_nbest": "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'gold' WHEN CAST('0x' || substring(md5(event_id || '|0'), 1, 8) AS BIGINT) % 2 = 0 THEN 'a ' || event_type ELSE 'b' END AS transcript, CASE WHEN event_id % 3 <> 0 THEN 2 END AS n FROM events",
    "d1_select_recordings": "WITH r AS (SELECT user_id, event_id, CASE WHEN event_id % 5 <> 0 THEN round(value % 1, 1) END AS wer, event_id % 3 = 0 AS ok FROM events), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ok DESC, coalesce(wer, 1e9), event_id) AS k FROM r) SELECT user_id AS slurp_id, 'f' || event_id AS file, wer FROM p WHERE k = 1",
    "d2_build_items": "WITH r AS (SELECT user_id, event_id, CASE WHEN event_id % 5 <> 0 THEN round(value % 1, 1) END AS wer, event_id % 3 = 0 AS ok FROM events), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ok DESC, coalesce(wer, 1e9), event_id) AS k FROM r) SELECT user_id AS slurp_id, 'audio' AS kind, 'f' || event_id AS file, CAST(user_id AS VARCHAR) AS transcript FROM p WHERE k = 1 UNION ALL SELECT DISTINCT user_id, 'text', NULL, CAST(user_id AS VARCHAR) FROM events",
    "d3_prepare_sft": f"WITH {_P}, r AS (SELECT key % 3000 AS slurp_id, model AS mode, CASE WHEN n % 2 = 0 THEN 'vanilla' ELSE 'cot' END AS method, key AS pos, CASE WHEN n % 3 = 0 THEN pred_intent ELSE gold_intent END AS final, CASE WHEN n % 2 = 0 THEN '' ELSE 'why' END AS rationale_text FROM pairs) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY slurp_id, mode, method ORDER BY pos) = 1",
    "d4_render_target": f"WITH {_P} SELECT key, 'C: ' || CASE WHEN n % 2 = 0 THEN gold_intent ELSE '(none)' END || chr(10) || 'R: ' || CASE WHEN n % 3 = 0 THEN '(none)' ELSE 'why' END || chr(10) || 'J: {{}}' AS target FROM pairs".replace("{{}}", "{}"),
    "d5_multitask": f"WITH {_P} SELECT key, '' AS rationale_text, 1 AS task_id, 'label' AS task_mode FROM pairs UNION ALL SELECT key, 'why', 0, 'cot' FROM pairs",
    "d6_render_group_target": f"WITH {_P}, g AS (SELECT gold_action AS grp, string_agg(DISTINCT gold_intent, ', ' ORDER BY gold_intent) AS members FROM pairs WHERE gold_action <> 'a3' GROUP BY 1) SELECT key, 'Intent Group ' || coalesce(grp, gold_intent) || ': ' || coalesce(members, gold_intent) || '. Selection: ' || gold_intent || '.' AS target FROM pairs LEFT JOIN g ON gold_action = grp",
    "d7_add_distractors": f"WITH {_P}, l AS (SELECT DISTINCT gold_intent AS label FROM pairs), o AS (SELECT key, label FROM pairs JOIN l ON label <> gold_intent QUALIFY row_number() OVER (PARTITION BY key ORDER BY md5(key || '|' || label || '|0'), label) <= 2), u AS (SELECT key, label FROM o UNION ALL SELECT key, gold_intent FROM pairs) SELECT key, string_agg(label, '|' ORDER BY md5(key || '|' || label || '|0-order'), label) AS candidates FROM u GROUP BY key",
    "d8_candidate_list": f"WITH {_P}, v AS (SELECT unnest(['click_a0', 'click_a1', 'click_a2', 'error_a0', 'error_a1', 'error_a2', 'view_a0', 'view_a1', 'view_a2']) AS w) SELECT key, gold_intent || '|' || string_agg(w, '|' ORDER BY w) AS candidates FROM pairs JOIN v ON w <> gold_intent GROUP BY key, gold_intent",
    "d9_format_nbest": "SELECT event_id, '1. ' || event_type || chr(10) || '2. ' || user_id AS text FROM events",
    "d9_db_definitions": f"WITH {_P} SELECT 'scenario' AS kind, 'Scenario: ' || string_agg(DISTINCT gold_scenario, ', ' ORDER BY gold_scenario) AS line FROM pairs UNION ALL SELECT 'action', 'Action: ' || string_agg(DISTINCT gold_action, ', ' ORDER BY gold_action) FROM pairs",
    "d9_template_rationale": f"WITH {_P} SELECT key, CASE WHEN gold_intent = pred_intent THEN 'C: Intent candidates: ' || gold_intent || chr(10) || 'R: (none)' ELSE 'C: Intent candidates: ' || gold_intent || ' | ' || pred_intent || chr(10) || 'R: ' || pred_intent || '!not supported by the words' END || chr(10) || 'J: {{\"intent\":\"' || gold_intent || '\"}}' AS rationale_text FROM pairs",
    "d10_distill_split": f"WITH {_P}, k AS (SELECT key, n FROM pairs WHERE n % 10 <> 0) SELECT key, CASE WHEN n % 2 = 0 THEN 'why' ELSE 'No rationale.' END AS rationale, CASE WHEN rank <= floor((SELECT count(*) FROM k) * 0.1) THEN 'eval' ELSE 'train' END AS split FROM {_rank('k', 'key', 7)}",
    "d11_sample_by_id": f"WITH i AS (SELECT DISTINCT user_id FROM events) SELECT event_id, user_id AS slurp_id FROM events WHERE user_id IN (SELECT user_id FROM {_rank('i', 'user_id', 3)} WHERE rank <= greatest(1, floor((SELECT count(*) FROM i) * 0.2)))",
    "d12_sample_per_combo": f"WITH {V.MATCHED}, gt AS (SELECT DISTINCT key, type FROM ge), r AS (SELECT pairs.key, gold_intent, coalesce(type, '__none__') AS slot FROM pairs LEFT JOIN gt USING (key)) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY gold_intent, slot ORDER BY md5(key || '|' || slot || '|1'), key) <= 5",
    "d13_cap_per_intent": f"WITH {_P} SELECT key, gold_intent FROM pairs QUALIFY row_number() OVER (PARTITION BY gold_intent ORDER BY md5(key || '|1'), key) <= 20",
    "d14_epoch_batches": f"WITH {_P}, a AS (SELECT key, 'audio' AS kind FROM pairs WHERE n % 3 <> 0), t AS (SELECT key, 'text' AS kind FROM pairs WHERE n % 3 = 0), u AS (SELECT key, kind, CAST(floor((rank - 1) / 4) + 1 AS BIGINT) AS rank FROM {_rank('a', 'key', 0)} WHERE (rank - 1) % 4 = 1 UNION ALL SELECT key, kind, rank FROM {_rank('t', 'key', 0)}) SELECT *, CAST(floor((rank - 1) / 64) AS BIGINT) AS batch FROM u",
    "d15_shard": "SELECT event_id AS key, event_id % 7 AS shard FROM events",
    "d16_success_filter": f"""WITH {V.MATCHED}, gt AS (SELECT DISTINCT key, type FROM ge), z AS (SELECT key, gold_intent, n % 9 = 0 AND gold_action <> 'a3' AS correct, n % 5 AS score, round(wer, 4) AS reward, md5(key || '|ties') AS h FROM pairs),
    mi AS (SELECT key FROM z WHERE gold_intent NOT IN (SELECT gold_intent FROM z WHERE correct) QUALIFY row_number() OVER (PARTITION BY gold_intent ORDER BY correct DESC, score DESC, reward DESC, h DESC, key DESC) = 1), ch AS (SELECT key FROM z WHERE correct UNION SELECT key FROM mi),
    cov AS (SELECT DISTINCT type FROM gt WHERE key IN (SELECT key FROM ch)), ms AS (SELECT z.key FROM z JOIN gt USING (key) WHERE type NOT IN (SELECT type FROM cov) QUALIFY row_number() OVER (PARTITION BY type ORDER BY correct DESC, score DESC, reward DESC, h DESC, z.key DESC) = 1)
    SELECT key, correct, false AS coverage_fallback FROM z WHERE correct UNION ALL SELECT key, correct, true FROM z WHERE NOT correct AND key IN (SELECT key FROM mi UNION SELECT key FROM ms)""",
    "d17_order_by_difficulty": f"WITH {_P} SELECT key, CAST(n % 5 AS DOUBLE) AS score, round(wer, 4) AS reward, row_number() OVER (ORDER BY n % 5, round(wer, 4), (n % 9 = 0 AND gold_action <> 'a3'), key) AS rank FROM pairs",
    "d18_derange_rationales": f"WITH r AS (SELECT * FROM {_rank('(SELECT c_custkey AS slurp_id, c_name FROM customer)', 'slurp_id', 5)}), n AS (SELECT count(*) AS n FROM r) SELECT a.slurp_id, b.c_name AS rationale_text, b.slurp_id AS rationale_source FROM r a CROSS JOIN n JOIN r b ON a.rank = (b.rank - 2 + n.n) % n.n + 1",
    "d20_nbest_tokens": "SELECT event_id AS key, event_type || ',now' AS stable, CAST(user_id % 3 AS VARCHAR) AS unstable FROM events",
    "d21_nbest_ablation": "SELECT event_id AS key, k, CAST(least(k, 3) AS INT) AS n FROM events CROSS JOIN (SELECT unnest([1, 2, 5]) AS k)",
    "d23_label_view": f"WITH {_P} SELECT key, gold_scenario, gold_action, gold_intent, pred_scenario, pred_action, pred_intent FROM pairs",
    "v1_label_inventory": f"WITH {V.MATCHED}, gt AS (SELECT DISTINCT key, type FROM ge), u AS (SELECT key, 'scenario' AS kind, gold_scenario AS label FROM pairs UNION ALL SELECT key, 'action', gold_action FROM pairs UNION ALL SELECT key, 'intent', gold_intent FROM pairs UNION ALL SELECT key, 'slot', type FROM gt JOIN pairs USING (key)) SELECT kind, label, count(*) AS n, min(key) AS first FROM u GROUP BY ALL",
    "v2_similar_pairs": f"WITH {_VEC} SELECT a, b, round(similarity, 5) AS similarity FROM s WHERE a < b AND similarity >= 0.3",
    "v3_nearest_labels": f"WITH {_VEC} SELECT a, b, round(similarity, 5) AS similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM s WHERE a <> b) WHERE rank <= 3",
    "v3_rule_neighbors": f"WITH {_P}, l AS (SELECT DISTINCT gold_intent AS x, gold_scenario AS s, gold_action AS t FROM pairs), r AS (SELECT a.x AS a, b.x AS b, CASE WHEN a.s = b.s THEN 10 ELSE 0 END + CASE WHEN a.t = b.t THEN 5 ELSE 0 END AS score FROM l a JOIN l b ON a.x <> b.x) SELECT * FROM r WHERE score > 0",
    "v4_soft_clusters": f"WITH {_VEC}, x AS (SELECT CAST(label AS INT) % 6 AS cluster, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM v), m AS (SELECT cluster, i, avg(x) AS m FROM x GROUP BY ALL), c AS (SELECT cluster, list(m ORDER BY i) AS c FROM m GROUP BY cluster) SELECT label, cluster, round(list_cosine_similarity(u, c), 5) AS similarity FROM v CROSS JOIN c WHERE list_cosine_similarity(u, c) >= 0.25",
    "v7_load_groups": "WITH r AS (SELECT c_name AS label, 'g' || (c_custkey // 5 * 5) AS grp FROM customer WHERE c_custkey % 5 <> 0) SELECT label, grp, CAST(count(*) OVER (PARTITION BY grp) AS INT) AS n FROM r",
    "g1_prepare_features": f"WITH {_F} SELECT vec_id, label, round(u[1], 5) AS x0 FROM f",
    "g2_distance_stats": f"WITH {_F}, i AS (SELECT label, count(*) AS n, avg(list_distance(u, c)) AS intra FROM f JOIN c USING (label) GROUP BY label), k AS (SELECT a AS label, arg_min(b, d) AS nearest, min(d) AS nd, avg(d) AS md FROM dd GROUP BY a) SELECT label, n, round(intra, 5) AS intra, nearest, round(nd, 5) AS nearest_distance, round(md, 5) AS mean_distance, round(nd / intra, 5) AS separation FROM i JOIN k USING (label)",
    "g3_spherical_stats": f"WITH {_F}, q AS (SELECT label, n, c, (list_dot_product(c, c) * n * n - n) / (n * (n - 1)) AS intra FROM c JOIN nn USING (label)), k AS (SELECT a.label, max(list_cosine_similarity(a.c, b.c)) AS nearest FROM c a JOIN c b ON a.label <> b.label GROUP BY 1) SELECT label, n, round(intra, 5) AS intra, round(nearest, 5) AS nearest, round(intra - nearest, 5) AS gap FROM q JOIN k USING (label)",
    "g4_margin_stats": f"WITH {_F}, {_M} SELECT label, count(*) AS n, round(avg(CAST(margin > 0 AS INT)), 5) AS positive, {_Q} FROM ms GROUP BY label",
    "g5_fisher_ratio": f"WITH {_F}, o AS (SELECT list(m ORDER BY i) AS mu FROM (SELECT i, avg(x) AS m FROM x GROUP BY i)), b AS (SELECT sum(n * pow(list_distance(c, mu), 2)) AS between_ FROM c JOIN nn USING (label) CROSS JOIN o), w AS (SELECT sum(pow(list_distance(u, c), 2)) AS within_ FROM f JOIN c USING (label)) SELECT round(between_, 4) AS \"between\", round(within_, 4) AS within, round(between_ / within_, 4) AS fisher FROM b CROSS JOIN w",
    "g6_silhouette_cosine": f"WITH {_F}, q AS (SELECT f.vec_id, f.label, c.label AS other, n, list_dot_product(u, c) * n AS dt FROM f CROSS JOIN c JOIN nn ON nn.label = c.label), r AS (SELECT vec_id, label, min((n - dt) / (n - 1)) FILTER (other = label) AS a, min(1 - dt / n) FILTER (other <> label) AS b FROM q GROUP BY ALL) SELECT label, count(*) AS n, round(avg((b - a) / greatest(a, b, 1e-12)), 5) AS silhouette FROM r GROUP BY label",
    "g6_silhouette_euclidean": f"""WITH {_F}, o AS (SELECT *, md5(vec_id || '|0') AS h FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS r FROM o), s AS (SELECT * FROM k ORDER BY r > 1, h LIMIT 4000),
    q AS (SELECT f.vec_id, f.label, g.label AS other, sum(list_distance(f.u, g.u)) AS d, count(*) AS n FROM s AS f CROSS JOIN s AS g GROUP BY ALL), r AS (SELECT vec_id, label, min(d / greatest(n - 1, 1)) FILTER (other = label) AS a, min(d / n) FILTER (other <> label) AS b, min(n) FILTER (other = label) AS own FROM q GROUP BY ALL)
    SELECT CAST(label AS VARCHAR) AS label, count(*) AS n, round(avg(CASE WHEN own > 1 THEN (b - a) / greatest(a, b, 1e-12) ELSE 0 END), 5) AS silhouette FROM r GROUP BY label""",
    "d22_simulate_nbest": f"""WITH t AS (SELECT event_id AS key, 'go to the ' || event_type AS first, ['go', 'to', 'the', event_type] AS w, {_draw("event_id || '|heard|1|1'")} % 2 AS h, {_draw("event_id || '|drop|1'")} % 4 AS d, {_draw("event_id || '|twice|1'")} % 4 AS x FROM events),
    f AS (SELECT key, first, unnest([replace(first, ' to ', CASE h WHEN 0 THEN ' two ' ELSE ' too ' END), array_to_string(list_concat(w[1:d], w[d + 2:]), ' '), array_to_string(list_concat(w[1:x + 1], w[x + 1:]), ' ')]) AS form FROM t)
    SELECT key, CAST(1 + count(*) AS INT) AS n, first, arg_max(form, {_draw("key || '|sure|' || form || '|1'")}) AS second FROM f GROUP BY key, first""",
    "g7_mean_distance_ranks": f"WITH {_F}, k AS (SELECT a AS label, min(d) AS nd, avg(d) AS md FROM dd GROUP BY a), r AS (SELECT label, n, md, CAST(row_number() OVER (ORDER BY md, nd, n DESC, label) AS INT) AS rank, count(*) OVER () AS k FROM k JOIN nn USING (label)) SELECT label, n, round(md, 5) AS mean_distance, rank FROM r WHERE rank = 1 OR rank = k OR (rank - 1) % 3 = 0",
    "g7_distance_table": f"WITH {_F} SELECT a, " + ", ".join(f"round(coalesce(max(d) FILTER (b = {k}), 0), 5) AS \"{k}\"" for k in range(4)) + " FROM dd WHERE a < 4 AND b < 4 GROUP BY a",
}
