"""Views of the bundled tables as label pairs, entities and candidates; the SQL beside each gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order give the same values."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted labels from events: a prediction is the type of the user's event before, or right for every third n."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given by number, for few small ones are not made one where much is computed from them
    e = table(spark, sf_dir, "events").repartition(parts, "user_id").withColumns({
        "n": F.regexp_extract("props", r"(\d+)", 1).cast("int"),
        "prev": F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")),
    })
    act = lambda n: F.concat(F.lit("a"), (n % 5).cast("string"))
    shifted = F.col("n") + F.when(F.col("event_id") % 4 == 0, 1).otherwise(0)
    rows = e.select(
        F.col("event_id").alias("key"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("event_type").alias("gold_scenario"), act(F.col("n")).alias("gold_action"),
        F.coalesce(F.when(F.col("n") % 3 == 0, F.col("event_type")).otherwise(F.col("prev")), F.lit("unknown")).alias("pred_scenario"), act(shifted).alias("pred_action"), (F.col("value") / 100).alias("wer"), "n",
    )
    return rows.withColumns({"gold_intent": F.concat_ws("_", "gold_scenario", "gold_action"), "pred_intent": F.concat_ws("_", "pred_scenario", "pred_action")})


PAIRS = r"""e AS (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS n, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
p0 AS (SELECT event_id AS key, 'm' || (user_id % 3) AS model, event_type AS gold_scenario, 'a' || (n % 5) AS gold_action,
  coalesce(CASE WHEN n % 3 = 0 THEN event_type ELSE prev END, 'unknown') AS pred_scenario, 'a' || ((n + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) % 5) AS pred_action, value / 100 AS wer, n FROM e),
pairs AS (SELECT *, gold_scenario || '_' || gold_action AS gold_intent, pred_scenario || '_' || pred_action AS pred_intent FROM p0)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted entities of each order from its lines: gold to line 4, predicted from line 2 to 6, some of another type."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    named = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    filler = F.split("p_name", " ")[0]
    other = F.when(F.col("l_partkey") % 5 == 0, F.lit("X")).otherwise(F.col("l_returnflag"))
    entry = lambda kind: F.struct(F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("part"), kind.alias("type"), filler.alias("filler"))
    some = lambda c, kind: F.array_sort(F.collect_list(F.when(c, entry(kind))))
    bare = lambda c: F.transform(c, lambda x: F.struct(x["type"].alias("type"), x["filler"].alias("filler")))
    found = named.groupBy(F.col("l_orderkey").alias("key")).agg(some(F.col("l_linenumber") <= 4, F.col("l_returnflag")).alias("g"), some(F.col("l_linenumber").between(2, 6), other).alias("p"))
    return found.select("key", bare(F.col("g")).alias("gold_entities"), bare(F.col("p")).alias("pred_entities"))


ENTITIES = """l AS (SELECT l_orderkey AS key, l_linenumber AS pos, l_partkey, l_returnflag AS gt, CASE WHEN l_partkey % 5 = 0 THEN 'X' ELSE l_returnflag END AS pt, split_part(p_name, ' ', 1) AS filler
  FROM lineitem JOIN part ON l_partkey = p_partkey),
ge AS (SELECT key, gt AS type, filler FROM l WHERE pos <= 4), pe AS (SELECT key, pt AS type, filler FROM l WHERE pos BETWEEN 2 AND 6)"""


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label pairs with the entities of the order of the same number; orders without lines have none."""
    none = F.array().cast("array<struct<type:string,filler:string>>")
    found = pairs(spark, sf_dir).join(entities(spark, sf_dir), "key", "left")
    return found.withColumns({c: F.coalesce(c, none) for c in ("gold_entities", "pred_entities")})


MATCHED = f"""{PAIRS}, {ENTITIES},
gs AS (SELECT DISTINCT key, type, filler FROM ge), ps AS (SELECT DISTINCT key, type, filler FROM pe),
sets AS (SELECT coalesce(gs.key, ps.key) AS key, count_if(gs.type IS NOT NULL AND ps.type IS NOT NULL) AS tp, count_if(gs.type IS NULL) AS fp, count_if(ps.type IS NULL) AS fn
  FROM gs FULL JOIN ps ON gs.key = ps.key AND gs.type = ps.type AND gs.filler = ps.filler GROUP BY 1),
m AS (SELECT pairs.*, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, CASE WHEN coalesce(tp + fp + fn, 0) = 0 THEN 1.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS entity_f1 FROM pairs LEFT JOIN sets USING (key))"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched rows with intent candidates, reasons and slots made from their numbers."""
    m = matched(spark, sf_dir)
    n = F.col("n")
    some = F.array_compact(F.array(F.when(n % 4 != 0, F.col("gold_intent")), F.when(n % 3 != 0, F.col("pred_intent")), F.when(n % 2 == 0, F.lit("other_a0")), F.when(n % 7 == 0, F.lit("other_a1"))))
    return m.withColumns({
        "candidates": F.array_distinct(some), "reasoned": F.array_compact(F.array(F.when(n % 5 != 0, F.col("pred_intent")), F.when(n % 6 != 0, F.lit("other_a0")))), "format_ok": n % 10 != 0,
        "gold_slots": F.array_distinct(F.transform("gold_entities", lambda e: e["type"])), "slot_candidates": F.array_distinct(F.transform("pred_entities", lambda e: e["type"])),
    })


CANDIDATES = f"""{MATCHED},
c AS (SELECT *, list_distinct(list_filter([CASE WHEN n % 4 <> 0 THEN gold_intent END, CASE WHEN n % 3 <> 0 THEN pred_intent END, CASE WHEN n % 2 = 0 THEN 'other_a0' END, CASE WHEN n % 7 = 0 THEN 'other_a1' END], lambda x: x IS NOT NULL)) AS candidates,
  list_filter([CASE WHEN n % 5 <> 0 THEN pred_intent END, CASE WHEN n % 6 <> 0 THEN 'other_a0' END], lambda x: x IS NOT NULL) AS reasoned, n % 10 <> 0 AS format_ok FROM m)"""

#: Shared, gold and predicted entities of each key, entities that repeat counted as often; s.n and the like are null for keys without any.
MULTISETS = """gm AS (SELECT key, type, filler, count(*) AS n FROM ge GROUP BY ALL), pm AS (SELECT key, type, filler, count(*) AS n FROM pe GROUP BY ALL),
ms AS (SELECT key, sum(g) AS golds, sum(p) AS preds, sum(least(g, p)) AS shared FROM (SELECT coalesce(gm.key, pm.key) AS key, coalesce(gm.n, 0) AS g, coalesce(pm.n, 0) AS p FROM gm FULL JOIN pm ON gm.key = pm.key AND gm.type = pm.type AND gm.filler = pm.filler) GROUP BY key)"""

#: Greedy matching by distance, a prediction a step: label, tp, fp, fn of every step and of every gold entity left. Needs WITH RECURSIVE.
GREEDY = """gl AS (SELECT key, coalesce(list({'t': gt, 'f': filler} ORDER BY pos, l_partkey, gt, filler) FILTER (pos <= 4), []) AS g, coalesce(list({'t': pt, 'f': filler} ORDER BY pos, l_partkey, pt, filler) FILTER (pos BETWEEN 2 AND 6), []) AS p FROM l GROUP BY key),
wk AS (
  SELECT key, kind, 0 AS i, range(1, len(g) + 1) AS rest, CAST(NULL AS STRUCT(d DOUBLE, i BIGINT)) AS best FROM gl CROSS JOIN (SELECT unnest(['word', 'char']) AS kind)
  UNION ALL
  SELECT key, kind, i, list_filter(rest, lambda x: b IS NULL OR x <> b.i), b FROM (
    SELECT w.key, kind, w.i + 1 AS i, rest, list_min(list_transform(list_filter(rest, lambda x: g[x].t = p[w.i + 1].t), lambda x: {'d': CASE WHEN kind = 'word' THEN CAST(g[x].f <> p[w.i + 1].f AS INT)::DOUBLE ELSE levenshtein(g[x].f, p[w.i + 1].f) / greatest(length(g[x].f), length(p[w.i + 1].f)) END, 'i': x})) AS b
    FROM wk AS w JOIN gl ON gl.key = w.key WHERE w.i < len(p))),
gc AS (
  SELECT key, kind, p[i].t AS label, CASE WHEN best IS NULL THEN 0.0 ELSE 1.0 END AS tp, CASE WHEN best IS NULL THEN 1.0 ELSE best.d END AS fp, CASE WHEN best IS NULL THEN 0.0 ELSE best.d END AS fn FROM wk JOIN gl USING (key) WHERE i > 0
  UNION ALL
  SELECT key, kind, g[x].t, 0.0, 0.0, 1.0 FROM (SELECT key, kind, unnest(rest) AS x, g FROM wk JOIN gl USING (key) WHERE i = len(p)))"""

#: Scores of a table of counts, as columns.
PRF = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1"""
PRF6 = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1"""
ACCURACIES = """count(*) AS n, round(avg(CAST(gold_scenario = pred_scenario AS INT)), 6) AS scenario_accuracy, round(avg(CAST(gold_action = pred_action AS INT)), 6) AS action_accuracy, round(avg(CAST(gold_intent = pred_intent AS INT)), 6) AS intent_accuracy"""
SUMS = "CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn"
