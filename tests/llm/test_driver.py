"""What comes to the driver, and how large the plans are that it holds."""

from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from utterlake.llm import mixing, toxicity


def sent(spark):
    """Bytes of the task results of each stage so far, by its number."""
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return {found.apply(k).stageId(): found.apply(k).resultSize() for k in range(found.size())}


def test_commonest_words_are_found_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_WORDS", 2000)
    all_words = ["".join(w) for w in product("ab", repeat=14)]
    texts = [" ".join(all_words[k::40]) for k in range(40)] + [" ".join(all_words[:1500])] * 3 + [" ".join(all_words[700:1000])]
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        seen = sent(spark)
        _, said = toxicity.corpus_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        most = max(n for k, n in sent(spark).items() if k not in seen)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    counts = Counter(w for t in texts for w in t.split())
    assert said == dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:2000])
    assert most < 2000 * 64


def test_mix_has_a_small_plan(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 90), "abc"[k % 3]) for k in range(600)], "doc_id long, text string, source string")
    found = mixing.mix(docs)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") < 8
    assert found.agg(F.sum("taken")).head()[0] > 0
