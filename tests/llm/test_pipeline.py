import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from utterlake.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_only_drop(spark):
    docs = table(spark, SF, "documents")
    columns, ids = set(docs.columns), {r[0] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, SF), f"test-{k}")
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now and now <= ids, name
        ids = now
        if k < len(corpus_pipeline.STAGES) - 1:
            assert set(docs.columns) == columns, name
    assert docs.where("n_tokens IS NULL").count() == 0


def run(spark, docs):
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        docs = written(stage(spark, docs, SF), f"test-{k}")
        ids.append([r["doc_id"] for r in docs.select("doc_id").collect()])
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    return docs, ids


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_go_through_all_stages(spark, empty):
    """Null, empty, very long and repeated texts, null and repeated identifiers, no rows, and columns called like inner ones."""
    base = table(spark, SF, "documents")
    kinds = dict(base.dtypes)
    long = " ".join(f"word{i * i % 7919}" for i in range(60_000))
    odd = [(9_000_001, None), (9_000_002, ""), (9_000_003, " \n "), (9_000_004, long), (9_000_005, long + " end"), (9_000_006, long), (None, "no name here"), (None, None), (9_000_007, "x"), (9_000_007, "x"), (9_000_007, "y z")]
    rows = spark.createDataFrame(odd, "doc_id long, text string")
    for c, t in kinds.items():
        if c not in ("doc_id", "text"):
            rows = rows.withColumn(c, F.lit(None).cast(t))
    docs = base.unionByName(rows.select(*base.columns)).withColumns({c: F.lit(1) for c in ("__id", "__own_id", "__times", "__copy", "class_id", "taken", "score", "g")})
    out, ids = run(spark, docs.limit(0) if empty else docs)
    if empty:
        assert ids == [[]] * 5
        return
    toxic, copies, near, mixed, coded = ids
    assert {i for i, _ in odd} <= set(toxic)  # nothing in them is toxic
    assert {9_000_001, 9_000_003, 9_000_004, 9_000_005, None} <= set(copies) and not {9_000_002, 9_000_006} & set(copies)
    assert copies.count(9_000_007) == 2 and copies.count(None) == 1  # two texts of one identifier; the null text has an earlier copy
    assert {9_000_001, 9_000_003, 9_000_004, 9_000_007, None} <= set(near) and 9_000_005 not in near
    assert set(mixed) <= set(near) and {9_000_001, 9_000_003} <= set(mixed) and sorted(map(str, coded)) == sorted(map(str, mixed))
    assert out.where("n_tokens IS NULL").count() == 0
