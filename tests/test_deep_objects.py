"""Objects found by the pattern of balanced braces and, where they nest deeper than it goes, by folds: both give the same."""

import random

import pytest
from pyspark.sql import functions as F

from utterlake.functions import objects as O
from utterlake.functions import parsing as P

MARK = r"(?i)\bfinal\b\s*[:=]\s*"


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(3)
    pieces = ["{", "{", "}", '"', "\\", "a", "final: ", ' "k": ', '{"scenario": "s"}', '{"a": {"b": "}"}}', '{"x": "\\"{"}', ", "]
    rows = ["".join(draw.choice(pieces) for _ in range(draw.choice([3, 8, 20, 40]))) for _ in range(400)]
    rows += ['final: ' + '{"a": ' * k + '{"scenario": "deep"}' + "}" * k + " {}" for k in (1, O.DEPTH - 2, O.DEPTH - 1, O.DEPTH, O.DEPTH + 5)] + ["{" * 40, "{}" * 40, ""]
    return spark.createDataFrame(list(enumerate(rows)), "key int, t string").repartition(4)


def test_pattern_and_folds_agree(texts):
    t = F.col("t")
    slow = F.transform(O.objects(t), lambda b: F.coalesce(b["object"], F.lit("")))
    got = texts.select("t", O._deep(t).alias("deep"), O._at_braces(t).alias("fast"), slow.alias("slow"), O.objects_apart(t).alias("apart"), O.apart(O.objects(t)).alias("apart_slow"), O.objects_after(t, MARK).alias("after"), O.objects(t).alias("all")).collect()
    assert sum(r["deep"] for r in got) >= 3
    for r in got:
        assert r["deep"] or r["fast"] == r["slow"]
        assert r["apart"] == r["apart_slow"]


def test_labels_are_found_at_any_depth(texts):
    rows = [r for r in texts.where("t like '%deep%'").select(P.extract_final("t").alias("f"), O.first_object(F.col("t")).alias("o"), "t").collect()]
    assert len(rows) == 5 and all(r["o"] == r["t"][len("final: ") : -3] for r in rows)
    assert all(r["f"]["label"]["scenario"] == "deep" for r in rows)
