"""Objects in text, and the labels read from them, against plain rules written with Python's JSON reader."""

import json
import random

from pyspark.sql import functions as F

from utterlake.functions import objects, parsing


def closing(text, start):
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if escaped:
            escaped = False
        elif quoted:
            quoted, escaped = c != '"', c == "\\"
        elif c == '"':
            quoted = True
        else:
            depth += (c == "{") - (c == "}")
            if depth == 0:
                return text[start : i + 1]
    return None


def random_texts(n, seed):
    r = random.Random(seed)
    parts = ["{", "}", '"', "\\", "a", ":", ",", " ", '{"scenario": "s"}', '"action": "x y"', '{"intent": "p_q"}', "{{", "}}", '"entities": [', "]", '"final": ', "final: ", "é", "\n", "1", '{"final": {"action": "z"}}', "J: "]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_every_brace_and_what_lies_apart(spark):
    texts = random_texts(400, 1) + ['{"a": "}"} {"b\\"{": {}} {', "", "no"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", objects.objects(F.col("t")).alias("o"), objects.apart(objects.objects(F.col("t"))).alias("apart")).collect():
        t = r["t"]
        assert [(x["at"], x["object"]) for x in r["o"]] == [(i, closing(t, i)) for i, c in enumerate(t) if c == "{"]
        want, at = [], 0
        while at < len(t):
            found = closing(t, at) if t[at] == "{" else None
            want += [found] if found else []
            at += len(found) if found else 1
        assert r["apart"] == want


def test_the_first_object_is_the_one_a_reader_finds(spark):
    def plain(t):
        for i, c in enumerate(t):
            if c == "{":
                try:
                    found, end = json.JSONDecoder().raw_decode(t, i)
                    return t[i:end]
                except ValueError:
                    pass
        return None

    texts = random_texts(600, 2)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", objects.first_object(F.col("t")).alias("o")).collect()
    assert [r["o"] for r in got] == [plain(r["t"]) for r in got] and sum(r["o"] is not None for r in got) > 100


def test_only_whole_objects_count(spark):
    texts = ['{"a": 1}', ' {"a": {"b": []}} ', '{"a": 1}] {"b": 2}', '{"a": 1}} {"b": 2}', '{"a": 1}, {"b": 2}', '{"a": 1} x', "[{}]", "{'a': 1}", "", None, '{"a": 1}]: 3}', '{"a": 1}, "y": 2}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(objects.is_object(F.col("t"))).collect()]
    assert got == [True, True] + [False] * 10


def test_no_python_worker_reads_labels(spark):
    df = spark.createDataFrame([("x",)], "raw_output string").withColumns({"scenario": F.lit(""), "action": F.lit(""), "entities": F.array().cast("array<struct<type:string,filler:string>>")})
    for found in (df.select(parsing.parse_prediction_label("raw_output")), df.select(parsing.extract_final("raw_output")), parsing.recover_predictions(df, ["raw_output"])):
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_counts_are_seen_by_the_job_that_reads_the_rows(spark):
    rows = [("", "", None, 'J: {"intent": "a_b"}'), ("a", "b", None, "none"), (None, "x", [("t", "f")], '{"scenario": "s"}'), ("error", "e", None, None)]
    df = spark.createDataFrame(rows, "scenario string, action string, entities array<struct<type:string,filler:string>>, raw_output string")
    found, seen = parsing.observed_recovery(parsing.recover_predictions(df, ["raw_output"]))
    got = [tuple(r) for r in found.select("scenario", "action", "changed", "recovered", "unresolved").collect()]
    assert got == [("a", "b", True, True, False), ("a", "b", False, False, False), ("", "x", False, False, True), ("error", "e", False, False, True)]
    assert seen.get == {"rows": 4, "changed": 1, "recovered": 1, "unresolved": 2}
    assert parsing.recovery_stats(parsing.recover_predictions(df, ["raw_output"])).head().asDict() == seen.get
