"""Distances, greedy choices, quantiles and sign flips against plain recomputation."""

import random

import numpy as np
from pyspark.sql import functions as F

from utterlake.functions import distance, spans
from utterlake.operators import errors, geometry, quantiles


def edits(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return d[-1][-1]


def error_rate(reference, hypothesis):
    return edits(reference, hypothesis) / len(reference) if reference else float(bool(hypothesis))


def plain_distance(gold, pred, kind):
    if kind == "char":
        return edits(gold, pred) / max(len(gold), len(pred)) if gold or pred else 0.0
    return error_rate(gold.split(), pred.split())


def plain_greedy(gold, pred, kind):
    left, out = list(gold), []
    for t, f in pred:
        options = [(plain_distance(g[1] or "", f or "", kind), k) for k, g in enumerate(left) if g[0] == t]
        if options:
            d, k = min(options)
            left.pop(k)
            out.append((t, 1.0, d, d))
        else:
            out.append((t, 0.0, 1.0, 0.0))
    return out + [(t, 0.0, 0.0, 1.0) for t, _ in left]


def test_greedy_counts_of_rows(spark):
    r = random.Random(4)
    entity = lambda: (r.choice(["t", "u", None]), r.choice([None, "", "a b", "b", "a  c", "é漢", "abc", "abd c"]))
    table = [([entity() for _ in range(r.randint(0, 4))], [entity() for _ in range(r.randint(0, 4))]) for _ in range(150)]
    e = "array<struct<type:string,filler:string>>"
    df = spark.createDataFrame(table, f"gold_entities {e}, pred_entities {e}")
    for kind in ("word", "char"):
        got = [[tuple(x) for x in row[0]] for row in df.select(spans.greedy_counts("gold_entities", "pred_entities", kind)).collect()]
        for found, (gold, pred) in zip(got, table, strict=True):
            want = plain_greedy(gold, pred, kind)
            assert [x[0] for x in found] == [x[0] for x in want] and np.allclose([x[1:] for x in found], [x[1:] for x in want]) if want else found == []
    plan = distance.slu_f1(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert {x["label"] for x in distance.slu_f1(df.limit(0)).collect()} <= {"overall"}


def test_rates_of_tokens_against_plain_edits(spark):
    r = random.Random(3)
    text = lambda: r.choice([None, "", " ".join(r.choice(["Ab", "c", "é", "dd", "漢字"]) for _ in range(r.randint(0, 6))) + r.choice(["", "  ", "\t x"])])
    pairs = [(text(), text()) for _ in range(200)] + [(" ".join(f"w{i}" for i in range(300)), " ".join(f"w{i * 2}" for i in range(250)))]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", distance.wer("a", "b").alias("w")).collect()
    words = lambda t: (t or "").lower().split()
    assert all(abs(x["w"] - error_rate(words(x["a"]), words(x["b"]))) < 1e-12 for x in got)
    phones = spark.createDataFrame([("tʃ/a", "tʃ a", 0.0), ("[ab]", "/ac/", 0.5), ("/", "", 0.0), ("", "a", 1.0), ("tʃ a o", "tʃ o", 1 / 3), (None, None, 0.0)], "a string, b string, want double")
    assert all(abs(x["p"] - x["want"]) < 1e-12 for x in phones.select("want", distance.per("a", "b").alias("p")).collect())


def test_the_farthest_hypotheses_come_next(spark):
    def plain(found, k):
        unique = {}
        for t in found:
            unique.setdefault(" ".join(t.lower().split()), t)
        rest = list(unique.items())
        if len(rest) <= k:
            return [t for _, t in rest]
        chosen = [rest.pop(0)]
        while len(chosen) < k:
            chosen.append(rest.pop(max(range(len(rest)), key=lambda i: (min(edits(rest[i][0], c[0]) for c in chosen), -i))))
        return [t for _, t in chosen]

    r = random.Random(9)
    lists = [[r.choice([None, "", "A b", "a  B", "abc", "ab", "x", "xyz é", "q q q", "漢字 x"]) for _ in range(r.randint(0, 9))] for _ in range(120)] + [None]
    df = spark.createDataFrame([(x,) for x in lists], "n array<string>")
    for k in (0, 1, 2, 4):
        got = [x[0] for x in df.select(spans.diverse_nbest("n", k)).collect()]
        assert got == [plain([t for t in x or [] if t is not None], k) if k else [] for x in lists]


def test_quantiles_of_many_values(spark):
    r = np.random.default_rng(2)
    values = {"a": np.round(r.normal(0, 1e6, 3000), 1), "b": np.repeat(0.25, 500), "c": r.exponential(1e-9, 700), "d": np.array([3.0])}
    rows = [(g, float(x), float(-x)) for g, v in values.items() for x in v] + [("a", None, 1.0), ("e", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    points = (0.0, 0.1, 0.5, 0.9, 1.0)
    for most in (1_000_000, 40):
        got = {(q["g"], q["name"]): q["values"] for q in quantiles.exact_quantiles(df, ["x", "y"], points, ["g"], most).collect()}
        for g, v in values.items():
            assert np.allclose(got[g, "x"], np.quantile(v, points), rtol=1e-12, atol=0)
            assert np.allclose(got[g, "y"], np.quantile(np.append(-v, 1.0) if g == "a" else -v, points), rtol=1e-12, atol=0)
        assert set(got) == {(g, c) for g in values for c in "xy"}
    whole = quantiles.exact_quantiles(df, ["x"], (0.25,), (), 40).head()["values"]
    assert np.allclose(whole, np.quantile(np.concatenate(list(values.values())), 0.25))


def test_edges_of_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.5, 3.0, None)], "wer double")
    assert np.allclose(errors.quantile_edges(df, "wer", 10), [0.0, 0.1 + 0.1 * 2 / 3, 0.3, 1.0]) and errors.quantile_edges(df.where("wer > 2"), "wer", 3) == []
    assert errors.linear_edges(0.3) == [0.0, 0.3, 0.6, 0.9, 1.0] and errors.linear_edges(0.25) == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert np.allclose(errors.log_edges(df, "wer", 3), [0.0, 0.1, 0.1 * 10**0.5, 1.0]) and errors.log_edges(df.where("wer > 2"), "wer", 3) == [0.0, 1.0]
    binned = errors.wer_bins(df, errors.linear_edges(0.3)).select("wer", "bin", "high").collect()
    assert sorted((x["wer"], x["bin"], x["high"]) for x in binned if x["high"]) == [(0.1, 0, 0.3), (0.2, 0, 0.3), (0.5, 1, 0.6)] and [x["bin"] for x in binned if x["high"] is None] == [4]


def test_bias_and_graph_keep_what_matters(spark):
    pairs = [("a", "b")] * 97 + [("a", "z")] * 2 + [("b", "b")] * 400 + [("a", "c")]
    df = spark.createDataFrame([(g, p) for g, p in pairs], "gold_intent string, pred_intent string")
    assert [x["label"] for x in errors.frequency_bias(df, n=1).collect()] == ["b"]
    many = spark.createDataFrame([("a", "b")] * 1095 + [("c", "d")] * 5, "gold_intent string, pred_intent string")
    assert {(x["gold"], x["pred"]) for x in errors.error_graph(many).collect()} == {("a", "b"), ("c", "d")}


def test_flipped_signs(spark):
    r = random.Random(6)
    table = [(k, r.random(), r.random() * 0.9 + 0.01) for k in range(300)]
    df = spark.createDataFrame(table, "key long, a double, b double")
    got = geometry.paired_test(df.repartition(3), 150, 7).head()
    key = np.array([x[0] for x in df.select(F.xxhash64("key")).collect()], np.int64).astype(np.uint64)
    d = np.array([a - b for _, a, b in table])
    one = np.array([geometry.sign_sums(key[i : i + 1], np.ones(1), 150, 7) for i in range(len(d))])
    assert set(np.unique(one)) == {-1.0, 1.0} and abs(one.mean()) < 0.02 and abs(np.corrcoef(one[:, 0], one[:, 70])[0, 1]) < 0.2
    means, seen = (one * d[:, None]).sum(axis=0) / len(d), d.mean()
    p = lambda c: (c.sum() + 1) / 151
    assert np.allclose([got["p_value"], got["p_lower"], got["p_upper"]], [p(abs(means) >= abs(seen)), p(means <= seen), p(means >= seen)])
    a, b = np.array(table)[:, 1], np.array(table)[:, 2]
    assert np.allclose([got[c] for c in ("median_a", "median_b", "difference_median", "ratio_median", "ratio_p10", "ratio_p90")], [np.median(a), np.median(b), np.median(d), *np.percentile(a / b, [50, 10, 90])])
    again = geometry.paired_test(df.repartition(8), 150, 7).head()
    assert got["p_value"] == again["p_value"]
