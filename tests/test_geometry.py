"""Groups, projections and sampled silhouettes of labelled vectors against plain recomputation."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from utterlake.operators import geometry, vocabulary

KIND = "vec_id long, label string, embedding array<float>"


def vectors(sizes, width=6, seed=3):
    r = np.random.default_rng(seed)
    names = [f"l{k}" for k, n in enumerate(sizes) for _ in range(n)]
    centres = {name: r.normal(size=width) * 2 for name in set(sorted(names))}
    return [(i, name, [float(x) for x in np.float32(centres[name] + r.normal(size=width))]) for i, name in enumerate(names)]


def test_projection_keeps_the_two_largest_variances(spark):
    rows = vectors([40, 25, 10])
    x = np.array([e for *_, e in rows])
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    got, shares = geometry.pca_2d(spark.createDataFrame(rows, KIND).repartition(4))
    assert got.columns == ["vec_id", "label", "embedding", "x", "y"]
    at = {r["vec_id"]: (r["x"], r["y"]) for r in got.collect()}
    flat = np.array([at[i] for i, *_ in rows])
    assert np.allclose(flat.mean(axis=0), 0, atol=1e-8) and np.allclose(np.cov(flat.T), np.diag(values[:2]), atol=1e-6)
    assert np.allclose(shares, values[:2] / values.sum(), atol=1e-8)


def test_groups_of_labels_are_a_fixed_point(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(4, 8)) * 20
    rows = [(k, f"l{k}", [float(x) for x in np.float32(centres[k % 4] + r.normal(size=8))]) for k in range(48)]
    found = vocabulary.kmeans_groups(spark.createDataFrame(rows, KIND), 4, 1).collect()
    groups = [[int(x[1:]) for x in g["labels"]] for g in found]
    assert sorted(k for g in groups for k in g) == list(range(48)) and all(g["labels"] == sorted(g["labels"]) for g in found)
    x = np.array([e for *_, e in rows])
    means = np.array([x[g].mean(axis=0) for g in groups])
    nearest = ((x[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert all(nearest[k] == i for i, g in enumerate(groups) for k in g)


def plain_silhouette(rows, most):
    h = lambda i: hashlib.md5(f"{i}|0".encode()).hexdigest()
    first = {name: min((i for i, n, _ in rows if n == name), key=h) for name in {n for _, n, _ in rows}}
    kept = sorted(rows, key=lambda r: (first[r[1]] != r[0], h(r[0])))[:most]
    x, names = np.array([e for *_, e in kept]), np.array([n for _, n, _ in kept])
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    score = {}
    for k, name in enumerate(names):
        own = names == name
        a = far[k, own].sum() / max(own.sum() - 1, 1)
        b = min(far[k, names == o].mean() for o in set(names) - {name})
        score.setdefault(str(name), []).append((b - a) / max(a, b) if own.sum() > 1 else 0.0)
    return {n: (len(s), float(np.mean(s))) for n, s in score.items()}


def test_silhouette_of_a_seeded_sample_has_a_row_of_every_class(spark):
    rows = vectors([60, 30, 9, 1])
    df = spark.createDataFrame(rows, KIND).repartition(5)
    for most in (7, 40, 1000):
        got = {r["label"]: (r["n"], r["silhouette"]) for r in geometry.silhouette_euclidean(df, most).collect()}
        want = plain_silhouette(rows, most)
        assert set(got) == set(want) == {"l0", "l1", "l2", "l3"} and sum(n for n, _ in got.values()) == min(most, 100)
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_distractors_come_from_near_labels_first(spark):
    from utterlake.operators import corpus

    labels = spark.createDataFrame([(x,) for x in "abcdefgh"], "label string")
    near = spark.createDataFrame([("a", ["b", "c", "d"]), ("b", ["h"])], "label string, neighbors array<string>")
    df = spark.createDataFrame([(k, "abz"[k % 3]) for k in range(60)], "key long, gold_intent string")
    h = lambda *p: hashlib.md5("|".join(map(str, p)).encode()).hexdigest()
    for neighbors, known in ((None, {}), (near, {"a": "bc", "b": "h"})):
        got = corpus.add_distractors(df, labels, 2, 5, neighbors=neighbors, nearest=2)
        assert got.columns == ["key", "gold_intent", "candidates"]
        for r in got.collect():
            others = sorted((x for x in "abcdefgh" if x != r["gold_intent"]), key=lambda x: (x not in known.get(r["gold_intent"], ""), h(r["key"], x, 5)))[:2]
            assert r["candidates"] == sorted([r["gold_intent"], *others], key=lambda x: h(r["key"], x, "5-order"))
    assert corpus.add_distractors(df.where(F.lit(False)), labels).count() == 0
