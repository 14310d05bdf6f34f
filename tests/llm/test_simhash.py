"""SimHash links against plain pairs, over rows that no mask, bucket or text may lose."""

import random
import re

import xxhash
from pyspark.sql import functions as F

from utterlake.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1 if words else 0))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(rows))]


def test_masks_cover_all_pairs_of_places():
    for masks, places in [(simhash.FIRST, range(64))] + [([m & ~simhash.FIRST[t] for m in row], simhash.left_out(simhash.FIRST[t])) for t, row in enumerate(simhash.SECOND)]:
        assert all(any(not m >> p & 1 and not m >> q & 1 for m in masks) for p in places for q in places)
    assert max(len(f) for k, f in simhash.FREE.items() if k % 8) <= 12


def test_links_hold_the_components_at_any_block(spark):
    rnd = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(40):
            values.add(x)
            for _ in range(rnd.randint(1, 3)):
                x ^= 1 << rnd.randrange(64)
    base = rnd.getrandbits(64)
    values |= {base ^ k for k in range(0, 512, 3)}  # one bucket full of members in several tables
    values = sorted(values)
    want = plain_components(list(enumerate(values)))
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    for block in (1024, 2):
        label = list(range(len(values)))
        place = {simhash.signed(v): i for i, v in enumerate(values)}
        edges = [(place[r["a"]], place[r["b"]]) for r in simhash.fingerprint_links(df, block).collect()]
        for _ in values:
            before = list(label)
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
            if before == label:
                break
        assert label == want


def test_texts_against_plain_pairs(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [None, "", " \t\n", "One", "one two", "ONE two three", "one two É é", "the same " * 3000]
    for _ in range(25):
        words = rnd.choices(vocabulary, k=rnd.randint(1, 150))
        texts.append(" ".join(words))
        for _ in range(rnd.randint(0, 3)):
            words = list(words)
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            texts.append("\t".join(words).upper())
    rows = [(i, t) for i, t in enumerate(texts)] + [(100_000 + i, t) for i, t in enumerate(texts[:9])] + [(None, texts[3]), (None, "nobody else has these words at all"), (5, texts[20])]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, fingerprint int")
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    want = sorted((d, simhash.signed(f), c) if d is not None else (-1, simhash.signed(f), c) for (d, f), c in zip(prints, plain_components(prints), strict=True))
    got = simhash.simhash(df).select(F.coalesce("doc_id", F.lit(-1)), "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.simhash(df.limit(0)).count() == 0


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op11_simhash(spark, sf).collect()}
    rows = [(d, plain_fingerprint(t)) for d, t in sorted(texts.items())]
    assert got == {d: (f"{f:016x}", c) for (d, f), c in zip(rows, plain_components(rows), strict=True)}
