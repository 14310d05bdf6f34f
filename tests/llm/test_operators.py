"""Each operator on small tables with the cases its docstring defines, against plain recomputation."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from utterlake.llm import bpe, exact_dedup, mixing, near_dedup, pieces, suffix_dedup, token_counts, token_files, topk, toxicity, url_filter
from utterlake.llm.common import scratch

SCHEMA = "doc_id long, text string, source string, host string, kept string"
LONG = " ".join(f"w{i * i % 997}" for i in range(4000))
TEXTS = [None, "", " \t\n ", "one two three four five six seven", "one  two three four five six seven", LONG, LONG, LONG + " end", "é漢字 <|endoftext|> don't 'll", "x"]


def docs(spark, texts=TEXTS, repeat=True):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, "h", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + (rows[3:4] if repeat else []), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    import re

    return re.sub(r"[\x20\x09-\x0d]+", " ", t or "")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    how = {"digest": lambda t: F.length(t).cast("string")} if weak else {}
    got = exact_dedup.exact_dedup(docs(spark), **how).collect()
    groups = collections.defaultdict(list)
    for r in docs(spark).collect():
        groups[norm(r["text"])].append(r["doc_id"])
    want = sorted((i, min(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    kept = exact_dedup.keep_first(docs(spark))
    assert kept.count() == len(groups) and kept.columns == docs(spark).columns


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/1", "https://example.org/en/19?x", "http://example.org/en/2", "http://x.com/fr/", "http://y.com/de/a#b", "http://badexample.org/es/", "http://spam-farm.net/", "http://a.cheap-pills.io/z", "http://z.net", "http://org", "a://b://c.org/es/"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls * 2)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(df).collect()}
    assert len(got) == 2 * len(urls)

    def want(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(r), r, v) for v, r in url_filter.SITE_RULES for h, p in [(r.split("/", 1)[0], "/" + r.split("/", 1)[1])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if "spam-farm" in host or "cheap-pills" in host else "allow")
        return host, path, rule, verdict

    assert all(got[i] == want(u) for i, u in enumerate(urls * 2))
    assert url_filter.url_filter(df.limit(0)).count() == 0


def test_bpe_round_trip_and_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    coded = bpe.encode(docs(spark))
    assert "kept" in coded.columns and "text" not in coded.columns
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in coded.collect()}
    assert all(got[i] == t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS))
    assert {r["doc_id"]: r["text"] for r in bpe.decode(coded).collect()} == {i: x or "" for i, x in enumerate(TEXTS)}
    assert bpe.digests(empty(spark)).count() == 0


def test_bpe_on_random_strings():
    from tokenizers import Tokenizer

    t, rnd = Tokenizer.from_file(bpe.vocabulary_path()), random.Random(5)
    texts = ["".join(rnd.choice("abst'’ relvmd  \n\téß漢ñ09٣½!.-😀\u0301\u2003REs") for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    ids, at = bpe.backtracking(bpe.vocabulary_path())(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark):
    from tokenizers import Tokenizer

    t, folder = Tokenizer.from_file(bpe.vocabulary_path()), scratch(spark, "test-tokens")
    token_files.write_tokens(docs(spark, repeat=False), folder)
    got = token_files.read_tokens(spark, folder).join(token_files.segment_starts(spark, folder), ["part", "seq"]).collect()
    start = 0
    for r, text in zip(sorted(got, key=lambda r: r["doc_id"]), TEXTS, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["before"] + r["at"] == start
        start += len(ids)
    empty_folder = scratch(spark, "test-tokens")
    token_files.write_tokens(empty(spark), empty_folder)
    assert token_files.read_tokens(spark, empty_folder).count() == 0


def test_null_identifiers_differ_from_minus_one(spark):
    df = spark.createDataFrame([(None, "a b"), (-1, "c"), (None, "d"), (5, None)], "doc_id long, text string")
    folder = scratch(spark, "test-nulls")
    token_files.write_tokens(df, folder)
    got = [r["doc_id"] for r in token_files.read_tokens(spark, folder).orderBy("part", "seq", "at").collect()]
    assert got == [None, None, -1, 5]
    token_counts.write_flat(df, f"{folder}-flat", size=2)
    names = token_counts.document_names(spark, f"{folder}-flat", 2).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in names) == [(False, -1), (False, 5), (True, 0), (True, 0)]


@pytest.mark.parametrize("kind", ["own", "library"])
def test_known_pieces_are_forgotten_and_found_again(kind):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    t, rnd = Tokenizer.from_file(path), random.Random(11)
    encoder = pieces.Encoder(bpe.vocabulary(path).encode_all, bpe.vocabulary(path).specials, most_kept=400) if kind == "own" else pieces.Encoder(token_files.library(path).memo.of, bpe.vocabulary(path).specials, most_kept=400)
    pool = [*"abst'’ relvmdLL  \n\t\r\u00a0\u3000éß漢ñ09٣½!.-😀\u200bREs\x85\x00", "<|endoftext|>", "'ll", " the", "don't", "<|endof"]
    for _ in range(6):
        texts = ["".join(rnd.choice(pool) for _ in range(rnd.choice([0, 1, 2, 5, 30]))) for _ in range(200)]
        ids, at = encoder(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packed_blocks():
    rnd = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.full(300, 7, np.uint32), rnd.integers(0, 2**32, 1000, dtype=np.uint32), np.where(rnd.random(5000) < 0.02, 4_000_000_000, rnd.integers(0, 9, 5000)).astype(np.uint32)):
        data = token_files.segment(pa.array([3]), np.array([len(ids)]), ids)
        _, counts, n, sections = token_files.parts_of(data)
        assert counts.tolist() == [len(ids)] and token_files.unpack(sections, n).tolist() == ids.tolist()
        if len(ids) > 256:
            assert token_files.unpack(sections, n, 1, 2).tolist() == ids[128:256].tolist()


def test_token_counts(spark):
    end = token_counts.END
    stream = [1, 2, end, end, 3] + [4] * 10 + [end, 5, 6]
    for size in (1, 2, 3, 5, 100):
        blocks = [(0, k, np.array(stream[i : i + size], "<u2").tobytes()) for k, i in enumerate(range(0, len(stream), size))]
        got = sorted(tuple(r) for r in token_counts.count_tokens(spark.createDataFrame(blocks, "file int, block int, data binary")).collect())
        assert got == [(0, 0, 0, 2, True), (0, 1, 3, 0, True), (0, 2, 4, 11, True), (0, 3, 16, 2, False)]
    folder = scratch(spark, "test-flat")
    token_counts.write_flat(docs(spark), folder, size=7)
    counts = token_counts.count_tokens(spark.read.schema("file int, block int, data binary").parquet(f"{folder}/kind=tokens"))
    got = counts.join(token_counts.document_names(spark, folder, 7), ["file", "number"]).collect()
    code = token_counts.encoding(token_counts.VOCABULARY)
    assert len(got) == len(TEXTS) + 1 and all(r["n_tokens"] == len(code.encode_ordinary(TEXTS[r["doc_id"]] or "")) for r in got)


def test_mixing(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join("w" * rnd.randint(1, 5) for _ in range(rnd.choice([0, 3, 40, 900]))), rnd.choice(["a", "b", "b", "b", "c", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 300 and all(r["size"] == len(rows[r["doc_id"]][1].split()) and r["taken"] <= 3 * r["size"] for r in got)
    names = ["a", "b", "c", None]
    sizes = [sum(r["size"] for r in got if r["source"] == s) for s in names]
    targets = mixing.capped_shares(sizes, [1, 2, 3, 1])
    assert abs(sum(targets) - sum(sizes)) < 1e-6 and all(t <= 3 * s + 1e-9 for t, s in zip(targets, sizes))
    for s, t in zip(names, targets):
        own = [r for r in got if r["source"] == s]
        assert abs(own[0]["target"] - t) < 1e-6 and abs(sum(r["taken"] for r in own) - t) <= mixing.BLOCK + 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(docs(spark)).count() == len(TEXTS) + 1
    assert mixing.mixed(docs(spark)).columns == docs(spark).columns


def test_mixing_word_by_word(spark, monkeypatch):
    """Targets, quotas seat by seat and taken words again from the rule, with several shards in every source."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 700)
    rnd, block, most, seed = random.Random(3), 8, 3, 17
    table = [(i, " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.choice([0, 3, 40, 90]))), rnd.choice(["a", "b", "b", "b", "b", "c", None])) for i in range(400)]
    df = spark.createDataFrame(table, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(df, block=block).collect()}
    order, weights = ["a", "b", "c", None], [1.0, 2.0, 3.0, 1.0]
    size = {s: sum(len(t.split()) for _, t, x in table if x == s) for s in order}
    left, target, open_ = float(sum(size.values())), {}, list(order)
    while True:
        share = {s: left * weights[order.index(s)] / sum(weights[order.index(x)] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * size[s]]
        target |= {s: most * size[s] for s in over} if over else share
        if not over:
            break
        open_, left = [s for s in open_ if s not in over], left - sum(most * size[s] for s in over)

    def seats(ideal, n, limits):
        given = [0] * len(ideal)
        for _ in range(n):
            free = [i for i in range(len(ideal)) if given[i] < limits[i]]
            if free:
                given[max(free, key=lambda i: (ideal[i] / (2 * given[i] + 1), -i))] += 1
        return given

    quota = dict(zip(order, seats([target[s] for s in order], round(sum(target.values()) / block), [most * -(-size[s] // block) for s in order])))
    keys = df.select("doc_id", F.xxhash64("doc_id", F.lit(seed)).alias("a"), F.xxhash64("doc_id", F.lit(seed + 1)).alias("b")).collect()
    n_shards = {s: max(1, -(-size[s] // 700)) for s in order}
    assert min(n_shards.values()) > 1
    source = {i: (s, len(t.split())) for i, t, s in table}
    shards = {}
    for r in sorted(keys, key=lambda r: (r["b"], r["doc_id"])):
        s, n = source[r["doc_id"]]
        shards.setdefault((s, r["a"] % n_shards[s]), []).append((r["doc_id"], n))
    for s in order:
        names = sorted(k for x, k in shards if x == s)
        words = [sum(n for _, n in shards[s, k]) for k in names]
        given = seats([quota[s] * w / size[s] for w in words], quota[s], [most * -(-w // block) for w in words])
        for k, n_words, share in zip(names, words, given):
            offset = spark.range(1).select(F.xxhash64(F.lit(s).cast("string"), F.lit(k).cast("long"), F.lit(seed + 2))).head()[0]
            full, goal = n_words // block, share * block
            rounds = min(most, goal // n_words) if n_words else 0
            more = 0 if rounds >= most or not n_words else int((goal - rounds * n_words) / block + 0.5)
            ranks = {b: (b * mixing.STRIDE + offset % max(full, 1)) % max(full, 1) for b in range(full)}
            at = 0
            for i, n in shards[s, k]:
                want = sum(rounds + (ranks[w // block] < more if w // block < full else more > full) for w in range(at, at + n))
                at += n
                assert (got[i]["taken"], got[i]["size"], got[i]["source_size"]) == (want, n, size[s]), (s, k, i)
                assert abs(got[i]["target"] - target[s]) < 1e-6


def test_highest_quotients_seat_by_seat():
    rnd = random.Random(4)
    for _ in range(50):
        targets, seats = [rnd.choice([1.0, 2.0, 3.7, 9.1]) for _ in range(rnd.randint(1, 6))], rnd.randint(0, 40)
        got = [0] * len(targets)
        for _ in range(seats):
            got[max(range(len(targets)), key=lambda i: (targets[i] / (2 * got[i] + 1), -i))] += 1
        assert mixing.highest_quotients(targets, seats) == got


def test_top_k(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(120, 24)) / 5)] + [(200, [0.5] * 24), (201, [0.5] * 24), (250, None), (300, [float("nan")] * 24), (350, [None] * 24), (400, [1.0] * 3), (450, [])]
    got = collections.defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_block=2, row_block=16).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    sound = {i: np.floor(256 * np.array(v)) for i, v in rows if v and len(v) == 24 and None not in v and np.isfinite(v).all()}
    for q in (0, 50, 100, 200):
        best = sorted((-int(sound[q] @ v), i) for i, v in sound.items() if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == {0, 50, 100, 200}


def near_classes(rows, threshold=0.8):
    bags = {i: collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").split()) else None for i, t in rows}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def similarity(a, b):
        every = set(a) | set(b)
        return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in a if d in b)

    for i in bags:
        for j in bags:
            if i < j and bags[i] and bags[j] and set(bags[i]) & set(bags[j]) and similarity(bags[i], bags[j]) >= threshold:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in bags}


@pytest.mark.parametrize("block", [2, 4096])
def test_near_dedup(spark, block):
    rnd = random.Random(6)
    base = [[f"w{rnd.randint(0, 60)}" for _ in range(60)] for _ in range(4)]
    rows = list(enumerate([None, "", "a b", "a b", LONG]))
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                w[rnd.randrange(60)] = f"z{rnd.randint(0, 5)}"
            rows.append((len(rows), " ".join(w)))
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == near_classes(rows)
    assert all(r["kept"] == (r["class_id"] == i) for i, r in got.items())


def test_near_dedup_edges(spark):
    assert near_dedup.near_dedup(empty(spark)).count() == 0
    assert near_dedup.near_dedup(docs(spark)).count() == len(TEXTS) + 1
    kept = near_dedup.keep_representatives(docs(spark))
    assert kept.columns == docs(spark).columns and kept.where("doc_id = 4").count() == 0


def test_repeated_spans(spark):
    rnd = random.Random(8)
    line = "the passage that many documents share, more than fifty bytes long "
    texts = [line, "x" + line * 3, "é" * 40 + line[:49], "ab" * 60, "ab" * 45, None, ""] + ["".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 150))) + rnd.choice(["", line, line[5:60]]) for _ in range(60)] + [LONG, "q" + LONG]
    seen, want = {}, {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if b[s : s + 50] in seen:
                gone[s : s + 50] = b"\1" * 50
        for s in range(len(b) - 49):
            seen.setdefault(b[s : s + 50], i)
        want[i] = bytes(x for x, g in zip(b, gone) if not g)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_spans(df).collect()}
    assert {i: bytes(r["kept"]) for i, r in got.items()} == want
    assert all(r["n_bytes"] - sum(s["end"] - s["start"] for s in r["spans"]) == len(r["kept"]) for r in got.values())
    assert suffix_dedup.repeated_spans(empty(spark)).count() == 0 and suffix_dedup.repeated_spans(docs(spark)).count() == len(TEXTS) + 1


def test_repeated_spans_in_few_files(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 200)
    line = "the passage that many documents share, more than fifty bytes long "
    df = spark.createDataFrame([(i if i % 4 else None, f"{i} {line * (i % 3)}") for i in range(40)], "doc_id long, text string")
    key = "spark.sql.sources.bucketing.maxBuckets"
    want = sorted((r["doc_id"] or -1, r["n_bytes"], bytes(r["kept"])) for r in suffix_dedup.repeated_spans(df).collect())
    spark.conf.set(key, 2)
    try:
        got = sorted((r["doc_id"] or -1, r["n_bytes"], bytes(r["kept"])) for r in suffix_dedup.repeated_spans(df).collect())
    finally:
        spark.conf.unset(key)
    assert got == want and len(got) == 40 and any(len(k) < n for _, n, k in got)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("repeats_")]


def test_identifiers_of_lists():
    for docs in ([], [0, 5, 2**32 - 2], [3, suffix_dedup.LAST], [2**32 - 1, 1], [-1, 4], [2**60, suffix_dedup.LAST]):
        assert suffix_dedup.longer(suffix_dedup.short(np.array(docs, np.int64)), len(docs)).tolist() == docs


def test_names_alike_in_64_bits():
    names = np.array([5, 5, 9, 5], np.uint64), np.array([1, 2, 1, 1], np.uint32)
    (found, more), least, number = suffix_dedup.least_of(names, np.array([4, 3, 2, 1]))
    assert (found.tolist(), more.tolist(), least.tolist(), number.tolist()) == ([5, 5, 9], [1, 2, 1], [1, 3, 2], [0, 1, 2, 0])


def test_toxicity(spark):
    rnd = random.Random(9)
    bad = ["idiot", "moron", "scum"]
    texts = [" ".join([rnd.choice(["the", "that", "tired", "mother", "story", "radio"]) for _ in range(30)] + ([rnd.choice(bad)] if i % 5 == 0 else [])) for i in range(400)]
    texts += ["you 1d10t the", "an i.d.i.o.t that", "m o r o n the", "looked tired", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, labels).collect()}
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got.values())
    right = [r["predicted"] == int(i % 5 == 0) for i, r in got.items() if i < 400 and r["held_out"]]
    assert sum(right) / len(right) > 0.95
    assert [got[400 + k]["predicted"] for k in range(6)] == [1, 1, 1, 0, 0, 0]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    assert toxicity.toxicity(docs(spark), labels.limit(0)).count() == len(TEXTS) + 1


def test_toxicity_reads_spacing_and_edge_signs(spark):
    rnd = random.Random(9)
    bad = ["idiot", "moron", "scum", "loser", "shit"]
    texts = [" ".join([rnd.choice(["the", "that", "a", "tired", "mother", "story", "radio"]) for _ in range(30)] + (["a", rnd.choice(bad), rnd.choice(bad)] if i % 5 == 0 else [])) for i in range(400)]
    hidden = ["a l o s e r the", "the i d i o t m o r o n", "i d 1 o t that", "the m 0 r o n", "i d i i i i o t that", "!diot that", "the shi+", "(!diot)", "that i d i o t!", "2 m o r o n", "! d 1 o t", "1 d 1 0 t that", "the 1 d 1 o t", "i-d-i-o-t", "iiidiot"]
    clean = ["the radio!", "(that story", "a 1 b 2", "1 2 3 4 5", "t h e r a d i o", "+ ! | *", "| tired | mother |"]
    df = spark.createDataFrame(list(enumerate(texts + hidden + clean)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(df, labels).collect()}
    assert [t for k, t in enumerate(hidden) if not got[400 + k]] == []
    assert [t for k, t in enumerate(clean) if got[400 + len(hidden) + k]] == []


def test_channel_breaks_runs_of_any_length():
    counts = toxicity.np.zeros((27, 27, 27))
    text = " a loser idiot moron " * 50
    at = [toxicity.letter(c) for c in text]
    for x, y, z in zip(at, at[1:], at[2:], strict=False):
        counts[x, y, z] += 1
    channel = toxicity.Channel(counts)
    assert channel.spaced(list("aloser")) == ["a", "loser", "aloser"]
    assert channel.spaced(list("m0ronid1ot"))[:2] == ["moron", "idiot"]
    assert channel.spaced(list("idiot" * 4000))[:4000].count("idiot") == 1
    assert channel.readings("!diot") == ["diot", "idiot"] and channel.readings("idiot") == ["idiot"]


def cheapest_row(channel, run):
    """All ways to spell the run as words of the dictionary and strays, one by one."""
    best = (float("inf"), None)

    def go(at, word, cost, found):
        nonlocal best
        if at == len(run):
            if not word and cost < best[0]:
                best = (cost, found)
            return
        c = run[at]
        if not word:
            go(at + 1, "", cost + toxicity.STRAY_COST, [*found, (c, False)])
        ways = [(c, 0.0)] if c.isalpha() else [*((x, toxicity.SIGN_COST) for x in toxicity.SIGNS.get(c, "")), ("", toxicity.DROP_COST)]
        if run[at : at + 3] == c * 3 and c.isalpha():
            ways.append(("", toxicity.DROP_COST))
        for out, more in ways:
            grown = word + out
            if any(w.startswith(grown) for w in channel.price):
                go(at + 1, grown, cost + more, found)
                if grown in channel.price:
                    go(at + 1, "", cost + more + channel.price[grown], [*found, (grown, True)])

    go(0, "", 0.0, [])
    return best[0], best[1]


@pytest.mark.parametrize("run", ["aloser", "xaloser", "loserq", "1d1ot", "id!ooot", "a.loser", "qqq", "!", "", "al0ser2", "idioteidiot"])
def test_known_words_are_the_cheapest_row(run):
    channel = toxicity.Channel(np.zeros(27**3), {"a": 50, "loser": 2, "los": 9, "er": 9, "idiot": 2, "e": 5, "idi": 1})
    _, row = cheapest_row(channel, run)
    joined, stray = [], ""
    for word, known in row:
        if known:
            joined += [w for w in (stray, word) if w]
        stray = "" if known else stray + word
    assert channel.known_words(run) == joined + [stray] * bool(stray)


def test_channel_breaks_by_words_of_the_documents(spark):
    """With the counts of the documents table: marks among other one-letter words, and next to each other."""
    channel = toxicity.Channel(*toxicity.corpus_counts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    for text, hidden in [("a l o s e r", ["a", "loser"]), ("y o u i d 1 o t", ["idiot"]), ("s t u p i d f o o l", ["stupid", "fool"]), ("1 d 1 o t !", ["idiot"])]:
        assert set(hidden) <= set(channel.spaced(text.split())), text
    long = channel.known_words("aloser" * 3000)
    assert long == ["a", "loser"] * 3000


def test_counts_are_those_of_all_whole_texts(spark):
    texts = ["The the, (THE) x1 tired", None, "", "the " * 5000, "ñu ÑU naïve", "a" * 70]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    trigrams, said = toxicity.corpus_counts(frame)
    plain, letters = collections.Counter(), collections.Counter()
    for t in texts:
        for w in (t or "").split():
            w = w.lower().strip(toxicity._EDGES)
            if w.isalpha() and len(w) <= toxicity.LONGEST_WORD:
                plain[w] += 1
        at = [0, *(toxicity.letter(c.lower()) for c in t or ""), 0]
        letters.update((x * 27 + y) * 27 + z for x, y, z in zip(at, at[1:], at[2:], strict=False))
    assert said == plain
    for x in range(27):
        for y in range(27):
            a = trigrams[(x * 27 + y) * 27 : (x * 27 + y + 1) * 27].tolist()
            if x and y:  # trigrams that no text's edge takes part in
                assert a == [letters[(x * 27 + y) * 27 + z] for z in range(27)]


def test_scores_recomputed_word_by_word(spark):
    """Scores of documents from the learned weights, by a plain loop over words, runs and features."""
    import math
    import re

    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "y o u i d 1 o t"), (-4, "!d1ot, (the) l o s e r"), (-5, "é " * 3000), (-5, "idiot")], frame.schema)
    frame = frame.unionByName(odd)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    teachers = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    channel = toxicity.Channel(*toxicity.corpus_counts(teachers))
    weights, base = toxicity.learned(teachers, labels, channel)
    channel.price_words([f[1:] for f in weights if f[0] == "=" and f[1:].isalpha()])
    assert weights

    def plain(text):
        names, run = set(), []
        tokens = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0d]+", text or "")]
        for token in [*tokens, ""]:
            low = token.lower()
            one = low.strip(toxicity._EDGES) or low.strip(toxicity._PLAIN)
            if len(one) == 1 and (one.isalpha() or one in toxicity.SIGNS):
                run.append(low)
            else:
                if len(run) >= toxicity.LEAST_SPACED and any(map(str.isalpha, "".join(run))):
                    names |= set(channel.spaced(run))
                run = []
            names |= set(channel.readings(low)) if token else set()
        marks = {f for n in names if n for f in [f"={n}", *[n[:k] for k in (4, 5, 6) if len(n) > k]] if f in weights}
        return 1 / (1 + math.exp(-(base + sum(weights[f] for f in marks))))

    got = sorted((r["doc_id"], r["score"]) for r in toxicity.score(frame, weights, base, channel).collect())
    wanted = sorted((r["doc_id"], plain(r["text"])) for r in frame.collect())
    assert [i for i, _ in got] == [i for i, _ in wanted]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, wanted, strict=True))
    assert sum(s > 1 / (1 + math.exp(-base)) + 1e-9 for _, s in wanted) > 5


def test_mixing_spreads_rows_without_an_identifier(spark, monkeypatch):
    """10,000 rows of null identifier and one text in one source: they are dealt over its shards, and the source meets its target."""
    rows = [(None, "one two three four five six seven eight nine ten", "a")] * 10_000 + [(i, f"v{i} " * 30, "b") for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    placed = frame.withColumn("at", F.monotonically_increasing_id()).groupBy("doc_id", F.pmod(mixing.drawn(mixing.SEED), F.lit(20)).alias("shard")).count()
    assert max(r["count"] for r in placed.collect()) < 700  # 500 on average
    monkeypatch.setattr(mixing, "SHARD_WORDS", 5000)
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    for source in "ab":
        mine = [r for r in got if r["source"] == source]
        # Quotas are whole blocks, and each shard rounds what it takes to the nearest block.
        shards = -(-mine[0]["source_size"] // 5000)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= mixing.BLOCK * (1 + shards / 2)
