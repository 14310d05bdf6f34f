"""Alignment against both libraries and all pairs of tokens, over texts that break one side or repeat."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from utterlake.llm import alignment
from utterlake.llm.bpe import byte_letters, vocabulary_path

NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [None, "", " ", "a", "Hello world", "Hello world", "  two  blanks ", "line\nbreak\ttab\r", "naïve café – 漢字 😀́", "it's<|endoftext|>here", "<s> </s> <unk> <0x0A>", "under▁score ▁", " nb sp", "ﬁ ﬂ ½", "\x00\x01", "x" * 300, "12345 67,890.12", "very long words " * 2000]


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(vocabulary_path(alignment.FIRST))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(alignment.SECOND))
    letters = byte_letters()

    def a(text):
        ids = one.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in ids]

    def b(text):
        names = [(i, two.id_to_piece(i)) for i in two.encode(text)]
        return [(i, bytes([int(x[3:5], 16)]) if len(x) == 6 and x.startswith("<0x") else x.replace("▁", " ").encode()) for i, x in names]

    return a, b


def plain(rows, sides):
    cut, counts = [], Counter()
    for text in rows:
        tokens = [[], []]
        if text:
            tokens = [side(text) for side in sides]
            if any(b"".join(t for _, t in side) != b" " + text.encode() for side in tokens):
                tokens = [[], []]
        spans = []
        for side in tokens:
            at, found = 0, []
            for i, t in side:
                found.append((i, at, at + len(t)))
                at += len(t)
            spans.append(found)
        links, j0 = [], 0
        for i, s, e in spans[0]:
            while j0 < len(spans[1]) and spans[1][j0][2] <= s:
                j0 += 1
            for j, s2, e2 in spans[1][j0:]:
                if s2 >= e:
                    break
                links.append((i, j))
        counts.update(links)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, before = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if s >= before and e <= end) for side in spans) if len(ends) < 200 else None)
            before = end
        if ends and groups[0] is None:
            place = {e: k for k, e in enumerate(ends)}
            held = [[[], []] for _ in ends]
            for n, side in enumerate(spans):
                k = 0
                for i, s, e in side:
                    held[k][n].append(str(i))
                    k += e in place
            groups = ["|".join(map(",".join, x)) for x in held]
        cut.append((len(spans[0]), len(spans[1]), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(a, b, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest) for a, b, g, links, digest in cut]


@pytest.mark.parametrize("group_bytes", [500, 4_000_000])
def test_alignment_against_libraries(spark, sides, group_bytes):
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice("ab the ing\n  é漢.'0▁<>") for _ in range(rnd.randint(0, 80))) for _ in range(150)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(1000 + i, texts[4], "x", 1) for i in range(30)] + [(None, "a", "x", 1), (3, "a b", "x", 1)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, n_a int")
    got = alignment.token_alignment(df, group_bytes=group_bytes).select(F.coalesce("doc_id", F.lit(-1)), *NAMES).collect()
    want = [(-1 if r[0] is None else r[0], *m) for r, m in zip(rows, plain([r[1] for r in rows], sides), strict=True)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert alignment.token_alignment(df.limit(0)).count() == 0 and alignment.token_alignment(df.where("text = ''")).count() == sum(r[1] == "" for r in rows)


def test_given_documents(spark, sides):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in alignment.op13_token_alignment(spark, sf).collect()}
    assert got == {d: m for (d, _), m in zip(docs, plain([t for _, t in docs], sides), strict=True)}
