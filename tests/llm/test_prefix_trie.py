"""The trie against plain nodes, with shards small enough that every kind of node spreads over several."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from oracle import connection, same

from utterlake.llm import prefix_trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_nodes(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(found)] for c, found in turns.items()}
    built = {}
    for c, found in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + found[h:])
    members = {}
    for c, found in built.items():
        for d in range(len(found) + 1):
            members.setdefault(found[:d], []).append(c)
    out = []
    for node, found in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = sum(not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below) for m in below)
        saved = sum((len(members[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in below if m)
        ends = ",".join(map(str, sorted(c for c in found if built[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(found), len(node), parent, len(found), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, key string, path int")


@pytest.mark.parametrize("shard", [1, 7, 100_000])
def test_trie_against_plain_nodes(spark, shard):
    rnd = random.Random(shard)
    rows = []
    for c in rnd.sample(range(400), 150):
        rows += [(c, k, rnd.choice(["user", None]), rnd.choice(["a b", "c", "", None, "d  e f"])) for k in range(rnd.randint(1, 6))]
    rows += [(c, k, "user", f"same {k}") for c in range(1000, 1040) for k in range(5)]  # one conversation of many
    rows += [(2000, k, "user", f"long {k % 7}") for k in range(150)] + [(2001, k, "user", f"long {k % 7}") for k in range(140)]
    rows += [(3000, None, "a", "first"), (3000, 0, "a", "x"), (3000, 0, "a", "x"), (None, 0, "a", "nobody"), (3021, 1, "a", "only"), (4001, 0, "é", "ü\tß")]
    rnd.shuffle(rows)
    got = prefix_trie.conversation_trie(frame(spark, rows), shard_turns=shard).select(*NAMES).collect()
    assert sorted(map(tuple, got), key=str) == plain_nodes(rows)
    if shard == 7:
        assert prefix_trie.conversation_trie(frame(spark, rows).limit(0)).count() == 0


def test_double_array_holds_what_was_packed_and_nothing_else():
    rnd = random.Random(1)
    parent, ids, seen = [], [], set()
    for k in range(1, 3000):
        while (edge := (rnd.choice([0, rnd.randrange(k)]), rnd.randrange(500))) in seen:
            pass
        seen.add(edge)
        parent.append(edge[0])
        ids.append(edge[1])
    trie = prefix_trie.DoubleArray(np.array(parent), np.array(ids))
    state = [0]
    for p, i in zip(parent, ids, strict=True):
        state.append(int(trie.step(np.array([state[p]]), np.array([i]))[0]))
    assert min(state) == 0 and len(set(state)) == len(state)
    for s, node in zip(state[:200], range(200), strict=True):
        fits = trie.step(np.full(500, s), np.arange(500)) >= 0
        assert set(np.flatnonzero(fits).tolist()) == {i for p, i in seen if p == node}
    assert (trie.step(np.array([-1]), np.array([3])) == -1).all()


def test_rows_match_sql(spark):
    sf = "/root/testdata/sf0.001"
    same(prefix_trie.op12_prefix_trie(spark, sf), connection(sf), prefix_trie.SQL["op12_prefix_trie"])
