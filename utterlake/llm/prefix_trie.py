"""Prefix tries over conversations: shared beginnings, who has them, and what storing them once would save.

A turn is known by sixteen bytes of the digest of role and text, followed by its number of words; a conversation is the bytes of
its turns, so that the order of bytes is the order of a trie's traversal. Conversations are dealt by ranges of (bytes, identifier):
a prefix shard is a run of neighbours of bounded size, and a prefix that many share, or a conversation that many repeat, simply
spreads over several shards. In each shard the turns get dense ids, BASE and CHECK arrays are packed, and all conversations
are led through them. Only nodes on the paths of a shard's first and last conversation can reach beyond it: these upper nodes come
out in parts, which are summed globally, and sums over subtrees climb the upper nodes in doubling steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORDS, parts_for, table, whole, written

#: Bytes of a turn: its digest, and its words as a big-endian number.
DIGEST, TURN = 16, 20
#: Turns of a shard, about; one conversation at least.
SHARD_TURNS = 100_000
EVERY, HEADS = 20, 4
NODE = "key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string, first_end long, ends binary"
_EMPTY = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """A trie of dense ids in two arrays: the child of the state s by id c is t = base[s] + c, if check[t] is s. The root is state 0."""

    def __init__(self, parent: np.ndarray, ids: np.ndarray) -> None:
        """parent and ids of the nodes 1.., whose parents have smaller numbers; 0 is the root."""
        n = len(parent) + 1
        order = np.argsort(parent, kind="stable")
        owner, begin, count = np.unique(parent[order], return_index=True, return_counts=True)
        taken = np.zeros(2 * n + 64, bool)
        taken[0] = True
        state, base = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low = 1
        for k in np.argsort(-count, kind="stable").tolist():
            if count[k] == 1:
                break
            nodes = order[begin[k] : begin[k] + count[k]]
            shift = ids[nodes] - ids[nodes].min()
            start, taken = self._place(taken, low, shift)
            taken[start + shift] = True
            state[nodes + 1] = start + shift
            base[owner[k]] = start - ids[nodes].min()
            while taken[low]:
                low += 1
        single = count == 1
        nodes = order[begin[single]]
        if (short := len(nodes) - int((~taken).sum())) > 0:
            taken = np.append(taken, np.zeros(short, bool))
        state[nodes + 1] = np.flatnonzero(~taken)[: len(nodes)]
        base[owner[single]] = state[nodes + 1] - ids[nodes]
        size = int(state.max()) + 1
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1)
        self.base[state] = base
        self.check[state[1:]] = state[parent]

    @staticmethod
    def _place(taken: np.ndarray, low: int, shift: np.ndarray) -> tuple[int, np.ndarray]:
        """The first place at which all shifts are free, and the array, longer if need be."""
        while True:
            open_, window = np.flatnonzero(~taken[low:]) + low, 256
            if len(open_):
                at = 0
                while at < len(open_):
                    found = open_[at : at + window]
                    found = found[found + shift.max() < len(taken)]
                    for s in shift.tolist():
                        found = found[~taken[found + s]]
                        if not len(found):
                            break
                    if len(found):
                        return int(found[0]), taken
                    at, window = at + window, window * 4
            taken = np.append(taken, np.zeros(len(taken) + int(shift.max()), bool))

    def step(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The states after one more id each; -1 where the trie has none, and from -1 on."""
        to = self.base[states] + ids
        fits = (states >= 0) & (to > 0) & (to < len(self.check))
        return np.where(fits & (self.check[np.where(fits, to, 0)] == states), to, -1)


class Shard:
    """Conversations in order of (path, identifier), led through a double array of their turns."""

    def __init__(self, conv: np.ndarray, paths: list[bytes]) -> None:
        self.conv, self.paths, n = conv, paths, len(paths)
        sizes = np.array([len(p) // TURN for p in paths], np.int64)
        flat = np.frombuffer(b"".join(paths), np.uint8).reshape(-1, TURN)
        halves = np.ascontiguousarray(flat[:, :DIGEST]).view(">u8").astype(np.uint64)
        words = np.ascontiguousarray(flat[:, DIGEST:]).view(">u4").reshape(-1).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(n), sizes)
        at = np.arange(len(row)) - begin[row]
        # A turn begins a new node where it, or one before it, differs from the conversation before.
        had = (row > 0) & (at < sizes[row - 1])
        other = np.where(had, begin[row - 1] + at, 0)
        differs = ~had | (halves[other] != halves).any(axis=1) if len(row) else np.zeros(0, bool)
        shared = np.full(n, 1 << 60)
        np.minimum.at(shared, row[differs], at[differs])
        new = at >= shared[row]
        # By depth, then row: nodes are numbered so, and a turn belongs to the latest new node of its depth.
        level = np.argsort(at, kind="stable")
        number = np.zeros(len(row), np.int64)
        number[level] = np.maximum.accumulate(np.where(new[level], np.cumsum(new[level]), 0)) if len(row) else number
        made = level[new[level]]
        parent = np.where(at[made] > 0, number[np.maximum(made - 1, 0)], 0)
        # Turns in order of the first node that has them: siblings get ids close to each other, which packs well.
        by = np.lexsort((halves[made, 1], halves[made, 0]))
        fresh = np.append(True, (halves[made[by]][1:] != halves[made[by]][:-1]).any(axis=1)) if len(made) else np.zeros(0, bool)
        group = np.cumsum(fresh) - 1
        first = np.full(int(fresh.sum()), 1 << 60)
        np.minimum.at(first, group, by)
        dense = np.empty(len(made), np.int64)
        dense[by] = np.argsort(np.argsort(first))[group]
        self.trie = DoubleArray(parent, dense)
        turn_id = dense[number - 1]
        self._walk(sizes, begin, turn_id, words)

    def _walk(self, sizes: np.ndarray, begin: np.ndarray, turn_id: np.ndarray, words: np.ndarray) -> None:
        """Members, smallest member, words and depth of every state, and where each conversation ends."""
        trie, n, m = self.trie, len(sizes), len(self.trie.base)
        self.n_convs, self.least, self.words, self.depth = np.zeros(m, np.int64), np.full(m, np.iinfo(np.int64).max), np.zeros(m, np.int64), np.full(m, -1)
        self.end, self.levels = np.zeros(n, np.int64), [np.zeros(1, np.int64)]
        self.n_convs[0], self.least[0], self.depth[0] = n, self.conv.min(), 0
        rows, states, d = np.flatnonzero(sizes > 0), np.zeros(int((sizes > 0).sum()), np.int64), 0
        while len(rows):
            here = begin[rows] + d
            states = trie.step(states, turn_id[here])
            self.n_convs += np.bincount(states, minlength=m) if len(states) * 8 > m else 0
            if len(states) * 8 <= m:
                np.add.at(self.n_convs, states, 1)
            np.minimum.at(self.least, states, self.conv[rows])
            self.words[states], self.depth[states] = words[here], d + 1
            self.levels.append(np.unique(states))
            done = sizes[rows] == d + 1
            self.end[rows[done]] = states[done]
            rows, states, d = rows[~done], states[~done], d + 1

    def nodes(self) -> pa.RecordBatch:
        """All states as rows of NODE; those on the first or last path are upper nodes, with a key and without what needs other shards."""
        trie, m = self.trie, len(self.trie.base)
        keys: dict[int, bytes] = {}
        upper_parent: dict[int, bytes | None] = {}
        for path in (self.paths[0], self.paths[-1]):
            state, before, running = 0, None, hashlib.sha256()
            keys[0], upper_parent[0] = running.copy().digest()[:DIGEST], None
            end, walk = self.end[0] if path is self.paths[0] else self.end[-1], []
            while end:
                walk.append(int(end))
                end = trie.check[end]
            for k, state in enumerate(reversed(walk)):
                before = keys[0] if not k else keys[walk[-k]]
                running.update(path[k * TURN : (k + 1) * TURN])
                keys[state], upper_parent[state] = running.copy().digest()[:DIGEST], before
        upper = np.zeros(m, bool)
        upper[list(keys)] = True
        used = np.concatenate(self.levels)
        inner = used[~upper[used]]
        children = np.bincount(trie.check[inner], minlength=m) if len(inner) else np.zeros(m, np.int64)
        leaves = np.where(upper, 0, children == 0).astype(np.int64)
        saved = np.where(upper, 0, (self.n_convs - 1) * self.words)
        for states in reversed(self.levels[1:]):
            states = states[~upper[states]]  # what is below an upper node climbs from there, once its parts are summed
            above = trie.check[states]
            np.add.at(leaves, above, leaves[states])
            np.add.at(saved, above, saved[states])
        ends = self._ends(upper)
        rows = []
        for s in used.tolist():
            up = int(trie.check[s]) if s else 0
            mine = ends.get(s)
            if upper[s]:
                rows.append((keys[s], upper_parent[s], None, None, None if mine is None else mine[0], None if mine is None else mine[1]))
            else:
                rows.append((None, keys.get(up), None if upper[up] else int(self.least[up]), mine or _EMPTY, None, None))
        key, parent, parent_conv, digest, first_end, blobs = zip(*rows, strict=True)
        columns = [pa.array(key, pa.binary()), pa.array(parent, pa.binary()), *(pa.array(x[used]) for x in (self.depth, self.least)), pa.array(parent_conv, pa.int64())]
        columns += [*(pa.array(x[used]) for x in (self.n_convs, children, leaves, saved, self.words)), pa.array(digest, pa.string()), pa.array(first_end, pa.int64()), pa.array(blobs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in NODE.split(", ")])

    def _ends(self, upper: np.ndarray) -> dict[int, tuple[int, bytes] | str]:
        """By state, of the conversations that end there: the digest, or for upper nodes the first identifier and all of them."""
        order = np.lexsort((self.conv, self.end))
        cuts = np.flatnonzero(np.diff(self.end[order])) + 1
        found: dict[int, tuple[int, bytes] | str] = {}
        for part in np.split(order, cuts):
            state, ids = int(self.end[part[0]]), ",".join(map(str, self.conv[part].tolist())).encode()
            found[state] = (int(self.conv[part[0]]), ids) if upper[state] else hashlib.sha256(ids).hexdigest()
        return found


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    conv: list[int] = []
    paths: list[bytes] = []
    held = 0
    for batch in batches:
        for c, p in zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist(), strict=True):
            conv.append(c)
            paths.append(p)
            held += len(p) // TURN + 1
            if held >= most:
                yield Shard(np.array(conv, np.int64), paths).nodes()
                conv, paths, held = [], [], 0
    if conv:
        yield Shard(np.array(conv, np.int64), paths).nodes()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each key whose pieces come in order; nothing of a key is held but the state of its digest."""
    key, running = None, hashlib.sha256()
    for batch in batches:
        keys, found = [], []
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    keys.append(key)
                    found.append(running.hexdigest())
                key, running = k, hashlib.sha256(piece)
            else:
                running.update(b",")
                running.update(piece)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found)], ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], ["key", "ends_sha256"])


def own_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the turns of each conversation in order, as 40 hexadecimal digits each.

    Null turns come first; equal ones are in order of their digests. Rows without conv_id belong to no conversation.
    """
    role, text = whole("role"), whole("text")
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(WORDS))), 2 * (TURN - DIGEST), "0")
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.concat(digest, words).alias("item")).alias("t"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: t["item"]).alias("turns"))


def rebuilt(own: DataFrame, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    """conv_id, path: the first h turns of conversation c - c % every, then the conversation's own turns after its first h; h is crc32(c) % heads."""
    base = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    turns = F.concat(F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1))))
    return joined.select("conv_id", F.unhex(F.array_join(turns, "")).alias("path"))


def prefix_trie(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie over paths(conv_id, path), one conversation a row: conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. No conversations have no nodes, not even a root."""
    dealt = paths.repartitionByRange(parts_for(paths.sparkSession), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    nodes = written(dealt.mapInArrow(lambda b: _shards(b, shard_turns), NODE), "trie-nodes")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parts = nodes.where("key IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = written(parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), *[F.min(c).alias(c) for c in ("parent", "depth", "words")], *sums), "trie-upper")
    more = merged.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("more")).withColumnRenamed("parent", "key")
    pieces = parts.where("ends IS NOT NULL").select("key", "first_end", "ends").repartition("key").sortWithinPartitions("key", "first_end")
    digests = pieces.mapInArrow(_digests, "key binary, ends_sha256 string")
    upper = merged.join(more, "key", "left").join(digests, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    upper = written(
        upper.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"))
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY))).drop("more"), "trie-upper",
    )
    upper = upper.drop("n_leaves", "saved_tokens").join(_climbed(upper.select("key", "parent", "n_leaves", "saved_tokens")), "key")
    above = upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    top = upper.join(above, "parent", "left").withColumn("parent_conv_id", F.col("above"))
    inner = nodes.where("key IS NULL").join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return top.select(*names).unionByName(inner.select(*names))


def _climbed(values: DataFrame) -> DataFrame:
    """key, n_leaves, saved_tokens summed over each node and all below it: after k rounds over those less than 2**k steps below."""
    now = values.withColumnRenamed("parent", "up")
    while now.where("up IS NOT NULL").head(1):
        given = now.where("up IS NOT NULL").groupBy("up").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        far = now.select(F.col("key").alias("up"), F.col("up").alias("next"))
        summed = now.join(given.withColumnRenamed("up", "key"), "key", "left")
        now = written(
            summed.join(far, "up", "left").select("key", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens")),
            "trie-climb",
        )
    return now.select("key", "n_leaves", "saved_tokens")


def conversation_trie(conversations: DataFrame, every: int = EVERY, heads: int = HEADS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of the rebuilt conversations of conversations(conv_id, turn, role, text); null roles and texts are empty.

    A conversation's turns, twenty bytes each, are one value. Rows that repeat a turn are turns of their own; an empty table has
    no nodes. Other columns are not read.
    """
    return prefix_trie(rebuilt(own_turns(conversations), every, heads), shard_turns)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


SQL = {
    "op12_prefix_trie": r"""
WITH table_ AS (SELECT list(v ORDER BY i) AS l FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, s: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) AS r(i))),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
convs AS (
  SELECT s.conv_id, s.conv_id - s.conv_id % 20 AS base, coalesce(b.n, 0) AS base_n,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(s.conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM sizes AS s CROSS JOIN table_ LEFT JOIN sizes AS b ON b.conv_id = s.conv_id - s.conv_id % 20),
rebuilt AS (
  SELECT c.conv_id, t.k AS depth, role, text FROM convs AS c JOIN turns AS t ON t.conv_id = c.base AND t.k <= c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, c.base_n) + t.k - c.h, role, text FROM convs AS c JOIN turns AS t ON t.conv_id = c.conv_id AND t.k > c.h),
keyed AS (
  SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS key
  FROM rebuilt),
member AS (
  SELECT conv_id, depth, words, key, lag(key, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM keyed
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM convs),
node AS (SELECT key, min(conv_id) AS conv_id, min(depth) AS depth, min(parent) AS parent, min(words) AS words, count(*) AS n_convs FROM member GROUP BY key),
child AS (SELECT parent, count(*) AS n FROM node GROUP BY parent),
below AS (
  SELECT m.key, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((d.n_convs - 1) * d.words) AS saved_tokens
  FROM node AS d JOIN member AS m ON m.conv_id = d.conv_id AND m.depth <= d.depth LEFT JOIN child AS c ON c.parent = d.key GROUP BY m.key),
ends AS (
  SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS digest
  FROM (SELECT conv_id, max_by(key, depth) AS key FROM member GROUP BY conv_id) GROUP BY key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves, b.saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM node AS n LEFT JOIN node AS p ON p.key = n.parent LEFT JOIN child AS c ON c.parent = n.key JOIN below AS b ON b.key = n.key LEFT JOIN ends AS e ON e.key = n.key
"""
}
