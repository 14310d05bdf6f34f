"""Near-duplicate detection: ProbMinHash signatures of weighted word shingles, banding, exact verification, classes.

Each shingle of five words is a point process of exponential arrivals whose rate is its weight (the number of times it occurs);
every arrival picks one of a signature's registers, and a register keeps the shingle that arrived there first. Arrivals of a
shingle stop as soon as its next one comes after the last register was filled. Two registers agree with the chance of the
probability Jaccard similarity; runs of registers are bands, and documents that share a band are candidates.

No bucket of candidates is turned into its pairs. First every bucket compares its members with one pivot; signatures tell which
comparisons can reach the wanted similarity, and those are verified exactly. One minus the probability Jaccard similarity is a
metric (it is the chance that two registers differ), so members of one class need no more links among each other, and of the
pivot's class only those stay that could reach a member outside it. What stays of a bucket goes to tasks with its shingles, in
blocks of bounded rows and bytes, a task for each two blocks that are not both of the pivot's class: there the members outside the
most common class are verified against the likeliest others, and only links that join two classes come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, pieces, raw, table, whole, written
from .pieces import piece_keys
from .words import words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
SEED = 0x5EED
BATCH_BYTES = 1_000_000
#: Members of a block, and bytes of their shingles, about.
BLOCK, BLOCK_BYTES = 4096, 8_000_000
#: Estimates from signatures stray by less than this, but for a chance of 1e-5 at the worst and 1e-8 at a similarity of 0.8.
STRAY = 0.2
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, weight) of the different shingles of each text, in order of text and key.

    A text of fewer words than a shingle has one, all its words; a text without words has none.
    """
    starts, ends, text = words(data, offsets)
    n_texts = len(offsets) - 1
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none
    key = mix64(piece_keys(data, starts, ends))
    count = np.bincount(text, minlength=n_texts)
    first = np.cumsum(count) - count
    place = np.arange(len(text)) - first[text]
    here = place <= np.maximum(count[text] - size, 0)
    at, left = np.flatnonzero(here), np.minimum(size, count[text[here]])
    value = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = k < left
        value[inside] = mix64(value[inside] * GOLD + key[at[inside] + k] + np.uint64(k + 1))
    owner = text[at]
    order = np.argsort(value)
    short = owner[order].astype(np.uint16 if n_texts <= 1 << 16 else np.int64)
    order = order[np.argsort(short, kind="stable")]
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    index = np.flatnonzero(new)
    return owner[index], value[index], np.diff(np.append(index, len(owner)))


def signatures(owner: np.ndarray, key: np.ndarray, weight: np.ndarray, n_texts: int, m: int = BANDS * ROWS, seed: int = SEED) -> np.ndarray:
    """ProbMinHash signatures, n_texts by m: the key of the shingle that arrives first in each register."""
    times = np.full(n_texts * m, np.inf)
    held = np.zeros(n_texts * m, np.uint64)
    clock, arrival = np.zeros(len(key)), 0
    while len(key):
        many = 1 if len(key) * 16 > 100_000 else 16  # arrivals of each shingle at once, where few are left
        salt = np.array([(seed + k * 2 * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF for k in range(arrival, arrival + many)], np.uint64)
        draw = mix64(key[:, None] + salt)
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        each = clock[:, None] - np.cumsum(np.log(uniform) / weight[:, None], axis=1)
        slot = owner[:, None] * m + (mix64(draw + GOLD) % np.uint64(m)).astype(np.int64)
        np.minimum.at(times, slot.reshape(-1), each.reshape(-1))
        row, column = np.nonzero(times[slot] == each)
        held[slot[row, column]] = key[row]
        clock = each[:, -1]
        stay = clock < times.reshape(n_texts, m).max(axis=1)[owner]
        owner, key, weight, clock = owner[stay], key[stay], weight[stay], clock[stay]
        arrival += many
    return held.reshape(n_texts, m)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, m = signature.shape
    out = np.zeros((n, m // rows), np.uint64)
    for k in range(rows):
        out = mix64(out * GOLD + signature[:, k::rows][:, : m // rows] + np.uint64(k + 1))
    return out


def contents(owner: np.ndarray, key: np.ndarray, weight: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's shingles end, and two sums over all its shingles and weights, the same for texts with the same ones."""
    ends = np.searchsorted(owner, np.arange(n_texts + 1))
    sums = []
    for mixed in (mix64(key * GOLD + weight.astype(np.uint64)), mix64(key + weight.astype(np.uint64) * GOLD + np.uint64(1))):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
        sums.append((total[ends[1:]] - total[ends[:-1]]).astype(np.int64))
    return ends, *sums


def _signed(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", BATCH_BYTES):
        owner, key, weight = shingles(*raw(batch.column("text")), size)
        n = batch.num_rows
        ends, same, too = contents(owner, key, weight, n)
        registers = signatures(owner, key, weight, n, bands * rows)
        found = band_keys(registers, rows).astype(np.int64)
        short = (registers >> np.uint64(32)).astype("<u4").tobytes()
        width = 4 * bands * rows
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), pa.array(found.reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(same), pa.array(too), pa.array(np.diff(ends)), lists, pa.array([short[k : k + width] for k in range(0, len(short), width)], pa.binary())],
            ["doc_id", "same", "too", "size", "bands", "signature"],
        )


def _shingled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """doc_id, keys and counts of the texts whose content is the wanted one; no counts stand for ones."""
    for batch in pieces(batches, "text", BATCH_BYTES):
        owner, key, weight = shingles(*raw(batch.column("text")), size)
        ends, same, too = contents(owner, key, weight, batch.num_rows)
        fits = (same == np.asarray(batch.column("same"))) & (too == np.asarray(batch.column("too")))
        flat, counts, ends = key.astype("<u8").tobytes(), weight.astype("<u4").tobytes(), ends.tolist()
        spans = [(a, b) for a, b, ok in zip(ends[:-1], ends[1:], fits.tolist(), strict=True) if ok]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").filter(pa.array(fits)), pa.array([flat[8 * a : 8 * b] for a, b in spans], pa.binary()), pa.array([counts[4 * a : 4 * b] if (weight[a:b] > 1).any() else b"" for a, b in spans], pa.binary())],
            ["doc_id", "keys", "counts"],
        )


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """sum over shared d of 1 / sum over all e of max(a_e / a_d, b_e / b_d), for (sorted keys, weights)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    both_x, both_y = x[i], y[j]
    alone_x, alone_y = x.sum() - both_x.sum(), y.sum() - both_y.sum()
    # max(x_e / x_d, y_e / y_d) is y_e / y_d for those e whose y_e / x_e is above y_d / x_d.
    ratio = both_y / both_x
    order = np.argsort(ratio, kind="stable")
    ratio, sx, sy = ratio[order], both_x[order], both_y[order]
    up_to = np.searchsorted(ratio, ratio, "right")
    sum_x = np.concatenate(([0.0], np.cumsum(sx)))[up_to]
    sum_y = sy.sum() - np.concatenate(([0.0], np.cumsum(sy)))[up_to]
    return float((1.0 / ((sum_x + alone_x) / sx + (sum_y + alone_y) / sy)).sum())


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        side = {}
        for name in ("keys", "counts", "other_keys", "other_counts"):
            side[name] = batch.column(name).to_pylist()
        found = []
        for ka, ca, kb, cb in zip(*side.values(), strict=True):
            a, b = np.frombuffer(ka, "<u8"), np.frombuffer(kb, "<u8")
            wa = np.frombuffer(ca, "<u4") if ca else np.ones(len(a))
            wb = np.frombuffer(cb, "<u4") if cb else np.ones(len(b))
            found.append(probability_jaccard((a, wa), (b, wb)))
        yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("doc"), pa.array(found, pa.float64())], ["pivot", "doc", "similarity"])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (_matrix(batch.column(c)) for c in ("signature", "other"))
        yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("doc"), pa.array((a == b).mean(axis=1) if batch.num_rows else np.zeros(0))], ["pivot", "doc", "estimate"])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u4").reshape(len(rows), -1) if rows else np.zeros((0, 1), np.uint32)


def estimates(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """pivot, doc, estimate: the share of registers that agree."""
    first = pairs.join(signed.select(F.col("doc_id").alias("doc"), "signature"), "doc")
    both = first.join(signed.select(F.col("doc_id").alias("pivot"), F.col("signature").alias("other")), "pivot")
    return both.select("pivot", "doc", "signature", "other").mapInArrow(_estimated, "pivot long, doc long, estimate double")


def similarities(pairs: DataFrame, shingled: DataFrame) -> DataFrame:
    """pivot, doc, exact similarity of the pairs."""
    first = pairs.select("pivot", "doc").join(shingled.withColumnRenamed("doc_id", "doc"), "doc")
    other = shingled.select(F.col("doc_id").alias("pivot"), F.col("keys").alias("other_keys"), F.col("counts").alias("other_counts"))
    return first.join(other, "pivot").select("pivot", "doc", "keys", "counts", "other_keys", "other_counts").mapInArrow(_verified, "pivot long, doc long, similarity double")


class Shingled:
    """Texts of one task as flat arrays: sorted shingle keys, weights as shares of their text, and where each text's start."""

    def __init__(self, rows: pa.Table) -> None:
        keys, counts = rows.column("keys").to_pylist(), rows.column("counts").to_pylist()
        self.ends = np.cumsum([0, *[len(k) // 8 for k in keys]])
        self.keys = np.frombuffer(b"".join(keys), "<u8")
        self.weights = np.concatenate([np.frombuffer(c, "<u4") if c else np.ones(len(k) // 8, np.uint32) for k, c in zip(keys, counts, strict=True)])
        sums = np.concatenate(([0], np.cumsum(self.weights, dtype=np.int64)))
        self.sums = (sums[self.ends[1:]] - sums[self.ends[:-1]]).astype(np.float64)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.keys[self.ends[i] : self.ends[i + 1]], self.weights[self.ends[i] : self.ends[i + 1]]

    def linked(self, i: int, others: np.ndarray, threshold: float) -> np.ndarray:
        """Those of others whose probability Jaccard similarity to i is at least threshold.

        Two samplers agree at most with the shared mass of their distributions; only pairs whose shared mass is enough are computed.
        """
        own, weight = self[i]
        sizes = self.ends[others + 1] - self.ends[others]
        total = np.cumsum(sizes)
        at = np.repeat(self.ends[others] - (total - sizes), sizes) + np.arange(total[-1])
        key = self.keys[at]
        place = np.minimum(np.searchsorted(own, key), len(own) - 1)
        shared = np.where(own[place] == key, np.minimum(weight[place] / self.sums[i], self.weights[at] / np.repeat(self.sums[others], sizes)), 0.0)
        mass = np.add.reduceat(shared, total - sizes)
        close = others[mass >= threshold - 1e-9]
        return np.array([j for j in close.tolist() if probability_jaccard(self[i], self[j]) >= threshold], np.int64)


def _links(rows: pa.Table, threshold: float, likely: float, bands: int) -> pa.Table:
    """Links that join the classes of a task's texts; the pairs of two blocks, or of one with itself, that a bucket stands for.

    A pair is looked at in the first bucket that it shares. Likeliest candidates come first, and those that have joined a text's
    class meanwhile need no look.
    """
    signature, label, own, doc = _matrix(rows.column("signature")), *(np.array(rows.column(c).to_pylist(), np.int64) for c in ("label", "own", "doc"))
    one, low, high = (rows.column(c)[0].as_py() for c in ("one", "low", "high"))
    texts, label = Shingled(rows), np.unique(label, return_inverse=True)[1]
    common = np.bincount(label).argmax()
    found: list[tuple[int, int]] = []
    for i in np.flatnonzero(label != common).tolist():
        other = label != label[i]
        if low != high:
            other &= own != own[i]
        near = np.flatnonzero(other)
        equal = signature[near] == signature[i]
        estimate = equal.mean(axis=1)
        near, estimate, equal = near[estimate >= likely], estimate[estimate >= likely], equal[estimate >= likely]
        alike = equal.reshape(len(near), bands, equal.shape[1] // bands).all(axis=2)
        mine = alike[:, one] & (alike[:, :one].sum(axis=1) == 0)
        near = near[mine][np.argsort(-estimate[mine], kind="stable")]
        step = 8
        while len(near):
            for j in texts.linked(i, near[:step], threshold).tolist():
                if label[j] != label[i]:
                    found.append((min(doc[i], doc[j]), max(doc[i], doc[j])))
                    label[label == label[j]] = label[i]
            near = near[step:][label[near[step:]] != label[i]]
            step *= 2
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def classes(edges: DataFrame, label: str = "near-classes") -> DataFrame:
    """doc, class (the least doc of its connected component) for edges(a, b): labels fall to the least neighbour's and jump to its label."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), label)
    now = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("class")).select(F.col("a").alias("doc"), "class"), label)
    while True:
        of = now.select(F.col("doc").alias("b"), "class")
        near = both.join(of, "b").groupBy("a").agg(F.min("class").alias("near"))
        fell = now.join(near, now["doc"] == near["a"]).select("doc", F.least("class", "near").alias("down"), F.col("class").alias("was"))
        jump = now.select(F.col("doc").alias("down"), F.col("class").alias("far"))
        following = written(fell.join(jump, "down").select("doc", F.least("down", "far").alias("class"), "was"), label)
        now = following.select("doc", "class")
        if not following.where(F.col("class") != F.col("was")).head(1):
            return now


def near_links(docs: DataFrame, shingled_of: Callable[[DataFrame], DataFrame], threshold: float = SIMILARITY, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b) that hold the classes of docs(doc_id, size, bands, signature); shingled_of(ids) gives doc_id, keys, counts of
    documents, and size is the number of their keys."""
    reach, likely = 1.0 - threshold, threshold - STRAY
    spread = docs.select(F.col("doc_id").alias("doc"), "size", F.posexplode("bands").alias("band", "value")).select("doc", "size", "band", F.xxhash64("band", "value").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("pivot")).where("n > 1").select("bucket", "pivot")
    rows = written(spread.join(shared, "bucket").where("doc != pivot"), "near-rows")
    signed = docs.select("doc_id", "signature")
    rough = written(estimates(rows.select("pivot", "doc").distinct(), signed), "near-estimates")
    ids = rows.select("doc").union(rows.select("pivot")).distinct().withColumnRenamed("doc", "doc_id")
    shingled = written(shingled_of(ids), "near-shingles")
    sims = written(similarities(rough.where(F.col("estimate") >= likely), shingled), "near-similarities")
    links = sims.where(F.col("similarity") >= threshold).select(F.col("pivot").alias("a"), F.col("doc").alias("b"))
    # What is in the pivot's class stays in a bucket only if a member of another class could reach it; the pivot itself is done.
    exact, rest = 1.0 - F.col("similarity"), 1.0 - F.col("estimate")
    known = rough.join(sims, ["pivot", "doc"], "left").select("pivot", "doc", F.coalesce(exact, F.greatest(F.lit(reach + 0.01), rest - STRAY)).alias("far"), F.coalesce(exact, rest + STRAY).alias("farthest"))
    found = classes(links)
    known = known.join(found.select("doc", F.col("class").alias("own")), "doc", "left").join(found.select(F.col("doc").alias("pivot"), F.col("class").alias("its")), "pivot", "left")
    known = known.select("pivot", "doc", "far", "farthest", F.coalesce("own", "doc").alias("label"), F.coalesce("its", "pivot").alias("main"))
    far = written(rows.join(known, ["pivot", "doc"]), "near-far")
    nearest = far.where("label != main").groupBy("bucket").agg(F.min("far").alias("nearest"))
    stay = far.join(nearest, "bucket").where((F.col("label") != F.col("main")) | (F.col("farthest") >= F.col("nearest") - reach - 1e-9))
    stay = written(stay.select("bucket", "doc", "size", "label", (F.col("label") != F.col("main")).alias("outside"), F.col("band").alias("one")), "near-left")
    texts = written(signed.join(shingled, "doc_id").withColumnRenamed("doc_id", "doc"), "near-texts")
    last = _tasks(stay, block).join(texts, "doc").groupBy("bucket", "low", "high").applyInArrow(lambda t: _links(t, threshold, likely, bands), "a long, b long")
    return links.unionByName(last).distinct()


def _tasks(rows: DataFrame, block: int) -> DataFrame:
    """Rows of the buckets with texts of two classes, once for each pair of blocks that their own is in.

    Blocks have bounded rows and bytes. What is outside the pivot's class meets all blocks, what is in it only blocks of outside ones:
    a bucket with few outside costs its rows once more for each block of those few. A bucket that fits one block is one.
    """
    n, size = F.count(F.lit(1)), F.sum("size") * 8
    counts = lambda n, size: F.ceil(F.greatest(n / block, size / BLOCK_BYTES)).cast("int")
    of = lambda kind: counts(F.count_if(kind), F.coalesce(F.sum(F.when(kind, F.col("size"))), F.lit(0)) * 8)
    found = rows.groupBy("bucket").agg(counts(n, size).alias("all"), of(F.col("outside")).alias("out"), of(~F.col("outside")).alias("in"), F.min("label").alias("least"), F.max("label").alias("most")).where("least != most")
    sizes = found.select("bucket", F.when(F.col("all") <= 1, 1).otherwise(F.col("out")).alias("out"), F.when(F.col("all") <= 1, 0).otherwise(F.col("in")).alias("in"))
    placed = rows.join(written(sizes, "near-sizes"), "bucket")
    free = F.col("outside") | (F.col("in") == 0)
    own = F.when(free, F.pmod(F.xxhash64("doc"), F.col("out"))).otherwise(F.col("out") + F.pmod(F.xxhash64("doc"), F.col("in"))).cast("int")
    both = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(free, F.col("out") + F.col("in")).otherwise(F.col("out")) - 1)))
    return both.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "doc", "label", "one")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the least doc_id of its class), links, kept.

    Classes are the connected components of documents whose probability Jaccard similarity over shingles of five words, weighted
    by their counts, is at least 0.8; of rows with the same shingles and counts, one stands for all. links counts the links that
    were verified at a document's representative, enough to hold its class together. Texts without words are each a class of
    their own, as are rows with a null identifier. Rows that repeat an identifier are one document; of their texts that differ, the
    one with the least digest speaks for it. Other columns of docs are not read.
    With 32 bands of 4 registers a pair of similarity 0.8 shares no band with a chance of 5e-8.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    signed = written(source.mapInArrow(lambda b: _signed(b, size, bands, rows), "doc_id long, same long, too long, size long, bands array<long>, signature binary"), "near-signatures")
    same = ["same", "too", "size"]
    full = signed.where("size > 0 AND doc_id IS NOT NULL").select("doc_id", *same)
    repeated = bool(full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1))
    if repeated:
        full = full.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("s")).select("doc_id", "s.*")
    stands = written(full.groupBy(*same).agg(F.min("doc_id").alias("first")), "near-contents")
    member = written(full.join(stands, same).select("doc_id", "first"), "near-members")
    chosen = signed.join(stands.withColumnRenamed("first", "doc_id"), ["doc_id", *same]).select("doc_id", "same", "too", "size", "bands", "signature")
    chosen = written(chosen.dropDuplicates(["doc_id"]) if repeated else chosen, "near-chosen")

    def shingled_of(ids: DataFrame) -> DataFrame:
        found = source.join(ids.join(chosen.select("doc_id", "same", "too"), "doc_id"), "doc_id").mapInArrow(lambda b: _shingled(b, size), "doc_id long, keys binary, counts binary")
        return found.dropDuplicates(["doc_id"]) if repeated else found

    links = written(near_links(chosen, shingled_of, threshold, bands, block), "near-links")
    found = classes(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("first")).groupBy("first").agg(F.count(F.lit(1)).alias("links"))
    classed = member.join(found.withColumnRenamed("doc", "first"), "first", "left").join(degree, "first", "left").select("doc_id", F.coalesce("class", "first").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    out = source.select("doc_id").join(classed, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), (F.col("doc_id").isNull() | (F.coalesce("class_id", "doc_id") == F.col("doc_id"))).alias("kept"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs whose document stands for its class, in the columns of docs; rows with a null identifier stay."""
    dropped = near_dedup(docs, id_col, **how).where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(dropped, id_col, "left_anti").select(*docs.columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
