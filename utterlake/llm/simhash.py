"""SimHash near-duplicates: fingerprints over word shingles, linked by covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over the hashes of a text's shingles. Bit places are dealt to the seven non-zero
vectors of three bits in turn; the mask of a non-zero vector v keeps the places whose vector has an odd product with v. Two
places that differ span at most a plane, so some v is orthogonal to both: its mask keeps neither, and the pair collides in its
table. Each of the seven tables keeps 36 or 37 of 64 bits. A bucket of more than BLOCK fingerprints is covered once more by seven
masks over the bits that its table leaves out; what is left then are at most twelve bits, so no bucket of different fingerprints
has more than 4096 members, whatever the corpus looks like.

Inside a bucket no pairs are made: two fingerprints within two bits share a value that is at most one bit from either, and all
that share such a value are within two bits of each other. Every member names itself and its neighbours over the free bits, equal
names join, and one link a member comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, raw, table, whole, written
from .near_dedup import classes
from .words import lowered, words

SHINGLE, SEED, BITS = 3, 42, 64
#: Vectors of RADIUS + 1 bits, without zero: that many tables.
RADIUS = 2
TABLES = (1 << (RADIUS + 1)) - 1
#: Fingerprints of a bucket that are compared as they are; larger buckets are covered again.
BLOCK = 1024
BATCH_BYTES = 1_000_000
#: Fingerprints of buckets that are joined at once, and hashes whose bits are counted at once.
AT_ONCE, HASHES = 50_000, 1 << 16


def covering(places: list[int]) -> list[int]:
    """A mask for each vector: places that keep the bits, so that any RADIUS of the given places are all left out by one mask."""
    return [sum(1 << p for k, p in enumerate(places) if ((k % TABLES + 1) & v).bit_count() % 2) for v in range(1, TABLES + 1)]


def left_out(mask: int) -> list[int]:
    return [p for p in range(BITS) if not mask >> p & 1]


FIRST = covering(list(range(BITS)))
SECOND = [[mask | more for more in covering(left_out(mask))] for mask in FIRST]
#: Bits that vary inside a bucket, by the number of its table: 8 t for a first table, 8 t + u + 1 for one of its second ones.
FREE = {8 * t: left_out(mask) for t, mask in enumerate(FIRST)} | {8 * t + u + 1: left_out(mask) for t, row in enumerate(SECOND) for u, mask in enumerate(row)}


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs one after the other with a blank behind each, and where each begins."""
    sizes = ends - starts
    total = np.cumsum(sizes)
    at = total - sizes + np.arange(len(sizes))
    out = np.full(int(total[-1]) + len(sizes), 0x20, np.uint8)
    step = np.arange(int(total[-1]))
    out[np.repeat(at - (total - sizes), sizes) + step] = data[np.repeat(starts - (total - sizes), sizes) + step]
    return out, at


def fingerprints(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text; texts without words have zero."""
    n = len(offsets) - 1
    low = lowered(data)
    starts, ends, text = words(low, offsets)
    ones = np.zeros((n, BITS), np.int64)
    total = np.zeros(n, np.int64)
    if len(starts):
        flat, begin = joined(low, starts, ends)
        stop = begin + ends - starts
        count = np.bincount(text, minlength=n)
        place = np.arange(len(text)) - (np.cumsum(count) - count)[text]
        at = np.flatnonzero(place <= np.maximum(count[text] - size, 0))
        last = at + np.minimum(size, count[text[at]]) - 1
        owner, total = text[at], np.maximum(count - size + 1, np.minimum(count, 1))
        flat, digest = flat.tobytes(), xxhash.xxh64_intdigest
        for k in range(0, len(at), HASHES):
            spans = zip(begin[at[k : k + HASHES]].tolist(), stop[last[k : k + HASHES]].tolist(), strict=True)
            hashes = np.fromiter((digest(flat[s:e], seed) for s, e in spans), "<u8", min(HASHES, len(at) - k))
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own = owner[k : k + HASHES]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").reshape(-1).view("<u8")


def _fingerprinted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", BATCH_BYTES):
        found = fingerprints(*raw(batch.column("text")), size)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.astype(np.int64))], ["doc_id", "fp"])


def least_reached(values: np.ndarray, bucket: np.ndarray, free: list[int]) -> np.ndarray:
    """For each value the least value of its bucket that is reached in steps of two bits or fewer, all among the free ones.

    Equal values of different buckets stay apart; the values of a bucket are all different.
    """
    n = len(values)
    order = np.lexsort((values, bucket))
    values, bucket = values[order], bucket[order]
    flips = np.array([0, *[1 << p for p in free]], np.uint64)
    named = (values[:, None] ^ flips).reshape(-1)
    owner = np.repeat(np.arange(n), len(flips))
    at = np.lexsort((named, bucket[owner]))
    named, owner = named[at], owner[at]
    run = np.flatnonzero(np.append(True, (named[1:] != named[:-1]) | (bucket[owner[1:]] != bucket[owner[:-1]])))
    sizes = np.diff(np.append(run, len(named)))
    label = np.arange(n)  # values are in order, so the least label is the least value
    while True:
        least = np.repeat(np.minimum.reduceat(label[owner], run), sizes)
        now = label.copy()
        np.minimum.at(now, owner, least)
        now = now[now]
        if np.array_equal(now, label):
            break
        label = now
    out = np.empty(n, np.uint64)
    out[order] = values[label]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        which = np.array(batch.column("bucket_table").to_pylist(), np.int64)
        lists = batch.column("fps")
        sizes = np.asarray(lists.value_lengths(), np.int64)
        begin = np.cumsum(sizes) - sizes
        flat = np.asarray(lists.flatten()).astype(np.uint64)
        for t in np.unique(which).tolist():
            rows = np.flatnonzero(which == t)
            for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(sizes[rows]) // AT_ONCE)) + 1):
                many = sizes[part]
                values = flat[np.repeat(begin[part] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                least = least_reached(values, np.repeat(np.arange(len(part)), many), FREE[t])
                moved = values != least
                yield pa.RecordBatch.from_arrays([pa.array(values[moved].astype(np.int64)), pa.array(least[moved].astype(np.int64))], ["a", "b"])


def fingerprint_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of fingerprints within two bits, or joined by such steps, that hold the components of fps(fp), all different."""

    def kept(mask: int) -> Column:
        return F.col("fp").bitwiseAND(F.lit(signed(mask)))

    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), kept(mask).alias("key")) for t, mask in enumerate(FIRST)])).alias("r")).select("fp", "r.*")
    counts = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = F.element_at(F.array(*[F.array(*[F.struct(F.lit(8 * t + u + 1).alias("bucket_table"), kept(m).alias("key")) for u, m in enumerate(row)]) for t, row in enumerate(SECOND)]), F.col("t") + 1)
    once = F.array(F.struct((F.col("t") * 8).alias("bucket_table"), "key"))
    dealt = rows.join(counts, ["t", "key"]).select("fp", F.explode(F.when(F.col("n") <= block, once).otherwise(again)).alias("r")).select("fp", "r.*")
    full = dealt.groupBy("bucket_table", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return full.select("bucket_table", "fps").mapInArrow(_links, "a long, b long").distinct()


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (long), component_id (the least identifier reachable over links).

    Rows of one fingerprint are linked like rows whose fingerprints differ in one or two bits; null and empty texts and texts
    without words have fingerprint zero. Rows that repeat an identifier each have their own fingerprint and component. A row with
    a null identifier takes part; component_id is null only if no row it reaches has an identifier. Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    each = written(source.mapInArrow(lambda b: _fingerprinted(b, size), "doc_id long, fp long"), "simhash-fingerprints")
    fps = written(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-different")
    found = classes(fingerprint_links(fps.select("fp"), block), "simhash-classes")
    linked = fps.join(found.withColumnRenamed("doc", "fp"), "fp").select("fp", "first", "class")
    least = linked.groupBy("class").agg(F.min("first").alias("least"))
    reached = linked.join(least, "class").select("fp", "least")
    named = fps.join(reached, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return each.join(named, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


SQL: dict[str, str] = {}
