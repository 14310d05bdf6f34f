"""Exact removal of repeated byte strings by naming sampled suffixes.

Every string of `span` bytes that also starts in a document with a smaller identifier is removed. The suffixes are not all sorted:
a sample stands for them, chosen so that equal strings of `span` bytes hold the same sampled places (where the hash of a short gram
is least in the string), which is what the residues of a difference cover are for. The steps are those of the difference-cover
construction, on the sample:

1. sort and name the grams at the sampled places; names that no other document has end here;
2. recurse on what is left: name the sampled places again by all bytes that a string through them can have, and find each
   name's smallest document;
3. merge the remaining suffixes: strings that a sampled place stands for, at places whose wide name is new, are named and sorted
   among each other;
4. in each sorted list, adjacent equal names give the smaller document, and the bytes of the others are covered.

Documents lie in a bucketed table by groups of bounded size, so each step reads them in place; only sorted lists of names travel,
one entry for each different name of a group, and single bits come back. A name that a third of all documents share is one entry
in each group. Names of grams only choose what is looked at; those that decide have 88 bits, of two rolling hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, raw, scratch, table, whole, written
from .pieces import _powers, rolling

SPAN, GRAM = 50, 24
GROUP_BYTES = 2_000_000
#: Names in a list of one bucket, about.
BUCKET_NAMES = 500_000
#: Files of the table of texts at most; more groups share them.
MOST_FILES = 20_000
NAMES = "bucket int, g int, names binary, more binary, docs binary"
REPLIES = "g int, kind int, bucket int, bits binary"
LAST = (1 << 63) - 1


class Sample:
    """The sampled places of texts laid end to end, and the strings that each stands for.

    place: the sampled byte; first, last: the first and last start of strings of `span` bytes whose least gram is there; text: whose.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM) -> None:
        self.data, self.offsets, self.span = data, offsets, span
        n, width = len(data), span - gram + 1
        down = _powers(1 << max(16, int(n).bit_length()))[1]
        self.down, self.sums, self.other = down, rolling(data), rolling(data, 1)
        none = np.zeros(0, np.int64)
        self.place, self.first, self.last, self.text, self.name = none, none, none, none, none.astype(np.uint64)
        if n < span:
            return
        grams = (self.sums[gram:] - self.sums[:-gram]) * down[: n - gram + 1]
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(32)
        least, have = grams, 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        # least[s] is the least gram of the string that starts at s; strings across two texts don't count.
        valid = np.zeros(len(least) + 1, np.int8)
        starts, ends = offsets[:-1], offsets[1:] - span + 1
        long = ends > starts
        np.add.at(valid, starts[long], 1)
        np.add.at(valid, ends[long], -1)
        valid = np.cumsum(valid[:-1]).astype(bool)
        new = np.zeros(len(least), bool)
        new[starts[long]] = True
        falls = np.zeros(len(least), bool)
        falls[1:] = least[1:] < least[:-1]
        falls[starts[long]] = False
        new[1:] |= grams[: len(least) - 1] == least[:-1]
        new |= falls
        new &= valid
        first = np.flatnonzero(new)
        stop = np.append(first[1:], n)
        text = np.searchsorted(offsets, first, "right") - 1
        self.first, self.text = first, text
        self.last = np.minimum(stop, offsets[text + 1] - span + 1) - 1
        place = first + width - 1
        search = np.flatnonzero(~falls[first])
        for at in range(0, len(search), 65_536):
            part = search[at : at + 65_536]
            place[part] = first[part] + (grams[first[part][:, None] + np.arange(width)] == least[first[part]][:, None]).argmax(axis=1)
        self.place, self.name = place, mix64(grams[place])

    def key(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 24 bits of a name of each run of bytes."""
        down = self.down[starts]
        return mix64((self.sums[ends] - self.sums[starts]) * down), (mix64((self.other[ends] - self.other[starts]) * down) >> np.uint64(40)).astype(np.uint32)

    def wide(self, which: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
        """Names of all bytes that strings through the places can have, and of how many lie before and after."""
        place, text = self.place[which], self.text[which]
        start = np.maximum(self.offsets[text], place - (self.span - gram))
        end = np.minimum(self.offsets[text + 1], place + self.span)
        name, more = self.key(start, end)
        around = (place - start).astype(np.uint64) * np.uint64(1_000_003) + (end - place).astype(np.uint64)
        return mix64(name + around), (more ^ around.astype(np.uint32)) & np.uint32(0xFFFFFF)

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the strings that the places stand for, and the place of each."""
        count = self.last[which] - self.first[which] + 1
        total = np.cumsum(count)
        owner = np.repeat(which, count)
        return self.first[owner] + np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - count, count), owner


def least_of(names: tuple[np.ndarray, np.ndarray], docs: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """The different names in order, the smallest document of each, and the number of each given name among them."""
    name, more = names
    found, number = np.unique(name, return_inverse=True)
    example = np.empty(len(found), np.int64)
    example[number] = np.arange(len(name))
    if not np.array_equal(more[example][number], more):  # two names alike in their first 64 bits
        order = np.lexsort((more, name))
        new = np.ones(len(name), bool)
        new[1:] = (name[order][1:] != name[order][:-1]) | (more[order][1:] != more[order][:-1])
        number[order] = np.cumsum(new) - 1
        example = order[new]
    least = np.full(len(example), LAST, np.int64)
    np.minimum.at(least, number, docs)
    return (name[example], more[example]), least, number


def short(docs: np.ndarray) -> bytes:
    """Identifiers in four bytes each where all fit, the null one as the largest of them, or else in eight."""
    null = docs == LAST
    if ((docs >= 0) & (docs < 0xFFFFFFFF) | null).all():
        return np.where(null, 0xFFFFFFFF, docs).astype("<u4").tobytes()
    return docs.astype("<i8").tobytes()


def longer(data: bytes, n: int) -> np.ndarray:
    if len(data) == 8 * n:
        return np.frombuffer(data, "<i8")
    docs = np.frombuffer(data, "<u4").astype(np.int64)
    return np.where(docs == 0xFFFFFFFF, LAST, docs)


class Group:
    """The documents of one group, with what the rounds so far have said about their names."""

    def __init__(self, docs: pa.Table, replies: pa.Table | None, n_buckets: int) -> None:
        column = docs.column("text").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        self.ids = np.asarray(docs.column("doc_id"), np.int64)
        self.g = docs.column("g")[0].as_py()
        self.n_buckets = n_buckets
        self.sample = Sample(*raw(column))
        self.bits = {} if replies is None else {(k, b): bits for k, b, bits in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "bits")), strict=True)}
        self.names, number = np.unique(self.sample.name, return_inverse=True)
        owner = self.ids[self.sample.text]
        low, high = np.full(len(self.names), LAST), np.full(len(self.names), -LAST)
        np.minimum.at(low, number, owner)
        np.maximum.at(high, number, owner)
        self.here, self.number, self.owner = low < high, number, owner

    def bucket(self, names: np.ndarray) -> np.ndarray:
        return ((names >> np.uint64(40)) % np.uint64(self.n_buckets)).astype(np.int64)

    def said(self, kind: int, names: np.ndarray) -> np.ndarray:
        """The bits that came back for sorted names, by their first 64 bits."""
        out, bucket = np.zeros(len(names), bool), self.bucket(names)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        for b in np.unique(bucket).tolist():
            at = order[edges[b] : edges[b + 1]]
            out[at] = np.unpackbits(np.frombuffer(self.bits[kind, b], np.uint8), count=len(at)).astype(bool)
        return out

    def lists(self, names: np.ndarray, more: np.ndarray | None = None, docs: np.ndarray | None = None) -> pa.Table:
        """Sorted names by bucket: 40 bits each, or 88 with the smallest document."""
        bucket = self.bucket(names)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        rows: list[list] = [[], [], [], []]
        for b in np.unique(bucket).tolist():
            at = order[edges[b] : edges[b + 1]]
            own = names[at].astype("<u8")
            rows[0].append(b)
            rows[1].append(own.view(np.uint8).reshape(-1, 8)[:, :5].tobytes() if docs is None else own.tobytes())
            rows[2].append(b"" if more is None else more[at].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes())
            rows[3].append(b"" if docs is None else short(docs[at]))
        columns = [pa.array(rows[0], pa.int32()), pa.array([self.g] * len(rows[0]), pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])]
        return pa.table(columns, ["bucket", "g", "names", "more", "docs"])

    def shared(self) -> np.ndarray:
        """Sampled places whose gram another document has."""
        return np.flatnonzero((self.here | self.said(1, self.names))[self.number])

    def contexts(self) -> tuple:
        which = self.shared()
        return which, *least_of(self.sample.wide(which), self.owner[which])

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """Places covered by an earlier document as a whole, and those whose strings must be looked at one by one."""
        which, names, least, number = self.contexts()
        later = (self.owner[which] > least[number]) | self.said(2, names[0])[number]
        return which[later], which[~later]

    def rest(self) -> tuple:
        covered, left = self.split()
        starts, owner = self.sample.strings(left)
        names, least, number = least_of(self.sample.key(starts, starts + self.sample.span), self.owner[owner])
        return covered, starts, owner, names, least, number

    def removed(self) -> np.ndarray:
        covered, starts, owner, names, least, number = self.rest()
        hit = (self.owner[owner] > least[number]) | self.said(3, names[0])[number]
        change = np.zeros(len(self.sample.data) + 1, np.int32)
        np.add.at(change, self.sample.first[covered], 1)
        np.add.at(change, self.sample.last[covered] + self.sample.span, -1)
        np.add.at(change, starts[hit], 1)
        np.add.at(change, starts[hit] + self.sample.span, -1)
        return np.cumsum(change[:-1]) > 0


def _spans(group: Group) -> pa.Table:
    gone, offsets, data = group.removed(), group.sample.offsets, group.sample.data
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], gone[:-1])) if len(gone) else gone
    starts = np.flatnonzero(gone & (~before | edge[:-1]))
    after = np.concatenate((gone[1:], [False])) if len(gone) else gone
    ends = np.flatnonzero(gone & (~after | edge[1:])) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    kept = data[~gone].tobytes()
    left = np.concatenate(([0], np.cumsum(~gone)))[offsets].tolist()
    base = offsets[text]
    at = np.searchsorted(text, np.arange(len(offsets)))
    pairs = pa.StructArray.from_arrays([pa.array(starts - base, pa.int64()), pa.array(ends - base, pa.int64())], ["start", "end"])
    return pa.table(
        [pa.array(group.ids), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pairs), pa.array([kept[a:b] for a, b in zip(left[:-1], left[1:], strict=True)], pa.binary())],
        ["doc_id", "n_bytes", "spans", "kept"],
    )


def _answer(lists: pa.Table, kind: int) -> pa.Table:
    """For each list of a bucket: whether another list has the name (kind 1), or has it with a smaller document."""
    bucket, groups = lists.column("bucket")[0].as_py(), lists.column("g").to_pylist()
    parts = lists.column("names").to_pylist()
    if kind == 1:
        each = []
        for p in parts:
            wide = np.zeros((len(p) // 5, 8), np.uint8)
            wide[:, :5] = np.frombuffer(p, np.uint8).reshape(-1, 5)
            each.append(wide.view("<u8").reshape(-1))
        names = np.concatenate(each)
        sizes = [len(x) for x in each]
        _, number, count = np.unique(names, return_inverse=True, return_counts=True)
        bits = count[number] > 1
    else:
        more = np.zeros((sum(map(len, parts)) // 8, 4), np.uint8)
        more[:, :3] = np.frombuffer(b"".join(lists.column("more").to_pylist()), np.uint8).reshape(-1, 3)
        names = np.frombuffer(b"".join(parts), "<u8"), more.view("<u4").reshape(-1)
        sizes = [len(p) // 8 for p in parts]
        docs = np.concatenate([longer(d, n) for d, n in zip(lists.column("docs").to_pylist(), sizes, strict=True)])
        _, least, number = least_of(names, docs)
        bits = docs > least[number]
    ends = np.cumsum(sizes).tolist()
    out = [np.packbits(bits[e - s : e]).tobytes() for s, e in zip(sizes, ends, strict=True)]
    n = len(groups)
    return pa.table([pa.array(groups, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(out, pa.binary())], ["g", "kind", "bucket", "bits"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (removed runs as [start, end) in bytes), kept (the other bytes), for each row of docs.

    A byte goes if a string of 50 bytes over it also starts in a document with a smaller identifier, judged on whole input texts
    as UTF-8; null is empty, and texts under 50 bytes keep all. Rows that repeat an identifier don't count for each other; a null
    identifier is larger than all others. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), whole(text_col).alias("text"))
    spread = F.xxhash64("doc_id", F.monotonically_increasing_id())
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n_groups = max(1, -(-total // GROUP_BYTES))
    n_buckets = max(1, total // 14 // BUCKET_NAMES)
    n_files = min(n_groups, MOST_FILES, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    name = f"repeats_{uuid.uuid4().hex}"
    grouped = rows.withColumn("g", F.pmod(spread, F.lit(n_groups)).cast("int")).repartition(n_files, "g")
    grouped.write.bucketBy(n_files, "g").option("compression", "zstd").option("path", scratch(spark, "repeats")).saveAsTable(name)
    here = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and here still reads them

    def step(kind: int, replies: DataFrame | None) -> DataFrame:
        def lists(a: pa.Table, b: pa.Table | None = None) -> Iterator[pa.Table]:
            group = Group(a, b, n_buckets)
            if kind == 1:
                return group.lists(group.names)
            if kind == 2:
                _, names, least, _ = group.contexts()
            else:
                _, _, _, names, least, _ = group.rest()
            return group.lists(*names, least)

        if replies is None:
            sent = here.groupBy("g").applyInArrow(lambda a: lists(a), NAMES)
        else:
            sent = here.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(lambda a, b: lists(a, b), NAMES)
        return written(sent.groupBy("bucket").applyInArrow(lambda a: _answer(a, kind), REPLIES), "repeats-replies")

    replies = step(1, None)
    replies = replies.unionByName(step(2, replies))
    replies = replies.unionByName(step(3, replies))
    found = here.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(lambda a, b: _spans(Group(a, b, n_buckets)), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return found.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(LAST)))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


SQL: dict[str, str] = {}
