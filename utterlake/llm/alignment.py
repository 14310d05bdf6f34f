"""Alignment of two tokenizers over the same bytes, each distinct text once.

Texts are shuffled by the hash of the whole text; equal texts of a task are collapsed before, with their number, and meet in one
group, where each is tokenised once by both vocabularies. Both tokenisations cut the same bytes, so the union of their ends cuts a
text into segments, each in one token of either side: the segments are the links. How often two ids are linked is summed by group
with the texts' numbers of copies, then over all groups; a group gets back the sums of its own pairs only, so that no table of
all pairs travels whole. Groups are of bounded bytes and lie in a bucketed table of both sides' ids, which is read in place.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import vocabulary, vocabulary_path
from .common import pieces, raw, scratch, table, written
from .pieces import Encoder

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of the distinct texts of a group, about, of what a task collapses at once, and of what is tokenised at once.
GROUP_BYTES, COLLAPSE_BYTES, BATCH_BYTES = 2_000_000, 16_000_000, 1_000_000
#: Rows that go to and from a Python worker at once, so that both sides hold few whole texts.
BATCH_ROWS = 1000
#: Files of the table of ids at most; more groups share them.
MOST_FILES = 20_000
TOKENS = "g int, digest binary, copies long, a binary, b binary"
MEASURES = "digest binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class ByteBpe:
    """The byte-level vocabulary by the operator of BPE encoding, with special tokens as plain text."""

    def __init__(self, path: str) -> None:
        v = vocabulary(path)
        self.encoder, self.offsets, self.flat = Encoder(v.encode_all, {}), v.offsets, v.flat

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.encode(data, offsets)


class Pieces:
    """A sentence-piece vocabulary; tokens stand for UTF-8 bytes, U+2581 for a blank, <0xHH> for one byte."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        tokens = [bytes([int(x[3:5], 16)]) if self.model.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)]
        self.offsets = np.cumsum([0, *map(len, tokens)])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(texts, num_threads=1)
        at = np.cumsum([0, *map(len, found)])
        return np.fromiter((i for x in found for i in x), np.uint32, int(at[-1])), at


@cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@cache
def sentence_pieces(path: str) -> Pieces:
    return Pieces(path)


def spelled(side: ByteBpe | Pieces, ids: np.ndarray) -> np.ndarray:
    """The bytes of all ids in a row."""
    first, widths = side.offsets[ids], side.offsets[ids + np.uint32(1)] - side.offsets[ids]
    ends = np.cumsum(widths)
    return side.flat[np.repeat(first - (ends - widths), widths) + np.arange(int(ends[-1]) if len(ends) else 0)]


def tokenised(texts: list[str], a: ByteBpe, b: Pieces) -> list[tuple[np.ndarray, np.ndarray]]:
    """Both sides' ids of each text behind a blank; none where the joined bytes of a side are not the blank and the text."""
    wanted = [b" " + t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(wanted), np.uint8), np.cumsum([0, *map(len, wanted)])
    out = []
    sides = [(a, *a.ids(data, at)), (b, *b.ids(texts))]
    spelt = [(spelled(side, ids).tobytes(), np.concatenate(([0], np.cumsum(side.offsets[ids + np.uint32(1)] - side.offsets[ids])))[cut], ids, cut) for side, ids, cut in sides]
    for k, want in enumerate(wanted):
        same = all(flat[ends[k] : ends[k + 1]] == want for flat, ends, _, _ in spelt)
        out.append(tuple(ids[cut[k] : cut[k + 1]] if same else ids[:0] for _, _, ids, cut in spelt))
    return out


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a run of rows as one, with their number."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in pieces(batches, "text", COLLAPSE_BYTES):
        if held and size + batch.nbytes > COLLAPSE_BYTES:
            yield from _counted(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield from _counted(held)


def _counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counted = pc.value_counts(pa.chunked_array([b.column("text") for b in held]))
    yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["text", "copies"])


def _ids_of(batches: Iterator[pa.RecordBatch], first: str, second: str) -> Iterator[pa.RecordBatch]:
    a, b = byte_bpe(first), sentence_pieces(second)
    for batch in pieces(batches, "text", BATCH_BYTES):
        found = tokenised(batch.column("text").to_pylist(), a, b)
        sides = [pa.array([x[k].astype(_width(side)).tobytes() for x in found], pa.binary()) for k, side in enumerate((a, b))]
        yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("digest"), batch.column("copies"), *sides], ["g", "digest", "copies", "a", "b"])


def _width(side: ByteBpe | Pieces) -> str:
    return "<u2" if len(side.offsets) <= 1 << 16 else "<u4"


class Aligned:
    """The texts of a group laid end to end: ids of both sides, where each token ends, and the segments that both sides' ends cut."""

    def __init__(self, rows: pa.Table, first: str, second: str) -> None:
        self.rows, n = rows, rows.num_rows
        self.sides = []
        for name, side in (("a", byte_bpe(first)), ("b", sentence_pieces(second))):
            data, at = _joined(rows.column(name))
            kind = np.dtype(_width(side))
            ids = np.frombuffer(data.tobytes(), kind).astype(np.int64)
            self.sides.append((ids, at // kind.itemsize, np.cumsum(side.offsets[ids + 1] - side.offsets[ids])))
        (a, self.a_at, a_ends), (b, self.b_at, b_ends) = self.sides
        total = int(a_ends[-1]) if len(a) else 0
        marks = np.zeros(total + 1, np.uint8)
        marks[a_ends] = 1
        marks[b_ends] += 2
        marks[0] = 0
        ends = np.flatnonzero(marks)
        self.both = marks[ends] == 3
        #: The place of each link's tokens: those that end at the segment's end or first after it.
        self.link_a = np.cumsum(marks[ends] & 1) - (marks[ends] & 1)
        self.link_b = np.cumsum(marks[ends] >> 1) - (marks[ends] >> 1)
        text_end = np.concatenate(([0], a_ends))[self.a_at]
        self.link_at = np.searchsorted(ends, text_end, "right")
        self.code = a[self.link_a] << 32 | b[self.link_b]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The different pairs of ids, in order, and how many links of all copies hold each."""
        copies = np.asarray(self.rows.column("copies").combine_chunks(), np.int64)
        weight = np.repeat(copies, np.diff(self.link_at))
        order = np.argsort(self.code)
        code = self.code[order]
        new = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        return code[new], np.add.reduceat(weight[order], new) if len(new) else weight

    def per_text(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values)))[self.link_at]
        return np.diff(sums)

    def groups(self) -> list[str]:
        """The digest of each text's groups; empty without tokens."""
        (a, a_at, _), (b, b_at, _) = self.sides
        # Groups before each token, and the tokens of the other side that stand before it in the written form.
        group = np.cumsum(self.both) - self.both
        last_a, last_b = np.append(self.link_a[1:] != self.link_a[:-1], True), np.append(self.link_b[1:] != self.link_b[:-1], True)
        if not len(group):
            return [""] * self.rows.num_rows
        group_a, group_b = group[last_a], group[last_b]
        n_a, n_b = np.bincount(group_a), np.bincount(group_b)
        before_b = np.cumsum(n_b) - n_b
        place_a = np.arange(len(a)) + before_b[group_a]
        place_b = np.arange(len(b)) + np.cumsum(n_a)[group_b]
        ends_a, ends_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        out = np.empty(len(a) + len(b), object)
        names = _names(max(int(a.max()), int(b.max())) + 1)
        out[place_a] = names[np.where(ends_a, 1, 0), a]
        out[place_b] = names[np.where(ends_b, 2, 0), b]
        words, cut = out.tolist(), (a_at + b_at).tolist()
        return [hashlib.sha256("".join(words[s:e])[:-1].encode()).hexdigest() if e > s else "" for s, e in zip(cut[:-1], cut[1:], strict=True)]


def _joined(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return raw(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)


@cache
def _named(n: int) -> np.ndarray:
    return np.array([[f"{k}{sign}" for k in range(n)] for sign in ",|;"], object)


def _names(n: int) -> np.ndarray:
    """Numbers up to at least n as text, followed by a comma, a bar or a semicolon."""
    return _named(1 << n.bit_length())


def token_alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str | None = None, second: str | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    first is the file of a byte-level vocabulary, which encodes a blank and the text; second that of a sentence-piece vocabulary,
    which adds the blank itself. Special tokens in a text are plain text. Null and empty texts, and texts of which either side's
    joined tokens are not the blank and the text, have zeros and an empty digest and add nothing to the counts. Rows that repeat a
    text count each; identifiers may repeat or be null. Other columns are not read.
    """
    measures = text_measures(docs, text_col, first, second, group_bytes)
    # Zeros stand for texts without tokens, too, so a row whose text has no measures needs no second look.
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(F.col(text_col), 256)).alias("digest"))
    out = named.join(measures, "digest", "left")
    counts = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return out.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def text_measures(docs: DataFrame, text_col: str = "text", first: str | None = None, second: str | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """MEASURES of each distinct text that has tokens, under the SHA-256 of the text."""
    first, second = first or vocabulary_path(FIRST), second or vocabulary_path(SECOND)
    here = token_table(docs, text_col, first, second, group_bytes)
    counted = pair_counts(here, first, second)

    def measured(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        group = Aligned(rows, first, second)
        code, total, best = (_numbers(found.column(c)) for c in ("code", "n", "best"))
        order = np.argsort(code)
        at = order[np.searchsorted(code[order], group.code)] if len(group.code) else np.zeros(0, np.int64)
        columns = [np.diff(group.a_at), np.diff(group.b_at), group.per_text(group.both), np.diff(group.link_at), group.per_text(best[at]), group.per_text(total[at])]
        return pa.table([rows.column("digest"), *map(pa.array, columns), pa.array(group.groups(), pa.string())], [c.split()[0] for c in MEASURES.split(", ")])

    return written(here.groupBy("g").cogroup(counted.groupBy("g")).applyInArrow(measured, MEASURES), "align-measures")


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, np.int64)


def token_table(docs: DataFrame, text_col: str, first: str, second: str, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """TOKENS of each distinct text, in groups by the hash of the text, as a table bucketed by group."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text")).where("text != ''")
    total = texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n_groups = max(1, -(-total // group_bytes))
    n_files = min(n_groups, MOST_FILES, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    few = texts.mapInArrow(_collapsed, "text string, copies long")
    dealt = few.withColumn("g", F.pmod(F.xxhash64("text"), F.lit(n_groups)).cast("int")).repartition(n_files, "g")
    distinct = dealt.groupBy("g", "text").agg(F.sum("copies").alias("copies")).select("g", "text", "copies", F.unhex(F.sha2("text", 256)).alias("digest"))
    coded = distinct.mapInArrow(lambda batches: _ids_of(batches, first, second), TOKENS)
    name = f"aligned_{uuid.uuid4().hex}"
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(rows)
    spark.conf.set(rows, BATCH_ROWS)
    try:
        coded.where("octet_length(a) > 0").write.bucketBy(n_files, "g").option("compression", "zstd").option("path", scratch(spark, "align-tokens")).saveAsTable(name)
    finally:
        spark.conf.set(rows, held)
    here = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and here still reads them
    return here


def pair_counts(here: DataFrame, first: str, second: str) -> DataFrame:
    """g, code (both ids of a pair), n (links over all texts), best (1 where no pair of its second id has more), for each group's pairs."""

    def pairs(key: tuple, rows: pa.Table) -> pa.Table:
        code, n = Aligned(rows, first, second).pairs()
        return pa.table([pa.array(np.full(len(code), key[0].as_py(), np.int32)), pa.array(code), pa.array(n)], ["g", "code", "n"])

    each = written(here.groupBy("g").applyInArrow(pairs, "g int, code long, n long"), "align-pairs")
    totals = each.groupBy("code").agg(F.sum("n").alias("n"))
    totals = written(totals.withColumn("second", F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))), "align-totals")
    most = totals.groupBy("second").agg(F.max("n").alias("most"))
    ranked = totals.join(most, "second").select("code", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    return each.select("g", "code").join(ranked, "code").select("g", "code", "n", "best")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
