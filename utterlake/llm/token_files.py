"""Token ids in patched frame-of-reference blocks.

A segment is one binary value with the ids of a run of documents. Its ids are cut into blocks of 128; a block stores its minimum,
the rest packed at a width that nine in ten of its values fit, and the values that don't fit as (position, value) exceptions; an
index has the place where each block's packed words start, so a block can be read alone. Sections of a segment, little-endian:

    magic PFR2 | documents u32 | ids u64 | doc_ids i64[] | whether there is one u8[] | ids of each u32[] | block minima u32[] |
    widths u8[] | exceptions of each u8[] | packed starts u64[] | packed words u64[] | exception positions u8[] | exception values u32[]
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import vocabulary_path
from .common import parts_for, pieces, raw, scratch, table, whole
from .pieces import Encoder

BLOCK = 128
PERCENTILE = 90
END = 0
BATCH_BYTES = 1_000_000
MAGIC = b"PFR2"


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> list[np.ndarray]:
    """The block sections of a segment for unsigned 32-bit ids."""
    n = -(-len(ids) // BLOCK)
    grid = np.zeros((n, BLOCK), np.uint32)
    grid.reshape(-1)[: len(ids)] = ids
    if len(ids) % BLOCK:
        grid[-1, len(ids) % BLOCK :] = ids[-1]
    low = grid.min(axis=1) if n else np.zeros(0, np.uint32)
    grid -= low[:, None]
    bits = np.searchsorted(np.uint64(1) << np.arange(33, dtype=np.uint64), grid.astype(np.uint64), "right").astype(np.uint8)
    widths = np.partition(bits, BLOCK * percentile // 100, axis=1)[:, BLOCK * percentile // 100] if n else np.zeros(0, np.uint8)
    odd = bits > widths[:, None]
    row, place = np.nonzero(odd)
    values = grid[row, place]
    grid[row, place] = 0
    words = 2 * widths.astype(np.int64)
    starts = np.cumsum(words) - words
    packed = np.zeros(int(words.sum()), np.uint64)
    for w in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == w)
        columns = np.ascontiguousarray(grid[rows].T).astype(np.uint64)
        out = np.zeros((2 * w, len(rows)), np.uint64)
        for i in range(BLOCK):
            word, shift = divmod(i * w, 64)
            out[word] |= columns[i] << np.uint64(shift)
            if shift + w > 64:
                out[word + 1] |= columns[i] >> np.uint64(64 - shift)
        packed[starts[rows][:, None] + np.arange(2 * w)] = out.T
    counts = np.bincount(row, minlength=n).astype(np.uint8)
    return [low, widths, counts, starts.astype(np.uint64), packed, place.astype(np.uint8), values]


def unpack(sections: list[np.ndarray], n_ids: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (exclusive, all by default)."""
    low, widths, counts, starts, packed, place, values = sections
    n = len(low)
    last = n if last is None else last
    grid = np.zeros((last - first, BLOCK), np.uint32)
    own = widths[first:last]
    for w in np.unique(own[own > 0]).tolist():
        rows = np.flatnonzero(own == w)
        columns = np.ascontiguousarray(packed[starts[first:last][rows].astype(np.int64)[:, None] + np.arange(2 * w)].T)
        out = np.empty((BLOCK, len(rows)), np.uint32)
        mask = np.uint64((1 << w) - 1)
        for i in range(BLOCK):
            word, shift = divmod(i * w, 64)
            value = columns[word] >> np.uint64(shift)
            if shift + w > 64:
                value |= columns[word + 1] << np.uint64(64 - shift)
            out[i] = value & mask
        grid[rows] = out.T
    ends = np.cumsum(counts.astype(np.int64))
    a, b = (int(ends[first - 1]) if first else 0), (int(ends[last - 1]) if last else 0)
    row = np.repeat(np.arange(last - first), counts[first:last])
    grid[row, place[a:b]] = values[a:b]
    grid += low[first:last, None]
    return grid.reshape(-1)[: max(0, min(n_ids, last * BLOCK) - first * BLOCK)]


def segment(doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> bytes:
    known = np.asarray(doc_ids.is_valid()).astype("u1")
    head = [np.array([len(doc_ids)], "<u4"), np.array([len(ids)], "<u8"), np.asarray(doc_ids.fill_null(0)).astype("<i8"), known, counts.astype("<u4")]
    return MAGIC + b"".join(x.astype(x.dtype.newbyteorder("<"), copy=False).tobytes() for x in [*head, *pack(ids)])


def parts_of(data: bytes) -> tuple[pa.Array, np.ndarray, int, list[np.ndarray]]:
    """doc_ids, ids of each, number of ids and block sections of a segment."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    at = 4

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, n, at)
        at += found.nbytes
        return found

    n_docs, n_ids = int(take("<u4", 1)[0]), int(take("<u8", 1)[0])
    doc_ids = pa.array(take("<i8", n_docs), mask=take("u1", n_docs) == 0)
    counts, n = take("<u4", n_docs), -(-n_ids // BLOCK)
    low, widths, odd, starts = take("<u4", n), take("u1", n), take("u1", n), take("<u8", n)
    packed = take("<u8", 2 * int(widths.sum(dtype=np.int64)))
    return doc_ids, counts, n_ids, [low, widths, odd, starts, packed, take("u1", int(odd.sum(dtype=np.int64))), take("<u4", int(odd.sum(dtype=np.int64)))]


@cache
def library(path: str) -> Encoder:
    """The tokenizers library behind a table of pieces it has seen."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    specials = {t.content: k for k, t in tokenizer.get_added_tokens_decoder().items()}

    def ids_of(found: list[bytes]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast([p.decode() for p in found], add_special_tokens=False)]

    return Encoder(ids_of, specials)


def _segments(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for seq, batch in enumerate(pieces(batches, "text", BATCH_BYTES)):
        ids, at = library(path).encode(*raw(batch.column("text")))
        n = batch.num_rows
        out = np.full(len(ids) + n, end, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
        counts = np.diff(at) + 1
        data = segment(batch.column("doc_id"), counts, out)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()), pa.array([len(out)], pa.int64()), pa.array([data], pa.binary())],
            ["part", "seq", "n_docs", "n_ids", "segment"],
        )


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, path: str | None = None) -> None:
    """Write segments of the ids of docs in ascending order of id_col, the id `end` after each document, as files below folder.

    Null and empty texts have the end id alone. Rows repeated with one identifier are written in order of their texts. A null
    identifier comes first and is read back as null. Other columns are not read. Every file holds whole segments in order of (part, seq).
    """
    path = path or vocabulary_path()
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    n = max(parts_for(spark), rows.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lambda b: _segments(b, path, end), "part int, seq int, n_docs long, n_ids long, segment binary").write.option("compression", "none").parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document of the files: part, seq, doc_id, at (ids before it in its segment), ids (little-endian unsigned 32-bit)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, counts, n_ids, sections = parts_of(batch.column(2)[k].as_py())
                flat = unpack(sections, n_ids).astype("<u4").tobytes()
                ends = np.cumsum(counts, dtype=np.int64)
                starts = ends - counts
                data = pa.array([flat[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
                fill = lambda j: pa.array(np.full(len(doc_ids), batch.column(j)[k].as_py(), np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([fill(0), fill(1), doc_ids, pa.array(starts), data], ["part", "seq", "doc_id", "at", "ids"])

    files = spark.read.schema("part int, seq int, n_docs long, n_ids long, segment binary").parquet(folder)
    return files.select("part", "seq", "segment").mapInArrow(rows, "part int, seq int, doc_id long, at long, ids binary")


def segment_starts(spark: SparkSession, folder: str) -> DataFrame:
    """part, seq, and the number of ids in all segments before: a prefix sum over parts, whose number is that of files, and one in each."""
    sizes = spark.read.schema("part int, seq int, n_docs long, n_ids long, segment binary").parquet(folder).select("part", "seq", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select("part", before(W.orderBy("part")).alias("base"))
    inside = sizes.select("part", "seq", before(W.partitionBy("part").orderBy("seq")).alias("before"))
    return inside.join(parts, "part").select("part", "seq", (F.col("base") + F.col("before")).alias("before"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), folder)
    found = read_tokens(spark, folder).select("part", "seq", "doc_id", "at", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return found.join(segment_starts(spark, folder), ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


SQL: dict[str, str] = {}
