"""Token counts of documents in flat token files without an index.

A file is a stream of ids cut into blocks wherever a block is full; documents end with an end-of-document id and run across
blocks. Each block is searched for end ids on its own; what a block knows is its number of ids, of ends, and the place of its last
end. A prefix scan of these over the blocks of a file gives the number of each block's first document and the ids that the
document brings along from earlier blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, table, whole

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Free in this vocabulary; no text has it.
END = 50256
BLOCK_IDS = 65_536
SCHEMA = "file int, kind string, block int, data binary"


@cache
def encoding(name: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _blocks(batches: Iterator[pa.RecordBatch], name: str, end: int, size: int) -> Iterator[pa.RecordBatch]:
    file, block, run, waiting, held, names = TaskContext.get().partitionId(), 0, 0, [], 0, []

    def row(kind: str, k: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([kind]), pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["file", "kind", "block", "data"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids = encoding(name).encode_ordinary(text.as_py())
            ids.append(end)
            waiting.append(np.array(ids, "<u2"))
            held += len(ids)
            names.append(doc_id)
            if held >= size:
                flat = np.concatenate(waiting)
                for at in range(0, held - size + 1, size):
                    yield row("tokens", block, flat[at : at + size].tobytes())
                    block += 1
                waiting, held = [flat[held - held % size :]], held % size
            if len(names) >= size:
                yield row("names", run, _packed(names))
                run, names = run + 1, []
    if held:
        yield row("tokens", block, np.concatenate(waiting).tobytes())
    if names:
        yield row("names", run, _packed(names))


def _packed(names: list) -> bytes:
    """Identifiers, and for each whether there is one."""
    return np.array([n or 0 for n in names], "<i8").tobytes() + bytes(n is not None for n in names)


def write_flat(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, size: int = BLOCK_IDS, name: str = VOCABULARY) -> None:
    """Write the ids of docs as flat files: blocks of unsigned 16-bit ids below kind=tokens, and the order of the documents below kind=names.

    Null and empty texts have the end id alone. Every row is a document of its own, also where identifiers repeat; a null identifier
    is read back as null. Columns but identifier and text are not read, whatever their names. An empty table gives no documents.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    rows.mapInArrow(lambda b: _blocks(b, name, end, size), SCHEMA).write.partitionBy("kind").option("compression", "zstd").parquet(folder)


def _scanned(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file, block, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            ids = np.frombuffer(data, "<u2")
            rows.append((file, block, len(ids), np.flatnonzero(ids == end)))
        files, blocks, sizes, ends = zip(*rows, strict=True)
        offsets = np.concatenate(([0], np.cumsum([len(e) for e in ends])))
        found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ends), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), pa.array(blocks, pa.int32()), pa.array(sizes, pa.int64()), found], ["file", "block", "size", "ends"])


def count_tokens(blocks: DataFrame, end: int = END) -> DataFrame:
    """file, number (of the document in its file, from 0), start, n_tokens (without the end id) and ended, for blocks(file, block, data).

    ended is false for a last document that lacks its end id; end ids in a row give documents of 0 tokens; a file without ids has
    no documents. Blocks of any size may follow one another.
    """
    scanned = blocks.select("file", "block", "data").mapInArrow(lambda b: _scanned(b, end), "file int, block int, size long, ends array<long>")
    w = W.partitionBy("file").orderBy("block")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    placed = scanned.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = placed.withColumn("last", F.col("base") + F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1))
    stitched = placed.select(
        "file", "block", "base", "size", "ends", "last",
        (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("open"),  # where the document that the block begins with starts
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("first"),
        F.lead("block").over(w).isNull().alias("final"),
    )
    each = stitched.select("file", "base", "open", "first", "ends", F.posexplode("ends").alias("k", "stop"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.col("base") + F.element_at("ends", F.greatest(F.col("k"), F.lit(1))) + 1)
    closed = each.select("file", (F.col("first") + F.col("k")).alias("number"), start.alias("start"), (F.col("base") + F.col("stop") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = F.col("base") + F.col("size") - F.greatest(F.coalesce(F.col("last") + 1, F.col("open")), F.col("open"))
    left = stitched.where("final").select(
        "file", (F.col("first") + F.size("ends")).alias("number"), F.greatest(F.coalesce(F.col("last") + 1, F.col("open")), F.col("open")).alias("start"), rest.alias("n_tokens"), F.lit(False).alias("ended")
    )
    return closed.unionByName(left.where("n_tokens > 0"))


def document_names(spark: SparkSession, folder: str, size: int = BLOCK_IDS) -> DataFrame:
    """file, number and doc_id of the documents of flat files, in the order they were written."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                n = len(data) // 9
                ids = pa.array(np.frombuffer(data, "<i8", n), mask=np.frombuffer(data, "u1", n, 8 * n) == 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, file, np.int32)), pa.array(np.arange(n) + block * size), ids], ["file", "number", "doc_id"])

    return spark.read.schema("file int, block int, data binary").parquet(f"{folder}/kind=names").mapInArrow(rows, "file int, number long, doc_id long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the file and place where each document's ids start."""
    folder = scratch(spark, "flat-tokens")
    write_flat(table(spark, sf_dir, "documents"), folder)
    counts = count_tokens(spark.read.schema("file int, block int, data binary").parquet(f"{folder}/kind=tokens"))
    return counts.join(document_names(spark, folder), ["file", "number"]).select("doc_id", "n_tokens", "file", "start")


SQL: dict[str, str] = {}
