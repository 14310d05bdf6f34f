"""BPE encoding by backtracking, and decoding by an offset table.

A vocabulary is read from the tokenizer's file. For each position of the pieces of a batch an Aho-Corasick automaton gives the
longest token that starts there; the encoder takes it if it is compatible with the token before, that is, if merging the two
tokens' bytes gives back just these two; else it tries the token's next shorter prefix token, or steps back. Each position is
given up at most once, so the work is linear in the text, and the tokens are those of the merges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_binary, pieces, raw, table, whole
from .pieces import Encoder

VOCABULARY = "byte_bpe_50k.json"
BATCH_BYTES = 1_000_000

def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, the pair each was merged from, the longest shorter token each begins with, and the automaton."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        names = file["model"]["vocab"]
        self.specials = {x["content"]: x["id"] for x in file["added_tokens"]}
        size = max([*names.values(), *self.specials.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for name, k in names.items():
            self.tokens[k] = bytes(letters[c] for c in name) if name not in self.specials else b""
        self.ids = {t: k for k, t in enumerate(self.tokens) if t}
        self.left, self.right, self.rank = list(range(size)), list(range(size)), [-1] * size
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(file["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b, made = names[a], names[b], names[a + b]
            self.pairs[a << 32 | b] = made
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = a, b, rank
        self.sizes = [len(t) for t in self.tokens]
        order = sorted((k for k, t in enumerate(self.tokens) if t), key=lambda k: self.rank[k])
        stands = [False] * size  # whether the merges make a token's bytes into it
        for k in order:
            a, b = self.left[k], self.right[k]
            stands[k] = self.rank[k] < 0 or (stands[a] and stands[b] and self._border_holds(a, b, self.rank[k]))
        self.ids = {t: k for t, k in self.ids.items() if stands[k]}
        self.shorter = [-1] * size
        for k, t in enumerate(self.tokens):
            self.shorter[k] = next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1)
        self.automaton = ahocorasick.Automaton()  # of the tokens read backwards: matches end where tokens start
        for t, k in self.ids.items():
            self.automaton.add_word(t[::-1].decode("latin-1"), k)
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}
        for special, k in self.specials.items():
            self.tokens[k] = special.encode()
        widths = np.array([len(t) for t in self.tokens], np.int64)
        #: The offset table: a token's bytes are flat[offsets[id] : offsets[id + 1]].
        self.offsets = np.concatenate(([0], np.cumsum(widths)))
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave the border between tokens a and b alone."""
        key = a << 32 | b
        if (found := self.known.get(key)) is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            found = self.known[key] = self._border_holds(a, b)
        return found

    def _border_holds(self, a: int, b: int, limit: int = 1 << 40) -> bool:
        # Undo the merges at the border, latest first; a merge across it that comes before the next one undone would have won.
        rank = self.rank
        while True:
            made = self.pairs.get(a << 32 | b)
            if made is not None and rank[made] < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            else:
                limit, b = rank[b] + 1, self.left[b]

    def longest(self, text: bytes) -> list[int]:
        """The longest token that starts at each byte; bytes of other code points are -1."""
        found = [-1] * len(text)
        last = len(text) - 1
        sizes = self.sizes
        for end, k in self.automaton.iter(text[::-1].decode("latin-1")):
            at = last - end
            if found[at] < 0 or sizes[found[at]] < sizes[k]:
                found[at] = k
        return found

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if (one := self.ids.get(piece)) is not None:
            return (one,)
        longest, sizes, shorter, known = self.longest(piece), self.sizes, self.shorter, self.known
        n, at, tokens, dead = len(piece), 0, [], set()
        token = longest[0]
        while at < n:
            while True:
                end = at + sizes[token]
                if end not in dead and (not tokens or (ok if (ok := known.get(tokens[-1] << 32 | token)) is not None else self.compatible(tokens[-1], token))):
                    tokens.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                if (token := shorter[token]) < 0:
                    dead.add(at)
                    token = tokens.pop()
                    at -= sizes[token]
        return tuple(tokens)

    def encode_all(self, found: list[bytes]) -> list[tuple[int, ...]]:
        return [self.encode(p) for p in found]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and the offset in them of each text whose ids start at offsets."""
        first, widths = self.offsets[ids], self.offsets[ids + np.uint32(1)] - self.offsets[ids]
        ends = np.concatenate(([0], np.cumsum(widths)))
        return self.flat[np.repeat(first - ends[:-1], widths) + np.arange(ends[-1])], ends[offsets]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@cache
def backtracking(path: str) -> Encoder:
    v = vocabulary(path)
    return Encoder(v.encode_all, v.specials)


def with_ids(batches: Iterator[pa.RecordBatch], encoder: Encoder, text_col: str, ids_col: str) -> Iterator[pa.RecordBatch]:
    """The batches with the text column replaced by its ids, little-endian unsigned 32-bit integers."""
    for batch in pieces(batches, text_col, BATCH_BYTES):
        ids, at = encoder.encode(*raw(batch.column(text_col)))
        flat = ids.astype("<u4").tobytes()
        column = pa.array([flat[4 * s : 4 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
        names = [n for n in batch.schema.names if n != text_col]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], column], [*names, ids_col])


def with_texts(batches: Iterator[pa.RecordBatch], path: str, ids_col: str, text_col: str) -> Iterator[pa.RecordBatch]:
    """The batches with a column of the texts that their ids stand for; ids and all else stay. Bad bytes become U+FFFD."""
    v = vocabulary(path)
    for batch in batches:
        data, at = raw(batch.column(ids_col))
        ids = np.frombuffer(data.tobytes(), "<u4")
        flat, ends = v.decode(ids, at // 4)
        flat = flat.tobytes()
        texts = pa.array([flat[s:e].decode("utf-8", "replace") for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, text_col])


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """docs with text_col replaced by ids_col: the ids of the whole text as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids; the vocabulary's special tokens in a text become their ids. Other columns pass through,
    except one called ids_col, which is replaced.
    """
    path = path or vocabulary_path()
    kept = docs.select(*[c for c in docs.columns if c not in (text_col, ids_col)], whole(text_col).alias(text_col))
    schema = [f for f in kept.schema.fields if f.name != text_col]
    out = T.StructType([*schema, T.StructField(ids_col, T.BinaryType())])
    return kept.mapInArrow(lambda batches: with_ids(batches, backtracking(path), text_col, ids_col), out)


def decode(coded: DataFrame, ids_col: str = "ids", text_col: str = "text", path: str | None = None) -> DataFrame:
    """coded with text_col: the text its ids stand for, special tokens included; null ids give an empty text."""
    path = path or vocabulary_path()
    kept = coded.select(*[c for c in coded.columns if c not in (ids_col, text_col)], F.coalesce(F.col(ids_col), F.lit(b"")).alias(ids_col))
    out = T.StructType([*kept.schema.fields, T.StructField(text_col, T.StringType())])
    return kept.mapInArrow(lambda batches: with_texts(batches, path, ids_col, text_col), out)


def round_trip(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with text_col replaced by ids and decoded, encoded and decoded again in one pass of one worker."""
    path = path or vocabulary_path()
    kept = docs.select(*[c for c in docs.columns if c not in (text_col, "ids", "decoded")], whole(text_col).alias(text_col))
    out = T.StructType([*[f for f in kept.schema.fields if f.name != text_col], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return kept.mapInArrow(lambda batches: with_texts(with_ids(batches, backtracking(path), text_col, "ids"), path, "ids", "decoded"), out)


def digests(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """doc_id, extra columns, n_tokens, ids_sha256 and decoded_sha256 of every row of docs(doc_id, text)."""
    coded = round_trip(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(extra or []), "text"))
    return coded.select(
        "doc_id", *(extra or []), (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
