"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over all documents. Words that could hide others (digits and signs among letters, letters
repeated) become lattices of the letters they may stand for; a Viterbi search under the character model and the costs of the channel
restores them. A run of one-character words is one lattice, with an optional word break after each letter; it is also read as the
likeliest words of the corpus in a row, priced by their counts over all documents. Signs at the edges of a word or run may be
punctuation or letters: it is read both ways. Restored texts are scored: of the words and word beginnings of
labelled documents, those that mark label 1 form a bounded lexicon, and a logistic regression weighs a document's marks.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, raw, table, whole, written
from .pieces import Memo, spread
from .words import distinct, lowered, words

THRESHOLD = 0.3
#: The lexicon is bounded; beyond that its weakest marks go. PRIOR is how many average documents stand against every mark.
MOST_MARKS, LEAST_DOCS, PRIOR, LEAST_CHANCE = 20_000, 3, 4.0, 0.35
#: Chosen on a quarter of the labelled rows that are not held out, learning from the others.
RIDGE = 0.0001
#: The classifier learns from at most so many labelled rows, those with the least hashes of their identifiers.
MOST_LABELLED = 20_000
BEGINNINGS = (4, 5, 6)
BATCH_BYTES = 1_000_000
#: The letters that signs may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": ""}
SIGN_COST, DROP_COST, KEEP_COST, EDGE_COST = 0.7, 0.4, 8.0, 4.0
_SIGNS = "".join(map(re.escape, SIGNS))
_HIDDEN = re.compile(rf"[^\W\d_][{_SIGNS}.\-_]+[^\W\d_]|^[{_SIGNS}]+[^\W\d_]|[^\W\d_][0-9$@]+$|([^\W\d_])\1\1|^[^\W\d_](?:[.\-_*][^\W\d_])+$")
_EDGES = ".,;:!?\"'()[]{}<>|#%&*+-_=/\\~^`"
_PLAIN = "".join(c for c in _EDGES if c not in SIGNS)
_OUTSIDE = _EDGES + "".join(c for c in SIGNS if c not in _EDGES)
_PUNCTUATION = np.isin(np.arange(256), [ord(c) for c in _PLAIN])
_THRICE = re.compile(rb"(.)\1\1")
#: Runs of so many one-character words are read as spaced out.
LEAST_SPACED = 3
LETTERS = 27
#: Spaced-out letters are read as words of this bounded dictionary: the commonest of the corpus (all words are counted) and the lexicon's
#: own, of at most so many letters. A character that no word takes costs more than any word.
MOST_WORDS, LONGEST_WORD, STRAY_COST = 20_000, 64, 30.0
#: Letters with marks count as those below the marks.
MARKED = {chr(c): base for c in range(0xC0, 0x100) if "a" <= (base := unicodedata.normalize("NFD", chr(c).lower())[0]) <= "z"} | {"ß": "s"}
#: What stands for a word of one character among the marks of words.
ONE = 0xFFFFFFFF


def letter(c: str) -> int:
    return ord(c) - 96 if "a" <= (c := MARKED.get(c, c)) <= "z" else 0


def letters_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The letters of texts laid end to end, each text between two signs that are no letters."""
    low = lowered(data)
    kind = np.where((low >= 97) & (low <= 122), low - 96, 0).astype(np.int32)
    second = np.array([letter(chr(0xC0 + k)) for k in range(64)], np.int32)
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80)) if len(data) else np.zeros(0, np.int64)
    kind[lead + 1] = second[data[lead + 1] - 0x80]
    keep = np.ones(len(data), bool)
    keep[lead] = False
    at = np.concatenate(([0], np.cumsum(keep)))[offsets]
    return np.insert(kind[keep], np.repeat(at, 2), 0)


class Channel:
    """Viterbi search over what a hidden word may stand for; costs: -log of the trigrams of letters, 0 being no letter, and of words."""

    def __init__(self, counts: np.ndarray, said: Mapping[str, int] | None = None) -> None:
        grid = counts.reshape(LETTERS, LETTERS, LETTERS) + 0.5
        self.cost = (-np.log(grid / grid.sum(axis=2, keepdims=True))).tolist()
        self.said = dict(said or {})
        self.price_words()

    def price_words(self, more: Iterator[str] | list[str] = ()) -> None:
        """Prices the dictionary by its counts; more words join it as seen once."""
        for word in more:
            self.said.setdefault(word, 1)
        total = sum(self.said.values())
        self.price = {w: math.log(total / n) for w, n in self.said.items()}
        self.ordered = sorted(self.price)

    def restored(self, word: str) -> str:
        """The likeliest letters behind the word, in lower case; a word without signs or repetitions is itself."""
        if not _HIDDEN.search(word):
            return word
        return self.likeliest(word)[0]

    def readings(self, word: str) -> list[str]:
        """The word without the signs at its edges, and with those of them that are likelier letters than punctuation, if it has such."""
        bare, outer = word.strip(_EDGES), word.strip(_PLAIN)
        found = [self.restored(bare) if bare else ""]
        if bare != outer and any(map(str.isalpha, bare)):
            found += self.likeliest(outer, edges=_EDGES)[1:]
        return found

    def spaced(self, tokens: list[str]) -> list[str]:
        """The words that one-character words in a row may spell, with and without breaks between them, and as words of the dictionary."""
        bare = [t.strip(_EDGES) or t.strip(_PLAIN) for t in tokens]
        found: list[str] = self.known_words("".join(t.strip(_PLAIN) for t in tokens))
        for text in dict.fromkeys(("".join(bare), "".join(t.strip(_PLAIN) for t in tokens))):
            for breaks in (True, False):
                for reading in self.likeliest(text, edges=_OUTSIDE, breaks=breaks):
                    found += reading.split()
        return list(dict.fromkeys(found))

    def known_words(self, run: str) -> list[str]:
        """The cheapest row of the dictionary's words that the run may spell; a stretch that no word takes comes out as it is.

        A sign is one of its letters, or nothing; of a character three times or more in a row, one or two may be meant. From each
        place where a word may begin, only beginnings of words of the dictionary are followed.
        """
        if not self.price:
            return []
        n = len(run)
        cells: list[list[tuple[str, float, int]]] = []
        for at, c in enumerate(run):
            next_ = at + 1
            while next_ < n and next_ - at < 3 and run[next_] == c:
                next_ += 1
            ways = [(c, 0.0, at + 1)] if c.isalpha() else [*((x, SIGN_COST, at + 1) for x in SIGNS.get(c, "")), ("", DROP_COST, at + 1)]
            if c.isalpha() and next_ - at > 2:
                ways.append(("", DROP_COST, at + 1))
            cells.append(ways)
        best: list[tuple[float, tuple | None]] = [(0.0, None)] + [(math.inf, None)] * n
        for at in range(n):
            cost, text = best[at]
            if cost + STRAY_COST < best[at + 1][0]:
                best[at + 1] = (cost + STRAY_COST, (text, run[at], False))
            ahead: dict[tuple[int, str], float] = {(at, ""): cost}
            while ahead:
                following: dict[tuple[int, str], float] = {}
                for (to, word), spent in ahead.items():
                    for out, more, then in cells[to] if to < n else []:
                        grown = word + out
                        if out:
                            first = bisect_left(self.ordered, grown)
                            if first == len(self.ordered) or not self.ordered[first].startswith(grown):
                                continue
                        total = spent + more
                        price = self.price.get(grown)
                        if not grown:
                            if total < best[then][0]:
                                best[then] = (total, text)
                        elif total < following.get((then, grown), math.inf):
                            following[then, grown] = total
                        if price is not None and total + price < best[then][0]:
                            best[then] = (total + price, (text, grown, True))
                ahead = following
        found: list[str] = []
        stray = ""
        _, text = best[n]
        while text is not None:
            text, word, known = text
            if known:
                found += [w for w in (stray, word) if w]
                stray = ""
            else:
                stray = word + stray
        return [*reversed(found + [stray] * bool(stray))]

    def likeliest(self, word: str, edges: str = "", breaks: bool = False) -> list[str]:
        """The likeliest reading that drops all signs of `edges` at both ends, then the likeliest that reads one of them at least as a letter.

        States: the last two letters, whether a sign at an edge was read, whether one behind the word was dropped. Texts are linked lists.
        """
        lead = len(word) - len(word.lstrip(edges))
        trail = max(lead, len(word.rstrip(edges)))
        best: dict[tuple[int, int, bool, bool], tuple[float, tuple | None]] = {(0, 0, False, False): (0.0, None)}
        at = 0
        while at < len(word):
            c = word[at]
            run = at + 1
            while run < len(word) and word[run] == c:
                run += 1
            edge = at < lead or at >= trail
            letters = [(x * k, SIGN_COST) for x in SIGNS.get(c, "") for k in range(1, min(run - at, 2) + 1)]
            if c.isalpha():
                choices = [(c * k, 0.0 if k == run - at else DROP_COST) for k in range(1, min(run - at, 2) + 1)] if run - at > 2 else [(c * (run - at), 0.0)]
            elif edge:
                choices = letters
            else:
                choices = letters + ([] if SIGNS.get(c) else [("", DROP_COST)]) + [(word[at:run], KEEP_COST)]
            if breaks:
                choices = choices + [(f"{out[0]} {out[1]}", more) for out, more in choices if len(out) == 2]
                if run < len(word):
                    choices = choices + [(f"{out} ", more) for out, more in choices if out]
                if not edge and c in _EDGES:
                    choices = [*choices, (" ", DROP_COST)]
            following: dict[tuple[int, int, bool, bool], tuple[float, tuple | None]] = {}
            for (a, b, read, closed), (cost, text) in best.items():
                for out, more in [] if closed else choices:
                    x, y, total = a, b, cost + more
                    for letter_ in out:
                        z = letter(letter_)
                        total += self.cost[x][y][z]
                        x, y = y, z
                    key = (x, y, read or edge, False)
                    if key not in following or total < following[key][0]:
                        following[key] = (total, (text, out))
                if edge and (at >= trail or not read or not letters):
                    key, total = (a, b, read, at >= trail and bool(letters) or closed), cost + (EDGE_COST if letters else 0.0)
                    if key not in following or total < following[key][0]:
                        following[key] = (total, text)
            best = following
            at = run
        found = []
        for wanted in (False, True):
            ends = [(cost + self.cost[a][b][0], k) for k, ((a, b, read, _), (cost, _)) in enumerate(best.items()) if read == wanted]
            if ends:
                text, out = list(best.values())[min(ends)[1]][1], []
                while text is not None:
                    text, last = text
                    out.append(last)
                found.append("".join(reversed(out)))
        return found


def corpus_counts(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, dict[str, int]]:
    """Counts of letter trigrams over all whole texts, 27**3 numbers whatever the corpus, and the MOST_WORDS commonest words.

    All words of letters alone are counted, in lower case and without punctuation around them, in the pass that counts trigrams;
    the counts go to the shared folder, and a bounded part of them to the driver. Words of over LONGEST_WORD letters are not counted.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, said = np.zeros(LETTERS**3, np.int64), {}

        def out(names: list, counts: list | np.ndarray, said_of: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(said_of, pa.string()), pa.array(counts, pa.int64())], ["trigram", "word", "n"])

        for batch in pieces(batches, "text", BATCH_BYTES):
            data, offsets = raw(batch.column(0))
            kind = letters_of(data, offsets)
            if len(kind) > 2:
                total += np.bincount((kind[:-2] * LETTERS + kind[1:-1]) * LETTERS + kind[2:], minlength=LETTERS**3)
            data = lowered(data)
            starts, ends, _ = words(data, offsets)
            if len(starts):
                found, number = distinct(data, starts, ends)
                for word, n in zip(found, np.bincount(number).tolist(), strict=True):
                    if len(word) <= 4 * LONGEST_WORD and (w := word.decode("utf-8", "replace").lower().strip(_EDGES)).isalpha() and len(w) <= LONGEST_WORD:
                        said[w] = said.get(w, 0) + n
            if len(said) > 100_000:
                yield out([None] * len(said), list(said.values()), list(said))
                said.clear()
        seen = np.flatnonzero(total)
        yield out(seen.tolist() + [None] * len(said), total[seen].tolist() + list(said.values()), [None] * len(seen) + list(said))

    found = docs.select(whole(text_col).alias("text")).mapInArrow(counted, "trigram long, word string, n long")
    found = written(found.groupBy("trigram", "word").agg(F.sum("n").alias("n")), "toxic-counts")
    total = np.zeros(LETTERS**3, np.int64)
    for row in found.where("word IS NULL").collect():
        total[row["trigram"]] = row["n"]
    said = found.where("word IS NOT NULL")
    # A collected sorted limit would bring each task's best to the driver; how many words there are of each magnitude leaves few, which tasks sort.
    least, many = 1, 0
    for row in sorted(said.groupBy(F.length(F.bin("n")).alias("bits")).count().collect(), reverse=True):
        least, many = 1 << row["bits"] - 1, many + row["count"]
        if many >= MOST_WORDS:
            break
    best = written(said.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(MOST_WORDS), "toxic-words")
    return total, {r["word"]: r["n"] for r in best.collect()}


class Reader:
    """Words of a batch as features, through the channel; what a word gives is kept for later batches up to a bound."""

    def __init__(self, channel: Channel, most_kept: int = 50_000) -> None:
        self.channel, self.most_kept, self.kept = channel, most_kept, {}

    def word(self, data: bytes) -> tuple[list[str], str]:
        """The readings of a word; and, where it may be one of letters spaced out, the word in lower case."""
        if (found := self.kept.get(data)) is None:
            if len(self.kept) > self.most_kept:
                self.kept.clear()
            low = data.decode("utf-8", "replace").lower()
            one = low.strip(_EDGES) or low.strip(_PLAIN)
            found = self.kept[data] = self.channel.readings(low), low if len(one) == 1 and (one.isalpha() or one in SIGNS) else ""
        return found

    def read(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different restored words of the texts, and for each reading of each word of each text its number and text."""
        data, offsets = raw(column)
        data = lowered(data)
        starts, ends, text = words(data, offsets)
        found, number = distinct(data, starts, ends)
        known = [self.word(w) for w in found]
        # Letters spaced out: three or more words of one character in a row, a letter among them, are read together.
        single = np.array([bool(one) for _, one in known] or [False])[number] if len(number) else np.zeros(0, bool)
        extra: list[tuple[str, int]] = []
        for a, b in runs(single, text):
            tokens = [known[k][1] for k in number[a:b].tolist()]
            if any(map(str.isalpha, "".join(tokens))):
                extra += [(w, int(text[a])) for w in self.channel.spaced(tokens)]
        table: dict[str, int] = {}
        first = np.array([table.setdefault(r[0], len(table)) for r, _ in known], np.int64)
        second = np.array([table.setdefault(r[1], len(table)) if len(r) > 1 else -1 for r, _ in known], np.int64)
        last = [table.setdefault(w, len(table)) for w, _ in extra]
        if not len(number):
            return list(table), np.zeros(0, np.int64), np.zeros(0, np.int64)
        more = second[number]
        return list(table), np.concatenate((first[number], more[more >= 0], last)).astype(np.int64), np.concatenate((text, text[more >= 0], [t for _, t in extra])).astype(np.int64)


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [f"={word}", *[word[:n] for n in BEGINNINGS if len(word) > n]] if word else []


def learned(docs: DataFrame, labels: DataFrame, channel: Channel, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[dict[str, float], float]:
    """Weights of the lexicon's features, and the weight of a document without any, from labelled rows outside the held-out quarter.

    At most MOST_LABELLED labelled rows, drawn by the hash of their identifiers, teach; so they can meet their texts by a broadcast
    of bounded size. A feature counts once a document, and documents of one text count once.
    """
    known = labels.where(F.col(label_col).isNotNull() & (held_out(id_col) == F.lit(False))).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("long")).alias("label"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(MOST_LABELLED)
    rows = docs.select(F.col(id_col).alias("__id"), whole(text_col).alias("text")).join(F.broadcast(known), "__id").groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.first("text").alias("text"), F.max("label").alias("label"))
    rows = written(rows.select("text", "label"), "toxic-labelled")
    reader = Reader(channel)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            pairs = list(sums.values())
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["feature", "docs", "ones"])

        for batch in pieces(batches, "text", BATCH_BYTES):
            label = np.array(batch.column("label").to_pylist(), np.int64)
            names, number, text = reader.read(batch.column("text"))
            pair = np.unique(number * batch.num_rows + text)
            for name, t in zip((names[i] for i in (pair // batch.num_rows).tolist()), (pair % batch.num_rows).tolist(), strict=True):
                for f in (f"={name}",) if name else ():
                    entry = sums.setdefault(f, [0, 0])
                    entry[0] += 1
                    entry[1] += int(label[t])
            begin: dict[str, int] = {}
            of = [[begin.setdefault(f, len(begin)) for f in features(n)[1:]] for n in names]
            sizes = np.array([len(x) for x in of] or [0])
            flat = np.array([k for x in of for k in x], np.int64)
            if len(flat):
                first = np.cumsum(sizes) - sizes
                w, t = pair // batch.num_rows, pair % batch.num_rows
                total = np.cumsum(sizes[w])
                each = np.unique(flat[np.repeat(first[w] - (total - sizes[w]), sizes[w]) + np.arange(total[-1])] * batch.num_rows + np.repeat(t, sizes[w]))
                docs_of = np.bincount(each // batch.num_rows, minlength=len(begin))
                ones_of = np.bincount(each // batch.num_rows, label[each % batch.num_rows], minlength=len(begin))
                for f, n, one in zip(begin, docs_of.tolist(), ones_of.tolist(), strict=True):
                    entry = sums.setdefault(f, [0, 0])
                    entry[0] += n
                    entry[1] += int(one)
            if len(sums) > 200_000:
                yield out()
                sums.clear()
        if sums:
            yield out()

    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).head()
    base = (totals["ones"] + 0.5) / (totals["n"] + 1)
    chance = (F.col("ones") + PRIOR * base) / (F.col("docs") + PRIOR)
    found = rows.mapInArrow(counted, "feature string, docs long, ones long").groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("ones").alias("ones"))
    found = found.where((F.col("ones") >= LEAST_DOCS) & (chance >= LEAST_CHANCE) & (chance >= 2 * base)).orderBy((chance * F.sqrt("ones")).desc(), "feature").limit(MOST_MARKS)
    lexicon = [r["feature"] for r in found.select("feature").collect()]
    if not lexicon:
        return {}, math.log(base / (1 - base))
    number = {f: k for k, f in enumerate(lexicon)}
    seen = written(rows.mapInArrow(lambda b: _marked(b, reader, number, "label"), "label long, marks array<int>"), "toxic-marks")
    named = seen.select(F.col("label").cast("double").alias("label"), F.transform("marks", lambda k: k.cast("string")).alias("marks"))
    vectors = CountVectorizerModel.from_vocabulary([str(k) for k in range(len(lexicon))], "marks", "features")
    model = LogisticRegression(regParam=RIDGE, maxIter=60, standardization=False).fit(vectors.setBinary(True).transform(named))
    return dict(zip(lexicon, model.coefficients.toArray().tolist(), strict=True)), float(model.intercept)


class Marker:
    """The lexicon's features in texts, through the channel; the numbers of a word's features are kept for later batches."""

    def __init__(self, reader: Reader, number: dict[str, int]) -> None:
        self.channel, self.number, self.memo = reader.channel, number, Memo(self.marks_of, most_kept=300_000)
        self.reader = Reader(reader.channel, 0)

    def marks_of(self, found: list[bytes]) -> list[list[int]]:
        """The marks of each word, after ONE for a word of one character that may be part of a word spaced out."""
        out, number = [], self.number
        for word in found:
            if len(word) > 1 and word.isalpha() and not _THRICE.search(word):  # nothing can be hidden
                w = word.decode()
                out.append([number[f] for f in (f"={w}", *[w[:n] for n in BEGINNINGS if len(w) > n]) if f in number])
            else:
                readings, one = self.reader.word(word)
                out.append([ONE] * bool(one) + self.marks(readings))
        return out

    def marks(self, readings: list[str]) -> list[int]:
        return [self.number[f] for f in {f for r in readings for f in features(r)} if f in self.number]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, mark), once each and in order."""
        data, offsets = raw(column)
        data = lowered(data)
        starts, ends, text = words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Punctuation that is never a letter goes from both ends.
        inner = np.flatnonzero(~_PUNCTUATION[data])
        to = np.searchsorted(inner, ends)
        bare = np.append(inner, len(data))[np.searchsorted(inner, starts)]
        values, first, many = self.memo.look(data, np.minimum(bare, ends), np.where(bare < ends, inner[to - 1] + 1 if len(inner) else ends, ends))
        some = np.flatnonzero(many)
        mark, owner, place = spread(values, first[some], many[some]).astype(np.int64), np.repeat(text[some], many[some]), np.repeat(some, many[some])
        single = np.zeros(len(starts), bool)
        single[place[mark == ONE]] = True
        more: list[tuple[int, int]] = []
        for a, b in runs(single, text):
            tokens = [data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace").lower() for k in range(a, b)]
            if any(map(str.isalpha, "".join(tokens))):
                more += [(int(text[a]), m) for m in self.marks(self.channel.spaced(tokens))]
        plain = mark != ONE
        n = max(1, len(self.number))
        pair = np.unique(np.concatenate((owner[plain] * n + mark[plain], np.array([t * n + m for t, m in more], np.int64))))
        return pair // n, pair % n


def runs(single: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where at least LEAST_SPACED single words of one text follow one another."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (single * (text + 1)).astype(np.int64), [0]))))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if single[a] and b - a >= LEAST_SPACED:
            yield a, b


def _marked(batches: Iterator[pa.RecordBatch], reader: Reader, number: dict[str, int], key: str) -> Iterator[pa.RecordBatch]:
    """The key column of the batches, and the lexicon's features in each text, once each."""
    marker = Marker(reader, number)
    for batch in pieces(batches, "text", BATCH_BYTES):
        text, mark = marker(batch.column("text"))
        marks = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32()), pa.array(mark, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(key), marks], [key, "marks"])


def held_out(id_col: str):
    """Rows that no label is learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def score(docs: DataFrame, weights: dict[str, float], base: float, channel: Channel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row of docs, over whole restored texts; a text without marks has the score of the base alone."""
    number, value = {f: k for k, f in enumerate(weights)}, np.array([*weights.values(), 0.0])
    reader = Reader(channel)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _marked(batches, reader, number, "doc_id"):
            marks = batch.column("marks")
            sums = np.concatenate(([0.0], np.cumsum(value[np.asarray(marks.values)])))
            at = np.asarray(marks.offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-(base + sums[at[1:]] - sums[at[:-1]]))))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(scored, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 from threshold on).

    Without labelled rows of label 1 the lexicon is empty and all have one score, about the share of label 1. Rows that repeat an identifier are each scored; a
    null identifier is not held out. Columns but identifier and text are not read.
    """
    channel = Channel(*corpus_counts(docs, text_col))
    weights, base = learned(docs, labels, channel, id_col, text_col)
    channel.price_words([w for f in weights if f[0] == "=" and (w := f[1:]).isalpha()])
    found = score(docs, weights, base, channel, id_col, text_col)
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL: dict[str, str] = {}
