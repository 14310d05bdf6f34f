"""Greedy choices by distance inside one row, as folds over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalise import col
from .objects import bound

COUNTS = "array<struct<label:string,tp:double,fp:double,fn:double>>"
#: What parts words, as Python's str.split has it.
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def token_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits between two arrays of tokens over the size of the first; an empty reference gives 0 or, against tokens, 1.

    Each different token of the two becomes one character, so that the JVM's edit distance of texts is that of the tokens.
    """
    every = F.array_distinct(F.concat(reference, hypothesis))
    letter = lambda x: F.decode(F.unhex(F.lpad(F.hex(F.array_position(every, x) + 0x10000), 8, "0")), "UTF-32")
    text = lambda tokens: F.array_join(F.transform(tokens, letter), "")
    return F.when(F.size(reference) == 0, F.when(F.size(hypothesis) == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.levenshtein(text(reference), text(hypothesis)) / F.size(reference))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda x: x != "")


def word_distance(gold: Column, pred: Column) -> Column:
    return token_rate(tokens(gold), tokens(pred))


def char_distance(gold: Column, pred: Column) -> Column:
    longest = F.greatest(F.length(gold), F.length(pred))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(gold, pred) / longest)


DISTANCES: dict[str, Callable[[Column, Column], Column]] = {"word": word_distance, "char": char_distance}


def _entry(label: Column, tp: Column | float, fp: Column | float, fn: Column | float) -> Column:
    value = lambda x: (F.lit(x) if isinstance(x, float) else x).cast("double")
    return F.struct(label.alias("label"), value(tp).alias("tp"), value(fp).alias("fp"), value(fn).alias("fn"))


def greedy_counts(gold: str | Column, pred: str | Column, kind: str) -> Column:
    """(label, tp, fp, fn) for each prediction, in order, and each gold entity that is left.

    A prediction takes the nearest gold entity of its type that no prediction before it took, the first of equals: 1 right, and the
    distance wrong on either side. Without one it is wrong, as is each gold entity left over.
    """

    def fold(gold: Column, pred: Column) -> Column:
        text = lambda e: F.coalesce(e["filler"], F.lit(""))
        at = lambda i: F.get(gold, i)

        def step(s: Column, p: Column) -> Column:
            options = F.transform(F.filter(s["left"], lambda i: at(i)["type"].eqNullSafe(p["type"])), lambda i: F.struct(DISTANCES[kind](text(at(i)), text(p)).alias("d"), i.alias("i")))
            taken = lambda best: F.struct(F.filter(s["left"], lambda i: i != best["i"]).alias("left"), F.concat(s["out"], F.array(_entry(p["type"], 1.0, best["d"], best["d"]))).alias("out"))
            missed = F.struct(s["left"].alias("left"), F.concat(s["out"], F.array(_entry(p["type"], 0.0, 1.0, 0.0))).alias("out"))
            return bound(F.array_min(options), lambda best: F.when(best.isNotNull(), taken(best)).otherwise(missed))

        every = F.when(F.size(gold) > 0, F.sequence(F.lit(0), F.size(gold) - 1)).otherwise(F.array().cast("array<int>"))
        start = F.struct(every.alias("left"), F.array().cast(COUNTS).alias("out"))
        return F.aggregate(pred, start, step, lambda s: F.concat(s["out"], F.transform(s["left"], lambda i: _entry(at(i)["type"], 0.0, 0.0, 1.0))))

    return bound(F.struct(col(gold).alias("gold"), col(pred).alias("pred")), lambda row: fold(row["gold"], row["pred"]))


def slu_counts(gold: str | Column, pred: str | Column) -> Column:
    """The greedy counts by words and by characters, one after the other."""
    return F.concat(greedy_counts(gold, pred, "word"), greedy_counts(gold, pred, "char"))


def diverse_nbest(c: str | Column, k: int) -> Column:
    """Up to k hypotheses: the first, then again and again the one whose nearest chosen one is farthest by edits, the first of equals.

    Texts that are equal in lower case with single spaces count once, as the first of them; null ones are left out. A null list has none.
    """
    plain = lambda t: F.array_join(tokens(F.lower(t)), " ")
    entry = lambda t, i: F.struct(F.lit(1 << 30).alias("near"), (-i).alias("order"), plain(t).alias("key"), t.alias("text"))

    def unique(rows: Column) -> Column:
        keys = F.transform(rows, lambda r: r["key"])
        return F.filter(rows, lambda r, i: F.array_position(keys, r["key"]) == i + 1)

    def step(s: Column, _: Column) -> Column:
        def take(best: Column) -> Column:
            rest = F.transform(F.filter(s["rest"], lambda r: r["order"] != best["order"]), lambda r: F.struct(F.least(r["near"], F.levenshtein(r["key"], best["key"])).alias("near"), r["order"].alias("order"), r["key"].alias("key"), r["text"].alias("text")))
            return F.when(best.isNull(), s).otherwise(F.struct(rest.alias("rest"), F.concat(s["chosen"], F.array(best["text"])).alias("chosen")))

        return bound(F.array_max(s["rest"]), take)

    def pick(rows: Column) -> Column:
        start = F.struct(rows.alias("rest"), F.array().cast("array<string>").alias("chosen"))
        return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(F.size(rows), F.lit(1)))), start, step, lambda s: s["chosen"])

    none = F.array().cast("array<string>")
    if k <= 0:
        return none
    given = F.filter(F.coalesce(col(c), none), lambda t: t.isNotNull())
    few = lambda rows: F.when(F.size(rows) <= k, F.transform(rows, lambda r: r["text"])).otherwise(pick(rows))
    return bound(F.transform(given, entry), lambda rows: bound(unique(rows), few))
