"""Edit distances of words, phones and spans (M4, M5, M8-M10), as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import overall, with_prf
from .normalise import col
from .spans import BLANKS, greedy_counts, slu_counts, token_rate


def word_tokens(c: str | Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), BLANKS), lambda x: x != "")


def phone_tokens(c: str | Column) -> Column:
    """Phones parted by spaces, or else characters; / [ ] part phones, too."""
    bare = F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)[\s/\[\]]+", " "))
    return F.filter(F.split(bare, F.when(F.contains(bare, F.lit(" ")), F.lit(" ")).otherwise(F.lit(""))), lambda x: x != "")


def wer(reference: str | Column, hypothesis: str | Column) -> Column:
    """M8: word error rate, in lower case; an empty reference gives 0 or, against words, 1."""
    return token_rate(word_tokens(reference), word_tokens(hypothesis))


def per(reference: str | Column, hypothesis: str | Column) -> Column:
    """M9: phone error rate: phones parted by spaces, or else characters; / [ ] count as spaces."""
    return token_rate(phone_tokens(reference), phone_tokens(hypothesis))


def char_distance(reference: str | Column, hypothesis: str | Column) -> Column:
    """M8: character distance over the longer length; 0 for two empty texts."""
    a, b = F.lower(F.trim(F.coalesce(col(reference), F.lit("")))), F.lower(F.trim(F.coalesce(col(hypothesis), F.lit(""))))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def nbest_report(df: DataFrame, reference: str = "reference_text", nbest: str = "asr_nbest") -> DataFrame:
    """Rows with top-1 and oracle (least) word error rate of an n-best list; null without hypotheses."""

    rates = F.transform(F.coalesce(col(nbest), F.array().cast("array<string>")), lambda h: token_rate(word_tokens(reference), word_tokens(h)))
    found = df.withColumn("__rates", rates)
    return found.withColumns({"top1_wer": F.get("__rates", F.lit(0)), "oracle_wer": F.array_min("__rates")}).drop("__rates")


def nbest_summary(report: DataFrame) -> DataFrame:
    """Means without nulls, and how many rows have them."""
    return report.agg(F.count(F.lit(1)).alias("n"), F.count("top1_wer").alias("scored"), F.avg("top1_wer").alias("top1_wer"), F.avg("oracle_wer").alias("oracle_wer"), (F.avg("top1_wer") - F.avg("oracle_wer")).alias("gap"))


def distance_counts(matched: DataFrame, counts: Column) -> DataFrame:
    """Sums by type of what greedy_counts gives for each row."""
    return matched.select(F.explode(counts).alias("e")).groupBy(F.col("e.label").alias("label")).agg(*[F.sum(f"e.{c}").alias(c) for c in ("tp", "fp", "fn")])


def span_distance_f1(matched: DataFrame, kind: str = "word", gold: str = "gold_entities", pred: str = "pred_entities") -> DataFrame:
    """M4: entity scores where a match counts 1 right and its distance wrong on either side, by type and overall."""
    counts = distance_counts(matched, greedy_counts(gold, pred, kind))
    return with_prf(counts).unionByName(overall(counts))


def slu_f1(matched: DataFrame, gold: str = "gold_entities", pred: str = "pred_entities") -> DataFrame:
    """M5: scores of the summed word and char counts, both from one pass over the rows."""
    counts = distance_counts(matched, slu_counts(gold, pred))
    return with_prf(counts).unionByName(overall(counts))
