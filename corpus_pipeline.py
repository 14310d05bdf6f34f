"""Five corpus stages in a row; each works on all its predecessor kept.

Stages but the last return the columns of their input, whatever they are called. Null texts count as empty: one of the empty texts
stays, and the mix keeps it. Rows without an identifier are scored as a group that is never dropped as toxic or as near copies; of
rows that repeat one identifier, equal ones become one, and near copies go or stay together. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.llm.bpe import digests
from utterlake.llm.common import table, written
from utterlake.llm.exact_dedup import keep_first
from utterlake.llm.mixing import mixed
from utterlake.llm.near_dedup import keep_representatives
from utterlake.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, by what the labelled ones among them teach; rows without an identifier stay."""
    rejected = toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest identifier."""
    return keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every document, and of the text they decode to, with its source."""
    return digests(docs, extra=["source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the learned scores nor the seeded draws and merges; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
