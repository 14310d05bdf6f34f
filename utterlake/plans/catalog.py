"""All registered queries of the library, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analysis, corpora, readings, scoring, text



def long_counts(sql: str) -> str:
    """Casts count_if(...) to BIGINT, as Spark's counts are."""
    out, at = [], 0
    while (start := sql.find("count_if(", at)) >= 0:
        depth, end = 0, start + 8
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        out += [sql[at:start], "CAST(", sql[start:end], " AS BIGINT)"]
        at = end
    return "".join(out) + sql[at:]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**scoring.QUERIES, **analysis.QUERIES, **text.QUERIES, **readings.QUERIES, **corpora.QUERIES}
SQL: dict[str, str] = {k: long_counts(v) for k, v in {**scoring.SQL, **analysis.SQL, **text.SQL, **readings.SQL, **corpora.SQL}.items()}
