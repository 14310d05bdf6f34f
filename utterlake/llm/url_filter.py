"""URL rules indexed by their rarest literal token.

A rule is a pattern over ``host/path``: plain text with ``*`` for any run, anchored to a host and its subdomains by ``||``.
Its literal tokens are the alphanumeric runs that are whole tokens of any URL it fits. Each rule is filed under the one of
them that the fewest URLs hold; the tokens of a URL fetch its candidate rules, and only those run their regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (verdict, host/path): a rule fits its host and all subdomains where the URL's path starts with the rule's.
SITE_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Where no site rule fits: any of these blocks.
BLOCK_PATTERNS = ("||spam-farm.*", "||cheap-pills.*", "*.spam-farm.*", "*.cheap-pills.*", "*/free-casino/*", "*/adult-content/*")
#: Rules are parameters of a job; the index of at most so many is sent to every task.
MOST_BROADCAST = 200_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or where there is no ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s)(?:(?!://).)*://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s)(?:(?!://).)*://[^/?#]*([^?#]*)", 1)


def rule_rows(site_rules: Sequence[tuple[str, str]], patterns: Sequence[str]) -> list[tuple]:
    """(rule, verdict, kind, regular expression, literal tokens) of each rule."""
    rows = [(rule, verdict, "site", r"^(?s)([^/]*\.)?" + _escaped(rule), _tokens("||" + rule + "*")) for verdict, rule in site_rules]
    for p in patterns:
        body = p.removeprefix("||")
        start = r"^(?s)([^/]*\.)?" if p.startswith("||") else r"^(?s)"
        rows.append((p, "block", "pattern", start + ".*".join(_escaped(x) for x in body.split("*")) + "$", _tokens(p)))
    return rows


def _escaped(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def _tokens(pattern: str) -> list[str]:
    """Alphanumeric runs with a literal boundary on both sides: such a run is a whole token wherever the pattern fits."""
    text = f"|{pattern.removeprefix('||')}|" if pattern.startswith("||") else f"|{pattern}|"
    return sorted({m[1].lower() for m in re.finditer(r"(?<=[^A-Za-z0-9*])([A-Za-z0-9]+)(?=[^A-Za-z0-9*])", text)})


def url_filter(pages: DataFrame, url_col: str = "url", site_rules: Sequence[tuple[str, str]] = SITE_RULES, patterns: Sequence[str] = BLOCK_PATTERNS) -> DataFrame:
    """All rows and columns of pages, with host, path, rule (the longest site rule that fits, else null) and verdict.

    Where no site rule fits, a URL is blocked if any pattern fits, else allowed. Rules without a whole literal token are filed
    under the empty token, which every URL fetches. A null or malformed URL has an empty host and path, fits no rule and is
    allowed. Equal URLs are judged once; columns of pages called host, path, rule or verdict are replaced.
    """
    spark = pages.sparkSession
    rules = rule_rows(site_rules, patterns)
    extra = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    keyed = pages.select(*extra, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not rules:
        return keyed.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    urls = keyed.select("host", "path").distinct()
    tokens = urls.select("host", "path", F.explode(F.array_distinct(F.split(F.concat_ws("/", F.lower("host"), F.lower("path"), F.lit("")), "[^a-z0-9]+"))).alias("token"))
    listed = spark.createDataFrame([(r, v, k, x, t) for r, v, k, x, ts in rules for t in ts or [""]], "name string, does string, kind string, regex string, token string")
    small = F.broadcast if len(rules) <= MOST_BROADCAST else lambda df: df
    counts = tokens.join(small(listed.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = (
        listed.join(counts, "token", "left").groupBy("name", "does", "kind", "regex")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )
    fits = tokens.join(small(index), "token").where(F.expr("concat(host, path) rlike regex"))
    best = fits.groupBy("host", "path").agg(
        F.max_by(F.struct("name", "does"), F.when(F.col("kind") == "site", F.struct(F.length("name"), "name"))).alias("site"),
        F.max(F.col("kind") == "pattern").alias("blocked"),
    )
    return keyed.join(best, ["host", "path"], "left").select(
        *extra, "host", "path", F.col("site.name").alias("rule"),
        F.coalesce(F.col("site.does"), F.when(F.col("blocked"), F.lit("block")), F.lit("allow")).alias("verdict"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_PARTS = r"""
WITH u AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '^(?s)(?:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^(?s)(?:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(does, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT DISTINCT host, path, h || p AS rule, does FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(does, length(rule)) AS does FROM f GROUP BY host, path)
SELECT page_id, u.host, u.path, rule,
  CASE WHEN does IS NOT NULL THEN does
       WHEN regexp_matches(u.host || u.path, '^([^/]*\.)?(spam-farm|cheap-pills)\.') OR regexp_matches(u.host || u.path, '\.(spam-farm|cheap-pills)\.|/free-casino/|/adult-content/') THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN best USING (host, path)"""
SQL = {"op3_url_filter": _PARTS}
