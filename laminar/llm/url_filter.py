"""URL filters: host-suffix and path-prefix expressions, hash-prefix equi-join, digest check, rule precedence.

A rule is (host, path, verdict). It fits its host and every subdomain if the url's path starts with the rule's
path; of all fitting rules the longest expression wins (then the longer host, then block before allow).

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and gets the default
verdict; an empty page table gives no rows; repeated rows each get their own row; extra columns of `pages` are not
looked at; a url gives an expression for each label of its host and each
length that rule paths have, however long it is. With an empty rule table every page gets the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The rules of the contract (fixed values).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

#: Hex digits of the digest in the join key (32 bits).
PREFIX_DIGITS = 8
#: Rule tables of at most so many rows are broadcast (under 200 bytes a row); larger ones are joined by a shuffle.
BROADCAST_RULES = 200_000


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(common.lower_ascii(host), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    schema = "host string, path string, verdict string"
    if not rules:
        return spark.sql("SELECT '' host, '' path, '' verdict WHERE false")
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({q(h)}, {q(p)}, {q(v)})" for h, p, v in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, verdict)").to(spark.createDataFrame([], schema).schema)


def host_suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every (host suffix, path prefix) expression; prefixes are taken at the lengths that rule paths have."""
    ends = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.flatten(F.transform(host_suffixes(host), lambda h: F.transform(ends, lambda n: F.concat(h, F.lit("\n"), F.substring(path, F.lit(1), n)))))


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(host, path), distinct -> the fitting rule that wins, for those that any rule fits: host, path, rule, verdict."""
    seen = rules.agg(F.collect_set(F.length("path")).alias("lengths"), F.count("*").alias("n")).first()
    keyed = rules.select(
        F.sha2(F.concat(F.col("host"), F.lit("\n"), F.col("path")), 256).alias("r_digest"),
        F.concat("host", "path").alias("rule"), F.length("host").alias("r_host"), F.col("verdict"),
    )
    keyed = keyed.withColumn("prefix", F.substring("r_digest", 1, PREFIX_DIGITS))
    if seen["n"] <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    lengths = sorted(x for x in seen["lengths"] if x is not None) or [0]
    asked = urls.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("e"))
    asked = asked.select("host", "path", F.sha2("e", 256).alias("digest"))
    asked = asked.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    hits = asked.join(keyed, "prefix").where(F.col("digest") == F.col("r_digest"))
    rank = F.struct(F.length("rule"), "r_host", F.col("verdict") == "block", "rule", "verdict")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict.

    Equal (host, path) pairs are judged once; a url shared by a third of the pages costs one judgement, and the join
    back is one whose large partitions Spark splits.
    """
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    found = judge(rows.select("host", "path").distinct(), rules)
    return rows.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.table(spark, sf_dir, "pages"), rules_table(spark))


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(h, pre, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT DISTINCT host, path FROM p),
m AS (
  SELECT host, path, arg_max(h || pre, length(h || pre)) AS rule, arg_max(verdict, length(h || pre)) AS verdict
  FROM u, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY host, path)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""
