"""URL rules by hashed expressions: host suffixes and path prefixes, short hash prefixes joined, full digests confirmed.

DataFrame functions only. A rule is (host, path, verdict). It fits a URL whose
host is the rule's or a subdomain of it, and whose path starts with the rule's.

1. Every distinct (host, path) of the URLs is expanded into expressions: the host's
   suffixes at dots, times the path's prefixes that end in ``/`` (and the empty
   one). Suffixes with more labels and prefixes longer than any rule has cannot
   meet a rule and are not made, so an endless URL makes no more expressions than others.
2. The expressions join the rules' folders (host, path up to its last ``/``) on
   the first PREFIX hex digits of a SHA-256; the full digest confirms. A folder knows
   the lengths of its rules' paths.
3. The path's prefixes of these lengths join the rules in the same way. So a
   folder with a million rules adds one expression per length, not one per rule.
4. Of the rules that fit, the longest (host and path together) decides; at equal
   length the one with the longer host, then ``block`` before ``allow``. A URL that no
   rule fits gets the default verdict.

Joins are equi-joins whose strategy Spark picks by the rules' size on disk: a small
rule list is sent to every task, a large one is shuffled, and AQE splits hot expressions
(``com/`` is in half of all URLs). Equal URLs are worked out once.

Defined cases: a URL that is null or has no ``://`` has an empty host and path, and gets the default verdict
unless a rule has an empty host and path; rules with a null host, path or verdict are ignored; equal rules
count once; repeated rows stay; a URL of any length is expanded as said above; without rules every
URL gets the default verdict; an empty table gives an empty result; input columns named like the added ones
(host, path, rule, verdict) are left out of the result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import let, stored, table, unused

#: Hex digits of a digest that the joins go by.
PREFIX = 8
ADDED = ["host", "path", "rule", "verdict"]
#: The query's rules, a fixed value: host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT = "allow"


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, most: int) -> Column:
    """The host and its parents, as far as they have at most ``most`` labels."""
    return let(
        F.split(host, r"\."),
        lambda labels: F.transform(
            F.sequence(F.greatest(F.size(labels) - (most - 1), F.lit(1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
        ),
    )


def path_folders(path: Column, longest: int) -> Column:
    """The empty prefix and the prefixes that end in ``/``, up to ``longest`` characters."""
    return let(
        F.split(F.substring(path, 1, longest), "/"),
        lambda parts: F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))),
    )


def _digest(host: Column, path: Column) -> Column:
    # A host has no "/", so the two cannot be confused.
    return F.sha2(F.concat(host, F.lit("/"), path), 256)


def _hash_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose ``digest`` is equal, met by its first digits; the right side's digest goes."""
    short = F.substring("digest", 1, PREFIX)
    a, b = left.withColumn("short", short), right.withColumn("short", short).withColumnRenamed("digest", "full")
    return a.join(b, "short").where(F.col("digest") == F.col("full")).drop("short", "digest", "full")


def rule_table(rules: DataFrame) -> DataFrame:
    """The usable rules, one per host and path: host, path, verdict, digest, folder digest."""
    known = rules.select(F.col("host").cast("string"), F.col("path").cast("string"), F.col("verdict").cast("string")).dropna()
    host = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)
    folder = F.regexp_extract("path", r"(?s)^(.*/)?", 0)
    once = known.groupBy(host.alias("host"), "path").agg(F.max("verdict").alias("verdict"))  # "block" is after "allow"
    return stored(once.select("host", "path", "verdict", _digest(F.col("host"), F.col("path")).alias("digest"), folder.alias("folder")), "url-rules")


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Per distinct (host, path) of ``urls`` that a rule fits: host, path, rule, verdict. ``rules`` is a ``rule_table``."""
    shape = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.length("folder")).alias("folder")).first()
    if shape["labels"] is None:
        return rules.select("host", "path", F.col("host").alias("rule"), "verdict").limit(0)
    folders = rules.groupBy(_digest(F.col("host"), F.col("folder")).alias("digest")).agg(F.collect_set(F.length("path")).alias("lengths"))
    expanded = (
        urls.select("host", "path")
        .distinct()
        .withColumn("suffix", F.explode(host_suffixes(F.col("host"), shape["labels"])))
        .withColumn("folder", F.explode(path_folders(F.col("path"), shape["folder"])))
        .select("host", "path", "suffix", _digest(F.col("suffix"), F.col("folder")).alias("digest"))
    )
    met = _hash_join(expanded, folders).withColumn("n", F.explode("lengths")).where(F.length("path") >= F.col("n"))
    prefixes = met.select("host", "path", _digest(F.col("suffix"), F.substr("path", F.lit(1), "n")).alias("digest"))
    fitting = _hash_join(prefixes, rules.select("digest", F.col("host").alias("rule_host"), F.concat("host", "path").alias("rule"), "verdict"))
    best = F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "rule", "verdict"))
    return fitting.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def judge_urls(rows: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``rows`` with host, path, rule (null if none fits) and verdict."""
    spare = [c for c in rows.columns if c.lower() not in ADDED]
    taken = rows.columns + ADDED
    host, path = unused(taken, "_host"), unused(taken, "_path")
    given = rows.withColumns({host: url_host(F.col(url)), path: url_path(F.col(url))}).select(*spare, host, path)
    found = fitting_rules(given.select(F.col(host).alias("host"), F.col(path).alias("path")), rule_table(rules))
    found = stored(found, "url-verdicts")
    joined = given.join(found, (F.col(host) == found["host"]) & (F.col(path) == found["path"]), "left")
    return joined.select(*[given[c] for c in spare], F.col(host).alias("host"), F.col(path).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules).drop("url")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE_SQL = f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {_VALUES}),
u AS (
  SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), m AS (
  SELECT rid, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS r
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (rid)
"""
