"""URL filters (operator 9), with DataFrame functions only.

Every distinct host and path is expanded into host-suffix + path-prefix expressions, but
only for the label counts and prefix lengths that some rule has: a URL gives at most
(label counts) x (prefix lengths) of them however long it is, and no rule can be missed.
Expressions meet the rules by an equi-join on the first 8 hex digits of their SHA-256;
equal full digests confirm.  Of the rules that fit, the longest (host and path together)
wins, of equally long ones the longer host, then block before allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "://([^/?#]*)([^?#]*)"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/")]
SHORT = 8


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _expressions(labels: list[int], lengths: list[int]) -> Column:
    """All host suffixes of so many labels, each with all path prefixes of so many characters."""
    path, have = F.col("__hl_path"), F.col("__hl_labels")
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)),
                           lambda n: F.substr(path, F.lit(1), n))
    suffixes = F.transform(F.filter(F.array(*map(F.lit, labels)), lambda k: k <= F.size(have)),
                           lambda k: F.array_join(F.slice(have, F.size(have) - k + 1, k), "."))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``
    (``default`` if none fits); columns of these names are replaced, other than the URL's.

    Null URLs and URLs without ``://`` have empty host and path, which only a rule with an
    empty host fits.  Rules with a null host are void, a null path is empty, rules given
    twice count once.  No rules: every verdict is ``default``.  Repeated rows stay.
    """
    rules = (rules.where(F.col("host").isNotNull())
             .select(F.lower("verdict").alias("v"), F.translate("host", UPPER, LOWER).alias("h"),
                     F.coalesce("path", F.lit("")).alias("p")).distinct().withColumn("rule", F.concat("h", "p")))
    # As many as the longest rule has labels and characters, whatever the number of rules.
    shape = rules.agg(F.collect_set(F.size(F.split("h", r"\."))).alias("labels"),
                      F.collect_set(F.length("p")).alias("lengths")).first()
    url = F.col(url_col).cast("string")
    kept = [c for c in pages.columns if c == url_col or c.lower() not in ("host", "path", "rule", "verdict")]
    out = pages.select(*kept, F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.lit("")).alias("__hl_host"),
                       F.coalesce(F.regexp_extract(url, _URL, 2), F.lit("")).alias("__hl_path"))
    if shape.labels:
        digest = F.sha2(F.col("rule").cast("binary"), 256)
        rules = rules.select(
            F.substring(digest, 1, SHORT).alias("__hl_short"), digest.alias("__hl_want"),
            F.struct((F.length("h") + F.length("p")).alias("n"), F.length("h").alias("nh"), (F.col("v") == "block").alias("b"),
                     "rule", "v").alias("__hl_rule"))
        won = (out.select("__hl_host", "__hl_path").distinct()
               .withColumn("__hl_labels", F.split("__hl_host", r"\."))
               .select("__hl_host", "__hl_path", F.explode(_expressions(sorted(shape.labels), sorted(shape.lengths))).alias("e"))
               .withColumn("__hl_full", F.sha2(F.col("e").cast("binary"), 256))
               .withColumn("__hl_short", F.substring("__hl_full", 1, SHORT))
               .join(small(rules), "__hl_short").where("__hl_full = __hl_want")
               .groupBy("__hl_host", "__hl_path").agg(F.max("__hl_rule").alias("__hl_rule")))
        out = out.join(won, ["__hl_host", "__hl_path"], "left")
        rule, verdict = F.col("__hl_rule.rule"), F.coalesce("__hl_rule.v", F.lit(default))
    else:
        rule, verdict = F.lit(None).cast("string"), F.lit(default)
    return out.select(*kept, F.col("__hl_host").alias("host"), F.col("__hl_path").alias("path"), rule.alias("rule"),
                      verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over all pages: page_id, host, path, rule, verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (
  SELECT rid, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fit USING (rid)
"""
