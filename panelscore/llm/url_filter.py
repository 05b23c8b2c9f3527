"""URL filters by host-suffix and path-prefix expressions, with DataFrame functions only.

Each url is expanded into (host suffix, path prefix) expressions as deep as the rules go. The expressions meet
the rules on the first 32 bits of their SHA-256; the full digest and the exact prefix confirm, the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscore.session import pin

#: Fixed values of the registered query.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: str = "url") -> tuple:
    """Host (A-Z lower-cased) and path; both empty for null or no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _digest(host, folder):
    return F.sha2(F.concat(host, F.lit("\n"), folder).cast("binary"), 256)


def _folder(path):
    """The path up to its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """(url, host, path, rule, verdict) for each distinct url.

    A rule fits its host and all subdomains if the path starts with the rule's path. The rule with most characters wins;
    of equally long ones that with the longer host, then a block. A url that no rule fits, an empty or null url too, gets
    a null rule and the default verdict. Rules with a null part count as none. Other columns of ``pages`` are not touched;
    repeated urls give one row, no urls no rows.
    """
    known = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null").distinct()
    depth = known.agg(
        F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)),
        F.coalesce(F.max(F.length(F.regexp_replace("path", "[^/]", ""))), F.lit(0)),
    ).first()
    host, path = url_parts("url")
    urls = pages.select(F.col(url).alias("url")).distinct().select("url", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(depth[0], 1)))),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
    )
    steps = F.split("path", "/")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(steps) - 1, F.lit(depth[1]))),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, 1, n), "/"), F.lit("/"))),
    )
    expressions = (
        urls.select("url", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("url", "path", "suffix", F.explode("prefixes").alias("folder"))
        .select("url", "path", _digest(F.col("suffix"), F.col("folder")).alias("digest"))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    keyed = known.select(
        F.col("path").alias("rule_path"),
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_chars"),
        F.col("verdict").alias("rule_verdict"),
        _digest(F.col("host"), _folder(F.col("path"))).alias("rule_digest"),
    ).withColumn("short", F.substring("rule_digest", 1, 8))
    best = (
        expressions.join(keyed, "short")
        .where("digest = rule_digest and startswith(path, rule_path)")
        .groupBy("url")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "host_chars", "rule_verdict", "rule")).alias("best"))
    )
    return urls.join(best.withColumnRenamed("url", "hit"), F.col("url").eqNullSafe(F.col("hit")), "left").select(
        "url",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )


def judge_pages(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict. Rows keep null and repeated ids."""
    # Written, so that a url of very many rows can be split where it is joined.
    judged = pin(filter_urls(pages, rules, url)).withColumnRenamed("url", "judged_url")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("page_url"))
    host, path = url_parts("page_url")
    return rows.join(judged.select("judged_url", "rule", "verdict"), F.col("page_url").eqNullSafe(F.col("judged_url")), "left").select(
        "page_id", host.alias("host"), path.alias("path"), "rule", "verdict"
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id,
    CASE WHEN position('://' IN coalesce(url, '')) = 0 THEN '' ELSE
      translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN position('://' IN coalesce(url, '')) = 0 THEN '' ELSE regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's') END AS path
  FROM pages),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hit AS (
  SELECT page_id, host, path, (
    SELECT max(struct_pack(n := length(rh || rp), rule := rh || rp, v := v)) FROM r
    WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS b
  FROM p)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict FROM hit
"""


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))
