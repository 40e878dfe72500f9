"""URL filtering by host and path rules, found through their rarest literal token.

A rule is a host and a path prefix with an action. It fits its host and every subdomain when the URL's path
starts with the rule's path; of several, the longest host + path wins (ties: the smaller rule text). Each rule is
filed under the one of its literal tokens (host labels, whole path segments) that fewest URLs of the corpus
contain. A URL's own tokens fetch the rules filed under them, and only these candidates run as regular
expressions. Everything is DataFrame functions.

Defined cases: a null URL or one without ``://`` has empty host and path and fits no rule; URLs that fit no rule
get the default verdict; repeated rows are each answered; null ids are kept; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import lower_ascii

#: Rule tables with at most so many rows are broadcast; larger ones are joined by a shuffle on the token.
BROADCAST_RULES = 50_000


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tagged(kind: str, parts: Column) -> Column:
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct host labels (h:) and path segments (p:)."""
    return F.array_distinct(F.concat(_tagged("h:", F.split(host, r"\.")), _tagged("p:", F.split(path, "/"))))


def rule_tokens(host: Column, path: Column) -> Column:
    """As url_tokens, but of a path only what a slash closes: the last, open segment may go on in the URL."""
    return url_tokens(host, F.regexp_extract(path, r"(?s)^(.*/)?", 1))


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([^A-Za-z0-9/])", r"\\$1")


def compile_rules(rules: DataFrame) -> DataFrame:
    """rules(host, path, action) with the rule text, its length, its regular expression and its tokens."""
    host, path = lower_ascii(F.col("host")), F.coalesce(F.col("path"), F.lit(""))
    end = F.when(F.col("rule_path") == "", F.lit("(?:/|$)")).otherwise(F.lit(""))
    return (
        rules.where(F.col("host") != "")
        .select(host.alias("rule_host"), path.alias("rule_path"), F.col("action"))
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("pattern", F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), _quoted(F.col("rule_host")), _quoted(F.col("rule_path")), end))
        .withColumn("tokens", rule_tokens(F.col("rule_host"), F.col("rule_path")))
    )


def index_rules(compiled: DataFrame, urls: DataFrame, small: bool) -> DataFrame:
    """One row per rule with the token that fewest of urls(host, path) hold."""
    tokens = compiled.select("rule", F.explode("tokens").alias("token"))
    wanted = tokens.select("token").distinct()
    counts = (
        urls.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
        .join(F.broadcast(wanted) if small else wanted, "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    rarest = tokens.join(counts, "token", "left").groupBy("rule").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    return compiled.join(rarest, "rule").select("rule", "action", "pattern", "token")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule and verdict for every row of pages."""
    source = pages.select(F.col(key).alias("key"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    urls = source.select("host", "path").where(F.col("host") != "").distinct()
    compiled = compile_rules(rules).dropDuplicates(["rule"])
    small = compiled.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    index = index_rules(compiled, urls, small)
    found = (
        urls.select("host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
        .join(F.broadcast(index) if small else index, "token")
        .where(F.expr("regexp_like(concat(host, path), pattern)"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), F.col("rule"))).alias("best"))
    )
    return source.join(found, ["host", "path"], "left").select(
        F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
