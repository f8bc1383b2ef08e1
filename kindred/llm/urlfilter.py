"""URL filtering by host-suffix and path-prefix expressions, equi-joined on short hash prefixes.

Every URL is expanded into its host suffixes (at label borders, of as many labels as rule hosts have at most) times its path
prefixes (of the lengths that rule paths have), so that a long URL has no more expressions than a short one. Expressions meet rules on the first four bytes of a SHA-256; the full digest then confirms, and of the
rules that fit, the longest (host and path together, then in text order, block before allow) gives the verdict.
DataFrame functions only. Different URLs are judged once, whatever the number of their rows, and only those that a rule fits
are joined back to the rows; the rows of a hot URL are a large partition of that join, which adaptive execution splits. Rules are written
and broadcast if their counted rows are within a bound, and shuffled beyond it.

Defined results: a null url, or one without ``://``, has an empty host and path; no rule fits an empty host; the
method's verdict where no rule fits is ``allow``; repeated rows, in any number, give repeated rows; no rules, or no rows, are no error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: (rule, verdict); a rule is a host followed by a path that begins with a slash.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
DEFAULT = "allow"
#: Bytes of a rule with its digest, for the bound of their broadcast.
RULE_BYTES = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule string, verdict string")


def parts(url):
    """Host and path columns of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule (null where none fits) and verdict of every row."""
    slash = F.instr("rule", "/")
    rules = rules.where("rule is not null and verdict is not null").select(
        "rule", "verdict", F.substr("rule", F.lit(1), slash - 1).alias("r_host"), F.substr("rule", slash).alias("r_path"), F.sha2("rule", 256).alias("digest")
    ).where(slash > 1)
    rules = scratch.save(rules, "rules")
    lengths = [r[0] for r in rules.select(F.length("r_path").alias("n")).distinct().orderBy("n").collect()]  # as many as rule path lengths differ
    most = rules.agg(F.max(F.size(F.split("r_host", r"\.", -1)))).first()[0] or 1
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = rows.where("url is not null").select("url").distinct().select("url", F.split(host, r"\.", -1).alias("labels"), path.alias("path"))
    tail = F.slice("labels", F.greatest(F.lit(1), F.size("labels") - most + 1), F.size("labels"))
    suffixes = F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels) - i + 1), '.'))")
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substr("path", F.lit(1), F.lit(n))) for n in lengths]) if lengths else F.array().cast("array<string>"), lambda p: p.isNotNull())
    urls = urls.withColumn("labels", tail).withColumn("suffixes", suffixes).withColumn("prefixes", prefixes)
    expanded = urls.select("url", F.explode(F.expr("flatten(transform(suffixes, s -> transform(prefixes, p -> concat(s, p))))")).alias("expression")).withColumn("full", F.sha2("expression", 256))
    keyed = scratch.bounded(rules.select(F.substring("digest", 1, 8).alias("short"), "digest", "rule", "verdict"), RULE_BYTES)
    hits = expanded.withColumn("short", F.substring("full", 1, 8)).join(keyed, "short").where((F.col("full") == F.col("digest")) & (F.col("expression") == F.col("rule")))
    best = hits.groupBy(F.col("url").alias("__url")).agg(F.max(F.struct(F.length("rule").alias("n"), "rule", F.col("verdict").alias("verdict"))).alias("best"))
    judged = rows.join(best, F.col("url") == F.col("__url"), "left")
    return judged.select("page_id", host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"))
