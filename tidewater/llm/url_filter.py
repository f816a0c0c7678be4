"""URL filter: host-suffix and path-prefix expressions, hash-prefix join, digest check, precedence.

A rule is a host and a path, written as one expression such as ``example.com/en/``. It fits a URL if the URL's host is
the rule's or a subdomain of it, and the URL's path starts with the rule's path. Each URL is expanded into every
expression that a rule could have; expressions meet rules by an equi-join on the first 32 bits of their SHA-256 and
are confirmed by the whole digest. Of the rules that fit, the longest expression decides, then the longer host.

Null URLs, and URLs without ``://``, have an empty host and path, and no rule. A null id is kept as it is. Repeated
rows give repeated results. Rule tables below a checked size are broadcast; larger ones are spread over salts, so that
an expression which most URLs share does not meet its rule in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: verdict, expression
Rules = Sequence[tuple[str, str]]

#: Rules are broadcast up to this many rows; an expression is at most a URL long, so they are a few MB at most.
BROADCAST_RULES = 20_000
SALTS = 32


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Rules) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, rule string")


def decide(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages`` (page_id, url); ``rules`` has verdict and rule."""
    known = rules.where("rule is not null and verdict is not null").groupBy("rule").agg(F.min(F.struct(F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("o"), "verdict")).alias("v"))
    known = known.select("rule", F.col("v.verdict").alias("verdict"), F.sha2("rule", 256).alias("digest"), F.expr("locate('/', rule)").alias("cut"))
    small = known.limit(broadcast_rules + 1).count() <= broadcast_rules
    # where the paths of rules end within a segment; as many lengths as a path has characters at most
    cuts = sorted(r[0] for r in known.where("cut > 0 and not endswith(rule, '/')").select(F.expr("length(rule) - cut + 1")).distinct().collect())

    rows = pages.select("page_id", "url").groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.select("page_id", "url", "copies", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels = rows.withColumn("labels", F.split("host", "\\.")).withColumn("segments", F.split("path", "/"))
    hosts = F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels) - i + 1), '.'))")
    dirs = F.expr("CASE WHEN size(segments) < 2 THEN CAST(array() AS array<string>) ELSE transform(sequence(1, size(segments) - 1), i -> concat(array_join(slice(segments, 1, i), '/'), '/')) END")
    ends = F.array_distinct(F.concat(F.array(F.lit("")), F.array(F.col("path")), *([F.transform(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.length("path")), lambda c: F.expr("path").substr(F.lit(1), c))] if cuts else [])))
    wide = labels.select("page_id", "url", "copies", "host", "path", hosts.alias("hosts"), F.array_distinct(F.concat(dirs, ends)).alias("paths"))
    parts = wide.select("page_id", "url", "copies", "host", "path", F.explode("hosts").alias("h"), "paths").select("page_id", "url", "copies", "host", "path", "h", F.explode("paths").alias("p"))
    parts = parts.withColumn("digest", F.sha2(F.concat("h", "p"), 256))
    parts = parts.withColumn("prefix", F.substring("digest", 1, 8)).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))

    side = known.select("rule", "verdict", F.col("digest").alias("rule_digest"), F.substring("digest", 1, 8).alias("prefix"))
    if small:
        met = parts.join(F.broadcast(side), "prefix", "left")
    else:
        met = parts.join(side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["prefix", "salt"], "left")
    fits = (F.col("rule_digest") == F.col("digest")) & (F.col("rule") == F.concat("h", "p"))
    best = F.max(F.when(fits, F.struct(F.length("rule").alias("n"), F.length("h").alias("m"), F.col("rule"), F.col("verdict"))))
    out = met.groupBy("page_id", "url", "copies", "host", "path").agg(best.alias("best"))
    out = out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.expr("array_repeat(0, CAST(copies AS INT))")).alias("copy"))
    return out.drop("copy")
