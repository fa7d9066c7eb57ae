"""Judging urls against allow and block rules by hashed host-suffix and path-prefix expressions.

Every url is expanded into the expressions a rule could have written for it, one for each shape
(labels in the host, length of the path) that occurs among the rules. Expressions and rules
meet in an equi-join on the first 32 bits of a SHA-256 digest; the full digest then confirms the
match, and the longest rule wins. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_BYTES = 8 << 20  # rules above this size meet the urls in a shuffled join
SALTS = 32                 # shares of a common expression in that join


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return (ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A small rule list, (host, path, verdict) each, as a table."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("#"), path), 256)  # '#' is in neither part


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow",
               broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row ``page_id, host, path, rule, verdict`` for each row of ``pages`` (page_id, url).

    ``rules`` has host, path and verdict (``allow`` or ``block``). A rule fits its host and every
    subdomain when the url's path starts with the rule's path. The longest rule (host and path
    together) wins, then the one with the longer host, then ``block``; without a fitting rule
    ``rule`` is null and ``verdict`` is ``default``.

    Null or malformed urls have an empty host and path. Repeated rows stay repeated, a null
    page_id stays null, other columns of ``pages`` are not read, and rules with a null part count
    as empty there (null verdict: ``block``). Empty tables give empty or default results.
    """
    known = rules.select(
        ascii_lower(F.coalesce("host", F.lit(""))).alias("r_host"),
        F.coalesce("path", F.lit("")).alias("r_path"),
        F.coalesce("verdict", F.lit("block")).alias("r_verdict"),
    ).distinct().withColumn("digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("prefix", _short(F.col("digest")))
    # one row for each pair of host depth and path length: bounded by the length of a url
    dots = F.length("r_host") - F.length(F.replace("r_host", F.lit("."), F.lit("")))
    shapes = known.select(dots.alias("dots"), F.length("r_path").alias("chars")).distinct().collect()
    rule_bytes = known.agg(F.sum(F.length("r_host") + F.length("r_path") + 160)).first()[0] or 0

    host, path = url_parts(F.col("_u"))
    urls = (pages.select("page_id", F.coalesce("url", F.lit("")).alias("_u"))
            .withColumn("_row", F.monotonically_increasing_id())
            .withColumns({"host": host, "path": path}).drop("_u"))
    host_dots = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))
    forms = [F.when((host_dots >= s.dots) & (F.length("path") >= s.chars),
                    _digest(F.substring_index("host", ".", -(s.dots + 1)), F.substring("path", 1, s.chars)))
             for s in shapes]
    # the extra "" keeps urls without any expression
    spread = (urls.withColumn("x_digest", F.explode(F.array(F.lit(""), *forms)))
              .filter(F.col("x_digest").isNotNull()).withColumn("x_prefix", _short(F.col("x_digest"))))
    match = (F.col("x_prefix") == F.col("prefix")) & (F.col("x_digest") == F.col("digest"))
    if rule_bytes <= broadcast_bytes:
        hits = spread.join(F.broadcast(known), match, "left")
    else:
        shares = known.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = (spread.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
                .join(shares, match & (F.col("salt") == F.col("r_salt")), "left"))
    best = F.max(F.when(F.col("r_host").isNotNull(), F.struct(
        F.length("r_host") + F.length("r_path"), F.length("r_host"), (F.col("r_verdict") == "block").alias("block"),
        F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))))
    return (hits.groupBy("_row", "page_id", "host", "path").agg(best.alias("best"))
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
