"""Log text: search with context, tails, line removal and colour codes.

One document is one row with its whole ``text``; ``log_lines`` is the long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import (
    contains_any_case, first_lines, has_cr, last_lines, line_ends, lines_with_ends, plain_lines, strip)

# fixed value: a terminal colour code
COLOUR_CODE = r"\x1b\[[\d;]{1,4}m"


def log_lines(docs: DataFrame) -> DataFrame:
    """One row per line, numbered from 0, without line ends."""
    return docs.select("doc_id", F.posexplode(plain_lines(strip(F.col("text")))).alias("line_no", "line"))


def _grep_mixed(whole: Column, phrase: str, before: int, after: int) -> Column:
    lines = lines_with_ends(whole)
    hit = F.array_position(F.transform(lines, lambda p: contains_any_case(p, phrase)), F.lit(True)).cast("int")
    begin = F.greatest(hit - before, F.lit(1))
    return F.when(hit > 0, F.array_join(F.slice(lines, begin, hit - begin + 1 + after), ""))


def grep_context(docs: DataFrame, phrase: str, before: int, after: int) -> DataFrame:
    """First line with the phrase, in any case, and the lines around it; null if none.

    The phrase is part of one line, so it has no line end in it. LF texts are cut by
    position, without an array of lines. Done in steps so that each intermediate text
    is made once.
    """
    found = docs.select("doc_id", strip(F.col("text")).alias("w")).withColumn("l", F.lower("w")).withColumn(
        "at", F.instr("l", phrase.lower()))
    found = found.withColumn("above", F.when(F.col("at") > 0, line_ends(F.substring("l", F.lit(1), F.col("at") - 1))))
    found = found.withColumn("upto", first_lines(F.col("w"), F.col("above") + 1 + after))
    skipped = F.greatest(F.col("above") - before, F.lit(0))
    plain = last_lines(F.col("upto"), line_ends(F.col("upto")) + 1 - skipped)
    hit = F.when(has_cr(F.col("w")), _grep_mixed(F.col("w"), phrase, before, after)).otherwise(plain)
    return found.select("doc_id", strip(F.when(F.col("at") > 0, hit)).alias("fragment"))


def _tail_mixed(whole: Column, n: int) -> Column:
    lines = lines_with_ends(whole)
    return F.when(F.size(lines) <= n, whole).otherwise(
        F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n), ""))


def tail_text(text: Column, n: int) -> Column:
    whole = strip(text)
    return F.when(has_cr(whole), _tail_mixed(whole, n)).otherwise(last_lines(whole, F.lit(n)))


def tail_lines(docs: DataFrame, n: int) -> DataFrame:
    """The last ``n`` lines of each text."""
    return docs.select("doc_id", tail_text(F.col("text"), n).alias("tail"))


def drop_lines(docs: DataFrame, template: str) -> DataFrame:
    """The text without the lines that contain ``template`` in any case."""
    whole = strip(F.col("text"))
    keep = lambda p: ~contains_any_case(p, template)
    mixed = F.array_join(F.filter(lines_with_ends(whole), keep), "")
    plain = F.array_join(F.filter(F.split(whole, "\n"), keep), "\n")
    return docs.select("doc_id", F.when(~contains_any_case(whole, template), whole).otherwise(
        strip(F.when(has_cr(whole), mixed).otherwise(plain))).alias("text"))


def without_markup(text: Column) -> Column:
    return F.regexp_replace(text, COLOUR_CODE, "")


def strip_markup(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", without_markup(F.col("text")).alias("text"))
