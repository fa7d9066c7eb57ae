"""Column helpers for text: trimming, lines and number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: white space of a plain trim; lines end at LF, CR or the pair CR LF
WHITE = " \t\n\r\u000b\u000c"
_LINE_END = r"(?<=\n)|(?<=\r)(?!\n)"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def lines_with_ends(text: Column) -> Column:
    """Lines of a text, each with its own line end; no lines for an empty text."""
    return F.filter(F.split(text, _LINE_END), lambda p: p != "")


def has_cr(text: Column) -> Column:
    return F.contains(text, F.lit("\r"))


def plain_lines(text: Column) -> Column:
    """Lines without their ends; texts with LF only take the cheap split."""
    mixed = F.transform(lines_with_ends(text), lambda p: F.btrim(p, F.lit("\r\n")))
    return F.when(has_cr(text), mixed).when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(text, "\n"))


def first_lines(text: Column, n: Column) -> Column:
    """The first ``n`` lines of an LF text."""
    return F.call_function("substring_index", text, F.lit("\n"), n)


def last_lines(text: Column, n: Column) -> Column:
    """The last ``n`` lines of an LF text."""
    return F.call_function("substring_index", text, F.lit("\n"), -n)


def line_ends(text: Column) -> Column:
    """Number of LFs in a text."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def contains_any_case(line: Column, phrase: str) -> Column:
    return F.contains(F.lower(line), F.lit(phrase.lower()))


def decode_int(text: Column) -> Column:
    """Integer text that may be hex (0x, #) or octal (leading 0); null when malformed.

    Only 32-bit results are accepted.
    """
    sign = F.when(F.startswith(text, F.lit("-")), -1).otherwise(1)
    # zeros that pad a number do not count against the digits a long can hold
    body = F.regexp_replace(F.regexp_replace(text, "^[+-]", ""), "^(0[xX]|#|0)0+(?=[0-9a-fA-F])", "$1")
    number = (
        F.when(body.rlike("^(0[xX]|#)[0-9a-fA-F]{1,15}$"),
               F.conv(F.regexp_replace(body, "^(0[xX]|#)", ""), 16, 10))
        .when(body.rlike("^0[0-7]{1,20}$"), F.conv(body, 8, 10))
        .when(body.rlike("^(0|[1-9][0-9]{0,17})$"), body)
        .try_cast("long"))
    value = number * sign
    return F.when(value.between(-2147483648, 2147483647), value.cast("int"))


def starts(text: Column, prefix: str) -> Column:
    return F.startswith(text, F.lit(prefix))


def after(text: Column, prefix: str) -> Column:
    return F.substring(text, len(prefix) + 1, 2147483647)
