"""String similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_length(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence, row by row of the usual table, in nested folds."""
    x, y = F.split(a, ""), F.split(b, "")
    zero = F.transform(F.concat(F.array(F.lit("")), y), lambda _: F.lit(0))

    def row(before: Column, c: Column) -> Column:
        step = lambda acc, j: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), F.get(before, j), F.get(before, j - 1) + F.when(F.get(y, j - 1) == c, 1).otherwise(0))))
        return F.aggregate(F.sequence(F.lit(1), F.size(y)), F.array(F.lit(0)), step)

    full = F.aggregate(x, zero, row)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(full, -1))


def ratio(a: Column, b: Column) -> Column:
    """2 * common length / sum of lengths, from 0 to 1; two empty strings are equal."""
    n = F.length(a) + F.length(b)
    return F.when(n == 0, 1.0).otherwise(2.0 * common_length(a, b) / n)


def may_reach(a: Column, b: Column, least: float) -> Column:
    """Whether the lengths alone let the ratio reach `least`: the shorter string can be common as a whole."""
    return 2.0 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))


def escape_slash(text: Column) -> Column:
    return F.replace(text, F.lit("/"), F.lit("&slash;"))


def unescape_slash(text: Column) -> Column:
    return F.replace(text, F.lit("&slash;"), F.lit("/"))


def ascii_only(text: Column) -> Column:
    """Each character beyond ASCII becomes a question mark."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def decoded(data: Column) -> Column:
    """Bytes as UTF-8, or as ISO 8859-1 where they are none; Spark decodes no Windows code page."""
    return F.coalesce(F.try_validate_utf8(data.cast("string")), F.decode(data, "ISO-8859-1"))


def idf(total: Column, df: Column) -> Column:
    """ln(total / max(df, 1))."""
    return F.log(total / F.greatest(df, F.lit(1)))


def frequency_idf(frequency: Column, missing: float = 206272.0) -> Column:
    """ln(1 / frequency), or the logarithm of a fixed number where there is no frequency."""
    return F.when(frequency > 0, F.log(1 / frequency)).otherwise(F.log(F.lit(missing)))
