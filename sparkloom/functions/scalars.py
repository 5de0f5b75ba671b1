"""Small column functions used by the operators and plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: str | Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_suffix(text: str | Column, suffix: str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.endswith(suffix), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c)


def is_hex(text: str | Column, digits: int) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return c.rlike(f"^[0-9a-f]{{{digits}}}$")


def git_blob_sha1(data: str | Column) -> Column:
    """SHA-1 of a git blob: the header with the length in bytes, a zero byte, the data."""
    c = (F.col(data) if isinstance(data, str) else data).cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(c).cast("string")).cast("binary"), F.unhex(F.lit("00")), c))


def nibbles(byte: str | Column) -> tuple[Column, Column]:
    """Low and high half of a byte."""
    c = F.col(byte) if isinstance(byte, str) else byte
    return c.bitwiseAND(15), F.shiftrightunsigned(c, 4).bitwiseAND(15)


def packed_nibbles(low: str | Column, high: str | Column) -> Column:
    lo = F.col(low) if isinstance(low, str) else low
    return F.shiftleft(high, 4).bitwiseOR(lo)


def e8m0_scale(code: str | Column) -> Column:
    """2 ^ (code - 127)."""
    return F.pow(F.lit(2.0), F.col(code) - 127 if isinstance(code, str) else code - 127)


def gib(size: str | Column) -> Column:
    return F.round((F.col(size) if isinstance(size, str) else size) / F.lit(float(1 << 30)), 3)


def forbidden(line: str | Column, patterns: list[str]) -> Column:
    """Whether a line matches any of the patterns, in either case."""
    return F.coalesce((F.col(line) if isinstance(line, str) else line).rlike("(?i)(" + "|".join(patterns) + ")"), F.lit(False))


def first_middle_last(items: str | Column) -> Column:
    """The first, middle and last element of an array, each once."""
    c = F.col(items) if isinstance(items, str) else items
    n = F.size(c)
    return F.when(n > 0, F.array_distinct(F.array(F.element_at(c, 1), F.element_at(c, F.floor(n / 2).cast("int") + 1), F.element_at(c, -1)))).otherwise(F.slice(c, 1, 0))


def tiled(items: str | Column, length: int) -> Column:
    """An array repeated to exactly `length` elements; an empty one stays empty."""
    c = F.col(items) if isinstance(items, str) else items
    times = F.when(F.size(c) > 0, F.ceil(F.lit(length) / F.size(c)).cast("int")).otherwise(F.lit(0))
    return F.slice(F.flatten(F.array_repeat(c, times)), F.lit(1), F.lit(length))


def gathered(items: str | Column, positions: str | Column) -> Column:
    """items[positions], 0-based; null where there is no such element."""
    return F.transform(positions, lambda i: F.get(items, i))


def number_statistics(values: str) -> list[Column]:
    """Counts of NaN and infinities, and the extremes of finite values."""
    c = F.col(values)
    finite = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return [F.count_if(F.isnan(c)).alias("nan"), F.count_if(c == float("inf")).alias("pos_inf"), F.count_if(c == float("-inf")).alias("neg_inf"), F.min(finite).alias("least"), F.max(finite).alias("most")]
