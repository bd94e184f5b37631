"""Message lengths, costs and codes, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BYTES_PER_INTEGER = 4
COST_PER_BYTE = 0.0001


def list_json_length(array: str | Column) -> Column:
    """UTF-8 length of an array of integers as JSON with ', ' between items."""
    a = F.col(array) if isinstance(array, str) else array
    text = F.array_join(F.transform(a, lambda x: x.cast("string")), ", ")
    return (F.octet_length(text) + 2).cast("long")


def cost(n_bytes: str | Column) -> Column:
    return F.round((F.col(n_bytes) if isinstance(n_bytes, str) else n_bytes) * COST_PER_BYTE, 4)


def cost_text(n_bytes: str | Column) -> Column:
    """The cost with one to four decimals, never with an exponent."""
    return F.regexp_replace(cost(n_bytes).cast("decimal(30,4)").cast("string"), "0{1,3}$", "")


def bracketed(array: str | Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.col(array) if isinstance(array, str) else array, lambda x: x.cast("string")), ","), F.lit("]"))


def padded(number: Column) -> Column:
    """At least three digits, never cut."""
    text = number.cast("string")
    return F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)


def pair_code(first: Column, second: Column) -> Column:
    return F.concat(padded(first), F.lit("000"), padded(second))


def pair_codes(texts: str) -> Column:
    """Codes of all numbers in an array of bracketed texts, two at a time."""
    numbers = F.expr(rf"flatten(transform({texts}, t -> regexp_extract_all(t, '(\\d+)', 1)))")
    even = F.transform(F.sequence(F.lit(0), F.size(numbers) - 1), lambda i: i)
    firsts = F.filter(even, lambda i: (i % 2 == 0) & (i + 1 < F.size(numbers)))
    codes = F.transform(firsts, lambda i: pair_code(F.get(numbers, i), F.get(numbers, i + 1)))
    return F.when(F.size(numbers) >= 2, codes).otherwise(F.array().cast("array<string>"))
