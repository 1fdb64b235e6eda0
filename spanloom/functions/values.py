"""Values of typed fields, and check digits of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.typed import currency_value as money

__all__ = ["bic_valid", "card_valid", "crc", "dotted_value", "iban_valid", "isbn_valid", "money", "number_of", "range_of"]


def number_of(c: Column) -> Column:
    return F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")


def range_of(c: Column) -> tuple[Column, Column]:
    """Ends of `a..b`, `a - b` or `a`."""
    n = F.regexp_extract_all(c, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)(?=\s*(?:\.\.|-|,|to|$|[^0-9.]))"), F.lit(1))
    lo = F.get(n, F.lit(0)).try_cast("double")
    hi = F.coalesce(F.abs(F.get(n, F.lit(1)).try_cast("double")) * F.when(F.rlike(c, F.lit(r"\.\.\s*-")), -1).otherwise(1), lo)
    return F.least(lo, hi), F.greatest(lo, hi)


def dotted_value(c: Column) -> Column:
    """A dotted number (IPv4 and the like) as one number, base 256."""
    return F.aggregate(F.split(F.trim(c), r"\."), F.lit(0).cast("decimal(38,0)"), lambda a, x: (a * 256 + F.coalesce(x.try_cast("decimal(10,0)"), F.lit(0))).cast("decimal(38,0)")).cast("double")


def iban_valid(c: Column) -> Column:
    """Remainder by 97 of the rearranged digits is 1; taken in pieces, so that no number grows long."""
    x = F.upper(F.regexp_replace(c, r"\s", ""))
    moved = F.concat(F.substring(x, 5, 64), F.substring(x, 1, 4))
    chars = F.split(moved, "")
    value = lambda ch: F.when(F.rlike(ch, F.lit("[0-9]")), ch.try_cast("int")).otherwise(F.ascii(ch) - 55)
    left = F.aggregate(chars, F.lit(0), lambda a, ch: F.when(F.length(ch) == 0, a).otherwise(((a * F.when(value(ch) > 9, 100).otherwise(10) + value(ch)) % 97).cast("int")))
    return F.rlike(x, F.lit(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")) & (left == 1)


def isbn_valid(c: Column) -> Column:
    x = F.upper(F.regexp_replace(c, r"[\s-]", ""))
    d = F.split(x, "")
    digit = lambda ch: F.when(ch == "X", 10).otherwise(F.coalesce(ch.try_cast("int"), F.lit(0)))
    ten = F.aggregate(F.transform(d, lambda ch, i: digit(ch) * (10 - i)), F.lit(0), lambda a, v: a + v) % 11 == 0
    thirteen = F.aggregate(F.transform(d, lambda ch, i: digit(ch) * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, v: a + v) % 10 == 0
    return F.when(F.rlike(x, F.lit("^[0-9]{9}[0-9X]$")), ten).when(F.rlike(x, F.lit("^[0-9]{13}$")), thirteen).otherwise(F.lit(False))


def bic_valid(c: Column) -> Column:
    return F.rlike(F.upper(F.trim(c)), F.lit(r"^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$"))


def card_valid(c: Column) -> Column:
    x = F.regexp_replace(c, "[^0-9]", "")
    return F.length(x).between(12, 19) & F.call_function("luhn_check", x)


def crc(c: Column) -> Column:
    return F.crc32(c.cast("binary"))
