"""Scalar expressions: amounts, the ratio rule, text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """Amount with up to two decimals as integer cents; exact for decimals and for text."""
    return (amount.cast("decimal(20,2)") * 100).cast("bigint")


def amount_text(cents: Column) -> Column:
    """Integer cents as text with as many decimals as it takes: none, one or two."""
    whole, rest = (F.floor(cents / 100)).cast("string"), F.pmod(cents, F.lit(100))
    return F.when(rest == 0, whole).when(rest % 10 == 0, F.concat(whole, F.lit("."), (rest / 10).cast("int").cast("string"))).otherwise(F.concat(whole, F.lit("."), F.lpad(rest.cast("string"), 2, "0")))


def ratio_ok(earlier: Column, later: Column) -> Column:
    """The later transfer is 0.2 to 3 times the earlier one, both bounds included; integers, no division."""
    return (earlier <= 5 * later) & (later <= 3 * earlier)


def path_text(*vertices: Column) -> Column:
    """Ids joined by commas; nulls (padding) are left out."""
    return F.concat_ws(",", *[v.cast("string") for v in vertices])


def digits(number: Column) -> Column:
    """Decimal digits of a non-negative integer."""
    return F.length(number.cast("string"))


def rounded_score(score: Column) -> Column:
    """Score to three decimals; the nudge keeps halves apart from the order of summation."""
    return F.round(score + 1e-7, 3)


def score_text(vertex: Column, score: Column) -> Column:
    return F.format_string("%d,%.3f", vertex, score)


def pack_id_weight(vertex: Column, weight: Column, bits: int = 10) -> Column:
    """An id and a weight of ``bits`` bits in one long."""
    return F.shiftleft(vertex.cast("bigint"), bits).bitwiseOR(weight.cast("bigint"))


def unpack_id(packed: Column, bits: int = 10) -> Column:
    return F.shiftright(packed, bits)


def unpack_weight(packed: Column, bits: int = 10) -> Column:
    return packed.bitwiseAND(F.lit((1 << bits) - 1))
