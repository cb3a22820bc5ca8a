"""Decoding of hex-encoded unsigned 256-bit log words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB = 16  # hex digits that fit one unsigned 64-bit number


def hex_word(data: Column) -> Column:
    """``0x``-prefixed word as DECIMAL(38,0).

    NULL for an empty or all-zero word, for bad digits, and for values of more
    than 38 decimal digits.
    """
    digits = F.ltrim(F.substr(data, F.lit(3)), F.lit("0"))
    usable = F.when(digits.rlike("^[0-9a-fA-F]{1,32}$"), F.lpad(digits, 2 * LIMB, "0"))
    high = F.conv(F.substring(usable, 1, LIMB), 16, 10).cast("decimal(20,0)")
    low = F.conv(F.substring(usable, LIMB + 1, LIMB), 16, 10).cast("decimal(20,0)")
    limb_size = F.lit(str(2**64)).cast("decimal(20,0)")
    return F.try_add(F.try_multiply(high, limb_size), low).cast("decimal(38,0)")


def token_amount(data: Column, decimals: int) -> Column:
    """The word as a token amount with the given number of decimals."""
    return hex_word(data).cast("double") / F.lit(float(10**decimals))
