"""64-bit FNV-1a over UTF-8 bytes and the partition that a hash falls into.

The hash is kept in two 32-bit limbs, because 64-bit products overflow under ANSI arithmetic. Constants of the algorithm are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET_HIGH, OFFSET_LOW = 3421674724, 2216829733
PRIME_LOW = 435
"""The prime is 2 ** 40 + 435."""

MASK = 0xFFFFFFFF
STRATEGY = "fnv1a64:v1"


def fnv1a64(text: Column) -> Column:
    """Hash of a text as a signed long; null for null, the offset basis for the empty text."""
    # one character for each byte, so that its code is the byte
    codes = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")

    def step(state: Column, code: Column) -> Column:
        x = state["lo"].bitwiseXOR(F.ascii(code).cast("bigint"))
        product = x * PRIME_LOW
        high = state["hi"] * PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(high.bitwiseAND(F.lit(MASK)).alias("hi"), product.bitwiseAND(F.lit(MASK)).alias("lo"))

    start = F.struct(F.lit(OFFSET_HIGH).cast("bigint").alias("hi"), F.lit(OFFSET_LOW).cast("bigint").alias("lo"))
    whole = F.aggregate(F.when(text != "", codes).otherwise(F.array().cast("array<string>")), start, step, lambda s: F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"]))
    return F.when(text.isNotNull(), whole)


def unsigned_mod(value: Column, count: int | Column) -> Column:
    """Unsigned remainder of a long seen as 64 bits."""
    n = F.lit(count) if isinstance(count, int) else count
    return F.pmod((F.shiftrightunsigned(value, 1) % n) * 2 + value.bitwiseAND(F.lit(1).cast("bigint")), n)


def partition_of(text: Column, count: int) -> Column:
    """Partition number of a key."""
    return unsigned_mod(fnv1a64(text), count)
