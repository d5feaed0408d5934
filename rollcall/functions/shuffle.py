"""A keyed bijection on row numbers: a shuffle without a sort.

Row number x of n is written as x = l * b + r with l below a and r below b,
where a * b is n or little more.  Each of four Feistel rounds adds a keyed hash
of one half to the other, modulo its size; that can be undone, so the rounds are
a bijection on a * b numbers.  Numbers of n and above go through the rounds again
until they fall below n (cycle walking), which is a bijection on 0..n-1.

A walk ends after a * b - n + 1 steps at the latest.  Up to ``STEPS`` are taken; a
walk that long has a chance of (a * b - n) / (a * b) to the power of ``STEPS``,
zero below 4096 rows and under 2^-384 above, and would be reported, not hidden.
The hash is md5, so other engines can repeat the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import spread

ROUNDS, STEPS = 4, 64


def halves(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n, a * b - n < b <= about the root of n."""
    b = max(1, math.isqrt(max(0, n - 1)) + 1 if n > 1 else 1)
    return max(1, -(-n // b)), b


def shuffled(row: Column, n: int, *key: Column) -> Column:
    """The place that ``row`` (0..n-1) gets in the order named by ``key``."""
    a, b = halves(n)

    def hashed(i: Column, half: Column, size: int) -> Column:
        text = F.concat_ws("|", *key, i, half)
        return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(size))

    def rounds(x: Column) -> Column:
        # the state travels through the rounds, so that no half is written out twice
        def one(state: Column, i: Column) -> Column:
            left, right = state["l"], state["r"]
            return F.struct(F.when(i % 2 == 0, F.pmod(left + hashed(i, right, a), F.lit(a))).otherwise(left).alias("l"),
                            F.when(i % 2 == 1, F.pmod(right + hashed(i, left, b), F.lit(b))).otherwise(right).alias("r"))

        start = F.struct(F.floor(x / b).cast("bigint").alias("l"), F.pmod(x, F.lit(b)).cast("bigint").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one, lambda s: s["l"] * b + s["r"])

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(min(STEPS, a * b - n + 1))), F.lit(a * b).cast("bigint"),
                       lambda x, i: F.when(i == 1, rounds(row.cast("bigint"))).when(x >= n, rounds(x)).otherwise(x))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("a walk of the shuffle did not end")).cast("bigint"))


def numbered(df: DataFrame, key: str, name: str = "seat") -> DataFrame:
    """``df`` with its row number in the order of the unique ``key``, by range partitions and offsets."""
    return spread.running(df.withColumn("_one", F.lit(1)), [], [key], {"_r": "_one"}).withColumn(name, F.col("_r_before").cast("bigint")).drop(
        "_one", "_r_before", "_r_all")
