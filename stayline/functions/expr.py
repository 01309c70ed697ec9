"""Small column expressions. All of them stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MANTISSA_BITS = 24
COARSE_SHIFT = 12
#: Above the cell of every finite double.
END_CELL = 1 << 50


def ratio(num: Column, den: Column) -> Column:
    """`num / den`, null where the denominator is zero (also under ANSI mode)."""
    return num / F.when(den != 0, den)


def one_if(cond: Column) -> Column:
    """1 where true, else 0 (also for null)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def count_where(cond: Column) -> Column:
    return F.sum(one_if(cond).cast("bigint"))


def value_block(x: Column, bits: int = MANTISSA_BITS) -> Column:
    """Order-preserving integer cell of a double: sign, exponent, leading mantissa.

    Cells are relative (2**-bits of the value), so an outlier or a pile of
    scores near zero does not push everything into one cell. The infinities
    have end cells of their own, and NaN, which sorts last, the cell behind.
    """
    infinity = F.lit(float("inf"))
    end = F.lit(END_CELL).cast("bigint")
    magnitude = F.when(~F.isnan(x) & (F.abs(x) != infinity), F.abs(x))
    exponent = F.floor(F.log2(magnitude))
    mantissa = F.floor(magnitude / F.pow(F.lit(2.0), exponent) * F.lit(float(2**bits)))
    cell = (exponent + F.lit(1100)) * F.lit(2 ** (bits + 1)) + mantissa
    return (
        F.when(F.isnan(x), end + F.lit(1))
        .when(x == infinity, end)
        .when(x == -infinity, -end)
        .when(x == 0, F.lit(0).cast("bigint"))
        .when(x > 0, cell.cast("bigint"))
        .otherwise(-cell.cast("bigint"))
    )


def seeded_hash(seed, *parts: Column) -> Column:
    """md5 of `seed:part:part`, the key of every seeded draw."""
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed_col.cast("string"), *[p.cast("string") for p in parts]))


def hash_block(digest: Column, digits: int = 6) -> Column:
    """Leading hex digits of a digest as a number: even cells by construction."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def severity(risk: Column, threshold: Column) -> Column:
    """info below the threshold, critical from 4/3 of it, else warning."""
    return (
        F.when(risk >= threshold * F.lit(4) / F.lit(3), F.lit("critical"))
        .when(risk >= threshold, F.lit("warning"))
        .otherwise(F.lit("info"))
    )


def threshold_bucket(score: Column, steps: int = 100) -> Column:
    """How many of the thresholds k/steps (k = 1..steps) are <= score.

    floor(score*steps) can be off by one in floating point, so it is checked
    against the exact neighbours.
    """
    k = F.floor(score * F.lit(float(steps)))
    scale = F.lit(float(steps))
    fixed = (
        F.when(score >= (k + F.lit(1)) / scale, k + F.lit(1))
        .when(score < k / scale, k - F.lit(1))
        .otherwise(k)
    )
    return F.least(F.greatest(fixed, F.lit(0)), F.lit(steps)).cast("int")


def round6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)
