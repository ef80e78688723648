"""Sums of doubles that are the nearest double to the true sum, so that they are the same in any order and however partial sums are merged.

A double is a whole number times a power of two. Whole numbers are added as decimals, which is exact, in bins of BIN powers; a group has at most 70 or so of these bins.
At the end they are put together as one whole number and rounded once.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Powers of two that share a decimal: of 56 bits and BIN more, 2 ** 38 numbers fit in one.
BIN = 32
#: Bits that a double is shifted by beyond the power found for it, so that a power that is one off does no harm.
BITS = 54


def nearest(bins: list[tuple[int, int]]) -> float:
    """The double nearest to the sum of n * 2 ** (BIN * bin) over (bin, n)."""
    total = sum((Fraction(n) * Fraction(2) ** (BIN * b) for b, n in bins), Fraction(0))
    try:
        return float(total)
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


@F.arrow_udf(DoubleType())
def _rounded(bins: pa.Array) -> pa.Array:
    return pa.array([nearest([(x["bin"], int(x["n"])) for x in many or []]) for many in bins.to_pylist()], pa.float64())


def exact_sums(df: DataFrame, keys: list[str], value: str | Column, name: str = "s") -> DataFrame:
    """keys and the sum of a column of doubles. Nulls count for nothing; NaN and infinities make what they make in a plain sum.

    Partial sums are formed before the shuffles, so no task gets all the rows of a key; a key has a row for each bin.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*keys, v.alias("v_"))
    finite = F.col("v_").isNotNull() & ~F.isnan("v_") & (F.abs("v_") < float("inf"))
    some = finite & (F.col("v_") != 0)
    # very small values are brought up first, so that no power leaves the range of doubles
    tiny = F.abs("v_") < 2.0**-900
    up = F.when(tiny, F.col("v_") * 2.0**200).otherwise(F.col("v_"))
    power = F.floor(F.log2(F.abs("u_"))).cast("int")
    shifted = rows.withColumn("u_", up).withColumn("p_", F.when(some, power - BITS))
    # two steps, as one factor may be beyond the range
    half = F.floor(-F.col("p_") / 2)
    whole = (F.col("u_") * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), -F.col("p_") - half)).cast("long")
    placed = shifted.withColumn("m_", F.when(some, whole)).withColumn("q_", F.col("p_") - F.when(tiny, 200).otherwise(0))
    binned = placed.withColumn("bin", F.floor(F.col("q_") / BIN).cast("int"))
    scale = F.pow(F.lit(2.0), F.col("q_") - F.col("bin") * BIN).cast("decimal(10,0)")
    number = F.col("m_").cast("decimal(20,0)") * scale
    sums = binned.groupBy(*keys, "bin").agg(F.sum(number).cast("decimal(38,0)").alias("n"), F.sum(F.when(~finite, F.col("v_"))).alias("odd_"))
    listed = sums.groupBy(*keys).agg(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n"))).alias("bins_"), F.sum("odd_").alias("odd_"))
    return listed.select(*keys, F.coalesce("odd_", _rounded("bins_")).alias(name))


def grain(weights: np.ndarray) -> int | None:
    """The least k, up to 40, for which all weights are whole numbers of 2 ** -k; None if there is none."""
    for k in range(41):
        if (np.ldexp(weights, k) == np.rint(np.ldexp(weights, k))).all():
            return k
    return None
