"""Exact sums and rounded means of decimals of any precision, in 64-bit integers.

A decimal's digits are cut into *limbs* of nine, each with the decimal's sign. Limbs are summed as BIGINTs, which is safe for nine
billion rows and needs no wide buffers in shuffles and state; carries are taken once per sum, when the mean is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMB = 9
BASE = 10**LIMB
LONG_DIGITS = 18


def limb_count(kind: T.DecimalType) -> int:
    return -(-kind.precision // LIMB)


def limbs(value: Column, kind: T.DecimalType) -> list[Column]:
    """The digits of a decimal without its point, lowest nine first, as signed BIGINTs."""
    if kind.precision <= LONG_DIGITS:
        units = (value * F.lit(str(10**kind.scale)).cast(T.DecimalType(kind.scale + 1, 0))).cast("bigint")
        return [units] if limb_count(kind) == 1 else [units % BASE, _div(units, BASE)]
    whole = kind.precision - kind.scale
    # Text and not abs or a minus sign, by which Spark rounds decimals of more than 34 digits.
    text = F.to_char(value, F.lit("S" + "0" * max(whole, 1) + ("." + "0" * kind.scale if kind.scale else "")))
    digits = F.lpad(F.translate(text, "+-.", ""), LIMB * limb_count(kind) + 1, "0")
    sign = F.when(value < 0, -1).otherwise(1).cast("bigint")
    width = LIMB * limb_count(kind) + 1
    return [F.substring(digits, width - LIMB * (k + 1) + 1, LIMB).cast("bigint") * sign for k in range(limb_count(kind))]


def _div(value: Column, by: Column | int) -> Column:
    """Integer division that truncates toward zero."""
    by = F.lit(by).cast("bigint") if isinstance(by, int) else by
    return F.call_function("div", value, by)


def mean_type(kind: T.DecimalType) -> T.DecimalType:
    """The type of a mean with two decimals: eighteen digits, more if the whole part needs them."""
    return T.DecimalType(min(38, max(LONG_DIGITS, kind.precision - kind.scale + 2)), 2)


def with_mean(sums: DataFrame, names: list[str], count: str, kind: T.DecimalType, result: str) -> DataFrame:
    """Add ``result``: the mean of decimals of type ``kind`` from the sums of their limbs, with two decimals, ties toward zero.

    Dividing decimals would round twice, and neither ``round`` nor ``bround`` breaks ties toward zero. Here the sum is divided
    digit by digit, first by the count, then by the power of ten that leaves two decimals; the last remainder decides, and what
    earlier ones left over breaks ties upward.
    """
    keep = sums.columns
    n = len(names) + 1  # one limb more for carries
    at = [f"_limb{k}" for k in range(n)]

    def carried(frame: DataFrame) -> DataFrame:
        """Limbs from 0 to BASE - 1, but for the highest, which has the sign."""
        for k in range(n - 1):
            low = F.pmod(at[k], F.lit(BASE).cast("bigint"))
            frame = frame.withColumns({at[k]: low, at[k + 1]: F.col(at[k + 1]) + _div(F.col(at[k]) - low, BASE)})
        return frame

    def divided(frame: DataFrame, by: Column, rest: str) -> DataFrame:
        frame = frame.withColumn(rest, F.lit(0).cast("bigint"))
        for k in reversed(range(n)):
            here = F.col(rest) * BASE + F.col(at[k])
            frame = frame.withColumns({at[k]: _div(here, by), rest: here % by})
        return frame

    frame = sums.withColumns({at[k]: F.col(name) for k, name in enumerate(names)} | {at[-1]: F.lit(0).cast("bigint")})
    frame = carried(frame).withColumn("_negative", F.col(at[-1]) < 0)
    factor = F.lit(10 ** max(0, 2 - kind.scale)).cast("bigint")
    frame = carried(frame.withColumns({a: F.when(F.col("_negative"), -F.col(a)).otherwise(F.col(a)) * factor for a in at}))
    by = F.col(count).cast("bigint")
    frame = divided(frame, by, "_rest")
    twice, left_over = F.col("_rest") * 2, F.lit(False)
    for done in range(0, max(0, kind.scale - 2), LIMB):
        power = F.lit(10 ** min(LIMB, kind.scale - 2 - done)).cast("bigint")
        frame = frame.withColumn("_over", (F.col("_rest") > 0) | (F.col("_over") if done else F.lit(False)))
        frame = divided(frame, power, "_rest")
        by, left_over = power, F.col("_over")
    frame = frame.withColumn("_up", (twice > by) | ((twice == by) & left_over))
    goal = mean_type(kind)
    if goal.precision <= LONG_DIGITS:
        hundredths = F.lit(0).cast("bigint")
        for k in reversed(range(n)):
            hundredths = hundredths * BASE + F.col(at[k])
    else:
        hundredths = F.lit(0).cast("decimal(38,0)")
        fit = [k for k in range(n) if LIMB * k < 38]
        for k in fit:
            hundredths = (hundredths + F.col(at[k]).cast("decimal(10,0)") * F.lit(str(10 ** (LIMB * k))).cast(T.DecimalType(LIMB * k + 1, 0))).cast("decimal(38,0)")
        for k in range(len(fit), n):
            hundredths = F.when(F.col(at[k]) > 0, F.raise_error(F.lit("a mean has over 38 digits"))).otherwise(hundredths)
    hundredths = (hundredths + F.col("_up").cast("int")) * F.when(F.col("_negative"), -1).otherwise(1)
    mean = (hundredths.cast("decimal(38,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(goal)
    return frame.withColumn(result, mean).select(*keep, result)
