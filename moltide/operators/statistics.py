"""Tests and keyed draws that have a closed form: permutation, paired, gates, hash-keyed holdouts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Increment and multipliers of SplitMix64.
STEP, MULTIPLIERS = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
EXACT = 20


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def times(a: Column, b: int) -> Column:
    """Product of longs, of which only the low 64 bits stay: by halves, as ANSI arithmetic refuses to overflow."""
    low, high = a.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(a, 32)
    b0, b1 = b & 0xFFFFFFFF, b >> 32
    part = lambda x, y: x.cast("decimal(20,0)") * F.lit(y).cast("decimal(20,0)")
    word = F.lit(1 << 32).cast("decimal(20,0)")
    total = part(low, b0) + F.pmod(part(low, b1) + part(high, b0), word) * word
    return wrapped(total)


def wrapped(x: Column) -> Column:
    """A whole number of any size as a long, modulo 2^64."""
    all_, half = F.lit("18446744073709551616").cast("decimal(38,0)"), F.lit("9223372036854775808").cast("decimal(38,0)")
    r = F.pmod(x.cast("decimal(38,0)"), all_)
    return F.when(r >= half, r - all_).otherwise(r).cast("long")


def split_mix(z: Column) -> Column:
    """SplitMix64 of a long."""
    z = wrapped(z.cast("decimal(38,0)") + F.lit(str(STEP)).cast("decimal(38,0)"))
    for shift, m in zip((30, 27), MULTIPLIERS, strict=True):
        z = times(z.bitwiseXOR(F.shiftrightunsigned(z, shift)), m)
    return z.bitwiseXOR(F.shiftrightunsigned(z, 31))


def held_out(seed: int, cell: Column, umi_class: Column, share: float) -> Column:
    """Whether a class is held out: a draw that depends on nothing but the seed, the cell and the class."""
    if not 0 < share < 1:
        return F.lit(share >= 1)
    key = F.shiftleft(cell.cast("long"), 32).bitwiseOR(umi_class.cast("long"))
    z = split_mix(key.bitwiseXOR(F.lit(signed(seed & MASK))))
    return F.shiftrightunsigned(z, 11).cast("double") * F.lit(2.0**-53) < share


def depth_gate(total: Column, scale: float, power: float) -> Column:
    """Share of trust in a cell's own counts: d^p / (d^p + D^p), zero for none."""
    logit = F.when(total > 0, power * (F.ln(total) - math.log(scale)))
    return F.when(total <= 0, 0.0).otherwise(F.when(logit >= 0, 1 / (1 + F.exp(-logit))).otherwise(F.exp(logit) / (1 + F.exp(logit))))


def paired(differences: DataFrame, by: list[str], of: str) -> DataFrame:
    """n, mean, t and the exact sign-flip p-value of each group's paired differences; p is null beyond EXACT of them."""
    kept = differences.where(F.col(of).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(of).alias("mean"), F.stddev_samp(of).alias("s"), F.when(F.count("*") <= EXACT, F.sort_array(F.collect_list(of))).alias("d"))
    flips = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.least("n", F.lit(EXACT)).cast("int")) - 1)
    total = lambda m: F.abs(F.aggregate(F.transform("d", lambda x, i: F.when(F.getbit(m, i) == 1, -x).otherwise(x)), F.lit(0.0), lambda s, x: s + x))
    seen = F.abs(F.aggregate("d", F.lit(0.0), lambda s, x: s + x))
    extreme = F.aggregate(flips, F.lit(0).cast("long"), lambda s, m: s + F.when(total(m.cast("long")) >= seen - 1e-12, 1).otherwise(0))
    t = F.try_divide(F.col("mean"), F.col("s") / F.sqrt("n"))
    return kept.select(*by, "n", "mean", t.alias("t"), F.when(F.col("d").isNotNull(), extreme / F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n").cast("int"))).alias("p"))
