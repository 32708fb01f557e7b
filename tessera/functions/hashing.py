"""Seeded pseudo-random columns that depend on stable ids only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplier and modulus of the linear congruential hash, the same in every SQL dialect.
MULTIPLIER, MODULUS = 1103515245, 2147483648


def lcg(column: Column, seed: int) -> Column:
    """``(column * MULTIPLIER + seed) mod MODULUS``, never negative."""
    return F.pmod(column.cast("long") * F.lit(MULTIPLIER) + F.lit(seed), F.lit(MODULUS))


def digest(seed: int, *columns: Column, digits: int = 15) -> Column:
    """The first hexadecimal digits of the MD5 of seed and ids, as a number: every SQL dialect has it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def uniform(seed: int, *columns: Column) -> Column:
    """A number in (0, 1) for each combination of ids."""
    return (digest(seed, *columns, digits=13) + F.lit(0.5)) * F.lit(2.0**-52)


def gaussian(seed: int, *columns: Column) -> Column:
    """A standard normal number for each combination of ids."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(seed, *columns)))
    return radius * F.cos(F.lit(6.283185307179586) * uniform(seed + 1_000_003, *columns))
