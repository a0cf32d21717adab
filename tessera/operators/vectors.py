"""Elementwise maps of vectors (i, v), and their reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_chain(df: DataFrame, y: str = "y", z: str = "z", out: str = "x") -> DataFrame:
    """x = y + z + y + z."""
    return df.withColumn(out, F.col(y) + F.col(z) + F.col(y) + F.col(z))


def two_outputs(df: DataFrame) -> DataFrame:
    """x = y + z - w and a = y - z + w in one pass."""
    y, z, w = F.col("y"), F.col("z"), F.col("w")
    return df.select("*", (y + z - w).alias("x"), (y - z + w).alias("a"))


def waxpby(x: DataFrame, y: DataFrame, alpha, beta) -> DataFrame:
    """w = alpha x + beta y where x has a value."""
    return x.alias("x").join(y.alias("y"), "i").select("i", (F.lit(alpha) * F.col("x.v") + F.lit(beta) * F.col("y.v")).alias("v"))


def fused_waxpby(state: DataFrame, updates: dict[str, tuple]) -> DataFrame:
    """Several updates of one wide table at once; out: (alpha, column, beta, column), all from the old values."""
    new = [(F.lit(a) * F.col(x) + F.lit(b) * F.col(y)).alias(out) for out, (a, x, b, y) in updates.items()]
    return state.select(*[c for c in state.columns if c not in updates], *new)


def dot(x: Column, y: Column) -> Column:
    return F.sum(x * y)


def norm(x: Column) -> Column:
    return F.sqrt(F.sum(x * x))


def spread(df: DataFrame, value: str, place: str) -> DataFrame:
    """Sum, mean, least and greatest with places, and the sample deviation in percent of the mean (0 for one row).

    In ties the least takes the lowest place, the greatest the highest."""
    low, high = F.min(F.struct(value, place)), F.max(F.struct(value, place))
    mean = F.avg(value)
    return df.agg(
        F.sum(value).alias("total"), mean.alias("mean"), low[value].alias("least"), low[place].alias("least_at"), high[value].alias("greatest"), high[place].alias("greatest_at"),
        F.when(F.count("*") > 1, F.try_divide(F.stddev_samp(value), mean) * 100).otherwise(0.0).alias("deviation_percent"),
    )
