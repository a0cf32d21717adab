"""Selection in batches (row_id, idx, val): greatest and k-th with places, ranks, histograms, scans.

Ranks and scans go by ``scans.running_sums``, which cuts long rows into pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import scans


def positions(df: DataFrame, row: str, order: list[str], val: Column) -> DataFrame:
    """(row_id, idx, val): idx from 0 in each row by ``order``."""
    values = df.select(F.col(row).alias("row_id"), val.alias("val"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)])
    return scans.places(values, "row_id", [f"_o{k}" for k in range(len(order))], "idx").select("row_id", "idx", "val")


def argmax(batch: DataFrame) -> DataFrame:
    """(row_id, max_val, max_idx), the first place in ties. Combines before the shuffle, so long rows don't meet whole."""
    top = F.max(F.struct("val", (-F.col("idx")).alias("back")))
    return batch.groupBy("row_id").agg(top.alias("t")).select("row_id", F.col("t.val").alias("max_val"), (-F.col("t.back")).alias("max_idx"))


def ranks(batch: DataFrame) -> DataFrame:
    """The batch with ``rank``, from 0 by value, then place: a stable sort of each row."""
    return scans.places(batch, "row_id", ["val", "idx"], "rank")


def kth_smallest(batch: DataFrame, k: int) -> DataFrame:
    """(row_id, kth_val, kth_idx), k from 0; rows with fewer values are left out.

    The place is compared as row_number() gives it, so that tasks keep only the first k + 1 values of a row before they meet."""
    if k < 0:
        raise ValueError("k starts at 0")
    placed = batch.withColumn("_place", F.row_number().over(Window.partitionBy("row_id").orderBy("val", "idx")))
    return placed.where(F.col("_place") == k + 1).select("row_id", F.col("val").alias("kth_val"), F.col("idx").alias("kth_idx"))


def digit_histogram(values: DataFrame, value: str, passes: int, bits: int = 2) -> DataFrame:
    """(pass, digit, n) for each pass of a radix sort, empty bins included. Counts meet, values don't."""
    digits = F.array(*[F.shiftright(F.col(value), bits * p).bitwiseAND((1 << bits) - 1).cast("long") for p in range(passes)])
    counted = values.select(F.posexplode(digits).alias("pass", "digit")).groupBy("pass", "digit").agg(F.count("*").alias("n"))
    bins = values.sparkSession.range(passes << bits).select(F.shiftright("id", bits).cast("int").alias("pass"), F.col("id").bitwiseAND((1 << bits) - 1).alias("digit"))
    return bins.join(counted, ["pass", "digit"], "left").select("pass", "digit", F.coalesce("n", F.lit(0)).alias("n"))


def radix_pass(batch: DataFrame, shift: int, bits: int = 2) -> DataFrame:
    """(row_id, idx, val, at): the place of each value after one stable pass over a digit."""
    key = F.shiftright("val", shift).bitwiseAND((1 << bits) - 1)
    return scans.places(batch.withColumn("_digit", key), "row_id", ["_digit", "idx"], "at").drop("_digit")


def prefix_sums(df: DataFrame, row: str, order: list[str], value: str, long_row: int | None = None) -> DataFrame:
    """The rows with inclusive and exclusive sums of ``value`` in each row by ``order``. Null values count for nothing."""
    summed = scans.running_sums(df, row, order, {"inclusive": F.col(value)}, long_row)
    return summed.withColumn("exclusive", F.col("inclusive") - F.col(value))
