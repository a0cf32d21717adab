"""Generated domains: vectors, matrices, grids, permutations, meshes and boxes, from spark.range alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def vector(spark: SparkSession, n: int, **columns: Callable[[Column], Column]) -> DataFrame:
    """(i, then a column for each function of i), i in [0, n)."""
    i = F.col("id")
    return spark.range(n).select(i.alias("i"), *[f(i).alias(c) for c, f in columns.items()])


def matrix(spark: SparkSession, rows: int, cols: int, f: Callable[[Column, Column], Column], names: tuple[str, str, str] = ("i", "j", "v")) -> DataFrame:
    """A matrix or grid from a function of its two indices, a row for each cell."""
    cells = spark.range(rows * cols).select(F.expr(f"id div {cols}").alias(names[0]), (F.col("id") % cols).alias(names[1]))
    return cells.withColumn(names[2], f(F.col(names[0]), F.col(names[1])))


def permutations(spark: SparkSession, n: int, m: int, seed: int = 0) -> DataFrame:
    """(row_id, idx, val): n rows, each a permutation of 0..m-1 by the order of hashes."""
    from pyspark.sql import Window

    cells = matrix(spark, n, m, lambda i, j: F.xxhash64(F.lit(seed), i, j), ("row_id", "idx", "h"))
    place = F.row_number().over(Window.partitionBy("row_id").orderBy("h", "idx")) - 1
    return cells.select("row_id", "idx", place.cast("long").alias("val"))


def affine_permutations(spark: SparkSession, n: int, m: int, a: int = 5, step: int = 17) -> DataFrame:
    """(row_id, idx, val): val = (a * idx + step * row_id) % m, a permutation where a and m share no factor."""
    return matrix(spark, n, m, lambda i, j: (a * j + step * i) % m, ("row_id", "idx", "val"))


def mesh_nodes(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    """(id, ix, iy, iz): the nodes of nx x ny x nz cells, x fastest."""
    a, b = nx + 1, ny + 1
    return spark.range(a * b * (nz + 1)).select("id", (F.col("id") % a).alias("ix"), F.expr(f"(id % {a * b}) div {a}").alias("iy"), F.expr(f"id div {a * b}").alias("iz"))


def mesh_elements(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    """(elem, ex, ey, ez): the cells."""
    return spark.range(nx * ny * nz).select(F.col("id").alias("elem"), (F.col("id") % nx).alias("ex"), F.expr(f"(id % {nx * ny}) div {nx}").alias("ey"), F.expr(f"id div {nx * ny}").alias("ez"))


def box_points(boxes: DataFrame) -> DataFrame:
    """A row for each integer point of half-open boxes (part, x0, x1, y0, y1, z0, z1), z outermost."""
    own = boxes.where("x0 < x1 and y0 < y1 and z0 < z1")
    for axis in "zyx":
        own = own.withColumn(axis, F.explode(F.sequence(F.col(f"{axis}0"), F.col(f"{axis}1") - 1)))
    return own.select("part", "x", "y", "z")
