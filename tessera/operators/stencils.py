"""Laplacians of grids (i, j, u), by windows along rows and columns of tiles.

A tile has TILE x TILE places. A cell near a tile's edge goes to the tile beyond as well, so each tile has
all that its own cells need: cells are dealt out once, and no task needs a whole line of the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coefficients by distance from the centre, for one axis.
SECOND_ORDER = {-1: 1, 0: -2, 1: 1}
FOURTH_ORDER = {-2: -1, -1: 16, 0: -30, 1: 16, 2: -1}
TILE = 512


def _along(axis: str, across: str, weights: dict[int, int]) -> Column:
    """The weighted sum along an axis; null where a neighbour is missing: the next row counts only if it is the next place."""
    w = Window.partitionBy("_ti", "_tj", across).orderBy(axis)
    at = lambda d: F.when(F.lag(axis, -d).over(w) == F.col(axis) + d, F.lag("u", -d).over(w)) if d else F.col("u")
    terms = [at(d) * F.lit(c) for d, c in weights.items()]
    return sum(terms[1:], terms[0])


def _tiled(grid: DataFrame, reach: int, tile: int) -> DataFrame:
    """Cells with their tile (_ti, _tj), and _own; those within ``reach`` of an edge for the neighbouring tile too."""
    ti, tj = F.floor(F.col("i") / tile), F.floor(F.col("j") / tile)
    place = lambda a, b, own: F.struct(a.alias("ti"), b.alias("tj"), F.lit(own).alias("own"))
    near = [(F.pmod("i", F.lit(tile)) < reach, place(ti - 1, tj, False)), (F.pmod("i", F.lit(tile)) >= tile - reach, place(ti + 1, tj, False))]
    near += [(F.pmod("j", F.lit(tile)) < reach, place(ti, tj - 1, False)), (F.pmod("j", F.lit(tile)) >= tile - reach, place(ti, tj + 1, False))]
    places = F.filter(F.array(place(ti, tj, True), *[F.when(c, p) for c, p in near]), lambda x: x.isNotNull())
    dealt = grid.select("i", "j", "u", F.explode(places).alias("_t"))
    return dealt.select("i", "j", "u", F.col("_t.ti").alias("_ti"), F.col("_t.tj").alias("_tj"), F.col("_t.own").alias("_own")).repartition("_ti", "_tj")


def laplacian(grid: DataFrame, weights: dict[int, int], scale: float = 1.0, out: str = "d2u", tile: int = TILE) -> DataFrame:
    """(i, j, d2u) of the interior: the cells whose neighbours, as far as the weights reach, are all there. Places as in ``grid``."""
    first = _tiled(grid, max(weights), tile).withColumn("_a", _along("j", "i", weights))
    both = first.withColumn("_b", _along("i", "j", weights))
    return both.where("_own and _a is not null and _b is not null").select("i", "j", ((F.col("_a") + F.col("_b")) * F.lit(scale)).alias(out))


def laplacian5(grid: DataFrame, tile: int = TILE) -> DataFrame:
    """Second order, not divided by the square of the step."""
    return laplacian(grid, SECOND_ORDER, tile=tile)


def laplacian9(grid: DataFrame, n: int | None = None, tile: int = TILE) -> DataFrame:
    """Fourth order; the interior is numbered from 0. With ``n`` points a side of unit length it is scaled by the step."""
    scale = (n - 1) ** 2 / 12 if n else 1 / 12
    inner = laplacian(grid, FOURTH_ORDER, scale, tile=tile)
    return inner.select((F.col("i") - 2).alias("i"), (F.col("j") - 2).alias("j"), "d2u")
