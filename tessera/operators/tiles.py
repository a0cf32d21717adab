"""Stencils over grids whose tiles are rows: a tile's values are one array, and tiles exchange the strips along their edges alone.

A grid (i, j, u) becomes (ti, tj, u): SIDE x SIDE values in rows of j, null where the grid has a hole. Tiles
are dealt out once, by (ti, tj). A sweep sends each tile's four edge strips to the tiles beside it, and works on
whole arrays with numpy; the tiles themselves stay where they are (``materialize.settled``), so a sweep over
n cells shuffles about 4 n / SIDE of them. Each sweep cuts lineage, as it reads the tiles twice.

Values are doubles: whole numbers are exact up to 2**53. Defined cases: cells with a null place are left out; a
null value is a hole; a cell that is there twice adds up; places may be negative; an empty grid has no tiles. Other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.materialize import materialize, settled

#: Places along a tile's side: 32 KB a tile.
SIDE = 64
#: What a sweep does: (values, there), each with a margin of the stencil's reach -> values and there of the inner part.
Rule = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def lay_out(grid: DataFrame, side: int = SIDE) -> DataFrame:
    """(ti, tj, u) of a grid's cells (i, j, u); a tile that has no cell is no row."""
    cells = grid.where("i is not null and j is not null and u is not null").groupBy("i", "j").agg(F.sum("u").cast("double").alias("u"))
    place = (F.pmod("i", F.lit(side)) * side + F.pmod("j", F.lit(side))).cast("int")
    tile = [F.floor(F.col(a) / side).cast("long").alias(f"t{a}") for a in "ij"]

    @F.arrow_udf("array<double>")
    def dense(cells: pa.Array) -> pa.Array:
        return _lists(((place, u) for place, u in _cells(cells)), side)

    return cells.groupBy(*tile).agg(F.collect_list(F.struct(place.alias("place"), "u")).alias("c")).select("ti", "tj", dense("c").alias("u"))


def _cells(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k in range(len(lists)):
        cells = lists[k].values
        yield cells.field("place").to_numpy(zero_copy_only=False), cells.field("u").to_numpy(zero_copy_only=False)


def _lists(tiles: Iterator[tuple[np.ndarray, np.ndarray]], side: int) -> pa.Array:
    """Tiles from the places and values that each has."""
    values, there = [], []
    for place, u in tiles:
        own, has = np.zeros(side * side), np.zeros(side * side, dtype=bool)
        own[place], has[place] = u, True
        values.append(own)
        there.append(has)
    return _array(values, there, side)


def _array(values: list[np.ndarray], there: list[np.ndarray], side: int) -> pa.Array:
    none = not values
    flat = pa.array(np.empty(0) if none else np.concatenate(values), pa.float64(), mask=np.empty(0, dtype=bool) if none else ~np.concatenate(there))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * side * side, pa.int32()), flat)


def cells(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """The grid (i, j, u) that tiles hold."""
    each = tiles.select("ti", "tj", F.posexplode("u").alias("k", "u")).where("u is not null")
    return each.select((F.col("ti") * side + F.floor(F.col("k") / side)).alias("i"), (F.col("tj") * side + F.col("k") % side).alias("j"), "u")


def _strips(tiles: DataFrame, side: int, reach: int) -> DataFrame:
    """(ti, tj, strips): what the tiles beside each tile have along its edges, by where they lie from it."""
    columns = lambda first: F.transform(F.sequence(F.lit(0), F.lit(side * reach - 1)), lambda k: F.get("u", F.floor(k / reach).cast("int") * side + first + k % reach))
    sent = {
        (-1, 0, "below"): F.slice("u", 1, side * reach),
        (1, 0, "above"): F.slice("u", side * (side - reach) + 1, side * reach),
        (0, -1, "right"): columns(0),
        (0, 1, "left"): columns(side - reach),
    }
    each = [F.struct((F.col("ti") + di).alias("ti"), (F.col("tj") + dj).alias("tj"), F.lit(name).alias("side"), u.alias("u")) for (di, dj, name), u in sent.items()]
    dealt = tiles.select(F.explode(F.array(*each)).alias("s")).select("s.*")
    return dealt.groupBy("ti", "tj").agg(F.collect_list(F.struct("side", "u")).alias("strips"))


def _swept(rule: Rule, side: int, reach: int) -> Callable[[Column, Column], Column]:
    inner = slice(reach, reach + side)
    beside = {"above": (slice(0, reach), inner), "below": (slice(reach + side, None), inner), "left": (inner, slice(0, reach)), "right": (inner, slice(reach + side, None))}

    @F.arrow_udf("array<double>")
    def swept(tile: pa.Array, strips: pa.Array) -> pa.Scalar:
        u, has = np.zeros((side + 2 * reach,) * 2), np.zeros((side + 2 * reach,) * 2, dtype=bool)
        parts = [((inner, inner), tile[0].values)]
        if strips[0].is_valid:
            parts += [(beside[s["side"].as_py()], s["u"].values) for s in strips[0]]
        for place, part in parts:
            u[place] = part.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(u[place].shape)
            has[place] = part.is_valid().to_numpy(zero_copy_only=False).reshape(u[place].shape)
        own, kept = rule(u, has)
        return _array([own.ravel()], [kept.ravel()], side)[0]

    return swept


def _sweep(tiles: DataFrame, rule: Rule, side: int, reach: int) -> DataFrame:
    if not 0 < reach <= side:
        raise ValueError("a stencil reaches to the next tile at most")
    both = tiles.join(_strips(tiles, side, reach), ["ti", "tj"], "left")
    own = Window.partitionBy("ti", "tj")  # of one row: unlike other calls of Python, a window lets Spark see that rows stay where they were
    return both.select("ti", "tj", _swept(rule, side, reach)("u", "strips").over(own).alias("u"))


def _dealt(tiles: DataFrame) -> DataFrame:
    return materialize(tiles.repartition("ti", "tj"))


def _at(x: np.ndarray, reach: int, di: int, dj: int) -> np.ndarray:
    """The inner part of an array, moved."""
    n, m = x.shape
    return x[reach + di : n - reach + di, reach + dj : m - reach + dj]


def laplacian(tiles: DataFrame, weights: dict[int, int], side: int = SIDE) -> DataFrame:
    """Tiles of the weighted sums along both axes, with holes where a neighbour that a weight asks for isn't there."""
    reach = max(map(abs, weights))

    def rule(u: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        moves = [(d, 0, c) for d, c in weights.items()] + [(0, d, c) for d, c in weights.items()]
        with np.errstate(invalid="ignore"):
            total = sum(c * _at(u, reach, di, dj) for di, dj, c in moves)
        return total, np.logical_and.reduce([_at(has, reach, di, dj) for di, dj, _ in moves])

    with settled(tiles.sparkSession):
        return materialize(_sweep(_dealt(tiles), rule, side, reach))


def _mean_of_four(u: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    moves = [(-1, 0), (1, 0), (0, -1), (0, 1)]
    up, down, left, right = (_at(u, 1, *d) for d in moves)
    own, among = _at(has, 1, 0, 0), np.logical_and.reduce([_at(has, 1, *d) for d in [(0, 0), *moves]])
    with np.errstate(invalid="ignore"):
        return np.where(among, (up + down + left + right) / 4, _at(u, 1, 0, 0)), own


def relax(tiles: DataFrame, sweeps: int, side: int = SIDE) -> DataFrame:
    """Jacobi's relaxation: each sweep puts cells at the mean of their four neighbours, all at once.

    Cells that lack a neighbour are the boundary, and keep their values; holes stay holes."""
    with settled(tiles.sparkSession):
        out = _dealt(tiles)
        for _ in range(sweeps):
            out = materialize(_sweep(out, _mean_of_four, side, 1))
    return out
