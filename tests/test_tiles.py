"""Grids in tiles against plain loops."""

import math
import random

import pytest

from tessera.materialize import materialize, settled
from tessera.operators import stencils, tiles


def plain_laplacian(grid, weights):
    out = {}
    for i, j in grid:
        at = [((i + d, j), c) for d, c in weights.items()] + [((i, j + d), c) for d, c in weights.items()]
        if all(p in grid for p, _ in at):
            out[i, j] = float(sum(c * grid[p] for p, c in at))
    return out


def plain_relax(grid, sweeps):
    for _ in range(sweeps):
        beside = lambda i, j: [(i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)]
        grid = {p: sum(grid[q] for q in beside(*p)) / 4 if all(q in grid for q in beside(*p)) else u for p, u in grid.items()}
    return grid


def holey(seed, holes=0.04):
    rng = random.Random(seed)
    return {(i, j): float(rng.randrange(-50, 50)) for i in range(-11, 14) for j in range(-7, 30) if rng.random() > holes}


def table(spark, grid):
    return spark.createDataFrame([(i, j, u, "x") for (i, j), u in grid.items()], "i long, j long, u double, ti string")


def back(df, side):
    return {(r["i"], r["j"]): r["u"] for r in tiles.cells(df, side).collect()}


@pytest.mark.parametrize("side", [4, 7, 64])
def test_tiles_against_loops(spark, side):
    grid = holey(side)
    laid = tiles.lay_out(table(spark, grid), side)
    assert back(laid, side) == grid
    for weights in (stencils.SECOND_ORDER, stencils.FOURTH_ORDER):
        assert back(tiles.laplacian(laid, weights, side), side) == plain_laplacian(grid, weights)
    assert back(tiles.relax(laid, 3, side), side) == plain_relax(grid, 3)
    assert back(tiles.relax(laid, 0, side), side) == grid


def test_nulls_repeats_and_nothing(spark):
    rows = [(i, j, float(i * j), None) for i in range(5) for j in range(5)] + [(2, 2, 3.0, "r"), (None, 1, 1.0, ""), (1, None, 1.0, ""), (9, 9, None, "")]
    grid = {(i, j): float(i * j) for i in range(5) for j in range(5)} | {(2, 2): 7.0}
    laid = tiles.lay_out(spark.createDataFrame(rows, "i long, j long, u double, extra string"), 2)
    assert back(laid, 2) == grid
    assert back(tiles.laplacian(laid, stencils.SECOND_ORDER, 2), 2) == plain_laplacian(grid, stencils.SECOND_ORDER)
    none = tiles.lay_out(spark.createDataFrame([], "i long, j long, u double"), 4)
    assert none.count() == 0 and tiles.relax(none, 2, 4).count() == 0


def test_values_that_are_not_finite_are_no_holes(spark):
    grid = {(i, j): 1.0 for i in range(6) for j in range(6)} | {(2, 2): math.inf, (4, 4): math.nan}
    out = back(tiles.laplacian(tiles.lay_out(table(spark, grid), 3), stencils.SECOND_ORDER, 3), 3)
    assert set(out) == set(plain_laplacian(grid, stencils.SECOND_ORDER))
    assert out[2, 1] == math.inf and math.isnan(out[4, 4]) and math.isnan(out[3, 4]) and out[1, 1] == 0


def test_a_stencil_ends_in_the_next_tile(spark):
    with pytest.raises(ValueError):
        tiles.laplacian(tiles.lay_out(table(spark, {(0, 0): 1.0}), 1), stencils.FOURTH_ORDER, 1)


def test_only_strips_are_exchanged(spark):
    """The tiles stay in place: the one exchange of a sweep is of strips."""
    with settled(spark):
        laid = tiles._dealt(tiles.lay_out(table(spark, holey(1)), 8))
        for _ in range(2):
            swept = tiles._sweep(laid, tiles._mean_of_four, 8, 1)
            plan = swept._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "CartesianProduct" not in plan
            laid = materialize(swept)
