"""Operators over rows of tables: solver by owners, selection by digits, bisection, overlap joins, block products."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.materialize import materialize, settled
from tessera.operators import dense, halo, radix, scans, spatial
from tessera.plans import fem
from tessera.sources import csr_text


def laplacian(n, edges):
    """Dense matrix of a graph's Laplacian, plus one, and its cells; repeated edges add up."""
    a = np.eye(n)
    for i, j in edges:
        a[i, i] += 1
        a[j, j] += 1
        a[i, j] -= 1
        a[j, i] -= 1
    cells = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    return a, cells


@pytest.fixture(scope="module")
def system(spark):
    """A hub with a third of all cells beside a random graph, repeated cells, and rows that are none."""
    rng = random.Random(2)
    edges = [(0, j) for j in range(1, 200)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(300)]
    a, cells = laplacian(200, [e for e in edges if e[0] != e[1]])
    cells = [(i, j, v / 2) for i, j, v in cells for _ in range(2)] + [(None, 1, 5.0), (1, None, 5.0), (1, 2, None)]
    return a, spark.createDataFrame(cells, "row long, col long, coef double").repartition(5)


@pytest.mark.parametrize("long_row", [50, 10_000])
def test_products_by_owner(spark, system, long_row):
    a, cells = system
    layout = halo.lay_out(cells, parts=5, long_row=long_row)
    assert (layout.long is None) == (long_row > 1000)
    x = np.arange(200) % 11 - 5.0
    with settled(spark):
        v = materialize(layout.spread(spark.createDataFrame(list(enumerate(x.tolist())), "i long, v double")))
        got = {r["i"]: r["v"] for r in layout.product(v).collect()}
    assert len(got) == 200 and max(abs(got[i] - y) for i, y in enumerate(a @ x)) < 1e-9
    read = layout.halo.collect()
    assert len({(r["col"], r["reader"]) for r in read}) == len(read)  # a value goes once to each part that reads it


def test_steps_exchange_values_alone(spark, system):
    """One exchange in a product, of external values; two with long rows, of their sums. Cells stay in place."""
    for long_row, n in ((10_000, 1), (50, 2)):
        layout = halo.lay_out(system[1], parts=5, long_row=long_row)
        with settled(spark):
            v = materialize(layout.spread(spark.range(200).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))))
            plan = layout.product(v)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == n and "Broadcast" not in plan


@pytest.mark.parametrize("long_row", [50, 10_000])
def test_solution(spark, system, long_row):
    a, cells = system
    b = np.arange(200) % 7 - 3.0
    right = spark.createDataFrame(list(enumerate(b.tolist())), "row long, v double")
    found = fem.conjugate_gradients(halo.lay_out(cells, parts=3, long_row=long_row), right, tolerance=1e-8, iterations=60)
    assert found.converged and not found.breakdown and found.residual < 1e-8
    x = np.linalg.solve(a, b)
    assert max(abs(r["v"] - x[r["i"]]) for r in found.x.collect()) < 1e-8


def test_parts_are_rows_of_arrays(spark, system):
    """What is kept, dealt and exchanged are a few rows of arrays, however many cells and entries there are."""
    layout = halo.lay_out(system[1], parts=5, long_row=50)
    assert layout.cells.count() <= 5 and layout.reads.count() <= 5 and layout.long.count() <= 5
    with settled(spark):
        v = materialize(layout.spread(spark.range(200).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))))
        assert v.count() <= 5 and layout.times(v, "v", "out").count() == v.count()


@pytest.mark.parametrize("long_row", [3, 10_000])
def test_products_with_what_is_missing(spark, long_row):
    """Values that are null or lacking add nothing, even to cells that aren't finite; ids that the matrix lacks get 0; null ids are none; repeated ids add up."""
    cells = [(0, j, 1.0 + j) for j in range(6)] + [(1, 4, math.inf), (1, 5, math.nan), (2, 1, -2.0), (5, 0, 3.0)]
    x = [(0, 1.0), (1, 2.5), (1, 0.5), (2, 2.0), (3, 4.0), (4, None), (9, 7.0), (None, 5.0)]
    layout = halo.lay_out(spark.createDataFrame(cells, "row long, col long, coef double"), parts=4, long_row=long_row)
    with settled(spark):
        v = materialize(layout.spread(spark.createDataFrame(x, "i long, v double")))
        got = {r["i"]: r["v"] for r in layout.product(v).collect()}
    assert got == {0: 1.0 + 6.0 + 6.0 + 16.0, 1: 0.0, 2: -6.0, 3: 0.0, 4: 0.0, 9: 0.0}
    b = spark.createDataFrame([(0, 2.0), (7, 4.0), (None, 1.0)], "row long, v double")
    diagonal = spark.createDataFrame([(0, 0, 2.0), (7, 7, 2.0)], "row long, col long, coef double")
    lengths = diagonal.select("row", F.lit(50).alias("n"))  # more than there are: only where cells lie depends on it
    found = fem.conjugate_gradients(halo.lay_out(diagonal, parts=3, long_row=long_row, lengths=lengths), b)
    assert found.converged and {r["i"]: r["v"] for r in found.x.collect()} == {0: 1.0, 7: 2.0}


def test_breakdown_is_told(spark):
    """A right-hand side outside of the range of a singular matrix: the first direction has no product."""
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, -1.0), (1, 0, -1.0), (1, 1, 1.0)], "row long, col long, coef double")
    b = spark.createDataFrame([(0, 1.0), (1, 1.0)], "row long, v double")
    for a in (cells, halo.lay_out(cells, parts=2)):
        found = fem.conjugate_gradients(a, b)
        assert found.breakdown and not found.converged and found.iterations == 0 and found.residual == pytest.approx(math.sqrt(2))
    assert fem.conjugate_gradients(cells, spark.createDataFrame([(0, 0.0), (1, 0.0)], "row long, v double")).converged


# --- selection by digits ---------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["small", "wide", "double"])
def test_ranks_of_a_column(spark, kind):
    rng = random.Random(3)
    special = {"small": [5, 5, 5], "wide": [-(1 << 63), (1 << 63) - 1, 0, -1], "double": [0.0, -0.0, math.inf, -math.inf, math.nan, 5e-324, -1.5, 1e308]}[kind]
    value = {"small": lambda: rng.randrange(20), "wide": lambda: rng.randrange(-(1 << 63), 1 << 63), "double": lambda: rng.gauss(0, 1e3)}[kind]
    rows = [(v, p) for v in special for p in (3, None)] + [(value(), rng.randrange(50)) for _ in range(150)] + [(None, 1)] * 20
    df = spark.createDataFrame(rows, f"price {'double' if kind == 'double' else 'long'}, place long")
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (isinstance(r[0], float) and math.isnan(r[0]), 0 if isinstance(r[0], float) and math.isnan(r[0]) else r[0], r[1] is not None, r[1] or 0))
    ranks = [0, 1, 40, 41, 99, len(order) - 1, len(order), 10_000]
    got = {r["rank"]: (r["value"], r["place"]) for r in radix.kth_of_column(df, "price", "place", ranks).collect()}
    assert set(got) == {r for r in ranks if r < len(order)}
    assert {k: repr((v + 0 if v == v else v, p)) for k, (v, p) in got.items()} == {k: repr((order[k][0] + 0 if order[k][0] == order[k][0] else order[k][0], order[k][1])) for k in got}


def test_selection_sorts_no_rows(spark):
    """Rows are counted by digit; what is ordered are histograms."""
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(0).alias("g"))
    got = radix.select(df, ["v"], spark.createDataFrame([(0, k) for k in range(0, 1000, 100)], "g int, rank long"), ["g"]).collect()
    assert sorted((r["rank"], r["v"], r["left"], r["ties"]) for r in got) == [(k, k, 0, 1) for k in range(0, 1000, 100)]


def brute_parts(rows, axes, parts):
    """Recursive bisection of a list, each node sorted."""
    total, out = len(rows), {}

    def cut(own, lo, hi, level):
        if hi - lo == 1:
            out.update((r["id"], lo) for r in own)
            return
        mid, axis = lo + (hi - lo) // 2, axes[level % len(axes)]
        own = sorted(own, key=lambda r: (r[axis] is not None, r[axis] or 0, r["id"]))
        k = mid * total // parts - lo * total // parts
        cut(own[:k], lo, mid, level + 1)
        cut(own[k:], mid, hi, level + 1)

    cut(rows, 0, parts, 0)
    return out


@pytest.mark.parametrize("parts", [1, 2, 5, 8])
def test_bisection_of_rows(spark, parts):
    """Ties, nulls, negative numbers and doubles; a third of all rows in one place."""
    rng = random.Random(4)
    rows = [{"id": k, "a": rng.randrange(-20, 20), "b": rng.choice([None, rng.gauss(0, 1)])} for k in range(60)] + [{"id": 100 + k, "a": 3, "b": 0.5} for k in range(31)]
    df = spark.createDataFrame([(r["id"], r["a"], r["b"]) for r in rows], "id long, a long, b double").repartition(3)
    got = radix.bisect_rows(df, ["a", "b"], parts, "id")
    assert got.columns == ["id", "a", "b", "part"]
    assert {r["id"]: r["part"] for r in got.collect()} == brute_parts(rows, ["a", "b"], parts)


def test_bisection_without_keys(spark):
    """Equal rows are told apart, so parts differ by one row at most; few rows leave parts empty."""
    same = spark.range(100).select(F.lit(1).alias("a"))
    assert sorted(r["count"] for r in radix.bisect_rows(same, ["a"], 7).groupBy("part").count().collect()) == [14, 14, 14, 14, 14, 15, 15]
    assert sorted(r["part"] for r in radix.bisect_rows(same.limit(2), ["a"], 4).collect()) == [1, 3]
    assert radix.bisect_rows(same.limit(0), ["a"], 4).count() == 0


# --- overlap joins ---------------------------------------------------------------------------------


def brute_pairs(a, b, axes, closed):
    below = (lambda x, y: x <= y) if closed else (lambda x, y: x < y)
    fine = lambda r: all(r[lo] is not None and r[hi] is not None and r[lo] == r[lo] and r[hi] == r[hi] and below(r[lo], r[hi]) for lo, hi in axes)
    return Counter((x["id"], y["id"]) for x in a for y in b if fine(x) and fine(y) and all(below(x[lo], y[hi]) and below(y[lo], x[hi]) for lo, hi in axes))


@pytest.mark.parametrize("dims", [1, 2, 3])
@pytest.mark.parametrize("closed", [True, False])
def test_overlaps(spark, dims, closed):
    """Long and short boxes, points, negative places, ends that touch, repeated rows, nulls, ends the wrong way round; a hot cell."""
    rng = random.Random(dims)
    axes = [(f"lo{k}", f"hi{k}") for k in range(dims)]

    def box(n, hot):
        lo = [rng.uniform(-1, 1) if hot else float(rng.randrange(-40, 40)) for _ in range(dims)]
        size = [rng.choice([0.0, 0.5, 1.0, 3.0, 60.0 if rng.random() < 0.1 else 2.0]) for _ in range(dims)]
        return {"id": n, **{k: v for d in range(dims) for k, v in ((f"lo{d}", lo[d]), (f"hi{d}", lo[d] + size[d]))}}

    tables = [[box(n, n % 3 == 0) for n in range(90)] for _ in range(2)]
    for t in tables:
        t += [dict(t[0]), dict(t[1]), {**t[2], "lo0": None}, {**t[3], "hi0": math.nan}, {**t[4], "hi0": t[4]["lo0"] - 1}]
    schema = "id long, " + ", ".join(f"{c} double" for axis in axes for c in axis)
    a, b = (spark.createDataFrame([tuple(r.values()) for r in t], schema).repartition(3) for t in tables)
    want = brute_pairs(*tables, axes, closed)
    for options in ({}, {"pairs_each": 20}, {"units": [5.0] * dims}):
        got = Counter((r["x"], r["y"]) for r in spatial.overlap_join(a, b, axes, closed=closed, **options).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).collect())
        assert got == want
    assert want


def test_overlaps_compare_no_table_with_all(spark):
    a = spark.range(50).select("id", F.col("id").alias("lo"), (F.col("id") + 2).alias("hi"))
    plan = spatial.overlap_join(a, a, [("lo", "hi")])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert spatial.overlap_join(a.limit(0), a, [("lo", "hi")]).count() == 0
    points = a.select("id", "lo", F.col("lo").alias("hi"))
    assert spatial.overlap_join(points, points, [("lo", "hi")]).count() == 50


# --- blocks and scans ------------------------------------------------------------------------------


def cells_of(df):
    return sorted((r["i"], r["k"], repr(r["v"])) for r in df.collect())


@pytest.mark.parametrize("side", [1, 2, 8])
def test_blocks_with_repeated_cells_and_infinities(spark, side):
    a = [(0, 0, 1.0), (0, 0, 2.0), (0, 5, math.inf), (7, 5, -1.0), (9, 2, 4.0), (None, 1, 1.0), (1, None, 1.0), (1, 1, None), (12, 2, 0.0)]
    b = [(0, 0, 1.0), (5, 3, 2.0), (5, 9, 0.5), (2, 8, math.inf), (2, 8, 1.0), (3, 1, 7.0), (None, 1, 1.0)]
    x, y = spark.createDataFrame(a, "i long, j long, v double"), spark.createDataFrame(b, "j long, k long, v double")
    fine = lambda df: df.dropna()
    assert cells_of(dense.matmul_blocks(x, y, block=4, side=side)) == cells_of(dense.matmul_cells(fine(x), fine(y)))
    assert dense.matmul_blocks(x.limit(0), y, block=4, side=side).count() == 0


@pytest.mark.parametrize("side", [1, 3])
def test_blocks_against_numpy(spark, side):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-5, 6, (30, 21)), rng.integers(-5, 6, (21, 26))
    frame = lambda m, names: spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(m)], f"{names[0]} long, {names[1]} long, v double")
    got = dense.matmul_blocks(frame(a, "ij"), frame(b, "jk"), block=4, side=side).collect()
    out = np.full((30, 26), np.nan)
    for r in got:
        out[r["i"], r["k"]] = r["v"]
    assert len(got) == 30 * 26 and (out == a @ b).all()


def test_scans_with_nulls(spark):
    ids = spark.createDataFrame([(5,), (6,), (None,), (9,), (None,)], "id long")
    assert sorted(map(tuple, scans.compress_runs(ids).collect())) == [(5, 0, 2), (9, 2, 1)]
    values = spark.createDataFrame([(3, 1), (None, 7), (1, 2), (2, None), (None, 1)], "id long, n long")
    got = scans.exclusive_scan(values, "id", "n", "before").collect()
    assert sorted((r["id"] or -1, r["n"] or -1, r["before"]) for r in got) == [(-1, 1, 0), (-1, 7, 0), (1, 2, 0), (2, -1, 2), (3, 1, 2)]
    starts = spark.createDataFrame([(1, "a"), (None, "n"), (4, "b")], "start long, name string")
    assert sorted(map(tuple, scans.floor_lookup(ids, starts, "id", "start").select("id", "name").collect())) == [(5, "b"), (6, "b"), (9, "b")]


def test_lines_of_a_sparse_matrix(spark):
    """Empty rows, one with most cells, and a matrix without any."""
    cells = [(0, j, float(j) - 7.5) for j in range(40)] + [(3, 2, 5.0), (3, 0, 1e-9), (6, 39, 2.0)]
    df = spark.createDataFrame(cells, "row long, col long, coef double").repartition(3)
    text = sorted(map(tuple, csr_text.lines(df, 8, 40).collect()))
    assert [n for n, _ in text] == list(range(1 + 9 + 43))
    assert [t for _, t in text[:10]] == ["43 8 40", "0", "40", "40", "40", "42", "42", "42", "43", "43"]
    coo, offsets = csr_text.parse(csr_text.lines(df, 8, 40))
    assert sorted(map(tuple, coo.collect())) == sorted(cells) and offsets.count() == 9
    assert csr_text.parse(csr_text.lines(df.limit(0), 2, 2))[0].count() == 0


def test_lines_of_a_matrix_write_its_cells_once(spark, monkeypatch):
    from tessera.operators import scans
    from tessera.sources import csr_text

    wide = []
    for module in (csr_text, scans):
        monkeypatch.setattr(module, "materialize", lambda df, own=module.materialize: wide.append("coef" in df.columns) or own(df))
    cells = spark.createDataFrame([(0, 1, 2), (0, 3, 4), (3, 0, 5)], "row long, col long, coef long")
    coo, _ = csr_text.parse(csr_text.lines(cells, 4, 4))
    assert sorted(map(tuple, coo.collect())) == [(0, 1, 2.0), (0, 3, 4.0), (3, 0, 5.0)]
    assert sum(wide) == 1


def test_part_stats_take_more_partitions_for_more_cells(spark, monkeypatch):
    from tessera.operators import sparse

    rows = [(i, (i * k) % 60, 1) for i in range(60) for k in (1, 2, 7)]
    cells, owners = spark.createDataFrame(rows, "row long, col long, coef long"), spark.createDataFrame([(i, i % 5) for i in range(60)], "row long, part long")
    one = sparse.part_stats(cells, owners).collect()
    monkeypatch.setattr(sparse, "CELLS_EACH", 20)
    many = sparse.part_stats(cells, owners)
    assert many.collect() == one
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 9), REPARTITION_BY_NUM") >= 4  # 180 cells
