"""Meshes of which some cells are there, bricks of many shapes, solutions between nodes, and rows in boxes and their halos."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import geometry, scans
from tessera.plans import catalog, fem


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_structure_of_some_cells(spark):
    mesh = fem.Mesh(3, 2, 2)
    every = spark.createDataFrame(list(itertools.product(range(3), range(2), range(2))), "ex long, ey long, ez long")
    assert tuples(fem.structure_of(every, mesh)) == tuples(fem.structure(spark, mesh))
    rng = random.Random(3)
    some = rng.sample(sorted(itertools.product(range(3), range(2), range(2))), 5)
    node = lambda c, d: c[0] + d[0] + 4 * (c[1] + d[1]) + 12 * (c[2] + d[2])
    want = {(node(c, a), node(c, b)) for c in some for a in fem.CORNERS for b in fem.CORNERS}
    rows = [(*c, "x") for c in [*some, some[0], (None, 0, 0), (0, 0, None)]]
    assert tuples(fem.structure_of(spark.createDataFrame(rows, "ex long, ey long, ez long, row string"), mesh)) == sorted(want)
    assert fem.structure_of(every.limit(0), mesh).count() == 0


def test_bricks_are_as_single_cells(spark):
    steps = [(0.5, 0.25, 2.0), (1.0, 1.0, 1.0), (3.0, 0.1, 0.7)]
    cells = spark.createDataFrame([(k, *h, 2.5) for k, h in enumerate(steps)], "id int, hx double, hy double, hz double, q double")
    for n in (2, 3):
        got = {(r["id"], r["a"], r["b"]): r["k"] for r in fem.brick_matrices(cells, n).collect()}
        for k, h in enumerate(steps):
            for r in fem.element_matrix(spark, h, n).collect():
                assert abs(got[k, r["a"], r["b"]] - r["k"]) < 1e-9
    got = {(r["id"], r["a"]): r["v"] for r in fem.brick_sources(cells).collect()}
    for k, h in enumerate(steps):
        assert all(abs(got[k, r["a"]] - r["v"]) < 1e-9 for r in fem.element_source(spark, h, 2.5).collect())
    none = spark.createDataFrame([(1, None, 1.0, 1.0, None)], "id int, hx double, hy double, hz double, q double")
    assert all(r["k"] is None for r in fem.brick_matrices(none).collect()) and all(r["v"] is None for r in fem.brick_sources(none).collect())


def test_solutions_between_nodes(spark):
    """A function that is linear along each axis is itself between the nodes."""
    mesh = fem.Mesh(3, 4, 2)
    f = lambda x, y, z: 1 + 2 * x - y + 3 * z + x * y * z
    nodes = [(i + 4 * j + 20 * k, f(i / 3, j / 4, k / 2)) for i in range(4) for j in range(5) for k in range(3)]
    rng = random.Random(5)
    points = [tuple(rng.random() for _ in range(3)) for _ in range(40)] + [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (1 / 3, 1.0, 0.5)]
    rows = [*points, points[0], (1.5, 0.0, 0.0), (-0.1, 0.5, 0.5), (None, 0.5, 0.5)]
    x = spark.createDataFrame(nodes, "i long, v double")
    out = fem.interpolate(x, spark.createDataFrame(rows, "x double, y double, z double"), mesh).collect()
    assert sorted((r["x"], r["y"], r["z"]) for r in out) == sorted(points)
    assert all(abs(r["v"] - f(r["x"], r["y"], r["z"])) < 1e-9 for r in out)
    # a place whose cell lacks a corner has no value
    lacking = fem.interpolate(x.where("i <> 0"), spark.createDataFrame([(0.1, 0.1, 0.1), (0.9, 0.9, 0.9)], "x double, y double, z double"), mesh)
    assert [r["x"] for r in lacking.collect()] == [0.9]


def test_shapes_sum_to_one(spark):
    points = spark.createDataFrame([(k, x, 0.5, -1.0) for k, x in enumerate((-1.0, -0.25, 1.0))], "id int, x double, y double, z double")
    assert all(abs(r[1] - 1) < 1e-12 for r in fem.shapes_at(points).groupBy("id").agg(F.sum("v")).collect())
    corner = fem.shapes_at(spark.createDataFrame([(1.0, -1.0, -1.0)], "x double, y double, z double")).where("v <> 0").collect()
    assert [(r["a"], r["v"]) for r in corner] == [(1, 1.0)]


def test_rows_in_boxes_and_halos(spark):
    rng = random.Random(7)
    limits = (8, 6, 5)
    rows = [(rng.randrange(8), rng.randrange(6), rng.randrange(5)) for _ in range(300)] + [(1, 1, 1)] * 200
    boxes = geometry.bisect(geometry.Box([0, 0, 0], list(limits)), 6)
    table = geometry.table(spark, boxes)
    places = geometry.counted(spark.createDataFrame([*rows, (None, 1, 1)], "x int, y int, z int"))
    has = lambda b, p, by: all(max(b.lo[k] - by, 0) <= p[k] < min(b.hi[k] + by, limits[k]) for k in range(3))
    counts = {p: rows.count(p) for p in rows}
    own = sorted((part, *p, n) for p, n in counts.items() for part, b in enumerate(boxes) if has(b, p, 0))
    assert tuples(geometry.owned(places, table)) == own
    halo = [(o, r, *p, n) for p, n in counts.items() for o, a in enumerate(boxes) if has(a, p, 0) for r, b in enumerate(boxes) if r != o and has(b, p, 1)]
    out = geometry.halo_rows(places, table, limits)
    assert tuples(out.select("owner", "reader", "x", "y", "z", "n")) == sorted(halo) and halo
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()
    assert geometry.owned(places.limit(0), table).count() == 0


def test_structure_of_tall_meshes_shuffles_no_pairs(spark):
    rng = random.Random(2)
    mesh = fem.Mesh(3, 2, 70)
    cells = sorted({(rng.randrange(3), rng.randrange(2), rng.choice([0, 30, 31, 32, 33, 63, 64, rng.randrange(70)])) for _ in range(60)})
    df = spark.createDataFrame(cells + cells[:5], "ex long, ey long, ez long")
    ids = [[mesh.node_id(x + a, y + b, z + c) for a, b, c in fem.CORNERS] for x, y, z in cells]
    want = sorted({(a, b) for n in ids for a in n for b in n})
    out = fem.structure_of(df, mesh)
    assert sorted(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # pairs are made above the last one
    lengths = fem.row_lengths(df, mesh)
    assert {r: n for r, n in lengths.collect()} == {a: sum(1 for p in want if p[0] == a) for a in {p[0] for p in want}}
    offsets = dict(map(tuple, fem.row_offsets(lengths).collect()))
    assert offsets == {a: sum(1 for p in want if p[0] < a) for a in {p[0] for p in want}}


def test_bricks_of_a_single_partition_are_dealt_out(spark):
    cells = spark.range(100).selectExpr("id", "1.0 hx", "2.0 hy", "3.0 hz", "1.0 q", "0.0 x", "0.0 y", "0.0 z").coalesce(1)
    for made, times in ((fem.brick_matrices, 64), (fem.brick_sources, 8), (fem.shapes_at, 8)):
        sizes = made(cells).groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == 4 and all(abs(n - 25 * times) <= 2 * times for _, n in sizes)


@pytest.fixture
def scattered(spark, monkeypatch):
    """Cells far from one another, and along a line, dealt into many ranges and kept in small pieces."""
    monkeypatch.setattr(fem, "RANGE_CELLS", 10)
    monkeypatch.setattr(fem, "HELD", 40)
    monkeypatch.setattr(fem, "PACKED", 7)
    rng, mesh = random.Random(6), fem.Mesh(2_000_000, 3000, 4)
    cells = sorted({(rng.randrange(2_000_000), rng.randrange(3000), rng.randrange(4)) for _ in range(80)} | {(x, 5, 1) for x in range(70)} | {(1_999_999, 2999, 3)})
    ids = [[mesh.node_id(x + a, y + b, z + c) for a, b, c in fem.CORNERS] for x, y, z in cells]
    return spark.createDataFrame(cells + cells[:5], "ex long, ey long, ez long").repartition(3), mesh, sorted({(a, b) for n in ids for a in n for b in n})


def test_structure_of_scattered_cells_shuffles_bytes(scattered):
    cells, mesh, want = scattered
    out = fem.structure_of(cells, mesh)
    assert sorted(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert final.count("Exchange hashpartitioning") == 1 and "edges" in final


def test_offsets_of_scattered_cells_sort_no_rows(spark, scattered, monkeypatch):
    cells, mesh, want = scattered
    monkeypatch.setattr(scans, "exclusive_scan", lambda *more, **named: pytest.fail("rows are scanned"))
    starts = {}
    for k, (row, _) in enumerate(want):
        starts.setdefault(row, k)
    got = list(map(tuple, fem.offsets_of(cells, mesh).collect()))
    assert sorted(got) == sorted(starts.items())
    assert fem.offsets_of(cells.limit(0), mesh).count() == 0
    assert catalog.mesh_row_offsets(spark, "/root/testdata/sf0.001").count() == catalog.mesh_structure(spark, "/root/testdata/sf0.001").where("row = col").count()
