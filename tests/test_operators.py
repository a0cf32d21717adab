"""Properties of the array operators on small domains."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import dense, geometry, reports, scans, selection, sparse, stencils
from tessera.plans import fem
from tessera.sources import csr_text, domain, parameters, results
from tessera.streaming.reductions import running_argmax


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_permutations(spark):
    batch = domain.permutations(spark, 6, 32, seed=4).cache()
    assert all(r[1] == 31 for r in rows(selection.argmax(batch)))
    assert all(r[1] == 9 for r in rows(selection.kth_smallest(batch, 9)))
    assert rows(selection.kth_smallest(batch, 99)) == []
    with pytest.raises(ValueError):
        selection.kth_smallest(batch, -1)


def test_argmax_takes_first_place(spark):
    batch = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 0, 5), (2, 1, 7), (2, 2, 7)], "row_id long, idx long, val long")
    assert rows(selection.argmax(batch)) == [(1, 0, 0), (2, 7, 1)]


def test_radix_passes_sort(spark):
    batch = domain.affine_permutations(spark, 3, 64)
    for shift in range(0, 6, 2):
        batch = selection.radix_pass(batch, shift).select("row_id", F.col("at").alias("idx"), "val")
    assert all(i == v for _, i, v in rows(batch))


def test_stencils(spark):
    square = domain.matrix(spark, 12, 12, lambda i, j: i * i + j * j, ("i", "j", "u"))
    assert {r[2] for r in rows(stencils.laplacian5(square))} == {4}
    nine = rows(stencils.laplacian9(square))
    assert {round(r[2], 9) for r in nine} == {4.0} and len(nine) == 64 and nine[0][:2] == (0, 0)
    scaled = domain.matrix(spark, 12, 12, lambda i, j: (i / 11) ** 2 + (j / 11) ** 2, ("i", "j", "u"))
    assert {round(r[2], 6) for r in rows(stencils.laplacian9(scaled, n=12))} == {4.0}


SHAPES = [(24, 6, 12), (24, 12, 6), (12, 6, 24), (12, 24, 6), (6, 24, 12), (6, 12, 24)]


@pytest.mark.parametrize("ni,nj,nk", SHAPES)
def test_matmul_shapes(spark, ni, nj, nk):
    a = domain.matrix(spark, ni, nj, lambda i, j: 3 * i + 4 * j)
    b = domain.matrix(spark, nj, nk, lambda j, k: 5 * j + 6 * k, ("j", "k", "v"))
    want = [(i, k, sum((3 * i + 4 * j) * (5 * j + 6 * k) for j in range(nj))) for i in range(ni) for k in range(nk)]
    assert rows(dense.matmul_cells(a, b)) == want
    assert rows(dense.matmul_blocks(a, b, block=5)) == want


TEXT = "4 4 4\n0\n2\n3\n3\n4\n0 2.0\n3 1.0\n1 5.0\n0 7.0\n"


def test_sparse_text_and_products(spark, tmp_path):
    (tmp_path / "m.txt").write_text(TEXT)
    coo, offsets = csr_text.parse(csr_text.numbered_lines(spark, str(tmp_path / "m.txt")))
    assert rows(coo) == [(0, 0, 2.0), (0, 3, 1.0), (1, 1, 5.0), (3, 0, 7.0)]
    assert rows(offsets) == [(0, 0), (1, 2), (2, 3), (3, 3), (4, 4)]
    domain4, x = spark.range(4).toDF("row"), domain.vector(spark, 4, v=lambda i: F.lit(1.0))
    want = [(0, 3.0), (1, 5.0), (2, 0.0), (3, 7.0)]
    assert rows(sparse.spmv(coo, x, domain4)) == want
    ell = sparse.to_ell(coo, domain4)
    assert rows(ell) == [(0, 2, [2.0, 1.0], [0, 3]), (1, 1, [5.0, 0.0], [1, 1]), (2, 0, [0.0, 0.0], [0, 0]), (3, 1, [7.0, 0.0], [0, 0])]
    assert rows(sparse.spmv_ell(ell, x)) == want
    own, other = sparse.split_by_owner(coo, 0, 1)
    assert own.count() == 3 and other.count() == 1


def test_scans_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(scans, "ROWS_EACH", 2)
    ids = [0, 1, 2, 5, 9, 10, 11, 12, 13, 30]
    runs = scans.compress_runs(spark.createDataFrame([(i,) for i in ids * 2], "id long"))
    assert rows(runs) == [(0, 0, 3), (5, 3, 1), (9, 4, 5), (30, 9, 1)]
    found = scans.floor_lookup(spark.createDataFrame([(-1,), (2,), (8,), (13,), (40,)], "k long"), runs, "k", "start")
    assert [(r[0], r[1]) for r in rows(found)] == [(2, 0), (8, 5), (13, 9), (40, 30)]


@pytest.mark.parametrize("parts", [1, 2, 3, 7, 16])
def test_bisection_covers(spark, parts):
    boxes = geometry.bisect(geometry.Box([0, 0, 0], [16, 16, 16]), parts)
    points = domain.box_points(geometry.table(spark, boxes))
    assert len(boxes) == parts and points.count() == points.select("x", "y", "z").distinct().count() == 4096
    halo = geometry.halos(geometry.table(spark, boxes), (16, 16, 16))
    ghosts = geometry.ghost_points(geometry.table(spark, boxes), (16, 16, 16))
    assert rows(halo.select("reader", "x", "y", "z")) == rows(ghosts)


def test_scans_of_hashed_ids_and_one_hot_key(spark, monkeypatch):
    """Ids anywhere among 64-bit numbers fall into few ranges; a key with most rows is looked up once."""
    monkeypatch.setattr(scans, "ROWS_EACH", 500)
    ids = spark.range(5000).select(F.xxhash64("id").alias("id"))
    got = rows(scans.exclusive_scan(ids.withColumn("one", F.lit(1).cast("long")), "id", "one", "at").select("id", "at"))
    assert [r[1] for r in got] == list(range(5000))
    assert ids.select(scans.ranges(ids, "id").alias("b")).distinct().count() == 10
    left = ids.select(F.col("id").alias("k")).unionByName(spark.range(20_000).select(F.lit(77).cast("long").alias("k"))).unionByName(spark.createDataFrame([(None,)], "k long"))
    starts = ids.where("id % 3 = 0").select(F.col("id").alias("start"), F.lit("x").alias("what"))
    own = sorted(r[0] for r in starts.collect())
    found = scans.floor_lookup(left, starts, "k", "start").groupBy("k", "start").count().collect()
    import bisect

    want = {k: own[bisect.bisect_right(own, k) - 1] for k in [r[0] for r in got] + [77] if k >= own[0]}
    assert {r["k"]: r["start"] for r in found} == want and {r["k"]: r["count"] for r in found}[77] == 20_000


def test_stencils_leave_out_cells_beside_holes(spark):
    square = domain.matrix(spark, 9, 9, lambda i, j: i * i + j * j, ("i", "j", "u")).where("not (i = 3 and j = 3)")
    for tile in (2, 4, 100):
        got = {r[:2]: r[2] for r in rows(stencils.laplacian5(square, tile=tile))}
        assert set(got.values()) == {4} and len(got) == 49 - 5
        assert not {(3, 3), (2, 3), (4, 3), (3, 2), (3, 4)} & set(got)
        nine = rows(stencils.laplacian9(square, tile=tile))
        assert {round(r[2], 9) for r in nine} == {4.0} and len(nine) == 25 - 7
    moved = square.select((F.col("i") - 5).alias("i"), (F.col("j") - 40).alias("j"), "u")
    assert len(rows(stencils.laplacian5(moved, tile=3))) == 44


def test_stencils_and_kth_plans(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    grid = spark.createDataFrame([(1, 1, 1.0)], "i long, j long, u double")
    assert plan(stencils.laplacian5(grid)).count("Exchange") == 1
    batch = spark.createDataFrame([(1, 1, 1)], "row_id long, idx long, val long")
    assert "WindowGroupLimit" in plan(selection.kth_smallest(batch, 3))


def test_imbalance():
    boxes = geometry.bisect(geometry.Box([0, 0, 0], [16, 16, 16]), 4)
    out = geometry.add_imbalance(boxes, 40)
    assert geometry.imbalance(boxes) == 0 and geometry.imbalance(out) >= 40
    assert sum(b.cells() for b in out) == 4096
    assert geometry.add_imbalance(boxes[:1], 40) == boxes[:1]


def test_imbalance_round_by_round():
    """Two halves along z: the upper counts as largest and grows downwards, the lower is the smallest and shrinks by the same plane."""
    two = [geometry.Box([0, 0, 0], [4, 4, 6]), geometry.Box([0, 0, 6], [4, 4, 12])]
    one = geometry.add_imbalance(two, 1)
    assert [(b.lo[2], b.hi[2]) for b in one] == [(0, 5), (5, 12)]
    assert [(b.lo[2], b.hi[2]) for b in geometry.add_imbalance(two, 30)] == [(0, 4), (4, 12)]
    assert [(b.lo[2], b.hi[2]) for b in geometry.add_imbalance(two, 99)] == [(0, 1), (1, 12)]  # nothing moves any more
    # All boxes on a plane move with it, so four quarters stay a partition.
    four = geometry.bisect(geometry.Box([0, 0, 0], [8, 8, 8]), 4)
    out = geometry.add_imbalance(four, 25)
    assert len({(b.lo[2], b.hi[2]) for b in out}) == 2 and sum(b.cells() for b in out) == 512


def test_box_predicates(spark):
    boxes = geometry.table(spark, [geometry.Box([0, 0, 0], [2, 2, 2]), geometry.Box([2, 0, 0], [4, 2, 2]), geometry.Box([5, 5, 5], [6, 6, 6]), geometry.Box([0, 0, 0], [6, 6, 6])])
    both = boxes.alias("a").join(boxes.alias("b"), F.col("a.part") != F.col("b.part"))
    pairs = lambda f: rows(both.where(f("a", "b")).select("a.part", "b.part"))
    assert pairs(geometry.contains) == [(3, 0), (3, 1), (3, 2)]
    assert (0, 1) in pairs(geometry.neighbouring) and (0, 2) not in pairs(geometry.neighbouring)
    assert (0, 1) in pairs(geometry.disjoint) and (0, 3) not in pairs(geometry.disjoint)


def test_ghost_points_are_those_of_the_grown_box(spark):
    boxes = geometry.table(spark, geometry.bisect(geometry.Box([0, 0, 0], [9, 8, 7]), 5))
    for by in (1, 2):
        inside = domain.box_points(boxes)
        want = domain.box_points(geometry.grown(boxes, by, (9, 8, 7))).join(inside, ["part", "x", "y", "z"], "left_anti")
        assert rows(geometry.ghost_points(boxes, (9, 8, 7), by)) == rows(want.select("part", "x", "y", "z"))


def test_gauss_rules(spark):
    for n in (1, 2, 3):
        assert abs(sum(w for _, w in fem.gauss_points(n)) - 8) < 1e-6
        assert all(abs(r[1] - 1) < 1e-9 for r in rows(fem.shape_values(spark, n).groupBy("gp").agg(F.sum("v"))))
        assert all(abs(r[1] - fem.source_term((0.5, 0.25, 0.5))) < 1e-8 for r in rows(fem.element_source(spark, (0.5, 0.25, 0.5), n=n)))
    two, three = rows(fem.element_matrix(spark, (0.5, 0.5, 0.5))), rows(fem.element_matrix(spark, (0.5, 0.5, 0.5), n=3))
    assert all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(two, three, strict=True))


def test_verification(spark):
    mesh = fem.Mesh(6, 6, 6)
    a, b = fem.dirichlet(*fem.assemble(spark, mesh, q=0.0), mesh)
    found = fem.conjugate_gradients(a, b, tolerance=1e-10)
    whole = fem.verify(found.x, mesh, whole=True).first()
    centre = fem.verify(found.x, mesh).first()
    assert whole.checked == 343 and centre.checked == 1 and centre.max_row == 171 and centre.passed
    assert centre.max_error <= whole.max_error and whole.passed == (whole.max_error <= 0.06)
    assert all(r[1] < 1e-12 for r in rows(fem.errors(found.x, mesh, whole=True)) if r[0] % 7 in (0, 6))
    middle = spark.range(1).select(fem.series(F.lit(0.5), F.lit(0.5), F.lit(0.5), terms=20), fem.series(F.lit(0.5), F.lit(0.5), F.lit(0.5))).first()
    assert abs(middle[0] - 1 / 6) < 1e-6 and abs(middle[1] - 1 / 6) < 1e-9  # by symmetry each face gives a sixth
    running = fem.errors(found.x, mesh, coords="running", whole=True)
    assert running.count() == 343 and running.where("error is null").count() == 0
    assert fem.errors(found.x, mesh, coords="running").count() < 343


def test_products_are_a_parameter_of_the_solver(spark):
    mesh = fem.Mesh(3, 2, 2)
    a, b = fem.dirichlet(*fem.assemble(spark, mesh), mesh)
    one, two = fem.conjugate_gradients(a, b), fem.conjugate_gradients(fem.by_slices(a, b.select("row"), height=5), b)
    assert one.iterations == two.iterations and all(abs(x[1] - y[1]) < 1e-12 for x, y in zip(rows(one.x), rows(two.x), strict=True))
    minus = a.withColumn("coef", -F.col("coef"))
    with pytest.raises(ArithmeticError):
        fem.conjugate_gradients(minus.where("row = col"), b.withColumn("v", F.col("row") * 0.0 + 1), iterations=2)


def test_sparse_helpers(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (2, 2, 4.0)], "row long, col long, coef double")
    parts = spark.createDataFrame([(0, 1, 5.0), (0, 1, 1.0), (1, 1, 9.0), (2, 2, -4.0)], "row long, col long, coef double")
    assert rows(sparse.accumulate(cells, parts)) == [(0, 0, 1.0), (0, 1, 8.0), (1, 0, 3.0), (2, 2, 0.0)]
    assert rows(sparse.add_to_diagonal(cells, 10.0)) == [(0, 0, 11.0), (0, 1, 2.0), (1, 0, 3.0), (2, 2, 14.0)]
    y = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)], "i long, v double")
    assert rows(sparse.spmv_axpby(cells, y, y, 2.0, 10.0)) == [(0, 16.0), (1, 16.0), (2, 18.0), (3, 10.0)]
    owners = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "row long, part long")
    outside = sparse.externals(cells, owners)
    assert rows(outside) == [(0, 1, 1), (1, 0, 0)]
    assert rows(sparse.neighbours(outside.where("reader = 0"))) == [(0, 1), (1, 0)]
    got = sparse.part_stats(cells, owners).first()
    assert (got.rows_min, got.rows_max, got.nnz_min, got.nnz_max, got.rows_avg) == (1, 2, 2, 2, 1.5) and abs(got.halo_mb - (3 * 2 + 3 * 2) * 4 / 2**20) < 1e-12
    numbered = sparse.local_numbers(spark.createDataFrame([(0, 2, 9), (0, 1, 30), (0, 1, 4), (0, 2, 9), (1, 0, 5)], "reader long, owner long, id long"))
    assert rows(numbered) == [(0, 1, 4, 0), (0, 1, 30, 1), (0, 2, 9, 2), (1, 0, 5, 0)]


def test_blocks_of_sparse_factors(spark):
    """Only places where a pair of cells meets are there, as in the product by cells; a product may be 0."""
    a = spark.createDataFrame([(0, 0, 2.0), (0, 7, 1.0), (9, 3, 4.0), (5, 5, 0.0)], "i long, j long, v double")
    b = spark.createDataFrame([(0, 2, 3.0), (7, 2, -6.0), (3, 11, 1.0), (5, 1, 8.0), (6, 6, 1.0)], "j long, k long, v double")
    assert rows(dense.matmul_blocks(a, b, block=4)) == rows(dense.matmul_cells(a, b)) == [(0, 2, 0.0), (5, 1, 0.0), (9, 11, 4.0)]
    x = spark.createDataFrame([([1.0, 2.0],), ([3.0, -1.0],), (None,)], "a array<float>")
    assert rows(dense.gram(x, "a", "a")) == [(0, 0, 10.0), (0, 1, -1.0), (1, 0, -1.0), (1, 1, 5.0)]
    assert rows(dense.gram(x.where("a is null"), "a", "a")) == []


def test_system_of_two_cells(spark):
    mesh = fem.Mesh(2, 2, 2)
    a, b = fem.assemble(spark, mesh)
    assert a.count() == 343 and b.count() == 27
    assert all(abs(r[1]) < 1e-9 for r in rows(a.groupBy("row").agg(F.sum("coef"))))
    a, b = fem.dirichlet(a, b, mesh)
    assert abs(b.agg(F.sum("v")).first()[0] - 9.125) < 1e-8
    found = fem.conjugate_gradients(a, b)
    assert abs(found.first_residual - 3.0026030373615) < 1e-9 and found.iterations in (2, 3, 4)
    assert abs(found.x.where("i = 13").first()[1] - 0.0937499999487) < 1e-9


def test_algebra(spark):
    m = [[2, 0, 1], [1, 3, 2], [1, 1, 4]]
    cols = [[F.lit(float(v)) for v in r] for r in m]
    inverse, det = scalar.inverse3(cols)
    unit = scalar.matmul3(cols, inverse)
    got = spark.range(1).select(det, *[c for r in unit for c in r]).first()
    assert abs(got[0] - 18) < 1e-12 and [round(x, 9) + 0.0 for x in got[1:]] == [1, 0, 0, 0, 1, 0, 0, 0, 1]


def test_places_and_rates(spark):
    one = spark.range(1)
    ids = one.select(*[scalar.point_id(*[F.lit(v) for v in p], 4, 3, 2) for p in ((1, 2, 1), (0, 0, 0), (4, 0, 0), (0, -1, 0), (0, 0, 2))]).first()
    assert list(ids) == [21, 0, -1, -1, -1]
    assert list(one.select(*scalar.lattice_coords(F.lit(1), F.lit(2), F.lit(3), 2, 4, 3)).first()) == [0.5, 0.5, 1.0]
    assert list(one.select(*scalar.running_coords(F.lit(10), 2, 2, 2)).first()) == [0.5, (10 % 9) / 3 / 2, 10 / 9 / 2]
    assert scalar.transpose3([[1, 2, 3], [4, 5, 6], [7, 8, 9]]) == [[1, 4, 7], [2, 5, 8], [3, 6, 9]]
    got = one.select(scalar.gigabytes_per_second(F.lit(1 << 27), 8, F.lit(2.0)), scalar.gflops(F.lit(1 << 31), F.lit(2.0)), scalar.mflops(F.lit(3e6), F.lit(2.0)), scalar.mflops(F.lit(3e6), F.lit(1e-5)), scalar.percent_off(F.lit(3.0), F.lit(2.0)), scalar.percent_off(F.lit(3.0), F.lit(0.0))).first()
    assert list(got) == [0.5, 1.0, "1.5", "inf", 50.0, -1.0]


def test_results_from_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("threads,processes,nodes,n,used,gflops,setup,wait,copy,dgemm\n4,1,1,64,own,2.5,0.1,0.2,0.3,0.4\n4,2,1,64,own,,1,1,1,1\n")
    got = results.read_results(spark, str(tmp_path / "r.csv"), results.MATMUL).orderBy("processes").collect()
    assert [(r.threads, r.used, r.gflops) for r in got] == [(4, "own", 2.5), (4, "own", None)]


def test_long_text_is_numbered(spark, tmp_path):
    (tmp_path / "long.txt").write_text("\n".join(f"line {i}" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = csr_text.numbered_lines(spark, str(tmp_path / "long.txt"))
        assert lines.count() == 20_000 and lines.where("line <> concat('line ', n)").count() == 0
        assert "Python" not in lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_run_report(tmp_path):
    p = parameters.parse("nx=3 load_imbalance=5 mv_overlap_comm_comp=1")
    tree = reports.run_report(p, {"Global Nrows": 64}, fem.Solution(None, 7, 1e-9, 2.0), {"assembly": 1.5, "solve": 2.5}, 4, "2026-01-02")
    reports.write_report(tree, str(tmp_path / "run"))
    lines = (tmp_path / "run").read_text().split("\n")
    assert lines[:5] == ["Global Run Parameters:", "  dimensions:", "    nx: 3", "    ny: 3", "    nz: 3"] and "  mv_overlap_comm_comp: 1 (yes)" in lines
    assert "  Global Nrows: 64" in lines and "  Iterations: 7" in lines and "Total Program Time: 4.0" in lines and lines[-1] == ""


def test_parameters(tmp_path):
    assert (parameters.parse("nx=4").nx, parameters.parse("nx=4").nz) == (4, 4)
    p = parameters.parse("--nx 4 ny:5 load_imbalance=2.5 name=a")
    assert (p.nx, p.ny, p.nz, p.load_imbalance, p.name) == (4, 5, 5, 2.5, "a")
    (tmp_path / "p").write_text("nx=7")
    assert parameters.parse(f"input_file={tmp_path / 'p'}").nx == 7


def test_writers(spark, tmp_path):
    written = lambda name: [line for part in sorted((tmp_path / name).glob("part-*")) for line in part.read_text().splitlines()]
    v = domain.vector(spark, 500, v=lambda i: i * 2.5).repartition(7)
    more = v.unionByName(spark.createDataFrame([(700, None), (None, 1.0)], "i long, v double"))
    assert reports.write_vector(more, str(tmp_path / "v")) == 500
    assert written("v") == ["500", *[f"{i} {2.5 * i}" for i in range(500)]]
    assert rows(reports.read_vector(spark, str(tmp_path / "v"))) == rows(v)
    assert reports.write_vector(v.limit(0), str(tmp_path / "none")) == 0 and written("none") == ["0"]
    cells = spark.createDataFrame([(1, 0, 2.5), (0, 1, 1.0), (0, 0, 3.0), (0, None, 3.0)], "row long, col long, coef double")
    assert reports.write_matrix(cells, str(tmp_path / "m")) == (2, 3)
    assert written("m") == ["2 3", "0 0 3.0", "0 1 1.0", "1 0 2.5"]
    assert rows(reports.read_matrix(spark, str(tmp_path / "m"))) == rows(cells.dropna())
    assert reports.report_lines({"a": {"b": 1}, "c": 2}) == ["a:", "  b: 1", "c: 2"]


def test_stream(spark, tmp_path):
    domain.affine_permutations(spark, 3, 16).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, idx long, val long").parquet(str(tmp_path / "in"))
    q = running_argmax(stream, "row_id", "idx", "val").writeStream.outputMode("complete").format("memory").queryName("tops").start()
    q.processAllAvailable()
    q.stop()
    assert [r[1] for r in rows(spark.table("tops"))] == [15, 15, 15]


def test_long_rows_are_cut_into_slices(spark):
    cells = spark.range(5000).selectExpr("0L as row", "id as col", "1.0D as coef").unionByName(spark.range(1, 20).selectExpr("id as row", "id as col", "2.0D as coef"))
    domain = spark.range(21).selectExpr("id as row")
    ell = sparse.to_sliced_ell(cells, domain, width=50)
    got = ell.selectExpr("count(*) as n", "max(size(coefs)) as widest", "sum(len) as len", "count(distinct row) as n_rows").first()
    assert got.n_rows == 21 and got.len == 5019 and got.widest < 150 and got.n == 120
    v = {r.row: r.v for r in sparse.spmv_ell(ell, spark.range(5000).selectExpr("id as i", "1.0D as v")).collect()}
    assert v == {0: 5000.0, **{k: 2.0 for k in range(1, 20)}, 20: 0.0}
