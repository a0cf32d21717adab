"""Long rows: running sums in pieces, and packed products, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import packed, scans, selection, sparse


@pytest.fixture(scope="module")
def values(spark):
    """One row with more than a third of all values, short rows beside it, the null row, and null values."""
    rng = random.Random(5)
    rows = [7] * 1200 + [None] * 90 + [rng.randrange(300) for _ in range(1500)]
    data = [(r, k, None if k % 11 == 0 else rng.randrange(-5, 50), "x") for k, r in enumerate(rows)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "row long, at long, v long, other string").repartition(6)


def by_row(data):
    out = {}
    for r in sorted(data, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("long_row", [0, 1000, 10_000])
def test_running_sums(values, long_row):
    data, df = values
    got = {r["at"]: (r["inclusive"], r["exclusive"], r["other"]) for r in selection.prefix_sums(df, "row", ["at"], "v", long_row).collect()}
    assert len(got) == len(data)
    for row in by_row(data).values():
        total = None
        for _, at, v, other in row:
            total = total if v is None else v + (total or 0)
            assert got[at] == (total, None if v is None else total - v, other)


@pytest.mark.parametrize("long_row", [0, 10_000])
def test_places_by_descending_order_and_ties(values, long_row):
    data, df = values
    got = {r["at"]: r["place"] for r in scans.places(df, "row", [F.col("v").desc(), "at"], "place", long_row).collect()}
    for row in by_row(data).values():
        ordered = sorted(row, key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        assert [got[r[1]] for r in ordered] == list(range(len(row)))


def test_pieces_of_a_long_row_fill_tasks_evenly(spark):
    """A third of the rows in one key: no task has more than twice the median."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("row"), F.col("id").alias("at"))
    out = scans.places(df, "row", ["at"], "place", long_row=0)
    assert out.where("row = -1").agg(F.max("place")).first()[0] == 19_999
    sizes = sorted(r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_running_sums_of_nothing_and_of_equal_keys(spark):
    none = spark.createDataFrame([], "row long, at long, v long")
    assert scans.places(none, "row", ["at"], "place", 0).collect() == []
    same = spark.range(50).selectExpr("1L as row", "2L as at", "id as v")
    assert sorted(r["place"] for r in scans.places(same, "row", ["at"], "place", 0).collect()) == list(range(50))


def cells_of(rng):
    """A full row, a full column, repeats, and a rest; whole coefficients."""
    cells = [(3, c) for c in range(400)] + [(r, 5) for r in range(300)] + [(rng.randrange(300), rng.randrange(400)) for _ in range(500)]
    return [(r, c, rng.randrange(-9, 10)) for r, c in cells]


@pytest.mark.parametrize(("columns", "most", "height"), [(1 << 16, 1 << 18, 256), (64, 50, 4), (7, 20, 1)])
def test_packed_product(spark, columns, most, height):
    cells = cells_of(random.Random(9))
    df = spark.createDataFrame([*cells, (None, 1, 4), (1, None, 4), (1, 2, None)], "row long, col long, coef long").repartition(3)
    x = {c: c % 13 - 4 for c in range(400) if c % 17}
    vector = spark.createDataFrame([*x.items(), (0, None), (None, 3)], "i long, v long")
    want = {}
    for r, c, v in cells:
        if c in x:
            want[r] = want.get(r, 0) + v * x[c]
    a = packed.pack(df, columns, most, height)
    assert {r["row"]: r["v"] for r in packed.product(a, vector).collect()} == want
    domain = spark.range(310).toDF("row")
    assert {r["row"]: r["v"] for r in packed.product(a.kept(), vector, domain).collect()} == {r: want.get(r, 0) for r in range(310)}
    if most < 100:
        assert a.table.agg(F.max(F.size("rows"))).first()[0] < 300  # the full column lies in several groups
    padded, real = a.table.agg(F.sum(F.size("coefs")), F.sum(F.expr("aggregate(lens, 0, (s, n) -> s + n)"))).first()
    assert real == len({(r, c) for r, c, _ in cells}) and (height > 1 or padded == real)


def test_packed_product_of_doubles_and_of_nothing(spark):
    """Pads make no NaN of infinities, and an empty matrix gives no rows."""
    cells = spark.createDataFrame([(0, 0, 1.5), (0, 1, 2.0), (1, 2, math.inf), (2, 0, 0.5)], "row long, col long, coef double")
    x = spark.createDataFrame([(0, 2.0), (1, math.inf), (2, 1.0)], "i long, v double")
    assert {r["row"]: r["v"] for r in packed.product(packed.pack(cells), x).collect()} == {0: math.inf, 1: math.inf, 2: 1.0}
    assert packed.product(packed.pack(cells.limit(0)), x).collect() == []
    same = sparse.spmv(cells, x).collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, packed.product(packed.pack(cells), x).collect()))


def test_products_of_cells_shuffle_cells(spark):
    import random
    from collections import Counter

    from tessera.operators import dense

    rng = random.Random(6)
    a = [(rng.randrange(40), rng.randrange(30), rng.randrange(-5, 6)) for _ in range(300)] + [(7, j, 1) for j in range(30)] + [(None, 3, 2), (5, None, 4), (2, 3, None)]
    b = [(rng.randrange(30), rng.randrange(20), rng.randrange(-5, 6)) for _ in range(200)] + [(4, k, 2) for k in range(25)] + [(None, 1, 3), (6, None, 5)]
    x, y = spark.createDataFrame(a, "i long, j long, v long"), spark.createDataFrame(b, "j long, k long, v long")
    want = {}
    for i, j, v in a:
        for l, k, w in b:  # noqa: E741
            if j is not None and j == l:
                want.setdefault((i, k), []).extend([] if v is None else [v * w])
    want = {at: sum(vs) if vs else None for at, vs in want.items()}
    got = dense.matmul_cells(x, y, products=200, long_row=10)
    assert Counter(map(tuple, got.collect())) == Counter((*at, v) for at, v in want.items())
    plan = dense.matmul_cells(x.where("i < 7 or i > 7"), y, products=200)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # products are made above the last one
    whole = [(i, j, float(v)) for i, j, v in a if None not in (i, j, v)]
    x = spark.createDataFrame(whole, "i long, j long, v double")
    y = y.where("j is not null and k is not null")
    known = {(i, k) for i, j, _ in whole for l, k, _ in b if j == l and k is not None}  # noqa: E741
    for cost in (1, 10**9):  # cell by cell, and by blocks
        dense.PAIR_COST, before = cost, dense.PAIR_COST
        try:
            blocks = {(r.i, r.k): r.v for r in dense.matmul_blocks(x, y, block=8, side=2).collect()}
        finally:
            dense.PAIR_COST = before
        assert blocks == {at: want[at] for at in known}


def test_packed_products_take_a_group_at_a_time(spark):
    from tessera.operators import packed

    cells = [(i, j, i + j + 1) for i in range(20) for j in range(50) if (i * j) % 3 == 0]
    x = spark.createDataFrame([(j, j - 7) for j in range(45)], "i long, v long")
    table = packed.pack(spark.createDataFrame(cells, "row long, col long, coef long"), columns=8, most=10, height=4)
    out = packed.product(table, x)
    want = {}
    for i, j, c in cells:
        if j < 45:
            want[i] = want.get(i, 0) + c * (j - 7)
    assert dict(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsIn" in plan and "MapInPandas" not in plan  # batches of many rows hold all of a task's groups
