"""A finite-element heat problem on a box of cells: structure, assembly, fixed values, conjugate gradients, check.

Rows are node ids throughout. The mesh is uniform, so the element matrix is made once (64 numbers)
and joined as a constant; everything that grows with the mesh stays distributed, and the solver
brings two sums an iteration to the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import inverse3, running_coords
from tessera.materialize import materialize, settled
from tessera.operators import packed
from tessera.operators.halo import Layout, unpacked, with_product
from tessera.operators.sparse import spmv
from tessera.sources.domain import mesh_elements, mesh_nodes

# The cell's corners in order, and the Gauss rules of one to three points, (place, weight), truncated as stated here.
CORNERS = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
GAUSS = {
    1: ((0.0, 2.0),),
    2: ((-0.577350269, 1.0), (0.577350269, 1.0)),
    3: ((-0.77459667, 0.55555556), (0.0, 0.88888889), (0.77459667, 0.55555556)),
}
EPSILON = 2.220446049250313e-16
#: Cells to a range of node ids, cells that a task deals at a time, and rows that are kept as one value.
RANGE_CELLS, HELD, PACKED = 250_000, 1_000_000, 500_000


@dataclass(frozen=True)
class Mesh:
    nx: int
    ny: int
    nz: int

    def step(self) -> tuple[float, float, float]:
        return 1 / self.nx, 1 / self.ny, 1 / self.nz

    def node_id(self, x: Column, y: Column, z: Column) -> Column:
        return x + (self.nx + 1) * y + (self.nx + 1) * (self.ny + 1) * z


def structure(spark: SparkSession, mesh: Mesh) -> DataFrame:
    """(row, col): each node and its neighbours of 27 offsets within the mesh."""
    shift = F.sequence(F.lit(-1), F.lit(1))
    near = mesh_nodes(spark, mesh.nx, mesh.ny, mesh.nz)
    for axis in "xyz":
        near = near.withColumn(f"d{axis}", F.explode(shift)).where((F.col(f"i{axis}") + F.col(f"d{axis}")).between(0, getattr(mesh, f"n{axis}")))
    return near.select(F.col("id").alias("row"), mesh.node_id(*[F.col(f"i{a}") + F.col(f"d{a}") for a in "xyz"]).alias("col"))


def _around(cells: DataFrame, mesh: Mesh, make: Callable[[tuple, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """What ``make`` gives of the nodes that a cell has, a range of ids at a time: the range, their ids in order, and the cells around each as bits.

    Bit x + 2 y + 4 z is the cell of which the node is the corner that lies x, y and z from its lower one. Ids are dealt into ranges by the
    quantiles of lower corners; a cell goes, as bytes among many, to the ranges of its four edges along x, and nothing else is shuffled."""
    row, plane = mesh.nx + 1, (mesh.nx + 1) * (mesh.ny + 1)
    there = cells.where("ex is not null and ey is not null and ez is not null").select((F.col("ex") + row * F.col("ey") + plane * F.col("ez")).cast("long").alias("at"))
    parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(there.count() / RANGE_CELLS))
    cuts = np.unique(np.array(there.agg(F.percentile_approx("at", [k / parts for k in range(1, parts)], max(10_000, 10 * parts))).first()[0] or [] if parts > 1 else [], dtype=np.int64))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(range, edges): lower ends of edges times four, plus the edge of the cell that they are."""

        def dealt(at: np.ndarray) -> pd.DataFrame:
            edges = np.sort(np.concatenate([(at + y * row + z * plane) * 4 + y + 2 * z for z in (0, 1) for y in (0, 1)]))
            own, next_ = np.searchsorted(cuts, edges >> 2, "left"), np.searchsorted(cuts, (edges >> 2) + 1, "left")
            out = []
            for ranges, each in ((own, edges), (next_[own != next_], edges[own != next_])):
                starts = np.flatnonzero(np.diff(ranges, prepend=-1))
                out += [(int(ranges[lo]), part.tobytes()) for lo, part in zip(starts, np.split(each, starts[1:]), strict=True)] if len(each) else []
            return pd.DataFrame(out, columns=["range", "edges"])

        held, n = [], 0
        for pdf in batches:
            held.append(pdf["at"].unique())
            n += len(held[-1])
            if n >= HELD:
                held = [np.unique(np.concatenate(held))]
                if len(held[0]) >= HELD // 2:
                    yield dealt(held.pop())
                n = sum(map(len, held))
        if n:
            yield dealt(np.unique(np.concatenate(held)))

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        edges = np.unique(np.concatenate([np.frombuffer(e, dtype=np.int64) for e in pdf["edges"]]))
        ends = np.sort(np.concatenate([(edges >> 2) + x << 3 | (edges & 3) << 1 | x for x in (0, 1)]))
        ends = ends[np.searchsorted(cuts, ends >> 3, "left") == key[0]]
        first = np.flatnonzero(np.diff(ends >> 3, prepend=-1))
        return make(key, ends[first] >> 3, np.bitwise_or.reduceat(1 << (ends & 7), first) if len(first) else first)

    return there.mapInPandas(deal, "range long, edges binary").groupBy("range").applyInPandas(gather, schema)


def _beside(mesh: Mesh) -> dict[int, int]:
    """How far each possible neighbour's id is from a node's, and the cells that have both, as bits around the node."""
    out = {}
    for d in itertools.product((-1, 0, 1), repeat=3):
        corners = [c for c in itertools.product((0, 1), repeat=3) if all(by == 0 or c[k] == (by < 0) for k, by in enumerate(d))]
        out[int(d[0] + (mesh.nx + 1) * (d[1] + (mesh.ny + 1) * d[2]))] = sum(1 << (x + 2 * y + 4 * z) for x, y, z in corners)
    return out


def structure_of(cells: DataFrame, mesh: Mesh) -> DataFrame:
    """(row, col) of a mesh of which only some cells (ex, ey, ez) are there: the corners that share a cell, each pair once.

    Cells without a place are left out; repeated ones count once. Pairs are made of what nodes know of the cells around
    them, and aren't shuffled."""
    nodes = _around(cells, mesh, lambda key, ids, masks: pd.DataFrame({"row": ids, "m": masks}), "row long, m int")
    cols = F.array(*[F.when(F.col("m").bitwiseAND(F.lit(bits)) != 0, F.col("row") + by) for by, bits in sorted(_beside(mesh).items())])
    return nodes.select("row", F.explode(cols).alias("col")).where("col is not null")


def _lengths(mesh: Mesh) -> np.ndarray:
    """How many neighbours a node has, itself included, by the cells around it."""
    return sum((np.arange(256) & bits != 0).astype(np.int64) for bits in _beside(mesh).values())


def row_lengths(cells: DataFrame, mesh: Mesh) -> DataFrame:
    """(row, n): how many columns each row of ``structure_of`` has, without making them."""
    lengths = _lengths(mesh)
    return _around(cells, mesh, lambda key, ids, masks: pd.DataFrame({"row": ids, "n": lengths[masks]}), "row long, n long")


def offsets_of(cells: DataFrame, mesh: Mesh) -> DataFrame:
    """(row, start) as ``row_offsets`` of ``row_lengths``. Ranges of rows are in order as they are made, so a range's rows are kept as bytes and its
    sum is added up; what each takes over from those before it comes from a table of a row a range."""
    lengths = _lengths(mesh)

    def pack(key: tuple, ids: np.ndarray, masks: np.ndarray) -> pd.DataFrame:
        out = []
        for k in range(0, len(ids), PACKED):
            own, n = ids[k : k + PACKED], lengths[masks[k : k + PACKED]]
            steps = np.diff(own)
            small = not len(steps) or int(steps.max()) < 1 << 32
            out.append((key[0], k, int(own[0]), int(n.sum()), steps.astype(np.uint32 if small else np.int64).tobytes(), n.astype(np.uint8).tobytes()))
        return pd.DataFrame(out, columns=["range", "k", "first", "total", "steps", "n"])

    packed_rows = materialize(_around(cells, mesh, pack, "range long, k long, first long, total long, steps binary, n binary"))
    before = Window.orderBy("range", "k").rowsBetween(Window.unboundedPreceding, -1)
    carried = packed_rows.select("range", "k", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("start"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, start, steps, n in zip(*(batch.column(c).to_pylist() for c in ("first", "start", "steps", "n")), strict=True):
                n = np.frombuffer(n, dtype=np.uint8).astype(np.int64)
                steps = np.frombuffer(steps, dtype=np.uint32 if len(steps) == 4 * (len(n) - 1) else np.int64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(first + np.cumsum(np.append(0, steps))), pa.array(start + np.cumsum(n) - n)], names=["row", "start"])

    # A row a range, or a piece of one.
    return packed_rows.join(F.broadcast(carried), ["range", "k"]).select("first", "start", "steps", "n").mapInArrow(unpack, "row long, start long")


def row_offsets(pattern: DataFrame) -> DataFrame:
    """(row, start): where each row starts if cells are laid out by row. ``pattern`` has a row for each cell, or (row, n)."""
    from tessera.operators.scans import exclusive_scan

    counts = pattern if "n" in pattern.columns else pattern.groupBy("row").agg(F.count("*").alias("n"))
    return exclusive_scan(counts, "row", "n", "start").select("row", "start")


def gauss_points(n: int) -> list[tuple[tuple[float, float, float], float]]:
    """Places and weights of the n x n x n points in the cube from -1 to 1."""
    return [((x, y, z), u * v * w) for x, u in GAUSS[n] for y, v in GAUSS[n] for z, w in GAUSS[n]]


def shape_values(spark: SparkSession, n: int = 2) -> DataFrame:
    """(gp, a, v): the eight trilinear shape functions at the Gauss points."""
    rows = []
    for gp, (at, _) in enumerate(gauss_points(n)):
        for a, corner in enumerate(CORNERS):
            rows.append((gp, a, math.prod(1 + (2 * c - 1) * x for c, x in zip(corner, at, strict=True)) / 8))
    return spark.createDataFrame(rows, "gp int, a int, v double")


def shape_gradients(spark: SparkSession, n: int = 2) -> DataFrame:
    """(gp, weight, a, g0, g1, g2): gradients of the eight trilinear shape functions at the Gauss points."""
    rows = []
    for gp, (at, weight) in enumerate(gauss_points(n)):
        for a, corner in enumerate(CORNERS):
            s = [2 * c - 1 for c in corner]
            one = [1 + s[d] * at[d] for d in range(3)]
            rows.append((gp, weight, a, *[0.125 * s[d] * one[(d + 1) % 3] * one[(d + 2) % 3] for d in range(3)]))
    return spark.createDataFrame(rows, "gp int, weight double, a int, g0 double, g1 double, g2 double")


def element_matrix(spark: SparkSession, step: tuple[float, float, float], n: int = 2) -> DataFrame:
    """(a, b, k): the diffusion matrix of a cell of these edges, summed over its Gauss points."""
    grads = shape_gradients(spark, n)
    coords = spark.createDataFrame([(a, *[float(c[d] * step[d]) for d in range(3)]) for a, c in enumerate(CORNERS)], "a int, c0 double, c1 double, c2 double")
    at = grads.join(F.broadcast(coords), "a")  # eight rows
    jacobian = at.groupBy("gp").agg(*[F.sum(F.col(f"g{r}") * F.col(f"c{c}")).alias(f"j{r}{c}") for r in range(3) for c in range(3)])
    inverse, det = inverse3([[F.col(f"j{r}{c}") for c in range(3)] for r in range(3)])
    moved = grads.join(jacobian, "gp").select("gp", "a", (det * F.col("weight")).alias("det"), *[sum((inverse[r][c] * F.col(f"g{c}") for c in range(1, 3)), inverse[r][0] * F.col("g0")).alias(f"d{r}") for r in range(3)])
    x, y = moved.alias("x"), moved.alias("y")
    inner = sum((F.col(f"x.d{r}") * F.col(f"y.d{r}") for r in range(1, 3)), F.col("x.d0") * F.col("y.d0"))
    return x.join(y, "gp").groupBy(F.col("x.a").alias("a"), F.col("y.a").alias("b")).agg(F.sum(inner * F.col("x.det")).alias("k"))


def shape_at(a: int, x: Column, y: Column, z: Column) -> Column:
    """The shape function of corner ``a`` at a place in the cube from -1 to 1."""
    one = [1 + (2 * c - 1) * at for c, at in zip(CORNERS[a], (x, y, z), strict=True)]
    return one[0] * one[1] * one[2] / 8


def _spread(cells: DataFrame) -> DataFrame:
    """Rows dealt evenly before each becomes many: a small file, read by one task, would be worked on by one alone."""
    return cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _by_corner(cells: DataFrame, values: list[Column]) -> DataFrame:
    """``cells`` with a row for each corner: (a, v)."""
    return _spread(cells).select("*", F.posexplode(F.array(*values)).alias("a", "v"))


def shapes_at(points: DataFrame) -> DataFrame:
    """``points`` (x, y, z within a cell, from -1 to 1) with (a, v): the eight shape functions at each."""
    return _by_corner(points, [shape_at(a, F.col("x"), F.col("y"), F.col("z")) for a in range(8)])


def brick_matrices(cells: DataFrame, n: int = 2) -> DataFrame:
    """``cells`` (with edges hx, hy, hz) with (a, b, k): the diffusion matrix of each, by what Gauss points give for each axis.

    A brick's Jacobian has the half edges on its diagonal, so that only three sums over the points are needed, the
    same for all cells; only cells themselves are shuffled. Null edges give null values."""
    sums = [[[0.0] * 3 for _ in range(8)] for _ in range(8)]
    for at, weight in gauss_points(n):
        grads = []
        for corner in CORNERS:
            s = [2 * c - 1 for c in corner]
            one = [1 + s[d] * at[d] for d in range(3)]
            grads.append([0.125 * s[d] * one[(d + 1) % 3] * one[(d + 2) % 3] for d in range(3)])
        for a in range(8):
            for b in range(8):
                for d in range(3):
                    sums[a][b][d] += weight * grads[a][d] * grads[b][d]
    table = F.lit([sums[a][b] for a in range(8) for b in range(8)])
    h = [F.col(f"h{axis}") for axis in "xyz"]
    each = _spread(cells).select("*", F.posexplode(table).alias("_p", "_s"))
    k = sum((F.get("_s", F.lit(d)) * h[(d + 1) % 3] * h[(d + 2) % 3] / (2 * h[d]) for d in range(1, 3)), F.get("_s", F.lit(0)) * h[1] * h[2] / (2 * h[0]))
    return each.select(*cells.columns, F.floor(F.col("_p") / 8).cast("int").alias("a"), (F.col("_p") % 8).cast("int").alias("b"), k.alias("k"))


def brick_sources(cells: DataFrame, n: int = 2) -> DataFrame:
    """``cells`` (with edges hx, hy, hz and a source q) with (a, v): each corner's share of the source."""
    shares = [sum(w * math.prod(1 + (2 * c - 1) * x for c, x in zip(corner, at, strict=True)) / 8 for at, w in gauss_points(n)) / 8 for corner in CORNERS]
    return _by_corner(cells, [F.col("q") * F.col("hx") * F.col("hy") * F.col("hz") * F.lit(share) for share in shares])


def element_source(spark: SparkSession, step: tuple[float, float, float], q: float = 1.0, n: int = 2) -> DataFrame:
    """(a, v): the corners' shares of a source over a cell, from the shape functions at its Gauss points."""
    volume = step[0] * step[1] * step[2] / 8
    weights = spark.createDataFrame([(gp, w) for gp, (_, w) in enumerate(gauss_points(n))], "gp int, weight double")
    return shape_values(spark, n).join(F.broadcast(weights), "gp").groupBy("a").agg((F.sum(F.col("v") * F.col("weight")) * (q * volume)).alias("v"))


def source_term(step: tuple[float, float, float], q: float = 1.0) -> float:
    """Each corner's share of a unit source over a cell."""
    return q * step[0] * step[1] * step[2] / 8


def assemble(spark: SparkSession, mesh: Mesh, q: float = 1.0, medium: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(A, b): (row, col, coef) and (row, v). Each cell is evaluated once; equal places are summed.

    ``medium`` (ex, ey, ez, k, f) gives cells a conductivity and a source, in units; cells that it lacks have 1 of each."""
    k = {(r["a"], r["b"]): r["k"] for r in element_matrix(spark, mesh.step()).collect()}  # 64 numbers
    corner = lambda c: mesh.node_id(F.col("ex") + c[0], F.col("ey") + c[1], F.col("ez") + c[2])
    cells = mesh_elements(spark, mesh.nx, mesh.ny, mesh.nz)
    own = [F.lit(1.0).alias("mk"), F.lit(1.0).alias("mf")]
    if medium is not None:
        cells = cells.join(medium, ["ex", "ey", "ez"], "left")
        own = [F.coalesce("k", F.lit(1.0)).alias("mk"), F.coalesce("f", F.lit(1.0)).alias("mf")]
    cells = cells.select(F.array(*[corner(c) for c in CORNERS]).alias("n"), *own)
    table = F.lit([[float(k[a, b]) for b in range(8)] for a in range(8)])
    rows = cells.select("n", "mk", "mf", F.posexplode("n").alias("a", "row"), table.alias("k"))
    own = rows.withColumn("coefs", F.get("k", F.col("a")))
    parts = own.select("row", "mk", F.explode(F.arrays_zip("n", "coefs")).alias("c"))
    a = parts.groupBy("row", F.col("c.n").alias("col")).agg(F.sum(F.col("c.coefs") * F.col("mk")).alias("coef"))
    b = rows.groupBy("row").agg((F.sum("mf") * F.lit(source_term(mesh.step(), q))).alias("v"))
    return a, b


def _plane(node: Column, mesh: Mesh) -> tuple[Column, Column, Column]:
    a, plane = mesh.nx + 1, (mesh.nx + 1) * (mesh.ny + 1)
    return node % a, F.floor((node % plane) / a), F.floor(node / plane)


def zero_faces(node: Column, mesh: Mesh) -> Column:
    """On x = 0 or on a face across y or z."""
    x, y, z = _plane(node, mesh)
    return (x == 0) | y.isin(0, mesh.ny) | z.isin(0, mesh.nz)


def one_face(node: Column, mesh: Mesh) -> Column:
    return _plane(node, mesh)[0] == mesh.nx


def fix(a: DataFrame, b: DataFrame, on: callable, value: float) -> tuple[DataFrame, DataFrame]:
    """The system with rows for which ``on`` holds fixed at ``value``: their rows become identity, their
    columns move to the right-hand side. Cells stay in place, with 0."""
    row, col = on(F.col("row")), on(F.col("col"))
    moved = a.where(col & ~row).groupBy("row").agg(F.sum("coef").alias("m"))
    b2 = b.join(moved, "row", "left").select("row", F.when(row, value).otherwise(F.col("v") - value * F.coalesce("m", F.lit(0.0))).alias("v"))
    a2 = a.withColumn("coef", F.when(row, (F.col("row") == F.col("col")).cast("double")).when(col, 0.0).otherwise(F.col("coef")))
    return a2, b2


def dirichlet(a: DataFrame, b: DataFrame, mesh: Mesh) -> tuple[DataFrame, DataFrame]:
    """First the faces at 0, then the face at 1: nodes on both end at 1, but their columns went with 0."""
    a, b = fix(a, b, lambda n: zero_faces(n, mesh), 0.0)
    return fix(a, b, lambda n: one_face(n, mesh), 1.0)


@dataclass
class Solution:
    """``breakdown``: the last direction and its product were as good as orthogonal, so that no step was left to take;
    then the residual says how far the solution is."""

    x: DataFrame
    iterations: int
    residual: float
    first_residual: float
    converged: bool = False
    breakdown: bool = False


#: A x for x (i, v), as (row, v).
Matvec = Callable[[DataFrame], DataFrame]


def by_cells(a: DataFrame) -> Matvec:
    """Products with cells (row, col, coef), which are laid out by column once."""
    laid = materialize(a.repartition("col"))
    return lambda x: spmv(laid, x)


def by_slices(a: DataFrame, rows: DataFrame, height: int = packed.HEIGHT) -> Matvec:
    """Products with padded slices of rows, which are packed once."""
    laid = packed.pack(a, height=height).kept()
    return lambda x: packed.product(laid, x, rows)


def conjugate_gradients(a: DataFrame | Matvec | Layout, b: DataFrame, iterations: int = 200, tolerance: float = EPSILON) -> Solution:
    """(i, v) of A x = b (row, v) from x = 0, at most ``iterations`` steps, until the residual is at the tolerance.

    ``a`` is a table of cells, any product with one, or cells that are laid out by owner: then the vectors are
    too, as arrays; a step moves what parts need of one another, and each part's arrays once. A step multiplies, cuts the lineage and takes two sums."""
    if isinstance(a, Layout):
        with settled(b.sparkSession):
            dealt = a.spread(b, "row")
            zero = F.array_repeat(F.lit(0.0), F.size("ids"))
            start = materialize(dealt.select("part", "ids", zero.alias("x"), F.col("v").alias("r"), zero.alias("p")))
            return _steps(lambda p: a.placed(a.times(p, "p", "ap")), start, iterations, tolerance, _add_arrays, _dot_arrays, lambda state: unpacked(state, "x").select("i", "v"))
    start = b.select(F.col("row").alias("i"), F.lit(0.0).alias("x"), F.col("v").cast("double").alias("r"), F.lit(0.0).alias("p"))
    product = by_cells(a) if isinstance(a, DataFrame) else a
    times = lambda p: with_product(p, product(p.select("i", F.col("p").alias("v"))).select(F.col("row").alias("i"), "v"), ["i"], "ap")
    return _steps(times, start, iterations, tolerance, _add, _dot, lambda state: state.select("i", F.col("x").alias("v")))


def _add(a: str, s: float, b: str) -> Column:
    return F.col(a) + s * F.col(b)


def _dot(a: str, b: str) -> Column:
    return F.sum(F.col(a) * F.col(b))


def _add_arrays(a: str, s: float, b: str) -> Column:
    return F.zip_with(a, b, lambda u, v: u + s * v)


def _dot_arrays(a: str, b: str) -> Column:
    """Entries that are null count for nothing, as in a sum of rows."""
    return F.sum(F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda done, t: done + F.coalesce(t, F.lit(0.0))))


def _steps(times: Matvec, state: DataFrame, iterations: int, tolerance: float, add: Callable, dot: Callable, solution: Callable) -> Solution:
    """Steps from a state with columns x, r and p, of numbers or of arrays of them; ``times`` puts the product of p beside it, as ap."""
    rtr = state.agg(dot("r", "r")).first()[0] or 0.0
    residual = first = math.sqrt(rtr)
    beta, done, breakdown = 0.0, 0, False
    while done < iterations and residual > tolerance:
        step = materialize(times(state.withColumn("p", add("r", beta, "p"))))
        pap, pp, apap = step.agg(dot("p", "ap"), dot("p", "p"), dot("ap", "ap")).first()
        if pap is None:
            raise ValueError("the matrix has none of the rows of the right-hand side")
        if pap < 0:
            raise ArithmeticError("the matrix isn't positive definite")
        if pap <= 100 * math.sqrt(pp * apap) * EPSILON:
            breakdown = True
            break
        alpha = rtr / pap
        state = step.withColumns({"x": add("x", alpha, "p"), "r": add("r", -alpha, "ap")}).drop("ap")
        done += 1
        before, rtr = rtr, state.agg(dot("r", "r")).first()[0]
        beta, residual = rtr / before, math.sqrt(rtr)
    return Solution(solution(state), done, residual, first, residual <= tolerance, breakdown)


#: From here on sinh(pi (2p + 1)) is no finite number, so that a term is none or 0.
LAST_TERM = 112
TOLERANCE = 0.06


def series(x: Column, y: Column, z: Column, terms: int = 300) -> Column:
    """The steady state without a source, as a double sine series; terms that aren't numbers count as none."""
    pi = math.pi

    def term(p: Column, q: Column) -> Column:
        a, b = 2 * p + 1, 2 * q + 1
        k = pi * F.sqrt(a * a + b * b)
        t = F.sinh(k * x) / F.sinh(k) * F.sin(a * pi * y) * F.sin(b * pi * z) / (a * b)
        return F.when(F.isnan(t), 0.0).otherwise(t)

    n = F.sequence(F.lit(0), F.lit(min(terms, LAST_TERM)))
    add = lambda inner: lambda total, v: total + inner(v)
    total = F.aggregate(n, F.lit(0.0), add(lambda p: F.aggregate(n, F.lit(0.0), add(lambda q: term(p.cast("double"), q.cast("double"))))))
    return total * 16 / (pi * pi)


def steady(x: Column, y: Column, z: Column, terms: int = 300) -> Column:
    """The steady state in the cube of side 1: the series within, on faces their own values: 1 where x is 1, else 0."""
    face = (x == 0) | y.isin(0.0, 1.0) | z.isin(0.0, 1.0)
    return F.when(x == 1, 1.0).when(face, 0.0).otherwise(series(x, y, z, terms))


def interpolate(x: DataFrame, points: DataFrame, mesh: Mesh) -> DataFrame:
    """(x, y, z, v): a solution (i, v) at each place of ``points`` (x, y, z from 0 to 1), by the shape functions of the cell there.

    A place comes once, however many rows have it; places outside, and those without a value at a corner, are left out.
    Only the eight corners' weights of places are shuffled, and the solution by node."""
    within = [F.col(a).between(0, 1) for a in "xyz"]
    places = points.select("x", "y", "z").where(within[0] & within[1] & within[2]).distinct()
    cells, local = {}, {}
    for a in "xyz":
        n = getattr(mesh, f"n{a}")
        cells[a] = F.least(F.floor(F.col(a) * n), F.lit(n - 1))
        local[a] = 2 * (F.col(a) * n - cells[a]) - 1
    corners = [F.struct(mesh.node_id(*[cells[a] + d for a, d in zip("xyz", c, strict=True)]).alias("i"), shape_at(k, *local.values()).alias("w")) for k, c in enumerate(CORNERS)]
    each = places.select("x", "y", "z", F.explode(F.array(*corners)).alias("c")).select("x", "y", "z", "c.i", "c.w")
    met = each.join(x.select("i", "v"), "i").groupBy("x", "y", "z").agg(F.sum(F.col("w") * F.col("v")).alias("v"), F.count("v").alias("_n"))
    return met.where("_n = 8").drop("_n")


def errors(x: DataFrame, mesh: Mesh, coords: str = "lattice", terms: int = 300, whole: bool = False) -> DataFrame:
    """(i, error) against the series, over the nodes within 0.05 of the centre along each axis, or the whole domain.

    ``lattice`` takes places as they are; ``running``
    lets y and z run on within lines and planes."""
    node = F.col("i")
    px, py, pz = _plane(node, mesh)
    places = (px / mesh.nx, py / mesh.ny, pz / mesh.nz) if coords == "lattice" else running_coords(node, mesh.nx, mesh.ny, mesh.nz)
    at = x.select("i", "v", *[c.alias(n) for c, n in zip(places, "xyz", strict=True)])
    if not whole:
        at = at.where((F.abs(F.col("x") - 0.5) < 0.05) & (F.abs(F.col("y") - 0.5) < 0.05) & (F.abs(F.col("z") - 0.5) < 0.05))
    return at.select("i", F.abs(F.col("v") - steady(F.col("x"), F.col("y"), F.col("z"), terms)).alias("error"))


def verify(x: DataFrame, mesh: Mesh, coords: str = "lattice", terms: int = 300, whole: bool = False, tolerance: float = TOLERANCE) -> DataFrame:
    """(checked, max_error, max_row, passed) of ``errors``; the greatest row of equal errors."""
    worst = F.max(F.struct("error", "i"))
    return errors(x, mesh, coords, terms, whole).agg(F.count("*").alias("checked"), worst["error"].alias("max_error"), worst["i"].alias("max_row"), F.coalesce(F.max("error") <= tolerance, F.lit(True)).alias("passed"))
