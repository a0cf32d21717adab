"""Sparse matrices as cells (row, col, coef), as padded rows, and their products with vectors (i, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.materialize import materialize
from tessera.operators import scans

#: Cells that a partition of part_stats has, about.
CELLS_EACH = 500_000


def spmv(cells: DataFrame, x: DataFrame, rows: DataFrame | None = None, alpha: float = 1.0) -> DataFrame:
    """(row, v) of alpha A x. With ``rows`` (row), rows without cells are there, with 0."""
    y = cells.join(x.select(F.col("i").alias("col"), "v"), "col").groupBy("row").agg((F.sum(F.col("coef") * F.col("v")) * alpha).alias("v"))
    return y if rows is None else rows.join(y, "row", "left").select("row", F.coalesce("v", F.lit(0)).alias("v"))


def spmv_axpby(cells: DataFrame, x: DataFrame, y: DataFrame, alpha: float, beta: float) -> DataFrame:
    """(row, v) of alpha A x + beta y, for the rows that y (i, v) has."""
    ax = spmv(cells, x, alpha=alpha).select("row", F.col("v").alias("_ax"))
    return y.select(F.col("i").alias("row"), F.col("v").alias("_y")).join(ax, "row", "left").select("row", (F.coalesce("_ax", F.lit(0)) + F.col("_y") * beta).alias("v"))


def accumulate(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """``cells`` with the coefficients of ``parts`` (row, col, coef) added where they have a cell; elsewhere parts are left out."""
    sums = parts.groupBy("row", "col").agg(F.sum("coef").alias("_more"))
    return cells.join(sums, ["row", "col"], "left").select("row", "col", (F.col("coef") + F.coalesce("_more", F.lit(0))).alias("coef"))


def spmv_dot(cells: DataFrame, x: DataFrame) -> DataFrame:
    """<x, A x> of a square A, in one plan."""
    y = spmv(cells, x)
    return y.join(x.select(F.col("i").alias("row"), F.col("v").alias("x")), "row").agg(F.sum(F.col("v") * F.col("x")).alias("dot"))


def row_counts(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, n) for every row of the domain."""
    return rows.join(cells.groupBy("row").agg(F.count("*").alias("n")), "row", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))


def to_ell(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, len, coefs, cols): every row padded to the longest one, with coefficient 0 at its own last column.

    An empty row is padded with column 0, so that a pad is always a valid place."""
    width = row_counts(cells, rows).agg(F.max("n")).first()[0] or 0
    packed = cells.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "coef"))).alias("c"))
    own = rows.join(packed, "row", "left").withColumn("c", F.coalesce("c", F.array().cast(packed.schema["c"].dataType)))
    n = F.size("c")
    pad = lambda v: F.array_repeat(v, F.lit(width) - n)
    last = F.coalesce(F.get("c", n - 1)["col"], F.lit(0))
    return own.select("row", n.alias("len"), F.concat(F.col("c.coef"), pad(F.lit(0.0).cast(cells.schema["coef"].dataType))).alias("coefs"), F.concat(F.col("c.col"), pad(last.cast("long"))).alias("cols"))


def to_sliced_ell(cells: DataFrame, rows: DataFrame, width: int = 256) -> DataFrame:
    """(row, slice, len, coefs, cols): as ``to_ell``, with long rows dealt by a hash of their columns into slices of about ``width`` cells.

    No value or task holds a long row, and what is padded is a slice, to the longest slice."""
    cells, rows = materialize(cells), materialize(rows)  # each is read several times
    long = cells.groupBy("row").agg(F.count("*").alias("n")).where(F.col("n") > width)
    slices = long.select("row", F.ceil(F.col("n") / width).cast("long").alias("slices"))
    dealt = cells.join(slices, "row", "left").withColumn("slice", F.pmod(F.xxhash64("col"), F.coalesce("slices", F.lit(1).cast("long"))))
    key = F.struct("row", "slice")
    empty = rows.join(cells.select("row").distinct(), "row", "left_anti").select(F.struct("row", F.lit(0).cast("long").alias("slice")).alias("row"))
    own = dealt.join(rows, "row", "left_semi").select(key.alias("row"), "col", "coef")
    own = materialize(own)
    return to_ell(own, own.select("row").distinct().unionByName(empty)).select("row.row", "row.slice", "len", "coefs", "cols")


def spmv_ell(ell: DataFrame, x: DataFrame) -> DataFrame:
    """(row, v) from padded rows or slices; pads are skipped by their length, empty rows give 0."""
    cells = ell.select("row", F.explode(F.slice(F.arrays_zip("coefs", "cols"), 1, F.col("len"))).alias("c")).select("row", F.col("c.cols").alias("col"), F.col("c.coefs").alias("coef"))
    return spmv(cells, x, ell.select("row").distinct())


def matrix_stats(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows, cells, cells a row, and gigabytes in compressed rows of 4-byte places and 8-byte values."""
    c = row_counts(cells, rows).agg(F.count("*").alias("n_rows"), F.sum("n").alias("nnz"), F.avg("n").alias("mean_row"), F.max("n").alias("longest_row"), F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("empty_rows"))
    return c.withColumn("memory_gb", (2 * F.col("n_rows") * 4 + F.col("nnz") * 4 + F.col("nnz") * 8) / float(1 << 30))


def part_stats(cells: DataFrame, owners: DataFrame) -> DataFrame:
    """One row: least, greatest and mean rows and cells of the parts of owners (row, part), and the megabytes of what
    they exchange: each part's external columns (their id and local number), what it sends, and three numbers for each neighbour."""
    cells = materialize(cells.select("row", "col"))
    parts = _parts(cells.count(), cells)
    laid, owners = cells.repartition(parts, "row"), owners.select("row", "part").repartition(parts, "row")
    counts = owners.join(laid.groupBy("row").agg(F.count("*").alias("n")), "row", "left").groupBy("part").agg(F.count("*").alias("rows"), F.sum(F.coalesce("n", F.lit(0))).alias("nnz"))
    out = counts.agg(*[f(c).alias(f"{c}_{name}") for c in ("rows", "nnz") for name, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])
    outside = externals(laid, owners, parts)
    numbers = outside.agg(F.count("*").alias("n")).join(F.broadcast(neighbours(outside).agg(F.count("*").alias("m"))))  # one row each
    return out.join(F.broadcast(numbers)).select(*out.columns, ((3 * F.col("n") + 3 * F.col("m")) * 4 / float(1 << 20)).alias("halo_mb"))


def _parts(n: int, df: DataFrame) -> int:
    """Partitions for so many cells, so that a task's share of them doesn't grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // CELLS_EACH))


def externals(cells: DataFrame, owners: DataFrame, parts: int | None = None) -> DataFrame:
    """(reader, owner, id): the columns that a part's rows need from other parts. ``parts``: partitions for columns, by default Spark's."""
    read = cells.join(owners.select("row", F.col("part").alias("reader")), "row").select("reader", F.col("col").alias("id"))
    own = owners.select(F.col("row").alias("id"), F.col("part").alias("owner"))
    if parts:
        read, own = read.repartition(parts, "id"), own.repartition(parts, "id")
    return read.distinct().join(own, "id").where("reader <> owner").select("reader", "owner", "id")


def neighbours(external: DataFrame) -> DataFrame:
    """(part, neighbour): those that a part reads from or that read from it."""
    pairs = external.select(F.col("reader").alias("part"), F.col("owner").alias("neighbour")).distinct()
    return pairs.unionByName(pairs.select(F.col("neighbour").alias("part"), F.col("part").alias("neighbour"))).distinct()


def split_by_owner(cells: DataFrame, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """The cells whose columns are among rows first..last, and the others."""
    own = F.col("col").between(first, last)
    return cells.where(own), cells.where(~own)


def local_numbers(external: DataFrame) -> DataFrame:
    """(reader, owner, id, local): external ids of each reader numbered by owner, then id, from 0."""
    return scans.places(external.select("reader", "owner", "id").distinct(), "reader", ["owner", "id"], "local")


def add_to_diagonal(cells: DataFrame, value: float) -> DataFrame:
    return cells.withColumn("coef", F.when(F.col("row") == F.col("col"), F.col("coef") + value).otherwise(F.col("coef")))
