"""Reader and lines of sparse matrices in text: ``nnz rows cols``, then rows + 1 offsets, then nnz lines ``col value``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.materialize import materialize
from tessera.operators.scans import exclusive_scan


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of a text file. Sections are positional, so lines are numbered over the whole file."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start").alias("at")
    lines = spark.read.text(path).select(at, F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    # Lines of a block of the file have consecutive ids; blocks are few, and follow one another by path and start.
    blocks = lines.groupBy("at").agg(F.min("id").alias("first"), F.count("*").alias("count"))
    before = F.coalesce(F.sum("count").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(F.broadcast(blocks.select("at", "first", before.alias("before"))), "at").select((F.col("before") + F.col("id") - F.col("first")).alias("n"), "line")


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(coo, offsets) from numbered lines: coo is (row, col, coef), offsets (row, start) with an end row.

    Entries find their row by a range join on the offsets of rows that aren't empty."""
    parts = F.split(F.trim("line"), r"\s+")
    head = lines.where("n = 0").select(parts.cast("array<long>").alias("p")).first()["p"]
    nnz, rows = head[0], head[1]
    offsets = lines.where(F.col("n").between(1, rows + 1)).select((F.col("n") - 1).alias("row"), F.trim("line").try_cast("long").alias("start"))
    entries = lines.where(F.col("n").between(rows + 2, rows + 1 + nnz)).select((F.col("n") - rows - 2).alias("k"), parts.alias("p"))
    ends = offsets.select((F.col("row") - 1).alias("row"), F.col("start").alias("stop"))
    runs = offsets.join(ends, "row").where("start < stop")
    places = runs.select("row", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("k"))
    coo = places.join(entries, "k").select("row", F.col("p")[0].cast("long").alias("col"), F.col("p")[1].cast("double").alias("coef"))
    return coo, offsets


def lines(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """(n, line) of cells (row, col, coef) with distinct places below ``rows`` and ``cols``: what ``parse`` reads.

    Entries come by row, then column; their numbers, and the rows' offsets, are scans, so no task needs all cells."""
    spark, one = cells.sparkSession, F.lit(1).cast("long")
    cells = materialize(cells.select((F.col("row") * cols + F.col("col")).alias("at"), "row", "col", "coef", one.alias("one")))
    placed = exclusive_scan(cells, "at", "one", "k", kept=True)
    counts = spark.range(rows + 1).select(F.col("id").alias("row")).join(cells.groupBy("row").agg(F.count("*").alias("n")), "row", "left")
    offsets = exclusive_scan(counts.select("row", F.coalesce("n", F.lit(0)).alias("n")), "row", "n", "start")
    head = spark.createDataFrame([(0, f"{cells.count()} {rows} {cols}")], "n long, line string")
    body = placed.select((F.col("k") + rows + 2).alias("n"), F.concat_ws(" ", "col", "coef").alias("line"))
    return head.unionByName(offsets.select((F.col("row") + 1).alias("n"), F.col("start").cast("string").alias("line"))).unionByName(body)
