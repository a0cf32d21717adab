"""Writers of vectors and matrices as text, nested reports, and summaries of repeated runs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import scans


def _write(lines: DataFrame, order: list[str], header: str, path: str) -> None:
    """``line`` of the rows by ``order``, in part files one after the other; the header is the first line of the first."""
    first = lines.sparkSession.range(1).select(F.lit(0).alias("_rank"), *[F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in order], F.lit(header).alias("line"))
    every = first.unionByName(lines.select(F.lit(1).alias("_rank"), *order, "line"))
    every.repartitionByRange("_rank", *order).sortWithinPartitions("_rank", *order).select("line").write.text(path)


def write_vector(v: DataFrame, path: str) -> int:
    """The number of values, which is returned, then lines ``i v`` sorted by i. Rows with a null are left out."""
    v = v.dropna(subset=["i", "v"])
    n = v.count()
    _write(v.select("i", F.concat_ws(" ", "i", "v").alias("line")), ["i"], str(n), path)
    return n


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(i, v) of a file that write_vector wrote: the header is the one line of a single number."""
    part = F.split("value", " ")
    return spark.read.text(path).where(F.size(part) == 2).select(part[0].cast("long").alias("i"), part[1].cast("double").alias("v"))


def write_matrix(cells: DataFrame, path: str) -> tuple[int, int]:
    """A header of rows and cells, which are returned, then lines ``row col coef`` sorted by row and column. Cells with a null are left out."""
    cells = cells.dropna(subset=["row", "col", "coef"])
    n, nnz = cells.agg(F.count_distinct("row"), F.count("*")).first()
    _write(cells.select("row", "col", F.concat_ws(" ", "row", "col", "coef").alias("line")), ["row", "col"], f"{n} {nnz}", path)
    return n, nnz


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, coef) of a file that write_matrix wrote; its header has two numbers."""
    part = F.split("value", " ")
    return spark.read.text(path).where(F.size(part) == 3).select(part[0].cast("long").alias("row"), part[1].cast("long").alias("col"), part[2].cast("double").alias("coef"))


def report_lines(tree: dict, depth: int = 0) -> list[str]:
    """Nested keys and values, two spaces a level."""
    out = []
    for key, value in tree.items():
        pad = "  " * depth
        out += [f"{pad}{key}:", *report_lines(value, depth + 1)] if isinstance(value, dict) else [f"{pad}{key}: {value}"]
    return out


def run_report(parameters, stats: dict, solution, seconds: dict[str, float], workers: int, when: str) -> dict:
    """The tree of a run: its parameters, the matrix's figures, times of the steps and how the solver ended."""
    overlap = "1 (yes)" if parameters.mv_overlap_comm_comp == 1 else "0 (no)"
    sizes = {"nx": parameters.nx, "ny": parameters.ny, "nz": parameters.nz}
    return {
        "Global Run Parameters": {"dimensions": sizes, "load_imbalance": parameters.load_imbalance, "mv_overlap_comm_comp": overlap, "number of processors": workers},
        "Run Date/Time": when,
        "Matrix attributes": stats,
        **{f"{step} time": took for step, took in seconds.items()},
        "CG solve": {"Iterations": solution.iterations, "Final Resid Norm": solution.residual},
        "Total Program Time": sum(seconds.values()),
    }


def write_report(tree: dict, path: str) -> None:
    Path(path).write_text("\n".join([*report_lines(tree), ""]))


def mean_without_first(runs: DataFrame, key: str, order: str, value: str, skip: int = 2) -> DataFrame:
    """(key, mean) of each key's values but the first ``skip`` by order."""
    placed = scans.places(runs, key, [order], "_n")
    return placed.where(F.col("_n") >= skip).groupBy(key).agg(F.avg(value).alias("mean"))
