"""Benchmark results: CSV files with a fixed schema, and small series given in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MATMUL = "threads int, processes int, nodes int, n int, used string, gflops double, setup double, wait double, copy double, dgemm double"
SOLVER = "dimension int, gpus int, time_per_iteration double, total_time double, Mflops double, Iterations int, total_cg_time double"


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def series(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
