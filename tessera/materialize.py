"""Cuts of lineage for iterative plans."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def settled(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside stay as they were made: what is materialised then keeps its partitioning, and later
    plans find it in place, joins on more columns than it is dealt by too. For tables that are dealt evenly by design."""
    fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {key: spark.conf.get(key) for key in fixed}
    for key, value in fixed.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def materialize(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the folder that spark.checkpoint.dir names. Without one it fails but on a single machine: a folder of one machine's own would lose data on a cluster."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint()
