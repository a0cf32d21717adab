"""Running reductions over a stream of values, for use with ``writeStream`` in update or complete mode."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators.selection import argmax


def running_argmax(stream: DataFrame, row: str, idx: str, val: str) -> DataFrame:
    """(row_id, max_val, max_idx) so far. The state is one struct a row_id, however many values came."""
    return argmax(stream.select(stream[row].alias("row_id"), stream[idx].alias("idx"), stream[val].alias("val")))
