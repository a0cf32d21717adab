"""Sparse matrices packed for products: groups of rows in blocks of columns, as arrays padded slice by slice.

A block has ``columns`` columns, a group about ``most`` of its cells, by a hash of their rows: so a column that
most rows have, and a row that has most columns, lie in many groups. A group's rows are ordered by their length
and padded in slices of ``height`` rows, each to its own longest, so that padding stays small. A product sends
each block of x once to each group of its columns, multiplies whole slices with numpy, and adds what
groups give a row.

Defined cases: cells with a null count for nothing, repeated cells add up; so do values of x that are null or that
x lacks; a row of which no cell meets a value has no result, or 0 with ``rows``. Ids of x are distinct.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.materialize import materialize

COLUMNS, CELLS, HEIGHT = 1 << 15, 1 << 17, 256
WHOLE = {"tinyint", "smallint", "int", "bigint"}


@dataclass(frozen=True)
class Packed:
    """``table``: (block, group, rows, lens, coefs, cols), cols counted within the block. ``sizes``: (block, groups)."""

    table: DataFrame
    sizes: DataFrame
    columns: int
    height: int

    def kept(self) -> Packed:
        """Packed once, for many products."""
        return replace(self, table=materialize(self.table), sizes=materialize(self.sizes))


def _slices(rows: np.ndarray, cols: np.ndarray, coefs: np.ndarray, height: int) -> tuple[np.ndarray, ...]:
    """Rows by length, their lengths, and padded coefficients and columns, slice after slice. A pad is 0 at its row's last column."""
    order = np.lexsort((cols, rows))
    ids, start, n = np.unique(rows[order], return_index=True, return_counts=True)
    by = np.argsort(n, kind="stable")
    padded = []
    for lo in range(0, len(ids), height):
        first, lens = start[by[lo : lo + height], None], n[by[lo : lo + height], None]
        across = np.arange(lens.max())
        cell = order[first + np.minimum(across, lens - 1)]
        padded.append((np.where(across < lens, coefs[cell], 0).ravel(), cols[cell].ravel()))
    return ids[by], n[by], np.concatenate([c for c, _ in padded]), np.concatenate([c for _, c in padded])


def pack(cells: DataFrame, columns: int = COLUMNS, most: int = CELLS, height: int = HEIGHT) -> Packed:
    kind = "bigint" if dict(cells.dtypes)["coef"] in WHOLE else "double"
    known = cells.where("row is not null and col is not null and coef is not null")
    summed = known.groupBy("row", "col").agg(F.sum("coef").cast(kind).alias("coef"))
    placed = summed.select(F.col("row").cast("long").alias("row"), F.floor(F.col("col") / columns).alias("block"), F.pmod("col", F.lit(columns)).cast("int").alias("at"), "coef")
    sizes = placed.groupBy("block").agg(F.ceil(F.count("*") / most).alias("groups"))
    dealt = placed.join(sizes, "block").withColumn("group", F.pmod(F.xxhash64("row"), "groups"))

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = _slices(group["row"].to_numpy(), group["at"].to_numpy(), group["coef"].to_numpy(), height)
        return pd.DataFrame({"block": [key[0]], "group": [key[1]], **{c: [v] for c, v in zip(("rows", "lens", "coefs", "cols"), found, strict=True)}})

    table = dealt.groupBy("block", "group").applyInPandas(one, f"block long, group long, rows array<long>, lens array<int>, coefs array<{kind}>, cols array<int>")
    return Packed(table, sizes, columns, height)


def _times(r: pd.Series, at: np.ndarray, v: np.ndarray, columns: int, height: int, dtype: type) -> pd.DataFrame:
    """The sums of one group's rows; a slice is as wide as its last row is long."""
    x, known = np.zeros(columns, dtype), np.zeros(columns, bool)
    x[at], known[at] = v, True
    sums, hits, begin = [], [], 0
    for lo in range(0, len(r.lens), height):
        lens = r.lens[lo : lo + height, None]
        width = int(lens[-1, 0])
        here = slice(begin, begin + len(lens) * width)
        begin = here.stop
        col, coef = r.cols[here].reshape(-1, width), r.coefs[here].reshape(-1, width)
        use = (np.arange(width) < lens) & known[col]
        sums.append(np.where(use, coef * x[col], 0).sum(axis=1))
        hits.append(use.any(axis=1))
    hit = np.concatenate(hits)
    return pd.DataFrame({"row": r.rows[hit], "v": np.concatenate(sums)[hit].astype(dtype)})


def product(a: Packed, x: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(row, v) of A x for x (i, v). With ``rows`` (row), rows without a result are there, with 0."""
    whole = dict(x.dtypes)["v"] in WHOLE and a.table.schema["coefs"].dataType.elementType.typeName() == "long"
    kind, dtype, columns, height = ("bigint", np.int64, a.columns, a.height) if whole else ("double", np.float64, a.columns, a.height)
    value = F.struct(F.pmod("i", F.lit(columns)).cast("int").alias("at"), F.col("v").cast(kind).alias("v"))
    blocks = x.where("i is not null and v is not null").groupBy(F.floor(F.col("i") / columns).alias("block")).agg(F.collect_list(value).alias("x"))
    sent = blocks.join(a.sizes, "block").select("block", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))

    def multiply(packed: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:  # a group at a time, however many a task has
        if not len(packed) or not len(values):
            return pd.DataFrame({"row": np.zeros(0, np.int64), "v": np.zeros(0, dtype)})
        with np.errstate(all="ignore"):
            r, x = packed.iloc[0], values.iloc[0]
            return _times(r, x["at"], x["v"], columns, height, dtype)

    sent = sent.select("block", "group", F.col("x.at").alias("at"), F.col("x.v").alias("v"))
    key = ["block", "group"]
    products = a.table.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(multiply, f"row long, v {kind}")
    y = products.groupBy("row").agg(F.sum("v").alias("v"))
    return y if rows is None else rows.join(y, "row", "left").select("row", F.coalesce("v", F.lit(0)).alias("v"))
