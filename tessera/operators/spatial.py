"""Joins of boxes that overlap, in any number of dimensions; intervals are boxes of one.

Every box lies in cells of a grid that is about as coarse as the box is long: sizes go by powers of two
(levels), so a box meets two cells at most along each axis, whatever its length. Two boxes meet on the
level of the longer one, to which the shorter is lifted. Of the cells that they share only the one with
the lower corner of what they have in common reports them, so a pair comes once.

A cell with many boxes is dealt out: one side's rows by their place into slices, the other side's to all
of them, so that no task makes more than about PAIRS_EACH pairs of a cell. The join is an equality of
cells, which Spark shuffles; nothing is compared with everything.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.materialize import materialize

#: Pairs of a cell that one slice compares, and most slices of a cell.
PAIRS_EACH, MOST_SLICES = 1_000_000, 4096
Axis = tuple[str, str]


def _level(axes: list[Axis], units: list[float], top: int) -> Column:
    """The least level whose cells are as long as the box along every axis."""
    longest = [F.greatest((F.col(f"`{hi}`") - F.col(f"`{lo}`")) / F.lit(u), F.lit(1.0)) for (lo, hi), u in zip(axes, units, strict=True)]
    return F.least(F.ceil(F.log2(F.greatest(*longest, F.lit(1.0)))).cast("int"), F.lit(top))


def _size(unit: float, level: Column) -> Column:
    return F.lit(float(unit)) * F.pow(F.lit(2.0), level)


def overlap_join(a: DataFrame, b: DataFrame, axes: list[Axis], units: list[float] | None = None, closed: bool = True, pairs_each: int = PAIRS_EACH) -> DataFrame:
    """(a, b): structs of the rows of both tables whose boxes overlap.

    ``axes`` names the lower and the upper end along each axis, in both tables; numbers. Ends belong to
    boxes (``closed``), or upper ends don't. ``units`` is the length of the finest cells, by default the mean
    length of both tables' boxes. Boxes with a null or NaN end, or whose upper end is below their lower one (or at
    it, where ends aren't closed), are left out. Rows that are there twice make their pairs twice."""
    names = [c for axis in axes for c in axis]
    within = (lambda lo, hi: lo <= hi) if closed else (lambda lo, hi: lo < hi)
    sides = []
    for df in (a, b):
        fine = [F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double")) for c in names] + [within(F.col(f"`{lo}`"), F.col(f"`{hi}`")) for lo, hi in axes]
        ends = [F.col(f"`{c}`").cast("double").alias(f"e{k}") for k, c in enumerate(names)]
        sides.append(df.where(_every(fine)).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *ends))
    own = [(f"e{2 * k}", f"e{2 * k + 1}") for k in range(len(axes))]
    ends = [f(x).alias(n) for k, (lo, hi) in enumerate(own) for f, x, n in ((F.min, lo, f"lo{k}"), (F.max, hi, f"hi{k}"), (F.sum, F.col(hi) - F.col(lo), f"sum{k}"))]
    stats = [s.agg(F.count("*").alias("n"), *ends).first() for s in sides]
    rows = sum(s["n"] for s in stats)
    spread = [max((s[f"hi{k}"] for s in stats if s["n"]), default=0.0) - min((s[f"lo{k}"] for s in stats if s["n"]), default=0.0) for k in range(len(axes))]
    if units is None:  # the mean length; of mere points, cells of which each has some
        each = max(rows, 1) ** (1 / len(axes))
        units = [sum(s[f"sum{k}"] or 0.0 for s in stats) / max(rows, 1) or spread[k] / each or 1.0 for k in range(len(axes))]
    top = max([1, *(math.ceil(math.log2(s / u)) + 1 for s, u in zip(spread, units, strict=True) if s > u)])
    leveled = [s.withColumn("level", _level(own, units, top)) for s in sides]
    # The levels that there are, at most one for each doubling of a length.
    there = [[r[0] for r in s.select("level").distinct().collect()] for s in leveled]
    celled = []
    for s, other in zip(leveled, reversed(there), strict=True):
        # A box meets the longer ones on their levels, and those of its own or below on its own.
        meets = F.array_distinct(F.concat(F.array("level"), F.filter(F.lit(other).cast("array<int>"), lambda v: v > F.col("level"))))
        out = s.withColumn("at", F.explode(meets))
        for k, ((lo, hi), u) in enumerate(zip(own, units, strict=True)):
            cell = lambda c, u=u: F.floor(F.col(c) / _size(u, F.col("at"))).cast("long")
            out = out.withColumn(f"c{k}", F.explode(F.sequence(cell(lo), cell(hi))))
        celled.append(out)
    cells = ["at", *[f"c{k}" for k in range(len(axes))]]
    counts = [s.groupBy(*cells).agg(F.count("*").alias(f"n{k}")) for k, s in enumerate(celled)]
    slices = F.least(F.ceil(F.col("n0") * F.col("n1") / pairs_each), F.lit(MOST_SLICES)).cast("int")
    hot = counts[0].join(counts[1], cells).where(F.col("n0") * F.col("n1") > pairs_each).select(*cells, slices.alias("slices"))
    left, right = [s.join(hot, cells, "left").withColumn("slices", F.coalesce("slices", F.lit(1))) for s in celled]
    left = left.withColumn("slice", F.pmod(F.xxhash64("row", F.monotonically_increasing_id()), F.col("slices")).cast("int"))
    right = right.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    keys = [*cells, "slice"]
    x, y = left.alias("x"), right.alias("y")
    met = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys] + [F.greatest("x.level", "y.level") == F.col("x.at")]
    for k, ((lo, hi), u) in enumerate(zip(own, units, strict=True)):
        met += [within(F.col(f"x.{lo}"), F.col(f"y.{hi}")), within(F.col(f"y.{lo}"), F.col(f"x.{hi}"))]
        met.append(F.floor(F.greatest(f"x.{lo}", f"y.{lo}") / _size(u, F.col("x.at"))).cast("long") == F.col(f"x.c{k}"))
    return x.hint("shuffle_hash").join(y, _every(met)).select(F.col("x.row").alias("a"), F.col("y.row").alias("b"))


def overlap_totals(a: DataFrame, b: DataFrame, axes: list[Axis], key: str, closed: bool = True, where: Column | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``a`` that meet some of ``b``, with (n, least): how many, and the least ``key`` among them; and ``sums`` over them.

    Equal boxes are one row on either side while they are joined, with how many they stand for, so a table of
    copies costs what its different boxes cost. ``where`` and ``sums`` are expressions of the ends of boxes a and b."""
    names = [c for axis in axes for c in axis]
    a = materialize(a)
    ones = materialize(a.select(*names).distinct())
    others = materialize(b.groupBy(*names).agg(F.count("*").alias("_n"), F.min(key).alias("_least")))
    met = overlap_join(ones, others, axes, closed=closed)
    met = met if where is None else met.where(where)
    more = [F.sum(F.col("b._n") * v).alias(out) for out, v in (sums or {}).items()]
    found = met.groupBy(*[F.col(f"a.{c}").alias(c) for c in names]).agg(F.sum("b._n").alias("n"), F.min("b._least").alias("least"), *more)
    return a.drop("n", "least", *(sums or {})).join(found, names)


def _every(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
