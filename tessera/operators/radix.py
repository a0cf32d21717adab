"""Selection over whole columns without sorting them: the digits of the wanted values are found from
histograms, 16 bits at a time, and each pass counts only rows that agree with the digits found so far.

Many ranks, in many groups, are found at once. What a pass brings together is a histogram: 65,536 counts
at most for each group and prefix, combined before they meet; rows never do. Numbers count as their
distance from the least one, so that a column takes as many passes as its range has digits, four at most.

Keys are whole numbers; ``ordered_bits`` gives doubles as such, in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.materialize import materialize

BITS = 16
#: Most ranks that go to every task, a row of some numbers each; they are counted first, and more are joined by their prefix.
BROADCAST_RANKS = 100_000
_LOW = (1 << 63) - 1


@F.pandas_udf(T.LongType())
def _bits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in batches:
        given = x.notna().to_numpy()
        b = (x.to_numpy(dtype=np.float64, na_value=0.0) + 0.0).view(np.int64)  # the two zeros are one
        yield pd.Series(np.where(b < 0, b ^ _LOW, b)).astype("Int64").where(given)


#: The bits of NaN, which pandas can't tell from null.
_NAN = 0x7FF8000000000000


def ordered_bits(x: Column) -> Column:
    """A double as a whole number in the same order; a null stays one. NaN is the greatest."""
    return F.when(F.isnan(x), F.lit(_NAN)).otherwise(_bits(F.when(F.isnan(x), None).otherwise(x)))


@F.pandas_udf(T.DoubleType())
def _doubles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in batches:
        b = x.to_numpy(dtype=np.int64, na_value=0)
        yield pd.Series(np.where(b < 0, b ^ _LOW, b).view(np.float64)).where(x.notna())


def from_ordered_bits(bits: Column) -> Column:
    """The double of ordered bits."""
    # No nulls go to pandas, which would make whole numbers doubles.
    return F.when(bits == _NAN, F.lit(float("nan"))).when(bits.isNotNull(), _doubles(F.coalesce(F.when(bits != _NAN, bits), F.lit(0))))


def _span(df: DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    """(least, passes) of each key; where the range doesn't fit a long, the least is that of all longs."""
    ends = df.agg(*[f(k).alias(f"{n}{k}") for k in keys for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for k in keys:
        lo, hi = ends[f"lo{k}"] or 0, ends[f"hi{k}"] or 0
        wide = hi - lo >= 1 << 63
        out.append((-(1 << 63) if wide else lo, 4 if wide else max(1, -(-(hi - lo).bit_length() // BITS))))
    return out


def select(df: DataFrame, keys: list[str], ranks: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rank, keys..., left, ties): for each of ``ranks`` (by..., rank, from 0) the row of that rank by ``keys``, one
    after another, in its group. ``ties`` rows have these keys, and ``left`` of them come before it.

    Groups and keys aren't null. Ranks beyond a group are left out."""
    want = ranks.select(*by, F.col("rank").cast("long").alias("rank"), F.col("rank").cast("long").alias("left"))
    sent = F.broadcast if ranks.limit(BROADCAST_RANKS + 1).count() <= BROADCAST_RANKS else lambda d: d
    found: list[str] = []
    for key, (least, passes) in zip(keys, _span(df, keys), strict=True):
        # As an unsigned number: from the least of all longs a difference would overflow, a change of sign is the same.
        digits = F.col(key).bitwiseXOR(F.lit(least)) if least == -(1 << 63) else F.col(key) - F.lit(least)
        rows = df.select(*by, *found, digits.alias("_u"))
        want = want.withColumn("_prefix", F.lit(0).cast("long"))
        for p in reversed(range(passes)):
            above = F.shiftrightunsigned("_u", BITS * (p + 1)) if p < 3 else F.lit(0).cast("long")
            cut = rows.select(*by, *found, above.alias("_prefix"), F.shiftrightunsigned("_u", BITS * p).bitwiseAND((1 << BITS) - 1).alias("_digit"))
            place = [*by, *found, "_prefix"]
            first = not found and p == passes - 1  # all rows have the same prefix: none
            live = cut if first else cut.join(sent(want.select(*place).distinct()), place, "left_semi")
            counts = live.groupBy(*place, "_digit").agg(F.count("*").alias("_n"))
            before = F.coalesce(F.sum("_n").over(Window.partitionBy(*place).orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            met = counts.withColumn("_before", before).join(sent(want), place).where((F.col("_before") <= F.col("left")) & (F.col("left") < F.col("_before") + F.col("_n")))
            want = materialize(
                met.select(*by, *found, "rank", (F.col("left") - F.col("_before")).alias("left"), F.shiftleft("_prefix", BITS).bitwiseOR(F.col("_digit")).alias("_prefix"), F.col("_n").alias("ties"))
            )
        value = F.col("_prefix").bitwiseXOR(F.lit(least)) if least == -(1 << 63) else F.col("_prefix") + F.lit(least)
        want = want.select(*by, *found, value.alias(key), "rank", "left", "ties")
        found.append(key)
    return want.select(*by, "rank", *found, "left", "ties")


def kth_of_column(df: DataFrame, value: str, place: str, ranks: list[int]) -> DataFrame:
    """(rank, value, place) of the rows of these ranks (from 0) by value, then place, in the whole table.

    Rows without a value are left out; without a place they come first and it is null. A double's NaN comes last."""
    double = dict(df.dtypes)[value] in ("double", "float")
    number = F.col(f"`{value}`").cast("double" if double else "long")
    at = F.struct(F.col(f"`{place}`").isNotNull().cast("int").alias("a"), F.coalesce(F.col(f"`{place}`").cast("long"), F.lit(0)).alias("b"))
    rows = df.where(number.isNotNull()).select((ordered_bits(number) if double else number).alias("_v"), at["a"].cast("long").alias("_a"), at["b"].alias("_b"), F.lit(0).alias("_g"))
    rows = materialize(rows)  # read by every pass
    wanted = df.sparkSession.createDataFrame([(0, r) for r in ranks], "_g int, rank long")
    out = select(rows, ["_v", "_a", "_b"], wanted, ["_g"])
    return out.select("rank", (from_ordered_bits(F.col("_v")) if double else F.col("_v")).alias("value"), F.when(F.col("_a") == 1, F.col("_b")).alias("place"))


def bisect_rows(df: DataFrame, axes: list[str], parts: int, key: str | None = None) -> DataFrame:
    """``df`` with ``part``, from 0: recursive bisection of the rows, along the axes in turn.

    A node of several parts is cut at the row of the rank that its lower half of parts takes, so that sizes
    differ by one at most, and equal places are told apart by ``key``, then by their place in the input. All
    nodes of a level are cut at once, by ranks; a node is a pair of part numbers, so nothing but these cuts
    (``parts`` at most) goes to all tasks. Axes are whole numbers or doubles, and null comes first."""
    types = dict(df.dtypes)
    number = lambda c: ordered_bits(F.col(f"`{c}`").cast("double")) if types[c] in ("double", "float") else F.col(f"`{c}`").cast("long")
    own = [*axes, *([key] if key else [])]
    # Null has a digit of its own below all numbers.
    columns = [c.alias(n) for k, a in enumerate(own) for c, n in ((F.col(f"`{a}`").isNotNull().cast("long"), f"_h{k}"), (F.coalesce(number(a), F.lit(0)), f"_k{k}"))]
    rows = materialize(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *columns, F.monotonically_increasing_id().alias("_at"), F.lit(0).alias("_lo"), F.lit(parts).alias("_hi")))
    total = rows.count()
    nulls = [rows.where(f"_h{k} = 0").limit(1).count() > 0 for k in range(len(own))]
    first = lambda p: F.floor(p.cast("decimal(20,0)") * total / parts).cast("long")
    level, most = 0, parts
    while most > 1:
        axis = level % len(axes)
        keys = [c for k in ([axis] if not key else [axis, len(axes)]) for c in ([f"_h{k}"] if nulls[k] else []) + [f"_k{k}"]] + ["_at"]
        mid = F.col("_lo") + F.floor((F.col("_hi") - F.col("_lo")) / 2).cast("int")
        nodes = rows.where("_hi - _lo > 1").select("_lo", "_hi").distinct()
        cuts = select(rows.where("_hi - _lo > 1"), keys, nodes.select("_lo", "_hi", (first(mid) - first(F.col("_lo"))).alias("rank")), ["_lo", "_hi"])
        at = cuts.select("_lo", "_hi", F.struct(*[F.col(k).alias(k) for k in keys]).alias("_cut"))
        placed = rows.join(F.broadcast(at), ["_lo", "_hi"], "left")  # a row a node: ``parts`` at most
        upper = F.col("_cut").isNotNull() & (F.struct(*keys) >= F.col("_cut"))
        lower = F.when(F.col("_hi") - F.col("_lo") > 1, ~upper)
        rows = materialize(placed.select("_row", *[c for c in rows.columns if c not in ("_row", "_lo", "_hi")], F.when(lower, F.col("_lo")).when(~lower, mid).otherwise(F.col("_lo")).alias("_lo"), F.when(lower, mid).otherwise(F.col("_hi")).alias("_hi")))
        level, most = level + 1, -(-most // 2)
    return rows.select("_row.*", F.col("_lo").alias("part"))
