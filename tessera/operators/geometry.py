"""Boxes: recursive bisection, ghost layers, halos and load imbalance, and the algebra of boxes that rows hold.

A box is (part, x0, x1, y0, y1, z0, z1), half open; in the algebra it is one value of its six ends. Parts are workers: their number is a parameter of
the run, not of the data, so box tables are small by construction; points are made and counted in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.materialize import materialize
from tessera.operators.spatial import overlap_join
from tessera.sources.domain import box_points

COLUMNS = "part int, x0 int, x1 int, y0 int, y1 int, z0 int, z1 int"
AXES = "xyz"


@dataclass
class Box:
    lo: list[int]
    hi: list[int]

    def cells(self) -> int:
        return (self.hi[0] - self.lo[0]) * (self.hi[1] - self.lo[1]) * (self.hi[2] - self.lo[2])


def bisect(box: Box, parts: int, axis: int = 2) -> list[Box]:
    """``parts`` boxes: halves along z, then y, then x, and again; the upper half gets its share rounded down."""
    if parts == 1:
        return [box]
    low = parts // 2
    n = box.hi[axis] - box.lo[axis]
    cut = box.hi[axis] - n * (parts - low) // parts
    below, above = Box(box.lo[:], box.hi[:]), Box(box.lo[:], box.hi[:])
    below.hi[axis] = above.lo[axis] = cut
    return bisect(below, low, (axis + 2) % 3) + bisect(above, parts - low, (axis + 2) % 3)


def partition(spark: SparkSession, nx: int, ny: int, nz: int, parts: int) -> DataFrame:
    return table(spark, bisect(Box([0, 0, 0], [nx, ny, nz]), parts))


def table(spark: SparkSession, boxes: list[Box]) -> DataFrame:
    rows = [(p, b.lo[0], b.hi[0], b.lo[1], b.hi[1], b.lo[2], b.hi[2]) for p, b in enumerate(boxes)]
    return spark.createDataFrame(rows, COLUMNS)


def grown(boxes: DataFrame, by: int, limits: tuple[int, int, int]) -> DataFrame:
    """The boxes with a layer around them, within the domain."""
    out = boxes
    for axis, n in zip(AXES, limits, strict=True):
        out = out.withColumn(f"{axis}0", F.greatest(F.col(f"{axis}0") - by, F.lit(0))).withColumn(f"{axis}1", F.least(F.col(f"{axis}1") + by, F.lit(n)))
    return out


def ghost_points(boxes: DataFrame, limits: tuple[int, int, int], by: int = 1) -> DataFrame:
    """(part, x, y, z) of the layer around each box: two slabs for each axis, so that no box's inside is made."""
    ends = lambda prefix: {f"{a}{e}": F.col(f"{prefix}{a}{e}") for a in AXES for e in "01"}
    own = boxes.select("part", *[F.col(f"{a}{e}").alias(f"o_{a}{e}") for a in AXES for e in "01"])
    both = grown(boxes, by, limits).join(own, "part")
    slabs = []
    for k, axis in enumerate(AXES):  # across the axes before this one as wide as the box, across those after as wide as the layer
        sides = {**ends(""), **{f"{a}{e}": F.col(f"o_{a}{e}") for a in AXES[:k] for e in "01"}}
        slabs.append({**sides, f"{axis}1": F.col(f"o_{axis}0")})
        slabs.append({**sides, f"{axis}0": F.col(f"o_{axis}1")})
    each = both.select("part", F.explode(F.array(*[F.struct(*[c.alias(n) for n, c in s.items()]) for s in slabs])).alias("s"))
    return box_points(each.select("part", "s.*"))


def box(lo: dict[str, Column], hi: dict[str, Column]) -> Column:
    """A box as one value, of the ends along each axis."""
    return F.struct(*[end.cast("long").alias(f"{a}{e}") for a in AXES for e, end in (("0", lo[a]), ("1", hi[a]))])


def _sides(b: Column) -> dict[str, tuple[Column, Column]]:
    return {a: (b[f"{a}0"], b[f"{a}1"]) for a in AXES}


def _boxes(sides: list[dict[str, tuple[Column, Column]]]) -> Column:
    """The boxes that aren't empty, as an array."""
    each = F.array(*[box({a: s[a][0] for a in AXES}, {a: s[a][1] for a in AXES}) for s in sides])
    return F.filter(each, lambda b: (b["x0"] < b["x1"]) & (b["y0"] < b["y1"]) & (b["z0"] < b["z1"]))


def difference(a: Column, b: Column) -> Column:
    """What box ``a`` has and ``b`` hasn't, as an array of at most six boxes that share nothing; no points are made.

    Slabs are cut off below and above b along x, then from what is left along y, then z. A null or empty ``b``
    takes nothing away; a null or empty ``a`` gives no boxes."""
    left, slabs = _sides(a), []
    for axis in AXES:
        lo, hi = left[axis]
        low = F.greatest(lo, F.least(b[f"{axis}0"], hi))
        high = F.greatest(low, F.least(b[f"{axis}1"], hi))
        slabs += [left | {axis: (lo, low)}, left | {axis: (high, hi)}]
        left = left | {axis: (low, high)}
    none = b.isNull() | (b["x0"] >= b["x1"]) | (b["y0"] >= b["y1"]) | (b["z0"] >= b["z1"])
    return F.when(a.isNull(), F.slice(_boxes(slabs), 1, 0)).when(none, _boxes([_sides(a)])).otherwise(_boxes(slabs))


def union(a: Column, b: Column) -> Column:
    """What either box has, as at most seven boxes that share nothing."""
    return F.concat(difference(a, F.lit(None).cast("struct<x0:long,x1:long,y0:long,y1:long,z0:long,z1:long>")), difference(b, a))


def layer(b: Column, by: int = 1) -> Column:
    """What lies within ``by`` of a box that isn't empty, outside of it, as at most six boxes."""
    sides = _sides(b)
    return difference(box({a: sides[a][0] - by for a in AXES}, {a: sides[a][1] + by for a in AXES}), b)


def volume(boxes: Column) -> Column:
    """Cells of an array of boxes that share nothing."""
    cells = lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) * (b["z1"] - b["z0"])
    return F.aggregate(boxes, F.lit(0).cast("long"), lambda n, b: n + cells(b))


def holds(boxes: Column, x: Column, y: Column, z: Column) -> Column:
    """Whether one of the boxes has the point."""
    return F.exists(boxes, lambda b: (b["x0"] <= x) & (x < b["x1"]) & (b["y0"] <= y) & (y < b["y1"]) & (b["z0"] <= z) & (z < b["z1"]))


def contains(a: str, b: str) -> Column:
    """Whether box alias ``a`` has all of ``b``."""
    inside = [(F.col(f"{a}.{x}0") <= F.col(f"{b}.{x}0")) & (F.col(f"{b}.{x}1") <= F.col(f"{a}.{x}1")) for x in AXES]
    return inside[0] & inside[1] & inside[2]


def neighbouring(a: str, b: str) -> Column:
    """Whether two box aliases have a plane in common along every axis."""
    meet = [F.col(f"{a}.{x}0").isin(F.col(f"{b}.{x}0"), F.col(f"{b}.{x}1")) | F.col(f"{a}.{x}1").isin(F.col(f"{b}.{x}0"), F.col(f"{b}.{x}1")) for x in AXES]
    return meet[0] & meet[1] & meet[2]


def neighbour_totals(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` with (n, least): how many boxes of ``b`` have a plane in common along every axis, and the least ``key`` among them.

    No pairs are made: both sides give each set of their planes (the lower, the upper or both along each axis), 27 a box,
    which meet by equality. Boxes with one plane of a's or the other along an axis are those with the one, plus those with the
    other, less those with both. Boxes without an end, or that end before they start, have none."""
    ends = [f"{x}{e}" for x in AXES for e in "01"]
    fine = " and ".join(f"{x}0 <= {x}1" for x in AXES)

    def planes(boxes: DataFrame) -> tuple[DataFrame, list[str]]:
        for x in AXES:
            sets = [F.struct(F.col(f"{x}{e}").alias("lo"), F.col(f"{x}{f}").alias("hi")) for e, f in ("00", "11", "01")]
            boxes = boxes.withColumn(f"_{x}", F.explode(F.array_distinct(F.array(*sets))))
        return boxes, [f"_{x}" for x in AXES]

    ones, keys = planes(a.select(*ends).where(fine).distinct())
    others, _ = planes(b.where(fine).groupBy(*ends).agg(F.count("*").alias("_n"), F.min(key).alias("_least")))
    known = others.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"))
    both = [F.col(f"_{x}.lo") != F.col(f"_{x}.hi") for x in AXES]
    sign = F.when(both[0], -1).otherwise(1) * F.when(both[1], -1).otherwise(1) * F.when(both[2], -1).otherwise(1)
    met = ones.join(known, keys).groupBy(*ends).agg(F.sum(sign * F.col("_n")).alias("n"), F.min("_least").alias("least"))
    return a.drop("n", "least").join(met.where("n > 0"), ends)


def disjoint(a: str, b: str) -> Column:
    """Whether two box aliases share no cell."""
    apart = [(F.col(f"{a}.{x}1") <= F.col(f"{b}.{x}0")) | (F.col(f"{b}.{x}1") <= F.col(f"{a}.{x}0")) for x in AXES]
    return apart[0] | apart[1] | apart[2]


def halos(boxes: DataFrame, limits: tuple[int, int, int], by: int = 1) -> DataFrame:
    """(owner, reader, x, y, z): the points of ``owner`` that ``reader`` needs around its own box."""
    met = overlap_join(boxes, grown(boxes, by, limits), [(f"{a}0", f"{a}1") for a in AXES], closed=False)
    pairs = met.select(F.col("a").alias("o"), F.col("b").alias("r")).where("o.part <> r.part")
    common = [F.greatest(f"o.{a}0", f"r.{a}0").alias(f"{a}0") for a in AXES] + [F.least(f"o.{a}1", f"r.{a}1").alias(f"{a}1") for a in AXES]
    both = pairs.select(F.struct(F.col("o.part").alias("owner"), F.col("r.part").alias("reader")).alias("part"), *common)
    return box_points(both).select("part.owner", "part.reader", *AXES)


def counted(rows: DataFrame) -> DataFrame:
    """(x, y, z, n): how many rows each place has, so that a place of any share of them is one row."""
    return rows.where("x is not null and y is not null and z is not null").groupBy(*AXES).agg(F.count("*").alias("n"))


def _as_boxes(places: DataFrame) -> DataFrame:
    return places.select("*", *[(F.col(a) + by).alias(f"{a}{by}") for a in AXES for by in (0, 1)])


def owned(places: DataFrame, boxes: DataFrame) -> DataFrame:
    """``places`` (x, y, z and more) with ``part``: once for each box that has them. The join reads them several times, so they are made once."""
    met = overlap_join(_as_boxes(materialize(places)), boxes, [(f"{a}0", f"{a}1") for a in AXES], closed=False)
    return met.select(F.col("b.part").alias("part"), *[F.col(f"a.{c}").alias(c) for c in places.columns])


def halo_rows(places: DataFrame, boxes: DataFrame, limits: tuple[int, int, int], by: int = 1) -> DataFrame:
    """(owner, reader, and the columns of ``places``): the places of ``owner`` that lie within ``by`` of ``reader``'s box."""
    own = owned(places, boxes).withColumnRenamed("part", "owner")
    return owned(own, grown(boxes, by, limits)).withColumnRenamed("part", "reader").where("owner <> reader")


def imbalance(boxes: list[Box]) -> float:
    """How far the largest or the smallest box is from the mean, in percent of it."""
    n = [b.cells() for b in boxes]
    mean = sum(n) / len(n)
    return max(max(n) - mean, mean - min(n)) / mean * 100 if mean else -1.0


def add_imbalance(boxes: list[Box], percent: float, least: int = 2) -> list[Box]:
    """Boxes that are out of balance by ``percent`` or more.

    Each round moves two planes by a layer: the first inner face of the largest box outwards, and the
    first inner face of the smallest, if it is more than ``least`` layers thick there, inwards. Faces are
    tried along z, y, x, the upper before the lower. All boxes that end at a plane move with it, unless
    that would make one thinner than ``least`` allows; when no plane moves, that is the end. Of equal boxes
    the last counts as largest and the first as smallest. One box stays as it is."""
    out = [Box(b.lo[:], b.hi[:]) for b in boxes]
    domain = Box([min(b.lo[x] for b in out) for x in range(3)], [max(b.hi[x] for b in out) for x in range(3)])
    while len(out) > 1 and imbalance(out) < percent:
        sizes = [b.cells() for b in out]
        large = len(sizes) - 1 - sizes[::-1].index(max(sizes))
        moves = [_move(out[large], domain, 1, 0), _move(out[sizes.index(min(sizes))], domain, -1, least)]
        moves = [m for m in moves if m and all(_may_move(b, *m, least) for b in out)]
        if not moves:
            break
        for axis, at, by in moves:
            for b in out:
                b.lo[axis] += by * (b.lo[axis] == at)
                b.hi[axis] += by * (b.hi[axis] == at)
    return out


def _move(box: Box, domain: Box, outwards: int, thicker_than: int) -> tuple[int, int, int] | None:
    """(axis, plane, step) of the box's first inner face, moved outwards (1) or inwards (-1)."""
    for axis in (2, 1, 0):
        if box.hi[axis] - box.lo[axis] > thicker_than:
            if box.hi[axis] < domain.hi[axis]:
                return axis, box.hi[axis], outwards
            if box.lo[axis] > domain.lo[axis]:
                return axis, box.lo[axis], -outwards
    return None


def _may_move(box: Box, axis: int, at: int, by: int, least: int) -> bool:
    shrinks = at == (box.lo if by > 0 else box.hi)[axis]
    return not shrinks or box.hi[axis] - box.lo[axis] >= least
