"""How many boxes meet each box, and the least key among them, without their pairs; intervals are boxes of one axis.

Boxes a and b meet along an axis if b starts by a's end, less those that end before a's start. Multiplied out over the
axes, a count is a sum of signed counts of points (ends of b) that lie below a place (ends of a) on every axis. Each axis is cut
into bins by quantiles. Points that lie in lower bins on every axis come from one table of prefix sums, of at most
TABLE cells; the others share a bin with the place on some axis, and are compared within that bin, a task each. So rows are
shuffled a few times each, however many boxes meet, and the work of a bin is that of sets of bits.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.materialize import materialize
from tessera.operators.scans import exclusive_scans
from tessera.operators.spatial import Axis, overlap_join

#: Cells of a table of bins, points whose sets of bits are made at a time, and places that are looked up in them at a time.
TABLE, CHUNK, PLACES = 1 << 18, 2048, 8192
#: Boxes of least keys that every task tries first, and boxes that may be left for the driver to hand to tasks in rounds.
HEAD, LEFT = 16_384, 65_536


def _fine(axes: list[Axis]) -> Column:
    """Boxes that have both ends, in order, along every axis."""
    out = F.lit(True)
    for lo, hi in axes:
        out = out & F.col(f"`{lo}`").isNotNull() & F.col(f"`{hi}`").isNotNull() & ~F.isnan(F.col(f"`{lo}`").cast("double")) & ~F.isnan(F.col(f"`{hi}`").cast("double")) & (F.col(f"`{lo}`") <= F.col(f"`{hi}`"))
    return out


def _ends(df: DataFrame, axes: list[Axis], *more: str) -> DataFrame:
    """Ends as doubles e0, e1 along the first axis, e2, e3 along the second and so on."""
    return df.select(*[F.col(f"`{c}`").cast("double").alias(f"e{k}") for k, c in enumerate(c for axis in axes for c in axis)], *more)


def _cuts(sides: list[DataFrame], axes: int, bins: int) -> list[np.ndarray]:
    """Upper ends of bins along each axis. An axis of at most ``bins`` values has a bin for each, and a value that many rows have has its own."""
    pooled = [sides[0].select(F.explode(F.array(f"e{2 * k}", f"e{2 * k + 1}")).alias("v")).unionByName(sides[1].select(F.explode(F.array(f"e{2 * k}", f"e{2 * k + 1}")).alias("v"))) for k in range(axes)]
    out = []
    for values in pooled:
        few = [r[0] for r in values.distinct().limit(bins + 1).collect()]
        if len(few) <= bins:
            cuts = set(few)
        else:
            found = values.agg(F.percentile_approx("v", [k / bins for k in range(1, bins)], 20 * bins)).first()[0]
            cuts = set(found) | {np.nextafter(v, -np.inf) for v in found if found.count(v) > 1}
        out.append((np.array(sorted(cuts), dtype=np.float64), len(few) <= bins))
    # A bin is single if all that it has is one value.
    return [(cuts, np.append([whole or (k > 0 and np.nextafter(v, -np.inf) <= cuts[k - 1]) for k, v in enumerate(cuts)], False).astype(bool)) for cuts, whole in out]


def _below(conditions: list[tuple[np.ndarray, str, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    """For each place the weight of the points for which all conditions hold: (of points, le, lt or ge, of places). The first isn't ge."""
    points, how, places = conditions[0]
    order, asked = np.argsort(points, kind="stable"), np.argsort(places, kind="stable")
    conditions = [(p[order], h, r[asked]) for p, h, r in conditions]
    weights, total = weights[order], np.zeros(len(asked), dtype=np.int64)
    points, how, places = conditions[0]
    some, every = ("left", "left") if how == "le" else ("right", "right")
    for at in range(0, len(points), CHUNK):
        part, w = slice(at, at + CHUNK), weights[at : at + CHUNK]
        n = len(w)
        first, whole = np.searchsorted(places, points[at], some), np.searchsorted(places, points[at + n - 1], every)
        words = -(-n // 64)
        one = np.zeros((n, words), dtype=np.uint64)
        one[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        planes = [np.bitwise_or.reduce(np.where((w >> k & 1).astype(bool)[:, None], one, np.uint64(0)), axis=0) for k in range(int(w.max()).bit_length())]
        same = bool((w == 1).all())
        sets = []
        for p, h, r in conditions:
            by = np.argsort(p[part], kind="stable")
            table = np.zeros((n + 1, words), dtype=np.uint64)
            np.bitwise_or.accumulate(one[by], axis=0, out=table[1:])
            if h == "ge":  # those that aren't below
                table = table[n] & ~table
            sets.append((table, np.searchsorted(p[part][by], r[first:], "right" if h == "le" else "left")))
        for lo in itertools.chain(range(first, whole, PLACES), range(max(first, whole), len(places), PLACES)):
            hi = min(lo + PLACES, whole) if lo < whole else lo + PLACES
            bits = None
            for k, (table, rank) in enumerate(sets):
                if k == 0 and lo >= whole and len(sets) > 1:
                    continue  # true for all of the chunk
                found = table[rank[lo - first : hi - first]]
                bits = found if bits is None else np.bitwise_and(bits, found, out=bits)
            for k, plane in enumerate(planes):
                total[lo:hi] += np.bitwise_count(bits if same else bits & plane).sum(axis=1, dtype=np.int64) << k
    out = np.empty_like(total)
    out[asked] = total
    return out


def meeting_counts(a: DataFrame, b: DataFrame, axes: list[Axis], table: int | None = None) -> DataFrame:
    """(id, n): how many boxes of ``b`` (ends, and ``_n``, how many each stands for) meet each box of ``a`` (ends and ``id``). Ends belong to boxes, and
    all boxes are fine. Both are read several times. Those that meet none may be there with 0, or not."""
    d, spark = len(axes), a.sparkSession
    points, places = _ends(b, axes, "_n"), _ends(a, axes, "id")
    bins = max(2, int((table or TABLE) ** (1 / d)))
    cuts = _cuts([points, places], d, bins)
    if d > 1 and (wide := [len(c) for c, _ in cuts if len(c) > bins // 2]) and len(wide) < d:  # axes of few values leave room for finer bins on the others
        room = (table or TABLE) / math.prod(len(c) + 1 for c, _ in cuts if len(c) <= bins // 2)
        cuts = _cuts([points, places], d, max(bins, int(room ** (1 / len(wide)))))
    shape = tuple(len(c) + 1 for c, _ in cuts)
    names = [f"e{k}" for k in range(2 * d)]
    strides = [math.prod(shape[k + 1 :]) for k in range(d)]
    signs = list(itertools.product((0, 1), repeat=d))
    starts = np.cumsum([0, *[2 * n for n in shape]])
    bin_of = lambda pdf, k: np.searchsorted(cuts[k // 2][0], pdf[f"e{k}"].to_numpy(), "left")

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(signs), math.prod(shape)), dtype=np.int64)
        for pdf in batches:
            own = [bin_of(pdf, k) for k in range(2 * d)]
            for k, s in enumerate(signs):
                np.add.at(sums[k], sum(own[2 * x + s[x]] * strides[x] for x in range(d)), pdf["_n"].to_numpy())
        for k in range(len(signs)):
            at = np.flatnonzero(sums[k])
            yield pd.DataFrame({"s": k, "at": at, "n": sums[k][at]})

    counted = points.mapInPandas(histogram, "s int, at long, n long").groupBy("s", "at").agg(F.sum("n").alias("n")).toPandas()  # at most 2^d tables
    sums = np.zeros((len(signs), math.prod(shape)), dtype=np.int64)
    sums[counted["s"].to_numpy(dtype=np.int64), counted["at"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    lower = np.zeros((len(signs), *[n + 1 for n in shape]), dtype=np.int64)
    lower[(slice(None), *[slice(1, None)] * d)] = sums.reshape(len(signs), *shape)
    for x in range(d):
        np.cumsum(lower, axis=x + 1, out=lower)
    known = spark.sparkContext.broadcast(lower)

    def reach(pdf: pd.DataFrame) -> dict[tuple[int, int], np.ndarray]:
        """By axis and sign the first bin that doesn't lie below a place: a single bin does, if its value counts."""
        out = {}
        for x in range(d):
            upper = bin_of(pdf, 2 * x + 1)
            out[x, 0], out[x, 1] = upper + cuts[x][1][upper], bin_of(pdf, 2 * x)
        return out

    def from_table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, n = reach(pdf), np.zeros(len(pdf), dtype=np.int64)
            for k, s in enumerate(signs):
                n += (-1) ** sum(s) * known.value[(k, *[at[x, s[x]] for x in range(d)])]
            yield pd.DataFrame({"id": pdf["id"], "n": n})

    def dealt(which: int):
        """Rows for each bin that an end lies in, but single ones; which: 0 for the ends of points, 1 for those of places."""

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for x, s in itertools.product(range(d), (0, 1)):
                    own = bin_of(pdf, 2 * x + (s if which == 0 else 1 - s))
                    there = ~cuts[x][1][own]
                    yield pdf[there].assign(bin=starts[x] + 2 * own[there] + s)

        return deal

    def count(key: tuple, mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(others):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
        x = int(np.searchsorted(starts, key[0], "right")) - 1
        s = int(key[0] - starts[x]) % 2
        p, r = [{k: pdf[f"e{k}"].to_numpy() for k in range(2 * d)} for pdf in (mine, others)]
        always = [(p[2 * x + s], "lt" if s else "le", r[2 * x + 1 - s])]
        for y in range(x + 1, d):
            always += [(p[2 * y], "le", r[2 * y + 1]), (p[2 * y + 1], "ge", r[2 * y])]
        at, n = reach(others), np.zeros(len(others), dtype=np.int64)
        for t in itertools.product((0, 1), repeat=x):
            lower = [(bin_of(mine, 2 * y + t[y]), "lt", at[y, t[y]]) for y in range(x)]
            n += (-1) ** (s + sum(t)) * _below(always + lower, mine["_n"].to_numpy())
        return pd.DataFrame({"id": others["id"], "n": n})

    ends = ", ".join(f"{c} double" for c in names)
    tables = places.mapInPandas(from_table, "id long, n long")
    left = points.mapInPandas(dealt(0), f"{ends}, _n long, bin long")
    right = places.mapInPandas(dealt(1), f"{ends}, id long, bin long")
    near = left.groupBy("bin").cogroup(right.groupBy("bin")).applyInPandas(count, "id long, n long")
    return tables.unionByName(near.where("n <> 0")).groupBy("id").agg(F.sum("n").alias("n"))


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which boxes of a (rows) meet which of b, both as arrays of ends (2 an axis)."""
    out = np.ones((a.shape[1], b.shape[1]), dtype=bool)
    for k in range(0, len(a), 2):
        out &= a[k][:, None] <= b[k + 1]
        out &= a[k + 1][:, None] >= b[k]
    return out


def least_met(a: DataFrame, b: DataFrame, axes: list[Axis], head: int | None = None, left: int | None = None) -> DataFrame:
    """(id, least): the least ``_least`` of the boxes of ``b`` that meet each box of ``a`` (ends and ``id``), all of which meet some.

    Every box tries those of least keys in their order, ``head`` of them at most, until it meets one, so it takes about as many tries as one in
    how many boxes meet it. Few that are left go on so, in rounds of eight times as many boxes. More than ``left`` meet few boxes, or
    those of great keys; they are joined with all that they meet. Both tables are read several times."""
    d, head, left = len(axes), head or HEAD, left or LEFT
    names = [f"e{k}" for k in range(2 * d)]
    boxes, own = _ends(b, axes, "_least"), _ends(a, axes, "id")
    array = lambda pdf: np.array([pdf[c].to_numpy(dtype=np.float64) for c in names])
    first = boxes.orderBy("_least").limit(head).toPandas()
    if not len(first):
        return own.select("id", F.lit(None).cast(boxes.schema["_least"].dataType).alias("least")).limit(0)
    tried, keys = array(first), first["_least"].to_numpy()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends, at = array(pdf), np.full(len(pdf), -1)
            todo, lo, step = np.arange(len(pdf)), 0, 16
            while lo < len(keys) and len(todo):
                step = min(step, max(16, 4_000_000 // len(todo)))
                met = _meet(ends[:, todo], tried[:, lo : lo + step])
                some = met.any(axis=1)
                at[todo[some]] = lo + met[some].argmax(axis=1)
                todo, lo, step = todo[~some], lo + step, 2 * step
            yield pd.DataFrame({"id": pdf["id"], "at": at, **{c: pdf[c] for c in names}})

    found = materialize(own.mapInPandas(scan, "id long, at long, " + ", ".join(f"{c} double" for c in names)))
    kind = boxes.schema["_least"].dataType
    done = found.where("at >= 0").select("id", F.get(F.lit(keys.tolist()), F.col("at").cast("int")).cast(kind).alias("least"))
    rest = found.where("at < 0").drop("at")
    n, many, known = rest.limit(left + 1).count(), head, []
    if n > left:
        met = overlap_join(rest, boxes.where(F.col("_least") >= F.lit(keys[-1].item())), [(f"e{2 * k}", f"e{2 * k + 1}") for k in range(d)])
        return done.unionByName(met.groupBy(F.col("a.id").alias("id")).agg(F.min("b._least").alias("least")))
    if not n:
        return done
    rest, total, last = rest.toPandas(), boxes.count(), keys[-1].item()
    while len(rest) and many < total:
        many *= 8
        cut = boxes.agg(F.percentile_approx("_least", min(1.0, many / total), 100_000)).first()[0] if many < total else None
        some = boxes.where(F.col("_least") >= F.lit(last)) if cut is None else boxes.where((F.col("_least") >= F.lit(last)) & (F.col("_least") <= F.lit(cut)))
        asked, ids = array(rest), rest["id"].to_numpy()

        def try_all(batches: Iterator[pd.DataFrame], asked=asked, ids=ids) -> Iterator[pd.DataFrame]:
            best = {}
            for pdf in batches:
                pdf = pdf.sort_values("_least")
                ends, key, each = array(pdf), pdf["_least"].to_numpy(), max(1, 4_000_000 // max(1, len(pdf)))
                for lo in range(0, len(ids), each):
                    met = _meet(asked[:, lo : lo + each], ends)
                    for k in np.flatnonzero(met.any(axis=1)):
                        v = key[met[k].argmax()]
                        best[lo + k] = min(v, best.get(lo + k, v))
            yield pd.DataFrame({"id": ids[list(best)], "least": pd.Series(list(best.values()), dtype=keys.dtype)})

        spread = some.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        got = spread.mapInPandas(try_all, f"id long, least {kind.simpleString()}").groupBy("id").agg(F.min("least").alias("least")).collect()
        known += [(r["id"], r["least"]) for r in got]
        rest = rest[~rest["id"].isin([r["id"] for r in got])]
        last = cut
    return done.unionByName(a.sparkSession.createDataFrame(known, f"id long, least {kind.simpleString()}"))


def meeting_totals(a: DataFrame, b: DataFrame, axes: list[Axis], key: str) -> DataFrame:
    """Rows of ``a`` that meet some of ``b``, with (n, least): how many, and the least ``key`` (a number) among them. As ``spatial.overlap_totals``
    of closed boxes, but no pairs are made: time goes by rows, and not by how many meet."""
    names = [c for axis in axes for c in axis]
    a = materialize(a.where(_fine(axes)))
    ones = materialize(a.select(*names).distinct().withColumn("id", F.monotonically_increasing_id()))
    others = materialize(b.where(_fine(axes)).groupBy(*names).agg(F.count("*").alias("_n"), F.min(key).alias("_least")))
    counts = meeting_counts(ones, others, axes).where("n > 0")
    met = materialize(ones.join(counts, "id"))
    found = met.join(least_met(met, others, axes), "id").drop("id")
    return a.drop("n", "least").join(found, names)


def interval_totals(a: DataFrame, b: DataFrame, axis: Axis, key: str) -> DataFrame:
    """As meeting_totals of closed intervals whose ends are whole numbers, with ``shared``: the sum of the lengths that they have in common.

    Up to a place t the intervals of b have t (starts - ends) - (sum of starts) + (sum of ends) in common with all that
    lies before it, each over what is below t; so two running sums' values at either end of an interval of a tell what it shares."""
    lo, hi = axis
    a = materialize(a.where(_fine([axis])))
    ones = materialize(a.select(lo, hi).distinct().withColumn("id", F.monotonically_increasing_id()))
    others = materialize(b.where(_fine([axis])).groupBy(lo, hi).agg(F.count("*").alias("_n"), F.min(key).alias("_least")))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    none, nothing = F.lit(0).cast("long"), F.lit(0).cast("decimal(38,0)")
    ends = others.select(F.col(lo).alias("t"), F.col("_n").alias("starts"), none.alias("ends"), (-exact(lo) * exact("_n")).cast("decimal(38,0)").alias("sum"))
    ends = ends.unionByName(others.select(F.col(hi).alias("t"), none.alias("starts"), F.col("_n").alias("ends"), (exact(hi) * exact("_n")).cast("decimal(38,0)").alias("sum")))
    for c in axis:
        ends = ends.unionByName(ones.select(F.col(c).alias("t"), none.alias("starts"), none.alias("ends"), nothing.alias("sum")))
    by_place = ends.groupBy("t").agg(*[F.sum(c).alias(c) for c in ("starts", "ends", "sum")])
    scanned = exclusive_scans(by_place, "t", {"started": "starts", "ended": "ends", "summed": "sum"})
    covered = (exact("t") * (F.col("started") - F.col("ended")).cast("decimal(20,0)") + F.col("summed")).cast("decimal(38,0)")
    at = materialize(scanned.select("t", covered.alias("covered"), (F.col("started") + F.col("starts")).alias("started"), "ended"))
    below = at.select(F.col("t").alias(lo), F.col("covered").alias("_c0"), F.col("ended").alias("_ended"))
    above = at.select(F.col("t").alias(hi), F.col("covered").alias("_c1"), F.col("started").alias("_started"))
    both = ones.join(below, lo).join(above, hi).select("id", lo, hi, (F.col("_started") - F.col("_ended")).alias("n"), (F.col("_c1") - F.col("_c0")).cast("long").alias("shared"))
    met = materialize(both.where("n > 0"))
    found = met.join(least_met(met, others, [axis]), "id").drop("id")
    return a.drop("n", "least", "shared").join(found, [lo, hi])
