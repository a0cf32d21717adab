"""Algebra of boxes against sets of points."""

import itertools
import random

from pyspark.sql import functions as F

from tessera.operators import geometry, spatial

ENDS = ["x0", "x1", "y0", "y1", "z0", "z1"]
TYPE = "struct<x0:long,x1:long,y0:long,y1:long,z0:long,z1:long>"


def points(b):
    return set() if b is None else set(itertools.product(*[range(b[2 * k], b[2 * k + 1]) for k in range(3)]))


def parts(boxes):
    """The boxes' points; each is in one box alone, and no box is empty."""
    each = [points(tuple(b)) for b in boxes]
    out = set().union(*each)
    assert all(each) and sum(map(len, each)) == len(out)
    return out


def test_difference_union_and_layer(spark):
    rng = random.Random(4)

    def some():
        ends = [sorted(rng.choices(range(7), k=2)) for _ in range(3)]
        return (ends[0][0], ends[0][1], ends[1][0], ends[1][1], ends[2][0], ends[2][1])

    inner, outer = (2, 4, 2, 4, 2, 4), (0, 6, 0, 6, 0, 6)
    pairs = [(outer, inner), (inner, outer), (inner, inner), (inner, None), (None, inner), (None, None), ((4, 2, 0, 6, 0, 6), inner), (outer, (4, 2, 0, 6, 0, 6))]
    pairs += [(some(), some()) for _ in range(200)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], f"k int, a {TYPE}, b {TYPE}")
    a, b = F.col("a"), F.col("b")
    sets = df.select("k", "a", geometry.difference(a, b).alias("only"), geometry.union(a, b).alias("either"), geometry.layer(a).alias("layer"))
    out = sets.select("*", *[geometry.volume(F.col(c)).alias(f"{c}_n") for c in ("only", "either")], geometry.holds(F.col("only"), F.lit(3), F.lit(2), F.lit(1)).alias("held")).collect()
    assert len(out) == len(pairs)
    for r in out:
        one, two = map(points, pairs[r["k"]])
        assert parts(r["only"]) == one - two and r["only_n"] == len(one - two) and len(r["only"]) <= 6
        assert parts(r["either"]) == one | two and r["either_n"] == len(one | two) and len(r["either"]) <= 7
        assert r["held"] == ((3, 2, 1) in one - two)
        if one:
            x = pairs[r["k"]][0]
            assert parts(r["layer"]) == points(tuple(e + (1 if k % 2 else -1) for k, e in enumerate(x))) - one


AXES = [(f"{a}0", f"{a}1") for a in "xyz"]


def some_boxes(seed, n, side):
    """Boxes with copies, points, empty and broken ones among them."""
    rng = random.Random(seed)
    rows = [(k, *[e for _ in range(3) for e in sorted(rng.choices(range(side), k=2))]) for k in range(n)]
    rows += [(n + k, *rng.choice(rows)[1:]) for k in range(n)]
    return [*rows, (9001, 3, 1, 0, 2, 0, 2), (9002, None, 1, 0, 2, 0, 2), (9003, 1, 2, 2, 2, 0, 2)]


def want(a, b, meets, size=lambda x, y: 1):
    out = set()
    for x in a:
        met = [y for y in b if None not in x and None not in y and meets(x[1:], y[1:])]
        if met:
            out.add((x[0], len(met), min(y[0] for y in met), sum(size(x[1:], y[1:]) for y in met)))
    return out


def test_totals_of_boxes_that_meet_join_equal_boxes_once(spark, monkeypatch):
    a, b = some_boxes(1, 40, 6), some_boxes(2, 50, 6)
    x, y = [spark.createDataFrame(rows, "id long, " + ", ".join(f"{e} long" for e in ENDS)) for rows in (a, b)]
    sizes, join = [], spatial.overlap_join
    monkeypatch.setattr(spatial, "overlap_join", lambda p, q, *more, **named: sizes.append((p.count(), q.count())) or join(p, q, *more, **named))
    each = [(0, 1), (2, 3), (4, 5)]
    shared = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    got = spatial.overlap_totals(x, y, AXES, "id", sums={"shared": shared})
    closed = lambda p, q: all(p[i] <= p[j] and q[i] <= q[j] and p[i] <= q[j] and q[i] <= p[j] for i, j in each)
    assert {tuple(r) for r in got.select("id", "n", "least", "shared").collect()} == want(a, b, closed, lambda p, q: min(p[1], q[1]) - max(p[0], q[0]))
    assert sizes == [(len({r[1:] for r in a}), len({r[1:] for r in b}))]
    got = spatial.overlap_totals(x, y, AXES, "id", closed=False, where=geometry.contains("a", "b"))
    inside = lambda p, q: all(q[i] < q[j] and p[i] <= q[i] and q[j] <= p[j] for i, j in each)
    assert {tuple(r) for r in got.select("id", "n", "least").collect()} == {r[:3] for r in want(a, b, inside)}


def test_totals_of_neighbours_make_no_pairs(spark):
    a, b = some_boxes(3, 60, 5), some_boxes(4, 60, 5)
    x, y = [spark.createDataFrame(rows, "id long, " + ", ".join(f"{e} long" for e in ENDS)) for rows in (a, b)]
    plane = lambda p, q: all(p[i] <= p[i + 1] and q[i] <= q[i + 1] and {p[i], p[i + 1]} & {q[i], q[i + 1]} for i in (0, 2, 4))
    got = geometry.neighbour_totals(x, y, "id")
    assert {tuple(r) for r in got.select("id", "n", "least").collect()} == {r[:3] for r in want(a, b, plane)}
    assert geometry.neighbour_totals(x, y.limit(0), "id").count() == 0
