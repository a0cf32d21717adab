"""Queries that count boxes and intervals that meet: all rows, without pairs of them."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from tessera.operators import counting, spatial
from tessera.plans import catalog


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Lines of orders, most of them of three lines or more."""
    rng, folder = random.Random(7), str(tmp_path_factory.mktemp("orders"))
    lines = []
    for order in range(120):
        for number in range(rng.choice([1, 2, 3, 4, 6])):
            lines.append((order, number + 1, float(rng.randint(1, 50)), rng.randint(90_000, 200_000) / 100, datetime(1996, 1, 1) + timedelta(days=rng.randint(0, 200))))
    df = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp")
    df.coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder, lines


def met(lines, box, meets):
    """(id, n, least) of even orders with the odd ones whose boxes meet theirs, pair by pair."""
    orders = {}
    for line in lines:
        orders.setdefault(line[0], []).append(line)
    boxes = {k: box(own) for k, own in orders.items()}
    out = set()
    for a in boxes:
        others = [b for b in boxes if a % 2 == 0 and b % 2 == 1 and meets(boxes[a], boxes[b])]
        if others:
            out.add((a, len(others), min(others)))
    return out


def as_sql(name, folder):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/lineitem.parquet/*.parquet')")
    return set(c.execute(catalog.ORACLES[name]).fetchall())


def test_box_neighbours_has_orders_of_any_length(spark, orders):
    folder, lines = orders
    box = lambda own: [f(v) + e for v in ([x[1] for x in own], [x[4].year * 12 + x[4].month for x in own], [int(x[2]) // 10 for x in own]) for f, e in ((min, 0), (max, 1))]
    plane = lambda p, q: all({p[i], p[i + 1]} & {q[i], q[i + 1]} for i in (0, 2, 4))
    want = met(lines, box, plane)
    got = {(r["id"], r["neighbours"], r["least"]) for r in catalog.box_neighbours(spark, folder).collect()}
    assert got == want == as_sql("box_neighbours", folder)


def boxes_of(spark, seed, n, side, axes):
    """Boxes as integers, a third of them at one place, with copies, broken ones and such without an end."""
    rng = random.Random(seed)
    rows = [(k, *[e for x in range(axes) for e in (sorted(rng.choices(range(side if x else 1000), k=2)) if k % 3 else (4, 5))]) for k in range(n)]
    rows += [(n + k, *rng.choice(rows)[1:]) for k in range(n // 2)]
    rows += [(9001, *[3, 1] * axes), (9002, *[None, 1] * axes)]
    return rows, spark.createDataFrame(rows, "id long, " + ", ".join(f"lo{x} long, hi{x} long" for x in range(axes))).repartition(3)


@pytest.mark.parametrize("axes", [1, 2, 3])
@pytest.mark.parametrize("head, left", [(2, 1000), (2, 3), (1000, 10)])
def test_totals_without_pairs(spark, monkeypatch, axes, head, left):
    a, x = boxes_of(spark, axes, 150, 12, axes)
    b, y = boxes_of(spark, axes + 9, 130, 12, axes)
    monkeypatch.setattr(counting, "TABLE", 6**axes)
    monkeypatch.setattr(counting, "HEAD", head)
    monkeypatch.setattr(counting, "LEFT", left)
    joined = []
    join = counting.overlap_join
    monkeypatch.setattr(counting, "overlap_join", lambda *more, **named: joined.append(1) or join(*more, **named))
    want = set()
    for p in a:
        others = [q[0] for q in b if None not in p + q and all(p[k] <= p[k + 1] and q[k] <= q[k + 1] and p[k] <= q[k + 1] and q[k] <= p[k + 1] for k in range(1, 2 * axes, 2))]
        if others:
            want.add((p[0], len(others), min(others)))
    got = counting.meeting_totals(x, y, [(f"lo{k}", f"hi{k}") for k in range(axes)], "id")
    assert {tuple(r) for r in got.select("id", "n", "least").collect()} == want
    assert bool(joined) == (left == 3)  # boxes that are left are joined only if they are many
    assert counting.meeting_totals(x, y.limit(0), [(f"lo{k}", f"hi{k}") for k in range(axes)], "id").count() == 0


def test_box_join_makes_no_pairs(spark, orders, monkeypatch):
    folder, lines = orders
    monkeypatch.setattr(spatial, "overlap_join", lambda *more, **named: pytest.fail("pairs"))
    assert {(r["id"], r["others"], r["least_other"]) for r in catalog.box_join(spark, folder).collect()} == as_sql("box_join", folder)


def test_box_join_has_orders_of_any_length(spark, orders):
    folder, lines = orders
    box = lambda own: [f(v) for v in ([round(x[3] * 100) for x in own], [x[4] for x in own], [x[2] for x in own]) for f in (min, max)]
    meets = lambda p, q: all(p[i] <= q[i + 1] and q[i] <= p[i + 1] for i in (0, 2, 4))
    got = {(r["id"], r["others"], r["least_other"]) for r in catalog.box_join(spark, folder).collect()}
    assert got == met(lines, box, meets) == as_sql("box_join", folder)


@pytest.mark.parametrize("head, left", [(2, 1000), (2, 3)])
def test_totals_of_intervals_without_pairs(spark, monkeypatch, head, left):
    a, x = boxes_of(spark, 5, 150, 12, 1)
    b, y = boxes_of(spark, 6, 130, 12, 1)
    monkeypatch.setattr(counting, "HEAD", head)
    monkeypatch.setattr(counting, "LEFT", left)
    far = 1_700_000_000_000_000  # as microseconds
    want = set()
    for p in a:
        others = [q for q in b if None not in p + q and p[1] <= p[2] and q[1] <= q[2] and p[1] <= q[2] and q[1] <= p[2]]
        if others:
            want.add((p[0], len(others), min(q[0] for q in others), sum(min(p[2], q[2]) - max(p[1], q[1]) for q in others)))
    moved = [t.withColumns({c: t[c] + far for c in ("lo0", "hi0")}) for t in (x, y)]
    got = counting.interval_totals(*moved, ("lo0", "hi0"), "id")
    assert {tuple(r) for r in got.select("id", "n", "least", "shared").collect()} == want
    assert counting.interval_totals(x, y.limit(0), ("lo0", "hi0"), "id").count() == 0


def test_interval_join_makes_no_pairs(spark, monkeypatch):
    """Sessions of a day meet nearly all windows of it."""
    data = "/root/testdata/sf0.001"
    monkeypatch.setattr(spatial, "overlap_join", lambda *more, **named: pytest.fail("pairs"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{data}/events.parquet')")
    want = c.execute(f"SELECT event_id, sessions, least_user, shared FROM ({catalog.ORACLES['interval_join']})").fetchall()
    assert {tuple(r) for r in catalog.interval_join(spark, data).select("event_id", "sessions", "least_user", "shared").collect()} == set(want)
