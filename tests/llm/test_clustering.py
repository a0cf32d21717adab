import hashlib
import math
import random

import numpy as np
import pytest

from tessera.llm import clustering


def brute(rows, k=16, rounds=3, dim=64, scale=64):
    """Lloyd's rounds with whole numbers, every vector against every centroid."""
    kept = [(i, [min(max(math.floor(scale * x), -clustering.LIMIT), clustering.LIMIT) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    rank = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=rank)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        owned = [min(range(len(centroids)), key=lambda c: (dist(v, centroids[c]), c)) for _, v in kept]
        if n == rounds:
            break
        for c in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, owned, strict=True) if o == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out = [(i, c, dist(v, centroids[c]), c) for (i, v), c in zip(kept, owned, strict=True)]
    per = {c: sum(d for _, o, d, _ in out if o == c) for c in set(owned)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, per[c], sum(per.values()), sha[c]) for i, c, d, _ in out), key=str)


def vectors(n, dim, seed=3, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dim)] for _ in range(9)]
    return [(k, [float(np.float32(c + rng.gauss(0, 0.3))) for c in centres[rng.randrange(9)]]) for k in range(n)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_size(spark):
    rows = vectors(120, 64)
    assert got(clustering.clusters(frame(spark, rows))) == brute(rows)


def test_awkward(spark):
    """Nulls, wrong lengths, NaN and infinities, repeated rows and ids, null ids, ties, one vector in a third of all rows."""
    rows = vectors(60, 4, spread=0.5)
    rows += [(1000 + k, [0.5, 0.5, 0.5, 0.5]) for k in range(40)]
    rows += [(1, rows[1][1]), (1, rows[1][1]), (2, rows[9][1]), (None, rows[4][1]), (None, [0.0, 0.0, 0.0, 0.0])]
    rows += [(70, None), (71, []), (72, [1.0, 2.0, 3.0]), (73, [1.0, 2.0, 3.0, 4.0, 5.0]), (74, [1.0, None, 3.0, 4.0]), (75, [math.nan, 0.0, 0.0, 0.0]), (76, [0.0, math.inf, 0.0, -math.inf])]
    rows += [(77, [-0.001, -0.0, 1e-30, 0.015625])]
    want = brute(rows, k=7, dim=4)
    df = frame(spark, rows)
    assert got(clustering.clusters(df, k=7, dim=4)) == want
    crowd = df.selectExpr("vec_id", "embedding", "1 AS cluster", "'x' AS distance", "2 AS owner", "3 AS v", "4 AS was", "5 AS inertia")
    assert got(clustering.clusters(crowd, k=7, dim=4)) == want
    renamed = clustering.clusters(df.selectExpr("vec_id AS own", "embedding AS e"), "own", "e", k=7, dim=4)
    assert renamed.columns[0] == "own" and got(renamed) == want


def test_many_rounds_and_large_numbers(spark):
    rows = [(k, [float(np.float32(x * 70_000)) for x in v]) for k, v in vectors(80, 3)] + [(500, [3e38, -3e38, 1.0])]
    assert got(clustering.clusters(frame(spark, rows), k=5, rounds=8, dim=3)) == brute(rows, k=5, rounds=8, dim=3)


def test_few_and_none(spark):
    rows = vectors(3, 2)
    assert got(clustering.clusters(frame(spark, rows), dim=2)) == brute(rows, dim=2)
    empty = clustering.clusters(frame(spark, []))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert clustering.clusters(frame(spark, [(1, [1.0])])).count() == 0


@pytest.mark.parametrize("large", [False, True])
def test_delta_is_the_whole_comparison(large):
    rng = np.random.default_rng(4)
    size = 1 << 26 if large else 40
    v = rng.integers(-size, size, (300, 5))
    old = v[:6].copy()
    old[3] = old[2]  # a tie
    owner, distance = clustering.reassigned(v, np.full(300, -1), np.zeros(300, dtype=np.int64), old, np.ones(6, dtype=bool))
    moved = np.array([True, False, True, False, False, False])
    new = old + moved[:, None] * rng.integers(-size // 4, size // 4, (6, 5))
    for result in (clustering.reassigned(v, owner, distance, new, moved), clustering.reassigned(v, np.full(300, -1), distance, new, np.ones(6, dtype=bool))):
        whole = ((v[:, None, :] - new[None, :, :]) ** 2).sum(axis=2)
        assert (result[0] == whole.argmin(axis=1)).all() and (result[1] == whole.min(axis=1)).all()


def test_transfers_are_signed(spark):
    state = spark.createDataFrame([(1, [1, 2], 0, 0, 1), (2, [5, 6], 0, 0, 0), (3, [7, 8], 1, 0, -1), (4, [1, 1], 0, 0, 1)], clustering.STATE.format(id="long"))
    got = {(r["cluster"], r["place"]): r["n"] for r in clustering.transfers(state, 2).collect()}
    assert got == {(0, -1): 2, (0, 0): 2, (0, 1): 3, (1, -1): -1, (1, 0): 5, (1, 1): 5}
