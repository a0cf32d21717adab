import itertools
import random

from tessera.llm import near

THRESHOLD = 0.8


def grams(t):
    w = (t or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(doc_id, class_id, n_links) of all rows, by all pairs."""
    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))
    links = [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and both >= THRESHOLD * len(sets[i] | sets[j]) - 1e-9:
            links[i] += 1
            links[j] += 1
            up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), float("inf")), float("inf") if d is None else d)
    name = lambda i: least[root(i)] if least[root(i)] != float("inf") else None
    return sorted(((d, name(i), links[i]) for i, (d, _) in enumerate(rows)), key=str)


def result(df, **options):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in near.near_duplicates(df, **options).collect()), key=str)


def test_bands():
    b, r = near.choose_bands()
    assert b * r <= near.MOST_HASHES and 1 - (1 - 0.8**r) ** b >= 0.9999


def test_awkward(awkward, crowded, nothing, awkward_rows):
    assert result(awkward) == brute([r[:2] for r in awkward_rows])
    assert result(crowded) == brute([r[:2] for r in awkward_rows])
    assert result(nothing) == []


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(docs) == want and any(r[2] for r in want)


def test_blocks_lose_no_link(spark):
    """A crowd of near copies of one text, over many blocks: each link counts once."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(90):
        w = base[:]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, block=16) == brute(rows)


def test_one_of_each_stays(crowded, nothing):
    kept = near.keep_one_of_each(crowded)
    assert kept.columns == crowded.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    assert ids.count(None) == 1  # of those without an id one is a copy of document 1
    assert near.keep_one_of_each(nothing).count() == 0


def test_rows_are_told_apart_by_id_and_text(spark):
    """Links between rows without ids are found; of a repeated id only the copy goes."""
    base = [f"w{i}" for i in range(60)]
    near_base = [*base[:59], "x"]
    other = [f"v{i}" for i in range(60)]
    rows = [(None, base), (None, near_base), (5, other), (5, base[::-1]), (3, base[::-1]), (None, other[:40]), (None, other[:40]), (None, None), (None, None), (8, None), (8, None)]
    df = spark.createDataFrame([(d, None if w is None else " ".join(w)) for d, w in rows], "doc_id long, text string")
    assert result(df) == brute([(r.doc_id, r.text) for r in df.collect()])
    kept = [(r.doc_id, r.text) for r in near.keep_one_of_each(df).collect()]
    assert sorted(t for d, t in kept if d is not None and t) == sorted(map(" ".join, (other, base[::-1]))) and (3, " ".join(base[::-1])) in kept
    assert [t for d, t in kept if d is None].count(" ".join(other[:40])) == 1
    assert len([t for d, t in kept if d is None and t]) == 2 and kept.count((None, None)) == 2 and kept.count((8, None)) == 1


def test_hubs(spark, monkeypatch):
    monkeypatch.setattr(near, "HUB", 10)
    edges = [(1000, k) for k in range(1, 60)] + [(60 + k, 2000) for k in range(40)] + [(2000, 3), (500, 501)] + [(200 + i, 201 + i) for i in range(20)]
    got = {r.v: r.least for r in near.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == 1 for x in (1000, 2000, 59, 60, 99)) and got[501] == 500 and got[220] == 200


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (8, 8)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.v: r.least for r in near.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[x] for x in (1, 2, 3, 9)} == {1} and got[6] == 5 and {got[100 + i] for i in range(31)} == {100} and 8 not in got
