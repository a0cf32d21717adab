import hashlib
from collections import defaultdict

import numpy as np

from tessera.llm import substrings


def brute(rows):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    least = defaultdict(lambda: float("inf"))
    for i, w in docs:
        for k in range(len(w) - 12):
            if i is not None:
                least[tuple(w[k : k + 13])] = min(least[tuple(w[k : k + 13])], i)
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and least[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i if i is not None else -1, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(df, digest=True).collect())


def test_against_brute_force(spark, awkward, awkward_rows):
    assert result(awkward) == brute([r[:2] for r in awkward_rows])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(docs) == want and sum(r[2] for r in want) > 1000


def test_hot_anchors_give_the_same(spark, awkward, monkeypatch):
    docs = awkward.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text", "lang", "source", "n_chars"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    monkeypatch.setattr(substrings, "HOT_COUNT", 2)
    assert len(substrings._hot_anchors(docs.select("text").where("text is not null and doc_id is not null"), docs.count())) > 10
    assert result(docs) == want


def test_other_shapes(crowded, nothing, awkward_rows):
    assert result(crowded) == brute([r[:2] for r in awkward_rows])
    assert substrings.dedup_substrings(nothing).count() == 0
    texts = {r.doc_id: r.text for r in substrings.dedup_substrings(crowded).collect()}
    assert texts[8] == "one two three" and texts[5] == ""


def test_every_shared_window_shares_its_anchor():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**63, 13).astype(np.uint64)
    for _ in range(50):
        a, b = (np.r_[rng.integers(0, 2**63, rng.integers(0, 20)).astype(np.uint64), shared, rng.integers(0, 2**63, 9).astype(np.uint64)] for _ in range(2))
        found = []
        for w in (a, b):
            windows = substrings.run_hashes(w, 13, seed=7)
            h, first, count = substrings.anchors_of(w)
            found.append({(int(h[k]), int(windows[s])) for k in range(len(h)) for s in range(first[k], first[k] + count[k])})
        assert found[0] & found[1]


def test_windows_that_only_meet_by_a_part_of_their_hashes_stay(spark, monkeypatch):
    """Different contexts of one anchor whose hashes agree in their low 32 bits."""
    whole = substrings.run_hashes

    def close(words, n, seed=0):
        h = whole(words, n, seed)
        return h & np.uint64(0xFFFFFFFF00000000) if n == substrings.LENGTH else h

    # A phrase that is the anchor of all windows that hold it: the one of least hash among many.
    phrase = min((f"one phrase of {k} words" for k in range(2000)), key=lambda x: substrings.run_hashes(substrings.word_hashes(x), substrings.ANCHOR)[0])
    rows = [(i, " ".join([f"l{i}x{k}" for k in range(8)] + phrase.split() + [f"r{i}x{k}" for k in range(8)])) for i in range(9)]
    rows += [(20, rows[3][1]), (21, "x " + rows[3][1][:-6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    windows = substrings._windows

    def patched(*a):
        def run(batches):
            substrings.run_hashes = close
            try:
                yield from windows(*a)(batches)
            finally:
                substrings.run_hashes = whole

        return run

    monkeypatch.setattr(substrings, "_windows", patched)
    assert result(docs) == brute(rows)


def test_hot_routes_are_bounded(spark, monkeypatch):
    """Of two frequent passages only one is taken as hot; both are found."""
    monkeypatch.setattr(substrings, "HOT_COUNT", 3)
    monkeypatch.setattr(substrings, "HOT_MOST", 2)
    a, b = (" ".join(f"{x}{k}" for k in range(20)) for x in "ab")
    rows = [(i, f"x{i} {a} y{i} {b} z{i}") for i in range(40)] + [(100, f"{b} {a}"), (100, b), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(substrings._hot_anchors(docs.select("text"), 43)) == 2
    assert result(docs) == brute(rows)
