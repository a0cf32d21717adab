import re
from collections import Counter

import pytest

from tessera.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share >= most * sizes[s]}
        if not over:
            out |= {s: weight[s] * share for s in open_}
            break
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(rows, got):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = brute_targets(sizes)
    assert sorted((r.size, r.source_size) for r in got) == sorted((size(t), sizes[s]) for _, t, s in rows)
    for r in got:
        assert any(abs(r.target - want[s]) < 1e-6 and sizes[s] == r.source_size for s in sizes)
        assert r.taken % r.size == 0 if r.size else r.taken == 0
        rate = r.target / r.source_size if r.source_size else 0
        assert int(rate) * r.size <= r.taken <= min(3, int(rate) + 1) * r.size
    return sizes, want


def test_awkward(awkward, crowded, nothing, awkward_rows):
    rows = [(r[0], r[1], r[3]) for r in awkward_rows]
    check(rows, mixing.mix_plan(awkward).collect())
    plan = sorted(map(tuple, mixing.mix_plan(awkward).collect()), key=str)
    assert plan == sorted(map(tuple, mixing.mix_plan(crowded).collect()), key=str)
    mixed = mixing.mix(crowded)
    assert mixed.columns == crowded.columns and mixed.count() == sum(r[-1] for r in plan)
    assert mixing.mix(nothing).count() == 0


def test_many_sources_are_salted(awkward, crowded, monkeypatch):
    plan = sorted(map(tuple, mixing.mix_plan(awkward).collect()), key=str)
    mixed = sorted(map(str, mixing.mix(crowded).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted(map(tuple, mixing.mix_plan(awkward).collect()), key=str) == plan
    assert sorted(map(str, mixing.mix(crowded).collect())) == mixed


def test_documents_stay_where_they_are(awkward):
    plan = mixing.mix(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("BuildRight") >= 1 and "BuildLeft" not in plan


def test_targets_are_met(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = mixing.mix_plan(docs).collect()
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], got)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[s] - target[s]) < 0.2 * target[s] for s in taken)
    assert abs(sum(taken.values()) - sum(target.values())) < 0.03 * sum(target.values())


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 1000, "c": 1000, None: 5}, {"z": 3}, {"a": 0, "b": 0}, {f"s{i:03}": (i * 37) % 101 for i in range(200)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(4)
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)
