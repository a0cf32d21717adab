import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding


def straw(seed, name, key, weight):
    bits = int(hashlib.md5(f"{seed}:{name}:{key}".encode()).hexdigest()[:13], 16)
    return -math.log((bits + 0.5) / (1 << 52)) / weight


def brute_shard(key, tree, seed=1):
    """Down the tree, level by level, from the list of its shards."""
    k = "\\N" if key is None else str(key)
    inside = [s for s in tree if s.weight > 0]
    for level, name in (("region", "region:{0.region}"), ("rack", "rack:{0.region}:{0.rack}"), ("shard", "shard:{0.shard}")):
        weight = defaultdict(float)
        for s in inside:
            weight[getattr(s, level)] += s.weight
        names = {getattr(s, level): name.format(s) for s in inside}
        best = min(sorted(weight), key=lambda c: straw(seed, names[c], k, weight[c]))
        inside = [s for s in inside if getattr(s, level) == best]
    return inside[0].shard


def check(rows, got, tree):
    want = Counter()
    for doc_id, text in rows:
        data = (text or "").encode()
        want[doc_id, len(data) + 8, zlib.crc32(data), "key", brute_shard(doc_id, tree), brute_shard(doc_id, sharding.grown(tree))] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in places.values())


def test_awkward(awkward, crowded, nothing, awkward_rows):
    rows = [(r[0], r[1]) for r in awkward_rows]
    got = sharding.placements(awkward).collect()
    check(rows, got, sharding.tree())
    assert sorted(got, key=str) == sorted(sharding.placements(crowded).collect(), key=str)
    assert sharding.placements(nothing).count() == 0


def test_slots_follow_ids_and_split_ties(spark):
    """A third of all rows are one row; no partition holds all of a shard, and slots go by id."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text")).repartition(5)
    small = sharding.tree(1, 1, 2)
    got = sharding.placements(rows, small).collect()
    check([(7 if k % 3 == 0 else k, "same") for k in range(3000)], got, small)
    for s in (0, 1):
        own = sorted((r.slot, r.doc_id) for r in got if r.shard == s)
        assert [d for _, d in own] == sorted(d for _, d in own)


@pytest.mark.parametrize("shape", [(2, 3, 4), (1, 1, 1), (3, 1, 2)])
def test_growth_takes_only_into_the_new_shard(spark, shape):
    """From the even tree and from trees that have grown before."""
    tree = sharding.tree(*shape)
    keys = spark.range(3000)
    for _ in range(3):
        more = sharding.grown(tree)
        new = more[-1].shard
        moved = keys.select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), more).alias("b")).where("a <> b").groupBy("b").count().collect()
        assert [r["b"] for r in moved] == [new]
        assert abs(moved[0]["count"] - 3000 / len(more)) < 5 * math.sqrt(3000 / len(more))
        tree = more


def test_weights_and_movement_stay_in_subtrees(spark):
    tree = sharding.tree()
    heavy = sharding.reweighted(tree, 5, 3.0)
    keys = spark.range(20_000)
    got = keys.select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), heavy).alias("b")).groupBy("a", "b").count().collect()
    at = {s.shard: s for s in tree}
    share = Counter()
    for r in got:
        share[r["b"]] += r["count"]
        if r["a"] != r["b"]:
            a, b, own = at[r["a"]], at[r["b"]], at[5]
            # Into a subtree whose weight rose: the region, or its rack, or the shard.
            assert b.region == own.region and (a.region != own.region or b.rack == own.rack) and ((a.region, a.rack) != (own.region, own.rack) or b.shard == 5)
    assert abs(share[5] - 20_000 * 3 / 26) < 5 * math.sqrt(20_000 * 3 / 26)
    assert all(abs(share[s] - 20_000 / 26) < 5 * math.sqrt(20_000 / 26) for s in range(24) if s != 5)
    none = sharding.reweighted(tree, 5, 0.0)
    left = keys.select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), none).alias("b"))
    assert left.where("b = 5").count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), sharding.reweighted(sharding.tree(1, 1, 1), 0, 0.0))


def test_texts_as_keys_keep_copies_together(awkward):
    out = sharding.with_shard(awkward, sharding.tree(), key="text")
    assert out.groupBy("text").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0


def test_written_shards(spark, awkward, tmp_path):
    sharding.write_shards(awkward, str(tmp_path / "out"), files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == awkward.count()
    assert back.select("doc_id", "shard").where(F.col("shard") != sharding.shard_of(F.col("doc_id"), sharding.tree())).count() == 0


def test_native(awkward):
    plan = sharding.placements(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
