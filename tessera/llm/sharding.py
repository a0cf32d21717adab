"""Sharding by a hierarchical weighted hash tree: regions, racks, shards.

A key descends from the root: among the children of a node each draws a straw from a hash of the key and
the child's name, -ln(u) / weight, and the shortest wins. So a child gets its share of the weight, and
since straws of other children don't depend on a child's weight, raising it moves keys only into it and
lowering it only out of it: what happens below nodes whose weights stay is the same as before. A node's
weight is the sum of its shards' weights.

Growth (``grown``) gives a new shard a region of its own, so that one more shard takes keys only into
itself. ``reweighted`` changes a shard where it is: then keys may move within the subtrees above it, as
their weights change too, and between no others.

The law is ``key``: the key and the tree decide alone. Equal keys share a shard, so a key with a third of
all rows makes a large shard; that is what the law says. Rows never meet in one task, though: places in
shards (``slots``) come from range partitions of slim rows, ties split by their place in the input, and
from counts of these partitions.

Column expressions only. Defined cases: a null key is a key; a null text has no bytes (size 8, checksum
0); rows alike in every column get neighbouring slots; an empty table gives an empty result; other
columns are passed on unread; a shard of weight 0 gets nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Bytes that a row takes beside its text.
ROW_BYTES = 8
SEED = 1
REGIONS, RACKS, SHARDS = 2, 3, 4


@dataclass(frozen=True)
class Shard:
    shard: int
    region: int
    rack: int
    weight: float = 1.0


#: A tree is the list of its shards; its size is a parameter of the run, not of the data.
Tree = tuple[Shard, ...]


def tree(regions: int = REGIONS, racks: int = RACKS, shards: int = SHARDS) -> Tree:
    """An even tree: ``regions`` of ``racks`` racks of ``shards`` shards, numbered through from 0."""
    return tuple(Shard(n, n // (racks * shards), n // shards % racks) for n in range(regions * racks * shards))


def grown(t: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, alone in a region of its own."""
    return (*t, Shard(max((s.shard for s in t), default=-1) + 1, max((s.region for s in t), default=-1) + 1, 0, weight))


def reweighted(t: Tree, shard: int, weight: float) -> Tree:
    return tuple(replace(s, weight=weight) if s.shard == shard else s for s in t)


def children(t: Tree) -> tuple[dict, dict, dict]:
    """The weights of regions; of racks by region; of shards by region and rack. Nodes of weight 0 are left out."""
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    shards: dict[tuple[int, int], dict[int, float]] = {}
    for s in sorted((s for s in t if s.weight > 0), key=lambda s: (s.region, s.rack, s.shard)):
        regions[s.region] = regions.get(s.region, 0.0) + s.weight
        own = racks.setdefault(s.region, {})
        own[s.rack] = own.get(s.rack, 0.0) + s.weight
        shards.setdefault((s.region, s.rack), {})[s.shard] = s.weight
    return regions, racks, shards


def _straw(key: Column, name: str, weight: float, seed: int) -> Column:
    """-ln(u) / weight, with u from the first 52 bits of an MD5, so that any engine can draw it again."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{name}:"), key)), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / float(1 << 52)) / weight


def _winner(key: Column, names: dict[int, str], weights: dict[int, float], seed: int) -> Column:
    """The child with the shortest straw; of equal ones the first. Nothing is drawn for an only child."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    straws = [F.struct(_straw(key, names[c], w, seed).alias("straw"), F.lit(c).alias("child")) for c, w in weights.items()]
    return F.array_min(F.array(*straws))["child"]


def _chosen(by: Column, options: dict[int, Column]) -> Column:
    """The option of the node that won; only its own children draw."""
    (first, column), *rest = options.items()
    out = F.when(by == first, column)
    for node, column in rest:
        out = out.when(by == node, column)
    return out


def shard_of(key: Column, t: Tree, seed: int = SEED) -> Column:
    """The shard (int) of a key, null being a key of its own."""
    regions, racks, shards = children(t)
    if not regions:
        raise ValueError("a tree needs a shard with a weight")
    k = F.coalesce(key.cast("string"), F.lit("\\N"))
    region = _winner(k, {r: f"region:{r}" for r in regions}, regions, seed)
    below = {}
    for r, own in racks.items():
        rack = _winner(k, {c: f"rack:{r}:{c}" for c in own}, own, seed)
        below[r] = _chosen(rack, {c: _winner(k, {s: f"shard:{s}" for s in shards[r, c]}, shards[r, c], seed) for c in own})
    return _chosen(region, below).cast("int")


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def with_shard(docs: DataFrame, t: Tree, key: str = "doc_id", out: str = "shard", seed: int = SEED) -> DataFrame:
    """The rows with their shard, replacing a column of that name. Nothing is shuffled."""
    return docs.withColumn(out, shard_of(F.col(f"`{key}`"), t, seed))


def slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """``rows`` with ``slot``: the place in the shard by ``order``, gapless from 0.

    Rows are dealt by range of (shard, order, place in the input), so a range has few shards, each of them in
    one piece; a piece starts where those of its shard before it end. Pieces are as many as partitions and
    shards at most, so they go to every task. Rows should be slim, as they are written once."""
    keys = [F.col(f"`{c}`").asc_nulls_last() for c in (shard, *order)]
    tied = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{shard}`").alias("shard"), *[F.col(f"`{c}`").alias(f"by{n}") for n, c in enumerate(order)], F.monotonically_increasing_id().alias("tie"))
    own = [F.col(c).asc_nulls_last() for c in ("shard", *[f"by{n}" for n in range(len(keys) - 1)], "tie")]
    placed = cut(tied.repartitionByRange(*own).sortWithinPartitions(*own).select("row", "shard", F.monotonically_increasing_id().alias("at")))
    pieces = placed.groupBy(F.shiftright("at", 33).alias("part"), "shard").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    a, b = pieces.alias("a"), pieces.alias("b")
    same = F.col("a.shard").eqNullSafe(F.col("b.shard")) & (F.col("b.part") < F.col("a.part"))
    before = a.join(b, same, "left").groupBy("a.part", "a.shard").agg(F.first("a.first").alias("first"), F.coalesce(F.sum("b.rows"), F.lit(0)).alias("before"))
    starts = before.select(F.col("part").alias("_part"), F.col("shard").alias("_shard"), "first", "before")
    met = placed.join(F.broadcast(starts), (F.shiftright("at", 33) == F.col("_part")) & F.col("shard").eqNullSafe(F.col("_shard")))
    return met.select("row.*", (F.col("before") + F.col("at") - F.col("first")).alias("slot"))


def placements(docs: DataFrame, t: Tree | None = None, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Slim rows: the key, size, text_crc32, law, shard, slot, and grown_shard, the shard with one more."""
    t = tree() if t is None else t
    own, whole = F.col(f"`{key}`"), F.col(f"`{text}`")
    crc = F.crc32(F.coalesce(whole, F.lit("")).cast("binary"))
    slim = docs.select(own.alias(key), size_of(whole).alias("size"), crc.alias("text_crc32"), shard_of(own, t, seed).alias("shard"), shard_of(own, grown(t), seed).alias("grown_shard"))
    out = slots(slim, "shard", [key, "text_crc32", "size"])
    return out.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, t: Tree | None = None, key: str = "doc_id", files: int = 4, seed: int = SEED) -> None:
    """Parquet folders ``shard=N`` of about ``files`` files each; a large shard is written by as many tasks."""
    t = tree() if t is None else t
    dealt = with_shard(docs, t, key, seed=seed).withColumn("_file", F.pmod(F.monotonically_increasing_id(), F.lit(files)))
    dealt.repartition(len(t) * files, "shard", "_file").drop("_file").write.partitionBy("shard").parquet(path)
