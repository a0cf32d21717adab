"""Mixing sources to target weights.

Sizes are summed for each source and targets derived from weights; the rate of a source is its
target over its size. Every document is taken floor(rate) times, and once more if a coin seeded by
a hash of its id and text falls under the fraction. So reruns agree and no task needs to see a
whole source.

The table of sources isn't assumed small: it is ranked by range partitions and its targets come from
sums. It is counted, and goes to the documents where it is small; so no text travels. Only beyond that
documents are dealt out, by source and salt.

Defined cases: a null text has size 0; a null source is a source, ranked last; documents without an
id are mixed like others; repeated rows fall alike; a source of size 0 has target 0; an empty table
gives an empty result; other columns are passed on unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, word_count

MAX_REPEATS = 3
#: Most sources that are sent to every task (a row of three numbers and a name each), and the salts of a source beyond.
BROADCAST_SOURCES = 100_000
SALTS = 64
SEED = 20


def ranked(sources: DataFrame, key: str) -> DataFrame:
    """``sources`` with ``rank``: the place of ``key`` from 0, nulls last, without one task for all rows."""
    rows = cut(sources.repartitionByRange(F.col(key).asc_nulls_last()).sortWithinPartitions(F.col(key).asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("part")).count()
    # One row a partition: the partitions before it are summed by a join of these few rows.
    before = counts.alias("a").join(counts.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("before"))
    place = F.col("at") - F.shiftleft(F.col("part"), 33)
    return rows.withColumn("part", part).join(before, "part").withColumn("rank", F.col("before") + place).drop("part", "before", "at")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: float = MAX_REPEATS) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``.

    Sources by code point, null last, weigh ``weights``, repeating. The total is dealt by weight; a
    source gets ``max_repeats`` times its size at most, and what it can't take is dealt again."""
    rank = F.col("rank") % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    t = cut(ranked(sizes, "source").withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats))))
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words for each unit of weight; it only rises, and each round caps another source
    while True:
        capped = F.col("cap") <= F.col("weight") * level
        taken, free = t.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not free:
            break
        raised = (total - (taken or 0)) / free
        if raised <= level:
            break
        level = raised
    return t.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def copies(rate: Column, *identity: Column, seed: int = SEED) -> Column:
    """floor(rate), and one more with the fraction's probability by a hash of ``identity``.

    The coin is the first 52 bits of an MD5, so that any engine can toss it again."""
    parts = [F.coalesce(c.cast("string"), F.lit("\\N")) for c in (F.lit(seed), *identity)]
    coin = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return (F.floor(rate) + F.when(coin < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _with_targets(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """``sized`` with its sources' targets. Up to BROADCAST_SOURCES sources (counted first) go to every task, so that no
    row moves; more are joined by source and salt, so that a source may have any share of the rows."""
    goals = goals.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if goals.count() <= BROADCAST_SOURCES:
        return sized.join(F.broadcast(goals), same)
    spread = goals.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_own"))
    salted = sized.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_h"), F.lit(SALTS)).cast("int"))
    return salted.join(spread.hint("merge"), same & (F.col("_salt") == F.col("_own")))


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: bool = False, **options) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (and ``copies``; with ``row``, a struct of its columns)."""
    own = [F.struct("*").alias("row")] if row else []
    sized = docs.select(*own, F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_h"))
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **options)
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    out = _with_targets(sized, goals).withColumn("copies", copies(rate, F.col("doc_id"), F.col("_h")))
    return out.select(*(["row"] if row else []), "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row as often as it is taken, with the columns of ``docs``."""
    plan = mix_plan(docs, row=True, **options).where("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("row.*")
