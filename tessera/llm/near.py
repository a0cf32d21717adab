"""N-gram Jaccard join by MinHash banding, and near-duplicate groups.

A document is the set of its 5-word n-grams (one n-gram of all its words if they are fewer). Documents
with equal sets are a class and are compared once, by a representative. Each class has a MinHash
signature in bands whose number and height are chosen for a recall at the threshold; classes meet by
band hash. Candidates are verified on their whole n-gram sets.

Candidate buckets aren't expanded into pairs of rows. A bucket that comes in several bands with the
same members is kept once; one of over BLOCK members, or BLOCK_GRAMS n-grams, is cut into blocks and
every two blocks are a task. A task holds at most two blocks, compares its candidates there and returns
a row for each member: how many documents it is linked to, and one link to join it to its group. A pair
that shares several bands counts in the first of them alone. So every verified pair counts once and rows
stay in proportion to members.

Defined cases: documents without words (null, empty) aren't compared: each is its own class without
links; equal texts are always linked; very long texts are taken whole; rows are told apart by id and
text, so repeated ids with other words, and rows without an id, are compared like others; ties go to the
smallest id; a class is named by its smallest id, and has no name if none of its rows has one; an empty
table gives an empty result; other columns are passed on unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.hashing import mixed, run_hashes, word_hashes

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 96
BLOCK = 512
BLOCK_GRAMS = 1 << 19
#: Documents that are signed at a time, which bounds what a worker holds.
ROWS = 256
#: A vertex is a hub from this many edges on, or from this share of all: so there are at most 2 / HUB_SHARE hubs.
HUB, HUB_SHARE = 5_000, 1 / 50_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the tallest bands that find a pair at the threshold with this probability by at most ``most`` hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def ngrams(text: str | None, n: int = NGRAM) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-grams."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    return np.unique(run_hashes(words, min(n, len(words)), seed=len(words) if len(words) < n else 0))


def _band_hashes(grams: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), 8192):  # bounded memory for very long texts
        x = grams[at : at + 8192, None] * a + b
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0), out=least)
    out = np.zeros(len(a) // rows, dtype=np.uint64)
    for r in range(rows):
        out = mixed(out * np.uint64(31) + least.reshape(-1, rows)[:, r])
    return out


def _key(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _sign(n: int, bands: int, rows: int):
    rng = np.random.default_rng(9)
    a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    none = np.empty(0, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keys, hashes, sizes, last = [], [], [], {}
            for text in batch.column(2):
                g = ngrams(text.as_py(), n)
                k = _key(g) if len(g) else None
                if k is not None and k not in last:  # copies in a batch are signed once
                    last[k] = _band_hashes(g, a, b, rows).view(np.int64)
                keys.append(k)
                sizes.append(len(g))
                hashes.append(last.get(k, none))
            flat = np.concatenate([none, *hashes])
            ends = np.cumsum([0, *map(len, hashes)], dtype=np.int32)
            made = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.record_batch([batch.column(0), batch.column(1), *made], names=["doc_id", "h", "key", "size", "bands"])

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (whole.slice(a, ROWS) for whole in batches for a in range(0, len(whole), ROWS))


def _sets(n: int):
    """(v, grams) of rows (v, text); copies in a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            raw = {}
            for v, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if v not in raw:
                    raw[v] = ngrams(text.as_py(), n).tobytes()
            yield pa.record_batch([pa.array(raw.keys(), pa.int64()), pa.array(raw.values(), pa.binary())], names=["v", "grams"])

    return run


def _verify(members: list[tuple], threshold: float, band: int) -> list[tuple]:
    """(v, documents linked, least v that it is joined to) of the linked members of one task.

    members: (v, documents, side, bands, grams); side 0 and 1 are the task's two blocks, 2 its only one."""
    members = list({m[0]: m for m in members}.values())
    bands = np.array([m[3] for m in members], dtype=np.int64)
    sets = [np.frombuffer(m[4], dtype=np.uint64) for m in members]
    sizes = np.array([len(s) for s in sets])
    docs = np.array([m[1] for m in members])
    side = np.array([m[2] for m in members])
    # Postings of n-grams that two members or more have: intersections are counted list by list.
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(gram, kind="stable")
    starts = np.searchsorted(gram[order], np.arange(gram.max() + 2))
    posted, ends = owner[order], np.cumsum(sizes)
    linked, label = np.zeros(len(sets), dtype=np.int64), np.arange(len(sets))
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        j = j[(side[j] != side[i]) | (side[j] == 2)]
        j = j[(bands[j] == bands[i]).argmax(axis=1) == band]  # the first band that they share is this one
        j = j[np.minimum(sizes[j], sizes[i]) >= threshold * np.maximum(sizes[j], sizes[i]) - 1e-9]
        if not len(j):
            continue
        own = gram[ends[i] - sizes[i] : ends[i]]
        own = own[starts[own + 1] - starts[own] > 1]
        lists = [posted[a:b] for a, b in zip(starts[own].tolist(), starts[own + 1].tolist(), strict=True)]
        both = np.bincount(np.concatenate(lists), minlength=len(sets))[j] if lists else np.zeros(len(j), dtype=np.int64)
        j = j[both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9]
        if len(j):
            linked[i] += docs[j].sum()
            linked[j] += docs[i]
            met = np.unique(label[np.r_[i, j]])
            label[np.isin(label, met)] = met[0]
    least: dict[int, int] = {}
    for m, x in zip(members, label.tolist(), strict=True):
        least[x] = min(least.get(x, m[0]), m[0])
    return [(m[0], int(n), least[x]) for m, n, x in zip(members, linked, label.tolist(), strict=True) if n]


def _verify_tasks(threshold: float):
    """Reads rows sorted by task (band, hash, p, q), of which it holds one task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, members = None, []

        def result() -> pa.RecordBatch:
            rows = _verify(members, threshold, task[0]) if len(members) > 1 else []
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["v", "linked", "least"])

        for batch in _slices(batches):
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols, strict=True):
                if row[:4] != task:
                    if members:
                        yield result()
                    task, members = row[:4], []
                members.append(row[4:])
        if members:
            yield result()

    return run


def _with_least(edges: DataFrame, least: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """``edges`` with the ``m`` of their ``a``. Edges of hubs stay where they are."""
    if hubs is None:
        return edges.join(least, "a")
    own = edges.join(F.broadcast(least.join(F.broadcast(hubs), "a", "left_semi").select(F.col("a").alias("_a"), F.col("m").alias("_m"))), F.col("a") == F.col("_a"), "left")
    return own.where("_a is null").select("a", "b").join(least, "a").unionByName(own.where("_a is not null").select("a", "b", F.col("_m").alias("m")))


def connected(edges: DataFrame) -> DataFrame:
    """(v, least): each vertex of ``edges`` (a, b: long) with the least vertex of its component.

    Alternates large-star and small-star steps until the edges stay as they are; each step is a
    grouping and a join, and only counts come to the driver. Hubs are joined without moving their edges."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state, n = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hubs = None
        if n > HUB:
            hubs = cut(both.groupBy("a").count().where(F.col("count") > max(HUB, int(2 * n * HUB_SHARE))).select("a"))
            hubs = None if hubs.isEmpty() else hubs
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = _with_least(both, least, hubs).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")  # after the first step a vertex has its own label and those of its neighbours here
        edges = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b")).where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state, n = now, now[0]
    roots = edges.select(F.col("b").alias("v")).distinct()
    return edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("least")).unionByName(roots.select("v", F.col("v").alias("least")))


def _classified(docs: DataFrame, doc_id: str, text: str, n: int, threshold: float, recall: float, block: int) -> DataFrame:
    """One row a document: doc_id, h (a hash of its text), class_id, first (id and h of the group's first row), copy_class_id, n_links."""
    bands, rows = choose_bands(threshold, recall)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    signed = cut(own.mapInArrow(_sign(n, bands, rows), "doc_id long, h long, key binary, size long, bands array<long>"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")  # rows without an id come last
    classes = signed.where("key is not null").groupBy("key").agg(F.min(order).alias("rep"), F.count("*").alias("docs"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("v", F.monotonically_increasing_id()))
    # Buckets of two classes or more; those with the same members in several bands once, in the first band.
    banded = classes.select("v", "size", F.posexplode("bands").alias("band", "hash"))
    members = [F.bit_xor(F.xxhash64(F.lit(i), F.col("v"))).alias(f"x{i}") for i in (1, 2)]
    buckets = banded.groupBy("band", "hash").agg(F.count("*").alias("n"), F.sum("size").alias("grams"), *members).where("n > 1")
    buckets = buckets.groupBy("n", "grams", "x1", "x2").agg(F.min(F.struct("band", "hash")).alias("b")).select("b.band", "b.hash", "n", "grams")
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    dealt = banded.join(buckets, ["band", "hash"]).select("band", "hash", "v", blocks.alias("blocks"), F.pmod(F.xxhash64("v"), blocks).cast("int").alias("own"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    tasks = cut(met.select("band", "hash", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "v", side.alias("side")))
    # The n-gram sets of the classes that meet another, from their representatives' texts.
    needed = tasks.select("v").distinct().join(classes.select("v", F.col("rep.doc_id").alias("_id"), F.col("rep.h").alias("_h")), "v")
    texts = own.join(needed, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("v", "text")
    sets = texts.mapInArrow(_sets(n), "v long, grams binary")
    by = ["band", "hash", "p", "q"]
    full = tasks.join(classes.select("v", "docs", "bands"), "v").join(sets, "v").select(*by, "v", "docs", "side", "bands", "grams")
    verified = cut(full.repartition(*by).sortWithinPartitions(*by).mapInArrow(_verify_tasks(threshold), "v long, linked long, least long"))
    links = verified.groupBy("v").agg(F.sum("linked").alias("linked"))
    groups = connected(verified.select(F.col("v").alias("a"), F.col("least").alias("b")))
    labelled = classes.select("v", "key", "rep", "docs").join(links, "v", "left").join(groups, "v", "left").withColumn("group", F.coalesce("least", "v"))
    first = labelled.groupBy("group").agg(F.min("rep").alias("first"))
    named = labelled.join(first, "group").select("key", "rep", "first", (F.col("docs") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return (
        signed.select("doc_id", "h", "key")
        .join(named, "key", "left")
        .select("doc_id", "h", "key", "first", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("copy_class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """One row a document: doc_id, class_id, copy_class_id, n_links.

    class_id is the least doc_id of the documents that links lead to, copy_class_id that of the
    documents with equal n-gram sets; n_links counts the other documents of similarity ``threshold``
    or more, copies included."""
    return _classified(docs, doc_id, text, n, threshold, recall, block).select("doc_id", "class_id", "copy_class_id", "n_links")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` without those that a near duplicate of a smaller id, or an equal row, stands for.

    Of rows without an id those of the least text hash come first. Rows without words stay, those with an id once."""
    classes = _classified(docs, doc_id, text, n, threshold, recall, block)
    # Rows that stay, by id and text, and how often they come.
    first = F.col("key").isNull() | ((F.col("first.h") == F.col("h")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id")))
    stay = cut(classes.where(first).groupBy("doc_id", "h", F.col("key").isNull().alias("blank")).count())
    stay = stay.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), ((F.col("count") > 1) & ~(F.col("blank") & F.col("doc_id").isNull())).alias("_many"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("h"))
    kept = rows.join(stay, (F.col("h") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_id")))
    if stay.where("_many").isEmpty():
        return kept.select("row.*")
    once = kept.where("_many").groupBy("id", "h").agg(F.first("row").alias("row"))  # equal rows meet in each task before they move
    return kept.where("not _many").select("row").unionByName(once.select("row")).select("row.*")
