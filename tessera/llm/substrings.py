"""Substring deduplication: seed at winnowed anchors, extend both ways, keep repeats of 13 words or more.

The anchor of a window of 13 words is the run of 5 words in it with the least hash, so documents
that share a window share its anchor, at the same place in it; there are about a fifth as many anchors
as words. Seeds: documents are dealt out by the hashes of their anchors alone, and those that two
documents or more have go back to their texts. Extension: there each shared anchor is extended to the
left and right into the windows that it is the anchor of, as whole 64-bit hashes, and windows meet
within their anchor. A window that also starts in an earlier document is a repeat; repeats that overlap
join into maximal ones in the last pass.

Hot anchors (found on a bounded sample of documents, which decides only the route) need no seeds, as
they are shared for certain. Their windows meet one by one: groups are salted, each salt finds its first
document, and these few meet again. So no task holds a whole hot group.

Defined cases: a null or empty text has no words; texts of fewer than 13 words keep all; very long
texts are handled whole; equal ids aren't smaller than each other, so repeated rows alone remove
nothing; a document without an id neither removes nor loses words; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.hashing import mixed, run_hashes, word_hashes

LENGTH = 13
ANCHOR = 5
SALTS = 64
#: Documents for which rows are made at a time, which bounds what a worker holds.
ROWS = 256
#: Anchors are hot from this many documents of the sample on, the most frequent HOT_MOST at most; the others take the
#: way of all anchors, which is exact as well.
SAMPLE_SHARE, SAMPLE_LEAST, SAMPLE_MOST, HOT_COUNT, HOT_MOST = 0.01, 2000, 200_000, 20, 200_000


def anchors_of(words: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor that windows of a text have: its hash, the first of its windows, how many follow (itself included)."""
    size = len(words) - length + 1
    if size <= 0:
        none = np.empty(0, dtype=np.int64)
        return np.empty(0, dtype=np.uint64), none, none
    runs = run_hashes(words, anchor)
    least, at = runs[:size].copy(), np.zeros(size, dtype=np.int64)
    for k in range(1, length - anchor + 1):
        lower = runs[k : k + size] < least
        np.copyto(least, runs[k : k + size], where=lower)
        at[lower] = k
    at += np.arange(size)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return runs[at[first]], first, np.diff(np.r_[first, size])


def _among(h: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``h`` are in ``some``, which is sorted."""
    if not len(some):
        return np.zeros(len(h), dtype=bool)
    return some[np.minimum(np.searchsorted(some, h), len(some) - 1)] == h


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (whole.slice(a, ROWS) for whole in batches for a in range(0, len(whole), ROWS))


def _repeated(batch: pa.RecordBatch, n_keys: int, counts: list[int]) -> list[pa.Array]:
    """The key columns of ``batch``, each row as often as ``counts`` says."""
    rows = pa.array(np.repeat(np.arange(len(batch), dtype=np.int32), counts))
    return [c.take(rows) for c in batch.columns[:n_keys]]


def _seeds(hot: np.ndarray, keys: list[str]):
    """Rows (text last) to the hashes of their anchors. A document with hot ones has one marked row for them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            hs, marks, counts = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=bool)], []
            for text in batch.column(len(keys)):
                words = word_hashes(text.as_py())
                h = np.unique(anchors_of(words)[0])
                known = _among(h, hot)
                h, mark = h[~known], known.any()
                if mark:
                    h = np.r_[h, words[:1]]  # any number that spreads such rows
                marks.append(np.arange(len(h)) == (len(h) - 1 if mark else -1))
                hs.append(h)
                counts.append(len(h))
            yield pa.record_batch([*_repeated(batch, len(keys), counts), np.concatenate(hs).view(np.int64), np.concatenate(marks)], names=[*keys, "h", "hot"])

    return run


def _hot_anchors(texts: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of the anchors that are frequent in a sample of ``texts`` (text last), which has ``n`` rows."""
    most = min(SAMPLE_MOST, max(SAMPLE_LEAST, int(n * SAMPLE_SHARE)))
    some = texts if n <= most else texts.sample(most / n, seed=3)
    counts = some.select("text").mapInArrow(_seeds(np.empty(0, dtype=np.uint64), []), "h long, hot boolean").groupBy("h").count().where(F.col("count") >= HOT_COUNT)
    return np.sort(np.array([r["h"] for r in counts.orderBy(F.desc("count"), "h").limit(HOT_MOST).collect()], dtype=np.int64).view(np.uint64))


def _windows(hot: np.ndarray, keys: list[str]):
    """Rows (text and shared anchors last) to the windows that extend them: runs of them by anchor, those of hot anchors
    one by one, by a hash of window and salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            groups, starts, hots, runs, counts = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)], [], [np.empty(0, dtype=np.uint64)], []
            sizes = [np.zeros(1, dtype=np.int64)]
            for doc, text, shared in zip(*[batch.column(k) for k in (0, len(keys), len(keys) + 1)], strict=True):
                if not shared.is_valid:
                    counts.append(0)
                    continue
                words = word_hashes(text.as_py())
                h, first, n = anchors_of(words)
                windows = run_hashes(words, LENGTH, seed=7)
                known = _among(h, hot)
                cold = ~known & _among(h, np.sort(shared.values.to_numpy().view(np.uint64)))
                single = np.repeat(known, n)  # windows of hot anchors
                groups += [h[cold], mixed(windows[single] + np.uint64(doc.as_py() % SALTS))]
                starts += [first[cold], np.flatnonzero(single)]
                sizes += [n[cold], np.ones(single.sum(), dtype=np.int64)]
                runs += [windows[np.repeat(cold, n)], windows[single]]
                hots += [False] * int(cold.sum()) + [True] * int(single.sum())
                counts.append(int(cold.sum() + single.sum()))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(runs).view(np.int64)))
            yield pa.record_batch([*_repeated(batch, len(keys), counts), np.concatenate(groups).view(np.int64), np.concatenate(starts).astype(np.int32), pa.array(hots, pa.bool_()), lists], names=[*keys, "g", "start", "hot", "windows"])

    return run


def _with_list(docs: DataFrame, rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``docs`` with a list of ``column`` of their rows. The same join each time, so that texts are dealt out once."""
    return docs.join(rows.groupBy(*keys).agg(F.collect_list(column).alias("own")), keys, "left").select(*keys, "text", "own")


def repeated_windows(docs: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, start) of every window of ``docs`` (keys, text; ``n`` rows) that also starts in a smaller doc_id.

    ``keys`` tell rows apart: doc_id, or doc_id and row."""
    texts = docs.where("text is not null and doc_id is not null").select(*keys, "text")
    hot = _hot_anchors(texts, n)
    named = ", ".join(f"{k} long" for k in keys)
    seeds = texts.mapInArrow(_seeds(hot, keys), f"{named}, h long, hot boolean")
    group = Window.partitionBy("h")
    cold = F.when(~F.col("hot"), F.col("doc_id"))
    shared = seeds.withColumn("a", F.min(cold).over(group)).withColumn("b", F.max(cold).over(group)).where("hot or a < b")
    found = _with_list(docs, shared, keys, "h").mapInArrow(_windows(hot, keys), f"{named}, g long, start int, hot boolean, windows array<long>")
    each = found.repartition("g").select(*keys, "g", "hot", "start", F.posexplode("windows").alias("i", "window")).withColumn("start", F.col("start") + F.col("i"))
    local = each.withColumn("first", F.min("doc_id").over(Window.partitionBy("g", "window")))
    # Both routes read the same columns, so that the stage below is made once for them.
    out = local.where("doc_id > first and hot is not null").select(*keys, "start")
    if len(hot):  # each salt's first documents meet again
        met = local.where("hot and doc_id = first").withColumn("least", F.min("doc_id").over(Window.partitionBy("window")))
        out = out.unionByName(met.where("doc_id > least").select(*keys, "start"))
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        out = []
        for doc, text, starts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            words = (text.as_py() or "").encode().split()
            n = len(words)
            if starts.is_valid and len(starts):
                gone = np.zeros(n + 1, dtype=np.int64)
                at = np.unique(starts.values.to_numpy())
                np.add.at(gone, at, 1)
                np.add.at(gone, at + LENGTH, -1)
                keep = np.cumsum(gone[:n]) == 0
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            out.append((doc, n, n - len(words), b" ".join(words)))
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array([x.decode() for x in cols[3]], pa.large_string())], names=["doc_id", "n_words", "n_removed", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _kept(batches):
        sha = [hashlib.sha256(x.as_py().encode()).hexdigest() for x in b.column(3)]
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """For each document: doc_id, n_words, n_removed, and its kept words as ``text`` (``kept_sha256`` with ``digest``).

    Places belong to rows, so where ids repeat, rows are told apart by a hash of their texts."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n, distinct = own.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    keys = ["doc_id"] if distinct == n else ["doc_id", "row"]
    if len(keys) > 1:
        own = own.withColumn("row", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")))
    joined = _with_list(own, repeated_windows(own, keys, n), keys, "start").select("doc_id", "text", F.col("own").alias("starts"))
    if digest:
        return joined.mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return joined.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, text string")
