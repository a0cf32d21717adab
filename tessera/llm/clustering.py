"""Centroid clustering by Lloyd's rounds that do only what changed.

Vectors become whole numbers, floor(scale * x), so that sums don't depend on their order. State is
written after each round: a row a vector with its whole numbers, owner and distance; and, on the driver,
the centroids with the sums and counts of their vectors (k rows, whatever the number of vectors). A round

* compares a vector whose centroid stayed where it was with those centroids that moved, its own distance
  being known, and a vector whose centroid moved with all of them;
* takes from the new state the vectors that changed owner, adds each to one sum and takes it from another
  within tasks, and adds these signed transfers to the sums (2 k rows from each task).

No vector is shuffled. Tasks need the k centroids and one batch of vectors.

Defined cases: vectors without exactly ``dim`` components, or with one that is null, NaN or infinite,
are left out; a null or repeated id is an id like others (rows that repeat one are vectors of their own;
a null id hashes as an empty one); components are held within +-2^27 after scaling, so that distances fit
a long; fewer than k vectors make fewer centroids, in ties by components; equal distances go to the
smaller number; a centroid without vectors stays where it is; an empty table gives an empty result;
other columns aren't read. Sums of distances beyond a long are null.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import remove, shared_folder

K, ROUNDS, SCALE, DIM, SEED = 16, 3, 64, 64, 1
LIMIT = 1 << 27
#: Below it squared distances of whole numbers are exact in doubles, for up to 2^7 components.
EXACT = 1 << 21
STATE = "vec_id {id}, v array<int>, owner int, distance long, was int"


def _vectors(column: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows count, and their components as whole numbers."""
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fit = np.flatnonzero(sizes == dim)
    values = column.take(pa.array(fit)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
    fine = np.isfinite(values).all(axis=1)
    return fit[fine], np.clip(np.floor(scale * values[fine]), -LIMIT, LIMIT).astype(np.int64)


def _distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``v`` to all of ``c``, exact."""
    if not len(v) or not len(c):
        return np.zeros((len(v), len(c)), dtype=np.int64)
    if max(np.abs(v).max(), np.abs(c).max()) < EXACT and v.shape[1] <= 128:
        x, y = v.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)).astype(np.int64)
    return np.stack([((v - one) ** 2).sum(axis=1) for one in c], axis=1)


def reassigned(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances. ``owner`` is -1 where there is none yet; ``moved`` says which centroids aren't where they were."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | moved[owner]
    d = _distances(v[lost], centroids)
    if d.size:
        owner[lost] = d.argmin(axis=1)  # the first of equal ones
        distance[lost] = d.min(axis=1)
    new = np.flatnonzero(moved)
    d = _distances(v[~lost], centroids[new])
    if d.size:
        best = d.argmin(axis=1)
        nearest, at = d[np.arange(len(d)), best], new[best]
        kept, held = owner[~lost], distance[~lost]
        better = (nearest < held) | ((nearest == held) & (at < kept))
        owner[~lost], distance[~lost] = np.where(better, at, kept), np.where(better, nearest, held)
    return owner, distance


def _state(ids: pa.Array, v: np.ndarray, owner: np.ndarray, distance: np.ndarray, was: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel().astype(np.int32)))
    columns = [ids, lists, pa.array(owner.astype(np.int32)), pa.array(distance.astype(np.int64)), pa.array(was.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "owner", "distance", "was"])


def quantised(vectors: DataFrame, key: str = "vec_id", array: str = "embedding", dim: int = DIM, scale: float = SCALE) -> DataFrame:
    """The state before any round: vectors as whole numbers, without owners."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, v = _vectors(batch.column(1), dim, scale)
            none = np.full(len(v), -1)
            yield _state(batch.column(0).take(pa.array(rows)), v, none, np.zeros(len(v)), none)

    slim = vectors.select(F.col(f"`{key}`"), F.col(f"`{array}`").cast("array<double>"))
    return slim.mapInArrow(make, STATE.format(id=dict(slim.dtypes)[key]))


def _round(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    dim = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)
            was = batch.column(2).to_numpy(zero_copy_only=False)
            owner, distance = reassigned(v, was, batch.column(3).to_numpy(zero_copy_only=False), centroids, moved)
            yield _state(batch.column(0), v, owner, distance, was)

    return state.mapInArrow(assign, STATE.format(id=dict(state.dtypes)["vec_id"]))


def transfers(state: DataFrame, dim: int = DIM) -> DataFrame:
    """(cluster, place, n): what the vectors that changed owner add to sums, and take from them; place -1 has counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)
            counted = np.concatenate([np.ones((len(v), 1), dtype=np.int64), v], axis=1)
            for sign, column in ((1, 1), (-1, 2)):
                cluster = batch.column(column).to_numpy(zero_copy_only=False)
                for c in np.unique(cluster[cluster >= 0]):
                    total[int(c)] = total.get(int(c), 0) + sign * counted[cluster == c].sum(axis=0)
        names = ["cluster", "place", "n"]
        for c, row in total.items():
            columns = [np.full(dim + 1, c, dtype=np.int32), np.arange(-1, dim, dtype=np.int32), row]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    changed = state.where("owner <> was").select("v", "owner", "was")
    return changed.mapInArrow(add, "cluster int, place int, n long").groupBy("cluster", "place").agg(F.sum("n").alias("n"))


def first_centroids(state: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors with the k smallest sha256 of ``seed:id``, in that order."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in state.select("v", rank.alias("rank")).orderBy("rank", "v").limit(k).collect()], dtype=np.int64)


def delta_lloyd(vectors: DataFrame, key: str = "vec_id", array: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: float = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) after ``rounds`` rounds and a last assignment, and the final centroids (k x dim)."""
    spark = vectors.sparkSession
    folder = f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}"
    quantised(vectors, key, array, dim, scale).write.parquet(f"{folder}/0")
    state = spark.read.parquet(f"{folder}/0")
    centroids = first_centroids(state, k, seed)
    if not len(centroids):
        return state.select("vec_id", F.col("owner").alias("cluster"), "distance"), centroids.reshape(0, dim)
    sums = np.zeros((len(centroids), dim + 1), dtype=np.int64)
    moved = np.ones(len(centroids), dtype=bool)
    for n in range(1, rounds + 2):
        _round(state, centroids, moved).write.parquet(f"{folder}/{n}")
        state = spark.read.parquet(f"{folder}/{n}")
        remove(spark, f"{folder}/{n - 1}")
        if n > rounds:
            break
        for t in transfers(state, dim).collect():  # at most k (dim + 1) rows
            sums[t["cluster"], t["place"] + 1] += t["n"]
        full = sums[:, 0] > 0
        new = centroids.copy()
        new[full] = sums[full, 1:] // sums[full, :1]
        moved, centroids = (new != centroids).any(axis=1), new
    return state.select("vec_id", F.col("owner").alias("cluster"), "distance"), centroids


def clusters(vectors: DataFrame, key: str = "vec_id", array: str = "embedding", **options) -> DataFrame:
    """One row a vector: its id (under its name), cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    owned, centroids = delta_lloyd(vectors, key, array, **options)
    spark = vectors.sparkSession
    prints = [(n, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for n, c in enumerate(centroids)]
    inertia = owned.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    each = inertia.join(F.broadcast(spark.createDataFrame(prints, "cluster int, centroid_sha256 string")), "cluster")
    total = inertia.agg(F.try_sum("cluster_inertia").alias("inertia"))
    each = each.join(F.broadcast(total))  # one row
    return owned.join(F.broadcast(each), "cluster").select(F.col("vec_id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows at most
