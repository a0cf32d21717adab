"""Products of a square matrix that stays where it is: vectors are owned by parts, and what travels are
the values that another part's rows need (its halo).

A row belongs to the part of its id, and so do vector entries. A part is one row of a table, with what it has as
arrays, those of cells and of what is sent as bytes: its cells, by their places among its rows and among the values that it reads; the columns that each other
part reads of it; and its entries of vectors, by id. Cells of long rows lie with their columns' owners and send sums
instead, one for each part, so that a row with any share of the cells is spread over all parts. A column with any
share of the cells sends one value to each part that reads it.

A product thus exchanges values of vectors alone, in one order that both sides know, so without ids; joins with
cells find both sides in place. That holds for vectors that ``spread`` deals out, or that are ``placed``, and that
are materialised within ``settled``, as the solver does.

Defined cases: ids are whole numbers; cells with a null count for nothing, repeated cells add up; so do values of a
vector with one id; a value that is null, or that the vector lacks, adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructType

from tessera.materialize import materialize, settled

#: Cells in a part, and in a row beyond which it is long.
CELLS_EACH, LONG_ROW = 500_000, 100_000
#: Rows that a task sorts by part at a time, as it deals them out.
CHUNK = 1 << 20
Owner = Callable[[Column], Column]


@dataclass(frozen=True)
class Layout:
    """``cells``, and ``long`` by column: (part, local, at, source, n, remote, of, coef), the bytes of arrays. Local and remote ids are distinct,
    remote ones by their source, n of each; at and of are a cell's places among them. ``reads``: (part, reads), columns by reader."""

    parts: int
    owner: Owner
    cells: DataFrame
    reads: DataFrame
    long: DataFrame | None

    @property
    def halo(self) -> DataFrame:
        """(part, col, reader): the columns of each part that a part reads, itself too."""
        return self.reads.select("part", F.inline("reads")).select("part", F.explode(_longs("cols")).alias("col"), "reader")

    def spread(self, v: DataFrame, key: str = "i", value: str = "v") -> DataFrame:
        """(part, ids, v): a vector dealt by owner, as arrays by id."""
        known = v.where(F.col(key).isNotNull()).select(self.owner(F.col(key)).cast("int").alias("part"), F.col(key).cast("long").alias("i"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"), F.col(value).isNotNull().alias("known"))
        return self.placed(_dealt(known, self.parts).select("part", _vector("chunks").alias("_v")).select("part", "_v.*"))

    def placed(self, x: DataFrame) -> DataFrame:
        """Rows by part where the cells of each are; Spark forgets where rows are once Python has seen them."""
        return x.repartition(self.parts, "part")

    def times(self, x: DataFrame, value: str, out: str) -> DataFrame:
        """A spread ``x`` with ``out``: A times its column ``value``, for the ids that x has.

        A union and a sum bring x and what is sent to it together: in place where both are, and, unlike with a join, what
        Spark takes for the size of a result doesn't multiply with every step of an iteration until it has millions of digits."""
        kept = x.columns
        message = lambda ids: F.struct(F.col("part").alias("source"), ids.alias("ids"), F.col("m.v").alias("v"), F.col("m.known").alias("known"))
        dealt = lambda m, ids: m.select(F.col("m.part").alias("part"), message(ids).alias("m")).repartition(self.parts, "part")
        sent = dealt(x.join(self.reads.hint("merge"), "part").select("part", F.explode(_values("ids", value, "reads")).alias("m")), F.lit(None).cast("binary"))
        if self.long is not None:
            sums = x.join(self.long.hint("merge"), "part").select("part", F.explode(_sums("ids", value, *PACKED)).alias("m"))
            sent = sent.unionByName(dealt(sums, F.col("m.ids")))
        state = F.struct(*[c for c in kept if c != "part"])
        both = x.select("part", state.alias("x"), F.lit(None).cast(sent.schema["m"].dataType).alias("m")).unionByName(sent.select("part", F.lit(None).cast(x.select(state.alias("x")).schema["x"].dataType).alias("x"), "m"))
        met = both.groupBy("part").agg(F.first("x", ignorenulls=True).alias("x"), F.collect_list("m").alias("_sent")).where("x is not null").select("part", "x.*", "_sent")
        return met.join(self.cells.hint("merge"), "part", "left").withColumn(out, _product("ids", "_sent", *RECEIVED)).select(*kept, out)

    def product(self, x: DataFrame) -> DataFrame:
        """(part, i, v) of A x for a spread x, for the ids that x has."""
        return unpacked(self.times(x, "v", "_out"), "_out")


def unpacked(x: DataFrame, value: str) -> DataFrame:
    """(part, i, v) of a column of spread vectors."""
    return x.select("part", F.col("ids").alias("i"), F.col(value).alias("v")).select("part", F.inline(F.arrays_zip("i", "v")))


def with_product(p: DataFrame, terms: DataFrame, keys: list[str], out: str = "v") -> DataFrame:
    """``p`` (keys and doubles, a row each) with ``out``: the sum of the terms (keys, v) of each row, 0 without any.

    A union and a sum: in place where both sides are, and, unlike with a join, what Spark takes for the size of a
    result doesn't multiply with every step of an iteration until it has millions of digits."""
    rest = [c for c in p.columns if c not in keys]
    zero = F.lit(0.0)
    both = p.select(*keys, *rest, zero.alias(out), F.lit(1).alias("_own")).unionByName(terms.select(*keys, *[zero.alias(c) for c in rest], F.col("v").alias(out), F.lit(0).alias("_own")))
    summed = both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rest], F.coalesce(F.sum(out), zero).alias(out), F.max("_own").alias("_own"))
    return summed.where("_own = 1").drop("_own")


def by_hash(parts: int) -> Owner:
    return lambda i: F.pmod(F.xxhash64(i), F.lit(parts))


# --- what tasks do with the arrays of a part -------------------------------------------------------

LONGS, DOUBLES = ArrayType(LongType()), ArrayType(DoubleType())


def _in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield _by_part(held)
            held, n = [], 0
    if n:
        yield _by_part(held)


def _by_part(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    part = table["part"].to_numpy()
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
    ends = np.append(first, len(part))
    packed = {c: _bytes(ends, table[c].to_numpy()[order]) for c in table.column_names if c != "part"}
    return pa.RecordBatch.from_pydict({"part": pa.array(part[first]), **packed})


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """(part, chunks): the rows of each part, chunks with an array of each column, which has no nulls. What is shuffled are arrays, not rows."""
    rest = [c for c in rows.columns if c != "part"]
    chunks = rows.mapInArrow(_in_chunks, "part int, " + ", ".join(f"{c} binary" for c in rest))
    return chunks.repartition(parts, "part").groupBy("part").agg(F.collect_list(F.struct(*rest)).alias("chunks"))


def _bytes(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """Bytes of the values between each two of the ends."""
    offsets = pa.array(ends * values.itemsize).cast(pa.int32())  # fails beyond 2 GB
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(values))])


def _of(cell: pa.BinaryScalar, kind: type) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _joined(cells: pa.Array, kind: type) -> np.ndarray:
    """The values of all cells, one after another."""
    return np.concatenate([_of(c, kind) for c in cells] or [np.zeros(0, kind)])


def _ends(values: list) -> np.ndarray:
    return np.cumsum([0] + [len(v) for v in values])


def _all(values: list, kind: type) -> np.ndarray:
    return np.concatenate([*values, np.zeros(0, kind)]).astype(kind, copy=False)


def _lists(values: list, kind: pa.DataType) -> pa.Array:
    """Arrays, one for each row."""
    return pa.ListArray.from_arrays(pa.array(_ends(values).astype(np.int32)), pa.concat_arrays([pa.array(v, kind) for v in values] or [pa.array([], kind)]))


def _parcels(to: list, n: list, **columns: list) -> pa.Array:
    """For each row the parcels that it sends: (part, columns), n values of each column to each part."""
    ends = np.append(0, np.cumsum(_all(n, np.int64)))
    fields = {"part": pa.array(_all(to, np.int32)), **{c: _bytes(ends, _all(v, v[0].dtype if v else np.int64)) for c, v in columns.items()}}
    return pa.ListArray.from_arrays(pa.array(_ends(to).astype(np.int32)), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _found(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` among sorted ids, and whether each is there."""
    at = np.minimum(np.searchsorted(ids, wanted), max(len(ids) - 1, 0))
    return at, ids[at] == wanted if len(ids) else np.zeros(len(wanted), bool)


def _at(ids: np.ndarray, v: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``wanted`` ids, and whether each is known."""
    at, there = _found(ids, wanted)
    if v.null_count:
        there &= v.is_valid().to_numpy(zero_copy_only=False)[at]
    return (v.to_numpy(zero_copy_only=False)[at] if len(v) else np.zeros(len(at))), there


def _terms(coef: np.ndarray, x: np.ndarray, known: np.ndarray, of: np.ndarray) -> np.ndarray:
    """coef times x, 0 where x isn't known."""
    with np.errstate(all="ignore"):
        terms = coef * x[of]
    return terms if known.all() else np.where(known[of], terms, 0.0)


@F.arrow_udf(LONGS)
def _longs(cells: pa.Array) -> pa.Array:
    return _lists([_of(c, np.int64) for c in cells], pa.int64())


@F.arrow_udf(StructType().add("ids", LONGS).add("v", DOUBLES))
def _vector(chunks: pa.Array) -> pa.Array:
    ids, v = [], []
    for i in range(len(chunks)):
        i_, v_, known = chunks[i].values.flatten()
        summed = pa.table([pa.array(_joined(i_, np.int64)), pa.array(_joined(v_, np.float64), mask=~_joined(known, np.bool_))], ["i", "v"]).group_by("i").aggregate([("v", "sum")]).sort_by("i")
        ids.append(summed["i"].to_numpy())
        v.append(summed["v_sum"].combine_chunks())
    return pa.StructArray.from_arrays([_lists(ids, pa.int64()), _lists(v, pa.float64())], ["ids", "v"])


KINDS = {"local": np.int64, "at": np.int32, "source": np.int32, "n": np.int32, "remote": np.int64, "of": np.int32, "coef": np.float64}
PACKED = list(KINDS)
RECEIVED = [c for c in PACKED if c != "remote"]  # values come without ids
CELLS = StructType()
for c in PACKED:
    CELLS.add(c, BinaryType())


@F.arrow_udf(CELLS)
def _packed(chunks: pa.Array) -> pa.Array:
    out = {c: [] for c in PACKED}
    for i in range(len(chunks)):
        source, local, remote, coef = (_joined(c, kind) for c, kind in zip(chunks[i].values.flatten(), (np.int32, np.int64, np.int64, np.float64), strict=True))
        local, at = np.unique(local, return_inverse=True)
        remote, first, of = np.unique(remote, return_index=True, return_inverse=True)
        by = np.argsort(source[first], kind="stable")
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        sources, n = np.unique(source[first], return_counts=True)
        for c, v in zip(PACKED, (local, at, sources, n, remote[by], place[of], coef), strict=True):
            out[c].append(v)
    return pa.StructArray.from_arrays([_bytes(_ends(v), _all(v, KINDS[c])) for c, v in out.items()], PACKED)


@F.arrow_udf(ArrayType(StructType().add("part", IntegerType()).add("cols", BinaryType())))
def _wanted(source: pa.Array, n: pa.Array, remote: pa.Array) -> pa.Array:
    return _parcels([_of(s, np.int32) for s in source], [_of(k, np.int32) for k in n], cols=[_of(r, np.int64) for r in remote])


@F.arrow_udf(ArrayType(StructType().add("part", IntegerType()).add("v", BinaryType()).add("known", BinaryType())))
def _values(ids: pa.Array, v: pa.Array, reads: pa.Array) -> pa.Array:
    to, n, sent, known = [], [], [], []
    for i in range(len(ids)):
        reader, cols = reads[i].values.flatten()
        cols = [_of(c, np.int64) for c in cols]
        to.append(reader.to_numpy())
        n.append([len(c) for c in cols])
        values, there = _at(ids[i].values.to_numpy(), v[i].values, np.concatenate(cols))
        sent.append(values)
        known.append(there)
    return _parcels(to, n, v=sent, known=known)


@F.arrow_udf(ArrayType(StructType().add("part", IntegerType()).add("ids", BinaryType()).add("v", BinaryType()).add("known", BinaryType())))
def _sums(ids: pa.Array, v: pa.Array, *cells: pa.Array) -> pa.Array:
    to, n, rows, sums, known = [], [], [], [], []
    for i in range(len(ids)):
        local, at, source, k, remote, of, coef = (_of(c[i], KINDS[name]) for c, name in zip(cells, PACKED, strict=True))
        to.append(source)
        n.append(k)
        rows.append(remote)
        sums.append(np.bincount(of, _terms(coef, *_at(ids[i].values.to_numpy(), v[i].values, local), at), len(remote)))
        known.append(np.ones(len(remote), bool))
    return _parcels(to, n, ids=rows, v=sums, known=known)


def _received(source: np.ndarray, n: np.ndarray, came: np.ndarray, cells: pa.Array, kind: type) -> np.ndarray:
    """The values of a part's sources, one source after another; zeros for those that sent none."""
    order = {s: i for i, s in enumerate(came.tolist())}
    return _all([_of(cells[order[s]], kind) if s in order else np.zeros(k, kind) for s, k in zip(source.tolist(), n.tolist(), strict=True)], kind)


@F.arrow_udf(DOUBLES)
def _product(ids: pa.Array, sent: pa.Array, *cells: pa.Array) -> pa.Array:
    out = []
    for i in range(len(ids)):
        own, y = ids[i].values.to_numpy(), np.zeros(len(ids[i]))

        def add(rows: np.ndarray, sums: np.ndarray, own=own, y=y) -> None:
            at, there = _found(own, rows)
            y[at[there]] += sums[there]

        came, longs, values, known = sent[i].values.flatten()
        whole = longs.is_valid().to_numpy(zero_copy_only=False)  # sums of long rows, of distinct ids each
        if cells[0][i].is_valid:
            local, at, source, n, of, coef = (_of(c[i], KINDS[name]) for c, name in zip(cells, RECEIVED, strict=True))
            short = pa.array(~whole)
            x, there = (_received(source, n, came.filter(short), c.filter(short), kind) for c, kind in ((values, np.float64), (known, np.bool_)))
            add(local, np.bincount(at, _terms(coef, x, there, of), len(local)))
        for k in np.flatnonzero(whole).tolist():
            add(_of(longs[k], np.int64), _of(values[k], np.float64))
        out.append(y)
    return _lists(out, pa.float64())


def lay_out(cells: DataFrame, parts: int | None = None, owner: Owner | None = None, long_row: int = LONG_ROW, lengths: DataFrame | None = None) -> Layout:
    """Deals cells (row, col, coef) out once. Cells without a place or a value are left out; repeated ones add up in products.

    ``lengths`` (row, n) has at least as many cells as each row has, where that is known; without it cells are counted first.
    ``owner`` gives an id's part, from 0 to ``parts`` - 1; without one ids are dealt by a hash."""
    spark = cells.sparkSession
    whole = cells.where("row is not null and col is not null and coef is not null").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("coef").cast("double").alias("coef"))
    lengths = whole.groupBy("row").agg(F.count("*").alias("n")) if lengths is None else lengths
    n, some = lengths.agg(F.sum("n"), F.count_if(F.col("n") > long_row)).first()
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(n or 0) // CELLS_EACH))
    owner = owner or by_hash(parts)
    of = lambda c, out: owner(F.col(c)).cast("int").alias(out)
    short, long = whole, None
    if some:
        longer = materialize(lengths.where(F.col("n") > long_row).select("row"))  # as many as long rows can be among the cells
        short, long = whole.join(F.broadcast(longer), "row", "left_anti"), whole.join(F.broadcast(longer), "row", "left_semi")
    packed = lambda df, local, remote: materialize(_dealt(df.select(of(local, "part"), of(remote, "source"), local, remote, "coef"), parts).select("part", _packed("chunks").alias("_c")).select("part", "_c.*").repartition(parts, "part"))
    with settled(spark):
        laid = packed(short, "row", "col")
        wanted = laid.select(F.col("part").alias("reader"), F.explode(_wanted("source", "n", "remote")).alias("w")).select("w.part", "reader", "w.cols")
        reads = materialize(wanted.repartition(parts, "part").groupBy("part").agg(F.collect_list(F.struct("reader", "cols")).alias("reads")))
        return Layout(parts, owner, laid, reads, packed(long, "col", "row") if some else None)
