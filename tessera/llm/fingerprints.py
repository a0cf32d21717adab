"""Document fingerprints by order MinHash, from column expressions alone.

Words are taken in k-mers; a k-mer that comes again in its document is another element (it is hashed
with its occurrence number). For each of ENTRIES hash functions the two elements of the whole text with
the least values are taken, put back into text order and hashed together: so an entry agrees between two
texts only if both chose the same k-mers in the same order, which follows edit distance rather than the
set of words. Likeness is the share of entries that agree, whatever the texts' lengths.

The hash functions are those of BASES hash families, each from TURNS starting points: the value of an
element is how far its base hash lies beyond the starting point, around the circle of 64-bit numbers. So
the two least values are the two elements that follow the starting point, and only elements a short way
beyond one need to be sorted. A text in which too few lie there is sorted whole.

Defined cases: a null text is empty; a text without words is one empty element, so that all such
texts are alike; a text of fewer words than a k-mer is one element, and its entries are of it alone;
very long texts are taken whole; equal texts have equal fingerprints; other columns are passed on,
whatever their names (one named as the result gives way to it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import words

K = 2
BASES = 4
TURN_BITS = 4
TURNS = 1 << TURN_BITS
ENTRIES = BASES * TURNS
#: Elements that lie behind a starting point on average among those that are sorted.
NEAR = 12
#: Rows of a range of ids, and the most ranges: beyond, ranges have more rows.
ROWS_EACH, MOST_RANGES = 4000, 50_000


def _elements(kmers: Column, o: Column) -> Column:
    """Structs of each element's hash ``h`` and place ``p``. o: (k-mer, place) in order if any comes twice, else null."""
    steps = F.lit([1 << s for s in reversed(range(31))])

    def first_place(x: Column, i: Column) -> Column:
        """The first place in ``o`` with the k-mer of place i, by ever smaller steps back from i."""
        back = lambda at, s: F.when((at >= s) & (F.get(o, at - s)["k"] == x), at - s).otherwise(at)
        return F.aggregate(steps, i, back)

    def occurrence(x: Column, i: Column) -> Column:
        again = F.get(o, i - 1)["k"] == x["k"]
        return F.when((i > 0) & again, i - first_place(x["k"], i)).otherwise(0)

    once = F.transform(kmers, lambda x, i: F.struct(F.xxhash64(x, F.lit(0)).alias("h"), i.alias("p")))
    again = F.transform(o, lambda x, i: F.struct(F.xxhash64(x["k"], occurrence(x, i)).alias("h"), x["p"].alias("p")))
    return F.when(o.isNull(), once).otherwise(again)


def _candidates(e: Column, base: Column) -> Column:
    """The elements that lie a short way beyond a starting point; all of them in a short text."""
    most = (F.lit(float(NEAR << 64)) / F.greatest(F.size(e), F.lit(NEAR * TURNS))).cast("long")
    near = F.filter(e, lambda x: F.xxhash64(x["h"], base).bitwiseAND((1 << (64 - TURN_BITS)) - 1) < most)
    return F.when(F.size(e) <= NEAR * TURNS, e).otherwise(near)


def _placed(c: Column, base: Column) -> Column:
    """Elements ``c`` with their base hashes ``g``, these sorted as ``s`` and the parts of the circle that they lie in, ``t``.

    Hashes are sorted alone, which is much cheaper than sorting elements."""
    hashed = F.array(F.transform(c, lambda x: F.xxhash64(x["h"], base)))
    ranked = F.transform(hashed, lambda g: F.struct(g.alias("g"), F.sort_array(g).alias("s")))
    turn = lambda g: F.shiftrightunsigned(g, 64 - TURN_BITS)
    return F.transform(ranked, lambda x: F.struct(c.alias("c"), x["g"].alias("g"), x["s"].alias("s"), F.transform(x["s"], turn).alias("t")))[0]


def _each(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _lacking(turns: Column) -> Column:
    """Whether fewer than two elements follow some starting point."""
    second = lambda t: F.get(turns, F.nullif(F.array_position(turns, t.cast("long")), F.lit(0).cast("long")).cast("int"))
    return F.exists(_each(TURNS), lambda t: F.coalesce(second(t) != t, F.lit(True)))


def _entries(placed: Column, base: Column) -> Column:
    """For each starting point of a base the hash of the two elements that follow it, in text order."""
    s = placed["s"]
    element = lambda at: F.element_at(placed["c"], F.array_position(placed["g"], F.element_at(s, at)).cast("int"))

    def entry(t: Column) -> Column:
        # The first element of this part of the circle, or else of the next that has any.
        at = F.coalesce(*[F.nullif(F.array_position(placed["t"], ((t + k) % TURNS).cast("long")), F.lit(0).cast("long")) for k in range(TURNS)]).cast("int")
        return F.transform(F.array(F.struct(element(at).alias("x"), element(at % F.size(s) + 1).alias("y"))), lambda two: _pair(two["x"], two["y"], F.size(s), base * TURNS + t))[0]

    return F.transform(_each(TURNS), entry)


def _pair(x: Column, y: Column, n: Column, tag: Column) -> Column:
    both = F.when(x["p"] < y["p"], F.xxhash64(tag, x["h"], y["h"])).otherwise(F.xxhash64(tag, y["h"], x["h"]))
    return F.when(n == 1, F.xxhash64(tag, x["h"])).otherwise(both)


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """``df`` with ``out``: an array of ENTRIES numbers."""
    w, kmers, e = F.col("w"), F.col("k"), F.col("e")
    count = F.greatest(F.size("w") - k + 1, F.lit(1))
    # Hashes of the k-mers. Beyond the end of a short text get() gives null, which the hash passes over.
    a = df.select(F.struct("*").alias("row"), words(F.col(f"`{text}`")).alias("w"))
    b = a.select("row", F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])).alias("k"))
    # Occurrence numbers, where a hash comes twice: in sorted order, the distance from its first place.
    repeats = F.size(F.array_distinct(kmers)) < F.size(kmers)
    places = F.sort_array(F.transform(kmers, lambda x, i: F.struct(x.alias("k"), i.alias("p"))))
    c = b.select("row", "k", F.when(repeats, places).alias("o"))
    d = c.select("row", _elements(kmers, F.col("o")).alias("e"))
    some = d.select("row", "e", F.transform(_each(BASES), lambda i: _candidates(e, i)).alias("s"))
    placed = some.select("row", "e", F.transform("s", _placed).alias("s"))
    # Two elements or more beyond each starting point are the text's own two least; else all are sorted.
    lacking = lambda x: (F.size(e) > NEAR * TURNS) & _lacking(x["t"])
    whole = placed.select("row", F.transform("s", lambda x, i: F.when(lacking(x), _placed(e, i)).otherwise(x)).alias("s"))
    done = whole.select("row", F.flatten(F.transform("s", _entries)).alias("made"))
    return done.select(*[F.col("row")[c].alias(c) for c in df.columns if c != out], F.col("made").alias(out))


def likeness(a: Column, b: Column) -> Column:
    """The share of entries that agree. Each entry has its number in its hash, so none meets another."""
    return F.size(F.array_intersect(a, b)) / float(ENTRIES)


def as_string(fingerprint: Column) -> Column:
    """Entries in order, each as 16 hexadecimal digits."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")), "")


def _range_of(cuts: list[float], x: Column) -> Column:
    """The number of ``cuts`` below a number, by halving steps."""
    n, bounds = len(cuts), F.lit(cuts or [0.0])
    steps = F.lit([1 << s for s in reversed(range(max(1, n.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(bounds, at + s - 1) < x), at + s).otherwise(at))


def with_next(docs: DataFrame, doc_id: str, columns: list[str], suffix: str = "_next", rows_each: int = ROWS_EACH) -> DataFrame:
    """Each row with ``columns`` of the next document by descending id; after the last comes the first.

    Rows without an id come last; rows of equal ids are ordered by a hash of the first of ``columns``,
    from the greatest on. Rows are dealt once, into ranges of id and hash together, so one id may have any
    share of the rows. The first row of a range goes to the range before it as well, as what follows its
    last; so no task needs more than its range. The driver gets two numbers for each range."""
    key = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(1 << 63)))
    tie = F.shiftrightunsigned(F.xxhash64(F.col(f"`{columns[0]}`")), 4)
    # Id and hash as one number, in which a greater pair is never less. What it rounds off only joins neighbours in a range.
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), tie.alias("tie")).withColumn("at", F.col("key").cast("double") * float(1 << 60) + F.col("tie").cast("double"))
    n = rows.count()
    parts = min(MOST_RANGES, -(-n // rows_each))
    cuts = sorted(set(rows.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)], max(10_000, 4 * parts))).first()[0])) if parts > 1 else []
    own = rows.withColumn("part", _range_of(cuts, F.col("at")))
    tops = own.groupBy("part").agg(F.max(F.struct("key", "tie")).alias("top")).select("part", "top.key", "top.tie").collect() if n else []
    tops = sorted((t["part"], t["key"], t["tie"]) for t in tops)
    # By descending id the range before this one is the next above, and before the topmost the lowest.
    before = {part: tops[(k + 1) % len(tops)][0] for k, (part, _, _) in enumerate(tops)}
    table = docs.sparkSession.createDataFrame([(*t, before[t[0]]) for t in tops], "part int, top_key long, top_tie long, before int")
    place = lambda part, late: F.struct(part.alias("part"), F.lit(late).alias("late"))
    here, late = place(F.col("part"), False), place(F.col("before"), True)
    is_top = (F.col("key") == F.col("top_key")) & (F.col("tie") == F.col("top_tie"))
    known = own.join(F.broadcast(table), "part")  # a row for each range, MOST_RANGES at most
    dealt = known.select("row", "key", "tie", F.explode(F.when(is_top, F.array(here, late)).otherwise(F.array(here))).alias("to"))
    order = Window.partitionBy("to.part").orderBy(F.col("to.late"), F.col("key").desc(), F.col("tie").desc(), *[F.col("row")[c] for c in columns])
    out = dealt.select("row", "to", *[F.lead(F.col("row")[c]).over(order).alias(f"next{i}") for i, c in enumerate(columns)]).where(~F.col("to.late"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns], *[F.col(f"next{i}").alias(c + suffix) for i, c in enumerate(columns)])


def edited_by_next(text: Column, following: Column) -> Column:
    """``text`` with its last third (rounded down) replaced by the first as many characters of ``following``."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))
