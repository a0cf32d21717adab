"""Fill-in-middle: texts cut into prefix, middle and suffix, the middle moved to the end.

Cuts are found with whole numbers as bit vectors. bytes.translate turns a text's UTF-8 into a mask of
the bytes of a class, one lane of eight bits for each byte, and the mask is read as one whole number.
Shifted boolean operations on it mark the last byte of every unit, bit_count gives the number of units,
and the k-th mark is found by halving: the marks of the lower half are counted, and the search goes on
in one half. So no unit is visited one by one and a text takes time in proportion to its bytes.

Units are code points (``chars``), runs of anything but white space (``words``: a word with the white
space before it; white space at the end belongs to no word and stays with what comes last) or lines with
their line feed (``lines``: what follows the last line feed is a line too).

Where a text is cut and which form it gets is drawn from sha256 of seed and id, so reruns agree and rows
don't depend on one another; nothing is shuffled.

Defined cases: a null text counts as empty; an empty text is ``plain``, as are texts that contain a mark
and the share ``1 - fim_share`` of all; very long texts are cut whole; rows that repeat an id are drawn
alike, each over its own text; a null id is drawn as an empty one; other columns are passed on unread
(one that is named like an output is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares in percent: of texts that are transformed, and of these the ones with the suffix first.
FIM_PERCENT, SPM_PERCENT = 90, 20
SEED = 1
LANE = 8


def _table(members: bytes) -> bytes:
    own = set(members)
    return bytes(b in own for b in range(256))


#: Masks of byte classes: bytes that go on a code point, white space, and line feeds.
GOES_ON, SPACE, LINE_FEED = _table(bytes(range(0x80, 0xC0))), _table(b"\x20\x09\x0a\x0b\x0c\x0d"), _table(b"\n")


def _mask(data: bytes, table: bytes) -> int:
    """A whole number with a lane for each byte, the first lowest, that is 1 where the byte is of the class."""
    return int.from_bytes(data.translate(table), "little")


def unit_ends(data: bytes, unit: str = "chars") -> int:
    """A mask of the last bytes of units."""
    if not data:
        return 0
    every = int.from_bytes(b"\x01" * len(data), "little")
    last = 1 << LANE * (len(data) - 1)
    if unit == "chars":  # where the next byte doesn't go on
        return every ^ (_mask(data, GOES_ON) >> LANE)
    if unit == "words":  # a byte of a word before white space or the end
        space = _mask(data, SPACE)
        return (every ^ space) & (space >> LANE | last)
    if unit == "lines":
        return _mask(data, LINE_FEED) | last
    raise ValueError("units are chars, words or lines")


def place_of(mask: int, rank: int, lanes: int) -> int:
    """The lane of the mark with ``rank`` marks below it, by halving."""
    at = 0
    while lanes > 1:
        half = lanes // 2
        low = mask & ((1 << LANE * half) - 1)
        below = low.bit_count()
        if rank < below:
            mask, lanes = low, half
        else:
            mask >>= LANE * half
            at, rank, lanes = at + half, rank - below, lanes - half
    return at


def cuts(data: bytes, draws: tuple[int, int], unit: str = "chars") -> tuple[int, list[int], list[int]]:
    """(n, units, bytes): the number of units, and how many of them and how many bytes are before each of the two cuts, in order."""
    ends = unit_ends(data, unit)
    n = ends.bit_count()
    at = sorted(d % (n + 1) for d in draws)
    return n, at, [place_of(ends, k - 1, len(data)) + 1 if k else 0 for k in at]


def moved(data: bytes, at: list[int], form: str) -> bytes:
    """The text in a form, cut at two places in bytes."""
    prefix, middle, suffix = data[: at[0]], data[at[0] : at[1]], data[at[1] :]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


OUT = "n long, prefix_units long, middle_units long, output binary"


def _transformer(unit: str):
    @F.pandas_udf(OUT)
    def transform(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, first, second, forms in batches:
            rows = []
            for data, a, b, form in zip(texts, first, second, forms, strict=True):
                if form == "plain":
                    rows.append((unit_ends(data, unit).bit_count(), None, None, data))
                else:
                    n, units, at = cuts(data, (a, b), unit)
                    rows.append((n, units[0], units[1] - units[0], moved(data, at, form)))
            out = pd.DataFrame(rows, columns=["n", "prefix_units", "middle_units", "output"])
            yield out.astype({"n": "int64", "prefix_units": "Int64", "middle_units": "Int64"})

    return transform


def draw(doc_id: Column, k: int, seed: int = SEED) -> Column:
    """The k-th (from 1) group of 8 hex digits of sha256 of ``seed:id``, as a whole number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def form_of(text: Column, doc_id: Column, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> Column:
    """plain, psm (prefix, suffix, middle) or spm (suffix first)."""
    plain = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain |= draw(doc_id, 3, seed) % 100 >= fim_percent
    return F.when(plain, "plain").when(draw(doc_id, 4, seed) % 100 < spm_percent, "spm").otherwise("psm")


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "chars", fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> DataFrame:
    """The columns of ``docs`` with n (units of the text), form, prefix_units, middle_units (null if plain) and output."""
    ident, whole = F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    outputs = ("n", "form", "prefix_units", "middle_units", "output")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in outputs]
    form = form_of(whole, ident, fim_percent, spm_percent, seed)
    drawn = docs.select(F.struct(*kept).alias("kept"), whole.cast("binary").alias("data"), draw(ident, 1, seed).alias("first"), draw(ident, 2, seed).alias("second"), form.alias("form"))
    done = drawn.select("kept", "form", _transformer(unit)("data", "first", "second", "form").alias("made"))
    return done.select("kept.*", "made.n", "form", "made.prefix_units", "made.middle_units", F.col("made.output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: a transformed text has no marks but its three."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
