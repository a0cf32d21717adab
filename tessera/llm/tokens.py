"""Token counts of the sections of documents.

A document is encoded once, as a whole. Its tokens' byte spans come from the vocabulary's byte
lengths, and are joined with the section spans by place. A token that crosses a boundary goes by an
explicit rule: ``most`` (the default; the section that has most of its bytes, the earlier one in a
tie) or ``first`` (the section of its first byte). So the counts of a document's sections add up to
its tokens, which encoding the sections one by one doesn't give. Sections are the lines of a text, or
the fields that a document is put together from.

Defined cases: a null or empty text has no sections (a null field is an empty one); an empty section
has no tokens; very long texts are encoded whole; repeated rows are counted each; a null id is kept;
an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents that are counted at a time, which bounds what a worker holds.
ROWS = 256


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    """An encoding, and the byte length of each of its tokens."""
    import tiktoken

    with open(path) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def line_ends(text: str) -> list[int]:
    """Ends, in code points, of the sections of a text: its lines, each with its line break."""
    out, at = [], text.find("\n")
    while at >= 0:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out if out and out[-1] == len(text) else [*out, len(text)]


def attribute(token_lengths: np.ndarray, section_ends: np.ndarray, rule: str = "most") -> np.ndarray:
    """Tokens of each section. Both arguments in bytes, the ends ascending, the last the text's end."""
    ends = np.cumsum(token_lengths)
    starts = ends - token_lengths
    owner = np.searchsorted(section_ends, starts, side="right")
    if rule == "most":
        crossing = np.flatnonzero(ends > section_ends[owner])
        for t in crossing.tolist():
            best, at, k = (0, owner[t]), int(starts[t]), int(owner[t])
            while at < ends[t]:
                end = min(int(section_ends[k]), int(ends[t]))
                if end - at > best[0]:
                    best = (end - at, k)
                at, k = end, k + 1
            owner[t] = best[1]
    elif rule != "first":
        raise ValueError(f"no such rule: {rule}")
    return np.bincount(owner, minlength=len(section_ends))


Cutter = Callable[[tuple], tuple[str, list[int]]]


def lines_of(values: tuple) -> tuple[str, list[int]]:
    """A document of one text, and the ends of its lines."""
    text = values[0] or ""
    return text, line_ends(text) if text else []


def fields_of(values: tuple) -> tuple[str, list[int]]:
    """A document of several fields, one after another with a line break between them, which belongs to the field before."""
    parts = [v or "" for v in values]
    text = "\n".join(parts)
    return text, [*(np.cumsum([len(x) + 1 for x in parts])[:-1].tolist()), len(text)]


def _sections(path: str, pattern: str, rule: str, n_keep: int, cut: Cutter, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoding(path, pattern)
        for batch in (whole.slice(a, ROWS) for whole in batches for a in range(0, len(whole), ROWS)):
            owners, sections, starts, ends, counts = [], [], [], [], []
            for row, values in enumerate(zip(*[c.to_pylist() for c in batch.columns[n_keep:]], strict=True)):
                text, own = cut(values)
                if not own:
                    continue
                begins = [0, *own[:-1]]
                sizes = [len(text[a:b].encode()) for a, b in zip(begins, own, strict=True)]
                owners += [row] * len(own)
                sections += range(len(own))
                starts += begins
                ends += own
                counts.append(attribute(lengths[np.asarray(encoding.encode_ordinary(text), dtype=np.int64)], np.cumsum(sizes), rule))
            kept = [c.take(pa.array(owners, pa.int32())) for c in batch.columns[:n_keep]]
            made = [pa.array(x, pa.int32()) for x in (sections, starts, ends, np.concatenate(counts) if counts else [])]
            yield pa.record_batch([*kept, *made], names=names)

    return run


def section_tokens(
    docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rule: str = "most", fields: tuple[str, ...] | None = None
) -> DataFrame:
    """A row for each section: the columns ``keep``, section, start, end (in code points), n_tokens.

    Sections are the lines of ``text``, or with ``fields`` those columns, of which the document then consists."""
    columns = (text,) if fields is None else fields
    own = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *[F.col(f"`{c}`").cast("string").alias(f"t{i}") for i, c in enumerate(columns)])
    made = T.StructType([T.StructField(n, T.IntegerType()) for n in ("section", "start", "end", "n_tokens")])
    out = T.StructType([*own.schema.fields[: len(keep)], *made])
    counted = own.mapInArrow(_sections(path, pattern, rule, len(keep), lines_of if fields is None else fields_of, out.names), out)
    return counted.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *made.names)
