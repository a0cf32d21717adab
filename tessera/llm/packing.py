"""Best-fit packing of token ids into sequences, in rounds over a tree of partitions.

Documents are encoded once. Each input partition cuts long documents and packs its pieces by best
fit, longest first. Nearly full bins are done; underfull bins become items of the next round, in
fewer partitions, and so on until one partition is left or a round gains nothing. A partition of a
later round never has more than ITEMS items, however many remain, so no task grows with the input.
A bin carries its pieces (at most one for each of its tokens).

Encoding goes by distinct words: the vocabulary's pieces never cross white space, so the ids of words,
put together, are exactly those of the whole text.

Defined cases: a null or empty text is one piece with the end id alone; very long texts are cut;
ties are broken by size, id and piece, so reruns agree; repeated rows are packed each; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import os
import zlib
from collections import ChainMap
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

CAPACITY = 4096
END_ID = 1
#: Bins with at most this many free tokens are done.
NEARLY_FULL = 8
FAN_IN = 8
ITEMS = 100_000
#: Bytes that a task's cache of pieces takes at most, roughly, what an entry takes beside its piece and ids,
#: the longest piece that it keeps, and bytes of text that are cut into words at a time.
CACHE_BYTES = 48 << 20
ENTRY_BYTES = 176
LONGEST_KEPT = 64
TEXT_BYTES = 4 << 20

#: Plain words are of printable ASCII and letters of Latin-1, without apostrophes; in UTF-8, the latter are LATIN and one
#: byte of TAILS. What pieces the vocabulary's rules cut them into follows from three classes of characters: letters in
#: a run, digits one by one, others in a run.
LATIN = 0xC3
TAILS = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
PLAIN = np.array([0x21 <= b <= 0x7E and b != 0x27 or b == LATIN for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
LETTER, DIGIT, OTHER = range(3)
CLASS = np.array([LETTER if b >= 0x80 or chr(b).isalpha() else DIGIT if chr(b).isdigit() else OTHER for b in range(256)], dtype=np.uint8)

_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_BINS = pa.schema([("used", pa.int32()), ("members", pa.list_(_PIECE))])
BINS_SCHEMA = "used int, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


class Halves:
    """A bounded cache of ids. When its newer half is full, the older goes and the newer takes its place.

    Keys that come again move to the newer half, so rare ones go and common ones stay. Long keys are
    learnt each time and not kept."""

    def __init__(self, learn: Callable[[list], dict], most: int):
        self.learn, self.most = learn, most
        self.forget()

    def forget(self) -> None:
        self.known: dict = {}
        self.older: dict = {}
        self.held = 0

    def look_up(self, keys: set) -> Mapping:
        """The ids of ``keys``, and of others."""
        unknown = keys.difference(self.known)
        if not unknown:
            return self.known
        new = {k: self.older[k] for k in unknown.intersection(self.older)}
        new |= self.learn(list(unknown.difference(new)))
        long = {k: v for k, v in new.items() if len(k) > LONGEST_KEPT}
        for k in long:
            del new[k]
        size = self._size(new)
        if self.held + size > self.most // 2:
            new |= {k: self.known[k] for k in keys.intersection(self.known)}
            self.older, self.known, self.held, size = self.known, {}, 0, self._size(new)
        self.known.update(new)
        self.held += size
        return ChainMap(self.known, long) if long else self.known

    @staticmethod
    def _size(entries: dict) -> int:
        return sum(map(len, entries)) + sum(map(len, entries.values())) + ENTRY_BYTES * len(entries)


class WordIds:
    """The ids of texts as little-endian 32-bit numbers, by distinct words and a bounded cache of their pieces.

    A worker keeps the tokenizer between its tasks; ``forget`` empties the cache at each task's end."""

    _open: dict[str, WordIds] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # The same model for text that is already cut into pieces by spaces.
        self.cut = Tokenizer(self.tokenizer.model)
        self.cut.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a piece
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.pieces = Halves(self._pieces, CACHE_BYTES)

    @classmethod
    def at(cls, path: str) -> WordIds:
        """One for each Python worker."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def forget(self) -> None:
        self.pieces.forget()

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """All in one call, parted by the ids that end a piece."""
        ids = np.array(self.cut.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        flat = ids.tobytes()
        return dict(zip(pieces, (flat[a:b] for a, b in pairwise([0, *ends.tolist()])), strict=True))

    def _plain(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """Pieces are made in place, as offsets into the bytes of the words."""
        raw, at = _bytes_of(words)
        raw = LOWER[raw]
        raw[1:][(raw[:-1] == LATIN) & (raw[1:] <= 0x9E)] += 32
        kind = CLASS[raw]
        opens = np.ones(len(raw), dtype=bool)
        opens[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        opens[at[:-1][at[:-1] < len(raw)]] = True
        starts = np.r_[np.flatnonzero(opens), len(raw)].astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(raw)).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        known = self.pieces.look_up(set(distinct))
        ids = pa.array([known[p] for p in distinct], pa.large_binary()).take(pieces.indices)
        ends, data = _large(ids)
        ends = ends[np.r_[0, np.cumsum(opens)][at]]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), data])

    def _words(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        raw, at = _bytes_of(words)
        fine = PLAIN[raw]
        fine[1:] |= TAILS[raw[1:]] & (raw[:-1] == LATIN)
        odd = np.r_[0, np.cumsum(~fine)]
        odd = odd[at[1:]] > odd[at[:-1]]
        if not odd.any():
            return self._plain(words)
        others = words.filter(pa.array(odd)).to_pylist()
        ids = []
        for a in range(0, len(others), 1000):
            ids += [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(others[a : a + 1000], add_special_tokens=False)]
        both = pa.concat_arrays([self._plain(words.filter(pa.array(~odd))), pa.array(ids, pa.large_binary())])
        place = np.where(odd, len(words) - len(others) + np.cumsum(odd) - 1, np.cumsum(~odd) - 1)
        return both.take(pa.array(place))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of an Arrow array of strings."""
        texts = pc.fill_null(texts, "")
        part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // TEXT_BYTES
        cuts = np.flatnonzero(np.diff(part)) + 1 if len(texts) else []
        for a, b in pairwise([0, *cuts, len(texts)]):
            split = pc.ascii_split_whitespace(texts.slice(a, b - a))  # at exactly the six white space characters of SPACE
            coded = split.flatten().dictionary_encode()
            ends, data = _large(self._words(coded.dictionary).take(coded.indices))
            ends = ends[split.offsets.to_numpy()].tolist()
            raw = data.to_pybytes() if data else b""
            yield from (raw[x:y] for x, y in pairwise(ends))


def _bytes_of(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings together, and where each begins, with the end of the last."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, dtype=np.int32)
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _large(values: pa.LargeBinaryArray) -> tuple[np.ndarray, pa.Buffer | None]:
    """Offsets and bytes of large binary values."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, dtype=np.int64)
    return at, data


def best_fit(items: Iterable[tuple[int, tuple]], capacity: int = CAPACITY) -> list[tuple[int, list[tuple]]]:
    """Bins of (used, members), longest items first, each into the fullest bin that it fits.

    items: (size, members), members as tuples whose last is the offset within the item."""
    bins: list[list] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free room
    rooms = 0  # bit r: a bin with r free
    for size, members in items:
        fits = rooms >> size
        if fits:
            room = size + ((fits & -fits).bit_length() - 1)
            b = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([0, []])
        used = bins[b][0]
        bins[b][1] += [(*m[:-1], used + m[-1]) for m in members]
        bins[b][0] = used + size
        if room - size:
            free[room - size].append(b)
            rooms |= 1 << (room - size)
    return [(used, members) for used, members in bins]


def _order(item: tuple[int, tuple]):
    first = item[1][0]
    return -item[0], first[0] is None, first[0] or 0, first[1]


def _batches(bins: list[tuple[int, list[tuple]]]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _PIECE]
    for a in range(0, len(bins), 2000):
        some = bins[a : a + 2000]
        flat = [m for _, ms in some for m in ms]
        ends = np.cumsum([0] + [len(ms) for _, ms in some]).astype(np.int32)
        cols = [pa.array(c, _PIECE[i].type) for i, c in enumerate(zip(*flat, strict=True))]
        yield pa.record_batch([pa.array([u for u, _ in some], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(cols, names))], schema=_BINS)


def _encode_and_pack(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pieces, whole = WordIds.at(path), [], []
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), words.encode(batch.column(1)), strict=True):
                raw += END_ID.to_bytes(4, "little")
                for p, a in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[a : a + 4 * capacity]
                    item = (len(part) // 4, ((doc, p, a // 4, len(part) // 4, zlib.crc32(part), 0),))
                    (whole if item[0] == capacity else pieces).append(item)
            yield from _batches([(n, list(ms)) for n, ms in whole])
            whole = []
        words.forget()
        yield from _batches(best_fit(sorted(pieces, key=_order), capacity))

    return run


def _pack_again(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = []
        for batch in batches:
            for used, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                items.append((used, tuple(tuple(m.values()) for m in members)))
        yield from _batches(best_fit(sorted(items, key=_order), capacity))

    return run


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    bins = cut(docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_encode_and_pack(tokenizer, capacity), BINS_SCHEMA))
    done = []
    parts = bins.rdd.getNumPartitions()
    while True:
        done.append(bins.where(F.col("used") >= capacity - nearly_full))
        rest = bins.where(F.col("used") < capacity - nearly_full)
        n = rest.count()
        fewer = max(-(-parts // FAN_IN), -(-n // ITEMS))
        if n <= 1 or parts == 1:
            done.append(rest)
            break
        first = F.col("members")[0]
        bins = cut(rest.repartition(fewer, F.xxhash64(first["doc_id"], first["piece"], F.lit(fewer))).mapInArrow(_pack_again(capacity), BINS_SCHEMA))
        if fewer >= parts and bins.count() > 0.99 * n:
            done.append(bins)
            break
        parts = fewer
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    numbered = out.withColumn("sequence_id", F.monotonically_increasing_id())  # one for each bin, before its pieces part
    return numbered.select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
