import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tessera.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [[*x.ids, 1] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, out, capacity):
    """Every document's ids come back from its pieces, sequences have no gap and aren't too long. Returns their number."""
    ids = defaultdict(list)
    for (d, _), x in zip(rows, whole_ids([t for _, t in rows]), strict=True):
        parts = [x[a : a + capacity] for a in range(0, len(x), capacity)]
        ids[d] += [(p, p * capacity, len(y), zlib.crc32(np.array(y, "<u4").tobytes())) for p, y in enumerate(parts)]
    got, bins = defaultdict(list), defaultdict(list)
    for r in out:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in ids.items()}
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_awkward(awkward, awkward_rows, capacity):
    check([r[:2] for r in awkward_rows], packing.pack(awkward, PATH, capacity=capacity).collect(), capacity)


def test_table_is_packed_tightly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    out = packing.pack(docs, PATH).collect()
    n = check([(r.doc_id, r.text) for r in docs.collect()], out, 4096)
    assert n <= 1.01 * -(-sum(r.length for r in out) // 4096) + 1


def test_other_shapes(crowded, nothing):
    assert packing.pack(crowded, PATH).select("doc_id").distinct().count() == 13
    assert packing.pack(nothing, PATH).count() == 0


def test_rounds_end_when_nothing_fits(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 4)
    docs = spark.createDataFrame([(i, "the " * 40) for i in range(40)], "doc_id long, text string").repartition(4)
    out = packing.pack(docs, PATH, capacity=64).collect()
    assert len({r.sequence_id for r in out}) == 40


PARTS = ["it's", "~", "a~b", "<|endoftext|>", "é", "e\u0301", "ß\u0130", "12ab", "\u00a0x\u2003y", "日本", "\U0001f600!!", "Don't", "~~ ~", "\x1c", "\x85q", "ΑΣ", "…", "ÀÉÞ×÷ªº", "H\u0331", "naïve-ÖL7", "x" * 300, "\x7f", "Word.", "word,", "WORD"]


@pytest.mark.parametrize("most", [4000, 48 << 20])
def test_words_give_whole_ids(monkeypatch, most):
    rng = random.Random(1)
    texts = [None, "", " ", *(rng.choice([" ", "\n", "\t \x0b"]).join(rng.choice(PARTS) + rng.choice(["", chr(rng.randrange(33, 500))]) for _ in range(rng.randrange(60))) for _ in range(300))]
    monkeypatch.setattr(packing, "CACHE_BYTES", most)
    monkeypatch.setattr(packing, "TEXT_BYTES", 3000)
    own = packing.WordIds(PATH)
    want = whole_ids(texts)
    column = pa.array(["x", *texts], pa.string()).slice(1)
    assert [list(np.frombuffer(x, "<u4")) for x in own.encode(column)] == [x[:-1] for x in want]
    assert own.pieces.held <= most
    own.forget()
    assert not own.pieces.known and not own.pieces.older
    assert list(own.encode(pa.array([], pa.string()))) == []


def test_best_fit():
    bins = packing.best_fit([(s, ((i, 0, 0, s, 0, 0),)) for i, s in enumerate([60, 50, 40, 30, 10, 5])], 100)
    assert sorted(used for used, _ in bins) == [95, 100]
