"""The pipeline stage by stage against plain Python, on whole small tables."""

import corpus_pipeline
from tests.llm import test_mixing, test_near, test_packing, test_quality, test_secrets

from tessera.llm import secrets


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    steps = dict(corpus_pipeline.STAGES)

    out = steps["quality_rules"](spark, docs, "").cache()
    assert out.columns == columns
    rows = [r for r in rows if test_quality.brute(r[1], r[2])[0][-1]]
    assert sorted(map(tuple, out.collect())) == sorted(rows)

    out = steps["near_duplicates"](spark, out, "").cache()
    rows = _firsts(rows)
    assert out.columns == columns and sorted(map(tuple, out.collect())) == sorted(rows)

    out = steps["secret_scan"](spark, out, "").cache()
    rows = [(*r[:1], t := secrets.redacted(r[1], secrets.findings(r[1])), *r[2:4], len(t)) for r in rows]
    assert out.columns == columns and sorted(map(tuple, out.collect())) == sorted(rows)
    assert not any(test_secrets.brute(r[1]) for r in rows)

    plan = test_mixing.mixing.mix_plan(out).collect()
    out = steps["mix_sources"](spark, out, "").cache()
    assert out.columns == columns
    copies = {r.doc_id: r.copies for r in plan}
    assert sorted(map(tuple, out.collect())) == sorted(r for r in rows for _ in range(copies[r[0]]))

    packed = steps["pack_sequences"](spark, out, "").collect()
    test_packing.check([(r.doc_id, r.text) for r in out.collect()], packed, 4096)


def _firsts(rows):
    classes = {d: c for d, c, _ in test_near.brute([r[:2] for r in rows])}
    return [r for r in rows if classes[r[0]] == r[0]]


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_awkward_rows_pass_all_stages(spark, awkward, crowded, nothing, awkward_rows):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing columns and an empty table, each stage on what the one before kept."""
    for docs in (awkward, crowded, nothing):
        out = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, "").cache()
            assert out.columns == docs.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, out, "")
        texts = [(r.doc_id, r.text) for r in out.collect()]
        test_packing.check(texts, last.collect(), 4096)
        assert bool(texts) == (docs is not nothing)
    kept = [r for r in awkward_rows if test_quality.brute(r[1], r[2])[0][-1]]
    assert {r[1] for r in kept} >= {t for _, t in texts}
