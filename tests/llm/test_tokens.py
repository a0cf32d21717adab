from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import tokens
from tessera.llm.queries import BYTE_TOKENIZER


def brute(text, rule):
    """Byte by byte: each token goes by its bytes' sections."""
    encoding, _ = tokens._encoding(BYTE_TOKENIZER, public_tokenizers.PATTERN)
    ends = tokens.line_ends(text)
    section = [k for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) for _ in text[a:b].encode()]
    out, at = [0] * len(ends), 0
    for t in encoding.encode_ordinary(text):
        own = section[at : at + len(encoding.decode_single_token_bytes(t))]
        at += len(own)
        out[own[0] if rule == "first" else max(sorted(set(own)), key=own.count)] += 1
    assert at == len(section)
    return out


@pytest.mark.parametrize("rule", ["most", "first"])
def test_against_brute_force(spark, awkward, rule):
    odd = spark.createDataFrame([(50, "a\n\n\n\nb\n \n  c"), (51, "\n"), (52, "x\n\n"), (53, "é\n\U0001f600\n\n日本\n")], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").unionByName(odd).unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text"))
    got, want = Counter(), Counter()
    for r in tokens.section_tokens(docs, BYTE_TOKENIZER, public_tokenizers.PATTERN, rule=rule).collect():
        got[tuple(r)] += 1
    for r in docs.collect():  # repeated rows and those without an id count each
        ends = tokens.line_ends(r.text) if r.text else []
        for k, (a, b, n) in enumerate(zip([0, *ends], ends, brute(r.text, rule) if r.text else [], strict=False)):
            want[(r.doc_id, k, a, b, n)] += 1
    assert got == want


def test_documents_are_encoded_once(awkward):
    plan = tokens.section_tokens(awkward, BYTE_TOKENIZER, public_tokenizers.PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_fields(spark):
    encoding, _ = tokens._encoding(BYTE_TOKENIZER, public_tokenizers.PATTERN)
    docs = spark.createDataFrame([(1, "A title", "the body\nof it"), (None, None, "x"), (2, "", None), (2, "", None)], "doc_id long, title string, body string")
    got = sorted(tokens.section_tokens(docs, BYTE_TOKENIZER, public_tokenizers.PATTERN, fields=("title", "body")).collect(), key=str)
    whole = {r.doc_id: 0 for r in got}
    for r in got:
        whole[r.doc_id] += r.n_tokens
    assert whole == {1: len(encoding.encode_ordinary("A title\nthe body\nof it")), None: len(encoding.encode_ordinary("\nx")), 2: 2}
    assert [tuple(r)[:4] for r in got if r.doc_id == 1] == [(1, 0, 0, 8), (1, 1, 8, 22)]


def test_rule():
    lengths, ends = np.array([3, 4, 2, 5]), np.array([4, 8, 14])
    assert tokens.attribute(lengths, ends, "first").tolist() == [2, 1, 1]
    assert tokens.attribute(lengths, ends, "most").tolist() == [1, 2, 1]
    with pytest.raises(ValueError):
        tokens.attribute(lengths, ends, "other")


def test_other_shapes(crowded, nothing):
    assert tokens.section_tokens(crowded, BYTE_TOKENIZER, public_tokenizers.PATTERN).columns == ["doc_id", "section", "start", "end", "n_tokens"]
    assert tokens.section_tokens(nothing, BYTE_TOKENIZER, public_tokenizers.PATTERN).count() == 0
