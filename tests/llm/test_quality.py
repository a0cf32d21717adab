import math
import random
import re
import unicodedata
from collections import Counter

from tessera.llm import quality

LIMITS = quality.Limits()


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def brute(text, lang):
    t = text or ""
    w = _words(t)
    lines = [x for x in t.split("\n") if _words(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    refs = [quality.REFERENCES[lang]] if lang in quality.REFERENCES else list(quality.REFERENCES.values())

    def js(p, q):
        part = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
        return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q, strict=True)) / 2))

    chars = Counter()
    for c in t:
        kind = unicodedata.category(c)
        chars["upper" if kind == "Lu" else "letter" if kind[0] == "L" else "digit" if kind == "Nd" else "space" if c in " \t\n\v\f\r" else "mark" if c in ".,;:!?'\"()-" else "other"] += 1
    a = min(js([chars[k] / len(t) for k in quality.CLASSES], r.classes) for r in refs) if len(t) >= LIMITS.guard_chars else None
    b = share = None
    fits = True
    if len(w) >= LIMITS.guard_words and (lang is None or lang in quality.REFERENCES):
        found = [x for x in re.split(r"[\W_]+", t.lower()) if x]
        total = max(1, len(found) + (not re.match(r"[^\W_]", t)) + (not re.search(r"[^\W_]\Z", t)))
        judged = []
        for r in refs:
            counts = [found.count(x) for x in r.common]
            hits, all_of = sum(counts), sum(r.common.values())
            judged.append((hits / total, js([c / hits for c in counts], [v / all_of for v in r.common.values()]) if hits >= LIMITS.guard_common else None))
        share, b = max(x for x, _ in judged), min((y for _, y in judged if y is not None), default=None)
        fits = any(x >= LIMITS.common_share and (y is None or y <= LIMITS.word_distance) for x, y in judged)
    kept = not failed and (a is None or a <= LIMITS.class_distance) and fits
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, kept), a, b, share


def test_against_brute_force(spark, awkward, awkward_rows):
    docs = awkward.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = quality.quality_signals(docs, keep=("doc_id", "text", "lang")).collect()
    assert len(got) == docs.count()
    for r in got:
        want, a, b, share = brute(r.text, r.lang)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == want, r.doc_id
        for x, y in ((r.class_distance, a), (r.word_distance, b), (r.common_share, share)):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9), r.doc_id


def test_filter_keeps_columns(crowded, nothing, awkward_rows):
    kept = quality.quality_filter(crowded)
    assert kept.columns == crowded.columns
    want = [r[:2] for r in awkward_rows if brute(r[1], r[2])[0][-1]]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str) and 0 < len(want) < len(awkward_rows)
    assert quality.quality_filter(nothing).count() == 0


def test_labelled_rows(spark):
    """Clean rows stay, junk goes, on rows that the references weren't fitted on."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    got = quality.quality_signals(docs, keep=("doc_id", "quality")).toPandas()
    judged = got[~got.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.98
    assert judged[judged.quality == 0].kept.mean() < 0.15


def test_words_decide(spark):
    """Texts of another language, word lists and invented words go, though their characters are those of prose."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id").where("n_chars > 600").collect()
    other = {"en": "de", "de": "fr", "fr": "es", "es": "en"}
    rng = random.Random(3)
    vocabulary = [x for r in docs for x in r.text.lower().split()]
    common = {x for r in quality.REFERENCES.values() for x in r.common}
    bare = [x.capitalize() if rng.random() < 0.1 else x for x in vocabulary if x.strip(".,") not in common]
    lists = [" ".join(rng.sample(bare, 150)) for _ in range(20)]
    rows = [("own", r.text, r.lang) for r in docs] + [("other", r.text, other[r.lang]) for r in docs] + [("list", t, "en") for t in lists]
    got = quality.quality_signals(spark.createDataFrame(rows, "what string, text string, lang string"), keep=("what",)).toPandas().groupby("what").agg(kept=("kept", "mean"), base=("base_failed", "mean"))
    assert got.kept["own"] > 0.98 and got.kept["other"] < 0.1 and got.kept["list"] == 0 and got.base["list"] < 0.1


def test_references_from_a_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    refs = quality.fit_references(docs, {"en": ["the", "of"], "qq": ["z"]})
    assert set(refs) == {"en"} and abs(sum(refs["en"].classes) - 1) < 1e-9 and refs["en"].common["the"] > 0.02
