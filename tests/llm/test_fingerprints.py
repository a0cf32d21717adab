import hashlib
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import fingerprints
from tessera.llm.queries import op8_order_minhash


def spark_hash(*values):
    """xxhash64() of strings (str), numbers (bytes of their width) and nulls, as an unsigned number."""
    h = 42
    for v in values:
        h = h if v is None else xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, seed=h)
    return h


def num(x, n):
    return (x % (1 << 8 * n)).to_bytes(n, "little")


def brute_print(text):
    """Order MinHash by its definition: all elements under all hash functions."""
    words = [w.decode() for w in (text or "").encode().split()]
    kmers = [spark_hash(*words[i : i + 2]) for i in range(max(1, len(words) - 1))]
    seen, elements = Counter(), []
    for k in kmers:
        elements.append(spark_hash(num(k, 8), num(seen[k], 4)))
        seen[k] += 1
    out = []
    for base in range(fingerprints.BASES):
        g = [spark_hash(num(h, 8), num(base, 4)) for h in elements]
        for t in range(fingerprints.TURNS):
            start = t << (64 - fingerprints.TURN_BITS)
            least = sorted(range(len(g)), key=lambda p: (g[p] - start) % (1 << 64))[:2]
            h = spark_hash(num(base * fingerprints.TURNS + t, 4), *[num(elements[p], 8) for p in sorted(least)])
            out.append(h - (1 << 64) if h >> 63 else h)
    return out


def edited(rows):
    """(doc_id, text, edited text, next text) of rows by descending id, those without one last."""
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), -(spark_hash(r[1]) >> 4), r[1]))
    out = []
    for k, (d, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        third = len(t) // 3
        out.append((d, t, t[: len(t) - third] + following[:third], following))
    return out


def run(df, rows_each=4000):
    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = fingerprints.with_fingerprint(docs, "text", "print")
    pairs = fingerprints.with_next(own, "doc_id", ["text", "print"], rows_each=rows_each)
    return pairs.select("*", fingerprints.edited_by_next(F.col("text"), F.col("text_next")).alias("edited"))


@pytest.mark.parametrize("rows_each", [1, 3, 4000])
def test_next_document(awkward, awkward_rows, rows_each):
    got = sorted(((r.doc_id, r.text, r.edited, r.text_next) for r in run(awkward, rows_each).collect()), key=str)
    assert got == sorted(edited([r[:2] for r in awkward_rows]), key=str)


def test_query(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op8_order_minhash(spark, str(tmp_path)).collect()}
    want = edited([(r.doc_id, r.text) for r in docs.collect()])
    assert len(got) == len(want)
    for d, t, e, _ in want:
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    long = [r for r in got.values() if r.n_chars > 1000]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)
    by_text = {}
    for d, t, _, _ in want:
        assert by_text.setdefault(t, got[d].fingerprint) == got[d].fingerprint


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return {r.i: r.p for r in fingerprints.with_fingerprint(df, "text", "p").collect()}, df


def alike(a, b):
    return len(set(a) & set(b)) / fingerprints.ENTRIES


def test_against_brute_force(spark, awkward_rows):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [r[1] for r in awkward_rows] + [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 2, 3, 5, 20, 90, 97, 98, 99, 120, 300, 3000)] + ["a " * 500]
    p, _ = prints(spark, texts)
    assert [list(p[i]) for i in range(len(texts))] == [brute_print(t) for t in texts]


def test_texts_with_few_elements_beyond_a_start_are_sorted_whole(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "NEAR", 2)
    texts = [" ".join(f"{k}x{i}" for i in range(150)) for k in range(8)]
    p, _ = prints(spark, texts)
    assert [list(p[i]) for i in range(len(texts))] == [brute_print(t) for t in texts]


@pytest.mark.parametrize("n", [20, 60, 150, 600])
def test_likeness_follows_order_at_any_length(spark, n):
    """Blocks of ten words in another order: nine of ten k-mers stay, likeness falls to about the share of pairs that keep both their k-mers and their order."""
    rng = random.Random(n)
    near, far = [], []
    for trial in range(30):
        words = [f"t{trial}w{i}" for i in range(n)]
        blocks = [words[i : i + 10] for i in range(0, n, 10)]
        far += [" ".join(words), " ".join(w for b in reversed(blocks) for w in b)]
        few = words[:]
        few[rng.randrange(n)] = "changed"
        near += [" ".join(words), " ".join(few)]
    p, _ = prints(spark, near + far)
    mean = lambda at: sum(alike(p[i], p[i + 1]) for i in range(at, at + 60, 2)) / 30
    kept = (0.9 * n) / (1.1 * n)  # Jaccard index of the k-mers, about
    assert mean(60) < 0.62 * kept + 0.1
    assert mean(0) > ((n - 2) / (n + 2)) ** 2 - 0.12 and mean(0) > mean(60) + 0.2


def test_order_and_repeats_count(spark):
    words = [f"w{i}" for i in range(300)]
    other = words[150:] + words[:150]
    texts = [" ".join(words), " ".join(words[:290] + ["x"] * 10), " ".join(other), "  ".join(words), "a b " * 50, "a b " * 25, "", " \n", "one", "one", " ".join(reversed(words))]
    p, df = prints(spark, texts)
    assert p[0] == p[3] and p[6] == p[7] and p[8] == p[9] and len(p[6]) == len(p[8]) == fingerprints.ENTRIES
    assert 0.75 < alike(p[0], p[1]) < 1 and alike(p[0], p[10]) == 0
    assert alike(p[0], p[2]) < alike(p[0], p[1])  # the same k-mers but one, in another order
    assert p[4] != p[5]  # occurrences are told apart
    got = df.alias("a").join(df.alias("b"), F.lit(True)).where("a.i < 3 and b.i < 3")
    both = fingerprints.with_fingerprint(fingerprints.with_fingerprint(got.select(F.col("a.text").alias("x"), F.col("b.text").alias("y"), F.col("a.i").alias("i"), F.col("b.i").alias("j")), "x", "p"), "y", "q")
    for r in both.select("i", "j", fingerprints.likeness(F.col("p"), F.col("q")).alias("l")).collect():
        assert abs(r.l - alike(p[r.i], p[r.j])) < 1e-12


def test_other_shapes(nothing, crowded, awkward):
    assert run(nothing).count() == 0
    extra = crowded.withColumn("w", F.lit(1)).withColumn("row", F.lit(2)).withColumn("e", F.lit(3)).withColumn("part", F.lit(4)).withColumn("key", F.lit(5)).withColumn("s0", F.lit(6))
    got = fingerprints.with_fingerprint(extra, "text", "print")
    assert got.columns == [*extra.columns, "print"] and got.select("key", "e").distinct().collect() == [(5, 3)]
    plain = sorted(map(str, fingerprints.with_fingerprint(awkward, "text", "print").select("print").collect()))
    assert sorted(map(str, got.select("print").collect())) == plain
    following = fingerprints.with_next(extra, "doc_id", ["text"])
    assert following.columns == [*extra.columns, "text_next"]
    assert sorted(str(r.text_next) for r in following.collect()) == sorted(str(r.text) for r in extra.collect())


def test_one_id_has_most_rows(spark):
    """Ranges split rows of one id, and those without any, as well."""
    rows = [(7 if i % 3 else None, f"text {i}") for i in range(400)] + [(i, f"t{i}") for i in range(100)] + [(1 << 60, "far"), (-5, "low")]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"), rows_each=20)
    assert sorted(((r.doc_id, r.text, r.edited, r.text_next) for r in got.collect()), key=str) == sorted(edited(rows), key=str)
