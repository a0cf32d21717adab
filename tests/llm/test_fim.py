import hashlib
import re
import time

from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import fim


def brute(doc_id, text, percent=90, spm=20):
    """(n, form, prefix, middle, output) over code points, one by one."""
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= percent:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def rows_of(df):
    cols = ["doc_id", "n", "form", "prefix_units", "middle_units", "output", fim.restored(df["output"], df["form"]).alias("back")]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_awkward(awkward, crowded, nothing, awkward_rows):
    want = sorted(((r[0], *brute(r[0], r[1]), r[1] or "") for r in awkward_rows), key=str)
    assert rows_of(fim.fill_in_middle(awkward)) == want
    crowd = fim.fill_in_middle(crowded)
    assert rows_of(crowd) == want
    assert {"text", "lang", "kept", "key"} <= set(crowd.columns) and len(set(crowd.columns)) == len(crowd.columns)
    assert fim.fill_in_middle(nothing).count() == 0


def test_marks_and_all_forms(spark):
    texts = ["a <P> b", "<S>", "x<M>", "<", "<<P", "S>", "ends with <", "<P", "a<S b>", "€" * 7, "\U0001f600" * 5 + "é", "\x00a\x00"]
    rows = [(k, t) for t in texts for k in range(40)]
    got = rows_of(fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == sorted(((k, *brute(k, t), t) for k, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_shares_and_names(spark):
    docs = spark.range(4000).selectExpr("id AS own", "concat('text ', id) AS body", "id AS n", "'z' AS output")
    out = fim.fill_in_middle(docs, "own", "body", fim_percent=50, spm_percent=50)
    assert out.columns == ["own", "body", "n", "form", "prefix_units", "middle_units", "output"]
    by = {r["form"]: r["count"] for r in out.groupBy("form").count().collect()}
    assert abs(by["plain"] - 2000) < 150 and abs(by["spm"] - 1000) < 150 and abs(by["psm"] - 1000) < 150


def naive_ends(data, unit):
    if unit == "chars":
        return [len(p.encode()) for p in (data.decode()[: k + 1] for k in range(len(data.decode())))]
    pattern = rb"[^\x20\x09-\x0D]+" if unit == "words" else rb"[^\n]*\n|[^\n]+$"
    return [m.end() for m in re.finditer(pattern, data)]


@given(st.text(alphabet="a \n\té€\U0001f600b.", max_size=80), st.sampled_from(["chars", "words", "lines"]))
def test_units(text, unit):
    data = text.encode()
    ends = naive_ends(data, unit)
    mask = fim.unit_ends(data, unit)
    assert mask.bit_count() == len(ends)
    assert [fim.place_of(mask, k, len(data)) + 1 for k in range(len(ends))] == ends
    for d in range(len(ends) + 1):
        n, at, places = fim.cuts(data, (d, 3 * len(ends) + 2), unit)
        assert n == len(ends) and at == sorted(at) and places == [ends[k - 1] if k else 0 for k in at]
        for form in ("psm", "spm"):
            out = fim.moved(data, places, form)
            parts = re.split(rb"<P>|<S>|<M>", out)
            assert (parts[1] + parts[3] + parts[2] if form == "psm" else parts[2] + parts[3] + parts[1]) == data


def test_words_and_lines(spark):
    docs = spark.createDataFrame([(k, "one two  three\nfour \n five ") for k in range(50)], "doc_id long, text string")
    for unit, n in (("words", 5), ("lines", 3)):
        got = fim.fill_in_middle(docs, unit=unit, fim_percent=100)
        assert {(r["n"], r["back"]) for r in got.select("n", fim.restored(got["output"], got["form"]).alias("back")).collect()} == {(n, "one two  three\nfour \n five ")}


def test_time_goes_with_the_text():
    began = time.perf_counter()
    data = "aé€".encode() * 2_000_000
    n, _, places = fim.cuts(data, (4_000_000, 1_234_567))
    assert n == 6_000_000 and places == [1_234_567 // 3 * 6 + 1, 1_333_333 * 6 + 1]
    assert time.perf_counter() - began < 5
