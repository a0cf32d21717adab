"""SQL for those queries of the text operators that SQL can express, from the same parameters.

The joins here are plain: the n-gram join counts shared n-grams of all pairs instead of banding, and
repeated windows meet by their words instead of by anchors.
"""

from __future__ import annotations

from tessera.llm import clustering, fim, mixing, near, quality, sharding, substrings

WORD = r"[^\x20\x09-\x0D]+"

#: Each row of documents with a number, as ids may repeat; then its words by place.
ROWS = f"r AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents)"
PLACED = "p AS (SELECT rid, doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM r)"


def _run(n: int) -> str:
    """The n words from a place on, in the window ``o``; null where fewer follow."""
    parts = ["word", *[f"lead(word, {k}) OVER o" for k in range(1, n)]]
    return " || ' ' || ".join(parts)


def _numbers(xs) -> str:
    return "[" + ", ".join(f"CAST({float(x)!r} AS DOUBLE)" for x in xs) + "]"


def _distance(p: str, q: str) -> str:
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    x, y = f"{p}[k]", f"{q}[k]"
    return f"sqrt(greatest(list_sum([{part(x, y)} + {part(y, x)} for k in range(1, len({q}) + 1)]), 0) / 2)"


def quality_sql(limits: quality.Limits = quality.Limits(), references: dict[str, quality.Reference] = quality.REFERENCES) -> str:
    rows = []
    for lang, x in references.items():
        words = "[" + ", ".join(f"'{w}'" for w in x.common) + "]"
        rows.append(f"('{lang}', {_numbers(x.classes)}, {words}, {_numbers(quality.among_themselves(x))})")
    removed = lambda text, pattern: f"length(regexp_replace({text}, '{pattern}', '', 'g'))"
    return rf"""WITH {ROWS}, {PLACED},
ref(name, classes, common, shares) AS (VALUES {", ".join(rows)}),
k AS (SELECT rid, i, {_run(quality.WINDOW)} AS k FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM k WHERE k IS NOT NULL) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + d.range) AS n FROM twice, range({quality.WINDOW}) d GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM r),
a AS (SELECT r.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {removed("t", "[^#*$%&|<>]+")} AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, length(t) AS n, regexp_replace(t, '\p{{L}}+', '', 'g') AS rest
  FROM r JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
b AS (SELECT *, {removed("t", r"[^\p{Lu}]+")} AS upper_n, n - length(rest) AS letter_n, {removed("rest", r"\P{Nd}+")} AS digit_n, n - word_chars AS space_n,
  {removed("rest", r"[^.,;:!?''" + '"' + r"()\-]+")} AS mark_n, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS own, len(regexp_extract_all(lower(t), '[^\p{{L}}\p{{N}}]+')) + 1 AS own_n FROM a),
c AS (SELECT *, [x / CAST(n AS DOUBLE) for x in [upper_n, letter_n - upper_n, digit_n, space_n, mark_n, length(rest) - digit_n - space_n - mark_n]] AS p FROM b),
f AS (SELECT c.rid, c.lang, own_n, ref.*, c.p, c.n, c.n_words, [len(list_filter(own, lambda x: x = v)) for v in common] AS found
  FROM c JOIN ref ON c.lang = ref.name OR c.lang IS NULL OR c.lang NOT IN (SELECT name FROM ref)),
g AS (SELECT *, list_sum(found) AS hits, [x / CAST(list_sum(found) AS DOUBLE) for x in found] AS q FROM f),
h AS (SELECT rid, min(CASE WHEN n >= {limits.guard_chars} THEN {_distance("p", "classes")} END) AS cd,
  bool_or(CASE WHEN n_words >= {limits.guard_words} AND (lang IS NULL OR lang = name) THEN hits / CAST(own_n AS DOUBLE) >= {limits.common_share} AND (hits < {limits.guard_common} OR {_distance("q", "shares")} <= {limits.word_distance}) END) AS fits FROM g GROUP BY rid),
z AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.max_repeat_percent} * n_words AS base_failed FROM a JOIN h USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND coalesce(cd <= {limits.class_distance}, true) AND coalesce(fits, true) AS kept FROM z"""


def substrings_sql(length: int = substrings.LENGTH) -> str:
    return f"""WITH {ROWS}, {PLACED},
k AS (SELECT *, {_run(length)} AS k FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
s AS (SELECT *, k IS NOT NULL AND min(doc_id) OVER (PARTITION BY k) < doc_id AS starts FROM k),
g AS (SELECT *, coalesce(bool_or(starts) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW), false) AS gone FROM s),
d AS (SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM r LEFT JOIN d USING (rid)"""


def near_sql(n: int = near.NGRAM, threshold: float = near.THRESHOLD) -> str:
    return f"""WITH RECURSIVE {ROWS}, {PLACED},
k AS (SELECT rid, doc_id, {_run(n)} AS k FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT DISTINCT rid, doc_id, k FROM k WHERE k IS NOT NULL UNION ALL SELECT rid, doc_id, array_to_string(w, ' ') FROM r WHERE len(w) BETWEEN 1 AND {n - 1}),
c AS (SELECT rid, doc_id, md5(string_agg(k, '  ' ORDER BY k)) AS key, count(*) AS size FROM g GROUP BY ALL),
class AS (SELECT key, min(doc_id) AS rep, count(*) AS docs, any_value(size) AS size, any_value(rid) AS rid FROM c GROUP BY key),
m AS MATERIALIZED (SELECT class.*, k FROM class JOIN g USING (rid)),
pair AS (SELECT a.rep AS a, b.rep AS b, any_value(a.size) AS na, any_value(b.size) AS nb, any_value(b.docs) AS docs, count(*) AS shared FROM m a JOIN m b ON a.k = b.k AND a.rep <> b.rep GROUP BY 1, 2),
link AS MATERIALIZED (SELECT * FROM pair WHERE shared >= {threshold} * (na + nb - shared)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
more AS (SELECT a, sum(docs) AS n FROM link GROUP BY a)
SELECT r.doc_id, coalesce(least(class.rep, low.least), class.rep, r.doc_id) AS class_id, coalesce(class.rep, r.doc_id) AS copy_class_id,
CAST(coalesce(class.docs - 1, 0) + coalesce(more.n, 0) AS BIGINT) AS n_links
FROM r LEFT JOIN c ON c.rid = r.rid LEFT JOIN class ON class.key = c.key LEFT JOIN low ON low.a = class.rep LEFT JOIN more ON more.a = class.rep"""


def mixing_sql(weights: tuple[int, ...] = (1, 2, 3), most: int = mixing.MAX_REPEATS, seed: int = mixing.SEED) -> str:
    """Sources are capped in the order of their room for a unit of weight, so one pass finds the level."""
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5(coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n FROM d GROUP BY source),
w AS (SELECT source, n, {most} * n AS cap, CAST([{", ".join(map(str, weights))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1] AS DOUBLE) AS weight FROM s),
o AS (SELECT *, sum(n) OVER () AS total, cap / weight AS room, coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
l AS (SELECT (total - before) / free AS level FROM o WHERE (total - before) / free <= room ORDER BY room, source LIMIT 1),
t AS (SELECT source, n, least(cap, weight * (SELECT level FROM l)) AS target FROM w),
x AS (SELECT d.*, n, target, CASE WHEN n > 0 THEN target / n ELSE 0 END AS rate,
  CAST('0x' || substr(md5(concat_ws(':', '{seed}', coalesce(CAST(doc_id AS VARCHAR), '\\N'), h)), 1, 13) AS BIGINT) / 4503599627370496.0 AS coin FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target, CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x"""


def fim_sql(seed: int = fim.SEED) -> str:
    draw = lambda k: f"CAST('0x' || substr(h, {8 * k - 7}, 8) AS BIGINT)"
    p, s, m = fim.PREFIX, fim.SUFFIX, fim.MIDDLE
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT *, least({draw(1)} % (n + 1), {draw(2)} % (n + 1)) AS a, greatest({draw(1)} % (n + 1), {draw(2)} % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR {draw(3)} % 100 >= {fim.FIM_PERCENT} THEN 'plain' WHEN {draw(4)} % 100 < {fim.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM d),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || substr(t, 1, a) || '{s}' || substr(t, b + 1) || '{m}' || substr(t, a + 1, b - a)
  ELSE '{s}' || substr(t, b + 1) || '{p}' || substr(t, 1, a) || '{m}' || substr(t, a + 1, b - a) END AS output FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""


def clustering_sql(k: int = clustering.K, rounds: int = clustering.ROUNDS, dim: int = clustering.DIM, scale: int = clustering.SCALE, seed: int = clustering.SEED) -> str:
    """Lloyd's rounds as a chain of tables: every vector is compared with every centroid in each."""
    out = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
f AS (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c FROM v),
c0 AS MATERIALIZED (SELECT c, v AS w FROM f WHERE c < {k})"""
    for n in range(rounds + 1):
        out += f""",
d{n} AS (SELECT rid, vec_id, c, CAST(list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{n}),
a{n} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, min(d) AS d, CAST(arg_min(c, d * {k} + c) AS INTEGER) AS c FROM d{n} GROUP BY rid)"""
        if n < rounds:
            out += f""",
p{n} AS (SELECT c, i, CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) AS s FROM (SELECT a{n}.c, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN (SELECT rid, unnest(v) AS x, unnest(range({dim})) AS i FROM v) USING (rid) GROUP BY 1, 2)),
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(m.w, c{n}.w) AS w FROM c{n} LEFT JOIN (SELECT c, list(s ORDER BY i) AS w FROM p{n} GROUP BY c) m USING (c))"""
    return out + f"""
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


def sharding_sql(t: sharding.Tree | None = None, seed: int = sharding.SEED) -> str:
    """Straws of all nodes for each id; the shortest of the children of each winner. The checksum goes byte by byte."""
    t = sharding.tree() if t is None else t
    straw = lambda name, w: f"-ln((CAST('0x' || substr(md5('{seed}:' || {name} || ':' || k), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / {w}"

    def descent(tree: sharding.Tree, out: str) -> str:
        rows = ", ".join(f"({s.shard}, {s.region}, {s.rack}, CAST({s.weight} AS DOUBLE))" for s in tree)
        return f"""{out}t(shard, region, rack, w) AS (VALUES {rows}),
{out}r AS (SELECT k, arg_min(region, {straw("'region:' || region", "w")}) AS region FROM ids, (SELECT region, sum(w) AS w FROM {out}t GROUP BY 1) GROUP BY k),
{out}c AS (SELECT k, any_value(region) AS region, arg_min(rack, {straw("'rack:' || region || ':' || rack", "w")}) AS rack FROM {out}r JOIN (SELECT region, rack, sum(w) AS w FROM {out}t GROUP BY 1, 2) USING (region) GROUP BY k),
{out} AS (SELECT k, CAST(arg_min(shard, {straw("'shard:' || shard", "w")}) AS INTEGER) AS shard FROM {out}c JOIN {out}t USING (region, rack) GROUP BY k)"""

    step = "(c >> 8)"
    for k in range(8):  # a byte's part of the checksum is the sum of its bits' parts
        part = 1 << k
        for _ in range(8):
            part = part >> 1 ^ 0xEDB88320 * (part & 1)
        step = f"xor({step}, (xor(c, b) >> {k} & 1) * {part})"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(CAST(doc_id AS VARCHAR), '\\N') AS k, coalesce(text, '') AS t, strlen(coalesce(text, '')) + {sharding.ROW_BYTES} AS size FROM documents),
ids AS (SELECT DISTINCT k FROM d),
{descent(t, "own")},
{descent(sharding.grown(t), "more")},
x AS (SELECT rid, hex(t) AS h FROM d),
crc AS (SELECT rid, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h), 2), lambda i: CAST('0x' || h[i + 1:i + 2] AS BIGINT))), lambda c, b: {step}), 4294967295) AS crc FROM x),
p AS (SELECT d.doc_id, d.size, crc.crc, own.shard, more.shard AS grown FROM d JOIN crc USING (rid) JOIN own ON own.k = d.k JOIN more ON more.k = d.k)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, crc, size) - 1 AS slot, grown AS grown_shard FROM p"""


ORACLES = {
    "op1_quality_rules": quality_sql(),
    "op3_substring_dedup": substrings_sql(),
    "op9_ngram_jaccard_join": near_sql(),
    "op10_mix_sources": mixing_sql(),
    "op11_fill_in_middle": fim_sql(),
    "op12_centroid_clustering": clustering_sql(),
    "op13_hash_tree_shards": sharding_sql(),
}
