"""DuckDB SQL for the queries whose results SQL can express exactly."""

from __future__ import annotations

# A-Z folded, then the runs of digits, letters and characters above ASCII: the words of all operators here
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_FOLD)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE k >= 0.8 * (na + nb - k) - 1e-9),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT node AS doc_id, min(seen) AS class_id, node = min(seen) AS kept FROM r GROUP BY node"""

OP7 = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS m FROM v WHERE e IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.m > 0 AND b.m > 0
      AND list_dot_product(a.e, b.e) / (a.m * b.m) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT node AS vec_id, coalesce(max(n.n), 0) AS n_links, min(seen) AS component_id, node = min(seen) AS kept
FROM r LEFT JOIN n ON n.vec_id = r.node GROUP BY node"""

# a unit ends before a newline (kept here as chr(2)) or after a stop before a blank; pieces cover the whole text
_PIECES = r"string_split(replace(regexp_replace({}, '([.!?])([ \t])', '\1' || chr(1) || '\2', 'g'), chr(10), chr(2) || chr(1)), chr(1))"
OP8 = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_PIECES.format("coalesce(text, '')")} AS parts,
             {_PIECES.format(_FOLD)} AS folded FROM documents),
u AS (SELECT doc_id, coalesce(list_sum(list_transform(parts[1:j - 1], lambda x: length(x))), 0)::BIGINT AS start,
        length(parts[j]) - CAST(ends_with(parts[j], chr(2)) AS INTEGER) AS n,
        {_WORDS.format('folded[j]')} AS w FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS j FROM t)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS i,
        row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, start) AS nth FROM u WHERE len(w) >= 5),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM k WHERE nth > 1),
g AS (SELECT doc_id, min(start) AS a, max(start + n) AS b FROM r GROUP BY doc_id, run HAVING sum(len(w)) >= 25),
p AS (SELECT doc_id, count(*) AS n_removed, sum(b - a) AS gone, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM g GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_units FROM k GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n_units, 0) AS INTEGER) AS n_units, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed,
  CAST(length(t.text) - coalesce(gone, 0) AS BIGINT) AS kept_chars, coalesce(spans, '') AS spans
FROM t LEFT JOIN p USING (doc_id) LEFT JOIN c USING (doc_id)"""


OP11 = f"""WITH d AS MATERIALIZED (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all({_FOLD}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs
  FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
t AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(sum(s.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) d
  LEFT JOIN (SELECT c.* FROM c JOIN k USING (lang, term)) s ON s.lang = d.lang AND s.source = d.source GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + 1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT // (g.total + t.v) AS BIGINT) AS p,
    CAST(1 + 1000000000 * (k.n + 1)::HUGEINT // (t.total + t.v) AS BIGINT) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN t ON t.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM o)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200"""


# groups one by one onto the least-loaded shard; of equal sizes those of the lower digest go to the lower shard.
# crc32 has no function there: its table, then a fold over the bytes
OP12 = r"""WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, md5(md5(coalesce(text, ''))) AS key,
    strlen(coalesce(text, '')) + 1 AS size FROM documents),
g AS MATERIALIZED (SELECT key, CAST(sum(size) AS BIGINT) AS size FROM t GROUP BY key),
o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY size DESC) AS i, size FROM g),
l AS (SELECT 0::BIGINT AS i, 0::BIGINT AS size, 0 AS shard, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0] AS loads
  UNION ALL SELECT o.i, o.size, list_position(loads, list_min(loads)) - 1,
    list_transform(loads, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN x + o.size ELSE x END) FROM l JOIN o ON o.i = l.i + 1),
c AS (SELECT size, shard, count(*) AS n FROM l WHERE i > 0 GROUP BY ALL),
p AS (SELECT size, shard, sum(n) OVER (PARTITION BY size ORDER BY shard) AS hi, sum(n) OVER (PARTITION BY size ORDER BY shard) - n AS lo FROM c),
r AS (SELECT key, size, row_number() OVER (PARTITION BY size ORDER BY key) - 1 AS rank FROM g),
s AS (SELECT r.key, p.shard FROM r JOIN p ON p.size = r.size AND r.rank >= p.lo AND r.rank < p.hi),
b AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab),
x AS (SELECT key, any_value(text) AS text FROM t GROUP BY key),
y AS MATERIALIZED (SELECT key, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM x),
z AS MATERIALIZED (SELECT key, xor(list_reduce(bytes, lambda a, v: xor(a >> 8, tab[xor(a & 255, v) + 1]), 4294967295), 4294967295) AS crc FROM y, b)
SELECT t.doc_id, t.size, z.crc AS text_crc32, 'bytes' AS law, CAST(s.shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY s.shard ORDER BY md5(coalesce(CAST(t.doc_id AS VARCHAR), '')), t.key) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM t JOIN s USING (key) JOIN z USING (key)"""


def _op13(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds unrolled: a<i> assigns parts to book b<i>, b<i + 1> is the next book."""
    near = """a{i} AS MATERIALIZED (SELECT x.rid, x.k, min(list_sum(list_transform(list_zip(x.x, b.x),
  lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 256 + b.j) AS dj FROM x JOIN b{i} b ON b.k = x.k GROUP BY ALL)"""
    book = """s{i} AS (SELECT x.k, a.dj % 256 AS j, pos, sum(x.x[pos]) AS s, count(*) AS n
  FROM a{i} a JOIN x ON x.rid = a.rid AND x.k = a.k, unnest(range(1, len(x.x) + 1)) AS u(pos) GROUP BY ALL),
m{i} AS (SELECT k, j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS x FROM s{i} GROUP BY ALL),
b{n} AS MATERIALIZED (SELECT b.k, b.j, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m ON m.k = b.k AND m.j = b.j)"""
    steps = [t.format(i=i, n=i + 1) for i in range(rounds) for t in (near, book)] + [near.format(i=rounds)]
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
    list_transform(embedding, lambda y: CAST(floor(4096 * CAST(y AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(CAST(y AS DOUBLE)))) = 0),
x AS MATERIALIZED (SELECT rid, k, e[k * (len(e) // {parts}) + 1:(k + 1) * (len(e) // {parts})] AS x FROM v, range({parts}) AS t(k)),
b0 AS MATERIALIZED (SELECT k, rid - 1 AS j, x FROM x WHERE rid <= {entries}),
{", ".join(steps)},
c AS (SELECT rid, string_agg(printf('%02x', CAST(dj % 256 AS INTEGER)), '' ORDER BY k) AS code, CAST(sum(dj // 256) AS BIGINT) AS error
  FROM a{rounds} GROUP BY rid),
h AS (SELECT sha256(string_agg(y, ',' ORDER BY k, j)) AS sha FROM (SELECT k, j, array_to_string(x, ',') AS y FROM b{rounds})),
l AS (SELECT v.label, CAST(sum(c.error) AS BIGINT) AS label_error FROM v JOIN c USING (rid) GROUP BY v.label)
SELECT v.vec_id, c.code, c.error, l.label_error, h.sha AS codebooks_sha256
FROM v JOIN c USING (rid) JOIN l ON l.label IS NOT DISTINCT FROM v.label, h"""


ORACLES = {"op5_minhash_near_dedup": OP5, "op7_embedding_near_dedup": OP7, "op8_substring_dedup": OP8,
           "op11_source_divergence": OP11, "op12_sharding": OP12,
           "op13_vector_codes": _op13()}
