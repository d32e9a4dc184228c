"""DuckDB SQL fragments for the oracle queries (the independent check).

These restate each operator's rule in plain SQL; they share only the fixed
constants (regex classes, budgets) with the Spark code.
"""

from __future__ import annotations

from docloom.functions.text import PY_WHITESPACE

BUDGET = 510
DIM = 64


def clean(x: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace({x}, '[\\x{{A0}}\\n]', ' ', 'g'), ' {{2,}}', ' ', 'g'), "
            f"'^{PY_WHITESPACE}+|{PY_WHITESPACE}+$', '', 'g')")


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_WHITESPACE}+|{PY_WHITESPACE}+$', '', 'g')"


FILE = "('pdf-' || source || '-' || CAST(doc_id AS VARCHAR) || '.pdf')"


def suffix_label(f: str) -> str:
    return f"regexp_replace({f}, '\\.pdf$', '')"


def buckets(text: str, dim: int = DIM) -> str:
    return (f"list_transform(list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''), "
            f"lambda t: CAST((('0x' || substr(md5(t), 1, 8))::BIGINT) % {dim} AS INTEGER))")


def embed_ctes(src: str, key: str, text: str, prefix: str, dim: int = DIM) -> str:
    """CTEs ending in ``{prefix}_dense(key, idx, value FLOAT)`` and
    ``{prefix}_vec(key, embedding FLOAT[])``: hash embedding of ``text``."""
    return f"""
{prefix}_b AS (SELECT {key} AS k, unnest({buckets(text, dim)}) AS bk FROM {src}),
{prefix}_cnt AS (SELECT k, bk, count(*) AS c FROM {prefix}_b GROUP BY k, bk),
{prefix}_nrm AS (SELECT k, sqrt(sum(CAST(c AS DOUBLE) * c)) AS n FROM {prefix}_cnt GROUP BY k),
{prefix}_dense AS (SELECT s.{key} AS {key}, CAST(r.i AS INTEGER) AS idx,
      CAST(coalesce(c.c / n.n, 0) AS FLOAT) AS value
    FROM {src} s CROSS JOIN range({dim}) r(i)
    LEFT JOIN {prefix}_nrm n ON n.k = s.{key}
    LEFT JOIN {prefix}_cnt c ON c.k = s.{key} AND c.bk = r.i),
{prefix}_vec AS (SELECT {key}, list(value ORDER BY idx) AS embedding FROM {prefix}_dense GROUP BY {key})"""


def l2sq(a: str, b: str) -> str:
    return (f"list_sum(list_transform(range(1, len({a}) + 1), "
            f"lambda i: (CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE)) * (CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE))))")


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"


def chunk_ctes(src: str, keys: str, budget: int = BUDGET, prefix: str = "ck") -> str:
    """CTEs ending in ``{prefix}_out(keys..., pos, text)`` for the documents
    of ``src`` (keys..., text) that have no word over the budget."""
    return f"""
{prefix}_w AS (SELECT {keys}, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM {src} WHERE text IS NOT NULL),
{prefix}_c AS (SELECT *, list_transform(ws, lambda w: greatest(1, ceil(length(w) / 4))::INTEGER) AS cs FROM {prefix}_w),
{prefix}_s AS (SELECT {keys}, ws, list_reduce(cs, lambda acc, x: {{'s': CASE WHEN acc.cur + x > {budget} THEN list_append(acc.s, acc.i) ELSE acc.s END,
      'cur': CASE WHEN acc.cur + x > {budget} THEN x ELSE acc.cur + x END, 'i': acc.i + 1}},
      {{'s': [1], 'cur': 0, 'i': 1}}).s AS st
    FROM {prefix}_c WHERE len(cs) > 0 AND list_max(cs) <= {budget}),
{prefix}_j AS (SELECT {keys}, ws, st, unnest(range(1, len(st) + 1)) AS j FROM {prefix}_s),
{prefix}_out AS (SELECT {keys}, CAST(j - 1 AS INTEGER) AS pos,
      array_to_string(ws[st[j]:coalesce(st[j + 1] - 1, len(ws))], ' ') AS text FROM {prefix}_j)"""


def passages_ctes(budget: int = BUDGET, dim: int = DIM) -> str:
    """CTEs ending in ``psg(passage_id, doc_id, pos, text, source, embedding)``:
    the collection built from ``documents`` (clean, chunk, first per chunk
    id, hash embedding)."""
    return f"""
pdoc AS (SELECT md5({FILE}) AS doc_id, {suffix_label(FILE)} AS source, {clean('text')} AS text FROM documents),
{chunk_ctes('pdoc', 'doc_id, source', budget, 'pc')},
pfirst AS (SELECT md5(text) AS passage_id, doc_id, pos, text, source,
      row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id, pos) AS rn FROM pc_out),
pb AS (SELECT passage_id, doc_id, pos, text, source FROM pfirst WHERE rn = 1),
{embed_ctes('pb', 'passage_id', 'text', 'pe', dim)},
psg AS (SELECT pb.*, pe_vec.embedding FROM pb JOIN pe_vec USING (passage_id))"""


def hops_ctes(q0: str, psg: str, k: int = 20, prefix: str = "h") -> str:
    """Two-hop retrieval with the mean (Rocchio) rewriter, as CTEs ending in
    ``{prefix}_all(query_id, passage_id, hop, rank, score)``.
    ``q0(query_id, v)``, ``psg(passage_id, embedding)``."""
    return f"""
{prefix}1 AS (SELECT * FROM (SELECT q.query_id, p.passage_id, round({l2sq('q.v', 'p.embedding')}, 9) AS score
      FROM {q0} q, {psg} p) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, passage_id) <= {k}),
{prefix}1r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, passage_id) AS rank FROM {prefix}1),
{prefix}_sums AS (SELECT query_id, i, sum(x) AS s, count(*) AS n FROM (
      SELECT h.query_id, unnest(range(1, len(p.embedding) + 1)) AS i, unnest(p.embedding)::DOUBLE AS x
      FROM {prefix}1r h JOIN {psg} p USING (passage_id)) GROUP BY query_id, i),
{prefix}_q1 AS (SELECT q.query_id, list((CAST(q.v[s.i] AS DOUBLE) + s.s) / (s.n + 1) ORDER BY s.i) AS v
      FROM {q0} q JOIN {prefix}_sums s USING (query_id) GROUP BY q.query_id),
{prefix}2 AS (SELECT * FROM (SELECT q.query_id, p.passage_id, round({l2sq('q.v', 'p.embedding')}, 9) AS score
      FROM {prefix}_q1 q, {psg} p) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, passage_id) <= {k}),
{prefix}2r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, passage_id) AS rank FROM {prefix}2),
{prefix}_all AS (SELECT query_id, passage_id, 1 AS hop, rank, score FROM {prefix}1r
      UNION ALL SELECT query_id, passage_id, 2 AS hop, rank, score FROM {prefix}2r)"""


def maxsim(q: str, p: str, n_tok: int = 4) -> str:
    d = f"(len({q}) // {n_tok})"
    return (f"list_sum(list_transform(range({n_tok}), lambda i: list_max(list_transform(range({n_tok}), lambda j: "
            f"list_sum(list_transform(range(1, {d} + 1), lambda t: CAST({q}[i * {d} + t] AS DOUBLE) * CAST({p}[j * {d} + t] AS DOUBLE)))))))")
