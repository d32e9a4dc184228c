"""DuckDB oracle SQL for the registered queries (same column names)."""

from __future__ import annotations

from docloom.plans.sqlparts import (BUDGET, DIM, FILE, buckets, chunk_ctes, clean, embed_ctes, l2sq, passages_ctes,
                                    py_strip, suffix_label)

ORACLES: dict[str, str] = {}

CLEAN_DOCS = f"cd AS (SELECT doc_id, source, {clean('text')} AS text FROM documents)"

ORACLES["doc_id"] = f"SELECT {FILE} AS file, md5({FILE}) AS doc_id FROM documents"
ORACLES["source_label"] = (f"SELECT {FILE} AS file, {suffix_label(FILE)} AS source_suffix, "
                           f"trim({FILE}, '.pdf') AS source_charset FROM documents")
ORACLES["file_stem"] = f"SELECT {FILE} AS file, split_part({FILE}, '.', 1) AS stem FROM documents"
ORACLES["assemble_elements"] = ("SELECT CAST(conv_id AS VARCHAR) AS doc, string_agg(text, chr(10) ORDER BY turn) AS text "
                                "FROM conversations GROUP BY conv_id")
ORACLES["clean_whitespace"] = f"SELECT doc_id, {clean('text')} AS text FROM documents"
ORACLES["text_after_marker"] = f"""WITH {CLEAN_DOCS}
SELECT doc_id,
  CASE WHEN regexp_matches(text, '(?is)les?\\s?:') THEN {py_strip("regexp_extract(text, '(?is)les?\\s?:(.*)', 1)")} ELSE text END AS text,
  coalesce(regexp_matches(text, '(?is)les?\\s?:'), false) AS matched
FROM cd"""
ORACLES["copy_metadata"] = "SELECT doc_id, source, source AS filename FROM documents"

ORACLES["chunk_by_token_budget"] = f"WITH {CLEAN_DOCS}, {chunk_ctes('cd', 'doc_id')} SELECT doc_id, pos, text FROM ck_out"
ORACLES["chunk_id"] = f"WITH {CLEAN_DOCS}, {chunk_ctes('cd', 'doc_id')} SELECT doc_id, pos, md5(text) AS chunk_id FROM ck_out"
ORACLES["chunk_metadata"] = (f"WITH {CLEAN_DOCS}, {chunk_ctes('cd', 'doc_id, source')} "
                             "SELECT source, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM ck_out GROUP BY source")

ORACLES["embed_texts"] = f"""WITH {CLEAN_DOCS}, {embed_ctes('cd', 'doc_id', 'text', 'e')}
SELECT doc_id, idx, round(CAST(value AS DOUBLE), 6) AS value FROM e_dense"""
ORACLES["cls_pool"] = """SELECT vec_id AS id, CAST(i - 1 AS INTEGER) AS idx, round(CAST(embedding[i] AS DOUBLE), 6) AS value
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) // 4 + 1)) AS i FROM embeddings)"""
ORACLES["query_prefix"] = "SELECT item_id AS query_id, 'query: ' || text AS query FROM benchmark"

ORACLES["knn_topk"] = f"""WITH d AS (
  SELECT a.vec_id AS query_id, b.vec_id AS passage_id, round({l2sq('a.embedding', 'b.embedding')}, 9) AS score
  FROM embeddings a, embeddings b)
SELECT query_id, passage_id, CAST(rank AS INTEGER) AS rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, passage_id) AS rank FROM d) WHERE rank <= 20"""


def _rag_sql(k: int = 20, rerank_k: int = 10, dim: int = DIM) -> str:
    return f"""WITH {passages_ctes(BUDGET, dim)},
qb AS (SELECT item_id AS query_id, text AS question, 'query: ' || text AS qtext FROM benchmark),
{embed_ctes('qb', 'query_id', 'qtext', 'qe', dim)},
q0 AS (SELECT qb.query_id, qb.question, qe_vec.embedding AS v FROM qb JOIN qe_vec USING (query_id)),
h1 AS (SELECT * FROM (SELECT q0.query_id, psg.passage_id, round({l2sq('q0.v', 'psg.embedding')}, 9) AS score
          FROM q0, psg) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, passage_id) <= {k}),
h1r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, passage_id) AS rank FROM h1),
sums AS (SELECT h.query_id, i, sum(CAST(p.embedding[i] AS DOUBLE)) AS s, count(*) AS n
         FROM h1r h JOIN psg p USING (passage_id), range(1, {dim} + 1) r(i) GROUP BY h.query_id, i),
q1 AS (SELECT q0.query_id, list(( CAST(q0.v[s.i] AS DOUBLE) + s.s) / (s.n + 1) ORDER BY s.i) AS v
       FROM q0 JOIN sums s USING (query_id) GROUP BY q0.query_id),
h2 AS (SELECT * FROM (SELECT q1.query_id, psg.passage_id, round({l2sq('q1.v', 'psg.embedding')}, 9) AS score
          FROM q1, psg) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, passage_id) <= {k}),
h2r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, passage_id) AS rank FROM h2),
allh AS (SELECT query_id, passage_id, 1 AS hop, rank FROM h1r UNION ALL SELECT query_id, passage_id, 2 AS hop, rank FROM h2r),
dd AS (SELECT * FROM allh QUALIFY row_number() OVER (PARTITION BY query_id, passage_id ORDER BY hop, rank) = 1),
sc AS (SELECT dd.query_id, dd.passage_id, dd.hop, p.text, p.source,
         CAST(len(list_filter({buckets('q0.question', dim)}, lambda b: list_contains({buckets('p.text', dim)}, b))) AS DOUBLE) AS score
       FROM dd JOIN psg p USING (passage_id) JOIN q0 USING (query_id))
SELECT query_id, CAST(rank AS INTEGER) AS rank, passage_id, score, hop, text, source FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM sc)
WHERE rank <= {rerank_k}"""


ORACLES["rag_retrieve"] = _rag_sql()


def all_oracles() -> dict[str, str]:
    from docloom.plans.registry import EXTRA_ORACLES
    return {**ORACLES, **EXTRA_ORACLES}
