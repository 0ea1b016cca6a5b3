"""DuckDB twins of the registered queries (same column names and rounding)."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

DOCS = (
    "docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, lang, source, "
    "'lang=' || lang || ',source=' || source AS meta FROM documents)"
)
VECS = "vecs AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding, label FROM embeddings)"
# Vectors that have a document (orphans dropped before ranking).
LIVE = "live AS (SELECT * FROM vecs WHERE id IN (SELECT id FROM docs))"


def sq_l2(a: str, b: str) -> str:
    return (
        f"list_sum(list_transform(list_zip(({a})::DOUBLE[], ({b})::DOUBLE[]), "
        f"lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    )


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip(({a})::DOUBLE[], ({b})::DOUBLE[]), lambda p: p[1] * p[2]))"


def norm(a: str) -> str:
    return f"sqrt(list_sum(list_transform(({a})::DOUBLE[], lambda x: x * x)))"


def fold(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{LOWER}')"


def knn_all_sql(k: int, threshold: float | None = None, extra_cols: str = "") -> str:
    """Every vector as a query over the live vectors; rank by (round(d,9), id)."""
    thr = f"AND 1.0 / (1.0 + dist) >= {threshold}" if threshold else ""
    return f"""
WITH {DOCS}, {VECS}, {LIVE},
d AS (SELECT q.id AS query_id, v.id, {sq_l2('v.embedding', 'q.embedding')} AS dist
      FROM vecs q, live v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id) AS rank FROM d)
SELECT query_id, rank, id, round(dist, 6) AS dist, round(1.0 / (1.0 + dist), 6) AS score {extra_cols}
FROM r WHERE rank <= {k} {thr}
"""


SQL: dict[str, str] = {}

SQL["semantic_search_vector"] = f"""
WITH {DOCS}, {VECS}, {LIVE},
q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 7),
d AS (SELECT v.id, {sq_l2('v.embedding', 'q.qe')} AS dist FROM live v, q),
r AS (SELECT id, dist, row_number() OVER (ORDER BY round(dist, 9), id) AS rank FROM d)
SELECT r.rank, r.id, docs.text, round(1.0 / (1.0 + r.dist), 6) AS score, docs.meta AS metadata
FROM r JOIN docs USING (id) WHERE r.rank <= 10
"""

SQL["semantic_search_batch"] = knn_all_sql(10)

SQL["semantic_search_bounded"] = knn_all_sql(10)

SQL["semantic_search_threshold"] = f"""
WITH t AS ({knn_all_sql(10, 0.6)})
SELECT query_id, rank, id, score FROM t
"""

SQL["list_all"] = f"WITH {DOCS} SELECT id, text, meta AS metadata FROM docs"
SQL["list_ids"] = f"WITH {DOCS} SELECT id FROM docs"
SQL["get_by_id"] = f"WITH {DOCS} SELECT id, text, meta AS metadata FROM docs WHERE id = '42'"

IDS = (
    "ids AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM labels "
    "UNION ALL SELECT 'conv-' || CAST(conv_id AS VARCHAR) FROM conversations)"
)
SQL["get_by_ids"] = f"""
WITH {DOCS}, {IDS}
SELECT id, text, meta AS metadata FROM docs WHERE id IN (SELECT id FROM ids)
"""
SQL["exists_flags"] = f"""
WITH {DOCS}, {IDS}
SELECT DISTINCT id, id IN (SELECT id FROM docs) AS "exists" FROM ids
"""
SQL["count_all"] = "SELECT count(*) AS count FROM documents"
SQL["count_by_metadata"] = "SELECT count(*) AS count FROM documents WHERE lang = 'en'"
SQL["count_by_metadata_grouped"] = """
SELECT key, value, count(*) AS count FROM (
  SELECT 'lang' AS key, lang AS value FROM documents
  UNION ALL SELECT 'source', source FROM documents) GROUP BY key, value
"""

SQL["metadata_fold"] = f"WITH {DOCS} SELECT id AS document_id, meta AS metadata FROM docs"
SQL["metadata_explode"] = f"""
WITH {DOCS}
SELECT id AS document_id, 'lang' AS key, lang AS value FROM docs
UNION ALL SELECT id, 'source', source FROM docs
"""
SQL["metadata_join"] = f"""
WITH {DOCS},
meta AS (SELECT id AS document_id, 'lang' AS key, lang AS value FROM docs
         UNION ALL SELECT id, 'source', source FROM docs)
SELECT DISTINCT d.id, d.text FROM docs d JOIN meta m ON d.id = m.document_id
WHERE m.key = 'lang' AND m.value = 'fr'
"""
SQL["metadata_search"] = f"""
WITH {DOCS}
SELECT row_number() OVER (ORDER BY id) AS rank, id, text, 1.0::DOUBLE AS score, meta AS metadata
FROM (SELECT * FROM docs WHERE lang = 'fr' ORDER BY id LIMIT 10)
"""
SQL["list_by_metadata"] = f"""
WITH {DOCS}
SELECT id, text, meta AS metadata FROM docs WHERE source = 'src3'
"""
SQL["list_by_metadata_capped"] = f"""
WITH {DOCS}
SELECT id, text, meta AS metadata FROM (SELECT * FROM docs WHERE lang = 'en' ORDER BY id LIMIT 1000)
"""
SQL["list_empty_filter"] = SQL["list_all"]
SQL["count_empty_filter"] = SQL["count_all"]
SQL["metadata_attach"] = f"WITH {DOCS} SELECT id, CASE WHEN lang = 'en' THEN '' ELSE meta END AS metadata FROM docs"

SQL["text_search"] = f"""
WITH {DOCS}
SELECT id, 1.0::DOUBLE AS score FROM (SELECT id FROM docs WHERE {fold('text')} LIKE '%the%' ORDER BY id LIMIT 10)
"""
SQL["text_search_wildcard"] = f"WITH {DOCS} SELECT id FROM docs WHERE {fold('text')} LIKE '%th_n%ou%'"
SQL["text_search_non_ascii"] = f"WITH {DOCS} SELECT id FROM docs WHERE {fold('text')} LIKE '%É%'"

SQL["text_search_indexed"] = SQL["text_search"]
SQL["text_search_indexed_wildcard"] = f"WITH {DOCS} SELECT id FROM docs WHERE {fold('text')} LIKE '%tion%the_th%'"
SQL["text_search_indexed_non_ascii"] = f"WITH {DOCS} SELECT id FROM docs WHERE {fold('text')} LIKE '%Éle%'"

PAIRS = (
    "pairs AS (SELECT CAST(a.vec_id AS VARCHAR) AS id_a, CAST(b.vec_id AS VARCHAR) AS id_b, "
    "a.embedding AS a, b.embedding AS b FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id)"
)
SQL["l2_distance"] = f"WITH {PAIRS} SELECT id_a, id_b, round({sq_l2('a', 'b')}, 6) AS dist FROM pairs"
SQL["score"] = f"WITH {PAIRS} SELECT id_a, id_b, round(1.0 / (1.0 + {sq_l2('a', 'b')}), 6) AS score FROM pairs"
SQL["cosine_similarity"] = f"""
WITH {PAIRS}
SELECT id_a, id_b, round(CASE WHEN {norm('a')} * {norm('b')} > 0
       THEN {dot('a', 'b')} / ({norm('a')} * {norm('b')}) ELSE 0 END, 6) AS cosine FROM pairs
"""
SQL["l2_normalize"] = f"""
WITH {PAIRS},
diff AS (SELECT id_a, list_transform(list_zip(b::DOUBLE[], a::DOUBLE[]), lambda p: p[1] - p[2]) AS v FROM pairs),
n AS (SELECT id_a, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM diff)
SELECT id_a, generate_subscripts(v, 1) - 1 AS pos,
       round(((unnest(v) / (nrm + 1e-12))::FLOAT)::DOUBLE, 6) + 0.0 AS value FROM n
"""
SQL["mean_pool"] = """
WITH t AS (SELECT label, vec_id % 3 <> 0 AS m, embedding FROM embeddings),
u AS (SELECT label, m, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM t),
s AS (SELECT label, pos, sum(CASE WHEN m THEN x ELSE 0 END) / greatest(sum(CASE WHEN m THEN 1 ELSE 0 END), 1) AS mean
      FROM u GROUP BY label, pos),
n AS (SELECT label, sqrt(sum(mean * mean)) + 1e-12 AS nrm FROM s GROUP BY label)
SELECT label, pos, round(((mean / nrm)::FLOAT)::DOUBLE, 6) AS value FROM s JOIN n USING (label)
"""
SQL["similarity_pairs"] = f"""
WITH {VECS},
p AS (SELECT a.id AS id_a, b.id AS id_b, {dot('a.embedding', 'b.embedding')} AS sim FROM vecs a, vecs b)
SELECT id_a, id_b, round(sim, 6) AS sim FROM p WHERE sim >= 0.3
"""
SQL["similarity_pairs_pruned"] = SQL["similarity_pairs"].replace("sim >= 0.3", "sim >= 0.5")
SQL["similarity_topk"] = f"""
WITH {VECS},
p AS (SELECT a.id AS id_a, b.id AS id_b, {dot('a.embedding', 'b.embedding')} AS sim FROM vecs a, vecs b),
r AS (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY round(sim, 9) DESC, id_b) AS rk FROM p)
SELECT id_a, id_b, round(sim, 6) AS sim FROM r WHERE rk <= 3
"""

SQL["similarity_topk_pruned"] = SQL["similarity_topk"]


def hashing_sql(src: str, key: str, text: str, dim: int = 64, limit: int | None = None) -> str:
    """CTEs hb_<src> (key, bucket, value) of the hashing embedder, sparse form,
    plus hn_<src> (key, nrm) with a row for every key (zero vectors too)."""
    tokens = f"regexp_extract_all({fold(text)}, '[a-z0-9]+')"
    if limit is not None:
        tokens = f"list_slice({tokens}, 1, {limit})"
    return f"""
ht_{src} AS (SELECT {key} AS key, {tokens} AS t FROM {src}),
hc_{src} AS (SELECT key, bucket, count(*)::DOUBLE AS cnt FROM (
    SELECT key, unnest(list_transform(t, lambda x: (('0x' || substr(md5(x), 1, 4))::INTEGER) % {dim})) AS bucket
    FROM ht_{src}) GROUP BY key, bucket),
hs_{src} AS (SELECT key, sqrt(sum(cnt * cnt)) AS nrm FROM hc_{src} GROUP BY key),
hb_{src} AS (SELECT key, bucket, ((cnt / (nrm + 1e-12))::FLOAT)::DOUBLE AS value FROM hc_{src} JOIN hs_{src} USING (key)),
hn_{src} AS (SELECT t.key, coalesce((SELECT sum(value * value) FROM hb_{src} b WHERE b.key = t.key), 0) AS sq
             FROM ht_{src} t)"""


HASH_DOCS = hashing_sql("documents", "CAST(doc_id AS VARCHAR)", "text")
HASH_BENCH = hashing_sql("benchmark", "CAST(item_id AS VARCHAR)", "text")

SQL["embed_hashing"] = f"""
WITH {HASH_DOCS}
SELECT key AS id, bucket AS pos, round(value, 6) AS value FROM hb_documents WHERE value <> 0
"""

SQL["embed_token_limit"] = f"""
WITH {hashing_sql("documents", "CAST(doc_id AS VARCHAR)", "text", limit=256)}
SELECT key AS id, bucket AS pos, round(value, 6) AS value FROM hb_documents WHERE value <> 0
"""
SQL["embed_precomputed"] = f"""
WITH {DOCS}, {VECS} SELECT id, CASE WHEN id IN (SELECT id FROM vecs) THEN 'embedded' ELSE 'missing' END AS status FROM docs
"""

# Squared L2 between every benchmark query and every document, sparse form.
QD_DIST = f"""
{HASH_DOCS}, {HASH_BENCH},
dots AS (SELECT q.key AS query_id, d.key AS id, sum(q.value * d.value) AS dt
         FROM hb_benchmark q JOIN hb_documents d USING (bucket) GROUP BY q.key, d.key),
qd AS (SELECT q.key AS query_id, d.key AS id, q.sq AS qq, d.sq AS xx FROM hn_benchmark q, hn_documents d),
dist AS (SELECT qd.query_id, qd.id, greatest(qd.xx + qd.qq - 2 * coalesce(dots.dt, 0), 0) AS dist,
                CASE WHEN qd.xx > 0 AND qd.qq > 0 THEN coalesce(dots.dt, 0) / (sqrt(qd.xx) * sqrt(qd.qq)) ELSE 0 END AS cos
         FROM qd LEFT JOIN dots USING (query_id, id))"""

SQL["semantic_search_text"] = f"""
WITH {QD_DIST},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id) AS rank FROM dist)
SELECT query_id, rank, id, round(1.0 / (1.0 + dist), 6) AS score FROM r WHERE rank <= 10
"""
SQL["best_match"] = f"""
WITH {QD_DIST},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - cos, 9), id) AS rank FROM dist)
SELECT query_id, id, round(cos, 6) AS similarity FROM r WHERE rank = 1
"""
SQL["retrieval_eval"] = f"""
WITH {QD_DIST},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - cos, 9), id) AS rank FROM dist)
SELECT r.query_id, r.id, round(r.cos, 6) AS similarity, strpos(d.text, b.text) > 0 AS hit
FROM r JOIN documents d ON CAST(d.doc_id AS VARCHAR) = r.id
JOIN benchmark b ON CAST(b.item_id AS VARCHAR) = r.query_id WHERE r.rank = 1
"""

SQL["metadata_normalise"] = """
WITH src AS (
  SELECT event_id, '{"type": "' || event_type || '", "user": ' || CAST(user_id AS VARCHAR) || ', "big": '
         || CASE WHEN value > 25 THEN 'true' ELSE 'false' END || ', "props": ' || props || ', "value": ' || CAST(value AS VARCHAR) || ', "one": 1.0, "hundred": 1e2, "none": null}' AS j
  FROM events),
k AS (SELECT event_id, j, unnest(json_keys(j)) AS key FROM src)
SELECT event_id, key,
       CASE WHEN key = 'hundred' THEN '100.0' WHEN json_type(j, '$."' || key || '"') = 'VARCHAR' THEN json_extract_string(j, '$."' || key || '"')
            ELSE json_extract(j, '$."' || key || '"')::VARCHAR END AS value
FROM k
"""

# ------------------------------------------------------------------ mutations
T0 = "'2024-01-01 00:00:00'"
T1 = "'2024-06-01 00:00:00'"
CH = (
    "ch AS (SELECT CASE WHEN role = 'assistant' THEN CAST(conv_id AS VARCHAR) ELSE 'c' || CAST(conv_id AS VARCHAR) END AS id, "
    "text, 'role=' || role || ',turn=' || CAST(turn AS VARCHAR) AS meta, turn AS ordinal FROM conversations)"
)
LAST = "last AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordinal DESC) = 1)"
UPSERTED = f"""
upserted AS (
  SELECT d.id, coalesce(l.text, d.text) AS text, CASE WHEN l.id IS NULL THEN d.meta ELSE l.meta END AS meta,
         {T0} AS created_at, CASE WHEN l.id IS NULL THEN {T0} ELSE {T1} END AS updated_at
  FROM docs d LEFT JOIN last l USING (id)
  UNION ALL
  SELECT id, text, meta, {T1}, {T1} FROM last WHERE id NOT IN (SELECT id FROM docs))"""
TOXIC = (
    "gone AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE toxic = 1 "
    "UNION ALL SELECT 'conv-' || CAST(conv_id AS VARCHAR) FROM conversations)"
)
EDITED = f"{UPSERTED}, {TOXIC}, edited AS (SELECT * FROM upserted WHERE id NOT IN (SELECT id FROM gone))"


def table_sql(src: str) -> str:
    return f"SELECT id, text, meta AS metadata, created_at, updated_at FROM {src}"


SQL["insert"] = f"""
WITH {DOCS}, {CH},
firsts AS (SELECT id, min(ordinal) AS f FROM ch GROUP BY id),
ins AS (SELECT ch.* FROM ch JOIN firsts USING (id) WHERE ch.ordinal = firsts.f AND ch.id NOT IN (SELECT id FROM docs))
SELECT id, text, meta AS metadata, {T0} AS created_at, {T0} AS updated_at FROM docs
UNION ALL SELECT id, text, meta, {T1}, {T1} FROM ins
"""
SQL["insert_report"] = f"""
WITH {DOCS}, {CH},
firsts AS (SELECT id, min(ordinal) AS f FROM ch GROUP BY id)
SELECT ch.id, ch.ordinal,
       CASE WHEN ch.id IN (SELECT id FROM docs) THEN 'exists' WHEN ch.ordinal <> firsts.f THEN 'duplicate'
            ELSE 'inserted' END AS status
FROM ch JOIN firsts USING (id)
"""
SQL["insert_ties"] = """
SELECT 'n' || conv_id AS id, 1::BIGINT AS n_inserted, count(*) - 1 AS n_duplicate, 1::BIGINT AS n_stored FROM conversations GROUP BY conv_id
"""
SQL["insert_rejects"] = """
WITH r AS (SELECT CASE WHEN role = 'system' THEN 'rejected: Missing ''text'' field' WHEN turn = 0 THEN 'rejected: Missing ''id'' field'
                  ELSE 'inserted' END AS status FROM conversations)
SELECT status, count(*) AS n FROM r GROUP BY status
UNION ALL SELECT 'stored', (SELECT count(*) FROM documents) + (SELECT count(*) FROM r WHERE status = 'inserted')
"""
SQL["insert_batch_rolled_back_table"] = f"WITH {DOCS} SELECT id, text, meta AS metadata, {T0} AS created_at, {T0} AS updated_at FROM docs"
SQL["insert_batch_ok"] = f"""
WITH {DOCS}
SELECT id, text, meta AS metadata, {T0} AS created_at, {T0} AS updated_at FROM docs
UNION ALL
SELECT 'b' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text, 'role=' || role, {T1}, {T1} FROM conversations
"""
SQL["insert_batch_rejected"] = f"""
WITH {DOCS}, {CH},
n AS (SELECT id, count(*) AS c FROM ch GROUP BY id)
SELECT ch.id, 'rolled_back' AS status,
       CASE WHEN ch.id IN (SELECT id FROM docs) THEN 'exists' WHEN n.c > 1 THEN 'duplicate in batch' END AS reason
FROM ch JOIN n USING (id)
"""
SQL["update"] = f"""
WITH {DOCS}, {CH}, {LAST}
SELECT d.id, coalesce(l.text, d.text) AS text, CASE WHEN l.id IS NULL THEN d.meta ELSE l.meta END AS metadata,
       {T0} AS created_at, CASE WHEN l.id IS NULL THEN {T0} ELSE {T1} END AS updated_at
FROM docs d LEFT JOIN last l USING (id)
"""
SQL["upsert"] = f"WITH {DOCS}, {CH}, {LAST}, {UPSERTED} {table_sql('upserted')}"
SQL["upsert_batch"] = SQL["upsert"]
SQL["upsert_json_no_ordinal"] = f"""
WITH {DOCS},
last AS (SELECT CAST(conv_id AS VARCHAR) AS id, arg_max(text, turn) AS text, '' AS meta FROM conversations GROUP BY conv_id),
{UPSERTED} {table_sql('upserted')}
"""
SQL["stamps"] = f"WITH {DOCS}, {CH}, {LAST}, {UPSERTED} SELECT id, created_at, updated_at FROM upserted"
SQL["delete"] = f"WITH {DOCS}, {TOXIC} SELECT id FROM docs WHERE id NOT IN (SELECT id FROM gone)"
SQL["text_search_after_edits"] = f"""
WITH {DOCS}, {CH}, {LAST}, {UPSERTED}, {TOXIC}
SELECT id FROM upserted WHERE {fold('text')} LIKE '%tion%' AND id NOT IN (SELECT id FROM gone)
"""
SQL["delete_report"] = f"""
WITH {DOCS}, {TOXIC}
SELECT DISTINCT id, CASE WHEN id IN (SELECT id FROM docs) THEN 'deleted' ELSE 'not_found' END AS status FROM gone
"""
SQL["delete_cascade"] = f"""
WITH {DOCS}, {VECS}, {TOXIC}
SELECT 'metadata' AS kind, id, unnest(['lang', 'source']) AS key FROM docs WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'vector', id, '' FROM vecs WHERE id NOT IN (SELECT id FROM gone)
"""
SQL["metadata_put_replace"] = f"""
WITH {DOCS}
SELECT id AS document_id, 'lang' AS key, lang AS value FROM docs
UNION ALL SELECT docs.id, 'source', coalesce(CAST(quality AS VARCHAR), source) FROM docs LEFT JOIN labels ON CAST(labels.doc_id AS VARCHAR) = docs.id
"""
SQL["metadata_put_report"] = """
SELECT CAST(doc_id AS VARCHAR) AS id, 'quality' AS key, CASE WHEN doc_id IN (SELECT doc_id FROM documents) THEN 'ok' ELSE 'not_found' END AS status FROM labels
UNION ALL SELECT 'conv-' || conv_id, 'k', 'not_found' FROM conversations WHERE turn = 0
"""
SQL["metadata_put"] = f"""
WITH {DOCS}
SELECT id AS document_id, 'lang' AS key, lang AS value FROM docs
UNION ALL SELECT id, 'source', source FROM docs
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'quality', CAST(quality AS VARCHAR) FROM labels
"""
SQL["metadata_put_ties"] = f"""
WITH {DOCS},
last AS (SELECT CAST(conv_id AS VARCHAR) AS id, arg_max(text, CASE WHEN turn = 3 THEN 1 ELSE -1 - turn END) AS last FROM conversations GROUP BY conv_id)
SELECT id, coalesce(last, '-') AS last FROM docs LEFT JOIN last USING (id)
"""
SQL["metadata_search_indexed"] = SQL["metadata_search"]
SQL["count_by_metadata_indexed"] = f"""
WITH {DOCS}, {TOXIC},
left_ AS (SELECT id, lang, source FROM docs WHERE id NOT IN (SELECT id FROM gone)),
edits AS (SELECT CAST(doc_id AS VARCHAR) AS id, max(CAST(quality AS VARCHAR)) AS value FROM labels GROUP BY doc_id),
meta AS (SELECT 'lang' AS key, lang AS value FROM left_
         UNION ALL SELECT 'source', coalesce(e.value, source) FROM left_ LEFT JOIN edits e USING (id))
SELECT key, value, count(*) AS count FROM meta GROUP BY key, value
"""
SQL["metadata_delete"] = f"""
WITH {DOCS}
SELECT id AS document_id, 'lang' AS key, lang AS value FROM docs
UNION ALL SELECT id, 'source', source FROM docs
  WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)
"""
SQL["metadata_delete_report"] = """
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN toxic = 1 THEN 'source' ELSE 'quality' END AS key,
       toxic = 1 AS deleted
FROM labels
"""
SQL["validate_split"] = """
WITH r AS (
  SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_type <> 'error' THEN event_type END AS text, event_type
  FROM events)
SELECT id, CASE WHEN text IS NULL THEN 'Missing ''text'' field'
                WHEN event_type IN ('click', 'signup') THEN 'Invalid ''metadata'': must be a JSON object of unique keys'
           END AS error
FROM r
"""
SQL["assign_ids"] = """
SELECT count(*) AS n, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END)::BIGINT AS n_given,
       sum(CASE WHEN role <> 'assistant' THEN 1 ELSE 0 END)::BIGINT AS n_generated, count(*) AS n_distinct
FROM conversations
"""
SQL["snapshot_roundtrip"] = f"WITH {DOCS} SELECT id, text, meta AS metadata, {T0} AS created_at, {T0} AS updated_at FROM docs"


VEC_DIGEST = """
SELECT t.key AS id, 'hashing-64' AS model, t.h AS text_hash,
       round(coalesce((SELECT sum((b.bucket + 1) * b.value) FROM hb_{src} b WHERE b.key = t.key), 0), 6) AS checksum
FROM (SELECT {key} AS key, sha256({text}) AS h FROM {src}) t
"""
SQL["vector_rebuild"] = (
    f"WITH {HASH_DOCS} "
    + VEC_DIGEST.format(src="documents", key="CAST(doc_id AS VARCHAR)", text="text")
)
SQL["vector_sync"] = (
    f"WITH {DOCS}, {CH}, {LAST}, {EDITED}, {hashing_sql('edited', 'id', 'text')} "
    + VEC_DIGEST.format(src="edited", key="id", text="text")
)
SQL["index_drift"] = f"""
WITH {DOCS}, {CH}, {LAST}, {EDITED},
old AS (SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text) AS h FROM documents),
new AS (SELECT id, sha256(text) AS h FROM edited)
SELECT coalesce(n.id, o.id) AS id,
       CASE WHEN o.id IS NULL THEN 'missing' WHEN n.id IS NULL THEN 'orphan'
            WHEN n.h <> o.h THEN 'stale' ELSE 'ok' END AS status
FROM new n FULL OUTER JOIN old o USING (id)
"""
SQL["health"] = f"""
WITH d AS ({SQL['index_drift']})
SELECT sum(CASE WHEN status <> 'orphan' THEN 1 ELSE 0 END)::BIGINT AS documents,
       sum(CASE WHEN status <> 'missing' THEN 1 ELSE 0 END)::BIGINT AS vectors,
       sum(CASE WHEN status = 'missing' THEN 1 ELSE 0 END)::BIGINT AS missing,
       sum(CASE WHEN status = 'orphan' THEN 1 ELSE 0 END)::BIGINT AS orphans,
       sum(CASE WHEN status = 'stale' THEN 1 ELSE 0 END)::BIGINT AS stale
FROM d
"""

SQL["semantic_search_grid"] = knn_all_sql(10)
SQL["ann_full_probe"] = knn_all_sql(10)
SQL["search_dispatch_metadata"] = f"""
WITH {DOCS}
SELECT row_number() OVER (ORDER BY id) AS rank, id, text, 1.0::DOUBLE AS score, meta AS metadata
FROM (SELECT * FROM docs WHERE source = 'src7' ORDER BY id LIMIT 10)
"""
SQL["search_dispatch_text"] = f"""
WITH {DOCS}
SELECT row_number() OVER (ORDER BY id) AS rank, id, text, 1.0::DOUBLE AS score, meta AS metadata
FROM (SELECT * FROM docs WHERE {fold('text')} LIKE '%eau%' ORDER BY id LIMIT 10)
"""
QTEXT = "qtext AS (SELECT 'q' AS qid, 'the and of in' AS text)"
SQL["search_dispatch_unknown_type"] = f"""
WITH {DOCS}, {QTEXT}, {HASH_DOCS}, {hashing_sql('qtext', 'qid', 'text')},
dots AS (SELECT d.key AS id, sum(q.value * d.value) AS dt FROM hb_qtext q JOIN hb_documents d USING (bucket) GROUP BY d.key),
dist AS (SELECT d.key AS id, greatest(d.sq + q.sq - 2 * coalesce(dots.dt, 0), 0) AS dist
         FROM hn_documents d CROSS JOIN hn_qtext q LEFT JOIN dots ON dots.id = d.key),
r AS (SELECT *, row_number() OVER (ORDER BY round(dist, 9), id) AS rank FROM dist)
SELECT r.rank, r.id, docs.text, round(1.0 / (1.0 + r.dist), 6) AS score, docs.meta AS metadata
FROM r JOIN docs USING (id) WHERE r.rank <= 10 AND 1.0 / (1.0 + r.dist) >= 0.6
"""

def ann_sql(points: str, queries: str, k: int, want: int) -> str:
    """CTEs of an IVF search: ``points`` and ``queries`` are CTEs (id, v), lists are around
    the CTE ``cents`` (list_id, v). ``hits`` has each query's rows with its list's rank
    ``rk`` and ``enough``, the number of lists that hold k rows, ``need`` for ``want``."""
    return f"""
near AS (SELECT p.id, list_id FROM {points} p, cents c
         QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY round({sq_l2('p.v', 'c.v')}, 9), list_id) = 1),
sizes AS (SELECT c.list_id, count(n.id) AS size FROM cents c LEFT JOIN near n USING (list_id) GROUP BY c.list_id),
ordered AS (SELECT q.id AS query_id, list_id, row_number() OVER (PARTITION BY q.id ORDER BY round({sq_l2('q.v', 'c.v')}, 9), list_id) AS rk
            FROM {queries} q, cents c),
filled AS (SELECT *, sum(size) OVER (PARTITION BY query_id ORDER BY rk) AS seen FROM ordered JOIN sizes USING (list_id)),
needs AS (SELECT query_id, least(count(*) FILTER (seen < {k}) + 1, count(*)) AS enough, least(count(*) FILTER (seen < {want}) + 1, count(*)) AS need
          FROM filled GROUP BY query_id),
hits AS (SELECT o.query_id, p.id, {sq_l2('p.v', 'q.v')} AS dist, o.rk, needs.enough, needs.need
         FROM ordered o JOIN needs USING (query_id) JOIN near n USING (list_id) JOIN {points} p ON p.id = n.id JOIN {queries} q ON q.id = o.query_id)"""


FIXED = f"""{DOCS}, {VECS}, {LIVE},
cents AS (SELECT vec_id AS list_id, embedding AS v FROM embeddings WHERE vec_id < 16),
points AS (SELECT id, embedding AS v FROM live), qs AS (SELECT id, embedding AS v FROM vecs),
{ann_sql('points', 'qs', 10, 10)}"""


def ranked_probe(p: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id) AS rank FROM hits WHERE rk <= greatest({p}, enough)"


SQL["ann_probe"] = f"""
WITH {FIXED}, r AS ({ranked_probe('2')})
SELECT query_id, rank, id, round(dist, 6) AS dist, round(1.0 / (1.0 + dist), 6) AS score FROM r WHERE rank <= 10
"""
SQL["ann_recall_fitted"] = "SELECT count(*) AS n_queries, TRUE AS reached FROM embeddings"
SQL["vector_list_upkeep"] = "SELECT count(*) AS n_vectors, 0::BIGINT AS misplaced, TRUE AS short FROM embeddings"
SQL["ann_codes_recall"] = "SELECT count(*) AS n_queries, TRUE AS reached, TRUE AS short FROM embeddings"
SQL["retrieval_trained"] = "SELECT count(*) AS n_queries, TRUE AS better FROM benchmark"
SQL["ann_recall"] = f"""
WITH {FIXED},
exact AS (SELECT query_id, id FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id) <= 10),
{", ".join(f"r{p} AS ({ranked_probe(str(p))})" for p in (1, 2, 4, 8))}
{" UNION ALL ".join(f"SELECT {p} AS nprobe, round((SELECT count(*) FROM exact JOIN r{p} USING (query_id, id) WHERE rank <= 10) / (SELECT count(*) FROM exact), 6) AS recall" for p in (1, 2, 4, 8))}
"""


def dense(src: str, dim: int = 64) -> str:
    """CTE (id, v) of the hashing vectors of a CTE, as lists."""
    return f"""dense_{src} AS (SELECT key AS id, list_transform(range(0, {dim}), lambda i: coalesce(m[i], 0.0)) AS v FROM (
    SELECT t.key, map(coalesce(list(b.bucket) FILTER (b.bucket IS NOT NULL), []), coalesce(list(b.value) FILTER (b.bucket IS NOT NULL), [])) AS m
    FROM ht_{src} t LEFT JOIN hb_{src} b ON b.key = t.key GROUP BY t.key))"""


SQL["semantic_search_ann"] = f"""
WITH {HASH_DOCS}, {HASH_BENCH}, {dense('documents')}, {dense('benchmark')},
cents AS (SELECT CAST(id AS BIGINT) AS list_id, v FROM dense_documents WHERE CAST(id AS BIGINT) < 16),
{ann_sql('dense_documents', 'dense_benchmark', 10, 50)},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id) AS rank FROM hits WHERE rk <= need)
SELECT query_id, rank, r.id, round(1.0 / (1.0 + dist), 6) AS score, text FROM r JOIN documents d ON CAST(d.doc_id AS VARCHAR) = r.id
WHERE rank <= 10 AND 1.0 / (1.0 + dist) >= 0.4
"""

SQL["text_files"] = "SELECT CAST(doc_id AS VARCHAR) AS name, text FROM documents"
SQL["json_documents"] = """
SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_type <> 'error' THEN event_type END AS text,
       'k=' || CAST(json_extract(props, '$.k') AS VARCHAR) AS metadata,
       CASE WHEN event_type = 'error' THEN 'Missing ''text'' field' END AS error
FROM events
"""
SQL["json_types_rejected"] = """
SELECT CASE event_id % 6 WHEN 1 THEN 'Invalid ''text'': must be a string' WHEN 2 THEN 'Invalid ''text'': must be a string'
       WHEN 3 THEN 'Invalid ''id'': must be a string' WHEN 4 THEN 'Invalid ''metadata'': must be a JSON object of unique keys'
       WHEN 5 THEN 'Invalid ''metadata'': must be a JSON object of unique keys' END AS error, count(*) AS n
FROM events GROUP BY 1
"""
SQL["ingest_stream"] = SQL["upsert_batch"]
SQL["ingest_out_of_order"] = SQL["upsert_batch"]

SQL["result_preview"] = f"""
WITH {QD_DIST},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - cos, 9), id) AS rank FROM dist)
SELECT r.query_id, r.id, round(r.cos, 4) AS score, substr(d.text, 1, 200) AS text
FROM r JOIN documents d ON CAST(d.doc_id AS VARCHAR) = r.id WHERE r.rank = 1
"""

SQL["store_upsert_batch"] = SQL["upsert_batch"]
SQL["store_vectors"] = (
    f"WITH {DOCS}, {CH}, {LAST}, {UPSERTED}, {hashing_sql('upserted', 'id', 'text')} "
    + VEC_DIGEST.format(src="upserted", key="id", text="text")
)
SQL["ingest_stream_vectors"] = SQL["store_vectors"]
SQL["vectors_roundtrip"] = """
SELECT CAST(vec_id AS VARCHAR) AS id, generate_subscripts(embedding, 1) - 1 AS pos, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings
"""
