"""Registered queries: one per operator group, over the driver's whole tables.

Each callable takes (spark, sf_dir) and returns a DataFrame whose columns
match the SQL twin in ``docsift.plans.oracle``. Floats are rounded to 6
decimals; maps are shown as sorted ``k=v`` text so every engine prints them
the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.sources.testdata import (
    documents_from_testdata,
    metadata_long_from_testdata,
    read_table,
    vectors_from_testdata,
)

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn

    return deco


def meta_str(c="metadata") -> Column:
    """Canonical text of a map: 'k1=v1,k2=v2' with keys sorted."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat_ws(
        ",", F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    )


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6)


def docs_of(spark, d):
    return documents_from_testdata(spark, d)


def vecs_of(spark, d):
    return vectors_from_testdata(spark, d)


def _show_results(df: DataFrame, with_query: bool = True) -> DataFrame:
    cols = (["query_id"] if with_query else []) + [
        F.col("rank").cast("long").alias("rank"),
        "id",
        "text",
        r6("score").alias("score"),
        meta_str().alias("metadata"),
    ]
    return df.select(*cols)


# --------------------------------------------------------------- semantic (vector)


@register("semantic_search_vector")
def q_semantic_search_vector(spark, d):
    """Q2 + J2 + P5: the vector of document 7 as the query, k = 10."""
    from docsift.plans.search import search_vector

    docs, vecs = docs_of(spark, d), vecs_of(spark, d)
    qv = vecs.filter(F.col("id") == "7").select("embedding").first()["embedding"]
    return _show_results(search_vector(docs, vecs, qv, k=10), with_query=False)


@register("semantic_search_batch")
def q_semantic_search_batch(spark, d):
    """T2 for many queries at once: every vector queries the whole table."""
    from docsift.operators.knn import knn
    from docsift.plans.search import drop_orphans

    docs, vecs = docs_of(spark, d), vecs_of(spark, d)
    corpus = drop_orphans(vecs, docs)
    queries = vecs.select(F.col("id").alias("query_id"), "embedding")
    hits = knn(corpus, queries, 10)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "id", r6("dist").alias("dist"), r6("score").alias("score"))


@register("semantic_search_bounded")
def q_semantic_search_bounded(spark, d):
    """T2 for many queries with both sides distributed and lists pruned by each query's bound."""
    from docsift.operators.knn import knn_bounded
    from docsift.plans.search import drop_orphans

    docs, vecs = docs_of(spark, d), vecs_of(spark, d)
    queries = vecs.select(F.col("id").alias("query_id"), "embedding")
    hits = knn_bounded(drop_orphans(vecs, docs), queries, 10, lists=32, max_block_rows=128)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "id", r6("dist").alias("dist"), r6("score").alias("score"))


@register("semantic_search_threshold")
def q_semantic_search_threshold(spark, d):
    """every vector as a query, k = 10, score >= 0.6 (inclusive)."""
    from docsift.plans.search import search_vectors

    docs, vecs = docs_of(spark, d), vecs_of(spark, d)
    queries = vecs.select(F.col("id").alias("query_id"), "embedding")
    res = search_vectors(docs, vecs, queries, k=10, threshold=0.6)
    return res.select("query_id", F.col("rank").cast("long").alias("rank"), "id", r6("score").alias("score"))


# --------------------------------------------------------------- scans and lookups


@register("list_all")
def q_list_all(spark, d):
    from docsift.operators.lookup import list_all

    return list_all(docs_of(spark, d)).select("id", "text", meta_str().alias("metadata"))


@register("list_ids")
def q_list_ids(spark, d):
    from docsift.operators.lookup import list_ids

    return list_ids(docs_of(spark, d))


@register("get_by_id")
def q_get_by_id(spark, d):
    from docsift.operators.lookup import get_by_id

    return get_by_id(docs_of(spark, d), "42").select("id", "text", meta_str().alias("metadata"))


def _label_ids(spark, d) -> DataFrame:
    return read_table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"))


def _label_and_missing_ids(spark, d) -> DataFrame:
    """Ids of ``labels`` plus one id per conversation that no document has."""
    conv = read_table(spark, d, "conversations").select(F.concat(F.lit("conv-"), F.col("conv_id")).alias("id"))
    return _label_ids(spark, d).unionByName(conv)


@register("get_by_ids")
def q_get_by_ids(spark, d):
    from docsift.operators.lookup import get_by_ids

    res = get_by_ids(docs_of(spark, d), _label_and_missing_ids(spark, d))
    return res.select("id", "text", meta_str().alias("metadata"))


@register("exists_flags")
def q_exists_flags(spark, d):
    from docsift.operators.lookup import exists_flags

    return exists_flags(docs_of(spark, d), _label_and_missing_ids(spark, d))


@register("count_all")
def q_count_all(spark, d):
    from docsift.operators.lookup import count_all

    return count_all(docs_of(spark, d))


@register("count_by_metadata")
def q_count_by_metadata(spark, d):
    from docsift.operators.metadata import count_by_metadata

    return count_by_metadata(docs_of(spark, d), "lang", "en")


@register("count_by_metadata_grouped")
def q_count_by_metadata_grouped(spark, d):
    from docsift.operators.metadata import count_by_metadata_grouped

    return count_by_metadata_grouped(docs_of(spark, d))


# --------------------------------------------------------------- metadata


@register("metadata_fold")
def q_metadata_fold(spark, d):
    from docsift.operators.metadata import fold_metadata

    folded = fold_metadata(metadata_long_from_testdata(spark, d))
    return folded.select("document_id", meta_str().alias("metadata"))


@register("metadata_explode")
def q_metadata_explode(spark, d):
    from docsift.operators.metadata import explode_metadata

    return explode_metadata(docs_of(spark, d))


@register("metadata_join")
def q_metadata_join(spark, d):
    from docsift.operators.metadata import metadata_join

    res = metadata_join(docs_of(spark, d), metadata_long_from_testdata(spark, d), "lang", "fr")
    return res.select("id", "text")


@register("metadata_search")
def q_metadata_search(spark, d):
    from docsift.plans.search import metadata_search

    return _show_results(metadata_search(docs_of(spark, d), "lang", "fr", k=10), with_query=False)


@register("list_by_metadata")
def q_list_by_metadata(spark, d):
    from docsift.operators.metadata import list_by_metadata

    res = list_by_metadata(docs_of(spark, d), "source", "src3")
    return res.select("id", "text", meta_str().alias("metadata"))


def metadata_index(spark, d):
    from docsift.operators.metadata_index import MetadataIndex
    from docsift.session import scratch_path

    return MetadataIndex.build(docs_of(spark, d), scratch_path(spark, "metadata"))


@register("metadata_search_indexed")
def q_metadata_search_indexed(spark, d):
    """F4 + T3 through the clustered table: as ``metadata_search``."""
    return _show_results(metadata_index(spark, d).search(docs_of(spark, d), "lang", "fr", k=10), with_query=False)


@register("count_by_metadata_indexed")
def q_count_by_metadata_indexed(spark, d):
    """A2 through the clustered table, after documents were edited and deleted."""
    from docsift.operators.metadata import put_metadata
    from docsift.operators.mutate import delete
    from docsift.session import scratch_path

    docs, gone = docs_of(spark, d), _toxic_and_missing_ids(spark, d)
    edits = _label_edits(spark, d, "source")
    after = put_metadata(delete(docs, gone)[0], edits)
    index = metadata_index(spark, d).after(gone.select("id").unionByName(edits.select("id")), after, scratch_path(spark, "metadata"))
    return index.count_grouped()


@register("list_by_metadata_capped")
def q_list_by_metadata_capped(spark, d):
    """T4 as the reference's client sees it: the first 1000 matches."""
    from docsift.operators.metadata import list_by_metadata
    from docsift.schema import LIST_CAP

    return list_by_metadata(docs_of(spark, d), "lang", "en", limit=LIST_CAP).select("id", "text", meta_str().alias("metadata"))


@register("list_empty_filter")
def q_list_empty_filter(spark, d):
    """T4: an empty value means no filter."""
    from docsift.operators.metadata import list_by_metadata

    return list_by_metadata(docs_of(spark, d), "lang", "").select("id", "text", meta_str().alias("metadata"))


@register("count_empty_filter")
def q_count_empty_filter(spark, d):
    """A2: an empty key means no filter."""
    from docsift.operators.metadata import count_by_metadata

    return count_by_metadata(docs_of(spark, d), "", "en")


@register("metadata_attach")
def q_metadata_attach(spark, d):
    """Long rows of the documents that aren't English joined back; the English ones
    have no metadata and get the empty map."""
    from docsift.operators.metadata import attach_metadata

    rows = metadata_long_from_testdata(spark, d)
    foreign = rows.filter((F.col("key") == "lang") & (F.col("value") != "en")).select("document_id")
    out = attach_metadata(docs_of(spark, d), rows.join(foreign, "document_id", "left_semi"))
    return out.select("id", meta_str().alias("metadata"))


# --------------------------------------------------------------- text search


def _text_hits(spark, d, query, k=None):
    from docsift.operators.text_search import text_matches, text_search

    docs = docs_of(spark, d)
    if k is None:
        return text_matches(docs, query).select("id")
    return text_search(docs, query, k=k).select("id", r6("score").alias("score"))


@register("text_search")
def q_text_search(spark, d):
    """F3 + T3 + P6: first 10 documents in id order containing 'The'."""
    return _text_hits(spark, d, "The", k=10)


@register("text_search_wildcard")
def q_text_search_wildcard(spark, d):
    """Every document matching the live-wildcard pattern 'th_n%ou'."""
    return _text_hits(spark, d, "th_n%ou")


@register("text_search_non_ascii")
def q_text_search_non_ascii(spark, d):
    """'É' folds to nothing: only documents containing 'É' literally."""
    return _text_hits(spark, d, "É")


def trigram_index(spark, d):
    from docsift.operators.trigram import TrigramIndex
    from docsift.session import scratch_path

    return TrigramIndex.build(docs_of(spark, d), scratch_path(spark, "trigram"))


@register("text_search_indexed")
def q_text_search_indexed(spark, d):
    """F3 + T3 + P6 through the trigram index: as ``text_search``."""
    return trigram_index(spark, d).search("The", k=10).select("id", r6("score").alias("score"))


@register("text_search_indexed_wildcard")
def q_text_search_indexed_wildcard(spark, d):
    """F3 through the index, with live wildcards between pieces that have trigrams."""
    return trigram_index(spark, d).matches("TION%the_th").select("id")


@register("text_search_indexed_non_ascii")
def q_text_search_indexed_non_ascii(spark, d):
    """F3 through the index: 'É' isn't folded."""
    return trigram_index(spark, d).matches("Éle").select("id")


@register("text_search_after_edits")
def q_text_search_after_edits(spark, d):
    """F3 through a trigram index that followed an upsert and a delete: every match of the
    documents as they are then."""
    from docsift.operators.mutate import delete, upsert
    from docsift.operators.trigram_segments import SegmentedTrigrams
    from docsift.session import scratch_path

    docs, changes, gone = docs_of(spark, d), conversation_changes(spark, d), _toxic_and_missing_ids(spark, d)
    index = SegmentedTrigrams.build(docs, scratch_path(spark, "trigram"))
    edited, _ = upsert(docs, changes, MUT_AS_OF)
    index = index.after(changes, edited)
    return index.after(gone, delete(edited, gone)[0]).matches("tion").select("id")


# --------------------------------------------------------------- vector functions


def _consecutive_pairs(spark, d) -> DataFrame:
    """Each vector with the next one by id: an equi-join over the whole table."""
    e = read_table(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("ia"), F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("ib"), F.col("embedding").alias("b"))
    pairs = a.join(b, F.col("ia") + F.lit(1) == F.col("ib"))
    return pairs.select(
        F.col("ia").cast("string").alias("id_a"), F.col("ib").cast("string").alias("id_b"), "a", "b"
    )


@register("l2_distance")
def q_l2_distance(spark, d):
    from docsift.functions.vectors import squared_l2

    p = _consecutive_pairs(spark, d)
    return p.select("id_a", "id_b", r6(squared_l2("a", "b")).alias("dist"))


@register("score")
def q_score(spark, d):
    from docsift.functions.vectors import score_from_distance, squared_l2

    p = _consecutive_pairs(spark, d)
    return p.select("id_a", "id_b", r6(score_from_distance(squared_l2("a", "b"))).alias("score"))


@register("cosine_similarity")
def q_cosine_similarity(spark, d):
    from docsift.functions.vectors import cosine_similarity

    p = _consecutive_pairs(spark, d)
    return p.select("id_a", "id_b", r6(cosine_similarity("a", "b")).alias("cosine"))


@register("l2_normalize")
def q_l2_normalize(spark, d):
    """V3 on the difference of consecutive vectors (not unit length)."""
    from docsift.functions.vectors import l2_normalize

    p = _consecutive_pairs(spark, d)
    diff = p.select(
        "id_a", F.zip_with("b", "a", lambda x, y: x.cast("double") - y.cast("double")).alias("v")
    )
    normed = diff.select("id_a", l2_normalize("v").alias("u"))
    return normed.select("id_a", F.posexplode("u").alias("pos", "value")).select(
        "id_a", F.col("pos").cast("long").alias("pos"), r6(F.col("value").cast("double")).alias("value")
    )


@register("mean_pool")
def q_mean_pool(spark, d):
    """A6 + V5: ``label`` as the document, its vectors as tokens,
    mask = (vec_id % 3 <> 0)."""
    from docsift.operators.pooling import mean_pool

    e = read_table(spark, d, "embeddings")
    tokens = e.select(
        F.col("label").alias("id"),
        (F.col("vec_id") % 3 != 0).cast("int").alias("mask"),
        F.col("embedding").alias("vec"),
    )
    pooled = mean_pool(tokens, dim=64)
    return pooled.select("id", F.posexplode("embedding").alias("pos", "value")).select(
        F.col("id").alias("label"), F.col("pos").cast("long").alias("pos"), r6(F.col("value").cast("double")).alias("value")
    )


@register("similarity_pairs")
def q_similarity_pairs(spark, d):
    """Every pair of vectors (diagonal included) with dot >= 0.3."""
    from docsift.operators.similarity import similarity_pairs

    v = vecs_of(spark, d)
    return similarity_pairs(v, min_sim=0.3).select("id_a", "id_b", r6("sim").alias("sim"))


@register("similarity_pairs_pruned")
def q_similarity_pairs_pruned(spark, d):
    """J8 over many lists and blocks, of which those that the bound rules out are never joined."""
    from docsift.operators.similarity import similarity_pairs

    pairs = similarity_pairs(vecs_of(spark, d), min_sim=0.5, lists=64, max_block_rows=96)
    return pairs.select("id_a", "id_b", r6("sim").alias("sim"))


@register("similarity_topk_pruned")
def q_similarity_topk_pruned(spark, d):
    """J8 for k over many lists: those that can't beat a list's k-th best are never joined."""
    from docsift.operators.similarity import similarity_pairs

    return similarity_pairs(vecs_of(spark, d), k=3, lists=32, max_block_rows=96).select("id_a", "id_b", r6("sim").alias("sim"))


@register("similarity_topk")
def q_similarity_topk(spark, d):
    """The 3 most similar vectors of every vector (itself included)."""
    from docsift.operators.similarity import similarity_pairs

    v = vecs_of(spark, d)
    return similarity_pairs(v, k=3).select("id_a", "id_b", r6("sim").alias("sim"))


# --------------------------------------------------------------- embedding and text queries


def hashing_vectors(spark, d, dim: int = 64, max_tokens: int | None = None) -> DataFrame:
    """K1 with the hashing embedder over every document."""
    from docsift.operators.embed import HashingEmbedder, embed_documents

    # The driver's table is one file of one row group, hence one split. A real table
    # arrives in many, and needs no exchange here.
    docs = docs_of(spark, d).select("id", "text", "text_hash").repartition("id")
    return embed_documents(docs, HashingEmbedder(dim, max_tokens))


def benchmark_queries(spark, d) -> DataFrame:
    b = read_table(spark, d, "benchmark")
    return b.select(b.item_id.cast("string").alias("query_id"), b.text.alias("query"))


@register("embed_hashing")
def q_embed_hashing(spark, d):
    """V6 (hashing): non-zero coordinates of every document's vector."""
    v = hashing_vectors(spark, d)
    return (
        v.select("id", F.posexplode("embedding").alias("pos", "value"))
        .filter(F.col("value") != 0)
        .select("id", "pos", r6(F.col("value").cast("double")).alias("value"))
    )


@register("embed_token_limit")
def q_embed_token_limit(spark, d):
    """V6 with a token limit, as a model with a fixed context has: the first 256 tokens."""
    from docsift.schema import TOKEN_LIMIT

    v = hashing_vectors(spark, d, max_tokens=TOKEN_LIMIT)
    return (
        v.select("id", F.posexplode("embedding").alias("pos", "value"))
        .filter(F.col("value") != 0)
        .select("id", "pos", r6(F.col("value").cast("double")).alias("value"))
    )


@register("embed_precomputed")
def q_embed_precomputed(spark, d):
    """V6 (precomputed): which documents have a vector, and which are missing one."""
    from docsift.operators.embed import PrecomputedEmbedder, embed_documents

    embedder, docs = PrecomputedEmbedder(vecs_of(spark, d)), docs_of(spark, d)
    done = embed_documents(docs, embedder).select("id", F.lit("embedded").alias("status"))
    return done.unionByName(embedder.missing(docs).withColumn("status", F.lit("missing")))


@register("semantic_search_text")
def q_semantic_search_text(spark, d):
    """Q1: every ``benchmark`` text as a query over all documents, k = 10."""
    from docsift.operators.embed import HashingEmbedder
    from docsift.plans.search import search_texts

    docs = docs_of(spark, d)
    res = search_texts(docs, hashing_vectors(spark, d), benchmark_queries(spark, d), HashingEmbedder(64), k=10)
    return res.select("query_id", F.col("rank").cast("long").alias("rank"), "id", r6("score").alias("score"))


@register("best_match")
def q_best_match(spark, d):
    """A5: the most similar document (cosine) of every benchmark text."""
    from docsift.operators.embed import HashingEmbedder, embed_queries
    from docsift.operators.knn import best_match

    q = embed_queries(benchmark_queries(spark, d), HashingEmbedder(64))
    res = best_match(hashing_vectors(spark, d), q)
    return res.select("query_id", "id", r6("similarity").alias("similarity"))


@register("retrieval_eval")
def q_retrieval_eval(spark, d):
    """Q4: top hit per benchmark text, its similarity, and whether the hit
    contains the query text verbatim (the passage was planted there)."""
    from docsift.plans.evaluate import retrieval_eval
    from docsift.operators.embed import HashingEmbedder

    res = retrieval_eval(docs_of(spark, d), hashing_vectors(spark, d), benchmark_queries(spark, d), HashingEmbedder(64))
    return res.select("query_id", "id", r6("similarity").alias("similarity"), "hit")


# --------------------------------------------------------------- JSON metadata


@register("retrieval_trained")
def q_retrieval_trained(spark, d):
    """V6 + Q4: whether the embedder trained on the corpus finds more of the benchmark's texts (the
    best document holds the text) than token counts do, at the same dimension."""
    from docsift.operators.embed import HashingEmbedder, embed_documents
    from docsift.operators.embed_svd import SvdEmbedder
    from docsift.plans.evaluate import retrieval_eval

    docs, queries = docs_of(spark, d), benchmark_queries(spark, d)
    parts = None
    for name, embedder in (("counts", HashingEmbedder(256)), ("trained", SvdEmbedder.fit(docs, 256))):
        found = retrieval_eval(docs, embed_documents(docs, embedder), queries, embedder)
        part = found.select(F.lit(name).alias("name"), F.col("hit").cast("int").alias("hit"))
        parts = part if parts is None else parts.unionByName(part)
    count = lambda n: F.sum(F.when(F.col("name") == n, F.col("hit")).otherwise(0))
    return parts.agg(F.count_if(F.col("name") == "trained").alias("n_queries"), (count("trained") > count("counts")).alias("better"))


def events_json(spark, d) -> DataFrame:
    """A JSON object per event: string, number, boolean, object and null values."""
    e = read_table(spark, d, "events")
    j = F.concat(
        F.lit('{"type": "'),
        e.event_type,
        F.lit('", "user": '),
        e.user_id.cast("string"),
        F.lit(', "big": '),
        F.when(e.value > 25, F.lit("true")).otherwise(F.lit("false")),
        F.lit(', "props": '),
        e.props,
        F.lit(', "value": '),
        e.value.cast("string"),
        F.lit(', "one": 1.0, "hundred": 1e2, "none": null}'),
    )
    return e.select(e.event_id, j.alias("json"))


@register("metadata_normalise")
def q_metadata_normalise(spark, d):
    """JSON metadata -> map<string,string> (non-strings as compact JSON)."""
    from docsift.functions.json import normalise_metadata_json

    m = events_json(spark, d).select("event_id", normalise_metadata_json("json").alias("m"))
    return m.select("event_id", F.explode("m").alias("key", "value"))


# --------------------------------------------------------------- mutations

MUT_AS_OF = "2024-06-01 00:00:00"


def ts_str(c) -> Column:
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss")


def show_table(t: DataFrame) -> DataFrame:
    return t.select(
        "id", "text", meta_str().alias("metadata"), ts_str("created_at").alias("created_at"),
        ts_str("updated_at").alias("updated_at"),
    )


def conversation_changes(spark, d) -> DataFrame:
    """Ordered changes from ``conversations``: assistant turns edit document
    ``conv_id``, other turns a new document ``c<conv_id>``; ordinal = turn."""
    c = read_table(spark, d, "conversations")
    cid = c.conv_id.cast("string")
    return c.select(
        F.when(c.role == "assistant", cid).otherwise(F.concat(F.lit("c"), cid)).alias("id"),
        c.text,
        F.create_map(F.lit("role"), c.role, F.lit("turn"), c.turn.cast("string")).alias("metadata"),
        c.turn.alias("ordinal"),
    )


@register("insert")
def q_insert(spark, d):
    """M1 + J3 + P7: conversation rows inserted one by one (existing ids and
    later rows of a new id refused)."""
    from docsift.operators.mutate import insert

    table, _ = insert(docs_of(spark, d), conversation_changes(spark, d), MUT_AS_OF)
    return show_table(table)


@register("insert_report")
def q_insert_report(spark, d):
    from docsift.operators.mutate import insert

    _, report = insert(docs_of(spark, d), conversation_changes(spark, d), MUT_AS_OF)
    return report


@register("insert_ties")
def q_insert_ties(spark, d):
    """M1: several rows of one new id without an order: one is inserted, the rest refused."""
    from docsift.operators.mutate import insert

    c = read_table(spark, d, "conversations")
    rows = c.select(F.concat(F.lit("n"), c.conv_id.cast("string")).alias("id"), "text", F.lit(None).cast("long").alias("ordinal"))
    table, report = insert(docs_of(spark, d), rows, MUT_AS_OF)
    stored = table.groupBy("id").agg(F.count("*").alias("n_stored"))
    told = report.groupBy("id").agg(*(F.count_if(F.col("status") == x).alias(f"n_{x}") for x in ("inserted", "duplicate")))
    return told.join(stored, "id")


@register("insert_rejects")
def q_insert_rejects(spark, d):
    """M1 + F6: rows without a text or an id are rejected, each with a report row."""
    from docsift.operators.mutate import insert

    c = read_table(spark, d, "conversations")
    name = F.concat(F.lit("r"), c.conv_id.cast("string"), F.lit("-"), c.turn.cast("string"))
    rows = c.select(F.when(c.turn != 0, name).alias("id"), F.when(c.role != "system", c.text).alias("text"))
    table, report = insert(docs_of(spark, d), rows, MUT_AS_OF, require_id=True)
    stored = table.agg(F.lit("stored").alias("status"), F.count("*").alias("n"))
    return report.groupBy("status").agg(F.count("*").alias("n")).unionByName(stored)


@register("insert_batch_rolled_back_table")
def q_insert_batch_rolled_back_table(spark, d):
    """M2: the table after a rollback is the table before."""
    from docsift.operators.mutate import insert_batch

    table, _ = insert_batch(docs_of(spark, d), conversation_changes(spark, d).drop("ordinal"), MUT_AS_OF)
    return show_table(table)


@register("insert_batch_ok")
def q_insert_batch_ok(spark, d):
    """M2: a batch of fresh unique ids is inserted whole."""
    from docsift.operators.mutate import insert_batch

    c = read_table(spark, d, "conversations")
    batch = c.select(
        F.concat(F.lit("b"), c.conv_id.cast("string"), F.lit("-"), c.turn.cast("string")).alias("id"),
        "text",
        F.create_map(F.lit("role"), c.role).alias("metadata"),
    )
    table, _ = insert_batch(docs_of(spark, d), batch, MUT_AS_OF)
    return show_table(table)


@register("insert_batch_rejected")
def q_insert_batch_rejected(spark, d):
    """M2: existing ids and repeated ids roll the whole batch back."""
    from docsift.operators.mutate import insert_batch

    table, report = insert_batch(docs_of(spark, d), conversation_changes(spark, d).drop("ordinal"), MUT_AS_OF)
    return report


@register("update")
def q_update(spark, d):
    """M3: the last change per id, applied to existing documents only."""
    from docsift.operators.mutate import update

    table, _ = update(docs_of(spark, d), conversation_changes(spark, d), MUT_AS_OF)
    return show_table(table)


@register("upsert")
def q_upsert(spark, d):
    """M4: the last change per id; existing ids updated, others inserted."""
    from docsift.operators.mutate import upsert

    table, _ = upsert(docs_of(spark, d), conversation_changes(spark, d), MUT_AS_OF)
    return show_table(table)


@register("upsert_batch")
def q_upsert_batch(spark, d):
    """M5: ordered changes, last ordinal per id wins, then upsert."""
    from docsift.operators.mutate import upsert_batch

    table, _ = upsert_batch(docs_of(spark, d), conversation_changes(spark, d), MUT_AS_OF)
    return show_table(table)


@register("stamps")
def q_stamps(spark, d):
    """created_at kept on edit, both stamps set on insert."""
    from docsift.operators.mutate import upsert_batch

    table, _ = upsert_batch(docs_of(spark, d), conversation_changes(spark, d), MUT_AS_OF)
    return table.select("id", ts_str("created_at").alias("created_at"), ts_str("updated_at").alias("updated_at"))


@register("upsert_json_no_ordinal")
def q_upsert_json_no_ordinal(spark, d):
    """S2 + M5: the last turn of each conversation as a JSON document without an ordinal,
    which is the reference's payload."""
    from docsift.operators.mutate import upsert_batch
    from docsift.sources.json_docs import parse_json_documents

    c = read_table(spark, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    lines = last.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), "text")).alias("value"))
    table, _ = upsert_batch(docs_of(spark, d), parse_json_documents(lines), MUT_AS_OF)
    return show_table(table)


def _toxic_and_missing_ids(spark, d) -> DataFrame:
    lab = read_table(spark, d, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").cast("string").alias("id"))
    conv = read_table(spark, d, "conversations").select(F.concat(F.lit("conv-"), F.col("conv_id")).alias("id"))
    return lab.unionByName(conv)


@register("delete")
def q_delete(spark, d):
    """M6 + J4: documents labelled toxic deleted (plus ids never present)."""
    from docsift.operators.mutate import delete

    table, _ = delete(docs_of(spark, d), _toxic_and_missing_ids(spark, d))
    return table.select("id")


@register("delete_report")
def q_delete_report(spark, d):
    from docsift.operators.mutate import delete

    _, report = delete(docs_of(spark, d), _toxic_and_missing_ids(spark, d))
    return report


@register("delete_cascade")
def q_delete_cascade(spark, d):
    """Long metadata and vectors that are left after deleting the toxic documents."""
    from docsift.operators.mutate import delete_cascade

    rows, vecs = delete_cascade(metadata_long_from_testdata(spark, d), vecs_of(spark, d), _toxic_and_missing_ids(spark, d))
    left = rows.select(F.lit("metadata").alias("kind"), F.col("document_id").alias("id"), "key")
    return left.unionByName(vecs.select(F.lit("vector").alias("kind"), "id", F.lit("").alias("key")))


def _label_edits(spark, d, key: str) -> DataFrame:
    lab = read_table(spark, d, "labels")
    return lab.select(F.col("doc_id").cast("string").alias("id"), F.lit(key).alias("key"), F.col("quality").cast("string").alias("value"))


@register("metadata_put_replace")
def q_metadata_put_replace(spark, d):
    """M7: an existing key's value is replaced."""
    from docsift.operators.metadata import explode_metadata, put_metadata

    return explode_metadata(put_metadata(docs_of(spark, d), _label_edits(spark, d, "source")))


@register("metadata_put_report")
def q_metadata_put_report(spark, d):
    """M7: edits of unknown ids are refused."""
    from docsift.operators.metadata import put_metadata_report

    conv = read_table(spark, d, "conversations").filter("turn = 0")
    unknown = conv.select(F.concat(F.lit("conv-"), F.col("conv_id")).alias("id"), F.lit("k").alias("key"), F.lit("v").alias("value"))
    return put_metadata_report(docs_of(spark, d), _label_edits(spark, d, "quality").unionByName(unknown))


@register("metadata_put")
def q_metadata_put(spark, d):
    """M7: key 'quality' set from ``labels``; other keys kept."""
    from docsift.operators.metadata import explode_metadata, put_metadata

    lab = read_table(spark, d, "labels")
    edits = lab.select(
        F.col("doc_id").cast("string").alias("id"), F.lit("quality").alias("key"),
        F.col("quality").cast("string").alias("value"),
    )
    return explode_metadata(put_metadata(docs_of(spark, d), edits))


@register("metadata_put_ties")
def q_metadata_put_ties(spark, d):
    """M7: many edits of one key, by ordinal; an edit without one counts by its position."""
    from docsift.operators.metadata import put_metadata

    c = read_table(spark, d, "conversations")
    edits = c.select(
        c.conv_id.cast("string").alias("id"), F.lit("last").alias("key"), c.text.alias("value"),
        F.when(c.turn != 3, -1 - c.turn).alias("ordinal"),
    )
    return put_metadata(docs_of(spark, d), edits).select("id", F.coalesce(F.col("metadata")["last"], F.lit("-")).alias("last"))


@register("metadata_delete")
def q_metadata_delete(spark, d):
    """M8: key 'source' removed from documents labelled toxic."""
    from docsift.operators.metadata import explode_metadata, delete_metadata

    lab = read_table(spark, d, "labels").filter(F.col("toxic") == 1)
    edits = lab.select(F.col("doc_id").cast("string").alias("id"), F.lit("source").alias("key"))
    return explode_metadata(delete_metadata(docs_of(spark, d), edits))


@register("metadata_delete_report")
def q_metadata_delete_report(spark, d):
    from docsift.operators.metadata import delete_metadata_report

    lab = read_table(spark, d, "labels")
    edits = lab.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("toxic") == 1, F.lit("source")).otherwise(F.lit("quality")).alias("key"),
    )
    return delete_metadata_report(docs_of(spark, d), edits)


def event_requests(spark, d) -> DataFrame:
    """Insert requests from ``events``: errors carry no text; clicks carry a
    JSON array as metadata; signups an object with a repeated key."""
    e = read_table(spark, d, "events")
    meta = (
        F.when(e.event_type == "click", F.concat(F.lit("["), e.props, F.lit("]")))
        .when(e.event_type == "signup", F.concat(F.lit('{"k": 0, '), F.substring(e.props, 2, 1000)))
        .otherwise(e.props)
    )
    return e.select(
        e.event_id.cast("string").alias("id"),
        F.when(e.event_type != "error", e.event_type).alias("text"),
        meta.alias("metadata_json"),
    )


@register("validate_split")
def q_validate_split(spark, d):
    """one error per rejected request (valid rows have none)."""
    from docsift.operators.mutate import validate

    return validate(event_requests(spark, d)).select("id", "error")


@register("assign_ids")
def q_assign_ids(spark, d):
    """Assistant turns keep their id, the others get a generated one."""
    from docsift.operators.mutate import assign_ids

    c = read_table(spark, d, "conversations")
    rows = c.select(
        F.when(c.role == "assistant", F.concat(F.lit("a"), c.conv_id.cast("string"), F.lit("-"), c.turn.cast("string")))
        .otherwise(F.lit(""))
        .alias("id"),
        "text",
    )
    out = assign_ids(rows)
    return out.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(~F.col("id_generated"), 1).otherwise(0)).alias("n_given"),
        F.sum(F.when(F.col("id_generated"), 1).otherwise(0)).alias("n_generated"),
        F.countDistinct("id").alias("n_distinct"),
    )


@register("snapshot_roundtrip")
def q_snapshot_roundtrip(spark, d):
    """S5 + S6: publish both tables to a new store, read the head back."""
    from docsift.session import scratch_path
    from docsift.sources.store import Store

    store = Store(spark, scratch_path(spark, "store"))
    docs = docs_of(spark, d)
    vecs = vecs_of(spark, d).drop("label")
    store.publish(docs, vecs)
    return show_table(store.documents())


@register("vectors_roundtrip")
def q_vectors_roundtrip(spark, d):
    """Vectors published by a new database's second version, read back."""
    from docsift.session import scratch_path
    from docsift.sources.store import Store

    store = Store(spark, scratch_path(spark, "store"))
    store.publish(docs_of(spark, d), vecs_of(spark, d).drop("label"), parent=store.new_db())
    v = store.vectors().select("id", F.posexplode("embedding").alias("pos", "value"))
    return v.select("id", F.col("pos").cast("long").alias("pos"), r6(F.col("value").cast("double")).alias("value"))


# --------------------------------------------------------------- vector table upkeep


def edited_docs(spark, d) -> DataFrame:
    """Documents after the upsert batch and the delete of toxic ones."""
    from docsift.operators.mutate import delete, upsert_batch

    t, _ = upsert_batch(docs_of(spark, d), conversation_changes(spark, d), MUT_AS_OF)
    t, _ = delete(t, _toxic_and_missing_ids(spark, d))
    return t


def _vec_digest(v: DataFrame) -> DataFrame:
    chk = F.aggregate(
        F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0).cast("double"), lambda a, x: a + x
    )
    return v.select("id", "model", "text_hash", r6(chk).alias("checksum"))


@register("vector_rebuild")
def q_vector_rebuild(spark, d):
    """K1: hashing vectors of every document, with model and text hash."""
    return _vec_digest(hashing_vectors(spark, d))


@register("vector_sync")
def q_vector_sync(spark, d):
    """K2: vectors of the original documents synced to the edited ones
    (only changed and new documents embedded); equals a rebuild."""
    from docsift.operators.embed import HashingEmbedder
    from docsift.operators.index import sync

    old = hashing_vectors(spark, d)
    return _vec_digest(sync(edited_docs(spark, d), old, HashingEmbedder(64)))


@register("index_drift")
def q_index_drift(spark, d):
    """Edited documents against the vectors of the original ones."""
    from docsift.operators.index import drift

    return drift(edited_docs(spark, d), hashing_vectors(spark, d), "hashing-64")


@register("health")
def q_health(spark, d):
    """A4: counts of documents, vectors and drift."""
    from docsift.operators.index import health

    return health(edited_docs(spark, d), hashing_vectors(spark, d), "hashing-64")


# --------------------------------------------------------------- approximate search and dispatch


@register("semantic_search_grid")
def q_semantic_search_grid(spark, d):
    """T2 through the bounded grid (query side too big to broadcast): small
    blocks force many (corpus block x query block) cells."""
    from docsift.operators.knn import knn_grid
    from docsift.plans.search import drop_orphans

    docs, vecs = docs_of(spark, d), vecs_of(spark, d)
    corpus = drop_orphans(vecs, docs).select("id", "embedding")
    queries = vecs.select(F.col("id").alias("query_id"), "embedding")
    hits = knn_grid(corpus, queries, 10, max_block_rows=128, max_query_rows=96)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "id", r6("dist").alias("dist"), r6("score").alias("score"))


def _ivf(spark, d, nlist=8):
    from docsift.operators.ann import build_ivf
    from docsift.plans.search import drop_orphans

    docs, vecs = docs_of(spark, d), vecs_of(spark, d)
    return build_ivf(drop_orphans(vecs, docs).select("id", "embedding"), nlist=nlist, seed=7)


@register("ann_full_probe")
def q_ann_full_probe(spark, d):
    """K3 + K4 + J7 with nprobe = nlist: must equal the exact search."""
    from docsift.operators.ann import ann_search

    idx = _ivf(spark, d)
    queries = vecs_of(spark, d).select(F.col("id").alias("query_id"), "embedding")
    hits = ann_search(idx, queries, 10, nprobe=idx.nlist)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "id", r6("dist").alias("dist"), r6("score").alias("score"))


def _fixed_ivf(spark, d):
    """Lists around the first 16 vectors, so that SQL can follow them."""
    import numpy as np

    from docsift.operators.ann import build_ivf
    from docsift.plans.search import drop_orphans

    first = read_table(spark, d, "embeddings").filter("vec_id < 16").orderBy("vec_id").select("embedding").collect()
    centroids = np.asarray([r["embedding"] for r in first], dtype=np.float64)
    return build_ivf(drop_orphans(vecs_of(spark, d), docs_of(spark, d)), centroids=centroids)


@register("ann_probe")
def q_ann_probe(spark, d):
    """K4 + J7: two lists a query, and more where they hold fewer than k rows."""
    from docsift.operators.ann import ann_search

    queries = vecs_of(spark, d).select(F.col("id").alias("query_id"), "embedding")
    hits = ann_search(_fixed_ivf(spark, d), queries, 10, nprobe=2)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "id", r6("dist").alias("dist"), r6("score").alias("score"))


@register("ann_probe_fitted")
def q_ann_probe_fitted(spark, d):
    """K3 + K4 + J7: lists that grow with the table, as many probed as recall@10 of 0.9 takes."""
    from docsift.operators.ann import ann_search, fit_nprobe, lists_for

    idx = fit_nprobe(_ivf(spark, d, lists_for(vecs_of(spark, d).count())))
    queries = vecs_of(spark, d).select(F.col("id").alias("query_id"), "embedding")
    hits = ann_search(idx, queries, 10, nprobe=idx.nprobe)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "id", r6("dist").alias("dist"), r6("score").alias("score"))


@register("ann_recall_fitted")
def q_ann_recall_fitted(spark, d):
    """K4 + Q4: whether the fitted search reaches recall@10 of 0.9, every vector as a query."""
    from docsift.operators.ann import ann_search, fit_nprobe, lists_for
    from docsift.operators.knn import knn

    idx = fit_nprobe(_ivf(spark, d, lists_for(vecs_of(spark, d).count())))
    queries = vecs_of(spark, d).select(F.col("id").alias("query_id"), "embedding")
    exact = knn(idx.vectors.select("id", "embedding"), queries, 10).select("query_id", "id")
    found = ann_search(idx, queries, 10, nprobe=idx.nprobe).select("query_id", "id", F.lit(1.0).alias("found"))
    both = exact.join(found, ["query_id", "id"], "left")
    recall = F.avg(F.coalesce("found", F.lit(0.0)))
    return both.agg(F.count_distinct("query_id").alias("n_queries"), (recall >= 0.9).alias("reached"))


@register("vector_list_upkeep")
def q_vector_list_upkeep(spark, d):
    """K2: two lists of all vectors, split until none is long; vectors whose list isn't that of
    a full assignment, and whether all lists have at most LONG times the square root of n."""
    from docsift.operators.ann import assign_lists, build_ivf
    from docsift.operators.list_upkeep import LONG, balanced

    after = balanced(build_ivf(vecs_of(spark, d).select("id", "embedding"), nlist=2, seed=7))
    full = assign_lists(after.vectors.select("id", "embedding"), after.centroids).withColumnRenamed("list_id", "nearest")
    both = after.vectors.select("id", "list_id").join(full.select("id", "nearest"), "id")
    short = F.lit(bool(after.sizes.max() <= LONG * int(after.sizes.sum()) ** 0.5))
    return both.agg(F.count("*").alias("n_vectors"), F.count_if(F.col("list_id") != F.col("nearest")).alias("misplaced")).withColumn("short", short)


@register("ann_codes_recall")
def q_ann_codes_recall(spark, d):
    """K4 by product-quantised codes and an exact shortlist: whether recall@10 is 0.9 or more,
    every vector as a query, and whether the shortlist is under a quarter of the vectors."""
    from docsift.operators.ann import lists_for
    from docsift.operators.knn import knn
    from docsift.operators.pq import PqIndex

    vecs = vecs_of(spark, d)
    n = vecs.count()
    idx = PqIndex.build(_ivf(spark, d, lists_for(n))).fit()
    queries = vecs.select(F.col("id").alias("query_id"), "embedding")
    exact = knn(idx.ivf.vectors.select("id", "embedding"), queries, 10).select("query_id", "id")
    both = exact.join(idx.search(queries, 10).select("query_id", "id", F.lit(1.0).alias("found")), ["query_id", "id"], "left")
    recall = F.avg(F.coalesce("found", F.lit(0.0)))
    return both.agg(F.count_distinct("query_id").alias("n_queries"), (recall >= 0.9).alias("reached"), F.lit(idx.shortlist < n / 4).alias("short"))


@register("ann_recall")
def q_ann_recall(spark, d):
    """Q4 for K4: recall@10 against the exact search at nprobe 1, 2, 4, 8; one search at 8."""
    from docsift.operators.ann import ann_candidates, within_probes
    from docsift.operators.knn import knn
    from docsift.plans.evaluate import recall_at_k
    from docsift.session import materialised

    idx = _fixed_ivf(spark, d)
    queries = vecs_of(spark, d).select(F.col("id").alias("query_id"), "embedding")
    exact = materialised(knn(idx.vectors.select("id", "embedding"), queries, 10))
    found = materialised(ann_candidates(idx, queries, 10, nprobe=8))
    out = None
    for p in (1, 2, 4, 8):
        r = recall_at_k(within_probes(found, 10, p), exact, 10).select(F.lit(p).alias("nprobe"), r6("recall").alias("recall"))
        out = r if out is None else out.unionByName(r)
    return out


@register("semantic_search_ann")
def q_semantic_search_ann(spark, d):
    """Q1 + K4 + F5 + J2: every benchmark text through the lists (around the first 16
    documents), 50 rows or more looked at for each, k = 10, score >= 0.4."""
    import numpy as np

    from docsift.operators.ann import build_ivf
    from docsift.operators.embed import HashingEmbedder
    from docsift.plans.search import search_texts
    from docsift.session import materialised

    vectors = materialised(hashing_vectors(spark, d))
    first = vectors.filter("cast(id as long) < 16").orderBy(F.col("id").cast("long")).select("embedding").collect()
    index = build_ivf(vectors, centroids=np.asarray([r["embedding"] for r in first], dtype=np.float64))
    res = search_texts(docs_of(spark, d), vectors, benchmark_queries(spark, d), HashingEmbedder(64), 10, 0.4, 50, index)
    return res.select("query_id", F.col("rank").cast("long").alias("rank"), "id", r6("score").alias("score"), "text")


@register("search_dispatch_metadata")
def q_search_dispatch_metadata(spark, d):
    """Q3: a metadata filter replaces the query, type and threshold."""
    from docsift.plans.search import search

    res = search(
        docs_of(spark, d), None, "population of portugal", k=10, type="semantic",
        metadata={"key": "source", "value": "src7"}, threshold=0.99,
    )
    return _show_results(res, with_query=False)


@register("search_dispatch_text")
def q_search_dispatch_text(spark, d):
    """Q3: type 'fulltext' -> substring search, first 10 in id order."""
    from docsift.plans.search import search

    res = search(docs_of(spark, d), None, "Eau", k=10, type="fulltext")
    return _show_results(res, with_query=False)


@register("search_dispatch_unknown_type")
def q_search_dispatch_unknown_type(spark, d):
    """Q3: an unknown type is semantic (hashing embedder), threshold 0.6."""
    from docsift.operators.embed import HashingEmbedder
    from docsift.plans.search import search

    res = search(
        docs_of(spark, d), hashing_vectors(spark, d), "the and of in", k=10, type="bogus",
        threshold=0.6, embedder=HashingEmbedder(64),
    )
    return _show_results(res, with_query=False)


# --------------------------------------------------------------- sources and streaming


@register("text_files")
def q_text_files(spark, d):
    """Every document written as ``<doc_id>.txt``, read back whole."""
    from docsift.session import scratch_path
    from docsift.sources.files import read_text_files, write_text_files

    path = scratch_path(spark, "text-files")
    src = read_table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), "text")
    write_text_files(src, path)
    return read_text_files(spark, path).select("name", "text")


def conversation_json_lines(spark, d) -> DataFrame:
    """The conversation changes as JSON lines (one object per change)."""
    ch = conversation_changes(spark, d)
    return ch.select(F.col("ordinal").alias("turn"), F.to_json(F.struct("id", "text", "metadata", "ordinal")).alias("value"))


@register("json_documents")
def q_json_documents(spark, d):
    """S2 + F6 + P3: event requests written as JSON lines and read back."""
    from docsift.operators.mutate import validate
    from docsift.session import scratch_path
    from docsift.sources.json_docs import read_json_documents

    e = read_table(spark, d, "events")
    text = F.when(e.event_type != "error", F.concat(F.lit(', "text": "'), e.event_type, F.lit('"'))).otherwise(F.lit(""))
    line = F.concat(F.lit('{"id": "'), e.event_id.cast("string"), F.lit('"'), text, F.lit(', "metadata": '), e.props, F.lit("}"))
    path = scratch_path(spark, "json-docs")
    e.select(line.alias("value")).write.text(path)
    checked = validate(read_json_documents(spark, path))
    return checked.select("id", "text", meta_str().alias("metadata"), "error")


@register("json_types_rejected")
def q_json_types_rejected(spark, d):
    """S2 + F6: a text, id or metadata of a wrong JSON type, counted by error."""
    from docsift.operators.mutate import validate
    from docsift.sources.json_docs import parse_json_documents

    e = read_table(spark, d, "events")
    number, name = e.event_id.cast("string"), F.concat(F.lit('"'), e.event_id.cast("string"), F.lit('"'))
    kind = F.pmod(e.event_id, F.lit(6))
    text = F.when(kind == 1, number).when(kind == 2, F.lit('{"a": 1}')).otherwise(F.lit('"t"'))
    meta = F.when(kind == 4, F.lit('"{}"')).when(kind == 5, F.lit('{"x": 1e400}')).otherwise(e.props)
    line = F.concat(F.lit('{"id": '), F.when(kind == 3, number).otherwise(name), F.lit(', "text": '), text, F.lit(', "metadata": '), meta, F.lit("}"))
    checked = validate(parse_json_documents(e.select(line.alias("value"))))
    return checked.groupBy("error").agg(F.count("*").alias("n"))


def _ingested(spark, d, embedder=None, reverse: bool = False):
    """A store after two runs of the stream: the first turns arrive, then the others (or the
    other way round)."""
    from docsift.operators.index import load_or_build
    from docsift.session import scratch_path
    from docsift.sources.store import Store
    from docsift.streaming.ingest import ingest

    root = scratch_path(spark, "ingest")
    lines = conversation_json_lines(spark, d)
    store = Store(spark, f"{root}/store")
    store.publish(docs_of(spark, d))
    if embedder is not None:
        load_or_build(store, embedder)
    parts = [("early", F.col("turn") < 2), ("late", F.col("turn") >= 2)]
    for name, part in reversed(parts) if reverse else parts:
        lines.filter(part).select("value").write.text(f"{root}/incoming/{name}")
        ingest(spark, f"{root}/incoming", store, f"{root}/checkpoint", MUT_AS_OF, embedder)
    return store


@register("ingest_stream")
def q_ingest_stream(spark, d):
    """Conversation changes arrive as JSON-lines files in two batches; the final table
    equals the upsert batch of all changes."""
    return show_table(_ingested(spark, d).documents())


@register("ingest_out_of_order")
def q_ingest_out_of_order(spark, d):
    """The last changes arrive first; the final table is that of the upsert batch all the same."""
    return show_table(_ingested(spark, d, reverse=True).documents())


@register("ingest_stream_vectors")
def q_ingest_stream_vectors(spark, d):
    """I1 + K2: the vectors after the stream equal a rebuild over the final table."""
    from docsift.operators.embed import HashingEmbedder

    return _vec_digest(_ingested(spark, d, HashingEmbedder(64)).vectors())


@register("result_preview")
def q_result_preview(spark, d):
    """P5: the best document per benchmark text as the reference's scripts
    print it: score at 4 decimals and the first 200 characters."""
    from docsift.operators.embed import HashingEmbedder, embed_queries
    from docsift.operators.knn import best_match
    from docsift.plans.search import preview

    q = embed_queries(benchmark_queries(spark, d), HashingEmbedder(64))
    top = best_match(hashing_vectors(spark, d), q).withColumnRenamed("similarity", "score")
    shown = preview(top.join(docs_of(spark, d).select("id", "text"), "id"))
    return shown.select("query_id", "id", "score", "text")


def _engine_after_upsert(spark, d):
    """Documents loaded into a store with vectors built, then the conversation changes
    applied through the engine."""
    import datetime as dt

    from docsift.operators.embed import HashingEmbedder
    from docsift.operators.index import load_or_build
    from docsift.plans.api import SearchEngine
    from docsift.session import scratch_path

    clock = lambda: dt.datetime.strptime(MUT_AS_OF, "%Y-%m-%d %H:%M:%S")
    eng = SearchEngine(spark, scratch_path(spark, "engine"), HashingEmbedder(64), buckets=16, clock=clock)
    eng.store.publish(docs_of(spark, d))
    load_or_build(eng.store, eng.embedder)
    eng.documents.upsert_batch(conversation_changes(spark, d))
    return eng


@register("store_upsert_batch")
def q_store_upsert_batch(spark, d):
    """S5 + M5 through the engine: the stored table after the changes."""
    return show_table(_engine_after_upsert(spark, d).docs())


@register("store_vectors")
def q_store_vectors(spark, d):
    """K1 + K2 through the engine: stored vectors after the changes equal a
    rebuild over the changed table."""
    return _vec_digest(_engine_after_upsert(spark, d).vectors())
