"""The vector table's build, drift, incremental sync and health.

The vectors table is keyed by document id (never by position) and carries
the hash of the text it was computed from and the embedder's name, so drift
is an id join: a document without a vector is ``missing``, a vector without
a document is an ``orphan``, a vector whose text hash or model differs is
``stale``. Sync embeds only missing and stale documents; its result equals
a full rebuild.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.operators.embed import embed_documents
from docsift.schema import VEC_COLUMNS
from docsift.session import materialised

def rebuild(docs: DataFrame, embedder) -> DataFrame:
    """K1: vectors for every document."""
    return embed_documents(docs, embedder)


def drift(docs: DataFrame, vectors: DataFrame, model: str | None = None) -> DataFrame:
    """[id, status] with status in missing / orphan / stale / ok.

    Reads ids and the stored hashes only, never texts or vectors.
    """
    d = docs.select("id", F.col("text_hash").alias("_dh"), F.lit(True).alias("_d"))
    v = vectors.select("id", F.col("text_hash").alias("_vh"), F.col("model").alias("_vm"), F.lit(True).alias("_v"))
    j = d.join(v, "id", "full_outer")
    # A vector without a recorded hash cannot be verified: it counts as stale.
    stale = (F.col("_dh") != F.col("_vh")) | F.col("_vh").isNull()
    if model is not None:
        stale = stale | (F.col("_vm") != F.lit(model)) | F.col("_vm").isNull()
    status = (
        F.when(F.col("_v").isNull(), F.lit("missing"))
        .when(F.col("_d").isNull(), F.lit("orphan"))
        .when(stale, F.lit("stale"))
        .otherwise(F.lit("ok"))
    )
    return j.select("id", status.alias("status"))


def sync(docs: DataFrame, vectors: DataFrame, embedder, changed: DataFrame | None = None) -> DataFrame:
    """K2: keep the vectors that are still right, embed the rest.

    The drift compares ids and stored hashes only; its rows that aren't ok (few after an
    edit) are materialised once. Texts are read for the documents to embed alone: from
    ``changed [id, text, text_hash]`` (unique ids), if given, where it has them as ``docs`` do, and
    from ``docs``, whose texts are shuffled, only if others drifted. Without vectors all are embedded."""
    if vectors.isEmpty():
        return embed_documents(docs.filter(F.col("id").isNotNull()), embedder)
    todo = materialised(drift(docs, vectors, embedder.model).filter(F.col("status") != "ok"))
    gone = todo.filter(F.col("status").isin("orphan", "stale")).select("id")
    fresh = todo.filter(F.col("status").isin("missing", "stale")).select("id")
    kept = vectors.select(*VEC_COLUMNS).join(gone, "id", "left_anti")
    embed = lambda some: embed_documents(some, embedder)
    if changed is None:
        return kept.unionByName(embed(docs.join(fresh, "id", "left_semi")))
    # A row a document, as ids may repeat there.
    ours = docs.select("id", "text_hash").join(fresh, "id", "left_semi")
    known = materialised(ours.join(changed.select("id", "text", "text_hash"), ["id", "text_hash"]))
    out = kept.unionByName(embed(known))
    rest = ours.join(known, ["id", "text_hash"], "left_anti").select("id", F.col("text_hash").alias("_hash"))
    if rest.isEmpty():
        return out
    same = (F.col("id") == F.col("_id")) & F.col("text_hash").eqNullSafe(F.col("_hash"))
    return out.unionByName(embed(docs.join(rest.withColumnRenamed("id", "_id"), same, "left_semi")))


def health(docs: DataFrame, vectors: DataFrame, model: str | None = None) -> DataFrame:
    """A4: one row [documents, vectors, missing, orphans, stale]."""
    dr = drift(docs, vectors, model)
    counts = dr.agg(
        F.sum(F.when(F.col("status") != "orphan", 1).otherwise(0)).alias("documents"),
        F.sum(F.when(F.col("status") != "missing", 1).otherwise(0)).alias("vectors"),
        F.sum(F.when(F.col("status") == "missing", 1).otherwise(0)).alias("missing"),
        F.sum(F.when(F.col("status") == "orphan", 1).otherwise(0)).alias("orphans"),
        F.sum(F.when(F.col("status") == "stale", 1).otherwise(0)).alias("stale"),
    )
    return counts.select(*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts.columns])


def publish_synced(store, head, documents: DataFrame, embedder, changed: DataFrame | None = None, dealt: bool = False,
                   batch_id: int | None = None, ordinals: DataFrame | None = None):
    """Publish documents with their vectors, synced, and lists. The documents are written first and
    the sync reads them back, so that they are computed once; ``changed`` as for ``sync``, ``dealt``
    as for ``Store.stage``."""
    staged = store.stage(documents, "documents", dealt)
    vectors = sync(store.staged(staged), store.vectors(head), embedder, changed)
    return publish_in_step(store, head, staged, vectors, synced=True, batch_id=batch_id, ordinals=ordinals)


def publish_in_step(store, head, documents, vectors: DataFrame, synced: bool, batch_id: int | None = None,
                    ordinals: DataFrame | None = None):
    """Publish tables (documents: a frame, a staged table or None) with the coarse lists of the
    vectors, if the store keeps lists: unchanged vectors keep their list, the others are assigned."""
    from docsift.operators.ann import assign_lists, carry_lists

    lists = None
    if head is not None and head.centroids is not None:
        centroids = store.centroids(head)
        if head.lists is not None:
            lists, _ = carry_lists(vectors, store.lists(head), centroids)
        else:
            lists = assign_lists(vectors.select("id", "embedding"), centroids)
    return store.publish(documents, vectors, parent=head, lists=lists, batch_id=batch_id, synced=synced, ordinals=ordinals)


def load_or_build(store, embedder) -> DataFrame:
    """The vectors of the store's head, synced to its documents (a full build when
    there are none yet) and published with the lists."""
    head = store.head()
    vectors = sync(store.documents(head), store.vectors(head), embedder)
    return store.vectors(publish_in_step(store, head, None, vectors, synced=True))
