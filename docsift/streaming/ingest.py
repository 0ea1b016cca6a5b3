"""Streaming document ingest.

JSON-lines change files arrive in a folder; each micro-batch is parsed (S2), validated
(F6), upserted with the last change of each id winning (M5), its vectors and lists synced
(K2) and all published as one version (S5) that records the batch id. Later versions
inherit it, so a batch that was published once is skipped ever after: a restarted query
or a replayed batch changes nothing.

The stream's state is keyed by id: the largest ordinal applied so far, a table of the store
that is published with the documents, in one step. A change with a smaller ordinal than its
id's arrives too late and is dropped. So any split of the changes into files, and any order of
their arrival, gives the table of one upsert batch. Of changes with equal ordinals the one that
arrives last wins; a change without ordinal is applied as it arrives and leaves the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators.index import publish_synced
from docsift.operators.mutate import latest_per_id, prepare, upsert_batch
from docsift.sources.json_docs import parse_json_documents
from docsift.sources.store import Store


def in_time(changes: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes that aren't older than the state, the new state) of prepared ``changes`` and
    ``state [id, ordinal]``. Rejected rows pass, so that they are reported."""
    applied = state.select("id", F.col("ordinal").alias("_applied"))
    late = F.col("ordinal").isNotNull() & F.col("_applied").isNotNull() & (F.col("ordinal") < F.col("_applied"))
    fresh = changes.join(applied, "id", "left").filter(~late).drop("_applied")
    given = changes.filter(F.col("error").isNull() & F.col("ordinal").isNotNull()).select("id", "ordinal")
    return fresh, state.unionByName(given).groupBy("id").agg(F.max("ordinal").alias("ordinal"))


def apply_batch(store: Store, batch: DataFrame, batch_id: int, as_of, embedder=None) -> bool:
    """Apply one micro-batch of raw JSON lines; False when already applied. Without an
    embedder only the documents are published, and health reports stale vectors."""
    head = store.head()
    if head is not None and head.batch_id is not None and batch_id <= head.batch_id:
        return False
    changes = prepare(parse_json_documents(batch), require_id=True)
    changes, ordinals = in_time(changes, store.ordinals(head))
    table, _ = upsert_batch(store.documents(head), changes, as_of, deal=store.deal)
    if embedder is None:
        store.publish(store.stage(table, "documents", dealt=True), parent=head, batch_id=batch_id, ordinals=ordinals)
        return True
    publish_synced(store, head, table, embedder, latest_per_id(changes), dealt=True, batch_id=batch_id, ordinals=ordinals)
    return True


def ingest(
    spark: SparkSession,
    source: str,
    store: Store,
    checkpoint: str,
    as_of,
    embedder=None,
    files_per_batch: int | None = None,
    available_now: bool = True,
):
    """Start the ingest stream; with ``available_now`` it processes what is there and
    stops (returns after termination)."""
    reader = spark.readStream.schema("value string").option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.text(source)

    def each(df: DataFrame, batch_id: int) -> None:
        apply_batch(store, df, batch_id, as_of, embedder)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
