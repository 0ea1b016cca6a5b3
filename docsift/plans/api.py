"""The reference client's call surface over a versioned store.

    eng = SearchEngine(spark, root, HashingEmbedder(64))
    eng.documents.create("text", {"k": "v"})
    eng.search.query("population of portugal", threshold=0.7).show()

Every call is a Spark plan. A mutation applies the operator (``operators.mutate``) to the
head's documents, syncs vectors (K2) and lists, and publishes all as one version, which
fails if another was published meanwhile. Edits are meant to come in batches: a version
rewrites the tables it changes. Results and reports come back as DataFrames, counts as ints.
"""

from __future__ import annotations

import datetime as _dt
import json
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators import lookup, metadata as meta_ops, mutate
from docsift.operators.ann import IvfIndex, build_ivf, fit_nprobe, lists_for
from docsift.operators.index import health as health_op
from docsift.operators.index import publish_in_step, publish_synced
from docsift.operators.index import rebuild as rebuild_op
from docsift.operators.list_upkeep import balanced
from docsift.operators.trigram_segments import SegmentedTrigrams
from docsift.plans import search as search_ops
from docsift.schema import DEFAULT_EF_SEARCH, DEFAULT_K, DEFAULT_TYPE
from docsift.sources.store import DEFAULT_BUCKETS, Store

REQUEST = "id string, text string, metadata_json string, ordinal long"


class SearchEngine:
    def __init__(self, spark: SparkSession, root: str, embedder, buckets: int = DEFAULT_BUCKETS, clock=None):
        self.spark = spark
        self.store = Store(spark, root, buckets)
        self.embedder = embedder
        self.clock = clock
        self.documents = Documents(self)
        self.search = Search(self)
        self.index = Index(self)

    def now(self) -> str:
        t = self.clock() if self.clock else _dt.datetime.now(_dt.timezone.utc)
        return t.strftime("%Y-%m-%d %H:%M:%S")

    def docs(self) -> DataFrame:
        return self.store.documents()

    def vectors(self) -> DataFrame:
        return self.store.vectors()

    def health(self) -> DataFrame:
        """A4: [documents, vectors, missing, orphans, stale]."""
        head = self.store.head()
        return health_op(self.store.documents(head), self.store.vectors(head), self.embedder.model)

    def requests(self, documents) -> DataFrame:
        """Documents as dicts ``{text, id?, metadata?}`` (metadata any JSON object) or a
        DataFrame -> request rows for validation."""
        if isinstance(documents, DataFrame):
            return documents
        rows = []
        for i, d in enumerate(documents):
            m = d.get("metadata")
            rows.append((d.get("id"), d.get("text"), None if m is None else json.dumps(m), i))
        return self.spark.createDataFrame(rows, REQUEST)

    def mutate(self, fn, changed: DataFrame | None = None, dealt: bool = False) -> DataFrame:
        """Run ``fn(documents) -> (table, report)`` on the head and publish the table with its
        vectors and lists (``table=None``: no change, nothing published); ``changed`` and ``dealt``
        as for ``publish_synced``."""
        head = self.store.head()
        table, report = fn(self.store.documents(head))
        if table is not None:
            publish_synced(self.store, head, table, self.embedder, changed, dealt)
        return report


class Documents:
    def __init__(self, eng: SearchEngine):
        self.eng = eng

    def total_count(self) -> int:
        return lookup.count_all(self.eng.docs()).first()["count"]

    def create(self, text: str, metadata: dict | None = None, id: str | None = None) -> DataFrame:  # noqa: A002
        """M1 + P4: insert one document; an existing id is refused."""
        return self.create_many([{"text": text, "metadata": metadata, "id": id}])

    def create_many(self, documents) -> DataFrame:
        rows = mutate.prepare(self.eng.requests(documents), generate_ids=True)
        return self.eng.mutate(lambda docs: mutate.insert(docs, rows, self.eng.now())).select("id", "status")

    def retrieve(self, document_id: str) -> DataFrame:
        """zero or one row; only the id's bucket is read."""
        return self.eng.store.document(document_id).select("id", "text", "metadata")

    def _ids(self, ids: Iterable[str] | DataFrame) -> DataFrame:
        return ids if isinstance(ids, DataFrame) else self.eng.spark.createDataFrame([(i,) for i in ids], "id string")

    def retrieve_many(self, ids: Iterable[str] | DataFrame) -> DataFrame:
        """F1 for many ids: a row for each one that exists."""
        return lookup.get_by_ids(self.eng.docs(), self._ids(ids)).select("id", "text", "metadata")

    def exists(self, ids: Iterable[str] | DataFrame) -> DataFrame:
        """[id, exists] for each distinct id."""
        return lookup.exists_flags(self.eng.docs(), self._ids(ids))

    def count_grouped(self) -> DataFrame:
        """A2: [key, value, count] of every metadata value."""
        return meta_ops.count_by_metadata_grouped(self.eng.docs())

    def update(self, document_id: str, text: str, metadata: dict | None = None) -> DataFrame:
        """PUT is an upsert in the reference: a missing id is inserted."""
        return self.upsert(document_id, text, metadata)

    def upsert(self, document_id: str, text: str, metadata: dict | None = None) -> DataFrame:
        return self.upsert_batch([{"id": document_id, "text": text, "metadata": metadata}])

    def delete(self, document_id: str) -> DataFrame:
        """M6: [id, status] with ``deleted`` or ``not_found``."""
        return self.delete_many([document_id])

    def delete_many(self, ids: Iterable[str] | DataFrame) -> DataFrame:
        want = self._ids(ids)
        return self.eng.mutate(lambda docs: mutate.delete(docs, want))

    def count(self, key: str | None = None, value: str | None = None) -> int:
        return meta_ops.count_by_metadata(self.eng.docs(), key, value).first()["count"]

    def list(self, key: str | None = None, value: str | None = None, limit: int | None = None) -> DataFrame:  # noqa: A003
        """All documents, or the matches of a filter; the reference's client sees the first
        1000 matches, which ``limit=schema.LIST_CAP`` gives."""
        return meta_ops.list_by_metadata(self.eng.docs(), key, value, limit)

    def create_batch(self, documents) -> DataFrame:
        """M2: all or nothing; [id, status, reason]."""
        rows = mutate.prepare(self.eng.requests(documents), generate_ids=True)

        def fn(docs):
            table, report = mutate.insert_batch(docs, rows, self.eng.now())
            rolled_back = not report.filter(F.col("status") == "rolled_back").isEmpty()
            return (None if rolled_back else table), report

        return self.eng.mutate(fn)

    def upsert_batch(self, documents) -> DataFrame:
        """M5: rows without id rejected; the last row per id wins."""
        rows = mutate.prepare(self.eng.requests(documents), require_id=True)
        fn = lambda docs: mutate.upsert_batch(docs, rows, self.eng.now(), self.eng.store.deal)
        return self.eng.mutate(fn, changed=mutate.latest_per_id(rows), dealt=True)

    def put_metadata(self, document_id: str, key: str, value: str) -> DataFrame:
        """M7 for one key; other keys kept; unknown id reported."""
        edits = self.eng.spark.createDataFrame([(document_id, key, value)], "id string, key string, value string")
        return self.eng.mutate(lambda docs: (meta_ops.put_metadata(docs, edits), meta_ops.put_metadata_report(docs, edits)))

    def delete_metadata(self, document_id: str, key: str) -> DataFrame:
        """M8: [id, key, deleted]."""
        edits = self.eng.spark.createDataFrame([(document_id, key)], "id string, key string")
        return self.eng.mutate(lambda docs: (meta_ops.delete_metadata(docs, edits), meta_ops.delete_metadata_report(docs, edits)))


class Search:
    def __init__(self, eng: SearchEngine):
        self.eng = eng

    def query(
        self,
        query: str,
        k: int = DEFAULT_K,
        type: str = DEFAULT_TYPE,  # noqa: A002
        metadata: dict | None = None,
        threshold: float = 0.0,
        ef_search: int = DEFAULT_EF_SEARCH,
    ) -> DataFrame:
        """Q3: [rank, id, text, score, metadata], all from one version."""
        e, head = self.eng, self.eng.store.head()
        index = None
        if head is not None and head.lists is not None and metadata is None:
            index = e.index.lists(head)
        return search_ops.search(
            e.store.documents(head), e.store.vectors(head), query, k, type, metadata, threshold, ef_search, e.embedder, index,
            check_orphans=head is not None and not head.synced, trigrams=e.store.trigrams(head),
        )

    def semantic(self, query: str, k: int = DEFAULT_K, threshold: float = 0.0, ef_search: int = 350) -> DataFrame:
        return self.query(query, k, "semantic", None, threshold, ef_search)

    def fulltext(self, query: str, k: int = DEFAULT_K, threshold: float = 0.0) -> DataFrame:
        return self.query(query, k, "fulltext", None, threshold)

    def by_metadata(self, key: str, value: str, k: int = DEFAULT_K) -> DataFrame:
        return self.query("", k, DEFAULT_TYPE, {"key": key, "value": value})


class Index:
    def __init__(self, eng: SearchEngine):
        self.eng = eng

    def rebuild(self):
        """K1: embed every document and publish the vectors and lists."""
        e, head = self.eng, self.eng.store.head()
        return publish_in_step(e.store, head, None, rebuild_op(e.store.documents(head), e.embedder), synced=True)

    def save(self):
        """Every mutation is already published; returns the head."""
        return self.eng.store.head()

    def lists(self, head) -> IvfIndex:
        """The lists of a version, with their stored sizes and fitted ``nprobe``."""
        centroids, sizes = self.eng.store.coarse(head)
        return IvfIndex(centroids, self.eng.store.lists(head), sizes, head.nprobe)

    def build_ivf(self, nlist: int | None = None, seed: int = 42, k: int = DEFAULT_K, recall: float = 0.9) -> IvfIndex:
        """K3: coarse lists for approximate semantic search (K4), as many as the square root of
        the vectors if not given. The number of lists a search probes is fitted to ``recall`` at
        ``k`` against the exact search and published with them."""
        store, head = self.eng.store, self.eng.store.head()
        vectors = store.vectors(head)
        built = fit_nprobe(build_ivf(vectors, nlist or lists_for(vectors.count()), seed), k, recall)
        return self.lists(
            store.publish(parent=head, lists=built.vectors, centroids=built.centroids, synced=head.synced, nprobe=built.nprobe)
        )

    def build_trigrams(self) -> SegmentedTrigrams:
        """a trigram index of the texts, published; text searches go through it, and it
        follows later edits."""
        store, head = self.eng.store, self.eng.store.head()
        built = SegmentedTrigrams.build(store.documents(head), store.root)
        return store.trigrams(store.publish(parent=head, synced=head is not None and head.synced, trigrams=built))

    def upkeep(self, most: int | None = None, k: int = DEFAULT_K, recall: float = 0.9) -> IvfIndex | None:
        """K2: split lists that grew past ``most`` vectors, drop empty ones, fit the number of
        lists a search probes again, and publish; nothing is published if all lists are fine.
        None without lists."""
        store, head = self.eng.store, self.eng.store.head()
        if head is None or head.lists is None:
            return None
        index = self.lists(head)
        after = balanced(index, most)
        if after is index:
            return index
        after = fit_nprobe(after, k, recall)
        return self.lists(
            store.publish(parent=head, lists=after.vectors, centroids=after.centroids, synced=head.synced, nprobe=after.nprobe)
        )
