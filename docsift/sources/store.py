"""Versioned document and vector tables as partitioned Parquet.

Layout under ``root`` (any Hadoop file system path):

    documents-<unique>/bucket=B/   documents by a hash of the id, sorted by id
    vectors-<unique>/bucket=B/     vectors, the same way
    lists-<unique>/list_id=L/      optional: vectors with their coarse list
    centroids-<unique>/            optional: a row a list, with its centroid and size
    ordinals-<unique>/bucket=B/    optional: the largest ordinal that ingest has applied to each id
    segment-<unique>/              optional: segments of the trigram index of the texts
    v=N/pointer/                   one JSON row: the folder of each table of version N

A publish writes its tables to fresh folders, then the pointer to one, which is renamed to
``v=N`` as the last step; the rename fails if the version exists. So readers never see half
a version, and a publish that was killed leaves folders that no pointer names and nothing
reads: it blocks nothing. A table that a publish doesn't give is inherited. The head is the
largest version with a pointer. A publish names the version it started from and fails if
another was published meanwhile. A table may be staged first: it is written to its fresh folder
and read from there while the rest of the version is made. Documents published over a version with a trigram index are
compared with its documents by id, text hash and metadata, and the index follows what changed.
``retain`` removes old versions and what no pointer names.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.operators.trigram_segments import Segment, SegmentedTrigrams
from docsift.schema import DOCUMENTS, VECTOR_TYPE, VECTORS

LISTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("embedding", VECTOR_TYPE, False),
        T.StructField("list_id", T.IntegerType(), False),
    ]
)
CENTROIDS = T.StructType(
    [
        T.StructField("list_id", T.IntegerType()),
        T.StructField("centroid", T.ArrayType(T.DoubleType())),
        T.StructField("n", T.LongType()),
    ]
)
ORDINALS = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("ordinal", T.LongType(), False)])
TABLES = {"documents": DOCUMENTS, "vectors": VECTORS, "lists": LISTS, "centroids": CENTROIDS, "ordinals": ORDINALS}
BUCKETED = ("documents", "vectors", "ordinals")
DEFAULT_BUCKETS = 64


class Conflict(RuntimeError):
    """Another version was published since the one a publish started from."""


@dataclass
class Version:
    """A pointer: the folder of each table (None: there is none)."""

    version: int
    batch_id: int | None = None
    documents: str | None = None
    vectors: str | None = None
    lists: str | None = None
    centroids: str | None = None
    ordinals: str | None = None
    synced: bool = False  # the vectors are those of the documents
    nprobe: int = 1  # lists that a search of the lists probes
    trigrams: list[dict] | None = None  # segments of the trigram index

    def folders(self) -> set[str]:
        """Folders that the version names, its own among them."""
        tables = {getattr(self, t) for t in TABLES} - {None}
        return tables | {s["name"] for s in self.trigrams or []} | {f"v={self.version}"}


@dataclass(frozen=True)
class Staged:
    """A table that is written, but that no version names yet."""

    table: str
    folder: str


def changed_ids(before: DataFrame, after: DataFrame) -> DataFrame:
    """[id] of the documents that were inserted, deleted, or have another text or metadata; reads
    ids, text hashes and metadata. A document without a text hash counts as changed."""
    said = lambda df, name: df.select("id", F.struct("text_hash", F.array_sort(F.map_entries("metadata")).alias("m")).alias(name))
    both = said(before, "_was").join(said(after, "_is"), "id", "full_outer")
    same = (F.col("_was.text_hash") == F.col("_is.text_hash")) & (F.col("_was.m") == F.col("_is.m"))
    return both.filter(~F.coalesce(same, F.lit(False))).select("id")


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = DEFAULT_BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = int(buckets)

    def _bucket(self, id_col: Column) -> Column:
        return F.pmod(F.xxhash64(id_col), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[Version]:
        """All published versions, oldest first (``retain`` bounds them)."""
        try:
            rows = self.spark.read.text(f"{self.root}/v=*/pointer").select("value").collect()
        except AnalysisException:
            return []
        return sorted((Version(**json.loads(r["value"])) for r in rows), key=lambda v: v.version)

    def head(self) -> Version | None:
        found = self.versions()
        return found[-1] if found else None

    # ------------------------------------------------------------ reading

    def _read(self, table: str, version: Version | None) -> DataFrame:
        version = version or self.head()
        holder = getattr(version, table) if version else None
        if holder is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self._of(table, holder)

    def _of(self, table: str, holder: str) -> DataFrame:
        schema = TABLES[table]
        if table in BUCKETED:
            schema = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{holder}")

    def _plain(self, table: str, version: Version | None) -> DataFrame:
        return self._read(table, version).select(*TABLES[table].names)

    def staged(self, table: Staged) -> DataFrame:
        return self._of(table.table, table.folder).select(*TABLES[table.table].names)

    def documents(self, version: Version | None = None) -> DataFrame:
        return self._plain("documents", version)

    def document(self, doc_id: str, version: Version | None = None) -> DataFrame:
        """Zero or one row; only the id's bucket is read."""
        docs = self._read("documents", version)
        if "bucket" in docs.columns:
            docs = docs.filter(F.col("bucket") == self._bucket(F.lit(doc_id)))
        return docs.filter(F.col("id") == doc_id).select(*DOCUMENTS.names)

    def vectors(self, version: Version | None = None) -> DataFrame:
        return self._plain("vectors", version)

    def lists(self, version: Version | None = None) -> DataFrame:
        """Vectors with their list; a filter on ``list_id`` reads only those folders."""
        return self._plain("lists", version)

    def ordinals(self, version: Version | None = None) -> DataFrame:
        """[id, ordinal]: the largest ordinal applied to each id that ingest has changed."""
        return self._plain("ordinals", version)

    def centroids(self, version: Version | None = None) -> np.ndarray | None:
        """The centroids (a row a list), or None."""
        found = self.coarse(version)
        return found[0] if found else None

    def coarse(self, version: Version | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """(centroids, rows of each list), a row a list, or None."""
        rows = self._read("centroids", version).orderBy("list_id").collect()
        if not rows:
            return None
        return np.asarray([r["centroid"] for r in rows], dtype=np.float64), np.asarray([r["n"] for r in rows], dtype=np.int64)

    def trigrams(self, version: Version | None = None) -> SegmentedTrigrams | None:
        """The trigram index of a version's texts, or None."""
        version = version or self.head()
        if version is None or not version.trigrams:
            return None
        return SegmentedTrigrams(self.spark, self.root, tuple(Segment(**s) for s in version.trigrams))

    # ------------------------------------------------------------ writing

    def deal(self, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        """(rows with an id dealt as ``stage`` writes a bucketed table; the columns, the id among
        them, that name an id's rows in their order). Ranges of an id's hash within its bucket: a
        bucket may go to many tasks, and a task has near buckets, so it writes few files."""
        rows = rows.withColumn("bucket", self._bucket(F.col("id"))).withColumn("_part", F.hash("id"))
        return rows.repartitionByRange("bucket", "_part"), ["bucket", "id", "_part"]

    def stage(self, df: DataFrame, table: str, dealt: bool = False) -> Staged:
        """Writes a table that a later publish names; ``dealt``: its rows, with their bucket, come
        from ``deal``, and aren't shuffled again."""
        return Staged(table, self._write(df, table, dealt))

    def _write(self, df: DataFrame, table: str, dealt: bool = False) -> str:
        """Writes a table to a fresh folder; its name."""
        folder = f"{table}-{uuid.uuid4().hex}"
        path = f"{self.root}/{folder}"
        if dealt:
            df.select(*TABLES[table].names, "bucket").sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(path)
            return folder
        df = df.select(*TABLES[table].names)
        if table == "centroids":
            df.coalesce(1).write.parquet(path)
            return folder
        part = "list_id" if table == "lists" else "bucket"
        if part == "bucket":
            df = df.withColumn("bucket", self._bucket(F.col("id")))
        # AQE cuts a large part into several files and packs small ones.
        df.hint("rebalance", part).sortWithinPartitions(part, "id").write.partitionBy(part).parquet(path)
        return folder

    def _files(self):
        """(file system of the root, constructor of paths)."""
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        return make(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), make

    def _point(self, new: Version) -> None:
        """The last step of a publish: the pointer, complete, becomes ``v=N`` by one rename."""
        fresh = f"{self.root}/pointer-{uuid.uuid4().hex}"
        row = self.spark.createDataFrame([(json.dumps(asdict(new)),)], "value string")
        row.coalesce(1).write.text(f"{fresh}/pointer")
        fs, make = self._files()
        source, target = (fs.makeQualified(make(p)) for p in (fresh, f"{self.root}/v={new.version}"))
        files = self.spark._jvm.org.apache.hadoop.fs
        no_options = self.spark.sparkContext._gateway.new_array(files.Options.Rename, 0)
        try:
            files.FileContext.getFileContext(source.toUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, no_options)
        except Exception as e:
            if fs.exists(target):
                raise Conflict(f"version {new.version} was published meanwhile") from e
            raise

    def _next(self, parent: Version | None) -> int:
        """The number after ``parent``; folders of such a name without a pointer are passed over."""
        number = parent.version + 1 if parent else 0
        known = {v.version for v in self.versions()}
        fs, make = self._files()
        while number not in known and fs.exists(make(f"{self.root}/v={number}")):
            number += 1
        return number

    def publish(self, documents: DataFrame | Staged | None = None, vectors: DataFrame | Staged | None = None, parent: Version | None = None,
                lists: DataFrame | None = None, centroids: np.ndarray | None = None, batch_id: int | None = None,
                synced: bool = False, keep_lists: bool = True, nprobe: int | None = None, ordinals: DataFrame | None = None,
                trigrams: SegmentedTrigrams | None = None) -> Version:
        """Write the given tables as the version after ``parent`` (None: the first one); the
        others, the batch id and nprobe if none is given, are inherited. New vectors without
        new lists drop the lists; ``keep_lists=False`` drops them, their centroids and the trigram
        index. New lists are counted, and their sizes stored with the centroids. The trigram index
        follows new documents, unless one is given."""
        head = self.head()
        if (head and head.version) != (parent and parent.version):
            raise Conflict(f"started from version {parent and parent.version}, but the head is {head and head.version}")
        new = Version(**asdict(parent)) if parent else Version(0)
        new.version = self._next(parent)
        new.batch_id = new.batch_id if batch_id is None else batch_id
        new.nprobe = new.nprobe if nprobe is None else nprobe
        new.synced = synced
        if vectors is not None and lists is None:
            new.lists = None
        if not keep_lists:
            new.lists = new.centroids = new.trigrams = None
        for table, df in (("documents", documents), ("vectors", vectors), ("lists", lists), ("ordinals", ordinals)):
            if df is not None:
                setattr(new, table, df.folder if isinstance(df, Staged) else self._write(df, table))
        if trigrams is None and documents is not None and new.trigrams:
            written = self.documents(new)
            trigrams = self.trigrams(parent).after(changed_ids(self.documents(parent), written), written)
        if trigrams is not None:
            new.trigrams = [asdict(s) for s in trigrams.segments]
        if centroids is None and lists is not None:
            centroids = self.centroids(parent)
        if centroids is not None:
            counts = {}
            if new.lists is not None:
                sizes = self._read("lists", new).groupBy("list_id").agg(F.count("*").alias("n"))
                counts = {r["list_id"]: r["n"] for r in sizes.collect()}  # a row a list
            rows = [(i, [float(x) for x in c], counts.get(i, 0)) for i, c in enumerate(centroids)]
            new.centroids = self._write(self.spark.createDataFrame(rows, CENTROIDS), "centroids")
        self._point(new)
        return new

    def new_db(self) -> Version:
        """S5 ``--new-db``: publish an empty version, without lists."""
        empty = lambda schema: self.spark.createDataFrame([], schema)
        return self.publish(
            empty(DOCUMENTS), empty(VECTORS), parent=self.head(), synced=True, keep_lists=False, ordinals=empty(ORDINALS)
        )

    def retain(self, n: int, unnamed_after: float = 86_400.0) -> list[int]:
        """Keep the last ``n`` versions and the tables they name; returns the removed ones.
        Other folders of the store go once they are ``unnamed_after`` seconds old: younger
        ones may belong to a publish that is under way."""
        found = self.versions()
        kept = found[-max(1, n) :]
        used = set().union(*(v.folders() for v in kept))
        old = set().union(*(v.folders() for v in found))
        fs, make = self._files()
        before = (time.time() - unnamed_after) * 1000
        if fs.exists(make(self.root)):
            for status in fs.listStatus(make(self.root)):
                name = status.getPath().getName()
                ours = name.split("-")[0] in (*TABLES, "segment", "pointer") or name.startswith("v=")
                if ours and name not in used and (name in old or status.getModificationTime() < before):
                    fs.delete(status.getPath(), True)
        return [v.version for v in found[: -max(1, n)]]
