"""F3 under edits: a trigram index in segments, each a ``TrigramIndex`` of its own.

An edit writes one more segment: an index of the documents that changed, and their ids, the
deleted ones among them, which older segments no longer answer for. So an edit costs what it
changed. The last two segments are merged while the last is at least half the size of the one
before; so there are at most about log2(n) segments, and a document is indexed again about
log2(n) times in its life. A search asks every segment for its candidates and leaves out, by
an anti join of ids, what a later segment has replaced. Results equal the plain search's over
the documents as they are now.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators.trigram import TrigramIndex
from docsift.schema import TEXT_SCORE, check_k

GROWTH = 2


@dataclass(frozen=True)
class Segment:
    name: str  # folder
    rows: int  # documents, and ids it takes from older segments
    first: bool = False  # there is no older one, so it takes no ids


@dataclass(frozen=True)
class SegmentedTrigrams:
    """Segments under ``root``, oldest first. Folders are never rewritten: an older value goes
    on answering for its own state of the documents until its folders are removed."""

    spark: SparkSession
    root: str
    segments: tuple[Segment, ...] = ()
    sizes: tuple[tuple[str, int], ...] = ()  # settings of every segment's index: buckets, chunk, block

    @staticmethod
    def build(docs: DataFrame, root: str, **sizes: int) -> SegmentedTrigrams:
        """One segment of ``docs [id, text, metadata]`` (unique ids); ``sizes`` as for ``TrigramIndex.build``."""
        empty = SegmentedTrigrams(docs.sparkSession, root.rstrip("/"), (), tuple(sizes.items()))
        return replace(empty, segments=(empty._write(docs, None),))

    def _path(self, segment: Segment) -> str:
        return f"{self.root}/{segment.name}"

    def index(self, segment: Segment) -> TrigramIndex:
        return TrigramIndex(self.spark, f"{self._path(segment)}/index", **dict(self.sizes))

    def taken(self, segment: Segment) -> DataFrame:
        """[id] that a segment takes from older ones."""
        return self.spark.read.schema("id string").parquet(f"{self._path(segment)}/taken")

    def _write(self, docs: DataFrame, taken: DataFrame | None) -> Segment:
        segment = Segment(f"segment-{uuid.uuid4().hex}", 0, taken is None)
        path = self._path(segment)
        TrigramIndex.build(docs, f"{path}/index", **dict(self.sizes))
        rows = self.index(segment).texts().count()
        if taken is not None:
            taken.select("id").write.parquet(f"{path}/taken")
            rows = max(rows, self.taken(segment).count())
        return replace(segment, rows=rows)

    def after(self, changed: DataFrame, docs: DataFrame) -> SegmentedTrigrams:
        """The index after the documents ``changed [id]`` were edited, inserted or deleted;
        ``docs [id, text, metadata]`` are the documents afterwards, of which only the changed
        ones are indexed. Ids may repeat, or be of documents that never were; null ids are ignored."""
        ids = changed.select("id").where("id is not null").distinct()
        if ids.isEmpty():
            return self
        fresh = self._write(docs.select("id", "text", "metadata").join(ids, "id", "left_semi"), ids)
        out = replace(self, segments=(*self.segments, fresh))
        while len(out.segments) > 1 and out.segments[-1].rows * GROWTH >= out.segments[-2].rows:
            out = out._merged()
        return out

    def _merged(self) -> SegmentedTrigrams:
        """The last two segments as one."""
        *rest, older, newer = self.segments
        texts = lambda s: self.index(s).texts().select("id", "text", "metadata")
        kept = texts(older).join(self.taken(newer), "id", "left_anti").unionByName(texts(newer))
        taken = None if older.first else self.taken(older).unionByName(self.taken(newer)).distinct()
        return replace(self, segments=(*rest, self._write(kept, taken)))

    def compacted(self) -> SegmentedTrigrams:
        """All segments as one."""
        out = self
        while len(out.segments) > 1:
            out = out._merged()
        return out

    def _live(self, of) -> DataFrame:
        """Rows [id, ..] of each segment by ``of``, without those that a later segment took."""
        parts = []
        for i, segment in enumerate(self.segments):
            rows, later = of(self.index(segment)), [self.taken(s) for s in self.segments[i + 1 :]]
            parts.append(rows.join(reduce(DataFrame.unionByName, later), "id", "left_anti") if later else rows)
        return reduce(DataFrame.unionByName, parts)

    def documents(self) -> DataFrame:
        """[id, text, metadata] of every document as it is now."""
        return self._live(lambda index: index.texts().select("id", "text", "metadata"))

    def matches(self, query: str) -> DataFrame:
        """[id, text, metadata] of every document whose text contains ``query``, as LIKE has it."""
        return self._live(lambda index: index.matches(query))

    def search(self, query: str, k: int = 10, threshold: float = 0.0) -> DataFrame:
        """F3 + T3 + P6 + F5 as ``text_search``: the first k matches in id order, score 1.0."""
        hits = self.matches(query).orderBy("id").limit(check_k(k)).withColumn("score", F.lit(TEXT_SCORE))
        if threshold > TEXT_SCORE:
            hits = hits.filter(F.lit(False))
        return hits.select("id", "text", "score", "metadata")
