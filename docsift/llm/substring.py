"""Operator 10: exact removal of long repeated word spans by De Bruijn compaction.

Edges of the graph are the ``window``-word k-mers of the texts; two edges meet in
a node when they follow each other. Storing every edge of a corpus is dear, so:

1. Edges are binned by their minimizer, the least hashed ``gram``-word run in them
   (as partitioned compacters of De Bruijn graphs do). Consecutive edges of a
   document with one minimizer form a path. Only minimizers that occur under two
   document ids can hold a repeated edge; the others go at once, on narrow rows.
2. Paths of the rest are grouped by the hash of all their words: equal paths of
   any number of documents become one path with its least document id.
3. A bin with one path has no branch: every edge in it has that least id. In a
   bin with several, the paths are split into edges, each edge gets its least id
   from all paths that run through it, and a join puts the ids back on the paths.
4. The paths meet their occurrences (document, word position) in a join. An edge
   whose least id is smaller than the document's covers ``window`` words there; the
   covered words are cut out of the source text at those coordinates.

Documents whose word sequence equals that of a smaller id need none of this: all
their edges start in the smaller one. Nothing is collected, and every grouping is
a partial aggregate, so a passage in a third of the documents is one row a task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.session import ship_package

from .common import U64, chain, checkpointed, remove, text_key, written
from .words import grams, texts_of, word_chunks

WINDOW = 50
GRAM = 10

_SEEN = "doc_id long, key long, content binary, n_words long, whole_sha256 string, anchors array<long>"
_PATHS = "anchor long, path long, doc_id long, key long, start long, n int, edges binary"


def _runs(words, window: int, gram: int):
    """Paths of a chunk: (row, first window, windows, minimizer hash, window hashes).

    A path is a run of windows with one minimizer hash, wherever in the window it lies, so a
    run of one word isn't a path a window. It has at most as many windows as keep the first
    and the last one adjoining: these two and the length then fix all of its words."""
    edges = grams(words.hash, window)
    ok = words.spans(window)
    if not ok.any():
        return None
    g = grams(words.hash, gram)
    width = window - gram + 1
    best = np.arange(len(g))
    done = 1
    while done < width:  # position of the least gram in windows of `done`, doubled
        step = min(done, width - done)
        left, right = best[:-step], best[step:]
        best = np.where(g[left] <= g[right], left, right)
        done += step
    at = best[: len(edges)]
    index = np.flatnonzero(ok)
    least = g[at[index]]
    row = words.row[index]
    new = np.ones(len(index), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    begun = np.flatnonzero(new)
    new[(np.arange(len(index)) - np.repeat(begun, np.diff(np.append(begun, len(index))))) % width == 0] = True
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(index)))
    start = index[first]
    return row[first], start, n, least[first], edges


def _scan(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column("text"))
            ids, keys = b.column("doc_id"), b.column("key")
            for w in word_chunks(texts):
                sha, n = [], np.diff(w.at)
                for t in texts.slice(w.first, w.rows).cast(pa.large_binary()):
                    sha.append(hashlib.sha256(b" ".join(t.as_py().split())).digest())
                found = _runs(w, window, gram)
                counts = np.zeros(w.rows, dtype=np.int64)
                anchors = np.zeros(0, dtype=np.int64)
                if found is not None:
                    counts = np.bincount(found[0], minlength=w.rows)
                    anchors = found[3].view(np.int64)
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(w.first, w.rows),
                        keys.slice(w.first, w.rows),
                        pa.array(sha, pa.binary()),
                        pa.array(n, pa.int64()),
                        pa.array([s.hex() for s in sha], pa.string()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(anchors)),
                    ],
                    ["doc_id", "key", "content", "n_words", "whole_sha256", "anchors"],
                )

    return run


def _paths(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column("text"))
            ids, keys, wanted = b.column("doc_id"), b.column("key"), b.column("runs")
            for w in word_chunks(texts):
                found = _runs(w, window, gram)
                if found is None:
                    continue
                row, start, n, anchor, edges = found
                base = np.searchsorted(row, np.arange(w.rows + 1))
                picks = []
                for i in range(w.rows):
                    r = wanted[w.first + i].values
                    if r is not None and len(r):
                        picks.append(np.sort(r.to_numpy(zero_copy_only=False)) + base[i])
                if not picks:
                    continue
                pick = np.concatenate(picks)
                row, start, n, anchor = row[pick], start[pick], n[pick], anchor[pick]
                path = chain(chain(edges[start], edges[start + n - 1]), n.astype(U64))
                raw = edges.astype("<u8").tobytes()
                take = pa.array(row + w.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)),
                        pa.array(path.view(np.int64)),
                        ids.take(take),
                        keys.take(take),
                        pa.array(start - w.at[row], pa.int64()),
                        pa.array(n, pa.int32()),
                        pa.array([raw[8 * s : 8 * (s + k)] for s, k in zip(start, n, strict=True)], pa.binary()),
                    ],
                    ["anchor", "path", "doc_id", "key", "start", "n", "edges"],
                )

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each edge of each path."""
    for b in batches:
        raw = b.column("edges")
        n = np.array([len(x) // 8 for x in raw.to_pylist()])
        path, src = (np.repeat(b.column(c).to_numpy(), n) for c in ("path", "src"))
        off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        edge = np.frombuffer(b"".join(raw.to_pylist()), dtype="<i8")
        yield pa.RecordBatch.from_arrays(
            [pa.array(path), pa.array(src), pa.array(off.astype(np.int32)), pa.array(edge)], ["path", "src", "off", "edge"]
        )


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept")}
            texts = texts_of(b.column("text"))
            for i, spans in enumerate(b.column("spans")):
                words = texts[i].cast(pa.large_binary()).as_py().split()
                hit = np.zeros(len(words) + 1, dtype=np.int64)
                for s in [{"start": 0, "n": len(words) + 1 - window, "offs": None}] if spans.as_py() is None else spans.as_py():
                    if s["offs"] is None:
                        a, e = s["start"], s["start"] + s["n"] - 1 + window
                        hit[a] += 1
                        hit[e] -= 1
                    else:
                        for o in s["offs"]:
                            hit[s["start"] + o] += 1
                            hit[s["start"] + o + window] -= 1
                keep = np.cumsum(hit[:-1]) == 0
                left = [w for w, k in zip(words, keep, strict=True) if k]
                cols["doc_id"].append(b.column("doc_id")[i].as_py())
                cols["n_words"].append(len(words))
                cols["n_removed"].append(len(words) - len(left))
                cols["kept"].append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(cols[k], pa.int64()) for k in ("doc_id", "n_words", "n_removed")), pa.array(cols["kept"], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(seen, spans) of ``docs (doc_id, text)``; other columns are ignored.

    ``seen`` has a row for each input row: doc_id, key (hash of the text), n_words,
    whole_sha256 and ``copy`` (its word sequence also belongs to a smaller id).
    ``spans`` has, for the other rows with repeated spans, doc_id, key and the list of
    (start word, number of windows, offsets of the repeated ones or null for all).

    A null text has no words. A null doc_id has no order: such a row is neither a
    source nor shortened. Rows that repeat an id aren't sources for each other."""
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "key", text_key()
    )
    seen, seen_at = written(base.mapInArrow(_scan(window, gram), _SEEN), "seen")
    # Tables joined on a key that may be hot are written first: a join of two plain sides is one that AQE can split.
    least = seen.where("doc_id is not null and n_words > 0").groupBy("content").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    least, least_at = written(least.where("least < most").select("content", "least"), "copied")
    seen = seen.join(least, "content", "left").withColumn("copy", F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)))
    narrow = checkpointed(seen.select("doc_id", "key", "n_words", "whole_sha256", "copy"))
    sources = seen.where("not copy and doc_id is not null and size(anchors) > 0")
    binned = sources.select("doc_id", "key", F.posexplode("anchors").alias("run", "anchor"))
    shared = binned.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    shared, shared_at = written(shared, "shared")
    runs = binned.join(shared, "anchor").groupBy("doc_id", "key").agg(F.collect_set("run").alias("runs"))
    paths, paths_at = written(
        base.join(runs, ["doc_id", "key"]).select("doc_id", "key", "text", "runs").mapInArrow(_paths(window, gram), _PATHS),
        "paths",
    )
    distinct = paths.groupBy("anchor", "path").agg(F.min("doc_id").alias("src"), F.first("edges").alias("edges"))
    distinct, distinct_at = written(distinct, "compacted")
    branches = distinct.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", F.lit(True).alias("branched"))
    branches, branches_at = written(branches, "branches")
    edges = (
        distinct.join(branches, "anchor").select("path", "src", "edges")
        .mapInArrow(_edges, "path long, src long, off int, edge long")
    )
    firsts, firsts_at = written(edges.groupBy("edge").agg(F.min("src").alias("first")), "firsts")
    offsets = (
        edges.join(firsts, "edge").groupBy("path")
        .agg(F.sort_array(F.collect_list(F.struct("off", "first"))).alias("firsts"))
    )
    marked = distinct.select("anchor", "path", "src").join(branches, "anchor", "left")
    where = marked.select("path", "src", F.coalesce("branched", F.lit(False)).alias("branched")).join(offsets, "path", "left")
    where, where_at = written(where, "least")
    hits = (
        paths.select("path", "doc_id", "key", "start", "n").join(where, "path")
        .withColumn("offs", F.when(F.col("branched"), F.expr("transform(filter(firsts, x -> x.first < doc_id), x -> x.off)")))
        .where("(not branched and src < doc_id) or size(offs) > 0")
    )
    spans = checkpointed(
        hits.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "n", "offs")).alias("spans"))
    )
    remove(spark, seen_at, least_at, shared_at, paths_at, distinct_at, branches_at, firsts_at, where_at)
    return narrow, spans


def _shortened(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "key", text_key()
    )
    marks = spans.select(F.struct("doc_id", "key").alias("mark"), "spans")
    return (
        base.join(marks, F.struct("doc_id", "key").eqNullSafe(F.col("mark"))).select("doc_id", "text", "spans")
        .mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string")
    )


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) with the kept words joined by one space.

    A row for each input row (repeated rows included); an empty table gives none."""
    narrow, spans = repeated_spans(docs, window, gram)
    nothing = F.lit(None).cast(spans.schema["spans"].dataType)
    long_copy = F.col("copy") & (F.col("n_words") >= window)
    rest = (
        narrow.join(spans.select("doc_id", "key"), ["doc_id", "key"], "left_anti")
        .groupBy("doc_id", "key").agg(F.first(long_copy).alias("all"))
    )
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).alias("n"), F.lit(None).cast("array<int>").alias("offs")))
    # A whole copy is marked by null spans.
    marks = spans.unionByName(
        rest.select("doc_id", "key", F.when(F.col("all"), nothing).otherwise(F.slice(whole, 1, 0)).alias("spans"))
    )
    return _shortened(docs, marks, window)


def substring_digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """As ``dedup_substrings``, with the SHA-256 of the kept text in its place. Texts
    that keep all or none of their words aren't read again."""
    narrow, spans = repeated_spans(docs, window, gram)
    untouched = narrow.join(spans.select("doc_id", "key"), ["doc_id", "key"], "left_anti")
    gone = F.col("copy") & (F.col("n_words") >= window)
    plain = untouched.select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("whole_sha256")).alias("kept_sha256"),
    )
    cut = _shortened(docs, spans, window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return plain.unionByName(cut)
