"""Operator 2: quality rules by a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into ``buckets``. Two multinomials over the buckets
are counted: one over the whole corpus, one over trusted documents. A bucket's weight
is the difference of its smoothed log probabilities; a document's score is the sum of
its n-grams' weights divided by their number. Documents under the threshold go: it is
the ``tail`` quantile of the scores of trusted documents held out of the target counts
(half of them, by a hash of the id), read from a histogram of all their scores. Every
document is judged by the same comparison; nothing is drawn at random.

Weights are integers (millionths), so sums don't depend on the order of rows. What
reaches the driver is bounded by parameters: one row a bucket, one a histogram bin.

The base rules stand before it: fewer than ``MIN_WORDS`` words, or more than
``MAX_REPEAT`` percent of the words in repeated runs of ``RUN`` words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.session import ship_package

from .common import U64, checkpointed, matching, mix, text_key
from .words import SPACE, grams, hash_spans, texts_of, word_chunks

BITS = 16
TAIL = 0.002
SCALE = 1_000_000
BIN = 1_000  # width of a histogram bin, in millionths
MIN_WORDS, MAX_REPEAT, RUN = 20, 30, 8
# An id takes 8 bytes; up to this many trusted ids are sent to all executors.
BROADCAST_IDS = 1_000_000

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _buckets(words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and word pair."""
    shift = U64(64 - bits)
    two = words.spans(2)
    pairs = grams(words.hash, 2)[two]
    rows = np.concatenate([words.row, words.row[: len(two)][two]])
    return rows, np.concatenate([words.hash >> shift, pairs >> shift]).astype(np.int64)


def _count(bits: int):
    """(bucket, n, n in trusted rows) of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, good = np.zeros(1 << bits, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)
        for b in batches:
            trusted = b.column("trusted").to_numpy(zero_copy_only=False)
            for w in word_chunks(texts_of(b.column("text"))):
                rows, bucket = _buckets(w, bits)
                n += np.bincount(bucket, minlength=1 << bits)
                good += np.bincount(bucket[trusted[w.first + rows]], minlength=1 << bits)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(good[some])], ["bucket", "n", "good"])

    return run


def _repeated(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True for each item that has an equal one in its row."""
    key = mix(h + mix(row.astype(U64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _first(row: np.ndarray, h: np.ndarray) -> int:
    return np.unique(mix(h + mix(row.astype(U64))), return_index=True)[1]


def _measure(weights: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in word_chunks(texts_of(b.column("text"))):
                per_row = lambda rows, n=w.rows: np.bincount(rows, minlength=n)
                byte_row = np.repeat(np.arange(w.rows), np.diff(w.offsets))
                starts_char = (w.data & 0xC0) != 0x80
                line_end = w.data == 0x0A
                edges = np.zeros(len(w.data) + 1, dtype=bool)
                edges[w.offsets] = True
                edges[1:] |= line_end
                lines = np.flatnonzero(edges)
                begin, end = lines[:-1], lines[1:] - line_end[lines[1:] - 1] if len(lines) > 1 else lines[:0]
                wordy = np.add.reduceat(~SPACE[w.data], begin) > 0 if len(begin) else np.zeros(0, dtype=bool)
                begin, end = begin[wordy], end[wordy]
                line_row = byte_row[begin]
                unique = _first(line_row, hash_spans(w.data, begin, end))
                ok = w.spans(RUN)
                at = np.flatnonzero(ok)
                cover = np.zeros(len(w.row) + 1, dtype=np.int64)
                twice = at[_repeated(w.row[at], grams(w.hash, RUN)[at])]
                np.add.at(cover, twice, 1)
                np.add.at(cover, twice + RUN, -1)
                rows, bucket = _buckets(w, bits)
                total = np.zeros(w.rows, dtype=np.int64)
                np.add.at(total, rows, weights[bucket])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(w.first, w.rows),
                        *(
                            pa.array(x.astype(np.int64))
                            for x in (
                                np.diff(w.at),
                                per_row(byte_row[starts_char & ~SPACE[w.data]]),
                                per_row(byte_row[_SYMBOL[w.data]]),
                                per_row(line_row) - per_row(line_row[unique]),
                                per_row(w.row[np.cumsum(cover[:-1]) > 0]),
                                total,
                                per_row(rows),
                            )
                        ),
                        b.column("tkey").slice(w.first, w.rows),
                    ],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "total", "n_grams", "tkey"],
                )

    return run


_MEASURES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "total long, n_grams long, tkey long"
)


def ratio_weights(docs: DataFrame, trusted: DataFrame, bits: int = BITS) -> np.ndarray:
    """Integer weight of each bucket, from all ``docs (doc_id, text)`` and the part whose
    id is in ``trusted (doc_id)``. Without trusted documents all weights are 0."""
    flag = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    flag = checkpointed(flag)
    side = F.broadcast(flag) if flag.count() <= BROADCAST_IDS else flag
    marked = docs.select("doc_id", "text").join(side, "doc_id", "left")
    counts = (
        marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
        .mapInArrow(_count(bits), "bucket long, n long, good long")
        .groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    ).toPandas()  # at most 2 ** bits rows
    raw, good = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[counts["bucket"]], good[counts["bucket"]] = counts["n"], counts["good"]
    if not good.sum():
        return np.zeros(1 << bits, dtype=np.int64)
    ratio = np.log((good + 1) / (good.sum() + len(good))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    return np.rint(ratio * SCALE).astype(np.int64)


def tail_threshold(scores: DataFrame, tail: float) -> int | None:
    """The largest bin edge under which at most ``tail`` of ``scores (score)`` lie."""
    bins = (
        scores.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin")
    ).toPandas()  # scores are means of bounded weights: under 10 ** 5 bins
    if bins.empty:
        return None
    under = bins["n"].cumsum() - bins["n"]
    return int(bins["bin"][under <= tail * bins["n"].sum()].max()) * BIN


def quality(docs: DataFrame, labels: DataFrame, bits: int = BITS, tail: float = TAIL) -> DataFrame:
    """One row for each row of ``docs (doc_id, text)``: doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score and tkey (hash of
    the text). Trusted are ``labels (doc_id, quality, toxic)`` of quality 1 not marked
    toxic.

    A null or empty text has no words and fails the base rules. A null doc_id is never
    trusted; the row is judged all the same. Repeated rows and labels change nothing but
    the corpus counts. Without held-out trusted documents only the base rules reject."""
    ship_package(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    weights = ratio_weights(base, trusted.where(fold == 0), bits)
    measures = checkpointed(
        base.withColumn("tkey", text_key()).mapInArrow(_measure(weights, bits), _MEASURES)
    ).withColumn("score", F.when(F.col("n_grams") > 0, F.floor(F.col("total") / F.col("n_grams"))).otherwise(F.lit(0)))
    threshold = tail_threshold(measures.where("n_grams > 0").join(trusted.where(fold == 1), "doc_id"), tail)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    good = F.lit(True) if threshold is None else F.col("score") >= threshold
    return measures.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & good).alias("kept"), (F.col("score") / SCALE).alias("score"), "tkey",
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that ``quality`` rejects, columns unchanged."""
    kept = quality(docs, labels, **options).where("kept").select("doc_id", "tkey").distinct()
    return matching(docs, kept, "left_semi")
