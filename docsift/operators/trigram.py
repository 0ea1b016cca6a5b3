"""F3 by a trigram index: substring search that reads the texts of candidates only.

Build: documents are sorted by id over partitions and numbered in that order; a run of
``CHUNK`` numbers is a chunk. A task collects, for each chunk, which documents hold each
trigram of the folded text (three code points as one long), and emits one row for each
(trigram, chunk) with the documents delta-coded in variable-length bytes. So the shuffle
carries about a byte for each (document, trigram), and a frequent trigram is many rows of
at most ``CHUNK`` entries, which any number of files can hold; so is a trigram of long texts, as a
task holds ``MOST_ENTRIES`` at a time. Postings lie in folders by a
hash of the trigram; texts in folders by ``BLOCK`` numbers.

Search: the literal pieces of a pattern (between its wildcards) of three or more
characters give trigrams. Their postings alone are read, intersected chunk by chunk, and
only the folders with a candidate are read for texts, on which the exact LIKE decides. A
pattern without such a piece scans all texts. Results equal the plain search's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.text import LOWER, UPPER, ascii_lower_py, like_contains
from docsift.schema import TEXT_SCORE, check_k
from docsift.session import materialised, ship_package

CHUNK = 4096
BLOCK = 16 * CHUNK
BUCKETS = 64
# A pattern of more trigrams is looked up by this many, spread evenly: fewer postings are
# read, and the exact test decides all the same.
MOST_GRAMS = 64
# Entries (document, trigram) that a task holds at once.
MOST_ENTRIES = 1 << 20
POSTINGS = "gram long, chunk long, n int, deltas binary"

_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]


def trigrams(text: str) -> np.ndarray:
    """Distinct trigrams of the folded text, sorted."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if len(c) < 3:
        return np.zeros(0, dtype=np.int64)
    c = np.where(c < 128, _FOLD[np.minimum(c, 127)], c).astype(np.int64)
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])


def pattern_trigrams(query: str) -> np.ndarray:
    """Trigrams that every text matching LIKE '%query%' holds."""
    pieces = [trigrams(p) for p in re.split("[%_]", ascii_lower_py(query))]
    grams = np.unique(np.concatenate(pieces))
    if len(grams) > MOST_GRAMS:
        grams = grams[np.linspace(0, len(grams) - 1, MOST_GRAMS).astype(int)]
    return grams


def encode(sorted_numbers: np.ndarray) -> bytes:
    """Delta code: differences to the number before (the first to -1), less 1, seven bits a
    byte, the high bit set on all but a number's last byte."""
    d = np.diff(sorted_numbers, prepend=-1) - 1
    length = 1 + (d >= 1 << 7) + (d >= 1 << 14)
    at = np.cumsum(length) - length
    out = np.empty(int(length.sum()), dtype=np.uint8)
    for k in range(3):
        some = length > k
        last = length[some] == k + 1
        out[at[some] + k] = ((d[some] >> 7 * k) & 0x7F) | np.where(last, 0, 0x80)
    return out.tobytes()


def decode(code: bytes) -> np.ndarray:
    b = np.frombuffer(code, dtype=np.uint8).astype(np.int64)
    ends = np.flatnonzero(b < 0x80)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.cumsum(np.add.reduceat((b & 0x7F) << 7 * place, starts) + 1) - 1 if len(b) else b


def _postings(size: int):
    """Rows of ``POSTINGS`` from rows (num, text) sorted by num, in chunks of ``size`` numbers; a chunk of
    long texts is written in parts, each with a row a trigram."""

    def run(batches):
        chunk, grams, members, entries = None, [], [], 0
        for b in batches:
            for num, text in zip(b.column("num").to_pylist(), b.column("text"), strict=True):
                if grams and (num // size != chunk or entries >= MOST_ENTRIES):
                    yield _chunk_rows(chunk, grams, members)
                    grams, members, entries = [], [], 0
                chunk = num // size
                g = trigrams(text.as_py())
                if len(g):
                    grams.append(g)
                    members.append(np.full(len(g), num % size, dtype=np.int32))
                    entries += len(g)
        if grams:
            yield _chunk_rows(chunk, grams, members)

    return run


def _chunk_rows(chunk: int, grams: list[np.ndarray], members: list[np.ndarray]) -> pa.RecordBatch:
    gram, member = np.concatenate(grams), np.concatenate(members)
    order = np.argsort(gram, kind="stable")  # members of a trigram stay in order
    gram, member = gram[order], member[order]
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    cut = np.r_[first, len(gram)]
    codes = [encode(member[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(gram[first]), pa.array(np.full(len(first), chunk)), pa.array(np.diff(cut).astype(np.int32)), pa.array(codes, pa.binary())],
        ["gram", "chunk", "n", "deltas"],
    )


def _intersect(wanted: int, size: int):
    """Numbers of a chunk's documents that are in the postings of all ``wanted`` trigrams."""

    def run(table: pa.Table) -> pa.Table:
        count = np.zeros(size, dtype=np.int32)
        for code in table.column("deltas"):
            count[decode(code.as_py())] += 1
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"num": pa.array(chunk * size + np.flatnonzero(count == wanted))})

    return run


@dataclass
class TrigramIndex:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    chunk: int = CHUNK
    block: int = BLOCK

    @staticmethod
    def build(docs: DataFrame, path: str, buckets: int = BUCKETS, chunk: int = CHUNK, block: int = BLOCK) -> TrigramIndex:
        """Index ``docs [id, text, metadata]`` (unique ids) in the folder ``path``; ``chunk``
        and ``block`` are powers of two."""
        spark = docs.sparkSession
        ship_package(spark)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = docs.select("id", "text", "metadata").repartitionByRange(parts, "id").sortWithinPartitions("id")
        # Numbers rise with the partition and the row, so with the id; a chunk lies in one partition.
        numbered = placed.withColumn("num", F.monotonically_increasing_id())
        numbered.withColumn("block", F.shiftright("num", block.bit_length() - 1)).write.partitionBy("block").parquet(f"{path}/texts")
        index = TrigramIndex(spark, path, buckets, chunk, block)
        # Read back by whole chunks: numbers were given when the texts were written.
        texts = index.texts().select("num", "text").withColumn("chunk", F.shiftright("num", chunk.bit_length() - 1))
        sorted_texts = texts.repartition("chunk").sortWithinPartitions("num").select("num", "text")
        postings = sorted_texts.mapInArrow(_postings(chunk), POSTINGS).withColumn("bucket", index._bucket())
        postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram", "chunk").write.partitionBy("bucket").parquet(f"{path}/postings")
        return index

    def _bucket(self):
        return F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int")

    def texts(self) -> DataFrame:
        return self.spark.read.schema("id string, text string, metadata map<string,string>, num long, block long").parquet(f"{self.path}/texts")

    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS + ", bucket int").parquet(f"{self.path}/postings")

    def candidates(self, query: str) -> DataFrame | None:
        """[num] of the documents that hold every trigram of the pattern; None if it has none."""
        grams = [int(g) for g in pattern_trigrams(query)]
        if not grams:
            return None
        keys = self.spark.createDataFrame([(g,) for g in grams], "gram long")
        buckets = [r["b"] for r in keys.select(self._bucket().alias("b")).distinct().collect()]
        found = self.postings().filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
        # A chunk has few rows a trigram, of at most ``chunk`` documents in all, each in one of them.
        return found.select("chunk", "deltas").groupBy("chunk").applyInArrow(_intersect(len(grams), self.chunk), "num long")

    def matches(self, query: str) -> DataFrame:
        """[id, text, metadata] of every document whose text contains ``query``, as LIKE has it."""
        test = like_contains("text", query)
        found = self.candidates(query)
        if found is None:
            return self.texts().filter(test).select("id", "text", "metadata")
        found = materialised(found)
        blocks = [r["block"] for r in found.select(F.shiftright("num", self.block.bit_length() - 1).alias("block")).distinct().collect()]
        texts = self.texts().filter(F.col("block").isin(blocks))
        return texts.join(found, "num", "left_semi").filter(test).select("id", "text", "metadata")

    def search(self, query: str, k: int = 10, threshold: float = 0.0) -> DataFrame:
        """F3 + T3 + P6 + F5 as ``text_search``: the first k matches in id order, score 1.0."""
        hits = self.matches(query).orderBy("id").limit(check_k(k)).withColumn("score", F.lit(TEXT_SCORE))
        if threshold > TEXT_SCORE:
            hits = hits.filter(F.lit(False))
        return hits.select("id", "text", "score", "metadata")
