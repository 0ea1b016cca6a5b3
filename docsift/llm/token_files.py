"""Operator 6: token ids in static range-ANS files.

A token file set is a folder of three Parquet tables (so that any store Spark reads can
hold it, and writes commit as a whole):

``format``  one row: version, scale_bits, lanes, checkpoint_steps, end_id, n_docs, n_tokens
``model``   id, freq: the frequency table that all blocks share; freqs sum to 2^scale_bits
``blocks``  shard, block, first_token, n_tokens, doc_ids, lengths, state, words, checkpoints
            (first step, first word, states), crc32

A block holds whole documents, in ascending (doc_id, hash of text) or a given order, until it
has ``block_tokens`` ids or more; blocks follow each other by (shard, block). Its ids are dealt
to ``lanes`` coders in turn: id number s * lanes + l belongs to step s of lane l. A coder
is a range asymmetric numeral system with a 64-bit state of at least 2^31, which gives up
32 bits when it would overflow. All lanes share one stream of words, in decoding order:
step by step, and in a step by lane. Every ``checkpoint_steps`` steps the states and the
place in the stream are stored, so a decoder may begin there; a full read decodes all
checkpoints of a block side by side. crc32 is that of the block's ids.

Writing takes one shuffle of the texts (by range of doc_id), one scratch table of ids, from
which the frequencies are counted, and one pass that encodes it. Only the frequencies (a row
an id of the vocabulary) and a count for each shard reach the driver."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.session import ship_package

from .bpe import Encoder
from .common import U64, remove, text_key, written

SCALE_BITS, LANES, CHECKPOINT_STEPS, BLOCK_TOKENS = 18, 2048, 128, 1 << 19
LOW = U64(1) << U64(31)
VERSION = 1

_IDS = "shard int, block int, before long, n_tokens long, doc_ids array<long>, lengths array<long>, ids binary"
_BLOCKS = (
    "shard int, block int, first_token long, n_tokens long, doc_ids array<long>, lengths array<long>, state binary, words binary, "
    "checkpoints array<struct<step: long, word: long, states: binary>>, crc32 long"
)


def normalise(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies in proportion to ``counts`` that sum to 2^bits, at least 1 where a count is."""
    some = np.flatnonzero(counts)
    if len(some) > 1 << bits:
        raise ValueError("more ids than slots: raise scale_bits")
    out = np.zeros(len(counts), dtype=np.int64)
    if not len(some):
        return out
    exact = counts[some] / counts[some].sum() * (1 << bits)
    freq = np.maximum(1, np.floor(exact)).astype(np.int64)
    left = (1 << bits) - freq.sum()
    order = np.argsort(-exact, kind="stable")
    if left >= 0:
        freq[order[0]] += left
    for i in order if left < 0 else ():
        take = min(freq[i] - 1, -left)
        freq[i] -= take
        left += take
        if not left:
            break
    out[some] = freq
    return out


def rans_encode(ids: np.ndarray, freq: np.ndarray, bits: int, lanes: int, every: int):
    """(final states, words, checkpoints) of one block."""
    first = np.cumsum(freq) - freq
    steps = -(-len(ids) // lanes)
    padded = np.full(steps * lanes, -1, dtype=np.int64)
    padded[: len(ids)] = ids
    grid = padded.reshape(steps, lanes)
    state = np.full(lanes, LOW, dtype=U64)
    pieces, points = [], []
    shift, bound = U64(bits), U64(63 - bits)
    f_all, c_all = freq.astype(U64), first.astype(U64)
    for s in range(steps - 1, -1, -1):
        k = lanes if s < steps - 1 or len(ids) % lanes == 0 else len(ids) % lanes  # the last step may be short
        x, sym = state[:k], grid[s, :k]
        f = f_all[sym]
        over = x >= f << bound
        out = x[over]
        pieces.append((out & U64(0xFFFFFFFF)).astype("<u4"))
        x[over] = out >> U64(32)
        q = x // f
        state[:k] = (q << shift) + (x - q * f) + c_all[sym]
        if s and s % every == 0:
            points.append((s, state.copy()))
    pieces.reverse()
    at = np.append(0, np.cumsum([len(p) for p in pieces]))
    words = np.concatenate(pieces) if pieces else np.zeros(0, dtype="<u4")
    checkpoints = [{"step": int(s), "word": int(at[s]), "states": x.astype("<u8").tobytes()} for s, x in reversed(points)]
    return state.astype("<u8").tobytes(), words.tobytes(), checkpoints


class Decoder:
    def __init__(self, freq: np.ndarray, bits: int, lanes: int, every: int):
        self.bits, self.lanes, self.every = bits, lanes, every
        self.freq, self.first = freq.astype(U64), (np.cumsum(freq) - freq).astype(U64)
        self.symbol = np.repeat(np.arange(len(freq)), freq)

    def block(self, n: int, state: bytes, words: bytes, checkpoints: list[dict]) -> np.ndarray:
        """All ids of a block: the segments between checkpoints side by side."""
        steps = -(-n // self.lanes)
        if not steps:
            return np.zeros(0, dtype=np.uint32)
        begin = [0, *(c["step"] for c in checkpoints)]
        word = np.array([0, *(c["word"] for c in checkpoints)])
        states = np.frombuffer(b"".join([state, *(c["states"] for c in checkpoints)]), dtype="<u8").reshape(-1, self.lanes).copy()
        stream = np.append(np.frombuffer(words, dtype="<u4"), np.uint32(0)).astype(U64)
        lengths = np.diff([*begin, steps])
        out = np.zeros((len(begin), self.every if len(begin) > 1 else steps, self.lanes), dtype=np.uint32)
        mask, shift = U64((1 << self.bits) - 1), U64(self.bits)
        short = n % self.lanes
        for t in range(int(lengths.max())):
            live = np.flatnonzero(lengths > t)
            x = states[live]
            slot = x & mask
            sym = self.symbol[slot]
            x = self.freq[sym] * (x >> shift) + slot - self.first[sym]
            need = x < LOW
            if short and live[-1] == len(begin) - 1 and t == lengths[-1] - 1:  # the last step of the block
                need[-1, short:] = False
            flat = x.ravel()
            wanted = np.flatnonzero(need.ravel())
            segment = wanted // self.lanes
            want = np.bincount(segment, minlength=len(live))
            at = (word[live] - (np.cumsum(want) - want))[segment] + np.arange(len(wanted))
            flat[wanted] = (flat[wanted] << U64(32)) | stream[at]
            word[live] += want
            states[live] = flat.reshape(x.shape)
            out[live, t] = sym
        return np.concatenate([out[i, :k].ravel() for i, k in enumerate(lengths)])[:n]


def _tokenise(path: str, end_id: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder.of(path), TaskContext.get().partitionId()
        block = before = held = 0
        doc_ids, lengths, parts = [], [], []

        def row():
            nonlocal block, before, held, doc_ids, lengths, parts
            ids = np.concatenate(parts)
            out = pa.RecordBatch.from_pylist(
                [{"shard": shard, "block": block, "before": before, "n_tokens": held, "doc_ids": doc_ids, "lengths": lengths,
                  "ids": ids.astype(encoder.dtype).tobytes()}], _IDS_ARROW)
            block, before, held = block + 1, before + held, 0
            doc_ids, lengths, parts = [], [], []
            return out

        for b in batches:
            for first, ids, size in encoder.ids(b.column("text")):
                begin = np.cumsum(size) - size
                whole = np.full(len(ids) + len(size), end_id, dtype=encoder.dtype)
                whole[np.arange(len(ids)) + np.repeat(np.arange(len(size)), size)] = ids
                begin, size = begin + np.arange(len(size)), size + 1
                names = b.column("doc_id").slice(first, len(size)).to_pylist()
                a, sums = 0, np.cumsum(size)
                while a < len(size):
                    want = block_tokens - held + (sums[a - 1] if a else 0)
                    e = min(len(size), int(np.searchsorted(sums, want)) + 1)  # up to the document that fills the block
                    doc_ids += names[a:e]
                    lengths += size[a:e].tolist()
                    parts.append(whole[begin[a] : begin[e - 1] + size[e - 1]])
                    held += len(parts[-1])
                    a = e
                    if held >= block_tokens:
                        yield row()
        if held:
            yield row()

    return run


_IDS_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())])


def _count(dtype: str, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocabulary, dtype=np.int64)
        for b in batches:
            for raw in b.column("ids"):
                n += np.bincount(np.frombuffer(raw.as_buffer(), dtype=dtype), minlength=vocabulary)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["id", "n"])

    return run


def _encode(freq: np.ndarray, dtype: str, starts: dict[int, int], bits: int, lanes: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], dtype=dtype).astype(np.int64)
                state, words, points = rans_encode(ids, freq, bits, lanes, every)
                yield pa.RecordBatch.from_pylist(
                    [{"shard": r["shard"], "block": r["block"], "first_token": starts[r["shard"]] + r["before"], "n_tokens": len(ids),
                      "doc_ids": r["doc_ids"], "lengths": r["lengths"], "state": state, "words": words, "checkpoints": points,
                      "crc32": zlib.crc32(ids.astype("<u4").tobytes())}], _BLOCKS_ARROW)

    return run


_BLOCKS_ARROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("state", pa.binary()), ("words", pa.binary()),
    ("checkpoints", pa.list_(pa.struct([("step", pa.int64()), ("word", pa.int64()), ("states", pa.binary())]))), ("crc32", pa.int64()),
])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, scale_bits: int = SCALE_BITS, lanes: int = LANES,
                 checkpoint_steps: int = CHECKPOINT_STEPS, block_tokens: int = BLOCK_TOKENS, order: str | None = None) -> None:
    """Write the ids of ``docs (doc_id, text)``, each text followed by ``end_id``, to ``path``;
    documents go by the column ``order``, if one is named, and by (doc_id, hash of text).

    ``tokenizer`` is a file of the tokenizers library that every executor has. A null
    text is empty, and an empty text is ``end_id`` alone. A null id comes first; rows that
    repeat an id are ordered by a hash of their text. An empty table writes no blocks."""
    spark = docs.sparkSession
    ship_package(spark)
    encoder = Encoder.of(tokenizer)
    dtype = np.dtype(encoder.dtype).newbyteorder("<").str
    vocabulary = max(encoder.lib.get_vocab_size(), end_id + 1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = [F.col(order).alias("_order")] if order else []
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *given).withColumn("tkey", text_key())
    by = [*(["_order"] if order else []), "doc_id", "tkey"]
    ranged = base.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("doc_id", "text", "tkey")
    ids, ids_at = written(ranged.mapInArrow(_tokenise(tokenizer, end_id, block_tokens), _IDS), "ids")
    counted = ids.select("ids").mapInArrow(_count(dtype, vocabulary), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocabulary, dtype=np.int64)  # at most a row an id
    counts[counted["id"]] = counted["n"]
    freq = normalise(counts, scale_bits)
    per_shard = ids.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.sum(F.size("doc_ids")).alias("docs")).orderBy("shard").collect()
    starts, total = {}, 0  # a number for each of the ``parts`` shards
    for r in per_shard:
        starts[r["shard"]] = total
        total += r["n"]
    ids.mapInArrow(_encode(freq, dtype, starts, scale_bits, lanes, checkpoint_steps), _BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    some = np.flatnonzero(freq)
    spark.createDataFrame([(int(i), int(freq[i])) for i in some], "id long, freq long").coalesce(1).write.parquet(f"{path}/model")
    head = (VERSION, scale_bits, lanes, checkpoint_steps, end_id, sum(r["docs"] for r in per_shard), total)
    spark.createDataFrame([head], _FORMAT).coalesce(1).write.parquet(f"{path}/format")
    remove(spark, ids_at)


_FORMAT = "version int, scale_bits int, lanes int, checkpoint_steps int, end_id int, n_docs long, n_tokens long"


def _decode(freq: np.ndarray, bits: int, lanes: int, every: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(freq, bits, lanes, every)
        for b in batches:
            for r in b.to_pylist():
                ids = decoder.block(r["n_tokens"], r["state"], r["words"], r["checkpoints"]).astype("<u4")
                raw = memoryview(ids.tobytes())
                if zlib.crc32(raw) != r["crc32"]:
                    raise ValueError(f"block {r['shard']}/{r['block']} is damaged")
                size = np.array(r["lengths"])
                begin = np.cumsum(size) - size
                columns = [
                    pa.array(r["doc_ids"], pa.int64()),
                    pa.array(begin + r["first_token"]),
                    pa.array(size),
                    pa.array([zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin, size, strict=True)], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of the files at ``path``: doc_id, start (ids before it), n_tokens,
    ids_crc32 and, unless left out, ids. A block whose checksum differs raises."""
    ship_package(spark)
    head = spark.read.schema(_FORMAT).parquet(f"{path}/format").first()
    if head["version"] != VERSION:
        raise ValueError(f"unknown version {head['version']}")
    model = spark.read.schema("id long, freq long").parquet(f"{path}/model").toPandas()  # at most a row an id
    freq = np.zeros(int(model["id"].max()) + 1 if len(model) else 0, dtype=np.int64)
    freq[model["id"]] = model["freq"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    return blocks.mapInArrow(_decode(freq, head["scale_bits"], head["lanes"], head["checkpoint_steps"], with_ids), schema)
