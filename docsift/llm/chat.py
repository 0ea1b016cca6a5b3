"""Operator 7: chat formatting at token level.

A turn is ``start role sep text end``, where start, sep and end are reserved ids, the first
three after the tokenizer's own. Role and text are encoded on their own, so no token crosses
a mark and no content can make one. The marks' strings inside contents are escaped besides:
``<|im_end|>`` becomes ``<\\|im_end|>``, and one more backslash is put into those that have
some already, which ``unescape`` takes out again. So the rendered text can be split safely too.

Positions come from prefix sums of the segments' lengths, and the loss mask, over the texts of
assistant turns, is the running sum of +1 where such a text begins and -1 where it ends.

Turns are dealt by range of (conv_id, turn, role, text) and sorted, so one conversation, or all
rows without conv_id, lies over as many tasks as its rows fill. A task counts turns and tokens
from its own first row on; what earlier partitions hold of a conversation is added afterwards.
Nothing is held whole. Only ``conversation_digests`` goes by conversation, as a SHA-256 is
sequential: a very long one costs time in one task there, but no memory."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.session import ship_package

from .bpe import Encoder
from .common import remove, written
from .words import texts_of

# The marks, in the order of their reserved ids (fixed values).
MARKS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
_MARKED = re.compile(r"<(\\*)\|(im_start|im_sep|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_sep|im_end)\|>")
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _MARKED.sub(r"<\\\1|\2|>", text) if "|im_" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text) if "|im_" in text else text


# Characters of roles and texts that ranges are cut by (a row's whole text isn't sampled).
RANGE_CHARS = 32


def _parts(df: DataFrame) -> int:
    ship_package(df.sparkSession)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


_OUT = "conv_id long, turn_index long, first_token long, ids array<int>, loss_mask array<byte>"


def _flat(encoder: Encoder, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ids, sizes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for _, i, n in encoder.ids(pa.array(texts, pa.large_string())):
        ids.append(i.astype(np.int64))
        sizes.append(n)
    return np.concatenate(ids), np.concatenate(sizes)


def _assemble(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        mark = encoder.lib.get_vocab_size() + np.arange(3)
        last, turn, token = object(), 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            roles = texts_of(b.column("role")).to_pylist()
            texts = texts_of(b.column("text")).to_pylist()
            role_ids, role_n = _flat(encoder, [escape(r) for r in roles])
            text_ids, text_n = _flat(encoder, [escape(t) for t in texts])
            size = role_n + text_n + 3
            end = np.cumsum(size)
            begin = end - size
            ids = np.empty(end[-1], dtype=np.int64)
            ids[begin], ids[begin + 1 + role_n], ids[end - 1] = mark
            within = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids[np.repeat(begin + 1, role_n) + within(role_n)] = role_ids
            ids[np.repeat(begin + 2 + role_n, text_n) + within(text_n)] = text_ids
            loss = np.array([r == LOSS_ROLE for r in roles])
            step = np.zeros(len(ids) + 1, dtype=np.int8)
            np.add.at(step, (begin + 2 + role_n)[loss], 1)
            np.add.at(step, (end - 1)[loss], -1)
            mask = np.cumsum(step[:-1], dtype=np.int8)
            conv = b.column("conv_id").to_pylist()
            turns, firsts = [], []
            for c, n in zip(conv, size.tolist(), strict=True):
                if c != last:
                    last, turn, token = c, 0, 0
                turns.append(turn)
                firsts.append(token)
                turn, token = turn + 1, token + n
            offsets = pa.array(np.append(0, end).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("conv_id"),
                    pa.array(turns, pa.int64()),
                    pa.array(firsts, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(mask)),
                ],
                ["conv_id", "turn_index", "first_token", "ids", "loss_mask"],
            )

    return run


def _carried(placed: DataFrame) -> DataFrame:
    """``placed`` with the turns and tokens that earlier partitions hold of each conversation
    added to its positions. Only the first conversation of a partition can have begun in
    another, so what is joined is a row a partition at most, and broadcast."""
    held = placed.groupBy("conv_id", "part").agg(F.count("*").alias("turns"), F.sum(F.size("ids")).alias("tokens"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("part", F.col("conv_id").alias("conv"), F.sum("turns").over(before).alias("turns"), F.sum("tokens").over(before).alias("tokens"))
    earlier = F.broadcast(held.where("turns is not null").withColumnRenamed("part", "at"))
    mine = (F.col("part") == F.col("at")) & F.col("conv_id").eqNullSafe(F.col("conv"))
    more = lambda own, add: (F.col(own) + F.coalesce(add, F.lit(0))).alias(own)
    return placed.join(earlier, mine, "left").select("conv_id", more("turn_index", "turns"), more("first_token", "tokens"), "ids", "loss_mask")


def _placed(turns: DataFrame, tokenizer: str) -> tuple[DataFrame, str]:
    """The formatted turns by partition, as a written table, and its path. Ranges are cut from
    a sample, and positions hold for one cut only."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *said)
    ranges = ["conv_id", "turn", *(F.substring(c, 1, RANGE_CHARS) for c in ("role", "text"))]
    dealt = base.repartitionByRange(_parts(turns), *ranges).sortWithinPartitions("conv_id", "turn", "role", "text")
    assembled = dealt.select("conv_id", "role", "text").mapInArrow(_assemble(tokenizer), _OUT)
    return written(assembled.withColumn("part", F.spark_partition_id()), "placed-turns")


def format_conversations(turns: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each row of ``turns (conv_id, turn, role, text)``: conv_id, turn_index (0, 1,
    ... by turn; ties by role, then text), first_token (ids of the conversation before the
    turn), ids and loss_mask.

    Null roles and texts are empty, and a null turn comes first. Rows without conv_id are one
    conversation. Repeated rows are turns of their own, and lie in one partition; an empty
    table gives none; other columns are ignored. A text is encoded whole, in one task."""
    return _carried(_placed(turns, tokenizer)[0])


def _parse(path: str):
    """(conv_id, turn_index, role, text, loss_text, rendered) from ids and masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        start, sep, end = (encoder.lib.get_vocab_size() + np.arange(3)).tolist()
        for b in batches:
            roles, texts, losses = [], [], []
            for k in range(b.num_rows):
                ids = b.column("ids")[k].values.to_numpy()
                mask = b.column("loss_mask")[k].values.to_numpy().astype(bool)
                cut = int(np.flatnonzero(ids == sep)[0])
                if ids[0] != start or ids[-1] != end:
                    raise ValueError("a turn doesn't begin and end with its marks")
                roles.append(ids[1:cut].tolist())
                texts.append(ids[cut + 1 : -1].tolist())
                losses.append(ids[mask].tolist())
            decode = lambda x: encoder.lib.decode_batch(x, skip_special_tokens=False)
            roles, texts = decode(roles), decode(texts)
            losses = [unescape(x) for x in decode(losses)]
            rendered = [MARKS[0] + r + MARKS[1] + t + MARKS[2] for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("conv_id"),
                    b.column("turn_index"),
                    pa.array([unescape(r) for r in roles], pa.string()),
                    pa.array([unescape(t) for t in texts], pa.string()),
                    pa.array(losses, pa.string()),
                    pa.array(rendered, pa.string()),
                ],
                ["conv_id", "turn_index", "role", "text", "loss_text", "rendered"],
            )

    return run


def read_conversations(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """What ``format_conversations`` wrote, as text again: conv_id, turn_index, role, text,
    loss_text (text under the mask) and rendered (marks and escaped text)."""
    return formatted.select("conv_id", "turn_index", "ids", "loss_mask").mapInArrow(
        _parse(tokenizer), "conv_id long, turn_index long, role string, text string, loss_text string, rendered string"
    )


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _DIGEST.replace(",", "").split()[::2]
    conv = state = None
    for b in batches:
        out = []
        for c, r, t, x, f in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text", "loss_text", "rendered")), strict=True):
            if state is None or c != conv:
                if state:
                    out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += 1
            state[1].update(f"{r}\n{t}\n".encode())
            state[2] += len(x)
            state[3].update(x.encode())
            state[4] += len(f)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), _DIGEST_TYPES, strict=True)], names)
    if state:
        last = (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(last, _DIGEST_TYPES, strict=True)], names)


def conversation_digests(parsed: DataFrame) -> DataFrame:
    """One row a conversation of ``read_conversations``: counts and digests."""
    in_order = parsed.repartition(_parts(parsed), "conv_id").sortWithinPartitions("conv_id", "turn_index")
    return in_order.mapInArrow(_digest, _DIGEST)


def write_conversations(turns: DataFrame, path: str, tokenizer: str) -> None:
    """``format_conversations`` as a zstd table at ``path``."""
    placed, at = _placed(turns, tokenizer)
    _carried(placed).write.option("compression", "zstd").parquet(path)
    remove(turns.sparkSession, at)


def read_back(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    return read_conversations(spark.read.schema(_OUT).parquet(path), tokenizer)
