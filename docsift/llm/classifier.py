"""Operator 13: quality classifier by random Fourier features.

1. Statistics of every whole text (``STATISTICS``), from its bytes and words alone.
2. They are standardised by sums over all documents and cut at ``CUT`` deviations.
3. ``FEATURES`` random cosines approximate a Gaussian kernel whose variance is the number of
   statistics (Rahimi and Recht, 2007); the draws are fixed by a seed.
4. Normal equations: a task adds up the products of its labelled rows' features, by fold,
   and the sums are added as vectors. The driver solves ridge systems of ``FEATURES + 1``.
5. Calibration: each training row is scored by the model fitted without its fold; a
   histogram of these scores and labels is made isotonic by pooling adjacent violators,
   and scores between two pools are interpolated. The model of all folds scores every row.

A label is learnt only where crc32 of the id as text, modulo 5, isn't 0; folds are that
remainder. The driver sees sums by feature and by histogram bin, never a row by document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.session import ship_package

from .common import U64, mix, remove, written
from .words import SPACE, Words, grams, hash_spans, texts_of, word_chunks

FEATURES, RIDGE, SEED, CUT = 256, 0.1, 13, 5.0
FOLDS, THRESHOLD = 5, 0.3
BIN, LEAST, MOST = 0.0005, -1.0, 2.0

# Share of characters in a class, by its ASCII members.
_CLASSES = {"symbol": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)), "punctuation": b".,;:!?", "exclamation": b"!"}
STATISTICS = [
    "log_words", "word_length", *_CLASSES, "sentence_ends", "repeated_lines", "line_words",
    "distinct_words", "top_word", "repeated_pairs", "equal_neighbours",
]


def _members(some: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(some)] = True
    return out


_TABLES = [_members(c) for c in _CLASSES.values()]
_END = _members(b".!?")


def _grouped(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of different items, count of the commonest) of each row."""
    _, first, n = np.unique(mix(h + mix(row.astype(U64))), return_index=True, return_counts=True)
    top = np.zeros(rows, dtype=np.int64)
    np.maximum.at(top, row[first], n)
    return np.bincount(row[first], minlength=rows), top


def statistics(w: Words) -> np.ndarray:
    """A row of ``STATISTICS`` for each text."""
    at_least_one = lambda x: np.maximum(x, 1)
    per_row = lambda r: np.bincount(r, minlength=w.rows)
    n = np.diff(w.at)
    byte_row = np.repeat(np.arange(w.rows), np.diff(w.offsets))
    wordy = ~SPACE[w.data]
    chars = per_row(byte_row[wordy & ((w.data & 0xC0) != 0x80)])
    shares = [per_row(byte_row[t[w.data]]) / at_least_one(chars) for t in _TABLES]
    # A word's last byte: one that is no space, before a space or its text's end.
    edge = np.zeros(len(w.data) + 1, dtype=bool)
    edge[w.offsets] = True
    last = wordy & (np.r_[~wordy[1:], True] | edge[1:]) if len(w.data) else wordy
    ends = per_row(byte_row[last & _END[w.data]])
    newline = w.data == 0x0A
    cut = edge.copy()
    cut[1:] |= newline
    cut = np.flatnonzero(cut)
    begin, end = cut[:-1], cut[1:]
    if len(begin):
        some = np.add.reduceat(wordy, begin) > 0
        begin, end = begin[some], end[some]
        end = end - newline[end - 1]
    line_row = byte_row[begin]
    lines = per_row(line_row)
    different_lines, _ = _grouped(line_row, hash_spans(w.data, begin, end), w.rows)
    words, top = _grouped(w.row, w.hash, w.rows)
    two = w.spans(2)
    pair_row = w.row[: len(two)][two]
    pairs = grams(w.hash, 2)[two]
    different_pairs, _ = _grouped(pair_row, pairs, w.rows)
    same = pair_row[(w.hash[1:] == w.hash[:-1])[two]] if len(two) else pair_row
    of_pairs = at_least_one(n - 1)
    return np.column_stack([
        np.log1p(n), chars / at_least_one(n), *shares, ends / at_least_one(n),
        (lines - different_lines) / at_least_one(lines), np.log1p(n / at_least_one(lines)),
        words / at_least_one(n), top / at_least_one(n), np.where(n > 1, n - 1 - different_pairs, 0) / of_pairs, per_row(same) / of_pairs,
    ]).astype(np.float64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w in word_chunks(texts_of(b.column("text"))):
            x = statistics(w)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).slice(w.first, w.rows) for c in ("doc_id", "fold")), *map(pa.array, x.T)],
                ["doc_id", "fold", *(f"s{i}" for i in range(len(STATISTICS)))],
            )


class Features:
    """Random cosines of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, seed: int):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(deviation > 1e-12, deviation, 1.0)
        self.directions = r.normal(size=(len(mean), features)) / np.sqrt(len(mean))
        self.phases = r.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CUT, CUT)
        cosines = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([cosines, np.ones(len(x))])


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([b.column(f"s{i}").to_numpy() for i in range(len(STATISTICS))])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def _equations(features: Features):
    """A task's sums of products by fold: (fold, row of the matrix, its numbers as bytes); a
    matrix has the right-hand side as its last column."""
    size = len(features.phases) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for b in _slices(batches):
            p, y, fold = features(_matrix(b)), b.column("y").to_numpy(), b.column("fold").to_numpy()
            for f in np.unique(fold):
                q = p[fold == f]
                sums[int(f)] = sums.get(int(f), np.zeros((size, size + 1))) + q.T @ np.column_stack([q, y[fold == f]])
        for f, m in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, f)), pa.array(np.arange(size)), pa.array([r.tobytes() for r in m], pa.binary())], ["fold", "i", "numbers"]
            )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the vectors of a group; its batches are read one after the other."""
    total = None
    for b in batches:
        for v in b.column("numbers"):
            x = np.frombuffer(v.as_buffer(), dtype=np.float64)
            total = x.copy() if total is None else total + x
        key = b.select(["fold", "i"]).slice(0, 1)
    yield pa.RecordBatch.from_arrays([*key.columns, pa.array([total.tobytes()], pa.binary())], ["fold", "i", "numbers"])


def _solve(m: np.ndarray, ridge: float) -> np.ndarray:
    a = m[:, :-1] + np.diag(np.r_[np.full(len(m) - 1, ridge), 1e-9])  # the constant isn't shrunk
    return np.linalg.solve(a, m[:, -1])


def _raw(features: Features, models: np.ndarray, by_fold: bool):
    """Adds ``raw``: the score by model 0, or by the model without the row's fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            p = features(_matrix(b))
            which = b.column("fold").to_numpy() if by_fold else np.zeros(b.num_rows, dtype=np.int64)
            raw = np.clip(np.round(np.einsum("ij,ij->i", p, models[which]), 9), LEAST, MOST)
            extra = ["y"] if by_fold else ["doc_id", "fold"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in extra), pa.array(raw)], [*extra, "raw"])

    return run


def isotonic(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools of adjacent violators: (mean x, share of positives), both rising, from cells in
    order of x with counts and (fractional) positives."""
    pools: list[list[float]] = []
    for cell in zip(x * n, n, positive, strict=True):
        pools.append(list(cell))
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    p = np.array(pools).reshape(-1, 3)
    return p[:, 0] / p[:, 1], np.clip(p[:, 2] / p[:, 1], 0, 1)


def _scored(batches: Iterator[pa.RecordBatch], x: np.ndarray, share: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        score = np.interp(b.column("raw").to_numpy(), x, share)
        held = b.column("fold").to_numpy() == 0
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(held), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"],
        )


def score_quality(docs: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs (doc_id, text)``, learnt from
    ``labels (doc_id, quality)``.

    A null or empty text has statistics of 0 and is scored like any other; a null id counts as
    the empty text in crc32, so its row is held out. Several labels of one id are averaged (1 is
    good, any other number isn't), null ones are ignored; repeated rows each count. Without a usable
    label every score is 0.5. An empty table gives no rows. Other columns, ``lang`` and ``source``
    among them, are not used. A very long text is one task's work, in linear memory."""
    spark = docs.sparkSession
    ship_package(spark)
    fold = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS).cast("long")
    columns = [f"s{i}" for i in range(len(STATISTICS))]
    schema = "doc_id long, fold long, " + ", ".join(f"{c} double" for c in columns)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("fold"), "text")
    stats, _ = written(base.mapInArrow(_measure, schema), "statistics")
    row = stats.agg(*(F.coalesce(f(c), F.lit(0.0)) for f in (F.avg, F.stddev_pop) for c in columns)).first()
    mean, deviation = np.array(row[: len(columns)]), np.array(row[len(columns) :])
    draw = Features(mean, deviation, features, seed)
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)).alias("y"))
    )
    train, train_at = written(stats.where("fold <> 0").join(known, "doc_id").select("fold", "y", *columns), "labelled")
    parts = (
        train.mapInArrow(_equations(draw), "fold long, i long, numbers binary")
        .groupBy("fold", "i").applyInArrow(_added, "fold long, i long, numbers binary")
    ).toArrow()  # a row a fold and feature
    if parts.num_rows:
        sums = np.zeros((FOLDS, features + 1, features + 2))
        sums[parts["fold"].to_numpy(), parts["i"].to_numpy()] = [np.frombuffer(v.as_buffer(), dtype=np.float64) for v in parts["numbers"]]
        whole = sums.sum(axis=0)
        models = np.array([_solve(whole - (sums[f] if f else 0), ridge) for f in range(FOLDS)])
        cells = (
            train.mapInArrow(_raw(draw, models, True), "y double, raw double")
            .groupBy(F.floor(F.col("raw") / BIN).alias("bin"))
            .agg(F.count("*").alias("n"), F.sum("y").alias("good"), F.avg("raw").alias("x")).orderBy("bin")
        ).toPandas()  # at most (MOST - LEAST) / BIN + 1 rows
        x, share = isotonic(*(cells[c].to_numpy(dtype=np.float64) for c in ("x", "n", "good")))
    else:
        models, x, share = np.zeros((1, features + 1)), np.array([0.0]), np.array([0.5])
    remove(spark, train_at)
    raw = stats.mapInArrow(_raw(draw, models, False), "doc_id long, fold long, raw double")
    return raw.mapInArrow(lambda batches: _scored(batches, x, share), "doc_id long, held_out boolean, score double, predicted int")
