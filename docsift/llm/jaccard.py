"""Operator 8: n-gram Jaccard join by chosen paths.

Each text is the set of its runs of ``n`` words (words unchanged; a text of fewer
words is one run). Texts with equal sets form a class, found by a grouped digest, so
copies cost one row each and are never paired.

1. A set is embedded in ``tokens`` min-hash tokens (position, value).
2. Chosen paths: a run starts with every set in one node. A set follows a token of
   its own to a child node if hash(run, path, token) < 1 / (lambda * tokens); sets
   that share the token make the same choice. Two sets at the threshold share about
   one child a level, dissimilar sets fewer at every level. The choices are hashes,
   so the first ``depth`` levels need no shuffle; nodes with one set are dropped.
   Nodes of more than ``limit`` sets are split by two levels more, down to
   ``max_depth``, unless the sets resemble the node's first one on average: splitting
   can't part them. The number of runs follows from the target recall at the threshold
   (``runs_for``) at ``depth``. Only sets of a node that is split take further runs, as
   many as the target takes at the next depth. A pair that is missed hasn't met in all
   runs of some depth, so each depth may miss its part of 1 - recall.
3. Sets in a small node are compared by their tokens, all with all, in one task's
   numpy; the result is a forest of likely links, one row a set. A large node of
   alike sets, or one still large after ``max_depth`` levels, is joined whole.
4. Connected components of these links bound where links can be. Each component is
   cut into blocks of about ``block`` sets and ``block_words`` shingles, and every pair
   of blocks is one cell in which exact intersections decide. A pair of sets meets in one cell only, so counts add
   up. Cells return a row for each set, not for each pair: how many documents it
   links to, and a local root, whose components are the near-duplicate groups.

Hot groups: copies are pre-aggregated; a large group of near copies is spread over
block pairs. What is joined on a path or a component is written first, so that both
sides of the join are plain and AQE splits a hot one."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain as joined

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.session import ship_package

from .common import U64, chain, checkpointed, components, mix, remove, seed, text_key, written
from .words import grams, texts_of, word_chunks

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999
TOKENS, DEPTH, MAX_DEPTH = 64, 2, 6
LIMIT, BLOCK, BLOCK_WORDS = 512, 128, 1_000_000
# Five standard deviations of the token estimate at the threshold.
SLACK = 5 * math.sqrt(0.8 * 0.2 / TOKENS)


def runs_for(recall: float, depth: int, threshold: float, tokens: int, lam: float) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``."""
    meet = 1.0
    for _ in range(depth):
        meet = 1 - (1 - threshold * meet / (lam * tokens)) ** tokens
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row), chunk by chunk."""
    for w in word_chunks(texts):
        g = grams(w.hash, n)
        sets = []
        for a, b in zip(w.at[:-1], w.at[1:], strict=True):
            if b - a >= n:
                sets.append(np.unique(g[a : b - n + 1]))
            elif b > a:
                h = w.hash[a : a + 1]
                for i in range(a + 1, b):
                    h = chain(h, w.hash[i : i + 1])
                sets.append(h)
            else:
                sets.append(w.hash[:0])
        yield w.first, sets


def _embed(n: int, tokens: int):
    seeds = [(seed(2 * i) | U64(1), seed(2 * i + 1) | U64(1)) for i in range(tokens)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column("text"))
            for first, sets in shingle_sets(texts, n):
                size = np.array([len(s) for s in sets])
                full = np.flatnonzero(size)
                sketch = np.zeros((len(sets), tokens), dtype="<u2")
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    cut = np.cumsum(size[full]) - size[full]
                    for i, (a, c) in enumerate(seeds):
                        x = flat * a
                        x ^= x >> U64(32)
                        x *= c
                        low = mix(np.minimum.reduceat(x, cut))
                        sketch[full, i] = (low & U64(0xFFFF)).astype("<u2")
                keys = [hashlib.blake2b(s.tobytes(), digest_size=8).digest() for s in sets]
                node = np.frombuffer(b"".join(keys), dtype="<i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(first, len(sets)),
                        b.column("tkey").slice(first, len(sets)),
                        pa.array(node),
                        pa.array(size, pa.int64()),
                        pa.array([r.tobytes() for r in sketch], pa.binary()),
                    ],
                    ["doc_id", "tkey", "node", "n_shingles", "sketch"],
                )

    return run


def _tokens(sketches: list[bytes], tokens: int) -> np.ndarray:
    values = np.frombuffer(b"".join(sketches), dtype="<u2").reshape(-1, tokens).astype(U64)
    return mix(values + (np.arange(1, tokens + 1, dtype=U64) << U64(16)))


def _children(t: np.ndarray, path: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``path``, child path) of every chosen token."""
    h = mix(t ^ mix(path * U64(2) + U64(1))[:, None])
    at, token = np.nonzero(h < limit)
    return at, mix(h[at, token] + U64(1))


def _start(runs: range, depth: int, tokens: int, lam: float):
    """Paths of ``depth`` levels in each of ``runs``."""
    limit = U64(int(2**64 / (lam * tokens)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                b = batch.slice(k, 2000)
                node = b.column("node").to_numpy()
                t = _tokens(b.column("sketch").to_pylist(), tokens)
                for r in runs:
                    who, path = np.arange(len(node)), np.full(len(node), seed(1000 + r), dtype=U64)
                    for _ in range(depth):
                        at, path = _children(t[who], path, limit)
                        who = who[at]
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(node[who])], ["path", "node"])

    return run


def _deeper(levels: int, tokens: int, lam: float):
    """Paths that go on from ``path`` by ``levels``."""
    limit = U64(int(2**64 / (lam * tokens)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                b = batch.slice(k, 2000)
                t = _tokens(b.column("sketch").to_pylist(), tokens)
                who, path = np.arange(b.num_rows), b.column("path").to_numpy().view(U64)
                for _ in range(levels):
                    at, path = _children(t[who], path, limit)
                    who = who[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(path.view(np.int64)), b.column("node").take(pa.array(who))], ["path", "node"]
                )

    return run


def _resemblance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        one, two = (
            np.frombuffer(b"".join(b.column(c).to_pylist()), dtype="<u2").reshape(-1, TOKENS) for c in ("sketch", "first_sketch")
        )
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array((one == two).mean(axis=1))], ["path", "share"])


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, many groups each, from rows sorted by ``keys``."""
    rest = None
    for b in joined(batches, [None]):
        if b is not None and not b.num_rows:
            continue
        table = pa.Table.from_batches([b]) if b is not None else None
        if rest is not None:
            table = pa.concat_tables([rest, table]) if table is not None else rest
        if table is None:
            return
        if b is None:
            yield table
            return
        tail = np.ones(table.num_rows, dtype=bool)
        for k in keys:
            col = table.column(k).to_numpy()
            tail &= col == col[-1]
        cut = int(np.flatnonzero(~tail)[-1]) + 1 if not tail.all() else 0
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut)


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        col = table.column(k).to_numpy()
        new[1:] |= col[1:] != col[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least index of each row's component in a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(axis=1, initial=n)
        low = np.minimum(low, label)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _likely(tokens: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["path"]):
            node = table.column("node").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype="<u2").reshape(-1, tokens)
            cut = _bounds(table, ["path"])
            size = np.diff(cut)
            twos = cut[:-1][size == 2]
            same = (sketch[twos] == sketch[twos + 1]).sum(axis=1) >= least * tokens
            left, right = [node[twos[same]]], [node[twos[same] + 1]]
            for a, b in zip(cut[:-1][size > 2], cut[1:][size > 2], strict=True):
                s, alike = sketch[a:b], np.zeros((b - a, b - a), dtype=bool)
                for i in range(b - a):
                    alike[i] = (s[i] == s).sum(axis=1) >= least * tokens
                root = _roots(alike)
                off = root != np.arange(b - a)
                left.append(node[a:b][off])
                right.append(node[a:b][root[off]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return run


def _shingles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, sets in shingle_sets(texts_of(b.column("text")), n):
                part = b.slice(first, len(sets))
                raw = pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())
                names = ["root", "node", "weight", "blocks", "blk"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), raw], [*names, "shingles"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections. Tokens of many sets go through a matrix
    product, the others through their few pairs."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    token, of = np.unique(np.concatenate(sets), return_inverse=True)
    df = np.bincount(of)
    order = np.argsort(of, kind="stable")
    out = np.zeros((n, n), dtype=np.float32)
    heavy = np.flatnonzero(df > max(8, n // 16))
    column = np.full(len(token), -1)
    column[heavy] = np.arange(len(heavy))
    for k in range(0, len(heavy), 4096):
        width = min(4096, len(heavy) - k)
        col = column[of] - k
        ok = (col >= 0) & (col < width) & (column[of] >= 0)
        m = np.zeros((n, width), dtype=np.float32)
        m[owner[ok], col[ok]] = 1
        out += m @ m.T
    start = np.cumsum(df) - df
    members = owner[order]
    flat = out.reshape(-1)
    for d in range(2, max(8, n // 16) + 1):
        light = np.flatnonzero(df == d)
        for k in range(0, len(light), max(1, 1_000_000 // (d * d))):
            posting = members[start[light[k : k + max(1, 1_000_000 // (d * d))]][:, None] + np.arange(d)]
            pairs = posting[:, :, None] * n + posting[:, None, :]
            flat += np.bincount(pairs.ravel(), minlength=n * n).astype(np.float32)
    return flat.reshape(n, n)


def _verify(threshold: float):
    keys = ["root", "bi", "bj"]

    def links(table: pa.Table):
        node = table.column("node").to_numpy()
        first = np.unique(node, return_index=True)[1]  # a repeated row counts once
        node, blk = node[first], table.column("blk").to_numpy()[first]
        weight = table.column("weight").to_numpy()[first]
        raw = table.column("shingles").take(pa.array(first)).to_pylist()
        sets = [np.frombuffer(r, dtype="<u8") for r in raw]
        size = np.array([len(s) for s in sets], dtype=np.float64)
        if len(sets) == 2:
            both = float(len(np.intersect1d(sets[0], sets[1], assume_unique=True)))
            inter = np.array([[0.0, both], [both, 0.0]])
        else:
            inter = intersections(sets).astype(np.float64)
        linked = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9
        np.fill_diagonal(linked, False)
        if table.column("bi")[0].as_py() != table.column("bj")[0].as_py():
            linked &= blk[:, None] != blk[None, :]
        count = linked @ weight
        return node, count, node[_roots(linked)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, keys):
            cut = _bounds(table, keys)
            found = [links(table.slice(a, b - a)) for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > 1]
            if found:
                node, count, root = (np.concatenate(x) for x in zip(*found, strict=True))
                some = count > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[some]), pa.array(count[some].astype(np.int64)), pa.array(root[some])], ["node", "links", "to"]
                )

    return run


def _in_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys)


def _shared(level: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Rows of ``level (path, node)`` whose path has more rows, with their number ``n``."""
    spark = level.sparkSession
    level, level_at = written(level, name)
    sizes, sizes_at = written(level.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    members, at = written(level.join(sizes, "path"), "paths")
    remove(spark, level_at, sizes_at)
    return members, at


def _candidates(classes: DataFrame, recall: float, threshold: float, lam: float, least: float, depth: int, max_depth: int, limit: int) -> DataFrame:
    """Edges (a, b) between classes that are likely linked."""
    spark, sketches = classes.sparkSession, classes.select("node", "sketch")
    depths = [*range(depth, max_depth, 2), max(depth, max_depth)]
    part = 1 - (1 - recall) / len(depths)
    runs = [runs_for(part, d, threshold, TOKENS, lam) for d in depths]
    level = sketches.mapInArrow(_start(range(runs[0]), depth, TOKENS, lam), "path long, node long")
    small, whole, paths = [], [], []
    for k, d in enumerate(depths):
        members, at = _shared(level, f"level-{d}")
        paths.append(at)
        small.append(members.where(f"n <= {limit}").select("path", "node"))
        large = members.where(f"n > {limit}").select("path", "node")
        if large.isEmpty():
            break
        firsts = large.groupBy("path").agg(F.min("node").alias("b"))
        if d < depths[-1]:
            first_sketch = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("first_sketch"))
            share = (
                large.join(sketches, "node").join(firsts.join(first_sketch, "b"), "path")
                .select("path", "sketch", "first_sketch").mapInArrow(_resemblance, "path long, share double")
            )
            alike = share.groupBy("path").agg(F.avg("share").alias("share")).where(F.col("share") >= least).select("path")
            firsts = firsts.join(alike, "path")
        firsts, at = written(firsts, "firsts")
        paths.append(at)
        whole.append(large.join(firsts, "path").select(F.col("node").alias("a"), "b").distinct())
        if d == depths[-1]:
            break
        split, at = written(large.join(firsts, "path", "left_anti").select("path", "node"), "split")
        paths.append(at)
        if split.isEmpty():
            break
        on = split.join(sketches, "node").select("path", "node", "sketch")
        again = split.select("node").distinct().join(sketches, "node")
        level = on.mapInArrow(_deeper(depths[k + 1] - d, TOKENS, lam), "path long, node long").unionByName(
            again.mapInArrow(_start(range(runs[k], runs[k + 1]), depths[k + 1], TOKENS, lam), "path long, node long")
        )
    every = small[0]
    for s in small[1:]:
        every = every.unionByName(s)
    seen = _in_groups(every.join(sketches, "node").select("path", "node", "sketch"), ["path"])
    likely = seen.mapInArrow(_likely(TOKENS, least), "a long, b long").distinct()
    for w in whole:
        likely = likely.unionByName(w)
    out = checkpointed(likely)
    remove(spark, *paths)
    return out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL, lam: float | None = None,
                    depth: int = DEPTH, max_depth: int = MAX_DEPTH, limit: int = LIMIT, block: int = BLOCK, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of ``docs (doc_id, text)``:

    doc_id, tkey (hash of the text), class_id (least id with an equal set), n_copies
    (documents of the class), n_links (other documents whose Jaccard similarity is
    ``threshold`` or more, copies included), group_id (least id that links lead to).

    Other columns are ignored. Texts without words and rows without doc_id link to
    nothing: n_copies 1, n_links 0, and their own id as class_id and group_id. An empty
    table gives no rows. A very long text costs 8 bytes a word in each cell of its block."""
    lam = threshold if lam is None else lam
    ship_package(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "tkey", text_key()
    )
    seen, seen_at = written(
        base.mapInArrow(_embed(n, TOKENS), "doc_id long, tkey long, node long, n_shingles long, sketch binary"), "sketches"
    )
    valid = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes, classes_at = written(
        seen.where(valid).groupBy("node")
        .agg(F.min(F.struct("doc_id", "tkey")).alias("rep"), F.count("*").alias("weight"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("words")),
        "classes",
    )
    edges = _candidates(classes, recall, threshold, lam, threshold - SLACK, depth, max_depth, limit)
    near, near_at = written(components(edges).join(classes.select("node", "weight", "words", "rep.doc_id", "rep.tkey"), "node"), "near")
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("words") / block_words)).cast("int")
    sizes, sizes_at = written(near.groupBy("root").agg(blocks.alias("blocks")), "blocks")
    sets = near.join(sizes, "root").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = (
        base.join(sets, ["doc_id", "tkey"]).select("root", "node", "weight", "blocks", "blk", "text")
        .mapInArrow(_shingles(n), "root long, node long, weight long, blocks int, blk int, shingles binary")
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("root", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "node", "weight", "blk", "shingles")
    )
    links = checkpointed(
        _in_groups(cells, ["root", "bi", "bj"]).mapInArrow(_verify(threshold), "node long, links long, to long")
    )
    groups = components(links.select(F.col("node").alias("a"), F.col("to").alias("b")))
    per_class, grouped_at = written(
        classes.select("node", F.col("rep.doc_id").alias("class_id"), "weight")
        .join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .join(groups, "node", "left")
        .withColumn("root", F.coalesce("root", "node")),
        "grouped",
    )
    least_id, least_at = written(per_class.groupBy("root").agg(F.min("class_id").alias("group_id")), "least")
    per_class = written(per_class.join(least_id, "root").select(
        "node", "class_id", "weight", F.coalesce("links", F.lit(0)).alias("links"), "group_id"), "classified")[0]
    rows = checkpointed(seen.select("doc_id", "tkey", "node", valid.alias("valid")))
    remove(docs.sparkSession, seen_at, classes_at, near_at, sizes_at, grouped_at, least_at)
    out = rows.join(per_class.withColumn("valid", F.lit(True)), ["node", "valid"], "left")
    return out.select(
        "doc_id",
        "tkey",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("weight", F.lit(1)).alias("n_copies"),
        (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("group_id", "doc_id").alias("group_id"),
    )


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near duplicates: of each group the row with the least doc_id
    stays, and of rows that repeat it one. Rows without id or words stay."""
    found = near_duplicates(docs, **options)
    kept = found.where("doc_id is not null and doc_id = group_id").groupBy("doc_id", "tkey").agg(F.min("n_copies").alias("n_copies"))
    mine = docs.withColumn("__tkey", text_key()).withColumn("__id", F.col("doc_id").cast("long"))
    ided = mine.join(kept.select(F.col("doc_id").alias("__id"), F.col("tkey").alias("__tkey")), ["__id", "__tkey"])
    ided = ided.dropDuplicates(["__id", "__tkey"])
    rest = mine.where("doc_id is null")
    return ided.select(docs.columns).unionByName(rest.select(docs.columns))
