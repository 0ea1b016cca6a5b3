"""Operator 12: conversation structure repair by prefix-doubling path ranking.

A conversation's rows, in order, are repaired by the cheapest edits after which the
initials of its roles read ``(s?(ua)+)?``. A state says what the last role left was
(start, s, u, a); each row is a (min, +) matrix between states, and so is any run of rows.

1. Rows equal in every column are one row with a count. Rows are dealt by range of
   (conv_id, turn, role, digest of the text) and checkpointed, so a conversation of any
   length lies on consecutive partitions, and partitions hold about ``ROWS`` rows.
2. Cost DP: the cost from every row and state to the end is a suffix product of matrices,
   by doubling, for all conversations of a partition at once. What crosses a partition's
   edge is one matrix a partition; the driver multiplies these (16 numbers a partition).
3. Arcs on cheapest paths join nodes (row, state). From one state a letter leads to one
   state only, so the arcs out of a node differ in letter, and the least arc is the first
   letter of the node's least audit. Nodes are ranked by the first 1, 2, 4, ... letters: the
   rank for twice the length is the rank of (rank, rank of the node the doubled pointer
   reaches). The least path is read from the start through the doubled pointers.
4. Which state a path leaves a partition in is a map of four states; the driver chains
   these, and the last pass writes audits, counts and the edits of rows that stay.

Texts are read twice and shuffled once, by conversation, for the digest alone: SHA-256 of a
repaired conversation is sequential by definition, and is taken from a sorted stream."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docsift.session import ship_package

from .common import checkpointed

ROWS = 250_000
# Fixed values of the task: states, what Insert or Rerole makes of each, costs.
START, S, U, A = range(4)
FOLLOWS = np.array([U, U, A, U])
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LETTERS = np.frombuffer(b"\0DIKR", dtype=np.uint8)  # by rank; 0 is the end
END_RANK, D, I, K, R = range(5)
FAR = 1 << 50
EMPTY = hashlib.sha256(b"").hexdigest()
SPACES = " \t\n\x0b\f\r"


# --- rows -----------------------------------------------------------------------------------


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that crc32 of ``conv_id:turn`` picks;
    a null role, text or part of that key is one space."""
    kind = F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn"))) % 20
    text = _or_space("text")
    return (
        rows.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.when(kind == 4, F.lit("user")).otherwise(_or_space("role")).alias("role"),
            F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
            kind.alias("kind"),
        )
        .where("kind <> 0")
        .withColumn("kind", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .drop("kind")
    )


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _facts(rows: DataFrame) -> DataFrame:
    """One row for each different row, with its count and first fault; without texts."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    key = ["conv_id", "turn", "role", "digest"]
    some = (
        _keyed(rows)
        .withColumn("end", F.when(trimmed == "", F.lit(0)).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), F.lit(1)).otherwise(F.lit(2)))
        .groupBy(*key, "end").agg(F.count("*").alias("copies"))
    )
    # The first turn of a role and text; a null turn comes first. The join is on all four columns, so no key is hot.
    at = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))
    first = some.groupBy("conv_id", "role", "digest").agg(F.min(at).alias("at"))
    first = first.select("conv_id", F.col("at.b").alias("turn"), "role", "digest", F.lit(True).alias("first"))
    a, b = some.alias("a"), first.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("a.turn").eqNullSafe(F.col("b.turn"))
    same = same & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest"))
    return a.join(b, same, "left").select("a.*", F.coalesce("b.first", F.lit(False)).alias("first"))


# --- matrices -------------------------------------------------------------------------------


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) products of stacks of 4 x 4 matrices."""
    out = a[..., :, 0:1] + b[..., 0:1, :]
    for k in range(1, 4):
        np.minimum(out, a[..., :, k : k + 1] + b[..., k : k + 1, :], out=out)
    return np.minimum(out, FAR)


def _matrix(arcs) -> np.ndarray:
    m = np.full((4, 4), FAR, dtype=np.int64)
    for a, b, c in arcs:
        m[a, b] = min(m[a, b], c)
    return m


def _inserts() -> np.ndarray:
    one = _matrix([(s, s, 0) for s in range(4)] + [(s, FOLLOWS[s], INSERT) for s in range(4)])
    return _times(_times(one, one), one)


def _row_edits() -> np.ndarray:
    """Matrix of one row's own edit by (initial's state or 0 for any other, end): the end is
    whole (0), truncated (1) or must go (2)."""
    out = np.empty((4, 3, 4, 4), dtype=np.int64)
    for role in range(4):
        for end in range(3):
            arcs = [(s, s, DELETE) for s in range(4)]
            if end < 2:
                more = TRUNCATED * end
                arcs += [(s, FOLLOWS[s], REROLE + more) for s in range(4)]
                arcs += [(s, role, KEEP + more) for s in range(4) if _legal(s, role)]
            out[role, end] = _matrix(arcs)
    return out


def _legal(state: int, role: int) -> bool:
    return role == S and state == START or role in (U, A) and FOLLOWS[state] == role


CLOSURE = _inserts()
ROW = _row_edits()
FINAL = _times(CLOSURE, _matrix([(START, START, 0), (A, START, 0)]))[:, 0]  # cost to end from each state


# --- a partition ----------------------------------------------------------------------------


class Rows:
    """A partition's rows as arrays; ``piece`` numbers the conversations in it."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.table, self.n = table, table.num_rows
        self.conv, self.turn = table.column("conv_id"), table.column("turn")
        initial = table.column("initial").to_numpy(zero_copy_only=False)
        self.role = np.select([initial == "s", initial == "u", initial == "a"], [S, U, A], 0)
        self.copies = table.column("copies").to_numpy()
        end, first = table.column("end").to_numpy(), table.column("first").to_numpy(zero_copy_only=False)
        self.blank, self.again = end == 0, (end != 0) & ~first
        self.truncated = (end == 2) & first
        self.must_go = self.blank | self.again
        new = np.ones(self.n, dtype=bool)
        new[1:] = ~_same(self.conv)
        self.starts = np.flatnonzero(new)
        self.piece = np.cumsum(new) - 1
        self.ends = np.r_[self.starts[1:], self.n]
        self.turn_new = new.copy()
        self.turn_new[1:] |= ~_same(self.turn)

    def matrices(self) -> np.ndarray:
        fault = np.where(self.must_go, 2, self.truncated)
        m = _times(np.broadcast_to(CLOSURE, (12, 4, 4)), ROW.reshape(12, 4, 4))[self.role * 3 + fault]
        return m + (DELETE * (self.copies - 1))[:, None, None]

    def suffixes(self) -> np.ndarray:
        """Products of the matrices of each row to the end of its piece, by doubling."""
        m, left, step = self.matrices(), self.ends[self.piece] - np.arange(self.n), 1
        while (left > step).any():
            at = np.flatnonzero(left > step)
            m[at] = _times(m[at], m[at + step])
            step *= 2
        return m


def _same(column: pa.ChunkedArray) -> np.ndarray:
    """True where a value equals the one before it; null equals null."""
    null = column.is_null().to_numpy()
    value = column.fill_null(0).to_numpy()
    return (null[1:] == null[:-1]) & (value[1:] == value[:-1])


def _value(column, i: int):
    return column[i].as_py()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition with rows: its number, what it begins and ends with, and the
    matrix of its first piece."""
    batches = [b for b in batches if b.num_rows]
    if batches:
        r = Rows(batches)
        last = r.n - 1
        yield pa.RecordBatch.from_pylist(
            [{
                "part": _value(r.table.column("part"), 0), "first_conv": _value(r.conv, 0), "last_conv": _value(r.conv, last),
                "first_turn": _value(r.turn, 0), "last_turn": _value(r.turn, last), "last_role": int(r.role[last]),
                "single": len(r.starts) == 1, "matrix": r.suffixes()[0].ravel().tolist(),
            }],
            schema=pa.schema([
                ("part", pa.int32()), ("first_conv", pa.int64()), ("last_conv", pa.int64()), ("first_turn", pa.int64()),
                ("last_turn", pa.int64()), ("last_role", pa.int32()), ("single", pa.bool_()), ("matrix", pa.list_(pa.int64())),
            ]),
        )


EDGES = (
    "part int, first_conv long, last_conv long, first_turn long, last_turn long, last_role int, single boolean, matrix array<long>"
)


class Audits:
    """Least cheapest audits of a partition: ``after`` are the costs beyond its last row if
    its last conversation goes on."""

    def __init__(self, r: Rows, after: list[int] | None):
        self.r, pieces = r, len(r.starts)
        # Layers: one before each row, and one after the last row of each piece.
        layer = np.arange(r.n) + r.piece
        end = r.ends + np.arange(pieces)
        tail = np.tile(FINAL, (pieces, 1))
        if after is not None:
            tail[-1] = after
        g = np.empty((r.n + pieces, 4), dtype=np.int64)
        g[end] = tail
        g[layer] = (r.suffixes() + tail[r.piece][:, None, :]).min(axis=2)
        self.cost, self.layer, self.end = g, layer, end
        nodes = np.arange(g.size).reshape(g.shape)
        rank, to = np.zeros(g.shape, dtype=np.int64), nodes.copy()
        states = np.arange(4)
        here, own = g[layer], (DELETE * (r.copies - 1))[:, None]
        more = np.where(r.truncated, TRUNCATED, 0)[:, None] + own
        stay = ~r.must_go[:, None]
        legal = np.array([[_legal(s, q) for s in range(4)] for q in range(4)])[r.role]
        nxt = g[layer + 1]
        keep = stay & legal & (here == KEEP + more + nxt[np.arange(r.n), r.role][:, None])
        rerole = stay & (here == REROLE + more + nxt[:, FOLLOWS])
        delete = here == DELETE + own + nxt
        insert = here == INSERT + here[:, FOLLOWS]
        # The least letter's arc wins: later lines overwrite earlier ones.
        for arc, letter, target in (
            (rerole, R, nodes[layer + 1][:, FOLLOWS]), (keep, K, np.broadcast_to(nodes[layer + 1, r.role][:, None], here.shape)),
            (insert, I, nodes[layer][:, FOLLOWS]), (delete, D, nodes[layer + 1]),
        ):
            rank[layer] = np.where(arc, letter, rank[layer])
            to[layer] = np.where(arc, target, to[layer])
        closing = end if after is None else end[:-1]
        opens = np.isin(states, (S, U))  # an audit can't end here: insert
        rank[closing[:, None], states[opens]] = I
        to[closing[:, None], states[opens]] = nodes[closing[:, None], FOLLOWS[opens]]
        self.letter = rank.ravel()
        self._double(rank.ravel(), to.ravel())

    def _double(self, rank: np.ndarray, to: np.ndarray) -> None:
        """Ranks by 1, 2, 4, ... letters, the pointers over as many arcs, and audit lengths."""
        self.jumps, self.length = [to], (rank > 0).astype(np.int64)
        while (self.length[to] > 0).any():
            pair = rank * (int(rank.max()) + 1) + rank[to]
            rank = np.unique(pair, return_inverse=True)[1].ravel()
            self.length = self.length + self.length[to]
            to = to[to]
            self.jumps.append(to)
        self.rank, self.sink = rank, to

    def exits(self) -> list[int]:
        """State in which the partition's last piece is left, by the state it is entered in."""
        first = 4 * self.layer[self.r.starts[-1]]
        return [int(self.sink[first + s]) % 4 for s in range(4)]

    def paths(self, entry: int) -> tuple[np.ndarray, np.ndarray]:
        """(piece, node) along the least audit of each piece, in order; the first piece is
        entered in state ``entry``, others at the start."""
        start = 4 * self.layer[self.r.starts]
        start[0] += entry
        size = self.length[start]
        piece = np.repeat(np.arange(len(start)), size)
        step = np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size)
        node = start[piece]
        for k, jump in enumerate(self.jumps):
            at = np.flatnonzero(step >> k & 1)
            node[at] = jump[node[at]]
        return piece, node


def _exits(after: dict[int, list[int]]):
    """(part, exit state by entry state) of partitions whose last conversation goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        part = batches[0].column("part")[0].as_py() if batches else None
        if part in after:
            out = Audits(Rows(batches), after[part]).exits()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([out], pa.list_(pa.int32()))], ["part", "exits"])

    return run


REPAIRS = (
    "conv_id long, part int, turn long, role string, digest binary, sub int, new_role string, audit string, cost long, "
    "blank long, duplicate long, truncated long, illegal long, low long, high long, turns long"
)
_ROLES = np.array([None, "system", "user", "assistant"], dtype=object)


def _repairs(after: dict[int, list[int]], before: dict[int, tuple]):
    """Rows of two kinds. With ``sub`` null: a piece's audit and counts. Else an edit that leaves
    a row, at the key of the row it belongs to: insertions before it (-4 and up) or after the
    conversation's last row (1 and up), and -1 for the row itself, whose new role is null if kept."""
    schema = _arrow_schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        r = Rows(batches)
        part = _value(r.table.column("part"), 0)
        entry, last_turn, last_role, continued = before.get(part, (START, None, 0, False))
        a = Audits(r, after.get(part))
        piece, node = a.paths(entry)
        letter, layer = a.letter[node], node // 4
        is_end = np.isin(layer, a.end)
        row = layer - piece - is_end  # an insertion at the end belongs to the last row
        own = np.where(letter == I, 1, r.copies[row])
        text = np.full(int(own.sum()), ord("D"), dtype=np.uint8)
        text[np.cumsum(own) - own] = LETTERS[letter]
        cuts = np.r_[0, np.cumsum(np.bincount(piece, weights=own, minlength=len(r.starts)).astype(np.int64))]
        text = text.tobytes().decode("ascii")
        count = lambda what: np.add.reduceat(what.astype(np.int64), r.starts)
        # Two neighbours are legal as su, ua or au; equal rows never are.
        pair = (r.copies - 1).copy()
        bad = ~(((r.role[:-1] == S) & (r.role[1:] == U)) | ((r.role[:-1] == U) & (r.role[1:] == A)) | ((r.role[:-1] == A) & (r.role[1:] == U)))
        inner = np.ones(r.n, dtype=bool)
        inner[r.starts] = False
        pair[1:] += bad & inner[1:]
        illegal, turns = count(pair), count(r.turn_new & r.turn.is_valid().to_numpy())
        if continued:
            illegal[0] += (last_role, int(r.role[0])) not in ((S, U), (U, A), (A, U))
            turns[0] -= last_turn is not None and _value(r.turn, 0) == last_turn
        cost = a.cost[a.layer[r.starts], START].copy()
        if continued:
            cost[0] = 0  # counted where the conversation begins
        turn = r.turn.fill_null(0).to_numpy()
        valid = r.turn.is_valid().to_numpy()
        low = np.minimum.reduceat(np.where(valid, turn, np.iinfo(np.int64).max), r.starts)
        high = np.maximum.reduceat(np.where(valid, turn, np.iinfo(np.int64).min), r.starts)
        some = count(valid) > 0
        at = pa.array(r.starts)
        yield _record(schema, len(r.starts), {
            "conv_id": r.conv.take(at), "part": np.full(len(r.starts), part), "cost": cost,
            "audit": [text[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)],
            "blank": count(np.where(r.blank, r.copies, 0)),
            "duplicate": count(np.where(r.blank, 0, r.copies - 1 + r.again)),
            "truncated": count(r.truncated), "illegal": illegal, "turns": turns,
            "low": pa.array(low, mask=~some), "high": pa.array(high, mask=~some),
        })
        left = np.flatnonzero(letter != D)
        node, row, letter, is_end = node[left], row[left], letter[left], is_end[left]
        to = a.jumps[0][node] % 4
        # Consecutive insertions at one place are numbered in order.
        place = np.flatnonzero(np.r_[True, (node[1:] // 4 != node[:-1] // 4)]) if len(node) else np.zeros(0, dtype=np.int64)
        nth = np.arange(len(node)) - np.repeat(place, np.diff(np.r_[place, len(node)]))
        sub = np.where(letter != I, -1, np.where(is_end, 1 + nth, nth - 4))
        for i in range(0, len(node), 65536):
            s = slice(i, i + 65536)
            at = pa.array(row[s])
            yield _record(schema, len(at), {
                "conv_id": r.conv.take(at), "turn": r.turn.take(at), "role": r.table.column("role").take(at),
                "digest": r.table.column("digest").take(at), "sub": sub[s],
                "new_role": np.where(letter[s] == K, None, _ROLES[to[s]]),
            })

    return run


def _arrow_schema() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(REPAIRS))


def _record(schema: pa.Schema, n: int, columns: dict) -> pa.RecordBatch:
    out = []
    for field in schema:
        value = columns.get(field.name)
        if isinstance(value, pa.ChunkedArray):
            value = value.combine_chunks()
        if value is None:
            value = pa.nulls(n, field.type)
        elif not isinstance(value, pa.Array):
            value = pa.array(value, field.type)
        out.append(value.cast(field.type))
    return pa.RecordBatch.from_arrays(out, schema=schema)


# --- partition edges, on the driver ---------------------------------------------------------


def _chain_back(edges: list) -> dict[int, list[int]]:
    """Costs beyond the last row of each partition whose last conversation goes on."""
    after, beyond = {}, None
    for k in range(len(edges) - 1, 0, -1):
        this, left = edges[k], edges[k - 1]
        costs = FINAL if not (this.single and this.part in after) else np.array(after[this.part])
        if left.last_conv == this.first_conv:
            beyond = (np.array(this.matrix, dtype=np.int64).reshape(4, 4) + costs).min(axis=1)
            after[left.part] = [int(c) for c in beyond]
    return after


def _chain_on(edges: list, after: dict, exits: dict[int, list[int]]) -> dict[int, tuple]:
    """(entry state, last turn and role before it, True) of partitions whose first conversation began earlier."""
    before = {}
    for left, this in zip(edges[:-1], edges[1:], strict=True):
        if left.part in after:
            entered = before[left.part][0] if left.single and left.part in before else START
            before[this.part] = (exits[left.part][entered], left.last_turn, left.last_role, True)
    return before


# --- digests --------------------------------------------------------------------------------


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, SHA-256 of its repaired rows) from rows sorted by conversation, key and sub."""
    conv, state, waiting, any_row, done = None, None, False, False, []

    def put(role: str, text: str) -> None:
        nonlocal any_row
        state.update((("\n" if any_row else "") + role + ":" + text).encode())
        any_row = True

    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("conv_id", "sub", "role", "new_role", "text")]
        for c, sub, role, new, text in zip(*columns, strict=True):
            if state is None or c != conv:
                if state is not None:
                    done.append((conv, state.hexdigest()))
                conv, state, waiting, any_row = c, hashlib.sha256(), False, False
            if sub == -1:
                waiting, role_now = True, new if new is not None else role
            elif sub == 0:
                if waiting:  # the first of equal rows; others are deleted
                    put(role_now, text)
                waiting = False
            else:
                put(new, "")
        if len(done) > 8192:
            yield _digest_batch(done)
            done = []
    if state is not None:
        done.append((conv, state.hexdigest()))
    if done:
        yield _digest_batch(done)


def _digest_batch(done: list) -> pa.RecordBatch:
    conv, sha = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(sha, pa.string())], ["conv_id", "sha"])


# --- the operator ---------------------------------------------------------------------------


def repair_edits(rows: DataFrame) -> DataFrame:
    """Repair of ``rows (conv_id, turn, role, text)`` as they are: the table of ``REPAIRS``, with a
    row (``sub`` null) for each piece of a conversation, and a row for each one that stays or is put in.

    Rows go by turn (nulls first), then role, then SHA-256 of the text, which orders ties."""
    spark = rows.sparkSession
    ship_package(spark)
    key = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    facts = checkpointed(_facts(rows).withColumn("initial", F.left("role", F.lit(1))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-facts.count() // ROWS))
    dealt = checkpointed(
        facts.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id())
    )
    edges = sorted(dealt.mapInArrow(_edges, EDGES).collect(), key=lambda e: e.part)  # a row a partition
    after = _chain_back(edges)
    exits = {}
    if after:
        exits = {e.part: e.exits for e in dealt.mapInArrow(_exits(after), "part int, exits array<int>").collect()}
    return checkpointed(dealt.mapInArrow(_repairs(after, _chain_on(edges, after, exits)), REPAIRS))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for each
    conv_id of ``rows (conv_id, turn, role, text)``, after the damage of ``damaged``.

    A null conv_id is a conversation of its own; a null role or text is one space, so such a row
    is blank or can't be kept under its role; null turns come first and count in no gap. Rows of
    one turn go by role, then SHA-256 of the text; equal rows after the first are duplicates. An
    empty table gives no rows. Other columns are not used. A very long text costs its hash and one
    shuffle; a very long conversation is spread over tasks but for its SHA-256, one task's stream."""
    broken = damaged(rows)
    edits = repair_edits(broken)
    pieces = edits.where("sub is null")
    left = edits.where("sub is not null").select("conv_id", "turn", "role", "digest", "sub", "new_role", F.lit(None).cast("string").alias("text"))
    texts = _keyed(broken).select("conv_id", "turn", "role", "digest", F.lit(0).alias("sub"), F.lit(None).cast("string").alias("new_role"), "text")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest", "sub")]
    hashes = left.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_digests, "conv_id long, sha string")
    none = lambda kind: F.lit(None).cast(kind)
    counts = ["cost", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns"]
    known = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    shape = lambda df, **given: df.select(
        "conv_id", *(given.get(c, none("long")).alias(c) for c in ("part", *counts)),
        given.get("audit", none("string")).alias("audit"), given.get("sha", none("string")).alias("sha"),
    )
    every = (
        shape(known)
        .unionByName(shape(pieces, part=F.col("part").cast("long"), audit=F.col("audit"), **{c: F.col(c) for c in counts}))
        .unionByName(shape(hashes, sha=F.col("sha")))
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    whole = every.groupBy("conv_id").agg(
        *(total(c) for c in ("cost", "blank", "duplicate", "truncated", "illegal", "turns")),
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.array_sort(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("part", "audit")))).alias("pieces"),
        F.coalesce(F.max("sha"), F.lit(EMPTY)).alias("repaired_sha256"),
    )
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return whole.select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost",
        F.concat_ws("", F.col("pieces.audit")).alias("audit"), "repaired_sha256",
    )
