import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from docsift.llm import repair
from docsift.llm.repair import damaged, repair_conversations

from conftest_llm import SF001

SCHEMA = "conv_id long, turn long, role string, text string, digest string, audit string, part int, kind string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def frame(spark, rows):
    from docsift.session import ship_package

    ship_package(spark)
    return spark.createDataFrame([(*r, "d", "a", 1, "k") for r in rows], SCHEMA)


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        code = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def brute_conversation(rows):
    """Row of the operator for one conversation, from its rows after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)

    @lru_cache(None)
    def best(i, state):
        """Least (cost, audit, repaired) from row i in a state, audits by bytes."""
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if i < len(rows):
            role, text, fault = rows[i][2], rows[i][3], faults[i]
            go = best(i + 1, state)
            found.append((go[0] + 2, "D" + go[1], go[2]))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                first = role[:1]
                if first == "s" and state == "" or first in ("u", "a") and NEXT[state] == first:
                    go = best(i + 1, first)
                    found.append((go[0] + more, "K" + go[1], (f"{role}:{text}", *go[2])))
                to = NEXT[state]
                go = best(i + 1, to)
                found.append((go[0] + 1 + more, "R" + go[1], (f"{FULL[to]}:{text}", *go[2])))
        return inserted(i, state, found)

    def inserted(i, state, found):
        # At most two insertions in a row can be part of a cheapest repair.
        for n in (1, 2):
            to, put = state, []
            for _ in range(n):
                to = NEXT[to]
                put.append(f"{FULL[to]}:")
            go = plain(i, to)
            if go:
                found.append((go[0] + 5 * n, "I" * n + go[1], (*put, *go[2])))
        return min(found) if found else (10**9, "", ())

    @lru_cache(None)
    def plain(i, state):
        """Like best, but the first edit is not an insertion."""
        if i == len(rows):
            return (0, "", ()) if state in ("", "a") else None
        role, text, fault = rows[i][2], rows[i][3], faults[i]
        go = best(i + 1, state)
        found = [(go[0] + 2, "D" + go[1], go[2])]
        if fault not in ("blank", "duplicate"):
            more, first, to = 5 * (fault == "truncated"), role[:1], NEXT[state]
            if first == "s" and state == "" or first in ("u", "a") and NEXT[state] == first:
                go = best(i + 1, first)
                found.append((go[0] + more, "K" + go[1], (f"{role}:{text}", *go[2])))
            go = best(i + 1, to)
            found.append((go[0] + 1 + more, "R" + go[1], (f"{FULL[to]}:{text}", *go[2])))
        return min(found)

    cost, audit, repaired = best(0, "")
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = zip(rows[:-1], rows[1:], strict=True)
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairs)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    sha = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
    assert not repaired or re.fullmatch("s?(ua)+", "".join(x[0] for x in repaired))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def brute(rows):
    left = brute_damage(rows)
    return {c: brute_conversation([r for r in left if r[0] == c]) for c in {r[0] for r in rows}}


def found(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def conversations(seed, n, longest):
    r, out = random.Random(seed), []
    for conv in range(n):
        for turn in range(r.randrange(1, longest)):
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = r.choice(["Yes.", "No", "", " \n", None, f"Text {r.randrange(9)}!", "a. b"])
            out.append((conv, r.choice([turn, turn, turn, None, turn + 3]), role, text))
    return out


def test_equals_brute_force(spark):
    rows = conversations(1, 300, 12)
    assert found(repair_conversations(frame(spark, rows))) == brute(rows)


def test_the_given_table(spark):
    df = spark.read.parquet(f"{SF001}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, damaged(df).collect()), key=str) == sorted(brute_damage(rows), key=str)
    assert found(repair_conversations(df)) == brute(rows)


def test_a_long_conversation_lies_on_many_partitions(spark, monkeypatch):
    """Costs, entry states, gaps and pairs are carried over partition edges."""
    rows = [(7, t, r, x) for _, t, r, x in conversations(2, 60, 12) for t in [random.Random(str((t, r, x))).randrange(400)]]
    rows += [(None, None, "user", "Null."), (None, None, "user", "Null."), (8, 1, "assistant", "Hi.")]
    monkeypatch.setattr(repair, "ROWS", 9)
    assert found(repair_conversations(frame(spark, rows))) == brute(rows)


def test_many_equal_rows_are_one_with_a_count(spark):
    rows = [(1, 1, "user", "Same.")] * 500 + [(1, 2, "assistant", "Fine."), (1, 3, "user", "Same.")]
    got = found(repair_conversations(frame(spark, rows)))
    assert got == brute(rows)
    assert got[1][2] >= 499


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (1, None, "user", None), (2, 0, "user", ""), (3, 5, "system", "Only."),
        (4, 0, "user", "x" * 200_000 + "."), (4, 1, "assistant", "y" * 200_000), (5, 0, "ultra", "Kept."), (5, 1, "ally", "Kept!"),
        (6, -(2**62), "user", "Low."), (6, 2**61, "assistant", "High."), (7, 1, "us\ner", "a:b.\n"), (8, 0, "user", "é\U0001f600?"),
    ]
    rows += [(9, t, "user", "Dropped or not.") for t in range(40)]
    assert found(repair_conversations(frame(spark, rows))) == brute(rows)
    assert repair_conversations(frame(spark, rows).limit(0)).count() == 0


def test_a_conversation_that_is_all_dropped(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = found(repair_conversations(frame(spark, [(gone, 0, "user", "Hi.")])))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_ranks_order_the_audits(n):
    """The ranks after the last doubling order all nodes by the audits that start there."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(n)
    batch = pa.RecordBatch.from_pydict({
        "conv_id": pa.array([1] * n, pa.int64()), "turn": pa.array(range(n), pa.int64()), "initial": [r.choice("suat") for _ in range(n)],
        "copies": pa.array([1] * n, pa.int64()), "end": pa.array([r.randrange(3) for _ in range(n)], pa.int32()), "first": [r.random() < 0.8 for _ in range(n)],
    })
    a = repair.Audits(repair.Rows([batch]), None)
    audits = []
    for node in range(a.letter.size):
        word = []
        while a.letter[node]:
            word.append(int(a.letter[node]))
            node = int(a.jumps[0][node])
        audits.append(word)
    order = sorted(range(len(audits)), key=lambda v: audits[v])
    assert (np.diff(a.rank[order]) >= 0).all()
    assert all((a.rank[x] == a.rank[y]) == (audits[x] == audits[y]) for x, y in zip(order[:-1], order[1:], strict=True))
