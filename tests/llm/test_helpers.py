import random

import numpy as np
import pyarrow as pa
import pytest
from brute import words

from docsift.llm.common import components
from docsift.llm.words import grams, texts_of, word_chunks

TEXTS = ["", None, " a  b\n", "one", "é ü\x0bx\x0cy\rz", "x" * 5000 + " y", "a b a b", "  nbsp", "tail "]


@pytest.mark.parametrize("limit", [1, 20, 10**6])
def test_words_match_the_regex(limit):
    column = texts_of(pa.array(TEXTS))
    seen = {}
    for w in word_chunks(column, limit):
        for i in range(w.rows):
            own = w.hash[w.at[i] : w.at[i + 1]]
            expected = words(TEXTS[w.first + i])
            assert len(own) == len(expected)
            for h, e in zip(own.tolist(), expected, strict=True):
                assert seen.setdefault(h, e) == e
    assert len(seen) == len({x for t in TEXTS for x in words(t)})


def test_word_hash_does_not_depend_on_place():
    a, b = (next(word_chunks(texts_of(pa.array([t])))).hash for t in ("xyz longerthaneight", "longerthaneight\nxyz"))
    assert a.tolist() == b[::-1].tolist()


@pytest.mark.parametrize("n", [1, 2, 3, 8, 10, 50])
def test_grams_are_equal_where_runs_are(n):
    r = np.random.default_rng(0).integers(0, 2, 300).astype(np.uint64)
    g = grams(r, n)
    runs = [tuple(r[i : i + n]) for i in range(len(r) - n + 1)]
    assert len(g) == len(runs)
    assert len(set(g.tolist())) == len(set(runs)) == len(set(zip(g.tolist(), runs, strict=True)))


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    up = {x: x for e in edges for x in e}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
