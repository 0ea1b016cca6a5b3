import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docsift.llm.classifier import FOLDS, STATISTICS, THRESHOLD, isotonic, score_quality, statistics
from docsift.llm.words import texts_of, word_chunks

from conftest_llm import ODD, SF001, key, prose


def brute_statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, n, pairs = sum(map(len, w)), len(w), list(zip(w, w[1:]))  # noqa: B905
    share = lambda some: sum(t.count(c) for c in some) / max(chars, 1)
    classes = ["#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?", "!"]
    return [
        np.log1p(n), chars / max(n, 1), *map(share, classes), sum(x[-1] in ".!?" for x in w) / max(n, 1),
        (len(lines) - len(set(lines))) / max(len(lines), 1), np.log1p(n / max(len(lines), 1)),
        len(set(w)) / max(n, 1), max(Counter(w).values(), default=0) / max(n, 1),
        (len(pairs) - len(set(pairs))) / max(len(pairs), 1), sum(a == b for a, b in pairs) / max(len(pairs), 1),
    ]


def test_statistics_equal_brute_force(sample):
    texts = [t for _, t in ODD + sample]
    for limit in (1000, 4_000_000):
        got = np.concatenate([statistics(w) for w in word_chunks(texts_of(pa.array(texts, pa.string())), limit)])
        want = np.array([brute_statistics(t) for t in texts])
        assert got.shape[1] == len(STATISTICS)
        assert np.allclose(got, want, atol=1e-12)


def test_isotonic_equals_least_squares():
    """The least squares fit over all rising step functions, by the min-max formula."""
    r = np.random.default_rng(1)
    for size in (1, 2, 5, 30):
        x, n = np.sort(r.normal(size=size)), r.integers(1, 9, size).astype(float)
        good = r.integers(0, n + 1).astype(float)
        mean = lambda a, b: good[a : b + 1].sum() / n[a : b + 1].sum()  # noqa: E731, B023
        want = [max(min(mean(a, b) for b in range(i, size)) for a in range(i + 1)) for i in range(size)]
        at, share = isotonic(x, n, good)
        assert (np.diff(share) > 0).all() and (np.diff(at) > 0).all()
        pool = np.array([np.argmin(np.abs(share - v)) for v in want])
        assert np.allclose(share[pool], want) and (np.diff(pool) >= 0).all()


def auc(score, good):
    a, b = score[good == 1], score[good == 0]
    return (a[:, None] > b).mean() + (a[:, None] == b).mean() / 2


@pytest.fixture(scope="module")
def scored(spark):
    from docsift.session import ship_package

    ship_package(spark)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, labels).toPandas(), labels.toPandas()


def test_held_out_documents_are_told_apart(scored):
    got, labels = scored
    assert len(got) == 10_000 and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % FOLDS == 0 for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= THRESHOLD)).all()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    score, good = held["score"].to_numpy(), held["quality"].to_numpy()
    assert auc(score, good) > 0.99
    assert (held["predicted"] == good).mean() > 0.98
    assert ((score - good) ** 2).mean() < 0.02  # calibrated


def test_held_out_labels_are_never_read(make, spark):
    docs = make([(i, prose(i, 30) if i % 2 else prose(i, 30, 3)) for i in range(120)] + ODD)
    rows = [(i, i % 2, "x", 1.0) for i in range(120)]
    held = lambda i: zlib.crc32(str(i).encode()) % FOLDS == 0
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, fold string, y double")
    run = lambda rows: sorted(map(tuple, score_quality(docs, frame(rows), features=32).collect()), key=key)
    a = run(rows)
    b = run([(i, 1 - q if held(i) else q, x, y) for i, q, x, y in rows] + [(None, 0, "x", 1.0), (3, None, "x", 1.0)])
    assert len(a) == 120 + len(ODD)
    assert [r[:2] + r[3:] for r in a] == [r[:2] + r[3:] for r in b]
    assert np.allclose([r[2] for r in a], [r[2] for r in b], atol=1e-6)
    told = [(r[3], r[0] % 2) for r in a if r[1] and r[0] is not None and r[0] > 10 and r[0] < 120]
    assert np.mean([p == q for p, q in told]) > 0.9


def test_without_labels_or_documents(make, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = score_quality(make(ODD), none).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert score_quality(make([]), one).collect() == []
    assert all(r.score == 1 for r in score_quality(make(ODD), one).collect())


def test_lang_and_source_are_not_used(make, spark):
    pairs = [(i, prose(i, 40) if i % 2 else "# " * 40) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    a = score_quality(make(pairs), labels).toPandas().sort_values("doc_id")["score"]
    b = score_quality(make(pairs, source="other").selectExpr("doc_id", "text"), labels).toPandas().sort_values("doc_id")["score"]
    assert np.allclose(a, b, atol=1e-6)


def test_given_small_table(spark):
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    assert score_quality(docs, labels).count() == 200
