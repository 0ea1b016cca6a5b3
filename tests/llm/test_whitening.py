import numpy as np
import pytest

from docsift.llm import whitening
from docsift.llm.whitening import scatter, whiten

from conftest_llm import SF001

SCHEMA = "vec_id long, embedding array<float>, label int, n int, component string, dim int, key string"


def frame(spark, rows):
    from docsift.session import ship_package

    ship_package(spark)
    return spark.createDataFrame([(i, v, 0, 1, "c", 2, "k") for i, v in rows], SCHEMA)


def usable(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def brute(rows, most=16):
    rows = [(i, v) for i, v in rows if usable(v)]
    dim = max(len(v) for _, v in rows)
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 1000000 for c in [*v, *[0.0] * (dim - len(v))]] for _, v in rows]
    fit = np.array(sorted({tuple(v) for v in x}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (fit * n - s).astype(np.float64) / n
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(most, int((e > dim * np.finfo(float).eps * max(e[0], 0)).sum()))
    deviation = [int(((np.array(r, dtype=object) * n - s) ** 2).sum()) for r in x]
    white = ((np.array(x, dtype=object) * n - s).astype(np.float64) / n) @ axes[:, :k] / np.sqrt(e[:k])
    return n, deviation, white, e[:k] / np.trace(v), rows


def check(spark, rows):
    n, deviation, white, explained, left = brute(rows)
    got = whiten(frame(spark, rows)).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    k = white.shape[1]
    assert len(got) == len(left) * k and set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-6
    names = lambda v: -99 if v is None or v != v else int(v)
    key = sorted((names(i), c + 1, d, float(w[c])) for (i, _), d, w in zip(left, deviation, white, strict=True) for c in range(k))
    mine = sorted((names(a), b, int(d), w) for a, b, d, w in got[["vec_id", "component", "deviation", "whitened"]].itertuples(index=False))
    assert [t[:3] for t in mine] == [t[:3] for t in key]
    for c in range(1, k + 1):  # the sign is free, but one for all rows
        a, b = sorted(t[2:] for t in mine if t[1] == c), sorted(t[2:] for t in key if t[1] == c)
        flipped = sorted((d, -w) for d, w in b)
        assert np.allclose([w for _, w in a], [w for _, w in b], atol=1e-7) or np.allclose([w for _, w in a], [w for _, w in flipped], atol=1e-7)
        assert np.allclose(got["explained"][got["component"] == c], explained[c - 1], rtol=1e-9)
    return got


def test_scatter_is_exact():
    r = np.random.default_rng(3)
    for top, rows, dim in ((2, 1, 1), (120, 200, 9), (2**40, 65, 4), (2**62, 7, 3), (1, 64, 5)):
        y = r.integers(0, top, (rows, dim)).astype(np.uint64)
        cross, total = scatter(y)
        whole = y.astype(object)
        assert (np.triu(cross) == np.triu(whole.T @ whole)).all() and (total == whole.sum(axis=0)).all()


def test_the_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    got = check(spark, rows + rows[:50])
    assert got["component"].max() == 16 and got["n"].iloc[0] == 500


def test_odd_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(c) for c in r.normal(size=4)]) for i in range(60)]
    rows += [(None, rows[0][1]), (7, None), (8, [1.0, None, 0.0, 0.0]), (9, [float("nan")] * 4), (10, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(11, [0.5]), (12, []), (13, [1.0, 2.0, 3.0, 4.0, 5.0]), (14, [3e4, -3e4, 1e-9, 0.0])]
    rows += [rows[3]] * 5
    check(spark, rows)


def test_large_integers(spark):
    """Keys of 8 bytes, and sums that need more than 64 bits."""
    r = np.random.default_rng(6)
    rows = [(i, [float(c) for c in r.normal(size=3) * 1e12]) for i in range(30)]
    got = whiten(frame(spark, rows))
    n, deviation, white, _, _ = brute(rows)
    by_id = {a.vec_id: a.deviation for a in got.collect()}
    assert by_id == {i: d if d < 2**63 else None for (i, _), d in zip(rows, deviation, strict=True)}
    first = got.where("component = 1").toPandas().sort_values("vec_id")["whitened"].to_numpy()
    assert np.allclose(np.abs(first), np.abs(white[:, 0]), atol=1e-7)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_without_variance(spark, rows):
    assert whiten(frame(spark, rows)).collect() == []


def test_shuffles_carry_distinct_vectors_only(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PLANE_ROWS", 128)
    r = np.random.default_rng(8)
    base = [[float(c) for c in r.normal(size=5)] for _ in range(40)]
    check(spark, [(i, base[i % 40 if i % 3 else 0]) for i in range(3000)])
