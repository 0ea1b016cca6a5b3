"""LIKE semantics (FIXTURES section 3)."""

import pytest

from docsift.operators.text_search import text_matches, text_search


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize(
    "texts,query,expected",
    [
        (["a%b", "axb"], "a%b", ["1", "2"]),  # '%' is a live wildcard
        (["a_b", "acb", "ab"], "a_b", ["1", "2"]),  # '_' matches one char
        (["a\\b"], "\\", ["1"]),  # backslash is plain
        (["ABC"], "abc", ["1"]),  # ASCII folds
        (["É"], "é", []),  # non-ASCII does not
        (["x", "y"], "", ["1", "2"]),  # empty query matches all
    ],
)
def test_like_semantics(docs_factory, texts, query, expected):
    docs = docs_factory([(str(i + 1), t, None) for i, t in enumerate(texts)])
    assert ids(text_matches(docs, query)) == expected


def test_first_k_in_binary_id_order(docs_factory):
    docs = docs_factory([("2", "hit", None), ("10", "hit", None), ("3", "miss", None)])
    rows = text_search(docs, "hit", k=1).collect()
    assert [r["id"] for r in rows] == ["10"]  # '10' < '2'
    assert rows[0]["score"] == 1.0


def test_text_threshold(docs_factory):
    docs = docs_factory([("a", "hit", None), ("b", "hit", None)])
    assert text_search(docs, "hit", k=10, threshold=1.0).count() == 2
    assert text_search(docs, "hit", k=10, threshold=1.1).count() == 0


def test_reserved_escape_char_rejected(docs_factory):
    docs = docs_factory([("a", "x", None)])
    with pytest.raises(ValueError):
        text_matches(docs, "\u0001")


def test_metadata_table_reads_one_folder_and_follows_edits(spark, tmp_path, docs_factory):
    from docsift.operators.metadata import metadata_equals
    from docsift.operators.metadata_index import MetadataIndex
    from docsift.plans.search import metadata_search

    rows = [(str(i), f"t{i}", {"k": f"v{i % 7}", "even": str(i % 2)} if i % 5 else None) for i in range(200)]
    docs = docs_factory(rows)
    index = MetadataIndex.build(docs, str(tmp_path / "a"), buckets=16)
    ids = lambda df: sorted(r.id for r in df.collect())
    for key, value in (("k", "v3"), ("even", "1"), ("k", "none"), ("nokey", "1")):
        assert ids(index.ids(key, value)) == ids(metadata_equals(docs, key, value))
        assert index.count(key, value).first()["count"] == len(ids(index.ids(key, value)))
        assert [tuple(r) for r in index.search(docs, key, value, 4).collect()] == [tuple(r) for r in metadata_search(docs, key, value, 4).collect()]
    plan = index.count("k", "v3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(key,k)" in plan and "text" not in plan
    edited = docs_factory([("1", "new", {"k": "v3"}), ("new", "n", {"k": "v3", "x": "y"})] + [r for r in rows if r[0] not in ("1", "3")])
    changed = spark.createDataFrame([("1",), ("3",), ("new",), ("1",)], "id string")
    later = index.after(changed, edited, str(tmp_path / "b"))
    for key, value in (("k", "v3"), ("even", "1"), ("x", "y")):
        assert ids(later.ids(key, value)) == ids(metadata_equals(edited, key, value))
