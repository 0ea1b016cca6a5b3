"""M1-M8 F6 P3 P4 P7 J3 J4 (FIXTURES section 3)."""

from docsift.functions.json import normalise_metadata_json
from docsift.operators import mutate as M
from docsift.operators.metadata import (
    attach_metadata,
    delete_metadata,
    delete_metadata_report,
    explode_metadata,
    list_by_metadata,
    metadata_equals,
    metadata_join,
    put_metadata,
)

T1 = "2024-06-01 00:00:00"


def table(df):
    return {r["id"]: (r["text"], dict(r["metadata"])) for r in df.collect()}


def changes(spark, rows, with_ordinal=True):
    schema = "id string, text string, metadata map<string,string>" + (", ordinal long" if with_ordinal else "")
    return spark.createDataFrame(rows, schema)


def test_duplicate_insert_keeps_old(spark, docs_factory):
    docs = docs_factory([("a", "old", {"k": "v"})])
    t, rep = M.insert(docs, changes(spark, [("a", "new", None, 1), ("b", "bee", None, 2)]), T1)
    assert table(t) == {"a": ("old", {"k": "v"}), "b": ("bee", {})}
    assert {r["id"]: r["status"] for r in rep.collect()} == {"a": "exists", "b": "inserted"}


def test_batch_insert_all_or_nothing(spark, docs_factory):
    docs = docs_factory([("x", "keep", None)])
    batch = changes(spark, [("a", "1", None), ("a", "2", None), ("b", "3", None)], with_ordinal=False)
    t, rep = M.insert_batch(docs, batch, T1)
    assert table(t) == {"x": ("keep", {})}
    reasons = {(r["id"], r["reason"]) for r in rep.collect()}
    assert ("a", "duplicate in batch") in reasons and ("b", None) in reasons
    assert {r["status"] for r in rep.collect()} == {"rolled_back"}
    ok = changes(spark, [("a", "1", None), ("b", "3", None)], with_ordinal=False)
    t, rep = M.insert_batch(docs, ok, T1)
    assert set(table(t)) == {"x", "a", "b"}


def test_upsert_without_metadata_clears_it(spark, docs_factory):
    docs = docs_factory([("a", "old", {"k": "v"})])
    t, _ = M.upsert(docs, changes(spark, [("a", "new", None)], with_ordinal=False), T1)
    r = t.first()
    assert (r["text"], dict(r["metadata"])) == ("new", {})
    assert str(r["created_at"]) == "2024-01-01 00:00:00" and str(r["updated_at"]) == T1


def test_update_only_existing(spark, docs_factory):
    docs = docs_factory([("a", "old", None)])
    t, rep = M.update(docs, changes(spark, [("a", "new", None), ("z", "zz", None)], with_ordinal=False), T1)
    assert table(t) == {"a": ("new", {})}
    assert {r["id"]: r["status"] for r in rep.collect()} == {"a": "updated", "z": "not_found"}


def test_upsert_batch_last_wins_and_rejects_missing_id(spark, docs_factory):
    docs = docs_factory([("a", "old", None)])
    ch = changes(spark, [("a", "1", None, 1), (None, "no id", None, 2), ("a", "2", None, 3)])
    t, rep = M.upsert_batch(docs, ch, T1)
    assert table(t) == {"a": ("2", {})}
    assert sum(1 for r in rep.collect() if r["status"].startswith("rejected")) == 1


def test_delete_reports_missing(spark, docs_factory, vectors_factory):
    docs = docs_factory([("a", "x", {"k": "v"}), ("b", "y", None)])
    ids = spark.createDataFrame([("a",), ("nope",)], "id string")
    t, rep = M.delete(docs, ids)
    assert set(table(t)) == {"b"}
    assert {r["id"]: r["status"] for r in rep.collect()} == {"a": "deleted", "nope": "not_found"}
    meta, vec = M.delete_cascade(explode_metadata(docs), vectors_factory([("a", [1]), ("b", [2])]), ids)
    assert meta.count() == 0 and [r["id"] for r in vec.collect()] == ["b"]


def test_metadata_values_normalised(spark):
    j = '{"s":"x","n":1,"b":true,"z":null,"l":[1, 2],"o":{"b":1,"a":2}}'
    m = spark.createDataFrame([(j,)], "j string").select(normalise_metadata_json("j").alias("m")).first()["m"]
    assert dict(m) == {"s": "x", "n": "1", "b": "true", "z": "null", "l": "[1,2]", "o": '{"a":2,"b":1}'}


def test_bad_metadata_rejected(spark):
    rows = [("1", "t", "{bad"), ("2", "t", "[1,2]"), ("3", "t", '{"a":1,"a":2}'), ("4", "t", '{"a":1}'), ("5", None, None)]
    df = spark.createDataFrame(rows, "id string, text string, metadata_json string")
    errs = {r["id"]: r["error"] for r in M.validate(df).collect()}
    assert errs["4"] is None
    assert all(errs[i] and "metadata" in errs[i] for i in "123")
    assert errs["5"] == "Missing 'text' field"


def test_generated_ids_are_unique_and_stable(spark, docs_factory):
    docs = docs_factory([("a", "x", None)])
    new = spark.createDataFrame([("given", "same"), ("", "same"), (None, "same")], "id string, text string")
    t, rep = M.insert(docs, new, T1)
    ids = sorted(r["id"] for r in rep.collect())
    assert len(set(ids)) == 3 and ids[2] == "given" and all(i.startswith("doc_") for i in ids[:2])
    assert set(table(t)) == {"a", *ids}  # the table and the report agree, whenever they are computed
    again, _ = M.insert(t, new, T1)
    assert again.count() == 6  # equal texts without ids are documents of their own


def test_insert_ties_and_rejects(spark, docs_factory):
    docs = docs_factory([("old", "x", None)])
    rows = [("n", "1", None, 5), ("n", "2", None, 5), ("m", "1", None, None), ("m", "2", None, None), (None, "t", None, 1), ("z", None, None, 1)]
    t, rep = M.insert(docs, changes(spark, rows), T1, require_id=True)
    assert table(t) == {"old": ("x", {}), "n": ("1", {}), "m": ("1", {})}
    got = sorted((r["id"] or "", r["status"]) for r in rep.collect())
    assert got == [("", "rejected: Missing 'id' field"), ("m", "duplicate"), ("m", "inserted"), ("n", "duplicate"), ("n", "inserted"), ("z", "rejected: Missing 'text' field")]


def test_upsert_json_without_ordinal_keeps_the_text(spark, docs_factory):
    from docsift.sources.json_docs import parse_json_documents

    docs = docs_factory([("a", "old", {"k": "v"})])
    lines = ['{"id":"a","text":"first"}', '{"id":"a","text":"new"}', '{"id":"b","text":5}', '{"id":2,"text":"x"}', '{"text":"no id"}', "[1]", "{", '{"id":"c","text":"t","metadata":"{}"}']
    df = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
    t, rep = M.upsert_batch(docs, parse_json_documents(df), T1)
    assert table(t) == {"a": ("new", {})}
    assert sorted(r["status"] for r in rep.collect()) == sorted(
        ["upserted"] * 2
        + ["rejected: Invalid 'text': must be a string", "rejected: Invalid 'id': must be a string", "rejected: Missing 'id' field"]
        + ["rejected: Invalid request: must be a JSON object", "rejected: Malformed JSON", "rejected: Invalid 'metadata': must be a JSON object of unique keys"]
    )


def test_metadata_numbers(spark):
    j = '{"a":1.0,"b":1.5,"c":1e2,"d":1e16,"e":1.5e-7,"f":0.0001,"g":-2.50,"h":12345678901234567890,"i":1e15}'
    m = spark.createDataFrame([(j,)], "j string").select(normalise_metadata_json("j").alias("m")).first()["m"]
    assert m == {"a": "1.0", "b": "1.5", "c": "100.0", "d": "1e+16", "e": "1.5e-07", "f": "0.0001", "g": "-2.5", "h": m["h"], "i": "1e+15"}
    assert spark.createDataFrame([('{"a":1e400}',)], "j string").select(normalise_metadata_json("j").alias("m")).first()["m"] is None


def test_empty_filter_is_no_filter(docs_factory):
    from docsift.operators.metadata import count_by_metadata

    docs = docs_factory([("a", "x", {"k": "v"}), ("b", "y", None)])
    for key, value in (("", "v"), ("k", ""), (None, "v")):
        assert list_by_metadata(docs, key, value).count() == 2 and count_by_metadata(docs, key, value).first()["count"] == 2
    assert list_by_metadata(docs, "", "", limit=1).count() == 1


def test_metadata_put_delete(spark, docs_factory):
    docs = docs_factory([("a", "x", {"k": "v", "j": "w"}), ("b", "y", None)])
    edits = spark.createDataFrame([("a", "k", "new"), ("b", "q", "1")], "id string, key string, value string")
    assert table(put_metadata(docs, edits)) == {"a": ("x", {"k": "new", "j": "w"}), "b": ("y", {"q": "1"})}
    dels = spark.createDataFrame([("a", "k"), ("b", "k")], "id string, key string")
    assert table(delete_metadata(docs, dels)) == {"a": ("x", {"j": "w"}), "b": ("y", {})}
    rep = {r["id"]: r["deleted"] for r in delete_metadata_report(docs, dels).collect()}
    assert rep == {"a": True, "b": False}


def test_fold_explode_identity_and_forms_agree(docs_factory):
    docs = docs_factory([("a", "x", {"k": "v", "j": "w"}), ("b", "y", None), ("c", "z", {"k": "v"})])
    back = attach_metadata(docs, explode_metadata(docs))
    assert table(back) == table(docs)
    long_rows = explode_metadata(docs)
    m = sorted(r["id"] for r in metadata_equals(docs, "k", "v").collect())
    j = sorted(r["id"] for r in metadata_join(docs, long_rows, "k", "v").collect())
    assert m == j == ["a", "c"]
    assert list_by_metadata(docs, "k", None).count() == 3  # half filter: all


def test_metadata_wins_and_half_filter(docs_factory):
    from docsift.plans.search import search

    docs = docs_factory([("2", "x", {"k": "v"}), ("10", "y", {"k": "v"})])
    got = search(docs, None, "anything", k=10, metadata={"key": "k", "value": "v"}, threshold=5.0).collect()
    assert [(r["id"], r["score"]) for r in got] == [("10", 1.0), ("2", 1.0)]
    assert search(docs, None, "q", metadata={"key": "k"}).count() == 0


def test_metadata_put_repeated_key_last_wins(spark, docs_factory):
    docs = docs_factory([("a", "x", {"k": "v"})])
    edits = spark.createDataFrame(
        [("a", "k", "first", 1), ("a", "k", "second", 2), ("a", "j", "w", 3)], "id string, key string, value string, ordinal long"
    )
    assert table(put_metadata(docs, edits)) == {"a": ("x", {"k": "second", "j": "w"})}


def test_edits_of_one_key_apply_in_order(spark, docs_factory):
    from docsift.operators.metadata import put_metadata, put_metadata_report

    docs = docs_factory([("a", "t", {"k": "old", "o": "kept"}), ("b", "t", {"k": "old"})])
    put = lambda rows, schema: {r.id: r.metadata for r in put_metadata(docs, spark.createDataFrame(rows, schema)).collect()}
    plain = put([("a", "k", "zzz first"), ("a", "k", "aaa last"), ("zz", "k", "v")], "id string, key string, value string")
    assert plain == {"a": {"k": "aaa last", "o": "kept"}, "b": {"k": "old"}}
    ordered = "id string, key string, value string, ordinal long"
    assert put([("a", "k", "new", None)], ordered)["a"]["k"] == "new"
    assert put([("a", "k", "seven", 7), ("a", "k", "five", 5), ("a", "k", "also seven", 7)], ordered)["a"]["k"] == "also seven"
    assert put([("a", "k", None, 9), ("a", "k", "v", 1), ("b", None, "v", 1)], ordered) == {"a": {"k": "v", "o": "kept"}, "b": {"k": "old"}}
    report = put_metadata_report(docs, spark.createDataFrame([("a", "k", None), ("z", "k", "v"), ("a", "k", "v")], "id string, key string, value string"))
    assert sorted(r.status for r in report.collect()) == ["invalid", "not_found", "ok"]
