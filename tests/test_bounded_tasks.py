"""What a task holds, and how many tasks there are, for many rows or long texts."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docsift.operators import embed, trigram


def test_tokens_are_counted_a_slice_at_a_time():
    import tracemalloc

    r = np.random.default_rng(0)
    rows = [r.integers(0, 64, n).tolist() for n in (0, 3, 700, 2, 0, 5, 40_000, 1)]
    got = embed._unit_vectors(pa.array([[9], *rows], pa.list_(pa.int32())).slice(1), 64)
    for v, row in zip(got.to_pylist(), rows, strict=True):
        m = np.bincount(row, minlength=64).astype(float)
        assert v == (m / (np.sqrt((m * m).sum()) + embed.NORM_EPS)).astype(np.float32).tolist()
    many = pa.ListArray.from_arrays(np.arange(0, 8_000_001, 1000, dtype=np.int32), np.zeros(8_000_000, dtype=np.int32))
    tracemalloc.start()
    embed._unit_vectors(many, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # before, 16 bytes a token and more of a whole batch


def test_postings_of_long_texts_come_in_parts(monkeypatch):
    monkeypatch.setattr(trigram, "MOST_ENTRIES", 50)
    texts = ["the cat sat on the mat", "a cat", "on the mat again", "x", "the end of the cat"] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(texts)], ["num", "text"])
    out = list(trigram._postings(16)([batch]))
    assert max(sum(b.column("n").to_pylist()) for b in out) <= 50 + max(len(trigram.trigrams(t)) for t in texts)
    found = {}
    for b in out:
        for gram, chunk, n, code in zip(*(c.to_pylist() for c in b.columns), strict=True):
            members = trigram.decode(code)
            assert len(members) == n
            found.setdefault(gram, []).extend((chunk * 16 + members).tolist())
    for gram, numbers in found.items():
        assert numbers == [i for i, t in enumerate(texts) if gram in trigram.trigrams(t)]


def test_small_files_share_tasks(spark, tmp_path):
    from docsift.sources.files import TASKS_PER, read_text_files, write_text_files

    n = 900
    write_text_files(spark.range(n).select(F.col("id").cast("string").alias("name"), F.concat(F.lit("t"), "id").alias("text")), str(tmp_path / "txt"))
    put = {"spark.sql.files.maxPartitionBytes": "4m"}  # a file a task
    old = {k: spark.conf.get(k) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        got = read_text_files(spark, str(tmp_path / "txt"))
        assert got.rdd.getNumPartitions() <= TASKS_PER * max(spark.sparkContext.defaultParallelism, 8)
        assert {r.name: r.text for r in got.collect()} == {str(i): f"t{i}" for i in range(n)}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_json_metadata_is_parsed_once(spark):
    from docsift.functions.json import normalise_metadata_json

    rows = ['{"a": "x", "b": 1.0, "c": 1e2, "d": null, "e": [1, {"z": 1}], "f": true, "g": 7}', "[1]", "{", '{"a": 1e400}', "{}", None]
    df = spark.createDataFrame([(r,) for r in rows], "j string").select(normalise_metadata_json("j").alias("m"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("SchemaOfVariant.") == 1  # before, 2 and 5
    got = [r.m for r in df.collect()]
    assert got[0] == {"a": "x", "b": "1.0", "c": "100.0", "d": "null", "e": '[1,{"z":1}]', "f": "true", "g": "7"}
    assert got[1:] == [None, None, None, {}, None]
