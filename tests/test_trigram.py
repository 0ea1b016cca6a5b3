import random

import numpy as np
import pytest

from docsift.operators.text_search import text_matches, text_search
from docsift.operators.trigram import TrigramIndex, decode, encode, pattern_trigrams, trigrams


def test_codes_round_trip():
    r = np.random.default_rng(1)
    for numbers in ([0], [5], [0, 1, 2], [127, 128, 4095], sorted(r.choice(2**20, 500, replace=False)), list(range(0, 60000, 129))):
        x = np.array(numbers, dtype=np.int64)
        assert (decode(encode(x)) == x).all()
    assert len(encode(np.arange(4096))) == 4096


def test_trigrams_are_of_code_points_and_ascii_folded():
    assert (trigrams("The") == trigrams("tHE")).all() and len(trigrams("ab")) == 0
    assert not (trigrams("Éab")[0] == trigrams("éab")[0])
    assert len(trigrams("a\U0001f600bc")) == 2 and len(trigrams("aaaaaa")) == 1
    assert len(pattern_trigrams("ab%cd_ef")) == 0 and len(pattern_trigrams("abcd%ef_ghi")) == 3


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    r = random.Random(4)
    words = ["Then", "thEn", "north", "É", "École", "100%", "a_b", "back\\slash", "\U0001f600smile", "x", "", "ﬁne", "naïve", "tab\there", "The"]
    rows = [(f"{i}", " ".join(r.choices(words, k=r.randrange(0, 12))), {"n": str(i)}) for i in range(700)]
    docs = spark.createDataFrame(rows, "id string, text string, metadata map<string,string>").cache()
    return docs, TrigramIndex.build(docs, str(tmp_path_factory.mktemp("trigram") / "index"), buckets=5, chunk=16, block=64)


@pytest.mark.parametrize("query", ["then", "THE", "th", "", "École", "école", "00%", "n%rth", "a_b", "k\\s", "\U0001f600smi", "nothing here", "the north", "ïve", "b\there", "É", "%", "then _ x"])
def test_equals_the_plain_search(indexed, query):
    docs, index = indexed
    assert sorted(index.matches(query).select("id").collect()) == sorted(text_matches(docs, query).select("id").collect())
    for k, threshold in ((3, 0.0), (1000, 1.0), (5, 1.1)):
        mine = [(r.id, r.text, r.score, r.metadata) for r in index.search(query, k, threshold).collect()]
        assert mine == [(r.id, r.text, r.score, r.metadata) for r in text_search(docs, query, k, threshold).collect()]


def test_reads_only_folders_with_candidates(spark, tmp_path):
    rows = [(f"{i:05d}", "rare needle" if i == 4000 else f"hay {i}", {}) for i in range(6000)]
    docs = spark.createDataFrame(rows, "id string, text string, metadata map<string,string>")
    index = TrigramIndex.build(docs, str(tmp_path / "index"))
    hits = index.matches("needle")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    filters = [x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:]]
    block = index.texts().filter("id = '04000'").first()["block"]
    assert any(f"block#" in f and str(block) in f for f in filters), plan
    assert index.texts().select("block").distinct().count() > 1
    assert [r.id for r in hits.collect()] == ["04000"]
    grams = index.postings().filter("n > 1").count()
    assert grams > 0 and index.candidates("needle").count() == 1


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "id string, text string, metadata map<string,string>")
    index = TrigramIndex.build(docs, str(tmp_path / "index"))
    assert index.search("then").count() == 0 and index.search("").count() == 0
