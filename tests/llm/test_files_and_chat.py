"""Mixture, licences, decontamination, token files, chat and the pipeline."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from brute import edit_in, measures, near, sha
from conftest_llm import ODD, key, prose, rows_of

from docsift.llm import chat, decontam, licenses, mixture, token_files
from docsift.llm.bpe import Encoder
from docsift.llm.common import scratch
from docsift.llm.queries import tokenizer_file


def poisson_count(rate, seed, who):
    pieces = max(1, math.ceil(rate / mixture.PIECE))
    n = 0
    for k in range(1, pieces + 1):
        u = int(hashlib.md5(f"{seed}:{who}:{k}".encode()).hexdigest()[:13], 16) / 16**13
        p = c = math.exp(-rate / pieces)
        j = 0
        while c <= u and j < 121:
            j += 1
            p *= rate / pieces / j
            c += p
            n += 1
    return n


def test_mixture_counts(spark, make):
    rows = [(i, prose(i, 20 + i % 7)) for i in range(300)]
    docs = make(rows[:200], "big").unionByName(make(rows[200:290], "small")).unionByName(make(rows[290:], None)).unionByName(make(ODD, "odd"))
    weights = {"big": 1.0, "small": 2.0, "odd": 0.0}
    out = mixture.mix_sources(docs, weights, epochs=40.0, seed=3)
    assert out.columns == [*docs.columns, "copy_", "shard_", "shuffle_key"]
    got = collections.Counter(r.doc_id for r in out.collect())
    size = {s: sum(len(t) for _, t in part) for s, part in (("big", rows[:200]), ("small", rows[200:290]))}
    total = sum(len(t or "") for _, t in rows + ODD)
    for i, _ in rows[:290]:
        s = "big" if i < 200 else "small"
        rate = 40.0 * total * weights[s] / 3 / size[s]
        assert got[i] == poisson_count(rate, 3, i), i
    assert set(got) <= {i for i, _ in rows[:290]}
    big = sum(len(dict(rows)[i]) * n for i, n in got.items() if i < 200)
    assert abs(big / (40 * total) - 1 / 3) < 0.02


def test_mixture_order_and_default(make):
    docs = make([(i, prose(i, 30)) for i in range(500)], "a").unionByName(make(ODD, None))
    out = mixture.mix_sources(docs).collect()
    assert sorted(out) == sorted(mixture.mix_sources(docs).collect()) if all(r.doc_id is not None for r in out) else True
    by_shard = collections.defaultdict(list)
    for r in out:
        by_shard[r["shard_"]].append(r.shuffle_key)
    shards = sorted(by_shard)
    for a, b in zip(shards[:-1], shards[1:], strict=True):
        assert max(by_shard[a]) < min(by_shard[b])
    assert mixture.mix_sources(make([])).count() == 0


def test_mixture_join_on_salts(make, monkeypatch):
    docs = make([(i, prose(i, 30)) for i in range(200)], "a").unionByName(make([(i, prose(i, 9)) for i in range(200, 300)], None))
    cols = ("doc_id", "copy_", "shuffle_key")
    plain = sorted(tuple(r[c] for c in cols) for r in mixture.mix_sources(docs).collect())
    monkeypatch.setattr(mixture, "BROADCAST_BYTES", 0)
    assert sorted(tuple(r[c] for c in cols) for r in mixture.mix_sources(docs).collect()) == plain


LICENSED = [
    ("a/LICENSE", "MIT License\n\n" + prose(1, 300)), ("a/x.py", "# Licensed under the Apache License, Version 2.0.\n" + prose(2, 400)),
    ("a/b/y.py", prose(3, 50)), ("a/b/c/COPYING.txt", "GNU General Public License, version 3"), ("a/b/c/d/z.py", prose(4, 9)), ("a/b/c/d/z.py", prose(4, 9)),
    ("top.txt", None), ("q/r.py", "no licence to kill " + prose(5, 80)), (None, "Released under the MIT License."), (None, ""), ("a/bb/t", ""),
    ("e/LICENSE", ""), ("e/f", "x"), ("g/LICENSE", "Released under the MIT License."), ("g/NOTICE", "Licensed under the Apache License, Version 2.0."), ("g/h/i", "y"),
]


def test_licenses(spark):
    files = spark.createDataFrame([(p, t, 1.0, "w", "i", "b") for p, t in LICENSED], "path string, text string, score double, via string, inherited string, best string")
    got = sorted(((r.path, r.license, r.via) for r in licenses.scan_licenses(files).collect()), key=str)
    expected = [
        ("a/LICENSE", "MIT", "file"), ("a/x.py", "Apache-2.0", "header"), ("a/b/y.py", "MIT", "inherited"), ("a/b/c/COPYING.txt", "GPL-3.0", "file"),
        ("a/b/c/d/z.py", "GPL-3.0", "inherited"), ("a/b/c/d/z.py", "GPL-3.0", "inherited"), ("top.txt", None, "none"), ("q/r.py", None, "none"),
        (None, "MIT", "header"), (None, None, "none"), ("a/bb/t", "MIT", "inherited"), ("e/LICENSE", None, "none"), ("e/f", None, "none"),
        ("g/LICENSE", "MIT", "file"), ("g/NOTICE", "Apache-2.0", "file"), ("g/h/i", "Apache-2.0", "inherited"),
    ]
    assert got == sorted(expected, key=str)
    assert licenses.scan_licenses(files.limit(0)).count() == 0


MIT_FILE = """The MIT License (MIT)

Copyright (c) 2014-2021 Some People and contributors

Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
APACHE_HEADER = """#
# Licensed to the Apache Software Foundation (ASF) under one or more
# contributor license agreements.  See the NOTICE file distributed with
# this work for additional information regarding copyright ownership.
# The ASF licenses this file to You under the Apache License, Version 2.0
# (the "License"); you may not use this file except in compliance with
# the License.  You may obtain a copy of the License at
#
#    http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
#
"""
GPL_HEADER = """/* foo.c - does things
 * Copyright (C) 2009 A. Writer
 *
 * Foo is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * Foo is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
"""
INSTALLED = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def test_real_license_texts(spark):
    code = "\n".join(f"x{i} = call({i}, y{i})" for i in range(200))
    files = [
        ("m/LICENSE", MIT_FILE, "MIT", "file"), ("m/src/a.c", code, "MIT", "inherited"), ("m/one.txt", prose(1, 500) + " " + " ".join(MIT_FILE.split()) + " " + prose(2, 500), "MIT", "header"),
        ("s/a.py", APACHE_HEADER + code, "Apache-2.0", "header"), ("s/foo.c", GPL_HEADER + code, "GPL-3.0", "header"),
        ("s/foo2.c", GPL_HEADER.replace("version 3", "version 2") + code, "GPL-2.0", "header"),
        ("s/lib.c", GPL_HEADER.replace("General", "Lesser General") + code, "LGPL-3.0", "header"), ("s/srv.c", GPL_HEADER.replace("General", "Affero General") + code, "AGPL-3.0", "header"),
        ("n/a.txt", prose(3, 200) + " All rights reserved. " + prose(4, 200), None, "none"),
    ]
    for name, license in INSTALLED.items():
        path = f"/usr/share/common-licenses/{name}"
        if os.path.exists(path):
            files.append((f"{name}/LICENSE", open(path, encoding="utf-8").read(), license, "file"))
    got = {r.path: (r.license, r.via) for r in licenses.scan_licenses(spark.createDataFrame([f[:2] for f in files], "path string, text string")).collect()}
    assert got == {p: (license, via) for p, _, license, via in files}


def test_identifier_lines_and_sentences(spark):
    lines = {
        "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "# SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
        "/* SPDX-License-Identifier: BSD-3-Clause */": "BSD-3-Clause", "SPDX-License-Identifier: MPL-2.0": "MPL-2.0",
        "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1",
        "This project is licensed under the MIT License - see the LICENSE file for details.": "MIT",
        "This project is licensed under the Apache License 2.0 - see the LICENSE file for details.": "Apache-2.0", "License: GPLv3": "GPL-3.0",
        "This project is licensed under the terms of the license file.": None, "no licence to kill, mit copyright": None,
        "See the LICENSE file for details of the license": None,
    }
    rows = [(f"src{k}/main.c", f"{line}\n#include <x.h>\n{prose(k, 90)}\n", "r", "d") for k, line in enumerate(lines)]
    files = spark.createDataFrame(rows, "path string, text string, __row string, __dir string")
    got = {r.path: r for r in licenses.scan_licenses(files).collect()}
    assert {r[0]: got[r[0]].license for r in rows} == dict(zip([r[0] for r in rows], lines.values(), strict=True))
    assert all(r["__row"] == "r" and r["__dir"] == "d" for r in got.values())


def test_license_cosine(spark):
    """Scores equal a plain TF-IDF over the same headers."""
    import re

    files = [(f"f{i}", t + "\n" + prose(i, 30)) for i, t in enumerate([*licenses.TEMPLATES.values(), "Copyright by the license people", "license license 2.0"])]
    terms = lambda t: [x.strip(".") for x in re.findall(licenses.TERM, t.lower()) if x.strip(".")]
    heads = [terms(line) for _, t in files for line in ["\n".join(x for x in t.split("\n") if re.search(licenses.CUE, x))]]
    heads = [h for h in heads if h]
    temps = {n: terms(t) for n, t in licenses.TEMPLATES.items()}
    known, n = {t for v in temps.values() for t in v}, len(heads) + len(temps)
    df = collections.Counter(t for h in [*heads, *temps.values()] for t in set(h) if t in known)

    def vector(h):
        return {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in collections.Counter(h).items()}

    def cosine(a, b):
        length = lambda v: math.sqrt(sum(x * x for x in v.values()))
        return sum(x * b.get(t, 0) for t, x in a.items()) / length(a) / length(b)

    got = {r.path: r.score for r in licenses.scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    for p, t in files:
        h = terms("\n".join(x for x in t.split("\n") if re.search(licenses.CUE, x)))
        expected = max((cosine(vector(h), vector(v)) for v in temps.values()), default=0) if h else 0
        assert got[p] == pytest.approx(expected, abs=1e-6), t


def leaky():
    r = random.Random(5)
    items = [(i, prose(i + 40, 12 + i)) for i in range(12)] + [(20, "short item"), (21, None), (22, ""), (23, prose(41, 13))]
    rows, planted = [], []
    for k, (i, t) in enumerate(items[:12]):
        edited = list(t)
        for _ in range(k % 6):
            at = r.randrange(len(edited))
            edited[at : at + r.randrange(2)] = r.choice(["", "x", "yz"])
        rows.append((700 + k, f"{prose(k, 60)} {'  '.join(''.join(edited).upper().split())}\n{prose(k + 9, 40)}"))
        planted.append((700 + k, i, t, "".join(edited)))
    return items, rows, planted


def test_decontamination(spark, make):
    items, rows, planted = leaky()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (4_000_000, 150):
        got = decontam.benchmark_leaks(make(rows + ODD), bench, block_chars=size).collect()
        best = {(r.doc_id, r.item_id): r for r in got}
        for doc, item, text, _ in planted:
            whole = " ".join(dict(rows)[doc].lower().split())
            least = edit_in(whole, text)
            allowed = min(int(decontam.RATE * len(text)), (len(text) - decontam.Q) // decontam.Q)
            if least <= (allowed if len(text) >= decontam.MIN_CHARS else 0):
                assert best[doc, item].edits == least, (doc, item)
            else:
                assert (doc, item) not in best
        assert {k for k in best if k[1] != 23} <= {(d, i) for d, i, _, _ in planted}
        assert sum(k[1] == 23 for k in best) == sum(k[1] == 1 for k in best)
        for r in got:
            part = " ".join(dict(rows)[r.doc_id][r.start : r.end].lower().split())
            assert edit_in(part, dict(items)[r.item_id]) <= r.edits
    clean = decontam.decontaminate(make(rows + ODD), bench)
    assert clean.columns == make([]).columns
    gone = {d for d, _ in best}
    assert len(gone) > 6
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted([x for x in rows + ODD if x[0] not in gone], key=str)
    assert decontam.benchmark_leaks(make(rows), bench.limit(0)).count() == 0
    assert decontam.benchmark_leaks(make([]), bench).count() == 0


def test_short_items_are_found_exactly_at_edges_of_words(spark, make):
    items = [(1, "Ab Cd"), (2, "x"), (3, "$5"), (4, "é"), (5, "ab  cd"), (6, "the very same short question?"), (7, " ")]
    texts = ["xab cd", "Ab\n CD!", "ab cdx ab cd", "cost $5, $55", "É e x", "so: THE very  same\tshort question?ab cd", "", None, "x" * 50, "x ab cd", "$5x 5"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in decontam.benchmark_leaks(make(list(enumerate(texts))), bench).collect())
    expected = []
    for d, t in enumerate(texts):
        for i, item in items:
            words = r"[\x20\t-\r]+".join(map(re.escape, item.split()))
            for m in re.finditer(f"(?={words})", t or "", re.I) if item.strip() else ():
                a, b = m.start(), re.compile(words, re.I).match(t, m.start()).end()
                if not (a and t[a - 1].isalnum() and t[a].isalnum()) and not (b < len(t) and t[b].isalnum() and t[b - 1].isalnum()):
                    expected.append((d, i, a, b, 0))
    assert got == sorted(expected) and len(got) > 12


def test_rulers_are_bounded_and_texts_scanned_once(spark, make):
    import tracemalloc

    ruler = [(i, f"{'-' * (55 + i)} {prose(i, 6)}") for i in range(20)]
    index = decontam.Index(ruler, decontam.Q, decontam.RATE, decontam.MIN_CHARS)
    text = "-" * 200_000 + " " + prose(3, 6) + " " + "ab" * 50_000
    tracemalloc.start()
    u, row, _ = decontam.normal([text])
    bands = index.bands(u, row)
    hits = decontam._verified(index, bands, u, np.array([0, len(u)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30
    assert [int(i) for i, e in zip(hits[:, 1], hits[:, 2], strict=True) if e == 0] == [3]
    bench = spark.createDataFrame(ruler, "item_id long, text string")
    found = decontam.benchmark_leaks(make([(1, text[150_000:201_000]), (2, prose(9, 50))]), bench, block_chars=150)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(r.doc_id, r.item_id) for r in found.collect() if r.edits == 0} == {(1, 3)}


def test_repeated_grams_equal_brute_force(spark, make):
    r = random.Random(8)
    items = [(i, "".join(r.choice(["ab", "ba", "--", "a-", "abab", "-" * 12]) for _ in range(22))) for i in range(6)]
    rows = []
    for k in range(30):
        t = list(items[k % 6][1])
        for _ in range(k % 5):
            t[r.randrange(len(t))] = r.choice(["", "z", "ab"])
        rows.append((k, "-" * r.randrange(40) + "ab" * r.randrange(20) + "".join(t) + "-" * r.randrange(60)))
    got = {}
    for x in decontam.benchmark_leaks(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect():
        got[x.doc_id, x.item_id] = min(x.edits, got.get((x.doc_id, x.item_id), 99))
    expected = {}
    for d, t in rows:
        for i, item in items:
            item = " ".join(item.split())
            allowed = min(int(decontam.RATE * len(item)), (len(item) - decontam.Q) // decontam.Q)
            if (e := edit_in(" ".join(t.split()), item)) <= allowed:
                expected[d, i] = e
    assert got == expected and len(got) >= 25


def test_mixture_with_clashing_names_and_even_shards(spark, make):
    names = ["__source", "__pieces", "__cdf", "__salt", "__mine", "__uniform", "__number", "__u", "__n", "copy", "Shard", "shuffle_key"]
    rows = [(i, "word " * 20, f"s{i % 3}", *[f"x{i}"] * len(names)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    got = mixture.mix_sources(docs)
    assert got.columns == [*docs.columns, "copy_", "shard_", "shuffle_key_"]
    out = got.withColumn("at", F.spark_partition_id()).collect()
    assert all(r[n] == f"x{r.doc_id}" for r in out for n in names)
    assert all(r["at"] == r["shard_"] for r in out)
    sizes = collections.Counter(r["at"] for r in out)
    assert len(sizes) == 8 and max(sizes.values()) < 2 * len(out) / 8
    a, b = mixture.BROADCAST_BYTES, mixture.mix_sources(docs).drop("shard_").collect()
    mixture.BROADCAST_BYTES = 0
    try:
        assert sorted(mixture.mix_sources(docs).drop("shard_").collect()) == sorted(b)
    finally:
        mixture.BROADCAST_BYTES = a


def test_token_files_in_a_given_order(spark, make):
    docs = make([(i, f"text {i}") for i in range(300)] * 2).withColumn("o", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    path = scratch(spark, "ordered")
    token_files.write_tokens(docs, path, tokenizer_file(), order="o")
    got = [r.doc_id for r in sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)]
    assert got == [r.doc_id for r in docs.select("doc_id", "o").orderBy("o").collect()]
    assert sum(a == b for a, b in zip(got[:-1], got[1:], strict=True)) < 10


def test_encoder_equals_the_library():
    r = random.Random(1)
    alphabet = list("ab.,'! \n\té　“1—’")
    texts = ["".join(r.choices(alphabet, k=r.randrange(40))) for _ in range(3000)]
    texts += ["I'm he'll. ok", "a\r\nb c", "<|endoftext|> x", "x\x1cy z", "\x00 nul", "word.  Next", "", " "]
    encoder = Encoder(tokenizer_file())
    got = []
    for _, ids, size in encoder.ids(pa.array(texts)):
        end = np.cumsum(size)
        got += [ids[e - n : e].tolist() for e, n in zip(end, size, strict=True)]
    assert got == [e.ids for e in encoder.lib.encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 64, 1000, 4097])
@pytest.mark.parametrize("every", [1, 3, 1000])
def test_rans_round_trip(n, every):
    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(0.05, n), 300)
    counts = np.bincount(np.append(ids, [5, 299]), minlength=400)
    freq = token_files.normalise(counts, 12)
    assert freq.sum() == 1 << 12 and ((freq > 0) == (counts > 0)).all()
    state, words, points = token_files.rans_encode(ids, freq, 12, 8, every)
    decoder = token_files.Decoder(freq, 12, 8, every)
    assert decoder.block(n, state, words, points).tolist() == ids.tolist()
    for c in points[:3]:  # a decoder may begin at any checkpoint
        rest = ids[c["step"] * 8 :]
        alone = token_files.Decoder(freq, 12, 8, 10**6)
        assert alone.block(len(rest), c["states"], words[4 * c["word"] :], []).tolist() == rest.tolist()


def test_token_files(spark, make, sample):
    rows = sample + ODD
    path = scratch(spark, "test")
    token_files.write_tokens(make(rows), path, tokenizer_file(), block_tokens=5000, lanes=16, checkpoint_steps=32)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    lib = Encoder.of(tokenizer_file()).lib
    at = 0
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == collections.Counter(
        (i, (*lib.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in rows
    )
    for r in got:
        raw = np.array(r.ids, dtype="<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(raw))
        at += len(r.ids)
    again = scratch(spark, "test")
    token_files.write_tokens(make([]), again, tokenizer_file())
    assert token_files.read_tokens(spark, again).count() == 0


def test_damaged_block_is_refused(spark, make, sample):
    path = scratch(spark, "test")
    token_files.write_tokens(make(sample[:20]), path, tokenizer_file())
    from pyspark.sql import functions as F

    broken = spark.read.parquet(f"{path}/blocks").withColumn("crc32", F.col("crc32") + 1)
    broken.write.parquet(f"{path}-2/blocks")
    for t in ("model", "format"):
        spark.read.parquet(f"{path}/{t}").write.parquet(f"{path}-2/{t}")
    with pytest.raises(Exception, match="is damaged"):
        token_files.read_tokens(spark, f"{path}-2").collect()


TURNS = [
    (1, 0, "user", "hi <|im_end|> <\\|im_end|> <\\\\|im_sep|>\n"), (1, 1, "assistant", "é😀 ok"), (1, 1, "assistant", "é😀 ok"), (1, 2, "assistant", None),
    (2, None, None, None), (2, 0, "ass\nistant", "x"), (None, 0, "assistant", "no id"), (3, 5, "assistant<|im_sep|>", "<|im_start|>"),
    (4, 0, "assistant", prose(3, 20000)), (5, 0, "user", "only"),
]


def test_chat(spark):
    turns = spark.createDataFrame([(*t, 1, [2]) for t in TURNS], "conv_id long, turn long, role string, text string, turn_index int, ids array<int>")
    path = scratch(spark, "test")
    chat.write_conversations(turns, path, tokenizer_file())
    got = {r.conv_id: tuple(r)[1:] for r in chat.conversation_digests(chat.read_back(spark, path, tokenizer_file())).collect()}
    groups = collections.defaultdict(list)
    for c, n, r, t in TURNS:
        groups[c].append((n is not None, n, r or "", t or ""))
    for c, g in groups.items():
        g.sort()
        loss = "".join(t for _, _, r, t in g if r == "assistant")
        rendered = "".join(f"<|im_start|>{chat.escape(r)}<|im_sep|>{chat.escape(t)}<|im_end|>" for _, _, r, t in g)
        assert got[c] == (len(g), sha("".join(f"{r}\n{t}\n" for _, _, r, t in g)), len(loss), sha(loss), len(rendered)), c
    assert len(got) == len(groups)
    firsts = chat.format_conversations(turns, tokenizer_file()).collect()
    for c in groups:
        own = sorted((r for r in firsts if r.conv_id == c), key=lambda r: r.turn_index)
        assert [r.first_token for r in own] == [sum(len(x.ids) for x in own[:k]) for k in range(len(own))]
        assert all(len(r.ids) == len(r.loss_mask) for r in own)
    assert chat.format_conversations(turns.limit(0), tokenizer_file()).count() == 0


def test_a_long_conversation_lies_over_many_partitions(spark, monkeypatch):
    r, parts = random.Random(7), []
    rows = [(c, i if c else None, r.choice(["user", "assistant"]), prose(1000 * (c or 0) + i, r.randrange(9)))
            for c, n in ((9, 700), (None, 300), (1, 2), (12, 40)) for i in range(n)]
    r.shuffle(rows)

    def seen(df, name):
        out = written(df, name)
        parts.extend(out[0].select("conv_id", "part").distinct().collect())
        return out

    written = chat.written
    monkeypatch.setattr(chat, "written", seen)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(turns, tokenizer_file())
    got = {(x.conv_id, x.turn_index): (x.first_token, len(x.ids)) for x in formatted.collect()}
    spread = collections.Counter(p.conv_id for p in parts)
    assert spread[9] > 3 and spread[None] > 1
    back = {(x.conv_id, x.turn_index): (x.role, x.text) for x in chat.read_conversations(formatted, tokenizer_file()).collect()}
    assert len(got) == len(back) == len(rows)
    for c in (9, None, 1, 12):
        own = [x[2:] for x in sorted((x for x in rows if x[0] == c), key=lambda x: x[2:] if c is None else x[1:])]
        token = 0
        for i, said in enumerate(own):
            assert back[c, i] == said and got[c, i][0] == token
            token += got[c, i][1]


def test_escape_is_reversible():
    r = random.Random(2)
    parts = ["<|im_end|>", "<\\|im_end|>", "<|im_sep|>", "\\", "<", "|im_start|>", "|", ">", "im_", "a"]
    seen = {}
    for _ in range(5000):
        t = "".join(r.choices(parts, k=r.randrange(7)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(m in e for m in chat.MARKS)
        assert seen.setdefault(e, t) == t


def test_pipeline(spark, tmp_path, make):
    import corpus_pipeline
    from docsift.llm import jaccard, quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, sf)
        if name != "token_files":
            assert df.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
        df.write.parquet(f"{tmp_path}/{name}")
        docs = out[name] = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in out.items()}
    every = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality.quality(every, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    assert set(ids["quality_rules"]) == kept
    group = near([(r.doc_id, r.text) for r in out["quality_rules"].collect()])[1]
    assert sorted(ids["near_duplicates"]) == sorted(set(group.values()))
    norm = lambda t: " ".join(t.lower().split())
    items = [norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in out["near_duplicates"].collect() if not any(i in norm(r.text) for i in items)}
    assert set(ids["benchmark_decontamination"]) == clean
    assert set(ids["source_mixture"]) <= clean
    assert collections.Counter(ids["token_files"]) == collections.Counter(ids["source_mixture"])
    # The files hold the mixture's shuffled order: copies of a document don't lie side by side.
    order = [r.doc_id for r in sorted(out["token_files"].collect(), key=lambda r: r.start)]
    beside = sum(a == b for a, b in zip(order[:-1], order[1:], strict=True))
    copies = sum(n - 1 for n in collections.Counter(order).values())
    assert copies > 20 and beside < copies / 5 and order != sorted(order)
    assert corpus_pipeline.run(spark, sf).count() == len(ids["token_files"])
    assert jaccard.one_of_each_group(make([])).count() == 0


def test_pipeline_stages_on_odd_rows(spark, make):
    import corpus_pipeline

    rows = ODD + [(90, prose(1, 100)), (91, prose(1, 100)), (92, prose(2, 90))]
    docs, sf = make(rows), "/root/testdata/sf0.001"
    got = {name: stage(spark, docs, sf) for name, stage in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    found = {n: collections.Counter((r.doc_id, r.text) for r in df.collect()) for n, df in got.items() if n != "token_files"}
    passed = collections.Counter((i, t) for i, t in rows if not measures(t)[-1])
    assert found["quality_rules"] == passed and len(passed) == 4
    unlike = collections.Counter(rows)
    unlike[4, "word"], unlike[91, prose(1, 100)] = 1, 0
    assert found["near_duplicates"] == +unlike
    assert found["benchmark_decontamination"] == collections.Counter(rows)
    copies = found["source_mixture"]
    assert set(copies) <= set(rows) and 0 < copies.total() < 4 * len(rows)
    assert len({copies[5, t] for i, t in rows if i == 5}) == 1  # one id, one draw
    tokens = got["token_files"].collect()
    assert collections.Counter(r.doc_id for r in tokens) == collections.Counter(i for i, _ in rows)
    assert sorted(r.start for r in tokens) == [sum(sorted_n[:k]) for sorted_n in [[r.n_tokens for r in sorted(tokens, key=lambda r: r.start)]] for k in range(len(tokens))]
    assert rows_of([]) == [] and key((None, 1)) < key((1, 1))
