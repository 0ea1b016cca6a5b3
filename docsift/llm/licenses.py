"""Operator 4: licence scan with SQL functions only.

1. Headers: the lines of a file that hold a licence word; of a licence file (by its name) also the
   whole text. Their terms are runs of ``[a-z0-9.]``, without dots at the ends.
2. Each header and each template is a sparse TF-IDF vector: (1 + ln tf) * idf, with
   idf = ln((1 + N) / (1 + df)) + 1 over the N headers of all files and the templates. Only the
   templates' terms (fixed, a few hundred) need a count; a term that no template has weighs as one
   of df 0, which lengthens the vector. So counts are a partial aggregate of at most that many rows,
   and the vectors need no shuffle.
3. The best template by cosine is the file's licence if it reaches ``LEAST``; ties go to the
   name that sorts first.
4. A file with a licence word, but no licence so far, is compared in pieces: windows of ``WINDOW``
   terms, of a licence file all, else those with a licence word, against windows of the licence
   texts and standard headers in ``license_texts``. If none fits, its lines with a licence word, one
   by one, with the identifier lines and sentences of ``LINES``, at ``LINE_LEAST``: more than lines can
   reach that agree but for the licence's name. A piece counts for a licence with its best
   cosine, if that reaches the least; the licence with the largest sum is the file's.
5. A licence file's result belongs to its directory. Every directory is joined with its ancestors'
   licences; the nearest one holds for the files without a header of their own. Directories are
   joined, not files; files then join their directory's row, where AQE splits or broadcasts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, written
from .license_texts import TEXTS
from .spans import quoted

LEAST, LINE_LEAST = 0.5, 0.8
CUE = r"(?i)licen[cs]e|copyright|spdx|redistribut|warrant|permission is hereby|all rights reserved"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)[^/]*$"
TERM = "[a-z0-9.]+"
WINDOW, STEP, TEXT_STEP = 48, 24, 12  # terms of a window, and from one to the next in files and in licence texts

# Notices by which works are put under well-known licences (fixed values).
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License. Redistribution and use in source and binary forms are permitted.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms are permitted; the names of contributors may not endorse products.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License. Permission to use, copy, modify and distribute this software is hereby granted.",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Unlicense.",
}

# SPDX identifiers and names in running text (fixed values).
IDENTIFIERS = {
    "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], "Apache-2.0": ["Apache-2.0"], "BSD-2-Clause": ["BSD-2-Clause"],
    "BSD-3-Clause": ["BSD-3-Clause"], "CC-BY-4.0": ["CC-BY-4.0"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"], "CC-BY-SA-4.0": ["CC-BY-SA-4.0"],
    "CC0-1.0": ["CC0-1.0"], "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"], "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "ISC": ["ISC"], "LGPL-2.1": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"], "LGPL-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "MIT": ["MIT"], "MPL-2.0": ["MPL-2.0"], "Unlicense": ["Unlicense"],
}
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3"], "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0 License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution NonCommercial 4.0 International License", "CC BY-NC 4.0 License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution ShareAlike 4.0 International License", "CC BY-SA 4.0 License"], "CC0-1.0": ["CC0 1.0 Universal License"],
    "GPL-2.0": ["GNU General Public License v2.0", "GNU GPL v2", "GPLv2"], "GPL-3.0": ["GNU General Public License v3.0", "GNU GPL v3", "GPLv3"], "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPLv2.1"], "LGPL-3.0": ["GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPLv3"], "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License Version 2.0"], "Unlicense": ["Unlicense"],
}
# Columns that the steps add.
WORKING = ("own", "is_file", "parts", "lines", "windows", "ends", "bags", "cosines", "best", "license", "via", "score")
SENTENCES = ("This project is licensed under the {} - see the LICENSE file for details.", "Licensed under the {}.", "License: {}")
LINES = {
    name: [f"SPDX-License-Identifier: {i}" for i in IDENTIFIERS[name]] + [t.format(n) for n in NAMES[name] for t in SENTENCES]
    for name in IDENTIFIERS
}


def _terms(text: str) -> str:
    """SQL for the array of terms of a text."""
    return f"filter(transform(regexp_extract_all(lower({text}), '{TERM}', 0), t -> trim('.' from t)), t -> t <> '')"


def _vectors(spark, templates: dict[str, str]) -> dict[str, dict[str, int]]:
    """Term counts of the templates, made by the same expression."""
    rows = spark.createDataFrame(list(templates.items()), "name string, notice string")
    out = {}
    for r in rows.select("name", F.expr(_terms("notice")).alias("terms")).collect():
        out[r["name"]] = {t: r["terms"].count(t) for t in r["terms"]}
    return out


def headers(files: DataFrame) -> DataFrame:
    """``files (path, text, ...)`` without the text, with ``is_file`` (a licence file by name),
    ``parts``: the terms of its header, if it has one, and of a licence file's whole text,
    ``lines``: those of its lines with a licence word, and ``windows``: the pieces of it to compare
    with licence texts."""
    text, cue = "coalesce(text, '')", quoted(CUE)
    lines = f"array_join(filter(split({text}, '\\n'), l -> l rlike {cue}), '\n')"
    parts = f"concat(CASE WHEN {text} rlike {cue} THEN array({lines}) ELSE array() END, IF(is_file, array({text}), array()))"
    windows = f"transform(sequence(0, cast(ceil(greatest(size(windows) - {WINDOW}, 0) / {STEP}) as int)), i -> slice(windows, i * {STEP} + 1, {WINDOW}))"
    return (
        files.withColumn("is_file", F.expr(f"coalesce(path, '') rlike {quoted(FILE_NAME)}"))
        .withColumn("parts", F.expr(f"filter(transform({parts}, p -> array_sort({_terms('p')})), p -> size(p) > 0)"))
        .withColumn("lines", F.expr(f"filter(transform(filter(split({text}, '\\n'), l -> l rlike {cue}), l -> {_terms('l')}), t -> size(t) BETWEEN 1 AND {WINDOW})"))
        .withColumn("windows", F.expr(f"CASE WHEN is_file OR {text} rlike {cue} THEN {_terms(text)} ELSE array() END"))
        .withColumn("windows", F.expr(f"filter({windows}, w -> size(w) > 0 AND (is_file OR array_join(w, ' ') rlike {cue}))"))
        .drop("text")
    )


def _text_windows(spark, texts: dict[str, list[str]]) -> DataFrame:
    """``(term, idf, hits)``: each term of the licence texts, and the windows of them that it is in,
    with the licence's name and the term's part of the unit vector."""
    rows = spark.createDataFrame([(k, t) for k, found in texts.items() for t in found], "name string, notice string")
    pieces = []
    for r in rows.select("name", F.expr(_terms("notice")).alias("terms")).collect():
        last = max(0, len(r["terms"]) - WINDOW + TEXT_STEP - 1) // TEXT_STEP
        pieces += [(r["name"], r["terms"][i * TEXT_STEP : i * TEXT_STEP + WINDOW]) for i in range(last + 1)]
    names: dict[str, set[str]] = {}
    for name, terms in pieces:
        for t in terms:
            names.setdefault(t, set()).add(name)
    idf = {t: math.log((1 + len(texts)) / (1 + len(n))) + 1 for t, n in names.items()}
    hits: dict[str, list] = {t: [] for t in names}
    for i, (name, terms) in enumerate(pieces):
        w = {t: (1 + math.log(terms.count(t))) * idf[t] for t in set(terms)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            hits[t].append((i, name, x / norm))
    return spark.createDataFrame(
        [(t, idf[t], hits[t]) for t in sorted(hits)], "term string, idf double, hits array<struct<piece: int, name: string, w: double>>"
    )


def match_texts(found: DataFrame, texts: dict[str, list[str]], least: float = LEAST) -> DataFrame:
    """``(at, own, score)`` of the rows of ``found (row, windows)`` whose windows resemble a licence
    text. Terms that no text has weigh 1, the least. The texts' windows, a row a term, are broadcast
    by Spark if they are small enough."""
    known = _text_windows(found.sparkSession, texts)
    bag = "transform(array_distinct(w), t -> named_struct('term', t, 'tf', 1 + ln(size(filter(w, x -> x = t)))))"
    each = found.select("row", F.posexplode("windows").alias("k", "w")).select("row", "k", F.inline(F.expr(bag)))
    each = each.join(known, "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    norms = each.groupBy("row", "k").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = each.select("row", "k", "x", F.inline("hits")).groupBy("row", "k", "piece", "name").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    dots = dots.groupBy("row", "k", "name").agg(F.max("dot").alias("dot"))
    near = dots.join(norms, ["row", "k"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= least)
    sums = near.groupBy("row", "name").agg(F.round(F.sum("cosine"), 4).alias("sum"), F.max("cosine").alias("best"))
    return sums.groupBy("row").agg(F.min(F.struct((-F.col("sum")).alias("s"), "name", "best")).alias("b")).select(
        F.col("row").alias("at"), F.col("b.name").alias("own"), F.col("b.best").alias("score")
    )


def match_templates(files: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST,
                    texts: dict[str, list[str]] | None = None, lines: dict[str, list[str]] | None = None) -> DataFrame:
    """``files (path, text, ...)`` without its text, with ``is_file``, ``own`` (name of the best
    template, else of the best licence text, or null) and ``score`` (its cosine, 0 without a header).
    With templates of one's own, only ``texts`` and ``lines`` that are given are compared."""
    texts = (TEXTS if templates is None else {}) if texts is None else texts
    lines = (LINES if templates is None else {}) if lines is None else lines
    row = free_name("__row", [*files.columns, *WORKING])
    vectors = _vectors(files.sparkSession, TEMPLATES if templates is None else templates)
    found = checkpointed(headers(files).withColumn(row, F.monotonically_increasing_id()))  # narrow; texts are read once
    known = sorted({t for v in vectors.values() for t in v})
    part = found.select(F.explode("parts").alias("terms"))
    term = part.select(F.explode(F.array_distinct("terms")).alias("term")).where(F.col("term").isin(known))
    df = {r["term"]: r["n"] for r in term.groupBy("term").agg(F.count("*").alias("n")).collect()}  # at most the templates' terms
    n = part.count() + len(vectors)
    for v in vectors.values():
        for t in v:
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in known}
    rare = f"{math.log(1 + n) + 1!r}D"
    table = lambda w: "map(" + ", ".join(f"'{t}', {x!r}D" for t, x in sorted(w.items())) + ")"
    # counts of sorted terms: the places where runs of equal terms end
    ends = (
        "transform(parts, p -> filter(transform(p, (t, i) -> named_struct('t', t, 'i', i + 1, "
        "'last', i = size(p) - 1 OR get(p, i + 1) <> t)), x -> x.last))"
    )
    bags = (
        "transform(ends, p -> transform(p, (x, j) -> named_struct('t', x.t, "
        f"'w', (1 + ln(x.i - IF(j = 0, 0, get(p, j - 1).i))) * coalesce(try_element_at({table(idf)}, x.t), {rare}))))"
    )
    dots = []
    for name in sorted(vectors):
        w = {t: (1 + math.log(c)) * idf[t] for t, c in vectors[name].items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        unit = table({t: x / norm for t, x in w.items()})
        dots.append(f"named_struct('score', aggregate(p, 0D, (a, x) -> a + x.w * coalesce(try_element_at({unit}, x.t), 0D)), 'name', '{name}')")
    cosines = (
        f"flatten(transform(bags, p -> transform(array({', '.join(dots)}), "
        "d -> named_struct('score', round(d.score / sqrt(aggregate(p, 0D, (a, x) -> a + x.w * x.w)), 6), 'name', d.name))))"
    )
    best = "aggregate(cosines, named_struct('score', 0D, 'name', ''), (a, d) -> IF(d.score > a.score OR (d.score = a.score AND d.name < a.name), d, a))"
    scored = found
    for name, step in (("ends", ends), ("bags", bags), ("cosines", cosines), ("best", best)):
        scored = scored.withColumn(name, F.expr(step))
    scored = (
        scored.withColumn("score", F.col("best.score"))
        .withColumn("own", F.when(F.col("score") >= least, F.col("best.name")))
        .drop("parts", "ends", "bags", "cosines", "best")
    )
    for given, pieces, enough in ((texts, "windows", least), (lines, "lines", LINE_LEAST)):
        if given:
            scored = checkpointed(scored)
            open_ = scored.where(f"own is null and size({pieces}) > 0").select(F.col(row).alias("row"), F.col(pieces).alias("windows"))
            more = written(match_texts(open_, given, enough), "texts")[0]
            at, own, score = (free_name(f"__{c}", [*files.columns, *WORKING]) for c in ("at", "own", "score"))
            more = more.select(F.col("at").alias(at), F.col("own").alias(own), F.col("score").alias(score))
            scored = (
                scored.join(more, F.col(row) == F.col(at), "left")
                .withColumn("score", F.coalesce(score, "score")).withColumn("own", F.coalesce("own", own)).drop(at, own, score)
            )
    return scored.drop("windows", "lines", row)


def scan_licenses(files: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """``files (path, text, ...)``, a row each, without the text: with ``license`` (or null),
    ``via`` (header, file, inherited or none) and ``score`` (cosine of the file's own header).

    Paths are separated by /; a file at the top has the directory ''. A licence file covers its
    directory and all below it, if no nearer one does; of several in a directory the best score
    counts, then the first name. A null path has no directory and inherits nothing; a null text is
    empty. Repeated rows get equal results. Other columns are kept; those named like a result
    (license, via, score) are replaced, like a working column (own, is_file, parts, lines, windows, ends,
    bags, cosines, best) left out. An empty table gives no rows. A very long text is one task's work;
    its windows are rows from there on."""
    taken = [*files.columns, *WORKING]
    directory, at, inherited = (free_name(f"__{n}", taken) for n in ("dir", "at", "inherited"))
    own = match_templates(files, templates, least).withColumn(
        directory, F.expr("CASE WHEN path IS NULL THEN NULL WHEN instr(path, '/') = 0 THEN '' ELSE regexp_replace(path, '/[^/]*$', '') END")
    )
    own = checkpointed(own)
    given = (
        own.where(f"is_file and own is not null and {directory} is not null").groupBy(directory)
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "own")).alias("b")).select(F.col(directory).alias("above"), F.col("b.own").alias("given"))
    )
    ancestors = F.expr(
        f"CASE WHEN {directory} = '' THEN array('') ELSE concat(array(''), transform(sequence(1, size(split({directory}, '/'))), "
        f"i -> array_join(slice(split({directory}, '/'), 1, i), '/'))) END"
    )
    near = (
        own.select(directory).where(f"{directory} is not null").distinct().select(directory, F.posexplode(ancestors).alias("depth", "above"))
        .join(given, "above").groupBy(directory).agg(F.max_by("given", "depth").alias(inherited))
    )
    near = written(near.withColumnRenamed(directory, at), "directories")[0]
    out = own.join(near, F.col(directory) == F.col(at), "left")
    via = F.expr(f"CASE WHEN own IS NOT NULL AND is_file THEN 'file' WHEN own IS NOT NULL THEN 'header' WHEN {inherited} IS NOT NULL THEN 'inherited' ELSE 'none' END")
    return out.withColumn("license", F.coalesce("own", inherited)).withColumn("via", via).drop(directory, at, "own", inherited, "is_file")
