"""Licence scan: TF-IDF cosine of licence statements to templates, then inheritance by nearest ancestor directory.

DataFrame functions only. The terms are the templates' words; their document
frequencies are counted over all texts. A text's units are its lines, its sentences
(for notices within a long line) and each two lines that follow one another (for
headers that are wrapped). A unit is a sparse vector of its terms, and all its other
words weigh as words of one document, so a unit of other matter isn't near a template.
Each template's heaviest words are its anchors: so many that the others alone can't
reach the cosine asked for. Texts and units without any anchor are left out, which
changes no result.

A document whose best unit reaches COSINE has that licence itself; one that only
reserves all rights counts as such if it states no other licence. If its licence
lines hold FILE_SHARE of its words, it is a licence file and gives its licence to its
directory. A document without its own licence takes that of the nearest directory
above it that has one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_spread, written

COSINE, FILE_SHARE = 0.6, 0.3
#: Fixed value: the name of a bare reservation of rights.
RESERVED = "Proprietary"

#: Short wordings of well-known licences, headers first.
TEMPLATES = [
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the license"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("BSD-3-Clause", "use of this source code is governed by a bsd style license"),
    ("CC-BY-4.0", "this work is licensed under the creative commons attribution license version 4.0 international"),
    ("CC-BY-SA-4.0", "this work is licensed under the creative commons attribution sharealike license version 4.0 international"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("MIT", "released under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license version 2.0"),
    ("Apache-2.0", "spdx license identifier apache 2.0"),
    ("BSD-3-Clause", "spdx license identifier bsd 3 clause"),
    ("CC-BY-4.0", "licensed under cc by 4.0"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4.0"),
    ("CC-BY-NC-4.0", "this work is licensed under the creative commons attribution noncommercial license version 4.0 international"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4.0"),
    ("GPL-3.0", "spdx license identifier gpl 3.0"),
    ("MIT", "spdx license identifier mit"),
    ("MIT", "licensed under the mit license"),
    ("MPL-2.0", "spdx license identifier mpl 2.0"),
    ("Proprietary", "all rights reserved"),
    ("Proprietary", "copyright all rights reserved no part may be reproduced without permission"),
]


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _template_words() -> list[str]:
    return sorted({w for _, t in TEMPLATES for w in t.replace(".", " ").split()})


def weights(docs: DataFrame) -> tuple[dict[str, float], float]:
    """idf of each template word over all texts, and that of any other word."""
    vocab = F.array(*[F.lit(w) for w in _template_words()])
    each = docs.select(F.explode(F.array_intersect(terms(F.col("text")), vocab)).alias("w"))
    # One row a template word.
    df = {r["w"]: r["n"] for r in each.groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = docs.count()
    idf = lambda k: math.log((n + 1) / (k + 1)) + 1
    return {w: idf(df.get(w, 0)) for w in _template_words()}, idf(1)


def _vectors(idf: dict[str, float]) -> list[tuple[int, str, str, float]]:
    """(template, licence, word, weight) with weights of unit norm for each template."""
    out = []
    for k, (name, text) in enumerate(TEMPLATES):
        tf: dict[str, int] = {}
        for w in text.replace(".", " ").split():
            tf[w] = tf.get(w, 0) + 1
        norm = math.sqrt(sum((c * idf[w]) ** 2 for w, c in tf.items()))
        out += [(k, name, w, c * idf[w] / norm) for w, c in tf.items()]
    return out


def anchors(vectors: list[tuple[int, str, str, float]], cosine: float) -> list[str]:
    """Words such that a line without any of them has a cosine under `cosine` with every template."""
    out: set[str] = set()
    for k in {v[0] for v in vectors}:
        rest = 1.0
        for x, w in sorted(((x, w) for i, _, w, x in vectors if i == k), reverse=True):
            if math.sqrt(max(rest, 0.0)) < cosine - 1e-6:
                break
            out.add(w)
            rest -= x * x
    return sorted(out)


def units(docs: DataFrame, words: list[str]) -> DataFrame:
    """`docs` (key, text) with line, lines (1 or 2) and t: the units that hold one of the words."""
    has = lambda c: F.lower(c).rlike(f"(?<![\\p{{L}}\\p{{N}}])(?:{'|'.join(words)})(?![\\p{{L}}\\p{{N}}])")
    at = docs.where(has(F.col("text"))).select("key", F.split("text", "\n", -1).alias("ls"))
    one = "transform(ls, (x, i) -> struct(i AS line, 1 AS lines, x AS t))"
    two = "transform(slice(ls, 2, greatest(size(ls) - 1, 0)), (x, i) -> struct(i AS line, 2 AS lines, concat(ls[i], ' ', x) AS t))"
    parts = "flatten(transform(ls, (x, i) -> transform(split(x, '(?<=[.!?;])\\\\s+'), y -> struct(i AS line, 1 AS lines, y AS t))))"
    return at.select("key", F.expr(f"inline(array_distinct(concat({one}, {two}, {parts})))")).where(has(F.col("t")))


def lines(docs: DataFrame, cosine: float = COSINE) -> DataFrame:
    """key, line, lines, n (the unit's words), license, cosine: the units of `docs` (key, text) that reach a template, with their nearest."""
    idf, other = weights(docs)
    vectors = _vectors(idf)
    unit = written(units(docs, anchors(vectors, cosine)), "license-units")
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("license"), F.lit(w).alias("w"), F.lit(x).alias("x")) for k, n, w, x in vectors])
    table = docs.sparkSession.range(1).select(F.inline(rows))
    known = F.map_from_arrays(F.array(*[F.lit(w) for w in idf]), F.array(*[F.lit(x) for x in idf.values()]))
    # Copies of a unit are scored once.
    once = unit.groupBy("t").agg(F.count("*").alias("copies")).select("t", terms(F.col("t")).alias("ws"))
    once = once.select("t", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    tf = once.groupBy("t", "n", "w").agg(F.count("*").alias("c"))
    tf = tf.withColumn("y", F.col("c") * F.coalesce(F.element_at(known, F.col("w")), F.lit(other)))
    norm = tf.groupBy("t", "n").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
    # The table has a fixed number of rows.
    dot = tf.join(F.broadcast(table), "w").groupBy("t", "k", "license").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    near = dot.join(norm, "t").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= cosine)
    best = near.groupBy("t", "n").agg(F.max(F.struct("cosine", (-F.col("k")).alias("k"), "license")).alias("b"))
    return join_spread(unit, best, "t").select("key", "line", "lines", "n", "b.license", "b.cosine")


def path_of() -> Column:
    """Directories for tables without a path: /source/lang/doc_id div 1000/doc_id div 10."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    number = lambda k: F.coalesce(F.expr(f"doc_id div {k}").cast("string"), F.lit("_"))
    return F.concat_ws("/", F.lit(""), part("source"), part("lang"), number(1000), number(10), F.coalesce(F.col("doc_id").cast("string"), F.lit("_")))


def scan(docs: DataFrame, path: Column | None = None, cosine: float = COSINE) -> DataFrame:
    """doc_id, path, license, cosine, origin (own, inherited or null), license_dir of each row.

    Null and empty texts have no licence of their own; null source, lang or doc_id give
    the path part "_". Equal cosines go to the earlier template; of several licence
    files in a directory the one with the greatest cosine counts, then the least doc_id.
    Repeated rows get equal results, and rows with a null doc_id are scanned like any other.
    """
    paths = docs.select("doc_id", "text", (path if path is not None else path_of()).alias("path"))
    # Equal rows have one key, so that they stand for one another, whatever their doc_id.
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("path").isNull(), "path", F.col("text").isNull(), "text")
    paths = paths.withColumn("key", key)
    here = F.regexp_replace("path", "/[^/]*$", "")
    found = written(lines(paths.select("key", "text"), cosine), "license-lines")
    # The words of each line that takes part in a statement, once.
    held = found.groupBy("key", "line", "lines").agg(F.max("n").alias("n")).groupBy("key").agg(
        F.sum(F.when(F.col("lines") == 1, F.col("n"))).alias("single"), F.max(F.when(F.col("lines") == 2, F.col("n"))).alias("double")
    )
    order = F.struct((F.col("license") != RESERVED).alias("stated"), "cosine", (-F.col("line")).alias("l"), (-F.col("lines")).alias("m"), "license")
    own = found.groupBy("key").agg(F.max(order).alias("b")).join(held, "key").select(
        "key", F.col("b.license").alias("own"), F.col("b.cosine").alias("own_cosine"),
        F.greatest(F.coalesce("single", F.lit(0)), F.coalesce("double", F.lit(0))).alias("matched"),
    )
    # Only documents with a licence line are joined by their rows; the texts aren't shuffled.
    rows = paths.select("doc_id", "path", "key", here.alias("dir"), F.size(terms(F.col("text"))).alias("words")).join(own, "key", "left")
    files = rows.where(F.col("matched") >= FILE_SHARE * F.col("words"))
    given = files.groupBy("dir").agg(F.max(F.struct("own_cosine", (-F.col("doc_id")).alias("d"), F.col("own").alias("license"))).alias("g"))
    given = given.select(F.col("dir").alias("above"), F.col("g.license").alias("dir_license"))
    # Each directory's ancestors, itself included, by their depth.
    steps = F.split("dir", "/")
    up = rows.select("dir").distinct().select("dir", F.explode(F.sequence(F.lit(1), F.size(steps))).alias("depth"))
    up = up.withColumn("above", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    nearest = up.join(given, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_license")).alias("n"))
    nearest = nearest.select("dir", F.col("n.above").alias("above"), F.col("n.dir_license").alias("dir_license"))
    out = rows.join(nearest, "dir", "left")
    return out.select(
        "doc_id", "path", F.coalesce("own", "dir_license").alias("license"), F.col("own_cosine").alias("cosine"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("own").isNull(), F.col("above")).alias("license_dir"),
    )
