"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cloudloom.llm import ann, chat, decontaminate, licenses, line_dedup, lm_score, packing, simhash, toxicity, zstd_ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, k string, score string, start string, keeper string, cell string"
LONG = "alpha beta gamma delta\n" * 3000
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "one line of text that is long enough", "en", "a", 1), (3, "one line of text that is long enough", "en", "a", 1),
    (4, LONG, "en", "b", 2), (None, "a null id and a few words of text", "en", None, 3), (5, " \n\t\n", "en", "b", 4), (6, "Licensed under the Apache License, Version 2.0.", "en", "a", 5),
]
MORE = ("x",) * 6


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *MORE) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, None), (4, None, 1), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "one line of text that is long enough"), (None, "x y z")], "item_id long, text string")


def test_lines(docs, none):
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in line_dedup.digest(docs).collect()}
    assert (1, 1, 0) in got and (2, 1, 0) in got and (4, 3001, 0) in got and (5, 3, 0) in got
    assert line_dedup.digest(docs).count() == len(ROWS)
    assert line_dedup.digest(none).count() == 0
    kept = {r["doc_id"]: r["kept_sha256"] for r in line_dedup.digest(docs).collect()}
    assert kept[1] == kept[2] == hashlib.sha256(b"").hexdigest()
    assert kept[4] == hashlib.sha256(LONG.encode()).hexdigest()


def test_simhash(docs, none):
    got = [tuple(r) for r in simhash.digest(docs).collect()]
    assert len(got) == len(ROWS)
    assert {r[2] for r in got if r[0] in (1, 2, 5)} == {1} and {r[1] for r in got if r[0] == 1} == {"0" * 16}
    assert {r[2] for r in got if r[0] == 3} == {3}
    assert simhash.digest(none).count() == 0
    assert simhash.dedup(docs).columns == docs.columns


def test_toxicity(docs, none, labels):
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns


def test_packing(docs, none):
    got = packing.digest(docs).collect()
    assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
    assert [r["length"] for r in got if r["doc_id"] in (1, 2)] == [1, 1]
    assert packing.digest(none).count() == 0


def test_ids(docs, none):
    got = sorted(zstd_ids.digest(docs).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 4, 5, 6]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    assert zstd_ids.digest(none).count() == 0


def test_decontaminate(docs, none, items, spark):
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, items).collect()}
    assert got == {(3, 3)}
    assert decontaminate.find(none, items).count() == 0
    assert decontaminate.find(docs, items.limit(0)).count() == 0
    assert decontaminate.drop_leaks(docs, items).columns[0] == "doc_id"


def test_lm(docs, none, labels):
    got = lm_score.score(docs, labels).collect()
    assert len(got) == len(ROWS)
    assert all((r["score"] is None) == (r["n_tokens"] == 0) for r in got)
    assert lm_score.score(none, labels).count() == 0


def test_licenses(docs, none):
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.scan(docs).collect()}
    assert got[6] == ("Apache-2.0", "own") and got[3] == ("Apache-2.0", "inherited") and got[4] == (None, None) and got[1] == (None, None)
    assert licenses.scan(docs).count() == len(ROWS)
    assert licenses.scan(none).count() == 0


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 0.0]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (8, []), (20, [1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (6, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("x")).withColumn("v", F.lit(1))
    got = sorted(tuple(r) for r in ann.nearest(v).collect())
    assert got == [(0, 1, 6, 1.0), (0, 2, 20, 1.0), (0, 3, 7, 0.5), (20, 1, 0, 1.0), (20, 2, 6, 1.0), (20, 3, 7, 0.5)]
    assert ann.nearest(v.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "Hello there"), (1, 1, "assistant", None), (1, 1, "assistant", "Same turn"), (None, 0, None, "no id"), (2, None, "system", "a\nb"), (2, None, "system", "a\nb"), (3, 5, "user", "")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)).withColumn("block", F.lit("b"))
    got = chat.parse(c).collect()
    assert sum(r["n_lines"] for r in got) == chat.transcripts(c).count()
    assert all(r["rendered"].startswith("<|") and r["rendered"].endswith("<|end|>") for r in got)
    assert chat.parse(c.limit(0)).count() == 0


def duck(docs, sql):
    import duckdb

    documents = docs.toPandas()  # noqa: F841  read by the SQL
    return {tuple(r) for r in duckdb.sql(sql).fetchall()}


def test_lines_of_repeated_rows(spark):
    line = "a line that is long enough to count"
    runs = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")}
    before = runs()
    for rows in ([(1, line), (2, line), (2, line)], [(1, line), (2, line + "\nmore of the second text"), (2, line), (3, line)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {(r["doc_id"], r["n_dropped"]) for r in line_dedup.digest(docs).collect()}
        assert got == {(d, 0 if d == max(d for d, _ in rows) or len(rows) == 3 else 1) for d, _ in rows}
    docs = spark.createDataFrame([(i, f"{line}\n{i % 3} is a line of some of them, long too") for i in range(12)], "doc_id long, text string")
    assert {tuple(r) for r in line_dedup.digest(docs).collect()} == duck(docs, line_dedup.SQL)
    assert runs() == before


def test_hot_lines(spark):
    rows = [(i, "the line that nearly all documents have" + (f"\nand this line of group {i % 40} of them" if i % 2 else "")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in line_dedup.digest(docs).collect()} == duck(docs, line_dedup.SQL)


def test_licenses_of_odd_rows(spark):
    words = "many other words of this text " * 8
    rows = [
        (None, "/a/x", "Released under the MIT license"), (1, "/b/LICENSE", f"Released under the MIT license\n{words}"), (1, "/b/LICENSE", f"Released under the MIT license\n{words}"),
        (2, "/b/y", words), (3, "/c/z", f"{words}. Licensed under CC BY-NC 4.0. {words}"), (4, "/c/v", "Licensed under the\nApache License,\nVersion 2.0."),
        (5, "/d/u", "Copyright 2020 A. B.\nAll rights reserved.\nReleased under the MIT License."), (6, "/e/t", "All rights reserved."), (7, "/c/s", words), (8, None, words),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = [(r["doc_id"], r["license"], r["origin"]) for r in licenses.scan(docs, F.col("path")).collect()]
    assert sorted(got, key=str) == sorted([
        (None, "MIT", "own"), (1, "MIT", "own"), (1, "MIT", "own"), (2, None, None), (3, "CC-BY-NC-4.0", "own"), (4, "Apache-2.0", "own"),
        (5, "MIT", "own"), (6, "Proprietary", "own"), (7, "Apache-2.0", "inherited"), (8, None, None),
    ], key=str)
