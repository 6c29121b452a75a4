"""Quality rules: counts by brute force, the chain against all paths, its gradient, and held-out documents."""

import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloudloom.llm import quality
from cloudloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\r\x0b\x1c\x85\xa0é|#😀", max_size=60))
def test_counts(text):
    assert quality.base_counts(text) == brute_counts(text)


def test_counts_of_many_different_words():
    words = [f"w{i}" for i in range(1 << 20)] + ["w5", "w6", "w7", "w8"]
    assert quality.base_counts(" ".join(words))[4] == 8


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(5)
    for n in range(7):
        f = quality.Field(rng.normal(size=(2, 13)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, 13))
        e = x @ f.emit.T
        value = lambda y: e[np.arange(n), list(y)].sum() + sum(f.move[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert tuple(f.viterbi(x)) == best


def test_gradient_and_likelihood_by_all_paths():
    rng = np.random.default_rng(1)
    x, y, ends, w = rng.normal(size=(9, 13)), rng.integers(0, 2, 9), np.array([4, 5, 9]), rng.normal(size=30)
    at = lambda w: quality.loss(w[:26].reshape(2, 13), w[26:].reshape(2, 2), x, y, ends)
    value, g_emit, g_move = at(w)
    steps = 1e-5 * np.eye(30)
    assert np.allclose([(at(w + s)[0] - at(w - s)[0]) / 2e-5 for s in steps], np.r_[g_emit.ravel(), g_move.ravel()], atol=1e-6)
    e, move, want = x @ w[:26].reshape(2, 13).T, w[26:].reshape(2, 2), 0.0
    for a, b in ((0, 4), (4, 5), (5, 9)):
        score = lambda p: e[np.arange(a, b), list(p)].sum() + sum(move[i, j] for i, j in zip(p, p[1:], strict=False))  # noqa: E731, B023
        want += np.log(sum(np.exp(score(p)) for p in itertools.product((0, 1), repeat=b - a))) - score(y[a:b].tolist())
    assert abs(value - want) < 1e-9


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    field = quality.train(docs, labels.where(~out))
    rows = quality.judge(docs, field).join(labels.where(out), "doc_id").where("NOT base_failed").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in rows) >= 0.97 * len(rows) and {r["quality"] for r in rows} == {0, 1}
    good = [r for r in rows if r["quality"]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)


def test_boilerplate_between_content(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    field = quality.train(docs, labels)
    line = "The quiet river ran past the old mill, and the children of the village walked along it every morning before school."
    menu = " | ".join(["Home", "News", "Shop", "About", "Contact", "Login", "Cart", "Help"]) * 2
    lines = [line, line[4:], menu, menu[3:], line[10:]]
    assert list(field.viterbi(quality.line_features("\n".join(lines))[0])) == [0, 0, 1, 1, 0]


def test_whole_table_and_odd_rows(spark):
    got = QUERIES["op13_quality"](spark, SF)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = {r["doc_id"]: tuple(r)[1:] for r in got.collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500").collect()}
    for k, t in texts.items():
        want = brute_counts(t)
        assert rows[k][:5] == want and rows[k][5] == (want[0] < 50 or 2 * want[4] > want[0]) and not (rows[k][5] and rows[k][6])
    schema = "doc_id long, text string, kept string, n_words string"
    long = "A line of plain words that goes on for a while, as they do.\n" * 9 + " ".join(f"word{i}" for i in range(200_000)) + "."
    odd = spark.createDataFrame([(1, None, "x", "y"), (None, "", "x", "y"), (2, " \n\t\n", None, None), (3, long, "x", "y"), (3, long, "x", "y")], schema)
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (None, 0), (2, None)], "doc_id long, quality int")
    field = quality.train(odd, labels)
    out = [tuple(r) for r in quality.judge(odd, field).collect()]
    assert sorted(r[6] for r in out) == [False, False, True, True, True] and len({r for r in out if r[0] == 3}) == 1
    assert quality.judge(odd.limit(0), quality.train(odd.limit(0), labels)).count() == 0
