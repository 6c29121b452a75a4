"""The pipeline's stages against brute force, each on what its predecessor kept."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(Path(__file__).resolve().parent)]

import corpus_pipeline as p  # noqa: E402
from test_methods import brute_lines, brute_shingles, brute_similar, library  # noqa: E402

from cloudloom.llm import decontaminate, toxicity  # noqa: E402
from cloudloom.llm.shared import written  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The input and what each stage returns, as rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in p.STAGES:
        out.append(written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_return_documents(kept):
    for df in kept[:-1]:
        assert df.columns == p.COLUMNS
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_toxic_documents_go(spark, kept):
    before, after = texts(kept[0]), texts(kept[1])
    model = toxicity.train(kept[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(after) == {d for d, t in before.items() if model.score(toxicity.features(t)) < 0.5}
    assert all(before[d] == t for d, t in after.items())


def test_repeated_lines_go(kept):
    before, after = texts(kept[1]), texts(kept[2])
    gone = brute_lines([(d, t, None) for d, t in before.items()])
    assert after == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(gone[d])) for d, t in before.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in kept[2].collect())


def test_one_of_each_group_stays(kept):
    before, after = texts(kept[2]), texts(kept[3])
    sets = {d: brute_shingles(t, 5) for d, t in before.items()}
    assert set(after) == {d for d, root in brute_similar(sets, 0.8).items() if d == root}


def test_benchmark_passages_go(spark, kept):
    before, after = texts(kept[3]), texts(kept[4])
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, t in before.items() if any(i in t for i in items)}
    assert leaks and not leaks & set(after)
    found = {r["doc_id"] for r in decontaminate.find(kept[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(before) - set(after) == found and len(found) <= len(leaks) + 2


def test_all_tokens_are_packed(kept):
    lib = library("word_bpe_49k.json")
    want = {d: len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts(kept[4]).items()}
    got = {}
    for r in kept[5].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty texts, repeated rows, an empty table and clashing columns: no stage crashes or loses a clean row."""
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "a clean text of some words", None, "a", 1), (2, "a clean text of some words", None, "a", 1), (None, "another text, without an id", "en", None, 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", *[f"'x' AS {c}" for c in ("codes", "id", "h", "label", "n_lines", "role")])
    for name, stage in p.STAGES:
        got = stage(spark, docs, SF)
        ids = {r["doc_id"] for r in got.collect()}
        assert ids == {None, 1, 2}, name
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run(spark, kept):
    assert p.run(spark, SF).count() > 0
