"""Divergence of sources against a brute-force version in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from cloudloom.llm import divergence
from cloudloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, term string, value long, p long, k int"
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, min_docs=3, most=200):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        docs[lang or ""].update(set(terms))
        counts[lang or "", source or ""].update(terms)
    out = []
    for (lang, source), c in counts.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        whole = Counter()
        for (other, _), x in counts.items():
            if other == lang:
                whole.update(x)
        share = lambda x, t, kept=kept: 1 + 10**9 * (x[t] + 1) // (sum(x[k] for k in kept) + len(kept))
        p = {t: share(c, t) for t in kept}
        pairs = []
        for (other, s), x in counts.items():
            if other == lang and s != source:
                q = {t: share(x, t) for t in kept}
                pairs.append((sum((p[t] - q[t]) ** 2 // q[t] for t in kept), s))
        q = {t: share(whole, t) for t in kept}
        terms = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if c[t] and p[t] > q[t]]
        for part, found, end in (("pair", pairs, None), ("term", terms, most)):
            found.sort(key=lambda r: (-r[0], r[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found[:end])]
    return sorted(out)


def invented(n):
    rng = random.Random(4)
    words = ["alpha", "Beta", "ÄRGER", "ärger", "naïve", "日本", "x", "don't", "İ", "ZZ9zz", "\x80", "é_é", "😀", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(6))]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 30)))])
        rows.append((text, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "Ä", "z", None, "", f"s{i % 7}"])))
    rows += [("only here, rare", "tlh", "a"), ("nothing shared", "tlh", "b"), (None, "tlh", "c"), ("alone", "one", "one")]
    return rows + [("copy of the same row " * 3, "en", "hot")] * 40


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1, 2, 3) for i, r in enumerate(rows)], SCHEMA)


def found(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def test_invented_rows(spark, monkeypatch):
    rows = invented(150)
    df = frame(spark, rows).repartition(5)
    want = brute(rows, most=7)
    assert found(divergence.audit(df, most_terms=7)) == want
    monkeypatch.setattr(divergence, "SAMPLE", 1)
    assert found(divergence.audit(df, most_terms=7, shard_terms=40, chunk=9, block=3)) == want
    assert ("tlh", "a", "pair", "b", 0, 1) in want


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("text", "lang", "source").collect()]
    assert found(QUERIES["op12_divergence"](spark, path)) == brute(rows)


def test_no_rows_and_long_text(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    assert found(divergence.audit(frame(spark, [(None, None, None)]))) == []
    rows = [("aa bb cc " * 200_000, "en", "long"), ("aa bb", "en", "x"), ("aa cc bb", "en", "y")]
    assert found(divergence.audit(frame(spark, rows))) == brute(rows)


def test_shares_beyond_64_bits(spark):
    n, total = 9 * 10**18, 9 * 10**18 + 5
    got = spark.sql(f"SELECT {divergence.share(f'{n}L', f'{total}L')} AS p").first()["p"]
    assert got == 1 + 10**9 * (n + 1) // total


def test_pair_sums_of_blocks():
    rng = np.random.default_rng(2)
    dense = rng.integers(0, 4, (5, 40))
    p = 1 + 10**9 * (dense + 1) // (dense.sum(axis=1, keepdims=True) + 40)
    zero = 1 + 10**9 // (dense.sum(axis=1) + 40)

    def rows(part):
        some = [(k, t, p[s, t]) for k, s in enumerate(part) for t in range(40) if dense[s, t]]
        return pd.DataFrame(some + [(k, -1, zero[s]) for k, s in enumerate(part)], columns=["k", "id", "p"])

    got, base = divergence.pair_sums(rows([0, 1]), rows([2, 3, 4]))
    want = [[int(((p[a] - p[b]) ** 2 // p[b]).sum()) for b in (2, 3, 4)] for a in (0, 1)]
    assert (got + 40 * base).tolist() == want


def test_texts_and_layers_of_a_task(monkeypatch):
    for name, n in (("PIECE_TERMS", 7), ("HELD_TERMS", 90), ("HELD_DISTINCT", 25)):
        monkeypatch.setattr(divergence, name, n)
    rows = [(lang or "", source or "", divergence.terms(text)) for text, lang, source in invented(150)]
    held, frames = divergence._Held(3), []
    for lang, source, found_terms in rows:
        if held.add(lang, source, found_terms):
            frames += held.rows()
    out = pd.concat([*frames, *held.rows()])
    assert out["words"].str.split().str.len().max() <= 7
    got, want, layers, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, kind, words, _ in out.itertuples(index=False):
        assert len(set(words.split(" "))) == len(words.split(" ")) or kind == "texts"
        (got[lang, source] if kind == "texts" else layers[lang]).update(words.encode().split())
    for lang, source, found_terms in rows:
        want[lang, source].update(found_terms)
        docs[lang].update(set(found_terms))
    assert got == want
    for lang, n in docs.items():
        assert all(layers[lang][t] == n[t] if n[t] < 3 else layers[lang][t] >= 3 for t in n) and set(layers[lang]) == set(n)


def test_documents_of_a_source_are_joined(spark):
    df = frame(spark, [(f"aa bb w{chr(97 + i % 20)}", "en", "s") for i in range(500)]).coalesce(1)
    kinds = Counter(r["kind"] for r in divergence.term_texts(df).collect())
    assert kinds == {"texts": 1, "layers": 3}
    assert found(divergence.audit(df)) == brute([(r["text"], "en", "s") for r in df.collect()])
