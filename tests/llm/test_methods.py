"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import io
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloudloom.llm import ann, chat, decontaminate, encode, licenses, line_dedup, lm_score, packing, simhash, toxicity, zstd_ids
from cloudloom.llm.queries import QUERIES
from cloudloom.llm.shared import lower_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.orderBy("doc_id").collect()]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\té1aB'.,\x1c ́x|<>", max_size=40))
def test_pieces_equal_whole_texts(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = encode.table(public_tokenizers.path(name))
        assert t.encode([text])[0] == t.one(text)


def test_multi_index_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    e = v.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in e]), np.array([r["embedding"] for r in e], float)
    got = defaultdict(dict)
    for r in ann.nearest(v).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    found = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -9
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        found.append(len(best & set(got[ids[q]])) / 20)
        assert all(abs(s[np.searchsorted(ids, k)] - y) < 1e-9 for k, y in got[ids[q]].items())
    assert np.mean(found) >= 0.9


def test_multi_index_order():
    m = ann.Codebooks(np.array([[0.0], [1.0], [5.0]]), np.array([[0.0], [2.0], [9.0]]))
    a, b = m.halves(np.array([[0.9, 0.1]]))
    order = m.traverse(a[0], b[0], {k: 1 for k in range(9)}, 9)
    assert order == sorted(range(9), key=lambda k: (a[0][k // 3] + b[0][k % 3]))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    assert len(model.ids) < 50_000
    got = toxicity.score(docs, model).where("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    table = Counter((r["toxic"], r["predicted"]) for r in got)
    # Some toxic words stand in few of these 400 toxic documents.
    assert table[1, 1] >= 0.6 * (table[1, 1] + table[1, 0]) and table[0, 1] <= 0.01 * (table[0, 0] + table[0, 1])
    toxic, clean = ([r["score"] for r in got if r["toxic"] == k] for k in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.95


def test_ftrl_by_a_plain_loop():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, rng.integers(0, 12))).astype(np.int64) for _ in range(60)]
    y = np.array([float(3 in x or 7 in x) for x in rows])
    alpha, beta, l1, l2 = 0.7, 1.0, 0.3, 0.5
    m = toxicity.fit(rows, y, alpha, beta, l1, l2, epochs=2)
    z, g2, order = defaultdict(float), defaultdict(float), np.random.default_rng(7)

    def weight(i):
        least = 0.0 if i == "bias" else l1
        return 0.0 if abs(z[i]) <= least else -(z[i] - math.copysign(least, z[i])) / ((beta + math.sqrt(g2[i])) / alpha + l2)

    for _ in range(2):
        for k in order.permutation(60):
            on = ["bias", *rows[k].tolist()]
            w = {i: weight(i) for i in on}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y[k]
            for i in on:
                s = (math.sqrt(g2[i] + g * g) - math.sqrt(g2[i])) / alpha
                z[i] += g - s * w[i]
                g2[i] += g * g
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert dict(zip(m.ids.tolist(), m.weights.tolist())) == pytest.approx(want) and m.bias == pytest.approx(weight("bias"))


def test_toxicity_of_repeated_labels(spark):
    docs = spark.createDataFrame([(i, f"some words {'vile' if i % 2 else 'kind'} {i}") for i in range(60)] * 2, "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)]
    once, twice = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, labels + labels + [(1, 0), (3, None), (None, 1)]))
    assert (once.ids == twice.ids).all() and np.allclose(once.weights, twice.weights) and once.bias == twice.bias
    got = toxicity.score(docs, once).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got) and len(got) == 120


def test_toxicity_features_across_chunks(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500))
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    assert (toxicity.features(text) == whole).all()


def test_packing_round_trip(docs, rows):
    lib = library("word_bpe_49k.json")
    ids = {d: [*lib.encode(t or "", add_special_tokens=False).ids, 2] for d, t, _ in rows}
    got = packing.pack(docs, window=4 * 4096).collect()
    seqs, parts = defaultdict(list), defaultdict(list)
    for r in got:
        piece = np.frombuffer(r["ids"], "<u4").tolist()
        assert piece == ids[r["doc_id"]][r["start"] : r["start"] + r["n"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seqs[r["sequence_id"]].append((r["offset"], r["n"]))
        parts[r["doc_id"]].append((r["start"], r["n"]))
    assert {d: sum(n for _, n in p) for d, p in parts.items()} == {d: len(i) for d, i in ids.items()}
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == 4096 or at & (at - 1) == 0
    # Every full window has each source's share, to a token.
    total, of, windows = sum(map(len, ids.values())), Counter(), defaultdict(Counter)
    for d, _, s in rows:
        of[s] += len(ids[d])
    for r in got:
        windows[r["window"]][r["source"]] += r["n"]
    last = max(windows)
    for w, c in windows.items():
        if w != last:
            assert all(abs(c[s] - of[s] * 4 * 4096 / total) < 1.0001 for s in of)
    sent = Counter()
    for w in sorted(windows):
        sent += windows[w]
        if w != last:
            assert all(sent[s] == of[s] * (w + 1) * 4 * 4096 // total for s in of)


def test_packing_targets(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h i j", "en", "xy"[i % 2], 0) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    got = packing.pack(docs, length=64, window=256, targets={"x": 3.0, "y": 1.0}).collect()
    assert sum(r["n"] for r in got) == 400 * 11
    first = Counter()
    for r in got:
        if r["window"] == 0:
            first[r["source"]] += r["n"]
    assert abs(first["x"] - 192) <= 1 and abs(first["y"] - 64) <= 1
    seqs = defaultdict(int)
    for r in got:
        seqs[r["sequence_id"]] += r["n"]
    assert all(n == 64 or n & (n - 1) == 0 for n in seqs.values())


@pytest.mark.parametrize("targets", [{"x": 5.0, "y": 3.0, "z": 2.0}, None])
def test_packing_after_sources_run_dry(spark, monkeypatch, targets):
    """Every window, those after a source has run dry too, holds the shares of the sources left; more sources than queues."""
    monkeypatch.setattr(packing, "QUEUES", 4 if targets is None else 2)
    counts = {"x": 60, "y": 150, "z": 300}
    docs = spark.createDataFrame([(i, "a b c d e f g", s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))], "doc_id long, text string, source string").repartition(3)
    got = packing.pack(docs, length=64, window=256, targets=targets, power=0.5).collect()
    assert sum(r["n"] for r in got) == 8 * 510
    windows, left = defaultdict(Counter), {s: 8 * n for s, n in counts.items()}
    for r in got:
        windows[r["window"]][r["source"]] += r["n"]
    shares = targets or {s: (8 * n) ** 0.5 for s, n in counts.items()}
    for w in sorted(windows):
        live = {s: shares[s] for s, n in left.items() if n}
        total = sum(windows[w].values())
        for s in left:
            # A token of rounding at each end of a window, and one where a phase ends.
            assert abs(windows[w][s] - total * live.get(s, 0) / sum(live.values())) <= 2
            left[s] -= windows[w][s]
    assert not any(left.values())


@pytest.mark.parametrize("queues", [1024, 50])
def test_packing_of_many_sources(spark, monkeypatch, queues):
    """200 sources, each running dry at another window, with queues of their own or most in the last one; null source among them."""
    monkeypatch.setattr(packing, "QUEUES", queues)
    rows = [(1000 * s + i, "a b c d e f g " * (1 + (s + i) % 3), f"s{s}" if s else None) for s in range(200) for i in range(1 + s % 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = packing.pack(docs, length=64, window=1024, power=0.7).collect()
    parts, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r["doc_id"], r["doc_tokens"]].append((r["start"], r["n"]))
        seqs[r["sequence_id"]].append((r["offset"], r["n"]))
    assert {d for d, _ in parts} == {d for d, _, _ in rows}
    for (_, n), pieces in parts.items():
        at = 0
        for start, k in sorted(pieces):
            assert start == at
            at += k
        assert at == n
    for pieces in seqs.values():
        at = 0
        for offset, k in sorted(pieces):
            assert offset == at
            at += k
        assert at == 64 or at & (at - 1) == 0


def test_decontamination_kinds(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 8)))
    vocab = [word() for _ in range(3000)]
    prose = lambda n: [vocab[min(2999, int(k))] for k in rng.zipf(1.3, n) % 3000]
    item = prose(30) + ["."] + [word() for _ in range(6)]
    near = item[:]
    for k in (3, 9, 15, 21):
        near[k] = word()
    loose = [w for i, w in enumerate(item[:30]) if i % 3] + [word() for _ in range(4)] + item[30:]
    texts = {1: prose(400) + item + prose(300), 2: prose(5000) + near + prose(100), 3: prose(200) + loose + prose(90), 4: prose(900), 5: [w.upper() for w in item]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()] + [(100 + i, " ".join(prose(300))) for i in range(60)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(prose(25) + [word() for _ in range(5)]))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find(docs, bench).collect()}
    assert set(got) == {(1, 7), (2, 7), (3, 7), (5, 7)}
    assert got[3, 7]["answer_found"] and got[3, 7]["lcs_share"] < decontaminate.EDITED <= got[2, 7]["lcs_share"]


def test_decontamination_of_common_words(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(5, 9)))
    often, vocab = [word() for _ in range(40)], [word() for _ in range(3000)]
    prose = lambda n: [rng.choice(often) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(n)]
    passage, frequent = [word() for _ in range(28)], list(rng.permutation(often))[:30]
    mixed = [w if i % 5 else word() for i, w in enumerate(rng.permutation(often)[:30])]
    edit = lambda item, step: [w if i % step else word() for i, w in enumerate(item)]
    texts = {i: (prose(60 + i) + passage + prose(50), 7) for i in range(98)}
    texts |= {98: (prose(60) + edit(passage, 5) + prose(90), 7), 99: (prose(5000) + edit(passage, 6) + prose(90), 7)}
    texts |= {100: (prose(70) + frequent + prose(80), 8), 101: (prose(33) + edit(frequent, 6) + prose(80), 8)}
    # A looser copy of the passage, with its answer.
    texts[103] = prose(70) + edit(passage[:20], 2) + passage[20:] + prose(80), 7
    # Of this item all rare words differ.
    texts |= {102: (prose(70) + edit(mixed, 5) + prose(80), 9)}
    rows = [(i, " ".join(t)) for i, (t, _) in texts.items()] + [(1000 + i, " ".join(prose(250))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(7, " ".join(passage[:20]) + ". " + " ".join(passage[20:])), (8, " ".join(frequent)), (9, " ".join(mixed))]
    items += [(i, " ".join(word() for _ in range(30))) for i in range(10, 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["lcs_share"] for r in decontaminate.find(docs, bench).collect()}
    assert set(got) == {(i, item) for i, (_, item) in texts.items()}
    assert all(got[i, 7] == 1 for i in range(98)) and got[100, 8] == 1
    assert {r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()} == set(range(1000, 1200))


def test_decontamination_of_long_items(spark):
    rng = np.random.default_rng(6)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(5000)]
    prose = lambda n: [vocab[k] for k in rng.integers(0, 5000, n)]
    items = {1: prose(3000), 2: prose(5000), 3: prose(20)}
    texts = {1: prose(700) + items[1] + prose(40), 2: items[2], 3: prose(20_000) + items[2] + prose(3000), 4: prose(9000), 5: prose(50) + items[3], None: prose(30) + items[3] + prose(10)}
    docs = spark.createDataFrame([(i, " ".join(t), "x") for i, t in texts.items()] + [(9, None, "x"), (9, "", "x")], "doc_id long, text string, codes string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (5, 3), (None, 3)}
    kept = decontaminate.drop_leaks(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 9, 9] and kept.columns == ["doc_id", "text"]


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20_000)
    rng = np.random.default_rng(7)
    item = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 7)) for _ in range(20))
    items = [(i, item()) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontaminate._blocks(bench))) > 2
    docs = spark.createDataFrame([(i, f"{item()} {t} {item()}") for i, t in items] + [(100, item())], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench).collect()} == {(i, i) for i in range(12)}
    assert [r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()] == [100]


def test_latent_space(spark):
    rng = np.random.default_rng(4)
    topics = rng.dirichlet(np.full(60, 0.05), 5)
    texts = [rng.choice(60, 640, p=topics[rng.integers(5)]).astype(np.int32) for _ in range(80)]
    items = [rng.choice(60, 20, p=topics[k]).astype(np.int32) for k in range(3)]
    idf = rng.uniform(0.5, 3, 60)
    codes = spark.createDataFrame([(t.astype(np.int16).tobytes(),) for t in texts], "codes binary")
    vectors, values = decontaminate.basis(codes, items, idf, 4, 16)
    a = np.zeros((0, 60))
    for ws, weight in [(t[i : i + 64], 1.0) for t in texts for i in range(0, 640, 64)] + [(i, math.sqrt(800 / 3)) for i in items]:
        row = np.bincount(ws, minlength=60) * idf
        a = np.vstack([a, weight * row / np.linalg.norm(row)])
    _, want, right = np.linalg.svd(a)
    assert values == pytest.approx(want[:4], rel=5e-3)
    assert np.linalg.svd(right[:4] @ vectors)[1].min() > 0.99


def test_paraphrase_by_the_latent_step_alone(spark, monkeypatch):
    # Without the join on rarer words, windows near an item by cosine still find a copy with a third of its words changed.
    monkeypatch.setattr(decontaminate.Index, "_sharing", lambda *_: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(4, 8)))
    vocab = [word() for _ in range(3000)]
    prose = lambda n: [vocab[k] for k in rng.integers(0, 3000, n)]
    item = prose(40)
    loose = [w if i % 3 else word() for i, w in enumerate(item[:32])] + item[32:]
    docs = spark.createDataFrame([(1, " ".join(prose(100) + loose + prose(150)))] + [(10 + i, " ".join(prose(300))) for i in range(40)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item[:32]) + ". " + " ".join(item[32:]))] + [(20 + i, " ".join(prose(30))) for i in range(30)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench).collect()} == {(1, 7)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert decontaminate.lcs(decontaminate.places(a), len(a), b) == t[-1][-1]


def test_decontamination_of_the_table(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench).collect()}
    held = docs.join(bench.withColumnRenamed("text", "t"), F.expr("contains(text, t)")).select("doc_id", "item_id")
    assert {tuple(r) for r in held.collect()} <= got


def test_lm_losses(spark):
    texts = {i: " ".join(["red green blue"] * 5 if i % 3 else ["one two three four"] * 4) for i in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    target = docs.where("doc_id % 3 <> 0")
    got = {r["doc_id"]: r for r in lm_score.score(docs, target).collect()}
    assert got[1]["score"] < 0 < got[0]["score"]
    # The same by dictionaries of counts.
    uni, big = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in texts.items():
        w, k = ["<s>", *t.split()], 0 if i % 3 else 1
        uni[k].update(w)
        big[k].update(zip(w, w[1:]))
    scale = [1.0, sum(uni[0].values()) / sum(uni[1].values())]
    size = len({w for c in uni for w in c} - {"<s>"}) + 2
    for i in (0, 1):
        w = ["<s>", *texts[i].split()]
        loss = []
        for k in (0, 1):
            s = 0.0
            for a, b in zip(w, w[1:]):
                p1 = (scale[k] * uni[k][b] + 1) / (scale[k] * sum(uni[k].values()) + size)
                s -= math.log((scale[k] * big[k][a, b] + lm_score.KAPPA * p1) / (scale[k] * uni[k][a] + lm_score.KAPPA))
            loss.append(s / (len(w) - 1))
        assert got[i]["target_loss"] == pytest.approx(loss[0]) and got[i]["background_loss"] == pytest.approx(loss[1])


@pytest.mark.parametrize("chunk", [2_000, 2_000_000])
def test_lm_counts_every_word(spark, monkeypatch, chunk):
    # More words than 2 ** 16; the second half of the texts, which no model has met, mixes counted and new words.
    rng = np.random.default_rng(2)
    texts = {i: " ".join(f"w{k}" for k in np.concatenate([np.arange(i * 900, i * 900 + 900), rng.zipf(1.5, 300) % 900])) for i in range(80)}
    fresh = {100 + i: f"{texts[i][:300]} new{i} w5 {texts[i + 1][-200:]}" for i in range(4)}
    frame = lambda t: spark.createDataFrame(list(t.items()), "doc_id long, text string")
    monkeypatch.setattr(lm_score, "CHUNK", chunk)
    got = {r["doc_id"]: r for r in lm_score.score(frame(texts), frame(texts).where("doc_id % 2 = 0"), frame(fresh)).collect()}
    uni, big = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in texts.items():
        w = ["", *t.split()]
        uni[i % 2].update(w)
        big[i % 2].update(zip(w, w[1:]))
    size = len(set(uni[0]) | set(uni[1])) + 1
    assert size > 1 << 16 and len(got) == 84
    total = uni[0].total()
    scale = [1.0, total / uni[1].total()]
    for i, t in (texts | fresh).items():
        w, loss = ["", *t.split()], [0.0, 0.0]
        for k in (0, 1):
            for a, b in zip(w, w[1:]):
                p1 = (scale[k] * uni[k][b] + 1) / (total + size)
                loss[k] -= math.log((scale[k] * big[k][a, b] + lm_score.KAPPA * p1) / (scale[k] * uni[k][a] + lm_score.KAPPA))
        n = len(w) - 1
        assert got[i]["n_tokens"] == n
        assert (got[i]["target_loss"], got[i]["background_loss"]) == pytest.approx((loss[0] / n, loss[1] / n))
        assert got[i]["score"] == pytest.approx((loss[0] - loss[1]) / n)


def brute_lines(rows):
    keys = {d: [re.sub(r"^[ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$", "", re.sub("[A-Z]", lambda m: m[0].lower(), x)) for x in (t or "").split("\n")] for d, t, _ in rows}
    holders = defaultdict(set)
    for d, ks in keys.items():
        for k in ks:
            if len(k) >= 20:
                holders[k].add(d)
    return {d: [i for i, k in enumerate(ks) if len(holders[k]) >= 3 and max(holders[k]) != d] for d, ks in keys.items()}


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (3, 2), (5, 3)])
def test_line_runs(docs, rows, batches, fanout):
    want = brute_lines(rows)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, batches=batches, fanout=fanout).collect()}
    for d, t, _ in rows:
        ls = t.split("\n")
        assert got[d]["n_lines"] == len(ls) and got[d]["n_dropped"] == len(want[d])
        assert got[d]["text"] == "\n".join(x for i, x in enumerate(ls) if i not in set(want[d]))


def test_line_runs_unseen(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=4)
    batch = lambda ks: spark.createDataFrame([(k, k, 1, 100 - k) for k in ks], "h1 long, h2 long, n_docs long, keeper long")
    runs.add(batch([1, 2]))
    runs.add(batch([2, 3]))
    runs.add(batch([3, 4]))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert {r["h1"] for r in runs.unseen(batch([1, 2, 3, 4, 5])).collect()} == {5}
    assert {(r["h1"], r["n_docs"], r["keeper"]) for r in runs.all().collect()} == {(1, 1, 99), (2, 2, 98), (3, 2, 97), (4, 1, 96)}


def brute_fingerprint(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


def brute_groups(fp, radius):
    ids, up = sorted(fp), {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fp[a] ^ fp[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_groups(docs, rows):
    fp = {d: brute_fingerprint(t) for d, t, _ in rows}
    groups = brute_groups(fp, 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.digest(docs).collect()}
    assert got == {d: (f"{fp[d]:016x}", groups[d]) for d in fp}


@pytest.mark.parametrize(("radius", "segments", "dense"), [(4, 3, 256), (4, 3, 2), (4, 2, 3), (7, 4, 256), (3, 5, 1)])
def test_simhash_links(spark, radius, segments, dense):
    rng = np.random.default_rng(3)
    fp = {}
    for c in range(12):
        base = int(rng.integers(0, 2**63))
        for _ in range(12):
            x = base
            for b in rng.choice(64, rng.integers(0, 9), replace=False):
                x ^= 1 << int(b)
            fp[len(fp)] = x
    nodes = spark.createDataFrame([(i, [int(np.uint64(x).view(np.int64))]) for i, x in fp.items()], "id long, fp array<long>")
    roots = {r["id"]: r["root"] for r in simhash.components(simhash.links(nodes, radius, segments, dense)).collect()}
    assert {i: roots.get(i, i) for i in fp} == brute_groups(fp, radius)


def brute_shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def alike(x, y):
    return len(x & y) / len(x | y) if x or y else 1.0


def brute_similar(sets, least):
    """The least id of each id's group, linked by a similarity of at least `least`."""
    ids, up = sorted(sets), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if alike(sets[a], sets[b]) >= least:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("edits", "length"), [(2, 150), (5, 300), (6, 300), (10, 300), (14, 300)])
def test_similar_texts(spark, edits, length):
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(4000)]
    texts = {}
    for i in range(80):
        w = [vocab[k] for k in rng.integers(0, 4000, length)]
        texts[2 * i] = " ".join(w)
        for k in rng.choice(length, edits, replace=False):
            w[k] = vocab[rng.integers(0, 4000)]
        texts[2 * i + 1] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    sets = {d: brute_shingles(t, 5) for d, t in texts.items()}
    near = {2 * i for i in range(80) if alike(sets[2 * i], sets[2 * i + 1]) >= 0.8}
    linked = {2 * i for i in range(80) if got[2 * i + 1] == 2 * i}
    assert linked <= near and len(linked) >= 0.95 * len(near)
    assert all(got[d] == d for d in texts if d % 2 == 0)
    assert edits > 6 or len(near) > 70


def test_similar_texts_in_one_dense_group(spark, monkeypatch):
    # Edited copies of one text and a text of another kind in the same buckets, block by block.
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(9)
    vocab = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(4000)]
    base, texts = [vocab[k] for k in rng.integers(0, 4000, 200)], {}
    for i in range(120):
        w = base[:]
        for k in rng.choice(200, 3 if i % 10 else 18, replace=False):
            w[k] = vocab[rng.integers(0, 4000)]
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs, dense=8).collect()}
    assert got == brute_similar({d: brute_shingles(t, 5) for d, t in texts.items()}, 0.8)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1_ \n.é«\u00a0ßİ\u0301日x-", max_size=30))
def test_lower_words(text):
    assert [w.decode() for w in lower_words(text)] == re.findall(r"\w+", text.lower())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=700))
def test_bit_counts(h):
    assert simhash.bit_counts(np.array(h, np.uint64)).tolist() == [sum(x >> i & 1 for x in h) for i in range(64)]


def test_components_of_a_chain(spark):
    edges = spark.range(200).selectExpr("id + 1 AS a", "id AS b").unionByName(spark.range(300, 310).selectExpr("300L AS a", "id + 1 AS b"))
    got = {r["id"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[i] == 300 for i in range(301, 311))


@pytest.mark.parametrize("inner", [False, True])
def test_chat_turns(spark, inner):
    c = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    if inner:  # blank lines within texts too: only markers tell a turn from a paragraph then
        c = c.withColumn("text", F.regexp_replace("text", r"\. ", ".\n\n"))
    truth = chat.transcripts(c).where("opens").where(chat.held_out()).select("conv_id", "pos", F.col("role").alias("true_role"), chat.style_of().alias("style"))
    got = chat.parse(c).where(chat.held_out()).select("conv_id", F.col("first_line").alias("pos"), "role", chat.style_of().alias("style"))
    both = truth.join(got, ["conv_id", "pos", "style"], "full").select("style", "true_role", "role").collect()
    for style in range(3 if inner else 4):
        rows = [r for r in both if r["style"] == style]
        right = sum(r["true_role"] is not None and r["role"] is not None for r in rows) / len(rows)
        same = sum(r["true_role"] == r["role"] for r in rows) / len(rows)
        print("style", style, len(rows), right, same)
        assert right > 0.95 and same > 0.9, (style, right, same)


def test_viterbi_by_all_paths(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    rng = np.random.default_rng(3)
    soft = lambda *n: (lambda m: np.log(m / m.sum(-1, keepdims=True)))(rng.random(n) + 0.05)
    model = chat.Hmm(soft(3), soft(3, 3), soft(3, 2), soft(6, chat.BLANK + 1))
    symbols = {i: rng.integers(0, chat.BLANK + 1, n) for i, n in enumerate([1, 2, 5, 6])}
    rows = [(i, p, int(x), "", p == 0) for i, xs in symbols.items() for p, x in enumerate(xs)]
    got = chat.decode(spark.createDataFrame(rows, "conv_id long, pos long, symbol int, said string, start boolean"), model)
    path = defaultdict(dict)
    for r in got.collect():
        path[r["conv_id"]][r["pos"]] = chat.ROLES.index(r["role"]) + (0 if r["opens"] else 3)
    for i, xs in symbols.items():
        def worth(states):
            total, before = 0.0, None
            for s, x in zip(states, xs):
                role = s % 3
                if before is None:
                    total += model.first[role] if s < 3 else -math.inf
                elif s < 3:
                    total += model.on[before % 3, 1] + model.step[before % 3, role]
                else:
                    total += model.on[before % 3, 0] if role == before % 3 else -math.inf
                total += model.emit[s, x]
                before = s
            return total

        best = max(itertools.product(range(6), repeat=len(xs)), key=worth)
        assert tuple(path[i][p] for p in range(len(xs))) == best


def test_viterbi_blocks(spark, monkeypatch):
    c = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"line {i}\nmore" + "?" * (i % 3)) for i in range(300)], "conv_id long, turn long, role string, text string")
    whole = sorted(tuple(r) for r in chat.parse(c).collect())
    monkeypatch.setattr(chat, "BLOCK", 7)
    assert sorted(tuple(r) for r in chat.parse(c).collect()) == whole


def test_markers(spark):
    lines = ["User: hi", "[bot] hello?", "### Instruction: obey", "Q: why?", "plain: text", "", "**Human**: x", "A dog: x"]
    df = chat.observed(chat.lines_of(spark.createDataFrame([(1, "\n".join(lines))], "conv_id long, text string")))
    got = [(r["symbol"] // 64, r["said"], r["symbol"] // 32 % 2, r["symbol"] // 16 % 2) for r in df.orderBy("pos").collect()]
    assert got == [
        (2, "hi", 1, 0), (3, "hello?", 0, 0), (1, "obey", 0, 1), (2, "why?", 0, 0), (0, "plain: text", 0, 1),
        (chat.BLANK // 64, "", chat.BLANK // 32 % 2, 0), (2, "x", 1, 0), (0, "A dog: x", 0, 0),
    ]


def test_license_scores(spark):
    rows = [(1, "/r/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (2, "/r/a/b.txt", "plain words only"), (3, "/r/a/c.txt", "Released under the MIT license.\n" + "many other words " * 30), (4, "/s/d.txt", "license"), (5, "/r/a/LICENSE", "Licensed under the Apache License, Version 2.0.")]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["origin"], r["license_dir"]) for r in licenses.scan(docs, F.col("path")).collect()}
    assert got == {1: ("GPL-3.0", "own", None), 2: ("Apache-2.0", "inherited", "/r/a"), 3: ("MIT", "own", None), 4: (None, None, None), 5: ("Apache-2.0", "own", None)}
    # Cosines by hand.
    idf, other = licenses.weights(docs)
    vec = lambda ws: Counter(ws)
    weigh = lambda c: {w: n * idf.get(w, other) for w, n in c.items()}
    for r in licenses.lines(docs.withColumnRenamed("doc_id", "key")).where("lines = 1").collect():
        ws = [w for w in re.split(r"[^\w]+", rows[r["key"] - 1][2].split("\n")[r["line"]].lower()) if w]
        a = weigh(vec(ws))
        best = max(
            sum(a.get(w, 0) * x for w, x in b.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
            for name, t in licenses.TEMPLATES for b in [weigh(vec(t.replace(".", " ").split()))]
        )
        assert r["cosine"] == pytest.approx(best, abs=1e-6)


def test_zstd_round_trip(docs, rows):
    lib, at = library("byte_bpe_50k.json"), 0
    want = set()
    for d, t, _ in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.add((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert {tuple(r) for r in zstd_ids.digest(docs).collect()} == want


def test_zstd_reads_only_asked_frames(monkeypatch):
    monkeypatch.setattr(zstd_ids, "FRAME_IDS", 16)
    out, w = io.BytesIO(), None
    w = zstd_ids.Writer(out)
    docs = {i: np.arange(i, i + n, dtype="<u4") for i, n in enumerate([3, 5, 40, 0, 7, 16, 1])}
    for i, x in docs.items():
        w.add(i, x.tobytes())
    w.close()
    r = zstd_ids.Reader(io.BytesIO(out.getvalue()))
    assert len(w.entries) - 1 > 4
    got = r.documents([1])
    assert (got[1] == docs[1]).all() and r.frames_read == 1
    r = zstd_ids.Reader(io.BytesIO(out.getvalue()))
    got = r.documents([2, 3, 6, 99])
    assert set(got) == {2, 3, 6} and all((got[k] == docs[k]).all() for k in got) and r.frames_read == 4
    broken = bytearray(out.getvalue())
    broken[20] ^= 255
    with pytest.raises(Exception):
        zstd_ids.Reader(io.BytesIO(bytes(broken))).documents([0])


def test_every_operator_has_a_query():
    assert [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 11)] == [1] * 10


def test_pieces_met_stay_known(monkeypatch):
    """op3_packing's table is large enough for 380,000 different pieces, which aren't spelled again."""
    monkeypatch.setattr(encode, "_TABLES", {})
    t = encode.table(public_tokenizers.path("word_bpe_49k.json"), 400_000)
    spelled = []
    monkeypatch.setattr(t, "spelled", lambda p: spelled.append(p) or b"")
    texts = [" ".join(f"w{i}" for i in range(k, k + 1000)) for k in range(0, 380_000, 1000)]
    for _ in range(2):
        for x in texts:
            t.encode([x])
    assert len(spelled) == 380_000
