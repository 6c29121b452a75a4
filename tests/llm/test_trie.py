"""The prefix trie against a brute-force one, on ties, long conversations and groups of copies."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cloudloom.llm import trie
from cloudloom.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, n long, d int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, heads=6):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        whole[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
            if d:
                kids[whole[c][: d - 1]].add(whole[c][:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, m in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not kids[key]
            saved[key[:d]] += (len(m) - 1) * (len(key[-1][1]) if key else 0)
    return sorted(
        (m[0], len(key), members[key[:-1]][0] if key else -1, len(m), len(kids[key]), leaves[key], saved[key], hashlib.sha256(",".join(str(c) for c in m if len(whole[c]) == len(key)).encode()).hexdigest())
        for key, m in members.items()
    )


def found(df):
    assert df.columns == COLUMNS
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def invented(seed, convs, longest, words):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        n = rng.choice([0, 1, 2, 3, longest])
        rows += [(c * 7 % 1000, rng.choice([None, i, i]), rng.choice(["user", "assistant", None]), rng.choice([None, "", *words]), c, i) for i in range(n)]
    return rows


@pytest.mark.parametrize("block", [2, 3, 64])
def test_trie_of_invented_turns(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "CHUNK_IDS", 3)
    rows = invented(block, 120, 9, ["a", "bb", "ñé"])
    # Copies of one conversation, a long one, its beginning, repeated rows and a null id.
    rows += [(2000 + c, i, "user", f"turn {i}", 0, 0) for c in range(40) for i in range(8)]
    rows += [(5000 + c, i, "user", "x" * (i % 5), 0, 0) for c in range(3) for i in range(40 - 11 * c)]
    rows += [(7001, 1, "user", "twice", 0, 0)] * 9 + [(None, 1, "user", "no id", 0, 0)]
    got = found(trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(5), block=block))
    assert got == brute(rows)


def test_negative_ids_take_the_head_towards_zero(spark):
    rows = [(-250, i, "u", f"own {i}", 0, 0) for i in range(9)] + [(-200, i, "u", f"base {i}", 0, 0) for i in range(9)]
    h = zlib.crc32(b"-250") % 6
    got = found(trie.trie(spark.createDataFrame(rows, SCHEMA)))
    assert ((-250, h, 2) in {(r[0], r[1], r[3]) for r in got}) and len(got) == 1 + 9 + 9 - h


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op11_prefix_trie"](spark, path)) == brute(rows)


def test_no_conversation_and_no_turns(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "lost with its only turns", 0, 0)]
    assert found(trie.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_ends_by_halving():
    rng = np.random.default_rng(3)
    lcp = np.r_[-1, rng.integers(-1, 4, 60)]
    table = trie.sparse_table(lcp)
    row, depth = (x.ravel() for x in np.meshgrid(np.arange(61), np.arange(5)))
    left, right = trie.left_ends(table, row, depth), trie.right_ends(table, row, depth)
    for i, d, a, b in zip(row, depth, left, right, strict=True):
        lo = hi = i
        while lo > 0 and lcp[lo] >= d:
            lo -= 1
        while hi + 1 < 61 and lcp[hi + 1] >= d:
            hi += 1
        assert (a, b) == (lo, hi)
