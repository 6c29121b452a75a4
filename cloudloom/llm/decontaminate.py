"""Benchmark decontamination by latent semantic retrieval.

1. Texts are split into words once; a table in the shared folder keeps each text's words as
   numbers of the benchmark's vocabulary. All later steps read that table alone.
2. Document frequencies are counted over all texts.
3. A randomised SVD of the TF-IDF passages of all texts gives a latent space. Each task forms
   its part of Y = A'(A W) for a random orthonormal W, and Spark sums the parts. The singular vectors
   and values follow from Y (W'Y)^-1 Y', which is as good as A'A where that is large. A's rows are the passages and the benchmark's items (all items together weigh as much as all
   passages), its columns the benchmark's words.
4. Windows of all texts and the items are folded into that space, and windows near an item by
   cosine are candidates.
5. A copy's words are common where it stands in many texts, and then its cosine is low. So
   places are candidates too, whatever their cosine, that have as many of an item's rarer words
   as any place with `EDITED` of its words must have; with `LOOSE` of them, where most of the
   item's weight lies in common words.
6. Candidates are compared word for word: the longest common subsequence of the item and the
   window's surroundings, and whether the item's answer (its last sentence, or the column
   `answer`) is there too. An edited copy passes by its subsequence alone, a looser paraphrase
   only with its answer.

The benchmark is held on every worker in blocks whose vectors take at most `BLOCK_BYTES`; a larger
one takes more passes. Windows are as long as the items, however long these are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lower_words, partitions, written

SENTENCE = re.compile(r"[.!?\n]+")
#: Words of a passage, dimensions of the latent space, and further ones of the range it is taken from.
PASSAGE, RANK, SPARE = 64, 48, 8
BLOCK_BYTES = 64 << 20
COSINE = 0.4
#: A word with a lower idf is common: one in over a tenth of the texts.
COMMON = math.log(10)
#: Least share of an item's words in common order, alone or with its answer; then also of its idf mass and of the answer's words.
EDITED, LOOSE, MASS, ANSWER = 0.75, 0.5, 0.6, 0.8
#: Windows begin at multiples of STEP words. Texts are put together up to SPAN words.
STEP, SPAN = 4, 16384


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    answer: list[bytes]


def _item(r: dict) -> Item | None:
    w = lower_words(r["text"])
    if not w or r["item_id"] is None:
        return None
    said = r["answer"] if r.get("answer") else [s for s in SENTENCE.split(r["text"]) if lower_words(s)][-1]
    return Item(r["item_id"], w, lower_words(said))


def lcs(masks: dict, size: int, other: list) -> int:
    """Length of the longest common subsequence; masks: the places of each word in the first sequence of `size` words."""
    full = (1 << size) - 1
    row = full
    for w in other:
        m = masks.get(w)
        if m:
            both = row & m
            row = ((row + both) | (row - both)) & full
    return size - row.bit_count()


def places(sequence: list) -> dict:
    out: dict = {}
    for i, w in enumerate(sequence):
        out[w] = out.get(w, 0) | 1 << i
    return out


def kind(size: int) -> np.dtype:
    """What numbers of so many words are kept as."""
    return np.dtype(np.int16 if size < 1 << 15 else np.int32)


def coded(vocab: list[bytes]) -> Column:
    """The column `text` as numbers of its words (binary of integers of this `kind`), -1 for words out of the vocabulary."""
    index, small = {w: i for i, w in enumerate(vocab)}, kind(len(vocab))

    @F.pandas_udf("binary")
    def each(text: pd.Series) -> pd.Series:
        ids = [np.fromiter(map(index.get, w, repeat(-1)), small, len(w)).tobytes() for w in map(lower_words, text)]
        return pd.Series(ids, dtype=object)

    return each(F.col("text"))


def _numbers(b: pd.Series, size: int) -> Iterator[np.ndarray]:
    return (np.frombuffer(x, kind(size)).astype(np.int32) for x in b)


def frequencies(codes: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many texts (`codes`) each word stands, and the number of texts. One count a word and task is shuffled."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(size + 1, np.int64)
        for b in batches:
            for x in _numbers(b["codes"], size):
                n[np.unique(x[x >= 0])] += 1
            n[-1] += len(b)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"i": at, "n": n[at]})

    out = np.zeros(size + 1, np.int64)
    for r in codes.mapInPandas(each, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["i"]] = r["n"]
    return out[:-1], int(out[-1])


@dataclass
class Passages:
    """Rows of A: passage (ascending), word and weight of each entry; each row has unit norm."""

    row: np.ndarray
    word: np.ndarray
    x: np.ndarray
    n: int

    @classmethod
    def of(cls, texts: list[np.ndarray], idf: np.ndarray, length: int | None = PASSAGE) -> Passages:
        """Of the words' numbers of some texts; with a `length` of None each text is one row."""
        cut = [t[i : i + length] for t in texts for i in range(0, len(t), length)] if length else texts
        row, word = np.repeat(np.arange(len(cut)), [len(c) for c in cut]), np.concatenate([np.zeros(0, np.int32), *cut])
        at, n = np.unique((row * len(idf) + word)[word >= 0], return_counts=True)
        row, word = at // len(idf), at % len(idf)
        x = n * idf[word]
        return cls(row, word, (x / np.sqrt(np.bincount(row, x * x))[row]).astype(np.float32), len(cut))

    def times(self, w: np.ndarray) -> np.ndarray:
        """A w, for the rows that have entries."""
        if not len(self.row):
            return np.zeros((0, w.shape[1]), np.float32)
        return np.add.reduceat(w[self.word] * self.x[:, None], self._starts(self.row), axis=0)

    def back(self, y: np.ndarray, out: np.ndarray) -> None:
        """out += A'y."""
        if not len(self.row):
            return
        order = np.argsort(self.word, kind="stable")
        rank = np.cumsum(np.concatenate([[0], np.diff(self.row) > 0]))
        starts = self._starts(self.word[order])
        out[self.word[order][starts]] += np.add.reduceat(y[rank[order]] * self.x[order][:, None], starts, axis=0)

    @staticmethod
    def _starts(sorted_: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.flatnonzero(np.diff(sorted_)) + 1])


def _together(batches: Iterator[pd.DataFrame], size: int, most: int = 8 * SPAN) -> Iterator[list[np.ndarray]]:
    """Texts' numbers, some at a time."""
    held, n = [], 0
    for b in batches:
        for x in _numbers(b["codes"], size):
            for at in range(0, len(x), most):
                held.append(x[at : at + most])
                n += len(held[-1])
                if n >= most:
                    yield held
                    held, n = [], 0
    if held:
        yield held


def _summed(codes: DataFrame, size: int, rows: int, part) -> np.ndarray:
    """The sum over all tasks of the matrix (of `rows` rows) that part(matrix or None, texts) adds up, row by row in Spark."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for texts in _together(batches, size):
            out = part(out, texts)
        if out is not None:
            at = np.flatnonzero(np.abs(out).sum(1))
            for k in range(0, len(at), 500):
                yield pd.DataFrame({"i": at[k : k + 500], "y": list(out[at[k : k + 500]].astype(np.float32))})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for i, y in zip(b["i"].tolist(), b["y"], strict=True):
                out[i] = out[i] + y if i in out else y.astype(float)
        if out:
            yield pd.DataFrame({"i": list(out), "y": list(out.values())})

    n = min(rows, partitions(codes.sparkSession))
    total = None
    sums = codes.mapInPandas(each, "i long, y array<float>").repartition(n, "i").mapInPandas(added, "i long, y array<double>")
    # At most as many rows as the benchmark has words.
    for r in sums.toLocalIterator():
        if total is None:
            total = np.zeros((rows, len(r["y"])))
        total[r["i"]] = r["y"]
    return total


def basis(codes: DataFrame, items: list[np.ndarray], idf: np.ndarray, rank: int = RANK, spare: int = SPARE) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors (as columns) of all passages and the weighted items, and the singular values."""
    wide = min(rank + spare, len(idf))
    start = np.linalg.qr(np.random.default_rng(11).standard_normal((len(idf), wide)))[0]
    own = Passages.of(items, idf, None)
    sent = codes.sparkSession.sparkContext.broadcast((start.astype(np.float32), idf))

    def part(out: np.ndarray | None, texts: list[np.ndarray]) -> np.ndarray:
        w, idf = sent.value
        # The last row counts the passages.
        out = np.zeros((len(idf) + 1, w.shape[1])) if out is None else out
        p = Passages.of(texts, idf)
        p.back(p.times(w), out[:-1])
        out[-1] += p.n
        return out

    y = _summed(codes, len(idf), len(idf) + 1, part)
    weight = 1.0 if y is None else max(1.0, y[-1, 0] / max(1, own.n))
    y = np.zeros((len(idf), wide)) if y is None else y[:-1]
    mine = np.zeros_like(y)
    own.back(own.times(start.astype(np.float32)), mine)
    y += weight * mine
    # A small multiple of W keeps the inverse stable, and is taken off the eigenvalues again.
    small = 1e-6 * np.linalg.norm(y)
    y += small * start
    inner = start.T @ y
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    half = turn / np.sqrt(np.maximum(values, small / 10))
    left, sigma, _ = np.linalg.svd(y @ half, full_matrices=False)
    return left[:, :rank], np.sqrt(np.maximum(sigma[:rank] ** 2 - small, 0))


def scale_of(n: int) -> int:
    """The window for an item of n words: the least of 8, 12, 16, 24, 32, 48 and so on that isn't less."""
    size = 8
    while size < n:
        size = size * 3 // 2 if size & (size - 1) == 0 else size * 4 // 3
    return size


@dataclass
class Index:
    """What a task needs to find a block of items: sorted by their windows, with words as numbers."""

    items: list[Item]
    codes: list[np.ndarray]
    answers: list[np.ndarray]
    idf: np.ndarray
    vectors: np.ndarray
    latent: np.ndarray
    scale: np.ndarray
    #: A word that the benchmark lacks weighs as much as a word of middling frequency.
    other: float = 0.0
    masks: dict[int, tuple[dict, dict]] = field(default_factory=dict)

    def __post_init__(self):
        """The items that have each word among their rarer ones, one word after the other, and how many of these a copy has."""
        self.other = float(np.median(self.idf))
        edges = [0, *(np.flatnonzero(np.diff(self.scale)) + 1).tolist(), len(self.scale)]
        self.scales = [(int(self.scale[a]), a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]
        self.need = np.zeros(len(self.items), np.int64)
        of: list[list[int]] = [[] for _ in self.idf]
        for i, code in enumerate(self.codes):
            ids = sorted(code.tolist(), key=lambda k: (-self.idf[k], k))
            weights = self.idf[ids]
            share = LOOSE if 2 * weights[weights < COMMON].sum() > weights.sum() else EDITED
            lost = len(ids) - math.ceil(share * len(ids))
            # All but `lost` words of any choice are in a copy. All places of a word count.
            chosen = set(ids[: 2 * lost + 1])
            self.need[i] = sum(k in chosen for k in ids) - lost
            for k in chosen:
                of[k].append(i)
        self.first = np.cumsum([0] + [len(x) for x in of])
        self.rarer = np.array([i for x in of for i in x], np.int32)

    def scan(self, codes: pd.Series) -> list[dict[int, tuple[float, float, bool]]]:
        """For each text: cosine, share of the item's words in order, and whether the answer is there, of each item it holds."""
        texts = list(_numbers(codes, len(self.idf)))
        out: list[dict[int, tuple[float, float, bool]]] = [{} for _ in texts]
        most = int(self.scale[-1])
        span, held, n = max(SPAN, 8 * most), [], 0
        for k, t in enumerate(texts):
            for at in range(0, max(1, len(t)), span):
                part = t[at : at + span + 2 * most]
                held.append((k, at, part))
                n += len(part)
                if n >= span:
                    self._compare_all(held, texts, out)
                    held, n = [], 0
        self._compare_all(held, texts, out)
        return out

    def _compare_all(self, held: list[tuple[int, int, np.ndarray]], texts: list[np.ndarray], out: list) -> None:
        """Put parts of texts together, with gaps between them as wide as half the longest window, and compare their candidates."""
        if not held:
            return
        gap, at, pieces = int(self.scale[-1]) // 2, [], []
        n = 0
        for _, _, part in held:
            room = -(-(len(part) + gap) // STEP) * STEP
            at.append(n)
            pieces += [part, np.full(room - len(part), -2, np.int32)]
            n += room
        at, first = np.array(at), np.array([x for _, x, _ in held])
        item, cosine, lo = self._candidates(np.concatenate(pieces))
        size = self.scale[item]
        p = np.searchsorted(at, lo + size, "right") - 1
        lo = lo - at[p] + first[p]
        # Of the windows of a place, which overlap by half or more, the nearest one.
        order = np.lexsort((-cosine, 2 * lo // size, item, p))
        new = np.ones(len(order), bool)
        new[1:] = np.any([np.diff(x[order]) != 0 for x in (p, item, 2 * lo // size)], axis=0)
        for j in order[new].tolist():
            k, i = held[p[j]][0], int(item[j])
            got = self._compare(i, texts[k][max(0, int(lo[j])) : max(0, int(lo[j]) + 2 * int(size[j]))].tolist())
            if got and (i not in out[k] or got[0] > out[k][i][1]):
                out[k][i] = (float(cosine[j]), *got)

    def _candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """item, cosine, lo: windows that are near an item or share its rarer words, and where their surroundings, twice as long, begin."""
        at = np.flatnonzero(ids >= 0)
        square = np.where(ids >= 0, self.idf[ids], self.other) ** 2
        square[ids == -2] = 0
        chunks = len(ids) // STEP
        norm = np.concatenate([[0], np.cumsum(square.reshape(chunks, STEP).sum(1))])
        z = np.zeros((chunks + 1, self.vectors.shape[1]), np.float32)
        if len(at):
            chunk = at // STEP
            first = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1])
            z[chunk[first] + 1] = np.add.reduceat(self.vectors[ids[at]], first, axis=0)
        np.cumsum(z, axis=0, out=z)
        items, cosines, los = [], [], []
        for size, a, b in self.scales:
            wide = size // STEP
            begin = np.arange(0, chunks, max(1, min(wide, max(2, wide // 3))))
            end = np.minimum(begin + wide, chunks)
            v = z[end] - z[begin]
            # A window that hardly lies in the latent space, or hardly has words, is near nothing.
            whole = np.maximum(norm[end] - norm[begin], self.other**2 * size / 2)
            least = np.sqrt(np.maximum(np.einsum("ij,ij->i", v, v), whole / 4)).astype(np.float32)
            score = v @ self.latent[a:b].T
            k, i = np.nonzero(score >= COSINE * least[:, None])
            items.append(a + i)
            cosines.append(score[k, i] / least[k])
            los.append(begin[k] * STEP - size // 2)
        i, lo = self._sharing(ids, at)
        size = self.scale[i]
        s = np.minimum(chunks, (lo + size // 2) // STEP)
        e = np.minimum(chunks, s + size // STEP)
        v = z[e] - z[s]
        least = np.sqrt(np.maximum(np.einsum("ij,ij->i", v, v), np.maximum(norm[e] - norm[s], 1e-9) / 4))
        items.append(i)
        cosines.append(np.einsum("ij,ij->i", v, self.latent[i]) / least)
        los.append(lo)
        return np.concatenate(items), np.concatenate(cosines), np.concatenate(los)

    def _sharing(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """item, lo: stretches of two windows that hold every place of one and a half with the share of an item's words."""
        first = self.first[ids[at]]
        count = self.first[ids[at] + 1] - first
        total = int(count.sum())
        item = self.rarer[np.repeat(first - np.cumsum(count) + count, count) + np.arange(total)]
        order = np.argsort(item, kind="stable")
        item, place = item[order], np.repeat(at, count)[order]
        last = np.arange(total) + self.need[item] - 1
        held = last < total
        last = np.where(held, last, 0)
        held &= (item[last] == item) & (2 * (place[last] - place) < 3 * self.scale[item])
        item, half = item[held], self.scale[item[held]] // 2
        found = np.unique(np.stack([item, place[held] // half * half]), axis=1)
        return found[0], found[1]

    def _compare(self, i: int, near: list[int]) -> tuple[float, bool] | None:
        code, answer, there = self.codes[i], self.answers[i], set(near)
        held = [k for k in code.tolist() if k in there]
        if len(held) < LOOSE * len(code):
            return None
        if i not in self.masks:
            self.masks[i] = places(code.tolist()), places(answer.tolist())
        share = lcs(self.masks[i][0], len(code), near) / len(code)
        said = lcs(self.masks[i][1], len(answer), near) >= ANSWER * len(answer)
        if share >= EDITED or share >= LOOSE and said and self.idf[held].sum() >= MASS * self.idf[code].sum():
            return share, said
        return None


def _blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    """The benchmark's items, as many at a time as keep the vectors of their words within BLOCK_BYTES."""
    keep = [c for c in ("item_id", "text", "answer") if c in benchmark.columns]
    held, vocab = [], set()
    for r in benchmark.select(*keep).where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        if item := _item(r.asDict()):
            more = vocab | set(item.words) | set(item.answer)
            if held and 4 * (RANK + SPARE) * len(more) > BLOCK_BYTES:
                yield held
                held, more = [], set(item.words) | set(item.answer)
            held.append(item)
            vocab = more
    if held:
        yield held


def index(docs: DataFrame, items: list[Item]) -> tuple[DataFrame, Index]:
    """`docs` with the column `codes`, written to the shared folder, and the index of the items."""
    vocab = sorted({w for i in items for w in (*i.words, *i.answer)})
    place = {w: i for i, w in enumerate(vocab)}
    rows = written(docs.withColumn("codes", coded(vocab)), "word-codes")
    df, total = frequencies(rows.select("codes"), len(vocab))
    idf = np.log((total + 1) / (df + 0.5)).clip(0.01)
    items = sorted(items, key=lambda i: scale_of(len(i.words)))
    number = lambda ws: np.array([place[w] for w in ws], np.int32)
    codes = [number(i.words) for i in items]
    vectors = (basis(rows.select("codes"), codes, idf)[0] * idf[:, None]).astype(np.float32)
    latent = np.stack([vectors[c].sum(0) for c in codes])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    scale = np.array([scale_of(len(c)) for c in codes])
    return rows, Index(items, codes, [number(i.answer) for i in items], idf, vectors, latent, scale)


FOUND = "doc_id long, item_id long, cosine double, lcs_share double, answer_found boolean"


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_found: the documents that hold an item, once each item.

    Null and empty texts and items hold nothing; repeated rows give repeated results, rows with a
    null doc_id results with a null doc_id; an empty benchmark gives an empty table.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], FOUND)
    for items in _blocks(benchmark):
        rows, at = index(docs.select("doc_id", "text"), items)
        out = out.unionByName(_found(rows, spark.sparkContext.broadcast(at)))
    return out


def _holds_none(sent: Broadcast) -> Column:
    @F.pandas_udf("boolean")
    def clean(codes: pd.Series) -> pd.Series:
        return pd.Series([not hits for hits in sent.value.scan(codes)], dtype=bool)

    return clean(F.col("codes"))


def _found(rows: DataFrame, sent: Broadcast) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = sent.value
        for b in batches:
            found = zip(b["doc_id"], at.scan(b["codes"]), strict=True)
            if rows := [(d, at.items[i].item_id, *x) for d, hits in found for i, x in sorted(hits.items())]:
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "lcs_share", "answer_found"]).astype({"doc_id": "Int64"})

    return rows.select("doc_id", "codes").mapInPandas(each, FOUND)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns but one named `codes`, that hold no item, each judged by itself: null and repeated doc_ids too."""
    keep = [c for c in docs.columns if c != "codes"]
    out = docs.select(*keep)
    for items in _blocks(benchmark):
        rows, at = index(out, items)
        out = rows.where(_holds_none(docs.sparkSession.sparkContext.broadcast(at))).select(*keep)
    return out
