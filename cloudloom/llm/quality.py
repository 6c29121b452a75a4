"""Quality rules: a linear-chain conditional random field marks the lines of a text as content or boilerplate.

Each line with a word is one position of a chain with two labels. Emissions are
linear in features of the line alone and of the text before it, transitions are
free, and Viterbi decoding picks the labels of all lines of a text together. The
share of word characters in content lines decides whether a document is kept;
counts of words and repeats, the base rules, reject what needs no model.

The field is fitted by maximum likelihood in one task on a bounded sample of
labelled documents (`per_class` of each quality); a document's label stands for
each of its lines, and documents stand one behind the other in the fit's chains.
Scoring reads every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
_SIGNS, _PUNCTUATION = SYMBOLS.encode(), bytes(c for c in range(33, 127) if not chr(c).isalnum())
_DIGITS, _UPPER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLOSING = (b".", b"!", b"?", b":", b";", b'"', b")", "…".encode(), "。".encode(), "”".encode())
#: Names of the columns of `line_features`.
FEATURES = ["bias", "symbols", "bare_words", "digits", "capitals", "word_length", "few_words", "many_words", "closed", "seen_before", "repeats", "address", "punctuation"]
CONTENT, BOILERPLATE = 0, 1


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    r"""n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; zeros for a null or empty one.

    Words are runs outside [\x20\x09-\x0D]; lines are compared as they stand.
    """
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    chars = len(text) - sum(map(text.count, WHITE))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeat_words(words)


def _repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    pairs = a[:-1] * len(ids) + a[1:]
    if len(ids) >= 1 << 20:  # three numbers don't fit 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, n = np.unique(pairs[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    hit = n[at] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : k + len(hit)] |= hit
    return int(inside.sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and word bytes of each line that has a word, in order."""
    rows, sizes = [], []
    seen: set[bytes] = set()
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, m = len(words), sum(map(len, words))
        plain = line.translate(None, _PUNCTUATION)
        rows.append((
            1.0,
            min(1.0, (len(line) - len(line.translate(None, _SIGNS))) / n),
            1 - len(plain.split()) / n,
            (len(line) - len(line.translate(None, _DIGITS))) / m,
            (len(line) - len(line.translate(None, _UPPER))) / m,
            min(1.0, m / n / 20),
            float(n < 4),
            min(1.0, n / 20),
            float(words[-1].endswith(_CLOSING)),
            float(line in seen),
            1 - len(set(words)) / n,
            float(b"://" in line or b"www." in line or b"@" in line),
            min(1.0, (len(line) - len(plain)) / n / 4),
        ))
        sizes.append(m)
        seen.add(line)
    return np.array(rows, float).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


@dataclass(frozen=True)
class Field:
    """Weights of a two-label chain: emissions (2, features), transitions (2, 2) from row to column."""

    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The likeliest labels of a chain of lines; content wins ties."""
        if not len(x):
            return np.zeros(0, int)
        (stay0, to1), (to0, stay1) = self.move.tolist()
        scores = (x @ self.emit.T).tolist()
        a, b = scores[0]
        back = []
        for u, v in scores[1:]:
            from1 = (b + to0 > a + stay0, b + stay1 > a + to1)
            back.append(from1)
            a, b = (b + to0 if from1[0] else a + stay0) + u, (b + stay1 if from1[1] else a + to1) + v
        k = int(b > a)
        out = [k]
        for from1 in reversed(back):
            k = int(from1[k])
            out.append(k)
        return np.array(out[::-1])


def content_share(field: Field, text: str | None) -> float:
    """Share of the word bytes that lie in content lines; 0 without words."""
    x, sizes = line_features(text)
    total = int(sizes.sum())
    return float(sizes[field.viterbi(x) == CONTENT].sum() / total) if total else 0.0


def loss(emit: np.ndarray, move: np.ndarray, x: np.ndarray, y: np.ndarray, ends: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of the labels of chains that end at `ends`, and its gradients, by forward and backward sums."""
    starts = np.r_[0, ends[:-1]]
    order = np.argsort(starts - ends, kind="stable")  # longest first, so that the chains still going on are a prefix
    starts, ends = starts[order], ends[order]
    e = x @ emit.T
    n = len(e)
    fore, aft = np.zeros((n, 2)), np.zeros((n, 2))
    lengths = ends - starts
    fore[starts] = e[starts]
    for t in range(1, int(lengths[0])):
        at = starts[: np.searchsorted(-lengths, -t)] + t
        fore[at] = np.logaddexp(fore[at - 1, :1] + move[0], fore[at - 1, 1:] + move[1]) + e[at]
    for t in range(int(lengths[0]) - 1, 0, -1):
        at = starts[: np.searchsorted(-lengths, -t)] + t
        after = aft[at] + e[at]
        aft[at - 1] = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
    z = np.logaddexp(fore[ends - 1, 0], fore[ends - 1, 1])
    of = np.empty(n)
    of[:] = np.repeat(z[np.argsort(order, kind="stable")], lengths[np.argsort(order, kind="stable")])
    p = np.exp(fore + aft - of[:, None])
    own = np.eye(2)[y]
    inner = np.ones(n, bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    both = np.exp(fore[at - 1][:, :, None] + move + (e[at] + aft[at])[:, None, :] - of[at][:, None, None])
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[at - 1], y[at]), 1)
    value = z.sum() - e[np.arange(n), y].sum() - (pairs * move).sum()
    return float(value), (p - own).T @ x, both.sum(axis=0) - pairs


def fit(texts: list[tuple[np.ndarray, int]], l2: float = 1e-4, steps: int = 300, rate: float = 0.1, longest: int = 64) -> Field:
    """Maximum likelihood with weight decay by Adam over the lines of the texts, each text with one label.

    The texts, in the order given, are joined and cut into chains of `longest` lines, so that labels change within
    chains. Without texts of both labels every line is content.
    """
    texts = [(x, k) for x, k in texts if len(x)]
    if {k for _, k in texts} != {0, 1}:
        return Field(np.zeros((2, len(FEATURES))), np.zeros((2, 2)))
    x = np.concatenate([x for x, _ in texts])
    y = np.concatenate([np.full(len(x), k) for x, k in texts])
    ends = np.r_[np.arange(longest, len(x), longest), len(x)]
    w = np.zeros(2 * len(FEATURES) + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, steps + 1):
        emit, move = w[:-4].reshape(2, -1), w[-4:].reshape(2, 2)
        _, g_emit, g_move = loss(emit, move, x, y, ends)
        g = np.r_[g_emit.ravel(), g_move.ravel()] / len(x) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return Field(w[:-4].reshape(2, -1), w[-4:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, most_chars: int = 1 << 20) -> Field:
    """Fit on at most `per_class` labelled documents of each quality, each of at most `most_chars` characters, in one task.

    The documents are those of the least hash of their doc_id. Labels that repeat a doc_id count once, by the least
    quality; a doc_id with several texts takes the least of them. Only the weights reach the driver.
    """
    y = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("y"))
    parts = [y.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    # At most 2 * per_class rows.
    rows = docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").where(F.length("text") <= most_chars)
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [line_features(t)[0].tobytes() for t in b["text"]]})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [(d, np.frombuffer(x, float).reshape(-1, len(FEATURES)), k) for b in batches for d, x, k in zip(b["doc_id"], b["x"], b["y"], strict=True)]
        found.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
        f = fit([(x, CONTENT if k else BOILERPLATE) for _, x, k in found])
        yield pd.DataFrame({"emit": [f.emit.tobytes()], "move": [f.move.tobytes()]})

    # The rows are bounded by `per_class`, so one task holds them.
    features = rows.mapInPandas(each, "doc_id long, y int, x binary").repartition(1)
    r = features.mapInPandas(fitted, "emit binary, move binary").first()
    if r is None:
        return fit([])
    return Field(np.frombuffer(r["emit"], float).reshape(2, -1), np.frombuffer(r["move"], float).reshape(2, 2))


def judge(docs: DataFrame, field: Field, least_share: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, content_share, kept of every row.

    Each row is judged by its whole text alone: null and empty texts have no words and fail the base rules; repeated
    rows get equal results, a null doc_id is a row like any other, further columns aren't read, and an empty table
    gives an empty one. A share of exactly `least_share` is kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = [base_counts(t) for t in b["text"]]
            out = pd.DataFrame(counts, columns=names, dtype=np.int64)
            out.insert(0, "doc_id", b["doc_id"])
            out["base_failed"] = [base_failed(c[0], c[4]) for c in counts]
            out["content_share"] = [content_share(sent.value, t) for t in b["text"]]
            out["kept"] = ~out["base_failed"] & (out["content_share"] >= least_share)
            yield out

    schema = f"doc_id long, {', '.join(f'{n} long' for n in names)}, base_failed boolean, content_share double, kept boolean"
    return docs.select("doc_id", "text").mapInPandas(each, schema)
