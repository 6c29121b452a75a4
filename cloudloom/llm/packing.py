"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents' tokens. Time runs in windows of
`window` tokens. A window gives every source its share of tokens; what a source
can't take as whole tokens is its deficit and is carried to the next window, so
after w windows source s has had floor(w * window * share_s) tokens. As texts may
be cut, that is also what it has sent, and a token's window follows from its place
in its queue alone: all partitions carry the same deficits without any state
passed between them. Within a window the sources follow one another, and the whole
stream is cut into sequences of `length` tokens; the rest of under `length` tokens
becomes sequences of powers of two, so nothing is padded.

Shares are `targets` (share by source; sources without one come last), or those of the sources' tokens
in the table to a `power`: 1 for their own shares, less to level them. Unless they are the own shares,
sources run dry at different windows, and the shares left are scaled up.

Token ids are computed once, into a table in the shared folder; its rows aren't
shuffled. What joins them is one count a source and file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encode
from .shared import written

#: Sources with queues of their own, besides those with targets; further ones with fewer tokens share the last queue.
QUEUES = 1024
#: Texts that are encoded together.
SLICE = 500


def tokens(docs: DataFrame, path: str, end: int, pieces: int = 200_000) -> DataFrame:
    """doc_id, source, part, at, n, ids (little-endian 32-bit) of each row, written to the shared folder.

    A worker keeps the ids of up to twice `pieces` pieces of texts (about 200 bytes each).
    `at` counts the tokens of the same source before it in its partition `part`.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = encode.table(path, pieces)
        tail = np.array([end], "<u4").tobytes()
        sent: dict[str | None, int] = {}
        for whole in batches:
            # A few texts at a time, so that a batch's ids aren't held together.
            for first in range(0, len(whole), SLICE):
                b = whole.iloc[first : first + SLICE]
                ids = [x + tail for x in table.encode([x or "" for x in b["text"]])]
                n = [len(x) // 4 for x in ids]
                at = []
                for s, k in zip(b["source"], n, strict=True):
                    at.append(sent.get(s, 0))
                    sent[s] = at[-1] + k
                yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "part": b["part"], "at": at, "n": n, "ids": ids})

    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select("doc_id", "text", source.alias("source"), F.spark_partition_id().alias("part"))
    out = rows.mapInPandas(each, "doc_id long, source string, part int, at long, n long, ids binary")
    return written(out, "pack-ids")


def phases(totals: list[int], shares: list[float] | None) -> list[tuple[int, list[int], list[int]]]:
    """(tokens of the phase, tokens each queue has sent before it, tokens each sends in it).

    In a phase the queues that aren't empty share by their targets; it ends when one runs dry.
    """
    left, sent, out = list(totals), [0] * len(totals), []
    if shares is None:
        return [(sum(totals), sent, left)]
    while any(left):
        live = [i for i, k in enumerate(left) if k]
        weight = sum(shares[i] for i in live)
        of = [shares[i] / weight if weight > 0 else 1 / len(live) for i in live]
        span = min(left[i] / p for i, p in zip(live, of, strict=True) if p > 0)
        take = [0] * len(left)
        for i, p in zip(live, of, strict=True):
            take[i] = min(left[i], round(span * p))
        if not any(take):
            take = left[:]
        out.append((sum(take), sent[:], take))
        sent = [a + b for a, b in zip(sent, take, strict=True)]
        left = [a - b for a, b in zip(left, take, strict=True)]
    return out


def _long(*xs: int) -> Column:
    return F.array(*[F.lit(x).cast("long") for x in xs])


def pack(
    docs: DataFrame,
    path: str | None = None,
    end: int = 2,
    length: int = 4096,
    window: int = 64 * 4096,
    targets: dict[str, float] | None = None,
    power: float = 1.0,
    pieces: int = 200_000,
) -> DataFrame:
    """doc_id, source, start, ids (binary), n, doc_tokens, window, sequence_id, offset of each piece.

    A null or empty text is the end id alone, and a null source a queue of its own
    (""). Repeated rows are packed each. An empty table gives no pieces.
    """
    t = tokens(docs, path or public_tokenizers.path("word_bpe_49k.json"), end, pieces)
    spark = docs.sparkSession
    counts = written(t.groupBy("source", "part").agg(F.sum("n").alias("n")), "pack-counts")
    top = counts.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").limit(QUEUES - 1)
    own = sorted({r["source"] for r in top.collect()} | set(targets or {}))
    queue = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in own]).cast("array<string>"), F.col("source")) - 1, F.lit(-1))
    queue = F.when(queue < 0, len(own)).otherwise(queue).cast("int")
    sums = {r["q"]: r["n"] for r in counts.groupBy(queue.alias("q")).agg(F.sum("n").alias("n")).collect()}
    totals = [sums.get(q, 0) for q in range(len(own) + 1)]
    if not sum(totals):
        return spark.createDataFrame([], PIECES)
    shares = [n**power for n in totals] if targets is None else [targets.get(s, 0.0) for s in own] + [0.0]
    if targets is None and power == 1:
        shares = None
    return _laid_out(t, _bases(counts, queue), queue, phases(totals, shares), sum(totals), length, window)


PIECES = "doc_id long, source string, start long, ids binary, n long, doc_tokens long, window long, sequence_id long, offset long"


def _bases(counts: DataFrame, queue: Column) -> DataFrame:
    """source, part, base: the tokens of the queue before those of this source and part.

    A queue's parts are summed by blocks of 1024 parts first, so no task holds all of them.
    """
    c = counts.select("source", "part", "n", queue.alias("q"), F.floor(F.col("part") / 1024).alias("block"))
    blocks = c.groupBy("q", "block").agg(F.sum("n").alias("m"))
    blocks = blocks.select("q", "block", F.expr("sum(m) OVER (PARTITION BY q ORDER BY block) - m").alias("before"))
    inner = c.withColumn("within", F.expr("sum(n) OVER (PARTITION BY q, block ORDER BY part, source ROWS UNBOUNDED PRECEDING) - n"))
    return inner.join(blocks, ["q", "block"]).select("source", "part", (F.col("before") + F.col("within")).alias("base"))


def _phase_tables(spark: SparkSession, runs: list, window: int) -> tuple[DataFrame, DataFrame]:
    """The queues' parts of phases (q, phase, size, first, w0, from_, has), and what all queues take in a phase (phase, take).

    There are as many phases as queues at most, so neither has more than about `QUEUES` squared numbers (8 MB a column):
    both can be broadcast.
    """
    size = np.array([r[0] for r in runs], np.int64)
    windows = -(-size // window)
    sent, take = np.array([r[1] for r in runs], np.int64), np.array([r[2] for r in runs], np.int64)
    phase, q = np.nonzero(take)
    turns = {
        "q": q.astype(np.int32), "phase": phase.astype(np.int32), "size": size[phase], "first": (np.cumsum(size) - size)[phase],
        "w0": (np.cumsum(windows) - windows)[phase], "from_": sent[phase, q], "has": take[phase, q],
    }
    takes = {"phase": np.arange(len(runs), dtype=np.int32), "take": list(take)}
    turns = spark.createDataFrame(pa.table(turns), "q int, phase int, size long, first long, w0 long, from_ long, has long")
    takes = spark.createDataFrame(pa.table(takes), "phase int, take array<long>")
    return written(turns, "pack-turns"), written(takes, "pack-takes")


def _laid_out(
    t: DataFrame, bases: DataFrame, queue: Column, runs: list, total: int, length: int, window: int
) -> DataFrame:
    out = t.join(bases, ["source", "part"]).select(
        "doc_id", "source", "ids", F.col("n").alias("doc_tokens"), queue.alias("q"), (F.col("base") + F.col("at")).alias("a")
    )
    # Cut where a queue's phase ends, then at its windows' ends, then at the sequences' ends.
    turns, takes = _phase_tables(t.sparkSession, runs, window)
    # Only the phases that a document's tokens lie in.
    out = out.join(F.broadcast(turns), "q").where("a < from_ + has AND a + doc_tokens > from_")
    # lo, hi: the piece's tokens in its queue, counted from the phase's start.
    out = out.withColumn("lo", F.expr("greatest(a - from_, 0L)")).withColumn("hi", F.expr("least(a + doc_tokens - from_, has)"))
    d = lambda x: f"cast({x} AS decimal(19,0))"
    # The window w of a queue's token u is the last with floor(has * w * window / size) <= u.
    at = lambda u: f"(({d(f'{u} + 1')} * {d('size')} - 1) div ({d('has')} * {window}))"
    out = out.select("*", F.explode(F.expr(f"sequence({at('lo')}, {at('hi - 1')})")).alias("w"))
    given = lambda has, w: f"({d(has)} * least({d('size')}, {d(w)} * {window}) div {d('size')})"
    out = out.withColumn("g", F.expr(given("has", "w")))
    out = out.withColumn("s", F.greatest("lo", "g")).withColumn("e", F.least("hi", F.expr(given("has", "w + 1"))))
    # Before it in the stream: all that any queue had by the window's start, and the window's part of earlier queues.
    before = f"aggregate(take, 0L, (x, h) -> x + {given('h', 'w')}) + aggregate(slice(take, 1, q), 0L, (x, h) -> x + {given('h', 'w + 1')} - {given('h', 'w')})"
    out = out.join(F.broadcast(takes), "phase").withColumn("pos", F.expr(f"first + {before} + s - g")).drop("take")
    full = total // length
    tail, at_, rest = [], full * length, total % length
    for k in reversed(range(length.bit_length())):
        if rest >> k & 1:
            tail.append(at_)
            at_ += 1 << k
    starts = _long(*tail)
    seq = lambda p: F.when(p < full * length, F.floor(p / length)).otherwise(
        F.lit(full - 1) + F.size(F.filter(starts, lambda x: x <= p))
    ).cast("long")
    first = lambda s: F.when(s < full, s * length).otherwise(F.get(starts, (s - full).cast("int")))
    end = F.col("pos") + F.col("e") - F.col("s")
    out = out.select("*", F.explode(F.sequence(seq(F.col("pos")), seq(end - 1))).alias("sequence_id"), end.alias("end"))
    sid = F.col("sequence_id")
    stop = F.when(sid < full, (sid + 1) * length).otherwise(F.coalesce(F.get(starts, (sid - full + 1).cast("int")), F.lit(total)))
    out = out.withColumn("p0", F.greatest("pos", first(sid))).withColumn("p1", F.least(F.col("end"), stop))
    start = F.expr("from_ + s - a + p0 - pos")
    return out.select(
        "doc_id", "source", start.alias("start"), F.expr("substring(ids, int(4 * (from_ + s - a + p0 - pos) + 1), int(4 * (p1 - p0)))").alias("ids"),
        F.expr("p1 - p0").alias("n"), "doc_tokens", F.expr("w0 + w").alias("window"), "sequence_id", (F.col("p0") - first(sid)).alias("offset"),
    )


def digest(docs: DataFrame, power: float = 0.7, **how) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece; large sources are levelled by `power`."""
    return pack(docs, power=power, **how).select(
        "doc_id", "start", F.col("n").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
