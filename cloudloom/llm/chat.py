"""Transcripts to chat turns: roles by a hidden Markov model over the lines.

A state is a role and whether the line opens a turn or goes on with one. An observation
is a line of the raw text: its speaker marker (as "User:", "[bot]", "Q:", "### System", or
none), whether a blank line or the start comes before it, whether the text before it ended
with a question, its length and its closing mark; blank lines are one observation of
their own. Nothing else says where a turn opens: Viterbi decides it along with the roles.
Counts for all of this come from transcripts with known turns, with add-one smoothing.

The best path is exact for transcripts of any length: lines are cut into blocks, each
block is reduced to a table of its best paths from each first to each last state
(max-plus products, in any task), the tables of a transcript are chained, and each
block is then decoded between its known end states. A turn is rendered, without its
marker and the blank lines at its end, as

    <|role|>
    text
    <|end|>
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

ROLES = ["system", "user", "assistant"]
#: Speaker words and the class of marker that they form.
SPEAKERS = {
    "system": ["system", "instruction", "instructions"],
    "user": ["user", "human", "question", "q", "customer"],
    "assistant": ["assistant", "ai", "bot", "answer", "a", "agent", "model"],
}
MARKER = r"(?i)^\s*(?:[#>*\[(<|]+\s*)?(" + "|".join(w for ws in SPEAKERS.values() for w in ws) + r")\s*(?:[\])>|*]+\s*:?|:)[*]*\s*"
#: States: a line that opens a turn of each role, then one that goes on with it.
STATES = 2 * len(ROLES)
#: Marker classes (none and the roles) x gap before x question before x closing marks (none . ? other) x length classes; and a blank line.
CLOSES, LENGTHS = 4, 4
BLANK = 4 * 2 * 2 * CLOSES * LENGTHS
#: Lines of a block, and of the blocks that one call decodes.
BLOCK, CALL = 512, 100_000


def observed(lines: DataFrame) -> DataFrame:
    """`lines` (with line, p1 and p2: the lines before, null where there is none) with symbol and said (the line without its marker)."""
    word = F.lower(F.regexp_extract("line", MARKER, 1))
    mark = F.lit(0)
    for i, r in enumerate(ROLES):
        mark = F.when(word.isin(SPEAKERS[r]), i + 1).otherwise(mark)
    rest = F.regexp_replace("line", MARKER, "")
    last = lambda c: F.substring(F.rtrim(c), -1, 1)
    blank = lambda c: F.trim(c) == ""
    close = F.when(last(rest) == "", 0).when(last(rest) == ".", 1).when(last(rest) == "?", 2).otherwise(3)
    n = F.length(rest)
    size = F.when(n < 40, 0).when(n < 160, 1).when(n < 640, 2).otherwise(3)
    gap = (F.col("p1").isNull() | blank("p1")).cast("int")
    asked = F.coalesce(F.when(blank("p1"), last(F.col("p2"))).otherwise(last(F.col("p1"))) == "?", F.lit(False)).cast("int")
    symbol = (((mark * 2 + gap) * 2 + asked) * CLOSES + close) * LENGTHS + size
    return lines.withColumns({"symbol": F.when(blank("line"), BLANK).otherwise(symbol).cast("int"), "said": rest})


@dataclass
class Hmm:
    """Log probabilities: first role, role after a role at an opening, going on or not with a role, symbol of a state."""

    first: np.ndarray
    step: np.ndarray
    on: np.ndarray
    emit: np.ndarray

    def __post_init__(self):
        k = len(ROLES)
        opening = self.on[:, 1:] + self.step
        going = np.where(np.eye(k, dtype=bool), self.on[:, :1], -np.inf)
        self.move = np.tile(np.hstack([opening, going]), (2, 1))
        self.start = np.concatenate([self.first, np.full(k, -np.inf)])

    def moves(self, symbols: np.ndarray, start: np.ndarray) -> np.ndarray:
        """For each line the table of scores from the state before to its own; a first line's rows are all alike."""
        return np.where(start[:, None, None], self.start[None, None, :], self.move[None]) + self.emit[:, symbols].T[:, None, :]


def train(lines: DataFrame) -> Hmm:
    """Counts over observed lines with known `role`, `opens` and `prev` (at an opening, the role before; null at the start).

    Lines of other roles than ROLES aren't counted.
    """
    ids = {r: i for i, r in enumerate(ROLES)}
    k = len(ROLES)
    known = lines.where(F.col("role").isin(ROLES))
    emit, first, step, on = np.ones((STATES, BLANK + 1)), np.ones(k), np.ones((k, k)), np.ones((k, 2))
    # One row a state and symbol, or pair of roles.
    for r in known.groupBy("role", "opens", "symbol").agg(F.count("*").alias("n")).collect():
        emit[ids[r["role"]] + (0 if r["opens"] else k), r["symbol"]] += r["n"]
        if not r["opens"]:
            on[ids[r["role"]], 0] += r["n"]
    for r in known.where("opens").groupBy("prev", "role").agg(F.count("*").alias("n")).collect():
        if r["prev"] is None:
            first[ids[r["role"]]] += r["n"]
        elif r["prev"] in ids:
            step[ids[r["prev"]], ids[r["role"]]] += r["n"]
            on[ids[r["prev"]], 1] += r["n"]
    log = lambda m: np.log(m / m.sum(-1, keepdims=True))
    return Hmm(log(first), log(step), log(on), log(emit))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(1)


def _path(tables: np.ndarray, before: int, last: int) -> np.ndarray:
    """The best states of the lines, given the state before the first and the last line's state."""
    best = np.empty((len(tables), tables.shape[1]))
    back = np.empty(best.shape, np.int64)
    best[0], back[0] = tables[0][before], before
    for i in range(1, len(tables)):
        scores = best[i - 1][:, None] + tables[i]
        back[i], best[i] = scores.argmax(0), scores.max(0)
    out = np.empty(len(tables), np.int64)
    out[-1] = last
    for i in range(len(tables) - 1, 0, -1):
        out[i - 1] = back[i][out[i]]
    return out


def _runs(g: pd.DataFrame, *by: str) -> list[tuple[int, int]]:
    """Ends of the runs of rows that are alike in these columns."""
    new = np.zeros(len(g), bool)
    new[:1] = True
    for c in by:
        x = g[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new).tolist()
    return list(zip(at, [*at[1:], len(g)], strict=True))


def decode(lines: DataFrame, model: Hmm) -> DataFrame:
    """`lines` as observed (conv_id, pos, symbol, said, start) with the role that Viterbi gives each, and whether it opens a turn.

    `pos` must be a count from 0 that is unique in its transcript, as `transcripts` makes it.
    """
    spark = lines.sparkSession
    sent = spark.sparkContext.broadcast(model)
    cut = lines.withColumn("block", F.floor(F.col("pos") / BLOCK))
    k = STATES

    def moves(g: pd.DataFrame) -> np.ndarray:
        return sent.value.moves(g["symbol"].to_numpy(), g["start"].to_numpy(bool))

    def reduced(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["conv_id", "block", "pos"], kind="stable")
        tables, rows = moves(g), []
        for i, j in _runs(g, "conv_id", "block"):
            total = tables[i]
            for t in tables[i + 1 : j]:
                total = _product(total, t)
            rows.append((g["conv_id"].iat[i], g["block"].iat[i], total.ravel()))
        return pd.DataFrame(rows, columns=["conv_id", "block", "t"])

    def chained(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["conv_id", "block"], kind="stable")
        tables, rows = np.stack(g["t"].to_list()).reshape(-1, k, k), []
        for i, j in _runs(g, "conv_id"):
            total = tables[i]
            for t in tables[i + 1 : j]:
                total = _product(total, t)
            last = _path(tables[i:j], 0, int(total[0].argmax()))
            before = np.concatenate([[0], last[:-1]])
            rows += zip([g["conv_id"].iat[i]] * (j - i), g["block"].to_numpy()[i:j], before, last, strict=True)
        return pd.DataFrame(rows, columns=["conv_id", "block", "before", "last"])

    schema = T.StructType([f for f in cut.schema if f.name not in ("before", "last")] + [T.StructField("state", T.IntegerType())])

    def decoded(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["conv_id", "block", "pos"], kind="stable")
        tables, before, last = moves(g), g["before"].to_numpy(), g["last"].to_numpy()
        states = [_path(tables[i:j], int(before[i]), int(last[i])) for i, j in _runs(g, "conv_id", "block")]
        return g.drop(columns=["before", "last", "deal"]).assign(state=np.concatenate(states))

    # Blocks are dealt out by their hash, many to a group, so that short transcripts don't cost a call each.
    groups = F.lit(-(-lines.count() // CALL) or 1)
    dealt = lambda df, *by: df.withColumn("deal", F.pmod(F.xxhash64(*by), groups)).groupBy("deal")
    slim = cut.select("conv_id", "block", "pos", "symbol", "start")
    tables = dealt(slim, "conv_id", "block").applyInPandas(reduced, "conv_id long, block long, t array<double>")
    ends = dealt(tables, "conv_id").applyInPandas(chained, "conv_id long, block long, before long, last long")
    out = dealt(cut.join(ends, ["conv_id", "block"]), "conv_id", "block").applyInPandas(decoded, schema)
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("state") % len(ROLES) + 1)
    return out.withColumns({"role": role, "opens": F.col("state") < len(ROLES)}).drop("state", "block")


def turns(decoded: DataFrame) -> DataFrame:
    """conv_id, turn, role, first_line, n_lines, rendered: the lines from one opening to the next.

    Turns are numbered by counting openings up to each block of lines and within it, so a
    long transcript isn't sorted in one task.
    """
    d = decoded.withColumn("block", F.floor(F.col("pos") / BLOCK)).withColumn("o", F.col("opens").cast("int"))
    per = d.groupBy("conv_id", "block").agg(F.sum("o").alias("m"))
    per = per.selectExpr("conv_id", "block", "coalesce(sum(m) OVER (PARTITION BY conv_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    d = d.withColumn("within", F.expr("sum(o) OVER (PARTITION BY conv_id, block ORDER BY pos ROWS UNBOUNDED PRECEDING)"))
    d = d.join(per, ["conv_id", "block"]).withColumn("turn", F.col("before") + F.col("within") - 1)
    rows = d.groupBy("conv_id", "turn").agg(
        F.sort_array(F.collect_list(F.struct("pos", "said"))).alias("ls"), F.min("role").alias("role"), F.min("pos").alias("first_line"), F.count("*").alias("n_lines")
    )
    text = F.regexp_replace(F.array_join(F.transform("ls", lambda x: x["said"]), "\n"), r"\s+$", "")
    return rows.select("conv_id", "turn", "role", "first_line", "n_lines", F.concat(F.lit("<|"), "role", F.lit("|>\n"), text, F.lit("\n<|end|>")).alias("rendered"))


#: How the transcripts made from a table write the roles, by style, and whether a blank line follows a turn.
STYLES = [
    ({"system": "System: ", "user": "User: ", "assistant": "Assistant: "}, False),
    ({"system": "[system] ", "user": "[human] ", "assistant": "[ai] "}, True),
    ({"system": "### Instruction: ", "user": "Q: ", "assistant": "A: "}, False),
    ({"system": "", "user": "", "assistant": ""}, True),
]


def style_of() -> Column:
    return F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))


def _numbered(rows: DataFrame, *keep: str) -> DataFrame:
    """conv_id, pos, line, p1, p2, start and the columns of `keep`: the lines of rows (conv_id, at0, i0, lines, tail).

    at0: the place of the row's first line; tail: the last two lines before it, or fewer.
    """
    before = lambda k: F.expr(f"slice(concat(array_repeat(cast(null AS string), 2 - size(tail)), tail, lines), {3 - k}, size(lines))")
    out = rows.select("conv_id", "at0", *keep, F.posexplode(F.arrays_zip(F.col("lines").alias("line"), before(1).alias("p1"), before(2).alias("p2"))).alias("i", "l"))
    pos = F.col("at0") + F.col("i")
    return out.select("conv_id", pos.alias("pos"), "l.line", "l.p1", "l.p2", (pos == 0).alias("start"), "i", *keep)


def lines_of(texts: DataFrame) -> DataFrame:
    """conv_id, pos, line, p1, p2, start: the lines of raw transcripts (conv_id, text), one a row. A null text is one empty line.

    Each conv_id must stand in one row; a null conv_id counts as the smallest long.
    """
    none = F.array().cast("array<string>")
    rows = texts.select(
        F.coalesce("conv_id", F.lit(-(2**63))).alias("conv_id"), F.lit(0).cast("long").alias("at0"),
        F.split(F.coalesce("text", F.lit("")), "\r?\n", -1).alias("lines"), none.alias("tail"),
    )
    return _numbered(rows).drop("i")


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, line, p1, p2, start: the lines of raw transcripts made from (conv_id, turn, role, text); and role, opens, prev: what they were made of.

    Each conversation is written in one of STYLES, by a hash of its id; in the last there
    are no markers, only blank lines, as there are within texts. Lines are numbered by the
    sizes of the turns before, summed by blocks of turns. Rows with a null conv_id form a
    conversation; a null text is one empty line, a null turn comes first, a null role is the
    user's, roles other than ROLES have no marker, and rows that share a turn follow in order
    of role, equal ones side by side.
    """
    style = style_of()
    names = [F.when((style == i) & (F.col("role") == r), m) for i, (s, _) in enumerate(STYLES) for r, m in s.items() if m]
    spaced = style.isin([i for i, (_, x) in enumerate(STYLES) if x])
    c = conversations.select(
        F.coalesce("conv_id", F.lit(-(2**63))).alias("conv_id"), F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("user")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).withColumn("uid", F.monotonically_increasing_id())
    c = c.withColumn("lines", F.split(F.concat(F.coalesce(*names, F.lit("")), "text", F.when(spaced, "\n").otherwise("")), "\n", -1))
    c = c.withColumn("n", F.size("lines").cast("long")).withColumn("last", F.expr("slice(lines, -least(2, size(lines)), 2)"))
    c = written(c.drop("text").withColumn("block", F.floor(F.col("turn") / BLOCK)), "transcripts")
    order = "ORDER BY turn, role, uid"
    per = c.groupBy("conv_id", "block").agg(F.sum("n").alias("m"), F.max(F.struct("turn", "role", "uid", "last")).alias("z"))
    over = "OVER (PARTITION BY conv_id ORDER BY block"
    per = per.selectExpr(
        "conv_id", "block", f"coalesce(sum(m) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base",
        f"lag(z.role) {over}) AS before", f"lag(z.last) {over}) AS before_last",
    )
    part = "OVER (PARTITION BY conv_id, block " + order
    c = c.withColumn("at", F.expr(f"sum(n) {part} ROWS UNBOUNDED PRECEDING) - n"))
    c = c.withColumn("was", F.expr(f"lag(role) {part})")).withColumn("was_last", F.expr(f"lag(last) {part})"))
    c = c.join(per, ["conv_id", "block"])
    rows = c.select(
        "conv_id", (F.col("base") + F.col("at")).alias("at0"), "role", F.coalesce("was", "before").alias("prev"), "lines",
        F.coalesce("was_last", "before_last", F.array().cast("array<string>")).alias("tail"),
    )
    return _numbered(rows, "role", "prev").withColumn("opens", F.col("i") == 0).drop("i")


def parse(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, first_line, n_lines, rendered of each turn recovered from the table's transcripts.

    The model is counted on four fifths of the conversations (by a hash of conv_id); the
    turns of the others are seen by no count.
    """
    lines = observed(transcripts(conversations))
    return parse_lines(lines.drop("role", "prev", "opens"), train(lines.where(~held_out())))


def parse_lines(lines: DataFrame, model: Hmm) -> DataFrame:
    """The turns of observed lines, as of `lines_of` or `transcripts`."""
    return turns(decode(lines.select("conv_id", "pos", "symbol", "said", "start"), model))


def held_out() -> Column:
    return F.pmod(F.xxhash64("conv_id", F.lit("held out")), F.lit(5)) == 0
