r"""Divergence between the sources of a language, from exact counts of its terms.

A term is a run of letters A-Z or characters above ASCII, with A-Z in lower case
only. For each language a CountVectorizer with `min_docs` as its minDF and the
largest vocabSize turns texts into exact sparse vectors; sums of these by
(lang, source) give the counts. A vectorizer's vocabulary passes through the
driver, so terms are dealt to shards by their hash, of about SHARD_TERMS distinct
terms each, and every shard has a vectorizer of its own over its part of the
texts: what the driver holds at a time is bounded, the counts stay the same.

A sum of vectors is the vector of the joined texts, so a task joins its documents
of one (lang, source), and cuts long ones, into texts of PIECE_TERMS terms. As
minDF only asks whether a term is in `min_docs` documents, a vectorizer is fitted
on layers instead of documents: layer j of a task has each term that is in j or
more of its documents, for j up to `min_docs`. A term in n documents of a task
thus counts as min(n, min_docs) there, and all tasks together reach `min_docs` for
the same terms.

With p = 1 + floor(SCALE (count + 1) / (N + V)) for each kept term of a group (V
terms, N their occurrences there), f(p, q) = floor((p - q)^2 / q) is summed over
all kept terms for each ordered pair of sources. Only counts above zero are stored:
for p0 and q0, the values of absent terms, a pair's sum is V f(p0, q0), corrected
for the terms of either side and of both. All numbers are whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import drop_path, join_spread, new_path, written

#: Fixed: A-Z become lower case, a-z and all bytes of characters above ASCII stay, all others part terms.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
SCALE = 1_000_000_000
#: Distinct terms in a vectorizer's documents; kept terms and sources that a task compares at a time.
SHARD_TERMS, CHUNK_TERMS, BLOCK_SOURCES = 1 << 21, 2048, 128
#: One term in so many is counted to estimate how many there are.
SAMPLE = 64
#: Terms in a joined text, most terms and most different ones that a task holds before it writes them.
PIECE_TERMS, HELD_TERMS, HELD_DISTINCT = 1 << 15, 1 << 21, 1 << 18
#: Places of the vocabulary whose counts are summed at a time (2^CELL_BITS), and counts that are sorted at a time.
CELL_BITS, SORTED = 14, 1 << 20
_ABSENT = "\0"
_TEXTS = "lang string, source string, words string, sample array<long>, key string, kind string"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8; none for a null text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class _Held:
    """What a task has met and not written: the terms of each (lang, source), and of each language those in few documents."""

    def __init__(self, min_docs: int) -> None:
        self.min_docs = min_docs
        self.full: dict[str, set[bytes]] = {}  # in min_docs documents, and in as many layers
        self.clear()

    def clear(self) -> None:
        self.pieces: dict[tuple[str, str], list[list[bytes]]] = {}
        self.ends: dict[tuple[str, str], int] = {}
        self.seen: dict[str, dict[bytes, int]] = {}
        self.terms = self.distinct = 0
        if sum(map(len, self.full.values())) > HELD_DISTINCT:
            self.full = {}

    def add(self, lang: str, source: str, found: list[bytes]) -> bool:
        """Hold a document's terms; whether enough are held to be written."""
        pieces, n = self.pieces.setdefault((lang, source), [[]]), self.ends.get((lang, source), 0)
        for at in range(0, len(found), PIECE_TERMS):
            part = found[at : at + PIECE_TERMS]
            if n + len(part) > PIECE_TERMS:
                pieces.append([])
                n = 0
            pieces[-1].append(b" ".join(part))
            n += len(part)
        self.ends[lang, source] = n
        seen, full = self.seen.setdefault(lang, {}), self.full.setdefault(lang, set())
        before = len(seen)
        for t in set(filterfalse(full.__contains__, found)):
            n = seen[t] = seen.get(t, 0) + 1
            if n == self.min_docs:
                full.add(t)
        self.terms += len(found)
        self.distinct += len(seen) - before
        return self.terms >= HELD_TERMS or self.distinct >= HELD_DISTINCT

    def rows(self) -> Iterator[pd.DataFrame]:
        """All that is held, some megabytes at a time."""
        out, size = [], 0
        for lang, source, kind, words, sample in self._rows():
            out.append((lang, source, kind, words.decode("utf-8", "surrogatepass"), sample))
            size += len(words)
            if size >= HELD_TERMS:
                yield pd.DataFrame(out, columns=["lang", "source", "kind", "words", "sample"])
                out, size = [], 0
        self.clear()
        yield pd.DataFrame(out, columns=["lang", "source", "kind", "words", "sample"])

    def _rows(self) -> Iterator[tuple[str, str, str, bytes, list[int]]]:
        for (lang, source), pieces in self.pieces.items():
            for p in pieces:
                yield lang, source, "texts", b" ".join(p), []
        for lang, seen in self.seen.items():
            left, j = list(seen), 1
            while left or j == 1:
                for at in range(0, max(1, len(left)), PIECE_TERMS):
                    part = left[at : at + PIECE_TERMS]
                    yield lang, "", "layers", b" ".join(part), [h for h in map(xxhash.xxh32_intdigest, part) if h % SAMPLE == 0] if j == 1 else []
                j += 1
                left = [t for t in left if seen[t] >= j]


def term_texts(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """key (a hash of lang), lang, source, kind, words (terms joined by spaces) and sample; nulls of `docs` as empty strings.

    Rows of kind 'texts' have all terms of the documents, by (lang, source); each of these has a row. Rows of kind
    'layers' have the layers of each language, in rows without a common term; the first layer's `sample` has the hashes
    of its terms that are divisible by SAMPLE.
    """
    none = F.lit("")
    rows = docs.select(F.coalesce("lang", none).alias("lang"), F.coalesce("source", none).alias("source"), "text")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Held(min_docs)
        for b in batches:
            for lang, source, text in zip(b["lang"], b["source"], b["text"], strict=True):
                if held.add(lang, source, terms(text)):
                    yield from held.rows()
        yield from held.rows()

    return rows.mapInPandas(each, "lang string, source string, kind string, words string, sample array<long>").withColumn("key", F.md5(F.col("lang").cast("binary")))


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    """key, shard, kind, source, words: the terms of each row by the shard of their hash."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, kind, source, words in zip(b["key"], b["kind"], b["source"], b["words"], strict=True):
                parts: dict[int, list[str]] = {}
                for t in words.split(" ") if words else ():
                    parts.setdefault(zlib.crc32(t.encode("utf-8", "surrogatepass")) % shards, []).append(t)
                out += [(key, k, kind, source, " ".join(p)) for k, p in parts.items()]
            yield pd.DataFrame(out, columns=["key", "shard", "kind", "source", "words"])

    return rows.mapInPandas(each, "key string, shard int, kind string, source string, words string")


def _summed(vectors: DataFrame, bits: int = CELL_BITS) -> DataFrame:
    """source, place, n: the sums of the sparse vectors (source, places, counts) of each source, in blocks of places."""

    def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends, at = np.cumsum(b["places"].value_lengths().to_numpy()), 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SORTED)))
            yield b.slice(at, to - at)
            at = to

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in cut(whole)):
            names = b["source"].dictionary_encode()
            of = np.repeat(names.indices.to_numpy().astype(np.int64), b["places"].value_lengths().to_numpy())
            cell = of << 31 | b["places"].flatten().to_numpy()
            order = np.argsort(cell, kind="stable")  # each vector is in order already
            cell = cell[order]
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            n = np.add.reduceat(b["counts"].flatten().to_numpy()[order], first) if len(first) else np.zeros(0)
            cell = cell[first]
            at = np.flatnonzero(np.diff(cell >> bits, prepend=-1))
            ends = pa.array(np.append(at, len(cell)).astype(np.int32))
            places, counts = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((cell & (1 << 31) - 1).astype(np.int32), n.astype(np.int64)))
            block = pa.array(((cell[at] & (1 << 31) - 1) >> bits).astype(np.int32))
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(cell[at] >> 31)), block, places, counts], ["source", "block", "places", "counts"])

    def total(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        source, block = key
        # Every sum of a batch is a whole number; those of all are kept in 64 bits.
        n = np.zeros(1 << bits, np.int64)
        for places, counts in zip(g["places"], g["counts"], strict=True):
            n[places - (block << bits)] += counts
        k = np.flatnonzero(n)
        return pd.DataFrame({"source": source, "place": (k + (block << bits)).astype(np.int32), "n": n[k]})

    parts = vectors.mapInArrow(blocks, "source string, block int, places array<int>, counts array<long>")
    return parts.groupBy("source", "block").applyInPandas(total, "source string, place int, n long")


def counted(path: str, spark: SparkSession, min_docs: int = 3, shard_terms: int = SHARD_TERMS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, id, n) for the kept terms with occurrences, and the vocabulary (lang, id, term); `path` has `term_texts` by key."""
    lists = spark.read.schema(_TEXTS).parquet(path)
    layers = lists.where("kind = 'layers'")
    near = layers.select("key", F.explode("sample").alias("h")).groupBy("key").agg(F.count_distinct("h").alias("n"))
    shards = max(1, -(-SAMPLE * (near.agg(F.max("n")).first()[0] or 0) // shard_terms))
    # One row a language, and one a language and shard.
    langs = dict(layers.select("key", "lang").distinct().collect())
    out = new_path(spark, "term-sums")
    if shards > 1:
        path = new_path(spark, "terms")
        _dealt(lists, shards).write.partitionBy("key", "shard", "kind").parquet(path)
    named = ["key", "shard"] if shards > 1 else ["key", F.lit(0).alias("shard")]
    there = spark.read.schema("words string, key string" + ", shard int" * (shards > 1) + ", kind string").parquet(path).where("kind = 'layers'").select(*named).distinct().collect()
    words = None
    for key, shard in sorted(tuple(r) for r in there):
        at = f"{path}/key={key}" + f"/shard={shard}" * (shards > 1)
        layers, texts = (spark.read.schema("source string, words string").parquet(f"{at}/kind={kind}").where("words <> ''").select("source", F.split("words", " ").alias("terms")) for kind in ("layers", "texts"))
        # A term that no text has keeps the vocabulary from being empty.
        absent = spark.range(min_docs).select(F.array(F.lit(_ABSENT)).alias("terms"))
        model = CountVectorizer(inputCol="terms", outputCol="v", minDF=float(min_docs), vocabSize=2**31 - 1).fit(layers.select("terms").unionByName(absent))
        # The vectors are summed as they come; they needn't be stored.
        v = F.unwrap_udt("v")
        cells = _summed(model.transform(texts).select("source", v["indices"].alias("places"), v["values"].alias("counts")))
        ident = F.lit(shard * 2**31).cast("long")
        cells.select(F.lit(langs[key]).alias("lang"), "source", (ident + F.col("place")).alias("id"), "n").write.option("compression", "zstd").parquet(f"{out}/key={key}/shard={shard}")
        model.save(at := new_path(spark, "vectorizer"))
        found = spark.read.parquet(f"{at}/data").select(F.posexplode("vocabulary").alias("place", "term")).where(F.col("term") != _ABSENT)
        found = found.select(F.lit(langs[key]).alias("lang"), (ident + F.col("place")).alias("id"), "term")
        words = found if words is None else words.unionByName(found)
    if words is None:
        return spark.createDataFrame([], "lang string, source string, id long, n long"), spark.createDataFrame([], "lang string, id long, term string")
    return spark.read.schema("lang string, source string, id long, n long, key string, shard int").parquet(out).drop("key", "shard"), words


def share(n: str, total: str) -> str:
    """SQL of 1 + floor(SCALE (n + 1) / total), exact for every bigint; decimals only where the product may not be one."""
    return f"CASE WHEN {n} < {2**63 // SCALE - 1} THEN 1 + ({SCALE}L * ({n} + 1L)) div ({total}) ELSE 1 + (cast({SCALE} AS decimal(18,0)) * (cast({n} AS decimal(20,0)) + 1)) div cast({total} AS decimal(20,0)) END"


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_sums(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """What the terms of two blocks of sources add to V f(p0, q0), and f(p0, q0), for each source of `left` and of `right`.

    Rows are (k, id, p), by the source's place k in its block; its value for absent terms is that of id -1.
    """
    p0, q0 = (x[x["id"] < 0].sort_values("k")["p"].to_numpy() for x in (left, right))
    (i, t, p), (j, u, q) = (tuple(x[x["id"] >= 0].sort_values("id")[c].to_numpy() for c in ("k", "id", "p")) for x in (left, right))
    out = np.zeros((len(p0), len(q0)), np.int64)
    for b in range(len(q0)):
        np.add.at(out[:, b], i, _f(p, q0[b]) - _f(p0[i], q0[b]))
    for a in range(len(p0)):
        np.add.at(out[a], j, _f(p0[a], q) - _f(p0[a], q0[j]))
    low, high = np.searchsorted(u, t), np.searchsorted(u, t, "right")
    ends = np.cumsum(high - low)
    at = 0
    while at < len(t):  # about a million matches at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20))))
        n = high[at:to] - low[at:to]
        x = np.repeat(np.arange(at, to), n)
        y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:to], n)
        both = _f(p[x], q[y]) - _f(p[x], q0[j[y]]) - _f(p0[i[x]], q[y]) + _f(p0[i[x]], q0[j[y]])
        np.add.at(out, (i[x], j[y]), both)
        at = to
    return out, _f(p0[:, None], q0[None, :])


def _pairs(values: DataFrame, groups: DataFrame, chunk: int, block: int) -> DataFrame:
    """lang, source, item, value for each ordered pair of sources of a language.

    A task compares two blocks of sources over one chunk of terms. Each chunk also has every source's value for
    absent terms, so that it needs nothing else.
    """
    chunks = F.greatest(F.lit(1), F.ceil(F.col("v") / chunk)).cast("int")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    of = groups.withColumns({"k": place, "chunks": chunks, "blocks": F.ceil(F.count("*").over(Window.partitionBy("lang")) / block).cast("int")})
    of = written(of, "source-places")
    named = ["lang", "k", "chunks", "blocks"]
    present = join_spread(values.select("lang", "source", "id", "p"), of.select("source", *named), "lang", "source")
    present = present.select(*named, "id", "p", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"))
    absent = of.select(*named, F.lit(-1).cast("long").alias("id"), F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    own, other = F.expr(f"cast(k div {block} AS int)"), F.sequence(F.lit(0), F.col("blocks") - 1)
    met = F.array_union(F.transform(other, lambda j: F.struct(own.alias("a"), j.alias("b"))), F.transform(other, lambda j: F.struct(j.alias("a"), own.alias("b"))))
    rows = present.unionByName(absent.select(*present.columns)).select("lang", "chunk", "k", "id", "p", F.explode(met).alias("m")).select("*", "m.a", "m.b").drop("m")

    def each(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        _, lang, a, b = key
        at = g["k"] // block
        left, right = (g[at == x].assign(k=g["k"] - x * block) for x in (a, b))
        got, base = pair_sums(left, right)
        s, t = (x.ravel() for x in np.meshgrid(np.arange(got.shape[0]), np.arange(got.shape[1]), indexing="ij"))
        out = pd.DataFrame({"lang": lang, "s": s + a * block, "t": t + b * block, "got": got.ravel(), "base": base.ravel()})
        return out[out["s"] != out["t"]]

    sums = rows.groupBy("chunk", "lang", "a", "b").applyInPandas(each, "lang string, s int, t int, got long, base long")
    sums = sums.groupBy("lang", "s", "t").agg(F.sum("got").alias("got"), F.max("base").alias("base"))
    sums = sums.join(of.select("lang", F.col("k").alias("s"), "source", "v"), ["lang", "s"]).join(of.select("lang", F.col("k").alias("t"), F.col("source").alias("item")), ["lang", "t"])
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", F.expr("got + v * base").alias("value"))


def audit(docs: DataFrame, min_docs: int = 3, most_terms: int = 200, shard_terms: int = SHARD_TERMS, chunk: int = CHUNK_TERMS, block: int = BLOCK_SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources of a language, and the terms that mark a source.

    `docs`: text, lang, source; further columns aren't read. Nulls are empty strings, each row is a document of its
    own (repeated rows and ids too), and groups without terms take part with a count of zero for each kept term. Equal
    values stand in the order of their items' UTF-8 bytes. A language whose terms are all too rare has pairs of value 0
    and no term rows; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = new_path(spark, "term-texts")
    term_texts(docs, min_docs).write.partitionBy("key", "kind").parquet(path)
    lists = spark.read.schema(_TEXTS).parquet(path)
    groups = written(lists.where("kind = 'texts'").select("lang", "source").distinct(), "term-groups")
    sums, words = counted(path, spark, min_docs, shard_terms)
    words = written(words, "kept-terms")
    drop_path(spark, path)
    kept = written(words.groupBy("lang").agg(F.count("*").alias("v")), "kept-sizes")
    totals = written(sums.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n")), "term-totals")
    groups = groups.join(totals.drop("n"), ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["total", "v"])
    groups = written(groups.withColumn("p0", F.expr(f"IF(v = 0, 1, {share('0', 'total + v')})")), "group-totals")
    values = written(join_spread(sums, groups.select("lang", "source", "total", "v"), "lang", "source", sizes=totals.drop("total")).selectExpr("lang", "source", "id", "n", f"{share('n', 'total + v')} AS p"), "term-values")
    in_lang = sums.groupBy("id", "lang").agg(F.sum("n").alias("n"))
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    # Each kept term occurs, so that a language has as many sums as kept terms.
    q = join_spread(in_lang, of_lang, "lang", sizes=kept.select("lang", F.col("v").alias("n"))).selectExpr("lang", "id", f"{share('n', 'total + v')} AS q")
    terms = values.join(q, ["id", "lang"]).where("p > q").select("lang", "source", "id", F.expr("((p - q) * (p - q)) div q").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # Terms of equal value all stay until their texts decide.
    terms = terms.withColumn("rank", F.rank().over(by_value)).where(F.col("rank") <= most_terms).join(words, ["id", "lang"])
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return _pairs(values, groups, chunk, block).withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= most_terms))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
           FROM documents),
o AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gt AS (SELECT g.*, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total FROM g),
p AS (SELECT gt.lang, gt.source, kept.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gt.total + v) AS p,
             1 + (1000000000::HUGEINT * (kept.n + 1)) // (v.total + v) AS q
      FROM gt JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x
                    JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
         ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
one AS (SELECT lang, source, 'pair' AS part, item, value FROM pair
        UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM one QUALIFY part = 'pair' OR rank <= 200
"""
