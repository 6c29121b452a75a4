"""Token-id files of independent zstandard frames with a trailing seek table.

Layout of a file, all integers little-endian:

- data frames: each an independent zstandard frame (with its own content checksum)
  of unsigned 32-bit ids. A frame holds whole documents up to FRAME_IDS ids, or a
  FRAME_IDS part of a longer document.
- a skippable frame with the directory: the zstandard frame of the documents'
  doc_ids (int64, with a null mask) and id counts (int64), in file order.
- a skippable frame with the seek table: for each frame before it the compressed
  size, decompressed size (0 for the directory) and the low 32 bits of XXH64 of
  the content; then the number of frames, a flag byte and a closing magic number.

A reader takes the last 9 bytes, the seek table and the directory, and then reads
and decompresses only the frames that hold the documents asked for. Files are
written by range partitions of doc_id, so the files in order of their numbers
hold ascending doc_ids.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import xxhash
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encode
from .shared import new_path, partitions, written

#: Fixed values of the zstandard seekable format.
SKIPPABLE_DIRECTORY = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<III")
HEAD = struct.Struct("<II")

FRAME_IDS, FILE_CHARS = 1 << 16, 64 << 20


class Writer:
    """Writes documents' ids to a binary stream; `close` adds the directory and the seek table."""

    def __init__(self, out, level: int = 3):
        self.out = out
        self.codec = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[bytes] = []
        self.held_bytes = 0
        self.entries: list[tuple[int, int, int]] = []
        self.doc_ids: list[int] = []
        self.nulls: list[bool] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        most = 4 * FRAME_IDS
        if self.held_bytes + len(ids) > most:
            self._flush()
        for at in range(0, len(ids), most):
            part = ids[at : at + most]
            self.held.append(part)
            self.held_bytes += len(part)
            if self.held_bytes >= most:
                self._flush()

    def _flush(self) -> None:
        if self.held:
            data = b"".join(self.held)
            frame = self.codec.compress(data)
            self.out.write(frame)
            self.entries.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self._flush()
        columns = (np.array(self.doc_ids, "<i8"), np.array(self.counts, "<i8"), np.array(self.nulls, "u1"))
        plain = b"".join(c.tobytes() for c in columns)
        data = self.codec.compress(plain)
        self.out.write(HEAD.pack(SKIPPABLE_DIRECTORY, len(data)) + data)
        self.entries.append((HEAD.size + len(data), 0, xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        table = b"".join(ENTRY.pack(*e) for e in self.entries) + FOOTER.pack(len(self.entries), CHECKSUMS, SEEK_MAGIC)
        self.out.write(HEAD.pack(SKIPPABLE_SEEK, len(table)) + table)


@dataclass
class Reader:
    """Reads documents of one file (a seekable binary stream)."""

    file: object

    def __post_init__(self):
        f = self.file
        end = f.seek(0, 2)
        f.seek(end - FOOTER.size)
        n, flags, magic = FOOTER.unpack(f.read(FOOTER.size))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        f.seek(end - FOOTER.size - n * ENTRY.size)
        table = np.frombuffer(f.read(n * ENTRY.size), "<u4").reshape(n, 3).astype(np.int64)
        self.sums = table[:, 2]
        self.at = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.ids_at = np.concatenate([[0], np.cumsum(table[:, 1]) // 4])
        self.frames_read = 0
        f.seek(int(self.at[-2]))
        size = HEAD.unpack(f.read(HEAD.size))[1]
        plain = self._checked(zstandard.ZstdDecompressor().decompress(f.read(size)), n - 1)
        docs = len(plain) // 17
        self.doc_ids = np.frombuffer(plain, "<i8", docs)
        self.counts = np.frombuffer(plain, "<i8", docs, 8 * docs)
        self.nulls = np.frombuffer(plain, "u1", docs, 16 * docs).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def _checked(self, data: bytes, frame: int) -> bytes:
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[frame]:
            raise ValueError(f"frame {frame}: wrong checksum")
        return data

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.at[k]))
        self.frames_read += 1
        data = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.at[k + 1] - self.at[k])))
        return self._checked(data, k)

    def parts(self, places: Iterable[int]) -> Iterator[tuple[int, bytes]]:
        """(place, ids) of the documents at these ascending places; a long document comes in several parts."""
        held, data = -1, b""
        for i in places:
            lo, hi = int(self.starts[i]), int(self.starts[i + 1])
            k = int(np.searchsorted(self.ids_at, lo, "right")) - 1
            if lo == hi:
                yield i, b""
            while lo < hi:
                if k != held:
                    held, data = k, self.frame(k)
                base = int(self.ids_at[k])
                stop = min(hi, int(self.ids_at[k + 1]))
                yield i, data[4 * (lo - base) : 4 * (stop - base)]
                lo, k = stop, k + 1

    def documents(self, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
        """The ids of the documents asked for, those that the file has; only their frames are read."""
        want = np.isin(self.doc_ids, np.array(list(doc_ids), np.int64)) & ~self.nulls
        out: dict[int, list[bytes]] = {}
        for i, part in self.parts(np.flatnonzero(want).tolist()):
            out.setdefault(int(self.doc_ids[i]), []).append(part)
        return {d: np.frombuffer(b"".join(p), "<u4") for d, p in out.items()}


def _system(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """Arrow's file system and path of a URI; s3a, which only Hadoop knows by this name, is s3."""
    return arrow_fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def _opened(uri: str):
    system, path = _system(uri)
    return system.open_input_file(path)


def write(docs: DataFrame, path: str | None = None, end: int = 0, files: int | None = None, folder: str | None = None) -> DataFrame:
    """Write the ids of all whole texts; returns one row for each file: part, uri, docs, ids.

    A null text counts as empty, and each document ends with the id `end`. Null doc_ids
    come first; repeated ones stand side by side. Rows of a lost task are written again
    under the same name: a file gets its name when it is complete. `folder` must be a store that
    Arrow reads; without it files go to the shared folder and are deleted with the application.
    Files hold about FILE_CHARS characters of text each, so their directories stay small.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    folder = folder or new_path(spark, "zstd-ids")
    system, local = _system(folder)
    system.create_dir(local, recursive=True)
    if files is None:
        chars = docs.select(F.length("text").alias("n")).agg(F.sum("n")).first()[0] or 0
        files = max(partitions(spark), -(-chars // FILE_CHARS))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, task = encode.table(path), TaskContext.get()
        tail = np.array([end], "<u4").tobytes()
        system, to = _system(folder)
        name = f"{to}/ids-{task.partitionId():06d}.zst"
        partial = f"{to}/.ids-{task.partitionId():06d}-{task.taskAttemptId()}"
        with system.open_output_stream(partial) as out:
            w = Writer(out)
            for b in batches:
                for d, ids in zip(b["doc_id"], table.encode([x or "" for x in b["text"]]), strict=True):
                    w.add(None if pd.isna(d) else int(d), ids + tail)
            w.close()
        system.move(partial, name)
        uri = f"{folder}/ids-{task.partitionId():06d}.zst"
        yield pd.DataFrame({"part": [task.partitionId()], "uri": [uri], "docs": [len(w.counts)], "ids": [sum(w.counts)]})

    tie = F.xxhash64("text")
    rows = docs.select("doc_id", "text").repartitionByRange(files, "doc_id", tie)
    rows = rows.sortWithinPartitions("doc_id", tie)
    return written(rows.mapInPandas(each, "part int, uri string, docs long, ids long"), "zstd-files")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files' frames.

    `start` counts the ids of all documents before it; the files' own starts are summed by
    blocks of 1024 files, so no task holds all files.
    """
    f = files.withColumn("block", F.floor(F.col("part") / 1024))
    sums = f.groupBy("block").agg(F.sum("ids").alias("m"))
    sums = sums.selectExpr("block", "coalesce(sum(m) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    f = f.withColumn("within", F.expr("sum(ids) OVER (PARTITION BY block ORDER BY part ROWS UNBOUNDED PRECEDING) - ids"))
    f = f.join(sums, "block").select("uri", (F.col("before") + F.col("within")).alias("base"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri, base in zip(b["uri"], b["base"], strict=True):
                with _opened(uri) as file:
                    r = Reader(file)
                    crc = np.zeros(len(r.counts), np.int64)
                    for i, part in r.parts(range(len(r.counts))):
                        crc[i] = zlib.crc32(part, int(crc[i]))
                ids = pd.Series(r.doc_ids, dtype="Int64").mask(r.nulls)
                for at in range(0, len(ids), 10_000):
                    s = slice(at, at + 10_000)
                    yield pd.DataFrame({"doc_id": ids[s], "start": base + r.starts[:-1][s], "n_tokens": r.counts[s], "ids_crc32": crc[s]})

    n = max(1, min(files.count(), 4 * partitions(files.sparkSession)))
    return f.repartition(n, "uri").mapInPandas(each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame) -> DataFrame:
    return read(write(docs))
