"""A Spark data source for PLY files: ASCII and both binary byte orders.

    spark.dataSource.register(PlySource)
    spark.read.format("ply").load("/path/*.ply")
    cloud.write.format("ply").option("encoding", "ascii").mode("overwrite").save("/path")

Rows are (file, pt_id, x, y, z, nx, ny, nz); normals are null where a file has none.
A file is one partition, and its rows leave the task as Arrow batches. The writer makes one
file for each partition, with colours where the rows have red, green and blue. The data source
opens paths on the executors; `read` takes any store that Spark reads.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, pt_id long, x double, y double, z double, nx double, ny double, nz double"
#: The format's type names and their numpy types.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
ORDERS = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": ""}
COLUMNS = ["x", "y", "z", "nx", "ny", "nz"]


class PlyError(ValueError):
    pass


@dataclass
class Header:
    encoding: str
    elements: list[tuple[str, int, list[tuple[str, str]]]]
    size: int


def header(data: bytes) -> Header:
    """The header at the start of `data`; a list property's type is written "list <count> <item>"."""
    end = re.search(rb"end_header\r?\n", data)
    lines = data[: end.end()].decode("ascii", "replace").splitlines() if end else []
    if not lines or lines[0].strip() != "ply":
        raise PlyError("not a PLY header")
    encoding, elements = None, []
    for line in lines[1:]:
        w = line.split()
        if not w or w[0] in ("comment", "obj_info", "end_header"):
            continue
        if w[0] == "format":
            encoding = w[1]
        elif w[0] == "element":
            elements.append((w[1], int(w[2]), []))
        elif w[0] == "property" and elements:
            kinds = w[2:4] if w[1] == "list" else [w[1]]
            if any(k not in TYPES for k in kinds):
                raise PlyError(f"unknown type in: {line}")
            elements[-1][2].append((w[-1], " ".join(["list", *kinds] if w[1] == "list" else kinds)))
    if encoding not in ORDERS:
        raise PlyError("no known format line")
    return Header(encoding, elements, end.end())


def vertices(data: bytes) -> dict[str, np.ndarray]:
    """The columns of the element `vertex`."""
    h = header(data)
    order, at = ORDERS[h.encoding], h.size
    text = data[at:].decode("ascii", "replace").split("\n") if not order else []
    for name, n, props in h.elements:
        plain = not any(k.startswith("list") for _, k in props)
        if name == "vertex" and not plain:
            raise PlyError("list properties of vertices aren't supported")
        if not order:
            rows, text = text[:n], text[n:]
            if name == "vertex":
                values = np.array([r.split()[: len(props)] for r in rows if r.strip()], float) if n else np.zeros((0, len(props)))
                if values.shape != (n, len(props)):
                    raise PlyError("truncated body")
                return {p: values[:, i] for i, (p, _) in enumerate(props)}
        elif plain:
            kind = np.dtype([(p, order + TYPES[k]) for p, k in props])
            if len(data) < at + n * kind.itemsize:
                raise PlyError("truncated body")
            if name == "vertex":
                got = np.frombuffer(data, kind, n, at)
                return {p: got[p].astype(float) for p, _ in props}
            at += n * kind.itemsize
        else:
            for _ in range(n):
                for _, k in props:
                    parts = k.split()
                    if parts[0] != "list":
                        at += np.dtype(TYPES[k]).itemsize
                        continue
                    count = np.frombuffer(data, order + TYPES[parts[1]], 1, at)[0]
                    at += np.dtype(TYPES[parts[1]]).itemsize + int(count) * np.dtype(TYPES[parts[2]]).itemsize
    raise PlyError("no element vertex")


def encoded(rows: np.ndarray, encoding: str, colours: np.ndarray | None = None) -> bytes:
    """A PLY file of rows x y z nx ny nz, with optional red green blue."""
    names = COLUMNS + (["red", "green", "blue"] if colours is not None else [])
    kinds = ["float64"] * 6 + ["uchar"] * (len(names) - 6)
    head = ["ply", f"format {encoding} 1.0", f"element vertex {len(rows)}"]
    head += [f"property {'double' if k == 'float64' else k} {n}" for n, k in zip(names, kinds, strict=True)]
    out = ("\n".join([*head, "end_header"]) + "\n").encode()
    if encoding == "ascii":
        extra = colours.tolist() if colours is not None else [[]] * len(rows)
        return out + "".join(" ".join(map(repr, [*r, *c])) + "\n" for r, c in zip(rows.tolist(), extra, strict=True)).encode()
    order = ORDERS[encoding]
    block = np.zeros(len(rows), np.dtype([(n, order + ("f8" if k == "float64" else "u1")) for n, k in zip(names, kinds, strict=True)]))
    for i, n in enumerate(COLUMNS):
        block[n] = rows[:, i]
    if colours is not None:
        for i, n in enumerate(("red", "green", "blue")):
            block[n] = colours[:, i]
    return out + block.tobytes()


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        where = re.sub("^file:(//)?", "", path)
        self.paths = sorted(glob.glob(os.path.join(where, "*.ply") if os.path.isdir(where) else where))
        if not self.paths:
            raise PlyError(f"no file at {path}")

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            yield from _batches(os.path.basename(partition.path), f.read())


#: Rows of an Arrow batch.
ROWS = 65_536
ARROW = pa.schema([("file", pa.string()), ("pt_id", pa.int64()), *[(c, pa.float64()) for c in COLUMNS]])


def _batches(name: str, data: bytes) -> Iterator[pa.RecordBatch]:
    got = vertices(data)
    n = len(got["x"])
    for at in range(0, n, ROWS):
        size = min(ROWS, n - at)
        columns = [pa.array(got[c][at : at + size]) if c in got else pa.nulls(size, pa.float64()) for c in COLUMNS]
        yield pa.RecordBatch.from_arrays([pa.array([name] * size, pa.string()), pa.array(np.arange(at, at + size)), *columns], schema=ARROW)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The points of all files under the path, in any store that Spark reads; `file` is the file's name."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                yield from _batches(p.rsplit("/", 1)[-1], data)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(each, SCHEMA)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, encoding: str, colours: bool):
        self.path, self.encoding, self.colours = re.sub("^file:(//)?", "", path), encoding, colours
        os.makedirs(self.path, exist_ok=True)

    def write(self, rows):
        from pyspark import TaskContext

        task = TaskContext.get()
        names = COLUMNS + (["red", "green", "blue"] if self.colours else [])
        values = np.array([[r[c] if r[c] is not None else 0.0 for c in names] for r in rows], float).reshape(-1, len(names))
        if not len(values):
            return WriterCommitMessage()
        name = f"{self.path}/part-{task.partitionId():05d}.ply"
        partial = f"{name}.{task.taskAttemptId()}"
        with open(partial, "wb") as f:
            f.write(encoded(values[:, :6], self.encoding, values[:, 6:].astype(np.uint8) if self.colours else None))
        os.replace(partial, name)
        return WriterCommitMessage()


class PlySource(DataSource):
    @classmethod
    def name(cls):
        return "ply"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], self.options.get("encoding", "binary_little_endian"), {"red", "green", "blue"} <= set(schema.names))


def normal_tips(cloud, length: float = 1.0):
    """The cloud and the tips of its normals: red, green, blue tell them apart."""
    from pyspark.sql import functions as F

    base = cloud.select(*COLUMNS, *[F.lit(0).alias(c) for c in ("red", "green", "blue")])
    tips = cloud.select(
        *[(F.col(c) + length * F.col(f"n{c}")).alias(c) for c in "xyz"], "nx", "ny", "nz",
        F.lit(255).alias("red"), F.lit(0).alias("green"), F.lit(0).alias("blue"),
    )
    return base.unionByName(tips)


