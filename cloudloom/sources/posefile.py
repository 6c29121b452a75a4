"""Binary pose and pose-cluster records, read from `binaryFile` rows and written as one file a partition."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

#: Magic numbers and the record's layout (votes have four bytes).
POSE_MAGIC, CLUSTER_MAGIC = 7673, 8462597
POSE = struct.Struct("<id ii 16d 3d 4d d".replace(" ", ""))
CLUSTER = struct.Struct("<iiii")

SCHEMA = (
    "path string, cluster_id int, cluster_votes int, pose_id long, angle double, num_votes int, model_index int, "
    "pose array<double>, t array<double>, q array<double>, residual double"
)


def pack(angle: float, votes: int, model: int, pose: list[float], t: list[float], q: list[float], residual: float) -> bytes:
    return POSE.pack(POSE_MAGIC, angle, votes, model, *pose, *t, *q, residual)


def pack_cluster(cluster_id: int, votes: int, poses: list[bytes]) -> bytes:
    return CLUSTER.pack(CLUSTER_MAGIC, cluster_id, votes, len(poses)) + b"".join(poses)


def _poses(data: bytes, at: int, n: int) -> Iterator[tuple]:
    for i in range(n):
        if len(data) < at + POSE.size:
            raise ValueError("truncated pose record")
        f = POSE.unpack_from(data, at)
        if f[0] != POSE_MAGIC:
            raise ValueError("not a pose record")
        yield i, f[1], f[2], f[3], list(f[4:20]), list(f[20:23]), list(f[23:27]), f[27]
        at += POSE.size


def records(data: bytes) -> list[tuple]:
    """Rows of one file, which holds poses or clusters one after another."""
    out, at = [], 0
    while at < len(data):
        magic = struct.unpack_from("<i", data, at)[0]
        if magic == CLUSTER_MAGIC:
            _, cid, votes, n = CLUSTER.unpack_from(data, at)
            out += [(cid, votes, *p) for p in _poses(data, at + CLUSTER.size, n)]
            at += CLUSTER.size + n * POSE.size
        else:
            _, *rest = next(_poses(data, at, 1))
            out.append((None, None, len(out), *rest))
            at += POSE.size
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a pose of all files under the path, in any store that Spark reads."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows = [(p, *r) for p, data in zip(b["path"], b["content"], strict=True) for r in records(data)]
            yield pd.DataFrame(rows, columns=names).astype({"cluster_id": "Int32", "cluster_votes": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(each, SCHEMA)


def write(poses: DataFrame, folder: str) -> int:
    """Write rows (as of `read`) to files poses-NNNNN.bin in a folder that Arrow's file systems open; returns how many poses.

    Rows with a cluster_id are written as clusters, each with all its rows of a partition; the frame should be
    partitioned by it. A file gets its name when it is complete, so a task that runs again replaces its file.
    """
    system, at = arrow_fs.FileSystem.from_uri(folder)
    system.create_dir(at, recursive=True)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain, clusters, n = [], {}, 0
        for b in batches:
            for r in b.to_dict("records"):
                one = pack(r["angle"], r["num_votes"], r["model_index"], list(r["pose"]), list(r["t"]), list(r["q"]), r["residual"])
                if pd.isna(r["cluster_id"]):
                    plain.append(one)
                else:
                    clusters.setdefault((int(r["cluster_id"]), int(r["cluster_votes"])), []).append(one)
                n += 1
        if n:
            task = TaskContext.get()
            system, at = arrow_fs.FileSystem.from_uri(folder)
            name = f"{at}/poses-{task.partitionId():05d}.bin"
            with system.open_output_stream(f"{name}.{task.taskAttemptId()}") as out:
                out.write(b"".join(plain) + b"".join(pack_cluster(c, v, ps) for (c, v), ps in sorted(clusters.items())))
            system.move(f"{name}.{task.taskAttemptId()}", name)
        yield pd.DataFrame({"n": [n]})

    return poses.mapInPandas(each, "n long").groupBy().sum("n").first()[0] or 0
