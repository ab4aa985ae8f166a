"""Centroid clustering by dimension-sharded Lloyd rounds.

A vector's components are dealt over column blocks, each a shard of its own: a task holds some chunks of one
block and the same columns of the centroids, and gives the exact partial distances of its rows. Partial
distances of a chunk are added over the blocks, and the sum's least entry is the assignment. Assignments go
back to every block, which sums its own columns by cluster and so updates its own slice of the centroids.

What a round moves is a number for each vector, centroid and block, never vectors with all their components;
what reaches the driver is a row for each block and cluster.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import free_worker_tables, new_path, stored
from punctual.llm.vectors import chunk_numbers, chunks, firsts, narrow, usable, wide

#: Columns of a block.
WIDTH = 32
_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _shards(kept: DataFrame, id_col: str, vec_col: str, dims: int, scale: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Packed column blocks (chunk, block, part), stored by block, and the ids of each chunk."""
    kept = kept.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))

    def run(batches):
        free_worker_tables()
        number = chunk_numbers()
        for part, rows in chunks(batches, 1, dims, scale):
            chunk, blocks = next(number), range(0, dims, width)
            listed = pa.array([*[None] * len(blocks), part.column(0).to_pylist()], pa.list_(pa.int64()))
            packed = [narrow(rows[:, b : b + width]) for b in blocks]
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * (len(packed) + 1), pa.int64()), pa.array([*range(len(packed)), -1], pa.int32()), pa.array([*packed, None], pa.binary()), listed], ["chunk", "block", "part", "ids"])

    path, schema = new_path(kept.sparkSession, "vector-blocks"), "chunk long, block int, part binary, ids array<long>"
    kept.mapInArrow(run, schema).write.partitionBy("block").parquet(path)
    rows = kept.sparkSession.read.schema(schema).parquet(path)
    return rows.where("block >= 0").select("chunk", "block", "part"), rows.where("block = -1").select("chunk", "ids")


def _assigned(shards: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """chunk, labels and distances of every chunk: partial distances by block, added up, and their least entry (of equals the first)."""
    k, dims = centroids.shape
    slices = {b: centroids[:, b * width : (b + 1) * width] for b in range(-(-dims // width))}  # k x dims numbers in all

    def partial(batches):
        for batch in batches:
            for chunk, block, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = slices[block]
                x = wide(part, own.shape[1])
                d = (x * x).sum(1)[:, None] - 2 * (x @ own.T) + (own * own).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([narrow(d)], pa.binary())], ["chunk", "partial"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(wide(p, k) for p in table["partial"].to_pylist())
        labels = total.argmin(1)
        return pa.table({"chunk": table["chunk"][:1], "labels": pa.array([narrow(labels)], pa.binary()), "distances": pa.array([narrow(total[np.arange(len(total)), labels])], pa.binary())})

    return shards.mapInArrow(partial, "chunk long, partial binary").groupBy("chunk").applyInArrow(added, "chunk long, labels binary, distances binary")


def _updated(shards: DataFrame, assigned: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """The centroids after a round: each block sums its own columns by cluster."""
    k, dims = centroids.shape
    sums = [f"s{j}" for j in range(width)]

    def summed(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part, labels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                columns = min(width, dims - block * width)
                own = totals.setdefault(block, np.zeros((k, 1 + width), np.int64))
                label = wide(labels, 1)[:, 0]
                np.add.at(own[:, 1 : 1 + columns], label, wide(part, columns))
                own[:, 0] += np.bincount(label, minlength=k)
        for block, own in totals.items():
            used = np.flatnonzero(own[:, 0])
            columns = [pa.array([block] * len(used), pa.int32()), pa.array(used, pa.int32()), *map(pa.array, own[used].T)]
            yield pa.RecordBatch.from_arrays(columns, ["block", "cluster", "n", *sums])

    by_task = shards.join(assigned.select("chunk", "labels"), "chunk").select("block", "part", "labels").mapInArrow(summed, f"block int, cluster int, n long, {', '.join(f'{s} long' for s in sums)}")
    out = centroids.copy()
    for row in by_task.groupBy("block", "cluster").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).collect():  # a row for each block and cluster
        at = range(row.block * width, min(dims, (row.block + 1) * width))
        out[row.cluster, at.start : at.stop] = np.array(row[3 : 3 + len(at)], np.int64) // row.n
    return out


def clustered(embeddings: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vec_col: str = "embedding", width: int = WIDTH) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every usable vector.

    Usable are vectors of exactly dims components, none null, NaN or infinite; component x counts as
    floor(scale * x), at most 2^27 in size. Centroids 0, 1, ... start as the k vectors with the least
    SHA-256 of '<seed>:<vec_id>' (of equal ids by components; a null id starts none; with fewer than k vectors
    there are fewer centroids). Ties go to the smaller number, empty clusters keep their centroid. Repeated
    ids and vectors are rows of their own; an empty table gives no rows; inertia beyond 64 bits is null.
    Columns other than these two are not read, whatever their names. Nothing here depends on texts.
    """
    spark = embeddings.sparkSession
    kept = embeddings.where(usable(F.col(vec_col), dims)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vector"))
    named = kept.where("vec_id is not null")
    centroids = firsts(named, k, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), vec_col="vector", dims=dims, scale=scale)
    if not len(centroids):
        return spark.createDataFrame([], _RESULT)
    shards, ids = _shards(kept, "vec_id", "vector", dims, scale, width)
    for _ in range(rounds):
        centroids = _updated(shards, _assigned(shards, centroids, width), centroids, width)
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def unpacked(batches):
        for batch in batches:
            for own, labels, distances in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                label = wide(labels, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([own.values, pa.array(label, pa.int32()), pa.array(wide(distances, 1)[:, 0]), pa.array([shown[c] for c in label.tolist()])], ["vec_id", "cluster", "distance", "centroid_sha256"])

    last = ids.join(_assigned(shards, centroids, width), "chunk").select("ids", "labels", "distances")
    rows = stored(last.mapInArrow(unpacked, "vec_id long, cluster int, distance long, centroid_sha256 string"), "clusters")
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    held = lambda x: int(x) if x < 1 << 63 else None
    by_cluster = spark.createDataFrame([(c, held(x)) for c, x in sums.items()], "cluster int, cluster_inertia long")
    total = F.lit(held(sum(sums.values()))).cast("long")
    return rows.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")
