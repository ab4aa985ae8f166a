"""Vector codes by product quantisation, codebooks trained with adaptive bounds (Drake and Hamerly).

A vector is cut into parts, and each part position has a codebook. Between rounds every part keeps its entry, an
upper bound of the distance to it, the b entries closest to it with a lower bound each, and one outer bound for all
others. When entries move, bounds move by as much; ordered from the outside in, the j-th bound holds for the j-th
entry and all behind it. If the upper bound lies below the first, the entry stays and no distance is computed.
If it lies below the j-th, only the entries before that can win, and they are compared by whole-number distances;
if it reaches the outer bound, all are. So results are exact, ties included, however bounds are rounded: these are
kept in 32 bits, upper ones rounded up and lower ones down. b shrinks to what nearly all of the uncertain parts asked for.

Parts and bounds lie packed in chunks and are written to the shared folder after each round. Nothing is
shuffled but a task's sums by part and entry.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import drop_path, free_worker_tables, left_join_hot, new_path, stored
from punctual.llm.vectors import chunk_numbers, chunks, firsts, narrow, usable, wide

#: Closest entries kept at first, and at least; the share of uncertain parts that b is to serve.
MOST_NEAR, LEAST_NEAR, SERVED = 24, 2, 0.99
_RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
_STATE = "chunk long, ids array<long>, labels array<string>, vectors binary, bounds array<binary>, sums binary"


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


class Bounds:
    """Of n parts: entry, its upper bound, the near entries with their lower bounds, the outer bound."""

    def __init__(self, entry: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, outer: np.ndarray):
        self.entry, self.upper, self.near, self.lower, self.outer = entry, upper, near, lower, outer

    def packed(self) -> bytes:
        n, b = self.near.shape
        arrays = (self.entry.astype("<u2"), self.near.astype("<u2"), self.upper.astype("<f4"), self.lower.astype("<f4"), self.outer.astype("<f4"))
        return struct.pack("<II", n, b) + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def unpacked(cls, raw: bytes) -> Bounds:
        n, b = struct.unpack_from("<II", raw)
        at, out = 8, []
        for kind, count in (("<u2", n), ("<u2", n * b), ("<f4", n), ("<f4", n * b), ("<f4", n)):
            out.append(np.frombuffer(raw, kind, count, at))
            at += count * int(kind[2])
        entry, near, upper, lower, outer = out
        return cls(entry.astype(np.int64), upper.copy(), near.reshape(n, b).astype(np.int64), lower.reshape(n, b).copy(), outer.copy())

    def keep(self, b: int) -> None:
        """Of the near entries the first b stay; the outer bound takes in the others."""
        if b < self.near.shape[1]:
            self.outer = np.minimum(self.outer, self.lower[:, b:].min(1))
            self.near, self.lower = self.near[:, :b], self.lower[:, :b]


def _all_distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances to all entries, in whole numbers; by floating point where that is exact."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) < 1 << 21 and x.shape[1] <= 256:
        f, g = x.astype(np.float64), book.astype(np.float64)
        return ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)).astype(np.int64)
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)


def fresh(x: np.ndarray, book: np.ndarray, b: int) -> Bounds:
    """Bounds from the distances to all entries."""
    b = min(b, len(book) - 1)
    d = _all_distances(x, book)
    entry = d.argmin(1)
    every = np.arange(len(x))
    upper = _up(np.sqrt(d[every, entry]))
    d[every, entry] = -1  # first of all, also among equals
    near = np.argpartition(d, b, 1)[:, : b + 1]
    near = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1), 1)[:, 1:]
    outer = np.full(len(x), np.inf, np.float32)
    if b + 1 < len(book):
        outer = _down(np.sqrt(np.partition(d, b + 1, 1)[:, b + 1]))
    return Bounds(entry, upper, near, _down(np.sqrt(np.take_along_axis(d, near, 1))), outer)


def advance(x: np.ndarray, book: np.ndarray, moved: np.ndarray, bounds: Bounds, b: int) -> tuple[Bounds, np.ndarray]:
    """Bounds after entries have moved to book, by at most `moved`; and how many parts asked for 0, 1, ... near entries, at last for all."""
    bounds.keep(b)
    near = bounds.near
    b = near.shape[1]
    bounds.upper = _up(bounds.upper.astype(np.float64) + moved[bounds.entry])
    bounds.lower = _down(bounds.lower.astype(np.float64) - moved[near])
    bounds.outer = _down(bounds.outer.astype(np.float64) - moved.max())
    ordered = np.minimum.accumulate(np.concatenate([bounds.lower, bounds.outer[:, None]], 1)[:, ::-1], 1)[:, ::-1]
    asks = np.zeros(b + 2, np.int64)
    unsure = np.flatnonzero(bounds.upper >= ordered[:, 0])
    own = ((x[unsure] - book[bounds.entry[unsure]]) ** 2).sum(1)
    bounds.upper[unsure] = _up(np.sqrt(own))
    wanted = (ordered[unsure] <= bounds.upper[unsure, None]).sum(1)
    asks += np.bincount(wanted, minlength=b + 2)
    asks[0] += len(x) - len(unsure)
    some = (wanted > 0) & (wanted <= b)
    rows, q, own = unsure[some], wanted[some], own[some]
    if len(rows):
        most = int(q.max())
        listed = near[rows, :most]
        d = ((x[rows][:, None, :] - book[listed]) ** 2).sum(2)
        asked = np.arange(most) < q[:, None]
        d = np.concatenate([own[:, None], np.where(asked, d, np.iinfo(np.int64).max)], 1)
        entries = np.concatenate([bounds.entry[rows, None], listed], 1)
        order = np.lexsort((entries, d), axis=1)
        d, entries = np.take_along_axis(d, order, 1), np.take_along_axis(entries, order, 1)
        bounds.entry[rows], bounds.upper[rows] = entries[:, 0], _up(np.sqrt(d[:, 0]))
        near[rows, :most] = np.where(asked, entries[:, 1:], listed)
        bounds.lower[rows, :most] = np.where(asked, _down(np.sqrt(np.where(asked, d[:, 1:], 0))), bounds.lower[rows, :most])
    rows = unsure[wanted > b]
    if len(rows):
        anew = fresh(x[rows], book, b)
        bounds.entry[rows], bounds.upper[rows], bounds.near[rows], bounds.lower[rows], bounds.outer[rows] = anew.entry, anew.upper, anew.near, anew.lower, anew.outer
    return bounds, asks


def _unpacked_chunks(batches):
    for batch in batches:
        for row in batch.to_pylist():
            yield row["chunk"], row["ids"], row["labels"], row["vectors"], row["bounds"]


def _new_chunks(batches, dims: int, scale: int):
    number = chunk_numbers()
    for part, rows in chunks(batches, 2, dims, scale):
        yield next(number), part.column(0).to_pylist(), part.column(1).to_pylist(), narrow(rows), None


def _sums(parts: list[np.ndarray], codes: np.ndarray, totals: list[np.ndarray]) -> None:
    for x, entry, total in zip(parts, codes.T, totals, strict=True):
        np.add.at(total[:, 1:], entry, x)
        total[:, 0] += np.bincount(entry, minlength=len(total))


def _assign(vectors: bytes, bounds: list[bytes] | None, books: np.ndarray, moved: np.ndarray | None, b: int) -> tuple[list[np.ndarray], list[Bounds], np.ndarray]:
    """Parts, their bounds and how many near entries they asked for."""
    n_parts, _, width = books.shape
    x = wide(vectors, n_parts * width)
    parts = [x[:, p * width : (p + 1) * width] for p in range(n_parts)]
    if bounds is None:
        return parts, [fresh(x, book, b) for x, book in zip(parts, books, strict=True)], np.zeros(0, np.int64)
    found = [advance(x, book, m, Bounds.unpacked(raw), b) for x, book, m, raw in zip(parts, books, moved, bounds, strict=True)]
    return parts, [f for f, _ in found], sum(a for _, a in found)


def _round(source: DataFrame, first: bool, books: np.ndarray, moved: np.ndarray | None, b: int, scale: int) -> DataFrame:
    """All chunks with new bounds; the last row of a task has the sums of its parts by entry and no chunk."""
    n_parts, k, width = books.shape

    def run(batches):
        free_worker_tables()
        totals, asked = [np.zeros((k, 1 + width), np.int64) for _ in range(n_parts)], np.zeros(MOST_NEAR + 2, np.int64)
        for chunk, ids, labels, vectors, bounds in _new_chunks(batches, n_parts * width, scale) if first else _unpacked_chunks(batches):
            parts, found, asks = _assign(vectors, bounds, books, moved, b)
            asked[: len(asks)] += asks
            _sums(parts, np.stack([f.entry for f in found], 1), totals)
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "ids": ids, "labels": labels, "vectors": vectors, "bounds": [f.packed() for f in found]}], schema=arrow)
        yield pa.RecordBatch.from_pylist([{"sums": np.concatenate([*(t.ravel() for t in totals), asked]).astype("<i8").tobytes()}], schema=arrow)

    arrow = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("vectors", pa.binary()), ("bounds", pa.list_(pa.binary())), ("sums", pa.binary())])
    return source.mapInArrow(run, _STATE)


def _next_books(rows: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks from the tasks' sums, and how many parts asked for 0, 1, ... near entries."""
    n_parts, k, width = books.shape
    fields = [f"s{j}" for j in range(width)]

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                flat = np.frombuffer(raw, "<i8")
                totals = flat[: n_parts * k * (1 + width)].reshape(n_parts * k, 1 + width)
                used = np.flatnonzero(totals[:, 0])
                asks = flat[len(totals) * (1 + width) :]
                rows = np.concatenate([totals[used], np.pad(asks[:, None], ((0, 0), (0, width)))])
                names = [np.concatenate([used // k, np.full(len(asks), -1)]), np.concatenate([used % k, np.arange(len(asks))])]
                yield pa.RecordBatch.from_arrays([pa.array(names[0], pa.int32()), pa.array(names[1], pa.int32()), *map(pa.array, rows.T)], ["part", "entry", "n", *fields])

    long = rows.where("sums is not null").select("sums").mapInArrow(run, f"part int, entry int, n long, {', '.join(f'{f} long' for f in fields)}")
    out, asks = books.copy(), np.zeros(MOST_NEAR + 2, np.int64)
    for row in long.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f).alias(f) for f in fields]).collect():  # a row for each part and entry
        if row.part < 0:
            asks[row.entry] = row.n
        else:
            out[row.part, row.entry] = np.array(row[3:], np.int64) // row.n
    return out, asks


def _next_near(asks: np.ndarray, b: int) -> int:
    """b for the next round: what SERVED of the uncertain parts asked for; those that asked for all count as b."""
    wanted = np.bincount(np.minimum(np.arange(1, len(asks)), b), asks[1:], b + 1)
    if not wanted.sum():
        return max(LEAST_NEAR, b // 2)
    return min(b, max(LEAST_NEAR, int(np.searchsorted(np.cumsum(wanted), SERVED * wanted.sum()))))


def coded(embeddings: DataFrame, n_parts: int = 4, entries: int = 256, rounds: int = 4, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector.

    Usable are vectors of exactly dims components, none null, NaN or infinite; component x counts as
    floor(scale * x), at most 2^27 in size. A part position's codebook starts as that part of the vectors with
    the smallest ids, ascending (of equal ids by components; a null id starts no entry; with fewer vectors there
    are fewer entries; at most 256). Ties go to the lower index, unused entries stay. Repeated rows are rows of
    their own; label_error sums over equal labels, nulls together, and is null beyond 64 bits; an empty table gives no rows. Columns
    other than these three are not read, whatever their names. Nothing here depends on texts.
    """
    if entries > 256 or dims % n_parts:
        raise ValueError("a code is a byte a part, and parts are equal")
    spark, width = embeddings.sparkSession, dims // n_parts
    kept = embeddings.where(usable(F.col(vec_col), dims)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("v"))
    start = firsts(kept.where("id is not null"), entries, F.col("id"), vec_col="v", dims=dims, scale=scale)
    if not len(start):
        return spark.createDataFrame([], _RESULT)
    books = np.ascontiguousarray(start.reshape(len(start), n_parts, width).transpose(1, 0, 2))  # n_parts * entries * width numbers
    moved, b, path, source = None, MOST_NEAR, None, kept
    for k in range(rounds):
        before, path = path, new_path(spark, "vector-bounds")
        _round(source, k == 0, books, moved, b, scale).write.parquet(path)
        if before:
            drop_path(spark, before)
        source = spark.read.schema(_STATE).parquet(path)
        after, asks = _next_books(source, books)
        source = source.where("chunk is not null")
        moved = np.nextafter(np.sqrt(((after - books) ** 2).sum(2).astype(np.float64)), np.inf)
        books, b = after, _next_near(asks, b) if k else b
    shown = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def last(batches):
        for _, ids, labels, vectors, bounds in _new_chunks(batches, dims, scale) if not rounds else _unpacked_chunks(batches):
            parts, found, _ = _assign(vectors, bounds, books, moved, b)
            error = sum(((x - book[f.entry]) ** 2).sum(1) for x, book, f in zip(parts, books, found, strict=True))
            codes = np.stack([f.entry for f in found], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array([c.tobytes().hex() for c in codes]), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    rows = stored(source.mapInArrow(last, "vec_id long, label string, code string, error long"), "vector-codes")
    if path:
        drop_path(spark, path)
    key = F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))
    by_label = rows.groupBy(key.alias("key")).agg(F.try_sum("error").alias("label_error"))
    return left_join_hot(rows.withColumn("key", key), by_label, "key", "vec_id").select("vec_id", "code", "error", "label_error", F.lit(shown).alias("codebooks_sha256"))
