"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Documents are encoded, ordered by doc_id and packed into blocks. Within a block
the lengths of documents come first and then all ids as frequency ranks, both
in the same coding: a rank takes one to four bytes, its count of bytes less one
stands as two bits in a separate run of control bytes, four ranks a byte. The
most frequent 256 ids so take ten bits each. A numpy table gives for each
control byte the places of its four values, so a block is decoded without a
loop over ids.

A file is Parquet with one row a block (part, block, n_docs, n_tokens, doc ids,
control and data bytes), so that any store Spark writes to will do. Beside the
blocks lies the table of ranks.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from punctual.llm.common import drop_path, new_path, worker_table
from punctual.llm.pieces import PieceTable
from punctual.llm.trie_bpe import read_definition

BLOCK_TOKENS = 1_000_000
#: Pieces that a worker remembers.
_REMEMBERED = 400_000


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    four = np.zeros((-(-len(code) // 4), 4), np.uint8)
    four.ravel()[: len(code)] = code
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    keep = np.arange(4, dtype=np.uint8) <= code[:, None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[keep].tobytes()


#: For each control byte, the byte counts of its four values.
_SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    start = np.cumsum(size) - size
    value = raw[start].astype(np.uint32)
    for k in (1, 2, 3):
        at = np.flatnonzero(size > k)
        value[at] |= raw[start[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return value


def _tokenizer(definition: str):
    """This worker's tokenizer, and the pieces that it remembers."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(definition)
        made.no_truncation()
        made.no_padding()
        size = np.zeros(made.get_vocab_size(), np.int64)
        for token, i in made.get_vocab(with_added_tokens=False).items():
            size[i] = len(token)  # each character of a byte-level token stands for a byte
        encode = lambda texts: [x.ids for x in made.encode_batch_fast(texts, add_special_tokens=False)]
        return made, PieceTable(encode, size, _REMEMBERED), [x.content for x in made.get_added_tokens_decoder().values()]

    return worker_table(("tokens", hash(definition)), make)


def encode_texts(texts: list[str | None], definition: str, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, end_id behind each text, and how many each has."""
    _, table, added = _tokenizer(definition)
    return table.texts(texts, added, end_id)


def encoded(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (little-endian, two bytes each if end_id and the vocabulary allow it, else four), with end_id behind each document."""
    shared = docs.sparkSession.sparkContext.broadcast(read_definition(docs.sparkSession, path))

    def run(batches):
        wide = 2 if _tokenizer(shared.value)[0].get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                ids, n = encode_texts(part.column(1).to_pylist(), shared.value, end_id)
                place = np.concatenate([[0], np.cumsum(n) * wide]).astype(np.int64)
                own = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(place.tobytes()), pa.py_buffer(ids.astype(f"<u{wide}").tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), own.cast(pa.binary()), pa.array(n)], ["id", "ids", "n"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, ids binary, n long")


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def _ranks(tokens: DataFrame) -> np.ndarray:
    """All ids that occur, most frequent first: at most the vocabulary, whatever the size of the corpus."""

    def run(batches):
        count = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                own = np.bincount(np.concatenate([_ids(x, n) for x, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]))
                count, own = (count, own) if len(count) >= len(own) else (own, count)
                count[: len(own)] += own
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(count[at], pa.int64())], ["token", "n"])

    counted = tokens.select("ids", "n").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return np.array([x.token for x in counted.orderBy(F.desc("n"), "token").select("token").collect()], "<u4")


def write_token_files(docs: DataFrame, out: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs to the folder out. Null texts count as empty; rows without an id are left out; rows with the same id stand side by side."""
    spark = docs.sparkSession
    raw = new_path(spark, "tokens")
    encoded(docs.where(F.col(id_col).isNotNull()), path, end_id, id_col, text_col).write.option("compression", "zstd").parquet(raw)
    tokens = spark.read.parquet(raw)
    order = _ranks(tokens)
    spark.createDataFrame([(order.tobytes(),)], "ranked binary").coalesce(1).write.parquet(f"{out}/ranks")
    shared = spark.sparkContext.broadcast(order)

    def run(batches):
        from pyspark import TaskContext

        rank = np.zeros(int(shared.value.max(initial=0)) + 1, "<u4")
        rank[shared.value] = np.arange(len(shared.value), dtype="<u4")
        part, block, docs, sizes, total = TaskContext.get().partitionId(), 0, [], [], 0
        ids: list[np.ndarray] = []

        def flush():
            lengths, values = pack(np.array(sizes)), pack(rank[np.concatenate(ids)])
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in ((part, pa.int32()), (block, pa.int32()), (len(docs), pa.int64()), (total, pa.int64()), (docs, pa.list_(pa.int64())), (lengths[0], pa.binary()), (lengths[1], pa.binary()), (values[0], pa.binary()), (values[1], pa.binary()))], names)

        for batch in batches:
            for doc, own, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                docs.append(doc)
                sizes.append(n)
                ids.append(_ids(own, n))
                total += n
                if total >= BLOCK_TOKENS:
                    yield flush()
                    block, docs, sizes, ids, total = block + 1, [], [], [], 0
        if docs:
            yield flush()

    schema = "part int, block int, n_docs long, n_tokens long, docs array<bigint>, length_control binary, length_data binary, control binary, data binary"
    names = [x.split()[0] for x in schema.split(", ")]
    parts = max(1, tokens.rdd.getNumPartitions())
    tokens.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(run, schema).write.option("compression", "zstd").parquet(f"{out}/blocks")
    drop_path(spark, raw)


def _blocks(spark: SparkSession, out: str):
    order = np.frombuffer(spark.read.parquet(f"{out}/ranks").first().ranked, "<u4")
    return spark.read.parquet(f"{out}/blocks"), spark.sparkContext.broadcast(order)


def _decoded(blocks: DataFrame, shared, schema: str, arrays) -> DataFrame:
    """arrays(docs, lengths, ids) gives the columns of a block behind part and block."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths = unpack(row["length_control"], row["length_data"], row["n_docs"]).astype(np.int64)
                ids = shared.value[unpack(row["control"], row["data"], row["n_tokens"])]
                n = row["n_docs"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["block"], np.int32)), *arrays(row["docs"], lengths, ids)], [x.split()[0] for x in f"part int, block int, {schema}".split(", ")])

    return blocks.mapInArrow(run, f"part int, block int, {schema}")


def _split(lengths: np.ndarray, ids: np.ndarray) -> list[bytes]:
    ends, raw = (np.cumsum(lengths) * 4).tolist(), ids.tobytes()
    return [raw[b:e] for b, e in zip([0, *ends[:-1]], ends, strict=True)]


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """doc_id and ids (array of long, with the end id) of all documents."""
    blocks, shared = _blocks(spark, out)
    arrays = lambda docs, lengths, ids: (pa.array(docs, pa.int64()), pa.array([np.frombuffer(x, "<u4") for x in _split(lengths, ids)], pa.list_(pa.int64())))
    return _decoded(blocks, shared, "doc_id long, ids array<bigint>", arrays).drop("part", "block")


def token_file_digest(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files alone."""
    blocks, shared = _blocks(spark, out)
    # ids before each part, of one row a part, and before each block of its part
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    own = blocks.select("part", "block", "n_tokens")
    parts = own.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before("part")), F.lit(0)).alias("ahead"))
    within = own.select("part", "block", F.coalesce(F.sum("n_tokens").over(before("part", "block")), F.lit(0)).alias("from"))
    starts = within.join(parts, "part").select("part", "block", (F.col("ahead") + F.col("from")).alias("from"))
    arrays = lambda docs, lengths, ids: (pa.array(docs, pa.int64()), pa.array(np.cumsum(lengths) - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in _split(lengths, ids)], pa.int64()))
    each = _decoded(blocks, shared, "doc_id long, within long, n_tokens long, ids_crc32 long", arrays)
    return each.join(starts, ["part", "block"]).select("doc_id", (F.col("from") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
