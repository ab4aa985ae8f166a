"""What the operators share: tables, the shared folder, checked joins."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of their values, of a table that a join may broadcast; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16_000_000
#: Bytes of a batch sent to Python, and rows of a batch read from Parquet, in bounded_batches().
BATCH_BYTES, READ_ROWS = 4_000_000, 512
#: A key is hot if it has more rows than this, and more than one in HOT_SHARE of all: there are at most HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE = 2_000, 100_000
#: Tasks over which the rows of one key are dealt in joins with sides larger than that.
WAYS = 32


_TABLES: dict[Hashable, object] = {}


def _give_back() -> None:
    """Memory that this worker has freed goes back to the system at once, where the C library and Arrow can do so; else it would count on top of the next operator's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def worker_table(key: Hashable, make: Callable[[], object]):
    """A Python worker's large table, made once and kept for its later tasks; a worker keeps one at a time."""
    if key not in _TABLES:
        _TABLES.clear()
        _give_back()
        _TABLES[key] = make()
    return _TABLES[key]


def free_worker_tables() -> None:
    """For tasks that need no table: what another operator left in the worker makes room."""
    _TABLES.clear()
    _give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session moves rows in smaller batches. Each task holds a batch several times over, on the heap, beside it and in its Python
    worker; Spark's own bounds are 64 MB to Python and 4,096 rows from Parquet, whatever the length of texts. Results don't depend on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset and all runs on one machine (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there and a lost executor loses nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_stored(df: DataFrame) -> None:
    """Frees what stored() wrote, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        drop_path(df.sparkSession, files[0].rpartition("/")[0])


def is_small(df: DataFrame) -> bool:
    """Whether df, counted in rows and in bytes of values, may be broadcast."""
    each = F.lit(0)
    for f in df.schema.fields:
        kind, col = f.dataType.typeName(), F.col(f"`{f.name}`")
        each = each + (F.coalesce(F.octet_length(col), F.lit(0)) if kind in ("string", "binary") else F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0)) if kind in ("array", "struct", "map") else F.lit(8))
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(each.cast("long")), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def small_side(keys: DataFrame) -> DataFrame:
    """keys with a broadcast hint if they are counted to be few and short enough; as they are, for a shuffled join, if not."""
    return F.broadcast(keys) if is_small(keys) else keys


def left_join_hot(rows: DataFrame, side: DataFrame, key: str, *dealt_by: str) -> DataFrame:
    """rows left join side, which has one row a key, where one key may hold much of rows.

    A side counted to be small is broadcast. With a larger one each key's rows are dealt over
    WAYS tasks by a hash of dealt_by, and the side's row goes to each of them.
    """
    if is_small(side):
        return rows.join(F.broadcast(side), key, "left")
    way = f"way_{uuid.uuid4().hex}"  # a name that rows don't have
    dealt = rows.withColumn(way, F.pmod(F.xxhash64(*dealt_by), F.lit(WAYS)))
    ways = side.withColumn(way, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WAYS - 1).cast("long"))))
    return dealt.join(ways, [key, way], "left").drop(way)


def join_dealt(rows: DataFrame, side: DataFrame, key: str, weights: DataFrame, dealt_by: str, how: str = "inner") -> DataFrame:
    """rows joined with side, which has one row a key, where keys may hold much of rows; weights: key, _w (its count of rows).

    Rows of hot keys are dealt over WAYS tasks by a hash of dealt_by, and side's rows of these keys, at most HOT_SHARE, go to each of them.
    """
    total, most = weights.agg(F.coalesce(F.sum("_w"), F.lit(0)), F.coalesce(F.max("_w"), F.lit(0))).first()
    limit = max(HOT_ROWS, total // HOT_SHARE)
    if most <= limit:
        return rows.join(side, key, how)
    hot = F.broadcast(weights.where(F.col("_w") > limit).select(key, F.lit(True).alias("_hot")))  # at most HOT_SHARE keys
    way = F.when(F.col("_hot"), F.pmod(F.xxhash64(dealt_by), F.lit(WAYS))).otherwise(F.lit(0).cast("long"))
    ways = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(WAYS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    dealt = rows.join(hot, key, "left").withColumn("_way", way).drop("_hot")
    return dealt.join(side.join(hot, key, "left").withColumn("_way", ways).drop("_hot"), [key, "_way"], how).drop("_way")
