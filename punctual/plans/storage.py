"""Where derived tables are kept, the folder of spark.checkpoint.dir, and when they are made again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from punctual.sources.files import children, delete, listing


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own in the folder that driver and executors share. Where none is set and all runs on one machine (tests), in one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@dataclass
class Stored:
    path: str
    schema: StructType
    inputs: list[tuple[str, int, int]]


_STORED: dict[tuple[str, str, str], Stored] = {}


def _marks(rows: DataFrame) -> dict:
    """Of each service date how many rows it has and the sum of their hashes."""
    own = rows.groupBy("service_date").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h"))
    return {x.service_date: (x.n, x.h) for x in own.collect()}  # a row a date


def stored_table(spark: SparkSession, sf_dir: str, name: str, inputs: list[str], derive: Callable[[], DataFrame]) -> DataFrame:
    """A table partitioned by service date, as finalized trips and daily statistics are stored, that an application writes once and then only reads.

    It is made again when a file of the input tables has another name, size or time, or when it is gone; then only dates whose rows differ are written, and dates without rows go.
    """
    key, files = (spark.sparkContext.applicationId, sf_dir, name), [f for x in inputs for f in listing(spark, f"{sf_dir}/{x}.parquet")]
    known = _STORED.get(key)
    if known is None or not children(spark, known.path):
        own, path = derive(), new_folder(spark, name)
        own.sortWithinPartitions("service_date", *_order(own)).write.partitionBy("service_date").parquet(path)
        known = _STORED[key] = Stored(path, own.schema, files)
    elif known.inputs != files:
        own = derive()
        now, before = _marks(own.select(*known.schema.names)), _marks(spark.read.schema(known.schema).parquet(known.path).select(*known.schema.names))
        changed = [d for d, mark in now.items() if before.get(d) != mark]
        if changed:
            own.where(F.col("service_date").isin(changed)).sortWithinPartitions("service_date", *_order(own)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("service_date").parquet(known.path)
        for day in before.keys() - now.keys():
            delete(spark, f"{known.path}/service_date={day}")
        known.inputs = files
    return spark.read.schema(known.schema).parquet(known.path)


def _order(rows: DataFrame) -> list[str]:
    return [x for x in ("route_id", "trip_id", "trip_key") if x in rows.columns] or rows.columns[:1]
