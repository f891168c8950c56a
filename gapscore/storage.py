"""Where intermediate tables go, and how the engine decides to broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

MAX_BROADCAST_BYTES = 64 * 1024 * 1024

# Spark's switch that deletes a query's shuffle files as soon as the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: dict[str, tempfile.TemporaryDirectory] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; on a cluster a
    machine-local folder would be lost with its machine, so an unset value is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.TemporaryDirectory(prefix="gapscore-")
    return _local_dirs[app].name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end_with_query(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialise(
    df: DataFrame, name: str, partition_by: list[str] | None = None, read_as: dict[str, DataType] | None = None
) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which also cuts its lineage. Shuffle files of the writing go with it.

    ``read_as`` names columns that are read under another type of the same storage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_end_with_query(spark):
        writer = df.select("*").write  # planned anew, under the switch
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    types = read_as or {}
    fields = [StructField(f.name, types.get(f.name, f.dataType), f.nullable) for f in df.schema]
    return spark.read.schema(StructType(fields)).parquet(path)


def local_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A table of a few driver-side rows that the optimiser sees as constants."""
    fields = StructType.fromDDL(schema)
    records = [dict(zip(fields.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, to_arrow_schema(fields)), fields)


def small_side(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """The dictionary side of a join: measured, and broadcast only if it is small.

    A small one is computed once and becomes a constant table. A larger one is returned as it
    is: Spark then shuffles both sides and AQE splits skewed keys.
    """
    first = df.limit(max_rows + 1)
    # Bytes are bounded before the rows come to the driver; JSON is no smaller than the row.
    size = first.select(F.length(F.to_json(F.struct("*"))).alias("n")).agg(F.count("*"), F.sum("n")).first()
    if size[0] > max_rows or (size[1] or 0) > MAX_BROADCAST_BYTES:
        return df
    content = first.toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(content, df.schema))


def spread(df: DataFrame) -> DataFrame:
    """Rebalance an input of fewer splits than cores (one small file); leave larger inputs alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
