"""Session helpers: runtime settings and durable intermediate tables."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot documents and copied texts are split at run time, also where the
    # split costs one more exchange further up the plan.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Whole texts go to Python in small batches: a task holds a few of these at a time.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # Row counts of tables opened by ``read_footers`` come from file footers.
    "spark.sql.parquet.aggregatePushdown": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators are written for."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for durable intermediates: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (local tests) a temporary one is made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def write_and_read(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder and scan it back.

    Cuts the lineage so that a lost executor costs one task, not the whole plan.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, order: list[str], partition: str | None = None) -> DataFrame:
    """Write a table sorted by ``order``, in folders by ``partition``, and scan it back.

    Every file is sorted, so that row-group statistics let a scan skip what a condition
    on the first columns rules out. Rows stay in the task that made them: ranges over
    all files would cost a shuffle and compute the rows twice, for their bounds.
    """
    keys = [partition, *order] if partition else order
    writer = df.sortWithinPartitions(*keys).write.mode("error")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_name(path: str) -> str:
    """Name in the catalog of a table in buckets."""
    return "spanloom_" + hashlib.md5(path.encode()).hexdigest()


def write_buckets(df: DataFrame, path: str, key: str, order: list[str], buckets: int,
                  partition: str | None = None) -> DataFrame:
    """Write a table hashed by ``key`` into ``buckets``, sorted by ``order`` in each, and scan it back.

    Joins and groups of such tables by ``key``, or by more columns, need no exchange.
    Rows are dealt out by the caller: those that come from tables in the same buckets
    are in place already, others should be repartitioned by ``key`` before.
    """
    writer = df.write.format("parquet").mode("error").option("path", path).bucketBy(buckets, key).sortBy(*order)
    (writer.partitionBy(partition) if partition else writer).saveAsTable(table_name(path))
    return df.sparkSession.table(table_name(path))


def read_buckets(spark: SparkSession, path: str, key: str, order: list[str], buckets: int,
                 partition: str | None = None, schema: StructType | None = None) -> DataFrame:
    """A table of ``write_buckets`` by its path, also in a session that has never seen it.

    Only the catalog entry is made, in the location of the files, which stay as they are.
    """
    name = table_name(path)
    if not spark.catalog.tableExists(name):
        schema = schema or spark.read.parquet(path).schema
        columns = ", ".join(f"`{f.name}` {'string' if f.name == partition else f.dataType.simpleString()}"
                            for f in schema)                # folder names are text
        by = f"PARTITIONED BY ({partition})" if partition else ""
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {by} CLUSTERED BY ({key}) "
                  f"SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    if partition:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


V1_SOURCES = "spark.sql.sources.useV1SourceList"


def read_footers(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table by the source that answers counts from file footers."""
    sources = spark.conf.get(V1_SOURCES)
    spark.conf.set(V1_SOURCES, ",".join(s for s in sources.split(",") if s != "parquet"))
    try:
        return spark.read.schema(schema).parquet(path)
    finally:
        spark.conf.set(V1_SOURCES, sources)


def forget(spark: SparkSession, path: str) -> None:
    """Take a table of ``write_buckets`` out of the catalog; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {table_name(path)}")


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def make_folder(spark: SparkSession, path: str) -> None:
    """An empty folder, if there is none."""
    files, folder = _folder(spark, path)
    files.mkdirs(folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediates that nothing reads any more."""
    files, folder = _folder(spark, path)
    files.delete(folder, True)
