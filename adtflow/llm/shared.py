"""What the training-data operators share: input tables, tables in the shared folder, Arrow mapping."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtflow.shipping import ship_package

__all__ = ["BATCH_ROWS", "map_arrow", "shared_folder", "ship_package", "shuffle_partitions", "stored", "table", "text_or_empty", "without"]

#: Rows of two numbers that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Rows of an Arrow batch; texts may be long, so a batch of the default 10,000 rows could be gigabytes.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, read by Spark alone so that any store works."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="adtflow-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
        folder = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: On a mounted disk, Hadoop without its native library starts a chmod process for each file and folder it makes, and more for the
#: checksum files beside them; until such a process has loaded its program it counts as a second copy of the executor's memory. So
#: tables are written in few files, and without checksum files, where the store is such a disk. Other stores aren't affected.
RAW_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
#: Files of a written table for each core of the cluster, at most, and of one that is small beside the input.
FILES_PER_CORE, COMPACT_FILES_PER_CORE = 8, 2

_written: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the folder is temporary anyway
        pass


@atexit.register
def _remove_all() -> None:
    for spark, path in _written:
        _remove(spark, path)


def stored(df: DataFrame, label: str, codec: str = "zstd", compact: bool = False) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors, fixes any partitioning.

    compact: for tables that are small beside the input. What goes to one file is still computed partition by partition.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/adtflow/{label}-{uuid.uuid4().hex}"
    out = df.coalesce(max(1, (COMPACT_FILES_PER_CORE if compact else FILES_PER_CORE) * spark.sparkContext.defaultParallelism))
    out.write.options(**RAW_FILES).option("compression", codec).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def without(documents: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """documents without the rows whose id and text's hash are in gone (doc_id, h), with all columns.

    Up to BROADCAST_ROWS of gone, counted first, are broadcast, so that no text moves; beyond that both sides are shuffled.
    """
    gone = stored(gone.select(F.col("doc_id").alias("_gone_id"), F.col("h").alias("_gone_h")).distinct(), "gone", compact=True)
    few = gone.count() <= BROADCAST_ROWS
    same = documents[id_col].cast("long").eqNullSafe(F.col("_gone_id")) & (F.xxhash64(F.coalesce(documents[text_col], F.lit(""))) == F.col("_gone_h"))
    return documents.join(F.broadcast(gone) if few else gone, same, "left_anti")


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """function over each Arrow batch, one batch in memory at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(each, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(column: str) -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))
