"""Operator 1: balanced contiguous shards from global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adtflow.llm.shared import shuffle_partitions, stored, text_or_empty

#: Bytes that each row counts besides its text.
ROW_BYTES = 16


def shard_by_bytes(documents: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards 0 to n_shards - 1 that are contiguous in id order and near equal in bytes.

    The rows, without their texts, are dealt by range over partitions; the partitions' totals give each partition its offset, and
    a running sum inside a partition gives each row its global offset. A row goes to the shard in which its middle byte falls, so
    a shard is off its target by less than one row on either side.

    Nulls: a null text counts as empty (ROW_BYTES bytes, CRC 0); null ids come first. Ties on the id are ordered by the text's
    CRC and hash; rows equal in both are interchangeable. One id may hold any share of the rows, as ties are split between
    partitions too. An empty table gives no rows. A text larger than a shard's target may leave shards empty. Other columns are
    not read.
    """
    spark = documents.sparkSession
    text = text_or_empty(text_col)
    slim = documents.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("r"),
    )
    order = ["doc_id", "text_crc32", "h", "r"]
    dealt = stored(slim.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id()), "shards")

    # one row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        dealt.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
        )
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # safe to broadcast: totals has one row a partition, whatever the table's size
    placed = (
        dealt.join(F.broadcast(totals), "part")
        .withColumn("end", F.col("bytes_before") + F.sum("size").over(inside))
        .withColumn("position", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"((2 * end - size) * {n_shards} div (2 * total))").cast("int"))
    )
    # safe to broadcast: one row a shard
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("position") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
