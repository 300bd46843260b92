"""Stages that need more than one table or a whole group: semi joins, lookups, ranks, sets and aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtflow.functions import arithmetic as A


def keep_matching(rows: DataFrame, target: DataFrame, condition: Column, negated: bool) -> DataFrame:
    """Rows with (or without) a match; target's columns have names of their own, so that a table may be matched with itself.

    A semi or anti join on the equalities in condition: Spark picks broadcast or shuffle by size and never multiplies rows.
    """
    return rows.join(target, condition, "left_anti" if negated else "left_semi")


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer takes for the size of df, from its files' sizes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def lookup(rows: DataFrame, target: DataFrame, name: str, target_key: Column, source_key: Column, limit: int, order: Sequence[Column], item: Column, null_safe: bool) -> DataFrame:
    """rows with a list of the target's matching rows, at most limit, in order; more than limit is an error.

    Only limit + 1 rows of a key are ever gathered: the ranks are cut off before the shuffle, so that a frequent key stays cheap. Where
    the rows are the smaller side, as far as Spark knows, the target is first cut to their keys by a semi join.
    """
    key, rank = "__lookup_key", "__lookup_rank"
    target = target.withColumn(key, target_key)
    if estimated_bytes(rows) < estimated_bytes(target):
        asked = rows.select(source_key.alias("__source_key")).distinct()
        target = target.join(asked, F.col(key).eqNullSafe(F.col("__source_key")) if null_safe else F.col(key) == F.col("__source_key"), "left_semi")
    ranked = target.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(rank) <= limit + 1)
    pairs = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("rank"), item.alias("item"))))
    found = ranked.groupBy(key).agg(pairs.alias("__items"))
    same = F.col("__source_key").eqNullSafe(F.col(key)) if null_safe else F.col("__source_key") == F.col(key)
    joined = rows.withColumn("__source_key", source_key).join(found, same, "left")
    items = F.transform("__items", lambda x: x["item"])
    kind = target.select(item.alias("item")).schema["item"].dataType
    empty = F.array().cast(f"array<{kind.simpleString()}>")
    value = F.when(F.col("__items").isNull(), empty).when(F.size("__items") > limit, A.fail(f"E_RELATION_LIMIT: more than {limit} related rows")).otherwise(items)
    return joined.withColumn(name, value).drop("__source_key", key, "__items")


RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}


def rank(rows: DataFrame, partition: Sequence[Column], order: Sequence[Column], fields: Sequence[tuple[str, str]]) -> DataFrame:
    """rows with long ranks; without a partition Spark sorts all rows in one task, which only a following filter on the rank bounds."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumns({name: RANKS[kind]().over(w).cast("long") for name, kind in fields})


def combine(left: DataFrame, right: DataFrame, kind: str, ordered: bool = False) -> DataFrame:
    """Distinct union, intersection or difference of rows by position; ordered: by where each row occurs first, left rows before right."""
    if ordered:
        place, names = "__first", left.columns
        first = lambda df: df.groupBy(*(F.col(f"`{c}`") for c in names)).agg(F.min(place).alias(place))
        at = lambda df, side: df.toDF(*names).withColumn(place, F.struct(F.lit(side).alias("side"), F.monotonically_increasing_id().alias("at")))
        if kind == "union":
            out = first(at(left, 0).union(at(right, 1)))
        else:
            renamed = right.toDF(*(f"__right{i}" for i in range(len(names))))
            same = [F.col(f"`{c}`").eqNullSafe(F.col(f"__right{i}")) for i, c in enumerate(names)]
            out = first(at(left, 0)).join(renamed, reduce(and_, same), "left_semi" if kind == "intersect" else "left_anti")
        return out.orderBy(place).drop(place)
    if kind == "union":
        return left.union(right).distinct()
    return left.intersect(right) if kind == "intersect" else left.subtract(right)
