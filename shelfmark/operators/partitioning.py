"""Seeded order, batches and the scope filter of the partitioning workflow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading hexadecimal digits of the hash by which the global order is split among tasks.
PREFIX = 3


def seeded_order(df: DataFrame, key: str, seed: str) -> DataFrame:
    """(key, rank) in the order of the hash of seed and key, ranks from 1.

    A global rank without a global sort: keys are counted per prefix of the hash (at most 16**PREFIX counts), a
    running sum of the counts gives each prefix its first rank, and rows are ranked within their prefix.
    """
    rows = df.select(key, F.sha2(F.concat(F.lit(seed + ":"), F.col(key)), 256).alias("_h")).withColumn("_p", F.substring("_h", 1, PREFIX))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_p").orderBy("_h", key)
    return rows.join(starts, "_p").select(key, (F.col("_start") + F.row_number().over(inside)).alias("rank"))


def batches(df: DataFrame, key: str, seed: str, size: int) -> DataFrame:
    """(key, rank, batch_index) with batches of ``size`` in seeded order."""
    return seeded_order(df, key, seed).withColumn("batch_index", F.floor((F.col("rank") - 1) / F.lit(size)))


def check_range(batched: DataFrame, offset: int, count: int) -> None:
    """Error unless batches offset .. offset + count - 1 exist."""
    most = batched.agg(F.max("batch_index")).first()[0]
    if count <= 0 or offset < 0 or most is None or offset + count - 1 > most:
        raise ValueError(f"batches {offset} to {offset + count - 1} asked for, {0 if most is None else most + 1} there")


def ancestor_names(node_path: Column) -> Column:
    """Names of the nodes on a path below the root, trimmed, blanks left out."""
    parts = F.filter(F.transform(F.split(node_path, "/"), lambda p: F.trim(p)), lambda p: p != "")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def drop_ancestors(names: Column, blocked: Column | Sequence[str]) -> Column:
    """An array of names without those that are an ancestor's, whatever their case and the white space around them."""
    low = blocked if isinstance(blocked, Column) else F.array(*[F.lit(b) for b in blocked])
    low = F.transform(low, lambda b: F.lower(F.trim(b)))
    return F.filter(names, lambda n: ~F.array_contains(low, F.lower(F.trim(n))))


def filter_scope(response: DataFrame, categories: str, groups: str, blocked: Sequence[str]) -> DataFrame:
    """A proposal (categories: array of names; groups: array of (name, topics)) without ancestors at any level."""
    low = F.array(*[F.lit(b.strip().lower()) for b in blocked]).cast("array<string>")
    kept = F.filter(groups, lambda g: ~F.array_contains(low, F.lower(F.trim(g["name"]))))
    inner = F.transform(kept, lambda g: F.struct(g["name"].alias("name"), drop_ancestors(g["topics"], low).alias("topics")))
    return response.withColumn(categories, drop_ancestors(F.col(categories), low)).withColumn(groups, inner)
