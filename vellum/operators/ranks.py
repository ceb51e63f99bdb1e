"""Exact ranks and samples in hash order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.shared import materialize

#: Hex digits of the hash by which rows are put in buckets: 4,096 of them, for each group.
DIGITS = 3


def seeded(key: Column, seed: int = 42) -> Column:
    """The MD5 of a key and a seed, in hex: an order that every engine and partitioning gives alike."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


def ranked(df: DataFrame, order: str, by: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """``df`` with each row's rank from 0, within the columns ``by``, in the order of a hex column, which must be unique there.

    Rows are ranked within buckets of the hash, and the counts of lower buckets are added: at most 4,096 counts a group
    are summed in one place, rows never.
    """
    by = by or []
    bucket = F.substring(order, 1, DIGITS)
    counts = df.groupBy(*by, bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(*by, "_bucket", before.alias("_base"))
    rows = df.withColumn("_bucket", bucket)
    joined = rows.join(base, [*by, "_bucket"]) if by else rows.join(F.broadcast(base), "_bucket")  # without groups there are 4,096 rows at most
    w = Window.partitionBy(*by, "_bucket").orderBy(order)
    return joined.withColumn(rank, F.col("_base") + F.row_number().over(w) - 1).select(*df.columns, rank)


def placed(df: DataFrame, *order: Column, place: str = "place") -> DataFrame:
    """``df`` with each row's place from 1 in the given order, which must be total.

    Rows are sorted within ranges and written once; one count a range is summed in one place, rows never.
    """
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}))
    first = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).withColumn("_base", F.coalesce(F.sum("_n").over(first), F.lit(0)))
    return rows.join(F.broadcast(base), "_part").withColumn(place, F.col("_base") + F.col("_at") - F.col("_first") + 1).select(*df.columns, place)


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows of ``df`` in the seeded order of a unique key, and all if there are fewer."""
    rows = df.withColumn("_order", seeded(F.col(key), seed))
    return ranked(rows, "_order", rank="_rank").where(F.col("_rank") < n).drop("_order", "_rank")


def batches(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """``df`` with the number of its batch, from 0, in the seeded order of a unique key."""
    rows = df.withColumn("_order", seeded(F.col(key), seed))
    return ranked(rows, "_order", rank="_rank").withColumn("batch", F.floor(F.col("_rank") / size)).drop("_order", "_rank")
