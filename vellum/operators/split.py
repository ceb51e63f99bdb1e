"""Null pairs, the union of all pairs, and splits that keep an excerpt's pairs together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import fixed
from vellum.functions.text import base_id, null_id
from vellum.operators.ranks import ranked, sample, seeded


def null_pairs(excerpts: DataFrame, pairs: int, share: float = fixed.NULL_SHARE, seed: int = 42) -> DataFrame:
    """``int(pairs * share)`` excerpts (unique ``id``), or all there are, as pairs that need no edit."""
    ids = sample(excerpts.select("id"), "id", int(pairs * share), seed)
    return excerpts.join(ids, "id", "left_semi").select(null_id(F.col("id")).alias("id"), F.col("text").alias("clean"), F.col("text").alias("sloppy"), F.lit("null").alias("teacher"))


def all_pairs(kept: DataFrame, nulls: DataFrame) -> DataFrame:
    """Kept pairs and null pairs; what a null pair lacks is null."""
    return kept.unionByName(nulls, allowMissingColumns=True)


def split_bases(pairs: DataFrame, test: float = fixed.TEST_SHARE, val: float = fixed.VAL_SHARE, seed: int = 42) -> DataFrame:
    """``base, split``: of n base ids in seeded order the first ``int(n * test)`` are test, the next ``int(n * val)`` val, the rest train."""
    bases = pairs.select(base_id(F.col("id")).alias("base")).where("base is not null").distinct()
    n = bases.agg(F.count("*").alias("_all"))
    order = ranked(bases.withColumn("_order", seeded(F.col("base"), seed)), "_order").crossJoin(F.broadcast(n))  # one row
    tests = F.floor(F.col("_all") * F.lit(test))
    vals = F.floor(F.col("_all") * F.lit(val))
    return order.select("base", F.when(F.col("rank") < tests, "test").when(F.col("rank") < tests + vals, "val").otherwise("train").alias("split"))


def split_pairs(pairs: DataFrame, **how: float) -> DataFrame:
    """``pairs`` with ``base`` and ``split``; pairs without an id are in no split."""
    return pairs.withColumn("base", base_id(F.col("id"))).join(split_bases(pairs, **how), "base")


def leaks(rows: DataFrame) -> DataFrame:
    """One row: base ids, those in more than one split, and rows of each split."""
    by = rows.groupBy("base").agg(F.count_distinct("split").alias("splits"), *(F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")))
    return by.agg(F.count("*").alias("bases"), F.count_if(F.col("splits") > 1).alias("leaking"), *(F.coalesce(F.sum(s), F.lit(0)).cast("long").alias(s) for s in ("train", "val", "test")))
