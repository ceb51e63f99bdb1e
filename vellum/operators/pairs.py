"""Pairs of excerpts and teachers, made where they aren't there yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import fixed
from vellum.functions.text import pair_id, word_count


def with_outlines(excerpts: DataFrame, outlines: DataFrame) -> DataFrame:
    """The excerpts that have an outline, with it."""
    return excerpts.join(outlines, "id")


def for_teachers(excerpts: DataFrame, teachers: list[str]) -> DataFrame:
    """Each excerpt once for each teacher, with ``pair_id``. The teachers are a list in the plan, so nothing is joined."""
    rows = excerpts.withColumn("teacher", F.explode(F.array(*map(F.lit, teachers))))
    return rows.withColumn("pair_id", pair_id(F.col("id"), F.col("teacher")))


def not_yet(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows of ``todo`` whose key isn't among ``done``'s. Null keys are kept."""
    return todo.join(done.select(key), key, "left_anti")


def long_enough(df: DataFrame, text: str, least: int = fixed.MIN_DRAFT_WORDS) -> DataFrame:
    """The rows whose text has ``least`` words; a null text has none."""
    return df.where(word_count(F.col(text)) >= least)


def passes(ner: Column, sem: Column) -> Column:
    """Whether a pair's unrounded scores pass the gate, bounds included. A score that is null or NaN doesn't pass."""
    ok = (ner >= fixed.MIN_NER) & ~F.isnan(ner) & sem.between(fixed.MIN_SEM, fixed.MAX_SEM) & ~F.isnan(sem)
    return F.coalesce(ok, F.lit(False))


def keep_report(df: DataFrame, keep: Column) -> DataFrame:
    """One row: total, kept, dropped, rate, and what a rate outside the healthy band advises."""
    of = df.agg(F.count("*").alias("total"), F.count_if(keep).alias("kept"))
    rate = F.when(F.col("total") == 0, 0.0).otherwise(F.col("kept") / F.col("total"))
    warning = F.when((F.col("total") > 0) & (rate > fixed.KEEP_HIGH), "high").when((F.col("total") > 0) & (rate < fixed.KEEP_LOW), "low").otherwise("none")
    return of.select("total", "kept", (F.col("total") - F.col("kept")).alias("dropped"), rate.alias("rate"), warning.alias("warning"))
