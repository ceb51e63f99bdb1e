"""Phrases a model uses more often than people do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import fixed
from vellum.functions.metrics import occurrences
from vellum.functions.text import plain_pattern, rounded, word_count


def pattern_counts(texts: DataFrame, corpus: str, text: str, patterns: list[str] | None = None) -> DataFrame:
    """``corpus, pattern, place, hits, words``: occurrences of each pattern and all words of each corpus.

    One pass counts all patterns; rows are summed before the shuffle, and only the sums are turned into rows.
    """
    patterns = patterns or fixed.PROFILE_PATTERNS
    low = texts.where(F.col(text).isNotNull()).select(F.col(corpus).alias("corpus"), F.lower(F.col(text)).alias("low"), word_count(F.col(text)).alias("w"))
    sums = low.groupBy("corpus").agg(F.sum("w").alias("words"), *(F.sum(occurrences(F.col("low"), p)).alias(f"h{i}") for i, p in enumerate(patterns)))
    each = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(i).alias("place"), F.col(f"h{i}").alias("hits")) for i, p in enumerate(patterns)))
    return sums.select("corpus", "words", F.explode(each).alias("x")).select("corpus", "x.pattern", "x.place", "x.hits", "words")


def frequency(hits: Column, words: Column) -> Column:
    """Occurrences for each 1,000 words, the scale taken first; 0 without words."""
    return F.when(F.coalesce(words, F.lit(0)) == 0, 0.0).otherwise(hits * (1000.0 / words))


def slop_profile(counts: DataFrame, model: str, baseline: str) -> DataFrame:
    """``pattern, place, model_freq_per_1k, baseline_freq_per_1k, delta``, rounded to 4 places; a corpus without texts has 0."""
    of = lambda name: F.max(F.when(F.col("corpus") == name, frequency(F.col("hits"), F.col("words"))))
    both = counts.groupBy("pattern", "place").agg(F.coalesce(of(model), F.lit(0.0)).alias("m"), F.coalesce(of(baseline), F.lit(0.0)).alias("b"))
    return both.select("pattern", "place", rounded(F.col("m"), 4).alias("model_freq_per_1k"), rounded(F.col("b"), 4).alias("baseline_freq_per_1k"), rounded(F.col("m") - F.col("b"), 4).alias("delta"))


def top(profile: DataFrame, n: int = fixed.BANLIST_ROWS) -> DataFrame:
    """The first ``n`` by delta; of equal ones, in the patterns' order."""
    return profile.orderBy(F.desc("delta"), "place").limit(n)


def banlist(profile: DataFrame, n: int = fixed.BANLIST_ROWS, least: float = fixed.BANLIST_DELTA) -> DataFrame:
    """Of the top ``n`` those above ``least``, as plain phrases."""
    return top(profile, n).where(F.col("delta") > least).select(plain_pattern(F.col("pattern")).alias("phrase"), "delta")
