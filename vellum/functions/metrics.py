"""Metrics of a text or of a pair of texts, as columns.

Entities and embeddings come from a hook (``hooks``); the defaults are stand-ins without a model: runs of a capital and
letters, and the cosine of word sets. Empty texts give 0, or 1 where nothing can be lost.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import fixed
from vellum.functions.text import let, sentences, word_count


def literal_core(pattern: str) -> str:
    """The longest plain part of a pattern: a text without it can't match."""
    return max(re.split(r"\\.|[.+*?\[\](){}|^$]", pattern), key=len)


def matches(lowered: Column, pattern: str) -> Column:
    """Whether a lowered text has the pattern; the search for its plain part spares most regular expressions."""
    return lowered.contains(literal_core(pattern)) & lowered.rlike("(?d)" + pattern)


def occurrences(lowered: Column, pattern: str) -> Column:
    """How often a lowered text has the pattern."""
    return F.when(lowered.contains(literal_core(pattern)), F.regexp_count(lowered, F.lit("(?d)" + pattern))).otherwise(0)


def slop_hits(text: Column, patterns: list[str] | None = None) -> Column:
    """How many different patterns a text has."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, (matches(low, p).cast("int") for p in patterns or fixed.SCORE_PATTERNS))


def per_thousand(hits: Column, words: Column) -> Column:
    """Hits for each 1,000 words; 0 without words. ``words`` stands once in it, so it is counted once."""
    return F.coalesce(F.try_divide(hits.cast("double"), words / 1000.0), hits * F.lit(0.0))


def slop_score(text: Column, patterns: list[str] | None = None) -> Column:
    """Different patterns for each 1,000 words."""
    return per_thousand(slop_hits(text, patterns), word_count(text))


def fold_mean(values: Column) -> Column:
    """Mean of an array, summed in order."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def fold_deviation(values: Column, mean: Column) -> Column:
    """Population deviation of an array, summed in order."""
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(values))


def sentence_lengths(text: Column) -> Column:
    """Words of each sentence."""
    return F.transform(sentences(text), lambda s: word_count(s).cast("double"))


def burstiness(text: Column) -> Column:
    """Population deviation of the words of a sentence; 0 under two sentences."""
    deviation = lambda v: let(fold_mean(v), lambda m: fold_deviation(v, m))
    return let(sentence_lengths(text), lambda v: F.when(F.size(v) < 2, 0.0).otherwise(deviation(v)))


def share_kept(before: Column, after: Column) -> Column:
    """Share of one array's members that another has too; 1 if there is nothing to keep."""
    return F.when(F.size(before) == 0, 1.0).otherwise(F.size(F.array_intersect(before, after)) / F.size(before))


def share_new(before: Column, after: Column) -> Column:
    """Share of the second array's members that the first lacks; 0 if it is empty."""
    return F.size(F.array_except(after, before)) / F.greatest(F.size(after), F.lit(1))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, in double precision; null if either is all zeros or null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def set_cosine(a: Column, b: Column) -> Column:
    """Cosine of two sets as 0/1 vectors; 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.sqrt(F.size(a).cast("double") * F.size(b))), F.lit(0.0))
