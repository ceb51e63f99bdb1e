"""Five figures of a text's style, and the distance between two texts' figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.metrics import fold_deviation, fold_mean, sentence_lengths
from vellum.functions.text import BLANK, let, word_count

FIGURES = ("mean_length", "deviation", "commas", "quotes", "adverbs")


def style_vector(text: Column) -> Column:
    """``struct`` of ``FIGURES``: words of a sentence and their deviation, commas a sentence, quotes and -ly words a word.

    A text without sentences has the length 0, one without words divides by 1.
    """
    words = F.greatest(word_count(text), F.lit(1))
    count = lambda mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    def figures(found: Column, v: Column, mean: Column) -> Column:
        return F.struct(
            mean.alias("mean_length"),
            fold_deviation(v, mean).alias("deviation"),
            (count(",") / F.greatest(F.size(found), F.lit(1))).alias("commas"),
            (count('"') / words).alias("quotes"),
            (F.regexp_count(text, F.lit(rf"(?U)ly(?![^{BLANK}])")) / words).alias("adverbs"),
        )

    some = lambda found: F.when(F.size(found) == 0, F.array(F.lit(0.0))).otherwise(found)
    return let(sentence_lengths(text), lambda found: let(some(found), lambda v: let(fold_mean(v), lambda m: figures(found, v, m))))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two style vectors, unscaled."""
    return F.sqrt(sum(((a[f] - b[f]) * (a[f] - b[f]) for f in FIGURES), F.lit(0.0)))


def closer(reference: Column, baseline: Column, styled: Column) -> Column:
    """Whether the styled vector is nearer to the reference than the baseline; not if they are equally near."""
    return distance(styled, reference) < distance(baseline, reference)
