"""Where models plug in, and what stands in for them without one.

A hook takes and gives columns. ``batched`` makes one from a Python function over lists, loaded once a worker and called
with Arrow batches. The defaults need no model; they are stand-ins and not equal to what a model would give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.metrics import set_cosine

#: Teachers that only place stock phrases, by name: opening, a word and what follows it, ending.
STAND_INS = {"plain": ("Furthermore, ", " the ", " the vibrant ", ""), "turns": ("Moreover, ", " and ", " and, it is worth noting, ", " Everything changed.")}


def batched(load: Callable[[], Callable[[list], list]], kind: str) -> Callable[[Column], Column]:
    """A hook from ``load``, which gives a function from a list of texts to as many results of SQL type ``kind``."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        apply = load()
        for s in batches:
            yield pd.Series(apply(s.tolist()))

    return run


def entities(text: Column) -> Column:
    """Stand-in for entity recognition: lowered runs of a capital and further ASCII letters, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[A-Z][a-zA-Z]+"), 0), F.lower))


def word_set(text: Column) -> Column:
    """Stand-in for an embedding: a text's lowered ASCII words, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))


def similarity(a: Column, b: Column) -> Column:
    """Stand-in for the cosine of embeddings, of two word sets."""
    return set_cosine(a, b)


def draft(text: Column, teacher: Column) -> Column:
    """Stand-in for a teacher's draft; null for a teacher there is none of."""
    out = F.lit(None).cast("string")
    for name, (start, word, more, end) in STAND_INS.items():
        out = F.when(teacher == name, F.concat(F.lit(start), F.replace(text, F.lit(word), F.lit(more)), F.lit(end))).otherwise(out)
    return out


def edited(text: Column) -> Column:
    """Stand-in for the editing model: stock openings and words are taken out."""
    out = F.regexp_replace(text, r"\b(?:Furthermore|Moreover|In addition|Unsettlingly), ", "")
    out = F.regexp_replace(out, r"It is worth noting that ", "")
    return F.regexp_replace(out, r" (?:vibrant|nuanced|pivotal|multifaceted) ", " ")


def keeps_tone(text: Column, tone: Column) -> Column:
    """Stand-in for a judge: whether the tone's name is in the text."""
    return F.lower(text).contains(F.lower(tone))


def with_teacher(df: DataFrame, load: Callable[[], Callable[[str], str | None]], attempts: int = 2, least: int = 100) -> DataFrame:
    """``df`` with ``sloppy`` from its ``prompt``: asked again up to ``attempts`` times for ``least`` words, else null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = load()

        def once(prompt: str) -> str | None:
            for _ in range(attempts):
                try:
                    out = ask(prompt)
                except TimeoutError:
                    continue
                if out and len(out.split()) >= least:
                    return out
            return None

        for pdf in batches:
            yield pdf.assign(sloppy=pdf["prompt"].map(once))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "sloppy") + ", sloppy string"
    return df.drop("sloppy").mapInPandas(run, schema)


def first_token_ids(encode: Callable[[str], list[int]], phrases: list[str]) -> set[int]:
    """First token ids of phrases, each as it is and after a space. The list is short: it runs in the driver."""
    return {ids[0] for p in phrases for t in (p, " " + p) if (ids := encode(t))}
