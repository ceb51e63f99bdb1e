"""Books in excerpts that end where paragraphs do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import fixed
from vellum.functions.text import PARAGRAPH_BREAK, content_id, file_name, paragraphs, printable_ratio, strip_boilerplate, word_count

_STATE = "struct<cur:array<string>,n:int,out:array<struct<text:string,n:int>>>"


def segments(paras: Column, least: int = fixed.MIN_WORDS, most: int = fixed.MAX_WORDS) -> Column:
    """Array of ``struct(text, n)`` from an array of paragraphs.

    A paragraph above ``most`` words is skipped while nothing is collected. Otherwise, if it would take the words above
    ``most`` and there are ``least`` already, what is collected is an excerpt and the paragraph begins the next one; if
    not, it is added. What is left at the end is an excerpt if it has ``least`` words. So an excerpt has ``least`` words
    or more, and can have more than ``most``.
    """
    state = lambda cur, n, out: F.struct(cur.alias("cur"), n.alias("n"), out.alias("out")).cast(_STATE)
    excerpt = lambda s: F.array(F.struct(F.array_join(s["cur"], " ").alias("text"), s["n"].alias("n")))

    def step(s: Column, p: Column) -> Column:
        skip = (p["w"] > most) & (F.size(s["cur"]) == 0)
        full = (s["n"] + p["w"] > most) & (s["n"] >= least)
        cut = state(F.array(p["p"]), p["w"], F.concat(s["out"], excerpt(s)))
        return F.when(skip, s).when(full, cut).otherwise(state(F.concat(s["cur"], F.array(p["p"])), s["n"] + p["w"], s["out"]))

    empty = state(F.expr("cast(array() as array<string>)"), F.lit(0), F.expr("cast(array() as array<struct<text:string,n:int>>)"))
    counted = F.transform(paras, lambda p: F.struct(p.alias("p"), word_count(p).cast("int").alias("w")))
    return F.aggregate(counted, empty, step, lambda s: F.when(s["n"] >= least, F.concat(s["out"], excerpt(s))).otherwise(s["out"]))


def segment_books(books: DataFrame, least: int = fixed.MIN_WORDS, most: int = fixed.MAX_WORDS, separator: str = PARAGRAPH_BREAK) -> DataFrame:
    """``books(path, text, *)`` as ``id, source, path, pos, text, word_count``, excerpts that aren't printable left out.

    A book without text gives none. ``pos`` counts a book's excerpts before that filter.
    """
    found = books.select("path", F.posexplode(segments(paragraphs(strip_boilerplate(F.col("text")), separator), least, most)).alias("pos", "e"))
    rows = found.select(file_name(F.col("path")).alias("source"), "path", "pos", F.col("e.text").alias("text"), F.col("e.n").alias("word_count"))
    return rows.where(printable_ratio(F.col("text")) >= fixed.PRINTABLE).select(content_id(F.col("text")).alias("id"), "source", "path", "pos", "text", "word_count")


def first_excerpts(excerpts: DataFrame) -> DataFrame:
    """One row for each id: the first in path order (part by part), then in place. Copies are merged before the shuffle."""
    order = F.struct(F.split("path", "/").alias("parts"), "pos", "source", "text", "word_count", "path")
    return excerpts.groupBy("id").agg(F.min(order).alias("x")).select("id", "x.source", "x.path", "x.pos", "x.text", "x.word_count")


def by_source(excerpts: DataFrame) -> DataFrame:
    """Excerpts and words of each source."""
    return excerpts.groupBy("source").agg(F.count("*").alias("excerpts"), F.sum("word_count").cast("long").alias("words"), F.avg("word_count").alias("mean_words"))
