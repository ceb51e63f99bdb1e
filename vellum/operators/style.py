"""Style references: other texts of a pair's source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import fixed
from vellum.functions.text import style_base_id
from vellum.operators.ranks import ranked, seeded


def style_references(pairs: DataFrame, excerpts: DataFrame, k: int = fixed.STYLE_REFERENCES, seed: int = 42) -> DataFrame:
    """``pair_id, source, refs, reference`` of each pair (unique ``id``, ``clean``) whose excerpt's source has k + 1 texts.

    A source's different texts stand in a seeded circle; a pair takes k texts from a seeded place on, leaving out its own.
    Every text is as likely as any other, and a pair meets k + 1 texts however many its source has: there is no fan-out.
    Pairs whose excerpt isn't there, or has no source, are left out; of an excerpt's sources the first by name counts.
    """
    texts = excerpts.where("source is not null and text is not null").select("source", "text").distinct()
    circle = ranked(texts.withColumn("_order", seeded(F.concat("source", F.lit(":"), "text"), seed)), "_order", by=["source"], rank="at")
    sizes = texts.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") >= k + 1)
    owner = excerpts.where("source is not null").groupBy("id").agg(F.min("source").alias("source")).withColumnRenamed("id", "base")
    of = pairs.select(F.col("id").alias("pair_id"), "clean", style_base_id(F.col("id")).alias("base")).join(owner, "base").join(sizes, "source")
    start = F.pmod(F.conv(F.substring(seeded(F.col("pair_id"), seed), 1, 8), 16, 10).cast("long"), F.col("n"))
    places = of.select("pair_id", "source", "clean", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.pmod(start + i, F.col("n")))).alias("turn", "at"))
    met = places.join(circle.select("source", "at", "text"), ["source", "at"]).where(F.col("text") != F.col("clean"))
    taken = met.groupBy("pair_id", "source").agg(F.slice(F.array_sort(F.collect_list(F.struct("turn", "text"))), 1, k).alias("x"))  # at most k + 1
    return taken.select("pair_id", "source", F.size("x").alias("refs"), F.array_join(F.transform("x", lambda r: r["text"]), "\n\n").alias("reference"))
