"""Texts that were cut off, from the lengths of each source's texts and from how they end.

Lengths are counted in characters and in UTF-8 bytes, as they stand and without outer white space. For each source a
log-normal length distribution, right-censored at the candidate limits, is fitted by maximum likelihood (EM); a
candidate is a length that many more texts have than their neighbours do, and at which several end openly. A value of
such a length is censored with posterior odds ``observed / expected - 1``, unbounded; for any other length the odds are
the source's rate of interrupted texts. They are multiplied by the likelihood ratio of the text's ending, which is
estimated for each source: how often texts at its limits end so, against how often its whole texts do.

What whole texts do is what is left of the rows away from limits once those that interruptions explain are taken off:
fragments of words and broken characters, which no habit makes, give the number of interrupted texts, and the endings at
limits say how these end. So a source that never sets a last full stop makes an open end no evidence, and only its limit
tells. A cut inside a word or sentence leaves an open end; a text whose sentence is closed is no case at any length. A
quotation mark after a word and an abbreviation may stand inside a sentence or end it, and are left to the odds.

Null, empty and blank texts and those of fewer than 4 words are not truncated. Rows without a source are fitted together as one. Repeated rows each
count. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from math import erf, exp, log, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.words import WORD
from vellum.shared import bounded, materialize, spread

#: Endings of texts that were cut and of whole ones, before any row is seen (shares), and how many rows that is worth.
#: Endings that aren't named in the first are no case.
CUT = {"fragment": 0.45, "word": 0.25, "broken": 0.15, "clause": 0.10, "marked": 0.03, "abbreviation": 0.02}
WHOLE = {"fragment": 0.0015, "word": 0.004, "broken": 0.0005, "clause": 0.002, "marked": 0.006, "abbreviation": 0.003}
STRENGTH = 50.0
#: Share of interrupted texts before any row is seen.
RATE = 0.03
#: Endings that no whole text has by habit.
TORN = ("fragment", "broken")
#: Endings that tell of a lost rest; at a limit, several texts have them.
OPEN = ("broken", "fragment", "word", "clause")
#: Standard deviations by which an ending must exceed what interruptions explain to be a habit.
BEYOND = 3.0
#: A candidate limit has this many texts at least, and this many times as many as the mean of its neighbours.
SPIKE_ROWS, SPIKE_TIMES, NEIGHBOURS = 5, 6.0, 25
#: Texts of fewer words hold no sentence that could have been cut.
FEWEST = 4

_INVISIBLE = "​‌‍﻿⁠"
_QUOTES = "”\"»’'“)]}›"
_BROKEN = re.compile(r"(?:�|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|&#?\w{0,7}|%[0-9A-Fa-f]?|(?:%[0-9A-Fa-f]{2})+(?:%[0-9A-Fa-f]?)?|<[a-zA-Z/][^<>]{0,40})$")
_MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December|Januar|Februar|März|Mai|Juni|Juli|Oktober|Dezember|janvier|février|mars|avril|juin|juillet|août|septembre|octobre|novembre|décembre|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)"
_FORMULA = re.compile(
    r"(?:(?:^|[\s.!?…”\"“»])(?:THE END|The End|FIN|FINIS|Fin|ENDE|Ende)"
    r"|(?:^|[\n,.!?”] ?)(?:Yours|Sincerely|Faithfully|Truly|Love|Regards|Best|Ever|Always|Ihr|Ihre|Dein|Deine|Votre|Ton|Tuyo|Suyo)\b[^.!?\n]{0,40},?\s*\n\s*[^\W\d_][\w.’'-]*(?: [^\W\d_][\w.’'-]*){0,3}"
    rf"|\n[^\n.!?]{{0,60}}\b(?:{_MONTH}|\d{{4}})(?: \d{{4}})?"
    r"|(?:^|[\n.!?…”\"“»]) ?[—–-]{1,2} ?(?:from|by|aus|von|de|du|del|por|par)\b[^.!?\n]{1,80}"
    r"|[*#~=_]{1,3}(?: ?[*#~=_]){0,8})$"
)

#: What stands before more words, its full stop notwithstanding.
_ABBREVIATION = re.compile(r"(?:^|[\s“„«\"(])(?:Mrs?|Ms|Messrs|Dr|Prof|St|Rev|Hon|Capt|Col|Gen|Lt|Sgt|Hr|Fr|Frl|Mme|Mlle|Sra?|Srta|Dña|D|M)\.$")


def ending(text: str | None, model: str | None = None) -> str:
    """What a text's end says: one of ``OPEN``, ``marked`` or ``abbreviation``, or that it is whole: ``closed``, ``quoted``, ``formula`` or ``blank``.

    A text that ends as its model does, up to the last word, is closed. A last word that stands nowhere else in the text
    or its model is a ``fragment``.
    """
    t = (text or "").strip().rstrip(_INVISIBLE).rstrip()
    if len(t.split(None, FEWEST)) < FEWEST:
        return "blank"
    if ends_as(t, model):
        return "closed"
    if _BROKEN.search(t):
        return "broken"
    if _FORMULA.search(t[-240:]):
        return "formula"
    bare = t.rstrip(_QUOTES)
    closed = len(bare) < len(t)
    last = bare[-1:] or t[-1]
    if not closed and _ABBREVIATION.search(t[-12:]):
        return "abbreviation"
    if last in ".!?…。！？*":
        # An opening mark after the full stop begins what was lost.
        tail = t[len(bare) :]
        return "clause" if tail.endswith("“") and not _opened(t, "„") else "closed"
    if last in ",;:":
        return "clause"
    if last in "—–-":
        return "closed" if closed else "clause"
    if closed and t[-1] in "”\"»)]}“":
        return "clause" if t[-1] == "“" and not _opened(t, "„") else "closed" if t[-1] in ")]}" else "marked" if bare.rstrip()[-1:].isalnum() else "quoted"
    if last in "«„(¿¡[{":
        return "clause"
    if not (last.isalnum() or last in "’'"):
        return "closed"
    found = WORD.findall(t.lower())
    return "word" if found and (found[-1] in found[:-1] or found[-1] in WORD.findall((model or "").lower())) else "fragment"


def ends_as(text: str, model: str | None) -> bool:
    """Whether a text ends as its model does, up to the last word."""
    return bool(model) and len(text) >= 80 and (model.rstrip().endswith(text[-40:]) or _stem(text)[-40:] == _stem(model)[-40:])


def _stem(text: str) -> str:
    """A text without its last word."""
    return (text.rstrip().rsplit(None, 1) or [""])[0]


def _opened(text: str, mark: str) -> bool:
    """Whether a German quotation is open, so that a last “ closes it."""
    return text.rfind(mark) > text.rfind("“", 0, len(text) - 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(2).to_pylist()
        models = b.column(3).to_pylist()
        each = [("blank", 0, 0, 0, 0) if t is None else (ending(t, m), len(t), len(s := t.strip()), len(t.encode("utf-8", "surrogatepass")), len(s.encode("utf-8", "surrogatepass"))) for t, m in zip(texts, models, strict=True)]
        cols = list(zip(*each, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.string()), *(pa.array(x, pa.int64()) for x in cols[1:])], ["key", "source", "ending", *MEASURES])


MEASURES = ("chars", "chars_bare", "bytes", "bytes_bare")


def features(df: DataFrame, key: str, source: str, text: str, model: str | None = None) -> DataFrame:
    """``key, source, ending`` and the lengths of each row."""
    other = F.col(model).cast("string") if model else F.lit(None).cast("string")
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).cast("string").alias("text"), other.alias("model"))
    return spread(rows).mapInArrow(_features, "key long, source string, ending string, " + ", ".join(f"{m} long" for m in MEASURES))


def fit_censored(length: np.ndarray, n: np.ndarray, limit: np.ndarray, rounds: int = 40) -> tuple[float, float]:
    """Mean and deviation of the logarithms of lengths of which those at ``limit`` are only known to be no less."""
    x, w, cut = np.log(np.maximum(length, 1)), n.astype(float), limit.astype(bool)
    mu = float(np.average(x, weights=w))
    sd = max(0.05, sqrt(float(np.average((x - mu) ** 2, weights=w))))
    for _ in range(rounds):
        z = (x[cut] - mu) / sd
        tail = np.array([max(1e-12, 0.5 * (1 - erf(v / sqrt(2)))) for v in z])
        hazard = np.exp(-z * z / 2) / sqrt(2 * pi) / tail
        e1, e2 = x.copy(), x * x
        e1[cut] = mu + sd * hazard
        e2[cut] = mu * mu + sd * sd + sd * (x[cut] + mu) * hazard
        new = float(np.average(e1, weights=w))
        sd = max(0.05, sqrt(max(0.0, float(np.average(e2, weights=w)) - new * new)))
        if abs(new - mu) < 1e-6:
            break
        mu = new
    return mu, sd


def _limits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidate limits of one source and measure, from its histogram of lengths."""
    h = pdf.sort_values("length")
    length, n = h["length"].to_numpy(), h["n"].to_numpy()
    total = np.concatenate([[0], np.cumsum(n)])
    lo, hi = np.searchsorted(length, length - NEIGHBOURS), np.searchsorted(length, length + NEIGHBOURS, "right")
    mean = (total[hi] - total[lo] - n) / (2 * NEIGHBOURS)
    spike = (n >= SPIKE_ROWS) & (n > SPIKE_TIMES * np.maximum(mean, 0.2)) & (length > 20)
    out = pd.DataFrame({"source": [], "measure": [], "length": [], "odds": [], "decides": []})
    if spike.any():
        mu, sd = fit_censored(length, n, spike)
        at = length[spike]
        density = [exp(-((log(v) - mu) ** 2) / (2 * sd * sd)) / (v * sd * sqrt(2 * pi)) for v in at]
        expected = n.sum() * np.array(density)
        out = pd.DataFrame({"length": at, "odds": np.maximum(n[spike] / np.maximum(expected, 1e-9) - 1, 1e-9), "decides": h["open"].to_numpy()[spike] >= SPIKE_ROWS})
        out.insert(0, "measure", h["measure"].iloc[0])
        out.insert(0, "source", h["source"].iloc[0])
    return out.astype({"source": "object", "measure": "object", "length": "int64", "odds": "float64", "decides": "bool"})


def limits(feats: DataFrame) -> DataFrame:
    """``source, measure, length, odds, decides``: each source's candidate limits, the posterior odds that a value there is
    censored, and whether so many texts end openly there that it is a limit at which texts were cut."""
    each = feats.where("ending <> 'blank'").select("source", F.col("ending").isin(*OPEN).cast("int").alias("open"), F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in MEASURES))).alias("x"))
    histogram = each.groupBy("source", "x.measure", "x.length").agg(F.count("*").alias("n"), F.sum("open").alias("open"))
    return histogram.groupBy("source", "measure").applyInPandas(_limits, "source string, measure string, length long, odds double, decides boolean")


def evidence(rows: DataFrame) -> DataFrame:
    """``source, rate_odds, ratio``: each source's odds of an interruption, and a map of its endings' likelihood ratios.

    ``rows`` have ``source, ending`` and ``limit``, the posterior odds of censoring at the row's length, 0 away from limits.
    """
    p = F.col("limit") / (1 + F.col("limit"))
    known, away = F.col("ending") != "blank", F.col("limit") == 0
    count = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    figures = [f"{k}_{e}" for k in ("at", "off") for e in CUT] + ["off"]
    of = rows.where(known).groupBy("source").agg(
        *(count(F.when(F.col("ending") == e, p)).alias(f"at_{e}") for e in CUT),
        *(count(F.when(away & (F.col("ending") == e), 1.0)).alias(f"off_{e}") for e in CUT),
        count(F.when(away, 1.0)).alias("off"),
    )
    of = materialize(of)  # one row a source
    total = of.agg(*(count(f).alias(f"all_{f}") for f in figures))
    both = of.crossJoin(F.broadcast(total))  # one row
    col, add = F.col, lambda xs: reduce(lambda x, y: x + y, xs)
    # How cut texts end: at all sources' limits with the prior's rows, then at this source's with as many of all.
    everywhere = {e: (col(f"all_at_{e}") + STRENGTH * v) / (add(col(f"all_at_{x}") for x in CUT) + STRENGTH) for e, v in CUT.items()}
    cut = {e: (col(f"at_{e}") + STRENGTH * everywhere[e]) / (add(col(f"at_{x}") for x in CUT) + STRENGTH) for e in CUT}
    step = both.select("source", *figures, *(v.alias(f"cut_{e}") for e, v in cut.items()))
    step = step.withColumn("torn", F.least(col("off"), add(col(f"off_{e}") for e in TORN) / add(col(f"cut_{e}") for e in TORN)))
    expected = {e: col("torn") * col(f"cut_{e}") for e in CUT}
    habit = {e: F.lit(0.0) if e in TORN else F.greatest(F.lit(0.0), col(f"off_{e}") - expected[e] - BEYOND * F.sqrt(expected[e] + 1)) for e in CUT}
    whole = {e: (habit[e] + STRENGTH * WHOLE[e]) / (col("off") - col("torn") + STRENGTH) for e in CUT}
    whole |= {e: F.greatest(whole[e], F.lit(WHOLE[e])) for e in CUT if e not in OPEN}  # rare, but no sign of a cut
    rate = (col("torn") + STRENGTH * RATE) / (col("off") + STRENGTH)
    ratio = F.create_map(*(x for e in CUT for x in (F.lit(e), col(f"cut_{e}") / whole[e])))
    return step.select("source", (rate / (1 - rate)).alias("rate_odds"), ratio.alias("ratio"))


def judged(feats: DataFrame) -> DataFrame:
    """``feats`` (materialized) with ``limit``, the posterior odds that the length is a limit's, ``odds`` of a cut (natural logarithm) and ``truncated``."""
    of = lambda m: F.max(F.when(F.col("measure").startswith(m), F.col("odds")))
    found = limits(feats).where("decides").groupBy("source", "length").agg(of("chars").alias("c"), of("bytes").alias("b"))
    # One row a source, with at most a few limits; a source without any gets none.
    by = materialize(found.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("length", F.struct("c", "b")))).alias("at")))
    get = lambda m, k: F.try_element_at("at", F.col(m))[k]
    best = F.coalesce(F.greatest(get("chars", "c"), get("chars_bare", "c"), get("bytes", "b"), get("bytes_bare", "b")), F.lit(0.0))
    rows = feats.join(bounded(by), "source", "left").select(*feats.columns, best.alias("limit"))
    known = rows.join(bounded(materialize(evidence(rows))), "source", "left")
    ratio = F.try_element_at("ratio", F.col("ending"))
    odds = F.log(F.when(F.col("limit") > 0, F.col("limit")).otherwise(F.col("rate_odds"))) + F.log(ratio)
    return known.select(*feats.columns, "limit", F.coalesce(odds, F.lit(-99.0)).alias("odds")).withColumn("truncated", F.col("odds") > 0)


def rates(rows: DataFrame) -> DataFrame:
    """For each source: its texts, how many were cut, the rate, and how many of those at a length limit."""
    cut = F.col("truncated").cast("int")
    return rows.where("ending <> 'blank'").groupBy("source").agg(F.count("*").alias("texts"), F.sum(cut).cast("long").alias("cut"), F.round(F.avg(cut), 6).alias("rate"), F.sum(cut * (F.col("limit") > 1).cast("int")).cast("long").alias("at_limit"))
