"""Texts above a size limit in pieces within it, cut where the vocabulary changes most.

Within the second half of what a piece may hold, the best kind of boundary there is is taken: paragraph, line, sentence,
word; if it has none, the best kind in the first half beyond the overlap, else any character. Of several boundaries of that kind the one in the deepest valley of lexical cohesion is cut:
the similarity of the word counts of the blocks before and after it, against the peaks on either side. The next piece
begins at a sentence or word within the overlap before the cut.

Null, empty and short texts give no piece. Lengths are in Unicode characters. A text is walked once, window by window,
so a very long one takes time in proportion and no more memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.words import WORD, slices
from vellum.shared import ship

#: Characters of the blocks compared on either side of a boundary, and places their words are counted in.
BLOCK, PLACES = 600, 128
_KINDS = tuple(re.compile(x) for x in (r"\n[^\S\n]*\n\s*", r"\n", r"(?<=[.!?…])[”“»\"')\]]*\s+|(?<=[。！？])[”」』）]*\s*", r"\s+"))


def _counts(text: str) -> np.ndarray:
    at = [xxhash.xxh32_intdigest(w.lower()) % PLACES for w in WORD.findall(text) if len(w) > 3]
    return np.bincount(at, minlength=PLACES).astype(np.float64)


def cohesion(text: str, cuts: list[int]) -> np.ndarray:
    """Cosine of the word counts of the blocks before and after each cut."""
    out = np.empty(len(cuts))
    for i, c in enumerate(cuts):
        a, b = _counts(text[max(0, c - BLOCK) : c]), _counts(text[c : c + BLOCK])
        out[i] = float(a @ b) / (float(np.sqrt((a @ a) * (b @ b))) or 1.0)
    return out


def depths(similarity: np.ndarray) -> np.ndarray:
    """How far each value lies below the peaks it climbs to on the left and on the right, without going down on the way."""
    n = len(similarity)
    left, right = similarity.astype(float), similarity.astype(float)
    for i in range(1, n):
        if similarity[i - 1] >= similarity[i]:
            left[i] = left[i - 1]
    for i in range(n - 2, -1, -1):
        if similarity[i + 1] >= similarity[i]:
            right[i] = right[i + 1]
    return left + right - 2 * similarity


def _boundaries(text: str, lo: int, hi: int) -> list[int]:
    """The ends of the best kind of boundary in (lo, hi]; none if there is no boundary."""
    for kind in _KINDS:
        found = [m.end() for m in kind.finditer(text, lo, hi) if lo < m.end() <= hi]
        if found:
            return found
    return []


def split_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each piece; every end but the last is a chosen boundary."""
    n, start, out = len(text), 0, []
    while n - start > limit:
        least, middle, most = start + overlap + 1, start + max(overlap + 1, limit // 2), start + limit
        cuts = _boundaries(text, middle, most) or _boundaries(text, least, middle) or [most]
        cut = cuts[int(np.argmax(depths(cohesion(text, cuts))))] if len(cuts) > 1 else cuts[0]
        out.append((start, cut))
        back = max(start + 1, cut - overlap)
        later = [m.end() for k in _KINDS[2:3] for m in k.finditer(text, back, cut) if m.end() < cut] or [m.end() for m in _KINDS[3].finditer(text, back, cut) if m.end() < cut]
        start = later[0] if later else back
    out.append((start, n))
    return out


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                rec, no, lo, hi, text = [], [], [], [], []
                for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for i, (s, e) in enumerate(split_points(t, limit, overlap)):
                        rec.append(r)
                        no.append(i)
                        lo.append(s)
                        hi.append(e)
                        text.append(t[s:e])
                yield pa.RecordBatch.from_arrays([pa.array(rec, pa.int64()), pa.array(no, pa.int32()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(text, pa.string())], ["rec_id", "piece", "start", "end", "text"])

    return run


def pieces(df: DataFrame, rec: str, limit: int, overlap: int, text: str = "text") -> DataFrame:
    """``rec_id, piece, start, end, text`` of the rows of ``df`` above the limit, pieces counted from 0."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    ship(df.sparkSession)
    rows = df.select(F.col(rec).cast("long").alias("rec_id"), F.col(text).cast("string").alias("text")).where(F.length("text") > limit)
    return rows.mapInArrow(_pieces(limit, overlap), "rec_id long, piece int, start long, end long, text string")
