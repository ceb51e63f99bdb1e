"""The nearest vectors by cosine, each asked vector against all rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import six
from vellum.shared import spread

#: Asked vectors that one scan of all rows compares, and rows that are compared with them at a time.
BLOCK, ROWS = 1024, 4096


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Unit vectors as rows; NaN for one that is null, all zeros, of another width or has a null."""
    out = np.full((len(vectors), width), np.nan)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width and None not in v:
            out[i] = v
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, np.nan)


def _best(ids: np.ndarray, cosines: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by rounded cosine, then id; those without a cosine come last."""
    score = np.where(np.isnan(cosines), -np.inf, np.floor(cosines * 1e6 + 0.5))
    if len(score) > k:
        least = np.partition(score, -k)[-k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _compare(asked_ids: np.ndarray, asked: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [(np.empty(0, np.int64), np.empty(0)) for _ in asked_ids]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                found = _matrix(b.column(1).to_pylist(), asked.shape[1]) @ asked.T
                for q, own in enumerate(asked_ids):
                    other = ids != own
                    i, c = np.concatenate([top[q][0], ids[other]]), np.concatenate([top[q][1], found[other, q]])
                    best = _best(i, c, k)
                    top[q] = i[best], c[best]
        n = [len(i) for i, _ in top]
        i, c = (np.concatenate([t[j] for t in top]) for j in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked_ids, n), pa.int64()), pa.array(i, pa.int64()), pa.array(c, pa.float64(), from_pandas=True)], ["asked_id", "vec_id", "cosine"])

    return run


def nearest(asked: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``asked_id, vec_id, cosine, place``: the ``k`` of all ``rows`` nearest to each row of ``asked``, itself left out.

    Asked vectors pass through the driver in blocks, and each block is compared with all rows in one scan, which returns
    ``k`` rows a task and asked vector; these are merged. Keys are unique and not null.
    """
    pick = lambda df: df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    every, each, parts = spread(pick(rows)), pick(asked).toLocalIterator(), []
    while block := list(islice(each, BLOCK)):
        width = max((len(r.v) for r in block if r.v is not None), default=1)
        run = _compare(np.array([r.vec_id for r in block], np.int64), _matrix([r.v for r in block], width), k)
        parts.append(every.mapInArrow(run, "asked_id long, vec_id long, cosine double"))
    found = parts[0] if parts else rows.sparkSession.createDataFrame([], "asked_id long, vec_id long, cosine double")
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("asked_id").orderBy(F.desc_nulls_last("cosine"), "vec_id")
    return found.withColumn("cosine", six(F.col("cosine"))).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
