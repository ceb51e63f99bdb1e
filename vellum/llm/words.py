"""Words and shingles as arrays of 64-bit hashes, batch by batch, for the operators that compare texts.

A word is a maximal run of letters and digits of any script, compared in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORD = re.compile(r"[^\W_]+")
#: Distinct words a worker remembers before it starts again.
MEMO = 400_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHash(dict):
    """Hash of each word's lower case, remembered up to ``MEMO`` words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        return h


_hash = _WordHash()


def words(text: str | None) -> list[str]:
    """The words of a text; none for null."""
    return [w.lower() for w in WORD.findall(text)] if text else []


def hashes(found: list[str]) -> np.ndarray:
    """The hashes of words as ``WORD`` finds them."""
    return np.fromiter(map(_hash.__getitem__, found), np.uint64, len(found))


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' word hashes in one array, and each text's start (one more for the end)."""
    parts, ends, n = [], [0], 0
    for t in texts:
        if t:
            found = WORD.findall(t)
            parts.append(np.fromiter(map(_hash.__getitem__, found), np.uint64, len(found)))
            n += len(found)
        ends.append(n)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(ends, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int, mask: Iterable[int] | None = None) -> np.ndarray:
    """Hashes of the runs of ``k`` hashes at each place; only the offsets in ``mask`` count, all if it is None.

    The result has ``len(h) - k + 1`` entries, none if that is not positive; runs over a text's end are the caller's to leave out.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k) if mask is None else mask:
        out = (out ^ (out >> np.uint64(29))) * _M1 + h[i : i + n]
    return mix(out)


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Places of the minima of all windows of ``w`` entries (the last of equal ones); of the whole array if it is shorter."""
    n = len(g)
    if not n:
        return np.empty(0, np.int64)
    w = min(w, n)
    # Reversed, so that argmin's first is the last of equal ones.
    windows = np.lib.stride_tricks.sliding_window_view(g, w)[:, ::-1]
    at = np.arange(n - w + 1) + (w - 1 - windows.argmin(axis=1))
    return np.unique(at)


def content(h: np.ndarray) -> int:
    """A signed 64-bit name of a sequence of words."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(h.tobytes()))))


def lists(values: np.ndarray, ends: list[int] | np.ndarray, kind: pa.DataType, nulls: list[bool] | None = None) -> pa.ListArray:
    """An Arrow list column from one flat array and the lists' bounds."""
    mask = pa.array(nulls, pa.bool_()) if nulls is not None else None
    return pa.ListArray.from_arrays(pa.array(np.asarray(ends, np.int32)), pa.array(values, kind), mask=mask)


def slices(batch: pa.RecordBatch, column: str, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of ``column``, so that long texts don't fill a worker's memory."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    total = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        base = total[at - 1] if at else 0
        end = min(max(at + 1, int(np.searchsorted(total, base + size, "right"))), n)
        yield batch.slice(at, end - at)
        at = end
