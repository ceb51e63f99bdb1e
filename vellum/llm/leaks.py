"""Passages of held-out items in a corpus, by spaced seeds.

A seed hashes the words of a window of ``SPAN`` words that a fixed mask keeps, so a word changed at a place the mask
ignores leaves it as it was. Windows of the corpus are looked up among the items' seeds, first in a bit map sized by
their number, then by a join; around each hit the overlap is extended word by word, changed words allowed. An identical run of
``SPAN`` words or more is hit by every mask.

Null and empty texts and items of fewer words than ``SPAN`` have no seeds and are in no result; items with the same words
share their seeds and each count. Only the named columns are read; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.words import content, grams, slices, word_hashes, words
from vellum.shared import materialize, semi, spread

SPAN = 13
#: Places of a window that each mask keeps.
MASKS = tuple(tuple(i for i, x in enumerate(m) if x == "1") for m in ("1110110010111", "1101001110110", "1011011101001"))
#: The bit map has 16 bits or more for each seed, between 2 ** 16 and 2 ** 26 bits (8 MB); from 4 million seeds on it fills
#: up (at 30 million a third of its bits are set), and more windows are left to the join.
LEAST_BITS, MOST_BITS, SPARE = 16, 26, 16
#: An extension ends once it has lost this much: a word that agrees counts 1, one that doesn't -PENALTY.
PENALTY, DROP = 3, 8


def _seeds(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of all texts, and each one's text."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    n = len(h) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    whole = owner[:n] == owner[SPAN - 1 :]
    each = [grams(h, SPAN, m)[whole] + np.uint64(k) for k, m in enumerate(MASKS)]
    return np.concatenate(each), np.tile(owner[:n][whole], len(MASKS))


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, bounds = word_hashes(b.column(1).to_pylist())
        cs = np.array([content(h[bounds[i] : bounds[i + 1]]) for i in range(b.num_rows)], np.int64)
        seed, owner = _seeds(h, bounds)
        yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(cs[owner])], ["seed", "c"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, bounds = word_hashes(b.column(1).to_pylist())
        cs = [content(h[bounds[i] : bounds[i + 1]]) if bounds[i + 1] - bounds[i] >= SPAN else None for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cs, pa.int64()), b.column(1)], ["item", "c", "text"])


def map_bits(seeds: int) -> int:
    """The size of the bit map for a number of seeds, as a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, (SPARE * seeds - 1).bit_length()))


def _lookup(bitmap, power: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for whole in batches:
            for b in slices(whole, "text", 4_000_000):
                h, bounds = word_hashes(b.column(1).to_pylist())
                seed, owner = _seeds(h, bounds)
                place = seed >> np.uint64(64 - power)
                hit = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
                pairs = np.unique(np.stack([owner[hit].astype(np.int64), seed[hit].view(np.int64)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pairs[:, 0])), pa.array(pairs[:, 1])], ["doc", "seed"])

    return run


def _extend(a: list[str], b: list[str], i: int, j: int, step: int) -> tuple[int, int]:
    """Words and changed words that an extension from a[i], b[j] adds before it has lost ``DROP``."""
    score = best = length = changed = n = bad = 0
    while 0 <= i < len(a) and 0 <= j < len(b) and score > best - DROP:
        n += 1
        if a[i] == b[j]:
            score += 1
        else:
            score -= PENALTY
            bad += 1
        if score > best:
            best, length, changed = score, n, bad
        i, j = i + step, j + step
    return length, changed


def overlap(doc: list[str], item: list[str]) -> tuple[int, int, int]:
    """The longest identical run, and the longest overlap around a hit with its changed words."""
    at: dict[tuple[int, tuple[str, ...]], list[int]] = {}
    for k, m in enumerate(MASKS):
        for i in range(len(item) - SPAN + 1):
            at.setdefault((k, tuple(item[i + x] for x in m)), []).append(i)
    done: dict[int, int] = {}  # by diagonal, the place up to which it has been looked at
    exact, best = 0, (0, 0)
    for j in range(len(doc) - SPAN + 1):
        for k, m in enumerate(MASKS):
            for i in at.get((k, tuple(doc[j + x] for x in m)), ()):
                if done.get(j - i, -1) >= j:
                    continue
                back, right = _extend(doc, item, j - 1, i - 1, -1), _extend(doc, item, j, i, 1)
                lo, n = j - back[0], back[0] + right[0]
                done[j - i] = max(j, lo + n - SPAN)
                run = 0
                for x in range(lo, lo + n):
                    run = run + 1 if doc[x] == item[x - j + i] else 0
                    exact = max(exact, run)
                if n > best[0]:
                    best = (n, back[1] + right[1])
    return exact, *best


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        each = [overlap(words(t), words(i)) for t, i in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        cols = list(zip(*each, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int32()) for x in cols)], ["doc_id", "c", "exact_words", "overlap_words", "changed_words"])


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, exact_words, overlap_words, changed_words`` of each document and item that share a seed."""
    of = items.select(F.col(item).cast("long").alias("item"), F.col(text).cast("string").alias("text")).where("item is not null and text is not null")
    names = materialize(of.mapInArrow(_named, "item long, c long, text string").where("c is not null"))
    seeds = materialize(names.groupBy("c").agg(F.min("text").alias("text")).select("c", "text").mapInArrow(_item_seeds, "seed long, c long").distinct())
    power = map_bits(seeds.count())
    place = f"shiftrightunsigned(seed, {64 - power})"
    filled = seeds.selectExpr(f"cast(shiftright({place}, 6) as int) as w", f"shiftleft(1L, cast({place} & 63 as int)) as v").groupBy("w").agg(F.expr("bit_or(v)").alias("v")).toArrow()  # at most 2 ** (MOST_BITS - 6) words, 12 MB, however many seeds
    bitmap = np.zeros(1 << (power - 6), np.int64)
    bitmap[filled["w"].to_numpy()] = filled["v"].to_numpy()
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).where("doc is not null and text is not null")
    hits = spread(rows).mapInArrow(_lookup(shipped, power), "doc long, seed long")
    pairs = materialize(hits.join(seeds, "seed").select("doc", "c").distinct())
    texts = semi(rows, pairs, "doc")
    item_texts = names.groupBy("c").agg(F.min("text").alias("item_text"))
    found = pairs.join(texts, "doc").join(item_texts, "c").select("doc", "c", "text", "item_text").mapInArrow(_verify, "doc_id long, c long, exact_words int, overlap_words int, changed_words int")
    return found.join(names.select(F.col("item").alias("item_id"), "c"), "c").select("doc_id", "item_id", "exact_words", "overlap_words", "changed_words")
