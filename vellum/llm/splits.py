"""Records that stand in an evaluation split and, exactly or nearly, in the training split.

A text's fingerprints are minima of its rolling hashes of ``SHINGLE`` words: the texts' distinct runs are put in one
order, those that few texts have first (by the count of the run's hash bucket over all texts, then by the hash), and a
text keeps its first ``n - ceil(s n) + 1`` of n for a threshold s. Two texts of similarity s share ``s / (1 + s)`` of both
texts' runs, at least ``ceil(s n)`` of either's, so some of those that both keep are the same: no pair is lost, however
short, long or repetitive a text is. By the same count they share ``s / (1 + s)`` of both less what the one that drops
more has dropped; so much is asked for before texts are fetched. A passage that many texts have comes last in the order
and is no fingerprint of a text that has enough of its own. (Minima of windows can't promise that: short runs between
changed words, or runs that repeat, leave windows without a common minimum.) The fingerprints are joined across splits;
then the winnowed seeds of a pair, one of every ``WINDOW`` consecutive runs, are chained and extended word by word, and
the similarity is computed exactly.

Null texts and rows without a split are left out. Texts without a shingle are a case only if equal as strings. Copies
within a task are fingerprinted once; equal texts meet by their class. Empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.near import jaccard
from vellum.llm.words import content, grams, lists, slices, winnow, word_hashes, words
from vellum.shared import anti, bounded, materialize, semi, spread

WINDOW, SHINGLE = 3, 3
THRESHOLD = 0.6
#: Buckets in which runs are counted to order them: one number each is sent to the driver and to every task, 1 MB.
BUCKETS = 1 << 17


def _bucket(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(64 - 17)).astype(np.int64)


def _class(h: np.ndarray, text: str) -> int:
    """A text's class: its words, or the text itself if it has no shingle."""
    return content(h) if len(h) >= SHINGLE else int(np.int64(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=1))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many different texts of a task have a run of each bucket."""
    seen: set[int] = set()
    total = np.zeros(BUCKETS, np.int64)
    for whole in batches:
        for b in slices(whole, "text"):
            texts = b.column(2).to_pylist()
            h, ends = word_hashes(texts)
            g = grams(h, SHINGLE)
            for i, text in enumerate(texts):
                own = h[ends[i] : ends[i + 1]]
                if len(own) >= SHINGLE and (c := _class(own, text)) not in seen:
                    seen.add(c)
                    total += np.bincount(_bucket(np.unique(g[ends[i] : ends[i + 1] - SHINGLE + 1])), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32), pa.int32()), pa.array(total[at])], ["bucket", "n"])


def dropped(n: int, threshold: float) -> int:
    """How many of a text's ``n`` distinct runs are no fingerprints."""
    return max(0, int(np.ceil(threshold * n - 1e-9)) - 1)


def _fingerprints(counts, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(counts.value, np.int64)
        seen: set[tuple[bool, int]] = set()
        node = TaskContext.get().partitionId() << 32  # names a text by few bytes that aren't zero, so rows of seeds pack well
        for whole in batches:
            for b in slices(whole, "text"):
                sides, texts = b.column(0).to_pylist(), b.column(2).to_pylist()
                h, ends = word_hashes(texts)
                g = grams(h, SHINGLE)
                cs, ns, flat, bounds, nulls = [], [], [], [0], []
                for i, (side, text) in enumerate(zip(sides, texts, strict=True)):
                    own = h[ends[i] : ends[i + 1]]
                    runs = np.unique(g[ends[i] : ends[i + 1] - SHINGLE + 1]) if len(own) >= SHINGLE else np.empty(0, np.uint64)
                    cs.append(c := _class(own, text))
                    ns.append(len(runs))
                    key = (side == "train", c)
                    nulls.append(key in seen or not len(runs))
                    if not nulls[-1]:
                        seen.add(key)
                        order = np.lexsort((runs, often[_bucket(runs)]))
                        flat.append(np.sort(runs[order[: len(runs) - dropped(len(runs), threshold)]]))
                        bounds.append(bounds[-1] + len(flat[-1]))
                    else:
                        bounds.append(bounds[-1])
                seeds = np.concatenate(flat).view(np.int64) if flat else np.empty(0, np.int64)
                nodes = pa.array(range(node, node + b.num_rows), pa.int64())
                node += b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), nodes, pa.array(cs, pa.int64()), pa.array(ns, pa.int32()), lists(seeds, bounds, pa.int64(), nulls)], ["side", "line", "node", "c", "n", "seeds"])

    return run


def chain(a: list[str], b: list[str]) -> tuple[float, float]:
    """Share of each word list that collinear winnowed seeds, extended while the words agree, cover in the other."""
    place: dict[tuple[str, ...], int] = {}
    for j in range(len(b) - SHINGLE + 1):
        place.setdefault(tuple(b[j : j + SHINGLE]), j)
    h, _ = word_hashes([" ".join(a)])
    seeds_at = winnow(grams(h, SHINGLE), WINDOW).tolist() if len(h) == len(a) else range(len(a) - SHINGLE + 1)
    hits = [(i, place[t]) for i in seeds_at if (t := tuple(a[i : i + SHINGLE])) in place]
    tails, at, back = [], [], [-1] * len(hits)
    for k, (_, j) in enumerate(hits):  # the longest chain that rises in both texts
        x = bisect_left(tails, j)
        back[k] = at[x - 1] if x else -1
        if x == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[x], at[x] = j, k
    k, seeds = at[-1] if at else -1, []
    while k >= 0:
        seeds.append(hits[k])
        k = back[k]
    in_a, in_b = set(), set()
    for i, j in seeds:
        if i in in_a and i + SHINGLE - 1 in in_a:
            continue
        lo, hi = 0, SHINGLE
        while i + lo > 0 and j + lo > 0 and a[i + lo - 1] == b[j + lo - 1]:
            lo -= 1
        while i + hi < len(a) and j + hi < len(b) and a[i + hi] == b[j + hi]:
            hi += 1
        in_a.update(range(i + lo, i + hi))
        in_b.update(range(j + lo, j + hi))
    return len(in_a) / max(1, len(a)), len(in_b) / max(1, len(b))


def _unique_grams(texts: list[str]) -> list[np.ndarray]:
    """Each text's distinct shingle hashes."""
    h, ends = word_hashes(texts)
    g = grams(h, SHINGLE)
    return [np.unique(g[ends[i] : max(ends[i], ends[i + 1] - SHINGLE + 1)]) for i in range(len(texts))]


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "tt", 16_000_000):
                es, ts, left, right = (b.column(i).to_pylist() for i in range(4))
                # Pairs come in order of t: each text is hashed once for all of its pairs here.
                own, other = dict(zip(es, left, strict=True)), dict(zip(ts, right, strict=True))
                of, to = (dict(zip(d, _unique_grams(list(d.values())), strict=True)) for d in (own, other))
                out = []
                for e, t, t1, t2 in zip(es, ts, left, right, strict=True):
                    x, y = of[e], to[t]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both < threshold * (len(x) + len(y) - both) - 1e-6:
                        continue  # hashes that agree by chance can only raise it
                    a, z = words(t1), words(t2)
                    s = jaccard(*(set(zip(*(w[i:] for i in range(SHINGLE)), strict=False)) for w in (a, z)))
                    if s >= threshold:
                        out.append((e, t, s, *chain(a, z)))
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)], ["e", "t", "similarity", "covered", "covers"])

    return run


def cross_split(evals: DataFrame, train: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Overlaps of ``evals(split, line, text)`` with ``train(line, text)``; lines are unique within a split.

    Returns ``split, eval_line, train_line, similarity, covered, covers``: the share of the evaluation text's words that
    the chain of seeds covers, and of the training text's.
    """
    rows = evals.select(F.concat(F.lit("eval:"), "split").alias("side"), F.col("line").cast("long"), F.col("text").cast("string")).unionByName(train.select(F.lit("train").alias("side"), F.col("line").cast("long"), F.col("text").cast("string"))).where("side is not null and text is not null and line is not null")
    rows = spread(rows)
    counts = np.zeros(BUCKETS, np.int64)
    for r in rows.mapInArrow(_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # BUCKETS rows at most
        counts[r.bucket] = r.n
    shipped = rows.sparkSession.sparkContext.broadcast(counts.tobytes())
    prints = materialize(rows.mapInArrow(_fingerprints(shipped, threshold), "side string, line long, node long, c long, n int, seeds array<long>"))
    is_train = F.col("side") == "train"
    # Of equal texts that several tasks have fingerprinted, one stays; the list of the others is short.
    named = prints.where("seeds is not null").select(is_train.alias("train"), "c", "node")
    first = named.groupBy("train", "c").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    more = materialize(named.join(first, ["train", "c"]).where("node > first").select("node"))
    fresh = anti(prints.where("seeds is not null"), more, "node")
    e, t = (fresh.where(x).select(F.explode("seeds").alias("seed"), F.col("node").alias(k), F.col("n").alias(f"n{k}")) for x, k in ((~is_train, "e"), (is_train, "t")))
    drop = F.ceil(threshold * F.greatest("ne", "nt") - 1e-9) - 1
    least = F.greatest(F.lit(1), F.ceil(threshold / (1 + threshold) * (F.col("ne") + F.col("nt")) - 1e-9) - F.greatest(F.lit(0), drop))
    near = F.least("ne", "nt") >= threshold * F.greatest("ne", "nt") - 1e-9
    likely = e.join(t, "seed").where(near).groupBy("e", "t", "ne", "nt").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("e", "t")
    of = [fresh.where(x).select(F.col("node").alias(k), F.col("c").alias(f"c{k}")) for x, k in ((~is_train, "e"), (is_train, "t"))]
    pairs = materialize(likely.join(of[0], "e").join(of[1], "t").where("ce <> ct").select(F.col("ce").alias("e"), F.col("ct").alias("t")).distinct())
    lines = [materialize(semi(prints.where(x).select("side", "line", "c"), pairs.select(F.col(k).alias("c")).distinct(), "c").groupBy("c").agg(F.min(F.struct("side", "line")).alias("x")).select("c", "x.side", "x.line")) for x, k in ((~is_train, "e"), (is_train, "t"))]
    texts = [semi(rows.where(x), k, "line").join(bounded(k), ["side", "line"]).select(F.col("c").alias(n), F.col("text").alias(f"t{n}")) for x, k, n in ((~is_train, lines[0], "e"), (is_train, lines[1], "t"))]
    links = materialize(pairs.join(texts[0], "e").join(texts[1], "t").select("e", "t", "te", "tt").mapInArrow(_verifier(threshold), "e long, t long, similarity double, covered double, covers double"))
    ev = prints.where(~is_train).select(F.expr("substring(side, 6)").alias("split"), F.col("line").alias("eval_line"), F.col("c").alias("e"))
    tr = prints.where(is_train).select(F.col("line").alias("train_line"), F.col("c").alias("t"))
    near = ev.join(links, "e").join(tr, "t").select("split", "eval_line", "train_line", "similarity", "covered", "covers")
    one = F.lit(1.0)
    same = ev.join(tr, F.col("e") == F.col("t")).select("split", "eval_line", "train_line", one.alias("similarity"), one.alias("covered"), one.alias("covers"))
    return near.unionByName(same)
