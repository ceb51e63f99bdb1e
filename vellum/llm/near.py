"""Near-duplicate records by MinHash bands, Bayesian pruning and an exact check.

Texts with the same words are one class and meet once. Classes that share a band of MinHash values are candidates;
their sketches are compared a block at a time, and a pair is dropped once the posterior probability that its
similarity reaches the threshold falls below ``EPSILON``. What is left is compared exactly, by its shingles.

A bucket of more than ``HOT`` classes makes no pairs of them all. Its classes are compared with one class, the first of
their buckets' first ones; those within half of the distance that the threshold leaves are a ball around it. Jaccard
distance is a metric, so every two classes of a ball are near duplicates, and none of their pairs is made. The centre then
stands for the ball in all buckets; what is near enough to a centre to be near to a member is compared with the members.
So the links and memberships of n near copies of one text grow with n; pairs of names are made where they are asked for.

At similarity 0.6 a pair misses all 48 bands of 4 values with probability 0.0013, at 0.65 with 0.0001.

Null ids, null and empty texts and texts of fewer words than a shingle are in no pair. Rows that repeat an id are
one record; an id with several texts is similar where any of them is. An empty table gives empty results. Only the
named columns are read, so further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.words import content, grams, lists, mix, slices, word_hashes, words
from vellum.shared import materialize, semi, spread

BANDS, ROWS = 48, 4
#: Classes of a bucket that are all paired.
HOT = 32
#: Values compared before the next decision.
BLOCK = 16
#: A pair is dropped when its posterior probability of reaching the threshold is below this.
EPSILON = 1e-4


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32), (seeds[n:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


_XOR, _MUL = _family(BANDS * ROWS)


def minhash(x: np.ndarray) -> np.ndarray:
    """The minimum of each of the hash functions over one text's shingle hashes."""
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, ((x[i : i + 2048, None] ^ _XOR) * _MUL).min(axis=0), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of MinHash values."""
    v = m.reshape(len(m), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), v.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + v[:, :, i])
    return key.view(np.int64)


def fewest_matches(threshold: float, n: int, epsilon: float = EPSILON) -> int:
    """The fewest matches among ``n`` byte-wide values at which the posterior of reaching ``threshold`` is ``epsilon``.

    The prior is uniform; a byte agrees by chance once in 256.
    """
    t = threshold + (1 - threshold) / 256
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= epsilon:
            return m
    return n


def _sketcher(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a copy within this task is sketched once
        for whole in batches:
            for b in slices(whole, "text"):
                h, ends = word_hashes(b.column(1).to_pylist())
                g = (grams(h, shingle) >> np.uint64(32)).astype(np.uint32)
                cs, found, fresh, keep = [], [], [], []
                for i in range(b.num_rows):
                    lo, hi = ends[i], ends[i + 1] - shingle + 1
                    if hi <= lo:
                        continue
                    keep.append(i)
                    cs.append(c := content(h[lo : ends[i + 1]]))
                    fresh.append(c not in seen)
                    if fresh[-1]:
                        seen.add(c)
                        found.append(minhash(g[lo:hi]))
                m = np.array(found, np.uint32).reshape(-1, BANDS * ROWS)
                at = np.concatenate([[0], np.cumsum(fresh)]).astype(np.int64)
                low = (m & np.uint32(255)).astype(np.uint8)
                sig = iter(low)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(keep, pa.int64())),
                        pa.array(cs, pa.int64()),
                        lists(band_keys(m).ravel(), at * BANDS, pa.int64(), [not x for x in fresh]),
                        pa.array([next(sig).tobytes() if x else None for x in fresh], pa.binary()),
                    ],
                    ["name", "c", "keys", "sig"],
                )

    return run


def _pruner(threshold: float):
    steps = [(n, fewest_matches(threshold, n)) for n in range(BLOCK, BANDS * ROWS + 1, BLOCK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
            alive, matches = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for n, least in steps:
                matches[alive] += (x[alive, n - BLOCK : n] == y[alive, n - BLOCK : n]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            take = pa.array(alive)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take)], ["c1", "c2"])

    return run


def _contents(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                h, ends = word_hashes(b.column(0).to_pylist())
                cs = [content(h[ends[i] : ends[i + 1]]) for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), b.column(0)], ["c", "text"])

    return run


def shingle_set(text: str, k: int) -> set[tuple[str, ...]]:
    """The distinct runs of ``k`` words of a text."""
    w = words(text)
    return set(zip(*(w[i:] for i in range(k)), strict=False))


def jaccard(a: set, b: set) -> float:
    """Shared entries divided by those in either set; 0 for two empty sets."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if both else 0.0


def _verifier(threshold: float, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for x in slices(whole, "t1", 4_000_000) for part in slices(x, "t2", 4_000_000)):
            out: list[tuple[int, int, float]] = []
            last, left = None, set()
            for c1, c2, t1, t2 in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if c1 != last:
                    last, left = c1, shingle_set(t1, shingle)
                s = jaccard(left, shingle_set(t2, shingle))
                if s >= threshold:
                    out.append((c1, c2, s))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["c1", "c2", "similarity"])

    return run


def _hot_balls(hot: DataFrame, verified, inner: float) -> DataFrame:
    """``c, b``: the classes of hot buckets (``key, c``) within a ball, and its centre; centres are in their own ball."""
    lead = hot.groupBy("key").agg(F.min("c").alias("r"))
    mine = materialize(hot.join(lead, "key").groupBy("c").agg(F.min("r").alias("r")))
    top = mine.select(F.col("c").alias("r"), F.col("r").alias("root"))
    star = materialize(mine.join(top, "r").where("c <> root").select(F.col("root").alias("c1"), F.col("c").alias("c2")))
    near = materialize(verified(star, inner))
    centres = near.select(F.col("c1").alias("b")).distinct()
    inside = near.join(centres.select(F.col("b").alias("c2")), "c2", "left_anti").select(F.col("c2").alias("c"), F.col("c1").alias("b"))
    return materialize(inside.unionByName(centres.select(F.col("b").alias("c"), "b")))


def near_duplicates(df: DataFrame, name: str = "id", text: str = "text", threshold: float = 0.8, shingle: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between classes of equal texts (``c1, c2, similarity``), balls of which every two classes are linked, too
    (``c, b``), and the classes' members (``name, c``)."""
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(text).cast("string").alias("text")).where("name is not null and text is not null")
    sketches = materialize(spread(rows).mapInArrow(_sketcher(shingle), "name string, c long, keys array<long>, sig binary"))
    bands = sketches.where("keys is not null").select("c", F.explode("keys").alias("key")).repartition("key").dropDuplicates(["key", "c"])
    count = bands.groupBy("key").agg(F.count("*").cast("int").alias("k")).where("k > 1")
    shared = materialize(bands.join(count, "key").select("key", "c", "k"))

    def likely(pairs: DataFrame, least: float) -> DataFrame:
        ends = materialize(pairs.select(F.explode(F.array("c1", "c2")).alias("c")).distinct())
        sig = semi(sketches.where("sig is not null").select("c", "sig"), ends, "c").dropDuplicates(["c"])
        left, right = (sig.select(F.col("c").alias(f"c{i}"), F.col("sig").alias(f"sig{i}")) for i in (1, 2))
        return materialize(pairs.join(left, "c1").join(right, "c2").select("c1", "c2", "sig1", "sig2").mapInArrow(_pruner(least), "c1 long, c2 long"))

    def verified(pairs: DataFrame, least: float) -> DataFrame:
        ends = materialize(pairs.select(F.explode(F.array("c1", "c2")).alias("c")).distinct())
        names = materialize(semi(sketches.select("name", "c"), ends, "c").groupBy("c").agg(F.min("name").alias("name")))
        texts = semi(rows, names, "name").dropDuplicates(["name", "text"]).select("text").mapInArrow(_contents(shingle), "c long, text string").dropDuplicates(["c"])
        left, right = (texts.select(F.col("c").alias(f"c{i}"), F.col("text").alias(f"t{i}")) for i in (1, 2))
        return pairs.join(left, "c1").join(right, "c2").select("c1", "c2", "t1", "t2").mapInArrow(_verifier(least, shingle), "c1 long, c2 long, similarity double")

    hot = shared.where(F.col("k") > HOT).select("key", "c")
    if hot.limit(1).count():
        inner = (1 + threshold) / 2
        balls = _hot_balls(hot, verified, inner)
        # A centre stands for its ball.
        shared = materialize(shared.join(balls, "c", "left").select("key", F.coalesce("b", "c").alias("c"), F.col("b").isNotNull().alias("ball")).distinct())
        pairs = _paired(shared)
        plain = pairs.where("balls = 0").select("c1", "c2")
        # Within (1 - threshold) of a member, so within that and a ball's radius of its centre.
        spread_ = [likely(pairs.where(F.col("balls") == n).select("c1", "c2"), max(0.0, threshold - n * (1 - inner))) for n in (1, 2)]
        own = [balls.select(F.col("b").alias(f"c{i}"), F.col("c").alias(f"m{i}")) for i in (1, 2)]
        wide = spread_[0].unionByName(spread_[1]).join(own[0], "c1", "left").join(own[1], "c2", "left").select(F.coalesce("m1", "c1").alias("x"), F.coalesce("m2", "c2").alias("y"))
        pairs = materialize(plain.unionByName(wide.select(F.least("x", "y").alias("c1"), F.greatest("x", "y").alias("c2"))).distinct())
    else:
        balls = df.sparkSession.createDataFrame([], "c long, b long")
        pairs = materialize(_paired(shared.select("key", "c", F.lit(False).alias("ball"))).select("c1", "c2"))
    links = materialize(verified(likely(pairs, threshold), threshold))
    return links, balls, sketches.select("name", "c").distinct()


def _paired(shared: DataFrame) -> DataFrame:
    """``c1 < c2, balls`` of the classes in one bucket, and how many of the two stand for a ball."""
    one, two = (shared.select("key", F.col("c").alias(f"c{i}"), F.col("ball").cast("int").alias(f"n{i}")) for i in (1, 2))
    return one.join(two, "key").where("c1 < c2").select("c1", "c2", (F.col("n1") + F.col("n2")).alias("balls")).distinct()


def class_edges(links: DataFrame, balls: DataFrame) -> DataFrame:
    """``a, b``: edges that connect what links and balls connect, one for each member of a ball."""
    return links.select(F.col("c1").alias("a"), F.col("c2").alias("b")).unionByName(balls.where("c <> b").select(F.col("c").alias("a"), "b"))


def name_pairs(links: DataFrame, balls: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of different names that a link, a ball or a class of equal texts joins: ``id_a < id_b``."""
    a, b = (members.select(F.col("name").alias(f"n{i}"), F.col("c").alias(f"c{i}")) for i in (1, 2))
    x, y = (balls.select("b", F.col("c").alias(f"c{i}")) for i in (1, 2))
    every = links.select("c1", "c2").unionByName(x.join(y, "b").where("c1 < c2").select("c1", "c2"))
    across = every.join(a, "c1").join(b, "c2")
    within = a.join(b, F.col("c1") == F.col("c2"))
    both = across.select("n1", "n2").unionByName(within.where("n1 < n2").select("n1", "n2")).where("n1 <> n2")
    return both.select(F.least("n1", "n2").alias("id_a"), F.greatest("n1", "n2").alias("id_b")).distinct()


def link_counts(links: DataFrame, balls: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each class: ``c``, its ``copies``, and the ``links`` each member has to other names."""
    size = members.groupBy("c").agg(F.count("*").alias("copies"))
    ends = links.select(F.explode(F.array(F.struct("c1", "c2"), F.struct(F.col("c2").alias("c1"), F.col("c1").alias("c2")))).alias("x")).select(F.col("x.c1").alias("c"), F.col("x.c2").alias("other"))
    reached = ends.join(size.select(F.col("c").alias("other"), F.col("copies").alias("k")), "other").groupBy("c").agg(F.sum("k").alias("reached"))
    full = balls.join(size, "c").groupBy("b").agg(F.sum("copies").alias("ball"))
    of = size.join(reached, "c", "left").join(balls.join(full, "b").select("c", "ball"), "c", "left")
    return of.select("c", "copies", (F.coalesce("ball", "copies") - 1 + F.coalesce("reached", F.lit(0))).alias("links"))
