"""Long spans that stand verbatim in more than one document, by hashed runs of consecutive sentences.

A text is cut into units at sentence and clause marks and line ends; a stretch without any for more than ``UNIT``
characters is cut where the hash of the next 8 characters is least among 48 places. From each cut a run of consecutive
units of at least ``RUN`` characters is hashed, with the ``AFTER`` characters that follow it, and runs are joined over the
whole corpus. Cuts depend on the nearest characters only, so an identical passage of 300 characters has the same cuts in
both texts: the first lies within 64 characters, the run from it ends within 248, what follows it within 296, and the texts
share its hash. A shorter notice that many texts have makes no candidates unless what follows it is the same too.

Texts that share a run with at most ``HOT`` classes are compared pair by pair, exactly. A run of more classes makes no
pairs: all windows of the asked length around it are hashed (128 bits) and counted, and those that two classes have are
put together by the set of classes that has them. So the links and memberships of n texts with one common passage grow
with n; pairs of documents are made only where they are asked for, by ``doc_pairs``.

Null texts and texts under the length share nothing. Equal texts are one class that is compared once; each member
shares its whole text. Text is compared as it stands: case, spaces and line ends count. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.words import lists, mix, slices, winnow
from vellum.shared import materialize, semi, spread

UNIT, RUN, AFTER, PLACES, AHEAD = 64, 120, 48, 48, 8
#: The shortest length for which the runs promise to find every shared span.
LEAST = 300
#: Classes that a run may have for them to be compared pair by pair.
HOT = 16
_MARKS = np.array([ord(x) for x in ".!?…;:,\n\r\"”“»«—"], np.uint32)
_BETWEEN = 0x110000  # no character: it stands between two texts
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int, base: np.uint64, key: str) -> np.ndarray:
    if len(_powers.get(key, ())) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _powers[key] = np.multiply.accumulate(out)
    return _powers[key][:n]


def codes(text: str) -> np.ndarray:
    """The text's code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Rolling:
    """Hash of any slice of a sequence of code points, in constant time."""

    def __init__(self, cp: np.ndarray) -> None:
        n = len(cp)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(cp.astype(np.uint64) + np.uint64(1)) * _power(n, _P, "p"), out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = _power(len(self.total), _INVERSE, "i")
        return mix((self.total[end] - self.total[start]) * back[start] + (end - start).astype(np.uint64))


def cuts(cp: np.ndarray, roll: Rolling) -> np.ndarray:
    """Where units begin or end, among texts divided by ``_BETWEEN``."""
    mark = np.isin(cp, _MARKS)
    stop = cp == _BETWEEN
    edge = np.zeros(len(cp) + 1, bool)
    edge[1:-1] = mark[:-1] & ~mark[1:]
    edge[:-1] |= stop
    edge[1:] |= stop
    edge[0] = edge[-1] = True
    at = np.flatnonzero(edge)
    more = []
    for i in np.flatnonzero(np.diff(at) > UNIT):
        a = np.arange(at[i], at[i + 1] - AHEAD + 1)
        more.append(a[winnow(roll(a, a + AHEAD), PLACES)])
    return np.unique(np.concatenate([at, *more])) if more else at


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each run's text number, hash, and bounds among the texts, which one character divides."""
    between = np.array([_BETWEEN], np.uint32)
    parts = [x for t in texts for x in (codes(t), between)]
    cp = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    if not len(cp):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    roll = Rolling(cp)
    at = cuts(cp, roll)
    owner = np.cumsum(cp == _BETWEEN)
    owner = np.concatenate([[0], owner])  # texts that ended before each place
    end = np.searchsorted(at, at + RUN)
    ok = end < len(at)
    start, end = at[ok], at[end[ok]] + AFTER
    inside = end < len(cp)
    start, end = start[inside], end[inside]
    same = owner[start] == owner[end]
    start, end = start[same], end[same]
    return owner[start], roll(start, end), start, end


def _sketch(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for b in slices(whole, "text", 2_000_000):
                texts = b.column(1).to_pylist()
                keep = [i for i, t in enumerate(texts) if len(t) >= least]
                cs = [int(np.int64(np.uint64(xxhash.xxh64_intdigest(texts[i].encode("utf-8", "surrogatepass"))))) for i in keep]
                fresh = []
                for c in cs:
                    fresh.append(c not in seen)
                    seen.add(c)
                owner, key, _, _ = runs([texts[i] for i, new in zip(keep, fresh, strict=True) if new])
                count = np.bincount(owner, minlength=sum(fresh))
                bounds, k = [0], 0
                for new in fresh:
                    bounds.append(bounds[-1] + (int(count[k]) if new else 0))
                    k += new
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(keep, pa.int64())), pa.array(cs, pa.int64()), pa.array([len(texts[i]) for i in keep], pa.int64()), lists(key.view(np.int64), bounds, pa.int64(), [not x for x in fresh])],
                    ["doc", "c", "n", "keys"],
                )

    return run


def _stretches(hit: np.ndarray, least: int) -> list[int]:
    """Bounds, one after the other, of the characters that the marked windows of ``least`` characters cover."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    new = np.flatnonzero(np.diff(at, prepend=at[0] - least - 1) > least)
    return [int(x) for i, k in enumerate(new) for x in (at[k], (at[new[i + 1] - 1] if i + 1 < len(new) else at[-1]) + least)]


def windows(text: str, least: int) -> np.ndarray:
    """Hashes of all runs of ``least`` characters."""
    at = np.arange(max(0, len(text) - least + 1))
    return Rolling(codes(text))(at, at + least)


def shared_stretches(a: str, b: str, least: int, ga: np.ndarray | None = None, gb: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Bounds of the stretches of either text that lie in identical runs of at least ``least`` characters."""
    ga, gb = windows(a, least) if ga is None else ga, windows(b, least) if gb is None else gb
    ha = np.isin(ga, gb)
    if not ha.any():
        return [], []
    x, y = _stretches(ha, least), _stretches(np.isin(gb, ga), least)
    if a[x[0] : x[0] + least] not in b:  # two hashes that agree by chance
        return [], []
    return x, y


def _verifier(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "t2", 4_000_000):
                # Pairs come in order of the second: each text is hashed once for all of its pairs here.
                seen: dict[int, np.ndarray] = {}
                out = []
                for c1, c2, t1, t2 in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    for c, t in ((c1, t1), (c2, t2)):
                        if c not in seen:
                            seen[c] = windows(t, least)
                    x, y = shared_stretches(t1, t2, least, seen[c1], seen[c2])
                    if x:
                        out.append((c1, c2, x, y))
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, [pa.int64()] * 2 + [pa.list_(pa.int32())] * 2, strict=True)], ["c1", "c2", "in1", "in2"])

    return run


def _around(least: int):
    """All windows of ``least`` characters that hold a hot run: ``w, c, at``, hashed twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 1_000_000):
                cs, w1, w2, ats = [], [], [], []
                for c, t, hot in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    _, key, start, end = runs([t])
                    mine = np.isin(key.view(np.int64), np.array(hot, np.int64))
                    covered = np.zeros(len(t) - least + 2, np.int64)
                    for s, e in zip(start[mine].tolist(), end[mine].tolist(), strict=True):
                        lo, hi = max(0, e - least), min(s, len(t) - least)
                        if lo <= hi:
                            covered[lo] += 1
                            covered[hi + 1] -= 1
                    at = np.flatnonzero(np.cumsum(covered)[:-1])
                    cs.append(np.full(len(at), c, np.int64))
                    ats.append(at)
                    w1.append(Rolling(codes(t))(at, at + least).view(np.int64))
                    w2.append(np.fromiter((xxhash.xxh64_intdigest(t[i : i + least].encode("utf-8", "surrogatepass")) for i in at.tolist()), np.uint64, len(at)).view(np.int64))
                cols = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (w1, w2, cs, ats)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3].astype(np.int32), pa.int32())], ["w", "w2", "c", "at"])

    return run


def _hot_sets(shared: DataFrame, texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``w, w2, s`` of the windows around hot runs that more than one class has, with the set of classes; and where each class has them."""
    by = shared.groupBy("c").agg(F.collect_list("key").alias("hot"))  # no more than a text has runs
    around = materialize(texts.join(by, "c").select("c", "text", "hot").mapInArrow(_around(least), "w long, w2 long, c long, at int"))
    of = around.select("w", "w2", "c").distinct().groupBy("w", "w2").agg(F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"), F.min("c").alias("lo"))
    return of.where("n > 1").select("w", "w2", F.xxhash64("s", "n", "lo").alias("s")), around


def _joined(at: Column, least: int) -> Column:
    """Bounds of the stretches that windows starting at the sorted places ``at`` cover, one after the other."""
    empty = F.expr("cast(array() as array<int>)")
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) >= x), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x + least))).otherwise(F.concat(acc, F.array(x, x + least)))
    return F.aggregate(at, empty, step)


def shared_spans(df: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between classes of equal texts (``c1, c2, in1, in2``: bounds of the shared stretches), sets of classes that
    share a hot passage (``s, c, at``: bounds in each), and members (``doc, c, n``)."""
    if least < LEAST:
        raise ValueError(f"runs find every shared span from {LEAST} characters")
    rows = df.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).where("doc is not null and text is not null")
    sketches = materialize(spread(rows).mapInArrow(_sketch(least), "doc long, c long, n long, keys array<long>"))
    spans = sketches.where("keys is not null").select("c", F.explode("keys").alias("key")).repartition("key").dropDuplicates(["key", "c"])
    count = spans.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    shared = materialize(spans.join(count, "key").select("key", "c", "k"))
    rare, hot = shared.where(F.col("k") <= HOT), shared.where(F.col("k") > HOT)
    pairs = materialize(rare.select("key", F.col("c").alias("c1")).join(rare.select("key", F.col("c").alias("c2")), "key").where("c1 < c2").select("c1", "c2").distinct())
    ends = materialize(pairs.select(F.explode(F.array("c1", "c2")).alias("c")).unionByName(hot.select("c")).distinct())
    firsts = materialize(semi(sketches.select("doc", "c"), ends, "c").groupBy("c").agg(F.min("doc").alias("doc")))
    texts = semi(rows, firsts, "doc").join(firsts, "doc").select("c", "text")
    left, right = (texts.select(F.col("c").alias(f"c{i}"), F.col("text").alias(f"t{i}")) for i in (1, 2))
    links = materialize(pairs.join(left, "c1").join(right, "c2").select("c1", "c2", "t1", "t2").mapInArrow(_verifier(least), "c1 long, c2 long, in1 array<int>, in2 array<int>"))
    if hot.limit(1).count():
        of, around = _hot_sets(hot, texts, least)
        sets = materialize(around.join(of, ["w", "w2"]).groupBy("s", "c").agg(_joined(F.sort_array(F.collect_set("at")), least).alias("at")))
    else:
        sets = df.sparkSession.createDataFrame([], "s long, c long, at array<int>")
    return links, sets, sketches.select("doc", "c", "n")


def doc_pairs(links: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of documents that share a span: ``doc_id_a < doc_id_b``."""
    a, b = (members.select(F.col("doc").alias(f"d{i}"), F.col("c").alias(f"c{i}")) for i in (1, 2))
    x, y = (sets.select("s", F.col("c").alias(f"c{i}")) for i in (1, 2))
    both = links.select("c1", "c2").unionByName(x.join(y, "s").where("c1 < c2").select("c1", "c2")).distinct()
    across = both.join(a, "c1").join(b, "c2").select("d1", "d2")
    within = a.join(b, F.col("c1") == F.col("c2")).where("d1 < d2").select("d1", "d2")
    every = across.unionByName(within)
    return every.select(F.least("d1", "d2").alias("doc_id_a"), F.greatest("d1", "d2").alias("doc_id_b"))


def _sides(links: DataFrame, sets: DataFrame) -> DataFrame:
    """``c, at`` of all stretches that are shared."""
    side = lambda c, at: F.struct(F.col(c).alias("c"), F.col(at).alias("at"))
    return links.select(F.explode(F.array(side("c1", "in1"), side("c2", "in2"))).alias("x")).select("x.*").unionByName(sets.select("c", "at"))


def _merged(stretches: DataFrame) -> DataFrame:
    """Disjoint stretches ``c, lo, hi`` from ``c, at``; a start is kept once, with its furthest end."""
    each = stretches.select("c", F.explode(F.expr("transform(sequence(0, size(at) div 2 - 1), i -> struct(at[2 * i] as lo, at[2 * i + 1] as hi))")).alias("x")).groupBy("c", F.col("x.lo").alias("lo")).agg(F.max("x.hi").alias("hi"))
    w = Window.partitionBy("c").orderBy("lo")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    start = each.withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("lo")).cast("int"))
    return start.withColumn("island", F.sum("new").over(w)).groupBy("c", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def coverage(links: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """For each document of at least the length: how many of its characters are shared with another document, and with how many others.

    A document with hot passages counts those of its widest one and the documents that it is linked to besides.
    """
    cover = _merged(_sides(links, sets)).groupBy("c").agg(F.sum(F.col("hi") - F.col("lo")).alias("k"))
    size = members.groupBy("c").agg(F.count("*").alias("copies"))
    wide = sets.select("s", "c").join(size, "c").groupBy("s").agg(F.sum("copies").alias("m"))
    widest = materialize(sets.select("s", "c").join(wide, "s").groupBy("c").agg(F.max(F.struct("m", "s")).alias("x")).select("c", "x.m", "x.s"))
    ends = links.select(F.explode(F.array(F.struct("c1", "c2"), F.struct(F.col("c2").alias("c1"), F.col("c1").alias("c2")))).alias("x")).select(F.col("x.c1").alias("c"), F.col("x.c2").alias("other"))
    own = ends.join(widest.select("c", "s"), "c", "left")
    besides = own.join(sets.select("s", F.col("c").alias("other")), ["s", "other"], "left_anti")
    reached = besides.select("c", "other").join(size.select(F.col("c").alias("other"), F.col("copies").alias("m")), "other").groupBy("c").agg(F.sum("m").alias("r"))
    of = size.join(cover, "c", "left").join(reached, "c", "left").join(widest.select("c", "m"), "c", "left")
    shared = F.when(F.col("copies") > 1, F.col("n")).otherwise(F.coalesce("k", F.lit(0))).cast("long")
    others = F.coalesce(F.col("m"), F.col("copies")) - 1 + F.coalesce("r", F.lit(0))
    return members.join(of, "c").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_chars"), shared.alias("shared_chars"), others.alias("shared_with"))


_SENTENCE = re.compile(r"[^.!?…\n]*(?:[.!?…]+[”“»\"')\]]*[^\S\n]*\n?|\n|$)")


def without(text: str, at: list[int]) -> str:
    """The text without the sentences that lie wholly in the stretches ``at``."""
    out, inside = [], list(zip(at[::2], at[1::2], strict=True))
    for m in _SENTENCE.finditer(text):
        body_end = m.start() + len(m[0].rstrip())
        if not (m[0].strip() and any(lo <= m.start() and body_end <= hi for lo, hi in inside)):
            out.append(m[0])
    return "".join(out)


def deduplicated(df: DataFrame, links: DataFrame, sets: DataFrame, members: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's text without the sentences that an earlier document has in a shared span; of equal texts the first stays.

    Earlier means a lower ``doc``; a class counts as its first member.
    """
    first = members.groupBy("c").agg(F.min("doc").alias("first"))
    one, two = (first.select(F.col("c").alias(f"c{i}"), F.col("first").alias(f"f{i}")) for i in (1, 2))
    later = F.col("f1") > F.col("f2")
    paired = links.join(one, "c1").join(two, "c2").select(F.when(later, F.col("c1")).otherwise(F.col("c2")).alias("c"), F.when(later, F.col("in1")).otherwise(F.col("in2")).alias("at"))
    placed = sets.join(first, "c")
    before = placed.groupBy("s").agg(F.min("first").alias("least"))
    drop = _merged(paired.unionByName(placed.join(before, "s").where("first > least").select("c", "at")))
    at = drop.groupBy("c").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("lo", "hi"))), lambda x: F.array(x["lo"], x["hi"]))).alias("at"))
    of = members.join(first, "c").join(at, "c", "left").where((F.col("first") < F.col("doc")) | F.col("at").isNotNull()).select(F.col("doc"), (F.col("first") < F.col("doc")).alias("copy"), "at")
    rows = df.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).where("doc is not null")

    @F.pandas_udf("string")
    def cut(t, a):
        return t.combine(a, lambda x, y: without(x, list(y)))

    kept = F.when(F.col("copy"), F.lit("")).when(F.col("at").isNotNull(), cut(F.coalesce("text", F.lit("")), F.coalesce("at", F.expr("cast(array() as array<int>)")))).otherwise(F.col("text"))
    return rows.join(of, "doc", "left").select(F.col("doc").alias("doc_id"), kept.alias("text"))
