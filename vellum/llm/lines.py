"""Lines that stand in many texts of one site or source, found as clusters of near-equal lines.

A line's form is the line trimmed, with inner white space collapsed, in lower case, and with each run of digits as one
mark. Its skeleton is the set of its words and marks with numbers, dates and names masked: a name is a run of words with a
capital letter after the line's first word, so a line all in capitals is its first word, its marks and one name. Two forms
of one group are tied if a skeleton of the one and a skeleton of the other have a Jaccard similarity of ``SIMILAR`` or
more; ties unite to clusters. No tie is left to chance: in a group of up to ``BUCKET`` skeletons each is compared with each of
a fitting size, and a larger group is divided first by the rarest word that two skeletons have in common, then by the next
one (of n words any ceil(0.8 n) common ones show within the n - ceil(0.8 n) + 1 rarest). What is compared are the sums of
128-bit marks of the words, which differ in no more bits than the skeletons do in words; what passes is compared exactly,
unless both are in one cluster already. A cluster that stands in at least ``share`` of its group's rows and in at least
``least`` rows is repeated. ``exact`` lines are those of a repeated cluster whose own form stands in so many rows.

All rows with a group count for its size, rows with null text too; rows without a group are left out, as are blank
lines. A line that one row repeats counts once, and so do similar lines of one row. A line of names, numbers and an
article alone has no skeleton: only its form counts. Counts are summed before the shuffle, and a hot line's rows are met
by a broadcast of the (few) forms of the clusters that may be repeated, or by a salted join where there are more than
``bounded`` allows. An empty table gives no lines.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.near import _family
from vellum.llm.related import forest
from vellum.llm.words import lists, mix, slices
from vellum.shared import BROADCAST_ROWS, anti, bounded, materialize, semi, ship, spread

SHARE, LEAST = 0.10, 4
#: Shape of ``bands``, which the clusters don't need: they have every tie.
BANDS, ROWS = 4, 4
#: Share of two skeletons' entries that they must have in common.
SIMILAR = 0.8
SALT = 16
#: Rows of a bucket whose skeletons are compared each with each; a larger one is divided, up to ``DEPTH`` times.
BUCKET, DEPTH = 8192, 3
#: Skeletons that are compared with others in one step, and the others.
BLOCK, WINDOW = 64, 8192
#: Counts by which a word is rare or not: 1 MB.
COUNTS = 1 << 17
#: Forms that a worker remembers, so that their keys are written once a task.
MEMO = 1_000_000
_DIGITS = re.compile(r"[0-9]+")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s.,;:!?'’‘\"“”„()\[\]-]+")
_MONTHS = set("january february march april may june july august september october november december januar februar märz mai juni juli oktober dezember janvier février mars avril mai juin juillet août septembre octobre novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre monday tuesday wednesday thursday friday saturday sunday".split())
_ARTICLES = {xxhash.xxh32_intdigest(w) for w in "the a an der die das ein eine le la les l un une el los las una".split()}
_XOR, _MUL = _family(BANDS * ROWS)
_NUMBER, _DATE, _NAME = 0x1111, 0x2222, 0x3333
_MASKS = {_NUMBER, _DATE, _NAME}
_NONE = np.empty(0, np.uint32)


def normal(line: str) -> str:
    """The form by which lines are equal."""
    return _DIGITS.sub("0", " ".join(line.split()).lower())


class _Masked(dict):
    """32-bit hash of a word; numbers, months and words with a capital letter have one each."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        low = word.lower()
        self[word] = h = _NUMBER if word[0].isdigit() else _DATE if low in _MONTHS else _NAME if word[0].isupper() else xxhash.xxh32_intdigest(low)
        return h


_masked = _Masked()


def skeleton(line: str) -> np.ndarray:
    """Sorted hashes of a line's words and marks, masked; none if no word but names, numbers and an article is in it."""
    found = _TOKEN.findall(line)
    first = next((i for i, t in enumerate(found) if t[0].isalnum()), -1)
    if first >= 0:
        found[first] = found[first].lower() or found[first]  # the first word's capital names nobody
    out = set(map(_masked.__getitem__, found))
    if not any(_masked[t] not in _MASKS and _masked[t] not in _ARTICLES for t in found if t[0].isalnum()):
        return _NONE
    return np.array(sorted(out), np.uint32)


def bands(skeletons: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS`` keys for each skeleton; none of them may be empty."""
    keys = np.empty((len(skeletons), BANDS), np.uint64)
    if skeletons:
        x = mix(np.concatenate(skeletons).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        x = x.astype(np.uint32)
        at = np.cumsum([0, *map(len, skeletons[:-1])])
        for b in range(BANDS):
            # Sizes fall in classes of a factor of two that begin elsewhere in each band.
            key = np.floor(np.log2(np.fromiter(map(len, skeletons), np.float64, len(skeletons))) + b / BANDS).astype(np.uint64) * np.uint64(BANDS) + np.uint64(b)
            for r in range(b * ROWS, (b + 1) * ROWS):
                key = mix(key + np.minimum.reduceat((x ^ _XOR[r]) * _MUL[r], at).astype(np.uint64))
            keys[:, b] = key
    return keys.view(np.int64)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[str, int, int]] = set()
    for whole in batches:
        for b in slices(whole, "text", 4_000_000):
            row, pos, form, first, skeletons, fresh = [], [], [], [], [], []
            groups = b.column(1).to_pylist()
            for i, t in enumerate(b.column(3).to_pylist()):
                own: set[int] = set()
                written: set[str] = set()
                for j, x in enumerate(t.split("\n")):
                    if not x or x.isspace():
                        continue
                    row.append(i)
                    pos.append(j)
                    form.append(f := xxhash.xxh64_intdigest(normal(x).encode("utf-8", "surrogatepass")) - 2**63)
                    first.append(f not in own)  # whether a line is the first of its form in its row
                    own.add(f)
                    # Lines of one form may have several skeletons, if their capitals differ.
                    skeletons.append(s := _NONE if x in written else skeleton(x))
                    written.add(x)
                    k = (groups[i], f, xxhash.xxh64_intdigest(s.tobytes()))
                    fresh.append(len(s) > 0 and k not in seen)
                    if fresh[-1]:
                        if len(seen) >= MEMO:
                            seen.clear()
                        seen.add(k)
            at = pa.array(row, pa.int64())
            size = np.array(list(map(len, skeletons)), np.int64)
            new = np.array(fresh, bool)
            once = [s for s, x in zip(skeletons, fresh, strict=True) if x]
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(k).take(at) for k in range(3)),
                    *(pa.array(pos, pa.int64()), pa.array(first, pa.bool_()), pa.array(form, pa.int64())),
                    lists((np.concatenate(once) if once else _NONE).view(np.int32), np.concatenate([[0], np.cumsum(size * new)]), pa.int32(), (~new).tolist()),
                ],
                ["part", "grp", "rec", "pos", "first", "form", "skeleton"],
            )


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _marks(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of 128 bits for each skeleton: each word turns one bit, so that rows differ in no more bits than skeletons in words."""
    x = mix(words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bit, high = np.uint64(1) << (x & np.uint64(63)), (x & np.uint64(64)) > 0
    return np.stack([np.bitwise_xor.reduceat(np.where(high, np.uint64(0), bit), at), np.bitwise_xor.reduceat(np.where(high, bit, np.uint64(0)), at)], axis=1)


def united(sizes: np.ndarray, at: np.ndarray, words: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """The cluster of each skeleton, as a number: those of a similarity of ``similar`` or more are in one, directly or through others.

    Skeletons are distinct, sorted by size, each from its place ``at`` in ``words``.
    """
    n = len(sizes)
    root = np.arange(n)
    marks = _marks(words, at)
    ends = np.searchsorted(sizes, sizes / similar + 1e-9, "right")  # a larger one can't be similar
    # What two similar ones may differ in, as the sum of a part of each size; a little more lets no rounding lose a pair.
    most = ((1 - similar) / (1 + similar) * sizes + 0.005).astype(np.float32)
    for i in range(0, n, BLOCK):
        own = slice(i, min(i + BLOCK, n))
        far = np.arange(i, ends[own.stop - 1])
        if (root[own] == root[i]).all():
            far = far[root[far] != root[i]]
        for j in range(0, len(far), WINDOW):
            to = far[j : j + WINDOW]
            bits = np.bitwise_count(marks[own, None, 0] ^ marks[None, to, 0]) + np.bitwise_count(marks[own, None, 1] ^ marks[None, to, 1])
            a, b = np.nonzero((bits - most[None, to] <= most[own, None]) & (root[own, None] != root[None, to]))
            for x, mates in zip(np.unique(a) + i, np.split(to[b], np.nonzero(np.diff(a))[0] + 1)):
                others = mates[root[mates] != root[x]]
                if not len(others):
                    continue
                mine, lengths = words[at[x] : at[x] + sizes[x]], sizes[others]
                begin = _starts(lengths)
                theirs = words[np.repeat(at[others] - begin[:-1], lengths) + np.arange(begin[-1])]
                both = np.add.reduceat(np.isin(theirs, mine).astype(np.int64), begin[:-1])
                near = root[others[both >= similar * (sizes[x] + lengths - both) - 1e-9]]
                if len(near):
                    root[np.isin(root, near)] = root[x]
    return root


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b``: a form of each bucket's clusters with another one; rows come sorted by bucket."""
    key, nodes, found = None, [], []

    def edges() -> tuple[np.ndarray, np.ndarray]:
        number: dict[bytes, int] = {}
        of = np.array([number.setdefault(s, len(number)) for s in found], np.int64)
        if len(number) == 1:
            root = np.zeros(1, np.int64)
        else:
            order = sorted(number, key=len)
            sizes = np.array(list(map(len, order)), np.int64) // 4
            place = np.empty(len(order), np.int64)
            place[[number[s] for s in order]] = np.arange(len(order))
            of, root = place[of], united(sizes, _starts(sizes)[:-1], np.frombuffer(b"".join(order), np.uint32))
        node, cluster = np.array(nodes, np.int64), root[of]
        _, first = np.unique(cluster, return_index=True)
        top = np.empty(len(root), np.int64)
        top[cluster[first]] = node[first]
        a, b = top[cluster], node
        return a[a != b], b[a != b]

    def batch(ends: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in ends]), pa.int64()) for i in range(2)], ["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        out = []
        keys, each = b.column(0).to_numpy(), b.column(1).to_numpy()
        at = b.column(2).offsets.to_numpy()
        words = b.column(2).values.to_numpy().astype(np.int32).tobytes()
        cuts = [0, *(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)]
        for i, j in zip(cuts, cuts[1:]):
            if keys[i] != key:
                if len(nodes) > 1:
                    out.append(edges())
                key, nodes, found = keys[i], [], []
            nodes.extend(each[i:j].tolist())
            found.extend(words[4 * at[k] : 4 * at[k + 1]] for k in range(i, j))
        if out:
            yield batch(out)
    if len(nodes) > 1:
        yield batch([edges()])


def _divided(counts, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row in the buckets of the next common word, of the rarest ones first; ``past`` words were passed so far, ``depth`` of them taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(counts.value, np.int64)
        for b in batches:
            row, past, taken = [], [], []
            for i, (x, p) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                w = np.array(x, np.int32).view(np.uint32)
                w = w[np.lexsort((w, often[w & np.uint32(COUNTS - 1)]))]
                stop = min(len(w), len(w) - math.ceil(SIMILAR * len(w) - 1e-9) + depth + 1)
                if p < stop:
                    row.append(np.full(stop - p, i))
                    past.append(np.arange(p + 1, stop + 1, dtype=np.int32))
                    taken.append(w[p:stop])
            if not row:
                continue
            at = np.concatenate(row)
            key = mix(mix(b.column(0).to_numpy().view(np.uint64)[at]) + np.concatenate(taken).astype(np.uint64)).view(np.int64)
            # A batch of hot rows is a few MB; its copies are cut to as much.
            whole = pa.RecordBatch.from_arrays([pa.array(key), b.column(1).take(pa.array(at)), pa.array(at), pa.array(np.concatenate(past))], ["key", "node", "at", "past"])
            for i in range(0, len(at), 8192):
                x = whole.slice(i, 8192)
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), b.column(2).take(x.column(2)), x.column(3)], ["key", "node", "skeleton", "past"])

    return run


def _clusters(lines: DataFrame) -> DataFrame:
    """``node, root`` of the forms that are tied to another one; ``lines`` have ``g, node, skeleton``."""
    ship(lines.sparkSession)
    left = lines.where("skeleton is not null").select(F.col("g").alias("key"), "node", "skeleton", F.lit(0).alias("past"))
    edges, shipped = [], None
    for depth in range(DEPTH + 1):
        full = None
        if depth < DEPTH:
            full = materialize(left.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("key"))
            full = full if full.limit(1).count() else None
        whole = anti(left, full, "key") if full else left
        edges.append(materialize(whole.select("key", "node", "skeleton").repartition("key").sortWithinPartitions("key").mapInArrow(_tied, "a long, b long")))
        if not full:
            break
        hot = semi(left, full, "key")
        if not depth:
            # Equal skeletons are one; words are counted over the skeletons that are divided.
            hot = hot.withColumn("same", F.xxhash64("key", "skeleton"))
            each = materialize(hot.groupBy("same").agg(F.min("node").alias("node"), F.first("key").alias("key"), F.first("skeleton").alias("skeleton"), F.first("past").alias("past")))
            edges.append(materialize(hot.select("same", F.col("node").alias("b")).join(each.select("same", F.col("node").alias("a")), "same").where("a <> b").select("a", "b").distinct()))
            hot = each.select("key", "node", "skeleton", "past")
            counts = np.zeros(COUNTS, np.int64)
            words = hot.select(F.explode("skeleton").alias("w")).groupBy(F.col("w").bitwiseAND(COUNTS - 1).alias("slot")).agg(F.count("*").alias("n"))
            for r in words.toLocalIterator():  # COUNTS rows at most
                counts[r.slot] = r.n
            shipped = lines.sparkSession.sparkContext.broadcast(counts.tobytes())
        left = materialize(hot.mapInArrow(_divided(shipped, depth), "key long, node long, skeleton array<int>, past int"))
    labels, _ = forest(reduce(DataFrame.unionByName, edges))
    return labels


def repeated_lines(df: DataFrame, group: str, rec: str, text: str = "text", share: float = SHARE, least: int = LEAST, part: str | None = None) -> DataFrame:
    """``part, grp, rec, pos, cluster, exact``: every line of a repeated cluster; ``exact`` if its own form is repeated, too.

    ``part`` names a column that tells tables apart whose rows are in one frame: groups and records are a table's own.
    """
    of = F.col(part).cast("string") if part else F.lit("")
    rows = df.where(F.col(group).isNotNull()).select(of.alias("part"), F.col(group).cast("string").alias("grp"), F.col(rec).cast("long").alias("rec"), F.col(text).cast("string").alias("text"))
    need = F.greatest(F.lit(float(least)), share * F.count("*") - 1e-9).alias("need")
    sizes = materialize(rows.groupBy("part", "grp").agg(need).withColumn("g", F.xxhash64("part", "grp")))
    found = spread(rows.where("text is not null and rec is not null")).mapInArrow(_lines, "part string, grp string, rec long, pos long, first boolean, form long, skeleton array<int>")
    lines = materialize(found.join(bounded(sizes), ["part", "grp"]).withColumn("node", F.xxhash64("g", "form")).drop("form"))
    forms = lines.where("first").groupBy("node").agg(F.count("*").alias("n"), F.max("need").alias("need"))
    forms = materialize(forms.join(_clusters(lines), "node", "left").select("node", "n", "need", F.coalesce("root", "node").alias("cluster")))
    # A cluster stands in no more rows than its forms do together; those that may be repeated are counted exactly.
    likely = forms.groupBy("cluster").agg(F.sum("n").alias("most"), F.max("need").alias("need")).where(F.col("most") >= F.col("need")).select("cluster")
    wanted = materialize(forms.join(likely, "cluster", "left_semi").select("node", "cluster", (F.col("n") >= F.col("need")).alias("exact")))
    if wanted.count() <= BROADCAST_ROWS:
        met = lines.join(F.broadcast(wanted), "node")
    else:
        salts = F.explode(F.array(*(F.lit(i) for i in range(SALT)))).alias("salt")
        met = lines.withColumn("salt", F.pmod("rec", F.lit(SALT)).cast("int")).join(wanted.select("*", salts), ["node", "salt"])
    met = materialize(met.select("part", "grp", "rec", "pos", "cluster", "need", "exact"))
    often = met.select("cluster", "need", "rec").distinct().groupBy("cluster").agg(F.count("*").alias("n"), F.max("need").alias("need")).where(F.col("n") >= F.col("need")).select("cluster")
    return met.join(bounded(materialize(often)), "cluster", "left_semi").select("part", "grp", "rec", "pos", "cluster", "exact")


def without_lines(df: DataFrame, found: DataFrame, rec: str, text: str = "text") -> DataFrame:
    """``rec, text``: each text of ``df`` without the lines ``found(rec, pos)``; a text without such lines stays as it is."""
    drop = found.groupBy("rec").agg(F.collect_set("pos").alias("drop"))
    lines = F.split(F.col("text"), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("drop", i.cast("long"))), "\n")
    rows = df.select(F.col(rec).cast("long").alias("rec"), F.col(text).cast("string").alias("text"))
    return rows.join(drop, "rec", "left").select("rec", F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("text"))
