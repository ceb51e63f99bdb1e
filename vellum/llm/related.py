"""Splits that keep related records together: a spanning forest by Borůvka's contraction, dealt by size band.

Each round every component takes its least edge and joins what lies beyond it; pointers are shortened by doubling, the
edges taken are written as a table of the forest, and the rest is renamed to the new components. A round at least halves
the components that have an edge, so there are few. Once no more than ``LOCAL`` edges are left, one task contracts them,
to the same forest. All tables are written in the shared folder between steps; nothing is gathered in the driver but row
counts.

Null keys tie nothing. An empty table gives an empty forest. Repeated ties count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.shared import materialize, ship

#: Edges that one task contracts: 8 MB.
LOCAL = 200_000
#: Components in bands of 1 / LARGE of all rows or more are dealt first: there are LARGE at most. A lane of the other bands
#: has about LANE components.
LARGE, LANE = 1000, 10_000
#: The pattern by which components are dealt has this many places.
PATTERN = 500


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rest of the contraction of at most ``LOCAL`` edges: ``a, b`` of each edge taken, and ``u, root`` of each component."""
    edges = sorted(e for x in batches for e in zip(*(x.column(i).to_pylist() for i in (4, 2, 3, 0, 1)), strict=True))
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    taken = []
    for _, a, b, u, v in edges:  # in order of weight each joins two components or none, which gives the rounds' own forest
        x, y = top(u), top(v)
        if x != y:
            parent[max(x, y)] = min(x, y)
            taken.append((a, b))
    ends = [(u, top(u)) for u in list(parent)]
    at = pa.array([a for a, _ in taken] + [None] * len(ends), pa.int64()), pa.array([b for _, b in taken] + [None] * len(ends), pa.int64())
    of = pa.array([None] * len(taken) + [u for u, _ in ends], pa.int64()), pa.array([None] * len(taken) + [r for _, r in ends], pa.int64())
    yield pa.RecordBatch.from_arrays([*at, *of], ["a", "b", "u", "root"])


def forest(edges: DataFrame, local: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """``node, root`` of all nodes of ``edges(a, b)`` (longs), and the forest's edges ``a, b, round``.

    Weights are distinct (a hash of the ends, then the ends), so there is one minimum forest, whoever contracts it.
    """
    weight = F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().select("a", "b", F.col("a").alias("u"), F.col("b").alias("v"), weight.alias("w")))
    labels = None  # until the first round each node is its own component
    kept: list[DataFrame] = []
    turn = 0
    while (n := left.count()) > local:
        turn += 1
        ends = left.select(F.explode(F.array(F.struct("u", "v", "w", "a", "b"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "w", "a", "b"))).alias("x")).select("x.*")
        least = materialize(ends.groupBy("u").agg(F.min(F.struct("w", "a", "b", "v")).alias("x")).select("u", "x.v", "x.a", "x.b"))
        kept.append(least.select("a", "b").distinct().select("a", "b", F.lit(turn).alias("round")))
        # Two components that take the same edge point at each other: the lower one becomes the root.
        back = least.select(F.col("u").alias("v"), F.col("v").alias("again"))
        point = materialize(least.select("u", "v").join(back, "v").select("u", F.when((F.col("again") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("p")))
        while True:
            ahead = point.select(F.col("u").alias("p"), F.col("p").alias("q"))
            twice = point.join(ahead, "p").select("u", "q")
            further = twice.select(F.col("u").alias("q"), F.col("q").alias("r"))
            point = materialize(twice.join(further, "q").select("u", F.col("r").alias("p"), (F.col("r") != F.col("q")).alias("moved")))
            if not point.where("moved").limit(1).count():
                break
        at = point.select("u", "p")
        if labels is None:
            labels = at.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            labels = materialize(labels.join(at.select(F.col("u").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        left = materialize(left.join(at.withColumnRenamed("p", "pu"), "u").join(at.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v").where("pu <> pv").select("a", "b", F.col("pu").alias("u"), F.col("pv").alias("v"), "w"))
    if n or labels is None:
        ship(left.sparkSession)
        rest = materialize(left.select("u", "v", "a", "b", "w").coalesce(1).mapInArrow(_contract, "a long, b long, u long, root long"))
        kept.append(rest.where("a is not null").select("a", "b", F.lit(turn + 1).alias("round")))
        at = rest.where("u is not null").select("u", F.col("root").alias("p"))
        if labels is None:
            labels = at.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            labels = materialize(labels.join(at.select(F.col("u").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")))
    return labels, materialize(reduce(DataFrame.unionByName, kept))


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"(?i)\.(txt|text|md|html?)$", "")


def author(name: Column) -> Column:
    """``struct(last, first)`` that a file name gives, in lower case; null if it names nobody.

    Writings: ``first_last__title``, ``LAST_FIRST__TITLE``, ``title_by_first-last``, ``First Last - Title``,
    ``Last, First - Title``. A first name may be an initial.
    """
    stem = _stem(name)
    by = F.regexp_extract(stem, r"(?i)^.+_by_([^_]+)$", 1)
    under = F.regexp_extract(stem, r"^([^_ ]+(?:_[^_ ]+)+)__", 1)
    dash = F.regexp_extract(stem, r"^(.+?) +[-–—] +\S", 1)
    parts = lambda text, at: F.filter(F.split(text, at), lambda x: x != "")
    first_last = lambda p: F.when(F.size(p) >= 2, F.struct(F.try_element_at(p, F.lit(-1)).alias("last"), F.get(p, 0).alias("first")))
    last_first = lambda p: F.when(F.size(p) >= 2, F.struct(F.get(p, 0).alias("last"), F.get(p, 1).alias("first")))
    shouted = (F.upper(stem) == stem) & (F.lower(stem) != stem)
    found = (
        F.when(by != "", first_last(parts(by, "[- ]+")))
        .when((under != "") & shouted, last_first(parts(under, "_")))
        .when(under != "", first_last(parts(under, "_")))
        .when(dash.contains(","), last_first(parts(dash, " *, *")))
        .when(dash != "", first_last(parts(dash, " +")))
    )
    clean = lambda x: F.regexp_replace(F.lower(x), r"[\s.,]+", "")
    return F.when(found.isNotNull(), F.struct(clean(found["last"]).alias("last"), clean(found["first"]).alias("first")))


def base_excerpt(pair_id: Column) -> Column:
    """The 12 hex digits that a pair id names its excerpt by, however it is written; else the id up to its last ``_`` or ``-``."""
    low = F.lower(F.trim(pair_id))
    hexed = F.regexp_extract(low, r"(?:^|[^0-9a-f])([0-9a-f]{12})(?:[^0-9a-f]|$)", 1)
    return F.when(hexed != "", hexed).otherwise(F.regexp_replace(low, r"[_-][^_-]*$", ""))


def _node(kind: str, *cols: Column) -> Column:
    return F.xxhash64(F.lit(kind), *cols)


def ties(excerpts: DataFrame, pairs: DataFrame, source: str = "source", excerpt: str = "id", pair: str = "id") -> tuple[DataFrame, DataFrame]:
    """``a, b`` ties of sources and pair ids to the excerpts and authors they share, and ``kind, key, node`` of both."""
    seen = excerpts.select(F.col(source).cast("string").alias("source"), F.col(excerpt).cast("string").alias("id")).where("source is not null")
    node = _node("source", F.col("source"))
    shared = seen.where("id is not null").groupBy("id").agg(F.min("source").alias("lo"), F.max("source").alias("hi")).where("lo <> hi").select("id")
    by_id = seen.join(shared, "id").distinct().select(node.alias("a"), _node("excerpt", F.col("id")).alias("b"))
    sources = materialize(seen.select("source").distinct().select("source", node.alias("node"), author(F.col("source")).alias("x")).select("source", "node", "x.last", "x.first"))
    named = sources.where("last <> '' and first <> ''")
    initial = named.select("node", "last", F.substring("first", 1, 1).alias("i"), (F.length("first") == 1).alias("short"))
    full = named.where(F.length("first") > 1).select(F.col("node").alias("a"), _node("author", F.col("last"), F.col("first")).alias("b"))
    # A full name is tied to an initial only where some source gives just the initial.
    shortened = initial.where("short").select("last", "i").distinct()
    fits = initial.join(shortened, ["last", "i"]).select(F.col("node").alias("a"), _node("initial", F.col("last"), F.col("i")).alias("b"))
    ids = pairs.select(F.col(pair).cast("string").alias("key")).where("key is not null").distinct()
    pair_node = _node("pair", F.col("key"))
    by_base = ids.select(pair_node.alias("a"), _node("base", base_excerpt(F.col("key"))).alias("b"))
    keys = sources.select(F.lit("source").alias("kind"), F.col("source").alias("key"), "node").unionByName(ids.select(F.lit("pair").alias("kind"), "key", pair_node.alias("node")))
    return by_id.unionByName(full).unionByName(fits).unionByName(by_base), keys


def across(excerpts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b`` ties of sources to the bases of the pairs that were made of their excerpts."""
    bases = pairs.select(base_excerpt(F.col("id").cast("string")).alias("id")).where("id is not null").distinct()
    seen = excerpts.select(F.col("source").cast("string").alias("source"), F.lower(F.col("id").cast("string")).alias("id")).where("source is not null").distinct()
    return seen.join(bases, "id").select(_node("source", F.col("source")).alias("a"), _node("base", F.col("id")).alias("b"))


def unsourced(excerpts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Excerpts in rows without a source: their ties to the sources that other rows give them and to their pairs, and their keys."""
    of = excerpts.select(F.col("source").cast("string").alias("source"), F.col("id").cast("string").alias("id")).where("id is not null")
    loose = of.where("source is null").select("id").distinct()
    node = _node("excerpt", F.col("id"))
    given = of.where("source is not null").join(loose, "id", "left_semi").distinct().select(_node("source", F.col("source")).alias("a"), node.alias("b"))
    paired = loose.select(node.alias("a"), _node("base", F.lower("id")).alias("b"))
    return given.unionByName(paired), loose.select(F.lit("excerpt").alias("kind"), F.col("id").alias("key"), node.alias("node"))


def related(excerpts: DataFrame, pairs: DataFrame, together: bool = False) -> DataFrame:
    """``kind, key, root``: each source and each pair id with its component; a key without ties is its own.

    With ``together`` a pair also belongs with the sources of its excerpt, and an excerpt that rows without a source hold
    is a key of its own kind.
    """
    edges, keys = ties(excerpts, pairs)
    if together:
        more, loose = unsourced(excerpts)
        edges, keys = edges.unionByName(across(excerpts, pairs)).unionByName(more), keys.unionByName(loose)
    labels, _ = forest(edges)
    return keys.join(labels, "node", "left").select("kind", "key", F.coalesce("root", "node").alias("root"))


def related_pairs(roots: DataFrame) -> DataFrame:
    """Every two keys of one kind and component: ``kind, key_a < key_b``."""
    a, b = (roots.select("kind", "root", F.col("key").alias(k)) for k in ("key_a", "key_b"))
    return a.join(b, ["kind", "root"]).where("key_a < key_b").select("kind", "key_a", "key_b")


def pattern(shares: dict[str, float], places: int = PATTERN) -> list[str]:
    """Splits in the order they are dealt in: each place goes to the one that lags its share most."""
    total = sum(shares.values())
    given = dict.fromkeys(shares, 0)
    out = []
    for n in range(1, places + 1):
        out.append(k := max(shares, key=lambda k: shares[k] / total * n - given[k]))
        given[k] += 1
    return out


def _dealt(sizes: DataFrame, shares: dict[str, float], lanes: dict[int, int], seed: int) -> DataFrame:
    """``sizes`` with ``split``: each band's components in hash order, in as many lanes as the band has (one, if it isn't named)."""
    width = F.coalesce(F.create_map(*(F.lit(x) for kv in lanes.items() for x in kv))[F.col("band")], F.lit(1)) if lanes else F.lit(1)
    rows = sizes.withColumn("o", F.xxhash64("root", F.lit(seed))).withColumn("lane", F.pmod("o", width))
    w = Window.partitionBy("band", "lane").orderBy("o", "root")
    start = F.pmod(F.xxhash64("lane", "band"), F.lit(PATTERN)) if lanes else F.lit(0)
    at = F.pmod(F.row_number().over(w) - 1 + start, F.lit(PATTERN)).cast("int")
    return rows.select("root", "n", F.element_at(F.array(*map(F.lit, pattern(shares))), at + 1).alias("split"))


def deal(sizes: DataFrame, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """``root, split`` for components ``root, n``: within a band of sizes (powers of two), they are dealt in hash order.

    Large components, ``LARGE`` at most, are dealt first, from the largest on, each to the split that lacks most rows; so one
    that holds a large part of all rows goes to the largest share. The others are then dealt by what the shares still lack. Their bands are cut in lanes, so
    that no task sorts a whole band, and each lane starts elsewhere in the pattern.
    """
    rows = materialize(sizes.select("root", "n", F.floor(F.log2("n")).cast("int").alias("band")))
    bands = {r.band: r for r in rows.groupBy("band").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()}  # 63 at most
    total = sum(r.n for r in bands.values())
    is_large = F.pow(F.lit(2.0), "band") >= total / LARGE
    lacking = {k: v / sum(shares.values()) * total for k, v in shares.items()}
    each = []
    for r in sorted(rows.where(is_large).collect(), key=lambda r: (-r.n, r.root)):  # LARGE at most
        each.append((r.root, k := max(lacking, key=lambda k: lacking[k])))
        lacking[k] -= r.n
    large = sizes.sparkSession.createDataFrame(each, "root long, split string")
    lacking = {k: max(0.0, v) for k, v in lacking.items()}
    lanes = {b: -(-r.k // LANE) for b, r in bands.items() if 2.0**b < total / LARGE}
    small = _dealt(rows.where(~is_large), lacking if sum(lacking.values()) else shares, lanes, seed)
    return large.unionByName(small.select("root", "split"))


def related_splits(excerpts: DataFrame, pairs: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """``kind, key, split``: each source and pair id with the split of its component, sizes counted in rows.

    A pair goes where the source of its excerpt goes, or its text would stand in two splits. Rows without a source go by
    their excerpt's id (kind 'excerpt'). Rows without either, and pairs without an id, are tied to nothing: their null key
    gets the largest share.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    roots = materialize(related(excerpts, pairs, together=True))
    rows = excerpts.groupBy(F.col("source").cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit("source").alias("kind"), "key", "n")
    rows = rows.unionByName(pairs.groupBy(F.col("id").cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit("pair").alias("kind"), "key", "n"))
    rows = rows.unionByName(excerpts.where("source is null").groupBy(F.col("id").cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit("excerpt").alias("kind"), "key", "n"))
    sizes = roots.join(rows, ["kind", "key"]).groupBy("root").agg(F.sum("n").alias("n"))
    keyless = rows.where("key is null and kind <> 'source'").select("kind", "key", F.lit(max(shares, key=lambda k: shares[k])).alias("split"))
    return roots.join(deal(sizes, shares), "root").select("kind", "key", "split").unionByName(keyless)
