"""Near-duplicates, split overlaps, leaks, shared spans and related records, against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vellum.llm import leaks, near, related, spans, splits
from vellum.llm.words import words

rng = random.Random(11)
VOCAB = [f"w{i}" for i in range(900)]
LONG = " ".join(f"word{i % 7001}" for i in range(60_000))


def story(n):
    return [rng.choice(VOCAB) for _ in range(n)]


def changed(ws, share):
    """Words with some replaced, left out, put in or moved."""
    out = []
    for w in ws:
        r = rng.random()
        out += [rng.choice(VOCAB)] if r < share / 2 else [] if r < share * 0.75 else [w, rng.choice(VOCAB)] if r < share else [w]
    if rng.random() < 0.3:
        k = len(out) // 2
        out = out[k:] + out[:k]
    return out


def write(ws):
    return " ".join(w.upper() if rng.random() < 0.1 else w for w in ws).replace(" w1", "\n— w1")


def shingles(t):
    w = words(t)
    return set(zip(w, w[1:], w[2:], strict=False))


def alike(a, b):
    return near.jaccard(shingles(a), shingles(b))


def extra(df):
    return df.withColumns({c: F.lit("x") for c in ("name", "c", "keys", "key", "sig", "text2", "side", "n", "seeds", "doc", "item", "seed", "node", "root", "a", "b", "u", "v")})


@pytest.fixture(autouse=True)
def seeded():
    rng.seed(12)


@pytest.fixture(scope="module")
def texts():
    rng.seed(11)
    bases = [story(rng.choice([5, 20, 60, 150, 300])) for _ in range(60)]
    out = [write(b) for b in bases] + [write(changed(b, rng.choice([0.01, 0.04, 0.08, 0.15]))) for b in bases for _ in range(3)]
    return [*out, out[0], out[0], "", "?!", "two words", "two words", LONG, LONG + " more"]


def test_near_duplicates_against_brute_force(spark, texts):
    rows = [(f"i{k:04d}", t) for k, t in enumerate(texts)] + [("i0003", texts[3]), (None, texts[3]), ("null", None)]
    df = extra(spark.createDataFrame(rows, "id string, text string"))
    links, balls, members = near.near_duplicates(df, threshold=0.6, shingle=3)
    got = {(r.id_a, r.id_b) for r in near.name_pairs(links, balls, members).collect()}
    want = {(f"i{i:04d}", f"i{j:04d}") for i in range(len(texts)) for j in range(i + 1, len(texts)) if alike(texts[i], texts[j]) >= 0.6}
    assert not got - want and len(want - got) <= 0.005 * len(want) and len(want) > 100
    counts = {r.c: r for r in near.link_counts(links, balls, members).collect()}
    of = defaultdict(set)
    for a, b in got:
        of[a].add(b)
        of[b].add(a)
    assert {r["name"]: counts[r.c].links for r in members.collect()} == {r["name"]: len(of[r["name"]]) for r in members.collect()}


@pytest.mark.parametrize("hot", [4, 32])
def test_near_copies_of_one_text_make_no_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(near, "HOT", hot)
    base = story(150)
    texts = [write([w if rng.random() > 0.015 else rng.choice(VOCAB) for w in base]) for _ in range(50)] + [write(changed(base, 0.12)) for _ in range(6)] + [write(story(80)) for _ in range(10)]
    rows = [(f"i{k:03d}", t) for k, t in enumerate([*texts, texts[3], texts[3]])]
    texts += [texts[3]] * 2
    links, balls, members = near.near_duplicates(spark.createDataFrame(rows, "id string, text string"), threshold=0.6, shingle=3)
    assert balls.count() >= 40 and links.count() < 12 * 50
    want = {(f"i{i:03d}", f"i{j:03d}") for i in range(len(texts)) for j in range(i + 1, len(texts)) if alike(texts[i], texts[j]) >= 0.6}
    got = {(r.id_a, r.id_b) for r in near.name_pairs(links, balls, members).collect()}
    assert got == want and len(want) > 1200
    counts = {r.c: r.links for r in near.link_counts(links, balls, members).collect()}
    assert {r["name"]: counts[r.c] for r in members.collect()} == {n: sum(n in p for p in want) for n, _ in rows}


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([], "id string, text string")
    links, balls, members = near.near_duplicates(df)
    assert links.count() == members.count() == near.name_pairs(links, balls, members).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    assert near.fewest_matches(0.8, 64) > near.fewest_matches(0.6, 64) > 20
    assert near.fewest_matches(0.6, 192) < 0.6 * 192


def test_cross_split_against_brute_force(spark, texts):
    train = [(1000 + i, t) for i, t in enumerate(texts)]
    evals = [("test", i, write(changed(words(t), rng.choice([0.02, 0.08, 0.12]))[:400])) for i, t in enumerate(texts[:150])] + [("val", 7, texts[0]), ("val", 8, "two words"), ("val", 9, ""), ("val", 10, None), (None, 11, texts[1]), ("test", 12, "?!"), ("val", 13, "???")]
    e = extra(spark.createDataFrame(evals, "split string, line long, text string"))
    t = extra(spark.createDataFrame([*train, (None, "x"), (5000, None)], "line long, text string"))
    got = Counter((r.split, r.eval_line, r.train_line) for r in splits.cross_split(e, t).collect())
    want = Counter((s, i, j) for s, i, x in evals if s and x is not None for j, y in train if x == y or alike(x, y) >= 0.6)
    assert got == want and len(want) > 60
    assert splits.cross_split(e.where("false"), t).count() == 0 == splits.cross_split(e, t.where("false")).count()


def test_repetitive_texts_and_hot_passages_lose_no_pair(spark):
    notice = [f"n{i}" for i in range(60)]
    few = [f"r{i}" for i in range(25)]
    bases = [notice + story(90) for _ in range(25)] + [[rng.choice(few) for _ in range(150)] for _ in range(25)] + [story(30) * rng.choice([2, 3]) for _ in range(20)]
    train = [(i, write(b)) for i, b in enumerate(bases)]
    evals = [("test", 1000 + i, write(changed(b, rng.choice([0.03, 0.08, 0.12])))) for i, b in enumerate(bases)]
    e, t = spark.createDataFrame(evals, "split string, line long, text string"), spark.createDataFrame(train, "line long, text string")
    want = {(i, j) for _, i, x in evals for j, y in train if alike(x, y) >= 0.6}
    assert {(r.eval_line, r.train_line) for r in splits.cross_split(e, t).collect()} == want and len(want) > 40


def test_a_short_text_meets_its_repetition(spark):
    short = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}w" for i in range(42)]
    train = [(1, " ".join(short * 2)), (2, " ".join(short * 5)), (3, " ".join(f"x{w}" for w in short * 2)), (4, " ".join(short[:20] + ["other"] * 30))]
    for evals, texts, want in (([(7, " ".join(short))], train, {(7, 1), (7, 2)}), (train, [(7, " ".join(short))], {(1, 7), (2, 7)})):
        e = spark.createDataFrame([("test", i, t) for i, t in evals], "split string, line long, text string")
        t = spark.createDataFrame(texts, "line long, text string")
        assert {(r.eval_line, r.train_line) for r in splits.cross_split(e, t).collect()} == want
        assert all(alike(x, y) >= 0.6 for i, x in evals for j, y in texts if (i, j) in want)


def test_chain():
    a = [f"a{i}" for i in range(40)]
    assert splits.chain(a, a) == (1.0, 1.0)
    half, whole = splits.chain(a, [*a[:20], *(f"b{i}" for i in range(20))])
    assert half == whole == 0.5
    assert splits.chain(a, ["x"]) == splits.chain([], a) == (0.0, 0.0)


def test_leaks_against_brute_force(spark):
    items = [(i, write(story(rng.choice([3, 12, 13, 30, 60])))) for i in range(40)] + [(90, ""), (91, None)]
    items.append((92, items[3][1]))
    docs = []
    for i in range(150):
        ws = story(rng.choice([5, 80, 200]))
        if rng.random() < 0.6:
            src = words(items[rng.randrange(40)][1])
            k = rng.randint(5, 40)
            at = rng.randrange(max(1, len(src) - k + 1))
            ws[len(ws) // 2 : len(ws) // 2] = src[at : at + k]
        docs.append((i, write(ws)))
    docs += [(900, None), (901, ""), (902, LONG), (903, docs[0][1]), (None, docs[0][1])]
    d = extra(spark.createDataFrame(docs, "doc_id long, text string"))
    it = extra(spark.createDataFrame([*items, (None, items[0][1])], "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(d, it).where(F.col("exact_words") >= 13).collect()}
    runs = lambda t: {tuple(w[i : i + 13]) for w in [words(t)] for i in range(len(w) - 12)}
    of = {i: runs(t) for i, t in items if t}
    want = {(n, i) for n, t in docs if n is not None and t for i, r in of.items() if r & runs(t)}
    assert got == want and len(want) > 20
    assert leaks.leaks(d.where("false"), it).count() == leaks.leaks(d, it.where("false")).count() == 0


def test_overlap_over_changed_words():
    item = [f"x{i}" for i in range(40)]
    doc = ["a", "b", *item[:9], "other", *item[10:19], "other", *item[20:], "c"]
    exact, length, bad = leaks.overlap(doc, item)
    assert (exact, length, bad) == (20, 40, 2)
    assert leaks.overlap(["a"], item) == (0, 0, 0)


def test_changed_words_leave_most_items_found():
    found = 0
    for _ in range(60):
        item = story(40)
        found += leaks.overlap(story(50) + [w if rng.random() > 0.1 else rng.choice(VOCAB) for w in item] + story(50), item)[1] >= 13
    assert found >= 57 and leaks.map_bits(0) == 16 and leaks.map_bits(10**9) == leaks.MOST_BITS and leaks.map_bits(100_000) == 21


def test_shared_spans_against_brute_force(spark):
    def text(n):
        out = ""
        while len(out) < n:
            ws = story(rng.choice([1, 3, 9, 30]))
            out += " ".join(ws).capitalize() + rng.choice([". ", "! ", ".\n", ", ", " ", "… "])
        return out

    docs = [text(rng.choice([50, 280, 400, 900])) for _ in range(60)]
    for i in range(80):
        a, b = rng.choice(docs[:60]), text(300)
        k = rng.choice([200, 290, 299, 300, 301, 350, 600])
        at = rng.randrange(max(1, len(a) - k + 1))
        docs.append(b[: i % 97] + a[at : at + k] + b[i % 97 :])
    docs += [docs[0], "z" * 700, "z" * 400, " " * 500, "", docs[5].upper(), docs[5].replace("\n", "\r\n"), LONG[:30_000]]
    rows = [(i, t) for i, t in enumerate(docs)] + [(900, None), (None, docs[3])]
    df = extra(spark.createDataFrame(rows, "doc_id long, text string"))
    links, sets, members = spans.shared_spans(df)
    got = {(r.doc_id_a, r.doc_id_b) for r in spans.doc_pairs(links, sets, members).collect()}
    grams = [{t[i : i + 300] for i in range(len(t) - 299)} for t in docs]
    want = {(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if grams[i] & grams[j]}
    assert got == want and len(want) > 25
    cover = {r.doc_id: r.shared_chars for r in spans.coverage(links, sets, members).collect()}
    for i, t in enumerate(docs):
        other = set().union(*(g for j, g in enumerate(grams) if j != i))
        marks = {p for s in range(len(t) - 299) if t[s : s + 300] in other for p in range(s, s + 300)}
        assert cover.get(i, 0) == len(marks)
    kept = {r.doc_id: r.text for r in spans.deduplicated(df, links, sets, members).collect()}
    assert kept[140] == "" and kept[900] is None and kept[1] == docs[1] and sum(len(x or "") for x in kept.values()) < sum(map(len, docs)) - 3000


@pytest.mark.parametrize("hot", [2, 16])
def test_a_hot_passage_makes_no_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    body = lambda n: " ".join(story(n)).capitalize() + ". "
    notice, rest = body(90), body(45)
    docs = [body(20 + i) + notice + (rest if i % 10 == 3 else "") + body(30) for i in range(30)] + [body(200), body(40) + rest + body(20)]
    docs.append(docs[2])
    assert len(notice) > 330 and len(rest) < 290
    df = spark.createDataFrame([(100 - i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    links, sets, members = spans.shared_spans(df)
    assert links.count() <= 3 and sets.count() <= 6 * 31
    grams = [{t[i : i + 300] for i in range(len(t) - 299)} for t in docs]
    got = {(r.doc_id_a, r.doc_id_b) for r in spans.doc_pairs(links, sets, members).collect()}
    assert got == {(100 - j, 100 - i) for i in range(len(docs)) for j in range(i + 1, len(docs)) if grams[i] & grams[j]}
    cover = {r.doc_id: r for r in spans.coverage(links, sets, members).collect()}
    for i, t in enumerate(docs):
        other = set().union(*(g for j, g in enumerate(grams) if j != i))
        marks = {p for s in range(len(t) - 299) if t[s : s + 300] in other for p in range(s, s + 300)}
        assert cover[100 - i].shared_chars == len(marks) and cover[100 - i].shared_with == sum(bool(grams[i] & g) for j, g in enumerate(grams) if j != i)
    kept = {r.doc_id: r.text for r in spans.deduplicated(df, links, sets, members).collect()}
    assert sum(notice[:-1] in t for t in kept.values()) == 1 and notice in kept[68]


def test_shared_spans_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    links, sets, members = spans.shared_spans(df)
    assert spans.doc_pairs(links, sets, members).count() == spans.coverage(links, sets, members).count() == spans.deduplicated(df, links, sets, members).count() == 0
    with pytest.raises(ValueError, match="300"):
        spans.shared_spans(df, least=100)


def test_forest_against_union_find(spark):
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    labels, kept = related.forest(spark.createDataFrame(edges, "a long, b long"))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    groups = defaultdict(set)
    for r in labels.collect():
        groups[r.root].add(r.node)
    want = defaultdict(set)
    for x in list(parent):
        want[find(x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert kept.count() == len(parent) - len(want)  # a tree for each component, and each edge once
    # Rounds over tables give the forest that one task gives.
    rounds, taken = related.forest(spark.createDataFrame(edges, "a long, b long"), local=0)
    assert {(r.a, r.b) for r in taken.collect()} == {(r.a, r.b) for r in kept.collect()}
    again = defaultdict(set)
    for r in rounds.collect():
        again[r.root].add(r.node)
    assert sorted(map(sorted, again.values())) == sorted(map(sorted, want.values()))
    assert related.forest(spark.createDataFrame([], "a long, b long"))[0].count() == 0


def test_authors(spark):
    names = {
        "Theo Vuvibat - Under the Brown Ladder.txt": ("vuvibat", "theo"),
        "HABADAS_IMOGEN__UNDER_THE_BYRE.TXT": ("habadas", "imogen"),
        "S. Kegahat - Foxes.txt": ("kegahat", "s"),
        "Luvokek, Nestor - A Brown Oar.txt": ("luvokek", "nestor"),
        "nerys_vobeder__rough_brooks.txt": ("vobeder", "nerys"),
        "Gidaram, T. - Under the Quilt.txt": ("gidaram", "t"),
        "the-blanket_by_maren-goduzek.txt": ("goduzek", "maren"),
        "omnibus.txt": None,
        "": None,
    }
    df = spark.createDataFrame([(k,) for k in names], "s string")
    assert {r.s: tuple(r.x) if r.x else None for r in df.select("s", related.author(F.col("s")).alias("x")).collect()} == names


def test_related_keys_and_splits(spark):
    e = extra(spark.createDataFrame([("1", "ann_lee__x.txt"), ("2", "Lee, A. - Y.txt"), ("3", "A. Lee - Z.txt"), ("4", "bo_lee__q.txt"), ("5", "omnibus.txt"), ("5", "bo_lee__q.txt"), ("6", None), (None, "solo.txt"), ("5", "omnibus.txt")], "id string, source string"))
    p = extra(spark.createDataFrame([("0123456789ab_heron",), (" 0123456789AB_HERON",), ("0123456789ab-tern7_retry2",), ("ffffffffffff_heron",), (None,), ("odd_x",), ("odd_y",)], "id string"))
    got = {(r.kind, r.key_a, r.key_b) for r in related.related_pairs(related.related(e, p)).collect()}
    pair = sorted([" 0123456789AB_HERON", "0123456789ab-tern7_retry2", "0123456789ab_heron"])
    want = {("pair", a, b) for i, a in enumerate(pair) for b in pair[i + 1 :]} | {("pair", "odd_x", "odd_y"), ("source", "bo_lee__q.txt", "omnibus.txt")}
    names = sorted(["ann_lee__x.txt", "Lee, A. - Y.txt", "A. Lee - Z.txt"])
    assert got == want | {("source", a, b) for i, a in enumerate(names) for b in names[i + 1 :]}
    rows = related.related_splits(e, p).collect()
    split = {(r.kind, r.key): r.split for r in rows}
    assert len(rows) == len(split) == 14 and len({split["source", n] for n in names}) == 1
    assert split["excerpt", "6"] and split["pair", None] == "train"
    assert related.related_splits(e.where("false"), p.where("false")).count() == 0
    roots = {(r.kind, r.key): r.root for r in related.related(e.withColumn("id", F.when(F.col("id") == "4", "0123456789ab").otherwise(F.col("id"))), p, together=True).collect()}
    assert roots["source", "bo_lee__q.txt"] == roots["pair", pair[0]] == roots["source", "omnibus.txt"] != roots["pair", "odd_x"]


def test_dealing_keeps_the_shares(spark):
    sizes = spark.range(20_000).select(F.col("id").alias("root"), F.when(F.col("id") % 50 == 0, 300).otherwise(F.col("id") % 3 + 1).alias("n"))
    got = {r.split: r.n for r in sizes.join(related.deal(sizes, {"train": 0.8, "validation": 0.1, "test": 0.1}), "root").groupBy("split").agg(F.sum("n").alias("n")).collect()}
    total = sum(got.values())
    assert {k: round(v / total, 2) for k, v in got.items()} == {"train": 0.8, "validation": 0.1, "test": 0.1}
    assert Counter(related.pattern({"a": 0.5, "b": 0.5}, 100)) == {"a": 50, "b": 50}
    hot = sizes.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("root"), F.lit(total // 3).cast("long").alias("n")))
    rows = hot.join(related.deal(hot, {"train": 0.8, "validation": 0.1, "test": 0.1}), "root")
    share = {r.split: round(r.n / (total * 4 / 3), 2) for r in rows.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    assert share == {"train": 0.8, "validation": 0.1, "test": 0.1} and rows.where("root = -1").first().split == "train"
