"""Repeated lines, pieces, truncation, defects and tokens, against plain Python."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import defects, lines, pieces, tokens, truncation
from vellum.shared import materialize

LONG = "A clerk walked from the mill to the weir, and nobody sold the boat. " * 9000


def awkward(spark, **more):
    """Rows with nulls, empty and very long texts, repeated rows and columns with names the operators use themselves."""
    rows = [(1, "a", None), (2, "a", ""), (3, "a", LONG), (4, None, "Some text."), (5, "a", "x" * 5000), (6, "b", " \t\n​"), (6, "b", "Twice."), (6, "b", "Twice."), (None, "b", "No key.")]
    df = spark.createDataFrame(rows, "line_no long, src string, text string")
    return df.withColumns({c: F.lit("x") for c in ("c", "key", "grp", "rec", "pos", "name", "doc", "h", "n", "sig", "ending", "chars", "exact", "piece")} | more)


# Repeated lines


def test_lines_against_counting(spark):
    rng = random.Random(3)
    pool = ["Page 1 of 20", "PAGE 7  of 3", "all rights reserved", "All Rights Reserved", "*** END OF A FOX ***", "", "  "] + [f"line {c}" for c in "abcdefghij"]
    rows = [(i, rng.choice(["s", "t", "t", None]), None if i % 17 == 0 else "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    df = spark.createDataFrame(rows, "rec long, grp string, text string")
    got = {(r.rec, r.pos) for r in lines.repeated_lines(df, "grp", "rec").where("exact").collect()}
    size, seen, at = Counter(g for _, g, _ in rows), defaultdict(set), defaultdict(list)
    for rec, g, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            if g and (n := lines.normal(x)):
                seen[g, n].add(rec)
                at[g, n].append((rec, i))
    want = {o for k, v in seen.items() if len(v) >= 4 and 10 * len(v) >= size[k[0]] for o in at[k]}
    assert got == want and want


def test_lines_salted_join_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, "s", f"By Ann Lee, {i}\nown {i * 31 % 17} words here {i}") for i in range(40)], "rec long, grp string, text string")
    key = lambda rows: sorted((r.rec, r.pos, r.exact) for r in rows.collect())
    first = key(lines.repeated_lines(df, "grp", "rec"))
    monkeypatch.setattr(lines, "BROADCAST_ROWS", -1)
    assert key(lines.repeated_lines(df, "grp", "rec")) == first and len(first) >= 40


def test_skeletons_mask_names_numbers_and_dates():
    same = lambda *xs: len({lines.skeleton(x).tobytes() for x in xs}) == 1
    assert same("This edition was printed for Ann Lee in May 1897", "This edition was printed for Bo van Day in June 1911") is False
    assert same("This edition was printed for Ann Lee in May 1897", "This edition was printed for Bo Day in June 1911")
    assert same("*** START OF THE BROWN FOX ***", "*** START OF UNDER THE MILL ***") and not same("*** START OF A FOX ***", "*** END OF A FOX ***")
    assert not len(lines.skeleton("THE BROWN FOX")) and not len(lines.skeleton("12 — 1911")) and len(lines.skeleton("By Ann Lee"))
    keys = lines.bands([lines.skeleton(x) for x in ("This edition was printed for Ann Lee in 1897", "This edition was printed for Bo Day in 1911", "the boat lay by the weir all winter long")])
    assert (keys[0] == keys[1]).all() and not (keys[0] == keys[2]).any() and lines.bands([]).shape == (0, lines.BANDS)


def near_lines(rows=80):
    """Rows of own prose, a third of which have a notice with small changes, a byline and a marker; what is planted, by place."""
    rng, planted, out = random.Random(9), set(), []
    vocabulary = [f"{a}{b}" for a in "bdfglmprstvk" for b in ("amble", "orrin", "usty", "ellow", "istle", "aven", "eeder", "onic")]
    prose = lambda: " ".join(rng.choice(vocabulary) for _ in range(12)) + "."
    notice = "please keep this copy of the text with the readers of the river library and tell them about each misprint you find".split()
    for i in range(rows):
        ls = [prose() for _ in range(6)]
        if i % 3 == 0:
            n = list(notice)
            n[rng.randrange(len(n))] = rng.choice(vocabulary)
            for x in (" ".join(n), f"By {rng.choice(vocabulary).title()} {rng.choice(vocabulary).title()}", f"*** END OF {' '.join(rng.sample(vocabulary, 3)).upper()} ***"):
                at = rng.randrange(len(ls) + 1)
                ls.insert(at, x)
        planted |= {(i, j) for j, x in enumerate(ls) if x.startswith(("By ", "***")) or "library" in x or "misprint" in x}
        out.append((i, "s", "\n".join(ls)))
    return out, planted


def test_near_lines_are_found_by_their_cluster(spark):
    rows, planted = near_lines()
    df = spark.createDataFrame(rows, "rec long, grp string, text string")
    found = {(r.rec, r.pos): r for r in lines.repeated_lines(df, "grp", "rec").collect()}
    assert set(found) <= planted and len(found) >= 0.98 * len(planted) and not any(r.exact for r in found.values())
    text = {r.rec: r.text for r in lines.without_lines(df, lines.repeated_lines(df, "grp", "rec"), "rec").collect()}
    assert not any("*** END" in t or "By " in t for t in text.values())


def test_a_cluster_unites_bands(spark):
    base = "all rights to the paper edition of this text rest with the society of readers so ask before you print it".split()
    chain = [" ".join(f"x{j}" if j < i else w for j, w in enumerate(base)) for i in range(7)]
    # Each differs from the next by one word, the first from the last by seven; rows of their own are too few.
    rows = [(i, "s", f"{chain[i % 7]}\nown {i} {'abcdefghijklmnop'[i % 16]} words") for i in range(14)] + [(100 + i, "s", f"some {chr(97 + i % 26)}{chr(97 + i // 26)} body") for i in range(20)]
    df = spark.createDataFrame(rows, "rec long, grp string, text string")
    found = lines.repeated_lines(df, "grp", "rec").where("pos = 0").collect()
    assert len({r.cluster for r in found}) == 1 and len(found) >= 10 and not any(r.exact for r in found)


def linked(rows):
    """The lines of repeated clusters by plain comparison of all skeletons, two by two."""
    size, has, at = Counter(g for _, g, _ in rows), defaultdict(set), defaultdict(list)
    for rec, g, t in rows:
        for i, x in enumerate(t.split("\n")):
            at[g, lines.normal(x)].append((rec, i))
            has[g, lines.normal(x)].add(frozenset(lines.skeleton(x).tolist()))
    top = {f: f for f in at}

    def root(f):
        while top[f] != f:
            f = top[f]
        return f

    for a in at:
        for b in at:
            if a < b and a[0] == b[0] and any(5 * len(x & y) >= 4 * len(x | y) for x in has[a] for y in has[b] if x and y):
                top[root(a)] = root(b)
    whole = defaultdict(list)
    for f in at:
        whole[root(f)] += at[f]
    return {(*o, f) for f, os in whole.items() if len({r for r, _ in os}) >= max(4, 0.1 * size[f[0]]) for o in os}


def ladders(groups=4, rows=40, near=8):
    """Lines that differ from the next one of a chain by as much as a tie allows, of many lengths; chains are just repeated or just not."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(3))
    out = []
    for g in range(groups):
        texts = [[f"{word()} {word()} own"] for _ in range(rows)]
        for n in (4, 5, 8, 9, 18, 27, 45, 90):
            line = [word() for _ in range(n)]
            for t in rng.sample(texts, near if n % 2 else 5):
                t.append(" ".join(line))
                line = list(line)
                if n < 9:
                    line.append(word()) if len(line) == n else line.pop()
                else:
                    for i in rng.sample(range(n), n // 9):
                        line[i] = word()
        out += [(g * rows + i, f"g{g}", "\n".join(t)) for i, t in enumerate(texts)]
    return out


@pytest.mark.parametrize("bucket", [8192, 12])
def test_no_tie_of_lines_is_left_out(spark, monkeypatch, bucket):
    monkeypatch.setattr(lines, "BUCKET", bucket, raising=False)
    rows = ladders()
    df = spark.createDataFrame(rows, "rec long, grp string, text string")
    found = lines.repeated_lines(df, "grp", "rec").collect()
    want = linked(rows)
    assert {(r.rec, r.pos) for r in found} == {o[:2] for o in want} and len(want) > 150
    cluster = {o[:2]: o[2] for o in want}
    assert len({(r.cluster, cluster[r.rec, r.pos]) for r in found}) == len({r.cluster for r in found}) == len(set(cluster.values()))


def test_every_writing_of_a_line_may_tie_it(spark):
    # The same form twice in a row, once in capitals: its second writing alone is near to the notice.
    notice = "printed for the readers of the river library and the mill"
    texts = [f"{notice.upper()}\n{notice}" if i == 0 else f"{notice} {x}" for i, x in enumerate(("", "alpha", "beta", "gamma"))]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "rec long, grp string, text string")
    assert {(r.rec, r.pos) for r in lines.repeated_lines(df, "grp", "rec").collect()} == {(0, 0), (0, 1), (1, 0), (2, 0), (3, 0)}


def test_lines_of_two_tables(spark):
    rows = [(t, i, "s", f"Page {i} of this\n{t} {chr(97 + i)}") for t in "ab" for i in range(5)] + [("b", 9 + i, "s", f"more {i}x{chr(97 + i)}") for i in range(80)]
    df = spark.createDataFrame(rows, "t string, rec long, grp string, text string")
    assert {(r.part, r.rec) for r in lines.repeated_lines(df, "grp", "rec", part="t").where("exact").collect()} == {("a", i) for i in range(5)}


def test_lines_awkward(spark):
    df = awkward(spark)
    assert lines.repeated_lines(df, "src", "line_no").count() == 0
    assert lines.repeated_lines(df.where("false"), "src", "line_no").count() == 0
    kept = {r.rec: r.text for r in lines.without_lines(df, lines.repeated_lines(df, "src", "line_no"), "line_no").collect()}
    assert kept[3] == LONG and kept[1] is None


def test_lines_are_taken_out(spark):
    df = spark.createDataFrame([(i, "s", f"body {chr(97 + i)}\nSHARE this {i}\n\nend {chr(97 + i)}") for i in range(6)], "rec long, grp string, text string")
    found = lines.repeated_lines(df, "grp", "rec").where("exact")
    assert {r.text for r in lines.without_lines(df, found, "rec").collect()} == {f"body {chr(97 + i)}\n\nend {chr(97 + i)}" for i in range(6)}


# Pieces


@pytest.mark.parametrize("text", [LONG[:9000], "x" * 5000, "word " * 900, "One line.\n" * 400, "\n\n".join(["Para of words here."] * 200), "é“ß” " * 700])
def test_pieces_cover_the_text(text):
    cut = pieces.split_points(text, 1000, 80)
    assert cut[0][0] == 0 and cut[-1][1] == len(text) and all(0 < e - s <= 1000 for s, e in cut)
    for (s0, e0), (s1, _) in zip(cut, cut[1:], strict=False):
        assert s0 < s1 <= e0 and e0 - s1 <= 80
        if " " in text:
            assert text[e0 - 1].isspace() and text[s1 - 1].isspace()


def test_the_valley_is_cut():
    a, b = "The boat and the river, the oar and the ferry. ", "Bread from the oven, flour on the baker and dough. "
    text = a * 16 + b * 16
    cut = pieces.split_points(text, 1000, 0)[0][1]
    assert abs(cut - len(a * 16)) <= len(a)


def test_a_valley_is_as_deep_as_the_peaks_it_climbs_to():
    got = pieces.depths(np.array([0.9, 0.1, 0.5, 0.4, 0.5]))
    assert got == pytest.approx([0.0, 1.2, 0.0, 0.2, 0.0]) and pieces.depths(np.array([0.3])) == pytest.approx([0.0])


def test_a_boundary_in_the_first_half_is_cut():
    words = "Some words here. " * 15
    assert pieces.split_points(words + "x" * 3000, 1000, 80)[0] == (0, len(words))
    assert pieces.split_points(words + "\n\n" + "Mill " * 10 + "x" * 3000, 1000, 80)[0] == (0, len(words) + 2)
    cut = pieces.split_points("x" * 60 + " " + "y" * 3000, 1000, 80)
    assert cut[0] == (0, 1000) and all(0 < e - s <= 1000 for s, e in cut)
    cut = pieces.split_points("水" * 89 + "。" + "「" + "火" * 30 + "！」" + "木" * 970, 1000, 80)
    assert cut[0][1] in (90, 123)


def test_pieces_awkward(spark):
    rows = pieces.pieces(awkward(spark), "line_no", 2400, 100).collect()
    assert {r.rec_id for r in rows} == {3, 5}
    assert all(len(r.text) == r.end - r.start <= 2400 for r in rows)
    assert pieces.pieces(awkward(spark).where("false"), "line_no", 2400, 100).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        pieces.pieces(awkward(spark), "line_no", 100, 60)


# Truncation


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("He went to the mill and sat do", "fragment"),
        ("He went to the mill and then he", "word"),
        ("He went to the mill, and the clerk,", "clause"),
        ("“I will go,” he said. “", "clause"),
        ("He went to the mi�", "broken"),
        ("He went to the mill th\\u20", "broken"),
        ("He went to the mill &quo", "broken"),
        ("He went to the mill s%E2%8", "broken"),
        ("He went to the mill.", "closed"),
        ("He said: „Ich gehe jetzt nach Hause.“", "closed"),
        ("« Il est tard, mon ami. »", "quoted"),
        ("He went to the mill. THE END", "formula"),
        ("He went to the mill.\n\n* * *", "formula"),
        ("He went to the mill. Yours, as ever,\nElspeth", "formula"),
        ("He went to the mill.\nAnn & Bo\nat the mill, in March", "formula"),
        ("He went to the mill.\n— from the diary of Ann", "formula"),
        ("He went to the mill. So it goes…", "closed"),
        ("He went to the mill.\n(Here the page is blank)", "closed"),
        ("-", "blank"),
        (None, "blank"),
    ],
)
def test_endings(text, kind):
    assert truncation.ending(text) == kind


def test_an_ending_like_the_models_is_closed():
    model = "It rained on the mill all day. The old cook walked from the weir to the market square at noon without"
    assert truncation.ending("So " + model, model) == "closed" and truncation.ending("So " + model) == "fragment"
    assert truncation.ending(model[:-7] + "vibrant", model + ".") == "closed" and truncation.ending(model[:-20], model + ".") in truncation.OPEN


def test_censored_fit_recovers_the_lengths():
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(7.3, 0.4, 20_000)).astype(int)
    x = np.minimum(x, 1800)
    length, n = np.unique(x, return_counts=True)
    mu, sd = truncation.fit_censored(length, n, length == 1800)
    assert mu == pytest.approx(7.3, abs=0.02) and sd == pytest.approx(0.4, abs=0.02)
    assert np.average(np.log(x)) < mu - 0.02


def test_limits_and_rates(spark):
    rng = random.Random(2)
    full = lambda n: ("The clerk sold the boat and the widow wept again. " * 60)[:n]
    rows = [(i, "t", full(n) if (n := rng.randint(300, 2600)) <= 1400 else full(1400)) for i in range(400)]
    rows = [(i, s, t if len(t) == 1400 else t.rsplit(".", 1)[0] + ".") for i, s, t in rows] + [(900 + i, None, "Whole and done it is.") for i in range(3)]
    df = spark.createDataFrame(rows, "line_no long, src string, text string")
    feats = materialize(truncation.features(df, "line_no", "src", "text"))
    assert {(r.measure, r.length) for r in truncation.limits(feats).where("source = 't' and odds > 9").collect()} >= {("chars", 1400), ("bytes", 1400)}
    out = truncation.judged(feats)
    assert {r.key for r in out.where("truncated").collect()} == {i for i, _, t in rows if len(t) == 1400 and not t.rstrip().endswith(".")}
    assert {r.source: r.texts for r in truncation.rates(out).collect()} == {"t": 400, "": 3}


def test_only_the_limit_tells(spark):
    rng = random.Random(3)
    body = "The clerk sold the boat and the widow wept again. " * 60
    rows = [(i, "t", body[: rng.randint(300, 2600)].rsplit(".", 1)[0] + ".") for i in range(300)] + [(300 + i, "t", body[7:1407]) for i in range(12)]
    ends = ["They went to the ship that he called it “the Gull”", "They went to the ship. At noon it was met by Mr."]
    fill = lambda e, n: body[: n - len(e) - 2] + ", " + e
    rows += [(400 + k, "t", fill(e, 1400)) for k, e in enumerate(ends)] + [(500 + k, "t", fill(e, 1333)) for k, e in enumerate(ends)]
    whole = "He said so. « Il est tard, mon ami. »"
    rows += [(600, "t", fill(whole, 1400)), *((700 + i, "t", fill(ends[0], 2811)) for i in range(6))]
    assert [truncation.ending(t) for _, _, t in rows[-11:-7]] == ["marked", "abbreviation"] * 2
    feats = materialize(truncation.features(spark.createDataFrame(rows, "line_no long, src string, text string"), "line_no", "src", "text"))
    assert {r.key for r in truncation.judged(feats).where("truncated and key >= 400").collect()} == {400, 401}


def test_the_limit_overrules_the_ending_both_ways(spark):
    rng = random.Random(4)
    body = "the clerk sold the boat and the widow wept again at the mill by the river " * 60
    plain = lambda n: body[: n if not 1380 < n < 1420 else 1200].rsplit(" ", 1)[0]
    # One teacher never sets a last full stop; the other always does. Both have a limit of 1,400 characters.
    rows = [(i, "bare", plain(rng.randint(300, 2600))) for i in range(300)] + [(300 + i, "bare", body[i : 1400 + i]) for i in range(20)]
    rows += [(400 + i, "dots", plain(rng.randint(300, 2600)) + ".") for i in range(300)] + [(700 + i, "dots", body[i : 1400 + i]) for i in range(20)]
    rows += [(800, "dots", plain(900)), (801, "dots", body[:896] + "weptagai"), (802, "bare", body[:896] + "weptagai")]
    end = "they called it “the Gull”"
    rows += [(810, "dots", body[: 1400 - len(end)] + end), (811, "dots", body[: 1310 - len(end)] + end), (812, "dots", body[:1399] + ".")]
    rows = [(i, t, x.replace("weptagai", "zzweptagai"[:8])) for i, t, x in rows]
    df = spark.createDataFrame(rows, "line_no long, src string, text string")
    feats = materialize(truncation.features(df, "line_no", "src", "text"))
    cut = {r.key for r in truncation.judged(feats).where("truncated").collect()}
    ends = {i: truncation.ending(x) for i, _, x in rows}
    assert {i for i in range(300) if ends[i] == "word"} and not cut & set(range(300))  # open, but whole
    assert cut >= {300 + i for i in range(20) if ends[300 + i] != "closed"} and cut >= {700 + i for i in range(20)}
    assert ends[810] == ends[811] == "marked" and 810 in cut and 811 not in cut  # not open, but cut
    assert {800, 801} <= cut and not cut & (set(range(400, 700)) | {812})


def test_truncation_awkward(spark):
    feats = materialize(truncation.features(awkward(spark), "line_no", "src", "text"))
    assert feats.count() == 9
    assert {r.key for r in truncation.judged(feats).where("truncated").collect()} == set()
    empty = materialize(truncation.features(awkward(spark).where("false"), "line_no", "src", "text"))
    assert truncation.judged(empty).count() == 0 == truncation.rates(truncation.judged(empty)).count()


# Defects


def test_kinds_of_defects(spark):
    story = "The clerk walked from the mill to the weir, and nobody sold the boat before the harvest was in. " * 8
    other = "Der Nachbar brachte das Netz und die Kerze aus dem Wald, und niemand suchte den Koffer der Witwe am Hafen. " * 8
    draft = "Moreover, the widow chose to embark toward the square while the miller kept a light under the low bridge again. " * 8
    said = "“I cannot write to them again,” Ann told Bo. " + draft
    rows = [
        (1, story, None, "t", "empty"),
        (2, story, " [no output] ", "t", "empty"),
        (3, story, "I'm sorry, but I can't help with that kind of story.", "t", "refusal"),
        (4, story, "This one is not something I will write. I could summarise the characters of this scene instead.", "t", "refusal"),
        (5, story, "Here it is: " + story, None, "copy"),
        (6, story, story[: len(story) // 2] + draft[:60] + ".", "t", "copy"),
        (7, story, other, "t", "language"),
        (8, other, other.replace("Nachbar", "Wirt").replace("Netz", "Tuch").replace("Witwe", "Tante").replace("Koffer", "Korb").replace("Kerze", "Lampe"), "t", None),
        (9, story, draft[:500], "t", "truncated"),
        (10, story, draft, "t", None),
        (10, story, draft, "t", None),
        (11, story, said, "t", None),
        (12, None, draft, None, None),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "line_no long, clean string, sloppy string, teacher string").withColumns({c: F.lit(1) for c in ("key", "source", "h", "defect", "prompt", "text")})
    got = Counter((r.key, r.defect) for r in defects.pair_defects(df).collect())
    assert got == Counter((r[0], r[4]) for r in rows)
    assert defects.pair_defects(df.where("false")).count() == 0


def test_refusals_and_languages_of_whole_texts():
    outline = "The outline asks for a scene at the mill in which the clerk sells the boat of the widow, whom nobody in the village has seen since the harvest, and then walks to the weir. The story setting is the river after a long and cold winter, and its prompt gives the names of the miller and his two sons, who wait for the ferry. "
    assert defects.declines(outline + "I cannot write this.")
    policy = "As an AI language model, I follow rules about what content I may write for others. My guidelines do not allow me to write a scene with this content. " * 6
    assert len(policy.split()) > 120 and defects.declines(policy)
    story = "I could not find the boat. The clerk walked to the mill, and the widow stood at the weir. " * 12
    assert not defects.declines(story) and not defects.declines("The clerk walked to the mill. " * 40 + "I cannot write to them again.")
    polish = "Młynarz poszedł nad rzekę, żeby zobaczyć łódź, ale nikt jej tam nie znalazł, więc wrócił do domu przed zmrokiem i zamknął drzwi."
    swedish = "Mjölnaren gick till älven för att se båten, men ingen hade hittat henne där, så han vände hem före mörkret och stängde dörren."
    russian = "Мельник пошёл к реке."
    for text in (polish, swedish, russian):
        assert defects.other_language(story, text)
    assert not defects.other_language(story, story) and not defects.other_language(russian, russian) and not defects.other_language(story, "Café. Ann went home.")


def test_long_and_broken_placeholders_are_empty():
    for x in (None, "", " <p>\n</p> ", "null " * 100, "[no output] N/A"):
        assert defects.is_empty(x)
    assert not defects.is_empty("Nothing came of it.") and not defects.is_empty("null " * 100 + "mill")


def test_the_classifier_knows_refusals_in_other_words(spark):
    rng = random.Random(5)
    nouns = "clerk mill weir boat widow harvest miller light bridge ferry oar market letter cellar garden lantern kettle saddle orchard river".split()
    clause = lambda: f"the {rng.choice(nouns)} by the {rng.choice(nouns)} kept the {rng.choice(nouns)} that the {rng.choice(nouns)} had left"
    prompt = lambda: " ".join(clause().capitalize() + "." for _ in range(12))
    known = ["I'm sorry, but I can't help with that kind of story.", "I cannot write this scene.", "I must decline to draft a passage like this.", "I will not write this segment."]
    held_out = [
        "This tale is one that somebody else should be asked about.",
        "Leider bleibt diese Seite leer, denn so etwas entsteht hier nicht.",
        "Somebody with fewer scruples ought to take over from here. Thanks for understanding.",
        "Better leave such matters alone, friend. Ask again tomorrow about something kinder.",
    ]
    rows = [(i, p := prompt(), " ".join(f"Moreover, {x}." for x in p.lower().split(". ")[:9]) + " And so they all went home again.") for i in range(300)]
    rows += [(400 + i, prompt(), known[i % len(known)]) for i in range(24)] + [(500 + i, prompt(), x) for i, x in enumerate(held_out)]
    assert not any(defects.declines(x) for x in held_out)
    df = spark.createDataFrame([(*r, "t") for r in rows], "line_no long, clean string, sloppy string, teacher string")
    got = {r.key: r.defect for r in defects.pair_defects(df).collect()}
    assert {i for i, d in got.items() if d == "refusal"} >= {400 + i for i in range(24)} | {500 + i for i in range(len(held_out))}
    assert not any(got[i] == "refusal" for i in range(300))
    few = {r.key: r.defect for r in defects.pair_defects(df.where("line_no < 300 or line_no >= 500 or line_no < 405")).collect()}
    assert few[400] == "refusal" and few[500] is None  # too few known ones to learn from


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] - 1)))).astype(float)
    assert np.allclose(defects.fit_logistic(x, y), [2, -1, -1], atol=0.2)


def test_neighbours_find_shortened_texts(spark):
    base = "The clerk walked from the mill to the weir and nobody sold the boat. "
    texts = [base + f"Then {i} came home." for i in range(30)] + [base + "Then 7 came", base + "Then 7 came", base[:30], None, "", base + "Then 8 came home.”"]
    df = spark.createDataFrame([("p", t) for t in texts] + [("q", base), (None, base), (None, base + "More.")], "p string, t string")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert {r.t for r in defects.shortened(df, "p", "t").withColumnRenamed("p", "q").join(df.withColumn("k", F.xxhash64("p")).withColumn("h2", F.xxhash64("t")), (F.col("q") == F.col("k")) & (F.col("h") == F.col("h2"))).collect()} == {base + "Then 7 came", base}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_only_the_neighbour_tells(spark):
    base = "The clerk walked from the mill to the weir and nobody sold the boat. They came to the ship he called "
    rows = [
        (1, base + "it “the Gull”", "truncated"),
        (2, base + "it “the Gull” and went home.", None),
        (3, base + "by name…", "truncated"),
        (4, base + "by name.", None),
        (5, base + "by name often and loudly.", None),
        (6, base + "so. « Il est tard. »", "truncated"),
        (7, base + "so. « Il est tard. » Then all went home.", None),
        (8, base + "off “the Tern”", None),
        (9, base + "up from the sea…", None),
        (10, base + "« le Cormoran »", "truncated"),
        (11, base + "« le Cormoran » at last.", None),
        (12, base + "home at noon.", "truncated"),
        (13, base + "home at noon. Nobody saw them again.", None),
    ]
    other = [(20, "Another prompt.", base + "home at noon.", None), (21, None, base + "so. « Il est tard. »", None)]
    df = spark.createDataFrame([(i, "Nothing of this.", t, "t") for i, t, _ in rows] + [(i, p, t, "t") for i, p, t, _ in other], "line_no long, clean string, sloppy string, teacher string")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert {(r.key, r.defect) for r in defects.pair_defects(df).collect()} == {(r[0], r[-1]) for r in [*rows, *other]}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


# Tokens


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = tokens.PerfectHash(keys)
    assert h.size == 5000 and sorted(h(keys).tolist()) == list(range(5000))
    assert len(h([b"other", b""])) == 2
    with pytest.raises(ValueError, match="repeat"):
        tokens.PerfectHash([b"a", b"a"])


TEXTS = ["", " ", "Hello  world's 123 — “déjà vu”!\r\n\n  x", "<|endoftext|> a", "日本語 \U0001f600́ é", "a" * 3000, "\x00\t ", LONG[:20_000]]


def test_ids_equal_the_libraries():
    tiktoken = pytest.importorskip("tiktoken")
    try:
        raw = open(tokens.VOCABULARY, "rb").read()
    except OSError:
        pytest.skip("no vocabulary here")
    mine = tokens.Encoder(raw)
    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=mine.ranks, special_tokens={})
    for t in TEXTS:
        assert mine.encode(t).tolist() == own.encode_ordinary(t)
        assert b"".join({v: k for k, v in mine.ranks.items()}[i] for i in mine.encode(t[:400]).tolist()) == t[:400].encode()
    assert all(mine.merge(k) == [v] for k, v in list(mine.ranks.items())[::50])


def test_tokens_awkward(spark):
    rows = tokens.token_ids(awkward(spark), "line_no").collect()
    assert len(rows) == 9 and {r.line_no: r.ids for r in rows}[1] == [] and {r.line_no: r.ids for r in rows}[2] == []
    assert tokens.token_ids(awkward(spark).where("false"), "line_no").count() == 0
