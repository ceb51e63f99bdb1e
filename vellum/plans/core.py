"""The curation and evaluation queries over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import fixed, hooks
from vellum.functions import text as T
from vellum.functions.metrics import burstiness, share_kept, share_new, slop_hits, slop_score
from vellum.functions.outlines import outline_prompt, outline_text, parse_outline, teacher_prompt
from vellum.functions.prompts import chat_text, messages
from vellum.functions.style import FIGURES, closer, distance, style_vector
from vellum.operators import pairs as P
from vellum.operators import profile as R
from vellum.operators import report as Q
from vellum.operators import segment as S
from vellum.operators import split as L
from vellum.operators.nearest import nearest
from vellum.operators.ranks import batches, placed, ranked, sample, seeded
from vellum.operators.style import style_references
from vellum.shared import materialize, shared_dir, spread, table
from vellum.sources import files as I
from vellum.streaming.ingest import append_once, arrivals, json_stream, parquet_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
Six = T.six


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query by its function's name."""
    QUERIES[f.__name__] = f
    return f


def _books(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "raw_texts").select("path", "text"))


def _excerpts(s: SparkSession, d: str) -> DataFrame:
    """One row for each excerpt id that has a text: the one with the lowest line number."""
    rows = table(s, d, "raw_excerpts").where("id is not null and text is not null and text <> ''")
    return rows.groupBy("id").agg(F.min(F.struct("line_no", "source", "text")).alias("x")).select("id", "x.source", "x.text")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """One row for each id of kept pairs: the one with the lowest line number."""
    rows = table(s, d, "filtered_pairs").where("id is not null and clean is not null and sloppy is not null")
    return rows.groupBy("id").agg(F.min(F.struct("line_no", "clean", "sloppy", "teacher", "ner_overlap", "sem_sim")).alias("x")).select("id", "x.clean", "x.sloppy", "x.teacher", "x.ner_overlap", "x.sem_sim")


def _nulls(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "null_pairs").select("id", "clean", "sloppy", "teacher")


def _outline_json() -> Column:
    """An outline put together of an excerpt's entities, source and sentences."""
    people, events = F.array_sort(hooks.entities(F.col("text"))), F.transform(T.sentences(F.col("text")), T.strip)
    return F.to_json(F.struct(F.struct(people.alias("characters"), F.col("source").alias("setting"), events.alias("events"), F.lit("narrator").alias("pov_state")).alias("outline")))


# Sources and text


@query
def excerpts_by_source(s: SparkSession, d: str) -> DataFrame:
    return S.by_source(S.first_excerpts(S.segment_books(_books(s, d)))).withColumn("mean_words", Six(F.col("mean_words")))


@query
def segment_books(s: SparkSession, d: str) -> DataFrame:
    return S.segment_books(_books(s, d)).select("id", "source", "path", "pos", "word_count", F.length("text").alias("n_chars"))


@query
def segment_small(s: SparkSession, d: str) -> DataFrame:
    """Smaller excerpts, of documents whose paragraphs are lines."""
    docs = spread(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))
    return S.segment_books(docs, 60, 140, "\n").select("id", "path", "pos", "word_count")


@query
def excerpt_dedup(s: SparkSession, d: str) -> DataFrame:
    return S.first_excerpts(S.segment_books(_books(s, d))).select("id", "source", "path", "pos", "word_count")


@query
def strip_boilerplate(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_texts").select("text_id", F.length("text").alias("before"), F.length(T.strip_boilerplate(F.col("text"))).alias("after"))


@query
def path_names(s: SparkSession, d: str) -> DataFrame:
    """Books and sites of each file name."""
    return table(s, d, "raw_texts").groupBy(T.file_name(F.col("path")).alias("name")).agg(F.count("*").alias("n"), F.count_distinct("site").alias("sites"), F.min("path").alias("first_path"))


@query
def paths_in_order(s: SparkSession, d: str) -> DataFrame:
    """Every path with its place in order, part by part."""
    rows = table(s, d, "raw_texts").select("path", "text_id")
    return placed(rows, F.split("path", "/").asc_nulls_last(), F.col("text_id").asc())


@query
def printable_filter(s: SparkSession, d: str) -> DataFrame:
    r = T.printable_ratio(F.col("text"))
    return table(s, d, "raw_excerpts").select("line_no", Six(r).alias("ratio"), (r >= fixed.PRINTABLE).alias("keep"))


@query
def word_counts(s: SparkSession, d: str) -> DataFrame:
    """Stored and counted words, and whether the stored figure is missing or stale."""
    w = T.word_count(F.col("text"))
    return table(s, d, "raw_excerpts").select("line_no", F.col("word_count").alias("stored"), w.cast("int").alias("counted"), (~F.col("word_count").eqNullSafe(w.cast("int"))).alias("stale"))


@query
def content_ids(s: SparkSession, d: str) -> DataFrame:
    """How many rows hold each text, by content id."""
    return table(s, d, "raw_excerpts").where("text is not null").groupBy(T.content_id(F.col("text")).alias("content_id")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query
def base_id_parse(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "raw_pairs").select("id").unionByName(table(s, d, "null_pairs").select("id"))
    return rows.groupBy("id", T.base_id(F.col("id")).alias("base"), T.style_base_id(F.col("id")).alias("style_base")).agg(F.count("*").alias("n"))


# Files


def _place(s: SparkSession) -> str:
    return f"{shared_dir(s)}/{uuid.uuid4().hex}"


@query
def files_round_trip(s: SparkSession, d: str) -> DataFrame:
    """The first 500 documents as numbered files, and what is read back: the row cap is the source's own."""
    rows = table(s, d, "documents").where("text <> ''").select("doc_id", "title", "text")
    column = I.text_column(rows.drop("doc_id"))
    capped = I.first_rows(rows.select("doc_id", F.col(column).alias("text")), fixed.PROFILE_ROWS, "doc_id")
    I.write_files(I.numbered(capped, "doc_id"), at := _place(s))
    read = I.in_path_order(I.read_books(s, at))
    return read.select(T.file_name(F.col("path")).alias("name"), F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query
def jsonl_splits(s: SparkSession, d: str) -> DataFrame:
    """Kept pairs written as JSONL by split and read back by name."""
    rows, paths = table(s, d, "filtered_pairs"), {}
    for split in ("train", "val"):
        of = rows.where(F.col("split") == split).select("id", "clean", "sloppy", "teacher", "ner_overlap", "sem_sim")
        I.write_jsonl(of, paths.setdefault(split, _place(s)))
        I.write_jsonl(of.limit(0), paths[split], overwrite=False)  # the guard keeps what is there
    read = I.read_splits(s, paths, I.KEPT_PAIR)
    return read.select("split", "id", "teacher", "ner_overlap", F.nanvl("sem_sim", F.lit(-1.0)).alias("sem_sim"), F.md5(F.concat("clean", F.coalesce("sloppy", F.lit("")))).alias("digest"))


def _one_by_id(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "raw_pairs").where("id is not null")
    return rows.groupBy("id").agg(F.min("clean").alias("clean"), F.min("sloppy").alias("sloppy"), F.min("teacher").alias("teacher"))


@query
def append_resume(s: SparkSession, d: str) -> DataFrame:
    """Pairs appended in batches: one teacher's first, then all that aren't there yet, then none."""
    rows, at = materialize(_one_by_id(s, d)), _place(s)
    for todo in (rows.where("teacher = 'heron'"), rows, rows):
        I.append_new(todo, at, "id", I.PAIR)
    read = I.read_jsonl(s, at, I.PAIR)
    return read.groupBy("id").agg(F.count("*").alias("n"), F.min("teacher").alias("teacher"), F.md5(F.min("clean")).alias("digest"))


@query
def keyed_outlines(s: SparkSession, d: str) -> DataFrame:
    """Outlines as one keyed file, and what is read back of each."""
    I.write_keyed_json(_excerpts(s, d).select("id", _outline_json().alias("entry")), at := _place(s))
    e = F.col("entry")
    return I.read_keyed_json(s, at).select("id", F.try_variant_get(e, "$.outline.setting", "string").alias("setting"), F.size(F.try_variant_get(e, "$.outline.events", "array<string>")).alias("events"))


@query
def report_file(s: SparkSession, d: str) -> DataFrame:
    """The evaluation report as a JSON file, read back."""
    r = _report(s, d)
    I.write_report(r.select(*(Six(F.col(c)).alias(c) for c in r.columns)), at := f"{_place(s)}/report.json")
    return s.read.schema(", ".join(f"{c} double" for c in r.columns)).option("multiLine", True).json(at)


@query
def phrase_lines(s: SparkSession, d: str) -> DataFrame:
    """The ban list as lines of text, blank ones among them, and the phrases read back."""
    phrases = slop_banlist(s, d).select("phrase")
    I.write_lines(phrases.unionByName(s.createDataFrame([("  ",), ("",)], "phrase string")), "phrase", at := _place(s))
    return I.read_lines(s, at).select(F.col("value").alias("phrase"))


@query
def existing_files(s: SparkSession, d: str) -> DataFrame:
    """Of three named tables those that are wanted and there."""
    names = ("documents", "raw_pairs", "no_such_table")
    found = I.existing(s, {n: f"{d}/{n}.parquet" for n in names}, ["documents", "no_such_table"])
    return s.createDataFrame([(n,) for n in found], "name string")


@query
def first_tokens(s: SparkSession, d: str) -> DataFrame:
    """First token ids of the ban list's phrases, with UTF-8 bytes as the stand-in tokenizer's ids."""
    phrases = [r.phrase for r in slop_banlist(s, d).select("phrase").collect()]  # 50 at most
    return s.createDataFrame([(i,) for i in sorted(hooks.first_token_ids(lambda t: list(t.encode()), phrases))], "token int")


@query
def stream_append(s: SparkSession, d: str) -> DataFrame:
    """Raw pairs as a stream of files, each id appended once, however often it arrives."""
    I.write_jsonl(table(s, d, "raw_pairs").select("id", "clean", "sloppy", "teacher").where("id is not null"), src := _place(s))
    out = _place(s)
    for turn in range(2):  # the second run starts from an empty checkpoint and finds every key there
        append_once(json_stream(s, src, I.PAIR), out, "id", f"{out}-{turn}").awaitTermination()
    return s.read.parquet(out).groupBy("id").agg(F.count("*").alias("n"))


@query
def stream_arrivals(s: SparkSession, d: str) -> DataFrame:
    """Raw pairs by hour of arrival and teacher, as a stream with a watermark."""
    rows = table(s, d, "raw_pairs").where("loaded_at is not null").select("line_no", "teacher", F.col("loaded_at").cast("timestamp").alias("at"))
    rows.write.parquet(src := _place(s))
    name = "arrived_" + uuid.uuid4().hex
    arrivals(parquet_stream(s, src, "line_no long, teacher string, at timestamp"), "at", "teacher").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return s.table(name).select(F.unix_timestamp("start").alias("hour"), "teacher", "n")


# Metrics of one text


@query
def slop_scores(s: SparkSession, d: str) -> DataFrame:
    c, x = F.col("clean"), F.col("sloppy")
    return spread(table(s, d, "raw_pairs").select("line_no", "clean", "sloppy")).select("line_no", slop_hits(x).alias("hits"), Six(slop_score(x)).alias("slop"), Six(slop_score(c)).alias("clean_slop"))


@query
def burstiness_scores(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "raw_excerpts").select("line_no", "text")).select("line_no", Six(burstiness(F.col("text"))).alias("burstiness"))


@query
def style_vectors(s: SparkSession, d: str) -> DataFrame:
    v = spread(table(s, d, "raw_excerpts").where("text is not null").select("line_no", "text")).select("line_no", style_vector(F.col("text")).alias("v"))
    return v.select("line_no", *(Six(F.col("v")[f]).alias(f) for f in FIGURES))


# Metrics of pairs


@query
def style_distances(s: SparkSession, d: str) -> DataFrame:
    """Whether the draft or the edited draft is nearer in style to the clean text."""
    rows = spread(table(s, d, "raw_pairs").where("sloppy is not null").select("line_no", "clean", "sloppy"))
    v = rows.select("line_no", style_vector(F.col("clean")).alias("r"), style_vector(F.col("sloppy")).alias("b"), style_vector(hooks.edited(F.col("sloppy"))).alias("e"))
    return v.select("line_no", Six(distance(F.col("b"), F.col("r"))).alias("draft_distance"), Six(distance(F.col("e"), F.col("r"))).alias("edited_distance"), closer(F.col("r"), F.col("b"), F.col("e")).alias("closer"))


@query
def entity_overlap_heuristic(s: SparkSession, d: str) -> DataFrame:
    a, b = hooks.entities(F.col("clean")), hooks.entities(F.col("sloppy"))
    rows = spread(table(s, d, "raw_pairs").where("sloppy is not null").select("line_no", "clean", "sloppy")).select("line_no", a.alias("a"), b.alias("b"))
    return rows.select("line_no", F.size("a").alias("entities"), Six(share_kept(F.col("a"), F.col("b"))).alias("kept"), Six(share_new(F.col("a"), F.col("b"))).alias("made_up"))


@query
def cosine_search(s: SparkSession, d: str) -> DataFrame:
    """The 5 nearest of all rows to every vector whose id is divisible by 100."""
    e = table(s, d, "embeddings")
    return nearest(e.where("vec_id % 100 = 0"), e, 5)


@query
def pair_filter_gate(s: SparkSession, d: str) -> DataFrame:
    """Raw pairs with the stand-ins' scores and whether the gate keeps them, bounds on unrounded values."""
    c, x = F.col("clean"), F.col("sloppy")
    rows = spread(table(s, d, "raw_pairs").where("sloppy is not null").select("line_no", "clean", "sloppy")).select("line_no", share_kept(hooks.entities(c), hooks.entities(x)).alias("n"), hooks.similarity(hooks.word_set(c), hooks.word_set(x)).alias("m"))
    return rows.select("line_no", Six(F.col("n")).alias("ner"), Six(F.col("m")).alias("sem"), P.passes(F.col("n"), F.col("m")).alias("keep"))


@query
def stored_gate(s: SparkSession, d: str) -> DataFrame:
    """The same gate on stored scores; NaN and null don't pass."""
    ok = P.passes(F.col("ner_overlap"), F.col("sem_sim"))
    return table(s, d, "filtered_pairs").groupBy("split", ok.alias("keep")).agg(F.count("*").alias("n"), F.count_if(F.isnan("sem_sim")).alias("nan_sem"))


@query
def keep_rate(s: SparkSession, d: str) -> DataFrame:
    return P.keep_report(table(s, d, "filtered_pairs"), P.passes(F.col("ner_overlap"), F.col("sem_sim"))).withColumn("rate", Six(F.col("rate")))


# Making pairs


@query
def min_output_filter(s: SparkSession, d: str) -> DataFrame:
    return P.long_enough(table(s, d, "raw_pairs"), "sloppy").groupBy("teacher").agg(F.count("*").alias("n"), F.min(T.word_count(F.col("sloppy"))).cast("int").alias("fewest"))


@query
def pair_cross_teachers(s: SparkSession, d: str) -> DataFrame:
    """Each excerpt once for each stand-in teacher, with its draft's id and size."""
    rows = P.for_teachers(_excerpts(s, d), list(hooks.STAND_INS)).withColumn("sloppy", hooks.draft(F.col("text"), F.col("teacher")))
    return rows.select("pair_id", "teacher", F.md5("sloppy").alias("draft"), T.word_count(F.col("sloppy")).cast("int").alias("n_words"))


@query
def pair_resume(s: SparkSession, d: str) -> DataFrame:
    """Pairs of the table's excerpts and teachers that aren't among the raw pairs yet."""
    todo = P.for_teachers(_excerpts(s, d).select("id"), ["heron", "tern7"]).select(F.col("pair_id").alias("id"), "teacher")
    return P.not_yet(todo, table(s, d, "raw_pairs").select("id"), "id")


@query
def outline_resume(s: SparkSession, d: str) -> DataFrame:
    """Excerpts without a raw pair, by source, and the first id of each."""
    done = table(s, d, "raw_pairs").select(T.base_id(F.col("id")).alias("id"))
    return P.not_yet(_excerpts(s, d).select("id", "source"), done, "id").groupBy("source").agg(F.count("*").alias("todo"), F.min("id").alias("first_id"))


@query
def outline_join(s: SparkSession, d: str) -> DataFrame:
    """Excerpts that have an outline, here from their pairs: entities as characters and sentences as events."""
    out = _pairs(s, d).groupBy(T.base_id(F.col("id")).alias("id")).agg(F.min("clean").alias("clean")).select("id", F.size(hooks.entities(F.col("clean"))).alias("characters"), F.size(T.sentences(F.col("clean"))).alias("events"))
    return P.with_outlines(_excerpts(s, d).select("id", "source"), out)


@query
def teacher_prompts(s: SparkSession, d: str) -> DataFrame:
    """Prompts for a draft, from outlines put together as JSON."""
    rows = spread(_excerpts(s, d)).select("id", "text", outline_text(F.parse_json(_outline_json())).alias("outline"))
    prompt = teacher_prompt(F.col("text"), F.col("outline"), F.lit(fixed.TEACHER_BLOCKS["llama3"]))
    return rows.select("id", F.md5("outline").alias("outline"), F.md5(prompt).alias("prompt"), F.length(outline_prompt(F.col("text"))).alias("outline_prompt_chars"))


@query
def outline_parse(s: SparkSession, d: str) -> DataFrame:
    """Answers in four shapes made of each title: which of them give an outline, and its setting."""
    title = F.replace(F.replace(F.coalesce("title", F.lit("")), F.lit("'"), F.lit("")), F.lit('"'), F.lit(""))
    body = lambda q: F.concat(*(F.lit(x.replace('"', q)) if i % 2 == 0 else title for i, x in enumerate(('{"characters": [], "setting": "', "", '", "events": ["one"], "pov_state": "all"}'))))
    shapes = F.array(body('"'), body("'"), F.concat(F.lit("Here it is: "), body('"'), F.lit(" Done.")), F.lit('{"setting": "x"}'))
    rows = table(s, d, "documents").select("doc_id", F.posexplode(shapes).alias("shape", "raw"))
    o = rows.select("doc_id", "shape", parse_outline(F.col("raw")).alias("o"))
    return o.select("doc_id", "shape", F.col("o").isNotNull().alias("parsed"), F.try_variant_get("o", "$.setting", "string").alias("setting"))


# Null pairs, splits and records


@query
def null_sample(s: SparkSession, d: str) -> DataFrame:
    kept = table(s, d, "filtered_pairs").count()
    return L.null_pairs(_excerpts(s, d), kept).select("id", F.md5("clean").alias("text"), (F.col("clean") == F.col("sloppy")).alias("same"), "teacher")


@query
def union_formatted(s: SparkSession, d: str) -> DataFrame:
    """Kept and null pairs as training records, by length and hash."""
    rows = L.all_pairs(_pairs(s, d), _nulls(s, d))
    text = chat_text(messages(F.col("sloppy"), F.col("clean")))
    return rows.select("id", "teacher", "ner_overlap", F.length(text).alias("n_chars"), F.md5(text).alias("record"))


@query
def split_by_base(s: SparkSession, d: str) -> DataFrame:
    return L.split_bases(L.all_pairs(_pairs(s, d), _nulls(s, d)))


@query
def split_leakage_check(s: SparkSession, d: str) -> DataFrame:
    return L.leaks(L.split_pairs(L.all_pairs(_pairs(s, d), _nulls(s, d))))


@query
def stored_split_leaks(s: SparkSession, d: str) -> DataFrame:
    """The same check on the stored splits."""
    rows = table(s, d, "filtered_pairs").where("split is not null").select("id", "split").unionByName(table(s, d, "test_raw").select("id", F.lit("test").alias("split")))
    return L.leaks(rows.withColumn("base", T.base_id(F.col("id"))))


@query
def chat_render(s: SparkSession, d: str) -> DataFrame:
    """Messages and prompts of the test split, open for an answer."""
    m = messages(F.col("sloppy"))
    return table(s, d, "test_raw").select("line_no", F.size(m).alias("turns"), F.md5(chat_text(m, answer=True)).alias("prompt"), F.endswith(chat_text(m, answer=True), F.lit(fixed.ANSWER_MARK)).alias("open"))


@query
def style_reference_records(s: SparkSession, d: str) -> DataFrame:
    p, e = _pairs(s, d), table(s, d, "raw_excerpts")
    refs = style_references(p, e.where("text <> ''"))
    text = chat_text(messages(F.col("sloppy"), F.col("clean"), F.col("reference")))
    return refs.join(p.withColumnRenamed("id", "pair_id"), "pair_id").select("pair_id", "source", "refs", F.md5("reference").alias("reference"), F.length(text).alias("n_chars"))


@query
def fixture_buckets(s: SparkSession, d: str) -> DataFrame:
    """90 test records in seeded order, in three buckets of 30; a short input leaves the later ones short."""
    n = fixed.FIXTURE_ROWS
    rows = table(s, d, "test_raw").withColumn("order", seeded(F.col("line_no")))
    at = ranked(rows, "order").where(F.col("rank") < 3 * n)
    bucket = F.when(F.col("rank") < n, "clean").when(F.col("rank") < 2 * n, "voice").otherwise("tone")
    todo = F.when(F.col("rank") >= 2 * n, fixed.TONE_TODO).when(F.col("rank") >= n, fixed.VOICE_TODO)
    return at.select("line_no", "rank", bucket.alias("bucket"), F.when(F.col("rank") >= n, F.col("id")).alias("_source"), todo.alias("_todo"), F.when(F.col("rank") >= 2 * n, "FILL_IN").alias("tone"))


@query
def profile_samples(s: SparkSession, d: str) -> DataFrame:
    """500 books' beginnings and 500 test drafts, each in seeded order: characters and words."""
    head, x = T.head(F.col("text"), fixed.BASELINE_CHARS), F.col("sloppy")
    figures = lambda t: (F.length(t).alias("n_chars"), T.word_count(t).cast("int").alias("n_words"))
    books = sample(table(s, d, "raw_texts"), "text_id", fixed.PROFILE_ROWS).select(F.lit("people").alias("corpus"), F.col("text_id").alias("row_id"), *figures(head))
    return books.unionByName(sample(table(s, d, "test_raw"), "line_no", fixed.PROFILE_ROWS).select(F.lit("model").alias("corpus"), F.col("line_no").alias("row_id"), *figures(x)))


@query
def excerpt_batches(s: SparkSession, d: str) -> DataFrame:
    """Batches of 50 excerpts."""
    return batches(_excerpts(s, d).select("id"), "id", fixed.BATCH).groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


# Profiles


def _corpora(s: SparkSession, d: str) -> DataFrame:
    model = table(s, d, "raw_pairs").select(F.lit("model").alias("corpus"), F.col("sloppy").alias("text"))
    people = table(s, d, "raw_texts").select(F.lit("people").alias("corpus"), T.head(F.col("text"), fixed.BASELINE_CHARS).alias("text"))
    return spread(model.unionByName(people))


@query
def pattern_frequency(s: SparkSession, d: str) -> DataFrame:
    c = R.pattern_counts(_corpora(s, d), "corpus", "text")
    return c.select("corpus", "pattern", F.col("hits").cast("long").alias("hits"), F.col("words").cast("long").alias("words"), Six(R.frequency(F.col("hits"), F.col("words"))).alias("per_1k"))


def _profile(s: SparkSession, d: str) -> DataFrame:
    return R.slop_profile(R.pattern_counts(_corpora(s, d), "corpus", "text"), "model", "people")


@query
def slop_profile(s: SparkSession, d: str) -> DataFrame:
    return _profile(s, d)


@query
def slop_profile_top(s: SparkSession, d: str) -> DataFrame:
    return R.top(_profile(s, d), 20).select("pattern", "delta")


@query
def slop_banlist(s: SparkSession, d: str) -> DataFrame:
    """The ban list of the stand-in teachers' drafts against people's texts."""
    drafts = P.for_teachers(_excerpts(s, d), list(hooks.STAND_INS)).select(F.lit("model").alias("corpus"), hooks.draft(F.col("text"), F.col("teacher")).alias("text"))
    people = table(s, d, "raw_texts").select(F.lit("people").alias("corpus"), T.head(F.col("text"), fixed.BASELINE_CHARS).alias("text"))
    return R.banlist(R.slop_profile(R.pattern_counts(spread(drafts.unionByName(people)), "corpus", "text"), "model", "people"))


# Reports, tiers, gates and checks


def _evaluated(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "test_raw").where("sloppy is not null and clean is not null")
    return Q.evaluate(rows.withColumn("edited", hooks.edited(F.col("sloppy"))))


def _report(s: SparkSession, d: str, after: str = "edited") -> DataFrame:
    rows = table(s, d, "test_raw").where("sloppy is not null and clean is not null").withColumn("edited", hooks.edited(F.col("sloppy")))
    return Q.averages(Q.evaluate(rows, after=after))


@query
def eval_pairs(s: SparkSession, d: str) -> DataFrame:
    return _evaluated(s, d).select("line_no", *(Six(F.col(m)).alias(m) for m in Q.METRICS), "burstiness_improved")


@query
def eval_report(s: SparkSession, d: str) -> DataFrame:
    r = _report(s, d)
    return r.select(*(Six(F.col(c)).alias(c) for c in r.columns))


@query
def metric_tiers(s: SparkSession, d: str) -> DataFrame:
    return Q.tiers(_report(s, d)).select("metric", Six(F.col("value")).alias("value"), "tier")


@query
def regression_gates(s: SparkSession, d: str) -> DataFrame:
    """All three gates, of the edited texts against the clean ones as the base."""
    now, base = _report(s, d), _report(s, d, after="clean")
    texts = table(s, d, "test_raw").where("sloppy is not null and clean is not null").withColumn("edited", hooks.edited(F.col("sloppy")))
    now = now.crossJoin(Q.style_similarity(texts, "edited", "sloppy", "clean")).withColumn("unconditioned_sem_vs_target", F.col("sem_vs_target"))  # one row
    each = [g.withColumn("gate", F.lit(n)) for n, g in (("first", Q.first_gate(now)), ("second", Q.second_gate(now, base)), ("style", Q.style_gate(now, base)))]
    rows = each[0].unionByName(each[1]).unionByName(each[2])
    return rows.select("gate", "metric", Six(F.col("value")).alias("value"), Six(F.col("least")).alias("least"), "passed")


@query
def adversarial_report(s: SparkSession, d: str) -> DataFrame:
    """The adversarial means over eval items, by kind: English ones are clean, German voiced, the rest tagged with a tone."""
    kind = F.when(F.col("lang") == "en", "clean").when(F.col("lang") == "de", "voice").otherwise("tone")
    rows = table(s, d, "eval_items").where("text <> ''").select("text", hooks.edited(F.col("text")).alias("edited"), kind.alias("bucket"), F.lit("la").alias("tone"))
    r = Q.adversarial(rows)
    return r.select(*(Six(F.col(c)).alias(c) for c in r.columns))


@query
def kpi_segmentation(s: SparkSession, d: str) -> DataFrame:
    return Q.excerpt_checks(table(s, d, "raw_excerpts"))


@query
def kpi_outlines(s: SparkSession, d: str) -> DataFrame:
    out = _pairs(s, d).groupBy(T.base_id(F.col("id")).alias("id")).agg(F.min("clean").alias("c"))
    people = hooks.entities(F.col("c"))
    entry = F.to_json(F.struct(F.struct(people.alias("characters"), F.lit("").alias("setting"), T.sentences(F.col("c")).alias("events"), F.get(people, 0).alias("pov_state")).alias("outline")))
    out = out.select("id", F.parse_json(entry).alias("entry"))
    return Q.outline_checks(_excerpts(s, d), out)


@query
def kpi_pairs(s: SparkSession, d: str) -> DataFrame:
    return Q.pair_checks(table(s, d, "raw_pairs"))


@query
def kpi_dataset(s: SparkSession, d: str) -> DataFrame:
    rows = L.all_pairs(_pairs(s, d), _nulls(s, d))
    records = rows.select(chat_text(messages(F.col("sloppy"), F.col("clean"))).alias("text"))
    return Q.dataset_checks(table(s, d, "filtered_pairs"), table(s, d, "null_pairs"), L.split_bases(rows), table(s, d, "test_raw"), records)


# Grouping and sets


@query
def pairs_by_base(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_pairs").groupBy(T.base_id(F.col("id")).alias("base")).agg(F.count("*").alias("n"), F.count_distinct("teacher").alias("teachers"), F.min("line_no").alias("first_line"))


@query
def texts_by_source(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_excerpts").groupBy("source").agg(F.count("text").alias("texts"), F.count_distinct("text").alias("different"))


@query
def distinct_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_pairs").agg(F.count_distinct("id").alias("ids"), F.count_distinct("teacher").alias("teachers"), F.count("*").alias("n"))


@query
def pair_sources(s: SparkSession, d: str) -> DataFrame:
    """Kept pairs by their excerpt's source; pairs without one are counted too."""
    e = table(s, d, "raw_excerpts").where("source is not null").groupBy("id").agg(F.min("source").alias("source")).withColumnRenamed("id", "base")
    return table(s, d, "filtered_pairs").withColumn("base", T.style_base_id(F.col("id"))).join(e, "base", "left").groupBy("source").agg(F.count("*").alias("n"))


@query
def id_coverage(s: SparkSession, d: str) -> DataFrame:
    """Excerpt ids by whether they have raw pairs, and pair bases without an excerpt."""
    e = table(s, d, "raw_excerpts").select("id").where("id is not null")
    b = table(s, d, "raw_pairs").select(T.base_id(F.col("id")).alias("id")).where("id is not null")
    count = lambda df, name: df.agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
    return count(e.intersect(b), "both").unionByName(count(e.subtract(b), "excerpt_only")).unionByName(count(b.subtract(e), "pair_only"))
