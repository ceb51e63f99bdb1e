"""From metrics of pairs to reports, tiers, gates and checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import fixed, hooks
from vellum.functions.metrics import burstiness, share_kept, share_new, slop_score
from vellum.functions.text import base_id, word_count
from vellum.operators.pairs import passes

METRICS = ("slop_in", "slop_out", "slop_delta", "burstiness_out", "semantic_sim", "ner_preservation", "hallucination_rate", "sem_vs_target")


def evaluate(df: DataFrame, before: str = "sloppy", after: str = "edited", target: str | None = "clean", entities: Callable[[Column], Column] = hooks.entities, embed: Callable[[Column], Column] = hooks.word_set, similar: Callable[[Column, Column], Column] = hooks.similarity) -> DataFrame:
    """``df`` with the metrics of an edit. Features shared by several metrics are columns of their own, computed once."""
    cols = {"before": before, "after": after} | ({"target": target} if target else {})
    f = df.withColumns({f"_{k}_words": embed(F.col(c)) for k, c in cols.items()} | {f"_{k}_ents": entities(F.col(cols[k])) for k in ("before", "after")} | {f"_{k}_slop": slop_score(F.col(cols[k])) for k in ("before", "after")} | {f"_{k}_burst": burstiness(F.col(cols[k])) for k in ("before", "after")})
    out = f.withColumns(
        {
            "slop_in": F.col("_before_slop"),
            "slop_out": F.col("_after_slop"),
            "slop_delta": F.col("_before_slop") - F.col("_after_slop"),
            "burstiness_out": F.col("_after_burst"),
            "burstiness_improved": F.col("_after_burst") >= F.col("_before_burst"),
            "semantic_sim": similar(F.col("_before_words"), F.col("_after_words")),
            "ner_preservation": share_kept(F.col("_before_ents"), F.col("_after_ents")),
            "hallucination_rate": share_new(F.col("_before_ents"), F.col("_after_ents")),
        }
        | ({"sem_vs_target": similar(F.col("_after_words"), F.col("_target_words"))} if target else {})
    )
    return out.drop(*(c for c in out.columns if c.startswith("_") and c not in df.columns))


def averages(rows: DataFrame) -> DataFrame:
    """One row: the mean of each numeric metric that is there, and the share of edits whose rhythm didn't suffer."""
    return rows.agg(*(F.avg(m).alias(m) for m in METRICS if m in rows.columns), F.avg(F.col("burstiness_improved").cast("int")).alias("burstiness_improved_rate"))


def tier(metric: str, value: Column) -> Column:
    """PASS, WARN or FAIL by the metric's bounds; null and NaN fail."""
    fail, good = fixed.TIERS[metric]
    known = value.isNotNull() & ~F.isnan(value)
    better = (lambda b: value < b) if good < fail else (lambda b: value >= b)
    return F.when(~known, "FAIL").when(better(good), "PASS").when(better(fail), "WARN").otherwise("FAIL")


def tiers(report: DataFrame) -> DataFrame:
    """``metric, value, tier`` of a report's row; a metric it lacks is NaN."""
    value = lambda m: F.col(m).cast("double") if m in report.columns else F.lit(float("nan"))
    each = F.array(*(F.struct(F.lit(m).alias("metric"), value(m).alias("value"), tier(m, value(m)).alias("tier")) for m in fixed.TIERS))
    return report.select(F.explode(each).alias("x")).select("x.*")


def _at_least(now: DataFrame, base: DataFrame, slack: dict[str, float]) -> DataFrame:
    pair = now.select(*(F.col(m).alias(f"n_{m}") for m in slack)).crossJoin(base.select(*(F.col(m).alias(f"b_{m}") for m in slack)))  # one row each
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"n_{m}").alias("value"), (F.col(f"b_{m}") - s).alias("least"), (F.col(f"n_{m}") >= F.col(f"b_{m}") - s).alias("passed")) for m, s in slack.items()))
    return pair.select(F.explode(each).alias("x")).select("x.*")


def first_gate(report: DataFrame) -> DataFrame:
    """The first model's gate: a slop delta above 1, entities kept and nearness to the target at their bounds."""
    rules = (("slop_delta", 1.0, F.col("slop_delta") > 1.0), ("ner_preservation", 0.90, F.col("ner_preservation") >= 0.90), ("sem_vs_target", 0.78, F.col("sem_vs_target") >= 0.78))
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(b).alias("least"), ok.alias("passed")) for m, b, ok in rules))
    return report.select(F.explode(each).alias("x")).select("x.*")


def second_gate(now: DataFrame, base: DataFrame) -> DataFrame:
    """The preference-trained model against the first: no less slop removed, the rest within its slack."""
    return _at_least(now, base, {"slop_delta": 0.0, "ner_preservation": 0.02, "burstiness_improved_rate": 0.05, "sem_vs_target": 0.02})


def style_gate(now: DataFrame, base: DataFrame) -> DataFrame:
    """The style-conditioned model against the one before.

    Where ``now`` has them: ``style_similarity_conditioned`` must be above ``style_similarity_unconditioned``, and
    ``unconditioned_sem_vs_target`` (else ``sem_vs_target``) no more than 0.02 below the base's ``sem_vs_target``.
    """
    rows = _at_least(now, base, {"slop_delta": 0.05, "ner_preservation": 0.02, "sem_vs_target": 0.02})
    with_, without = "style_similarity_conditioned", "style_similarity_unconditioned"
    if with_ in now.columns and without in now.columns:
        rows = rows.unionByName(now.select(F.lit(with_).alias("metric"), F.col(with_).alias("value"), F.col(without).alias("least"), (F.col(with_) > F.col(without)).alias("passed")))
    if "unconditioned_sem_vs_target" in now.columns:
        own = now.select(F.col("unconditioned_sem_vs_target").alias("sem_vs_target"))
        rows = rows.unionByName(_at_least(own, base, {"sem_vs_target": 0.02}).withColumn("metric", F.lit("unconditioned_sem_vs_target")))
    return rows


def style_similarity(rows: DataFrame, conditioned: str, unconditioned: str, reference: str, embed: Callable[[Column], Column] = hooks.word_set, similar: Callable[[Column, Column], Column] = hooks.similarity) -> DataFrame:
    """One row: how near conditioned and unconditioned edits are to their style reference on average."""
    to = embed(F.col(reference))
    return rows.agg(F.avg(similar(embed(F.col(conditioned)), to)).alias("style_similarity_conditioned"), F.avg(similar(embed(F.col(unconditioned)), to)).alias("style_similarity_unconditioned"))


def adversarial(rows: DataFrame, text: str = "text", edited: str = "edited", kind: str = "bucket", tone: str = "tone") -> DataFrame:
    """One row of means: similarity on clean and on voiced texts, entities made up on clean ones, and tones kept; 0 where there are none."""
    t, e = F.col(text), F.col(edited)
    sim = hooks.similarity(hooks.word_set(t), hooks.word_set(e))
    invented = share_new(hooks.entities(t), hooks.entities(e))
    mean = lambda b, x: F.coalesce(F.avg(F.when(F.col(kind) == b, x)), F.lit(0.0))
    return rows.agg(mean("clean", sim).alias("over_edit_score"), mean("clean", invented).alias("hallucination_clean"), mean("voice", sim).alias("voice_flattening"), mean("tone", hooks.keeps_tone(e, F.col(tone)).cast("int")).alias("tone_preservation"))


def _checks(df: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    return df.agg(*(c.alias(k) for k, c in aggregates.items()))


def excerpt_checks(excerpts: DataFrame) -> DataFrame:
    """One row of figures about excerpts: rows, sizes outside 280 to 760 words, ids that repeat or aren't 12 hex digits, empty texts, boilerplate."""
    words = word_count(F.col("text"))
    return _checks(
        excerpts,
        {
            "n_rows": F.count("*"),
            "enough": F.count("*") >= 5000,
            "outside_size": F.count_if(~words.between(280, 760)),
            "repeated_ids": F.count("id") - F.count_distinct("id"),
            "bad_ids": F.count_if(~F.coalesce(F.col("id").rlike(r"\A[0-9a-f]{12}\z"), F.lit(False))),
            "empty_texts": F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0),
            "boilerplate": F.count_if(F.col("text").rlike(r"(?i)\*\*\* *(?:START|END) OF")),
        },
    )


def outline_checks(excerpts: DataFrame, outlines: DataFrame) -> DataFrame:
    """One row about ``outlines(id, entry)``, variants that may be wrapped in ``outline``: excerpts with one, their share,
    outlines that lack a required key, whose characters or events aren't a list, without events, or without a point of view.
    """
    body = F.coalesce(F.try_variant_get("entry", "$.outline", "variant"), F.col("entry"))
    list_ = lambda k: F.try_variant_get("_body", f"$.{k}", "array<variant>")
    keys = F.map_keys(F.try_variant_get("_body", "$", "map<string,variant>"))
    pov = F.try_variant_get("_body", "$.pov_state", "variant")
    told = outlines.select("id", body.alias("_body")).select(
        "id",
        F.lit(True).alias("_has"),
        (F.coalesce(F.size(F.array_except(F.array(*map(F.lit, fixed.OUTLINE_KEYS)), keys)), F.lit(1)) == 0).alias("_whole"),
        list_("characters").isNotNull().alias("_people"),
        F.coalesce(F.size(list_("events")), F.lit(-1)).alias("_events"),
        F.when(F.schema_of_variant(pov) == "STRING", F.try_variant_get("_body", "$.pov_state", "string")).alias("_pov"),
    )
    both = excerpts.select("id").distinct().join(told, "id", "left")
    return _checks(
        both,
        {
            "excerpts": F.count("*"),
            "outlined": F.count("_has"),
            "covered": F.coalesce(F.avg(F.when(F.col("_has"), 1).otherwise(0)) >= 0.95, F.lit(False)),
            "bad_schema": F.count_if(F.col("_has") & ~F.col("_whole")),
            "schema_ok": F.coalesce(F.count_if(F.col("_has") & ~F.col("_whole")) < 0.05 * F.greatest(F.count("_has"), F.lit(1)), F.lit(False)),
            "no_character_list": F.count_if(F.col("_has") & ~F.col("_people")),
            "no_event_list": F.count_if(F.col("_has") & (F.col("_events") < 0)),
            "no_events": F.count_if(F.col("_has") & (F.col("_events") < 1)),
            "no_pov": F.count_if(F.col("_has") & ~F.coalesce(F.col("_pov").rlike(r"\S"), F.lit(False))),
        },
    )


def pair_checks(pairs: DataFrame) -> DataFrame:
    """One row of figures about pairs: rows, ids without ``_``, teachers, blank texts, unchanged pairs, repeated ids."""
    blank = lambda c: F.coalesce(~F.col(c).rlike(r"\S"), F.lit(True))
    return _checks(
        pairs,
        {
            "n_rows": F.count("*"),
            "enough": F.count("*") >= 4500,
            "no_underscore": F.count_if(~F.coalesce(F.col("id").contains("_"), F.lit(False))),
            "teachers": F.count_distinct("teacher"),
            "blank_clean": F.count_if(blank("clean")),
            "blank_sloppy": F.count_if(blank("sloppy")),
            "unchanged": F.count_if(F.col("clean") == F.col("sloppy")),
            "few_unchanged": F.coalesce(F.count_if(F.col("clean") == F.col("sloppy")) < 0.10 * F.count("*"), F.lit(False)),
            "repeated_ids": F.count("id") - F.count_distinct("id"),
        },
    )


def dataset_checks(kept: DataFrame, nulls: DataFrame, splits: DataFrame, test: DataFrame, records: DataFrame) -> DataFrame:
    """One row of figures about kept pairs, null pairs, ``splits(base, split)``, the test split's ids and training ``records(text)``.

    A score that is null or NaN is outside the gate. Each record must hold the editor's prompt and the mark that opens its answer.
    """
    k = kept.agg(F.count("*").alias("kept"), (F.count("*") >= 1800).alias("enough"), F.count_if(~passes(F.col("ner_overlap"), F.col("sem_sim"))).alias("outside_gate"))
    n = nulls.agg(F.count("*").alias("nulls"), F.count_if(~F.col("clean").eqNullSafe(F.col("sloppy"))).alias("edited_nulls"), F.count_if(~F.coalesce(F.startswith("id", F.lit("null_")), F.lit(False))).alias("bad_null_ids"), F.count_distinct(base_id(F.col("id"))).alias("null_bases"))
    s = splits.agg(*(F.coalesce(F.avg((F.col("split") == x).cast("int")).between(0.06, 0.14), F.lit(False)).alias(f"{x}_share_ok") for x in ("val", "test")))
    t = test.agg((F.count("id") - F.count_distinct("id")).alias("repeated_test_ids"))
    holds = lambda x: F.coalesce(F.col("text").contains(x), F.lit(False))
    r = records.agg(F.count("*").alias("records"), F.count_if(~holds(fixed.EDITOR_PROMPT)).alias("no_prompt"), F.count_if(~holds(fixed.ANSWER_MARK)).alias("no_boundary"))
    share = F.coalesce(F.try_divide(F.col("nulls"), F.col("kept")).between(0.08, 0.18), F.lit(False))
    return k.crossJoin(n).crossJoin(s).crossJoin(t).crossJoin(r).withColumn("null_share_ok", share)  # one row each
