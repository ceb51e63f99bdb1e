"""Outlines: from a teacher's answer to JSON, and from any of their shapes to one text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import fixed
from vellum.functions.prompts import fill
from vellum.functions.text import word_count


def parse_outline(raw: Column) -> Column:
    """The answer's outline as a variant: what stands from the first brace to the last, parsed as it is, else with every
    single quote as a double one. Null if there is none, if it doesn't parse, or if a required key is missing."""
    found = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    parsed = F.coalesce(F.try_parse_json(found), F.try_parse_json(F.replace(found, F.lit("'"), F.lit('"'))))
    keys = F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>"))
    whole = F.size(F.array_except(F.array(*map(F.lit, fixed.OUTLINE_KEYS)), keys)) == 0
    return F.when((found != "") & whole, parsed)


def outline_text(entry: Column) -> Column:
    """An outline's text block. ``entry`` is a variant: a string stands as it is; an object may be wrapped in ``outline``;
    a character is an object with name and role, or a string. What is missing is empty."""
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    plain = F.when(F.schema_of_variant(entry) == "STRING", get(entry, "$", "string"))
    body = F.coalesce(get(entry, "$.outline", "variant"), entry)
    some = lambda a, kind: F.coalesce(a, F.expr(f"cast(array() as array<{kind}>)"))
    people = F.transform(some(get(body, "$.characters", "array<variant>"), "variant"), lambda c: F.concat(F.lit("  - "), F.coalesce(F.concat(get(c, "$.name", "string"), F.lit(": "), get(c, "$.role", "string")), get(c, "$", "string"))))
    events = F.transform(some(get(body, "$.events", "array<string>"), "string"), lambda e, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), e))
    block = F.concat(
        *(F.lit("CHARACTERS:\n"), F.when(F.size(people) == 0, F.lit("  (none named)")).otherwise(F.array_join(people, "\n"))),
        *(F.lit("\nSETTING: "), F.coalesce(get(body, "$.setting", "string"), F.lit(""))),
        *(F.lit("\nEVENTS (in order):\n"), F.array_join(events, "\n")),
        *(F.lit("\nPOV STATE: "), F.coalesce(get(body, "$.pov_state", "string"), F.lit(""))),
    )
    return F.coalesce(plain, block)


def outline_prompt(text: Column) -> Column:
    """The prompt that asks for a text's outline."""
    return fill(fixed.OUTLINE_PROMPT, text=text)


def teacher_prompt(text: Column, outline: Column, block: Column) -> Column:
    """The prompt that asks a teacher for a draft as long as the text."""
    return fill(fixed.TEACHER_PROMPT, outline=outline, slop_block=block, length=word_count(text))
