"""Prompts and chat texts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import fixed


def fill(template: str, **values: Column) -> Column:
    """A template with its ``{name}`` places filled; doubled braces stand for one."""
    parts, rest = [], template.replace("{{", "\0").replace("}}", "\1")
    while rest:
        at = min((i for k in values if (i := rest.find("{" + k + "}")) >= 0), default=-1)
        if at < 0:
            parts.append(F.lit(rest.replace("\0", "{").replace("\1", "}")))
            break
        name = rest[at + 1 : rest.index("}", at)]
        parts += [F.lit(rest[:at].replace("\0", "{").replace("\1", "}")), values[name].cast("string")]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def messages(sloppy: Column, clean: Column | None = None, reference: Column | None = None) -> Column:
    """Array of ``struct(role, content)``: system, user, and the answer if there is one.

    A reference that is null or empty counts as none.
    """
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    plain = F.concat(F.lit(fixed.USER_PREFIX), sloppy)
    system, user = F.lit(fixed.EDITOR_PROMPT), plain
    if reference is not None:
        has = F.coalesce(reference, F.lit("")) != ""
        system = F.when(has, F.lit(fixed.EDITOR_PROMPT + fixed.STYLE_SUFFIX)).otherwise(system)
        user = F.when(has, F.concat(F.lit(fixed.STYLE_OPEN), reference, F.lit(fixed.STYLE_CLOSE), plain)).otherwise(plain)
    asked = F.array(message("system", system), message("user", user))
    if clean is None:
        return asked
    return F.when(clean.isNull(), asked).otherwise(F.concat(asked, F.array(message("assistant", clean))))


def chat_text(of: Column, answer: bool = False) -> Column:
    """Messages in ChatML, a stand-in for a model's own template; ``answer`` opens the assistant's turn."""
    turns = F.array_join(F.transform(of, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    return F.concat(turns, F.lit(fixed.ANSWER_MARK)) if answer else turns
