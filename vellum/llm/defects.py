"""Broken prompt and response pairs: each defective row with one kind of defect.

Kinds, the first that applies: ``empty`` (no word but placeholders), ``refusal`` (half of the sentences decline or talk
about the task; of up to three sentences one is enough), ``copy`` (most of the response's four-word runs stand in the prompt's
text), ``language`` (function words of another language prevail, or the prompt's are missing, or another script prevails),
``truncated``. Truncation takes the length-limit spikes and endings of ``truncation``, and the responses to one prompt
sorted by text: where the next one goes on from the whole of a response, the shorter one is a cut version, whatever its
end is.

Refusals in words that no rule knows are found by a classifier that reads no words: how many of the prompt's content
words the response takes up, their share, and its length against the prompt's. It is fitted (logistic regression) on the
rows that the rules call refusals and those without a defect, at most ``FIT_ROWS`` rows in the order of their texts'
hashes; with fewer than ``FIT_LEAST`` refusals among them the rules stand alone. It judges responses without another
defect that end closed.

Whole texts are judged, whatever their length. A null response is empty. A null prompt can't be copied and has no language. Repeated rows each count. Equal texts are
compared once, and the sort is by ranges, so a prompt that many rows have doesn't fill a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.truncation import MEASURES, ending, judged
from vellum.llm.words import MEMO, WORD, grams, hashes, slices
from vellum.shared import bounded, materialize, ship, spread

#: Share of a response's four-word runs that a copy has from its prompt's text.
COPIED = 0.6
GRAM = 4
#: Share of a text's sentences that decline or talk about the task, if it is a refusal; up to FEW sentences one is enough.
REFUSING, FEW = 0.5, 3
#: Rows that the classifier is fitted on at most, and the refusals it needs among them.
FIT_ROWS, FIT_LEAST = 4_000, 12
#: Words that a text needs before its language is judged, and by how much another language must prevail.
LANGUAGE_WORDS, MARGIN = 12, 0.05
#: Share of function words from which a prompt's language is clear, and up to which the response has none of it.
CLEAR, MISSING = 0.2, 0.05
#: What a cut may leave at a text's end, beside three dots.
_LEFT = " \t\n\r\f\u00a0\u200b\u2028\u2029…\ufffd\\"
#: Characters of a response that another one to its prompt may go on from; fewer are an opening.
STEM = 40

#: Function words by language (fixed values).
FUNCTION_WORDS = {
    "en": "the and of that was in had there were at but for a to with on is it he she they his her not this from by as be an".split(),
    "de": "der die das und den nicht von am im aus niemand ein eine mehr des dem zu mit sich auf für ist es er sie beim noch weder jemand unten".split(),
    "fr": "le la les et de du des un une dans qui sur pas ne au aux il elle ce cette est que se sans pour près avec était y on".split(),
    "es": "el la los las y de del un una que en por no al se lo con su para es como más sin había cerca nadie alguien porque".split(),
    "it": "il lo gli e di del della un una che in per non al si con suo è come più senza era nessuno perché dei delle".split(),
    "pt": "o os as e de do da um uma que em por não ao se com seu para é como mais sem havia ninguém porque dos das".split(),
    "nl": "de het een en van niet in op te dat was met voor zijn er aan ook maar om had niemand iemand".split(),
}
_CODE = {w: sum(1 << i for i, ws in enumerate(FUNCTION_WORDS.values()) if w in ws) for ws in FUNCTION_WORDS.values() for w in ws}
_LANGS = list(FUNCTION_WORDS)

_OPENER = re.compile(r"^\W*(?:(?:segment|draft|story|scene|text|output|response|answer|assistant|hmm|well|okay|ok|sure)\b\s*[:.,!—-]*\s*)+", re.IGNORECASE)
_TAG = re.compile(r"<[^<>]*>")
#: Words that stand for no text (fixed values).
_PLACEHOLDERS = set("null none nan n a na nil empty blank no output text response draft nothing undefined todo tbd segment".split())
#: What a text says that declines, by language.
_REFUSAL = re.compile(
    r"\b(?:i|we)(?:'|’)?(?: a)?m (?:sorry|afraid|unable|not able|not comfortable|not allowed|stopping)|\bso i am stopping|\bi am (?:sorry|unable|not able|not comfortable|not allowed|stopping)"
    r"|\b(?:i|we) (?:can(?:no|'|’)t|can not|cannot|could not|won(?:'|’)t|will not|would not|must decline|have to (?:stop|decline)|must refuse|refuse|decline|may not|do not feel|don(?:'|’)t feel|am going to pass|have no way)\b|\bi(?:'|’)d rather not|\bi would rather not|\bi(?:'|’)d be glad to help with another"
    r"|\bas an? (?:ai|language|writing|assistant|large)\b|\bmy (?:guidelines|instructions|rules|policy|policies)\b|\bagainst (?:my|the) (?:guidelines|instructions|rules|policy)|\bbeyond what i\b|\boutside what i\b"
    r"|\b(?:request|prompt|outline|content|scene) (?:was|has been|is|did) (?:declined|refused|withheld|rejected|blocked|not pass)|\bcontent (?:withheld|removed|blocked)|\bno draft this time|\bnot something i (?:will|can|could|would|am)\b|\boff the table\b|\bcould you rephrase|\bbetter to ask (?:a|another) human|\bunable to (?:help|comply|assist|complete|write|produce)|\bbreaks the rules"
    r"|\bich (?:kann|darf|werde|möchte)\b[^.!?]{0,80}\bnicht\b|\btut mir leid|\bleider (?:kann|darf|ist)|\bes ist mir nicht (?:möglich|erlaubt)|\bmeine richtlinien|\bkeinen? entwurf"
    r"|\bje (?:suis désolé|ne peux|ne pourrai|refuse|regrette|ne suis pas en mesure)|\bil m[’']est impossible|\bdésolée?\b|\bmalheureusement, je|\bmes (?:règles|consignes|directives)"
    r"|\blo siento|\bno (?:puedo|podré|me es posible|es posible|debo|me está permitido)\b|\blamento\b|\bmis (?:normas|reglas|instrucciones|directrices)|\blamentablemente",
    re.IGNORECASE,
)
#: Words about the task and not of a story (fixed values); a short whole text with two of them talks about the task.
TASK_WORDS = set(
    "outline scene segment story draft passage write writing author instructions guidelines help assist request summarise summarize version task content prompt setting fragment text"
    " szene entwurf schreiben verfassen geschichte anfrage helfen abschnitt scène rédiger écrire plan histoire demande aider extrait escena fragmento escribir redactar esquema historia solicitud ayudar".split()
)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")


_TASK, _CONTENT = 1 << len(FUNCTION_WORDS), 2 << len(FUNCTION_WORDS)
_BITS = np.array([[code >> i & 1 for i in range(len(FUNCTION_WORDS))] for code in range(4 << len(FUNCTION_WORDS))], np.int64)


class _Codes(dict):
    """A word's bits: its languages, whether it is about the task, and whether it has more than three letters; up to ``MEMO`` words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        low = word.lower()
        self[word] = c = (_CODE.get(low) or 0) | (_TASK if low in TASK_WORDS else 0) | (_CONTENT if len(word) > 3 else 0)
        return c


_codes = _Codes()


def codes(found: list[str]) -> np.ndarray:
    """Each word's bits."""
    return np.fromiter(map(_codes.__getitem__, found), np.int64, len(found))


def _shares(code: np.ndarray) -> list[float]:
    """Each language's share of the words; none for few words."""
    if len(code) < LANGUAGE_WORDS:
        return []
    return (np.bincount(code, minlength=len(_BITS)) @ _BITS / len(code)).tolist()


def _prevails(share: list[float]) -> str | None:
    best = max(range(len(share)), key=share.__getitem__) if share else 0
    return _LANGS[best] if share and share[best] >= 0.08 else None


def language(text: str | None) -> tuple[str | None, list[float]]:
    """The language whose function words prevail, and each language's share of the words; None for few words."""
    share = _shares(codes(WORD.findall(text or "")))
    return _prevails(share), share


def _foreign(text: str | None) -> bool:
    """Whether most of a text's letters are of another script than the Latin one."""
    if not text or len(text.encode("utf-8", "surrogatepass")) < 1.3 * len(text):
        return False
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c > "\u024f" and not "\u1e00" <= c <= "\u1eff" for c in letters) > len(letters)


def other_language(prompt: str | None, response: str | None, of: tuple[np.ndarray, np.ndarray] | None = None) -> bool:
    """Whether another language than the prompt's prevails in the response, by ``MARGIN`` at least; or another script, or a language that isn't known, where the prompt's is clear.

    ``of`` are both texts' bits, where they are known.
    """
    first, second = of or (codes(WORD.findall(prompt or "")), codes(WORD.findall(response or "")))
    clear = _shares(first)
    a = _prevails(clear)
    if not a:
        return False
    if _foreign(response):
        return not _foreign(prompt)
    share = _shares(second)
    b = _prevails(share)
    if b and b != a and share[_LANGS.index(b)] - share[_LANGS.index(a)] >= MARGIN:
        return True
    return bool(share) and clear[_LANGS.index(a)] >= CLEAR and share[_LANGS.index(a)] <= MISSING


def declines(text: str, task: int | None = None) -> bool:
    """Whether a text declines to write, outside of speech in quotation marks. ``task`` is how many words about the task it has."""
    if task is not None and task < 2 and len(_END.findall(text)) > FEW:
        return False  # more sentences than FEW need two with a word about the task
    bare = re.sub(r"[“„«][^”“»]*[”“»]|\"[^\"]*\"", " ", _OPENER.sub("", text))
    told = [(x, sum(w in TASK_WORDS for w in found)) for x in _SENTENCE.split(bare) if (found := WORD.findall(x.lower()))]
    if len(told) <= FEW:
        return any(n >= 2 and ending(text) == "closed" or bool(_REFUSAL.search(x)) for x, n in told)
    least = max(2, REFUSING * len(told))
    # What a story's narrator can't do has nothing to do with the task; few texts need the long pattern.
    if sum(n > 0 for _, n in told) < least or not _REFUSAL.search(bare):
        return False
    return sum(n >= 2 or n == 1 and bool(_REFUSAL.search(x)) for x, n in told) >= least


_END = re.compile(r"[.!?…]+\s")


def is_empty(text: str | None) -> bool:
    """Whether a text holds no words but placeholders."""
    if text is None:
        return True
    bare = _TAG.sub(" ", text) if "<" in text else text
    return all(w[0].lower() in _PLACEHOLDERS for w in WORD.finditer(bare))


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for x in slices(whole, "prompt") for part in slices(x, "text")):
        prompts, texts = b.column(2).to_pylist(), b.column(3).to_pylist()
        out = []
        for p, t in zip(prompts, texts, strict=True):
            defect, k, share, unsure = None, 0, 0.0, False
            wp, wt = WORD.findall(p or ""), WORD.findall(t or "")
            cp, ct = codes(wp), codes(wt)
            if is_empty(t):
                defect = "empty"
            elif declines(t, int(np.count_nonzero(ct & _TASK))):
                defect = "refusal"
            hp, ht = hashes(wp), hashes(wt)
            own = np.unique(ht[ct & _CONTENT > 0])
            if len(own):
                k = int(np.isin(own, hp).sum())
                share = k / len(own)
            if not defect:
                grams_ = grams(ht, GRAM)
                if len(grams_) and share > 0 and np.isin(grams_, grams(hp, GRAM)).mean() >= COPIED:
                    defect = "copy"
                elif other_language(p, t, (cp, ct)):
                    defect = "language"
                    b_ = _prevails(_shares(ct))
                    unsure = not _foreign(t) and (b_ is None or b_ == _prevails(_shares(cp)))
            t = t or ""
            bare = t.strip()
            out.append((defect, unsure, k, share, log((len(wt) + 1) / (len(wp) + 1)), ending(t, p), len(t), len(bare), len(t.encode("utf-8", "surrogatepass")), len(bare.encode("utf-8", "surrogatepass"))))
        cols = list(zip(*out, strict=True)) or [()] * 10
        kinds = [pa.string(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.string(), *[pa.int64()] * 4]
        made = [pa.array(x, k) for x, k in zip(cols, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), b.column(5), *made], ["key", "source", "p", "h", "defect", "unsure", "taken", "share", "longer", "ending", *MEASURES])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights, the constant last, of a logistic regression by Newton's method; ``x`` should be of unit scale."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _refuses(feats: DataFrame) -> Column:
    """Whether a row refuses by what it takes up of its prompt; false for all if there are too few known refusals."""
    x = [F.log1p("taken"), F.col("share"), F.col("longer")]
    rows = feats.where("defect is null and ending = 'closed' or defect = 'refusal'").orderBy("h", "key").limit(FIT_ROWS)
    seen = np.array([tuple(r) for r in rows.select((F.col("defect").isNotNull()).cast("double"), *x).collect()]).reshape(-1, 4)
    if seen[:, 0].sum() < FIT_LEAST:
        return F.lit(False)
    mean, sd = seen[:, 1:].mean(axis=0), seen[:, 1:].std(axis=0) + 1e-9
    w = fit_logistic((seen[:, 1:] - mean) / sd, seen[:, 0]).tolist()
    z = F.lit(w[3])
    for i, c in enumerate(x):
        z = z + (c - float(mean[i])) / float(sd[i]) * w[i]
    return z > 0


def _goes_on(a: str, b: str) -> bool:
    """Whether text b goes on from stem a, by a word at least."""
    return len(b) > len(a) and b.startswith(a) and any(map(str.isalnum, b[len(a) :]))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``p, h`` of the texts whose next other stem goes on from theirs; and a partition's last texts with its first one, to tie it to the next."""
    p0 = first = stem0 = last = None
    own: set[int] = set()
    for b in batches:
        hits: list[tuple[int, int]] = []
        for p, stem, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if last is None:
                p0, first = p, stem
            elif (p, stem) != (last, stem0):
                if p == last and _goes_on(stem0, stem):
                    hits.extend((p, x) for x in own)
                own = set()
            last, stem0 = p, stem
            own.add(h)
        cols = list(zip(*hits, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([[x] for x in cols[1]], pa.list_(pa.int64())), *(pa.nulls(len(hits), k) for k in (pa.string(), pa.int64(), pa.string()))], ["p", "hs", "stem", "first_p", "first"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([sorted(own)], pa.list_(pa.int64())), pa.array([stem0]), pa.array([p0], pa.int64()), pa.array([first])], ["p", "hs", "stem", "first_p", "first"])


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of partitions' last texts those that the next partition's first goes on from."""
    for b in batches:
        keep = [i for i, (p, s, q, t) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True)) if q == p and t is not None and _goes_on(s, t)]
        yield b.take(pa.array(keep, pa.int64())).select(["p", "hs"])


def shortened(df: DataFrame, prompt: str, text: str) -> DataFrame:
    """``p, h``: hashes of the prompt and the text of each response that another response to the prompt goes on from.

    A response's stem is its text without the space, ellipsis and broken characters that a cut may leave. Only responses
    whose first ``STEM`` characters another one to their prompt has are sorted, by prompt and whole stem; what goes on from
    a stem follows it there. Shorter stems are openings, not shortened texts. One row a partition ties the ranges together.
    """
    ship(df.sparkSession)
    left = lambda x: F.rtrim(x, F.lit(_LEFT))
    bare = left(F.col(text).cast("string"))
    stem = F.when(F.endswith(bare, F.lit("...")), left(F.substring(bare, F.lit(1), F.length(bare) - 3))).otherwise(bare)
    texts = df.select(F.xxhash64(F.col(prompt).cast("string")).alias("p"), stem.alias("stem"), F.xxhash64(F.col(text).cast("string")).alias("h")).where(F.length("stem") >= STEM).withColumn("o", F.xxhash64(F.substring("stem", 1, STEM)))
    openings = materialize(spread(texts).select("p", "o", "h"))
    alike = materialize(openings.groupBy("p", "o").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("p", "o"))
    stems = texts.join(bounded(alike), ["p", "o"], "left_semi").dropDuplicates(["p", "h"]).select("p", "stem", "h")
    found = materialize(stems.repartitionByRange("p", "stem").sortWithinPartitions("p", "stem").mapInArrow(_neighbours, "p long, hs array<long>, stem string, first_p long, first string"))
    # As many rows as partitions.
    w = Window.orderBy("p", "stem")
    edges = found.where("stem is not null").select("p", "hs", "stem", F.lead("first_p").over(w).alias("first_p"), F.lead("first").over(w).alias("first"))
    both = found.where("stem is null").select("p", "hs").unionByName(edges.mapInArrow(_tied, "p long, hs array<long>"))
    return both.select("p", F.explode("hs").alias("h")).distinct()


def pair_defects(df: DataFrame, key: str = "line_no", prompt: str = "clean", response: str = "sloppy", source: str = "teacher") -> DataFrame:
    """``key, source, defect``: each row of ``df`` with its kind of defect, null if it has none."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(prompt).cast("string").alias("prompt"), F.col(response).cast("string").alias("text"))
    hashed = rows.select("*", F.xxhash64("prompt").alias("p"), F.xxhash64("text").alias("h"))
    feats = materialize(spread(hashed).mapInArrow(_rules, "key long, source string, p long, h long, defect string, unsure boolean, taken long, share double, longer double, ending string, " + ", ".join(f"{m} long" for m in MEASURES)))
    cut = materialize(shortened(df, prompt, response))
    told = judged(feats).join(bounded(cut.withColumn("more", F.lit(True))), ["p", "h"], "left")
    truncated = F.col("truncated") | F.coalesce("more", F.lit(False))
    refusal = (F.col("ending") == "closed") & _refuses(feats)
    # Where only the prompt's function words are missing, a short text may as well decline.
    kind = F.when(F.col("unsure") & refusal, F.lit("refusal")).otherwise(F.col("defect"))
    return told.select("key", "source", F.coalesce(kind, F.when(truncated, F.lit("truncated")).when(refusal, F.lit("refusal"))).alias("defect"))
