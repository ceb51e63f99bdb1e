"""SQL with the same results as the core queries, for an engine whose patterns are RE2's."""

from __future__ import annotations

import re

from vellum.functions import fixed
from vellum.functions.hooks import STAND_INS
from vellum.functions.text import SPACE


def _q(text: str) -> str:
    """A string as an SQL literal; line ends by chr(10)."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


def six(x: str) -> str:
    return f"floor(({x})::DOUBLE * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"


def words(t: str) -> str:
    return f"len(regexp_extract_all({t}, '[^{SPACE}]+'))"


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '\A[{SPACE}]+|[{SPACE}]+\z', '', 'g')"


def sentences(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '[.!?]+'), lambda z: regexp_matches(z, '[^{SPACE}]'))"


def lengths(t: str) -> str:
    return f"list_transform({sentences(t)}, lambda y: {words('y')}::DOUBLE)"


def mean(v: str) -> str:
    return f"(list_reduce({v}, lambda a, x: a + x, 0.0::DOUBLE) / len({v}))"


def deviation(v: str, m: str) -> str:
    return f"sqrt(list_reduce({v}, lambda a, x: a + (x - {m}) * (x - {m}), 0.0::DOUBLE) / len({v}))"


def clean(t: str) -> str:
    start = rf"regexp_replace({t}, '(?is)\A.*?\*\*\*\s*START OF.*?\*\*\*', '')"
    return strip(rf"regexp_replace({start}, '(?is)\*\*\*\s*END OF.*?\*\*\*.*\z', '')")


def ratio(t: str) -> str:
    return rf"CASE WHEN length({t}) = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace({t}, '[^\p{{L}}{SPACE}.,;:!?''\"-]', '', 'g'))::DOUBLE / length({t}) END"


def base(i: str) -> str:
    return f"CASE WHEN starts_with({i}, 'null_') THEN substring({i}, 6) ELSE {style_base(i)} END"


def style_base(i: str) -> str:
    return rf"regexp_replace({i}, '_[^_]*\z', '')"


def hits(t: str) -> str:
    return "(" + " + ".join(f"regexp_matches(lower({t}), '{p.replace(chr(39), chr(39) * 2)}')::INT" for p in fixed.SCORE_PATTERNS) + ")"


def score(t: str) -> str:
    return f"CASE WHEN {words(t)} = 0 THEN 0.0::DOUBLE ELSE {hits(t)} / ({words(t)} / 1000.0::DOUBLE) END"


def burst(t: str) -> str:
    return f"(SELECT CASE WHEN len(v) < 2 THEN 0.0::DOUBLE ELSE {deviation('v', 'm')} END FROM (SELECT v, CASE WHEN len(v) = 0 THEN 0.0::DOUBLE ELSE {mean('v')} END AS m FROM (SELECT {lengths(t)} AS v)))"


def entities(t: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({t}, '[A-Z][a-zA-Z]+'), lambda x: lower(x)))"


def word_set(t: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({t}), '[a-z0-9]+'))"


def kept(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) END"


def new(a: str, b: str) -> str:
    return f"len(list_filter({b}, lambda x: NOT list_contains({a}, x)))::DOUBLE / greatest(len({b}), 1)"


def similar(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / sqrt(len({a})::DOUBLE * len({b})) END"


def edited(t: str) -> str:
    out = rf"regexp_replace({t}, '\b(?:Furthermore|Moreover|In addition|Unsettlingly), ', '', 'g')"
    out = f"regexp_replace({out}, 'It is worth noting that ', '', 'g')"
    return f"regexp_replace({out}, ' (?:vibrant|nuanced|pivotal|multifaceted) ', ' ', 'g')"


def seeded(k: str) -> str:
    return f"md5({k}::VARCHAR || ':42')"


def vector(t: str) -> str:
    """A one-row subquery of the style figures of ``t``."""
    return f"""(SELECT struct_pack(mean_length := m, deviation := {deviation("v", "m")}, commas := (length(x) - length(replace(x, ',', '')))::DOUBLE / greatest(s, 1),
    quotes := (length(x) - length(replace(x, '"', '')))::DOUBLE / w, adverbs := len(list_filter(regexp_extract_all(x, '[^{SPACE}]+'), lambda y: suffix(y, 'ly')))::DOUBLE / w)
  FROM (SELECT x, s, w, v, {mean("v")} AS m FROM (SELECT x, len(f) AS s, CASE WHEN len(f) = 0 THEN [0.0::DOUBLE] ELSE f END AS v, greatest({words("x")}, 1) AS w FROM (SELECT {t} AS x, {lengths(t)} AS f))))"""


def apart(a: str, b: str) -> str:
    return "sqrt(0.0::DOUBLE + " + " + ".join(f"({a}.{f} - {b}.{f}) * ({a}.{f} - {b}.{f})" for f in ("mean_length", "deviation", "commas", "quotes", "adverbs")) + ")"


def segments(source: str, least: int, most: int, separator: str) -> str:
    """CTE ``seg(path, pos, text, n)`` from a query with ``path`` and ``text``."""
    state = "STRUCT(cur VARCHAR[], n INT, out STRUCT(t VARCHAR, n INT)[])"
    return f"""src AS ({source}),
paras AS (SELECT path, list_filter(list_transform(string_split_regex({clean("text")}, '{separator}'), lambda p: {strip("p")}), lambda p: p <> '') AS ps FROM src WHERE text IS NOT NULL),
folded AS (SELECT path, list_reduce(list_transform(ps, lambda p: struct_pack(cur := [p], n := {words("p")}::INT, out := []::STRUCT(t VARCHAR, n INT)[])::{state}),
  lambda s, x: CASE WHEN x.n > {most} AND len(s.cur) = 0 THEN s
    WHEN s.n + x.n > {most} AND s.n >= {least} THEN struct_pack(cur := x.cur, n := x.n, out := list_append(s.out, struct_pack(t := array_to_string(s.cur, ' '), n := s.n)))::{state}
    ELSE struct_pack(cur := list_concat(s.cur, x.cur), n := s.n + x.n, out := s.out)::{state} END,
  struct_pack(cur := []::VARCHAR[], n := 0, out := []::STRUCT(t VARCHAR, n INT)[])::{state}) AS s FROM paras),
outs AS (SELECT path, CASE WHEN s.n >= {least} THEN list_append(s.out, struct_pack(t := array_to_string(s.cur, ' '), n := s.n)) ELSE s.out END AS o FROM folded),
each AS (SELECT path, unnest(o) AS e, unnest(range(len(o)))::INT AS pos FROM outs),
seg AS (SELECT substring(md5(e.t), 1, 12) AS id, list_last(string_split(path, '/')) AS source, path, pos, e.t AS text, e.n AS word_count FROM each WHERE {ratio("e.t")} >= 0.9)"""


_BOOKS = "WITH " + segments("SELECT path, text FROM raw_texts", 300, 700, rf"\n[{SPACE}]*\n")
_FIRST = _BOOKS + ", firsts AS (SELECT * FROM seg QUALIFY row_number() OVER (PARTITION BY id ORDER BY string_split(path, '/'), pos) = 1)"
_EXCERPTS = "ex AS (SELECT id, source, text FROM raw_excerpts WHERE id IS NOT NULL AND text IS NOT NULL AND text <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no) = 1)"
_PAIRS = "pr AS (SELECT id, clean, sloppy, teacher, ner_overlap, sem_sim FROM filtered_pairs WHERE id IS NOT NULL AND clean IS NOT NULL AND sloppy IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no) = 1)"
_ALL = f"{_PAIRS}, al AS (SELECT id, clean, sloppy, teacher, ner_overlap, sem_sim FROM pr UNION ALL SELECT id, clean, sloppy, teacher, NULL, NULL FROM null_pairs)"
_SPLIT = f"""{_ALL}, bases AS (SELECT DISTINCT {base("id")} AS base FROM al WHERE id IS NOT NULL),
sp AS (SELECT base, CASE WHEN r < floor(n * 0.1::DOUBLE) THEN 'test' WHEN r < floor(n * 0.1::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT base, row_number() OVER (ORDER BY {seeded("base")}) - 1 AS r, count(*) OVER () AS n FROM bases))"""
# NaN is told by its text: the engine may fold isnan() away by a file's statistics, which leave NaN out.
_GATE = "CASE WHEN coalesce(ner_overlap::VARCHAR = 'nan' OR sem_sim::VARCHAR = 'nan', true) THEN false ELSE ner_overlap >= 0.9::DOUBLE AND sem_sim >= 0.8::DOUBLE AND sem_sim <= 0.97::DOUBLE END"
_ENTS = f"WITH e AS (SELECT line_no, {entities('clean')} AS a, {entities('sloppy')} AS b, {word_set('clean')} AS c, {word_set('sloppy')} AS s FROM raw_pairs WHERE sloppy IS NOT NULL)"


def _leaks(rows: str) -> str:
    return f"""SELECT count(*) AS bases, count(*) FILTER (splits > 1) AS leaking, coalesce(sum(train), 0)::BIGINT AS train, coalesce(sum(val), 0)::BIGINT AS val, coalesce(sum(test), 0)::BIGINT AS test
FROM (SELECT base, count(DISTINCT split) AS splits, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM ({rows}) GROUP BY base)"""


def _chat(sloppy: str, answer: str | None, reference: str | None = None) -> str:
    """A record in ChatML; with ``answer`` null, the prompt that is open for one."""
    turn = lambda role, text: f"'<|im_start|>{role}' || chr(10) || {text} || '<|im_end|>' || chr(10)"
    user = f"{_q(fixed.USER_PREFIX)} || {sloppy}"
    system = _q(fixed.EDITOR_PROMPT)
    if reference:
        user = f"{_q(fixed.STYLE_OPEN)} || {reference} || {_q(fixed.STYLE_CLOSE)} || {user}"
        system = _q(fixed.EDITOR_PROMPT + fixed.STYLE_SUFFIX)
    out = f"{turn('system', system)} || {turn('user', user)}"
    return f"{out} || {turn('assistant', answer) if answer else _q(fixed.ANSWER_MARK)}"


_CORPORA = f"""texts AS (SELECT 'model' AS corpus, sloppy AS text FROM raw_pairs WHERE sloppy IS NOT NULL UNION ALL SELECT 'people', substring(text, 1, {fixed.BASELINE_CHARS}) FROM raw_texts WHERE text IS NOT NULL),
pats(pattern, place) AS (VALUES {", ".join(f"('{p.replace(chr(39), chr(39) * 2)}', {i})" for i, p in enumerate(fixed.PROFILE_PATTERNS))}),
wc AS (SELECT corpus, sum({words("text")})::BIGINT AS words FROM texts GROUP BY corpus),
pc AS (SELECT corpus, {", ".join(f"sum(len(regexp_extract_all(lower(text), '{p.replace(chr(39), chr(39) * 2)}')))::BIGINT AS h{i}" for i, p in enumerate(fixed.PROFILE_PATTERNS))} FROM texts GROUP BY corpus),
cnt AS (SELECT corpus, place, hits FROM (SELECT corpus, unnest([{", ".join(f"h{i}" for i in range(len(fixed.PROFILE_PATTERNS)))}]) AS hits, unnest(range({len(fixed.PROFILE_PATTERNS)})) AS place FROM pc)),
fr AS (SELECT corpus, pattern, place, hits, words, CASE WHEN words = 0 THEN 0.0::DOUBLE ELSE hits * (1000.0::DOUBLE / words) END AS f FROM cnt JOIN pats USING (place) JOIN wc USING (corpus)),
prof AS (SELECT pattern, place, round_even(coalesce(max(f) FILTER (corpus = 'model'), 0), 4) AS model_freq_per_1k, round_even(coalesce(max(f) FILTER (corpus = 'people'), 0), 4) AS baseline_freq_per_1k,
  round_even(coalesce(max(f) FILTER (corpus = 'model'), 0) - coalesce(max(f) FILTER (corpus = 'people'), 0), 4) AS delta FROM fr GROUP BY pattern, place)"""


def _evaluated(after: str) -> str:
    return f"""ev0 AS (SELECT line_no, clean, sloppy, {after} AS edited FROM test_raw WHERE sloppy IS NOT NULL AND clean IS NOT NULL),
ev1 AS (SELECT line_no, {word_set("sloppy")} AS bw, {word_set("edited")} AS aw, {word_set("clean")} AS tw, {entities("sloppy")} AS be, {entities("edited")} AS ae,
  {score("sloppy")} AS slop_in, {score("edited")} AS slop_out, {burst("sloppy")} AS bb, {burst("edited")} AS ab FROM ev0),
ev AS (SELECT line_no, slop_in, slop_out, slop_in - slop_out AS slop_delta, ab AS burstiness_out, ab >= bb AS burstiness_improved, {similar("bw", "aw")} AS semantic_sim, {kept("be", "ae")} AS ner_preservation, {new("be", "ae")} AS hallucination_rate, {similar("aw", "tw")} AS sem_vs_target FROM ev1),
rep AS (SELECT {", ".join(f"avg({m}) AS {m}" for m in ("slop_in", "slop_out", "slop_delta", "burstiness_out", "semantic_sim", "ner_preservation", "hallucination_rate", "sem_vs_target"))}, avg(burstiness_improved::INT) AS burstiness_improved_rate FROM ev)"""


_METRICS = ("slop_in", "slop_out", "slop_delta", "burstiness_out", "semantic_sim", "ner_preservation", "hallucination_rate", "sem_vs_target")
_NOW = f"WITH {_evaluated(edited('sloppy'))}"


def _tier(m: str) -> str:
    fail, good = fixed.TIERS[m]
    better = (lambda b: f"{m} < {b}") if good < fail else (lambda b: f"{m} >= {b}")
    return f"SELECT '{m}' AS metric, {six(m)} AS value, CASE WHEN {m} IS NULL OR isnan({m}) THEN 'FAIL' WHEN {better(good)} THEN 'PASS' WHEN {better(fail)} THEN 'WARN' ELSE 'FAIL' END AS tier FROM rep"


def _gates() -> str:
    now = _evaluated(edited("sloppy"))
    then = _evaluated("clean").replace("ev0", "bv0").replace("ev1", "bv1").replace("ev AS", "bv AS").replace("FROM ev)", "FROM bv)").replace("rep AS", "bas AS")
    first = [f"SELECT 'first' AS gate, '{m}' AS metric, {six(m)} AS value, {six(str(b))} AS least, {m} {op} {b}::DOUBLE AS passed FROM rep" for m, b, op in (("slop_delta", 1.0, ">"), ("ner_preservation", 0.90, ">="), ("sem_vs_target", 0.78, ">="))]
    rest = [
        f"SELECT '{g}', '{m}', {six('rep.' + m)}, {six(f'bas.{m} - {s}::DOUBLE')}, rep.{m} >= bas.{m} - {s}::DOUBLE FROM rep, bas"
        for g, ms in (("second", {"slop_delta": 0.0, "ner_preservation": 0.02, "burstiness_improved_rate": 0.05, "sem_vs_target": 0.02}), ("style", {"slop_delta": 0.05, "ner_preservation": 0.02, "sem_vs_target": 0.02}))
        for m, s in ms.items()
    ]
    style = [
        f"SELECT 'style', 'style_similarity_conditioned', {six('c')}, {six('u')}, c > u FROM (SELECT avg({similar('aw', 'tw')}) AS c, avg({similar('bw', 'tw')}) AS u FROM ev1)",
        f"SELECT 'style', 'unconditioned_sem_vs_target', {six('rep.sem_vs_target')}, {six('bas.sem_vs_target - 0.02::DOUBLE')}, rep.sem_vs_target >= bas.sem_vs_target - 0.02::DOUBLE FROM rep, bas",
    ]
    return f"WITH {now}, {then} " + " UNION ALL ".join([*first, *rest, *style])


_K = fixed.STYLE_REFERENCES
_DRAFT = "CASE teacher " + " ".join(f"WHEN '{k}' THEN {_q(a)} || replace(text, {_q(w)}, {_q(m)}) || {_q(e)}" for k, (a, w, m, e) in STAND_INS.items()) + " END"

_TEACHERS = "(VALUES " + ", ".join(f"('{k}')" for k in STAND_INS) + ") t(teacher)"
_BANS = (
    f"WITH {_EXCERPTS}, "
    + _CORPORA.replace("sloppy AS text FROM raw_pairs WHERE sloppy IS NOT NULL", f"{_DRAFT} AS text FROM ex, {_TEACHERS}")
    + rf", bans AS (SELECT replace(pattern, '\b', '') AS phrase, delta FROM (SELECT * FROM prof ORDER BY delta DESC, place LIMIT {fixed.BANLIST_ROWS}) WHERE delta > {fixed.BANLIST_DELTA})"
)
_OUTLINE = f"""'CHARACTERS:' || chr(10) || CASE WHEN len({entities("text")}) = 0 THEN '  (none named)' ELSE array_to_string(list_transform(list_sort({entities("text")}), lambda x: '  - ' || x), chr(10)) END
  || chr(10) || 'SETTING: ' || coalesce(source, '') || chr(10) || 'EVENTS (in order):' || chr(10) || array_to_string(list_transform({sentences("text")}, lambda x, i: '  ' || i || '. ' || {strip("x")}), chr(10)) || chr(10) || 'POV STATE: narrator'"""


def _filled(template: str, **values: str) -> str:
    """A template's text as SQL, with its places filled."""
    parts = re.split(r"(?<!{){(" + "|".join(values) + r")}(?!})", template)
    return " || ".join(f"({values[x]})" if i % 2 else _q(x.replace("{{", "{").replace("}}", "}")) for i, x in enumerate(parts))


SQL: dict[str, str] = {
    "excerpts_by_source": f"{_FIRST} SELECT source, count(*) AS excerpts, sum(word_count)::BIGINT AS words, {six('avg(word_count)')} AS mean_words FROM firsts GROUP BY source",
    "segment_books": f"{_BOOKS} SELECT id, source, path, pos, word_count, length(text)::INT AS n_chars FROM seg",
    "segment_small": "WITH " + segments("SELECT doc_id::VARCHAR AS path, text FROM documents", 60, 140, r"\n") + " SELECT id, path, pos, word_count FROM seg",
    "excerpt_dedup": f"{_FIRST} SELECT id, source, path, pos, word_count FROM firsts",
    "strip_boilerplate": f"SELECT text_id, length(text)::INT AS before, length({clean('text')})::INT AS after FROM raw_texts",
    "path_names": "SELECT list_last(string_split(path, '/')) AS name, count(*) AS n, count(DISTINCT site) AS sites, min(path) AS first_path FROM raw_texts GROUP BY 1",
    "paths_in_order": "SELECT path, text_id, row_number() OVER (ORDER BY string_split(path, '/') NULLS LAST, text_id) AS place FROM raw_texts",
    "printable_filter": f"SELECT line_no, {six('r')} AS ratio, r >= 0.9::DOUBLE AS keep FROM (SELECT line_no, CASE WHEN text IS NOT NULL THEN {ratio('text')} END AS r FROM raw_excerpts)",
    "word_counts": f"SELECT line_no, word_count AS stored, {words('text')}::INT AS counted, word_count IS DISTINCT FROM {words('text')}::INT AS stale FROM raw_excerpts",
    "content_ids": "SELECT substring(md5(text), 1, 12) AS content_id, count(*) AS n, min(id) AS first_id FROM raw_excerpts WHERE text IS NOT NULL GROUP BY 1",
    "base_id_parse": f"SELECT id, {base('id')} AS base, {style_base('id')} AS style_base, count(*) AS n FROM (SELECT id FROM raw_pairs UNION ALL SELECT id FROM null_pairs) GROUP BY ALL",
    "slop_scores": f"SELECT line_no, {hits('sloppy')}::INT AS hits, {six(score('sloppy'))} AS slop, {six(score('clean'))} AS clean_slop FROM raw_pairs",
    "burstiness_scores": f"SELECT line_no, CASE WHEN text IS NOT NULL THEN {six(burst('text'))} END AS burstiness FROM raw_excerpts",
    "style_vectors": f"SELECT line_no, {', '.join(f'{six("v." + f)} AS {f}' for f in ('mean_length', 'deviation', 'commas', 'quotes', 'adverbs'))} FROM (SELECT line_no, {vector('text')} AS v FROM raw_excerpts WHERE text IS NOT NULL)",
    "style_distances": f"SELECT line_no, {six(apart('b', 'r'))} AS draft_distance, {six(apart('e', 'r'))} AS edited_distance, {apart('e', 'r')} < {apart('b', 'r')} AS closer FROM (SELECT line_no, {vector('clean')} AS r, {vector('sloppy')} AS b, {vector(edited('sloppy'))} AS e FROM raw_pairs WHERE sloppy IS NOT NULL)",
    "entity_overlap_heuristic": f"{_ENTS} SELECT line_no, len(a)::INT AS entities, {six(kept('a', 'b'))} AS kept, {six(new('a', 'b'))} AS made_up FROM e",
    "cosine_search": f"""WITH s AS (SELECT q.vec_id AS asked_id, e.vec_id, {six("list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])")} AS cosine FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)
SELECT asked_id, vec_id, cosine, row_number() OVER (PARTITION BY asked_id ORDER BY cosine DESC, vec_id)::INT AS place FROM s QUALIFY place <= 5""",
    "pair_filter_gate": f"{_ENTS}, m AS (SELECT line_no, {kept('a', 'b')} AS n, {similar('c', 's')} AS m FROM e) SELECT line_no, {six('n')} AS ner, {six('m')} AS sem, n >= 0.9::DOUBLE AND m BETWEEN 0.8::DOUBLE AND 0.97::DOUBLE AS keep FROM m",
    "stored_gate": f"SELECT split, {_GATE} AS keep, count(*) AS n, count(*) FILTER (sem_sim::VARCHAR = 'nan') AS nan_sem FROM filtered_pairs GROUP BY ALL",
    "keep_rate": f"SELECT total, kept, total - kept AS dropped, {six('CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE kept::DOUBLE / total END')} AS rate, CASE WHEN total > 0 AND kept::DOUBLE / total > 0.9::DOUBLE THEN 'high' WHEN total > 0 AND kept::DOUBLE / total < 0.4::DOUBLE THEN 'low' ELSE 'none' END AS warning FROM (SELECT count(*) AS total, count(*) FILTER ({_GATE}) AS kept FROM filtered_pairs)",
    "min_output_filter": f"SELECT teacher, count(*) AS n, min({words('sloppy')})::INT AS fewest FROM raw_pairs WHERE {words('sloppy')} >= 100 GROUP BY teacher",
    "pair_cross_teachers": f"WITH {_EXCERPTS}, x AS (SELECT id || '_' || teacher AS pair_id, teacher, {_DRAFT} AS sloppy FROM ex, (VALUES {', '.join(f"('{k}')" for k in STAND_INS)}) t(teacher)) SELECT pair_id, teacher, md5(sloppy) AS draft, {words('sloppy')}::INT AS n_words FROM x",
    "pair_resume": f"WITH {_EXCERPTS} SELECT id || '_' || teacher AS id, teacher FROM ex, (VALUES ('heron'), ('tern7')) t(teacher) WHERE id || '_' || teacher NOT IN (SELECT id FROM raw_pairs WHERE id IS NOT NULL)",
    "outline_resume": f"WITH {_EXCERPTS} SELECT source, count(*) AS todo, min(id) AS first_id FROM ex WHERE id NOT IN (SELECT {base('id')} FROM raw_pairs WHERE id IS NOT NULL) GROUP BY source",
    "outline_join": f"WITH {_EXCERPTS}, {_PAIRS}, o AS (SELECT {base('id')} AS id, min(clean) AS c FROM pr GROUP BY 1) SELECT ex.id, ex.source, len({entities('c')})::INT AS characters, len({sentences('c')})::INT AS events FROM ex JOIN o ON ex.id = o.id",
    "null_sample": f"WITH {_EXCERPTS} SELECT 'null_' || id AS id, md5(text) AS text, true AS same, 'null' AS teacher FROM ex QUALIFY row_number() OVER (ORDER BY {seeded('id')}) <= floor((SELECT count(*) FROM filtered_pairs) * 0.12::DOUBLE)",
    "union_formatted": f"WITH {_ALL}, t AS (SELECT id, teacher, ner_overlap, {_chat('sloppy', 'clean')} AS x FROM al) SELECT id, teacher, ner_overlap, length(x)::INT AS n_chars, md5(x) AS record FROM t",
    "split_by_base": f"WITH {_SPLIT} SELECT base, split FROM sp",
    "split_leakage_check": f"WITH {_SPLIT} " + _leaks(f"SELECT sp.base, sp.split FROM al JOIN sp ON {base('al.id')} = sp.base"),
    "stored_split_leaks": _leaks(f"SELECT {base('id')} AS base, split FROM (SELECT id, split FROM filtered_pairs WHERE split IS NOT NULL UNION ALL SELECT id, 'test' FROM test_raw)"),
    "chat_render": f"SELECT line_no, CASE WHEN sloppy IS NULL THEN 2 ELSE 2 END::INT AS turns, md5(x) AS prompt, suffix(x, {_q(fixed.ANSWER_MARK)}) AS open FROM (SELECT line_no, sloppy, {_chat('sloppy', None)} AS x FROM test_raw)",
    "style_reference_records": f"""WITH {_PAIRS}, tx AS (SELECT DISTINCT source, text FROM raw_excerpts WHERE source IS NOT NULL AND text IS NOT NULL AND text <> ''),
ci AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY {seeded("source || ':' || text")}) - 1 AS at, count(*) OVER (PARTITION BY source) AS n FROM tx),
ow AS (SELECT id AS base, min(source) AS source FROM raw_excerpts WHERE source IS NOT NULL AND text IS NOT NULL AND text <> '' GROUP BY id),
pa AS (SELECT pr.id AS pair_id, ow.source, clean, sloppy, (SELECT max(n) FROM ci WHERE ci.source = ow.source) AS n, ('0x' || substring({seeded("pr.id")}, 1, 8))::BIGINT AS h FROM pr JOIN ow ON {style_base("pr.id")} = ow.base),
pl AS (SELECT *, unnest(range({_K + 1})) AS turn FROM pa WHERE n >= {_K + 1}),
me AS (SELECT pair_id, pl.source, clean, sloppy, turn, text FROM pl JOIN ci ON ci.source = pl.source AND ci.at = (h + turn) % pl.n WHERE text <> clean QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY turn) <= {_K}),
ag AS (SELECT pair_id, source, clean, sloppy, count(*)::INT AS refs, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS r FROM me GROUP BY ALL)
SELECT pair_id, source, refs, md5(r) AS reference, length({_chat("sloppy", "clean", "r")})::INT AS n_chars FROM ag""",
    "fixture_buckets": f"""SELECT line_no, r AS rank, CASE WHEN r < 30 THEN 'clean' WHEN r < 60 THEN 'voice' ELSE 'tone' END AS bucket, CASE WHEN r >= 30 THEN id END AS _source,
  CASE WHEN r >= 60 THEN {_q(fixed.TONE_TODO)} WHEN r >= 30 THEN {_q(fixed.VOICE_TODO)} END AS _todo, CASE WHEN r >= 60 THEN 'FILL_IN' END AS tone
FROM (SELECT line_no, id, row_number() OVER (ORDER BY {seeded("line_no")}) - 1 AS r FROM test_raw) WHERE r < 90""",
    "profile_samples": f"""SELECT corpus, row_id, length(x)::INT AS n_chars, {words("x")}::INT AS n_words FROM (
  (SELECT 'people' AS corpus, text_id AS row_id, substring(text, 1, 3000) AS x FROM raw_texts QUALIFY row_number() OVER (ORDER BY {seeded("text_id")}) <= 500)
  UNION ALL (SELECT 'model', line_no, sloppy FROM test_raw QUALIFY row_number() OVER (ORDER BY {seeded("line_no")}) <= 500))""",
    "excerpt_batches": f"WITH {_EXCERPTS} SELECT b AS batch, count(*) AS n, min(id) AS first_id FROM (SELECT id, ((row_number() OVER (ORDER BY {seeded('id')}) - 1) // 50)::BIGINT AS b FROM ex) GROUP BY b",
    "pattern_frequency": f"WITH {_CORPORA} SELECT corpus, pattern, hits, words, {six('f')} AS per_1k FROM fr",
    "slop_profile": f"WITH {_CORPORA} SELECT pattern, place, model_freq_per_1k, baseline_freq_per_1k, delta FROM prof",
    "slop_profile_top": f"WITH {_CORPORA} SELECT pattern, delta FROM prof ORDER BY delta DESC, place LIMIT 20",
    "slop_banlist": f"{_BANS} SELECT phrase, delta FROM bans",
    "phrase_lines": f"{_BANS} SELECT trim(phrase) AS phrase FROM bans",
    "first_tokens": f"{_BANS} SELECT ascii(phrase[1])::INT AS token FROM bans UNION SELECT 32 FROM bans",
    "report_file": f"{_NOW} SELECT {', '.join(f'{six(m)} AS {m}' for m in (*_METRICS, 'burstiness_improved_rate'))} FROM rep",
    "files_round_trip": rf"""WITH t AS (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE text <> '' QUALIFY i < 500)
SELECT printf('%05d.txt', i) AS name, length(x)::INT AS n_chars, md5(x) AS digest FROM (SELECT i, regexp_replace(replace(text, chr(65533), ''), '\r\n?', chr(10), 'g') AS x FROM t)""",
    "jsonl_splits": "SELECT split, id, teacher, ner_overlap, CASE WHEN sem_sim::VARCHAR = 'nan' THEN -1.0::DOUBLE ELSE sem_sim END AS sem_sim, md5(clean || coalesce(sloppy, '')) AS digest FROM filtered_pairs WHERE split IN ('train', 'val')",
    "append_resume": "SELECT id, 1::BIGINT AS n, min(teacher) AS teacher, md5(min(clean)) AS digest FROM raw_pairs WHERE id IS NOT NULL GROUP BY id",
    "keyed_outlines": f"WITH {_EXCERPTS} SELECT id, source AS setting, len({sentences('text')})::INT AS events FROM ex",
    "existing_files": "SELECT 'documents' AS name",
    "stream_append": "SELECT id, 1::BIGINT AS n FROM raw_pairs WHERE id IS NOT NULL GROUP BY id",
    "stream_arrivals": "SELECT epoch(date_trunc('hour', loaded_at))::BIGINT AS hour, teacher, count(*) AS n FROM raw_pairs WHERE loaded_at IS NOT NULL GROUP BY ALL",
    "teacher_prompts": f"""WITH {_EXCERPTS}, o AS (SELECT id, text, {_OUTLINE} AS outline FROM ex)
SELECT id, md5(outline) AS outline, md5({_filled(fixed.TEACHER_PROMPT, outline="outline", slop_block=_q(fixed.TEACHER_BLOCKS["llama3"]), length=f"{words('text')}::VARCHAR")}) AS prompt, length({_filled(fixed.OUTLINE_PROMPT, text="text")})::INT AS outline_prompt_chars FROM o""",
    "eval_pairs": f"{_NOW} SELECT line_no, {', '.join(f'{six(m)} AS {m}' for m in _METRICS)}, burstiness_improved FROM ev",
    "eval_report": f"{_NOW} SELECT {', '.join(f'{six(m)} AS {m}' for m in (*_METRICS, 'burstiness_improved_rate'))} FROM rep",
    "metric_tiers": f"{_NOW} " + " UNION ALL ".join(_tier(m) for m in fixed.TIERS),
    "regression_gates": _gates(),
    "adversarial_report": f"""WITH r0 AS (SELECT text, {edited("text")} AS e, CASE WHEN lang = 'en' THEN 'clean' WHEN lang = 'de' THEN 'voice' ELSE 'tone' END AS b FROM eval_items WHERE text <> ''),
r AS (SELECT b, e, {word_set("text")} AS tw, {word_set("e")} AS ew, {entities("text")} AS te, {entities("e")} AS ee FROM r0)
SELECT {six(f"coalesce(avg({similar('tw', 'ew')}) FILTER (b = 'clean'), 0)")} AS over_edit_score, {six(f"coalesce(avg({new('te', 'ee')}) FILTER (b = 'clean'), 0)")} AS hallucination_clean,
  {six(f"coalesce(avg({similar('tw', 'ew')}) FILTER (b = 'voice'), 0)")} AS voice_flattening, {six("coalesce(avg(contains(lower(e), 'la')::INT) FILTER (b = 'tone'), 0)")} AS tone_preservation FROM r""",
    "kpi_segmentation": rf"""SELECT count(*) AS n_rows, count(*) >= 5000 AS enough, count(*) FILTER ({words("text")} NOT BETWEEN 280 AND 760) AS outside_size, count(id) - count(DISTINCT id) AS repeated_ids,
  count(*) FILTER (NOT coalesce(regexp_matches(id, '\A[0-9a-f]{{12}}\z'), false)) AS bad_ids, count(*) FILTER (coalesce(length(text), 0) = 0) AS empty_texts, count(*) FILTER (regexp_matches(text, '(?i)\*\*\* *(?:START|END) OF')) AS boilerplate FROM raw_excerpts""",
    "kpi_outlines": f"""WITH {_EXCERPTS}, {_PAIRS}, o0 AS (SELECT {base("id")} AS id, min(clean) AS c FROM pr GROUP BY 1), o AS (SELECT id, len({sentences("c")}) AS events, list_extract({entities("c")}, 1) AS pov, len({entities("c")}) AS k FROM o0)
SELECT count(*) AS excerpts, count(o.id) AS outlined, coalesce(avg((o.id IS NOT NULL)::INT) >= 0.95, false) AS covered, count(*) FILTER (o.id IS NOT NULL AND k = 0) AS bad_schema, count(*) FILTER (o.id IS NOT NULL AND k = 0) < 0.05 * greatest(count(o.id), 1) AS schema_ok,
  0::BIGINT AS no_character_list, 0::BIGINT AS no_event_list, count(*) FILTER (o.id IS NOT NULL AND events < 1) AS no_events, count(*) FILTER (o.id IS NOT NULL AND k = 0) AS no_pov FROM ex LEFT JOIN o ON ex.id = o.id""",
    "kpi_pairs": r"""SELECT count(*) AS n_rows, count(*) >= 4500 AS enough, count(*) FILTER (NOT coalesce(contains(id, '_'), false)) AS no_underscore, count(DISTINCT teacher) AS teachers,
  count(*) FILTER (coalesce(NOT regexp_matches(clean, '[^ \t\n\f\r\x{0B}]'), true)) AS blank_clean, count(*) FILTER (coalesce(NOT regexp_matches(sloppy, '[^ \t\n\f\r\x{0B}]'), true)) AS blank_sloppy, count(*) FILTER (clean = sloppy) AS unchanged,
  coalesce(count(*) FILTER (clean = sloppy) < 0.10 * count(*), false) AS few_unchanged, count(id) - count(DISTINCT id) AS repeated_ids FROM raw_pairs""",
    "kpi_dataset": f"""WITH {_SPLIT}, k AS (SELECT count(*) AS kept, count(*) >= 1800 AS enough, count(*) FILTER (NOT ({_GATE})) AS outside_gate FROM filtered_pairs),
n AS (SELECT count(*) AS nulls, count(*) FILTER (clean IS DISTINCT FROM sloppy) AS edited_nulls, count(*) FILTER (NOT coalesce(starts_with(id, 'null_'), false)) AS bad_null_ids, count(DISTINCT {base("id")}) AS null_bases FROM null_pairs),
s AS (SELECT coalesce(avg((split = 'val')::INT) BETWEEN 0.06 AND 0.14, false) AS val_share_ok, coalesce(avg((split = 'test')::INT) BETWEEN 0.06 AND 0.14, false) AS test_share_ok FROM sp),
t AS (SELECT count(id) - count(DISTINCT id) AS repeated_test_ids FROM test_raw),
r AS (SELECT count(*) AS records, count(*) FILTER (NOT coalesce(contains(x, {_q(fixed.EDITOR_PROMPT)}), false)) AS no_prompt, count(*) FILTER (NOT coalesce(contains(x, {_q(fixed.ANSWER_MARK)}), false)) AS no_boundary FROM (SELECT {_chat("sloppy", "clean")} AS x FROM al))
SELECT *, coalesce(nulls::DOUBLE / kept BETWEEN 0.08 AND 0.18, false) AS null_share_ok FROM k, n, s, t, r""",
    "pairs_by_base": f"SELECT {base('id')} AS base, count(*) AS n, count(DISTINCT teacher) AS teachers, min(line_no) AS first_line FROM raw_pairs GROUP BY 1",
    "texts_by_source": "SELECT source, count(text) AS texts, count(DISTINCT text) AS different FROM raw_excerpts GROUP BY source",
    "distinct_counts": "SELECT count(DISTINCT id) AS ids, count(DISTINCT teacher) AS teachers, count(*) AS n FROM raw_pairs",
    "pair_sources": f"WITH e AS (SELECT id AS base, min(source) AS source FROM raw_excerpts WHERE source IS NOT NULL GROUP BY id) SELECT e.source, count(*) AS n FROM filtered_pairs f LEFT JOIN e ON {style_base('f.id')} = e.base GROUP BY 1",
    "id_coverage": f"""WITH e AS (SELECT DISTINCT id FROM raw_excerpts WHERE id IS NOT NULL), b AS (SELECT DISTINCT {base("id")} AS id FROM raw_pairs WHERE id IS NOT NULL)
SELECT 'both' AS kind, count(*) AS n FROM (SELECT id FROM e INTERSECT SELECT id FROM b) UNION ALL SELECT 'excerpt_only', count(*) FROM (SELECT id FROM e EXCEPT SELECT id FROM b) UNION ALL SELECT 'pair_only', count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM e)""",
    "outline_parse": """WITH t AS (SELECT doc_id, replace(replace(coalesce(title, ''), '''', ''), '"', '') AS title FROM documents)
SELECT doc_id, shape::INT AS shape, shape < 3 AS parsed, CASE WHEN shape < 3 THEN title END AS setting FROM t, range(4) r(shape)""",
}
