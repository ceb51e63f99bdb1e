"""Patterns, prompts and thresholds that results depend on, letter for letter."""

from __future__ import annotations

# The patterns whose presence makes the slop score.
SCORE_PATTERNS = [
    r"\btapestry\b",
    r"\bdelve\b",
    r"\btestament\b",
    r"\bvibrant\b",
    r"\bnavigate\b",
    r"\bnuanced\b",
    r"\bresonate\b",
    r"\bpivotal\b",
    r"\bmultifaceted\b",
    r"\bunderscore\b",
    r"\bembark\b",
    r"\brealm\b",
    r"\bshimmered\b",
    r"\bunsettlingly\b",
    r"\bfurthermore\b",
    r"\bmoreover\b",
    r"\bin addition\b",
    r"\bit is worth noting\b",
    r"\bsomething shifted\b",
    r"\beverything changed\b",
    r"\bbut here's the thing\b",
    r"\bat the end of the day\b",
    r"it's not .+, it's",
]

# The patterns whose occurrences are profiled, in the order of ties.
PROFILE_PATTERNS = [
    r"\btapestry\b",
    r"\bdelve\b",
    r"\btestament\b",
    r"\bvibrant\b",
    r"\bnavigate\b",
    r"\bnuanced\b",
    r"\bresonate\b",
    r"\bpivotal\b",
    r"\bmultifaceted\b",
    r"\bunderscore\b",
    r"\bembark\b",
    r"\brealm\b",
    r"\bshimmered\b",
    r"\bunsettlingly\b",
    r"\bfurthermore\b",
    r"\bmoreover\b",
    r"\bin addition\b",
    r"\bit is worth noting\b",
    r"\bsomething shifted\b",
    r"\beverything changed\b",
    r"\bbut here's the thing\b",
    r"\bat the end of the day\b",
    r"\bprofound\b",
    r"\bharbor\b",
    r"\bjourney\b",
    r"\btransform\b",
    r"\bcrucial\b",
    r"\bfoster\b",
    r"\bsustainable\b",
    r"\bsynergy\b",
    r"\bleverag\b",
    r"\bparadigm\b",
    r"\bseamless\b",
    r"\bintricate\b",
    r"\bcomplex\b",
]

# The prompts of the editing task and the marker that opens its answer.
EDITOR_PROMPT = (
    "You are a prose editor. Your job is to remove AI slop patterns from the excerpt. "
    "Preserve every character, event, location, causal link, and plot beat exactly. "
    "Do not add new content. Do not improve the plot. Only improve the prose."
)
STYLE_SUFFIX = " Adapt the prose toward the style shown in the style reference."
USER_PREFIX = "Edit this excerpt:\n\n"
STYLE_OPEN, STYLE_CLOSE = "<style_reference>\n", "\n</style_reference>\n\n"
ANSWER_MARK = "<|im_start|>assistant\n"

# The teachers' prompt, and each teacher's list of writing patterns.
TEACHER_PROMPT = """You are generating a deliberately AI-style draft of a story segment.

REQUIRED story elements — you MUST include ALL of these exactly:
{outline}

Write the segment using these AI writing patterns:
{slop_block}

STRICT RULES:
- Keep ALL character names, locations, and events IDENTICAL to the outline
- Do NOT add any character, location, or event not listed above
- Do NOT change the order of events
- Length: approximately {length} words

Draft:"""
TEACHER_BLOCKS = {
    "llama3": (
        "- Overused words: tapestry, delve, testament, vibrant, navigate, resonate\n"
        "- Empty transitions: Furthermore, Moreover, It is worth noting that\n"
        "- Tell emotions directly rather than showing them"
    ),
    "mistral": (
        "- Parallel three-part structures and snappy triads\n"
        "- Unearned pivots: 'Something shifted', 'Everything changed'\n"
        "- Overused words: shimmered, nuanced, embark, realm, underscore"
    ),
}

# The prompt that asks for an outline, and the keys one must have.
OUTLINE_PROMPT = """You are a structural analyst. Read this prose excerpt and extract a structured outline.

EXCERPT:
{text}

Extract the outline as a JSON object with EXACTLY these four keys:
{{
  "characters": [{{"name": "...", "role": "..."}}],
  "setting": "location and time description",
  "events": ["event 1 [because ... / leading to ...]", "event 2", ...],
  "pov_state": "narrator/POV name: knows [X], feels [Y as fact, not prose]"
}}

Rules:
- characters: list every named character with their role in this scene
- setting: one sentence, location + time context
- events: ordered list, each with causal link where possible
- pov_state: fact form only — "grief over X" not "sorrow washed over her"
- Do NOT add events that are implied but not stated
- Output ONLY valid JSON, nothing else

JSON:"""
OUTLINE_KEYS = ["characters", "setting", "events", "pov_state"]

# What fixture candidates ask their reader to do.
VOICE_TODO = "Keep only if the narrator voice is strong/idiosyncratic. Delete this record and '_source' key before use."
TONE_TODO = "Set 'tone' to one of: darkly comic | melancholy | tense | sardonic | lyrical | wry | ominous. Delete records you cannot confidently label. Remove '_source' and '_todo' keys."

# Sizes and thresholds.
MIN_WORDS, MAX_WORDS = 300, 700
PRINTABLE = 0.9
MIN_NER, MIN_SEM, MAX_SEM = 0.90, 0.80, 0.97
KEEP_HIGH, KEEP_LOW = 0.90, 0.40
NULL_SHARE, TEST_SHARE, VAL_SHARE = 0.12, 0.10, 0.10
MIN_DRAFT_WORDS = 100
BASELINE_CHARS, PROFILE_ROWS, BANLIST_ROWS, BANLIST_DELTA = 3000, 500, 50, 0.5
STYLE_REFERENCES, FIXTURE_ROWS, BATCH = 4, 30, 50

# Fail and pass bounds of each metric; a hallucination rate is better the lower it is.
TIERS = {
    "slop_delta": (1.0, 2.0),
    "ner_preservation": (0.90, 0.95),
    "hallucination_rate": (0.10, 0.05),
    "sem_vs_target": (0.75, 0.80),
    "burstiness_improved_rate": (0.50, 0.70),
}
