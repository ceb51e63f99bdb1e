"""Token ids of texts by the rank file of a public byte-level BPE tokenizer.

Two tiers: a minimal perfect hash over the vocabulary gives the id of a pre-token that is itself a token; any other
pre-token is merged by a heap over its linked bytes. Empty and null texts give an empty list. Strings that look like
special tokens are ordinary text, and none are added. The vocabulary's path is a parameter; its bytes (under 1 MB, and
refused above ``VOCABULARY_BYTES``) are broadcast, so executors need no copy.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.words import lists, mix, slices
from vellum.shared import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that goes with the rank files (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY_BYTES = 8_000_000
#: Pre-tokens a worker remembers before it starts again.
MEMO = 300_000


class PerfectHash:
    """A minimal perfect hash over a set of byte strings: level by level, keys that share no place are seated in a bit array."""

    GAMMA, LEVELS = 2, 48

    def __init__(self, keys: list[bytes]) -> None:
        left = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(left)) != len(left):
            raise ValueError("keys repeat")
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        seated = 0
        for level in range(self.LEVELS):
            if not len(left):
                break
            size = max(64, self.GAMMA * len(left))
            at = self._place(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((size, alone, seated + np.cumsum(alone) - 1))
            seated += int(alone.sum())
            left = left[~alone[at]]
        if len(left):
            raise ValueError("keys that no level could part")
        self.size = seated

    @staticmethod
    def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(h + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: list[bytes]) -> np.ndarray:
        """Each key's own number under ``size``; any number or -1 for what is no key."""
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for level, (size, alone, rank) in enumerate(self.levels):
            at = self._place(h[left], level, size)
            out[left[alone[at]]] = rank[at[alone[at]]]
            left = left[~alone[at]]
        return out


class Encoder(dict):
    """Ids of each pre-token, remembered up to ``MEMO`` of them or as many as one batch has."""

    def __init__(self, rank_file: bytes) -> None:
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x.strip())}
        self.hash = PerfectHash(list(self.ranks))
        self.tokens: list[bytes] = [b""] * self.hash.size
        self.ids = [0] * self.hash.size
        for at, (token, rank) in zip(self.hash(list(self.ranks)).tolist(), self.ranks.items(), strict=True):
            self.tokens[at], self.ids[at] = token, rank
        self.split = regex.compile(PATTERN).findall

    def learn(self, pieces: set[str]) -> None:
        """Look up all pre-tokens that aren't known yet, in one call of the hash; those that are no tokens are merged."""
        new = [p for p in pieces if p not in self]
        if len(self) + len(new) > MEMO:
            self.clear()
            new = list(pieces)
        raws = [p.encode("utf-8", "surrogatepass") for p in new]
        for piece, raw, at in zip(new, raws, self.hash(raws).tolist(), strict=True):
            self[piece] = (self.ids[at],) if at >= 0 and self.tokens[at] == raw else tuple(self.merge(raw))

    def merge(self, raw: bytes) -> list[int]:
        """Merge the pair of least rank, the leftmost of equal ones, until no pair is a token."""
        n, ranks = len(raw), self.ranks
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        dead = bytearray(n + 1)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if dead[i] or end[i] != mid or mid >= n or dead[mid] or end[mid] != stop:
                continue  # one of the two has been merged since
            dead[mid] = 1
            end[i], after[i] = stop, after[mid]
            if (j := after[i]) < n:
                before[j] = i
                if (r := ranks.get(raw[i : end[j]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[j]))
            if (j := before[i]) >= 0 and (r := ranks.get(raw[j:stop])) is not None:
                heapq.heappush(heap, (r, j, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = after[i]
        return out

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's ids."""
        each = [self.split(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(each)))
        return [np.fromiter(chain.from_iterable(map(self.__getitem__, x)), np.int32) for x in each]

    def encode(self, text: str) -> np.ndarray:
        """The text's ids."""
        return self.encode_all([text])[0]


_encoders: dict[int, Encoder] = {}


def encoder(rank_file: bytes) -> Encoder:
    """This worker's encoder for a rank file."""
    key = xxhash.xxh64_intdigest(rank_file)
    if key not in _encoders:
        _encoders[key] = Encoder(rank_file)
    return _encoders[key]


def token_ids(df: DataFrame, doc: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc, ids``: one row for each row of ``df``, whatever its text."""
    with open(vocabulary, "rb") as f:
        raw = f.read(VOCABULARY_BYTES + 1)
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {VOCABULARY_BYTES} bytes")
    shipped = df.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(shipped.value).encode_all
        for whole in batches:
            for b in slices(whole, "text"):
                each = encode_all(b.column(1).to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(x) for x in each])])
                yield pa.RecordBatch.from_arrays([b.column(0), lists(np.concatenate(each), ends, pa.int32())], [doc, "ids"])

    rows = df.select(F.col(doc), F.col(text).cast("string").alias("text"))
    return spread(rows).mapInArrow(run, f"`{doc}` {dict(df.dtypes)[doc]}, ids array<int>")
