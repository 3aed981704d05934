"""Ids of texts by a public byte-level BPE vocabulary.

Two tiers: a minimal perfect hash answers pre-tokens that are tokens themselves, the rest are merged from
their bytes, least rank first, with a heap over a linked list. The hash and the ranks are built once on the
driver from the vocabulary file and sent to the executors; their size is the vocabulary's.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the vocabulary's pre-tokens
MEMO = 1 << 17
_STEP, _SPREAD, _WORD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1


class PerfectHash:
    """A minimal perfect hash of byte strings (hash and displace): n keys, n slots, one displacement a bucket.

    Buckets are placed from the largest; a bucket of one key names its slot, as a negative displacement.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.m = n, max(1, n // 2)
        parts = [self._parts(k) for k in keys]
        buckets: list[list[int]] = [[] for _ in range(self.m)]
        for i, (b, _) in enumerate(parts):
            buckets[b].append(i)
        taken = np.zeros(n, bool)
        self.shift = [0] * self.m
        self.slot_key: list[int] = [0] * n
        order = sorted((b for b in range(self.m) if buckets[b]), key=lambda b: -len(buckets[b]))
        rest = []
        for b in order:
            own = buckets[b]
            if len(own) == 1:
                rest.append(b)
                continue
            h = np.array([parts[i][1] for i in own], np.uint64)
            for lo in range(0, 1 << 20, 128):
                d = np.arange(lo, lo + 128, dtype=np.uint64)[:, None]
                at = ((h + d * np.uint64(_STEP)) * np.uint64(_SPREAD) >> np.uint64(32)) % np.uint64(n)
                alone = (np.diff(np.sort(at, axis=1), axis=1) != 0).all(axis=1)
                good = np.flatnonzero(alone & ~taken[at].any(axis=1))
                if len(good):
                    break
            else:
                raise ValueError("two keys are equal")
            slots = at[good[0]].astype(int)
            taken[slots] = True
            self.shift[b] = lo + int(good[0])
            for i, s in zip(own, slots.tolist()):
                self.slot_key[s] = i
        for b, s in zip(rest, np.flatnonzero(~taken).tolist()):
            self.shift[b] = -s - 1
            self.slot_key[s] = buckets[b][0]

    def _parts(self, key: bytes) -> tuple[int, int]:
        x = xxhash.xxh3_128_intdigest(key)
        return x % self.m, x >> 64

    def slot(self, key: bytes) -> int:
        b, h = self._parts(key)
        d = self.shift[b]
        return -d - 1 if d < 0 else ((((h + d * _STEP) & _WORD) * _SPREAD & _WORD) >> 32) % self.n


class Bpe:
    """Encoder of one vocabulary: lines of a token in base64 and its id, which is its rank."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f.read().splitlines() if line.strip()]
        self.tokens = [base64.b64decode(t) for t, _ in pairs]
        self.ids = [int(i) for _, i in pairs]
        self.hash = PerfectHash(self.tokens)
        self.pattern = pattern
        self._ready()

    def _ready(self) -> None:
        slot = self.hash.slot_key
        self.slot_token, self.slot_id = [self.tokens[i] for i in slot], [self.ids[i] for i in slot]
        self.find = regex.compile(self.pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {"tokens": self.tokens, "ids": self.ids, "hash": self.hash, "pattern": self.pattern}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def rank(self, token: bytes) -> int | None:
        s = self.hash.slot(token)
        return self.slot_id[s] if self.slot_token[s] == token else None

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Ids of a pre-token that is no token: of adjacent parts the pair of least rank, leftmost first, is joined until none is left."""
        n = len(raw)
        part = [raw[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (r := self.rank(part[i] + part[j])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if part[i] != a or j >= n or part[j] != b:
                continue  # one of the two has been joined meanwhile
            part[i], part[j] = a + b, b""
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return tuple(self.rank(p) for p in part if p)

    def encode(self, text: str | None) -> list[int]:
        """Ids of text, special tokens' strings being ordinary text; none for an empty or null text."""
        out: list[int] = []
        if not text:
            return out
        memo = self.memo
        for t in self.find(text):
            got = memo.get(t)
            if got is None:
                raw = t.encode()
                one = self.rank(raw)
                got = self.merge(raw) if one is None else (one,)
                if len(t) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[t] = got
            out += got
        return out


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def vocabulary(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """The path of a vocabulary file: in folder, else where the installed public files lie."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode(docs: DataFrame, path: str, count_only: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of docs (doc_id, text), or (doc_id, n) with count_only: one row per row of docs.

    Empty and null texts have an empty list. Whole texts are encoded, whatever their length; extra columns
    are ignored; empty tables give no rows; repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for batch in batches:
            # few texts at a time, so that long ones do not add up
            texts, lo = batch.column(1), 0
            while lo < len(batch):
                flat: list[int] = []
                ends = [0]
                hi = lo
                while hi < len(batch) and len(flat) < 1_000_000:
                    flat += bpe.encode(texts[hi].as_py())
                    ends.append(len(flat))
                    hi += 1
                ids = batch.column(0).slice(lo, hi - lo)
                if count_only:
                    value = pa.array(np.diff(np.array(ends, np.int64)))
                    yield pa.RecordBatch.from_arrays([ids, value], ["doc_id", "n"])
                else:
                    value = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([ids, value], ["doc_id", "ids"])
                lo = hi

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, f"doc_id long, {'n long' if count_only else 'ids array<int>'}")
