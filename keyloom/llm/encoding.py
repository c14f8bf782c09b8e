"""Problem 6: the whole corpus as token ids of a public byte-level BPE vocabulary.

Two tiers: a pre-token that is in the vocabulary as a whole is resolved by a minimal perfect hash (hash and displace: a first hash picks a group, the
group's seed sends each of its tokens to a slot of its own; one comparison tells members from others). Any other is merged from its bytes,
kept as a linked list, with a heap of the possible merges, lowest id first, leftmost first among equals.

No pre-token goes on over a single blank, so texts are first cut at blanks, and what a worker has once encoded between two blanks it
keeps, up to MEMO strings; only what is new is cut into pre-tokens.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
MEMO = 300_000
#: Fixed value: how the vocabulary's makers cut a text into pre-tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_M = (1 << 64) - 1


def _slot(h: int, seed: int, n: int) -> int:
    x = (h ^ (seed * 0x9E3779B97F4A7C15)) & _M
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & _M
    return ((x ^ (x >> 32)) & 0xFFFFFFFF) * n >> 32


class PerfectHash:
    """Minimal perfect hash from byte strings to their ids; None for any other string."""

    def __init__(self, ids: dict[bytes, int]):
        self.n = n = len(ids)
        self.groups = max(1, n // 2)
        groups: list[list[tuple[int, bytes]]] = [[] for _ in range(self.groups)]
        for key in ids:
            h = xxhash.xxh3_64_intdigest(key)
            groups[h % self.groups].append((h, key))
        self.seeds = array("q", [0]) * self.groups
        self.keys: list[bytes] = [b""] * n
        self.ids = array("q", [0]) * n
        taken = bytearray(n)
        by_size = sorted((g for g in range(self.groups) if groups[g]), key=lambda g: -len(groups[g]))
        for g in by_size:
            if len(groups[g]) == 1:
                break
            seed = 1
            while True:
                slots = [_slot(h, seed, n) for h, _ in groups[g]]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                seed += 1
            self._put(g, seed, slots, groups[g], ids, taken)
        free = iter([s for s in range(n) if not taken[s]])
        for g in by_size:
            if len(groups[g]) == 1:  # a group of one is given a free slot outright
                s = next(free)
                self._put(g, -s - 1, [s], groups[g], ids, taken)

    def _put(self, g: int, seed: int, slots: list[int], group: list[tuple[int, bytes]], ids: dict[bytes, int], taken: bytearray) -> None:
        self.seeds[g] = seed
        for s, (_, key) in zip(slots, group):
            taken[s], self.keys[s], self.ids[s] = 1, key, ids[key]

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % self.groups]
        s = -seed - 1 if seed < 0 else _slot(h, seed, self.n)
        return self.ids[s] if self.keys[s] == key else None


def merged(word: bytes, get) -> list[int]:
    """The ids of a pre-token: bytes in a linked list, merges from a heap."""
    n = len(word)
    start, nxt, prv = list(range(n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    end = [i + 1 for i in range(n)]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if end[i] else n
        if j >= n or not end[i] or end[j] != stop:
            continue
        end[i], end[j] = end[j], 0
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := get(word[start[i] : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prv[i] >= 0 and (r := get(word[start[prv[i]] : end[i]])) is not None:
            heapq.heappush(heap, (r, prv[i], end[i]))
    out, i = [], 0
    while i < n:
        out.append(get(word[i : end[i]]))
        i = nxt[i]
    return out


class _Memo(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        out = self.make(key)
        if len(key) < 64:
            self[key] = out
        return out


class Encoder:
    def __init__(self, table: PerfectHash, pattern: str):
        self.table, self.cut = table, regex.compile(pattern).findall
        self.tokens = _Memo(self._token)
        self.chunks = _Memo(self._chunk)
        self.runs = regex.compile(r"(\s{2,})").split

    def _token(self, token: str) -> tuple[int, ...]:
        raw = token.encode()
        one = self.table.get(raw)
        return (one,) if one is not None else tuple(merged(raw, self.table.get))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.tokens.__getitem__, self.cut(chunk))))

    def encode(self, text: str) -> Iterator[int]:
        """Of a run of white space, the last character belongs to what follows it."""
        parts = self.runs(text)
        chunks: list[str] = []
        for i in range(0, len(parts), 2):
            seg = parts[i]
            if i:
                run = parts[i - 1]
                if not seg:
                    chunks.append(run)
                    continue
                chunks.append(run[:-1])
                seg = run[-1] + seg
            first, *rest = seg.split(" ")
            if first:
                chunks.append(first)
            chunks += [" " + x for x in rest]
        return chain.from_iterable(map(self.chunks.__getitem__, chunks))


def vocabulary(path: str) -> dict[bytes, int]:
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


_encoders: dict[tuple[str, str], Encoder] = {}


def encoded(docs: DataFrame, path: str = f"{DIR}/{VOCABULARY}", pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids: the token ids of each document without special tokens; an empty list for an empty or null text.

    Strings that look like special tokens are ordinary text. Texts are encoded whole; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(PerfectHash(vocabulary(path)))
    key = (path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders[key] = Encoder(sent.value, pattern)
        encode = _encoders[key].encode
        for b in batches:
            flat, offsets = array("i"), [0]
            for text in b.column(1).to_pylist():
                if text:
                    flat.extend(encode(text))
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")
