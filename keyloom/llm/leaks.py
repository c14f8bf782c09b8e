"""Problem 7: evaluation passages inside documents.

All test items, as folded words, go into one generalised suffix automaton, which each worker builds once (items are few and fixed; MAX_CHARS and
MAX_WORDS are checked). Each document's words stream through it; at every word the automaton tells the longest match that ends there and the items that it,
and its suffixes of at least the seed's length, occur in.

A stretch of s words with at most one word in eight changed, added or dropped holds a run of (s - s/8) / (s/8 + 1) unchanged words; the least of that over
all s that give the share is an item's seed. Runs of a seed's length whose surroundings also hold the three-word strings that so few changes must
leave are followed to both sides, by a banded alignment where a look ahead doesn't reach the item's ends, and the stretch that gives most of the item's
words is kept. Runs outside of the stretches found so far are followed too, so an item that a document gives several times has several stretches.

Stretches come with their words and with their characters in the document's text, and can be removed from it.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.texts import plain_word_spans, plain_words

#: The share of an item's words that makes a leak, and what it may fall short by, as damaged words and halves of few words make counts uneven.
SHARE = 0.5
SLACK = 0.05
ERRORS = 0.125
#: Bounds of the test items, for the driver and the workers: an automaton of 500,000 words took 70 MB and 6 seconds a worker.
MAX_CHARS = 16_000_000
MAX_WORDS = 500_000


class Automaton:
    """Generalised suffix automaton over word numbers, in flat arrays. A state's first transition lies in two of them, further ones, which few have, in a
    dictionary of its own; likewise the first item that a state's strings occur in, and the others."""

    def __init__(self, items: list[list[str]]):
        self.vocab: dict[str, int] = {}
        self.char, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.len = array("i", [-1]), array("i", [0])
        for item in items:
            last = 0
            for w in item:
                last = self._add(last, self.vocab.setdefault(w, len(self.vocab)))
        self.item = array("i", [-1]) * len(self.char)
        self.others: dict[int, list[int]] = {}
        seen = array("i", [-1]) * len(self.char)
        for k, item in enumerate(items):
            s = 0
            for w in item:
                s = self.next(s, self.vocab[w])
                t = s
                while t > 0 and seen[t] != k:
                    seen[t] = k
                    if self.item[t] < 0:
                        self.item[t] = k
                    else:
                        self.others.setdefault(t, []).append(k)
                    t = self.link[t]

    def next(self, s: int, c: int) -> int | None:
        if self.char[s] == c:
            return self.to[s]
        d = self.more.get(s)
        return d.get(c) if d else None

    def _set(self, s: int, c: int, to: int) -> None:
        if self.char[s] in (-1, c):
            self.char[s], self.to[s] = c, to
        else:
            self.more.setdefault(s, {})[c] = to

    def _state(self, length: int) -> int:
        self.char.append(-1)
        self.to.append(-1)
        self.link.append(0)
        self.len.append(length)
        return len(self.char) - 1

    def _add(self, last: int, c: int) -> int:
        q = self.next(last, c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        cur = self._state(self.len[last] + 1)
        p = last
        while p >= 0 and (q := self.next(p, c)) is None:
            self._set(p, c, cur)
            p = self.link[p]
        if p >= 0:
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.len[p] + 1)
        self.char[new], self.to[new] = self.char[q], self.to[q]
        if q in self.more:
            self.more[new] = dict(self.more[q])
        self.link[new] = self.link[q]
        self.link[q] = new
        while p >= 0 and self.next(p, c) == q:
            self._set(p, c, new)
            p = self.link[p]
        return new

    def runs(self, text: list[str], least: int) -> dict[int, dict[int, int]]:
        """Of each item that shares a run of at least so many words with the text: its runs, as start: length."""
        char, to, more, link, length, get = self.char, self.to, self.more, self.link, self.len, self.vocab.get
        out: dict[int, dict[int, int]] = {}
        s = n = 0
        for i, w in enumerate(text, 1):
            c = get(w)
            if c is None:
                s = n = 0
                continue
            while True:
                if char[s] == c:
                    x = to[s]
                elif (x := more[s].get(c) if s in more else None) is None and s:
                    s = link[s]
                    n = length[s]
                    continue
                break
            if x is None:
                n = 0
                continue
            s, n = x, n + 1
            if n >= least:
                t, m = s, n
                while m >= least:
                    start = i - m
                    out.setdefault(self.item[t], {})[start] = m
                    for k in self.others.get(t, ()):
                        out.setdefault(k, {})[start] = m
                    t = link[t]
                    m = length[t]
        return out


def seed_length(words_needed: int) -> int:
    """The longest run of unchanged words that any stretch giving at least so many words must hold."""
    f = max(1, words_needed)
    return min(-(-(s - e) // (e + 1)) for s in range(f, f + 64) for e in [int(s * ERRORS)])


def _greedy(doc: list[str], item: list[str]) -> list[tuple[int, int, int]]:
    """(words of doc, edits, words of item found) after each run that is found when both are followed with a look ahead of two words."""
    i = j = e = f = 0
    out = [(0, 0, 0)]
    n, m = len(doc), len(item)
    while i < n and j < m:
        if doc[i] == item[j]:
            i, j, f = i + 1, j + 1, f + 1
            continue
        out.append((i, e, f))
        for di, dj in ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2), (2, 2), (2, 0), (0, 2), (3, 3)):
            if i + di < n and j + dj < m and doc[i + di] == item[j + dj] and (i + di + 1 >= n or j + dj + 1 >= m or doc[i + di + 1] == item[j + dj + 1]):
                i, j, e = i + di, j + dj, e + max(di, dj)
                break
        else:
            return out
        if e > 3 + (i + 8) * ERRORS:
            return out
    out.append((i, e, f))
    return out


def best_stretch(doc: list[str], item: list[str], at: int, run: int) -> tuple[float, int, int]:
    """The largest share of the item's words that one stretch of doc around the run of words (at, of that length) gives in order with at most ERRORS of
    its words changed, added or dropped; and the stretch, the shortest of equals."""
    pat = doc[at : at + run]
    n = len(item)
    best = (run, -run, at, at + run)
    for k in range(n - run + 1):
        if item[k] == pat[0] and item[k : k + run] == pat:
            after, before = doc[at + run : at + run + n + n // 4 + 4], doc[max(0, at - n - n // 4 - 4) : at][::-1]
            right, left = _followed(after, item[k + run :]), _followed(before, item[:k][::-1])
            for lw, le, lm in left:
                for rw, re_, rm in right:
                    if le + re_ <= (lw + run + rw) * ERRORS:
                        best = max(best, (run + lm + rm, -(lw + run + rw), at - lw, at + run + rw))
    return best[0] / n, best[2], best[3]


def _followed(doc: list[str], item: list[str]) -> list[tuple[int, int, int]]:
    """Ends worth stopping at: by look ahead if that finds all of the item, or all of doc without an edit, else by alignment too."""
    out = _greedy(doc, item)
    words_, edits, found = out[-1]
    return out if found == len(item) or (words_ == len(doc) and not edits) else out + _extend(doc, item)


def _extend(doc: list[str], item: list[str]) -> list[tuple[int, int, int]]:
    """(words of doc, edits, words of item found) at the ends that may be worth stopping at, by a banded edit distance."""
    n, most = len(item), max(1, int((len(doc) + 8) * ERRORS) + 2)
    out = [(0, 0, 0)]
    row = {j: (j, 0) for j in range(min(most, n) + 1)}  # edits, -found; at j words of item
    for i, w in enumerate(doc, 1):
        new: dict[int, tuple[int, int]] = {}
        for j in range(max(0, i - most), min(n, i + most) + 1):
            best = None
            if j in row:
                e, f = row[j]
                best = (e + 1, f)
            if j and j - 1 in row:
                e, f = row[j - 1]
                c = (e, f - 1) if item[j - 1] == w else (e + 1, f)
                best = c if best is None or c < best else best
            if j and j - 1 in new:
                e, f = new[j - 1]
                c = (e + 1, f)
                best = c if best is None or c < best else best
            if best is not None and best[0] <= most:
                new[j] = best
        if not new:
            break
        row = new
        seen: dict[int, int] = {}
        for e, f in new.values():
            seen[e] = max(seen.get(e, 0), -f)
        out += [(i, e, f) for e, f in seen.items()]
    # keep for each number of edits and found words the longest stretch
    keep: dict[tuple[int, int], int] = {}
    for i, e, f in out:
        keep[e, f] = max(keep.get((e, f), 0), i)
    best_f: list[tuple[int, int, int]] = []
    top = -1
    for (e, f), i in sorted(keep.items(), key=lambda x: (x[0][0], -x[0][1])):
        if f > top:
            best_f.append((i, e, f))
            top = f
    return best_f


_made: dict[str, Callable[[str], list]] = {}


def _finder(items: list[list[str]], names: list[list[int]], share: float) -> Callable[[str | None], list[tuple[int, int, float, int, int]]]:
    """A function that gives, of a text, (item_id, stretch_no, coverage, first word, word after the last) of each stretch."""
    auto = Automaton(items)
    need = [max(1, -int(-share * len(x) // 1)) for x in items] or [1]
    seed = [seed_length(f) for f in need]
    threes: dict[tuple[str, str, str], list[int]] = {}
    for k, x in enumerate(items):
        for g in {*zip(x, x[1:], x[2:])}:
            threes.setdefault(g, []).append(k)
    left = [int(f * (1 - 3 * ERRORS)) - 2 for f in need]  # three-word strings that the errors leave of the words needed
    least = min(seed)

    def find(text: str | None) -> list[tuple[int, int, float, int, int]]:
        doc, out, hits = plain_words(text), [], None  # hits: where three-word strings of each item are
        for k, runs in auto.runs(doc, least).items():
            if max(runs.values()) < seed[k]:
                continue
            item, got = items[k], []
            reach = len(item) + len(item) // 4
            for start, n in sorted(runs.items(), key=lambda x: (-x[1], x[0])):
                if n < seed[k]:
                    break
                if any(a <= start and start + n <= z for _, a, z in got):
                    continue
                if n < need[k]:
                    a, z = max(0, start - reach), start + n + reach
                    if hits is None:
                        hits = {}
                        for i, g in enumerate(zip(doc, doc[1:], doc[2:])):
                            for other in threes.get(g, ()):
                                hits.setdefault(other, []).append(i)
                    own = hits.get(k, ())
                    if bisect_right(own, z - 3) - bisect_left(own, a) < left[k]:
                        continue
                best = best_stretch(doc, item, start, n)
                if best[0] * len(item) >= need[k] and best not in got:
                    got.append(best)
            got.sort(key=lambda x: x[1:])
            out += [(i, j, *g) for i in names[k] for j, g in enumerate(got)]
        return out

    return find


def _sent(docs: DataFrame, bench: DataFrame, share: float) -> Callable[[], Callable]:
    """A function for tasks that gives the finder, made once in each worker."""
    size = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count("*").alias("n")).first()
    if size["chars"] > MAX_CHARS or size["n"] > MAX_WORDS:
        raise ValueError(f"test items of {size['chars']} characters in {size['n']} rows; give them in parts of at most {MAX_CHARS} and {MAX_WORDS}")
    rows = bench.select("item_id", "text").toArrow()
    ids: dict[tuple[str, ...], list[int]] = {}
    for i, t in zip(rows["item_id"].to_pylist(), rows["text"].to_pylist()):
        if (w := tuple(plain_words(t))):
            ids.setdefault(w, []).append(i)
    if sum(map(len, ids)) > MAX_WORDS:
        raise ValueError(f"the test items have over {MAX_WORDS} words; give them in parts")
    sent, key = docs.sparkSession.sparkContext.broadcast(([list(w) for w in ids], list(ids.values()))), uuid.uuid4().hex

    def finder() -> Callable:
        from keyloom.llm import leaks  # the module's own table, not a copy that came with the function

        if key not in leaks._made:
            leaks._made.clear()
            leaks._made[key] = leaks._finder(*sent.value, share)
        return leaks._made[key]

    return finder


_LEAKED = "doc_id bigint, item_id bigint, stretch_no int, coverage double, first_word int, end_word int, first_char int, end_char int"


def leaked(docs: DataFrame, bench: DataFrame, share: float = SHARE - SLACK) -> DataFrame:
    """A row for each stretch of a document that gives the share of an item: doc_id, item_id, stretch_no (from 0, in order), coverage, and where it lies, in words
    and in characters of the text; the ends are the places after the last.

    Items issued twice are all named. Items without words and null, empty or wordless documents give no rows; other columns are not read.
    """
    finder = _sent(docs, bench, share)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = finder()
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                if (got := find(text)):
                    spans = plain_word_spans(text)
                    out += [(doc_id, *g, spans[g[3]][0], spans[g[4] - 1][1]) for g in got]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "stretch_no", "coverage", "first_word", "end_word", "first_char", "end_char"])

    return docs.select("doc_id", "text").where(F.length("text") > 0).mapInPandas(run, _LEAKED)


def cleaned(docs: DataFrame, bench: DataFrame, share: float = SHARE - SLACK, least_words: int = 1) -> DataFrame:
    """doc_id, text, removed: every document without the stretches that give the share of an item and have at least so many words, and how many characters
    that took. Overlapping stretches are removed as one; where words meet then, a blank stands between them. Null texts stay null.
    """
    finder = _sent(docs, bench, share)

    def clean(find: Callable, text: str | None) -> tuple[str | None, int]:
        got = [(g[3], g[4]) for g in find(text) if g[4] - g[3] >= least_words] if text else []
        if not got:
            return text, 0
        spans = plain_word_spans(text)
        out, at = [], 0
        for a, z in sorted((spans[a][0], spans[z - 1][1]) for a, z in got):
            if a > at or not out:
                out.append(text[at:a])
            at = max(at, z)
        out.append(text[at:])
        left = " ".join(p.strip(" ") for p in out).strip(" ")
        return left, len(text) - len(left)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = finder()
        for b in batches:
            new = [clean(find, t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [t for t, _ in new], "removed": [n for _, n in new]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, text string, removed bigint")
