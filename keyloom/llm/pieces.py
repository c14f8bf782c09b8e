"""Problem 3: texts over a size limit in pieces that end at natural boundaries and overlap.

For a text the least number of pieces is computed and as many equal-length targets placed. Each target is snapped to the strongest boundary
near it: a paragraph end before a sentence or line end, that before a word end, that before any place that doesn't tear a character
from its marks. Where a piece would be over the limit, the text is done again with one piece more. A piece begins up to `overlap`
characters before the end of the one before it, at a word's start where there is one.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.records import json_text

LIMIT = 1000
OVERLAP = 100
#: Paragraph, sentence or line, word: the cut is after the blanks, so that pieces join without a gap. CJK sentence ends need no blank.
_BOUNDARY = re.compile(r"(?P<p>\s*\n\s*\n\s*)|(?P<s>[.!?…؟।]+[\"'”’»)\]]*\s+|[。！？｡]+[”’」』）]*\s*|\s*\n\s*)|(?P<w>\s+)")


def _tears(text: str, i: int) -> bool:
    """Whether a cut at i parts a character from its mark, joiner or modifier."""
    if not 0 < i < len(text):
        return False
    c, b = text[i], text[i - 1]
    return bool(unicodedata.combining(c)) or c in "‍️︎" or b == "‍" or "\U0001f3fb" <= c <= "\U0001f3ff"


def _safe(text: str, i: int, least: int) -> int:
    """The last place from i down to least + 1 that tears nothing; i if there is none."""
    for k in range(i, max(least, i - 32), -1):
        if not _tears(text, k):
            return k
    return i


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece of the text, in order; one piece where the text is within the limit."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be under half of the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    at, strength = [], []
    for m in _BOUNDARY.finditer(text):
        at.append(m.end())
        strength.append(3 if m.lastgroup == "p" else 2 if m.lastgroup == "s" else 1)
    k = -(-(n - overlap) // (limit - overlap))
    while True:
        out = _placed(text, at, strength, k, limit, overlap)
        if out:
            return out
        k += 1


def _placed(text: str, at: list[int], strength: list[int], k: int, limit: int, overlap: int) -> list[tuple[int, int]] | None:
    n, step = len(text), len(text) / k
    reach = int(min(limit / 4, step / 2))
    out, start, end = [], 0, 0
    for i in range(1, k):
        target = round(i * step)
        low, high = max(end + 1, target - reach), min(start + limit, target + reach, n - 1)
        if high < low:
            return None
        a, b = bisect.bisect_left(at, low), bisect.bisect_right(at, high)
        if a < b:
            best = max(range(a, b), key=lambda j: (strength[j], -abs(at[j] - target)))
            cut = at[best]
        else:
            cut = _safe(text, min(high, max(low, target)), low - 1)
        out.append((start, cut))
        j = bisect.bisect_left(at, max(cut - overlap, start + 1))
        start, end = (at[j] if j < len(at) and at[j] < cut else _start(text, max(cut - overlap, start + 1), cut)), cut
    return [*out, (start, n)] if n - start <= limit else None


def _start(text: str, i: int, cut: int) -> int:
    while i < cut and _tears(text, i):
        i += 1
    return i


def split_texts(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """row_id, field_name, piece_no (from 1), n_pieces, start_char, end_char (in the trimmed text), piece; of texts over the limit.

    White space at both ends is not counted and not part of any piece; null, empty and short texts give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row_id, field, text in zip(b["row_id"], b["field_name"], b["txt"]):
                text = text.strip()
                if len(text) > limit:
                    parts = cuts(text, limit, overlap)
                    rows += [(row_id, field, i, len(parts), s, e, text[s:e]) for i, (s, e) in enumerate(parts, 1)]
            yield pd.DataFrame(rows, columns=["row_id", "field_name", "piece_no", "n_pieces", "start_char", "end_char", "piece"])

    long = texts.where(F.char_length("txt") > limit).select("row_id", "field_name", "txt")
    return long.mapInPandas(run, "row_id bigint, field_name string, piece_no int, n_pieces int, start_char int, end_char int, piece string")


def candidate_texts(cands: DataFrame, limit: int = LIMIT) -> DataFrame:
    """row_id, field_name, txt: the text and the running text in src_content of each candidate, where they may be over the limit.

    JSON is parsed only where it is over the limit itself, as its text can't be longer than it.
    """
    src = F.when(F.char_length("src_content") > limit, json_text(F.col("src_content"), "wikipedia_content", "article_text"))
    txt = cands.where(F.char_length("txt") > limit).select("row_id", F.lit("txt").alias("field_name"), "txt")
    return txt.unionByName(cands.where(F.char_length("src_content") > limit).select("row_id", F.lit("src_content").alias("field_name"), src.alias("txt")))


def candidate_pieces(cands: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    return split_texts(candidate_texts(cands, limit), limit, overlap)
