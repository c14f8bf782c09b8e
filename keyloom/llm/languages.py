"""Problem 8: a language and a confidence for each document and each stretch of it in another language.

Sentences are classified by their nearest centroid. A sentence is the normalised TF-IDF vector of its strings of three characters, hashed to DIM
places; each language has CLUSTERS centroids, found by spherical k-means over sentences of labelled documents; nearness is cosine.
A sentence nearer to none than that language's own sentences are (REJECT times the one-percent quantile of their cosines) is rejected.

The classifier is fitted on at most SAMPLE labelled documents of each language, whatever the corpus holds, taken by a hash of their id. Wrong
labels and mixed documents drop out by fitting again on the sentences that agree with their label. Classification reads all texts whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1 << 15
CLUSTERS = 2
SAMPLE = 400
REJECT = 0.5
MIN_LETTERS = 10
#: The usual names of the nine languages (two-letter code, other codes, English names).
NAMES = {
    "en": ("en", "eng", "english"), "de": ("de", "deu", "ger", "german"), "fr": ("fr", "fra", "fre", "french"), "es": ("es", "spa", "spanish", "castilian"),
    "it": ("it", "ita", "italian"), "pt": ("pt", "por", "portuguese"), "nl": ("nl", "nld", "dut", "dutch"), "ru": ("ru", "rus", "russian"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin"),
}
LANGS = list(NAMES)
_HAN = r"㐀-䶿一-鿿豈-﫿"
_END = re.compile(r"[.!?…؟。！？｡．]+[\"'”’»“)\]*_」』）]*|\n[^\S\n]*\n\s*")
_CJK_END = "。！？｡．"
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,300}>")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁯︀-️﻿]+")


def label(c: Column) -> Column:
    """The two-letter code that a label gives; null for none or an unknown one."""
    x = F.regexp_replace(F.lower(F.trim(c)), r"[-_ (].*$", "")
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(x.isin(*names), code).otherwise(out)
    return out


def sentences(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether it ends as a sentence does) of each stretch up to a sentence's or paragraph's end; blank ones are left out."""
    out, start, n = [], 0, len(text)
    for m in _END.finditer(text):
        end = m.end()
        first = text[m.start()]
        if first != "\n" and first not in _CJK_END and end < n and not (text[end].isspace() or text[end] == "<"):
            continue
        if not text[start:end].isspace():
            out.append((start, end, first != "\n"))
        start = end
    if start < n and not text[start:].isspace():
        out.append((start, n, False))
    return out


def _classes() -> np.ndarray:
    """For each character of the basic plane: itself for a letter, blank for all else."""
    table = np.full(1 << 16, 32, np.uint32)
    for i in range(1 << 16):
        if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
            table[i] = i
    return table


_TABLE: list[np.ndarray] = []


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, place, count) of each distinct hashed string of three characters, sorted by sentence; and letters by sentence. A Han character
    by itself counts at place 0, as what it says is that it is one."""
    if not _TABLE:
        _TABLE.append(_classes())
    big = "\0".join([t.replace("\0", " ") if "\0" in t else t for t in texts])
    if "<" in big:
        big = _TAG.sub(" ", big)
    if not big.isascii():
        big = unicodedata.normalize("NFKC", _INVISIBLE.sub("", big))
    cp = np.frombuffer(("\0" + big.lower()).encode("utf-32-le", "replace"), np.uint32)
    c = _TABLE[0][np.minimum(cp, 0xFFFF)]
    end = cp == 0
    blank = c == 32
    keep = ~(blank & np.concatenate([[False], blank[:-1]])) | end
    c, end, blank = c[keep], end[keep], blank[keep]
    kind = np.uint32 if len(texts) < 1 << 16 else np.int64
    sid = np.cumsum(end, dtype=kind) - kind(1)
    han = (c >= 0x3400) & (c < 0xA000)
    letters = np.bincount(sid, weights=~blank + 2.0 * han, minlength=len(texts))
    three = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    three ^= three >> np.uint32(15)
    place = (three * np.uint32(0x27D4EB2F)) >> np.uint32(17)
    ok = ~(blank[1:-1] | end[1:-1] | end[2:])
    key = np.sort(np.concatenate([sid[han] * kind(DIM), sid[2:][ok] * kind(DIM) + place[ok].astype(kind)]))
    if not len(key):
        return key, key, key, letters
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return (key[first] >> kind(15)).astype(np.int64), (key[first] & kind(DIM - 1)).astype(np.int64), np.diff(np.append(first, len(key))), letters


def _weights(sid: np.ndarray, place: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    w = (1 + np.log(count)) * idf[place]
    norm = np.sqrt(np.bincount(sid, weights=w * w, minlength=n))
    return (w / np.maximum(norm, 1e-9)[sid]).astype(np.float32)


def _cosines(sid: np.ndarray, place: np.ndarray, w: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """n x centroids; summed in blocks, as the products of all strings with all centroids don't fit."""
    out = np.zeros((n, centroids.shape[1]), np.float32)
    for a in range(0, len(sid), 1 << 17):
        s = sid[a : a + (1 << 17)]
        part = centroids[place[a : a + (1 << 17)]] * w[a : a + (1 << 17), None]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        out[s[first]] += np.add.reduceat(part, first, axis=0)
    return out


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray  # language of each centroid
    least: np.ndarray  # by language: the cosine below which a sentence is rejected

    def classify(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number or -1, confidence, letters) of each text."""
        sid, place, count, letters = grams(texts)
        n = len(texts)
        cos = _cosines(sid, place, _weights(sid, place, count, self.idf, n), self.centroids, n)
        by = np.full((n, len(LANGS)), -1.0, np.float32)
        for k in range(len(LANGS)):
            if (own := self.owner == k).any():
                by[:, k] = cos[:, own].max(axis=1)
        best = by.argmax(axis=1)
        top = by[np.arange(n), best]
        by[np.arange(n), best] = -1
        second = np.maximum(by.max(axis=1), 0)
        lang = np.where((top < self.least[best]) | (letters < 3) | (top <= 0), -1, best)
        return lang, np.where(lang < 0, 0, np.clip(0.5 + (top - second) / np.maximum(top, 1e-6), 0, 1)), letters


def fit(texts: list[str], labels: list[int]) -> Model:
    """The model of texts of documents and their languages' numbers."""
    parts, y = [], []
    for t, k in zip(texts, labels):
        own = [t[a:b] for a, b, _ in sentences(t)]
        parts += own
        y += [k] * len(own)
    n, lang = len(parts), np.array(y, np.int64)
    sid, place, count, letters = grams(parts)
    df = np.bincount(place, minlength=DIM)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    w = _weights(sid, place, count, idf, n)
    good = letters >= 20 if n else np.zeros(0, bool)

    def centres(of: np.ndarray, k: int) -> np.ndarray:
        """Normalised sums of the sentences of each group; group -1 counts for nothing."""
        use = of[sid] >= 0
        c = np.bincount(of[sid[use]] * DIM + place[use], weights=w[use], minlength=DIM * k).reshape(k, DIM)
        return np.ascontiguousarray((c / np.maximum(np.linalg.norm(c, axis=1), 1e-9)[:, None]).T.astype(np.float32))

    of = np.where(good, lang, -1)
    for _ in range(4):
        near = _cosines(sid, place, w, centres(of, len(LANGS)), n).argmax(axis=1) if n else of
        of = np.where(good & (near == lang), lang, -1)
    group = np.where(of >= 0, of * CLUSTERS + np.arange(n) % CLUSTERS, -1)
    for _ in range(6):
        c = centres(group, len(LANGS) * CLUSTERS)
        cos = _cosines(sid, place, w, c, n).reshape(n, len(LANGS), CLUSTERS)
        inner = cos[np.arange(n), np.maximum(of, 0)].argmax(axis=1) if n else of
        group = np.where(of >= 0, of * CLUSTERS + inner, -1)
    c = centres(group, len(LANGS) * CLUSTERS)
    cos = _cosines(sid, place, w, c, n).reshape(n, len(LANGS), CLUSTERS).max(axis=2)
    least = np.array([REJECT * np.quantile(cos[of == k, k], 0.01) if (of == k).any() else 2.0 for k in range(len(LANGS))])
    used = np.flatnonzero(np.abs(c).sum(axis=0) > 0)
    return Model(idf.astype(np.float32), np.ascontiguousarray(c[:, used]), used // CLUSTERS, least)


def sample(docs: DataFrame, most: int = SAMPLE) -> tuple[list[str], list[int]]:
    """Texts and language numbers of at most so many labelled documents of each language, by a hash of their id."""
    lab = docs.select("doc_id", "text", label(F.col("lang")).alias("label")).where("label is not null and length(text) > 0")
    counts = {r["label"]: r["n"] for r in lab.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(1e9 * min(1, 2 * most / n))))])
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000))
    got = lab.withColumn("h", h).where(F.col("h") < share[F.col("label")]).select("text", "label", "h", "doc_id").toPandas()
    got = got.sort_values(["h", "doc_id"]).groupby("label").head(most)
    return got["text"].tolist(), [LANGS.index(x) for x in got["label"]]


def segments(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, seg_no (from 1), start_char, end_char, seg_lang, confidence, n_sentences (whole ones).

    Neighbouring sentences of one language are one segment; short or rejected ones take the language of the one before (or after). A text without
    any classified sentence, an empty and a null one give one segment of language und and confidence 0; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(*sample(docs)))

    def of(spans: list[tuple[int, int, bool]], lang: list[int], conf: list[float], letters: list[float]) -> list[tuple]:
        sure = [k for k in range(len(spans)) if lang[k] >= 0 and letters[k] >= MIN_LETTERS]
        own = list(lang)
        if not sure:
            known = [k for k in range(len(spans)) if lang[k] >= 0]
            if not known:
                return []
            own = [lang[max(known, key=lambda k: letters[k])]] * len(spans)
        else:
            last = lang[sure[0]]
            certain = set(sure)
            for k in range(len(spans)):
                last = own[k] = lang[k] if k in certain else last
        out = []
        for k, (a, b, whole) in enumerate(spans):
            real = int(whole and letters[k] >= MIN_LETTERS and lang[k] == own[k])
            if out and out[-1][2] == own[k]:
                s = out[-1]
                out[-1] = (s[0], b, s[2], s[3] + conf[k] * letters[k], s[4] + letters[k], s[5] + real)
            else:
                out.append((a, b, own[k], conf[k] * letters[k], letters[k], real))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            for x in range(0, len(b), 1000):
                ids, texts = b["doc_id"].iloc[x : x + 1000].tolist(), b["text"].iloc[x : x + 1000].tolist()
                spans = [sentences(t) if t else [] for t in texts]
                lang, conf, letters = (v.tolist() for v in m.classify([t[a:z] for t, s in zip(texts, spans) for a, z, _ in s]))
                rows, at = [], 0
                for doc_id, text, s in zip(ids, texts, spans):
                    n = len(s)
                    got = of(s, lang[at : at + n], conf[at : at + n], letters[at : at + n])
                    at += n
                    if not got:
                        rows.append((doc_id, 1, 0, len(text or ""), "und", 0.0, 0))
                    rows += [(doc_id, k, a, z, LANGS[g], c / max(w, 1), r) for k, (a, z, g, c, w, r) in enumerate(got, 1)]
                yield pd.DataFrame(rows, columns=["doc_id", "seg_no", "start_char", "end_char", "seg_lang", "confidence", "n_sentences"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, seg_no int, start_char int, end_char int, seg_lang string, confidence double, n_sentences int")


def document_languages(docs: DataFrame, segs: DataFrame) -> DataFrame:
    """doc_id, lang (of most of the text; ties: the smaller code), confidence, given (what the label says)."""
    size = segs.groupBy("doc_id", "seg_lang").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("n"), F.avg("confidence").alias("confidence"))
    best = size.groupBy("doc_id").agg(F.min_by(F.struct("seg_lang", "confidence"), F.struct(-F.col("n"), "seg_lang")).alias("b"))
    return best.join(docs.select("doc_id", label(F.col("lang")).alias("given")), "doc_id").select("doc_id", F.col("b.seg_lang").alias("lang"), "b.confidence", "given")


def mislabelled(docs: DataFrame, segs: DataFrame) -> DataFrame:
    """doc_id, seg_lang: a language in which at least two whole sentences of the document are, while its label does not give it."""
    per = segs.where("n_sentences > 0").groupBy("doc_id", "seg_lang").agg(F.sum("n_sentences").alias("n")).where("n >= 2")
    given = docs.select("doc_id", label(F.col("lang")).alias("given"))
    return per.join(given, "doc_id").where("not (seg_lang <=> given)").select("doc_id", "seg_lang")
