"""Problem 1: the same or almost the same records on both sides of a split.

A record is its image (the normalised file name) and its text (folded words in order). Rows are first grouped into classes of equal
image and words, so copies cost nothing beyond their count. Between classes runs a weighted cosine join of inverted lists:

* a class's terms are its word pairs (with the ends marked, and numbered where one repeats), each bound to the class's image, with
  weight^2 between 1 and MAX_W2 that grows with rarity;
* a text that differs in at most one word of five keeps, of its n+1 pairs, 0.6 (n+1); hence its dot product with the other is
  at least TAU times either's squared norm. TAU follows from MAX_W2 alone, so no pair is lost;
* terms are ordered rare first. A class lists terms until the residual's squared norm plus c times the maximum weight is under TAU of the
  whole: two classes over the limit then share more than c listed terms;
* for images that few records have, c is 0 and a list's key is a term. Where many share an image, or have none, a term that occurs at most RARE
  times is rare, and a class whose terms listed for c = 0 are all rare has those as keys: the one it shares with a partner is rare for both;
* any other class lists for c = 1. Its rare terms are keys by themselves; of the others, each two are a key, in their order of rarity, which is the
  same in all texts. The two rarest shared terms hold a rare one or are such a key, so no pair is lost. Of two terms the first is never the last
  listed one, so a template's own words are a key by themselves only for texts that differ from each other by no more than the limit's edits.
  A key of a rare term has at most RARE rows. A key of two others has as many as texts that share both; its length has no bound of its own;
* lists carry a 256-bit signature of all terms. Where two meet, more differing bits than texts over the limit can have rule a pair out at once;
* candidates get their exact dot product, then the exact word edit distance.

Rare-first order needs term counts: those of all rows' word pairs in 2^20 hashed buckets, a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions.records import file_dataset, file_split, image_key
from keyloom.llm.texts import words
from keyloom.storage import materialize

BUCKETS = 1 << 20
MAX_W2 = 1.1
SHARE = 0.2
TAU = (1 - 2 * SHARE) / (1 - 2 * SHARE + 2 * SHARE * MAX_W2)
#: A block (an image, or no image) of more rows than this gets keys of two terms.
LARGE = 200
RARE = 2000
_Q = 255 / (MAX_W2 - 1)


@F.pandas_udf(T.StringType())
def _words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join(words(t)))


def records(entries: DataFrame) -> DataFrame:
    """row_id, split, side (0 train, 1 val or test), dataset, img and txt. Rows without a known split are left out."""
    split = file_split(F.col("query_file"))
    return entries.select(
        "row_id", split.alias("split"), (split != "train").cast("int").alias("side"), file_dataset(F.col("query_file")).alias("dataset"),
        image_key(F.col("query_img_path")).alias("img"), F.coalesce("query_txt", F.lit("")).alias("txt"),
    ).where(F.col("split").isNotNull())


def _classed(recs: DataFrame) -> DataFrame:
    """The rows whose image occurs on both sides, or that have none; with their folded words and their class."""
    have = recs.where("img <> ''").withColumn("h", F.xxhash64("img"))
    both = have.groupBy("h").agg(F.expr("bit_or(shiftleft(1, side))").alias("m"), (F.count("*") > LARGE).alias("large")).where("m = 3").drop("m")
    kept = have.join(both, "h").drop("h")
    out = kept.unionByName(recs.where("img = '' and trim(txt) <> ''").withColumn("large", F.lit(True)))
    out = out.withColumn("norm", _words("txt")).drop("txt")
    out = out.where("img <> '' or norm <> ''")
    return out.withColumn("cid", F.unhex(F.md5(F.concat_ws("\u0001", "img", "norm"))))


def _counts(rows: DataFrame) -> np.ndarray:
    """Counts of word pairs in hashed buckets: of fixed size, whatever the input."""
    pairs = f"transform(sequence(0, size(ws)), i -> cast(pmod(xxhash64(concat(coalesce(get(ws, i - 1), ''), ' ', coalesce(get(ws, i), ''))), {BUCKETS}) as int))"
    got = (
        rows.where("norm <> ''").select(F.split("norm", " ").alias("ws")).select(F.explode(F.expr(pairs)).alias("b"))
        .groupBy("b").agg(F.count("*").alias("n")).toArrow()
    )
    out = np.ones(BUCKETS)
    out[got["b"].to_numpy()] = got["n"].to_numpy()
    return out


def _listed(w2: np.ndarray, c: int) -> int:
    """How many of the terms, rare first, are listed, for more than c of them to be shared."""
    rest = np.cumsum(w2[::-1])[::-1]
    return int(np.count_nonzero(rest + c * MAX_W2 >= TAU * rest[0] - 1e-6))


def _keys(hashes: np.ndarray, rare: np.ndarray, w2: np.ndarray, large: bool) -> np.ndarray:
    """Keys of the lists of a class, of its terms, rare first."""
    k = _listed(w2, 0)
    if not large or rare[:k].all():
        return hashes[:k]
    k = _listed(w2, 1)
    h = hashes[:k][~rare[:k]]
    i, j = np.triu_indices(len(h), 1)
    x = h[i] * np.uint64(0x9E3779B97F4A7C15) ^ h[j]
    x ^= x >> np.uint64(31)
    return np.concatenate([hashes[:k][rare[:k]], x * np.uint64(0xD6E8FEB86659FD93)])


def _signature(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(256, np.uint8)
    bits[hashes >> np.uint64(56)] = 1
    return np.packbits(bits).view(np.int64)


def _vectors(classes: DataFrame, counts: np.ndarray) -> DataFrame:
    """Adds terms (hash above, weight in the low 8 bits), norm2, and keys of the lists that the class is in."""
    sent = classes.sparkSession.sparkContext.broadcast(np.minimum(counts, 1 << 30).astype(np.int32))
    top = float(np.log(counts.sum() + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted = sent.value
        for b in batches:
            all_terms, norms, keys, sigs = [], [], [], []
            for img, norm, large in zip(b["img"], b["norm"], b["large"]):
                ws = ["", *norm.split(" "), ""] if norm else ["", ""]
                seen: dict[str, int] = {}
                hashes, buckets = [], []
                for x, y in zip(ws, ws[1:]):
                    pair = f"{x} {y}"
                    k = seen[pair] = seen.get(pair, 0) + 1
                    hashes.append(xxhash.xxh3_64_intdigest(f"{img}\1{pair}\1{k}") >> 8)
                    buckets.append(xxhash.xxh64_intdigest(pair, 42) % BUCKETS)  # the JVM's function, whose hash may be negative: 2^20 divides 2^64
                n = counted[buckets]
                q = (255 * (1 - np.log(n) / top)).astype(np.uint64)
                h = np.array(hashes, np.uint64) << np.uint64(8) | q
                order = np.lexsort((h, -q.astype(np.int64)))
                h, n, w2 = h[order], n[order], 1 + q[order] / _Q
                all_terms.append(h.view(np.int64))
                norms.append(w2.sum())
                keys.append(_keys(h, n <= RARE, w2, large).view(np.int64))
                sigs.append(_signature(h))
            yield b.drop(columns=["img", "large"]).assign(terms=all_terms, norm2=np.array(norms, np.float32), keys=keys, sig=sigs)

    return classes.mapInPandas(run, "cid binary, norm string, train boolean, evals boolean, terms array<bigint>, norm2 float, keys array<bigint>, sig array<bigint>")


def _near(a: str, b: str, most: float) -> int:
    """Word edit distance, or -1 where it is over most of the longer text's words."""
    x, y = a.split(), b.split()
    if x == y:
        return 0
    k = int(most * max(len(x), len(y)) + 1e-9)
    if abs(len(x) - len(y)) > k:
        return -1
    row = {j: j for j in range(min(k, len(y)) + 1)}
    for i, w in enumerate(x, 1):
        new = {}
        for j in range(max(0, i - k), min(len(y), i + k) + 1):
            v = row.get(j, k + 1) + 1
            if j:
                v = min(v, new.get(j - 1, k + 1) + 1, row.get(j - 1, k + 1) + (w != y[j - 1]))
            new[j] = v
        if min(new.values()) > k:
            return -1
        row = new
    d = row.get(len(y), k + 1)
    return d if d <= k else -1


@F.pandas_udf(T.IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_near(x, y, SHARE) for x, y in zip(a, b)], dtype="int32")


def class_pairs(classes: DataFrame) -> DataFrame:
    """cid_t, cid_e, cosine, edits of every near-same pair of classes of which one is in train and the other is not."""
    lists = classes.select("cid", "train", "evals", F.size("terms").alias("n"), *(F.col("sig")[i].alias(f"s{i}") for i in range(4)), F.explode(F.array_distinct("keys")).alias("k"))
    a, b = (lists.where(w).select("k", *(F.col(c).alias(f"{c}_{x}") for c in ("cid", "n", "s0", "s1", "s2", "s3"))) for w, x in (("train", "t"), ("evals", "e")))
    differ = sum((F.bit_count(F.col(f"s{i}_t").bitwiseXOR(F.col(f"s{i}_e"))) for i in range(4)), F.lit(0))
    # over the limit, at least 1 - 2 SHARE of the longer text's terms are in both
    few = differ + 2 * F.ceil((1 - 2 * SHARE) * F.greatest("n_t", "n_e") - 1e-9) <= F.col("n_t") + F.col("n_e")
    found = a.join(b, (a["k"] == b["k"]) & few & (F.col("cid_t") != F.col("cid_e"))).select("cid_t", "cid_e").distinct()
    side = lambda s: classes.select(F.col("cid").alias(f"cid_{s}"), F.col("norm").alias(f"w_{s}"), F.col("terms").alias(f"x_{s}"), F.col("norm2").alias(f"n_{s}"))
    full = found.join(side("t"), "cid_t").join(side("e"), "cid_e")
    dot = F.expr(f"aggregate(array_intersect(x_t, x_e), 0D, (s, t) -> s + 1 + (t & 255) / {_Q}D)")
    full = full.withColumn("dot", dot).where(F.col("dot") >= TAU * F.greatest("n_t", "n_e") - 1e-4)
    full = full.withColumn("edits", _distance("w_t", "w_e")).where("edits >= 0")
    near = full.select("cid_t", "cid_e", (F.col("dot") / F.sqrt(F.col("n_t") * F.col("n_e"))).alias("cosine"), "edits")
    same = classes.where("train and evals").select(F.col("cid").alias("cid_t"), F.col("cid").alias("cid_e"), F.lit(1.0).alias("cosine"), F.lit(0).alias("edits"))
    return near.unionByName(same)


def overlaps(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their class, near-same pairs of classes). Each is written once to the shared folder.

    Defined cases: a row with neither text nor image is in no class; null and empty are alike; a text of punctuation alone counts as
    empty; an image in one row only, or a text in one only, is no pair; an empty table gives no rows; other columns are ignored.
    """
    rows = materialize(_classed(records(entries)), "p1-rows")
    counts = _counts(rows)
    classes = rows.groupBy("cid").agg(
        F.first("img").alias("img"), F.first("norm").alias("norm"), F.max(F.col("side") == 0).alias("train"), F.max(F.col("side") == 1).alias("evals"), F.first("large").alias("large")
    )
    return rows, materialize(class_pairs(materialize(_vectors(classes, counts), "p1-classes")), "p1-pairs")


def row_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """row_id_a, row_id_b (smaller first): every train row with every near-same val or test row."""
    t = rows.where("side = 0").select(F.col("cid").alias("cid_t"), F.col("row_id").alias("x"))
    e = rows.where("side = 1").select(F.col("cid").alias("cid_e"), F.col("row_id").alias("y"))
    both = pairs.select("cid_t", "cid_e").join(t, "cid_t").join(e, "cid_e")
    return both.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))


def report(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per split and dataset of the held-out rows: rows that occur in train, and pairs. Counted by class, no pair is expanded."""
    n_t = rows.where("side = 0").groupBy(F.col("cid").alias("cid_t")).agg(F.count("*").alias("n_t"))
    links = pairs.join(n_t, "cid_t").groupBy(F.col("cid_e").alias("cid")).agg(F.sum("n_t").alias("links"))
    held = rows.where("side = 1").groupBy("cid", "split", "dataset").agg(F.count("*").alias("n"))
    return held.join(links, "cid").groupBy("split", "dataset").agg(F.sum("n").alias("leaked_rows"), F.sum(F.col("n") * F.col("links")).alias("pairs"))


def links_per_row(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """row_id, class_id, links: each row's class, and of how many rows of the other side it is a near copy."""
    n = rows.groupBy("cid", "side").agg(F.count("*").alias("n"))
    of_t = pairs.join(n.where("side = 1").select(F.col("cid").alias("cid_e"), "n"), "cid_e").select(F.col("cid_t").alias("cid"), F.lit(0).alias("side"), "n")
    of_e = pairs.join(n.where("side = 0").select(F.col("cid").alias("cid_t"), "n"), "cid_t").select(F.col("cid_e").alias("cid"), F.lit(1).alias("side"), "n")
    links = of_t.unionByName(of_e).groupBy("cid", "side").agg(F.sum("n").alias("links"))
    return rows.join(links, ["cid", "side"], "left").select("row_id", F.hex("cid").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
