"""Keys as columns, the prefix index as a table of edges, retrieval by bucket, reranking, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.operators.records import numbered

#: Queries of one broadcast block of an exact search.
QUERY_BLOCK = 16_384
#: Scores that a task of an exact search holds at a time.
SCORES_MOST = 1 << 22


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unit(v: Column) -> Column:
    return let(v, lambda x: let(F.greatest(F.sqrt(dot(x, x)), F.lit(1e-12)), lambda n: F.transform(x, lambda y: y / n)))


def fused(a: Column, has_a: Column, b: Column, has_b: Column) -> Column:
    """Sum of two vectors, each where its mask is set."""
    return F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * has_a.cast("double") + y * has_b.cast("double"))


def code_text(codes: Column) -> Column:
    """<a3><b0>...: the letter is the level."""
    return F.array_join(F.transform(codes, lambda x, i: F.concat(F.lit("<"), F.char(i + 97), x.cast("string"), F.lit(">"))), "")


def text_code(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"<[a-z](\d+)>"), 1), lambda x: x.cast("int"))


def _checked(codes: Column, offsets: list[int], width: int) -> Column:
    ok = (F.size(codes) <= len(offsets)) & F.forall(codes, lambda x: x.isNotNull() & (x >= 0) & (x < width))
    return F.when(codes.isNull() | ok, codes).otherwise(F.raise_error(F.lit(f"codes outside 0 to {width - 1}")))


def codes_to_tokens(codes: Column, offsets: list[int], width: int) -> Column:
    """Codes as ids in which no two levels share a number; a code outside its level is an error."""
    at = F.array(*map(F.lit, offsets))
    return F.transform(_checked(codes, offsets, width), lambda x, i: x + at[i])


def tokens_to_codes(tokens: Column, offsets: list[int], width: int) -> Column:
    at = F.array(*map(F.lit, offsets))
    return _checked(F.transform(tokens, lambda x, i: x - at[i]), offsets, width)


def exact_percentiles(df: DataFrame, by: str, value: str, names: dict[str, float], places: int = 6) -> DataFrame:
    """by, and the percentiles under their names, between two values in proportion. Values are counted first, so the sort sees each once."""
    n = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    n = n.withColumn("_c", F.sum("_n").over(Window.partitionBy(by).orderBy("_v"))).join(n.groupBy(by).agg((F.sum("_n") - 1).alias("_t")), by)
    at = lambda pos: F.min(F.when(F.col("_c") > pos, F.col("_v")))
    out = []
    for name, p in names.items():
        pos = F.col("_t") * p
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        part = F.max(pos - F.floor(pos))
        out.append(F.round(low + (high - low) * part, places).alias(name))
    return n.groupBy(by).agg(*out)


def flat_nodes(e: DataFrame) -> DataFrame:
    """Edges with id, their place within the depth by (prefix, token), and parent, their prefix's place among the depth's prefixes; both from 0."""
    parents = numbered(e.select("depth", "prefix").distinct(), ["prefix"], "parent", ["depth"], 0)
    return numbered(e.select("depth", "prefix", "token", "child"), ["prefix", "token"], "id", ["depth"], 0).join(parents, ["depth", "prefix"])


def edges(index: DataFrame, levels: int) -> DataFrame:
    """depth, prefix, token, child, items, leaves: the prefix index (codes, items) as a table of edges."""
    paths = index.select("codes", "items", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("depth"))
    paths = paths.select("depth", F.slice("codes", F.lit(1), F.col("depth")).alias("p"), F.col("codes")[F.col("depth")].alias("token"), "items")
    got = paths.groupBy("depth", "p", "token").agg(F.sum("items").alias("items"), F.count("*").alias("leaves"))
    return got.select("depth", code_text(F.col("p")).alias("prefix"), "token", code_text(F.concat("p", F.array("token"))).alias("child"), "items", "leaves")


def bucket_items(beams: DataFrame, coded: DataFrame) -> DataFrame:
    """qid, did, beam_rank (best), score (highest): the items in the buckets of the found keys."""
    items = coded.select(code_text(F.col("codes")).alias("prefix"), F.col("vec_id").alias("did"))
    return beams.join(items, "prefix").groupBy("qid", "did").agg(F.min("beam_rank").alias("beam_rank"), F.max("score").alias("score"))


def with_cosine(found: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds cosine; ids without a vector are dropped."""
    unit = lambda name: vectors.select(F.col("vec_id").alias(name), F.transform("embedding", lambda x: x.cast("double")).alias(f"v_{name}"))
    both = found.join(unit("qid"), "qid").join(unit("did"), "did")
    norm = lambda c: F.greatest(F.sqrt(dot(c, c)), F.lit(1e-12))
    a, b = F.col("v_qid"), F.col("v_did")
    return both.withColumn("cosine", dot(a, b) / (norm(a) * norm(b))).drop("v_qid", "v_did")


def standardized(c: str, by: str = "qid") -> Column:
    """z-score within the group by population deviation; 0 for one row or hardly any spread."""
    w = Window.partitionBy(by)
    sd = F.stddev_pop(c).over(w)
    return F.when((F.count(c).over(w) <= 1) | (sd < 1e-8) | sd.isNull(), 0.0).otherwise((F.col(c) - F.avg(c).over(w)) / sd)


def minmaxed(c: str, by: str = "qid") -> Column:
    w = Window.partitionBy(by)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when((F.count(c).over(w) <= 1) | (high - low < 1e-8), 0.0).otherwise((F.col(c) - low) / (high - low))


def weights(cosine: float, generation: float) -> tuple[float, float]:
    """Weights clamped at 0 and made to sum to one; both zero give the cosine all."""
    a, b = max(0.0, cosine), max(0.0, generation)
    return (a / (a + b), b / (a + b)) if a + b else (1.0, 0.0)


def blended(found: DataFrame, mode: str = "weighted_zscore", cosine: float = 0.8, generation: float = 0.2, k: int = 60) -> DataFrame:
    """Adds final, the score that items are reranked by. A score that is missing or not finite is minus the logarithm of the beam rank, which counts from 1."""
    a, b = weights(cosine, generation)
    df = found.withColumn("score", F.when(F.abs("score") < float("inf"), F.col("score")).otherwise(-F.log(F.col("beam_rank").cast("double"))))
    if mode == "cosine_only":
        final = F.col("cosine")
    elif mode == "generation_only":
        final = F.col("score")
    elif mode == "weighted_minmax":
        final = a * minmaxed("cosine") + b * minmaxed("score")
    elif mode == "weighted_zscore":
        final = a * standardized("cosine") + b * standardized("score")
    elif mode == "rrf":
        r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cosine"), "beam_rank", "did"))
        final = a / (k + r) + b / (k + F.col("beam_rank"))  # ranks from 0, plus one
    else:
        raise ValueError(mode)
    return df.withColumn("final", final)


def reranked(found: DataFrame, k: int) -> DataFrame:
    """The best k items of each query: final down, then beam rank, then id."""
    w = Window.partitionBy("qid").orderBy(F.desc("final"), "beam_rank", "did")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hit_rates(right: DataFrame, queries: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """k, queries, hit_rate: the share of queries with any right item (qid, rank) among the first k, rounded to four places."""
    first = right.groupBy("qid").agg(F.min("rank").alias("first"))
    per = queries.select("qid").join(first, "qid", "left").select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "first")
    hit = F.when(F.col("first") <= F.col("k"), 1.0).otherwise(0.0)
    return per.groupBy("k").agg(F.count("*").alias("queries"), F.round(F.avg(hit), 4).alias("hit_rate"))


def code_hits(beams: DataFrame, index: DataFrame) -> DataFrame:
    """One row: shares of queries with a beam whose key exists, at all and first, share of such beams, and their mean number by query."""
    h = beams.select("qid", "beam_rank", "codes").join(index.select("codes", F.lit(1).alias("hit")), "codes", "left")
    per = h.groupBy("qid").agg(F.count("*").alias("n"), F.count("hit").alias("hits"), F.max(F.when((F.col("beam_rank") == 1) & F.col("hit").isNotNull(), 1).otherwise(0)).alias("first"))
    return per.agg(
        F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)), 4).alias("any_code_hit_rate"), F.round(F.avg("first"), 4).alias("first_beam_hit_rate"),
        F.round(F.sum("hits") / F.sum("n"), 4).alias("beam_code_hit_rate"), F.round(F.avg("hits"), 4).alias("hit_beams"),
    )


def beam_order(beams: DataFrame, coded: DataFrame, k: int) -> DataFrame:
    """qid, rank, did: the first k items in beam order, then by id; an item in two beams counts twice."""
    rows = beams.select("qid", "beam_rank", "codes").join(coded.select("codes", F.col("vec_id").alias("did")), "codes")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("beam_rank", "did"))).where(F.col("rank") <= k).select("qid", "rank", "did")


def first_places(items: DataFrame, *more: str) -> DataFrame:
    """qid, did, place: distinct items in beam order, then by id."""
    return items.select("qid", "did", F.row_number().over(Window.partitionBy("qid").orderBy("beam_rank", "did")).alias("place"), *more)


def judged_recall(places: DataFrame, judged: DataFrame, queries: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """One row: queries with and without judgements, and of the former mean candidates, mean first place of a judged item, and share with one in the first k."""
    first = places.join(judged.select("qid", "did").distinct(), ["qid", "did"]).groupBy("qid").agg(F.min("place").alias("f"))
    n = places.groupBy("qid").agg(F.count("*").alias("n"))
    per = queries.join(judged.select("qid").distinct().withColumn("j", F.lit(1)), "qid", "left").join(first, "qid", "left").join(n, "qid", "left")
    of = lambda c: F.round(F.avg(F.when(F.col("j") == 1, c)), 4)
    return per.agg(
        F.count("j").alias("evaluated"), F.count(F.when(F.col("j").isNull(), 1)).alias("missing"), of(F.coalesce("n", F.lit(0))).alias("mean_candidates"), of(F.col("f")).alias("mean_first_rank"),
        *(of(F.when(F.col("f") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks),
    )


def length_normalised(beams: DataFrame) -> DataFrame:
    """Scores by the key's length."""
    return beams.withColumn("score", F.col("score") / F.size("codes"))


def best_sequences(rows: DataFrame) -> DataFrame:
    """qid, code, score: each query's distinct sequences with their best score."""
    return rows.groupBy("qid", "code").agg(F.max("score").alias("score"))


def segmented_top(rows: DataFrame, by: str, k: int, ties: list[str]) -> DataFrame:
    """The k best rows of each segment, of whatever length, with their rank; equals by `ties`."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), *ties)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def diverse_top(rows: DataFrame, k: int, strength: float) -> DataFrame:
    """qid, rank, owner, token, score: choices one by one; a chosen token makes its like `strength` worse for the next choices. Scores stay raw."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "owner", "token"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        work, token, chosen = g["score"].to_numpy().copy(), g["token"].to_numpy(), []
        for _ in range(min(k, len(g))):
            i = int(work.argmax())
            chosen.append(i)
            work[i] = -np.inf
            work[token == token[i]] -= strength
        out = g.loc[chosen, ["qid", "owner", "token", "score"]]
        out.insert(1, "rank", np.arange(1, len(out) + 1, dtype=np.int32))
        return out

    return rows.select("qid", "owner", "token", "score").groupBy("qid").applyInPandas(run, "qid bigint, rank int, owner int, token int, score double")


def _vectors_of(b: pa.RecordBatch, i: int) -> np.ndarray:
    flat = b.column(i).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(b.num_rows, -1).astype(np.float64) if b.num_rows else np.empty((0, 0))


def code_gains(queries: DataFrame, words: np.ndarray, rounded: int | None = 5) -> DataFrame:
    """qid, code, gain, alignment, cosine, z: the evidence of each codeword for each query vector; z over the whole codebook, by population deviation."""
    sent = queries.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        norm = (w * w).sum(axis=1)
        for b in batches:
            if not b.num_rows:
                continue
            r = _vectors_of(b, 1)
            align = r @ w.T
            gain = 2 * align - norm
            cosine = align / (np.maximum(np.linalg.norm(r, axis=1), 1e-12)[:, None] * np.maximum(np.sqrt(norm), 1e-12))
            z = (gain - gain.mean(axis=1, keepdims=True)) / np.maximum(gain.std(axis=1, keepdims=True), 1e-6)
            cols = [x.ravel() if rounded is None else x.ravel().round(rounded) + 0.0 for x in (gain, align, cosine, z)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), len(w))), pa.array(np.tile(np.arange(len(w), dtype=np.int32), len(r))), *map(pa.array, cols)], names=["qid", "code", "gain", "alignment", "cosine", "z"])

    return queries.select("vec_id", "embedding").mapInArrow(run, "qid bigint, code int, gain double, alignment double, cosine double, z double")


def selected_gain(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """qid, code, z of rows (qid, embedding, code): the z of one codeword from the codebook's first and second moments, without the other scores."""
    norm = (words * words).sum(axis=1)
    moments = (words, norm, words.mean(axis=0), norm.mean(), words.T @ words / len(words), (words * norm[:, None]).mean(axis=0), (norm**2).mean())
    sent = rows.sparkSession.sparkContext.broadcast(moments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n, m1, n1, m2, cross, n2 = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            r, code = _vectors_of(b, 1), b.column(2).to_numpy()
            mean = 2 * r @ m1 - n1
            second = 4 * ((r @ m2) * r).sum(axis=1) - 4 * r @ cross + n2
            z = (2 * (r * w[code]).sum(axis=1) - n[code] - mean) / np.sqrt(np.maximum(second - mean**2, 1e-12))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code.astype(np.int32)), pa.array(z.round(5))], names=["qid", "code", "z"])

    return rows.select("qid", "embedding", "code").mapInArrow(run, "qid bigint, code int, z double")


def masked_moments(rows: DataFrame, by: str, code: str, value: str) -> DataFrame:
    """by, best code, mean, deviation (at least 1e-4) and margin of the two best of the finite values; a margin of one value is 0."""
    fine = rows.where(F.abs(F.col(value)) < float("inf"))
    best = F.slice(F.sort_array(F.collect_list(value), False), 1, 2)  # as many values as a level has codes
    got = fine.groupBy(by).agg(F.max_by(code, F.struct(F.col(value), -F.col(code))).alias("best"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), best.alias("top"))
    return got.select(by, "best", F.round("mean", 5).alias("mean"), F.round(F.greatest("sd", F.lit(1e-4)), 5).alias("deviation"), F.round(F.coalesce(F.col("top")[0] - F.get("top", F.lit(1)), F.lit(0.0)), 5).alias("margin"))


def distances(vectors: DataFrame, words: np.ndarray) -> DataFrame:
    """vec_id, code, distance: Euclidean, from the squares, which are never below 0."""
    sent = vectors.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _vectors_of(b, 1)
            square = (x * x).sum(axis=1)[:, None] + (w * w).sum(axis=1)[None] - 2 * x @ w.T
            d = np.sqrt(np.maximum(square, 0)).round(5)
            d[d < 1e-5] = 0
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), len(w))), pa.array(np.tile(np.arange(len(w), dtype=np.int32), len(x))), pa.array(d.ravel())], names=["vec_id", "code", "distance"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, code int, distance double")


def exact_top(queries: DataFrame, rows: DataFrame, k: int, other: str | None = None) -> DataFrame:
    """qid, rank, did, score: the k rows of the largest inner product with each query, other than itself; equals by the smaller id.

    other: only rows that differ from the query in this column. The query set is broadcast in blocks of about QUERY_BLOCK; each task scans its rows once a
    block, SCORES_MOST scores at a time, and sends on what is as good as the k best that it has seen.
    """
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    group = F.col(other).cast("string") if other else F.lit(None).cast("string")
    parts = []
    for i in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).select("vec_id", "embedding", group.alias("g")).toArrow()
        if not got.num_rows:
            continue
        q = np.array(got["embedding"].to_pylist(), np.float64)
        sent = spark.sparkContext.broadcast((got["vec_id"].to_numpy(), q, np.array(got["g"].to_pylist(), object)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, y, groups = sent.value
            best = np.full((len(ids), k), -np.inf)  # values of the best so far
            for b in batches:
                for at in range(0, b.num_rows, size := max(1, SCORES_MOST // len(ids))):
                    part = b.slice(at, size)
                    did = part.column(0).to_numpy()
                    s = y @ _vectors_of(part, 1).T
                    s[ids[:, None] == did[None]] = -np.inf
                    if other:
                        s[groups[:, None] == np.array(part.column(2).to_pylist(), object)[None]] = -np.inf
                    n = min(k, s.shape[1])
                    both = np.concatenate([best, np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n :]], axis=1)
                    best = np.partition(both, n, axis=1)[:, n:]
                    r, c = np.nonzero((s >= best.min(axis=1)[:, None]) & np.isfinite(s))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(did[c]), pa.array(s[r, c])], names=["qid", "did", "score"])

        parts.append(rows.select("vec_id", "embedding", group.alias("g")).mapInArrow(run, "qid bigint, did bigint, score double"))
    every = parts[0] if parts else spark.createDataFrame([], "qid bigint, did bigint, score double")
    for p in parts[1:]:
        every = every.unionByName(p)
    return segmented_top(every, "qid", k, ["did"]).select("qid", "rank", "did", "score")


def prefix_neighbours(targets: DataFrame, index: DataFrame, depths: tuple[int, ...], n: int, seed: str) -> DataFrame:
    """vec_id, code: for each depth up to n stored keys that share so many codes with the target, itself left out; each key once.

    The shuffle is one of the seed and the key, so each prefix gives its first n + 1 keys and no target meets more.
    """
    parts = []
    for d in depths:
        keys = index.select(F.slice("codes", 1, d).alias("p"), code_text(F.col("codes")).alias("code")).withColumn("o", F.md5(F.concat(F.lit(seed), "code")))
        first = keys.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("o", "code"))).where(F.col("r") <= n + 1)
        own = targets.select("vec_id", F.slice("codes", 1, d).alias("p"), code_text(F.col("codes")).alias("own"))
        got = own.join(first, "p").where("code <> own")
        parts.append(got.withColumn("r", F.row_number().over(Window.partitionBy("vec_id").orderBy("o", "code"))).where(F.col("r") <= n).select("vec_id", "code"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
