"""Constrained search for complete keys: codebooks, encoding, rounds over stored continuations, planners.

A search state is a table of (qid, codes, score, r): a query's prefix, what it scores, and the residual that the prefix leaves of the query. A round joins the
states' prefixes with the stored continuations and scores each batch of rows by one matrix product per level against the codebook, which every task holds
once, as a broadcast whose size is checked. Rows carry no codewords. Continuations of a prefix come in chunks of about CHUNK, so a prefix of
millions of keys is many rows, and each row sends on only what can still be among the best.

The evidence for a code is 2 r.c - |c|^2; its log-softmax over all codes of the level, legal or not, is what a search adds up. All rounds of
a block use the evidence of the block's first prefix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.operators.keys import code_text
from keyloom.storage import materialize

CHUNK = 1024
BOOKS_MOST = 1 << 29
STATE = "qid bigint, codes array<int>, score double, r array<double>"


@dataclass(frozen=True)
class Books:
    """words: level x code x part; a codeword that is missing is NaN and never chosen."""

    words: np.ndarray

    @property
    def levels(self) -> int:
        return self.words.shape[0]

    def evidence(self, r: np.ndarray, level: int, guidance: float = 1.0) -> np.ndarray:
        """Row by code. guidance w moves from the query-free part, -|c|^2, w times the way to the whole."""
        w = self.words[level]
        out = guidance * 2 * (r @ np.nan_to_num(w).T) - (np.nan_to_num(w) ** 2).sum(axis=1)
        return np.where(np.isnan(w).any(axis=1), -np.inf, out)

    def logp(self, r: np.ndarray, level: int, guidance: float = 1.0, temperature: float = 1.0) -> np.ndarray:
        g = self.evidence(r, level, guidance) / temperature
        g -= g.max(axis=1, keepdims=True)
        return g - np.log(np.exp(g).sum(axis=1, keepdims=True))


def load_books(vectors: DataFrame, levels: int = 3, width: int = 16, scale: float = 0.35, stride: int | None = None) -> Books:
    """Level l's codeword c is scale times the vector of id l * stride + c (stride is width if not given)."""
    stride = stride or width
    rows = vectors.where(F.col("vec_id") < (levels - 1) * stride + width).select("vec_id", "embedding").toArrow()
    ids = rows["vec_id"].to_numpy()
    x = np.array(rows["embedding"].to_pylist(), np.float32).astype(np.float64).reshape(len(ids), -1)
    by = np.full(((levels - 1) * stride + width, x.shape[1] if len(ids) else 1), np.nan)
    by[ids] = x * scale
    words = np.stack([by[k * stride : k * stride + width] for k in range(levels)])
    if words.nbytes > BOOKS_MOST:
        raise ValueError(f"codebooks of {words.nbytes} bytes; at most {BOOKS_MOST} are broadcast")
    return Books(words)


def _matrix(column: pa.ListArray, dtype: type = np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype) if len(column) else np.empty((0, 0), dtype)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, m = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(x.ravel(), kind))


def encode(df: DataFrame, books: Books, levels: int | None = None) -> DataFrame:
    """vec_id, codes, energies (squared norm of what is left, by level): the nearest codeword by level, then the rest. Equal distances: the smaller code."""
    sent, levels = df.sparkSession.sparkContext.broadcast(books), levels or books.levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = _matrix(b.column(1))
            codes, left = np.empty((len(r), levels), np.int32), np.empty((len(r), levels))
            for k in range(levels if len(r) else 0):
                codes[:, k] = sent.value.evidence(r, k).argmax(axis=1)
                r = r - sent.value.words[k][codes[:, k]]
                left[:, k] = (r * r).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), _lists(codes, pa.int32()), _lists(left, pa.float64())], names=["vec_id", "codes", "energies"])

    return df.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, codes array<int>, energies array<double>")


def distinct_keys(coded: DataFrame) -> DataFrame:
    """codes, items: the index, each key once with the number of its holders. Written once, as every round reads it."""
    return materialize(coded.groupBy("codes").agg(F.count("*").alias("items")), "keys")


def leaves(index: DataFrame, depth: int) -> DataFrame:
    """codes (a prefix of that depth), leaves: the keys below it."""
    return index.groupBy(F.slice("codes", 1, depth).alias("codes")).agg(F.count("*").alias("leaves"))


def continuations(index: DataFrame, depth: int, span: int) -> DataFrame:
    """codes (a stored prefix of that depth), next: its distinct stored continuations of `span` codes, in chunks of about CHUNK."""
    rows = index.select(F.slice("codes", 1, depth).alias("codes"), F.slice("codes", depth + 1, span).alias("s"), (F.size("codes") > depth + span).alias("longer"))
    rows = rows.where("longer").select("codes", "s").distinct().unionByName(rows.where("not longer").select("codes", "s"))  # whole keys are distinct
    n = rows.groupBy("codes").agg(F.count("*").alias("n"))
    rows = rows.join(n, "codes").withColumn("chunk", F.pmod(F.xxhash64("s"), F.ceil(F.col("n") / CHUNK)))
    return rows.groupBy("codes", "chunk").agg(F.collect_list("s").alias("next")).drop("chunk")


Hook = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Scoring:
    """mode: how a block's codes count: sum, mean, last, or prefix (not at all). top_p drops codes beyond that probability, the first never;
    scope: among legal codes or all of the level (rounds of one level). hook(qid, codes, score) may replace scores; it must keep their shape."""

    mode: str = "sum"
    guidance: float = 1.0
    temperature: float = 1.0
    top_p: float = 1.0
    scope: str = "legal"
    hook: Hook | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("sum", "mean", "last", "prefix") or self.scope not in ("legal", "level"):
            raise ValueError(f"{self.mode}, {self.scope}")


def _nucleus(score: np.ndarray, owner: np.ndarray, p: float, normalise: bool) -> np.ndarray:
    """Which rows stay: each owner's first, and those up to a summed probability of p."""
    by = np.lexsort((-score, owner))
    own, prob = owner[by], np.exp(score[by])
    first = np.flatnonzero(np.diff(own, prepend=-1)) if len(own) else np.empty(0, int)
    size = np.diff(np.append(first, len(own)))
    if normalise and len(first):
        prob = prob / np.repeat(np.add.reduceat(prob, first), size)
    cum = np.cumsum(prob)
    cum -= np.repeat(cum[first] - prob[first], size)
    keep = (cum <= p + 1e-12) | np.isin(np.arange(len(own)), first)
    out = np.zeros(len(score), bool)
    out[by] = keep
    return out


def _expanded(state: DataFrame, index: DataFrame | None, books: Books, depth: int, span: int, keep: int, how: Scoring, anchor: int, advance: bool) -> DataFrame:
    """The states one round on: the `keep` best of each query. anchor is the depth whose residual r the states carry; index None: all codes are legal."""
    sent, stored = state.sparkSession.sparkContext.broadcast(books), index is not None
    joined = state.withColumn("next", F.lit(None).cast("array<array<int>>")) if index is None else state.join(continuations(index, depth, span), "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            n, qid, score, r = b.num_rows, b.column(0).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3))
            prefix = _matrix(b.column(1), np.int32).reshape(n, depth)
            logps = [book.logp(r, k, how.guidance, how.temperature) for k in range(depth, depth + span)]
            if not stored:
                width = book.words.shape[1]
                owner, tokens = np.repeat(np.arange(n), width), np.tile(np.arange(width), n)[:, None]
            else:
                lists = b.column(4)
                owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
                tokens = _matrix(lists.flatten(), np.int64).reshape(len(owner), span)
            each = np.stack([logps[j][owner, tokens[:, j]] for j in range(span)], axis=1)
            keeps = np.isfinite(each).all(axis=1)
            if how.top_p < 1 and span == 1:
                one = each[:, 0] if how.scope == "legal" else None
                if one is not None:
                    keeps &= _nucleus(one, owner, how.top_p, True)
                else:
                    width = logps[0].shape[1]
                    inside = _nucleus(logps[0].ravel(), np.repeat(np.arange(n), width), how.top_p, False).reshape(n, width)
                    keeps &= inside[owner, tokens[:, 0]]
            owner, tokens, each = owner[keeps], tokens[keeps], each[keeps]
            gain = {"sum": each.sum(axis=1), "mean": each.mean(axis=1), "last": each[:, -1], "prefix": np.zeros(len(each))}[how.mode]
            total = score[owner] + gain
            codes = np.concatenate([prefix[owner], tokens.astype(np.int32)], axis=1)
            if how.hook is not None:
                changed = np.asarray(how.hook(qid[owner], codes, total), np.float64)
                if changed.shape != total.shape:
                    raise ValueError(f"a score hook made {total.shape} {changed.shape}")
                total = changed
            # per row, the best `keep` and their equals; the choice among equals is made by key text afterwards
            by = np.lexsort((-total, owner))
            first = np.flatnonzero(np.diff(owner[by], prepend=-1)) if len(by) else np.empty(0, int)
            size = np.diff(np.append(first, len(by)))
            least = np.repeat(total[by][first + np.minimum(size, keep) - 1], size) if len(by) else np.empty(0)
            by = by[total[by] >= least]
            owner, total, codes = owner[by], total[by], codes[by]
            rest = r[owner]
            if advance:
                for level in range(anchor, depth + span):
                    rest = rest - book.words[level][codes[:, level]]
            yield pa.RecordBatch.from_arrays([pa.array(qid[owner]), _lists(codes, pa.int32()), pa.array(total), _lists(rest, pa.float64())], names=["qid", "codes", "score", "r"])

    return best_of(joined.select("qid", "codes", "score", "r", "next").mapInArrow(run, STATE), keep)


def best_of(state: DataFrame, k: int) -> DataFrame:
    """The k best states of each query; equals by key text."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), code_text(F.col("codes")))
    return state.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def start(queries: DataFrame) -> DataFrame:
    """The states before any round, of queries (vec_id, embedding)."""
    return queries.select(F.col("vec_id").cast("bigint").alias("qid"), F.array().cast("array<int>").alias("codes"), F.lit(0.0).alias("score"), F.col("embedding").cast("array<double>").alias("r"))


def ranked(state: DataFrame, *more: str) -> DataFrame:
    """qid, beam_rank, prefix (the key's text), codes, score."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "prefix")
    return state.select("qid", code_text(F.col("codes")).alias("prefix"), "codes", "score", *more).withColumn("beam_rank", F.row_number().over(w))


def block_search(queries: DataFrame, index: DataFrame | None, books: Books, width: int, spans: list[int] | None = None, prefix_width: int | None = None, how: Scoring = Scoring(), levelwise: bool = False) -> DataFrame:
    """The `width` best keys of each query that the index holds.

    spans gives how many levels each round decides; all ones is the sequential search, one span of all levels the one-pass selection. levelwise decides a
    block's levels one by one, pruned at each, by the same evidence. Between blocks prefix_width (width if not given) prefixes stay. Without an index every
    code is legal, and spans must be ones. Of a query that reaches fewer keys than width, fewer rows come.
    """
    spans = spans or [1] * books.levels
    if sum(spans) != books.levels or min(spans) < 1:
        raise ValueError(f"spans {spans} don't make {books.levels}")
    if index is None and max(spans) > 1:
        raise ValueError("without an index rounds are of one level")
    state, depth = start(queries), 0
    for n, span in enumerate(spans):
        keep = width if n == len(spans) - 1 else prefix_width or width
        if levelwise and span > 1:
            for j in range(span):
                state = _expanded(state, index, books, depth + j, 1, keep if j == span - 1 else width, how, depth, j == span - 1)
        else:
            state = _expanded(state, index, books, depth, span, keep, how, depth, True)
        depth += span
    return ranked(state)


def planned_search(queries: DataFrame, index: DataFrame, books: Books, width: int, budget: int | None = None, least: int = 1, most: int | None = None, prefix_width: int | None = None, each: int | None = None) -> DataFrame:
    """Keys found, and stop_depth: the depth from which each query's rest was decided in one block.

    With budget: from depth `least` on a query finishes where all its prefixes together hold at most so many keys, at `most` (or the last level) in any case.
    With each: where every one of its prefixes holds at most so many keys. Each depth's states are written once.
    """
    if (budget is None) == (each is None):
        raise ValueError("give budget or each")
    last = min(most if most is not None else books.levels - 1, books.levels - 1)
    state, done = start(queries), None
    for depth in range(books.levels):
        if depth < least:
            now = None
        elif depth >= last:
            now = state
        else:
            held = state.join(leaves(index, depth), "codes").groupBy("qid").agg(F.sum("leaves").alias("all"), F.max("leaves").alias("top"))
            ready = held.where(F.col("all") <= budget if budget is not None else F.col("top") <= each).select("qid")
            now, state = state.join(ready, "qid", "left_semi"), state.join(ready, "qid", "left_anti")
        if now is not None:
            found = _expanded(now, index, books, depth, books.levels - depth, width, Scoring(), depth, True).withColumn("stop_depth", F.lit(depth))
            done = found if done is None else done.unionByName(found)
            if depth >= last:
                break
        state = materialize(_expanded(state, index, books, depth, 1, prefix_width or width, Scoring(), depth, True), "states")
    return ranked(done, "stop_depth")


def planner_spans(length: int, begin: int, finish: bool) -> list[tuple[int, int]]:
    """The position ranges of a planner's step: decided ones singly, then the rest singly, or in one block to finish."""
    if not 0 <= begin < length:
        raise ValueError(f"start {begin} of {length}")
    return [(i, i + 1) for i in range(begin)] + ([(begin, length)] if finish else [(i, i + 1) for i in range(begin, length)])


def block_spans(sizes: list[int], length: int, modality_level: bool = False) -> list[int]:
    """Configured block sizes, which must make the length; sizes that leave out a leading modality level get one of 1 for it."""
    if any(s < 1 for s in sizes):
        raise ValueError(f"sizes {sizes}")
    if modality_level and sum(sizes) == length - 1:
        sizes = [1, *sizes]
    if sum(sizes) != length:
        raise ValueError(f"sizes {sizes} don't make {length}")
    return sizes


def search(queries: DataFrame, index: DataFrame, books: Books, width: int, one_pass: bool = False, budget: int | None = None, each: int | None = None, spans: list[int] | None = None, **kw) -> DataFrame:
    """The search that the settings ask for: one pass, else planned by budget, else by each prefix, else blocks, else level by level."""
    if one_pass:
        return block_search(queries, index, books, width, [books.levels], **kw)
    if budget is not None or each is not None:
        return planned_search(queries, index, books, width, budget=budget, each=None if budget is not None else each, **kw)
    return block_search(queries, index, books, width, spans, **kw)


def legal_codes(prefixes: DataFrame, index: DataFrame, depth: int, width: int, strict: bool = True) -> DataFrame:
    """prefixes (with codes, null codes inside marking undecided positions) with next: the codes that may follow.

    Strict: none after a prefix that isn't stored or has an undecided position. Otherwise all of the level there.
    """
    known = index.groupBy(F.slice("codes", 1, depth).alias("codes")).agg(F.array_sort(F.collect_set(F.col("codes")[depth])).alias("next"))
    none = F.array().cast("array<int>") if strict else F.sequence(F.lit(0), F.lit(width - 1))
    return prefixes.join(known, "codes", "left").withColumn("next", F.coalesce("next", none))


def position_scores(beams: DataFrame, queries: DataFrame, books: Books) -> DataFrame:
    """qid, codes, at, score: what each code of a key scores by the query alone, without the codes before it."""
    sent = beams.sparkSession.sparkContext.broadcast(books)
    rows = beams.select("qid", "codes").join(queries.select(F.col("vec_id").alias("qid"), "embedding"), "qid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes, r = _matrix(b.column(1), np.int64), _matrix(b.column(2))
            at = np.arange(len(codes))
            score = np.stack([sent.value.logp(r, k)[at, codes[:, k]] for k in range(codes.shape[1])], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(score, pa.float64())], names=["qid", "codes", "scores"])

    got = rows.select("qid", "codes", "embedding").mapInArrow(run, "qid bigint, codes array<int>, scores array<double>")
    return got.select("qid", "codes", F.posexplode("scores").alias("at", "score"))


def refined(scores: DataFrame, fraction: float) -> DataFrame:
    """qid, codes, kept: the key with the surest part of its positions, rounded up, and null where a position is open again; equals by position."""
    w = Window.partitionBy("qid", "codes").orderBy(F.desc("score"), "at")
    ranked_ = scores.withColumn("n", F.row_number().over(w)).withColumn("open", F.col("n") > F.ceil(F.size("codes") * fraction))
    one = F.struct("at", F.when(~F.col("open"), F.element_at("codes", F.col("at") + 1)).alias("c"))
    return ranked_.groupBy("qid", "codes").agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["c"]).alias("kept"))


def sampled_code(gains: DataFrame, by: str, code: str, score: str, seed: str, temperature: float = 1.0) -> DataFrame:
    """by, code: one code for each group, drawn with the probabilities that the scores give: the largest of score plus Gumbel noise of a hash of seed, group and code.
    A temperature of 0 takes the best."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(by).cast("string"), F.col(code).cast("string")))
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noisy = F.col(score) if temperature == 0 else F.col(score) / temperature - F.log(-F.log(u))
    return gains.groupBy(by).agg(F.max_by(code, F.struct(noisy.alias("s"), -F.col(code))).alias(code))


def positive_children(paths: DataFrame, levels: int) -> DataFrame:
    """qid, depth, prefix, next: for each query's distinct right keys, the codes that lead on to one after each of their prefixes."""
    at = paths.select("qid", "codes").distinct().select("qid", "codes", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("depth"))
    step = at.select("qid", "depth", F.slice("codes", F.lit(1), F.col("depth")).alias("p"), F.get("codes", F.col("depth")).alias("token")).distinct()
    return step.groupBy("qid", "depth", "p").agg(F.array_sort(F.collect_list("token")).alias("next")).select("qid", "depth", code_text(F.col("p")).alias("prefix"), "next")


def branch_records(paths: DataFrame, index: DataFrame, levels: int, n: int, seed: str) -> DataFrame:
    """qid, depth, child: beside each step of each right key up to n other stored codes, by a seeded shuffle that is one for all queries; each once."""
    parts = []
    for d in range(levels):
        kids = index.select(F.slice("codes", 1, d).alias("p"), F.slice("codes", 1, d + 1).alias("c")).distinct().withColumn("child", code_text(F.col("c"))).withColumn("o", F.md5(F.concat(F.lit(seed), "child")))
        few = kids.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("o", "child"))).where(F.col("r") <= n + 1)
        own = paths.select("qid", F.slice("codes", 1, d).alias("p"), F.slice("codes", 1, d + 1).alias("own")).distinct()
        got = own.join(few, "p").where("own <> c")
        got = got.withColumn("r", F.row_number().over(Window.partitionBy("qid", "own").orderBy("o", "child"))).where(F.col("r") <= n)
        parts.append(got.select("qid", F.lit(d).alias("depth"), "child").distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def trained_books(vectors: DataFrame, levels: int, width: int, seed: int = 7, rounds: int = 20) -> Books:
    """Codebooks by k-means on the residuals of each level, over all vectors; a codeword that no vector needs stays missing."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    dims = vectors.select(F.size("embedding").alias("d")).first()["d"]
    books = Books(np.full((levels, width, dims), np.nan))
    left = vectors.select("vec_id", "embedding")
    for k in range(levels):
        rows = materialize(residuals(left, books, k), "residuals")
        model = KMeans(k=width, seed=seed, maxIter=rounds, featuresCol="f").fit(rows.select(array_to_vector("r").alias("f")))
        for c, centre in enumerate(model.clusterCenters()):
            books.words[k, c] = centre
    return books


def residuals(vectors: DataFrame, books: Books, levels: int) -> DataFrame:
    """vec_id, r: what the first levels' codewords leave of each vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(Books(books.words.copy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = _matrix(b.column(1))
            for k in range(levels if len(r) else 0):
                r = r - sent.value.words[k][sent.value.evidence(r, k).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), _lists(r, pa.float64())], names=["vec_id", "r"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, r array<double>")


def reconstructed(prefixes: DataFrame, books: Books, id_col: str = "qid") -> DataFrame:
    """id, v: the sum of the codewords of each row's codes, by level; null and unknown codes add nothing."""
    sent = prefixes.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.nan_to_num(sent.value.words)
        levels, width, dims = words.shape
        for b in batches:
            v = np.zeros((b.num_rows, dims))
            for i, codes in enumerate(b.column(1).to_pylist()):
                for k, c in enumerate((codes or [])[:levels]):
                    if c is not None and 0 <= c < width:
                        v[i] += words[k, c]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), _lists(v, pa.float64())], names=["id", "v"])

    return prefixes.select(id_col, "codes").mapInArrow(run, "id bigint, v array<double>")
