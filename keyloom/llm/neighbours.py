"""Problem 4: the k most similar other vectors by cosine, for every vector.

Vectors are brought to length one, so cosine is inner product. Two levels of lists:

* regions: spherical k-means on a sample (SAMPLE_PER_REGION vectors for each region, SAMPLE_LEAST at least, hash-chosen), about CELL_ROWS vectors each. All
  vectors go to the region of their nearest centre; a vector also asks every region whose centre is nearer than that of its own less `margin`;
* lists: each region's task cuts what it holds into lists of about LIST_ROWS vectors, again by k-means.

In a region's task, codebooks of score-aware quantisation are fitted: 16 codewords for each pair of dimensions, fitted and assigned under a loss that counts the
part of the residual that is parallel to the vector ETA times, as only that part shifts the largest inner products. Every vector becomes four-bit codes of
what it differs from its list's centre by, two to a byte. Queries come in blocks of neighbours; a block's tables of partial products are scanned against
the codes of all lists that any of its queries probes, and the best by that estimate are reranked by exact cosine. The best of all regions asked make the result.

How far to look is measured in each run, not set by the table's size: `margin` on PILOTS vectors whose neighbours all vectors were searched for, the rows to
probe and the length of the short list on PILOTS_LOCAL vectors of the region, each so that TARGET of the exact neighbours stay. Data of few
natural directions need few rows. In isotropic clusters most of a cluster must be scanned whatever the index, so work then grows with the cluster.

A region too large for one task (where the sample's bound REGIONS_MOST is reached) is cut by a hash of the id into several cells that all its queries ask; a cell
of very many queries takes them in several tasks. Exact copies of a vector are indexed once, with the k + 1 smallest of their ids, and spelled out at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.storage import materialize

K = 10
CELL_ROWS = 50_000
#: Regions there should be at least, so that all executors have work, if they then hold REGION_LEAST rows.
SPREAD = 32
REGION_LEAST = 2_048
REGIONS_MOST = 4_096
CELL_MOST = 200_000
QUERIES_MOST = 100_000
SAMPLE_PER_REGION = 64
SAMPLE_LEAST = 16_384
LIST_ROWS = 64
PILOTS = 256
PILOTS_LOCAL = 96
TARGET = 0.98
COPIES_BROADCAST = 200_000
THRESHOLD = 0.2  # the inner product, as a share of the norms, from which on a score's accuracy counts
_BLOCK = 128
_FIT = 2_048


def usable(c: Column) -> Column:
    """Whether a vector is not null, has no null, NaN or infinite part, and is not zero."""
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)


def unit_vector(c: Column) -> Column:
    """A usable vector brought to length one."""
    square = F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.transform(F.array(F.sqrt(square)), lambda n: F.transform(c, lambda x: F.try_divide(x.cast("double"), n).cast("float")))[0]


def _eta(dims: int) -> float:
    return max(1.0, (dims - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return np.ascontiguousarray((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 8192] @ c.T).argmax(axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.empty(0, int)


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced starts; an emptied centre moves to the worst served vector."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        s = x @ c.T
        a = s.argmax(axis=1)
        order = np.argsort(a, kind="stable")
        size = np.bincount(a, minlength=k)
        held = np.flatnonzero(size)
        new = np.zeros_like(c)
        new[held] = np.add.reduceat(x[order], np.cumsum(size)[held] - size[held])
        norm = np.linalg.norm(new, axis=1)
        empty = np.flatnonzero(norm < 1e-9)
        new[empty] = x[np.argsort(s[np.arange(len(x)), a])[: len(empty)]]
        c = new / np.maximum(np.linalg.norm(new, axis=1), 1e-9)[:, None]
    return c


@dataclass
class Codebook:
    """words[m, j]: codeword j of the m-th pair of dimensions, for what a vector differs from its list's centre by."""

    words: np.ndarray

    def codes(self, x: np.ndarray, centre: np.ndarray, sweeps: int = 1) -> np.ndarray:
        """Codeword numbers by coordinate descent on |r|^2 + (eta - 1) (r.x)^2, pair by pair; r is what remains of x - centre."""
        left, along = np.ascontiguousarray((x - centre).T), np.ascontiguousarray(x.T)
        n, eta = len(x), _eta(x.shape[1])
        out = np.zeros((len(self.words), n), np.intp)
        par = np.zeros(n, np.float32)  # r.x so far
        parts = np.zeros((len(self.words), n), np.float32)
        cost, tmp = np.empty((n, 16), np.float32), np.empty((n, 16), np.float32)
        for _ in range(sweeps + 1):
            for m, w in enumerate(self.words):
                p, d = left[2 * m : 2 * m + 2], along[2 * m : 2 * m + 2]
                np.matmul(d.T, w.T, out=tmp)
                par -= parts[m]
                full = (p * d).sum(axis=0)
                np.subtract((par + full)[:, None], tmp, out=cost)
                cost *= cost
                cost *= eta - 1
                np.matmul(p.T, -2 * w.T, out=tmp)
                cost += tmp
                cost += (w * w).sum(axis=1)
                best = out[m] = cost.argmin(axis=1)
                parts[m] = full - (d[0] * w[best, 0] + d[1] * w[best, 1])
                par += parts[m]
        return out.T.astype(np.uint8)


def fit_codebook(x: np.ndarray, centre: np.ndarray, rounds: int = 3) -> Codebook:
    """Codewords by turns: codes under the loss above, then each codeword's least squares under it, a 2 x 2 system."""
    n, dims = x.shape
    eta = _eta(dims)
    pairs, along = (x - centre).reshape(n, -1, 2), x.reshape(n, -1, 2).astype(np.float64)
    start = np.linspace(0, n - 1, 16).astype(int)
    book = Codebook(np.stack([p[np.argsort(np.arctan2(p[:, 1], p[:, 0]))][start] for p in pairs.transpose(1, 0, 2)]).astype(np.float32))
    for _ in range(rounds):
        codes = book.codes(x, centre, 0)
        parts = ((pairs - book.words[np.arange(pairs.shape[1])[None], codes]) * along).sum(axis=2)
        rest = parts.sum(axis=1, keepdims=True) - parts
        for m in range(pairs.shape[1]):
            c, p, d = codes[:, m], pairs[:, m].astype(np.float64), along[:, m]
            full = rest[:, m] + (p * d).sum(axis=1)
            by = lambda w: np.bincount(c, weights=w, minlength=16)  # noqa: B023, E731
            count = by(np.ones(n))
            a, b, e = count + (eta - 1) * by(d[:, 0] ** 2), (eta - 1) * by(d[:, 0] * d[:, 1]), count + (eta - 1) * by(d[:, 1] ** 2)
            u, v = by(p[:, 0]) + (eta - 1) * by(d[:, 0] * full), by(p[:, 1]) + (eta - 1) * by(d[:, 1] * full)
            held = count > 0
            det = np.where(held, a * e - b * b, 1)
            book.words[m, held] = np.stack([(e * u - b * v) / det, (a * v - b * u) / det], axis=1)[held]
    return book


class Store:
    """The vectors of one cell: lists, four-bit codes, and how far its queries must look."""

    def __init__(self, x: np.ndarray, k: int):
        n = len(x)
        lists = max(1, n // LIST_ROWS)
        centres = _kmeans(x[np.linspace(0, n - 1, min(n, 16 * lists)).astype(int)], lists)
        if lists > 32:  # like lists next to each other, so that queries in their order make blocks that probe much the same
            group = _nearest(centres, _kmeans(centres, lists // 16))
            centres = centres[np.argsort(group, kind="stable")]
        home = _nearest(x, centres)
        self.order = np.argsort(home, kind="stable")  # rows of x by list
        self.x, home = x[self.order], home[self.order]
        size = np.bincount(home, minlength=lists)
        held = np.flatnonzero(size)
        self.centres, self.size = centres[held], size[held]
        self.start = np.cumsum(self.size) - self.size
        centre = centres[home]
        some = np.linspace(0, n - 1, min(n, _FIT)).astype(int)
        self.book = fit_codebook(self.x[some], centre[some])
        codes = np.concatenate([self.book.codes(self.x[i : i + 8192], centre[i : i + 8192]) for i in range(0, n, 8192)])
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        self.both = np.ascontiguousarray((codes[:, ::2] | codes[:, 1::2] << 4).T.astype(np.intp))  # by byte, then row
        self.k, self.rows, self.short = k, n, n

    def estimates(self, y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, estimated products of 16 bits by row and query) of the lists to use: the table scan."""
        words = self.book.words
        pairs = y.reshape(len(y), -1, 2)
        if len(words) % 2:
            words, pairs = np.concatenate([words, np.zeros((1, 16, 2), np.float32)]), np.pad(pairs, ((0, 0), (0, 1), (0, 0)))
        part = np.matmul(words, pairs.transpose(1, 2, 0))  # partial products: pair of dimensions, codeword, query
        low = part.min(axis=1, keepdims=True)
        base = self.centres[use] @ y.T
        base -= base.min(axis=0, keepdims=True)
        scale = 60000 / max(1e-9, float(((part - low).max(axis=1).sum(axis=0) + base.max(axis=0)).max()))
        part, base = ((part - low) * scale).astype(np.uint16), (base * scale).astype(np.uint16)
        table = (part[1::2, :, None, :] + part[::2, None, :, :]).reshape(len(words) // 2, 256, len(y))  # by byte: high half, low half
        whole = len(use) == len(self.size)
        rows = np.arange(len(self.x)) if whole else np.concatenate([np.arange(s, s + n) for s, n in zip(self.start[use], self.size[use])])
        both = self.both if whole else self.both[:, rows]
        acc = np.repeat(base, self.size[use], axis=0)
        tmp = np.empty((1024, len(y)), np.uint16)
        for b in range(0, len(rows), 1024):
            s = acc[b : b + 1024]
            t = tmp[: len(s)]
            for m in range(len(table)):
                table[m].take(both[m, b : b + 1024], axis=0, out=t, mode="clip")
                s += t
        return rows, acc

    def calibrate(self, y: np.ndarray, target: float) -> None:
        """Sets how many rows a query probes and how many it reranks, so that the target share of these queries' exact neighbours stays."""
        n, k = len(self.x), min(self.k + 1, len(self.x))
        if not len(y) or n <= 4 * self.k:
            return
        exact = y @ self.x.T
        true = np.argpartition(-exact, k - 1, axis=1)[:, :k]
        near = y @ self.centres.T
        by = np.argsort(-near, axis=1)
        before = np.empty_like(by)
        np.put_along_axis(before, by, np.cumsum(self.size[by], axis=1) - self.size[by], 1)
        home = np.repeat(np.arange(len(self.size)), self.size)
        need = np.take_along_axis(before, home[true], 1)
        self.rows = int(np.quantile(need, target, method="higher")) + 1
        _, acc = self.estimates(y, np.arange(len(self.size)))
        acc = acc.T.copy()
        worst = np.sort(acc, axis=1)
        at = np.take_along_axis(acc, true, 1)
        rank = np.array([n - np.searchsorted(w, a, side="left") for w, a in zip(worst, at)])
        self.short = max(2 * k, int(np.quantile(rank, 1 - (1 - target) / 2, method="higher")))

    def search(self, y: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row of the x given first, cosine), each query's best first, at most k. own: the row that is the query itself, or -1."""
        position = np.empty(len(self.x), np.int64)
        position[self.order] = np.arange(len(self.x))
        own = np.where(own >= 0, position[own], -1)
        near = y @ self.centres.T
        turn = np.lexsort((-near.max(axis=1), near.argmax(axis=1)))
        outs = []
        for a in range(0, len(turn), _BLOCK):
            q = turn[a : a + _BLOCK]
            by = np.argsort(-near[q], axis=1)
            before = np.cumsum(self.size[by], axis=1) - self.size[by]
            wanted = np.zeros(len(self.size), bool)
            wanted[by[before < self.rows]] = True
            rows, acc = self.estimates(y[q], np.flatnonzero(wanted))
            n = len(rows)
            limit = np.zeros(len(q), np.uint16)
            if n > self.short:  # an order statistic of evenly spaced rows, the 16th of them at least
                seen = acc[:: max(1, min(n // 1024, self.short // 16))]
                place = max(0, len(seen) - 1 - -(-self.short * len(seen) // n))
                limit = np.partition(seen, place, axis=0)[place]
            r, c = np.divmod(np.flatnonzero(acc >= limit[None]), len(q))
            by = np.argsort(c.astype(np.uint8), kind="stable")
            r, size = rows[r[by]], np.bincount(c, minlength=len(q))
            wide = np.full((len(q), max(self.k, int(size.max()))), -2, np.float32)
            row = np.zeros(wide.shape, np.int64)
            at = 0
            for i, m in enumerate(size):
                some = r[at : at + m]
                wide[i, :m] = self.x.take(some, axis=0) @ y[q[i]]
                row[i, :m] = some
                at += m
            wide[row == own[q][:, None]] = -2
            top = np.argpartition(-wide, self.k - 1, axis=1)[:, : self.k]
            wide, row = np.take_along_axis(wide, top, 1), np.take_along_axis(row, top, 1)
            best = np.argsort(-wide, axis=1, kind="stable")
            wide, row = np.take_along_axis(wide, best, 1), np.take_along_axis(row, best, 1)
            c, at = np.nonzero(wide > -1.5)
            outs.append((q[c], self.order[row[c, at]], wide[c, at]))
        return tuple(np.concatenate(z) for z in zip(*outs)) if outs else (np.empty(0, int), np.empty(0, int), np.empty(0, np.float32))


@dataclass
class Index:
    """centres of the regions; first cell of each and number of cells that a hash cuts it into; by cell, tasks that its queries are spread over and the first's slot."""

    centres: np.ndarray
    cell: np.ndarray
    cuts: np.ndarray
    tasks: np.ndarray
    slot: np.ndarray
    margin: float = 0.0

    def asked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home region, whether each vector asks each region)."""
        s = x @ self.centres.T
        return s.argmax(axis=1), s >= s.max(axis=1, keepdims=True) - self.margin


def fit_regions(x: np.ndarray, total: int) -> np.ndarray:
    """Centres of the regions of so many vectors, from a sample of unit vectors: k-means, then the fullest are halved while they are over twice the mean."""
    want = max(-(-total // CELL_ROWS), min(SPREAD, total // REGION_LEAST), 1)
    want = min(want, REGIONS_MOST, len(x))
    c = _kmeans(x, want)
    for _ in range(8):
        home = _nearest(x, c)
        size = np.bincount(home, minlength=len(c))
        big = np.flatnonzero((size > 2 * len(x) / want) & (size > 64) & (len(c) < REGIONS_MOST))
        if not len(big):
            break
        halves = [_kmeans(x[home == g], 2) for g in big]
        c = np.concatenate([np.delete(c, big, axis=0), *halves])
    return c


def _pilot_margin(reps: DataFrame, centres: np.ndarray, dims: int, pilots: np.ndarray, ids: np.ndarray, k: int, target: float) -> float:
    """The margin by which regions must be asked for the target share of the pilots' exact neighbours among all vectors."""
    sent = reps.sparkSession.sparkContext.broadcast((centres, pilots, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, y, own = sent.value
        cos, region = np.full((len(y), 0), 0, np.float32), np.empty((len(y), 0), np.int32)
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            s = y @ x.T
            s[own[:, None] == b.column(0).to_numpy()[None]] = -2
            top = np.argpartition(-s, min(k, len(x)) - 1, axis=1)[:, :k]
            cos = np.concatenate([cos, np.take_along_axis(s, top, 1)], axis=1)
            region = np.concatenate([region, _nearest(x[top.ravel()], c).reshape(top.shape).astype(np.int32)], axis=1)
            best = np.argsort(-cos, axis=1)[:, :k]
            cos, region = np.take_along_axis(cos, best, 1), np.take_along_axis(region, best, 1)
        pilot = np.repeat(np.arange(len(y), dtype=np.int32), cos.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(pilot), pa.array(cos.ravel()), pa.array(region.ravel())], names=["pilot", "cosine", "region"])

    rank = F.row_number().over(Window.partitionBy("pilot").orderBy(F.desc("cosine")))
    got = reps.select("id", "v").mapInArrow(run, "pilot int, cosine float, region int").withColumn("r", rank).where((F.col("r") <= k) & (F.col("cosine") > -1.5)).toArrow()
    if not got.num_rows:
        return 0.0
    s = pilots @ centres.T
    at = got["pilot"].to_numpy()
    need = s.max(axis=1)[at] - s[at, got["region"].to_numpy()]
    return float(np.quantile(need, target, method="higher")) + 1e-6


def _slots(spark: SparkSession, n: int) -> list[int]:
    """n integers that a hash exchange of n partitions sends to n different partitions."""
    found: dict[int, int] = {}
    at = 0
    while len(found) < n:
        step = max(64, 8 * n)
        got = spark.range(at, at + step, 1, 1).select(F.col("id").cast("int").alias("x")).select("x", F.pmod(F.hash("x"), F.lit(n)).alias("p")).toArrow()
        for x, p in zip(got["x"].to_pylist(), got["p"].to_pylist()):
            found.setdefault(p, x)
        at += step
    return list(found.values())


_OUT = "slot int, turn int, of int, kind int, id bigint, ids array<bigint>, v binary"


def _routed(reps: DataFrame, index: Index, dims: int) -> DataFrame:
    """A row (kind 0) for each vector in its cell, for each of the cell's tasks; and one (kind 1) for each other cell that it asks."""
    sent = reps.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        region = np.repeat(np.arange(len(ix.cuts)), ix.cuts)  # of each cell
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy().astype(np.int64)
            x = _unit(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            for a in range(0, len(x), 4096):
                xs, i = x[a : a + 4096], ids[a : a + 4096]
                raw = np.ascontiguousarray(xs).view(f"V{4 * dims}").ravel()
                home, asks = ix.asked(xs)
                mixed = i * 0x9E3779B1 & 0x7FFFFFFF
                cell = ix.cell[home] + mixed % ix.cuts[home]
                copies = ix.tasks[cell]
                rows0 = np.repeat(np.arange(len(xs)), copies)
                task0 = np.arange(len(rows0)) - np.repeat(np.cumsum(copies) - copies, copies)
                to = asks[:, region]
                to[np.arange(len(xs)), cell] = False
                rows1, cell1 = np.nonzero(to)
                row, cells = np.concatenate([rows0, rows1]), np.concatenate([cell[rows0], cell1])
                task = np.concatenate([task0, mixed[rows1] // 7 % ix.tasks[cell1]])
                kind = np.concatenate([np.zeros(len(rows0), np.int32), np.ones(len(rows1), np.int32)])
                binary = pa.Array.from_buffers(pa.binary(4 * dims), len(row), [None, pa.py_buffer(raw[row].tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ix.slot[ix.tasks.cumsum()[cells] - ix.tasks[cells] + task].astype(np.int32)), pa.array(task.astype(np.int32)), pa.array(ix.tasks[cells].astype(np.int32)),
                     pa.array(kind), pa.array(i[row]), b.column(1).slice(a, 4096).take(pa.array(row)), binary],
                    names=["slot", "turn", "of", "kind", "id", "ids", "v"],
                )

    return reps.select("id", "ids", "v").mapInArrow(run, _OUT)


def _searched(routed: DataFrame, partitions: int, dims: int, k: int, target: float) -> DataFrame:
    """id, found: the best k of each query in each cell that it asked, as (cosine, id), copies spelled out."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("id").to_numpy(), kind="stable")))  # the same result in whatever order rows come
        ids, kind = table.column("id").to_numpy(), table.column("kind").to_numpy()
        x = np.frombuffer(table.column("v").combine_chunks().buffers()[2], np.float32)[: len(ids) * dims].reshape(-1, dims)
        stored = np.flatnonzero(kind == 0)
        turn, of = table.column("turn")[0].as_py(), table.column("of")[0].as_py()
        mine = np.flatnonzero((kind == 1) | ((ids * 0x9E3779B1 & 0x7FFFFFFF) // 7 % of == turn))
        empty = np.empty(0, int)
        q, r, cos = empty, empty, np.empty(0, np.float32)
        if len(stored) and len(mine):
            store = Store(x[stored], k)
            store.calibrate(x[mine[np.linspace(0, len(mine) - 1, min(len(mine), PILOTS_LOCAL)).astype(int)]], target)
            place = np.full(len(ids), -1)
            place[stored] = np.arange(len(stored))
            q, r, cos = store.search(x[mine], place[mine])
            q, r = mine[q], stored[r]
        lists = table.column("ids").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())[r]
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()[r]
        take = np.repeat(at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        q, cos, nb = np.repeat(q, size), np.repeat(cos, size), flat[take]
        begin = lambda q: np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else empty
        first = begin(q)
        keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
        q, cos, nb = q[keep], cos[keep], nb[keep]
        first = begin(q)
        found = pa.StructArray.from_arrays([pa.array(cos.astype(np.float32)), pa.array(nb)], names=["cosine", "id"])
        return pa.table({"id": pa.array(ids[q[first]]), "found": pa.ListArray.from_arrays(pa.array(np.append(first, len(q)).astype(np.int32)), found)})

    return routed.repartition(partitions, "slot").groupBy("slot").applyInArrow(run, "id bigint, found array<struct<cosine:float,id:bigint>>")


def neighbours(table: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """vec_id, found: an array of the k most similar other vectors as (cosine, id), most similar first, ties by the smaller id.

    Null, zero, NaN and infinite vectors are in no row, nor are those of another number of parts than most have (ties: the larger number).
    Of an empty table, or one vector, no row comes.
    """
    good = table.where(usable(F.col(vec_col))).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    head = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    total, dims = (head["n"], head["d"]) if head else (0, 2)
    good = good.where(F.size("v") == dims)
    if dims % 2:  # pairs of dimensions: a zero part changes no product
        good, dims = good.withColumn("v", F.concat("v", F.array(F.lit(0).cast("float")))), dims + 1

    hashed = good.withColumn("h", F.xxhash64("v")).withColumn("h2", F.hash("v"))
    of = Window.partitionBy("h", "h2").orderBy("id")
    # the ids of copies, the k + 1 smallest: rows are cut per group before they are collected
    many = hashed.groupBy("h", "h2").agg(F.count("*").alias("copies")).where("copies > 1")
    many = materialize(many, "p4-copies")
    few = many.count() <= COPIES_BROADCAST  # else both joins shuffle
    light = F.broadcast if few else (lambda df: df)
    ranked = hashed.select("h", "h2", "id").join(light(many), ["h", "h2"]).withColumn("r", F.row_number().over(of)).where(F.col("r") <= k + 1)
    classes = materialize(ranked.groupBy("h", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids")), "p4-classes")
    reps = hashed.join(light(classes), ["h", "h2"], "left").where("ids is null or id = ids[0]").select("id", F.coalesce("ids", F.array("id")).alias("ids"), "v")

    index = _indexed(reps, total, dims, k, target)
    got = _searched(_routed(reps, index, dims), len(index.slot), dims, k, target)
    # the best of all cells; at most as many lists as cells were asked
    best = F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("found", lambda f: F.struct((-f["cosine"]).alias("c"), f["id"].alias("id")))))), 1, k)
    reps = got.groupBy("id").agg(best.alias("near")).select("id", F.transform("near", lambda f: F.struct((-f["c"]).alias("cosine"), f["id"].alias("id"))).alias("near"))
    members = hashed.select("h", "h2", "id").join(light(classes), ["h", "h2"]).select(F.col("id").alias("member"), F.col("ids")[0].alias("id"), "ids")
    out = reps.join(members, "id", "left")
    own = F.coalesce(F.transform(F.filter("ids", lambda i: i != F.col("member")), lambda i: F.struct(F.lit(1.0).cast("float").alias("cosine"), i.alias("id"))), F.array().cast("array<struct<cosine:float,id:bigint>>"))
    return out.select(F.coalesce("member", "id").alias("vec_id"), F.slice(F.concat(own, "near"), 1, k).alias("found"))


def _indexed(reps: DataFrame, total: int, dims: int, k: int, target: float) -> Index:
    """Regions from a bounded sample, their cells and tasks, and the margin from pilots; the driver sees sample and pilots only."""
    regions = min(REGIONS_MOST, max(-(-total // CELL_ROWS), SPREAD))
    share = min(1.0, max(SAMPLE_LEAST, SAMPLE_PER_REGION * regions) / max(1, total))
    picked = reps.where(F.shiftrightunsigned(F.xxhash64("id"), 1) <= min(2**63 - 1, int(share * 2**63))).select("id", "v").toArrow()
    if not picked.num_rows:
        picked = reps.select("id", "v").limit(1).toArrow()
    ids = picked["id"].to_numpy().astype(np.int64) if picked.num_rows else np.zeros(1, np.int64)
    x = _unit(picked["v"].combine_chunks().flatten().to_numpy().reshape(-1, dims)) if picked.num_rows else np.eye(1, dims, dtype=np.float32)
    mixed = np.argsort(ids * 0x9E3779B1 & 0x7FFFFFFF, kind="stable")  # an order that the ids' own, which may follow content, doesn't show in
    ids, x = ids[mixed], x[mixed]
    centres = fit_regions(x, max(1, total))
    margin = _pilot_margin(reps, centres, dims, x[:PILOTS], ids[:PILOTS], k, target) if len(centres) > 1 else 0.0
    rows = np.bincount(_nearest(x, centres), minlength=len(centres)) / len(x) * total
    cuts = np.maximum(1, np.ceil(rows / CELL_MOST)).astype(np.int64)
    index = Index(centres, np.cumsum(cuts) - cuts, cuts, np.ones(cuts.sum(), np.int64), np.empty(0, np.int64), margin)
    asked = sum((index.asked(x[i : i + 4096])[1].sum(axis=0) for i in range(0, len(x), 4096)), np.zeros(len(centres))) / len(x) * total
    index.tasks = np.maximum(1, np.ceil(np.repeat(asked, cuts) / QUERIES_MOST)).astype(np.int64)
    index.slot = np.array(_slots(reps.sparkSession, int(index.tasks.sum())))
    return index


def near_pairs(found: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id_a, vec_id_b (smaller first): pairs of which one is among the other's most similar, at a cosine of at least that."""
    near = found.select("vec_id", F.explode(F.filter("found", lambda f: f["cosine"] >= least)).alias("f"))
    return near.select(F.least("vec_id", "f.id").alias("vec_id_a"), F.greatest("vec_id", "f.id").alias("vec_id_b")).distinct()
