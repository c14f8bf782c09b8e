"""Queries on keys, search, retrieval and evaluation over the embeddings table, and their SQL.

Vectors whose id divides by ten are queries, the others candidates. A query's judgements are the vectors of the same label at the distances of JUDGED, in that
order; some have none, and some name vectors that are no candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.operators import keys, search

Query = Callable[[SparkSession, str], DataFrame]
K = 8
JUDGED = (20, 37, 21, 13, 5, 1)
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class World:
    """The tables of one query, each made when first asked for."""

    def __init__(self, spark: SparkSession, sf: str, **books):
        self.spark, self.sf, self.v = spark, sf, spark.read.parquet(f"{sf}/embeddings.parquet")
        self.q, self.c = self.v.where("vec_id % 10 = 0"), self.v.where("vec_id % 10 <> 0")
        self.books = search.load_books(self.v, **books)
        self._coded = self._index = None

    @property
    def coded(self) -> DataFrame:
        if self._coded is None:
            self._coded = search.materialize(search.encode(self.c, self.books), "coded")
        return self._coded

    @property
    def index(self) -> DataFrame:
        if self._index is None:
            self._index = search.distinct_keys(self.coded)
        return self._index

    @property
    def qids(self) -> DataFrame:
        return self.q.select(F.col("vec_id").alias("qid"))

    def beams(self, **kw) -> DataFrame:
        return search.block_search(self.q, self.index, self.books, K, **kw)

    def block(self) -> DataFrame:
        return self.beams(spans=[1, 2], prefix_width=4)

    def judged(self) -> DataFrame:
        """qid, pos, did."""
        near = F.array(*(F.col("vec_id") + d for d in JUDGED))
        asks = self.q.select(F.col("vec_id").alias("qid"), F.col("label").alias("l"), F.posexplode(near).alias("pos", "did"))
        return asks.join(self.v.select(F.col("vec_id").alias("did"), F.col("label").alias("l")), ["did", "l"]).select("qid", "pos", "did")

    def judged_paths(self) -> DataFrame:
        """qid, codes: the distinct keys of each query's judged candidates."""
        return self.judged().join(self.coded.select(F.col("vec_id").alias("did"), "codes"), "did").select("qid", "codes").distinct()

    def same_label(self, pairs: DataFrame) -> DataFrame:
        """The pairs (qid, did) of one label: the labels are joined to what was found, so no pair is made for it."""
        label = lambda k: self.v.select(F.col("vec_id").alias(k), F.col("label").alias("l"))
        return pairs.join(label("qid"), "qid").join(label("did"), ["did", "l"]).drop("l")


def _query(sql: str | None, **books):
    """Register a function of a World as a query, with the SQL that gives the same rows."""

    def register(f: Callable[[World], DataFrame]) -> Callable[[World], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf: f(World(spark, sf, **books))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def base(width: int = 16, stride: int = 16) -> str:
    """The CTEs v, book, coded, cands, leaf, edge, q and j."""
    judged = ", ".join(f"({i}, {d})" for i, d in enumerate(JUDGED))
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
book AS (SELECT level, CAST(vec_id - level * {stride} AS INTEGER) AS c, list_transform(e, lambda x: x * 0.35) AS w FROM v, (VALUES (0), (1), (2)) l(level) WHERE vec_id >= level * {stride} AND vec_id < level * {stride} + {width}),
e1 AS (SELECT v.vec_id, arg_min(c, (list_dot_product(w, w) - 2 * list_dot_product(e, w), c)) AS a FROM v, book WHERE level = 0 GROUP BY v.vec_id),
r1 AS (SELECT v.vec_id, label, e, a, list_transform(list_zip(e, w), lambda x: x[1] - x[2]) AS r FROM v JOIN e1 USING (vec_id) JOIN book ON level = 0 AND c = a),
e2 AS (SELECT vec_id, arg_min(c, (list_dot_product(w, w) - 2 * list_dot_product(r, w), c)) AS b FROM r1, book WHERE level = 1 GROUP BY vec_id),
r2 AS (SELECT vec_id, label, e, a, b, r AS ra, list_transform(list_zip(r, w), lambda x: x[1] - x[2]) AS r FROM r1 JOIN e2 USING (vec_id) JOIN book ON level = 1 AND c = b),
e3 AS (SELECT vec_id, arg_min(c, (list_dot_product(w, w) - 2 * list_dot_product(r, w), c)) AS d FROM r2, book WHERE level = 2 GROUP BY vec_id),
r3 AS (SELECT vec_id, label, e, a, b, d, ra, r2.r AS rb, list_transform(list_zip(r2.r, w), lambda x: x[1] - x[2]) AS r FROM r2 JOIN e3 USING (vec_id) JOIN book ON level = 2 AND c = d),
coded AS (SELECT vec_id, label, e, a, b, d, '<a' || a || '><b' || b || '><c' || d || '>' AS code, list_dot_product(r, r) AS energy, list_dot_product(ra, ra) AS energy1, list_dot_product(rb, rb) AS energy2 FROM r3),
cands AS (SELECT * FROM coded WHERE vec_id % 10 <> 0),
leaf AS (SELECT a, b, d, code, count(*) AS items FROM cands GROUP BY ALL),
edge AS (
  SELECT 0 AS depth, '' AS prefix, a AS token, '<a' || a || '>' AS child, sum(items)::BIGINT AS items, count(*) AS leaves FROM leaf GROUP BY a
  UNION ALL SELECT 1, '<a' || a || '>', b, '<a' || a || '><b' || b || '>', sum(items)::BIGINT, count(*) FROM leaf GROUP BY a, b
  UNION ALL SELECT 2, '<a' || a || '><b' || b || '>', d, code, sum(items)::BIGINT, count(*) FROM leaf GROUP BY a, b, d, code),
q AS (SELECT vec_id AS qid, label, e FROM coded WHERE vec_id % 10 = 0),
j AS (SELECT q.qid, o.pos, v.vec_id AS did FROM q, (VALUES {judged}) o(pos, away), v WHERE v.vec_id = q.qid + o.away AND v.label = q.label)
"""


def _lp(name: str, src: str, level: int, key: str, guidance: float = 1, temperature: float = 1) -> str:
    """CTE name(key, c, lp): log-softmax of the evidence of src.r over a level."""
    return f"""
{name}_g AS (SELECT {key}, c, ({guidance} * 2 * list_dot_product(r, w) - list_dot_product(w, w)) / {temperature} AS g FROM {src}, book WHERE level = {level}),
{name} AS (SELECT {key}, c, g - max(g) OVER p - ln(sum(exp(g - mx)) OVER p) AS lp FROM (SELECT *, max(g) OVER (PARTITION BY {key}) AS mx FROM {name}_g) WINDOW p AS (PARTITION BY {key}))"""


_MINUS = "list_transform(list_zip({r}, w), lambda x: x[1] - x[2]) AS r"
_DOMAIN = {"a": "SELECT c AS a FROM book WHERE level = 0", "b": "SELECT DISTINCT x.c AS a, y.c AS b FROM book x, book y WHERE x.level = 0 AND y.level = 1", "d": "SELECT x.c AS a, y.c AS b, z.c AS d, '<a' || x.c || '><b' || y.c || '><c' || z.c || '>' AS code FROM book x, book y, book z WHERE x.level = 0 AND y.level = 1 AND z.level = 2"}
_STORED = {"a": "SELECT DISTINCT a FROM leaf", "b": "SELECT DISTINCT a, b FROM leaf", "d": "SELECT a, b, d, code FROM leaf"}


def _nucleus(rows: str, by: str, p: float | None, scope: str) -> str:
    """rows (with lp), cut to the nucleus among the rows of `by`."""
    if p is None or scope == "level":
        return rows
    return f"SELECT * EXCLUDE (rn, cum) FROM (SELECT *, row_number() OVER o AS rn, sum(exp(lp)) OVER (o ROWS UNBOUNDED PRECEDING) / sum(exp(lp)) OVER (PARTITION BY {by}) AS cum FROM ({rows}) WINDOW o AS (PARTITION BY {by} ORDER BY lp DESC)) WHERE rn = 1 OR cum <= {p}"


def _level_nucleus(name: str, key: str, p: float | None, scope: str) -> str:
    """The CTE to read lp from: the level's nucleus where that is the scope."""
    if p is None or scope == "legal":
        return f", {name}n AS (SELECT * FROM {name})"
    return f", {name}n AS (SELECT * EXCLUDE (rn, cum) FROM (SELECT *, row_number() OVER o AS rn, sum(exp(lp)) OVER (o ROWS UNBOUNDED PRECEDING) AS cum FROM {name} WINDOW o AS (PARTITION BY {key} ORDER BY lp DESC)) WHERE rn = 1 OR cum <= {p})"


def sequential(k1: int = K, k2: int = K, stored: bool = True, guidance: float = 1, temperature: float = 1, p: float | None = None, scope: str = "legal", name: str = "beams", hook: str = "") -> str:
    """CTEs down to name(qid, code, s): level by level."""
    h = lambda c: hook.format(c=c)
    dom, opt = _STORED if stored else _DOMAIN, (guidance, temperature)
    one = _nucleus(f"SELECT qid, a, lp{h('a')} AS lp FROM l0n JOIN ({dom['a']}) x ON c = a", "qid", p, scope)
    two = _nucleus(f"SELECT q1.qid, a, x.b, q1.s, q1.code, lp{h('x.b')} AS lp FROM q1 JOIN ({dom['b']}) x USING (a) JOIN l1n ON l1n.qid = q1.qid AND l1n.a = q1.a AND l1n.c = x.b", "qid, a", p, scope)
    three = _nucleus(f"SELECT q2.qid, q2.a, q2.b, x.code, q2.s, lp{h('x.d')} AS lp FROM q2 JOIN ({dom['d']}) x USING (a, b) JOIN l2n ON l2n.qid = q2.qid AND l2n.a = q2.a AND l2n.b = q2.b AND l2n.c = x.d", "qid, a, b", p, scope)
    top = "QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, code) <= "
    return (
        ", q0 AS (SELECT qid, e AS r FROM q)," + _lp("l0", "q0", 0, "qid", *opt) + _level_nucleus("l0", "qid", p, scope)
        + f", f1 AS (SELECT qid, a, '<a' || a || '>' AS code, lp AS s FROM ({one}) {top}{k1})"
        + f", q1 AS (SELECT f1.qid, a, s, code, {_MINUS.format(r='e')} FROM f1 JOIN q USING (qid) JOIN book ON level = 0 AND c = a)," + _lp("l1", "q1", 1, "qid, a", *opt) + _level_nucleus("l1", "qid, a", p, scope)
        + f", f2 AS (SELECT * FROM (SELECT qid, a, b, code || '<b' || b || '>' AS code, s + lp AS s FROM ({two})) {top}{k2})"
        + f", q2 AS (SELECT f2.qid, f2.a, f2.b, f2.s, {_MINUS.format(r='q1.r')} FROM f2 JOIN q1 ON q1.qid = f2.qid AND q1.a = f2.a JOIN book ON level = 1 AND c = f2.b)," + _lp("l2", "q2", 2, "qid, a, b", *opt) + _level_nucleus("l2", "qid, a, b", p, scope)
        + f", {name} AS (SELECT * FROM (SELECT qid, code, s + lp AS s FROM ({three})) {top}{K})"
    )


def blocks(mode: str = "b.lp + d.lp", k1: int = 4, name: str = "beams", levelwise: bool = False) -> str:
    """CTEs down to name(qid, code, s): one level, then a block of two by the evidence of its prefix. Needs f1, q1 and l1 of the same widths, which it makes unless name isn't beams."""
    top = "QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, code) <= "
    pruned = (
        f", w2 AS (SELECT * FROM (SELECT q1.qid, q1.a, x.b, q1.code || '<b' || x.b || '>' AS code, q1.s + lp AS s FROM q1 JOIN ({_STORED['b']}) x USING (a) JOIN l1 ON l1.qid = q1.qid AND l1.a = q1.a AND l1.c = x.b) {top}{K})"
        if levelwise else ""
    )
    first = (
        ", q0 AS (SELECT qid, e AS r FROM q)," + _lp("l0", "q0", 0, "qid")
        + f", f1 AS (SELECT qid, a, '<a' || a || '>' AS code, lp AS s FROM l0 JOIN ({_STORED['a']}) x ON c = a {top}{k1})"
        + f", q1 AS (SELECT f1.qid, a, s, code, {_MINUS.format(r='e')} FROM f1 JOIN q USING (qid) JOIN book ON level = 0 AND c = a)," + _lp("l1", "q1", 1, "qid, a")
        if name == "beams" else ""
    )
    return (
        first + "," + _lp("m2", "q1", 2, "qid, a") + pruned
        + f", {name} AS (SELECT * FROM (SELECT q1.qid, leaf.code, q1.s + {mode} AS s FROM q1 JOIN leaf USING (a) JOIN l1 b ON b.qid = q1.qid AND b.a = q1.a AND b.c = leaf.b JOIN m2 d ON d.qid = q1.qid AND d.a = q1.a AND d.c = leaf.d"
        + (" SEMI JOIN w2 ON w2.qid = q1.qid AND w2.a = leaf.a AND w2.b = leaf.b" if levelwise else "") + f") {top}{K})"
    )


_ONE = (
    ", q0 AS (SELECT qid, e AS r FROM q)," + _lp("l0", "q0", 0, "qid") + "," + _lp("l1", "q0", 1, "qid") + "," + _lp("l2", "q0", 2, "qid")
    + ", beams AS (SELECT l0.qid, code, l0.lp + l1.lp + l2.lp AS s FROM leaf JOIN l0 ON l0.c = a JOIN l1 ON l1.qid = l0.qid AND l1.c = b JOIN l2 ON l2.qid = l0.qid AND l2.c = d"
    " QUALIFY row_number() OVER (PARTITION BY l0.qid ORDER BY l0.lp + l1.lp + l2.lp DESC, code) <= 8)"
)
_RANKED = ", ranked AS (SELECT qid, code, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, code) AS beam_rank FROM beams)"
_OUT = _RANKED + " SELECT qid, CAST(beam_rank AS INTEGER) AS beam_rank, code, round(s, 5) AS score FROM ranked"
_BASE, _BLOCK, _SEQ = base(), blocks(), sequential()


def _beams(df: DataFrame, *more: str) -> DataFrame:
    return df.select("qid", "beam_rank", F.col("prefix").alias("code"), F.round("score", 5).alias("score"), *more)


@_query(_BASE + "SELECT vec_id, code, round(energy, 5) AS energy FROM coded")
def encode(w):
    return search.encode(w.v, w.books).select("vec_id", keys.code_text(F.col("codes")).alias("code"), F.round(F.element_at("energies", -1), 5).alias("energy"))


@_query(base(256, 64) + "SELECT vec_id, code, round(energy, 5) AS energy FROM coded", width=256, stride=64)
def encode_wide(w):
    return encode(w)


@_query(_BASE + "SELECT vec_id, a || ',' || b || ',' || d AS codes FROM coded")
def code_roundtrip(w):
    return encode(w).select("vec_id", F.array_join(keys.text_code(F.col("code")), ",").alias("codes"))


@_query(_BASE + "SELECT vec_id, a + 3 || ',' || b + 19 || ',' || d + 35 AS tokens, '<a' || a || '><b' || b || '>' AS prefix, a || ',' || b || ',' || d AS codes FROM coded")
def token_ids(w):
    t = search.encode(w.v, w.books).select("vec_id", keys.codes_to_tokens(F.col("codes"), [3, 19, 35], 16).alias("t"), keys.code_text(F.slice("codes", 1, 2)).alias("prefix"))
    return t.select("vec_id", F.array_join("t", ",").alias("tokens"), "prefix", F.array_join(keys.tokens_to_codes(F.col("t"), [3, 19, 35], 16), ",").alias("codes"))


@_query(_BASE + "SELECT sum(items)::BIGINT AS items, count(*) AS distinct_keys, count(*) FILTER (items > 1) AS shared_keys, sum(items - 1)::BIGINT AS collisions, round(sum(items - 1) / sum(items), 6) AS collision_rate, max(items) AS largest FROM leaf")
def collisions(w):
    return w.index.agg(
        F.sum("items").alias("items"), F.count("*").alias("distinct_keys"), F.count(F.when(F.col("items") > 1, 1)).alias("shared_keys"), F.sum(F.col("items") - 1).alias("collisions"),
        F.round(F.sum(F.col("items") - 1) / F.sum("items"), 6).alias("collision_rate"), F.max("items").alias("largest"),
    )


@_query(_BASE + "SELECT code, count(*) AS items, count(*) - 1 AS changes, max(n) AS last_suffix FROM (SELECT code, vec_id, row_number() OVER (PARTITION BY code ORDER BY vec_id) - 1 AS n FROM cands) GROUP BY code")
def unique_suffixes(w):
    """Per key, in the order of ids: how often another vector takes a used key, and the suffix that this makes unique."""
    by = Window.partitionBy("codes").orderBy("vec_id")
    rows = w.coded.select("codes", "vec_id", (F.row_number().over(by) - 1).cast("bigint").alias("n"), (F.lag("vec_id").over(by) != F.col("vec_id")).cast("bigint").alias("changed"))
    return rows.groupBy("codes").agg(F.count("*").alias("items"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changes"), F.max("n").alias("last_suffix")).select(keys.code_text(F.col("codes")).alias("code"), "items", "changes", "last_suffix")


@_query(_BASE + "SELECT * FROM edge")
def index_edges(w):
    return keys.edges(w.index, w.books.levels)


@_query(
    _BASE + ", n AS (SELECT depth, count(*) AS prefixes, count(DISTINCT prefix) AS nodes, round(count(*) / count(DISTINCT prefix), 6) AS fan_out, max(items) AS largest, round(sum(items * items) / sum(items), 6) AS expected_bucket, round(quantile_cont(items, 0.5), 6) AS p50, round(quantile_cont(items, 0.95), 6) AS p95,"
    " round(-sum(p * log2(p)), 6) AS entropy_bits FROM (SELECT *, items / sum(items) OVER (PARTITION BY depth) AS p FROM edge) GROUP BY depth) SELECT *, round(prefixes / coalesce(lag(prefixes) OVER (ORDER BY depth), 1), 6) AS branching FROM n"
)
def prefix_stats(w):
    e = keys.edges(w.index, w.books.levels)
    all_items = w.index.agg(F.sum("items").alias("total"))  # one row: the same at every depth
    e = e.crossJoin(F.broadcast(all_items)).withColumn("p", F.col("items") / F.col("total"))
    per = e.groupBy("depth").agg(
        F.count("*").alias("prefixes"), F.countDistinct("prefix").alias("nodes"), F.round(F.count("*") / F.countDistinct("prefix"), 6).alias("fan_out"), F.max("items").alias("largest"),
        F.round(F.sum(F.col("items") * F.col("items")) / F.sum("items"), 6).alias("expected_bucket"), F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy_bits"),
    )
    per = per.join(keys.exact_percentiles(e, "depth", "items", {"p50": 0.5, "p95": 0.95}), "depth")
    return per.withColumn("branching", F.round(F.col("prefixes") / F.coalesce(F.lag("prefixes").over(Window.orderBy("depth")), F.lit(1)), 6))  # one row a depth


@_query(
    _BASE + ", u AS (SELECT level, c, count(*) AS n FROM (SELECT 0 AS level, a AS c FROM cands UNION ALL SELECT 1, b FROM cands UNION ALL SELECT 2, d FROM cands) GROUP BY ALL), p AS (SELECT u.*, n / sum(n) OVER (PARTITION BY level) AS p, list_dot_product(w, w) AS ww FROM u JOIN book USING (level, c))"
    " SELECT level, count(*) AS codes, round(-sum(p * log2(p)), 6) AS entropy_bits, round(-sum(p * log2(p)) / log2(16), 6) AS normalised_entropy, round(pow(2, -sum(p * log2(p))), 5) AS effective_codes, round(exp(-sum(p * ln(p + 1e-6))), 5) AS perplexity, round(avg(ww), 6) AS mean_energy, round(sum(p * ww), 6) AS used_energy FROM p GROUP BY level"
)
def code_usage(w):
    """Per level: used codes, entropy, effective codes, perplexity, and the codewords' energy, plain and weighted by use."""
    used = w.index.select("items", F.posexplode("codes").alias("level", "code")).groupBy("level", "code").agg(F.sum("items").alias("n"))
    energy = [(k, c, float(x)) for k, level in enumerate((w.books.words**2).sum(axis=2)) for c, x in enumerate(level) if x == x]
    p = used.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("level"))).join(F.broadcast(w.spark.createDataFrame(energy, "level int, code int, ww double")), ["level", "code"])
    h = -F.sum(F.col("p") * F.log2("p"))
    return p.groupBy("level").agg(
        F.count("*").alias("codes"), F.round(h, 6).alias("entropy_bits"), F.round(h / F.log2(F.lit(float(w.books.words.shape[1]))), 6).alias("normalised_entropy"), F.round(F.pow(F.lit(2.0), h), 5).alias("effective_codes"),
        F.round(F.exp(-F.sum(F.col("p") * F.log(F.col("p") + 1e-6))), 5).alias("perplexity"), F.round(F.avg("ww"), 6).alias("mean_energy"), F.round(F.sum(F.col("p") * F.col("ww")), 6).alias("used_energy"),
    )


@_query(_BASE + "SELECT levels, round(avg(x), 5) AS mean_energy, round(quantile_cont(x, 0.5), 5) AS median_energy, round(avg(g), 5) AS mean_gain FROM (SELECT 1 AS levels, energy1 AS x, list_dot_product(e, e) - energy1 AS g FROM coded UNION ALL SELECT 2, energy2, energy1 - energy2 FROM coded UNION ALL SELECT 3, energy, energy2 - energy FROM coded) GROUP BY levels")
def reconstruction_gain(w):
    """Energy left after each number of levels, and what the level took away; from one pass of encoding."""
    whole = w.v.select("vec_id", keys.let(F.col("embedding").cast("array<double>"), lambda x: keys.dot(x, x)).alias("whole"))
    each = search.encode(w.v, w.books).join(whole, "vec_id").select("whole", "energies", F.posexplode("energies").alias("at", "x"))
    each = each.select((F.col("at") + 1).alias("levels"), "x", (F.when(F.col("at") == 0, F.col("whole")).otherwise(F.get("energies", F.col("at") - 1)) - F.col("x")).alias("g"))
    mean = each.groupBy("levels").agg(F.round(F.avg("x"), 5).alias("mean_energy"), F.round(F.avg("g"), 5).alias("mean_gain"))
    return mean.join(keys.exact_percentiles(each, "levels", "x", {"median_energy": 0.5}, 5), "levels")


@_query(None)
def trained_codebook(w):
    """Codebooks by k-means on each level's residuals: used codes and mean energy left, by level."""
    books = search.trained_books(w.v, 3, 16)
    got = search.encode(w.v, books).select(F.posexplode("energies").alias("level", "x"), "codes")
    return got.groupBy("level").agg(F.countDistinct(F.get("codes", F.col("level"))).alias("codes"), F.round(F.avg("x"), 5).alias("mean_energy"))


@_query(_BASE + _SEQ + _OUT)
def search_sequential(w):
    return _beams(w.beams())


@_query(_BASE + _BLOCK + _OUT)
def search_block(w):
    return _beams(w.block())


@_query(_BASE + _ONE + _OUT)
def search_one_pass(w):
    return _beams(w.beams(spans=[3]))


@_query(base(256, 64) + _BLOCK + _OUT, width=256, stride=64)
def search_wide(w):
    """The block search over levels of 256 codes."""
    return _beams(w.block())


@_query(_BASE + blocks("(b.lp + d.lp) / 2") + _OUT)
def search_block_mean(w):
    return _beams(w.beams(spans=[1, 2], prefix_width=4, how=search.Scoring(mode="mean")))


@_query(_BASE + blocks("d.lp") + _OUT)
def search_block_last(w):
    """The first round's single code is its own last."""
    return _beams(w.beams(spans=[1, 2], prefix_width=4, how=search.Scoring(mode="last")))


@_query(_BASE + blocks("0").replace("'<a' || a || '>' AS code, lp AS s", "'<a' || a || '>' AS code, 0.0 AS s") + _OUT)
def search_block_prefix(w):
    """No code counts: the smallest key texts."""
    return _beams(w.beams(spans=[1, 2], prefix_width=4, how=search.Scoring(mode="prefix")))


@_query(_BASE + blocks(levelwise=True) + _OUT)
def search_levelwise(w):
    return _beams(w.beams(spans=[1, 2], prefix_width=4, levelwise=True))


_PROJECTED = (
    ", q0 AS (SELECT qid, e AS r FROM q)," + _lp("l0", "q0", 0, "qid") + "," + _lp("l1", "q0", 1, "qid") + "," + _lp("l2", "q0", 2, "qid")
    + f", f1 AS (SELECT qid, a, '<a' || a || '>' AS code, lp AS s FROM l0 JOIN ({_STORED['a']}) x ON c = a QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, code) <= 8)"
    + f", f2 AS (SELECT * FROM (SELECT f1.qid, a, x.b, f1.code || '<b' || x.b || '>' AS code, f1.s + lp AS s FROM f1 JOIN ({_STORED['b']}) x USING (a) JOIN l1 ON l1.qid = f1.qid AND l1.c = x.b) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, code) <= 8)"
    + f", beams AS (SELECT * FROM (SELECT f2.qid, x.code, f2.s + lp AS s FROM f2 JOIN ({_STORED['d']}) x USING (a, b) JOIN l2 ON l2.qid = f2.qid AND l2.c = x.d) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, code) <= 8)"
)


@_query(_BASE + _PROJECTED + _OUT)
def search_projected(w):
    """One prediction of all levels, projected onto the index level by level."""
    return _beams(w.beams(spans=[3], levelwise=True))


@_query(
    _BASE + _ONE + ", s AS (SELECT b.qid, b.code, f.a, f.b, f.d, l0.lp AS x0, l1.lp AS x1, l2.lp AS x2 FROM beams b JOIN leaf f USING (code) JOIN l0 ON l0.qid = b.qid AND l0.c = f.a JOIN l1 ON l1.qid = b.qid AND l1.c = f.b JOIN l2 ON l2.qid = b.qid AND l2.c = f.d)"
    " SELECT qid, code, CASE WHEN x0 < least(x1, x2) THEN '?' ELSE a::VARCHAR END || ',' || CASE WHEN x1 < x2 AND x1 <= x0 THEN '?' ELSE b::VARCHAR END || ',' || CASE WHEN x2 <= x0 AND x2 <= x1 THEN '?' ELSE d::VARCHAR END AS kept FROM s"
)
def refined_keys(w):
    """Keys of the one-pass search with the surest two of three positions, the other open again."""
    got = search.refined(search.position_scores(w.beams(spans=[3]), w.q, w.books), 0.6)
    return got.select("qid", keys.code_text(F.col("codes")).alias("code"), F.array_join(F.transform("kept", lambda c: F.coalesce(c.cast("string"), F.lit("?"))), ",").alias("kept"))


@_query(_BASE + sequential(stored=False) + _OUT)
def search_tokens(w):
    """Without an index: every code of a level is legal."""
    return _beams(search.block_search(w.q, None, w.books, K))


@_query(_BASE + sequential(guidance=1.5) + _OUT)
def search_guided(w):
    return _beams(w.beams(how=search.Scoring(guidance=1.5)))


@_query(_BASE + sequential(temperature=0.5) + _OUT)
def search_tempered(w):
    return _beams(w.beams(how=search.Scoring(temperature=0.5)))


@_query(_BASE + sequential(p=0.6, temperature=0.1) + _OUT)
def search_nucleus(w):
    """Codes beyond a probability of 0.6 among the legal ones are dropped, the first of a prefix never."""
    return _beams(w.beams(how=search.Scoring(top_p=0.6, temperature=0.1)))


@_query(_BASE + sequential(p=0.6, temperature=0.1, scope="level") + _OUT)
def search_level_nucleus(w):
    """The same among all codes of the level, before legality; a query whose codes all fall out has no rows."""
    return _beams(w.beams(how=search.Scoring(top_p=0.6, temperature=0.1, scope="level")))


def _odd_less(qid, codes, score):
    return score - 0.01 * (codes[:, -1] % 2)


@_query(_BASE + sequential(hook=" - 0.01 * ({c} % 2)") + _OUT)
def search_hooked(w):
    """A hook that replaces each round's scores before the choice."""
    return _beams(w.beams(how=search.Scoring(hook=_odd_less)))


@_query(_BASE + _SEQ + _RANKED + " SELECT qid, CAST(beam_rank AS INTEGER) AS beam_rank, code, round(s / 3, 5) AS score FROM ranked")
def length_normalised(w):
    return _beams(keys.length_normalised(w.beams()))


@_query(_BASE + _SEQ + _RANKED + ", many AS (SELECT qid, code, s FROM beams UNION ALL SELECT qid, code, s - beam_rank FROM ranked UNION ALL SELECT qid, '<a0><b0><c0>', -99 FROM q) SELECT qid, code, round(max(s), 5) AS score FROM many GROUP BY qid, code")
def best_of_sequences(w):
    """Sequences that came several times keep their best score."""
    b = w.beams().select("qid", F.col("prefix").alias("code"), "score", "beam_rank")
    many = b.drop("beam_rank").unionByName(b.select("qid", "code", (F.col("score") - F.col("beam_rank")).alias("score"))).unionByName(w.qids.select("qid", F.lit("<a0><b0><c0>").alias("code"), F.lit(-99.0).alias("score")))
    return keys.best_sequences(many).withColumn("score", F.round("score", 5))


_PLAN = sequential(4, 4, name="slow") + blocks(name="fast")


def _planned(rule: str) -> str:
    ready = f", ready AS (SELECT qid FROM f1 JOIN (SELECT a, count(*) AS n FROM leaf GROUP BY a) USING (a) GROUP BY qid HAVING {rule})"
    beams = ", beams AS (SELECT *, 1 AS stop_depth FROM fast SEMI JOIN ready USING (qid) UNION ALL SELECT *, 2 FROM slow ANTI JOIN ready USING (qid))"
    return _BASE + _PLAN + ready + beams + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, code) AS beam_rank FROM beams)"


_PLANNED = " SELECT qid, CAST(beam_rank AS INTEGER) AS beam_rank, code, round(s, 5) AS score, stop_depth FROM ranked"


@_query(_planned("sum(n) <= 110") + _PLANNED)
def search_planned(w):
    """Each query finishes in one block once its prefixes hold at most 110 keys."""
    return _beams(search.planned_search(w.q, w.index, w.books, K, budget=110, prefix_width=4), "stop_depth")


@_query(_planned("max(n) <= 32") + _PLANNED)
def search_adaptive(w):
    """Each query finishes in one block once each of its prefixes holds at most 32 keys."""
    return _beams(search.planned_search(w.q, w.index, w.books, K, each=32, prefix_width=4), "stop_depth")


@_query(_planned("sum(n) <= 110") + " SELECT stop_depth, count(DISTINCT qid) AS queries, round(count(DISTINCT qid) / (SELECT count(*) FROM q), 4) AS share, (SELECT round(avg(d), 4) FROM (SELECT DISTINCT qid, stop_depth AS d FROM ranked)) AS mean_depth FROM ranked GROUP BY stop_depth")
def stop_depths(w):
    per = search.planned_search(w.q, w.index, w.books, K, budget=110, prefix_width=4).groupBy("qid").agg(F.first("stop_depth").alias("stop_depth"))
    by = per.groupBy("stop_depth").agg(F.count("*").alias("queries"))
    mean = by.agg(F.round(F.sum(F.col("stop_depth") * F.col("queries")) / F.sum("queries"), 4).alias("mean_depth"))
    n = w.q.agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(n)).select("stop_depth", "queries", F.round(F.col("queries") / F.col("n"), 4).alias("share"), "mean_depth")


@_query("SELECT * FROM (VALUES " + ", ".join(f"({n}, {str(f).lower()}, {i}, {a}, {z})" for n, f in ((9, False), (9, True)) for i, (a, z) in enumerate(search.planner_spans(n, 3, f))) + ") t(levels, finish, span_no, first_level, end_level)")
def planner_spans(w):
    rows = [(9, f, i, a, z) for f in (False, True) for i, (a, z) in enumerate(search.planner_spans(9, 3, f))]
    return w.spark.createDataFrame(rows, "levels int, finish boolean, span_no int, first_level int, end_level int")


@_query(_BASE + _BLOCK + " SELECT qid, sum(n)::BIGINT AS leaves, max(n) AS largest, least(sum(n), 101)::BIGINT AS stopped, sum(n) <= 100 AS within FROM f1 JOIN (SELECT a, count(*) AS n FROM leaf GROUP BY a) USING (a) GROUP BY qid")
def exposed_leaves(w):
    """Stored keys under the prefixes that the first round of the block search keeps, and the count as one that stops past 100 gives it."""
    first = search._expanded(search.start(w.q), w.index, w.books, 0, 1, 4, search.Scoring(), 0, True)
    n = first.select("qid", "codes").distinct().join(search.leaves(w.index, 1), "codes").groupBy("qid").agg(F.sum("leaves").alias("leaves"), F.max("leaves").alias("largest"))
    return n.select("*", F.least("leaves", F.lit(101)).cast("bigint").alias("stopped"), (F.col("leaves") <= 100).alias("within"))


@_query(_BASE + "SELECT prefix, list_aggregate(list_sort(list(token)), 'string_agg', ',') AS next, count(*) AS n FROM edge GROUP BY prefix")
def index_children(w):
    e = keys.edges(w.index, w.books.levels)
    return e.groupBy("prefix").agg(F.array_join(F.array_sort(F.collect_list("token")), ",").alias("next"), F.count("*").alias("n"))


@_query(_BASE + "SELECT '<a' || a || '>' AS prefix, code[strpos(code, '<b'):] AS suffix FROM leaf")
def index_continuations(w):
    rows = search.continuations(w.index, 1, 2).select("codes", F.explode("next").alias("s"))
    return rows.select(keys.code_text(F.col("codes")).alias("prefix"), F.concat(F.lit("<b"), F.col("s")[0].cast("string"), F.lit("><c"), F.col("s")[1].cast("string"), F.lit(">")).alias("suffix"))


_NODES = """, node AS (SELECT depth, prefix, token, child, dense_rank() OVER (PARTITION BY depth ORDER BY prefix) - 1 AS parent, row_number() OVER (PARTITION BY depth ORDER BY prefix, token) - 1 AS id FROM edge)"""


@_query(_BASE + _NODES + " SELECT depth, parent::BIGINT AS parent, min(id)::BIGINT AS begin, count(*) AS n FROM node GROUP BY depth, parent")
def index_offsets(w):
    """The flat index: by depth and node, where its children begin and how many they are."""
    return keys.flat_nodes(keys.edges(w.index, w.books.levels)).groupBy("depth", "parent").agg(F.min("id").alias("begin"), F.count("*").alias("n"))


@_query(_BASE + _NODES + " SELECT depth, count(DISTINCT parent) AS nodes, count(*) AS edges, 4 * (count(DISTINCT parent) + 1) + 4 * count(*) AS bytes FROM node GROUP BY depth")
def index_bytes(w):
    """Size of the flat index: offsets and codes of four bytes."""
    n = keys.edges(w.index, w.books.levels).groupBy("depth").agg(F.countDistinct("prefix").alias("nodes"), F.count("*").alias("edges"))
    return n.withColumn("bytes", 4 * (F.col("nodes") + 1) + 4 * F.col("edges"))


@_query(_BASE + _BLOCK + _NODES + " SELECT f1.qid, f1.a AS owner, n.token, n.id AS child, count(*) OVER (PARTITION BY f1.qid, f1.a) AS n FROM f1 JOIN node n ON n.prefix = f1.code")
def index_expansion(w):
    """Each state's stored children with their owner, node number and the owner's count."""
    first = search._expanded(search.start(w.q), w.index, w.books, 0, 1, 4, search.Scoring(), 0, True)
    nodes = keys.flat_nodes(keys.edges(w.index, w.books.levels)).where("depth = 1")
    return first.select("qid", F.col("codes")[0].alias("owner"), keys.code_text(F.col("codes")).alias("prefix")).join(nodes, "prefix").select(
        "qid", "owner", "token", F.col("id").alias("child"), F.count("*").over(Window.partitionBy("qid", "owner")).alias("n")
    )


@_query(_BASE + _BLOCK + ", g AS (SELECT q1.qid, q1.a AS owner, x.b AS token, q1.s + lp AS s FROM q1 JOIN (SELECT DISTINCT a, b FROM leaf) x USING (a) JOIN l1 ON l1.qid = q1.qid AND l1.a = q1.a AND l1.c = x.b) SELECT qid, CAST(row_number() OVER w AS INTEGER) AS rank, owner, token, round(s, 5) AS score FROM g WINDOW w AS (PARTITION BY qid ORDER BY s DESC, owner, token) QUALIFY row_number() OVER w <= 3")
def ragged_top(w):
    """The three best of each query's expansions, of whatever owner; a query of fewer has fewer."""
    first = search._expanded(search.start(w.q), w.index, w.books, 0, 1, 4, search.Scoring(), 0, True)
    grown = search._expanded(first, w.index, w.books, 1, 1, 1 << 20, search.Scoring(), 1, True).select("qid", F.col("codes")[0].alias("owner"), F.col("codes")[1].alias("token"), "score")
    return keys.segmented_top(grown, "qid", 3, ["owner", "token"]).withColumn("score", F.round("score", 5))


@_query(None)
def diverse_top(w):
    """Choice one by one, each chosen code making its like 0.5 worse for the next choices; raw scores come out."""
    first = search._expanded(search.start(w.q), w.index, w.books, 0, 1, 4, search.Scoring(), 0, True)
    grown = search._expanded(first, w.index, w.books, 1, 1, 1 << 20, search.Scoring(), 1, True).select("qid", F.col("codes")[0].alias("owner"), F.col("codes")[1].alias("token"), "score")
    return keys.diverse_top(grown, 5, 0.5).withColumn("score", F.round("score", 5))


_PREFIXES = [(1, "0"), (2, "15"), (3, "99"), (4, "?")]


@_query(_BASE + ", p(id, a) AS (VALUES (1, 0), (2, 15), (3, 99), (4, NULL)) SELECT id, coalesce((SELECT list_aggregate(list_sort(list(token)), 'string_agg', ',') FROM edge WHERE depth = 1 AND prefix = '<a' || p.a || '>'), '') AS strict, coalesce((SELECT list_aggregate(list_sort(list(token)), 'string_agg', ',') FROM edge WHERE depth = 1 AND prefix = '<a' || p.a || '>'), list_aggregate(range(16), 'string_agg', ',')) AS lenient FROM p")
def legal_codes(w):
    """The codes that may follow a stored prefix, an unknown one, and one with an undecided position: strict, and falling back to the whole level."""
    p = w.spark.createDataFrame([(1, [0]), (2, [15]), (3, [99]), (4, [None])], "id int, codes array<int>")
    text = lambda strict, name: search.legal_codes(p, w.index, 1, 16, strict).select("id", F.array_join("next", ",").alias(name))
    return text(True, "strict").join(text(False, "lenient"), "id")


_GAINS = """, g AS (SELECT qid, c, 2 * list_dot_product(e, w) - list_dot_product(w, w) AS gain, list_dot_product(e, w) AS alignment, list_dot_product(e, w) / (greatest(sqrt(list_dot_product(e, e)), 1e-12) * greatest(sqrt(list_dot_product(w, w)), 1e-12)) AS cosine FROM q, book WHERE level = 0)"""


@_query(_BASE + _GAINS + " SELECT qid, c AS code, round(gain, 5) AS gain, round(alignment, 5) AS alignment, round(cosine, 5) AS cosine, round((gain - avg(gain) OVER p) / greatest(stddev_pop(gain) OVER p, 1e-6), 5) AS z FROM g WINDOW p AS (PARTITION BY qid)")
def code_gains(w):
    """The evidence of each first code: gain, alignment, cosine, and the gain's z over the whole codebook."""
    return keys.code_gains(w.q, w.books.words[0])


_U = "((('0x' || md5('3|' || qid || '|' || c)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


@_query(_BASE + _GAINS + f" SELECT qid, arg_max(c, (gain / 0.5 - ln(-ln({_U})), -c)) AS code FROM g GROUP BY qid")
def sampled_codes(w):
    """One first code a query, drawn by its probabilities at half the temperature."""
    return search.sampled_code(keys.code_gains(w.q, w.books.words[0], None), "qid", "code", "gain", "3", 0.5)


@_query("SELECT event_id, least(greatest((event_id - 100) / 400.0::DOUBLE, 0), 1) AS ramp, round(cos(pi() / 2 * (event_id % 100) / 100), 6) AS open_share FROM events")
def schedules(w):
    from keyloom.functions.text import mask_ratio, ramp

    e = w.spark.read.parquet(f"{w.sf}/events.parquet")
    return e.select("event_id", ramp(F.col("event_id"), 100, 400).alias("ramp"), F.round(mask_ratio(F.col("event_id") % 100 / 100), 6).alias("open_share"))


_PATHS = ", paths AS (SELECT DISTINCT j.qid, a, b, d, code FROM j JOIN cands c ON c.vec_id = j.did)"


@_query(_BASE + _PATHS + ", s AS (SELECT DISTINCT qid, 0 AS depth, '' AS prefix, a AS t FROM paths UNION SELECT qid, 1, '<a' || a || '>', b FROM paths UNION SELECT qid, 2, '<a' || a || '><b' || b || '>', d FROM paths) SELECT qid, depth, prefix, string_agg(t::VARCHAR, ',' ORDER BY t) AS next FROM s GROUP BY qid, depth, prefix")
def positive_children(w):
    """The codes that lead on to a judged item's key, after each of its prefixes."""
    return search.positive_children(w.judged_paths(), w.books.levels).withColumn("next", F.array_join("next", ","))


@_query(
    _BASE + _PATHS + ", own AS (SELECT DISTINCT qid, 0 AS depth, '' AS prefix, '<a' || a || '>' AS child FROM paths UNION SELECT qid, 1, '<a' || a || '>', '<a' || a || '><b' || b || '>' FROM paths UNION SELECT qid, 2, '<a' || a || '><b' || b || '>', code FROM paths),"
    " n AS (SELECT own.qid, own.depth, edge.child, row_number() OVER (PARTITION BY own.qid, own.child ORDER BY md5('9' || edge.child), edge.child) AS r FROM own JOIN edge ON edge.depth = own.depth AND edge.prefix = own.prefix AND edge.child <> own.child) SELECT DISTINCT qid, depth, child FROM n WHERE r <= 2"
)
def branch_records(w):
    """Two other stored children beside each step of each judged key."""
    return search.branch_records(w.judged_paths(), w.index, w.books.levels, 2, "9")


@_query(_BASE + _GAINS + ", z AS (SELECT qid, c, (gain - avg(gain) OVER p) / greatest(stddev_pop(gain) OVER p, 1e-6) AS z FROM g WINDOW p AS (PARTITION BY qid)) SELECT qid, a AS code, round(z, 5) AS z FROM z JOIN coded ON vec_id = qid AND a = c")
def selected_gain(w):
    """The z of the one chosen code by query, from the codebook's moments alone."""
    chosen = search.encode(w.q, w.books).select(F.col("vec_id").alias("qid"), F.col("codes")[0].alias("code"))
    return keys.selected_gain(w.q.select(F.col("vec_id").alias("qid"), "embedding").join(chosen, "qid"), w.books.words[0])


@_query(_BASE + _GAINS + ", r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY gain DESC, c) AS n FROM g) SELECT qid, arg_max(c, (gain, -c)) AS best, round(avg(gain), 5) AS mean, round(greatest(stddev_pop(gain), 1e-4), 5) AS deviation, round(max(gain) FILTER (n = 1) - max(gain) FILTER (n = 2), 5) AS margin FROM r GROUP BY qid")
def score_moments(w):
    """Per query: best code, mean and deviation of its finite scores, and the margin of the best two."""
    g = keys.code_gains(w.q, w.books.words[0], rounded=None)
    return keys.masked_moments(g, "qid", "code", "gain")


@_query(_BASE + "SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(e, list_transform(w, lambda x: x / 0.35)), lambda x: pow(x[1] - x[2], 2)))), 5) AS distance, c AS code FROM v, book WHERE level = 0 AND vec_id % 10 = 0")
def code_distances(w):
    """Euclidean distances of queries and the vectors of the first level's codewords."""
    return keys.distances(w.q, w.books.words[0] / 0.35)


@_query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), f AS (SELECT a.vec_id, list_transform(list_zip(a.e, b.e), lambda x: x[1] * (a.vec_id % 3 <> 0)::INT + x[2] * (a.vec_id % 3 <> 1)::INT) AS s FROM v a JOIN v b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(s[1] / sqrt(list_dot_product(s, s)), 5) AS first_part, round(sqrt(list_dot_product(s, s)), 5) AS norm FROM f")
def fused_vectors(w):
    """Two vectors of a record, each where its mask says so, added and brought to length one."""
    nxt = w.v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    fused = w.v.join(nxt, "vec_id").select("vec_id", keys.fused(F.col("embedding"), F.col("vec_id") % 3 != 0, F.col("other"), F.col("vec_id") % 3 != 1).alias("s"))
    return fused.select("vec_id", F.round(keys.unit(F.col("s"))[0], 5).alias("first_part"), F.round(F.sqrt(keys.let(F.col("s"), lambda x: keys.dot(x, x))), 5).alias("norm"))


_ITEMS = _RANKED + ", items AS (SELECT qid, vec_id AS did, min(beam_rank) AS beam_rank, max(s) AS score FROM ranked JOIN cands USING (code) GROUP BY ALL)"
_COS = _ITEMS + ", cosed AS (SELECT items.*, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS cosine FROM items JOIN q USING (qid) JOIN cands c ON c.vec_id = did)"
_STAT = ", st AS (SELECT *, count(*) OVER w AS n, avg(cosine) OVER w AS ac, stddev_pop(cosine) OVER w AS sc, avg(score) OVER w AS ag, stddev_pop(score) OVER w AS sg, min(cosine) OVER w AS ic, max(cosine) OVER w AS xc, min(score) OVER w AS ig, max(score) OVER w AS xg, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, beam_rank, did) AS rc FROM cosed WINDOW w AS (PARTITION BY qid))"
_FINALS = {
    "cosine_only": "cosine", "generation_only": "score", "rrf": "0.8 / (60 + rc) + 0.2 / (60 + beam_rank)",
    "weighted_minmax": "0.8 * CASE WHEN n <= 1 OR xc - ic < 1e-8 THEN 0 ELSE (cosine - ic) / (xc - ic) END + 0.2 * CASE WHEN n <= 1 OR xg - ig < 1e-8 THEN 0 ELSE (score - ig) / (xg - ig) END",
    "weighted_zscore": "0.8 * CASE WHEN n <= 1 OR sc < 1e-8 THEN 0 ELSE (cosine - ac) / sc END + 0.2 * CASE WHEN n <= 1 OR sg < 1e-8 THEN 0 ELSE (score - ag) / sg END",
}


def _rank_sql(mode: str, k: int, items: str = _COS) -> str:
    return _BASE + _BLOCK + items + _STAT + f", top AS (SELECT qid, did, final, row_number() OVER (PARTITION BY qid ORDER BY final DESC, beam_rank, did) AS rank FROM (SELECT *, {_FINALS[mode]} AS final FROM st) QUALIFY rank <= {k})"


def _retrieved(w: World) -> DataFrame:
    return keys.with_cosine(keys.bucket_items(w.block(), w.coded), w.v)


@_query(_BASE + _BLOCK + _ITEMS + " SELECT qid, did, CAST(beam_rank AS INTEGER) AS beam_rank, round(score, 5) AS score FROM items")
def bucket_join(w):
    return keys.bucket_items(w.block(), w.coded).withColumn("score", F.round("score", 5))


@_query(_BASE + _BLOCK + _RANKED + ", r AS (SELECT qid, vec_id AS did, row_number() OVER (PARTITION BY qid ORDER BY beam_rank, vec_id) AS rank FROM ranked JOIN cands USING (code)) SELECT qid, CAST(rank AS INTEGER) AS rank, did FROM r WHERE rank <= 10")
def retrieved_plain(w):
    """Items in beam order, cut at ten, without reranking; items aren't made distinct."""
    return keys.beam_order(w.block(), w.coded, 10)


@_query(_BASE + _BLOCK + _ITEMS + " SELECT qid, did, CAST(row_number() OVER (PARTITION BY qid ORDER BY beam_rank, did) AS INTEGER) AS place FROM items")
def unique_candidates(w):
    return keys.first_places(keys.bucket_items(w.block(), w.coded))


def _mode(mode: str) -> None:
    @_query(_rank_sql(mode, 5) + " SELECT qid, CAST(rank AS INTEGER) AS rank, did, round(final, 5) AS final FROM top")
    def rerank(w):
        return keys.reranked(keys.blended(_retrieved(w), mode), 5).select("qid", "rank", "did", F.round("final", 5).alias("final"))

    name = f"rerank_{mode}"
    QUERIES[name], SQL[name] = QUERIES.pop("rerank"), SQL.pop("rerank")


for _m in _FINALS:
    _mode(_m)

_LOST = _COS.replace("max(s) AS score", "CASE WHEN min(beam_rank) % 2 = 1 THEN -ln(min(beam_rank)) ELSE max(s) END AS score")


@_query(_rank_sql("generation_only", 5, _LOST) + " SELECT qid, CAST(rank AS INTEGER) AS rank, did, round(final, 5) AS final FROM top")
def rerank_missing_scores(w):
    """Scores that are missing, infinite or not numbers fall back to the beam rank."""
    bad = F.when(F.col("beam_rank") % 6 == 1, F.lit(None)).when(F.col("beam_rank") % 6 == 3, F.lit(float("-inf"))).when(F.col("beam_rank") % 6 == 5, F.lit(float("nan"))).otherwise(F.col("score"))
    return keys.reranked(keys.blended(_retrieved(w).withColumn("score", bad), "generation_only"), 5).select("qid", "rank", "did", F.round("final", 5).alias("final"))


_FEW = _COS.replace(", cosed AS", ", few AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY qid ORDER BY beam_rank, did) <= 6), cosed AS").replace("SELECT items.*", "SELECT few.*").replace("FROM items JOIN q", "FROM few JOIN q")


@_query(_rank_sql("weighted_zscore", 5, _FEW) + " SELECT qid, CAST(rank AS INTEGER) AS rank, did, round(final, 5) AS final FROM top")
def rerank_budget(w):
    """At most six items of each query, in beam order, are reranked."""
    few = keys.first_places(keys.bucket_items(w.block(), w.coded), "beam_rank", "score").where("place <= 6").drop("place")
    return keys.reranked(keys.blended(keys.with_cosine(few, w.v)), 5).select("qid", "rank", "did", F.round("final", 5).alias("final"))


@_query(_rank_sql("weighted_zscore", 10) + ", rel AS (SELECT q.qid, c.vec_id AS did FROM q JOIN cands c USING (label)) SELECT k, count(*) AS queries, round(avg(CASE WHEN f <= k THEN 1.0 ELSE 0.0 END), 4) AS hit_rate FROM (SELECT unnest([1, 5, 10]) AS k, f FROM (SELECT qid, (SELECT min(rank) FROM top JOIN rel USING (qid, did) WHERE top.qid = q.qid) AS f FROM q)) GROUP BY k")
def hit_rate(w):
    top = keys.reranked(keys.blended(_retrieved(w)), 10)
    return keys.hit_rates(w.same_label(top.select("qid", "did", "rank")), w.qids, (1, 5, 10))


@_query(_BASE + sequential(stored=False) + _RANKED + ", h AS (SELECT qid, beam_rank, code IN (SELECT code FROM leaf) AS hit FROM ranked), per AS (SELECT qid, count(*) AS n, count(*) FILTER (hit) AS hits, bool_or(hit AND beam_rank = 1) AS first FROM h GROUP BY qid) SELECT count(*) AS queries, round(avg((hits > 0)::INT), 4) AS any_code_hit_rate, round(avg(first::INT), 4) AS first_beam_hit_rate, round(sum(hits) / sum(n), 4) AS beam_code_hit_rate, round(avg(hits), 4) AS hit_beams FROM per")
def beam_hits(w):
    """How many queries have a beam whose key exists, in any place and the first, how many beams exist, and how many a query has. Beams are of the search without an index."""
    return keys.code_hits(search.block_search(w.q, None, w.books, K), w.index)


@_query(
    _BASE + _BLOCK + _ITEMS + ", u AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY beam_rank, did) AS place FROM items), per AS (SELECT q.qid, (SELECT count(*) FROM j WHERE j.qid = q.qid) AS judged, (SELECT count(*) FROM u WHERE u.qid = q.qid) AS n, (SELECT min(place) FROM u JOIN j USING (qid, did) WHERE u.qid = q.qid) AS f FROM q)"
    " SELECT count(*) FILTER (judged > 0) AS evaluated, count(*) FILTER (judged = 0) AS missing, round(avg(n) FILTER (judged > 0), 4) AS mean_candidates, round(avg(f) FILTER (judged > 0), 4) AS mean_first_rank, "
    + ", ".join(f"round(avg((coalesce(f, 99999) <= {k})::INT) FILTER (judged > 0), 4) AS recall_{k}" for k in (1, 5, 10, 50)) + " FROM per"
)
def judged_in_beams(w):
    """Judged items among the beams' distinct items, before any reranking."""
    return keys.judged_recall(keys.first_places(keys.bucket_items(w.block(), w.coded)), w.judged(), w.qids, (1, 5, 10, 50))


@_query(_BASE + _ONE + _RANKED + ", p AS (SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY qid) AS p FROM ranked), c AS (SELECT *, sum(p) OVER (PARTITION BY qid ORDER BY beam_rank ROWS UNBOUNDED PRECEDING) AS cum FROM p) SELECT qid, CAST(beam_rank AS INTEGER) AS beam_rank, code, round(cum, 5) AS cum FROM c WHERE beam_rank = 1 OR cum <= 0.6")
def top_p(w):
    """Each query's beams up to a summed probability of 0.6 among them, the first always."""
    b = w.beams(spans=[3])
    p = b.withColumn("p", F.exp("score") / F.sum(F.exp("score")).over(Window.partitionBy("qid")))
    cum = F.sum("p").over(Window.partitionBy("qid").orderBy("beam_rank").rowsBetween(Window.unboundedPreceding, 0))
    return p.withColumn("cum", cum).where("beam_rank = 1 or cum <= 0.6").select("qid", "beam_rank", F.col("prefix").alias("code"), F.round("cum", 5).alias("cum"))


@_query(_BASE + _BLOCK + _RANKED + " SELECT r.qid, coalesce((SELECT arg_min(c.code, j.pos) FROM j JOIN cands c ON c.vec_id = j.did WHERE j.qid = r.qid), r.code) AS code FROM ranked r WHERE beam_rank = 1")
def oracle_codes(w):
    """The key of the first judged item that is a candidate replaces the beams; where there is none, the first beam stays."""
    best = w.judged().join(w.coded.select(F.col("vec_id").alias("did"), "codes"), "did").groupBy("qid").agg(F.min_by("codes", "pos").alias("codes"))
    first = w.block().where("beam_rank = 1").select("qid", "prefix")
    return first.join(best, "qid", "left").select("qid", F.coalesce(keys.code_text(F.col("codes")), "prefix").alias("code"))


@_query(_BASE + _BLOCK + ", s AS (SELECT q.qid, EXISTS (SELECT 1 FROM j JOIN cands c ON c.vec_id = j.did JOIN f1 ON f1.qid = j.qid AND f1.a = c.a WHERE j.qid = q.qid) AS alive, EXISTS (SELECT 1 FROM j JOIN cands c ON c.vec_id = j.did JOIN beams b ON b.qid = j.qid AND b.code = c.code WHERE j.qid = q.qid) AS found, (SELECT sum(n) FROM f1 JOIN (SELECT a, count(*) AS n FROM leaf GROUP BY a) USING (a) WHERE f1.qid = q.qid) AS leaves FROM q) SELECT count(*) AS queries, round(avg(alive::INT), 4) AS survival, round(avg(found::INT), 4) AS success, round(avg(found::INT) FILTER (alive), 4) AS success_if_alive, round(avg(leaves), 4) AS mean_leaves, round(covar_pop(leaves, found::INT) / nullif(stddev_pop(leaves) * stddev_pop(found::INT), 0), 4) AS corr_leaves_success FROM s")
def frontier_survival(w):
    """Whether a judged item's prefix is among those that the first round keeps, and its key among the beams."""
    first = search._expanded(search.start(w.q), w.index, w.books, 0, 1, 4, search.Scoring(), 0, True)
    right = w.judged().select("qid", "did").join(w.coded.select(F.col("vec_id").alias("did"), "codes"), "did")
    flag = lambda df, name: df.select("qid").distinct().withColumn(name, F.lit(1))
    alive = flag(right.withColumn("codes", F.slice("codes", 1, 1)).join(first.select("qid", "codes"), ["qid", "codes"], "left_semi"), "alive")
    found = flag(right.join(w.block().select("qid", "codes"), ["qid", "codes"], "left_semi"), "found")
    held = first.join(search.leaves(w.index, 1), "codes").groupBy("qid").agg(F.sum("leaves").alias("leaves"))
    per = w.qids.join(held, "qid").join(alive, "qid", "left").join(found, "qid", "left").fillna(0, ["alive", "found"])
    return per.agg(
        F.count("*").alias("queries"), F.round(F.avg("alive"), 4).alias("survival"), F.round(F.avg("found"), 4).alias("success"), F.round(F.avg(F.when(F.col("alive") == 1, F.col("found"))), 4).alias("success_if_alive"),
        F.round(F.avg("leaves"), 4).alias("mean_leaves"), F.round(F.covar_pop("leaves", "found") / F.nullif(F.stddev_pop("leaves") * F.stddev_pop("found"), F.lit(0.0)), 4).alias("corr_leaves_success"),
    )


_PRODUCTS = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


@_query(_PRODUCTS + " SELECT q.vec_id AS qid, CAST(row_number() OVER w AS INTEGER) AS rank, c.vec_id AS did, round(list_dot_product(q.e, c.e), 5) AS score FROM v q, v c WHERE q.vec_id % 10 = 0 AND c.vec_id % 10 <> 0 WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) QUALIFY row_number() OVER w <= 10")
def exact_neighbours(w):
    """The ten candidates of the largest inner product, exact: a stated query set, in broadcast blocks, against all rows."""
    return keys.exact_top(w.q, w.c, 10).withColumn("score", F.round("score", 5))


@_query(_PRODUCTS + " SELECT q.vec_id AS qid, CAST(row_number() OVER w AS INTEGER) AS rank, c.vec_id AS did, round(list_dot_product(q.e, c.e), 5) AS score FROM v q, v c WHERE q.vec_id % 10 = 0 AND q.label <> c.label AND q.vec_id <> c.vec_id WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) QUALIFY row_number() OVER w <= 3")
def hard_negatives(w):
    """The three best scored rows of other groups (labels), for each query."""
    return keys.exact_top(w.q, w.v, 3, other="label").withColumn("score", F.round("score", 5))


@_query(_BASE + ", t AS (SELECT vec_id, a, b, code FROM coded WHERE vec_id % 10 = 0), n AS (SELECT vec_id, 1 AS depth, l.code FROM t JOIN leaf l USING (a) WHERE l.code <> t.code UNION ALL SELECT vec_id, 2, l.code FROM t JOIN leaf l USING (a, b) WHERE l.code <> t.code), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, depth ORDER BY md5('7' || code), code) AS n FROM n) SELECT DISTINCT vec_id, code FROM r WHERE n <= 4")
def prefix_neighbours(w):
    """Up to four other stored keys that share one code, and four that share two, by a seeded shuffle; each key once."""
    targets = search.encode(w.q, w.books).select("vec_id", "codes")
    return keys.prefix_neighbours(targets, w.index, (1, 2), 4, seed="7")
