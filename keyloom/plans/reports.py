"""Queries that report over tasks and runs, and their SQL. Metrics are made from line items: a supplier group is a task, a return flag a policy, a status a pool."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.operators import reports as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None, *tables: str):
    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf: f(*(spark.read.parquet(f"{sf}/{n}.parquet") for n in tables))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_M = "m AS (SELECT l_suppkey % 16 AS task, l_returnflag AS policy, l_linestatus AS pool, 'q' || l_linenumber % 3 AS metric, avg(l_quantity) AS value, count(*) AS n FROM lineitem GROUP BY ALL)"


def _metrics(li: DataFrame) -> DataFrame:
    keys = [(F.col("l_suppkey") % 16).alias("task"), F.col("l_returnflag").alias("policy"), F.col("l_linestatus").alias("pool"), F.concat(F.lit("q"), (F.col("l_linenumber") % 3).cast("string")).alias("metric")]
    return li.groupBy(*keys).agg(F.avg("l_quantity").alias("value"), F.count("*").alias("n"))


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 5) for c in cols})


_PAIRS = f"WITH {_M}, a AS (SELECT * FROM m WHERE policy = 'A' AND task % 5 <> 1), b AS (SELECT * FROM m WHERE policy = 'R' AND task % 5 <> 2), p AS (SELECT coalesce(a.task, b.task) AS task, coalesce(a.pool, b.pool) AS pool, coalesce(a.metric, b.metric) AS metric, a.value AS value_a, b.value AS value_b, b.value - a.value AS delta FROM a FULL JOIN b ON a.task = b.task AND a.pool = b.pool AND a.metric = b.metric)"


def _pairs(li: DataFrame) -> DataFrame:
    m = _metrics(li)
    return t.compared(m.where("policy = 'A' and task % 5 <> 1"), m.where("policy = 'R' and task % 5 <> 2"), ["task", "pool", "metric"])


@_query(_PAIRS + " SELECT task, pool, metric, round(value_a, 5) AS value_a, round(value_b, 5) AS value_b, round(delta, 5) AS delta FROM p", "lineitem")
def run_comparison(li):
    """Two runs side by side by all their key columns; tasks that one lacks stay."""
    return _rounded(_pairs(li), "value_a", "value_b", "delta")


_MACRO = "SELECT '{0}' AS kind, {0}::VARCHAR AS name, count(*) AS pairs, round(avg(value_a), 5) AS mean_a, round(avg(value_b), 5) AS mean_b, round(avg(value_b) - avg(value_a), 5) AS mean_delta FROM p WHERE delta IS NOT NULL GROUP BY {0}"


@_query(_PAIRS + " " + _MACRO.format("metric") + " UNION ALL " + _MACRO.format("task"), "lineitem")
def macro_means(li):
    p = _pairs(li)
    one = lambda by: _rounded(t.macro(p, by), "mean_a", "mean_b", "mean_delta").select(F.lit(by).alias("kind"), F.col(by).cast("string").alias("name"), "pairs", "mean_a", "mean_b", "mean_delta")
    return one("metric").unionByName(one("task"))


@_query(f"WITH {_M} SELECT task, policy, metric, round(max(value) FILTER (pool = 'F'), 5) AS local, round(max(value) FILTER (pool = 'O'), 5) AS \"union\" FROM m GROUP BY ALL", "lineitem")
def pool_columns(li):
    """Metrics with the local and the union pool side by side."""
    return _rounded(t.by_pool(_metrics(li), ["task", "policy", "metric"], ["F", "O"]).withColumnsRenamed({"F": "local", "O": "union"}), "local", "union")


_AUDIT = "x AS (SELECT task, avg(value) FILTER (policy = '{0}') AS a, avg(value) FILTER (policy = '{1}') AS b FROM m GROUP BY task)"


@_query(f"WITH {_M}, {_AUDIT.format('A', 'N')} SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS tasks, round(avg(a), 5) AS macro_base, round(avg(b), 5) AS macro_other, count(*) FILTER (b - a > 0) AS positive, round(min(b - a), 5) AS least_gain, round(max(b - a), 5) AS largest_gain, bool_and(a IS NOT NULL AND b IS NOT NULL) AS same_tasks FROM x", "lineitem")
def policy_audit(li):
    return _rounded(t.policy_audit(_metrics(li), "A", "N"), "macro_base", "macro_other", "least_gain", "largest_gain")


@_query(f"WITH {_M}, {_AUDIT.format('A', 'R')} SELECT round(max(abs(b - a)), 5) AS largest_gap, round(min((a - b) / a), 5) AS least_reduction, round(max((a - b) / a), 5) AS largest_reduction FROM x", "lineitem")
def control_gaps(li):
    return _rounded(t.control_gaps(_metrics(li), "A", "R"), "largest_gap", "least_reduction", "largest_reduction")


@_query("WITH s AS (SELECT l_linenumber * 10 AS weight, avg(round(l_discount, 2)) AS mean FROM lineitem GROUP BY 1) SELECT arg_max(weight, (mean, -weight)) AS weight, round(max(mean), 6) AS mean FROM s", "lineitem")
def best_weight(li):
    got = t.best_setting(li.select((F.col("l_linenumber") * 10).alias("weight"), F.round("l_discount", 2).alias("v")), "weight", "v")
    return got.withColumn("mean", F.round("mean", 6))


def _poisson_sql(u: str) -> str:
    import math

    total, term, out = 0.0, math.exp(-1), "CASE"
    for k in range(12):
        total += term
        out += f" WHEN {u} < {total!r} THEN {k}"
        term /= k + 1
    return out + " ELSE 12 END"


@_query(
    "WITH d AS (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN value END) - avg(CASE WHEN event_type <> 'click' THEN value END) AS delta FROM events GROUP BY user_id), u AS (SELECT rep, delta, ('0x' || md5('1|' || rep || '|' || user_id)[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM d, (SELECT unnest(range(1, 201)) AS rep)),"
    f" s AS (SELECT rep, sum(w * delta) / sum(w) AS m FROM (SELECT *, {_poisson_sql('u')} AS w FROM u) GROUP BY rep) SELECT (SELECT count(delta) FROM d) AS n, (SELECT round(avg(delta), 6) FROM d) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, least(1.0, 2 * least(avg((m <= 0)::INT), avg((m >= 0)::INT))) AS p_two_sided FROM s",
    "events",
)
def bootstrap_interval(e):
    """The mean difference of a user's clicks and other events, with an interval of 200 paired replicates."""
    of = lambda c: F.avg(F.when(c, F.col("value")))
    d = e.groupBy("user_id").agg((of(F.col("event_type") == "click") - of(F.col("event_type") != "click")).alias("delta"))
    return t.bootstrap(d, "user_id", "delta")


_RANK = "(SELECT {0} AS v, sum(n) OVER (ORDER BY {0}) - (n - 1) / 2.0 AS r FROM (SELECT {0}, count(*) AS n FROM d GROUP BY {0}))"


@_query(f"WITH d AS (SELECT l_quantity AS a, round(l_extendedprice, 0) AS b FROM lineitem) SELECT count(*) AS n, round(corr(x.r, y.r), 8) AS rho FROM d JOIN {_RANK.format('a')} x ON x.v = a JOIN {_RANK.format('b')} y ON y.v = b", "lineitem")
def rank_correlation(li):
    got = t.spearman(li.select(F.col("l_quantity").alias("a"), F.round("l_extendedprice", 0).alias("b")), "a", "b")
    return got.select("n", F.round("rho", 8).alias("rho"))


@_query("SELECT event_id // 8 AS batch_no, value FROM events WHERE event_id % 8 = 0 AND event_id >= 8", "events")
def batch_latencies(e):
    """Of rows that repeat their batch's latency, one a batch, without the first batch."""
    return t.every_batch(e, "event_id", 8).select("batch_no", "value")


@_query("SELECT event_type, count(*) AS n, round(avg(value), 5) AS mean FROM events WHERE event_id // 8 >= 5 GROUP BY event_type", "events")
def after_warm_up(e):
    """Means without the first five batches."""
    return e.where(F.floor(F.col("event_id") / 8) >= 5).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean"))


@_query("WITH s AS (SELECT l_orderkey % 500 AS q, l_quantity / 10 AS s, l_returnflag = 'A' AS good FROM lineitem), m AS (SELECT *, max(s) OVER (PARTITION BY q) AS top FROM s) SELECT q, round(ln(sum(exp(s - top))) - ln(sum(exp(s - top)) FILTER (good)), 5) AS loss, (max(s) FILTER (good) >= max(s))::INT AS top1, round(max(s) FILTER (good) - max(s) FILTER (NOT good), 5) AS margin FROM m GROUP BY q", "lineitem")
def positive_losses(li):
    s = li.select((F.col("l_orderkey") % 500).alias("q"), (F.col("l_quantity") / 10).alias("s"), (F.col("l_returnflag") == "A").alias("good"))
    return _rounded(t.multi_positive(s, "q", "s", "good"), "loss", "margin")


@_query(f"WITH {_M}, g AS (SELECT policy, avg(value) FILTER (pool = 'F') AS local, avg(value) FILTER (pool = 'O') AS \"union\" FROM m WHERE metric = 'q1' GROUP BY policy) SELECT policy, '| ' || policy || ' | ' || printf('%.2f', local) || ' | ' || printf('%.2f', \"union\") || ' |' AS line FROM g", "lineitem")
def summary_lines(li):
    m = _metrics(li).where("metric = 'q1'").groupBy("policy").pivot("pool", ["F", "O"]).agg(F.avg("value"))
    return t.summary_lines(m, "policy", ["F", "O"])


@_query("WITH x AS (SELECT DISTINCT regexp_extract(query_file, 'mbeir_([^/]*?)_(train|val|test)\\.jsonl$', 1) AS dataset, regexp_extract(query_file, '(?:^|/)(train|val|test)/[^/]*$', 1) AS split FROM mbeir_entry) SELECT dataset, split, CAST(row_number() OVER (ORDER BY CASE split WHEN 'test' THEN 1 WHEN 'val' THEN 2 ELSE 3 END, split, CASE dataset WHEN 'visualnews' THEN 1 WHEN 'mscoco' THEN 2 WHEN 'oven' THEN 3 ELSE 4 END, dataset) AS INTEGER) AS place FROM x", "mbeir_entry")
def report_order(e):
    from keyloom.functions.records import file_dataset, file_split

    x = e.select(file_dataset(F.col("query_file")).alias("dataset"), file_split(F.col("query_file")).alias("split")).distinct()
    return t.ordered(x, {"split": ["test", "val"], "dataset": ["visualnews", "mscoco", "oven"]})


_METRIC = "CASE WHEN task % 2 = 0 THEN 'q1' ELSE 'q2' END"


@_query(f"WITH {_M}, a AS (SELECT task, metric, avg(value) AS v FROM m WHERE policy = 'A' AND metric = {_METRIC} GROUP BY ALL), b AS (SELECT task, metric, avg(value) AS v FROM m WHERE policy = 'N' AND metric = {_METRIC} GROUP BY ALL) SELECT task, metric, round(a.v, 5) AS base, round(b.v, 5) AS other, round(b.v - a.v, 5) AS gain FROM a JOIN b USING (task, metric)", "lineitem")
def task_metric_join(li):
    """Two policies by task, each task by the metric that counts for it."""
    m = _metrics(li).where(F.expr(f"metric = {_METRIC}"))
    one = lambda p, n: m.where(F.col("policy") == p).groupBy("task", "metric").agg(F.avg("value").alias(n))
    return _rounded(one("A", "base").join(one("N", "other"), ["task", "metric"]).withColumn("gain", F.col("other") - F.col("base")), "base", "other", "gain")


@_query("WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders), b AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS n, count(a.k) AS in_a, count(b.k) AS in_b, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS aligned, (count(*) = count(a.k) AND count(*) = count(b.k)) AS same FROM a FULL JOIN b ON a.k = b.k", "orders", "lineitem")
def aligned_rows(o, li):
    """Two tables that should hold the same keys, joined by key, never by position, and whether they do."""
    a, b = o.select("o_orderkey"), li.select("l_orderkey").distinct()
    j = a.join(b, a["o_orderkey"] == b["l_orderkey"], "full_outer")
    n = j.agg(F.count("*").alias("n"), F.count("o_orderkey").alias("in_a"), F.count("l_orderkey").alias("in_b"), F.count(F.when(F.col("o_orderkey").isNotNull() & F.col("l_orderkey").isNotNull(), 1)).alias("aligned"))
    return n.withColumn("same", (F.col("n") == F.col("in_a")) & (F.col("n") == F.col("in_b")))


_STATE = "CASE event_type WHEN 'error' THEN 'task-' || event_id % 4 END"


@_query(f"WITH x AS (SELECT user_id, event_id, event_type, value, last_value({_STATE} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS task FROM events) SELECT task, count(*) AS lines, round(avg(value), 5) AS mean FROM x WHERE event_type <> 'error' AND task IS NOT NULL GROUP BY task", "events")
def logged_metrics(e):
    """Values of a log that belong to the task named last before them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    x = e.withColumn("task", F.last(F.expr(_STATE.replace("'task-' || event_id % 4", "concat('task-', event_id % 4)")), ignorenulls=True).over(w))
    return x.where("event_type <> 'error' and task is not null").groupBy("task").agg(F.count("*").alias("lines"), F.round(F.avg("value"), 5).alias("mean"))
