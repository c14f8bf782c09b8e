"""Reports over tasks, policies and runs. Metrics are long tables (task, policy, pool, metric, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.operators.keys import exact_percentiles


def compared(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, value_a, value_b, delta of every key that either run has; delta is null where one is missing. Null key parts are equal."""
    y = b.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(value).alias("value_b"), F.lit(1).alias("_b"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = a.select(*keys, F.col(value).alias("value_a"), F.lit(1).alias("_a")).join(y, on, "full_outer")
    out = both.select(*(F.when(F.col("_a").isNotNull(), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys), "value_a", "value_b")
    return out.withColumn("delta", F.col("value_b") - F.col("value_a"))


def macro(pairs: DataFrame, by: str) -> DataFrame:
    """by, pairs, mean_a, mean_b, mean_delta over the complete pairs."""
    n = pairs.where("value_a is not null and value_b is not null").groupBy(by).agg(F.count("*").alias("pairs"), F.avg("value_a").alias("mean_a"), F.avg("value_b").alias("mean_b"))
    return n.withColumn("mean_delta", F.col("mean_b") - F.col("mean_a"))


def by_pool(metrics: DataFrame, keys: list[str], pools: list[str]) -> DataFrame:
    """One row for each of the keys with a column for each pool's value."""
    return metrics.groupBy(*keys).pivot("pool", pools).agg(F.first("value"))


def policy_audit(metrics: DataFrame, base: str, other: str) -> DataFrame:
    """One row: tasks that both policies have, macro means, tasks that gain, least and largest gain; and whether both have the same tasks."""
    m = metrics.groupBy("task").pivot("policy", [base, other]).agg(F.avg("value"))
    a, b = F.col(f"`{base}`"), F.col(f"`{other}`")
    whole = a.isNotNull() & b.isNotNull()
    gain = F.when(whole, b - a)
    return m.agg(
        F.count(F.when(whole, 1)).alias("tasks"), F.avg(F.when(whole, a)).alias("macro_base"), F.avg(F.when(whole, b)).alias("macro_other"), F.count(F.when(gain > 0, 1)).alias("positive"),
        F.min(gain).alias("least_gain"), F.max(gain).alias("largest_gain"), F.bool_and(whole).alias("same_tasks"),
    )


def control_gaps(metrics: DataFrame, base: str, other: str) -> DataFrame:
    """One row: the largest gap between the policies' task means, and the range of the share by which the other is lower."""
    m = metrics.groupBy("task").pivot("policy", [base, other]).agg(F.avg("value"))
    a, b = F.col(f"`{base}`"), F.col(f"`{other}`")
    cut = (a - b) / F.nullif(a, F.lit(0.0))
    return m.agg(F.max(F.abs(b - a)).alias("largest_gap"), F.min(cut).alias("least_reduction"), F.max(cut).alias("largest_reduction"))


def best_setting(runs: DataFrame, setting: str, value: str) -> DataFrame:
    """The setting of the largest mean value; equals by the smaller setting."""
    mean = runs.groupBy(setting).agg(F.avg(value).alias("mean"))
    return mean.agg(F.max_by(setting, F.struct(F.col("mean"), -F.col(setting))).alias(setting), F.max("mean").alias("mean"))


def poisson_weight(u: Column) -> Column:
    """The Poisson number of mean one that a uniform number stands for; over 12 counts as 12."""
    out, total, term = F.lit(12), 0.0, math.exp(-1)
    bounds = []
    for k in range(12):
        total += term
        bounds.append((k, total))
        term /= k + 1
    for k, bound in reversed(bounds):
        out = F.when(u < bound, k).otherwise(out)
    return out


def bootstrap(deltas: DataFrame, key: str, value: str, replicates: int = 200, seed: str = "1") -> DataFrame:
    """One row: n, mean, low, high, p_two_sided: a paired bootstrap over the keys' differences.

    A key weighs in each replicate by a Poisson number of (seed, replicate, key), so replicates are sums that every task adds up for its own rows, and
    nothing is resampled or collected. An empty table gives n 0.
    """
    rep = deltas.select(key, value, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("rep").cast("string"), F.col(key).cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
    sums = rep.withColumn("w", poisson_weight(u)).groupBy("rep").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    ends = exact_percentiles(sums.withColumn("one", F.lit(1)), "one", "m", {"low": 0.025, "high": 0.975})
    tail = sums.agg(F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("m") <= 0).cast("double")), F.avg((F.col("m") >= 0).cast("double")))).alias("p_two_sided"))
    mean = deltas.agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.lit(1).alias("one"))
    return mean.join(F.broadcast(ends), "one", "left").crossJoin(F.broadcast(tail)).drop("one")


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            out *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * out


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, rho, p: rank correlation of the rows in which both are finite; equals share their mean rank. Null for under three rows or no spread.

    Ranks come from the counts of distinct values, so a sort sees each value once.
    """
    fine = df.where((F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))).select(F.col(a).alias("a"), F.col(b).alias("b"))

    def ranks(c: str) -> DataFrame:
        n = fine.groupBy(c).agg(F.count("*").alias("_n"))
        return n.select(c, (F.sum("_n").over(Window.orderBy(c)) - (F.col("_n") - 1) / 2).alias(f"r{c}"))

    both = fine.join(ranks("a"), "a").join(ranks("b"), "b")
    spread = F.nullif(F.stddev_pop("ra") * F.stddev_pop("rb"), F.lit(0.0))
    got = both.agg(F.count("*").alias("n"), (F.covar_pop("ra", "rb") / spread).alias("rho")).first()
    n, rho = got["n"], got["rho"]
    p = None
    if rho is not None and n > 2:
        p = 0.0 if abs(rho) >= 1 else _beta_share((n - 2) / 2, 0.5, 1 - rho * rho)
    return df.sparkSession.createDataFrame([(n, rho if n > 2 else None, p)], "n bigint, rho double, p double")


def every_batch(df: DataFrame, order: str, batch: int, skip: int = 1) -> DataFrame:
    """batch_no, first, value: of rows that repeat their batch's value, the first of each batch but the first `skip` batches."""
    return df.where((F.pmod(order, F.lit(batch)) == 0) & (F.floor(F.col(order) / batch) >= skip)).withColumn("batch_no", F.floor(F.col(order) / batch).cast("bigint"))


def multi_positive(scores: DataFrame, by: str, score: str, positive: str) -> DataFrame:
    """by, loss, top1, margin: log-sum-exp of all scores less that of the positives', whether the best is positive, best positive less best other."""
    top = F.max(score).over(Window.partitionBy(by))
    s = scores.withColumn("_e", F.exp(F.col(score) - top))
    good = F.when(F.col(positive), F.col("_e"))
    best = lambda c: F.max(F.when(c, F.col(score)))
    return s.groupBy(by).agg((F.log(F.sum("_e")) - F.log(F.sum(good))).alias("loss"), (best(F.col(positive)) >= F.max(score)).cast("int").alias("top1"), (best(F.col(positive)) - best(~F.col(positive))).alias("margin"))


def summary_lines(rows: DataFrame, name: str, values: list[str]) -> DataFrame:
    """line: a Markdown table row of each, values with two places."""
    cells = [F.coalesce(F.col(name).cast("string"), F.lit("")), *(F.coalesce(F.format_string("%.2f", v), F.lit("N/A")) for v in values)]
    return rows.select(name, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def ordered(rows: DataFrame, orders: dict[str, list[str]]) -> DataFrame:
    """rows with place: their order by given lists of names, column after column; names that a list lacks come last, by name."""
    cols = []
    for c, names in orders.items():
        at = F.array_position(F.array(*map(F.lit, names)), F.lower(c))
        cols += [F.when(at > 0, at).otherwise(len(names) + 1), F.col(c)]
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*cols)))  # a report's rows
