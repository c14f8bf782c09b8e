"""Operators on query and candidate records: identities, deduplication, joins, pools, reports. DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.functions.text import stripped
from keyloom.storage import materialize


def hashed_id(c: Column, per_dataset: int) -> Column:
    """ds * per_dataset + n of an id "ds:n" (500,000 for queries, 10,000,000 for candidates); null where it isn't one."""
    parts = F.split(c, ":")
    return F.try_add(parts[0].try_cast("bigint") * per_dataset, F.get(parts, F.lit(1)).try_cast("bigint"))


def unhashed_id(c: Column, per_dataset: int) -> Column:
    return F.concat_ws(":", F.floor(c / per_dataset).cast("string"), F.pmod(c, F.lit(per_dataset)).cast("string"))


def sentence_form(c: Column) -> Column:
    """Null as ''; carriage returns, then outer white space, then outer quotes away; a capital first, a full stop last unless . ? or ! is there."""
    x = F.regexp_replace(stripped(F.regexp_replace(F.coalesce(c, F.lit("")), "\r", "")), '^"+|"+$', "")
    x = F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2**31 - 1))
    return F.when(x == "", "").when(x.rlike("[.?!]$"), x).otherwise(F.concat(x, F.lit(".")))


def word_list(c: Column) -> Column:
    return F.filter(F.split(c, r"[ \t\n\r\f\x0B]+"), lambda t: t != "")


def doc_key(txt: Column, img: Column, modality: Column, strict: bool = False) -> Column:
    """The parts that aren't empty, joined by a dash; without text and image null, or an error where strict."""
    some = (F.coalesce(txt, F.lit("")) != "") | (F.coalesce(img, F.lit("")) != "")
    none = F.raise_error(F.lit("a document without text and image")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(some, F.concat_ws("-", F.nullif(txt, F.lit("")), F.nullif(img, F.lit("")), F.nullif(modality, F.lit("")))).otherwise(none)


def numbered(df: DataFrame, order: list[str], name: str = "n", within: list[str] | None = None, begin: int = 1) -> DataFrame:
    """Adds the row's number in a total order, in each group of `within` from `begin` on, without sorting a group in one task.

    Rows are range partitioned by group and order and written once; each partition numbers its own, and the sizes of the partitions before it, a
    table of one row a partition and group, are added.
    """
    within = within or []
    parts = materialize(df.repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_part", *within).agg(F.count("*").alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    own = F.row_number().over(Window.partitionBy("_part", *within).orderBy(*order))
    return parts.withColumn("_own", own).join(F.broadcast(sizes), ["_part", *within]).withColumn(name, (F.col("_own") + F.col("_before") + (begin - 1)).cast("bigint")).drop("_part", "_own", "_before")


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def all_but_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n > 1").drop("_n")


def merged_queries(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """key columns, qid, copies, pos, neg: one row for each key with its first qid and the ordered distinct unions of positives and of negatives.

    The parts of a key keep their places, and null differs from empty. Candidates are trimmed and blank ones left out; a key without any has empty lists. Each
    list is reduced to (candidate, first place) by partial aggregation before anything is collected, so a key of many rows reaches its task as its
    distinct candidates only. What is shuffled has the key's 128-bit digest in place of the key, which may hold a whole text.
    """
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    rows = df.withColumn("k", F.unhex(F.md5(F.concat(*(part(F.col(c)) for c in key)))))
    heads = rows.groupBy("k").agg(*(F.min_by(c, order).alias(c) for c in key), F.min_by("qid", order).alias("qid"), F.count("*").alias("copies"))
    side = lambda c: rows.select("k", F.col(order).alias("o"), F.lit(c).alias("side"), F.posexplode(f"{c}_cand_list").alias("at", "did"))
    each = side("pos").unionByName(side("neg")).withColumn("did", F.trim("did")).where("did <> ''")
    first = each.groupBy("k", "side", "did").agg(F.min(F.struct("o", "at")).alias("place"))
    union = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == c, F.struct("place", "did")))), lambda s: s["did"]).alias(c)
    none = F.array().cast("array<string>")
    return heads.join(first.groupBy("k").agg(union("pos"), union("neg")), "k", "left").select(*key, "qid", "copies", F.coalesce("pos", none).alias("pos"), F.coalesce("neg", none).alias("neg"))


def positives(df: DataFrame) -> DataFrame:
    """qid, pos, did: each positive of each record, in list order from 0, blanks aside; empty ones are left out."""
    return df.select("row_id", "qid", F.posexplode("pos_cand_list").alias("pos", "did")).withColumn("did", F.trim("did")).where("did <> ''")


def with_candidates(refs: DataFrame, pool: DataFrame, shared: DataFrame) -> DataFrame:
    """refs with the modality of the first candidate row of each did; a reference that neither pool has stays, with a null.

    The shared pool goes first: its few candidates are the ones referenced most, so what is shuffled to the large pool has no hot key of theirs.
    """
    first = lambda c: first_of_each(c.select("row_id", "did", "modality"), ["did"], ["row_id"]).drop("row_id")
    few = first(shared)
    return refs.join(few, "did").unionByName(refs.join(few, "did", "left_anti").join(first(pool), "did", "left"))


def referenced(df: DataFrame) -> DataFrame:
    """did: each candidate that is among the positives or the negatives of any record, once."""
    lists = F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in ("pos_cand_list", "neg_cand_list")))
    return df.select(F.explode(lists).alias("did")).select(F.trim("did").alias("did")).where("did <> ''").distinct()


def assigned_ids(df: DataFrame, dataset: Column, order: list[str], name: str = "new_id") -> DataFrame:
    """Adds "ds:i", i counting each dataset's rows from 1 in the given total order; no dataset is sorted in one task."""
    rows = numbered(df.withColumn("_ds", dataset), order, "_i", ["_ds"])
    return rows.withColumn(name, F.concat_ws(":", "_ds", "_i")).drop("_ds", "_i")


def remapped(df: DataFrame, row: str, column: str, ids: DataFrame) -> DataFrame:
    """row, column: each list with its ids replaced by those of the table ids (old, new), in order; ids that it lacks fall away, lists may become empty."""
    each = df.select(row, F.posexplode(column).alias("_at", "old")).withColumn("old", F.trim("old"))
    got = each.join(ids, "old").groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "new"))), lambda s: s["new"]).alias(column))
    return df.select(row).join(got, row, "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))


def graded(df: DataFrame, key: str, value: str, grade: str, good) -> DataFrame:
    """key, pos, neg: the values whose grade passes and the others, distinct and in order of value."""
    side = lambda c: F.array_sort(F.collect_set(F.when(c, F.col(value))))
    ok = F.coalesce(good(F.col(grade)), F.lit(False))
    return df.groupBy(key).agg(side(ok).alias("pos"), side(~ok).alias("neg"))


def appended(df: DataFrame, key: list[str], order: str, lists: list[str], maps: list[str]) -> DataFrame:
    """One row for each key: lists holds the values of its rows in order; of a map's entries the later row's wins."""
    k = F.unhex(F.md5(F.concat(*(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in key))))
    rows = df.withColumn("_k", k)
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v")))), lambda s: s["v"])
    out = rows.groupBy("_k").agg(*(F.min_by(c, order).alias(c) for c in key), *(in_order(c).alias(f"{c}_list") for c in lists))
    for m in maps:
        last = rows.select("_k", F.col(order).alias("o"), F.explode(m).alias("mk", "mv")).groupBy("_k", "mk").agg(F.max_by("mv", "o").alias("mv"))
        out = out.join(last.groupBy("_k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mk", "mv")))).alias(m)), "_k", "left")
    return out.drop("_k")


def looked_up(df: DataFrame, pool: DataFrame, on: str, strict: bool = False) -> DataFrame:
    """df with the pool's other columns (the pool has each key once); a key that is missing leaves nulls, or is an error where strict."""
    got = df.join(pool.withColumn("_hit", F.lit(True)), on, "left")
    if strict:
        got = got.where(F.when(F.col("_hit"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("missing "), F.coalesce(F.col(on).cast("string"), F.lit("key")))).cast("boolean")))
    return got.drop("_hit")


def pieces_of(n: Column, shards: int, total: Column) -> Column:
    """The shard, from 0, of row n (from 0): contiguous shards of one size, the last shorter."""
    return F.floor(n / F.greatest(F.ceil(total / F.lit(shards)), F.lit(1))).cast("int")


def seeded_order(seed: str, key: Column) -> Column:
    """A column that orders rows by a shuffle of the seed."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def sampled_list(values: Column, seed: str, key: Column, n: int) -> Column:
    """n values of a list in a seeded order, beginning again where it is short; empty for an empty list."""
    order = F.array_sort(F.transform(values, lambda v, i: F.struct(F.md5(F.concat(F.lit(seed), key.cast("string"), F.lit("|"), i.cast("string"))).alias("o"), v.alias("v"))))
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: order[F.pmod(i, F.size(values))]["v"])).otherwise(F.array().cast("array<string>"))


def wrapped_list(values: Column, n: int) -> Column:
    """The first n values, beginning again where the list is short."""
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: values[F.pmod(i, F.size(values))])).otherwise(F.array().cast("array<string>"))


def collated(df: DataFrame, row: str, texts: str, images: str) -> DataFrame:
    """row, at, place, txt, has_txt, has_img: the instances' items flattened to one batch. place counts all of them from 0; masks say which part an item has, and
    missing texts are ''."""
    each = df.select(row, F.posexplode(F.arrays_zip(F.col(texts).alias("t"), F.col(images).alias("i"))).alias("at", "x"))
    each = each.select(row, "at", F.coalesce("x.t", F.lit("")).alias("txt"), (F.coalesce("x.t", F.lit("")) != "").alias("has_txt"), (F.coalesce("x.i", F.lit("")) != "").alias("has_img"))
    return numbered(each, [row, "at"], "place", begin=0)


def unseen(pools: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key over all pools, in the given order of pools and rows."""
    return first_of_each(pools, key, order)


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of a that b lacks, of b that a lacks (repeats count), and whether both hold the same."""
    only = lambda x, y, name: x.exceptAll(y).agg(F.count("*").alias(name))
    both = only(a, b, "only_a").crossJoin(only(b, a, "only_b"))  # one row each
    return both.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, digest: a signature of a table's rows in no order, by which an index is kept or built anew: how many, and sums of two halves of their MD5."""
    part = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    h = F.md5(F.concat(*(part(F.col(c)) for c in columns)))
    half = lambda i: F.sum(F.conv(F.substring(h, i, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("n"), F.concat_ws("-", F.coalesce(half(1), F.lit("0")), F.coalesce(half(9), F.lit("0"))).alias("digest"))


def sampled_signature(df: DataFrame, order: list[str], column: str, most: int = 64) -> DataFrame:
    """signature: SHA-256 of at most so many rows, evenly spaced in the given total order, with the number of rows."""
    rows = numbered(df.select(*order, *([column] if column not in order else [])), order, "_n", begin=0)
    n = df.agg(F.count("*").alias("_total"))
    step = F.greatest(F.ceil(F.col("_total") / F.lit(most)), F.lit(1))
    picked = rows.crossJoin(F.broadcast(n)).where(F.pmod("_n", step) == 0)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(column).cast("string").alias("v")))), lambda s: F.coalesce(s["v"], F.lit(""))), "|")
    return picked.agg(F.sha2(F.concat(F.coalesce(F.max("_total"), F.lit(0)).cast("string"), F.lit("|"), text), 256).alias("signature"))
