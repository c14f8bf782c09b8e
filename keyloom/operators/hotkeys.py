"""Problem 5: per-key results when a few keys hold most rows.

Rows are range partitioned on the composite (key, record), with Spark's sampled quantiles as bounds, so a key that holds a tenth or a third
of all rows is cut into as many partitions as its share asks for. Range partitioning on (key, record) already clusters by (key, record): the first
aggregation needs no other exchange. It leaves one state per key and record; the second adds those up within each partition, and one
state per key and partition (several only for keys that cross a bound) is sent on to be stitched. Rows without a record would all share one value of the
composite; they are told apart by a third column, as they count as rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.records import entity_key, file_split, json_text
from keyloom.operators.aliases import final_entities
from keyloom.storage import materialize

SPLITS = ("train", "val", "test")
#: Parts that a key's rows without a record may be cut into.
LOOSE = 1024


def per_key(rows: DataFrame, keys: list[str], record: str, split: Column, partitions: int | None = None) -> DataFrame:
    """keys, n_rows, n_records (distinct record, null counts as none) and n_train, n_val, n_test.

    Rows with a null key are left out; rows with a null record count as rows only; an empty table gives no rows; other columns are not read.
    """
    spread = rows.select(*keys, F.col(record).alias("_record"), split.alias("_split")).dropna(subset=keys)
    nth = F.when(F.col("_record").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(LOOSE))).otherwise(F.lit(0)).cast("int")
    spread, by = spread.withColumn("_nth", nth), [*keys, "_record", "_nth"]
    spread = spread.repartitionByRange(*([partitions] if partitions else []), *by)
    count = lambda s: F.count(F.when(F.col("_split") == s, 1)).alias(f"n_{s}")
    states = spread.groupBy(*by).agg(F.count("*").alias("n_rows"), *(count(s) for s in SPLITS))
    return states.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), F.count("_record").alias("n_records"), *(F.sum(f"n_{s}").alias(f"n_{s}") for s in SPLITS)
    )


def keyed_entries(entries: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """key_kind, key_id, qid, split: a row for each entity and for each distinct candidate of each record. Blank candidates are left out.

    With a table of aliases, an entity is the one that it finally leads to.
    """
    clean = F.filter(F.transform("pos_cand_list", lambda d: F.regexp_replace(d, r"[\s\p{Z}\p{C}]+", "")), lambda d: d != "")
    split = file_split(F.col("query_file")).alias("split")
    entities = entries.select(entity_key(json_text(F.col("query_src_content"), "entity_id")).alias("alias_key"), "qid", split).where("alias_key is not null")
    if alias is not None:
        # read back from files, both sides of the join are plain exchanges, so Spark can cut a hot entity's partition where it doesn't broadcast
        entities = entities.join(materialize(final_entities(alias), "p5-aliases"), "alias_key", "left").withColumn("alias_key", F.coalesce("final_key", "alias_key"))
    candidates = entries.select(F.explode(F.array_distinct(clean)).alias("key_id"), "qid", split)
    one = entities.select(F.lit("entity").alias("key_kind"), F.col("alias_key").alias("key_id"), "qid", "split")
    return one.unionByName(candidates.select(F.lit("candidate").alias("key_kind"), "key_id", "qid", "split"))


def entry_keys(entries: DataFrame, partitions: int | None = None, alias: DataFrame | None = None) -> DataFrame:
    """key_kind, key_id, n_rows, n_records, n_train, n_val, n_test of every entity and candidate."""
    return per_key(keyed_entries(entries, alias), ["key_kind", "key_id"], "qid", F.col("split"), partitions)


def heavy_keys(entries: DataFrame, share: float = 0.02, alias: DataFrame | None = None) -> DataFrame:
    """key_kind, key_id of the keys that occur in at least the given share of all rows."""
    total = entries.agg((F.count("*") * F.lit(share)).alias("least"))
    return entry_keys(entries, alias=alias).crossJoin(F.broadcast(total)).where("n_rows >= least").select("key_kind", "key_id")
