"""Entity ids merged into others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.records import entity_key
from keyloom.storage import materialize


def final_entities(alias: DataFrame) -> DataFrame:
    """alias_key, final_key: each alias with the entity that it finally leads to, by pointer doubling.

    Of several targets of one alias the last merged counts (no time counts as first; ties: the smaller id); aliases of themselves and null ids
    count for nothing; the ids of a cycle all lead to its smallest id. Each round halves the chains left and is written to the shared folder.
    """
    a = alias.select(entity_key(F.col("alias_id")).alias("alias_key"), entity_key(F.col("entity_id")).alias("next"), "merged_at").dropna(subset=["alias_key", "next"])
    last = a.groupBy("alias_key").agg(F.min_by("next", F.struct(F.col("merged_at").isNull(), -F.unix_micros(F.col("merged_at").cast("timestamp")), "next")).alias("next"))
    links = materialize(last.where("alias_key <> next").withColumn("low", F.least("alias_key", "next")), "alias-links")
    n = links.count()
    for _ in range(max(1, n.bit_length()) + 1):
        far = links.select(F.col("alias_key").alias("next"), F.col("next").alias("then"), F.col("low").alias("then_low"))
        step = links.join(far, "next", "left")
        links = materialize(step.select("alias_key", F.coalesce("then", "next").alias("next"), F.least("low", F.coalesce("then_low", "low")).alias("low"), F.col("then").isNotNull().alias("moved")), "alias-links")
        if links.where("moved").isEmpty():
            break
    # what still moves after all chains must have ended is on a cycle or leads to one: its target is on it by now, and has seen all of it
    there = links.select(F.col("alias_key").alias("next"), F.col("low").alias("least"))
    ends = links.join(there, "next", "left")
    return ends.select("alias_key", F.when(F.col("moved"), F.coalesce("least", "low")).otherwise(F.col("next")).alias("final_key"))
