"""Problem 2: train, validation and test splits that keep related records together.

Records of one entity, after following entity_alias to its end, form a component. Components are weighed by their rows and spread over equal
bins by largest differencing: again and again the two partial solutions of greatest spread are combined, heaviest bin with lightest bin. Whole
bins are then given to the splits by target proportion.

The driver only sees tables of fixed size: components of at least 1/HEAVY of all rows (at most HEAVY of them) one by one, all lighter ones
as the LIGHT groups that a hash puts them in, each group whole. No component is dropped or cut.
"""

from __future__ import annotations

import heapq
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.functions.records import entity_key, file_split, json_text, split_name
from keyloom.operators.aliases import final_entities
from keyloom.storage import materialize

HEAVY = 2000
LIGHT = 4096
BINS = 100
TARGETS = {"train": 0.8, "val": 0.1, "test": 0.1}


def entity_rows(entries: DataFrame, alias: DataFrame) -> DataFrame:
    """row_id, entity_id (final), named (the split that data_split gives, else null), split (of the file) of each row that has an entity."""
    src = F.col("query_src_content")
    rows = entries.select("row_id", entity_key(json_text(src, "entity_id")).alias("alias_key"), split_name(json_text(src, "data_split")).alias("named"), file_split(F.col("query_file")).alias("split"))
    rows = rows.where(F.col("alias_key").isNotNull()).join(final_entities(alias), "alias_key", "left")
    return rows.select("row_id", F.coalesce("final_key", "alias_key").alias("entity_id"), "named", "split")


def components(rows: DataFrame) -> DataFrame:
    """entity_id, n_rows, n_named: rows of each component and how many splits its rows name."""
    one = lambda s: F.max((F.col("named") == s).cast("int"))
    named = sum((F.coalesce(one(s), F.lit(0)) for s in TARGETS), F.lit(0))
    return rows.groupBy("entity_id").agg(F.count("*").alias("n_rows"), named.alias("n_named"))


def largest_differencing(weights: list[int], bins: int) -> list[int]:
    """The bin of each weight. Partial solutions lie in a heap by spread (heaviest less lightest bin); two are combined by adding the
    heaviest bin of one to the lightest of the other. Items in a bin are a linked chain, so a combination costs one pass over the bins."""
    nxt = [-1] * len(weights)
    order = count()
    heap = []
    for i, w in enumerate(weights):
        part = [(w, i, i)]  # bins that hold something, heaviest first: weight, first and last item of the chain
        heapq.heappush(heap, (-w, next(order), part))
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        empty = (0, -1, -1)
        a += [empty] * (bins - len(a))
        b += [empty] * (bins - len(b))
        new = []
        for (w, f, e), (v, g, h) in zip(a, reversed(b)):
            if f >= 0 and g >= 0:
                nxt[e] = g
                new.append((w + v, f, h))
            elif f >= 0 or g >= 0:
                new.append((w, f, e) if f >= 0 else (v, g, h))
        new.sort(key=lambda x: -x[0])
        spread = new[0][0] - (new[-1][0] if len(new) == bins else 0)
        heapq.heappush(heap, (-spread, next(order), new))
    out = [0] * len(weights)
    for k, (_, i, _) in enumerate(heap[0][2] if heap else []):
        while i >= 0:
            out[i] = k
            i = nxt[i]
    return out


def bins_to_splits(loads: list[int], targets: dict[str, float] = TARGETS) -> list[str]:
    """The split of each bin: from the heaviest on, each goes where most of the target is still missing in proportion to the whole."""
    total, got = sum(loads), dict.fromkeys(targets, 0)
    out = [""] * len(loads)
    for i in sorted(range(len(loads)), key=lambda k: (-loads[k], k)):
        out[i] = max(targets, key=lambda s: targets[s] * total - got[s])
        got[out[i]] += loads[i]
    return out


def assigned(parts: DataFrame) -> DataFrame:
    """parts (of components()) with new_split."""
    spark = parts.sparkSession
    group = F.pmod(F.xxhash64("entity_id"), F.lit(LIGHT)).cast("int")
    total = parts.agg(F.sum("n_rows")).first()[0] or 0
    least = max(1, -(-total // HEAVY))
    unit = F.when(F.col("n_rows") >= least, F.col("entity_id")).otherwise(F.concat(F.lit("#"), group))
    units = parts.groupBy(unit.alias("unit")).agg(F.sum("n_rows").alias("n")).orderBy("unit").collect()  # at most HEAVY + LIGHT rows
    where = largest_differencing([u["n"] for u in units], BINS)
    loads = [0] * BINS
    for u, b in zip(units, where):
        loads[b] += u["n"]
    to = bins_to_splits(loads)
    table = spark.createDataFrame([(u["unit"], to[b]) for u, b in zip(units, where)], "unit string, new_split string")
    return parts.withColumn("unit", unit).join(F.broadcast(table), "unit").drop("unit")


def split_entities(entries: DataFrame, alias: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their entity, components with n_rows, n_named and new_split).

    Rows without an entity, or with broken JSON, get no split; an empty table gives no rows; ties between weights fall to the smaller id.
    """
    rows = entity_rows(entries, alias)
    return rows, assigned(materialize(components(rows), "p2-parts"))


def row_splits(entries: DataFrame, alias: DataFrame) -> DataFrame:
    """row_id, entity_id, new_split of every row that has an entity."""
    rows, parts = split_entities(entries, alias)
    return rows.join(parts.select("entity_id", "new_split"), "entity_id").select("row_id", "entity_id", "new_split")


def torn_entities(entries: DataFrame, alias: DataFrame) -> DataFrame:
    """entity_id of the components whose rows name at least two splits in data_split."""
    return split_entities(entries, alias)[1].where("n_named >= 2").select("entity_id")
