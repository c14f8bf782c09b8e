"""The core's queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom.operators import hotkeys
from keyloom.plans import etl, records, reports, retrieval

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "search_block"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return hotkeys.heavy_keys(_t(spark, sf, "mbeir_entry"), alias=_t(spark, sf, "entity_alias"))


def p5_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases count as the entity that they finally lead to."""
    return hotkeys.entry_keys(_t(spark, sf, "mbeir_entry"), alias=_t(spark, sf, "entity_alias"))


_P5_SQL = r"""
WITH RECURSIVE clean AS (
  SELECT regexp_replace(upper(regexp_replace(alias_id, '\s+', '', 'g')), '^WD:', '') AS a, regexp_replace(upper(regexp_replace(entity_id, '\s+', '', 'g')), '^WD:', '') AS e, merged_at FROM entity_alias),
links AS (SELECT a, e FROM clean WHERE a <> e QUALIFY row_number() OVER (PARTITION BY a ORDER BY merged_at DESC NULLS LAST, e) = 1),
walk AS (SELECT a, e, 1 AS d FROM links UNION ALL SELECT w.a, l.e, d + 1 FROM walk w JOIN links l ON w.e = l.a WHERE d < 64),
fin AS (SELECT a, arg_max(e, d) AS f FROM walk GROUP BY a),
base AS (
  SELECT row_id, qid, regexp_extract(query_file, '(?:^|/)(train|val|test)/[^/]*$', 1) AS split, pos_cand_list,
    CASE WHEN json_valid(query_src_content) THEN json_extract_string(query_src_content, '$.entity_id') END AS raw
  FROM mbeir_entry),
keys AS (
  SELECT 'entity' AS key_kind, coalesce(f, k) AS key_id, qid, split, row_id FROM (SELECT *, regexp_replace(upper(regexp_replace(raw, '\s+', '', 'g')), '^WD:', '') AS k FROM base WHERE raw IS NOT NULL) x LEFT JOIN fin ON x.k = fin.a
  UNION ALL
  SELECT DISTINCT 'candidate', regexp_replace(d, '\s+', '', 'g'), qid, split, row_id FROM (SELECT unnest(pos_cand_list) AS d, qid, split, row_id FROM base)),
res AS (
  SELECT key_kind, key_id, count(*) AS n_rows, count(DISTINCT qid) AS n_records, count(*) FILTER (split = 'train') AS n_train,
    count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test
  FROM keys WHERE key_id <> '' GROUP BY ALL)
"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (p5_found, p5_keys)} | retrieval.QUERIES | records.QUERIES | etl.QUERIES | reports.QUERIES
SQL: dict[str, str] = {
    "p5_found": _P5_SQL + "SELECT key_kind, key_id FROM res WHERE n_rows >= 0.02 * (SELECT count(*) FROM mbeir_entry)",
    "p5_keys": _P5_SQL + "SELECT * FROM res",
} | retrieval.SQL | records.SQL | etl.SQL | reports.SQL
