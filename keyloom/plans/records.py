"""Queries on records, judgements, documents and events, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.functions.records import entity_key, file_dataset, file_split, json_text
from keyloom.operators import records as r
from keyloom.operators.keys import exact_percentiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None, *tables: str):
    """Register a function of the named tables as a query, with the SQL that gives the same rows."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf: f(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in tables))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@_query("SELECT row_id, split_part(qid, ':', 1)::BIGINT * 500000 + split_part(qid, ':', 2)::BIGINT AS hashed, qid AS restored FROM mbeir_entry", "mbeir_entry")
def hashed_query_ids(e):
    h = e.select("row_id", r.hashed_id(F.col("qid"), 500_000).alias("hashed"))
    return h.withColumn("restored", r.unhashed_id(F.col("hashed"), 500_000))


_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def sentence_sql(txt: str) -> str:
    """txt by the rules of sentence_form."""
    t = rf"""regexp_replace(regexp_replace(regexp_replace(replace(coalesce({txt}, ''), chr(13), ''), '^{_SPACE}', ''), '{_SPACE}$', ''), '^"+|"+$', '', 'g')"""
    return f"(SELECT CASE WHEN t = '' THEN '' WHEN regexp_matches(t, '[.?!]$') THEN upper(t[1]) || t[2:] ELSE upper(t[1]) || t[2:] || '.' END FROM (SELECT {t} AS t))"


@_query(f"SELECT row_id, {sentence_sql('query_txt')} AS txt FROM mbeir_entry", "mbeir_entry")
def sentence_forms(e):
    return e.select("row_id", r.sentence_form(F.col("query_txt")).alias("txt"))


def _union_sql(side: str) -> str:
    return (
        f"{side}s AS (SELECT query_txt, query_img_path, query_modality, string_agg(did, ',' ORDER BY o, i) AS {side} FROM (SELECT query_txt, query_img_path, query_modality, did, min(o) AS o, arg_min(i, [o, i]) AS i FROM (SELECT query_txt, query_img_path,"
        f" query_modality, row_id AS o, trim(unnest({side}_cand_list)) AS did, generate_subscripts({side}_cand_list, 1) AS i FROM mbeir_entry) WHERE did <> '' GROUP BY ALL) GROUP BY ALL)"
    )


_SAME = "x.query_txt IS NOT DISTINCT FROM k.query_txt AND x.query_img_path IS NOT DISTINCT FROM k.query_img_path AND x.query_modality IS NOT DISTINCT FROM k.query_modality"


@_query(
    f"WITH k AS (SELECT query_txt, query_img_path, query_modality, arg_min(qid, row_id) AS qid, count(*) AS copies FROM mbeir_entry GROUP BY ALL), {_union_sql('pos')}, {_union_sql('neg')}"
    f" SELECT k.*, coalesce(x.pos, '') AS pos, coalesce(y.neg, '') AS neg FROM k LEFT JOIN poss x ON {_SAME} LEFT JOIN negs y ON {_SAME.replace('x.', 'y.')}",
    "mbeir_entry",
)
def merged_queries(e):
    """One row for each text, image and modality: first qid, copies, and the ordered distinct unions of its positives and negatives."""
    got = r.merged_queries(e, ["query_txt", "query_img_path", "query_modality"], "row_id")
    return got.withColumn("pos", F.array_join("pos", ",")).withColumn("neg", F.array_join("neg", ","))


@_query("SELECT row_id, qid FROM mbeir_entry QUALIFY row_number() OVER (PARTITION BY qid ORDER BY row_id) = 1", "mbeir_entry")
def first_delivered(e):
    return r.first_of_each(e.select("row_id", "qid"), ["qid"], ["row_id"])


@_query("SELECT row_id, did FROM cand_pool QUALIFY row_number() OVER (PARTITION BY did ORDER BY row_id) > 1", "cand_pool")
def delivered_again(c):
    return r.all_but_first(c.select("row_id", "did"), ["did"], ["row_id"])


@_query("SELECT modality, count(*) AS n FROM cand_pool GROUP BY modality", "cand_pool")
def modality_counts(c):
    return c.groupBy("modality").agg(F.count("*").alias("n"))


@_query(
    "SELECT regexp_extract(query_file, '(train|val|test)/[^/]*$', 1) AS split, regexp_extract(query_file, 'mbeir_([^/]*?)_(train|val|test)\\.jsonl$', 1) AS dataset, query_modality, count(*) AS n, count(DISTINCT qid) AS queries,"
    " round(avg(len(pos_cand_list)), 6) AS positives, round(avg(len(neg_cand_list)), 6) AS negatives FROM mbeir_entry GROUP BY ALL",
    "mbeir_entry",
)
def query_report(e):
    size = lambda c: F.round(F.avg(F.when(F.col(c).isNotNull(), F.size(c))), 6)
    return e.groupBy(file_split(F.col("query_file")).alias("split"), file_dataset(F.col("query_file")).alias("dataset"), "query_modality").agg(
        F.count("*").alias("n"), F.countDistinct("qid").alias("queries"), size("pos_cand_list").alias("positives"), size("neg_cand_list").alias("negatives")
    )


@_query(
    "WITH x AS (SELECT modality, did, count(*) AS n FROM cand_pool GROUP BY ALL) SELECT modality, count(*) AS dids, round(avg(n), 6) AS mean_n, min(n) AS min_n, max(n) AS max_n FROM x GROUP BY GROUPING SETS ((), (modality))",
    "cand_pool",
)
def deliveries_by_modality(c):
    n = c.groupBy("modality", "did").agg(F.count("*").alias("n"))
    return n.cube("modality").agg(F.count("*").alias("dids"), F.round(F.avg("n"), 6).alias("mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"))


_POS = "(SELECT row_id, qid, trim(unnest(pos_cand_list)) AS did FROM mbeir_entry)"
_REFS = "(SELECT trim(unnest(list_concat(coalesce(pos_cand_list, []), coalesce(neg_cand_list, [])))) AS did FROM mbeir_entry)"
_FIRST = "(SELECT did, modality, txt, src_content FROM {t} QUALIFY row_number() OVER (PARTITION BY did ORDER BY row_id) = 1)"


@_query(
    f"SELECT p.row_id, p.did, coalesce(s.modality, c.modality) AS modality FROM {_POS} p LEFT JOIN {_FIRST.format(t='cand_pool_shared')} s ON s.did = p.did LEFT JOIN {_FIRST.format(t='cand_pool')} c ON c.did = p.did WHERE p.did <> ''",
    "mbeir_entry", "cand_pool", "cand_pool_shared",
)
def training_pairs(e, c, s):
    """Every positive of every record with its candidate's modality, from either pool; modality is null where the candidate is in neither."""
    return r.with_candidates(r.positives(e), c, s).select("row_id", "did", "modality")


@_query(f"SELECT row_id, did FROM cand_pool WHERE did IN (SELECT did FROM {_REFS})", "mbeir_entry", "cand_pool")
def referenced_pool(e, c):
    """Candidate rows that are referenced by a positive or a negative of any record."""
    return c.select("row_id", "did").join(r.referenced(e), "did", "left_semi")


@_query(f"SELECT row_id, did FROM cand_pool WHERE did NOT IN (SELECT did FROM {_REFS} WHERE did IS NOT NULL)", "mbeir_entry", "cand_pool")
def unreferenced_pool(e, c):
    """Candidate rows that are not referenced by a positive or a negative of any record."""
    return c.select("row_id", "did").join(r.referenced(e), "did", "left_anti")


@_query(f"SELECT row_id, count(*) AS own FROM {_POS} WHERE split_part(did, ':', 1) = split_part(qid, ':', 1) GROUP BY row_id", "mbeir_entry")
def own_dataset_positives(e):
    ds = lambda c: F.split(c, ":")[0]
    return r.positives(e).where(ds("did") == ds("qid")).groupBy("row_id").agg(F.count("*").alias("own"))


@_query("SELECT did, max(modality) AS modality, count(*) AS n FROM (SELECT * FROM cand_pool UNION ALL SELECT * FROM cand_pool_shared) GROUP BY did", "cand_pool", "cand_pool_shared")
def union_pool(c, s):
    return c.unionByName(s).groupBy("did").agg(F.max("modality").alias("modality"), F.count("*").alias("n"))


@_query("SELECT did FROM cand_pool INTERSECT SELECT did FROM qrels", "cand_pool", "qrels")
def judged_candidates(c, q):
    return c.select("did").intersect(q.select("did"))


@_query("SELECT coalesce(s.did, c.did) AS did, coalesce(s.txt, c.txt) AS txt FROM (SELECT did, arg_min(txt, row_id) AS txt FROM cand_pool WHERE txt IS NOT NULL GROUP BY did) c FULL JOIN (SELECT did, arg_min(txt, row_id) AS txt FROM cand_pool_shared WHERE txt IS NOT NULL GROUP BY did) s ON s.did = c.did", "cand_pool", "cand_pool_shared")
def pool_overlay(c, s):
    one = lambda d, n: d.where("txt is not null").groupBy("did").agg(F.min_by("txt", "row_id").alias(n))
    return one(c, "a").join(one(s, "b"), "did", "full_outer").select("did", F.coalesce("b", "a").alias("txt"))


@_query("SELECT qid, count(DISTINCT did) AS relevant, min(task_id) AS task_id FROM qrels WHERE relevance > 0 GROUP BY qid", "qrels")
def relevant_judgements(q):
    return q.where("relevance > 0").groupBy("qid").agg(F.countDistinct("did").alias("relevant"), F.min("task_id").alias("task_id"))


@_query(f"SELECT count(*) AS pairs, count(q.did) AS judged FROM (SELECT DISTINCT qid, did FROM {_POS}) p LEFT JOIN (SELECT DISTINCT qid, did FROM qrels WHERE relevance > 0) q ON p.qid = q.qid AND p.did = q.did", "mbeir_entry", "qrels")
def judged_positives(e, q):
    good = q.where("relevance > 0").select("qid", "did").distinct().withColumn("j", F.lit(1))
    return r.positives(e).select("qid", "did").distinct().join(good, ["qid", "did"], "left").agg(F.count("*").alias("pairs"), F.count("j").alias("judged"))


_WORDS = r"list_filter(regexp_split_to_array(txt, '[ \t\n\r\f\v]+'), lambda t: t <> '')"


@_query(f"SELECT modality, count(*) AS n, round(avg(w), 6) AS mean_words, min(w) AS min_words, max(w) AS max_words FROM (SELECT modality, len({_WORDS}) AS w FROM cand_pool WHERE txt IS NOT NULL) GROUP BY modality", "cand_pool")
def word_lengths(c):
    w = c.where("txt is not null").select("modality", F.size(r.word_list(F.col("txt"))).alias("w"))
    return w.groupBy("modality").agg(F.count("*").alias("n"), F.round(F.avg("w"), 6).alias("mean_words"), F.min("w").alias("min_words"), F.max("w").alias("max_words"))


@_query(f"SELECT row_id, array_to_string(({_WORDS})[1:100], ' ') AS txt FROM cand_pool WHERE txt IS NOT NULL", "cand_pool")
def first_hundred_words(c):
    return c.where("txt is not null").select("row_id", F.array_join(F.slice(r.word_list(F.col("txt")), 1, 100), " ").alias("txt"))


@_query(
    f"SELECT row_id, i AS chunk, array_to_string(w[i * 100 + 1 : i * 100 + 100], ' ') AS txt FROM (SELECT row_id, w, unnest(range((len(w) + 99) // 100)) AS i FROM (SELECT row_id, {_WORDS} AS w FROM cand_pool WHERE txt IS NOT NULL))",
    "cand_pool",
)
def hundred_word_chunks(c):
    w = c.where("txt is not null").select("row_id", r.word_list(F.col("txt")).alias("w")).where("size(w) > 0")
    i = w.select("row_id", "w", F.explode(F.expr("sequence(0L, (size(w) - 1) div 100)")).alias("chunk"))
    return i.select("row_id", "chunk", F.array_join(F.slice("w", (F.col("chunk") * 100 + 1).cast("int"), F.lit(100)), " ").alias("txt"))


@_query(
    "SELECT row_id, coalesce(json_extract_string(j, '$.wikidata_id'), json_extract_string(j, '$.id')) AS source_id FROM (SELECT row_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(j, '$')) THEN json_extract_string(j, '$')::JSON END ELSE j END AS j"
    " FROM (SELECT row_id, CASE WHEN json_valid(src_content) THEN src_content::JSON END AS j FROM cand_pool))",
    "cand_pool",
)
def source_ids(c):
    return c.select("row_id", json_text(F.col("src_content"), "wikidata_id", "id").alias("source_id"))


@_query(
    "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, round(max(value), 4) AS top FROM events GROUP BY event_type",
    "events",
)
def latency_report(e):
    mean = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.max("value"), 4).alias("top"))
    return mean.join(exact_percentiles(e, "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, 4), "event_type")


@_query("SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_error FROM events", "events")
def carried_forward(e):
    """The last error of the same user so far: a value that later rows inherit."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(w).alias("last_error"))


_JSON = "(SELECT *, CASE WHEN json_type(j0) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(j0, '$')) THEN json_extract_string(j0, '$')::JSON END ELSE j0 END AS j FROM (SELECT *, CASE WHEN json_valid({c}) THEN {c}::JSON END AS j0 FROM {t}))"
_ENTITY = r"nullif(regexp_replace(upper(regexp_replace({x}, '[\s\p{{Z}}\p{{C}}]+', '', 'g')), '^WD:', ''), '')"


@_query(
    f"WITH x AS (SELECT row_id, modality, {_ENTITY.format(x=chr(34) + 'w' + chr(34))} AS entity FROM (SELECT *, json_extract_string(j, '$.wikidata_id') AS w FROM {_JSON.format(c='src_content', t='cand_pool')}))"
    " SELECT row_id, modality FROM x WHERE entity IS NULL UNION ALL SELECT row_id, modality FROM (SELECT * FROM x WHERE entity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity, modality ORDER BY md5(row_id::VARCHAR), row_id) <= CASE WHEN modality = 'text' THEN 25 ELSE 137 END)",
    "cand_pool",
)
def trimmed_pools(c):
    """A seeded shuffle's first rows of each entity and modality, with the modality's own limit; rows without an entity all stay."""
    rows = c.select("row_id", "modality", entity_key(json_text(F.col("src_content"), "wikidata_id")).alias("entity"))
    n = F.row_number().over(Window.partitionBy("entity", "modality").orderBy(F.md5(F.col("row_id").cast("string")), "row_id"))
    most = F.when(F.col("modality") == "text", 25).otherwise(137)
    # the larger limit stands alone too, as a bound that Spark applies before the shuffle
    kept = rows.where("entity is not null").withColumn("n", n).where((F.col("n") <= 137) & (F.col("n") <= most))
    return kept.select("row_id", "modality").unionByName(rows.where("entity is null").select("row_id", "modality"))


@_query("SELECT coalesce(a.key, b.key) AS key, a.n AS n_train, b.n AS n_test, b.n - a.n AS delta FROM (SELECT query_modality AS key, count(*) AS n FROM mbeir_entry WHERE query_file LIKE '%/train/%' GROUP BY 1) a FULL JOIN (SELECT query_modality AS key, count(*) AS n FROM mbeir_entry WHERE query_file LIKE '%/test/%' GROUP BY 1) b ON a.key = b.key", "mbeir_entry")
def compared_runs(e):
    side = lambda s: e.where(file_split(F.col("query_file")) == s).groupBy(F.col("query_modality").alias("key")).agg(F.count("*").alias(f"n_{s}"))
    return side("train").join(side("test"), "key", "full_outer").withColumn("delta", F.col("n_test") - F.col("n_train"))
