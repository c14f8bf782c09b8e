"""Queries that build records and pools, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.functions import text as x
from keyloom.functions.records import entity_key, file_dataset, file_split, json_text, parsed_json
from keyloom.operators import records as r
from keyloom.operators.keys import flat_nodes
from keyloom.plans.records import _ENTITY, _FIRST, _JSON, _POS, _WORDS, sentence_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None, *tables: str):
    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf: f(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in tables))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _case(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in table.items()) + " END"


_NAME = _case({str(v): k for k, v in x.DATASETS.items()}, "split_part(qid, ':', 1)")
_PATH = "regexp_extract(query_file, 'mbeir_([^/]*?)_(train|val|test)\\.jsonl$', 1)"
_SPLIT = "nullif(regexp_extract(query_file, '(?:^|/)(train|val|test)/[^/]*$', 1), '')"
_MARK = "coalesce(length({0})::VARCHAR || ':' || {0}, '-')"


@_query(f"WITH d AS (SELECT row_id, {_NAME} AS dataset, query_file FROM mbeir_entry) SELECT row_id, dataset, {_case(x.DATASETS, 'dataset')}::INT AS dataset_no, {_case(x.DOMAINS, 'dataset')} AS domain, {_PATH} AS file_dataset FROM d", "mbeir_entry")
def dataset_names(e):
    d = e.select("row_id", x.dataset_name(F.split("qid", ":")[0]).alias("dataset"), file_dataset(F.col("query_file")).alias("file_dataset"))
    return d.select("*", x.dataset_id(F.col("dataset")).alias("dataset_no"), x.dataset_domain(F.col("dataset")).alias("domain"))


_TASK = _case(x.TASKS, "query_modality || ' -> ' || modality")


@_query(f"SELECT query_modality, modality, {_TASK}::INT AS task, {_case({v: k for k, v in x.TASKS.items()}, _TASK)} AS task_name, count(*) AS pairs FROM (SELECT e.query_modality, c.modality FROM (SELECT query_modality, trim(unnest(pos_cand_list)) AS did FROM mbeir_entry) e JOIN {_FIRST.format(t='cand_pool')} c USING (did)) GROUP BY ALL", "mbeir_entry", "cand_pool")
def modality_tasks(e, c):
    pairs = r.positives(e.select("*")).join(e.select("row_id", "query_modality"), "row_id").join(r.first_of_each(c.select("row_id", "did", "modality"), ["did"], ["row_id"]).drop("row_id"), "did")
    n = pairs.groupBy("query_modality", "modality").agg(F.count("*").alias("pairs")).withColumn("task", x.task_id(F.col("query_modality"), F.col("modality")))
    return n.withColumn("task_name", x.task_name(F.col("task")))


@_query("SELECT row_id, CASE WHEN coalesce(txt, '') <> '' OR coalesce(img_path, '') <> '' THEN concat_ws('-', nullif(txt, ''), nullif(img_path, ''), nullif(modality, '')) END AS key FROM cand_pool", "cand_pool")
def doc_keys(c):
    return c.select("row_id", r.doc_key(F.col("txt"), F.col("img_path"), F.col("modality")).alias("key"))


_CKEY = "concat_ws('-', nullif(txt, ''), nullif(img_path, ''), nullif(modality, ''))"


@_query(f"WITH k AS (SELECT row_id, did, CASE WHEN coalesce(txt, '') <> '' OR coalesce(img_path, '') <> '' THEN {_CKEY} END AS key FROM cand_pool), f AS (SELECT key, arg_min(did, row_id) AS first_did FROM k WHERE key IS NOT NULL GROUP BY key) SELECT row_id, did, first_did FROM k LEFT JOIN f USING (key)", "cand_pool")
def doc_key_lookup(c):
    """Each candidate's first row of the same text, image and modality; joined by digest, as keys hold whole texts."""
    k = c.select("row_id", "did", F.unhex(F.md5(r.doc_key(F.col("txt"), F.col("img_path"), F.col("modality")))).alias("k"))
    return r.looked_up(k, k.where("k is not null").groupBy("k").agg(F.min_by("did", "row_id").alias("first_did")), "k").drop("k")


_ENTRY_ENTITY = _ENTITY.format(x="json_extract_string(j, '$.entity_id')")
_CAND_ENTITY = _ENTITY.format(x="json_extract_string(j, '$.wikidata_id')")
_E = f"e AS (SELECT row_id, query_txt, {_ENTRY_ENTITY} AS entity FROM {_JSON.format(c='query_src_content', t='mbeir_entry')})"
_C = f"c AS (SELECT row_id, did, txt, pool_file, {_CAND_ENTITY} AS entity, json_extract_string(j, '$.wikipedia_title') AS title FROM {_JSON.format(c='src_content', t='cand_pool')})"


def _entities(e: DataFrame) -> DataFrame:
    return e.select("row_id", "query_txt", entity_key(json_text(F.col("query_src_content"), "entity_id")).alias("entity"))


def _passages(c: DataFrame) -> DataFrame:
    src = F.col("src_content")
    return c.select("row_id", "did", "txt", "pool_file", entity_key(json_text(src, "wikidata_id")).alias("entity"), json_text(src, "wikipedia_title").alias("title"))


@_query(f"WITH {_E}, {_C}, f AS (SELECT entity, arg_min(did, row_id) AS did FROM c WHERE entity IS NOT NULL GROUP BY entity) SELECT e.row_id, f.did FROM e LEFT JOIN f USING (entity)", "mbeir_entry", "cand_pool")
def json_key_lookup(e, c):
    """Each record's first candidate whose JSON names the same entity; null where none does."""
    first = _passages(c).where("entity is not null").groupBy("entity").agg(F.min_by("did", "row_id").alias("did"))
    return r.looked_up(_entities(e), first, "entity").select("row_id", "did")


_ANSWER = "regexp_extract(query_txt, '([A-Za-z]{5,})[^A-Za-z]*$', 1)"


@_query(
    f"WITH {_E}, {_C}, q AS (SELECT row_id, entity, {_ANSWER} AS answer FROM e WHERE entity IS NOT NULL AND {_ANSWER} <> ''), p AS (SELECT DISTINCT entity, did, txt FROM c WHERE txt IS NOT NULL)"
    " SELECT q.row_id, count(DISTINCT did) FILTER (contains(txt, answer)) AS pos, count(DISTINCT did) FILTER (NOT contains(txt, answer)) AS neg FROM q JOIN p USING (entity) GROUP BY q.row_id",
    "mbeir_entry", "cand_pool",
)
def answer_passages(e, c):
    """Per record, its entity's passages with and without the answer (here the question's last long word), as a part of the text.

    No record meets its entity's passages one by one: an answer of letters lies within one run of letters, so answers meet the pieces of the distinct runs of
    all passages, and what a passage holds is counted by entity and answer.
    """
    answer = F.regexp_extract("query_txt", "([A-Za-z]{5,})[^A-Za-z]*$", 1)
    q = _entities(e).select("row_id", "entity", answer.alias("answer")).where("entity is not null and answer <> ''")
    asked = q.select("entity", "answer").distinct()
    p = _passages(c).where("txt is not null").select("entity", "did", F.md5("txt").alias("t"), "txt").where("entity is not null")
    texts = p.select("entity", "did", "t").distinct().groupBy("entity", "did").agg(F.count("*").alias("texts"))
    runs = p.select("entity", "did", "t", F.explode(F.array_distinct(F.regexp_extract_all("txt", F.lit("[A-Za-z]{5,}"), 0))).alias("run"))
    part = F.expr("explode(array_distinct(flatten(transform(sequence(1, length(run) - 4), i -> transform(sequence(5, length(run) - i + 1), n -> substring(run, i, n))))))")
    known = runs.select("run").distinct().select("run", part.alias("answer")).join(asked.select("answer").distinct(), "answer")
    hits = runs.join(known, "run").join(asked, ["entity", "answer"], "left_semi").groupBy("entity", "answer", "did").agg(F.countDistinct("t").alias("k"))
    held = hits.join(texts, ["entity", "did"]).groupBy("entity", "answer").agg(F.count("*").alias("pos"), F.count(F.when(F.col("k") == F.col("texts"), 1)).alias("whole"))
    total = texts.groupBy("entity").agg(F.count("*").alias("dids"))
    got = q.join(total, "entity").join(held, ["entity", "answer"], "left")
    return got.select("row_id", F.coalesce("pos", F.lit(0)).alias("pos"), (F.col("dids") - F.coalesce("whole", F.lit(0))).alias("neg"))


@_query(f"WITH {_E}, {_C}, t AS (SELECT entity, arg_min(title, row_id) AS title, count(DISTINCT did) AS dids FROM c WHERE entity IS NOT NULL GROUP BY entity) SELECT e.row_id, e.entity, t.title, coalesce(dids, 0) AS dids FROM e LEFT JOIN t USING (entity) WHERE entity IS NOT NULL", "mbeir_entry", "cand_pool")
def entity_titles(e, c):
    """Two steps: record to entity, entity to the title of its first candidate."""
    t = _passages(c).where("entity is not null").groupBy("entity").agg(F.min_by("title", "row_id").alias("title"), F.countDistinct("did").alias("dids"))
    return r.looked_up(_entities(e).where("entity is not null"), t, "entity").select("row_id", "entity", "title", F.coalesce("dids", F.lit(0)).alias("dids"))


_NEW = "n AS (SELECT did AS old, split_part(did, ':', 1) || ':' || row_number() OVER (PARTITION BY split_part(did, ':', 1) ORDER BY row_id) AS new FROM (SELECT did, min(row_id) AS row_id FROM cand_pool GROUP BY did))"


def _new_ids(c: DataFrame) -> DataFrame:
    firsts = c.groupBy("did").agg(F.min("row_id").alias("row_id"))
    return r.assigned_ids(firsts, F.split("did", ":")[0], ["row_id"]).select(F.col("did").alias("old"), F.col("new_id").alias("new"))


@_query(f"WITH {_NEW} SELECT * FROM n", "cand_pool")
def new_ids(c):
    """Ids "ds:i" in the order of first rows."""
    return _new_ids(c)


@_query(f"WITH {_NEW} SELECT e.row_id, coalesce(m.pos, '') AS pos FROM mbeir_entry e LEFT JOIN (SELECT row_id, string_agg(new, ',' ORDER BY i) AS pos FROM (SELECT row_id, trim(unnest(pos_cand_list)) AS old, generate_subscripts(pos_cand_list, 1) AS i FROM mbeir_entry) JOIN n USING (old) GROUP BY row_id) m USING (row_id)", "mbeir_entry", "cand_pool")
def remapped_positives(e, c):
    return r.remapped(e, "row_id", "pos_cand_list", _new_ids(c)).select("row_id", F.array_join("pos_cand_list", ",").alias("pos"))


@_query("SELECT pool_file, n, (coalesce(sum(n) OVER (ORDER BY pool_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS begins FROM (SELECT pool_file, count(*) AS n FROM cand_pool GROUP BY pool_file)", "cand_pool")
def chunk_starts(c):
    """Where each file's ids begin: the running sum of the files' sizes before it."""
    before = Window.orderBy("pool_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return c.groupBy("pool_file").agg(F.count("*").alias("n")).withColumn("begins", F.coalesce(F.sum("n").over(before), F.lit(0)))


@_query(f"WITH {_C}, p AS (SELECT DISTINCT row_id, trim(unnest(pos_cand_list)) AS did FROM mbeir_entry WHERE query_file LIKE '%mbeir_oven%'), w AS (SELECT did, entity FROM c QUALIFY row_number() OVER (PARTITION BY did ORDER BY row_id) = 1), i AS (SELECT DISTINCT entity, did AS passage FROM c WHERE pool_file LIKE '%mbeir_infoseek%'), n AS (SELECT entity, count(*) AS passages, min(passage) AS first_passage FROM i GROUP BY entity) SELECT DISTINCT p.row_id, w.entity, passages, first_passage FROM p JOIN w USING (did) JOIN n USING (entity)", "mbeir_entry", "cand_pool")
def same_entity_passages(e, c):
    """For the positives of one dataset, their entity and how many passages the other dataset has of it: record and passages meet in the entity, so a hot entity's
    pairs aren't spelled out."""
    all_c = _passages(c)
    own = r.first_of_each(all_c.select("row_id", "did", "entity"), ["did"], ["row_id"]).drop("row_id")
    other = all_c.where(F.col("pool_file").contains("mbeir_infoseek")).select("entity", F.col("did").alias("passage")).distinct()
    refs = r.positives(e.where(F.col("query_file").contains("mbeir_oven"))).select("row_id", "did").distinct()
    n = other.groupBy("entity").agg(F.count("*").alias("passages"), F.min("passage").alias("first_passage"))
    return refs.join(own, "did").select("row_id", "entity").distinct().join(n, "entity").select("row_id", "entity", "passages", "first_passage")


@_query(f"WITH f AS (SELECT row_id, query_modality, trim(pos_cand_list[1]) AS did FROM mbeir_entry WHERE len(pos_cand_list) > 0), m AS (SELECT f.*, coalesce(s.modality, c.modality) AS modality FROM f LEFT JOIN {_FIRST.format(t='cand_pool')} c USING (did) LEFT JOIN {_FIRST.format(t='cand_pool_shared')} s USING (did)) SELECT row_id, CASE modality WHEN 'text' THEN 'text' WHEN 'image,text' THEN 'image,text' WHEN 'image' THEN 'image' ELSE 'unknown' END AS route FROM m", "mbeir_entry", "cand_pool", "cand_pool_shared")
def routed_queries(e, c, s):
    """The task that a record's first positive's modality gives; an unknown candidate or modality is routed to unknown."""
    first = e.where(F.size("pos_cand_list") > 0).select("row_id", F.trim(F.col("pos_cand_list")[0]).alias("did"))
    return r.with_candidates(first, c, s).select("row_id", F.when(F.col("modality").isin("text", "image", "image,text"), F.col("modality")).otherwise("unknown").alias("route"))


@_query("SELECT row_id, qid FROM mbeir_entry WHERE (coalesce(trim(query_txt), '') <> '' OR coalesce(trim(query_img_path), '') <> '') AND len(list_filter(coalesce(pos_cand_list, []), lambda d: trim(coalesce(d, '')) <> '')) > 0", "mbeir_entry")
def complete_records(e):
    """Records with a text or an image, and at least one positive."""
    some = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return e.where((some("query_txt") | some("query_img_path")) & F.exists("pos_cand_list", lambda d: F.trim(d) != "")).select("row_id", "qid")


@_query("SELECT qid, coalesce(string_agg(did, ',' ORDER BY did) FILTER (good), '') AS pos, coalesce(string_agg(did, ',' ORDER BY did) FILTER (NOT good), '') AS neg FROM (SELECT DISTINCT qid, did, coalesce(relevance >= 1, false) AS good FROM qrels) GROUP BY qid", "qrels")
def graded_lists(q):
    """Positives and negatives by grade."""
    g = r.graded(q, "qid", "did", "relevance", lambda c: c >= 1)
    return g.select("qid", F.array_join("pos", ",").alias("pos"), F.array_join("neg", ",").alias("neg"))


@_query(
    f"WITH k AS (SELECT *, md5({_MARK.format('query_txt')} || {_MARK.format('query_modality')}) AS k FROM mbeir_entry), m AS (SELECT k, d, arg_max(row_id, row_id) AS v FROM (SELECT k, row_id, unnest(list_distinct(list_filter(coalesce(pos_cand_list, []), lambda d: d IS NOT NULL))) AS d FROM k) GROUP BY k, d)"
    " SELECT a.query_txt, a.query_modality, a.qids, coalesce(b.last, '') AS last FROM (SELECT k, any_value(query_txt) AS query_txt, any_value(query_modality) AS query_modality, string_agg(qid, ',' ORDER BY row_id) AS qids FROM k GROUP BY k) a LEFT JOIN (SELECT k, string_agg(d || '=' || v, ',' ORDER BY d) AS last FROM m GROUP BY k) b USING (k)",
    "mbeir_entry",
)
def appended_records(e):
    """Records of one text: their ids in order, and a map of their candidates in which the later record wins."""
    ids = F.transform(F.array_distinct(F.filter(F.coalesce("pos_cand_list", F.array().cast("array<string>")), lambda d: d.isNotNull())), lambda d: F.struct(d.alias("k"), F.col("row_id").alias("v")))
    got = r.appended(e.withColumn("last", F.map_from_entries(ids)), ["query_txt", "query_modality"], "row_id", ["qid"], ["last"])
    pairs = F.array_join(F.transform(F.map_entries("last"), lambda s: F.concat(s["key"], F.lit("="), s["value"].cast("string"))), ",")
    return got.select("query_txt", "query_modality", F.array_join("qid_list", ",").alias("qids"), F.coalesce(pairs, F.lit("")).alias("last"))


@_query(
    f"WITH p AS (SELECT e.row_id, e.qid, e.query_modality, e.i, c.modality, e.did, len({_WORDS.replace('txt', 'query_txt')}) AS w FROM (SELECT row_id, qid, query_modality, query_txt, trim(unnest(pos_cand_list)) AS did, generate_subscripts(pos_cand_list, 1) AS i FROM mbeir_entry) e JOIN {_FIRST.format(t='cand_pool')} c USING (did))"
    " SELECT query_modality, modality, count(*) AS pairs, count(DISTINCT qid) AS queries, count(DISTINCT did) AS dids, count(DISTINCT qid) FILTER (i = 1) AS first_queries, round(avg(w), 5) AS mean_words FROM p GROUP BY ALL",
    "mbeir_entry", "cand_pool",
)
def modality_pairs(e, c):
    """By modalities of query and positive: pairs, distinct queries and candidates, queries whose first positive it is, mean words."""
    words = e.select("row_id", "query_modality", F.when(F.col("query_txt").isNotNull(), F.size(r.word_list(F.col("query_txt")))).alias("w"))
    pool = r.first_of_each(c.select("row_id", "did", "modality"), ["did"], ["row_id"]).drop("row_id")
    p = r.positives(e).join(words, "row_id").join(pool, "did")
    return p.groupBy("query_modality", "modality").agg(
        F.count("*").alias("pairs"), F.countDistinct("qid").alias("queries"), F.countDistinct("did").alias("dids"), F.countDistinct(F.when(F.col("pos") == 0, F.col("qid"))).alias("first_queries"), F.round(F.avg("w"), 5).alias("mean_words")
    )


@_query(f"WITH {_C.replace('txt, pool_file', 'txt, modality, pool_file')}, n AS (SELECT entity, modality, count(*) AS n FROM c WHERE entity IS NOT NULL GROUP BY ALL), a AS (SELECT entity, sum(n) AS n FROM n GROUP BY entity) SELECT modality, count(*) AS entities, round(avg(n), 5) AS mean_n, min(n)::BIGINT AS min_n, max(n)::BIGINT AS max_n FROM n GROUP BY modality UNION ALL SELECT 'all', count(*), round(avg(n), 5), min(n)::BIGINT, max(n)::BIGINT FROM a", "cand_pool")
def entity_counts(c):
    """Rows of each entity: mean, least and most, for all modalities together and each."""
    n = c.select(entity_key(json_text(F.col("src_content"), "wikidata_id")).alias("entity"), "modality").where("entity is not null").groupBy("entity", "modality").agg(F.count("*").alias("n"))
    every = n.groupBy("entity").agg(F.sum("n").alias("n")).select("entity", F.lit("all").alias("modality"), "n")
    return n.unionByName(every).groupBy("modality").agg(F.count("*").alias("entities"), F.round(F.avg("n"), 5).alias("mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"))


_SP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{A0}]+"
_CAP = rf"regexp_replace(regexp_replace(c, '^{_SP}', ''), '{_SP}$', '')"


@_query(f"SELECT row_id, list_aggregate(list_transform(list_filter([query_txt, query_modality], lambda c: c IS NOT NULL AND c <> ''), lambda c: regexp_replace(lower({_CAP}[1]) || {_CAP}[2:], '\\.$', '')), 'string_agg', ' and ') AS caption FROM mbeir_entry", "mbeir_entry")
def joined_captions(e):
    return e.select("row_id", F.nullif(x.joined_captions(F.array("query_txt", "query_modality")), F.lit("")).alias("caption"))


@_query("SELECT row_id, regexp_replace(img_path, '([^/.])\\.[^./]*$', '\\1') AS bare, regexp_replace(img_path, '^[^/]*/', '') AS inner_path, img_path[1:4] AS head, regexp_extract(regexp_replace(img_path, '([^/.])\\.[^./]*$', '\\1'), '([^/]*/)?[^/]*$') AS path_key, right(img_path, 8)[1:2] AS digits FROM cand_pool WHERE length(img_path) > 8", "cand_pool")
def path_parts(c):
    p = F.col("img_path")
    return c.where(F.length(p) > 8).select("row_id", x.without_extension(p).alias("bare"), x.without_first_folder(p).alias("inner_path"), x.id_folder(p).alias("head"), x.path_key(p).alias("path_key"), x.id_digits(p).alias("digits"))


@_query("WITH n AS (SELECT row_id, regexp_replace(regexp_replace(regexp_extract(pool_file, '[^/]*$'), '^mbeir_', ''), '(_cand_pool)?\\.jsonl$', '') AS n FROM cand_pool) SELECT row_id, n AS pool, CASE WHEN lower(n || '_task0') IN ('mscoco_task0', 'flickr30k_task0') THEN lower(n || '_task0') || '_test' ELSE lower(n || '_task0') END AS task_pool FROM n", "cand_pool")
def pool_names(c):
    n = c.select("row_id", x.path_pool_name(F.col("pool_file")).alias("pool"))
    return n.withColumn("task_pool", x.pool_name(F.concat("pool", F.lit("_task0"))))


@_query(None, "mbeir_entry")
def chosen_prompts(e):
    """The prompt that each query always gets, by an eight-byte BLAKE2b digest, put before its text."""
    prompts = F.array(*(F.lit(p) for p in ("find the image that shows this", "which passage answers this?", "match this")))
    key = F.concat(F.col("qid"), F.lit("|"), F.col("query_modality"))
    p = e.select("row_id", "query_txt", r.sentence_form(x.chosen_prompt(prompts, key)).alias("prompt"))
    return p.select("row_id", "prompt", r.sentence_form(F.concat_ws(" ", "prompt", F.coalesce("query_txt", F.lit("")))).alias("txt"))


@_query(f"SELECT row_id, {sentence_sql(chr(39) + 'find this:' + chr(39) + ' || ' + chr(39) + ' ' + chr(39) + ' || coalesce(query_txt, ' + chr(39) * 2 + ')')} AS txt FROM mbeir_entry", "mbeir_entry")
def prompted_texts(e):
    return e.select("row_id", r.sentence_form(F.concat_ws(" ", F.lit("find this:"), F.coalesce("query_txt", F.lit("")))).alias("txt"))


_NUM = "CASE row_id % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN ' ' WHEN 2 THEN 'x1' WHEN 3 THEN row_id || '.5' ELSE ' ' || row_id || ' ' END"


@_query(f"SELECT row_id, TRY_CAST(nullif(nullif(trim({_NUM}), ''), 'N/A') AS DOUBLE) AS number, regexp_replace(did || ' ' || modality, '[^A-Za-z0-9._-]', '_', 'g') AS safe, CASE WHEN abs(row_id % 7 / 3.0) <= 1 THEN row_id % 7 / 3.0 * 100 ELSE row_id % 7 / 3.0 END AS percent FROM cand_pool", "cand_pool")
def tolerant_numbers(c):
    n = F.expr(_NUM.replace("row_id || '.5'", "concat(row_id, '.5')").replace("' ' || row_id || ' '", "concat(' ', row_id, ' ')"))
    third = F.col("row_id") % 7 / 3.0
    return c.select("row_id", x.parsed_number(n).alias("number"), x.safe_name(F.concat_ws(" ", "did", "modality")).alias("safe"), x.as_percent(third).alias("percent"))


@_query("SELECT doc_id, round((doc_id % 1000 / 1000.0 + 0.00005)::DECIMAL(30,15) * 100, 2)::DECIMAL(20,2)::VARCHAR AS percent FROM documents", "documents")
def decimal_percents(d):
    return d.select("doc_id", x.decimal_percent(F.col("doc_id") % 1000 / F.lit(1000).cast("decimal(10,0)") + F.lit("0.00005").cast("decimal(10,5)")).alias("percent"))


@_query("WITH t AS (SELECT count(*) AS t FROM cand_pool), n AS (SELECT did, row_number() OVER (ORDER BY row_id) - 1 AS n FROM cand_pool) SELECT sha256(any_value(t)::VARCHAR || '|' || string_agg(did, '|' ORDER BY n)) AS signature FROM n, t WHERE n % greatest(ceil(t / 64)::BIGINT, 1) = 0", "cand_pool")
def pool_signature(c):
    return r.sampled_signature(c, ["row_id"], "did")


@_query(f"SELECT count(*) AS n, sum(('0x' || h[1:8])::BIGINT)::VARCHAR || '-' || sum(('0x' || h[9:16])::BIGINT)::VARCHAR AS digest FROM (SELECT md5({_MARK.format('did')} || {_MARK.format('txt')}) AS h FROM cand_pool)", "cand_pool")
def pool_fingerprint(c):
    return r.fingerprint(c, ["did", "txt"])


_CUTS = "CASE WHEN n <= t * 0.8 THEN 'train' WHEN n <= t * 0.9 THEN 'val' ELSE 'test' END"


@_query(f"WITH n AS (SELECT row_id, row_number() OVER (ORDER BY md5('11' || row_id), row_id) AS n, count(*) OVER () AS t FROM cand_pool) SELECT row_id, {_CUTS} AS part FROM n", "cand_pool")
def sliced_rows(c):
    """Rows cut to 80, 10 and 10 in 100 after a seeded shuffle, numbered without a sort in one task."""
    n = r.numbered(c.select("row_id", r.seeded_order("11", F.col("row_id")).alias("o")), ["o", "row_id"])
    return n.crossJoin(F.broadcast(c.agg(F.count("*").alias("t")))).select("row_id", F.expr(_CUTS).alias("part"))


@_query("WITH n AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS n, count(*) OVER () AS t FROM cand_pool) SELECT shard::INT AS shard, count(*) AS n, min(row_id) AS first_row, max(row_id) AS last_row FROM (SELECT *, n // greatest(ceil(t / 7)::BIGINT, 1) AS shard FROM n) GROUP BY shard", "cand_pool")
def shards(c):
    """Seven contiguous shards, the last shorter."""
    n = r.numbered(c.select("row_id"), ["row_id"], begin=0).crossJoin(F.broadcast(c.agg(F.count("*").alias("t"))))
    return n.groupBy(r.pieces_of(F.col("n"), 7, F.col("t")).alias("shard")).agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


@_query(f"SELECT row_id, trim(pos_cand_list[1]) AS first_pos, list_aggregate(CASE WHEN len(neg_cand_list) > 0 THEN list_transform(range(3), lambda i: neg_cand_list[i % len(neg_cand_list) + 1]) ELSE [] END, 'string_agg', ',') AS negs FROM mbeir_entry WHERE len(pos_cand_list) > 0", "mbeir_entry")
def training_candidates(e):
    """The first positive, and three negatives, beginning again where there are fewer."""
    return e.where(F.size("pos_cand_list") > 0).select("row_id", F.trim(F.col("pos_cand_list")[0]).alias("first_pos"), F.nullif(F.array_join(r.wrapped_list(F.coalesce("neg_cand_list", F.array().cast("array<string>")), 3), ","), F.lit("")).alias("negs"))


@_query("WITH p AS (SELECT row_id, list_sort(list_transform(range(len(pos_cand_list)), lambda i: {'o': md5('5' || row_id || '|' || i), 'v': pos_cand_list[i + 1]})) AS s FROM mbeir_entry WHERE len(pos_cand_list) > 0) SELECT row_id, list_aggregate(list_transform(range(2), lambda i: s[i % len(s) + 1].v), 'string_agg', ',') AS picked FROM p", "mbeir_entry")
def sampled_positives(e):
    """Two positives by a seeded shuffle, again from the start where there is one."""
    return e.where(F.size("pos_cand_list") > 0).select("row_id", F.array_join(r.sampled_list(F.col("pos_cand_list"), "5", F.col("row_id"), 2), ",").alias("picked"))


@_query("SELECT row_id, 0 AS at, coalesce(query_txt, '') AS txt, coalesce(query_txt, '') <> '' AS has_txt, coalesce(query_img_path, '') <> '' AS has_img, (row_number() OVER (ORDER BY row_id) - 1) * 2 AS place FROM mbeir_entry UNION ALL SELECT row_id, 1, query_modality, true, coalesce(query_file, '') <> '', (row_number() OVER (ORDER BY row_id) - 1) * 2 + 1 FROM mbeir_entry", "mbeir_entry")
def collated(e):
    """Two items an instance, flattened to one batch with their places and masks."""
    rows = e.select("row_id", F.array("query_txt", "query_modality").alias("t"), F.array("query_img_path", "query_file").alias("i"))
    return r.collated(rows, "row_id", "t", "i")


@_query("SELECT c.modality, count(*) AS n, count(DISTINCT did) AS dids, bool_and(did IS NOT NULL) AS named FROM cand_pool c GROUP BY c.modality", "cand_pool")
def task_pools(c):
    """The pool parted by modality, with the check that ids aren't missing."""
    return c.groupBy("modality").agg(F.count("*").alias("n"), F.countDistinct("did").alias("dids"), F.bool_and(F.col("did").isNotNull()).alias("named"))


@_query("WITH a AS (SELECT did FROM cand_pool), b AS (SELECT DISTINCT did FROM cand_pool) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_b, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) = 0 AND (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) = 0 AS equal", "cand_pool")
def pool_equality(c):
    return r.set_difference(c.select("did"), c.select("did").distinct())


@_query("SELECT row_id, did FROM (SELECT 0 AS p, row_id, did, txt, img_path, modality FROM cand_pool_shared UNION ALL SELECT 1, row_id, did, txt, img_path, modality FROM cand_pool) QUALIFY row_number() OVER (PARTITION BY txt, img_path, modality ORDER BY p, row_id) = 1", "cand_pool", "cand_pool_shared")
def unseen_candidates(c, s):
    """Of both pools in order, the first row of each text, image and modality; by digest, so that texts aren't shuffled."""
    cols = ("txt", "img_path", "modality")
    part = lambda k: F.coalesce(F.concat(F.length(k).cast("string"), F.lit(":"), F.col(k)), F.lit("-"))
    one = lambda d, p: d.select(F.lit(p).alias("p"), "row_id", "did", F.unhex(F.md5(F.concat(*map(part, cols)))).alias("k"))
    return r.unseen(one(s, 0).unionByName(one(c, 1)), ["k"], ["p", "row_id"]).select("row_id", "did")


_NEST = "s1 AS (SELECT DISTINCT did FROM cand_pool WHERE row_id % 4 = 0), s2 AS (SELECT DISTINCT did FROM cand_pool WHERE row_id % 2 = 0), s3 AS (SELECT DISTINCT did FROM cand_pool)"


@_query(f"WITH {_NEST} SELECT 1 AS inner_no, 2 AS outer_no, (SELECT count(*) FROM s1 WHERE did NOT IN (FROM s2)) AS missing UNION ALL SELECT 2, 3, (SELECT count(*) FROM s2 WHERE did NOT IN (FROM s3)) UNION ALL SELECT 3, 2, (SELECT count(*) FROM s3 WHERE did NOT IN (FROM s2))", "cand_pool")
def nested_pools(c):
    """How many ids of one pool the next lacks; the last row asks the other way round."""
    pool = {1: c.where("row_id % 4 = 0"), 2: c.where("row_id % 2 = 0"), 3: c}
    part = lambda a, b: pool[a].select("did").distinct().join(pool[b].select("did"), "did", "left_anti").agg(F.lit(a).alias("inner_no"), F.lit(b).alias("outer_no"), F.count("*").alias("missing"))
    return part(1, 2).unionByName(part(2, 3)).unionByName(part(3, 2))


@_query(f"WITH p AS (SELECT DISTINCT split, did FROM (SELECT {_SPLIT} AS split, trim(unnest(pos_cand_list)) AS did FROM mbeir_entry) WHERE did <> '') SELECT split, count(*) AS dids FROM p GROUP BY split UNION ALL SELECT 'all', count(DISTINCT did) FROM p", "mbeir_entry")
def split_pools(e):
    """Each split's pool and the one of all splits, each without repeats."""
    p = r.positives(e).select("row_id", "did").join(e.select("row_id", file_split(F.col("query_file")).alias("split")), "row_id").select("split", "did").distinct()
    return p.groupBy("split").agg(F.count("*").alias("dids")).unionByName(p.select("did").distinct().agg(F.lit("all").alias("split"), F.count("*").alias("dids")))


@_query(f"WITH pos AS (SELECT DISTINCT {_PATH} AS dataset, trim(unnest(pos_cand_list)) AS did FROM mbeir_entry), pool AS (SELECT DISTINCT pool_file, did FROM cand_pool), o AS (SELECT dataset, pool_file, count(*) AS overlap FROM pos JOIN pool USING (did) GROUP BY ALL), z AS (SELECT pool_file, count(*) AS size FROM pool GROUP BY ALL) SELECT dataset, pool_file, overlap, contains(pool_file, dataset)::INT AS bonus, size FROM o JOIN z USING (pool_file) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY overlap DESC, contains(pool_file, dataset) DESC, size DESC, pool_file) = 1", "mbeir_entry", "cand_pool")
def aligned_pools(e, c):
    """For each dataset the pool that holds most of its positives; equals by name, then size."""
    pos = r.positives(e).select("row_id", "did").join(e.select("row_id", file_dataset(F.col("query_file")).alias("dataset")), "row_id").select("dataset", "did").distinct()
    pool = c.select("pool_file", "did").distinct()
    o = pos.join(pool, "did").groupBy("dataset", "pool_file").agg(F.count("*").alias("overlap")).join(pool.groupBy("pool_file").agg(F.count("*").alias("size")), "pool_file")
    o = o.withColumn("bonus", F.contains("pool_file", "dataset").cast("int"))
    best = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("overlap"), F.desc("bonus"), F.desc("size"), "pool_file"))
    return o.withColumn("n", best).where("n = 1").select("dataset", "pool_file", "overlap", "bonus", "size")


@_query("SELECT did, CAST(row_number() OVER (ORDER BY split_part(did, ':', 1)::INT, split_part(did, ':', 2)::INT) AS BIGINT) AS place FROM (SELECT DISTINCT did FROM cand_pool)", "cand_pool")
def numeric_order(c):
    """Ids in the order of their numbers."""
    p = F.split("did", ":")
    return r.numbered(c.select("did").distinct().select("did", p[0].cast("int").alias("a"), p[1].cast("int").alias("b")), ["a", "b"], "place").select("did", "place")


@_query("SELECT row_id, entity_id, coalesce(entity_id <> lag(entity_id) OVER (ORDER BY entity_id, row_id), true) AS starts, row_number() OVER (PARTITION BY entity_id ORDER BY row_id) - 1 AS place FROM entity_alias", "entity_alias")
def sorted_runs(a):
    """In sorted rows, where a value differs from the one before, and each row's place in its run."""
    w = Window.partitionBy("entity_id").orderBy("row_id")
    at = a.select("row_id", "entity_id", (F.row_number().over(w) - 1).cast("bigint").alias("place"))
    return at.withColumn("starts", F.col("place") == 0)


@_query("WITH p AS (SELECT did, row_id, pool_file FROM cand_pool) SELECT did, arg_min(pool_file, row_id) AS pool_file, count(*) - 1 AS later FROM p GROUP BY did", "cand_pool")
def cached_features(c):
    """One row an id, the first, and how many later ones were left out."""
    return c.groupBy("did").agg(F.min_by("pool_file", "row_id").alias("pool_file"), (F.count("*") - 1).alias("later"))


@_query("SELECT row_id, i - 1 AS beam, array_to_string(flat[(i - 1) * 2 + 1 : i * 2], ',') AS code FROM (SELECT row_id, flat, unnest(range(1, len(flat) // 2 + 1)) AS i FROM (SELECT row_id, pos_cand_list AS flat FROM mbeir_entry WHERE len(pos_cand_list) >= 2))", "mbeir_entry")
def beam_shapes(e):
    """Lists of K times L codes as K rows of L."""
    rows = e.where(F.size("pos_cand_list") >= 2).select("row_id", "pos_cand_list", F.explode(F.expr("sequence(0L, size(pos_cand_list) div 2 - 1L)")).alias("beam"))
    return rows.select("row_id", "beam", F.array_join(F.slice("pos_cand_list", (F.col("beam") * 2 + 1).cast("int"), F.lit(2)), ",").alias("code"))


@_query("WITH g AS (SELECT did, row_id FROM cand_pool UNION ALL SELECT did, row_id FROM cand_pool WHERE row_id % 9 = 0) SELECT (SELECT count(*) FROM (SELECT DISTINCT did, row_id FROM g)) AS trimmed, (SELECT count(DISTINCT row_id) FROM g) AS ids, (SELECT count(*) FROM (SELECT DISTINCT did, row_id FROM g)) = (SELECT count(DISTINCT row_id) FROM g) AS unique_ids", "cand_pool")
def gathered_rows(c):
    """Gathered parts, of which some repeat rows as padding: trimmed, and whether ids are then unique."""
    rows = c.select("did", "row_id")
    g = r.first_of_each(rows.unionByName(rows.where("row_id % 9 = 0")), ["did", "row_id"], ["row_id"])
    return g.agg(F.count("*").alias("trimmed"), F.countDistinct("row_id").alias("ids")).withColumn("unique_ids", F.col("trimmed") == F.col("ids"))
