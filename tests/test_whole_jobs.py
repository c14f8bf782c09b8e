from keyloom.plans import queries as plans

ENTRY = "row_id long, qid string, query_txt string, query_img_path string, query_modality string, pos_cand_list array<string>, neg_cand_list array<string>"
POOL = "row_id long, did string, txt string, modality string, src_content string"


def run(spark, tmp_path, name, **tables):
    for k, df in tables.items():
        df.write.mode("overwrite").parquet(str(tmp_path / f"{k}.parquet"))
    return [tuple(x) for x in plans.QUERIES[name](spark, str(tmp_path)).collect()]


def test_training_pairs_of_both_pools(spark, tmp_path):
    e = spark.createDataFrame([(1, "1:1", "a", None, "text", ["5:1", " 9:1", "5:1"], None), (2, "1:2", "b", None, "text", ["9:1", "7:7", ""], None), (3, "1:3", None, None, "text", None, [])], ENTRY)
    c = spark.createDataFrame([(2, "5:1", None, "image", None), (1, "5:1", None, "text", None)], POOL)
    s = spark.createDataFrame([(1, "9:1", None, "image,text", None), (2, "9:1", None, "text", None)], POOL)
    got = run(spark, tmp_path, "training_pairs", mbeir_entry=e, cand_pool=c, cand_pool_shared=s)
    assert sorted(got, key=str) == [(1, "5:1", "text"), (1, "5:1", "text"), (1, "9:1", "image,text"), (2, "7:7", None), (2, "9:1", "image,text")]


def test_trim_is_per_entity(spark, tmp_path):
    src = lambda i: '{"wikidata_id": "%s"}' % i
    rows = [(i, f"1:{i}", None, "text", src("Q1")) for i in range(30)] + [(100 + i, f"1:{i}", None, "text", src("Q2")) for i in range(26)]
    rows += [(200 + i, f"1:{i}", None, "image", src("Q1")) for i in range(140)] + [(400 + i, f"1:{i}", None, "text", None if i % 2 else "{") for i in range(60)] + [(500, "1:1", None, None, src("Q3"))]
    got = run(spark, tmp_path, "trimmed_pools", cand_pool=spark.createDataFrame(rows, POOL))
    assert len(got) == len(set(got)) == 25 + 25 + 137 + 60 + 1
    assert sum(i < 100 for i, _ in got) == 25 and sum(100 <= i < 200 for i, _ in got) == 25 and sum(i >= 400 for i, _ in got) == 61


def test_pools_know_negatives(spark, tmp_path):
    e = spark.createDataFrame([(1, "1:1", "a", None, "text", ["5:1"], [" 6:1 "]), (2, "1:2", "b", None, "text", None, ["6:2", None]), (3, "1:3", "c", None, "text", ["5:2"], None)], ENTRY)
    c = spark.createDataFrame([(i, d, None, "text", None) for i, d in enumerate(["5:1", "5:2", "6:1", "6:2", "8:1", "6:1"])], POOL)
    dids = lambda name: sorted(x for row in run(spark, tmp_path, name, mbeir_entry=e, cand_pool=c) for x in row if isinstance(x, str))
    assert dids("referenced_pool") == ["5:1", "5:2", "6:1", "6:1", "6:2"] and dids("unreferenced_pool") == ["8:1"]


def test_merged_queries_keep_all_candidates(spark, tmp_path):
    rows = [(3, "1:3", "a", "", "text", ["5:3", "5:1 "], ["6:9"]), (1, "1:1", "a", None, "text", ["5:2", "5:1", "5:2"], None), (2, "1:2", "a", None, "text", None, ["6:1", "6:9", ""])]
    e = spark.createDataFrame([*rows, (4, "1:4", None, None, "text", None, [])], ENTRY)
    e = e.unionByName(spark.createDataFrame([(5, "1:5", None, "a", "text", ["5:9"], None)], ENTRY))  # the image of this name isn't the text
    got = {x[:3]: x[3:] for x in run(spark, tmp_path, "merged_queries", mbeir_entry=e)}
    assert got == {
        ("a", "", "text"): ("1:3", 1, "5:3,5:1", "6:9"), ("a", None, "text"): ("1:1", 2, "5:2,5:1", "6:1,6:9"), (None, None, "text"): ("1:4", 1, "", ""), (None, "a", "text"): ("1:5", 1, "5:9", ""),
    }


def test_aliases_share_a_key(spark, tmp_path):
    rows = [(i, f"1:{i // 2}", '{"entity_id": "%s"}' % e, ["5:1"], "query/train/mbeir_oven_train.jsonl") for i, e in enumerate(["Q1", " q2", "wd:Q3", "Q1", "Q4"])]
    e = spark.createDataFrame([*rows, (9, "1:9", "{", None, "query/val/mbeir_oven_val.jsonl")], "row_id long, qid string, query_src_content string, pos_cand_list array<string>, query_file string")
    a = spark.createDataFrame([("Q3", "q2"), ("wd:Q2", "Q1"), ("Q8", "Q9")], "alias_id string, entity_id string").selectExpr("*", "timestamp'2024-01-01' AS merged_at")
    got = run(spark, tmp_path, "p5_keys", mbeir_entry=e, entity_alias=a)
    assert sorted(got) == [("candidate", "5:1", 5, 3, 5, 0, 0), ("entity", "Q1", 4, 2, 4, 0, 0), ("entity", "Q4", 1, 1, 1, 0, 0)]
