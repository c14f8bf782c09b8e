import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions.records import entity_key, image_key, json_text, split_name
from keyloom.operators import hotkeys, keys, search
from keyloom.operators import records as r
from keyloom.sources import files
from keyloom.streaming import judgements

ENTRY = "row_id long, qid string, query_txt string, query_img_path string, query_src_content string, pos_cand_list array<string>, query_file string, key_id string"


def test_record_columns(spark):
    df = spark.createDataFrame([("wd:q12 ", '{"entity_id": "q1"}', "a\\B%20c_1.JPG", "Dev"), (None, '{"entity_id": "q', "", None), ("", '"{\\"entity_id\\": \\"z\\"}"', None, " TRAINING")], "e string, j string, p string, s string")
    got = df.select(entity_key(F.col("e")), json_text(F.col("j"), "entity_id"), image_key(F.col("p")), split_name(F.col("s"))).collect()
    assert [tuple(x) for x in got] == [("Q12", "q1", "bc1", "val"), (None, None, "", None), (None, "z", "", "train")]


def test_hot_keys(spark):
    rows = [(i, f"1:{i // 2}", None, None, '{"entity_id": "Q1"}' if i % 3 else '{"entity_id"', ["5:1", " 5:1", f"6:{i}", ""], "query/train/mbeir_oven_train.jsonl", "clash") for i in range(300)]
    rows += [(900, None, None, None, None, None, "query/val/mbeir_oven_val.jsonl", "clash")]
    df = spark.createDataFrame(rows, ENTRY)
    got = {(x.key_kind, x.key_id): x for x in hotkeys.entry_keys(df, 7).collect()}
    assert got["candidate", "5:1"].n_rows == 300 and got["candidate", "5:1"].n_records == 150 and got["entity", "Q1"].n_rows == 200 and len(got) == 302
    assert {x.key_id for x in hotkeys.heavy_keys(df).collect()} == {"Q1", "5:1"}
    assert hotkeys.entry_keys(df.limit(0)).count() == 0


def test_search_agrees_with_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)).astype(np.float32).astype(float)
    v = spark.createDataFrame([(i, [float(y) for y in row], 0) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int").cache()
    books = search.load_books(v)
    q, coded = v.where("vec_id % 10 = 0"), search.encode(v.where("vec_id % 10 <> 0"), books)
    index = search.distinct_keys(coded)
    one = search.block_search(q, index, books, 500, spans=[3])
    codes = {tuple(c.codes) for c in coded.collect()}
    assert one.where("qid = 10").count() == len(codes)
    best = one.where("qid = 10 and beam_rank = 1").first()

    def score(c, spans):
        r, total, level = x[10], 0.0, 0
        for span in spans:
            left = r
            for k in range(level, level + span):
                g = np.array([2 * r @ w - w @ w for w in books.words[k]])
                total += g[c[k]] - g.max() - np.log(np.exp(g - g.max()).sum())
                left = left - books.words[k][c[k]]
            r, level = left, level + span
        return total

    assert best.score == pytest.approx(max(score(c, [3]) for c in codes), abs=1e-9)
    for spans in ([1, 1, 1], [1, 2], [2, 1]):
        wide = search.block_search(q, index, books, 500, spans).where("qid = 10").collect()
        assert len(wide) == len(codes) and all(r.score == pytest.approx(score(r.codes, spans), abs=1e-9) for r in wide)
    with pytest.raises(ValueError):
        search.block_search(q, index, books, 5, spans=[1, 1])
    assert keys.weights(-1, 0) == (1.0, 0.0) and keys.weights(1, 3) == (0.25, 0.75)
    # a budget that everything meets finishes at once, none at the last level; both give what the fixed spans give
    same = lambda a, b: sorted((r.prefix, round(r.score, 9)) for r in a.collect()) == sorted((r.prefix, round(r.score, 9)) for r in b.collect())
    plan = lambda **kw: search.planned_search(q, index, books, 6, **kw).where("qid = 20")
    fixed = lambda spans: search.block_search(q, index, books, 6, spans).where("qid = 20")
    assert same(plan(budget=10**6), fixed([1, 2])) and same(plan(budget=0), fixed([1, 1, 1])) and same(plan(each=0), fixed([1, 1, 1]))
    assert same(search.search(q, index, books, 6, one_pass=True).where("qid = 20"), fixed([3]))
    assert search.block_search(q.limit(0), index, books, 5).count() == 0
    small, search.CHUNK = search.CHUNK, 7
    try:
        assert same(search.block_search(q, index, books, 6, [1, 2]).where("qid = 20"), fixed([1, 2]))
    finally:
        search.CHUNK = small
    with pytest.raises(Exception, match="score hook"):
        search.block_search(q, index, books, 5, how=search.Scoring(hook=lambda a, b, c: c[:-1])).count()


def test_fixtures_of_index_and_planner(spark):
    rows = [(9, 2, 8, 4), (3, 7, 1, 6), (9, 2, 8, 4), (3, 7, 5, 0), (3, 1, 2, 9), (9, 4, 0, 1)]
    index = search.distinct_keys(spark.createDataFrame([(list(r),) for r in rows], "codes array<int>"))
    assert {tuple(r.codes) for r in index.collect()} == set(rows)
    assert {tuple(r.codes): r.leaves for r in search.leaves(index, 1).collect()} == {(9,): 2, (3,): 3}
    cube = search.distinct_keys(spark.createDataFrame([([a, b, c],) for a in (0, 1) for b in (10, 11) for c in (20, 21)], "codes array<int>"))
    nodes = keys.flat_nodes(keys.edges(cube, 3)).orderBy("depth", "id").collect()
    assert [(r.parent, r.token) for r in nodes if r.depth == 0] == [(0, 0), (0, 1)]
    assert [(r.parent, r.token, r.id) for r in nodes if r.depth == 1] == [(0, 10, 0), (0, 11, 1), (1, 10, 2), (1, 11, 3)]
    top = spark.createDataFrame([(o // 2, o % 2, t, s) for o, t, s in zip([0, 0, 1, 2, 3, 3, 3], [10, 11, 20, 30, 40, 41, 42], [0.1, 0.7, 0.5, 0.3, 0.9, 0.2, 0.8])], "qid long, owner int, token int, score double")
    got = keys.segmented_top(top, "qid", 3, ["owner", "token"]).orderBy("qid", "rank").collect()
    assert [r.token for r in got] == [11, 20, 10, 40, 42, 30] and [r.owner for r in got] == [0, 1, 0, 1, 1, 0]
    assert search.planner_spans(9, 3, True) == [(0, 1), (1, 2), (2, 3), (3, 9)] and search.planner_spans(9, 3, False) == [(i, i + 1) for i in range(9)]
    assert search.block_spans([1, 1, 6], 9, modality_level=True) == [1, 1, 1, 6]
    with pytest.raises(ValueError):
        search.block_spans([1, 2], 9)
    legal = spark.createDataFrame([([0, 0, 0],), ([0, 0, 1],), ([0, 1, 0],), ([1, 0, 0],)], "codes array<int>")
    near = keys.prefix_neighbours(spark.createDataFrame([(5, [0, 0, 0])], "vec_id long, codes array<int>"), search.distinct_keys(legal), (1, 2), 8, "s")
    assert {r.code for r in near.collect()} == {"<a0><b0><c1>", "<a0><b1><c0>"}
    # gains: |r|^2 - |r - c|^2, normalised rows of mean 0 and deviation 1; levels' gains add up to the error that they take away
    words, r = np.array([[1.0, 0], [0, 2], [-1, 1]]), np.array([[1.5, -1.5], [1.5, 2]])
    q = spark.createDataFrame([(i, [float(y) for y in row]) for i, row in enumerate(r)], "vec_id long, embedding array<float>")
    for g in keys.code_gains(q, words, None).collect():
        assert g.gain == pytest.approx((r[g.qid] ** 2).sum() - ((r[g.qid] - words[g.code]) ** 2).sum())
    z = keys.code_gains(q, words, None).groupBy("qid").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).collect()
    assert all(x.m == pytest.approx(0, abs=1e-9) and x.s == pytest.approx(1) for x in z)
    rebuilt = search.reconstructed(spark.createDataFrame([(1, [0, None, 2]), (2, [9]), (3, None)], "qid long, codes array<int>"), search.Books(np.arange(18.0).reshape(3, 3, 2))).collect()
    assert {x.id: x.v for x in rebuilt} == {1: [0 + 16, 1 + 17], 2: [0, 0], 3: [0, 0]}


def test_records(spark):
    df = spark.createDataFrame([("a b\r",), ('"x?"',), (None,), ("",)], "t string")
    assert [x[0] for x in df.select(r.sentence_form(F.col("t"))).collect()] == ["A b.", "X?", "", ""]
    ids = spark.createDataFrame([("3:7",), ("bad",), (None,)], "q string").select(r.hashed_id(F.col("q"), 500_000).alias("h"))
    assert [x[0] for x in ids.collect()] == [1_500_007, None, None]


def test_files(spark, tmp_path):
    (tmp_path / "q.txt").write_text("1:1 0 2:2 1 7\n\n1:1 0 2:3 0 7\n1:2\t0\t2:4\tx\t7\n")
    assert [tuple(x) for x in files.read_qrels(spark, str(tmp_path / "q.txt")).collect()] == [("1:1", "0", "2:2", 1, "7")]
    run = spark.createDataFrame([("1:1", 5, 1, "0")], "qid string, did long, rank int, task_id string")
    files.write_run(run, str(tmp_path / "run"), "me")
    assert tuple(files.read_run(spark, str(tmp_path / "run")).first()) == ("1:1", "5", 1, 1.0, "me", "0")
    np.save(tmp_path / "x.npy", np.arange(6.0).reshape(3, 2))
    assert [x.v for x in files.read_npy(spark, str(tmp_path / "x.npy")).orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]
    (tmp_path / "i.tsv").write_text("qm\tcm\tx\tds\tp1\tp2\ntext\timage\t\t3\tFind\t\n")
    assert files.read_instructions(spark, str(tmp_path / "i.tsv")).first().prompts == ["Find"]


def test_windowed_counts(spark):
    df = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:09:00", "a", 2.0), ("2024-01-01 00:11:00", "a", 4.0)], "t string, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp"))
    assert sorted((x.n, x.total) for x in judgements.windowed_counts(df).collect()) == [(1, 4.0), (2, 3.0)]
