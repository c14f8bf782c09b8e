import base64
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions import text as x
from keyloom.operators import keys, records, reports, search
from keyloom.sources import files


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"qid": "1:1"}\n\n{"qid": "1:2"}\n')
    assert files.read_jsonl(spark, str(p), "qid string").count() == 2
    (tmp_path / "b.json").write_text('[{"qid": "1:1"}, {"qid": "1:2"}, {"qid": "1:3"}]')
    assert files.read_entries(spark, str(tmp_path / "b.json"), "qid string")[0] == 3 and files.read_entries(spark, str(p), "qid string")[0] == 2
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(tmp_path / "a.txt"), "qid string")
    with pytest.raises(FileNotFoundError):
        files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "qid string")
    df = spark.createDataFrame([("1:1", ["a"])], "qid string, l array<string>")
    files.write_jsonl(df, str(tmp_path / "out.jsonl"))
    files.write_jsonl(df, str(tmp_path / "out.jsonl"), append=True)
    assert files.read_jsonl(spark, str(tmp_path / "out.jsonl"), df.schema.simpleString()[7:-1].replace(":", " ")).count() == 2


def test_judgements_keep_order(spark, tmp_path):
    (tmp_path / "q.txt").write_text("1:1 0 2:9 1 7\n1:1 0 2:3 1 8\n1:1 0 2:1 0 8\n")
    got = files.judgement_lists(files.read_qrels(spark, str(tmp_path / "q.txt"), order=True)).first()
    assert got.dids == ["2:9", "2:3"] and got.task_id == "7"


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.arange(50, dtype=np.float16).reshape(25, 2))
    got = files.read_npy(spark, str(tmp_path / "x.npy"), rows=7).orderBy("row").collect()
    assert [r.row for r in got] == list(range(25)) and got[24].v == [48, 49]
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "did long, v array<float>")
    files.write_npy(df, str(tmp_path / "out"), ["did"], rows=4)
    back = np.concatenate([np.load(p) for p in sorted((tmp_path / "out").glob("part-?????.npy"))])
    ids = np.concatenate([np.load(p) for p in sorted((tmp_path / "out").glob("*.ids.npy"))])
    assert (back[:, 0] == np.arange(10)).all() and (ids == np.arange(10)).all()
    np.savez(tmp_path / "p.npz", query_id=np.array([5]), live_prefixes=[2], exposed_leaves=[9], frontier_prefixes=np.array([[[1, 2], [3, 4]]]), latency_ms=[1.5])
    row = files.read_profiles(spark, str(tmp_path / "p.npz")).first()
    assert row.frontier_prefixes == [[1, 2], [3, 4]] and row.latency_ms == 1.5
    np.savez(tmp_path / "f.npz", ids=[3, 3], img=[[1.0], [2.0]], text=[[0.0], [0.0]], img_mask=[1, 1], text_mask=[0, 1])
    row = files.read_features(spark, str(tmp_path / "f.npz")).collect()
    assert len(row) == 1 and row[0].img == [1.0] and row[0].has_img and not row[0].has_txt


def test_texts_and_logs(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a.jpg\t0.5\ta red\tdress\nbroken\n")
    assert [tuple(r) for r in files.read_labels(spark, str(tmp_path / "l.txt")).collect()] == [("a.jpg", 0.5, "a red\tdress")]
    (tmp_path / "v.csv").write_text("id,ref_path,left_path,right_path,left_vote,right_vote\n1,r,a,b,0,1\n")
    assert files.read_votes(spark, str(tmp_path / "v.csv")).first().chosen == "b"
    (tmp_path / "m.tsv").write_text("a\tb\n1\t2\n")
    assert files.read_table(spark, str(tmp_path / "m.tsv")).first().b == "2"
    (tmp_path / "run.log").write_text("R@10: 0.1\nTask one\nR@10: 0.5\nnoise\nTask two\nR@10: 0.7\n")
    got = files.read_log(spark, str(tmp_path / "run.log"), r"^Task (\w+)", {"r10": r"R@10: ([0-9.]+)"}).collect()
    assert [(r.task, r.value) for r in got] == [(None, 0.1), ("one", 0.5), ("two", 0.7)]
    assert files.last_match(spark, str(tmp_path / "run.log"), r"R@10: ([0-9.]+)").first().value == 0.7
    (tmp_path / "i.tsv").write_text("7\t" + base64.b64encode(b"\xff\xd8\xff....\xff\xd9").decode() + "\n8\t@@\n")
    img = {r.id: r.ok for r in files.image_bytes(spark, str(tmp_path / "i.tsv")).select("id", files.valid_image(F.col("content")).alias("ok")).collect()}
    assert img == {"7": True, "8": False}


def test_folders_and_kept_index(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("hello secret")
    (tmp_path / "d" / "b.txt").write_text("x" * 100)
    assert files.found_files(spark, str(tmp_path / "d"), "*.txt").count() == 2
    assert files.resolved(spark, str(tmp_path), "nowhere/a.txt").endswith("d/a.txt")
    assert {(r.path[-5:], r.marker) for r in files.marked_files(spark, str(tmp_path / "d"), ["secret"], 50).collect()} == {("a.txt", "secret"), ("b.txt", None)}
    assert files.checked_layout(spark, str(tmp_path), ["d", "e"], {"a": [1], "b": []})[0] == "missing e"
    index = spark.createDataFrame([([1, 2],), ([1, 3],)], "codes array<int>")
    sign = lambda df: records.fingerprint(df.select(F.col("codes").cast("string").alias("c")), ["c"]).first().digest
    build = lambda: search.distinct_keys(index)
    first, new = files.kept_index(spark, str(tmp_path / "ix"), sign(index), build)
    again, newer = files.kept_index(spark, str(tmp_path / "ix"), sign(index), build)
    assert new and not newer and again.count() == first.count() == 2 and json.loads((tmp_path / "ix" / "manifest.json").read_text())["rows"] == 2
    assert sign(index.limit(1)) != sign(index) and files.kept_index(spark, str(tmp_path / "ix"), "other", build)[1]


def test_text_columns(spark):
    df = spark.createDataFrame([("q1", ["a", "b", "c"])], "k string, p array<string>")
    i = int.from_bytes(hashlib.blake2b(b"q1", digest_size=8).digest(), "little") % 3
    assert df.select(x.chosen_prompt(F.col("p"), F.col("k"))).first()[0] == "abc"[i]
    t = spark.createDataFrame([('["a", "b", "c"]',), ('"one"',), ("null",), ("{",)], "j string").select(x.caption_list(F.try_parse_json("j"), 2)).collect()
    assert [r[0] for r in t] == [["a", "b"], ["one"], [], []]
    svg = spark.createDataFrame([('<?xml version="1.0"?><!DOCTYPE svg [<!ENTITY a "b">]><svg><!-- c --><g/></svg>',)], "s string")
    assert svg.select(x.sanitized_svg(F.col("s"))).first()[0] == "<svg><g/></svg>"
    conf = {"a": {"b": 1, "c": {"d": 2}}, "e": 3}
    assert x.flattened(conf) == {"a.b": 1, "a.c.d": 2, "e": 3} and x.configured(conf, "a.c.d") == 2 and x.configured(conf, "a.x", 9) == 9
    s = spark.createDataFrame([("\u00a0\t\"hi\" \n",)], "s string")
    assert s.select(records.sentence_form(F.col("s"))).first()[0] == "Hi."
    with pytest.raises(Exception, match="codes outside"):
        spark.createDataFrame([([99],)], "c array<int>").select(keys.codes_to_tokens(F.col("c"), [3], 16)).collect()
    with pytest.raises(Exception, match="missing"):
        records.looked_up(spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([("b", 1)], "k string, v int"), "k", strict=True).collect()


def p_of_three_degrees(rho):
    """Student's t with three degrees of freedom in closed form."""
    a = np.arctan(rho / np.sqrt(1 - rho**2))
    return 1 - 2 / np.pi * (a + np.sin(a) * np.cos(a))


def test_reports(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip([1, 2, 2, 3, 5], [1, 3, 2, 2, 9])] + [(float("nan"), 1.0)], "a double, b double")
    got = reports.spearman(df, "a", "b").first()
    ra, rb = [1, 2.5, 2.5, 4, 5], [1, 4, 2.5, 2.5, 5]
    assert got.n == 5 and got.rho == pytest.approx(np.corrcoef(ra, rb)[0, 1]) and got.p == pytest.approx(p_of_three_degrees(got.rho))
    rng = np.random.default_rng(0)
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(0.5, 1, 400))], "k long, d double")
    got = reports.bootstrap(d, "k", "d").first()
    assert got.n == 400 and abs(got.low - (got.mean - 1.96 / 20)) < 0.03 and abs(got.high - (got.mean + 1.96 / 20)) < 0.03 and got.p_two_sided == 0
    assert reports.bootstrap(d.limit(0), "k", "d").first().n == 0
    top = spark.createDataFrame([(1, o, t, s) for o, t, s in [(0, 1, 0.9), (1, 1, 0.8), (0, 2, 0.5), (1, 3, 0.45)]], "qid long, owner int, token int, score double")
    assert [(r.owner, r.token) for r in keys.diverse_top(top, 3, 0.5).orderBy("rank").collect()] == [(0, 1), (0, 2), (1, 3)]
