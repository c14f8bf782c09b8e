import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from keyloom.llm import encoding, languages, leaks, neighbours, overlap, pieces, splits

ENTRY = "row_id long, query_txt string, query_img_path string, query_src_content string, query_file string, cid string"
TR, TE = "query/train/mbeir_oven_train.jsonl", "query/test/mbeir_oven_test.jsonl"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_overlap_agrees_with_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    texts = [[rng.choice(vocab) for _ in range(rng.choice([1, 3, 6, 12, 24, 40, 60]))] for _ in range(60)]
    rows = []
    for i in range(400):
        t = list(rng.choice(texts))
        for _ in range(rng.randint(0, len(t) // 4)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [t[k], rng.choice(vocab)]])
        img = rng.choice([None, "", "a/x.jpg", "b\\X.PNG"])
        rows.append((i, rng.choice([" ".join(t).upper(), ",  ".join(t), None if i % 9 == 0 else " ".join(t)]), img, None, rng.choice([TR, TE]), "clash"))
    rows += [(900, None, None, None, TR, ""), (901, "", "", None, TE, ""), (902, "...", None, None, TE, ""), (903, "w1", None, None, None, "")]
    df = spark.createDataFrame(rows, ENTRY)
    key = lambda x: (bool(x[2]), overlap.words(x[1]))
    want = set()
    for a in rows:
        for b in rows:
            if a[4] == TR and b[4] == TE and key(a) != (False, []) and key(a)[0] == key(b)[0]:
                x, y = key(a)[1], key(b)[1]
                if bool(x) == bool(y) and edits(x, y) <= 0.2 * max(len(x), len(y)) and key(b) != (False, []):
                    want.add((min(a[0], b[0]), max(a[0], b[0])))
    old, overlap.LARGE = overlap.LARGE, 20
    try:
        for rare in (2000, 1):
            overlap.RARE, was = rare, overlap.RARE
            got_rows, pairs = overlap.overlaps(df)
            overlap.RARE = was
            got = [tuple(x) for x in overlap.row_pairs(got_rows, pairs).collect()]
            assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
        assert overlap.report(got_rows, pairs).agg(F.sum("pairs")).first()[0] == len(want)
        assert overlap.links_per_row(got_rows, pairs).agg(F.sum("links")).first()[0] == 2 * len(want)
    finally:
        overlap.LARGE = old
    empty = overlap.overlaps(df.limit(0))
    assert overlap.row_pairs(*empty).count() == 0


def test_overlap_of_templates(spark, monkeypatch):
    """Texts without an image of one template, with more free words than the limit's edits, and longer ones: all near pairs of a sample, and no list of all texts."""
    monkeypatch.setattr(overlap, "RARE", 40)
    rng = random.Random(9)
    noun = [f"noun{i}" for i in range(12)] + [f"odd{i}" for i in range(2500)]
    pick = lambda: rng.choice(noun[:12] if rng.random() < 0.5 else noun)
    make = lambda: f"what is the {pick()} color of the {pick()} that stands next to the {pick()} behind {pick()}".split()
    tail = "it was said by many that the old road to the town had been closed for a long time when they came".split()
    texts = [make() + (tail if i % 4 == 0 else []) for i in range(3000)]
    for i in range(0, 3000, 3):
        t = list(texts[rng.randrange(i + 1)])
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = pick()
        texts[i] = t
    rows = [(i, " ".join(t), None, None, TR if i % 2 else TE, "") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ENTRY)
    got_rows, pairs = overlap.overlaps(df)
    got = {(r.row_id_a, r.row_id_b) for r in overlap.row_pairs(got_rows, pairs).collect()}
    sample = rng.sample(range(0, 3000, 2), 12)
    held = set(sample)
    want = {(min(a, b), max(a, b)) for a in sample for b in range(1, 3000, 2) if abs(len(texts[a]) - len(texts[b])) <= 8 and overlap._near(" ".join(texts[a]), " ".join(texts[b]), 0.2) >= 0}
    assert {(a, b) for a, b in got if a in held or b in held} == want and len(want) > 10
    counts = overlap._counts(got_rows)
    classes = got_rows.groupBy("cid").agg(F.first("img").alias("img"), F.first("norm").alias("norm"), F.lit(True).alias("train"), F.lit(True).alias("evals"), F.first("large").alias("large"))
    lists = overlap._vectors(classes, counts).select(F.explode(F.array_distinct("keys")).alias("k")).groupBy("k").count()
    assert lists.agg(F.max("count")).first()[0] < 750


def test_splits(spark):
    src = lambda e, s: f'{{"entity_id": "{e}", "data_split": {s}}}'
    rows = [(i, None, None, src(f"Q{i % 50 + 10}", '"train"'), TR, "") for i in range(1000)]
    rows += [(2000, None, None, src("wd:q1", '"Valid"'), TR, ""), (2001, None, None, src(" Q3", '"testing"'), TR, ""), (2002, None, None, src("Q3", "null")[:-1], TR, ""), (2003, None, None, None, TR, "")]
    rows += [(2004, None, None, src("Q7", '"train"'), TR, ""), (2005, None, None, src("Q8", '"dev"'), TR, "")]
    df = spark.createDataFrame(rows, ENTRY)
    alias = spark.createDataFrame([("Q1", "Q2", None), ("q2", "wd:Q3", None), ("Q3", "Q4", None), ("Q7", "Q8", None), ("Q8", "Q7", None), (None, "Q1", None), ("Q9", "Q9", None)], "alias_id string, entity_id string, merged_at timestamp")
    assert {x[0] for x in splits.torn_entities(df, alias).collect()} == {"Q4", "Q7"}
    got = splits.row_splits(df, alias).toPandas()
    assert got.groupby("entity_id").new_split.nunique().max() == 1 and len(got) == 1004
    share = got.new_split.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["val"] - 0.1) < 0.03
    assert splits.row_splits(df.limit(0), alias.limit(0)).count() == 0
    w = [5, 5, 4, 3, 3, 2, 2]
    bins = splits.largest_differencing(w, 3)
    assert max(sum(x for x, b in zip(w, bins) if b == k) for k in range(3)) <= 9 and splits.largest_differencing([], 3) == []


def test_pieces(spark):
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["word", " ", " ", ". ", "\n\n", "é", "漢字。", "x" * rng.choice([1, 400])]) for _ in range(rng.randint(1, 400))).strip()
        out = pieces.cuts(text)
        if not text:
            assert out == []
            continue
        assert out[0][0] == 0 and out[-1][1] == len(text) and all(0 < e - s <= 1000 for s, e in out)
        assert all(0 <= a[1] - b[0] <= 100 and b[0] > a[0] and b[1] > a[1] for a, b in zip(out, out[1:]))
    df = spark.createDataFrame([(1, "a " * 600, None), (2, None, '"{\\"article_text\\": \\"' + "b " * 700 + '\\"}"'), (3, " " * 2000, "{" + "x" * 2000), (4, "c" * 1000, None)], "row_id long, txt string, src_content string")
    got = pieces.candidate_pieces(df).where("piece_no = 1").collect()
    assert {(x.row_id, x.field_name) for x in got} == {(1, "txt"), (2, "src_content")}
    sentence = "This is a sentence of the text. "
    assert all((sentence * 60)[:e].rstrip().endswith(".") for _, e in pieces.cuts(sentence * 60)[:-1])


def recall(x, got, rows):
    """Share of the exact ten most similar of these rows that were found."""
    u = x.astype(np.float32)
    u /= np.linalg.norm(u, axis=1)[:, None]
    hits = []
    for i in rows:
        s = u @ u[i]
        s[i] = -2
        kth = np.partition(s, -10)[-10]
        hits += [s[g] >= kth - 1e-5 for g, _ in got[i]]
        assert len(got[i]) == 10 and all(g != i and abs(c - s[g]) < 1e-4 for g, c in got[i])
    return np.mean(hits)


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.8 * rng.normal(size=(3000, 16))
    x[100:115] = x[100]
    x[200:203] = x[200]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, []), (9005, [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    run = lambda: {r.vec_id: [(f["id"], f["cosine"]) for f in r.found] for r in neighbours.neighbours(df).collect()}
    got = run()
    assert set(got) == set(range(3000)) and recall(x, got, range(3000)) > 0.95
    # cut regions, and cells whose queries are spread over several tasks
    monkeypatch.setattr(neighbours, "REGION_LEAST", 200)
    monkeypatch.setattr(neighbours, "CELL_MOST", 150)
    monkeypatch.setattr(neighbours, "QUERIES_MOST", 90)
    got = run()
    assert set(got) == set(range(3000)) and recall(x, got, range(3000)) > 0.95
    assert neighbours.neighbours(df.limit(0)).count() == 0 and neighbours.neighbours(df.limit(1)).count() == 0


def test_neighbours_default_parameters(spark):
    """Over 50,000 vectors, unevenly spread, with outliers; several regions, so routing, probing and short lists all count."""
    rng = np.random.default_rng(1)
    n, centres = 60_000, rng.normal(size=(40, 64))
    size = rng.integers(0, 40, n)
    size[: n // 3] = 0
    x = (0.7 * centres[size] + rng.normal(size=(n, 64))).astype(np.float32)
    x[::50] = rng.normal(size=(n // 50, 64))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x))}))
    got = {r.vec_id: [(f["id"], f["cosine"]) for f in r.found] for r in neighbours.neighbours(df).where("vec_id % 117 = 0").collect()}
    assert recall(x, got, range(0, n, 117)) >= 0.95


def test_encoding(spark):
    ids = encoding.vocabulary(f"{encoding.DIR}/{encoding.VOCABULARY}")
    table = encoding.PerfectHash(ids)
    assert all(table.get(k) == v for k, v in ids.items()) and table.get(b"no such token") is None
    tiktoken = pytest.importorskip("tiktoken")
    ref = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ids, special_tokens={})
    rng = random.Random(0)
    texts = ["".join(rng.choice(["a", "the ", " ", "  ", "\n", "é", "漢", "🙂", "'s", "1", "<|endoftext|>", " ", "Zqx"]) for _ in range(rng.randint(0, 80))) for _ in range(500)] + ["x" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encoding.encoded(df).collect()}
    assert got[-1] == [] and all(got[i] == ref.encode_ordinary(t) for i, t in enumerate(texts))
    assert regex.findall(encoding.PATTERN, "we're 12") == ["we", "'re", " 12"]


def test_leaks(spark):
    rng = random.Random(5)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    items = [[rng.choice(vocab) for _ in range(n)] for n in (30, 40, 60, 4)]
    docs, want = [], set()
    for i in range(60):
        k, share = rng.randrange(3), rng.choice([0.2, 0.3, 0.7, 1.0])
        part = items[k][: round(len(items[k]) * share)]
        if i % 2:
            part = [("zzz" if j % 11 == 10 else w) for j, w in enumerate(part)]
        noise = [rng.choice(vocab) + "q" for _ in range(40)]
        docs.append((i, " ".join(noise) + "\n> <b>" + "  ".join(w.upper() for w in part) + "</b>, " + unicodedata.normalize("NFD", "é ") + " ".join(noise)))
        want |= {(i, k)} if share > 0.5 else set()
        want |= {(i, 9)} if share > 0.5 and k == 0 else set()
    docs += [(100, None), (101, ""), (102, "..."), (103, " ".join(items[3]))]
    want.add((103, 3))
    bench = spark.createDataFrame([(k, " ".join(w), "val") for k, w in enumerate(items)] + [(9, " ".join(items[0]).title(), "test"), (10, None, "val"), (11, "", "val")], "item_id long, text string, doc_id string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(x.doc_id, x.item_id) for x in leaks.leaked(df, bench).collect()} == want
    assert leaks.leaked(df.limit(0), bench).count() == 0 and leaks.leaked(df, bench.limit(0)).count() == 0


def test_leaked_stretches_are_whole_and_removed(spark):
    item = [f"word{i}" for i in range(100)]
    part = item[:99]
    part[40] = "other"
    short = "kilo lima mike november oscar papa quebec romeo sierra tango".split()
    texts = {
        1: "Before it, all five <b>words</b> come. " + " ".join(part).upper() + ". After &amp; all.",
        2: "x " + " ".join(short) + " between\n\n" + ", ".join(short[:6]) + " y",
        3: "caf\u00e9 " + " ".join(item[10:75]),
        4: None, 5: "", 6: "nothing here",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.stretch_no): r for r in leaks.leaked(df, bench).collect()}
    assert set(got) == {(1, 1, 0), (2, 2, 0), (2, 2, 1), (3, 1, 0)}
    one = got[1, 1, 0]
    assert (one.first_word, one.end_word, one.coverage) == (6, 105, 0.98)
    assert texts[1][one.first_char : one.end_char] == " ".join(part).upper()
    assert texts[2][got[2, 2, 1].first_char : got[2, 2, 1].end_char] == ", ".join(short[:6])
    assert texts[3][got[3, 1, 0].first_char :] == " ".join(item[10:75]) and got[3, 1, 0].coverage == 0.65
    clean = {r.doc_id: (r.text, r.removed) for r in leaks.cleaned(df, bench).collect()}
    assert clean[1][0] == "Before it, all five <b>words</b> come. . After &amp; all." and clean[2][0] == "x between\n\n y" and clean[3][0] == "caf\u00e9"
    assert clean[4] == (None, 0) and clean[5] == ("", 0) and clean[6] == ("nothing here", 0)
    assert leaks.leaked(leaks.cleaned(df, bench), bench).count() == 0
    old, leaks.MAX_CHARS = leaks.MAX_CHARS, 10
    try:
        with pytest.raises(ValueError):
            leaks.leaked(df, bench)
    finally:
        leaks.MAX_CHARS = old


def exact_stretch(doc, item):
    """Most words of the item that any stretch of doc gives in order with an edit in eight words, by a full table."""
    best = 0
    for a in range(len(doc)):
        row = {j: {0: 0} for j in range(len(item) + 1)}  # at a word of the item, from where the stretch may begin: edits -> most words found
        for z in range(a, len(doc)):
            new = {}
            for j in range(len(item) + 1):
                to = {}
                def put(e, f):
                    to[e] = max(to.get(e, -1), f)
                for e, f in row[j].items():
                    put(e + 1, f)
                if j:
                    for e, f in row[j - 1].items():
                        same = item[j - 1] == doc[z]
                        put(e + (not same), f + same)
                    for e, f in new[j - 1].items():
                        put(e + 1, f)
                new[j] = {e: f for e, f in to.items() if e <= len(doc) * leaks.ERRORS + 1}
            row = new
            n = z - a + 1
            best = max([best, *(f for d in row.values() for e, f in d.items() if e <= n * leaks.ERRORS)])
    return best


def test_stretches_agree_with_full_alignment():
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(200)]
    hits = 0
    for _ in range(40):
        item = [rng.choice(vocab) for _ in range(rng.randint(8, 24))]
        a = rng.randint(0, 4)
        body = list(item[a : a + rng.randint(len(item) // 2, len(item))])
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(body))
            body[k : k + 1] = rng.choice([[], ["zz"], [body[k], "yy"]])
        doc = [rng.choice(vocab) + "q" for _ in range(5)] + body + ["end"] * 3
        most = exact_stretch(doc, item)
        got = leaks._finder([item], [[1]], leaks.SHARE)(" ".join(doc))
        assert bool(got) == (most >= leaks.SHARE * len(item)), (doc, item, most, got)
        if got:
            hits += 1
            assert max(g[2] for g in got) == pytest.approx(most / len(item))
    assert hits > 15


def test_languages(spark):
    words = {"en": "the house stands on a green hill near old water", "de": "das haus steht auf einem hügel neben dem alten wasser", "fr": "la maison se trouve sur une colline verte près de", "zh": "这座房子在绿色的小山上靠近水边非常漂亮"}
    rng = random.Random(2)

    def sentence(k):
        if k == "zh":
            return "".join(rng.choice(words[k]) for _ in range(18)) + "。"
        return " ".join(rng.choice(words[k].split()) for _ in range(10)).capitalize() + ". "

    rows = [(i, "".join(sentence(k) for _ in range(5)), lab) for i, (k, lab) in enumerate((k, lab) for k in words for lab in [k, k.upper(), f"{k}-XX", k] * 6)]
    mixed = "".join(sentence("en") for _ in range(4)) + "".join(sentence("de") for _ in range(3))
    rows += [(500, mixed, "English"), (501, rows[0][1], "ger"), (502, None, "en"), (503, "", None), (504, "### 12 / 3", "en"), (505, rows[-1][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    segs = languages.segments(df).cache()
    assert {(x.doc_id, x.seg_lang) for x in languages.mislabelled(df, segs).collect()} == {(500, "de"), (501, "en"), (505, "zh")}
    by = {r.doc_id: r for r in languages.document_languages(df, segs).collect()}
    assert by[500].lang == "en" and by[502].lang == "und" and by[504].lang == "und" and by[0].confidence > 0.5
    parts = segs.where("doc_id = 500").orderBy("seg_no").collect()
    assert len(parts) == 2 and parts[0].start_char == 0 and parts[1].end_char == len(mixed.rstrip()) or parts[1].end_char == len(mixed)
    assert languages.segments(df.limit(0)).count() == 0
