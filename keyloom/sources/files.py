"""Reading and writing the file formats of records, judgements, runs, instructions and arrays."""

from __future__ import annotations

import io
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERY_SCHEMA = "qid string, query_txt string, query_img_path string, query_modality string, query_src_content string, pos_cand_list array<string>, neg_cand_list array<string>"
CANDIDATE_SCHEMA = "did string, txt string, img_path string, modality string, src_content string"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return any(True for _ in fs.globStatus(p) or []) if "*" in path else fs.exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str, check: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped. A name of another kind, or a file that isn't there, is an error."""
    if check and not path.rstrip("/*").endswith((".jsonl", ".json", ".jsonl.gz")) and "*" not in path:
        raise ValueError(f"not a JSON lines file: {path}")
    if check and not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(schema).json(path)


def read_entries(spark: SparkSession, path: str, schema: str) -> tuple[int, DataFrame]:
    """(count, rows) of a .jsonl file, or of a .json file that holds one list."""
    if not path.endswith((".json", ".jsonl")):
        raise ValueError(f"neither .json nor .jsonl: {path}")
    df = spark.read.schema(schema).option("multiLine", path.endswith(".json")).json(path)
    return df.count(), df


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and line: an order of files, of places in a file, then of lines."""
    meta = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return spark.read.text(path).select("value", meta.alias("line"))


def read_qrels(spark: SparkSession, path: str, order: bool = False) -> DataFrame:
    """qid, iter, did, relevance, task_id of whitespace separated lines; only relevance over 0. order adds line, by which lines sort."""
    p = F.split(F.trim("value"), r"\s+")
    df = (_lines(spark, path) if order else spark.read.text(path)).where(F.size(p) >= 4)
    return df.select(*(["line"] if order else []), p[0].alias("qid"), p[1].alias("iter"), p[2].alias("did"), p[3].try_cast("int").alias("relevance"), F.get(p, F.lit(4)).alias("task_id")).where("relevance > 0")


def judgement_lists(qrels: DataFrame) -> DataFrame:
    """qid, dids (in the order of lines, repeats kept), task_id (of the first line), of read_qrels with order."""
    dids = F.transform(F.array_sort(F.collect_list(F.struct("line", "did"))), lambda s: s["did"])
    return qrels.groupBy("qid").agg(dids.alias("dids"), F.min_by("task_id", "line").alias("task_id"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """qid, did, rank, score, run_id, task_id (null in lines of six fields)."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(p) >= 6).select(
        p[0].alias("qid"), p[2].alias("did"), p[3].try_cast("int").alias("rank"), p[4].try_cast("double").alias("score"), p[5].alias("run_id"), F.get(p, F.lit(6)).alias("task_id")
    )


def write_run(ranked: DataFrame, path: str, run_id: str) -> None:
    """Lines of qid Q0 did rank 1.0 run_id task_id."""
    line = F.concat_ws(" ", "qid", F.lit("Q0"), F.col("did").cast("string"), F.col("rank").cast("string"), F.lit("1.0"), F.lit(run_id), "task_id")
    ranked.select(line.alias("value")).write.mode("overwrite").text(path)


def read_instructions(spark: SparkSession, path: str) -> DataFrame:
    """dataset_id, query_modality, cand_modality, prompts: the non-empty fields from the fifth on."""
    df = spark.read.csv(path, sep="\t", header=True)
    c = [F.col(f"`{x}`") for x in df.columns]
    prompts = F.filter(F.array(*c[4:]), lambda x: x.isNotNull() & (x != ""))
    return df.select(c[3].alias("dataset_id"), c[0].alias("query_modality"), c[1].alias("cand_modality"), prompts.alias("prompts"))


def _npy_head(raw: bytes) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, where the data begin) of an array file's first bytes."""
    f = io.BytesIO(raw)
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran or kind.hasobject:
        raise ValueError("arrays in column order or of objects aren't read")
    return shape, kind, f.tell()


def read_npy(spark: SparkSession, path: str, rows: int = 65_536) -> DataFrame:
    """path, row, v of one- or two-dimensional .npy arrays. The driver reads the headers; tasks read ranges of rows, so a file may be larger than a task."""
    p, fs = _hadoop(spark, path)
    parts = []
    for st in fs.globStatus(p) or []:
        for f in [st] if st.isFile() else fs.listStatus(st.getPath()):
            name = f.getPath().toString()
            if not name.endswith(".npy"):
                continue
            stream = fs.open(f.getPath())
            head = bytes(b & 255 for b in stream.readNBytes(4096))
            stream.close()
            shape, kind, begin = _npy_head(head)
            width = shape[1] if len(shape) > 1 else 1
            parts += [(name, i, min(rows, shape[0] - i), width, kind.str, begin + i * width * kind.itemsize) for i in range(0, shape[0], rows)]
    schema = "path string, first bigint, n bigint, width bigint, kind string, at bigint"
    ranges = spark.createDataFrame(parts, schema).repartition(max(1, min(len(parts), 4096)), "path", "first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, first, n, width, kind, at in b.itertuples(index=False):
                with _opened(name) as f:
                    f.seek(at)
                    x = np.frombuffer(f.read(int(n * width * np.dtype(kind).itemsize)), kind).reshape(n, width).astype(np.float32)
                for i in range(0, n, 8192):
                    yield pd.DataFrame({"path": name, "row": np.arange(first + i, first + min(n, i + 8192)), "v": list(x[i : i + 8192])})

    return ranges.mapInPandas(run, "path string, row bigint, v array<float>")


def _opened(name: str):
    """A file in a task: local, or of whatever file system pyarrow knows."""
    if name.startswith("file:") or name.startswith("/"):
        return open(re.sub("^file:/*", "/", name), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(name)
    return system.open_input_file(inner)


def write_npy(df: DataFrame, path: str, order: list[str], v: str = "v", rows: int = 1_000_000) -> None:
    """part-N.npy files of the vectors in the given order, about `rows` each, and part-N.ids.npy with the first order column; each is written under another
    name and then renamed, so a lost task leaves no half file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        all_rows = pd.concat(got)
        part = int(all_rows["_part"].iloc[0])
        for name, x in ((f"part-{part:05d}.npy", np.stack(all_rows["_v"].to_numpy()).astype(np.float32)), (f"part-{part:05d}.ids.npy", all_rows["_id"].to_numpy())):
            write_atomic(f"{path}/{name}", _npy_bytes(x))
        yield pd.DataFrame({"part": [part], "n": [len(all_rows)]})

    n = max(1, -(-df.count() // rows))
    parts = df.select(F.col(order[0]).alias("_id"), F.col(v).alias("_v"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    keys = [f"_o{i}" for i in range(len(order))]
    parts.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("_id", "_v", F.spark_partition_id().alias("_part")).mapInPandas(run, "part int, n bigint").collect()  # one row a file


def _npy_bytes(x: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.save(f, x, allow_pickle=False)
    return f.getvalue()


def write_atomic(path: str, data: bytes) -> None:
    """The whole file or none: written beside its place, flushed, then renamed."""
    local = re.sub("^file:/*", "/", path)
    os.makedirs(os.path.dirname(local), exist_ok=True)
    tmp = f"{local}.{uuid.uuid4().hex}.tmp"
    with open(tmp, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, local)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """path, row, query_id, live_prefixes, exposed_leaves, frontier_prefixes, latency_ms of .npz profiles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                z = np.load(io.BytesIO(raw), allow_pickle=False)
                n = len(z["query_id"])
                yield pd.DataFrame({
                    "path": name, "row": np.arange(n), "query_id": z["query_id"].astype(np.int64), "live_prefixes": z["live_prefixes"].astype(np.int64), "exposed_leaves": z["exposed_leaves"].astype(np.int64),
                    "frontier_prefixes": [[[int(t) for t in p] for p in q] for q in z["frontier_prefixes"]], "latency_ms": z["latency_ms"].astype(np.float64),
                })

    return _archives(spark, path).mapInPandas(run, "path string, row bigint, query_id bigint, live_prefixes bigint, exposed_leaves bigint, frontier_prefixes array<array<int>>, latency_ms double")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """id, img, txt, has_img, has_txt of .npz feature files with ids, img, text, img_mask and text_mask; of an id that comes again the first row of the first file counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                z = np.load(io.BytesIO(raw), allow_pickle=False)
                yield pd.DataFrame({"path": name, "row": np.arange(len(z["ids"])), "id": z["ids"].astype(np.int64), "img": list(z["img"].astype(np.float32)), "txt": list(z["text"].astype(np.float32)), "has_img": z["img_mask"].astype(bool), "has_txt": z["text_mask"].astype(bool)})

    rows = _archives(spark, path).mapInPandas(run, "path string, row bigint, id bigint, img array<float>, txt array<float>, has_img boolean, has_txt boolean")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("path", "row"))).where("_n = 1").drop("_n", "path", "row")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A .csv or .tsv file with a header; texts where no schema is given."""
    reader = spark.read.option("header", True).option("sep", "\t" if path.rstrip("/*").endswith(".tsv") else ",")
    return (reader.schema(schema) if schema else reader).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    """One tab-separated file with a header: for reports."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """img_path, score, txt of tab-separated lines; lines of fewer than three fields are left out, further tabs belong to the text."""
    p = F.split("value", "\t", 3)
    return spark.read.text(path).where(F.size(p) == 3).select(p[0].alias("img_path"), p[1].try_cast("double").alias("score"), p[2].alias("txt"))


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """id, ref_path, left_path, right_path, left_vote, right_vote, and chosen: the path with the vote."""
    v = read_table(spark, path).withColumns({c: F.col(c).try_cast("int") for c in ("left_vote", "right_vote")})
    return v.withColumn("chosen", F.when(F.col("left_vote") == 1, F.col("left_path")).when(F.col("right_vote") == 1, F.col("right_path")))


def read_log(spark: SparkSession, path: str, task: str, values: dict[str, str]) -> DataFrame:
    """file, task, name, value: what patterns (one group each) find in a log's lines, with the task that a line of the pattern `task` named last before them.

    Lines before any task have a null task. Each file is one sequence.
    """
    w = Window.partitionBy("line.f").orderBy("line.b", "line.i").rowsBetween(Window.unboundedPreceding, 0)
    hit = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    rows = _lines(spark, path).withColumn("task", F.last(hit(task), ignorenulls=True).over(w))
    found = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), hit(p).try_cast("double").alias("value")) for n, p in values.items())), lambda s: s["value"].isNotNull())
    return rows.select(F.col("line.f").alias("file"), "task", F.explode(found).alias("x")).select("file", "task", "x.name", "x.value")


def last_match(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """file, value: the last number in each file that the pattern's group finds."""
    rows = _lines(spark, path).withColumn("v", F.try_element_at(F.regexp_extract_all("value", F.lit(pattern), 1), F.lit(-1)).try_cast("double")).where("v is not null")
    return rows.groupBy(F.col("line.f").alias("file")).agg(F.max_by("v", F.struct("line.b", "line.i")).alias("value"))


def found_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, size of the files below a folder whose names match."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return df.select("path", F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("length").alias("size"))


def resolved(spark: SparkSession, folder: str, path: str) -> str:
    """The path if it is there, else the first file of its name below the folder; an error where there is none."""
    if exists(spark, path):
        return path
    hit = found_files(spark, folder, os.path.basename(path)).orderBy("path").first()
    if hit is None:
        raise FileNotFoundError(path)
    return hit["path"]


def marked_files(spark: SparkSession, folder: str, markers: list[str], most: int) -> DataFrame:
    """path, marker (null: the file is over `most` bytes): files that hold a forbidden text, or are too large, which aren't opened."""
    large = found_files(spark, folder).where(F.col("size") > most).select("path", F.lit(None).cast("string").alias("marker"))
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("length") <= most)
    hits = df.select("path", F.explode(F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(F.col("content"), F.encode(m, "utf-8")))).alias("marker"))
    return large.unionByName(hits)


def checked_layout(spark: SparkSession, folder: str, required: list[str], equal: dict[str, list] | None = None) -> list[str]:
    """What a data folder lacks: required paths that aren't there, and lists that should be as long as each other."""
    out = [f"missing {p}" for p in required if not exists(spark, f"{folder}/{p}")]
    sizes = {k: len(v) for k, v in (equal or {}).items()}
    return out + ([f"lengths differ: {sizes}"] if len(set(sizes.values())) > 1 else [])


def image_bytes(spark: SparkSession, path: str) -> DataFrame:
    """id, content of tab-separated lines of an id and a Base64 image; content is null where that is broken."""
    p = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.size(p) == 2).select(p[0].alias("id"), F.try_to_binary(p[1], F.lit("base64")).alias("content"))


def valid_image(content: Column) -> Column:
    """Whether the bytes begin as a JPEG, PNG, GIF or WebP does, and a JPEG or PNG also ends as one; pixels aren't decoded."""
    h, tail = F.hex(F.substring(content, 1, 12)), F.hex(F.substring(content, -8, 8))
    jpeg = h.startswith("FFD8FF") & tail.endswith("FFD9")
    png = h.startswith("89504E470D0A1A0A") & (tail == "49454E44AE426082")
    return F.coalesce(jpeg | png | h.startswith("474946383") | h.rlike("^52494646.{8}57454250"), F.lit(False))


def kept_index(spark: SparkSession, folder: str, signature: str, build: Callable[[], DataFrame], version: int = 1) -> tuple[DataFrame, bool]:
    """(index, whether it was built now): the table kept in the folder if its manifest has this signature and version, else a new one.

    The table is written under its signature first and the manifest renamed into place last, so a reader sees a whole index or the one before.
    """
    local = re.sub("^file:/*", "/", folder)
    manifest = f"{local}/manifest.json"
    where = f"{folder}/{signature[:32]}-{version}"
    if os.path.exists(manifest):
        with open(manifest) as f:
            m = json.load(f)
        if m["signature"] == signature and m["version"] == version and exists(spark, f"{where}/_SUCCESS"):
            return spark.read.parquet(where), False
    build().write.mode("overwrite").parquet(where)
    write_atomic(manifest, json.dumps({"signature": signature, "version": version, "rows": spark.read.parquet(where).count()}).encode())
    return spark.read.parquet(where), True
