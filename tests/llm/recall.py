"""Recall of problem 4 against brute force, and how far a query looks: python tests/llm/recall.py N [clusters] [inner dimensions].

N unit vectors of 64 parts in that many natural clusters, isotropic within each over the given dimensions (64: the hardest case, as in the test tables).
Prints regions, cells asked by a vector (what the shuffle is in proportion to), seconds, and recall@10 of 300 vectors searched for among all.
"""

import os
import sys
import tempfile
import time

os.environ["OMP_NUM_THREADS"] = "1"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + ":" + os.environ.get("PYTHONPATH", "")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.parquet as pq  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from keyloom.llm import neighbours  # noqa: E402


def main(n: int, clusters: int = 32, inner: int = 64) -> None:
    with tempfile.TemporaryDirectory() as where:
        rng = np.random.default_rng(0)
        centre = rng.normal(size=(clusters, 64)).astype(np.float32)
        centre /= np.linalg.norm(centre, axis=1)[:, None]
        base = np.linalg.qr(rng.normal(size=(64, inner)))[0].astype(np.float32)
        x = 0.55 * centre[rng.integers(0, clusters, n)] + 0.835 / np.sqrt(inner) * rng.standard_normal((n, inner), np.float32) @ base.T
        for i in range(0, n, 250_000):
            part = x[i : i + 250_000]
            pq.write_table(pa.table({"vec_id": np.arange(i, i + len(part)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), 64).cast(pa.list_(pa.float32()))}), f"{where}/{i:09d}.parquet", row_group_size=25_000)
        spark = (
            SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "64")
            .config("spark.checkpoint.dir", f"{where}/shared").config("spark.sql.files.maxPartitionBytes", "16m").getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        made = neighbours._indexed

        def indexed(*a):
            ix = made(*a)
            some = neighbours._unit(x[:: max(1, n // 20_000)])
            print(f"n {n} regions {len(ix.centres)} tasks {len(ix.slot)} cells asked {ix.asked(some)[1].sum(axis=1).mean():.2f}", flush=True)
            return ix

        neighbours._indexed = indexed
        began = time.time()
        neighbours.neighbours(spark.read.parquet(f"{where}/*.parquet")).write.parquet(f"{where}/found")
        took = time.time() - began
        u, rows = neighbours._unit(x), rng.choice(n, 300, replace=False)
        got = {r.vec_id: [f["id"] for f in r.found] for r in spark.read.parquet(f"{where}/found").where(f"vec_id in ({','.join(map(str, rows))})").collect()}
        hits = []
        for i in rows:
            s = u @ u[i]
            s[i] = -2
            hits.append(np.mean(s[got[i]] >= np.partition(s, -10)[-10] - 1e-5))
        print(f"n {n} clusters {clusters} inner {inner}: {took:.0f} s, recall {np.mean(hits):.4f}, worst tenth {np.mean(np.sort(hits)[:30]):.3f}")
        spark.stop()


if __name__ == "__main__":
    main(*map(int, sys.argv[1:]))
