"""Queries against their SQL on tables that the small ones do not stand for: numbers of seven digits, sums that meet a limit exactly."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import pyarrow as pa

from tidemark.operators import compaction
from tidemark.plans import catalog_ops
from tidemark.sources import wal


def same_as_sql(spark, folder, name, **tables):
    """The query's rows on `tables` (DuckDB SELECTs), which are those of its SQL."""
    c = duckdb.connect()
    for t, select in tables.items():
        c.execute(f"COPY ({select}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalog_ops.all_queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(columns).collect())
    assert got == Counter(c.execute(f"SELECT {', '.join(columns)} FROM ({catalog_ops.all_sql()[name]})").fetchall())
    return got


def test_current_manifest_of_seven_digits(spark, tmp_path):
    got = same_as_sql(spark, tmp_path, "manifest_current", part="SELECT i AS p_partkey FROM range(999_000, 1_000_200) t(i)")
    assert got == {("MANIFEST-100019",): 1}


def test_orphans_of_seven_digits(spark, tmp_path):
    orders = "SELECT i * 3 AS o_orderkey, CASE WHEN i < 50 THEN 100_000 + i ELSE 1_000_000 + i END AS o_custkey FROM range(100) t(i)"
    got = same_as_sql(spark, tmp_path, "orphan_files", part="SELECT i AS p_partkey FROM range(999_900, 1_000_300) t(i)", orders=orders)
    # 1000000.sst is no file of the manifest, though 100000.sst is one.
    assert got["table", "100000.sst"] == 5


def test_memtables_whose_bytes_meet_the_limit_exactly(spark):
    rng = random.Random(5)
    rows, want = [], Counter()
    for log in range(30):
        sizes = [rng.randrange(20, 60) for _ in range(500)]
        left = 60_000 - sum(104 + n for n in sizes[:360]) - 360 * 32 // 3
        sizes[360:363] = [20, 20, left - 3 * 104 - 32 - 40]  # 363 rows are 60,000 bytes
        used = 0
        for seq, n in enumerate(sizes):
            rows.append((log, seq, b"k" * 8, b"v" * n))
            want[log, used // 60_000] += 1
            used += 3 * (104 + n) + 32
    df = spark.createDataFrame(rows, "log long, seq long, key binary, value binary")
    got = {(r["log"], r["memtable"]): r["rows"] for r in compaction.frozen_after(df, 20_000).collect()}
    assert got == want


def test_a_worker_holds_one_batch_of_segments_and_few_records():
    content = b"".join(wal.encode(1, i, 5, b"k%d" % i, b"v" * 1_000) for i in range(2_500))
    most = [0]

    def batches():
        for n in range(4):
            most[0] = max(most[0], pa.total_allocated_bytes() - before)
            yield pa.RecordBatch.from_pydict({"segment": pa.array([2 * n, 2 * n + 1]), "content": pa.array([content, content], pa.binary())})

    before, seen = pa.total_allocated_bytes(), []
    for out in wal.record_batches(batches()):
        assert out.num_rows <= 1_000
        seen += zip(out["segment"].to_pylist(), out["pos"].to_pylist(), out["seq"].to_pylist(), out["status"].to_pylist(), strict=True)
        del out
    assert seen == [(s, i, i, "ok") for s in range(8) for i in range(2_500)]
    assert most[0] < len(content)
