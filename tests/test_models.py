"""Randomised tests of the key-value operators against plain Python models."""

from __future__ import annotations

import random
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark import schema as S
from tidemark.functions import bloom, codec, histogram
from tidemark.operators import cache, flow, ingest, levels, manifest, merge, recovery, resolve
from tidemark.sources import wal

LOG = "key binary, seq long, op int, value binary"


def model(rows):
    best = {}
    for k, s, op, v in rows:
        if k not in best or (s, op) > best[k][:2]:
            best[k] = (s, op, v)
    return {k: v for k, (s, op, v) in best.items() if op == S.PUT}


def live(df):
    return {bytes(r["key"]): bytes(r["value"]) for r in resolve.live(df).collect()}


def test_tombstones_ties_and_empty_values(spark):
    rows = [(b"p1", 1, 1, b"v1"), (b"p3", 3, 1, b""), (b"gone", 4, 2, None), (b"dup", 1, 1, b"V1"), (b"dup", 100, 1, b"V2"), (b"shadow", 1, 1, b"x"), (b"shadow", 9, 2, None), (b"tie", 7, 1, b"x"), (b"tie", 7, 2, None)]
    df = spark.createDataFrame(rows, LOG)
    assert live(df) == {b"p1": b"v1", b"p3": b"", b"dup": b"V2"} == model(rows)
    assert resolve.exists(df, b"p3").first()[0] and not resolve.exists(df, b"tie").first()[0] and not resolve.exists(df, b"none").first()[0]
    assert resolve.get(df, b"gone").count() == 0


def test_random_operations_against_a_dictionary(spark):
    rng = random.Random(1337)
    rows, state = [], {}
    for i in range(4000):
        k = b"key_%05d" % (rng.randrange(300) * 7919 % 3000)
        if i % 10 < 6:
            rows.append((k, i + 1, 1, b"val_%d" % i))
            state[k] = b"val_%d" % i
        else:
            rows.append((k, i + 1, 2, None))
            state.pop(k, None)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, LOG)
    assert live(df) == state
    half = [r for r in rows if r[1] <= 2000]
    assert {bytes(r["key"]): bytes(r["value"]) for r in resolve.as_of(df, 2000).collect()} == model(half)


def test_merge_keeps_the_newest_and_is_idempotent(spark):
    rng = random.Random(42)
    rows = [(i % 5, b"k%d" % rng.randrange(18), rng.randrange(1, 60), 2 if rng.random() < 0.25 else 1) for i in range(400)]
    data = [(n, k, s, op, None if op == 2 else k + b"-%d-%d" % (s, n)) for n, k, s, op in rows]
    df = spark.createDataFrame(data, "input_idx int, key binary, seq long, op int, value binary")
    want = {}
    for n, k, s, op, v in data:
        if k not in want or (-s, -op, n) < want[k][0]:
            want[k] = ((-s, -op, n), v)
    got = merge.dedup_merge(df)
    assert {bytes(r["key"]): r["value"] and bytes(r["value"]) for r in got.collect()} == {k: v for k, (_, v) in want.items()}
    again = merge.dedup_merge(got)
    assert sorted(again.collect()) == sorted(got.select(*again.columns).collect())
    raw = [(bytes(r["key"]), -r["seq"], -r["op"], r["input_idx"]) for r in merge.raw_merge(df).collect()]
    assert raw == sorted(raw)


def test_tombstones_stay_only_where_deeper_levels_have_the_key(spark):
    up = spark.createDataFrame([(b"a", 9, 2, None), (b"b", 8, 2, None), (b"c", 7, 1, b"x")], LOG)
    deep = spark.createDataFrame([(b"a", 1, 1, b"old")], LOG)
    assert {bytes(r["key"]) for r in merge.drop_tombstones(up, deep).collect()} == {b"a", b"c"}
    assert {bytes(r["key"]) for r in merge.drop_tombstones(up, None).collect()} == {b"c"}


def test_exact_cuts_follow_the_sequential_rule(spark):
    rng = random.Random(3)
    rows = [(b"k_%04d" % i, i + 1, 1, bytes(rng.randrange(400))) for i in range(120)]
    got = merge.cut_exact(spark.createDataFrame(rows, LOG), 2048, partitions=1).orderBy("key").collect()
    size, number, want = 0, 0, []
    for k, _, _, v in rows:
        n = len(k) + 8 + len(v) + 16
        if size and (size >= 2048 or size + n > 2048):
            number, size = number + 1, 0
        size += n
        want.append(number)
    assert [r["file_no"] for r in got] == want
    assert wal.rotate([5, 5, 20, 1], 10) == [0, 0, 1, 2]


def test_store_pipeline_and_commands(spark):
    store = ingest.Store(spark)
    store.put(b"a", b"1")
    store.batch(ingest.WriteBatch().put(b"k", b"v1").put(b"k", b"v2").delete(b"k").put(b"k", b"v3").put(b"b", b""))
    store.delete(b"never")
    assert (store.get(b"k"), store.get(b"b"), store.get(b"never"), store.exists(b"a")) == (b"v3", b"", None, True)
    assert store.pipeline().get(b"a").put(b"a", b"2").get(b"a").exists(b"zz").execute() == [b"1", None, b"2", False]
    assert cli.execute(store, 'PUT x "a\\x00b"') == "OK" and cli.execute(store, "GET x") == '"a\\x00b"'
    assert cli.execute(store, "GET nothing") == "NOT FOUND" and cli.execute(store, "EXISTS 'x'") == "true"
    assert cli.execute(store, "PUT 'open").startswith("(error)") and cli.execute(store, "PUT a").startswith("(error)")
    assert cli.tokenize("a'b c'\"d\\n\" e") == [b"ab cd\n", b"e"]
    with pytest.raises(ValueError):
        store.put(b"", b"v")


def test_batches_count_only_when_committed(spark):
    R = "log int, seq long, type int, key binary, value binary"
    rows = [(0, 1, 3, None, None), (0, 2, 1, b"c", b"1"), (0, 3, 4, None, None), (0, 4, 3, None, None), (0, 5, 1, b"t", b"1"), (0, 6, 3, None, None), (0, 7, 1, b"u", b"1"), (0, 8, 4, None, None), (0, 9, 1, b"s", b"1"), (0, 10, 3, None, None), (0, 11, 1, b"z", b"1")]
    df = spark.createDataFrame(rows, R)
    assert {bytes(r["key"]) for r in recovery.replay(df).collect()} == {b"c", b"u", b"s"}
    assert [(r["seq"], r["problem"]) for r in recovery.marker_problems(df).collect()] == [(6, "nested start")]
    with pytest.raises(ValueError):
        recovery.replay(df, strict=True)


@pytest.mark.parametrize("cell", [1, 3, 8, 1 << 16])
def test_batches_are_followed_across_cells(spark, cell):
    rng = random.Random(cell)
    rows = [(log, seq, rng.choice([1, 1, 2, 3, 4]), b"%d" % n, b"v") for log in (0, 1, None) for n, seq in enumerate([None, None, *sorted(rng.choices(range(60), k=60)), (1 << 63) - 1])]
    want = []
    for log in (0, 1, None):
        own = sorted((r for r in rows if r[0] == log), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        at = lambda r: -1 if r[1] is None else r[1]
        for r in own:
            upto = [m[2] for m in own if m[2] in (3, 4) and at(m) <= at(r)]
            after = [m[2] for m in own if m[2] in (3, 4) and at(m) > at(r)]
            if r[2] in (1, 2) and (upto[-1:] != [3] or after[:1] == [4]):
                want.append(r[:3])
    df = spark.createDataFrame(rows, "log int, seq long, type int, key binary, value binary")
    got = [(r["log"], r["seq"], r["op"]) for r in recovery.committed(df, cell=cell).collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert 0 < len(want) < sum(r[2] < 3 for r in rows)


def test_segments_survive_a_round_trip_and_show_damage(spark, tmp_path):
    frames = b"".join(wal.encode(1, i, 5, b"k%d" % i, b"v" * i) for i in range(1, 6))
    (tmp_path / "wal_000000000001.log").write_bytes(frames)
    (tmp_path / "wal_000000000002.log").write_bytes(frames[:-3])
    bad = bytearray(frames)
    bad[29] ^= 1
    (tmp_path / "wal_000000000003.log").write_bytes(bytes(bad))
    rows = wal.read_segments(spark, str(tmp_path)).collect()
    by = {s: [r["status"] for r in rows if r["segment"] == s] for s in (1, 2, 3)}
    assert by == {1: ["ok"] * 5, 2: ["ok"] * 4 + ["torn"], 3: ["crc"]}
    assert [r["bytes"] for r in rows if r["segment"] == 1] == [27 + 2 + i for i in range(1, 6)]


def test_closure_matches_brute_force(spark):
    rng = random.Random(5)
    for _ in range(3):
        files = [(0, i, 1, b"%03d" % a, b"%03d" % (a + rng.randrange(1, 25))) for i, a in enumerate(rng.randrange(0, 400) for _ in range(25))]
        df = spark.createDataFrame(files, "level long, file_num long, file_size long, smallest_key binary, largest_key binary")
        seeds = [3, 7]
        inside = {f[1] for f in files if f[1] in seeds}
        while True:
            lo, hi = min(f[3] for f in files if f[1] in inside), max(f[4] for f in files if f[1] in inside)
            more = {f[1] for f in files if f[4] >= lo and f[3] <= hi}
            if more == inside:
                break
            inside = more
        assert {r["file_num"] for r in levels.closure(df, seeds).collect()} == inside


def test_manifest_edits(spark):
    adds = "array<struct<level:long,file_num:long,file_size:long>>"
    edits = spark.createDataFrame([(1, [(0, 1, 10), (0, 2, 10)], []), (2, [(1, 3, 20)], [(0, 1)]), (3, [], [(0, 9)])], f"edit_no long, adds {adds}, deletes array<struct<level:long,file_num:long>>")
    acts = manifest.actions(edits)
    assert {(r["level"], r["file_num"]) for r in manifest.replay(acts).collect()} == {(0, 2), (1, 3)}
    assert [(r["file_num"], r["problem"]) for r in manifest.problems(acts).collect()] == [(9, "delete of absent file")]


def test_histogram_matches_sorted_values(spark):
    rng = np.random.default_rng(0)
    values = [0, 1, 127, 128, 255, 256, (1 << 44) - 1, 1 << 44, -5, *rng.integers(0, 1 << 40, 500).tolist()]
    df = spark.createDataFrame([("a", int(v)) for v in values], "op string, ns long")
    h = histogram.histogram(df, ["op"])
    good = sorted(v for v in values if v >= 0)
    for r in histogram.percentiles(h, ["op"], (0.0, 0.5, 0.9, 1.0)).collect():
        exact = good[max(1, int(np.ceil(round(r["p"] * len(good), 9)))) - 1]
        assert exact <= r["value"] <= exact * (1 + 1 / 128) + 1
    edges = spark.createDataFrame([(v,) for v in (0, 127, 128, 255, 256, 257, 1 << 20, (1 << 44) - 1, 1 << 44)], "ns long").select("ns", histogram.bucket().alias("bucket"))
    for r in edges.withColumn("upper", histogram.upper_bound()).collect():
        assert r["ns"] <= r["upper"]
    assert [r["bucket"] for r in edges.collect()] == [0, 127, 128, 255, 256, 256, 14 * 128, 38 * 128 - 1, 38 * 128]


def test_murmur_vectors_and_filter(spark):
    h1, h2 = bloom.murmur3([b"", b"hello", b"hello, world", b"The quick brown fox jumps over the lazy dog"])
    assert [f"{a:016x}{b:016x}" for a, b in zip(h1.tolist(), h2.tolist(), strict=True)] == [
        "0" * 32,
        "cbd8a7b341bd9b025b1e906a48ae1d19",
        "342fac623a5ebc8e4cdcbc079642414d",
        "e34bbc7bbc071b6c7a433ca9c49a9347",
    ]
    r = bloom.rate_experiment(spark, 5000, 20000).first()
    assert r["false_negatives"] == 0
    expected = bloom.expected_rate(5000, 20000)
    assert abs(r["false_positives"] - expected) < 6 * expected**0.5


def test_varints():
    for n in (0, 1, 127, 128, 300, 1 << 35, (1 << 64) - 1):
        assert codec.decode_varint(codec.encode_varint(n), canonical=True) == n
    with pytest.raises(ValueError):
        codec.decode_varint(b"\x80\x00", canonical=True)
    assert codec.show(b"") == '""' and codec.show("né".encode()) == "né" and codec.show(b"\xff\n") == '"\\xff\\n"'
    assert codec.scrub_nested({"a": [{"api_key": 1, "b": 2}]}) == {"a": [{"api_key": "[REDACTED]", "b": 2}]}


def test_lru_replay_matches_an_ordered_dict(spark):
    rng = random.Random(9)
    trace = [(i, rng.randrange(3), rng.randrange(12), 0) for i in range(600)]
    df = cache.replay(spark.createDataFrame(trace, "pos long, shard long, file_num long, offset long"), 5)
    want, caches = {}, {}
    for pos, shard, f, o in trace:
        c = caches.setdefault(shard, OrderedDict())
        want[pos] = (f, o) in c
        c[(f, o)] = 1
        c.move_to_end((f, o))
        if len(c) > 5:
            c.popitem(last=False)
    assert {r["pos"]: r["hit"] for r in df.collect()} == want


def test_streams_give_what_batches_give(spark, tmp_path):
    from tidemark.streaming import live as stream

    rng = random.Random(2)
    rows = [(b"k%d" % rng.randrange(20), i, 2 if i % 3 == 1 else 1, None if i % 3 == 1 else b"v%d" % i) for i in range(200)]
    df = spark.createDataFrame(rows, LOG)
    for part in range(3):
        df.filter(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = stream.newest(stream.read_log(spark, str(tmp_path / "in"), LOG)).writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("newest").collect()) == sorted(resolve.newest(df).collect())
    bad = df.union(spark.createDataFrame([(b"", 1000, 1, b"x")], LOG))
    bad.write.parquet(str(tmp_path / "in2"))
    q = stream.append_valid(stream.read_log(spark, str(tmp_path / "in2"), LOG), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200


def test_policy_text_and_principals(spark):
    text = spark.createDataFrame([('{"principals":[{"fingerprint":"' + "AB" * 32 + '","role":"admin"}]}',), ("not json",)], "text string")
    policy = flow.parse_policy(text)
    assert policy.count() == 1
    who = flow.principals(spark.createDataFrame([("ab" * 32,), ("cd" * 32,)], "fingerprint string"), policy)
    assert {r["fingerprint"][:2]: r["role"] for r in who.collect()} == {"ab": "admin", "cd": None}


def test_publish_checks_each_edit(spark, tmp_path):
    from tidemark.operators import compaction

    path = str(tmp_path / "manifest")
    rows = [("add", 0, 1, 10), ("add", 0, 2, 10)]
    kind = "action string, level long, file_num long, file_size long"
    assert compaction.publish(spark, spark.createDataFrame(rows, kind), 1, path).count() == 2
    current = compaction.publish(spark, spark.createDataFrame([("delete", 0, 1, None), ("add", 1, 3, 20)], kind), 2, path)
    assert {(r["level"], r["file_num"]) for r in current.collect()} == {(0, 2), (1, 3)}
    for no, bad in ((3, [("delete", 0, 1, None)]), (3, [("add", 0, 2, 1)]), (2, [("add", 0, 9, 1)])):
        with pytest.raises(ValueError):
            compaction.publish(spark, spark.createDataFrame(bad, kind), no, path)
    with pytest.raises(ValueError):
        compaction.Policy(levels=1)
    assert compaction.Policy().capacity(2) == 100 << 20


def test_compaction_loses_nothing_and_resurrects_nothing(spark):
    from tidemark.operators import compaction, merge

    rng = random.Random(8)
    rows = [(b"k%02d" % rng.randrange(30), s, 2 if s % 4 == 0 else 1, None if s % 4 == 0 else b"v%d" % s, (300 - s) // 100, 1 + (300 - s) // 20) for s in range(1, 301)]
    df = spark.createDataFrame(rows, "key binary, seq long, op int, value binary, level long, file_num long")
    from tidemark.sources.testdata import file_metadata

    files = file_metadata(df)
    out, chosen = compaction.run(df, files, 0)
    gone = chosen.select("level", "file_num")
    rest = df.join(gone, ["level", "file_num"], "left_anti").select("key", "seq", "op", "value")
    assert live(rest.unionByName(out.select("key", "seq", "op", "value"))) == live(df)
    assert compaction.edit(out, chosen, 0, 100).filter("action = 'delete'").count() == chosen.count()
    assert merge.order_violations(out.withColumn("pos", F.struct("key", -F.col("seq"))).withColumn("part", F.col("file_no")), "part").count() == 0


def test_filter_blocks():
    block = bloom.encode_filter(b"\x05\x80", 16)
    assert bloom.decode_filter(block) == (b"\x05\x80", 16, bloom.PROBES)
    with pytest.raises(ValueError):
        bloom.decode_filter(block[:-1] + b"\0")


def test_reads_of_a_stored_log_are_pruned(spark, tmp_path):
    rows = [(b"k%03d" % (i % 100), i, 1, b"v%d" % i) for i in range(500)] + [(b"\xff\xffz", 900, 1, b"last"), (b"k\xff", 901, 1, b"edge")]
    merge.write_table(spark.createDataFrame(rows, LOG), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(key), EqualTo(key," in plan(resolve.get(log, b"k007"))
    assert "GreaterThanOrEqual(key," in plan(resolve.prefix_scan(log, b"k00")) and "LessThan(key," in plan(resolve.prefix_scan(log, b"k00"))
    assert "value" not in plan(resolve.exists(log, b"k007")).split("ReadSchema:")[1]
    for prefix in (b"k00", b"\xff\xff", b"k\xff", b"", b"none"):
        want = sorted(k for k, s, op, v in {r[0]: r for r in rows}.values() if k.startswith(prefix))
        assert [bytes(r["key"]) for r in resolve.prefix_scan(log, prefix, 500).collect()] == want
