"""Queries on sketches, latencies, workloads, flow control, access rules and the replicated log, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import cli
from tidemark.functions import bloom, codec, histogram, workload
from tidemark.operators import cache, flow, replog
from tidemark.plans import catalog_kv, catalog_store
from tidemark.plans.catalog_kv import L, LAT, Query, shown
from tidemark.sources import testdata as D

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- Bloom filters and their statistics

_M = "CAST(18446744073709551616 AS UHUGEINT)"


def _mul(x: str, c: int) -> str:
    return f"((({x}) * CAST({c} AS UHUGEINT)) % {_M})"


def _rot(x: str, n: int) -> str:
    return f"(((({x}) * CAST({1 << n} AS UHUGEINT)) % {_M}) + (({x}) // CAST({1 << (64 - n)} AS UHUGEINT)))"


def _little(text: str, first: int, last: int) -> str:
    """The bytes first..last of a text as a little-endian number."""
    return "(" + " + ".join(f"CAST(ord(substr({text}, {i}, 1)) AS UHUGEINT) * CAST({256 ** (i - first)} AS UHUGEINT)" for i in range(first, last + 1)) + ")"


def murmur_sql(source: str, low: str, high: str, tail: str | None, length: int) -> str:
    """CTEs up to H (the rows of `source` with h1, h2): the hash of keys of one length from 16 to 24, as steps on 64-bit numbers."""
    c1, c2 = int(bloom._C1), int(bloom._C2)
    final = [0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53]
    steps = [f"M0 AS (SELECT *, {low} AS k1, {high} AS k2, {tail or 'CAST(0 AS UHUGEINT)'} AS k3 FROM {source})"]
    steps.append(f"M1 AS (SELECT *, {_mul('k1', c1)} AS x, {_mul('k2', c2)} AS y, {_mul('k3', c1)} AS z FROM M0)")
    steps.append(f"M2 AS (SELECT * EXCLUDE (x, y, z), {_mul(_rot('x', 31), c2)} AS a0, {_mul(_rot('y', 33), c1)} AS y, {_mul(_rot('z', 31), c2)} AS z FROM M1)")
    steps.append(f"M3 AS (SELECT * EXCLUDE (a0), ({_rot('a0', 27)} % {_M} * 5 + 1390208809) % {_M} AS a FROM M2)")
    steps.append(f"M4 AS (SELECT * EXCLUDE (y), (({_rot('y', 31)} + a) % {_M} * 5 + 944331445) % {_M} AS b FROM M3)")
    steps.append(f"M5 AS (SELECT * EXCLUDE (a, b, z), xor(xor(a, z), CAST({length} AS UHUGEINT)) AS a, xor(b, CAST({length} AS UHUGEINT)) AS b FROM M4)")
    steps.append(f"M6 AS (SELECT * EXCLUDE (a, b), (a + b) % {_M} AS a, (a + 2 * b) % {_M} AS b FROM M5)")
    for i, c in enumerate(final):
        mixed = ", ".join(f"{_mul(f'xor({v}, {v} // CAST({1 << 33} AS UHUGEINT))', c)} AS {v}" for v in "ab")
        steps.append(f"M{7 + i} AS (SELECT * EXCLUDE (a, b), {mixed} FROM M{6 + i})")
    steps.append("M9 AS (SELECT * EXCLUDE (a, b), " + ", ".join(f"xor({v}, {v} // CAST({1 << 33} AS UHUGEINT)) AS {v}" for v in "ab") + " FROM M8)")
    steps.append(f"H AS (SELECT * EXCLUDE (a, b), (a + b) % {_M} AS h1, (a + 2 * b) % {_M} AS h2 FROM M9)")
    return ", ".join(steps)


def _bloom_sql(source: str, inserted: str, length: int) -> str:
    """CTEs up to A: the rows of `source` (id, key) with maybe, after those where `inserted` went in."""
    tail = _little("key", 17, length)
    return (
        murmur_sql(source, _little("key", 1, 8), _little("key", 9, 16), tail, length)
        + f", S AS (SELECT CAST(10 * count(*) AS UHUGEINT) AS m FROM H WHERE {inserted})"
        + ", P AS (SELECT H.*, (h1 % m + CAST(i AS UHUGEINT) * (h2 % m)) % m AS p FROM H, S, range(0, 7) t(i))"
        + f", W AS (SELECT DISTINCT p AS there FROM P WHERE {inserted})"
        + ", A AS (SELECT id, bool_and(there IS NOT NULL) AS maybe FROM P LEFT JOIN W ON p = there GROUP BY id)"
    )


@query(f"WITH K AS (SELECT c_custkey AS id, c_name AS key FROM customer), {_bloom_sql('K', 'id % 2 = 0', 18)} SELECT id AS c_custkey, id % 2 = 0 AS inserted, maybe FROM A")
def bloom_build_probe(spark, sf_dir):
    """Keys of even customers go in, all are asked: (c_custkey, inserted, maybe)."""
    c = D.table(spark, sf_dir, "customer").select("c_custkey", F.encode("c_name", "UTF-8").alias("key"))
    there = c.filter("c_custkey % 2 = 0")
    bits = bloom.filter_bits(there.count())
    found = bloom.query(c, "key", bloom.build(there, "key", bits), bits)
    return found.select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("inserted"), "maybe")


@query(f"""WITH K AS (SELECT id, CASE WHEN id < 20000 THEN 'insert:' || lpad(CAST(id AS VARCHAR), 10, '0') ELSE 'absent:' || lpad(CAST(id - 20000 AS VARCHAR), 10, '0') END AS key FROM range(0, 40000) t(id)),
  {_bloom_sql('K', 'id < 20000', 17)} SELECT count(*) FILTER (id < 20000 AND NOT maybe) AS false_negatives, count(*) FILTER (id >= 20000 AND maybe) AS false_positives FROM A""")
def bloom_rate_experiment(spark, sf_dir):
    return bloom.rate_experiment(spark, 20_000, 20_000)


@query("SELECT b, k, round(pow(1 - exp(-k / b), k), 9) AS rate FROM (SELECT CAST(b AS DOUBLE) AS b FROM range(4, 21) t(b)), (SELECT CAST(k AS DOUBLE) AS k FROM range(1, 15) t(k))")
def bloom_theory(spark, sf_dir):
    b, k = (spark.range(x, y).select(F.col("id").cast("double").alias(n)) for x, y, n in ((4, 21, "b"), (1, 15, "k")))
    return b.join(k, F.lit(True)).withColumn("rate", F.round(bloom.theoretical_rate(F.col("b"), F.col("k")), 9))


_Z = 1.959963984540054
_TRIALS = "C AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS x, count(*) AS n FROM events GROUP BY user_id)"


def _trials(spark, sf_dir):
    return D.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("x"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TRIALS}, P AS (SELECT user_id, x, n, x / CAST(n AS DOUBLE) AS p, {_Z} AS z FROM C), H AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS mid, z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * CAST(n AS DOUBLE) * n)) AS half FROM P) "
       "SELECT user_id, round(CASE WHEN x = 0 THEN 0 ELSE greatest(0, mid - half) END, 9) AS low, round(CASE WHEN x = n THEN 1 ELSE least(1, mid + half) END, 9) AS high FROM H")  # fmt: skip
def wilson_interval(spark, sf_dir):
    low, high = bloom.wilson(F.col("x"), F.col("n"), _Z)
    return _trials(spark, sf_dir).select("user_id", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(f"WITH {_TRIALS} SELECT user_id, round((x - n * 0.2) / sqrt(n * 0.2 * 0.8), 9) AS z FROM C")
def z_score(spark, sf_dir):
    return _trials(spark, sf_dir).select("user_id", F.round(bloom.z_score(F.col("x"), F.col("n"), 0.2), 9).alias("z"))


# --- latencies


_BUCKET = "CASE WHEN ns < 128 THEN ns WHEN ns >= 17592186044416 THEN 4864 ELSE (length(bin(ns)) - 7) * 128 + ((ns >> CAST(length(bin(ns)) - 8 AS INT)) & 127) END"
_HIST = f"H AS (SELECT op, {_BUCKET} AS bucket, count(*) AS count, CAST(sum(ns) AS BIGINT) AS sum, min(ns) AS least, max(ns) AS most FROM T WHERE ns >= 0 GROUP BY 1, 2)"
_UPPER = "CASE WHEN bucket < 128 THEN bucket WHEN bucket >= 4864 THEN 9223372036854775807 ELSE ((128 + bucket % 128 + 1) << CAST(bucket // 128 - 1 AS INT)) - 1 END"


@query(f"WITH {LAT}, {_HIST} SELECT * FROM H")
def hist_buckets(spark, sf_dir):
    return histogram.histogram(D.latencies(spark, sf_dir), ["op"])


@query(f"WITH {LAT}, {_HIST} SELECT bucket, {_UPPER} AS upper FROM (SELECT DISTINCT bucket FROM H)")
def hist_upper_bounds(spark, sf_dir):
    return histogram.histogram(D.latencies(spark, sf_dir), ["op"]).select("bucket").distinct().withColumn("upper", histogram.upper_bound())


@query(f"WITH {LAT}, {_HIST}, R AS (SELECT *, sum(count) OVER (PARTITION BY op ORDER BY bucket) AS reached, sum(count) OVER (PARTITION BY op) AS n, max(most) OVER (PARTITION BY op) AS hi FROM H), P AS (SELECT unnest([0.5, 0.9, 0.99, 0.999]) AS p) "
       f"SELECT op, CAST(p AS DOUBLE) AS p, least({_UPPER}, hi) AS value FROM R, P WHERE reached >= greatest(1, ceil(round(p * n, 9))) AND reached - count < greatest(1, ceil(round(p * n, 9)))")  # fmt: skip
def hist_percentiles(spark, sf_dir):
    return histogram.percentiles(histogram.histogram(D.latencies(spark, sf_dir), ["op"]), ["op"])


@query(f"WITH {LAT} SELECT op, quantile_disc(ns, 0.5) AS p50, quantile_disc(ns, 0.9) AS p90, quantile_disc(ns, 0.99) AS p99 FROM T WHERE ns >= 0 GROUP BY op")
def hist_exact_percentiles(spark, sf_dir):
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by ns)").cast("long")
    return D.latencies(spark, sf_dir).filter("ns >= 0").groupBy("op").agg(disc(0.5).alias("p50"), disc(0.9).alias("p90"), disc(0.99).alias("p99"))


@query(f"WITH {LAT}, {_HIST} SELECT op, bucket, count, sum, least, most FROM H")
def hist_merge(spark, sf_dir):
    return histogram.combine(histogram.histogram(D.latencies(spark, sf_dir), ["op", "worker"]), ["op"])


@query(f"WITH {LAT} SELECT op, count(*) AS n, CAST(sum(ns) // count(*) AS BIGINT) AS mean FROM T WHERE ns >= 0 GROUP BY op")
def hist_means(spark, sf_dir):
    return histogram.means(histogram.histogram(D.latencies(spark, sf_dir), ["op"]), ["op"])


_BOUNDS = ", ".join(f"('{b}', {b})" for b in histogram.SECONDS)


@query(f"SELECT event_type, bound, count(*) FILTER (greatest(value / 100, 0) <= b) AS cumulative FROM events, (VALUES {_BOUNDS}, ('+Inf', 1e300)) t(bound, b) GROUP BY event_type, bound")
def prom_histogram(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").withColumn("seconds", F.col("value") / 100)
    return histogram.cumulative(e, ["event_type"], "seconds")


@query(f"SELECT 'latency_bucket{{type=\"' || event_type || '\",le=\"' || bound || '\"}} ' || count(*) FILTER (greatest(value / 100, 0) <= b) AS line FROM events, (VALUES {_BOUNDS}, ('+Inf', 1e300)) t(bound, b) GROUP BY event_type, bound")
def prom_exposition(spark, sf_dir):
    counts = prom_histogram(spark, sf_dir).withColumnRenamed("event_type", "type")
    return histogram.exposition(counts, "latency", "type")


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS event_type, count(*) AS n FROM events GROUP BY 1")
def prom_labels(spark, sf_dir):
    return histogram.allowed_only(D.table(spark, sf_dir, "events"), "event_type", ["click", "view"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# --- workloads and caches


@query("SELECT id AS rank, round(pow(id + 1, -0.99) / (SELECT sum(pow(i, -0.99)) FROM range(1, 1001) t(i)), 9) AS p FROM range(0, 1000) t(id)")
def zipf_pmf(spark, sf_dir):
    return spark.range(1000).select(F.col("id").alias("rank"), F.round(workload.zipf_probability(F.col("id"), 1000), 9).alias("p"))


@query("""WITH Z AS (SELECT sum(pow(i, -0.99)) AS z FROM range(1, 1001) t(i)), C AS (SELECT z, 1 + pow(0.5, 0.99) AS two, (1 - pow(2.0 / 1000, 0.01)) / (1 - (1 + pow(0.5, 0.99)) / z) AS eta FROM Z), U AS (SELECT event_id, (event_id % 10007 + 0.5) / 10007 AS u FROM events)
  SELECT event_id, CAST(CASE WHEN u * z < 1 THEN 0 WHEN u * z < two THEN 1 ELSE least(999, greatest(0, floor(1000.0 * pow(eta * u - eta + 1, 1 / 0.01)))) END AS BIGINT) AS rank FROM U, C""")
def zipf_sample(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 10007 + 0.5) / 10007).alias("u"))
    return e.select("event_id", workload.zipf_rank(F.col("u"), 1000).alias("rank"))


@query("SELECT id AS seq, CASE WHEN id % 100 < 70 THEN 'GET' ELSE 'PUT' END AS op, 'bench:k:' || lpad(CAST(id % 1000 AS VARCHAR), 8, '0') AS key FROM range(0, 5000) t(id)")
def workload_lab(spark, sf_dir):
    return workload.lab_operations(spark, 5000, 70)


@query("""WITH Z AS (SELECT sum(pow(i, -0.99)) AS z FROM range(1, 1001) t(i)), C AS (SELECT z, 1 + pow(0.5, 0.99) AS two, (1 - pow(2.0 / 1000, 0.01)) / (1 - (1 + pow(0.5, 0.99)) / z) AS eta FROM Z),
  R AS (SELECT id, md5(id || ':42') AS h FROM range(0, 50000) t(id)), U AS (SELECT id, (CAST('0x' || substr(h, 1, 10) AS BIGINT) + 0.5) / 1099511627776.0 AS u, CAST('0x' || substr(h, 11, 8) AS BIGINT) % 100 AS mix FROM R),
  K AS (SELECT CASE WHEN mix < 80 THEN 'GET' ELSE 'PUT' END AS op, CASE WHEN u * z < 1 THEN 0 WHEN u * z < two THEN 1 ELSE least(999, greatest(0, floor(1000.0 * pow(eta * u - eta + 1, 1 / 0.01)))) END AS rank FROM U, C)
  SELECT op, count(*) AS n, count(DISTINCT rank) AS keys FROM K GROUP BY op""")
def workload_mix(spark, sf_dir):
    ops = workload.operations(spark, 50_000, 1000)
    return ops.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"))


@query("SELECT regexp_replace(printf('%,d', count(*)), 'x', '') AS operations, count(*) FILTER (event_type <> 'purchase') AS reads, round(100.0 * count(*) FILTER (event_type <> 'purchase') / count(*), 2) AS read_percent, round(count(*) / 60.0, 2) AS ops_per_second FROM events")
def bench_report(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "purchase", "PUT").otherwise("GET").alias("op"))
    r = workload.report(e, 60.0)
    return r.select("operations", F.regexp_replace("gets", ",", "").cast("long").alias("reads"), "read_percent", "ops_per_second")


def _trace(spark, sf_dir):
    return D.table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), (F.col("user_id") % 16).alias("shard"), F.col("user_id").alias("file_num"), (F.length("event_type") % 3).cast("long").alias("offset"))


def _lru_sql(trace: str, capacity: int, columns: str) -> str:
    """Hits by shard: an access hits if at most `capacity` different blocks, its own included, were read since it was read last."""
    return f"""WITH {trace}, P AS (SELECT *, lag(pos) OVER (PARTITION BY shard, f, o ORDER BY pos) AS prev FROM T),
  D AS (SELECT p.shard, p.pos, count(DISTINCT (q.f, q.o)) AS distance FROM P p JOIN T q ON q.shard = p.shard AND q.pos >= p.prev AND q.pos < p.pos WHERE p.prev IS NOT NULL GROUP BY 1, 2)
  SELECT shard, {columns} FROM (SELECT P.shard, count(*) AS accesses, count(*) FILTER (distance <= {capacity}) AS hits, count(DISTINCT (f, o)) AS blocks FROM P LEFT JOIN D USING (shard, pos) GROUP BY P.shard)"""


@query(_lru_sql("T AS (SELECT event_id AS pos, user_id % 16 AS shard, user_id AS f, length(event_type) % 3 AS o FROM events)", 12, "accesses, hits"))
def lru_hit_ratio(spark, sf_dir):
    return cache.hit_ratio(cache.replay(_trace(spark, sf_dir), 12), ["shard"]).select("shard", "accesses", "hits")


_EIGHT_BYTES = "CAST({} AS UHUGEINT)"


@query(_lru_sql(
    "X AS (SELECT event_id AS pos, user_id AS f, length(event_type) % 3 AS o FROM events), "
    + murmur_sql("X", _EIGHT_BYTES.format("f"), _EIGHT_BYTES.format("o"), None, 16)
    + ", T AS (SELECT pos, f, o, CAST((h1 // 268435456) % 16 AS BIGINT) AS shard FROM H)", 4,
    "accesses, hits, accesses - hits - least(4, blocks) AS evictions, hits / CAST(accesses AS DOUBLE) AS hit_ratio"))
def lru_sharded(spark, sf_dir):
    return cache.hit_ratio(cache.replay(cache.with_shard(_trace(spark, sf_dir).drop("shard")), 4), ["shard"])


# --- flow control, health, events


@query("SELECT n AS l0_count, CAST(CASE n WHEN 9 THEN 1 WHEN 10 THEN 5 WHEN 11 THEN 15 WHEN 12 THEN 30 ELSE 0 END AS BIGINT) AS delay_ms, n > 12 AS stall FROM range(0, 16) t(n)")
def pacing_delay(spark, sf_dir):
    return spark.range(16).select(F.col("id").alias("l0_count")).select("l0_count", *flow.pacing())


@query("""WITH R AS (SELECT o_orderkey, o_custkey, o_orderkey % 5 * 10000 + 1000 AS wanted FROM orders), U AS (SELECT *, coalesce(sum(wanted) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM R)
  SELECT o_orderkey, CASE WHEN wanted > 95000 THEN 'reject' WHEN used + wanted > 95000 THEN 'wait' WHEN used + wanted >= 80000 THEN 'delay' ELSE 'admit' END AS decision,
    round(CASE WHEN used + wanted BETWEEN 80000 AND 95000 THEN (used + wanted - 80000) / 15000.0 * 50 ELSE 0 END, 6) AS delay_ms FROM U""")
def memory_admission(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 5 * 10000 + 1000).alias("wanted"))
    decision, delay = flow.admission(F.col("used"), F.col("wanted"), 100_000)
    return flow.running_usage(o, "o_custkey", "o_orderkey", "wanted").select("o_orderkey", decision, F.round(delay, 6).alias("delay_ms"))


@query("SELECT date_trunc('minute', ts) AS start, count(*) AS ops, round(count(*) / 60.0, 9) AS per_second FROM events GROUP BY 1")
def throughput_1m(spark, sf_dir):
    return flow.throughput(D.table(spark, sf_dir, "events")).withColumn("per_second", F.round("per_second", 9))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'unhealthy' WHEN c_custkey % 5 = 0 THEN 'recovering' WHEN c_custkey % 3 = 0 THEN 'unhealthy' WHEN c_custkey % 2 = 0 THEN 'degraded' ELSE 'healthy' END AS status, c_custkey % 3 <> 0 AS liveness,
  c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 11 <> 0 AS readiness, CASE WHEN c_custkey % 7 = 0 THEN 'WAL is poisoned' WHEN c_custkey % 5 = 0 THEN 'Storage recovery in progress' WHEN c_custkey % 3 = 0 THEN 'Engine closed' WHEN c_custkey % 2 = 0 THEN 'Cluster quorum degraded' ELSE '' END AS incidents FROM customer""")
def health_status(spark, sf_dir):
    k = F.col("c_custkey")
    flags = D.table(spark, sf_dir, "customer").select(k, (k % 7 == 0).alias("wal_poisoned"), (k % 5 == 0).alias("recovering"), (k % 3 == 0).alias("closed"), (k % 11 != 0).alias("recovered"), (k % 2 != 0).alias("quorum_ok"))
    return flags.select("c_custkey", *flow.health()).withColumn("incidents", F.concat_ws(",", "incidents"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'DOWN' ELSE 'UP' END AS live, CASE WHEN c_custkey % 4 = 0 THEN 'DOWN' ELSE 'READY' END AS ready, CASE WHEN c_custkey % 8 = 0 THEN 'flushing' WHEN c_custkey % 4 = 0 THEN 'not ready' END AS reason FROM customer")
def health_probes(spark, sf_dir):
    k = F.col("c_custkey")
    return D.table(spark, sf_dir, "customer").select(k, *flow.probe(k % 3 != 0, k % 4 != 0, F.when(k % 8 == 0, "flushing")))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def events_recent_n(spark, sf_dir):
    return flow.recent(D.table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), 50, ["ts", "event_id"])


@query("SELECT greatest(0, count(*) - 256) AS dropped FROM events")
def events_dropped(spark, sf_dir):
    return flow.dropped(D.table(spark, sf_dir, "events"), 256)


# --- access rules and findings


@query("""WITH R(role, g) AS (VALUES ('reader', 1), ('writer', 3), ('admin', 7)), O(op, n) AS (VALUES ('GET', 1), ('EXISTS', 1), ('STATS', 1), ('PUT', 2), ('DELETE', 2), ('BATCH', 2)), Q AS (SELECT c_custkey, ['reader', 'writer', 'admin', 'guest'][c_custkey % 4 + 1] AS role, ['GET', 'PUT', 'BATCH', 'DROP', 'STATS', 'DELETE', 'EXISTS'][c_custkey % 7 + 1] AS op FROM customer)
  SELECT c_custkey, role, op, coalesce((n & g) = n, false) AS allowed FROM Q LEFT JOIN R USING (role) LEFT JOIN O USING (op)""")
def rbac_decisions(spark, sf_dir):
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % n + 1).cast("int"))
    q = D.table(spark, sf_dir, "customer").select("c_custkey", pick(["reader", "writer", "admin", "guest"], 4).alias("role"), pick(["GET", "PUT", "BATCH", "DROP", "STATS", "DELETE", "EXISTS"], 7).alias("op"))
    return flow.decide(q).select("c_custkey", "role", "op", "allowed")


_POLICY = "P AS (SELECT CASE WHEN c_custkey % 20 = 7 THEN 'xyz' ELSE sha256(CAST(c_custkey // 3 * 3 + CASE WHEN c_custkey % 3 = 2 AND c_custkey % 5 = 0 THEN 0 ELSE c_custkey % 3 END AS VARCHAR)) END AS fingerprint, ['reader', 'writer', 'admin', 'root'][c_custkey % 4 + 1] AS role FROM customer)"


@query(f"WITH {_POLICY} SELECT fingerprint, 'malformed' AS problem FROM P WHERE length(fingerprint) <> 64 UNION ALL SELECT fingerprint, 'unknown role' FROM P WHERE role = 'root' UNION ALL SELECT fingerprint, 'repeated' FROM P GROUP BY fingerprint HAVING count(*) > 1")
def policy_problems(spark, sf_dir):
    k = F.col("c_custkey")
    same = F.expr("c_custkey div 3 * 3") + F.when((k % 3 == 2) & (k % 5 == 0), 0).otherwise(k % 3)
    fp = F.when(k % 20 == 7, "xyz").otherwise(F.upper(F.sha2(same.cast("string"), 256)))
    role = F.element_at(F.array(*map(F.lit, ["reader", "writer", "admin", "root"])), (k % 4 + 1).cast("int"))
    return flow.policy_problems(D.table(spark, sf_dir, "customer").select(fp.alias("fingerprint"), role.alias("role")))


_FIND = "F AS (SELECT 'R' || lpad(CAST(doc_id % 7 AS VARCHAR), 3, '0') AS rule_id, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'][doc_id % 5 + 1] AS severity, source || '/a.go' AS file, doc_id AS line, 'title ' || lang AS title FROM documents)"
_FIND_ID = "'FIND-' || rule_id || '-' || substr(sha256(rule_id || '|' || file || '|' || line || '|' || title), 1, 8)"


def _findings(spark, sf_dir):
    k = F.col("doc_id")
    severity = F.element_at(F.array(*map(F.lit, flow.SEVERITIES)), (k % 5 + 1).cast("int"))
    return D.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("R"), F.lpad((k % 7).cast("string"), 3, "0")).alias("rule_id"), severity.alias("severity"), F.concat("source", F.lit("\\a.go")).alias("file"), k.alias("line"), F.concat(F.lit("title "), "lang", F.lit(" ")).alias("title")
    )


@query(f"WITH {_FIND} SELECT {_FIND_ID} AS finding_id, severity, line, line % 10 = 0 AS suppressed FROM F")
def findings_report(spark, sf_dir):
    f = _findings(spark, sf_dir)
    hidden = f.filter("line % 10 = 0").select(flow.finding_id().alias("finding_id"))
    return flow.audit(f, hidden).select("finding_id", "severity", "line", "suppressed")


@query(f"WITH {_FIND}, K AS (SELECT * FROM F WHERE line % 10 <> 0) SELECT count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'INFO') AS info FROM K")
def findings_by_severity(spark, sf_dir):
    return flow.severity_counts(_findings(spark, sf_dir).withColumn("suppressed", F.col("line") % 10 == 0))


@query("SELECT c_custkey, '***[REDACTED len=' || length(c_name) || ' sha256=' || substr(sha256(c_name), 1, 6) || ']***' AS masked FROM customer")
def secrets_masked(spark, sf_dir):
    return D.table(spark, sf_dir, "customer").select("c_custkey", codec.masked("c_name").alias("masked"))


#: Names that must be hidden, and near misses that must not.
HIDDEN_NAMES = (
    "password User_Password dbPasswd pass_word p_wd pwd user.pwd passphrase user_pass my_pass_old pass clientSecret secret-key token authToken access_token auth user_auth auth_header "
    "masterKey signing_key encryption-key API-Key apiKey private-key privatekey credentials session session_id SESSIONID user_session Set-Cookie Authorization card cvv CVC ssn salt "
    "nonce mnemonic wallet_seed X-API-KEY HTTPCookie"
).split()
SHOWN_NAMES = "name author authority authenticate tokenizer tokens passenger compass sessions discard salted seedling key monkey keyboard cardinal noncense path_passed api".split()


@query("SELECT n_nationkey, field, CASE WHEN hidden THEN '[REDACTED]' ELSE n_name END AS value FROM nation, (VALUES " + ", ".join(f"('{n}', {str(n in HIDDEN_NAMES).lower()})" for n in HIDDEN_NAMES + SHOWN_NAMES) + ") t(field, hidden)")
def log_scrubbing(spark, sf_dir):
    fields = F.map_from_arrays(F.array(*map(F.lit, HIDDEN_NAMES + SHOWN_NAMES)), F.array_repeat("n_name", len(HIDDEN_NAMES + SHOWN_NAMES)))
    n = D.table(spark, sf_dir, "nation").withColumn("m", fields)
    return n.withColumn("m", codec.scrubbed("m")).select("n_nationkey", F.explode("m").alias("field", "value"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'login token=[REDACTED], of ' || n_name WHEN 1 THEN 'sent Bearer [REDACTED] now' WHEN 2 THEN 'author: ' || n_name ELSE 'db.Password=[REDACTED] ok' END AS line FROM nation""")
def log_line_scrubbing(spark, sf_dir):
    n = F.col("n_nationkey") % 4
    line = (
        F.when(n == 0, F.concat(F.lit("login token = abc"), "n_nationkey", F.lit(", of "), "n_name"))
        .when(n == 1, F.concat(F.lit("sent Bearer x.y-"), "n_nationkey", F.lit(" now")))
        .when(n == 2, F.concat(F.lit("author: "), "n_name"))
        .otherwise(F.concat(F.lit("db.Password:"), F.lit("hunter"), "n_nationkey", F.lit(" ok")))
    )
    return D.table(spark, sf_dir, "nation").select("n_nationkey", codec.scrubbed_text(line).alias("line"))


@query(f"WITH {L} SELECT seq, '[REDACTED len=' || strlen(key) || ']' AS key FROM L")
def key_redaction(spark, sf_dir):
    return D.mutation_log(spark, sf_dir).select("seq", codec.redacted().alias("key"))


@query("""WITH B AS (SELECT n_nationkey, n_name, n_nationkey * 7 AS b FROM nation)
  SELECT n_nationkey, CASE WHEN b BETWEEN 32 AND 126 THEN n_name || chr(CAST(b AS INTEGER)) ELSE '"' || n_name || '\\x' || printf('%02x', b) || '"' END AS shown FROM B""")
def value_rendering(spark, sf_dir):
    n = D.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.encode("n_name", "UTF-8"), F.unhex(F.lpad(F.hex((F.col("n_nationkey") * 7).cast("long")), 2, "0"))).alias("v"))
    return n.select("n_nationkey", codec.shown("v").alias("shown"))


@query("""WITH N AS (SELECT n_nationkey, n_name, n_nationkey % 4 AS k, n_name LIKE '% %' AS two FROM nation)
  SELECT n_nationkey, CASE k WHEN 0 THEN 'PUT' WHEN 1 THEN CASE WHEN NOT two THEN 'GET' END WHEN 2 THEN 'BATCH' END AS kind, CASE k WHEN 0 THEN 'k ' || n_name WHEN 1 THEN CASE WHEN NOT two THEN n_name END END AS key,
    CASE k WHEN 0 THEN 'vA' END AS value, CAST(CASE k WHEN 2 THEN 2 ELSE 0 END AS BIGINT) AS operations, CASE WHEN k = 1 AND two THEN 'GET takes 1 arguments' WHEN k = 3 THEN 'PUT takes 2 arguments' END AS error FROM N""")
def cli_commands(spark, sf_dir):
    n = F.col("n_nationkey")
    line = F.when(n % 4 == 0, F.concat(F.lit("put 'k "), F.col("n_name"), F.lit("' \"v\\x41\""))).when(n % 4 == 1, F.concat(F.lit("GET "), "n_name")).when(n % 4 == 2, "BATCH PUT a b DELETE c").otherwise("PUT onlykey")
    return shown(D.table(spark, sf_dir, "nation").select("n_nationkey", cli.parsed(line).alias("c")).select("n_nationkey", "c.*"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN 404 WHEN 2 THEN 405 WHEN 1 THEN CASE WHEN c_custkey % 3 = 2 THEN 200 ELSE 403 END ELSE CASE WHEN c_custkey % 3 = 0 THEN 403 ELSE 200 END END AS answer FROM customer""")
def route_permissions(spark, sf_dir):
    routes = spark.createDataFrame([("/stats", "GET", 1), ("/stats", "PUT", 4), ("/compact", "POST", 4)], "path string, method string, needed int")
    k = F.col("c_custkey")
    path = F.when(k % 4 == 3, "/none").when(k % 4 == 1, "/compact").otherwise("/stats")
    method = F.when(k % 4 == 2, "DELETE").when(k % 4 == 1, "POST").otherwise("GET")
    granted = F.when(k % 3 == 0, 0).when(k % 3 == 1, 3).otherwise(7)
    return flow.route_access(D.table(spark, sf_dir, "customer").select(k, path.alias("path"), method.alias("method"), granted.alias("granted")), routes).select("c_custkey", "answer")


# --- replicated log


_NODES = "M AS (SELECT s_nationkey AS g, s_suppkey, CAST(trunc(s_acctbal) AS BIGINT) % 400 + 400 AS match_index FROM supplier)"


@query(f"WITH {_NODES}, B AS (SELECT g, list_sort(list(match_index), 'DESC')[count(*) // 2 + 1] AS bound FROM M GROUP BY g), E AS (SELECT g, i AS idx, i // 100 AS term FROM B, range(1, 801) t(i)) "
       "SELECT CAST(g AS BIGINT) AS node_group, greatest(50, max(idx) FILTER (idx <= bound AND term = bound // 100)) AS commit_index FROM E JOIN B USING (g) GROUP BY g")  # fmt: skip
def raft_commit_index(spark, sf_dir):
    m = D.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("group"), (F.col("s_acctbal").cast("long") % 400 + 400).alias("match_index"))
    bound = m.groupBy("group").agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("x")).select("group", (F.element_at("x", (F.floor(F.size("x") / 2) + 1).cast("int"))).alias("b"))
    entries = bound.select("group", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(800).cast("long"))).alias("index"), F.expr("b div 100").alias("current_term"), F.lit(50).cast("long").alias("committed")).withColumn("term", F.expr("index div 100"))
    return replog.commit_index(m, entries).select(F.col("group").alias("node_group"), "commit_index")


@query("SELECT s_suppkey, greatest(0, 700 - (CAST(trunc(s_acctbal) AS BIGINT) % 400 + 400)) AS lag FROM supplier")
def raft_lag(spark, sf_dir):
    m = D.table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal").cast("long") % 400 + 400).alias("match_index"), F.lit(700).cast("long").alias("commit_index"))
    return replog.lag(m).select("s_suppkey", "lag")


@query("SELECT o_orderkey, (o_orderkey % 5 > o_custkey % 5) OR (o_orderkey % 5 = o_custkey % 5 AND o_orderkey >= o_custkey) AS fresh FROM orders")
def raft_freshness(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("t"), (F.col("o_custkey") % 5).alias("u"), "o_custkey")
    return o.select("o_orderkey", replog.as_fresh("t", "o_orderkey", "u", "o_custkey").alias("fresh"))


@query("WITH E AS (SELECT event_id // 1000 AS log, event_id AS idx, lag(event_id) OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS before FROM events WHERE event_id % 17 <> 0) SELECT log, idx, before FROM E WHERE idx <> before + 1")
def raft_contiguity(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").filter("event_id % 17 <> 0").select(F.expr("event_id div 1000").alias("log"), F.col("event_id").alias("index"))
    return replog.breaks(e).select("log", F.col("index").alias("idx"), "before")


@query("""WITH Lo AS (SELECT event_id // 500 AS log, event_id % 500 AS i, 1 + event_id % 500 // 100 AS term FROM events), Ne AS (SELECT log, i, CASE WHEN i >= 300 AND log % 2 = 0 THEN 9 ELSE term END AS term FROM Lo WHERE i BETWEEN 250 AND 350),
  C AS (SELECT Lo.log, min(Lo.i) AS cut FROM Lo JOIN Ne USING (log, i) WHERE Lo.term <> Ne.term GROUP BY 1), K AS (SELECT Lo.* FROM Lo LEFT JOIN C USING (log) WHERE cut IS NULL OR i < cut)
  SELECT log, i AS idx, term FROM K UNION ALL SELECT log, i, term FROM Ne WHERE (log, i) NOT IN (SELECT (log, i) FROM K)""")
def raft_conflict_truncation(spark, sf_dir):
    e = D.table(spark, sf_dir, "events")
    local = e.select(F.expr("event_id div 500").alias("log"), (F.col("event_id") % 500).alias("index"), F.expr("1 + event_id % 500 div 100").alias("term"))
    new = local.filter("index between 250 and 350").withColumn("term", F.when((F.col("index") >= 300) & (F.col("log") % 2 == 0), 9).otherwise(F.col("term")))
    return replog.reconcile(local, new).select("log", F.col("index").alias("idx"), "term")


@query(f"WITH {L}, A AS (SELECT *, event_id // 3 AS idx, event_id % 3 AS pos FROM L WHERE event_id // 3 <= (SELECT max(event_id) // 3 * 9 // 10 FROM L) AND event_id // 3 % 10 <> 0), N AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC, pos DESC) AS rn FROM A) SELECT key, idx * 1024 + pos AS seq, value FROM N WHERE rn = 1 AND op = 1")
def raft_apply_state(spark, sf_dir):
    """The state where nine tenths of the entries are committed."""
    e = D.mutation_log(spark, sf_dir).withColumn("index", F.expr("event_id div 3"))
    ops = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "op", "key", "value"))), lambda x: F.struct(x["op"].alias("op"), x["key"].alias("key"), x["value"].alias("value")))
    entries = e.groupBy("index").agg(ops.alias("ops")).withColumn("type", F.when(F.col("index") % 10 == 0, "noop").otherwise("batch"))
    last = D.table(spark, sf_dir, "events").agg(F.expr("max(event_id) div 3")).first()[0] or 0
    return shown(replog.applied(entries, last * 9 // 10))


@query("""WITH A AS (SELECT user_id % 10 AS g, ts, event_id AS applied FROM events WHERE event_type <> 'view'), R AS (SELECT user_id % 10 AS g, ts, event_id AS read_id, event_id - event_id % 400 AS read_index FROM events WHERE event_type = 'view'),
  X AS (SELECT g, ts, 1 AS side, read_id, read_index, NULL AS applied FROM R UNION ALL SELECT g, ts, 0, NULL, NULL, applied FROM A), W AS (SELECT *, max(applied) OVER (PARTITION BY g ORDER BY ts, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached FROM X)
  SELECT read_id, reached, coalesce(reached, 0) >= read_index AS allowed FROM W WHERE side = 1""")
def read_index_barrier(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").withColumn("group", F.col("user_id") % 10)
    reads = e.filter("event_type = 'view'").select("group", "ts", F.col("event_id").alias("read_id"), (F.col("event_id") - F.col("event_id") % 400).alias("read_index"))
    return replog.read_barrier(reads, e.filter("event_type <> 'view'").select("group", "ts", F.col("event_id").alias("applied_index"))).select("read_id", "reached", "allowed")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'execute' WHEN 1 THEN 'redirect' ELSE 'unavailable' END AS route FROM customer")
def raft_routing(spark, sf_dir):
    role = F.element_at(F.array(*map(F.lit, ["leader", "follower", "candidate"])), (F.col("c_custkey") % 3 + 1).cast("int"))
    return D.table(spark, sf_dir, "customer").select("c_custkey", role.alias("role")).select("c_custkey", replog.route().alias("route"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE c_custkey END AS leader_id, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE 'n' || c_custkey || ':7000' END AS address FROM customer")
def redirect_parse(spark, sf_dir):
    k = F.col("c_custkey")
    c = D.table(spark, sf_dir, "customer").select(k, k.alias("leader_id"), F.concat(F.lit("n"), k.cast("string"), F.lit(":7000")).alias("address"))
    text = F.when(k % 4 == 3, F.concat(replog.redirect(), F.lit("\n"))).otherwise(replog.redirect())
    return c.select("c_custkey", text.alias("message")).select("c_custkey", *replog.parse_redirect())


@query("""WITH Q AS (SELECT o_orderkey AS pos, o_custkey % 50 AS voter, o_orderkey % 20 AS term, o_custkey AS candidate, o_orderkey % 7 AS last_term, o_custkey % 9 AS last_index FROM orders), F AS (SELECT *, row_number() OVER (PARTITION BY voter, term ORDER BY pos) AS rn FROM Q WHERE last_term > 3 OR (last_term = 3 AND last_index >= 4))
  SELECT voter, term, candidate FROM F WHERE rn = 1""")
def raft_votes(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    q = D.table(spark, sf_dir, "orders").select(k.alias("pos"), (c % 50).alias("voter"), (k % 20).alias("term"), c.alias("candidate"), (k % 7).alias("last_term"), (c % 9).alias("last_index"), F.lit(3).alias("voter_term"), F.lit(4).alias("voter_index"))
    return replog.votes(q)


@query("""WITH E AS (SELECT event_id // 2000 AS log, event_id % 2000 AS i, length(props) AS size FROM events), P AS (SELECT DISTINCT event_id // 2000 AS log, p AS peer, p * 300 AS nxt FROM events, range(0, 5) t(p)), D AS (SELECT *, row_number() OVER w AS n, sum(size) OVER w AS bytes FROM E JOIN P USING (log) WHERE i >= nxt AND i < nxt + 1024 WINDOW w AS (PARTITION BY log, peer ORDER BY i))
  SELECT log, peer, i AS idx FROM D WHERE n = 1 OR bytes <= 5000""")
def raft_replication_batch(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select(F.expr("event_id div 2000").alias("log"), (F.col("event_id") % 2000).alias("index"), F.octet_length("props").alias("size"))
    peers = e.select("log").distinct().select("log", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("peer")).withColumn("next_index", F.col("peer") * 300)
    return replog.replication_batch(e, peers, 5000).select("log", "peer", F.col("index").alias("idx"))


@query("""WITH N AS (SELECT s_suppkey % 90 AS node_id, 'h' || s_suppkey // 2 || ':1' AS address FROM supplier) SELECT 'repeated id' AS problem, CAST(node_id AS VARCHAR) AS value FROM N GROUP BY node_id HAVING count(*) > 1
  UNION ALL SELECT 'repeated address', address FROM N GROUP BY address HAVING count(*) > 1 UNION ALL SELECT 'self missing', NULL WHERE NOT EXISTS (SELECT 1 FROM N WHERE node_id = 1000) UNION ALL SELECT 'too many nodes', NULL WHERE (SELECT count(*) FROM N) > 256""")
def topology_problems(spark, sf_dir):
    k = F.col("s_suppkey")
    n = D.table(spark, sf_dir, "supplier").select((k % 90).alias("node_id"), F.concat(F.lit("H"), F.expr("s_suppkey div 2").cast("string"), F.lit(":1")).alias("address"))
    return replog.topology_problems(n, 1000)


def all_queries() -> dict[str, Query]:
    return catalog_kv.QUERIES | catalog_store.QUERIES | QUERIES


def all_sql() -> dict[str, str]:
    return catalog_kv.SQL | catalog_store.SQL | SQL
