"""Flow control, health, events, access rules and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Memory limits, pacing by number of level-0 files, permissions.
MAX_MEMORY, HIGH_MARK, HARD_MARK, MOST_DELAY_MS = 256 << 20, 0.80, 0.95, 50
PACING_MS = {9: 1, 10: 5, 11: 15, 12: 30}
STALL_ABOVE = 12
READ, WRITE, ADMIN = 1, 2, 4
ROLES = {"reader": READ, "writer": READ | WRITE, "admin": READ | WRITE | ADMIN}
OPERATIONS = {"GET": READ, "EXISTS": READ, "STATS": READ, "PUT": WRITE, "DELETE": WRITE, "BATCH": WRITE}
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")


def admission(used: Column, wanted: Column, most: int = MAX_MEMORY) -> list[Column]:
    """(decision, delay_ms) of a write that wants memory: free below the high mark, delayed in proportion up to the hard one, beyond it
    waiting, and rejected at once if it could never fit."""
    high, hard = int(most * HIGH_MARK), int(most * HARD_MARK)
    after = used + wanted
    decision = F.when(wanted > hard, "reject").when(after > hard, "wait").when(after >= high, "delay").otherwise("admit")
    delay = F.when((wanted <= hard) & (after <= hard) & (after >= high), (after - high) / float(hard - high) * MOST_DELAY_MS).otherwise(0.0)
    return [decision.alias("decision"), delay.alias("delay_ms")]


def pacing(l0_files: str = "l0_count") -> list[Column]:
    n = F.col(l0_files)
    delay = F.lit(0)
    for files, ms in PACING_MS.items():
        delay = F.when(n == files, ms).otherwise(delay)
    return [delay.cast("long").alias("delay_ms"), (n > STALL_ABOVE).alias("stall")]


def health() -> list[Column]:
    """(status, liveness, readiness, incidents) of the flags wal_poisoned, recovering, closed, recovered, quorum_ok."""
    poisoned, recovering, closed, quorum = (F.col(c) for c in ("wal_poisoned", "recovering", "closed", "quorum_ok"))
    cases = [(poisoned, "unhealthy", "WAL is poisoned"), (recovering, "recovering", "Storage recovery in progress"), (closed, "unhealthy", "Engine closed"), (~quorum, "degraded", "Cluster quorum degraded")]
    status, incident = F.lit("healthy"), F.lit(None).cast("string")
    for test, name, text in reversed(cases):
        status, incident = F.when(test, name).otherwise(status), F.when(test, text).otherwise(incident)
    return [status.alias("status"), (~closed).alias("liveness"), (~poisoned & ~closed & F.col("recovered")).alias("readiness"), F.array_compact(F.array(incident)).alias("incidents")]


def probe(up: Column, ready: Column, reason: Column) -> list[Column]:
    return [F.when(up, "UP").otherwise("DOWN").alias("live"), F.when(ready, "READY").otherwise("DOWN").alias("ready"), F.when(~ready, F.coalesce(reason, F.lit("not ready"))).alias("reason")]


def throughput(events: DataFrame, ts: str = "ts", every: str = "1 minute") -> DataFrame:
    """(start, ops, per_second) of tumbling windows; the same expression works on a stream."""
    w = events.groupBy(F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("ops"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return w.select(F.col("w.start").alias("start"), "ops", (F.col("ops") / seconds).alias("per_second"))


def recent(events: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last `n` events, oldest first: each task keeps `n`, no more meet."""
    return events.orderBy(*(F.col(c).desc() for c in order)).limit(n).orderBy(*order)


def dropped(events: DataFrame, capacity: int) -> DataFrame:
    """One row: how many events a ring of `capacity` no longer holds."""
    return events.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - capacity).alias("dropped"))


def _dimension(spark: SparkSession, values: dict[str, int], name: str, bits: str) -> DataFrame:
    return spark.createDataFrame(list(values.items()), f"{name} string, {bits} int")


def decide(requests: DataFrame, roles: dict[str, int] = ROLES, operations: dict[str, int] = OPERATIONS) -> DataFrame:
    """`requests` (role, op) with allowed: every bit that the operation needs is granted; unknown roles and operations are denied."""
    spark = requests.sparkSession
    granted, needed = F.broadcast(_dimension(spark, roles, "role", "granted")), F.broadcast(_dimension(spark, operations, "op", "needed"))
    both = requests.join(granted, "role", "left").join(needed, "op", "left")
    return both.withColumn("allowed", F.coalesce(F.col("needed").bitwiseAND(F.col("granted")) == F.col("needed"), F.lit(False))).drop("granted", "needed")


def principals(connections: DataFrame, policy: DataFrame) -> DataFrame:
    """`connections` (fingerprint) with the role that the policy (fingerprint, role) gives; 64 hex digits, any case."""
    clean = F.lower(F.trim("fingerprint"))
    known = policy.select(clean.alias("_fp"), "role").filter(F.col("_fp").rlike("^[0-9a-f]{64}$"))
    return connections.join(known, clean == F.col("_fp"), "left").drop("_fp")


def policy_problems(policy: DataFrame) -> DataFrame:
    """(fingerprint, problem) of entries that are malformed, repeated or name an unknown role."""
    fp = F.lower(F.trim("fingerprint"))
    rows = policy.select(fp.alias("fingerprint"), "role")
    form = rows.filter(~F.coalesce(F.col("fingerprint").rlike("^[0-9a-f]{64}$"), F.lit(False))).select("fingerprint", F.lit("malformed").alias("problem"))
    role = rows.filter(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))).select("fingerprint", F.lit("unknown role").alias("problem"))
    twice = rows.groupBy("fingerprint").count().filter("count > 1").select("fingerprint", F.lit("repeated").alias("problem"))
    return form.unionByName(role).unionByName(twice)


def parse_policy(text: DataFrame, column: str = "text") -> DataFrame:
    """(fingerprint, role) of JSON policies; text that does not parse gives nothing."""
    parsed = F.from_json(column, "principals array<struct<fingerprint:string,role:string>>")
    return text.select(F.explode(parsed["principals"]).alias("p")).select("p.*")


def finding_id() -> Column:
    """Stable id of (rule_id, file, line, title)."""
    file = F.replace(F.col("file"), F.lit("\\"), F.lit("/"))
    body = F.concat_ws("|", "rule_id", file, F.col("line").cast("string"), F.trim("title"))
    return F.concat(F.lit("FIND-"), F.col("rule_id"), F.lit("-"), F.substring(F.sha2(body, 256), 1, 8))


def severity_rank(severity: str = "severity") -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.upper(severity))


def audit(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """`findings` with id and suppressed, most severe first, then by file, line, rule and id."""
    known = suppressions.select("finding_id").distinct().withColumn("suppressed", F.lit(True))
    out = findings.withColumn("finding_id", finding_id()).join(known, "finding_id", "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))
    return out.orderBy(severity_rank(), "file", "line", "rule_id", "finding_id")


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row: findings that count, by severity."""
    return findings.filter(~F.col("suppressed")).agg(*(F.count_if(F.upper("severity") == s).alias(s.lower()) for s in SEVERITIES))


def table_listing(files: DataFrame) -> DataFrame:
    """Table files by name, last first."""
    return files.filter(F.col("name").rlike(r"\.sst$")).orderBy(F.col("name").desc())


def running_usage(requests: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """`requests` with used: what earlier requests of the group took."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return requests.withColumn("used", F.coalesce(F.sum(size).over(w), F.lit(0)))


def route_access(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """`requests` (method, path, granted) with answer: 404 for unknown paths, 405 for other methods, 403 without the route's permission.

    `routes` (path, method, needed) is a fixed table of a few dozen rows.
    """
    known = routes.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("method", "needed"))).alias("methods"))
    both = requests.join(known, "path", "left")
    needed = F.try_element_at("methods", F.col("method"))
    answer = F.when(F.col("methods").isNull(), 404).when(needed.isNull(), 405).when(F.col("granted").bitwiseAND(needed) == needed, 200).otherwise(403)
    return both.withColumn("answer", answer.cast("long")).drop("methods")


def collect_files(spark: SparkSession, root: str, excluded: str = r"/(\.git|vendor|node_modules|testdata)/") -> DataFrame:
    """(path, length) of the files below a folder but for excluded ones; contents are read only if a rule asks for them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.filter(~F.col("path").rlike(excluded)).select("path", "length")
