"""Queries on the client, the codecs of log and keys, tables and the manifest as they are written and read, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import bloom, codec
from tidemark.operators import ingest, levels, manifest, merge, recovery, resolve, validate
from tidemark.plans.catalog_kv import FS, L, Query, shown
from tidemark.sources import testdata as D
from tidemark.sources import wal

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# --- the client


def _key(n: int) -> bytes:
    return f"user:{n:010d}".encode()


def _key_sql(n: int) -> str:
    return f"'user:{n:010d}'"


#: What the client writes: a put, a delete, a batch whose last put of a key wins, and a key that the log has not.
_WRITES = [(1, 1, "new"), (2, 2, None), (3, 1, "first"), (4, 2, None), (3, 1, "last"), (9_999_999, 1, "")]
_WRITTEN = "X AS (SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, {_key_sql(k)}, {op}, {'NULL' if v is None else repr(v)})" for i, (k, op, v) in enumerate(_WRITES)) + ") t(n, key, op, value))"
_AFTER = f"{L}, {_WRITTEN}, L2 AS (SELECT key, seq, op, value FROM L UNION ALL SELECT key, (SELECT max(seq) FROM L) + n, op, value FROM X), N2 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, op DESC) AS rn FROM L2)"


def _client(spark, sf_dir) -> ingest.Store:
    store = ingest.Store(spark, D.mutation_log(spark, sf_dir))
    store.put(_key(1), b"new")
    store.delete(_key(2))
    store.batch(ingest.WriteBatch().put(_key(3), b"first").delete(_key(4)).put(_key(3), b"last"))
    store.put(_key(9_999_999), b"")
    return store


@query(f"WITH {_AFTER} SELECT key, seq, value FROM N2 WHERE rn = 1 AND op = 1")
def client_writes(spark, sf_dir):
    """The live state after single writes and a batch of the client."""
    return shown(resolve.live(_client(spark, sf_dir).log))


@query(f"WITH {_AFTER}, S AS (SELECT sum(27 + strlen(key) + coalesce(strlen(value), 0)) AS bytes, count(*) AS n, max(seq) AS last FROM L2), K AS (SELECT count(*) FILTER (op = 1) AS live, count(*) FILTER (op = 2) AS gone FROM N2 WHERE rn = 1) "
       """SELECT '{"state":{"last_seq":' || last || ',"revisions":' || n || '},"storage":{"live_keys":' || live || ',"tombstones":' || gone || ',"bytes":' || bytes || '}}' AS stats FROM S, K""")  # fmt: skip
def server_stats(spark, sf_dir):
    return ingest.stats_json(_client(spark, sf_dir).log)


@query(f"""WITH {_AFTER}, V AS (SELECT key, value FROM N2 WHERE rn = 1 AND op = 1)
  SELECT CAST(i AS BIGINT) AS i, CASE kind WHEN 'get' THEN coalesce((SELECT value FROM V WHERE V.key = q.key), '(none)') WHEN 'exists' THEN CASE WHEN q.key IN (SELECT key FROM V) THEN 'true' ELSE 'false' END ELSE text END AS answer
  FROM (VALUES (0, 'get', {_key_sql(1)}, ''), (1, 'exists', {_key_sql(2)}, ''), (2, 'put', '', '(none)'), (3, 'text', '', 'again'), (4, 'del', '', '(none)'), (5, 'text', '', '(none)'), (6, 'text', '', 'false'), (7, 'get', {_key_sql(3)}, '')) q(i, kind, key, text)""")
def pipeline_answers(spark, sf_dir):
    """Reads between the writes of one pipeline see the writes before them."""
    p = _client(spark, sf_dir).pipeline()
    p.get(_key(1)).exists(_key(2)).put(_key(5), b"again").get(_key(5)).delete(_key(5)).get(_key(5)).exists(_key(5)).get(_key(3))
    text = lambda x: "(none)" if x is None else str(x).lower() if isinstance(x, bool) else x.decode()
    return spark.createDataFrame([(i, text(x)) for i, x in enumerate(p.execute())], "i long, answer string")


# --- keys and frames


@query(f"WITH {L} SELECT seq, CASE WHEN seq % 7 = 0 THEN FALSE WHEN seq % 11 = 0 THEN FALSE ELSE TRUE END AS ok FROM L")
def encoded_key_checks(spark, sf_dir):
    """Encoded keys, every seventh cut short and every eleventh with an unknown operation."""
    log = D.mutation_log(spark, sf_dir).select("seq", codec.internal_key().alias("k"))
    broken = F.when(F.col("seq") % 7 == 0, F.expr("substring(k, 1, 9)")).when(F.col("seq") % 11 == 0, F.expr("substring(k, 1, octet_length(k) - 1) || unhex('07')")).otherwise(F.col("k"))
    return log.withColumn("k2", broken).select("seq", validate.encoded_key_ok("k2").alias("ok"))


@query(f"""WITH {L}, P AS (SELECT seq, key, op, lag(key) OVER w AS k, lag(seq // 3) OVER w AS s, lag(op) OVER w AS o FROM L WINDOW w AS (ORDER BY seq))
  SELECT seq, CAST(CASE WHEN key < k THEN -1 WHEN key > k THEN 1 WHEN seq // 3 > s THEN -1 WHEN seq // 3 < s THEN 1 WHEN op > o THEN -1 WHEN op < o THEN 1 ELSE 0 END AS BIGINT) AS cmp FROM P WHERE k IS NOT NULL""")
def internal_key_order(spark, sf_dir):
    """Each revision against the one before it, with numbers that repeat so that operations decide too."""
    log = D.mutation_log(spark, sf_dir).select("seq", F.struct("key", F.expr("seq div 3").alias("seq"), "op").alias("a"))
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("a").alias("b"))
    return log.join(before, "seq").select("seq", codec.compare_internal("a", "b").cast("long").alias("cmp"))


_FRAMES = f"""{L}, R AS (SELECT event_id // 1000 AS segment, event_id % 1000 AS pos, 27 + strlen(key) + coalesce(strlen(value), 0) AS bytes, op AS type, seq, key, coalesce(value, '') AS value FROM L),
  O AS (SELECT *, CAST(coalesce(sum(bytes) OVER (PARTITION BY segment ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off, max(pos) OVER (PARTITION BY segment) AS last FROM R)"""


def _frames(spark, sf_dir):
    log = D.mutation_log(spark, sf_dir).withColumn("segment", F.expr("event_id div 1000"))
    return wal.encoded(log.select("segment", F.col("op").alias("type"), "seq", (F.col("seq") * 1000).alias("ts_ns"), "key", "value"))


@query(f"WITH {_FRAMES} SELECT segment, pos, off, CAST(bytes AS BIGINT) AS bytes, CAST(type AS BIGINT) AS type, seq, seq * 1000 AS ts_ns, key, value, 'ok' AS status FROM O")
def wal_round_trip(spark, sf_dir):
    """The log as framed segments, decoded again."""
    return shown(wal.decoded(_frames(spark, sf_dir)).withColumnRenamed("offset", "off"))


@query(f"""WITH {_FRAMES}, D AS (SELECT *, CASE segment % 3 WHEN 1 THEN CASE WHEN pos = last THEN 'torn' ELSE 'ok' END WHEN 2 THEN CASE WHEN pos = 0 THEN 'crc' ELSE 'ok' END ELSE 'ok' END AS status FROM O)
  SELECT segment, count(*) AS records, max(status) FILTER (status <> 'ok') AS problem FROM D WHERE segment % 3 <> 2 OR pos = 0 GROUP BY segment""")
def wal_damage(spark, sf_dir):
    """Segments without their last three bytes, and with a changed byte in the first frame."""
    cut = F.expr("substring(content, 1, octet_length(content) - 3)")
    changed = F.expr("substring(content, 1, 13) || unhex('EE') || substring(content, 15)")
    broken = _frames(spark, sf_dir).withColumn("content", F.when(F.col("segment") % 3 == 1, cut).when(F.col("segment") % 3 == 2, changed).otherwise(F.col("content")))
    return wal.decoded(broken).groupBy("segment").agg(F.count(F.lit(1)).alias("records"), F.max(F.when(F.col("status") != "ok", F.col("status"))).alias("problem"))


@query("SELECT user_id, CAST(10 * count(DISTINCT event_id) AS BIGINT) AS bits, TRUE AS same FROM events GROUP BY user_id HAVING count(DISTINCT event_id) > 0")
def bloom_block_codec(spark, sf_dir):
    """Filter blocks of every user's events, encoded and decoded."""

    @F.pandas_udf("bits long, same boolean")
    def there_and_back(n):
        import pandas as pd

        rows = []
        for keys in n:
            bits = bloom.filter_bits(int(keys))
            body = bytes((i * 37 + int(keys)) % 256 for i in range((bits + 7) // 8))
            back = bloom.decode_filter(bloom.encode_filter(body, bits))
            rows.append((back[1], back == (body, bits, bloom.PROBES)))
        return pd.DataFrame(rows, columns=["bits", "same"])

    per = D.table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("event_id").alias("n"))
    return per.select("user_id", there_and_back("n").alias("b")).select("user_id", "b.*")


# --- scans, tables and plans


@query(f"WITH {L} SELECT key, seq, CAST(op AS BIGINT) AS op, row_number() OVER (PARTITION BY key ORDER BY seq DESC, op DESC) AS revision FROM L")
def kv_scan(spark, sf_dir):
    """All revisions in canonical order; the place inside the key is told from the order of the scan."""
    rows = resolve.scan(D.mutation_log(spark, sf_dir)).withColumn("at", F.monotonically_increasing_id())
    least = rows.groupBy("key").agg(F.sort_array(F.collect_list("at")).alias("all"))
    return shown(rows.join(least, "key").select("key", "seq", "op", F.array_position("all", F.col("at")).alias("revision")))


@query(f"WITH {FS}, K AS (SELECT DISTINCT file_num, key, max(seq) OVER (PARTITION BY file_num, key) AS seq FROM LF) SELECT K.file_num, K.key, K.seq, CASE WHEN LF.op = 1 THEN 'put' ELSE 'deleted' END AS state FROM K JOIN LF USING (file_num, key, seq)")
def table_lookup(spark, sf_dir):
    """Every key looked up in each file that has it."""
    rows = D.with_file(D.mutation_log(spark, sf_dir))
    last = rows.groupBy("file_num", "key").agg(F.max_by(F.struct("seq", "op"), F.struct("seq", "op")).alias("x"))
    state = F.when(F.col("x.op") == S.PUT, "put").otherwise("deleted")
    return shown(last.select("file_num", "key", F.col("x.seq").alias("seq"), state.alias("state")))


@query(f"WITH {L} SELECT 0 AS level, CAST(user_id % 5 AS BIGINT) AS file_num, CAST(sum(27 + strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS file_size, min(key) AS smallest_key, max(key) AS largest_key, min(seq) AS smallest_seq, max(seq) AS largest_seq FROM L GROUP BY user_id % 5")
def memtable_flush(spark, sf_dir):
    """The manifest rows of five frozen tables."""
    log = D.mutation_log(spark, sf_dir)
    out = None
    for i in range(5):
        one = merge.flush(log.filter(F.col("user_id") % 5 == i), i)
        out = one if out is None else out.unionByName(one)
    return shown(out)


@query(f"""WITH {FS}, C AS (SELECT CASE WHEN file_num % 2 = 0 THEN 'source' ELSE 'target' END AS role, level, file_num FROM F UNION ALL SELECT 'source', level, file_num FROM F WHERE file_num % 6 = 0)
  SELECT 'wrong level' AS problem, file_num FROM C WHERE level <> CASE role WHEN 'source' THEN 1 ELSE 2 END UNION ALL SELECT 'file twice', file_num FROM C GROUP BY file_num HAVING count(*) > 1""")
def plan_problems(spark, sf_dir):
    f = D.files(spark, sf_dir).select(F.when(F.col("file_num") % 2 == 0, "source").otherwise("target").alias("role"), "level", "file_num")
    return shown(levels.plan_problems(f.unionByName(f.filter("file_num % 6 = 0").withColumn("role", F.lit("source"))), 1))


@query(f"WITH {FS} SELECT greatest(300, (SELECT max(seq) FROM L)) + 1 AS next_seq, greatest(7, (SELECT max(file_num) FROM F) + 1, 1) AS next_file")
def recovery_next_numbers(spark, sf_dir):
    return recovery.next_numbers(300, D.mutation_log(spark, sf_dir), 7, D.files(spark, sf_dir).select("file_num"))


@query(f"""WITH {FS} SELECT CAST(level AS BIGINT) AS level, file_num, CAST(file_size AS BIGINT) AS file_size, smallest_key, largest_key, smallest_seq, largest_seq FROM F WHERE level > 0 OR file_num > 3
  UNION ALL SELECT 1, 100 + file_num, CAST(file_size AS BIGINT), smallest_key, largest_key, smallest_seq, largest_seq FROM F WHERE file_num <= 3""")
def manifest_edits(spark, sf_dir):
    """The version after an edit that adds all files and one that moves three of them a level down."""
    f = D.files(spark, sf_dir)
    add = f.select(F.lit("add").alias("action"), "*", F.lit(1).cast("long").alias("edit_no"))
    moved = f.filter("file_num <= 3")
    gone = moved.select(F.lit("delete").alias("action"), "level", "file_num", F.lit(2).cast("long").alias("edit_no"))
    down = moved.withColumn("file_num", F.col("file_num") + 100).withColumn("level", F.lit(1).cast("long")).select(F.lit("add").alias("action"), "*", F.lit(2).cast("long").alias("edit_no"))
    out = manifest.replay(add.unionByName(gone, allowMissingColumns=True).unionByName(down, allowMissingColumns=True))
    return shown(out, "level", "file_num", "file_size", "smallest_key", "largest_key", "smallest_seq", "largest_seq")
