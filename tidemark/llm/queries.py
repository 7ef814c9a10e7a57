"""The thin contract queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, exact_dedup, html_extract, langid, mixing, ngram_join, quality, sampling, secrets, suffix_dedup, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination_digest(decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark"), out="c", keep=["doc_id"]))


def contamination_digest(found: DataFrame) -> DataFrame:
    n_words, n_hit = F.col("c.n_words"), F.col("c.n_hit")
    return found.select(
        "doc_id",
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("c.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("c.items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= n_words)).alias("contaminated"),
    )


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS n, array_to_string(words[i : i + least(13, len(words)) - 1], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS i FROM items WHERE len(words) > 0)
), starts AS (
  SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM wins) WHERE len(words) >= n)
), hits AS (
  SELECT doc_id, i, starts.n, item_id FROM starts JOIN wins USING (win)
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


OP2_SQL = f"""
WITH t AS (SELECT doc_id, {_FOLD.format("coalesce(text, '')")} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM t WINDOW g AS (PARTITION BY body)
"""


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


#: A source's slots take its shuffled words in order, around and around, so the words of a document are taken as often as whole rounds go,
#: and once more as far as the last round reaches; the SQL needs no slots.
OP4_SQL = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS h
  FROM documents
), per AS (
  SELECT source, sum(size) AS source_size, 3 * sum(size) AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s GROUP BY source
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER (l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER l AS n
  FROM per WINDOW l AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST)
), goal AS (
  SELECT source, source_size, coalesce(least((SELECT arg_min(level, n) FROM levels WHERE level * weight <= cap) * weight, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // CAST(source_size AS BIGINT) ELSE 0 END AS around FROM goal
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM s
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(around * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - around * source_size - ahead)) AS BIGINT) AS taken
FROM placed JOIN plan ON placed.source IS NOT DISTINCT FROM plan.source
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = sampling.crc_part("doc_id", 4) == 2
    model = langid.train(docs.filter(~held))
    found = langid.identify(docs.select("doc_id", "text"), model, out="l", keep=["doc_id"])
    return found.select("doc_id", held.alias("held_out"), F.col("l.lang_pred").alias("lang_pred"), F.col("l.score").alias("score"))


def op5_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = sampling.crc_part("doc_id", 3) == 1
    forest = quality.train(docs, _table(spark, sf_dir, "labels").filter(~held).select("doc_id", "quality"))
    found = quality.score(docs, forest, out="q", keep=["doc_id"])
    score = F.col("q.score")
    return found.select("doc_id", held.alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def op9_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    found = url_filter.judge(pages, URL_RULES, out="f", keep=["page_id"])
    return found.select("page_id", *(F.col(f"f.{c}").alias(c) for c in ("host", "path", "rule", "verdict")))


OP9_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, {_FOLD.format("regexp_extract(r, '^[^/?#]*')")} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(verdict, h, p) AS (
  VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}
), fits AS (
  SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, h || p) AS n
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE n = 1) f USING (page_id)
"""


def op10_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs), out="s", keep=["doc_id"])

    def listed(spans: F.Column) -> F.Column:
        ranked = F.transform(spans, lambda x: F.struct(x["start"], F.array_position(F.array(*map(F.lit, secrets.KINDS)), x["kind"]).alias("k"), x["end"], x["kind"]))
        return F.array_join(F.transform(F.array_sort(ranked), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("s.base", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in secrets.KINDS[:3]),
        F.sha2(listed(F.col("s.base")), 256).alias("base_sha256"),
        listed(F.concat("s.base", "s.added")).alias("spans"),
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.join_components(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


OP7_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT x AS doc_id, x AS r FROM both_ways UNION SELECT y, r FROM reach JOIN both_ways ON doc_id = x
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Texts as hexadecimal digits, cut into pieces of 1,000 bytes and the 49 after them, which hold every string of 50 bytes once.
OP8_SQL = """
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), pieces AS (
  SELECT doc_id, k, substr(x, 2000 * k + 1, 2098) AS piece FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2000 + 1)) AS k FROM t)
), w AS (
  SELECT doc_id, 1000 * k + j AS p, substr(piece, 2 * j + 1, 100) AS win
  FROM (SELECT doc_id, k, piece, unnest(range(0, greatest(0, least(1000, len(piece) // 2 - 49)))) AS j FROM pieces)
), first AS (
  SELECT win, min(doc_id) AS least FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)
), hits AS (
  SELECT doc_id, p, p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 AS gap FROM w JOIN first USING (win) WHERE doc_id > least
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT doc_id, p, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hits) GROUP BY doc_id, run
), gone AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
), edges AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM runs
  UNION ALL SELECT t.doc_id, coalesce(max(b), 0), any_value(len(x)) // 2 FROM t LEFT JOIN runs USING (doc_id) GROUP BY t.doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(x, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS y FROM edges JOIN t USING (doc_id) GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(y, ''))) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_mix_sources": op4_mix_sources,
    "op5_extract_html": op5_extract_html,
    "op6_quality": op6_quality,
    "op7_ngram_join": op7_ngram_join,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_filter_urls": op9_filter_urls,
    "op10_find_secrets": op10_find_secrets,
}
SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op4_mix_sources": OP4_SQL, "op7_ngram_join": OP7_SQL, "op8_suffix_dedup": OP8_SQL, "op9_filter_urls": OP9_SQL}
