"""The contract queries on the smallest tables, against SQL where there is some, and what the models reach on held-out rows."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from tests.llm.common import SCHEMA, corpus, with_oddities
from tests.test_catalog import SF, TABLES, rows
from tidemark.llm import queries


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rel = duck.sql(queries.SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())


def test_language_on_held_out_rows(spark, duck):
    got = {r["doc_id"]: r for r in queries.op3_language_id(spark, SF).collect()}
    langs = duck.sql("select doc_id, lang from documents").fetchall()
    held = [(got[d]["lang_pred"], lang) for d, lang in langs if got[d]["held_out"]]
    assert len(got) == len(langs) and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_quality_on_held_out_rows(spark, duck):
    got = {r["doc_id"]: r for r in queries.op6_quality(spark, SF).collect()}
    labels = duck.sql("select doc_id, quality from labels").fetchall()
    held = [(got[d]["predicted"], q) for d, q in labels if got[d]["held_out"]]
    assert held and sum(a == b for a, b in held) >= 0.85 * len(held)


def test_secrets_and_pages(spark, duck):
    found = queries.op10_find_secrets(spark, SF).collect()
    assert len(found) == duck.sql("select count(*) from documents").fetchall()[0][0]
    assert all((r["n_assign"] + r["n_access"] + r["n_hex"] > 0) <= bool(r["spans"]) for r in found)
    pages = queries.op5_extract_html(spark, SF).collect()
    assert len(pages) == duck.sql("select count(*) from pages").fetchall()[0][0] and all("<p>" not in r["text"] for r in pages)


def test_mix_reaches_targets(spark):
    by: dict = {}
    for r in queries.op4_mix_sources(spark, SF).collect():
        x = by.setdefault((r["source_size"], r["target"]), [0, 0])
        x[0] += r["taken"]
        x[1] += r["size"]
    assert all(abs(taken - target) <= 1 and size == source_size for (source_size, target), (taken, size) in by.items())


def test_pipeline_stages_decide_on_their_own_input(spark, tmp_path):
    """Each stage against what its contract says about the rows that the stage before left."""
    import re

    docs = spark.createDataFrame(with_oddities(corpus()), SCHEMA)
    docs.write.parquet(str(tmp_path / "in"))
    bench = [(1, " ".join(next(t for _, t, *_ in corpus() if t and len(t.split()) > 60).split()[:40]))]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.read.parquet(str(tmp_path / "in"))
    before = df.collect()
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        df = spark.read.parquet(str(tmp_path / str(k)))
        assert df.columns == docs.columns
        kept.append(df.collect())
    fold = lambda r: (r["text"] or "").translate({c: c + 32 for c in range(65, 91)})
    assert len(kept[0]) == sum(any(c.isalpha() for c in r["text"] or "") for r in before)
    assert len(kept[1]) == len({fold(r) for r in kept[0]}) == len({fold(r) for r in kept[1]})
    near = {(r["doc_id"], r["text"]) for r in kept[2]}
    assert len(near) == len(kept[2]) < len(kept[1]) and near <= {(r["doc_id"], r["text"]) for r in kept[1]}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    window = {tuple(words(bench[0][1])[i : i + 13]) for i in range(28)}
    has = lambda r: any(tuple(words(r["text"])[i : i + 13]) in window for i in range(len(words(r["text"])) - 12))
    assert not any(has(r) for r in kept[3] if len(words(r["text"])) < 250)
    assert {r["doc_id"] for r in kept[2] if not has(r)} <= {r["doc_id"] for r in kept[3]}
    last = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).collect()
    assert len(last) == len(kept[3])


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "size", "taken"} <= set(out.columns) and out.count() > 100


def test_language_stage_without_languages(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words", None, "a", 10), (2, "12 !?", None, "a", 5), (3, None, None, "a", None), (4, "\u6f22\u5b57", None, "a", 2)], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == [1, 4]


def test_near_copies_with_repeated_ids(spark, tmp_path):
    from tidemark.llm import ngram_join

    texts = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[1] + " end"), (1, texts[2]), (3, texts[2] + " end"), (None, texts[3]), (4, texts[3] + " end"), (1, texts[0])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = ngram_join.drop_near_copies(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(1, texts[0]), (1, texts[1]), (1, texts[2]), (4, texts[3] + " end")])


def test_language_sample_has_every_language(spark):
    """Texts too long for the sample, and a language of one row among many, still give a model; odd rows get defined results."""
    from tidemark.llm import langid, sampling

    words = {"xx": "alba bela cola", "yy": "dern erof fgil", "zz": "hyn iqu jzo"}
    rows = [(i, (words["xx"] + " ") * 40, "xx", "a", 1) for i in range(300)] + [(400 + i, words["yy"] * 60, "yy", "a", 1) for i in range(40)] + [(500, words["zz"] * 300, "zz", "a", 1), (501, None, "zz", "a", 1)]
    docs = spark.createDataFrame(with_oddities(rows), SCHEMA)
    sample = sampling.per_label(docs, "doc_id", "text", "lang", 60, 4000).collect()
    assert {r["lang"] for r in sample} >= {"xx", "yy", "zz"} and len(sample) < 200
    long = spark.createDataFrame([(i, words[k] * 5000, k, "a", 1) for i, k in enumerate(words)], SCHEMA)
    model = langid.train(long, fit_rows=10, fit_bytes=1000)
    assert model.labels == ["xx", "yy", "zz"]
    got = {r["doc_id"]: r["language_"] for r in langid.identify(docs.withColumn("language", docs["lang"]), model).collect()}
    assert got[500]["lang_pred"] == "zz" and got[400]["lang_pred"] == "yy" and got[501] == ("und", 0.0)
    none = langid.train(docs.filter("doc_id < 0"))
    assert none.labels == [] and {r["language"] for r in langid.identify(docs, none).collect()} == {("und", 0.0)}


def test_language_stage_drops_what_no_language_claims(spark):
    words = {"xx": "alba bela cola", "yy": "dern erof fgil", "zz": "hyn iqu jzo"}
    rows = [(10 * i + j, f"{words[k]} " * 20, k, "a", 1) for i in range(30) for j, k in enumerate(words)]
    docs = spark.createDataFrame([*rows, (9000, "vwv " * 30, None, "a", 1), (9001, "42 !", None, "a", 1)], SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert {r[0] for r in rows} <= kept and not kept & {9000, 9001}
