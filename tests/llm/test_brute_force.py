"""Results of the operators against plain Python that follows their contracts word by word."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.common import SCHEMA, clashing, corpus, with_oddities
from tidemark.llm import decontaminate, exact_dedup, mixing, ngram_join, secrets, suffix_dedup
from tidemark.llm.queries import contamination_digest

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def items():
    rows = [t for _, t, *_ in corpus() if t]
    long = [t for t in rows if 30 < len(t.split()) < 300]
    pieces = [" ".join(t.split()[5 : 5 + n]) for t, n in zip(long, (13, 20, 12, 3, 1, 40), strict=False)]
    return [*enumerate(pieces), (2, pieces[0]), (50, None), (51, " .. "), (None, pieces[1]), (7, pieces[1].upper())]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, block_bytes):
    rows = with_oddities(corpus())
    bench = items()
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = []
    for i, t in bench:
        w = words(t)
        n = min(13, len(w))
        windows += [(i, w[k : k + n]) for k in range(len(w) - n + 1)] if n else []
    want = Counter()
    for d, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    found |= {str(i)} if i is not None else set()
        ids = sorted(found)
        want[(d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    docs = clashing(frame(spark, rows), "contamination", "items", "n_words")
    got = decontaminate.find_contamination(docs, spark.createDataFrame(bench, "item_id long, text string"), out="c", keep=["doc_id"], block_bytes=block_bytes)
    assert Counter(tuple(r) for r in contamination_digest(got).collect()) == want
    assert any(k[5] for k in want)


def test_contamination_keeps_columns_and_takes_free_names(spark):
    docs = clashing(frame(spark, corpus(8)), "contamination")
    out = decontaminate.find_contamination(docs, spark.createDataFrame([], "item_id long, text string"))
    assert out.columns == [*docs.columns, "contamination_"]
    assert {r["contamination_"]["n_hit"] for r in out.collect()} == {0}


def test_exact_dedup(spark):
    rows = with_oddities(corpus())
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[(t or "").translate(FOLD)].append(d)
    got = exact_dedup.exact_groups(clashing(frame(spark, rows), "key", "uid", "sha", "id")).collect()
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        kept[r["sha"]] += r["kept"]
    for body, ids in groups.items():
        sha = hashlib.sha256(body.encode()).hexdigest()
        best = max((i for i in ids if i is not None), default=None)
        mine = [r for r in got if r["sha"] == sha]
        assert Counter(r["id"] for r in mine) == Counter(ids)
        assert {(r["keep_id"], r["group_size"]) for r in mine} == {(best, len(ids))}
        assert kept[sha] == 1 and next(r["id"] for r in mine if r["kept"]) == best


def test_ngram_join(spark):
    rows = with_oddities(corpus())
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
                links += sets[i] != sets[j]
    assert links > 5
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    want = Counter((r[0], len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None)) for i, r in enumerate(rows))
    got = ngram_join.join_components(clashing(frame(spark, rows), "key", "n", "component", "tokens"))
    assert Counter((r["id"], r["n"], r["component"]) for r in got.collect()) == want


def test_equal_keys_of_different_texts_are_told_apart(spark):
    """With keys of few bits nearly all texts share one with others; the results stay."""
    docs = frame(spark, with_oddities(corpus(30)))
    for call, columns in ((ngram_join.join_components, ("id", "n", "component")), (suffix_dedup.repeated_spans, ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))):
        want, got = (Counter(tuple(r[c] for c in columns) for r in call(docs, key_bits=bits).collect()) for bits in (64, 4))
        assert want == got


def test_later_links_find_what_tiles_miss(spark):
    """Without any help of tiles the join on prefix tokens alone finds every link."""
    import numpy as np
    from pyspark.sql import functions as F

    from tidemark.llm import blocks, scratch
    from tidemark.llm.components import connected_components

    docs = frame(spark, corpus(80, seed=4))
    found = scratch.table(ngram_join.candidates(docs, "doc_id", "text", blocks.Layout(1 << 20)), "t")
    links = ngram_join.later_links(found.withColumn("comp", F.col("key")))
    labels = {r["node"]: r["root"] for r in connected_components(links).collect()}
    rows = {r["key"]: (r["n"], np.frombuffer(r["tokens"], np.uint64)) for r in found.collect()}
    parent = {k: k for k in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(rows)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            (n, x), (m, y) = rows[a], rows[b]
            both = len(np.intersect1d(x, y))
            if 100 * both >= 75 * (n + m - both):
                parent[root(a)] = root(b)
    same = lambda f: {frozenset(k for k in keys if f(k) == v) for v in {f(k) for k in keys}}
    assert same(root) == same(lambda k: labels.get(k, k))
    assert len(same(root)) < len(keys)


def test_suffix_dedup(spark):
    rows = with_oddities(corpus())
    top = (1 << 63) - 1
    order = sorted(range(len(rows)), key=lambda i: top if rows[i][0] is None else rows[i][0])
    seen: dict[bytes, int] = {}
    want = Counter()
    for i in order:
        d = top if rows[i][0] is None else rows[i][0]
        body = (rows[i][1] or "").encode()
        gone = bytearray(len(body))
        for k in range(len(body) - 49):
            if seen.setdefault(body[k : k + 50], d) < d:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        want[(rows[i][0], len(body), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    got = suffix_dedup.repeated_spans(clashing(frame(spark, rows), "key", "spans", "block")).collect()
    assert Counter((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert sum(r["n_removed"] for r in got) > 1000
    for r in got:
        edge = [int.from_bytes(r["spans"][k : k + 8], "little") for k in range(0, len(r["spans"]), 8)]
        assert sum(b - a for a, b in zip(edge[::2], edge[1::2], strict=True)) == r["n_removed"]


def test_secret_patterns(spark):
    text = 'é token = "abc1234" Password:\'x\' API_KEY=ABCDEFGH AKIA' + "Q" * 16 + " AKIA123 " + "0af" * 10 + " secret:short token=" + "z" * 40
    rows = [(1, text), (2, None), (3, ""), (4, "plain words only"), (1, text)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), None).collect()
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = [("assign", *m.span()) for m in pattern.finditer(text) if len(m[2]) >= 6]
    want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert len(want) == 5
    for r in got:
        spans = [tuple(x) for x in r["secrets"]["base"]]
        assert sorted(spans) == (sorted(want) if r["doc_id"] == 1 else [])


def test_mixing(spark):
    rows = with_oddities(corpus())
    df = frame(spark, rows)
    got = mixing.mix(clashing(df, "taken", "size", "h")).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in size if s is not None), key=str) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, left, open_ = {}, sum(size.values()), set(names)
    while True:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: unit * weight[s] for s in open_}
    by_size = {(size[s], round(target[s], 6)): s for s in names}
    taken = Counter()
    for r in got:
        taken[by_size[(r["source_size"], round(r["target"], 6))]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mix(df.repartition(5)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, got))


@pytest.mark.parametrize("sizes", [{"a": 7}, {"a": 1, "b": 1000, "c": 3}, {"a": 5, "b": 0}, {"a": 0}, {"x": 100, "y": 1, "z": 1, "w": 1}])
def test_mixing_small_and_capped_sources(spark, sizes):
    rows = [(i, "w " * n, None, s, None) for i, (s, n) in enumerate(sizes.items())]
    got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA), block_words=16).collect()}
    assert all(r["taken"] <= 3 * r["size"] and abs(r["taken"] - r["target"]) <= 1 for r in got.values())
    assert abs(sum(r["taken"] for r in got.values()) - sum(sizes.values())) <= len(sizes)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", None, None, 0)]])
def test_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    n = len(rows)
    assert len(exact_dedup.exact_groups(df).collect()) == n
    assert len(ngram_join.join_components(df).collect()) == n
    assert len(suffix_dedup.repeated_spans(df).collect()) == n
    assert len(mixing.mix(df).collect()) == n
    assert len(decontaminate.find_contamination(df, spark.createDataFrame(items(), "item_id long, text string")).collect()) == n
    assert len(secrets.scan(df, secrets.train(df)).collect()) == n


def test_decontamination_with_many_windows(spark):
    """Thousands of windows, whose prefix hashes stand on both sides of 2**63: each planted passage is found, clean texts stay clean."""
    import numpy as np

    rng = np.random.default_rng(4)
    word = lambda: "w" + str(int(rng.integers(0, 4000)))
    bench = [(i, " ".join(word() for _ in range(30))) for i in range(400)]
    index = decontaminate.WindowIndex(bench)
    index.choose({w: np.ones(len(k), np.int64) for w, k in index.shingles.items()})
    keys = index.prefix[decontaminate.SHINGLE][0]
    assert len(index.texts) > 5000 and keys.dtype == np.uint64 and keys.min() < 1 << 63 <= keys.max()
    assert not set(keys.tolist()) - {int(x) for _, t in bench for x in decontaminate.gram_hashes(decontaminate._hash_words(t.encode().split()), 5)}
    rows = []
    for i, t in bench:
        rows.append((i, " ".join([*(word() for _ in range(20)), *t.split()[9:23], *(word() for _ in range(20))])))
        rows.append((1000 + i, " ".join(word() for _ in range(50))))
    got = decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), out="c", keep=["doc_id"])
    for r in got.collect():
        assert (r["c"]["n_hit"], r["c"]["items"]) == ((14, [str(r["doc_id"])]) if r["doc_id"] < 1000 else (0, []))


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_of(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def secret_texts():
    import random

    rng = random.Random(8)
    make = [
        lambda: f"{rng.choice(['password', 'PassWd', 'secret', 'Token', 'api_key', 'APIKEY', 'tokKen', 'pass word'])}{rng.choice(['', chr(34), chr(39)])}{' ' * rng.randrange(3)}{rng.choice([':', '=', '=>'])}{rng.choice(['', ' ', ' ' + chr(34)])}"
        + "".join(rng.choice("abXY09+/_.=-") for _ in range(rng.randrange(1, 14))),
        lambda: "AKIA" + "".join(rng.choice("ABC019") for _ in range(rng.randrange(10, 22))),
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(18, 44))),
        lambda: rng.choice(["漢字", "\U0001f600", "é", "word", "x" * 30, "12345678901234567890123456", "\n"]),
    ]
    texts = [" ".join(rng.choice(make)() for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    return [*texts, None, "", "token=", "AKIA", "word " * 30_000 + "token = 'abcdef123456'", "ab12" * 20_000]


def test_base_spans_of_secrets_with_a_field(spark):
    rows = [(i, t, None, "a", 1) for i, t in enumerate(secret_texts())]
    docs = clashing(frame(spark, with_oddities(rows)), "base", "added", "s")
    field = secrets.train(docs)
    assert field is not None
    got = secrets.scan(docs, field, out="s").collect()
    assert Counter((r["doc_id"], tuple((x["kind"], x["start"], x["end"]) for x in r["s_"]["base"])) for r in got) == Counter((r[0], tuple(base_of(r[1] or ""))) for r in with_oddities(rows))
    for r in got:
        base = r["s_"]["base"]
        assert all(not (x["start"] < b["end"] and b["start"] < x["end"]) for x in r["s_"]["added"] for b in base) and r["s"] == "mine"
    empty = docs.filter("false")
    assert secrets.train(empty) is None and secrets.scan(empty, None).collect() == []
    assert secrets.train(docs.filter("text is null or text = ''")) is None


def test_field_finds_secrets_of_other_kinds():
    """Kinds that are neither patterns nor planted in training: most are found, and clean texts with numbers and addresses stay clean."""
    import random
    import string

    import pyarrow as pa

    from tests.llm.common import prose

    rng = random.Random(12)
    alnum = string.ascii_letters + string.digits
    field = secrets.fit([prose(rng, 120) + ' token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"' + prose(rng, 30) for _ in range(60)] + [prose(rng, 150) for _ in range(60)])
    kinds = [
        lambda: "ghp_" + "".join(rng.choice(alnum) for _ in range(36)),
        lambda: ".".join("".join(rng.choice(alnum + "-_") for _ in range(n)) for n in (36, 60, 43)),
        lambda: "".join(rng.choice("0123456789ABCDEF") for _ in range(32)),
        lambda: "sk-" + "".join(rng.choice(alnum) for _ in range(24)),
    ]
    for make in kinds:
        texts, want = [], []
        for _ in range(60):
            left, value = prose(rng, 20), make()
            texts.append(f"{left} {value} {prose(rng, 20)}")
            want.append((len(left) + 1, len(left) + 1 + len(value)))
        found = secrets._scan(field, pa.array(texts, pa.large_string())).to_pylist()
        assert sum(any(x["start"] < b and a < x["end"] for x in r["added"]) for r, (a, b) in zip(found, want, strict=True)) >= 54
        assert not any(x["end"] <= a or x["start"] >= b for r, (a, b) in zip(found, want, strict=True) for x in r["added"])
    clean = [prose(rng, 60) + " 4111 1111 1111 1111, 9807915762804490 of 2024-01-31, 10.20.30.40, jo.doe@mail.example.com https://www.example.com/en/page-12.html +1 (555) 123-4567 v1.20.3 HelloBigWorld snake_case_name" for _ in range(50)]
    assert not any(r["added"] for r in secrets._scan(field, pa.array(clean, pa.large_string())).to_pylist())
