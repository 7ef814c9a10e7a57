"""The data structures and models behind the operators."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.common import prose
from tidemark.llm import html_extract, langid, quality, secrets, suffix_dedup, url_filter
from tidemark.llm.components import connected_components
from tidemark.llm.ngram_join import Tile
from tidemark.llm.quotient import CountingQuotientFilter


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 1 << 12, n, dtype=np.uint64) << np.uint64(50) for n in (0, 1, 700, 5000)] + [np.full(600, 77, np.uint64)]
    merged = CountingQuotientFilter.merge(CountingQuotientFilter.from_bytes(CountingQuotientFilter.build(p).to_bytes()) for p in parts)
    keys, counts = CountingQuotientFilter.from_bytes(merged.to_bytes()).items()
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == dict(Counter(np.concatenate(parts).tolist()))


@pytest.mark.parametrize("seed", range(4))
def test_suffix_sort_orders_like_bytes(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 99, 3000, dtype=np.uint8)
    start = rng.integers(0, 2940, 400)
    segment = np.sort(rng.integers(0, 30, 400))
    order = suffix_dedup.suffix_sort(suffix_dedup.Prefix(data), start, segment, 50)
    raw = data.tobytes()
    for s in set(segment.tolist()):
        at = np.flatnonzero(segment == s)
        assert sorted(order[at].tolist()) == at.tolist()
        assert [raw[x : x + 50] for x in start[order[at]]] == sorted(raw[x : x + 50] for x in start[at])


def test_repeated_windows_survive_hash_collisions(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 2000, dtype=np.uint8)
    start, segment, ids = rng.integers(0, 1900, 300), np.sort(rng.integers(0, 5, 300)), rng.integers(0, 9, 300)
    want = suffix_dedup._by_bytes(data, start, segment, ids, 6)
    assert want.any() and (suffix_dedup.repeated_windows(data, start, segment, ids, 6) == want).all()
    monkeypatch.setattr(suffix_dedup.Prefix, "of", lambda self, a, b: np.zeros(len(a), np.uint64))
    assert (suffix_dedup.repeated_windows(data, start, segment, ids, 6) == want).all()


def test_tile_components_match_all_pairs():
    rng = random.Random(3)
    base = [[rng.getrandbits(63) for _ in range(40)] for _ in range(6)]
    sets = []
    for i in range(60):
        s = set(base[i % 6][: rng.randrange(25, 41)]) | {rng.getrandbits(63) for _ in range(rng.randrange(0, 8))}
        sets.append(np.array(sorted(s), np.uint64))
    tile = Tile(list(range(60)), [len(s) for s in sets], [s.tobytes() for s in sets])
    label = tile.components()
    of = {k: label[i] for i, k in enumerate(tile.keys)}
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    assert all((of[i] == of[j]) == (root(i) == root(j)) for i in range(60) for j in range(60))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (7, 8), (5, 5), (None, 4), *((100 + i, 101 + i) for i in range(40))]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(41)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_viterbi_finds_a_best_path():
    texts = ["a b c d", "", "x = 'q' 12", "word, " * 300, "é 漢字 token: abc"]
    data, offsets = secrets.buffers(pa.array(texts))
    t = secrets.tokenize(data, offsets)
    rng = np.random.default_rng(0)
    f = secrets.Field(rng.normal(size=(int(secrets.SHIFT[-1]), 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    tags, e = f.decode(t), f.scores(t.features)
    for a, b in zip(t.first[:-1].tolist(), t.first[1:].tolist(), strict=True):
        if a == b:
            continue
        v = f.start + e[a]
        for i in range(a + 1, b):
            v = (v[:, None] + f.step).max(0) + e[i]
        y = tags[a:b]
        mine = f.start[y[0]] + e[np.arange(a, b), y].sum() + sum(f.step[p, q] for p, q in zip(y[:-1], y[1:], strict=True))
        assert mine == pytest.approx(v.max())


def test_field_learns_secrets_it_has_patterns_for():
    rng = random.Random(0)
    key = lambda: "".join(rng.choice("0123456789abcdefghijkXYZ") for _ in range(36))
    texts = [prose(rng, 60) + (f' token = "{key()}" ' if i % 2 else " ") + prose(rng, 60) for i in range(200)]
    field = secrets.fit(texts)
    bare = prose(rng, 30) + f' auth = "{key()}" ' + prose(rng, 30)
    found = secrets._scan(field, pa.array([bare, texts[0], texts[1]])).to_pylist()
    assert found[1]["added"] == [] and len(found[2]["base"]) == 1 and found[2]["added"] == []
    assert [bare[x["start"] : x["end"]] for x in found[0]["added"]] == [bare.split('"')[1]]
    assert secrets.fit([]) is None


def test_language_model_separates_and_calibrates():
    rng = random.Random(1)
    alphabets = {"aa": ["ban", "tor", "emi"], "bb": ["züg", "ßen", "örk"], "cc": ["éa", "çou", "ère"]}
    rows = [("".join(rng.choice(alphabets[k]) + rng.choice(["", " "]) for _ in range(rng.randrange(3, 60))), k) for k in alphabets for _ in range(80)]
    rng.shuffle(rows)
    model = langid.fit([r[0] for r in rows[:180]], [r[1] for r in rows[:180]], np.ones(1 << langid.BUCKET_BITS))
    lang, score = model.predict([r[0] for r in rows[180:]] + ["", "123 !?", "😀"])
    assert np.mean([a == b for a, (_, b) in zip(lang, rows[180:], strict=False)]) > 0.95
    assert lang[-3:] == ["und"] * 3 and score[-3:].tolist() == [0.0] * 3 and ((score >= 0) & (score <= 1)).all()
    assert (model.weights == 0).mean() > 0.5


def test_no_grams_cross_texts():
    whole = [np.sort(np.concatenate([b[at[i] : at[i + 1]] for b, at in langid.grams(["abc", "Déf g", "", "x"])])) for i in range(4)]
    for text, got in zip(["abc", "Déf g", "", "x"], whole, strict=True):
        assert (np.sort(np.concatenate([b for b, _ in langid.grams([text])])) == got).all()


def test_boosting_and_flat_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.boost(x[:1500], y[:1500], trees=40)
    assert ((forest.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95
    for f, t, v in zip(forest.feature[:3], forest.threshold[:3], forest.value[:3], strict=True):
        one = quality.Forest(forest.depth, f[None], t[None], v[None], 0.0)
        for row in x[:20]:
            node = 0
            for _ in range(forest.depth):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            assert one.raw(row[None])[0] == v[node - len(f)]
    assert quality.boost(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    assert (quality.boost(x[:9], np.ones(9)).score(x[:3]) > 0.9).all()


def test_statistics_do_not_depend_on_neighbours():
    texts = ["Plain words, here.", None, "", "A\nA\nA\nb!!! ***", "é" * 10]
    together = quality.statistics(pa.array(texts))
    for t, row in zip(texts, together, strict=True):
        assert np.allclose(quality.statistics(pa.array([t], pa.string()))[0], row)
    assert np.isfinite(together).all()


def test_urls():
    assert url_filter.split_url("HTTP://Www.A.com:80/x/Y?q=1#f") == ("www.a.com:80", "/x/Y")
    assert url_filter.split_url("http://a.com?x") == ("a.com", "") and url_filter.split_url("nothing") == url_filter.split_url(None) == ("", "")
    assert list(url_filter.keys_of("b.a.com", "/x/y", [3, 1])) == ["b.a.com/x/", "b.a.com/", "a.com/x/", "a.com/", "com/x/", "com/"]


def test_cascade_is_exact_over_its_universe():
    listed = [f"host{i}.com/" for i in range(300)]
    universe = [f"host{i}.com/" for i in range(5000)]
    members = set(listed)
    c = url_filter.build(listed, 400, lambda c: [k for k in universe if k not in members and c.passes(k)])
    assert len(c.levels) > 1
    assert [k for k in universe if k in c] == listed


def test_filter_rules(spark):
    rules = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "a.com", "/en/"), url_filter.Rule("allow", "www.a.com", "/en/"), url_filter.Rule("block", "net", "/e")]
    urls = ["http://www.a.com/en/1", "http://x.a.com/en/1", "http://a.com/fr", "http://xa.com/en/", "http://q.net/es/", "http://q.net/f", "no url", None, "http://q.net/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'mine' as filter")
    got = {r["page_id"]: (r["filter_"]["rule"], r["filter_"]["verdict"]) for r in url_filter.judge(df, rules).collect()}
    assert got == {0: ("www.a.com/en/", "allow"), 1: ("a.com/en/", "block"), 2: ("com/", "allow"), 3: ("com/", "allow"), 4: ("net/e", "block"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: ("net/e", "block")}
    assert url_filter.judge(df.limit(0), rules).count() == 0
    assert {r["filter_"]["verdict"] for r in url_filter.judge(df, []).collect()} == {"allow"}


PAGE = "<html><head><title>t</title><script>var x='</p>';</script></head><body><header>Site name</header><nav><a href=/>Home</a></nav><div class=wrap><div class=text><h1>{0} &amp; title</h1><p>First {0}<br>line&nbsp;two<p>Second <b>{0} bold</p><ul><li>{0} one<li>two</ul></div><div class='box'><p>All rights of this site reserved, same on each page</p></div></div><form><p>Mail</p></form><div id=comments><p>nice {0}</p></div><footer>End</footer></body></html>"


def test_extraction():
    got = html_extract.extract_group([PAGE.format(w) for w in ("alpha", "beta", "gamma", "delta")])
    assert got[1] == "beta & title\n\nFirst beta line two\n\nSecond beta bold\n\nbeta one\n\ntwo"
    assert html_extract.extract_group([None, "", "<nav>x</nav>", "plain <i>text", "<article class=comment>no</article><main><p>yes"]) == ["", "", "", "plain text", "yes"]
    deep = "<article>" + "<div>" * 300 + "inner" + "</div>" * 300 + "<aside>no</aside></article>"
    assert html_extract.extract_group([deep]) == ["inner"]
    hostile = ["<div>" * 5000 + f"text {i}" + "</div>" * 5000 for i in range(3)] + ["<body>" + "".join(f"<div>part {i} {k}</div>" for k in range(900)) for i in range(3)]
    got = html_extract.extract_group(hostile)
    assert got[:3] == ["text 0", "text 1", "text 2"] and got[5].count("part 2") == 900


def test_constant_nodes_leave_named_articles():
    page = "<body><article><h1>{0} title</h1><div class=bar>Tell your friends</div><section><p>{0} one, {0} two and {0} three of a long text</p></section>{1}</article></body>"
    shared = "<div class=x>A passage</div>"
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    got = html_extract.extract_group([page.format(w, shared if i < 3 else f"<div class=x>Other {w}</div>") for i, w in enumerate(words)])
    assert all("Tell" not in t for t in got) and all("A passage" in t for t in got[:3]) and "Other zeta" in got[5]
    copies = ["<article><h1>t{0}</h1><section>The same long text in every copy</section></article>".format(i) for i in range(4)]
    assert all("same long text" in t for t in html_extract.extract_group(copies))


def test_alignment_reaches_all_blocks():
    """Constant paragraphs after others, text between blocks, deep and wide pages, a second layout, a short last run."""
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    text = lambda w, n: "".join(f"<p>{w} passage {k} of some length" for k in range(n))
    for before, after in (("<p>", "</p>"), ("<ul><li>Share<li>", "</ul>"), ("</p><span>", "</span>"), ("<div>" * 150, "</div>" * 150)):
        pages = [f"<body class=c{w}><article id=post-{i}><h1>{w}</h1>{text(w, 2 + i)}{before.format(w)}Subscribe now{after}{text(w, 1)}</article>" for i, w in enumerate(words)]
        got = html_extract.extract_group(pages)
        assert all("Subscribe" not in t and t.count("passage") == 3 + i for i, t in enumerate(got))
    wide = ["<body><article>" + ("<div>one more</div>" if i % 2 else "") + "".join(f"<div>{w} {k}</div>" for k in range(300)) + "<div>Subscribe now</div></article>" for i, w in enumerate(words)]
    assert all("Subscribe" not in t and t.count(w) == 300 for w, t in zip(words, html_extract.extract_group(wide), strict=True))
    two = [f"<div class={'ab'[i % 2]}><article>{text(w, 3)}<p>Made by {'ab'[i % 2]}</article></div>" for i, w in enumerate(words)]
    assert all("Made" not in t and t.count("passage") == 3 for t in html_extract.extract_group(two))


def test_extraction_does_not_depend_on_partitions(spark):
    """Groups of a host are the same however rows lie, by broadcast and by join; induction drops what only repetition marks."""
    page = "<article><h1>w{0}</h1><p>passage {0} of some length<p>Subscribe now</article>"
    rows = [(i, f"http://h{i % 7 // 4}.com/{i}", page.format(i)) for i in range(90)] + [(1, "http://h0.com/1", page.format(1))] * 5 + [(None, None, page.format(7))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = []
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n, hosts in (("1", 9), ("4", 9), ("31", 9), ("8", 0)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            before, html_extract._dealt.__defaults__ = html_extract._dealt.__defaults__, (hosts,)
            try:
                found.append(Counter(tuple(r) for r in html_extract.extract(df.repartition(int(n)), group_pages=8).collect()))
            finally:
                html_extract._dealt.__defaults__ = before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert all(f == found[0] for f in found) and sum(found[0].values()) == len(rows)
    assert not any("Subscribe" in r[2] for r in found[0] if r[1]) and "Subscribe" in html_extract.main_text(html_extract.parse(page.format(1)))


def test_all_content_containers_stay():
    header = "<div class=main-header><h1>Site</h1></div>"
    assert html_extract.extract_group([header + "<main><p>one<p>two</main>"]) == ["one\n\ntwo"]
    split = "<div class=content><p>first<div class=entry>inner</div></div><div class=sidebar>no</div><div class=post>second, the longer</div><main>{0}</main>"
    assert html_extract.extract_group([split.replace("<main>{0}</main>", "")]) == ["first\n\ninner\n\nsecond, the longer"]
    assert html_extract.extract_group([split.format("third")]) == ["third"]
    assert html_extract.extract_group(["<main>a</main><nav>no</nav><main>b<main>c</main></main>"]) == ["a\n\nb\n\nc"]


def test_simple_tree_matching_finds_the_largest_match():
    a = html_extract.parse("<body><div><h1>x</h1><p>y</p></div><section><p>z</p></section></body>")
    b = html_extract.parse("<body><div><p>y</p></div><div><h1>x</h1><p>q</p></div><section><p>z</p><h2>w</h2></section></body>")
    pairs: list = []
    assert html_extract.align(a, b, pairs) == len(pairs) == 7


def test_extract_rows(spark):
    rows = [(i, f"http://h{i % 2}.com/{i}", PAGE.format(f"w{i}")) for i in range(12)] + [(None, None, None), (3, "http://h1.com/3", PAGE.format("w3"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' as host", "'x' as text")
    got = html_extract.extract(df, group_pages=4).collect()
    assert len(got) == 14 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert Counter(r["page_id"] for r in got)[3] == 2 and next(r["text"] for r in got if r["page_id"] is None) == ""
    assert html_extract.extract(df.limit(0)).count() == 0


def test_runs_of_hot_anchors_are_cut_by_what_stands_around():
    """Cut runs hold the same windows, equal windows keep one name, and the comparison by name finds what brute force finds."""
    rng = random.Random(6)
    line = "the line that nearly every text has"
    texts = [f"{prose(rng, 12)} {line}{rng.choice([' and more of it', ', or not,', ''])} {prose(rng, 12)}" for _ in range(60)] + ["ab" * 80, "x" * 120, "ab" * 90]
    data, offsets = suffix_dedup.buffers(pa.array(texts, pa.large_string()))
    doc, first, windows, anchor = suffix_dedup.anchor_runs(data, offsets)
    hot = np.arange(len(doc)) % 5 > 0
    same = {int(a): bool(h) for a, h in zip(anchor, hot, strict=True)}
    hot = np.array([same[int(a)] for a in anchor])  # an anchor is hot everywhere or nowhere
    d, f, w, name = suffix_dedup._cut_hot(data, doc, first, windows, anchor, hot)
    starts = lambda doc, first, windows: sorted((int(x), int(a) + k) for x, a, n in zip(doc, first, windows, strict=True) for k in range(n))
    assert starts(d, f, w) == starts(doc, first, windows) and len(d) > len(doc) and w[-1] <= suffix_dedup.PLACES
    raw = data.tobytes()
    names: dict = {}
    owners: dict = {}
    for x, a, n, k in zip(d.tolist(), f.tolist(), w.tolist(), name.tolist(), strict=True):
        for p in range(a, a + n):
            assert names.setdefault(raw[p : p + 50], k) == k
            owners.setdefault(raw[p : p + 50], set()).add(x)
    order = np.argsort(name, kind="stable")
    size = w[order] + 49
    begin = np.r_[0, np.cumsum(size)[:-1]]
    flat = data[np.repeat(f[order] - begin, size) + np.arange(size.sum())]
    row, lo, hi = suffix_dedup._again(flat, begin, w[order], name[order], d[order].astype(np.int64), np.arange(len(order)))
    got = {(int(d[order][r]), int(f[order][r]) + k) for r, a, b in zip(row, lo, hi, strict=True) for k in range(a, b + 1)}
    want = {(x, a + k) for x, a, n in zip(d.tolist(), f.tolist(), w.tolist(), strict=True) for k in range(n) if min(owners[raw[a + k : a + k + 50]]) < x}
    assert got == want and len(want) > 100
