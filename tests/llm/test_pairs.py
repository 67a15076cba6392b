"""Near-duplicates, exact top-k, pages and the pipeline."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import numpy as np
import pytest
from oracle import same
from pyspark.sql import Window
from pyspark.sql import functions as F

from nearfield.llm import components as cc
from nearfield.llm import html, langid, neardup, packing, queries, topk, toxicity
from nearfield.llm.base import shingle_sets, table, word_hashes

SF = "/root/testdata/sf0.001"


def words_of(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def shingles(t, n):
    w = words_of(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def plain(rows, n, percent=80):
    """Every pair compared; doc_id to (n_shingles, least doc_id reached) of single rows."""
    sets = {d: shingles(t, n) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_hashes_are_of_words():
    rnd = random.Random(1)
    rows = ["".join(rnd.choice("aAbB é\t\n\x0b\x1c\xa0,") for _ in range(rnd.randint(0, 30))) for _ in range(500)]
    h, n = word_hashes([r.encode() for r in rows], chunk=100)
    every = [w for r in rows for w in words_of(r)]
    assert n.tolist() == [len(words_of(r)) for r in rows]
    of = {}
    for w, x in zip(every, h.tolist(), strict=True):
        assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of)
    for k in (1, 2, 5):
        assert [len(s) for s in shingle_sets([r.encode() for r in rows], k)] == [len(shingles(r, k)) for r in rows]


@pytest.mark.parametrize("words", [2, 5])
def test_links_are_the_plain_ones(spark, words):
    docs = table(spark, SF, "documents")
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], words)
    got = neardup.near_duplicates(docs, words).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def copies(rnd, base, n, changes):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(changes):
            w[rnd.randrange(len(w))] = f"new{rnd.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("limits", [{"NODE": 4}, {"NODE": 2, "TASK_NODE": 8, "BROADCAST_MEMBERS": 5}, {"CLUSTER": 8, "PIVOTS": 2}, {"CLUSTER": 4, "PIVOT_ROUNDS": 1, "TASK_NODE": 16, "PIVOT_BYTES": 0}])
def test_large_groups_and_deep_nodes(spark, monkeypatch, limits):
    """Small limits, so that nodes branch in a task and before it, alike ones are cut into blocks and clusters meet block by block."""
    rnd = random.Random(4)
    a, b = ([f"{p}{rnd.randint(0, 400)}" for _ in range(120)] for p in "ab")
    same_start = [" ".join(["one", "two", *[f"t{rnd.random()}" for _ in range(6)]]) for _ in range(60)]
    rows = list(enumerate(copies(rnd, a, 60, 2) + copies(rnd, b, 40, 6) + same_start + [" ".join(a)] * 30))
    for name, value in limits.items():
        monkeypatch.setattr(neardup, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, 2).collect()}
    assert got == plain(rows, 2)


def test_rows_of_one_doc_id_with_near_copies(spark):
    """Each text of a doc_id has its own links, and the doc_id joins them."""
    rnd = random.Random(8)
    base = [[f"{p}{i}" for i in range(60)] for p in "abcd"]
    rows = [(3, " ".join(base[0])), (3, " ".join(base[1])), (11, copies(rnd, base[1], 1, 2)[0]), (10, copies(rnd, base[0], 1, 2)[0]), (7, " ".join(base[2])), (20, copies(rnd, base[2], 1, 2)[0]), (20, " ".join(base[3])), (20, " ".join(base[3])), (21, copies(rnd, base[3], 1, 1)[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df, 2).collect())
    assert got == [(3, 3), (3, 3), (7, 7), (10, 3), (11, 3), (20, 7), (20, 7), (20, 7), (21, 7)]


def test_near_duplicates_of_odd_rows(spark):
    rows = [(5, "a b c d e"), (3, "A b  C d e"), (9, "x"), (8, "X"), (1, None), (2, ""), (7, " \t"), (None, "x"), (4, "long " * 30000), (6, "long " * 30000), (3, "other text of three"), (10, "Other text of three")]
    df = spark.createDataFrame([(d, t, 1, True) for d, t in rows], "doc_id long, text string, n int, kept boolean")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, 2).collect())
    want = [(-1, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 3, 3, True), (3, 4, 3, True), (4, 1, 4, True), (5, 4, 3, False), (6, 1, 4, False), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False), (10, 3, 3, False)]
    assert got == want
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    left = neardup.without_copies(df, 2).collect()
    assert sorted(r["doc_id"] or -1 for r in left) == [-1, 1, 2, 3, 4, 7, 8] and left[0].asDict().keys() == {"doc_id", "text", "n", "kept"}


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(5)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(50)]
    pairs = chain + star + [(200, 200), (None, 5)]
    rnd.shuffle(pairs)
    got = {r["v"]: r["component"] for r in cc.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(51)}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("crowd", [0, 4000])
def test_recall_of_trees(monkeypatch, crowd):
    """Pairs at 0.8 stay together in nodes that branch: at the first level, and where a crowd shares most tokens."""
    rnd = np.random.default_rng(6)
    monkeypatch.setattr(neardup, "NODE", 2)
    pairs = [np.stack([neardup.minwise(x[:160]), neardup.minwise(x[20:])]) for x in (rnd.integers(0, 1 << 63, 180).astype(np.uint64) for _ in range(300))]
    tokens = np.concatenate([*pairs, rnd.integers(0, 8, (crowd, neardup.TOKENS)).astype(np.uint8)])
    if crowd:
        tokens[:600] %= 8  # eight values a token: all share nodes with hundreds of others
    nodes = neardup.first_nodes(tokens)
    met = set()
    for k in range(nodes.shape[1]):
        a, b = neardup.links_below(nodes[:, k], np.full(len(tokens), 160), tokens, 80)
        met |= {int(min(x, y)) for x, y in zip(a, b, strict=True) if abs(int(x) - int(y)) == 1 and min(x, y) % 2 == 0 and max(x, y) < 600}
    assert len(met) >= 298


def test_links_below_are_those_of_every_pair():
    """Of all trees: what looks similar is connected, and nothing else, whether a node is small, alike, or branches on."""
    rnd = np.random.default_rng(9)
    base = rnd.integers(0, 256, (40, neardup.TOKENS)).astype(np.uint8)
    tokens = base[rnd.integers(0, 40, 600)]
    swap = rnd.random(tokens.shape) < 0.05
    tokens = np.where(swap, rnd.integers(0, 256, tokens.shape), tokens).astype(np.uint8)
    nodes, label = neardup.first_nodes(tokens), np.arange(600)
    for x, y in np.concatenate([neardup.links_below(n, np.full(600, 9), tokens, 80) for n in nodes.T], 1).T:
        label[label == label[x]] = label[y]
    near = (tokens[:, None] == tokens[None]).sum(2) >= neardup._least_matches(80)
    assert ((label[:, None] == label[None]) >= near).all() and len(np.unique(label)) == 40


def test_top_k_is_the_sql(spark):
    same(queries.QUERIES["op6_exact_top_k"](spark, SF), queries.ORACLE_SQL["op6_exact_top_k"], SF)


@pytest.mark.parametrize("size", [16 << 20, 64])
def test_top_k_of_odd_rows(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "QUERY_BYTES", size)
    monkeypatch.setattr(topk, "BLOCK", 2)
    rows = [(100, [0.5, 0.0]), (200, [0.0, 1.0]), (7, [0.5, 0.0]), (3, [0.5, 0.0]), (1, None), (2, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [-0.3, 2.0]), (7, [0.5, 0.0]), (None, [9.0, 9.0]), (8, [])]
    v = topk.integer_components(spark.createDataFrame([(k, x, 0) for k, x in rows], "vec_id long, embedding array<float>, rank int"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(v.where("key % 100 = 0"), v, 3).collect())
    assert got == [(100, 1, 3, 512 * 512), (100, 2, 7, 512 * 512), (100, 3, 7, 512 * 512), (200, 1, 6, 2048 * 1024), (200, 2, 3, 0), (200, 3, 7, 0)]
    assert topk.top_k(v.limit(0), v).count() == 0 and topk.top_k(v, v.limit(0)).count() == 0


def test_top_k_of_large_components_and_of_queries_that_come_twice(spark):
    """Components are held at a bound; rows of one key are one query with the best of all their scores."""
    m = topk.MOST
    rows = [(100, [1e30, -1e30]), (7, [3e38, 0.0]), (8, [-1.0, 1.0])]
    v = topk.integer_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(v.where("key = 100"), v, 5).orderBy("rank").collect()]
    assert got == [(7, m * m), (8, -2 * 1024 * m)]
    twice = topk.integer_components(spark.createDataFrame([(100, [1.0, 0.0]), (100, [0.0, 1.0])], "vec_id long, embedding array<double>"), scale=1)
    others = topk.integer_components(spark.createDataFrame([(7, [2.0, 1.0]), (8, [0.0, 5.0])], "vec_id long, embedding array<double>"), scale=1)
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(twice, others, 3).orderBy("rank").collect()]
    assert got == [(1, 8, 5), (2, 7, 2), (3, 7, 1)]


PAGE = """<html><head><title>T</title><script>var x="<p>no</p>";</script></head><body><div id=top>My site</div>
<div class="menu"><a href=/>Home</a></div><div class=body><h2>Title {0}</h2><div>Text &amp; more {0}<br>line &lt;{0}&gt;
<ul><li>item {0}<li>second {0}</ul></div><p>Thanks for reading our site</p></div><form><input name=q>Search</form>
<section class="reader-comments"><p>Nice {0}</p></section><div>All rights reserved</div></body></html>"""


def test_template_of_a_host_goes(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i)) for i in range(5)] + [(9, None, None), (10, "x", ""), (11, "http://one.example/", "<p>a  b<p>c&nbsp;d&#33;<b>e</b>f")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = {r["page_id"]: r for r in html.main_text(df).collect()}
    for i in range(5):
        assert got[i]["text"] == f"Title {i}\nText & more {i} line <{i}>\nitem {i}\nsecond {i}"
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert (got[9]["text"], got[10]["text"], got[11]["text"]) == ("", "", "a b\nc d!ef")
    assert html.main_text(df.limit(0)).count() == 0


def test_boxes_that_all_articles_share_go():
    page = "<body><div>Site</div><article><h1>Same</h1><p>First {0}</p><div>Share this</div><p>Same</p></article></body>"
    assert html.extract(page.format(7), template([page.format(i) for i in range(4)])) == "Same\nFirst 7\nSame"
    assert html.extract(page.format(0), template([page.format(0)] * 3)) == "Same\nFirst 0\nShare this\nSame"


def template(pages: list[str]) -> html.Node:
    t, *rest = [html.skeleton(html.parse(x)) for x in pages]
    for x in rest:
        t = html.fold(t, x)
    return html.decide(html.Node.load(t.dump()))


def test_text_that_few_pages_fill_stays():
    inner = "<article><div class='entry'>{1}<p>Text {0}</p></div></article>"
    outer = "<body><h2>Site</h2><div class='entry'>{1}<p>Text {0}</p></div><div>{2}</div></body>"
    for page in (inner, outer):
        pages = [page.format(i, "Only here" if i == 2 else "", "Closed today" if i == 1 else "") for i in range(5)]
        t = template(pages)
        assert html.extract(pages[2], t) == "Only here\nText 2"
        assert html.extract(pages[1], t) == ("Text 1\nClosed today" if page == outer else "Text 1")
        assert html.extract(pages[0], template([pages[0], pages[2], pages[2], pages[1], pages[3]])) == "Text 0"


@pytest.mark.parametrize(
    "page",
    [
        "<body class='has-sidebar'><p>Text {0}</p></body>",
        "<html class='no-ads header'><body class='search'><p>Text {0}</p></body></html>",
        "<div id='content' class='ad-free'><p>Text {0}</p></div>",
        "<div id='content' class='share-ready'><h3>Site</h3><p>Text {0}</p></div><div class='related'><i>{0}</i></div>",
        "<article class='post no-comments tags-x'><p>Text {0}</p></article>",
        "<main class='search'><p>Text {0}</p></main><div>{0}</div>",
        "<div class='social header'><main><p>Text {0}</p></main></div>",
        "<div class='header-x'><article class='tags'><p>Text {0}</p></article></div><div class='related'><article>{0}</article></div>",
        "<article><div class='tags-x'><p>Text {0}</p></div></article>",
        "<div class='widget'><div class='search'><p>Text {0}</p></div></div>",
    ],
)
def test_a_name_does_not_take_the_article(page):
    shell = "<div>Shared</div>{0}<nav class='menu'><p>Menu {1} and more of it</p></nav><div class='comments'><p>{1}</p></div>"
    pages = [shell.format(page.format(f"{i}."), i) if "<body" not in page else page.format(f"{i}.") for i in range(4)]
    assert html.extract(pages[1], template(pages)) == "Text 1."


@pytest.mark.parametrize("drawn", ["<svg width='9'/>", "<math/>", "<svg/><b>and</b><svg><text>no</text></svg>", "<SVG />"])
def test_drawings_that_close_themselves(drawn):
    want = "One and two" if "and" in drawn else "One two"
    assert html.extract(f"<p>One {drawn} two</p><p>Three</p>", None) == want + "\nThree"


def test_named_boxes_beside_an_article_go():
    page = "<div class='comments'><article class='comment'><p>Nice {0}</p></article></div><article><h1>Title</h1><p>Text number {0}</p><div class='share'>To {0}</div></article>"
    pages = [page.format(i) for i in range(4)]
    assert html.extract(pages[1], template(pages)) == "Title\nText number 1"


@pytest.mark.parametrize("body", ['<div class="share-of-voice">Body text of {0} goes here</div>', '<p id="comment-law">Body text of {0} goes here</p>'])
def test_names_that_only_look_like_a_menu_stay(body):
    pages = [f"<body><nav>Home</nav><article><h1>Title {i}</h1><p>First {i}</p>{body.format(i)}</article></body>" for i in range(4)]
    for t in (template(pages), template(pages[:1])):
        assert html.extract(pages[1], t) == "Title 1\nFirst 1\nBody text of 1 goes here"


#: Pages of the tables without an article element, and with names that are in no list.
FOREIGN = [("<article>", '<div class="b1">'), ("</article>", "</div>"), ('class="ad"', 'class="werbung"'), ("<footer>", '<div class="fuss">'), ("</footer>", "</div>"), ("<nav>", '<div class="leiste">'), ("</nav>", "</div>")]


@pytest.mark.parametrize("changes", [FOREIGN[:2], [*FOREIGN[:2], *FOREIGN[5:]], FOREIGN])
def test_the_template_finds_the_content(spark, changes):
    """Articles and menus renamed to plain boxes: the template finds all articles whole, and without it nothing does.

    Adverts and footers in no list, whose text varies and is no link, can't be told from an intro: they stay.
    """
    df = table(spark, "/root/testdata/sf0.01", "pages")
    want = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    renamed = df
    for a, b in changes:
        renamed = renamed.withColumn("html", F.replace("html", F.lit(a), F.lit(b)))
    got = {r["page_id"]: r["text"] for r in html.main_text(renamed).collect()}
    hosts = {r["page_id"]: r["n"] for r in df.select("page_id", F.count("*").over(Window.partitionBy(html._host())).alias("n")).collect()}
    many = [k for k in got if hosts[k] >= 5]
    assert len(many) > 100
    if changes == FOREIGN:
        assert all(want[k] in got[k] and len(got[k].splitlines()) <= len(want[k].splitlines()) + 4 for k in many)
    else:
        assert all(got[k] == want[k] for k in many)
    plain = {r["page_id"]: html.extract(r["html"], None) for r in renamed.collect()}
    assert changes == FOREIGN[:2] or all(plain[k] != want[k] for k in many)


@pytest.mark.parametrize(
    "page",
    [
        "<div class='headline'><h1>Headline {0}</h1></div><div class='intro'><p>Intro {0}</p></div><div class='story'>{1}</div>",
        "<div class='headline'>Headline {0}</div><div class='intro'>Intro {0}</div><div class='story'>{1}</div>",
        "<div><h1>Headline {0}</h1><div class='intro'>Intro {0}</div><section>{1}</section></div>",
    ],
)
def test_a_headline_and_an_intro_in_boxes_of_their_own_stay(page):
    """However short they are against the story; a box of links as short as they are goes."""
    links = "<div class='x9'>" + "".join("<a href='/{0}'>Link {0}</a> " for _ in range(4)) + "</div><nav><p>Home {0}</p></nav>"
    story = [f"Paragraph {{0}} {k} " + "of the story " * 30 for k in range(9)]
    whole = page + links + "<footer>Imprint</footer>"
    pages = [whole.replace("{1}", "".join(f"<p>{s}</p>" for s in story)).format(i, i) for i in range(12)]
    for i in (0, 7):
        want = [f"Headline {i}", f"Intro {i}", *(" ".join(s.format(i).split()) for s in story)]
        assert html.extract(pages[i], template(pages)).split("\n") == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div>" * 10_000 + "text" + "</div>" * 10_000 + "<p>after", "text\nafter"),
        ("<b>" * 10_000 + "text" + "</b>" * 10_000 + "<p>after", "text\nafter"),
        ("<p>x</p>" + "<a b='x" * 700_000 + ">end", "x\nend"),
        ("<p title=\"abc>Hello</p>" + "<i a='>' " * 200_000 + ">end", "Hello\nend"),
        ("<" * 2_000_000, "<" * 2_000_000),
        ("<!-- " * 500_000, ""),
        ("<script>" * 300_000, ""),
        ("<div data-p=/a/>One</div><div/>Two", "One\nTwo"),
    ],
)
def test_pages_that_are_deep_long_or_broken(page, want):
    import time

    began = time.perf_counter()
    t = html.decide(html.fold(html.skeleton(html.parse(page)), html.skeleton(html.parse(page))))
    assert html.extract(page, html.Node.load(t.dump())) == html.extract(page, None) == want
    assert time.perf_counter() - began < 20


def test_alignment_of_deep_and_wide_trees_is_quick():
    deep = lambda n, last: html.Node(f"x{n}", None, 1, [html.Node("a"), deep(n - 1, last), html.Node("b")] if n else [html.Node(last)])
    t = html.fold(deep(90, "p"), deep(90, "q"))
    assert t.size() == 90 * 3 + 3
    rnd = random.Random(2)
    names = [f"n{i}" for i in range(3000)]
    wide = html.Node("r", None, 1, [html.Node(n) for n in names]), html.Node("r", None, 1, [html.Node(n) for n in rnd.sample(names, 3000)])
    pairs = html.match(wide[0].children, wide[1].children)
    assert all(p < q and r < s for (p, r), (q, s) in zip(pairs[:-1], pairs[1:], strict=True)) and len(pairs) > 50
    assert html.fold(*wide).size() == 3001


def test_alignment_covers_most_nodes():
    """Against every order-preserving choice of pairs."""
    rnd = random.Random(7)

    def tree(d):
        return html.Node("r", None, 1, [html.Node(n, None, 1, tree(d - 1).children) for n in rnd.sample("abcdef", rnd.randint(0, 5))] if d else [])

    def most(a, b):
        if not a or not b:
            return 0
        here = 1 + most(a[0].children, b[0].children) + most(a[1:], b[1:]) if a[0].name == b[0].name else 0
        return max(here, most(a[1:], b), most(a, b[1:]))

    for _ in range(200):
        a, b = tree(2), tree(2)
        assert html._score(a, b, {}) == 1 + most(a.children, b.children)


def test_many_hosts_and_names(spark, monkeypatch):
    """Templates leave a task before all hosts are seen; names of single pages leave a template."""
    rows = [(i, f"http://h{i % 7}.example/{i}", PAGE.format(i).replace("<p>", f"<p><b>{i}</b></p><p>")) for i in range(70)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    want = {tuple(r) for r in html.main_text(df).collect()}
    monkeypatch.setattr(html, "MOST_HOSTS", 2)
    assert {tuple(r) for r in html.main_text(df).collect()} == want
    monkeypatch.setattr(html, "MOST_NODES", 40)
    t = template([f"<div id=a{'xyz'[i % 3] * (i // 3)}>Text {i}</div><p>Text {i}</p><div>Shared</div>" for i in range(200)])
    assert t.size() < 150 and html.extract("<div id=new>New</div><p>Text</p><div>Shared</div>", t) == "New\nText"


def test_large_templates_give_the_same_text(spark, monkeypatch):
    """Boxes of a single page are weighed, and names that come again on later pages counted, however many there are."""
    links = "".join(f"<a href=x>Link {i} of the menu</a> " for i in range(9))

    def page(i):
        own = f"<div id=only{'abcdefgh'[i % 8] * (1 + i // 8)}><div class=inner>Page {i} says much. {'More words. ' * (i % 9)}</div></div>" if i % 3 else ""
        late = f"<div id=late{'xyz'[i % 3] * (1 + i % 130 // 3)}>The same note on two pages only</div>"
        return f"<body><div class=a>Site</div><div class=w>{own}{late}<div class=rel{'pq'[i % 2] * (1 + i // 2)}>{links}</div></div><div class=z>Notes</div></body>"

    rows = [(i, "http://h.example/", page(i)) for i in range(260)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    want = {tuple(r) for r in html.main_text(df).collect()}
    whole = template([h for _, _, h in rows])
    monkeypatch.setattr(html, "MOST_NODES", 40)
    assert {tuple(r) for r in html.main_text(df).collect()} == want
    few = template([h for _, _, h in rows])
    assert few.size() < whole.size() // 2
    assert [html.extract(h, few) for _, _, h in rows] == [html.extract(h, whole) for _, _, h in rows]


@pytest.mark.parametrize("box", ["<div id='c'>{0}</div>", "<article>{0}</article>"])
def test_comments_longer_than_the_text_go(box):
    page = "<body><div class=a>Site</div>" + box.format("<h1>Title {0}</h1><p>Short text {0}</p><section class='user-comments-list'><p>" + "Many words of a reader {0}. " * 30 + "</p></section>") + "</body>"
    pages = [page.format(i) for i in range(5)]
    assert html.extract(pages[1], template(pages)) == "Title 1\nShort text 1"


def test_pages_of_other_layouts_keep_their_text():
    """A page is judged by what it has: without the host's usual article, or with little text of its own."""
    usual = "<body><div class=a>Site</div><article><p>Long text of the page {0} that goes on and on.</p></article><div class=z>Notes {0}</div></body>"
    other = "<body><div class=a>Site</div><div class=post><p>Another text {0}, of some length.</p></div><nav>x</nav></body>"
    short = "<body><div class=a>Site</div><div class=contact>Call us {0}</div></body>"
    pages = [(usual if i % 4 else other).format(i) for i in range(20)] + [short.format(99)]
    t = template(pages)
    assert html.extract(pages[1], t) == "Long text of the page 1 that goes on and on."
    assert html.extract(pages[4], t) == "Another text 4, of some length."
    assert html.extract(pages[20], t) == "Call us 99"


def test_templates_joined_by_host_are_the_same(spark, monkeypatch):
    df = table(spark, SF, "pages")
    want = {tuple(r) for r in html.main_text(df).collect()}
    monkeypatch.setattr(html, "BROADCAST_BYTES", -1)
    assert {tuple(r) for r in html.main_text(df).collect()} == want


def test_articles_are_whole(spark):
    import html as std

    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op7_html_extraction"](spark, SF).collect()}
    for r in table(spark, SF, "pages").collect():
        inner = r["html"].split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        blocks = [" ".join(std.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:h1|p)>", inner)]
        assert got[r["page_id"]] == "\n".join(filter(None, blocks))


def test_tree_matching_aligns_most_nodes():
    n = lambda name, *kids: html.Node(name, None, 1, list(kids))
    a, b = [n("a"), n("b", n("x"), n("y")), n("c")], [n("b", n("x"), n("z"), n("y")), n("a"), n("c")]
    assert html.match(a, b) == [(1, 0), (2, 2)]
    t = html.fold(n("r", *a), n("r", *b))
    assert sorted(c.name for c in t.children) == ["a", "b", "c"] and t.pages == 2


def test_pipeline_stages(spark):
    """Each stage against what its operator says of the same rows; copies against every pair compared."""
    docs = table(spark, SF, "documents").cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_dedup", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF).cache()
        assert out.columns == docs.columns
        ids = {r["doc_id"] for r in out.collect()}
        if name == "toxicity":
            chain = toxicity.train(kept, table(spark, SF, "labels"))
            want = {r["doc_id"] for r in toxicity.score(kept, chain).where("NOT toxic").collect()}
        elif name == "language":
            want = {r["doc_id"] for r in langid.identify(kept, langid.train(kept)).where("lang_pred <> 'und'").collect()}
        else:
            want = {d for d, (_, c) in plain([(r["doc_id"], r["text"]) for r in kept.collect()], 5).items() if d == c}
        assert ids == want
        kept = out
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in kept.collect()}
    assert len(packing.pack([], packing.Limits())[0]) == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in any column, ties, repeated rows, empty and long texts, clashing columns; and empty tables."""
    docs = table(spark, SF, "documents").limit(120)
    extra = [(None, "A text that has no number of its own", "en", None, None), (900, None, None, None, None), (901, "", "en", "x", 0), (902, "12 %%", None, None, 1), (None, None, None, None, None)]
    one = docs.orderBy("doc_id").first()
    extra += [(one["doc_id"], one["text"], one["lang"], one["source"], one["n_chars"])] * 3 + [(903, "the and of to in " * 20000, "en", "y", 5)]
    odd = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for c in ("toxic", "kept", "length", "node", "component_id", "lang_pred"):
        odd = odd.withColumn(c, F.lit(None).cast("string"))
    labels = table(spark, SF, "labels")
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, 0), (6, 1, None)], labels.schema)).write.parquet(str(tmp_path / "labels.parquet"))
    kept = table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == odd.columns
    rows = kept.collect()
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and not {900, 901, 902} & set(ids) and sum(r["doc_id"] is None for r in rows) == 1
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in rows}
    for t in ("documents", "labels"):
        (empty := tmp_path / "none" / t).parent.mkdir(exist_ok=True)
        table(spark, str(tmp_path), t).limit(0).write.parquet(f"{empty}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
