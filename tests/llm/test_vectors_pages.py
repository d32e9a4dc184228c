"""Vector duplicates and page texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import html, vector_dedup
from docloom.llm.components import connected_components


def brute(ids, vecs, t=0.95):
    n = len(ids)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vecs]
    links, up = [0] * n, list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vecs[i]) == len(vecs[j]):
                a, b = np.array(vecs[i], float), np.array(vecs[j], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= t:
                    links[i] += 1
                    links[j] += 1
                    a, b = top(i), top(j)
                    up[max(a, b)] = min(a, b)
    return links, [ids[top(i)] for i in range(n)]


def test_vector_links_and_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    vecs = [(centres[i % 40] + rng.standard_normal(16) * s).astype(np.float32).astype(float).tolist()
            for i, s in enumerate(rng.choice([0.02, 0.15, 0.3], 900))]
    vecs += [(centres[0] + rng.standard_normal(16) * 0.05).astype(np.float32).astype(float).tolist() for _ in range(300)]   # a dense cluster
    ids = list(range(len(vecs)))
    df = spark.createDataFrame(list(zip(ids, vecs)), "vec_id bigint, embedding array<float>")
    out = {r.vec_id: r for r in vector_dedup.vector_duplicates(df, leaf=64, block=50).collect()}
    links, comps = brute(ids, vecs)
    got = [out[i].n_links for i in ids]
    assert all(g <= w for g, w in zip(got, links)) and sum(got) >= 0.97 * sum(links) > 0
    assert np.mean([out[i].component_id == c for i, c in zip(ids, comps)]) >= 0.99
    assert all(out[i].kept == (out[i].component_id == i) for i in ids)


def test_a_loose_dense_cluster_does_not_multiply_its_rows():
    rng = np.random.default_rng(0)
    spread = vector_dedup.unit(rng.standard_normal((4000, 64)))
    dense = vector_dedup.unit(np.sqrt(0.95) * spread[0] + np.sqrt(0.05) * vector_dedup.unit(rng.standard_normal((1000, 64))))
    for x in (dense, np.concatenate([spread, dense])):
        tree = vector_dedup.fit_tree(x, 50.0, 0.95, 512, 0.4, np.random.default_rng(5))
        assert len(vector_dedup.leaves_of(x, [tree])[0]) <= 6 * len(x)


def around(mean, n, rng, d=64):
    """Unit vectors whose mean cosine is ``mean``, the last 300 turned from the first 300 to a cosine of 0.95 to 0.97."""
    m = vector_dedup.unit(rng.standard_normal((1, d)))
    r = rng.standard_normal((n - 300, d))
    x = np.sqrt(mean) * m + np.sqrt(1 - mean) * vector_dedup.unit(r - (r @ m.T) * m)
    t = rng.standard_normal((300, d))
    t = vector_dedup.unit(t - (t * x[:300]).sum(1, keepdims=True) * x[:300])
    c = rng.uniform(0.9501, 0.97, (300, 1))
    return np.concatenate([x, c * x[:300] + np.sqrt(1 - c * c) * t])


@pytest.mark.parametrize("mean", [0, 0.6, 0.8])
def test_leaves_hold_the_pairs_and_few_others_whatever_the_mean_cosine(mean):
    x = around(mean, 8000, np.random.default_rng(3))
    row, leaf = vector_dedup.leaves_of(x, vector_dedup.fit_forest(x, 1.0, 0.95, vector_dedup.TREES, vector_dedup.LEAF, 0.4, 5))
    size = np.bincount(leaf).astype(float)
    assert (size * (size - 1) / 2).sum() < 0.2 * 8000 * 7999 / 2
    held = [set() for _ in x]
    for r, at in zip(row, leaf):
        held[r].add(at)
    assert np.mean([bool(held[i] & held[7700 + i]) for i in range(300)]) >= 0.98


def test_oversized_leaves_are_split_again(spark, monkeypatch):
    """A sample too small for the table: links are found as with all of it, in small leaves."""
    x = around(0.6, 4000, np.random.default_rng(8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(4)
    seen = []
    stage = vector_dedup.stage
    monkeypatch.setattr(vector_dedup, "stage", lambda d, name: seen.append(stage(d, name)) or seen[-1])
    out = {r.vec_id: r for r in vector_dedup.vector_duplicates(df, sample=300).collect()}
    sizes = next(d for d in seen if d.columns == ["leaf", "blocks"])
    assert sizes.count() > 100 and sizes.where("blocks > 1").count() == 0
    want = np.flatnonzero((x @ x.T >= 0.95).sum(1) > 1)
    assert sum(out[i].n_links > 0 for i in want) >= 0.95 * len(want) and all(out[i].n_links == 0 for i in set(range(4000)) - set(want))


def test_ties_at_the_threshold_link(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.95, (1 - 0.95 ** 2) ** 0.5]), (3, [0.9499, (1 - 0.9499 ** 2) ** 0.5]), (4, [19.0, 39.0 ** 0.5])],
                               "vec_id bigint, embedding array<double>")
    out = {r.vec_id: r.n_links for r in vector_dedup.vector_duplicates(df).collect()}
    x = vector_dedup.unit(np.array([r.embedding for r in df.orderBy("vec_id").collect()]))
    assert out == dict(zip((1, 2, 3, 4), ((x @ x.T >= 0.95).sum(1) - 1).tolist()))


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (1, v, 0), (None, v, 0), (2, [2.0, 4.0, 6.0], 0), (3, None, 0), (4, [], 0), (5, [0.0, 0.0, 0.0], 0),
            (6, [1.0, None, 2.0], 0), (7, [nan, 1.0, 1.0], 0), (8, [inf, 1.0, 1.0], 0), (9, [1.0, 2.0], 0), (10, [1e-30, 2e-30, 3e-30], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, node int")
    got = sorted(map(tuple, vector_dedup.vector_duplicates(df).collect()), key=repr)
    want = [(1, 4, 1, True)] * 2 + [(None, 4, 1, False), (2, 4, 1, False), (10, 4, 1, False)] + [(i, 0, i, True) for i in range(3, 10)]
    assert got == sorted(want, key=repr)
    assert vector_dedup.vector_duplicates(df.limit(0)).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, i) for i in range(100, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    edges += [(None, 3), (5, None)] + edges[:5]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in [*range(100, 160), 1000]}, 200: 200, 201: 200, 202: 200}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><p>Site header</p></header><nav><ul><li><a href="/x">Menu</a></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p><b>First  para<br>more<p>Second &quot;q&quot; &#233; 1 < 2 <script>x</script></p><div class="ad">inner ad</div>
<ul><li>item one<li>item two</ul><aside>side</aside><form>form</form></article>
<section id="comments"><p>A reader's comment that is long enough to win by far if it counted as text of the page</p></section>
<footer>&copy; foot</footer></body></html>"""
TEXT = 'Head & line\n\nFirst para more\n\nSecond "q" é 1 < 2\n\nitem one\n\nitem two'


def test_one_page():
    assert html.extract(PAGE, []) == TEXT
    assert html.extract(PAGE[:PAGE.index("item two")], []) == TEXT[:TEXT.index("\n\nitem two")]
    assert html.extract("", []) == "" and html.extract("<nav>x</nav><p", []) == ""
    assert html.extract("just text &am", []) == "just text &am"


LONG_P = "A sentence of the article that is long enough to count as text of the page. " * 4
L = LONG_P.strip()


@pytest.mark.parametrize("page, want", [
    # the parts of one article, whatever holds most of it
    (f"<article><h1>Title</h1><p>The lead of it</p><section><p>{L}</p></section></article>", f"Title\n\nThe lead of it\n\n{L}"),
    (f"<article><div><p>{L}</p></div><div><p>The smaller part.</p></div></article>", f"{L}\n\nThe smaller part."),
    (f"<body><article><p>Intro here.</p><table><tr><td>{L}</td></tr></table><p>Outro here.</p></article></body>", f"Intro here.\n\n{L}\n\nOutro here."),
    (f"<body><div class='wrap'><div id='c'><h1>Title</h1><p>Lead.</p><div class='text'><p>{L}</p></div></div></div></body>", f"Title\n\nLead.\n\n{L}"),
    # self-closed and unclosed elements hold nothing
    (f"<p>Before<svg/>it</p><p>{L}</p>", f"Beforeit\n\n{L}"), (f"<p>One</p><iframe/><p>{L}</p>", f"One\n\n{L}"),
    (f"<p>One</p><select><option>x<p>{L}</p>", f"One\n\nx\n\n{L}"), (f"<p>One <svg><text>x</text></svg>more</p><p>{L}</p>", f"One more\n\n{L}"),
    (f"<p>One<noscript>no</noscript> and more</p><nav>x<p>{L}</p>", f"One and more\n\nx\n\n{L}"),
    (f"<p>One<select><option>x</select> two</p><textarea><p>{L}</p>", f"One two\n\n{L}"), (f"<p>{L}</p><script>var x = '<p>no</p>'", L),
    # names that only sound like parts that are left out
    (f"<div class='content no-sidebar'><p>{L}</p></div>", L), (f"<div class='post tags-news'><p>{L}</p></div>", L), (f"<div id='has-header'><p>{L}</p></div>", L),
    (f"<div class='article-header-image'><p>{L}</p></div><div class='main-nav'><p>{L}</p></div><div class='x comments-area'><p>{L}</p></div>", L),
    # wrappers that hold the article; a form without paragraphs and comments are none
    (f"<form id='aspnet'><div><p>{L}</p></div></form>", L), (f"<div class='nav-menu'><h1>Title</h1><p>{L}</p></div>", f"Title\n\n{L}"),
    (f"<p>Article text of this page.</p><form>{L}</form><div class='comments'><p>{L}{L}</p></div>", "Article text of this page."),
    # unnamed menus beside the article
    (f"<body><div><a href='/'>one</a> <a href='/'>two</a></div><p>{L}</p><div><ul><li><a href='/'>three</a></ul></div></body>", L)])
def test_the_article_is_kept_whole(page, want):
    assert html.extract(page, []) == want
    assert html.extract(page, [html.choice(html.blocks(page)) or "none"]) == want


def test_every_page_against_a_plain_reader(spark):
    """The driver's pages keep to one form: blocks of the article, by another parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.text, self.on, self.out_of = [], [], False, 0

        def end(self):
            if t := " ".join("".join(self.text).split()):
                self.out.append(t)
            self.text = []

        def handle_starttag(self, tag, attrs):
            if tag in ("h1", "p", "li", "article"):
                self.end()
            self.on |= tag == "article"
            self.text += [" "] if tag == "br" else []

        def handle_endtag(self, tag):
            if tag in ("h1", "p", "li", "article"):
                self.end()
            self.on &= tag != "article"

        def handle_data(self, data):
            self.text += [data] if self.on else []

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    for r in pages.collect():
        reader = Reader()
        reader.feed(r.html)
        reader.close()
        reader.end()
        assert got[r.page_id] == "\n\n".join(reader.out)


def test_long_repeated_and_nameless_pages(spark):
    page = "<body><article>" + "".join(f"<p>Paragraph {i} of a very long page.</p>" for i in range(30_000)) + "</article><footer>x</footer></body>"
    rows = [(None, "http://a.b", page), (1, "http://a.b", page), (1, "http://a.b", page), (None, None, "<p>x")]
    got = sorted((r.text.count("\n\n"), r.text[-9:]) for r in html.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect())
    assert got == [(0, "x")] + [(29_999, "ong page.")] * 3


def test_hosts_outvote_a_misleading_page(spark):
    good = "<body><div class='story7'><p>" + "a real sentence of the story. " * 5 + "</p></div><div class='box'><p>short box text that is small</p></div></body>"
    odd = "<body><div class='story9'><p>a short story today</p></div><div class='box'><p>" + "boxed words in plenty " * 20 + "</p></div></body>"
    rows = [(i, f"https://user@h.example:80/{i}", good) for i in range(8)] + [(9, "//H.example/9", odd), (10, None, None), (11, "", ""), (12, None, odd)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("mine")).withColumn("winners", F.lit(1))
    out = {r.page_id: r for r in html.main_text(df).collect()}
    assert out[9].text == "a short story today" and out[0].text.startswith("a real sentence") and "box" not in out[0].text
    assert out[10].text == out[11].text == "" and out[12].text.startswith("boxed words") and out[9].host == "mine"
    joined = {r.page_id: r.text for r in html.main_text(df, most_hosts=0).collect()}
    assert joined == {k: r.text for k, r in out.items()}
    assert html.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("url, want", [("http://A.b/c", "a.b"), ("https://u:p@x.y:8/z", "x.y"), ("nonsense", ""), (None, "")])
def test_host(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(html.host("u")).first()[0] == want
