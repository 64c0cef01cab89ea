from __future__ import annotations

import html
import random
import re

import pytest

from stmtgauge.llm import html_text, queries
from stmtgauge.llm.dom import blocks, read_page
from stmtgauge.llm.html_text import Template, Tree, aligned, content


def alone(text):
    page = read_page(text)
    return blocks(page, content(Tree(page.labels, page.parents), None))


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("", []),
        ("just  text\n&amp; more &copy", ["just text & more ©"]),
        ("<p>one<p>two<b>three<p>four", ["one", "twothree", "four"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<p>b</td><td>c<tr><td>d</table>", ["a", "b", "c", "d"]),
        ("a<br>b &nbsp; c<hr>d", ["a b c", "d"]),
        ("<article>x<script>if (a</b) '</p>'</script>y<!-- <p>no</p> --><style>p{}</style>z</article>", ["xyz"]),
        ("<p>1 < 2 </3> and <> <a href='x>y' title=\"<p>\">link</a></p>", ["1 < 2 and <> link"]),
        ("<main><header><h1>T</h1></header>body</main><header>site</header>", ["T", "body"]),
        ("<div class='layout with-sidebar'><article>text of it</article><div class='sidebar'>s</div></div>", ["text of it"]),
        ("<article><p>a<span class='ad'>buy</span> b<button>x</button></p><form>f<input></form><section id=comments><article class=comment>no</article></section></article>", ["a b"]),
        ("<body><div hidden>h</div><div class='cookie-notice'>c</div><p>t</body></html> after", ["t after"]),
        ("<article>never closed <b>bold <i>both</b> it", ["never closed bold both it"]),
        ("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>", ["deep"]),
        ("<p>a<!-- never closed <p>b", ["a"]),
    ],
)
def test_reading(given, want):
    assert alone(given) == want


def all_matchings(a, b, i=0, j=0):
    """Best score of matching two trees, by trying every order-keeping choice of pairs of children."""

    def best(x, y):
        if not x or not y:
            return 0
        got = max(best(x[1:], y), best(x, y[1:]))
        if a.tags[x[0]] == b.tags[y[0]]:
            got = max(got, all_matchings(a, b, x[0], y[0]) + best(x[1:], y[1:]))
        return got

    return 1 + 2 * (a.labels[i] == b.labels[j]) + best(a.children[i], b.children[j])


def test_tree_matching_is_the_best_one():
    draw = random.Random(7)
    for _ in range(150):
        trees = []
        for _ in range(2):
            n = draw.randint(1, 8)
            labels = ["#"] + [draw.choice(["p", "div", "div.a", "div.b", "ul"]) for _ in range(n)]
            trees.append(Tree(labels, [-1] + [draw.randint(0, i) for i in range(n)]))
        a, b = trees
        match = aligned(a, b)
        got = sum(1 + 2 * (a.labels[i] == b.labels[j]) for j, i in match.items())
        assert got == all_matchings(a, b) and len(set(match.values())) == len(match)
        assert all(match[b.parents[j]] == a.parents[i] for j, i in match.items() if j)
        many, html_text.CELLS = html_text.CELLS, 0
        assert all(a.labels[i] == b.labels[j] for j, i in aligned(a, b).items() if j)
        html_text.CELLS = many


def test_laying_trees_over_each_other():
    stats = lambda n: {k: [1] * n for k in html_text._STATS}
    t = Template(["#", "div.a", "p"], [-1, 0, 1], stats(3))
    t.lay(Template(["#", "nav", "div.b", "p", "ul"], [-1, 0, 0, 2, 2], stats(5)))
    assert [t.labels[c] for c in t.children[0]] == ["nav", "div.a"] and [t.labels[c] for c in t.children[1]] == ["p", "ul"]
    assert t.stats["pages"][:3] == [2, 2, 2] and Template.of(t.text()).text() == t.text()


def page(n, body, aside=""):
    """A page that names nothing: only what its host repeats tells text from frame."""
    return f"<html><body><div class=x{n}><div class=l>Our shop is the best shop, ask anyone.{aside}</div><div class=r>{body}</div><div class=k>All of it is ours, 1999.</div></div></body></html>"


def test_frames_are_induced(spark):
    draw = random.Random(1)
    say = lambda: " ".join(draw.choice(["river", "stone", "bird", "late", "cold", "runs"]) for _ in range(30))
    texts = [[say() for _ in range(draw.randint(1, 5))] for _ in range(12)]
    links = "".join(f"<a href=/{i}>some place {draw.random()}</a> " for i in range(3))
    rows = [(i, f"http://Host.example:80/{i}", page(i, "".join(f"<p>{t}</p>" for t in x) + f"<ul>{links}{i}</ul>")) for i, x in enumerate(texts)]
    rows += [(100 + i, "http://copies.example/x", "<body><article><h1>T</h1><p>same everywhere</p></article></body>") for i in range(8)]
    rows += [(200, "http://host.example/y", "<p>no frame<nav>n</nav>"), (201, None, "<p>a"), (202, "nonsense", None), (None, None, "<p>b"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").selectExpr("*", "1 AS text", "'x' AS __tree", "2 AS host")
    out = html_text.main_text(df.repartition(3)).collect()
    got = [(r.page_id, r.text) for r in out]
    want = [(i, "\n".join(x)) for i, x in enumerate(texts)] + [(100 + i, "T\nsame everywhere") for i in range(8)]
    want += [(200, "no frame"), (201, "a"), (202, ""), (None, "b"), (0, "\n".join(texts[0]))]
    assert sorted(got, key=str) == sorted(want, key=str) and all(r.n_chars == len(r.text) for r in out)
    assert html_text.main_text(df.limit(0)).collect() == []


def test_hosts_of_many_shapes(spark, monkeypatch):
    monkeypatch.setattr(html_text, "FAN", 3)
    rows = [(i, "http://h/", f"<body><div class=c{'abcdefghij'[i % 10]}{'x' * (i // 10)}>frame</div><article><p>text {i}</article>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    assert {r.page_id: r.text for r in html_text.main_text(df).collect()} == {i: f"text {i}" for i in range(40)}
    assert len(html_text.templates(df.selectExpr("'h' AS __host", "html AS __html")).collect()) == 1


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_on_given_pages(spark, sf):
    """Their articles are flat, so a pattern finds them."""
    want = {}
    for r in spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want[r.page_id] = (r.url, "\n".join(p for p in parts if p))
    got = queries.op11_html_text(spark, f"/root/testdata/sf{sf}").collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_a_very_long_page():
    text = "<body><article>" + "<p>word &amp; word</p><div class=c>x</div>" * 100_000 + "</article>" + "<li><a href=/>y</a>" * 100_000
    got = alone(text)
    assert len(got) == 200_000 and set(got) == {"word & word", "x"}
