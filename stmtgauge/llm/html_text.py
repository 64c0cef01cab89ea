"""Main text of web pages by wrapper induction.

The pages of a host are laid over each other: their trees are aligned by simple tree matching (the largest set of pairs of
nodes of equal tag that keeps order and ancestry) into one template, whose places know on how many pages they occur, how
much text and link text they hold, and whether that text is the same everywhere. What is constant is the template's; what
varies is content, unless it is a menu, an advert, a comment and the like, which vary too and say so by element or name.
An ``article`` or ``main`` element bounds the content; where a page has none, the place that holds nearly all of the text
that varies does.

All pages take part in the template of their host. Statistics are pooled in tasks, then by host and shape of tree, and the
shapes of a host meet in groups of bounded size; no task sees the pages of a host.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtgauge.llm.common import materialize, schema_with, small, spread, table, with_columns
from stmtgauge.llm.dom import ARTICLE_WORDS, ASIDE_TAGS, ASIDE_WORDS, HEADER_WORDS, HEADINGS, Page, blocks, read_page, tag_of, words_of

#: Text is constant when it is the same on so many pages, which are this share of the pages of the host and vary elsewhere.
CONSTANT_PAGES, CONSTANT_SHARE = 5, 0.5
#: A region without a name is narrowed while one part of it holds this share of its varying text; parts with more link text
#: than this share are menus.
NARROW, LINKS = 0.8, 0.5
#: Shapes of one host that are laid over each other in one task, tables of children that are compared cell by cell, and
#: statistics that a task holds before it passes them on.
FAN, CELLS, HELD = 256, 20_000, 1 << 16
_CONTAINERS = frozenset("# html body div section main article center table tbody tr td header hgroup details figure fieldset".split())
_STATS = ("pages", "chars", "links", "low", "high", "page_low", "page_high")


# -- simple tree matching --------------------------------------------------------------------------------------------
class Tree:
    """Nodes in the order they were added, the root first; children in the order of the pages."""

    def __init__(self, labels: list[str], parents: list[int], children: list[list[int]] | None = None):
        self.labels, self.parents = labels, parents
        self.tags = [tag_of(x) for x in labels]
        self.children = children or [[] for _ in labels]
        if children is None:
            for i, p in enumerate(parents[1:], 1):
                self.children[p].append(i)


def aligned(a: Tree, b: Tree) -> dict[int, int]:
    """For nodes of ``b`` the node of ``a`` they are matched with."""
    if a.labels == b.labels and a.parents == b.parents and a.children == b.children:
        return {i: i for i in range(len(b.labels))}
    scores: dict[tuple[int, int], int] = {}

    def table_of(i: int, j: int) -> list[list[int]]:
        """Best score of the first so many children of both; equal labels count more than equal tags."""
        rows = [[0] * (len(b.children[j]) + 1)]
        for x in a.children[i]:
            row, above = [0], rows[-1]
            for k, y in enumerate(b.children[j]):
                best = max(row[k], above[k + 1])
                if a.tags[x] == b.tags[y]:
                    best = max(best, above[k] + score(x, y))
                row.append(best)
            rows.append(row)
        return rows

    def by_name(i: int, j: int) -> list[tuple[int, int]]:
        """Of very many children those of equal label; siblings have different ones."""
        named = {a.labels[x]: x for x in a.children[i]}
        return [(named[b.labels[y]], y) for y in b.children[j] if b.labels[y] in named]

    def score(i: int, j: int) -> int:
        if (i, j) not in scores:
            own = 1 + 2 * (a.labels[i] == b.labels[j])
            if len(a.children[i]) * len(b.children[j]) > CELLS:
                own += sum(score(x, y) for x, y in by_name(i, j))
            else:
                own += table_of(i, j)[-1][-1]
            scores[i, j] = own
        return scores[i, j]

    out, todo = {}, [(0, 0)]
    while todo:
        i, j = todo.pop()
        out[j] = i
        if len(a.children[i]) * len(b.children[j]) > CELLS:
            todo += by_name(i, j)
            continue
        rows, x, y = table_of(i, j), len(a.children[i]), len(b.children[j])
        while x and y:
            one, two = a.children[i][x - 1], b.children[j][y - 1]
            if a.tags[one] == b.tags[two] and rows[x][y] == rows[x - 1][y - 1] + score(one, two):
                todo.append((one, two))
                x, y = x - 1, y - 1
            elif rows[x][y] == rows[x - 1][y]:
                x -= 1
            else:
                y -= 1
    return out


class Template(Tree):
    """A tree with the pooled statistics of the pages laid over it."""

    def __init__(self, labels, parents, stats: dict[str, list[int]], children=None):
        super().__init__(list(labels), list(parents), children)
        self.stats = {k: list(v) for k, v in stats.items()}

    def lay(self, other: Template) -> None:
        """Pool ``other`` into this template; nodes without a match are added after the sibling they follow."""
        match = aligned(self, other)
        for j in range(len(other.labels)):
            if j in match:
                i = match[j]
                for k in ("pages", "chars", "links"):
                    self.stats[k][i] += other.stats[k][j]
                for k in ("low", "page_low"):
                    self.stats[k][i] = min(self.stats[k][i], other.stats[k][j])
                for k in ("high", "page_high"):
                    self.stats[k][i] = max(self.stats[k][i], other.stats[k][j])
                continue
            parent, i = match[other.parents[j]], len(self.labels)
            match[j] = i
            siblings = other.children[other.parents[j]]
            before = [match[s] for s in siblings[: siblings.index(j)] if s in match]
            at = self.children[parent].index(before[-1]) + 1 if before and before[-1] in self.children[parent] else 0
            self.children[parent].insert(at, i)
            self.labels.append(other.labels[j])
            self.parents.append(parent)
            self.tags.append(other.tags[j])
            self.children.append([])
            for k in _STATS:
                self.stats[k].append(other.stats[k][j])

    def text(self) -> str:
        return json.dumps([self.labels, self.parents, self.children, self.stats], separators=(",", ":"))

    @classmethod
    def of(cls, text: str) -> Template:
        labels, parents, children, stats = json.loads(text)
        return cls(labels, parents, stats, children)


# -- what of a page is content ---------------------------------------------------------------------------------------
def content(page: Tree, template: Template | None) -> list[bool]:
    """For each place of a page whether its own text is main text."""
    n = len(page.labels)
    match = aligned(template, page) if template else {}
    stat = lambda k, i: template.stats[k][match[i]] if i in match else 0
    every = template.stats["pages"][0] if template else 0
    own = [stat("chars", i) for i in range(n)]
    links = [stat("links", i) for i in range(n)]
    constant = [
        i in match
        and stat("low", i) == stat("high", i)
        and stat("page_low", i) != stat("page_high", i)
        and stat("pages", i) >= max(CONSTANT_PAGES, CONSTANT_SHARE * every)
        for i in range(n)
    ]
    words = [words_of(x) for x in page.labels]
    named = [bool(w & ASIDE_WORDS) for w in words]
    head = [i > 0 and (page.tags[i] in ("article", "main") or bool(words[i] & ARTICLE_WORDS)) for i in range(n)]
    sums = lambda values: _sums(page.parents, values)
    chars, heads = sums(own), sums([h and not a for h, a in zip(head, named)])
    out, inside_head = [False] * n, [False] * n
    for i in range(1, n):
        p = page.parents[i]
        # A frame around the article may be named after what else it holds.
        frame = page.tags[i] in ("html", "body") or heads[i] > (head[i] and not named[i]) and 2 * chars[i] >= chars[0]
        top = not inside_head[p] and (page.tags[i] == "header" or bool(words[i] & HEADER_WORDS))
        out[i] = out[p] or page.tags[i] in ASIDE_TAGS or (named[i] or top) and not frame
        inside_head[i] = inside_head[p] or head[i] and not out[i]
    roots = [i for i in range(n) if head[i] and not out[i]]
    articles = [i for i in roots if page.tags[i] == "article"]
    if articles and (2 * sum(chars[i] for i in articles) >= max(chars[i] for i in roots) or not any(chars)):
        roots = articles
    if roots:
        inside = _below(page.parents, roots)
        varies = any(inside[i] and not out[i] and own[i] and not constant[i] for i in range(n))
        return [inside[i] and not out[i] and not (constant[i] and varies and page.tags[i] not in HEADINGS) for i in range(n)]
    linked = sums(links)
    for i in range(1, n):
        out[i] = out[i] or out[page.parents[i]] or page.tags[i] not in ("html", "body") and linked[i] > LINKS * max(1, chars[i])
    varies = any(own[i] and not out[i] and not constant[i] for i in range(n))
    gone = [out[i] or constant[i] and varies for i in range(n)]
    mass, root = sums([0 if gone[i] else own[i] - links[i] for i in range(n)]), 0
    while True:
        heir = max((c for c in page.children[root] if page.tags[c] in _CONTAINERS), key=lambda c: mass[c], default=None)
        if heir is None or mass[heir] < NARROW * mass[root] or not mass[root]:
            break
        root = heir
    inside = _below(page.parents, [root])
    return [inside[i] and not gone[i] for i in range(n)]


def _sums(parents: list[int], values: list) -> list[int]:
    """Of every place with all below it; parents come first."""
    out = [int(v) for v in values]
    for i in range(len(out) - 1, 0, -1):
        out[parents[i]] += out[i]
    return out


def _below(parents: list[int], roots: list[int]) -> list[bool]:
    out = [i in set(roots) for i in range(len(parents))]
    for i in range(1, len(parents)):
        out[i] = out[i] or out[parents[i]]
    return out


# -- the distributed part --------------------------------------------------------------------------------------------
def _measured(page: Page) -> dict[str, list[int]]:
    """Statistics of one page by place: pages, characters, those in links, digests of the place's text and the page's."""
    n = len(page.labels)
    chars, links, texts = [0] * n, [0] * n, [[] for _ in range(n)]
    for place, _, text, link in page.runs:
        if kept := " ".join(text.split()):
            chars[place] += len(kept)
            links[place] += len(kept) * link
            texts[place].append(kept)
    signed = lambda t: xxhash.xxh64_intdigest("\n".join(t).encode(errors="surrogatepass")) - (1 << 63)
    own = [signed(t) for t in texts]
    whole = signed([t for part in texts for t in part])
    return dict(zip(_STATS, ([1] * n, chars, links, own, own, [whole] * n, [whole] * n)))


def _shapes(pages: DataFrame) -> DataFrame:
    """``host``, ``tree`` (JSON) of every shape of tree on a host with its pooled statistics as a template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[str, list[int]]] = {}

        def rows() -> pa.RecordBatch:
            out = []
            for (host, shape), stats in held.items():
                key = xxhash.xxh3_128_digest(shape.encode(errors="surrogatepass"))
                for i, values in enumerate(zip(*(stats[k] for k in _STATS))):
                    out.append((host, key, i, shape if not i else None, *values))
            held.clear()
            types = [pa.string(), pa.binary(), pa.int32(), pa.string(), *[pa.int64()] * len(_STATS)]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            return pa.RecordBatch.from_arrays(columns, ["host", "key", "node", "shape", *_STATS])

        for batch in batches:
            for host, text in zip(batch.column("__host").to_pylist(), batch.column("__html")):
                page = read_page(text.as_py() or "")
                stats, at = _measured(page), (host, json.dumps([page.labels, page.parents]))
                if at not in held:
                    held[at] = stats
                    continue
                old = held[at]
                for k in _STATS:
                    join = min if k.endswith("low") else max if k.endswith("high") else int.__add__
                    old[k] = [join(x, y) for x, y in zip(old[k], stats[k])]
            if sum(len(s["pages"]) for s in held.values()) > HELD:
                yield rows()
        if held:
            yield rows()

    kinds = ", ".join(f"{k} bigint" for k in _STATS)
    found = pages.select("__host", "__html").mapInArrow(run, f"host string, key binary, node int, shape string, {kinds}")
    sums = [(F.min if k.endswith("low") else F.max if k.endswith("high") else F.sum)(k).alias(k) for k in _STATS]
    nodes = found.groupBy("host", "key", "node").agg(F.max("shape").alias("shape"), *sums)
    row = F.struct("node", *_STATS)
    return nodes.groupBy("host", "key").agg(F.max("shape").alias("shape"), F.array_sort(F.collect_list(row)).alias("nodes"))


def _laid(pdf: pd.DataFrame) -> pd.DataFrame:
    """One template of all that is given: the most frequent first."""
    found = sorted(((t.stats["pages"][0], key, t) for key, t in zip(pdf["key"], map(Template.of, pdf["tree"]))), key=lambda x: (-x[0], x[1]))
    first = found[0][2]
    for _, _, t in found[1:]:
        first.lay(t)
    return pd.DataFrame({"host": pdf["host"].iloc[:1], "key": [found[0][1]], "tree": [first.text()]})


def templates(pages: DataFrame) -> DataFrame:
    """``host`` and ``tree``: one template per ``__host`` of the pages (``__html``)."""

    def as_template(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            trees = []
            for shape, nodes in zip(pdf["shape"], pdf["nodes"]):
                labels, parents = json.loads(shape)
                trees.append(Template(labels, parents, {k: [int(n[k]) for n in nodes] for k in _STATS}).text())
            yield pd.DataFrame({"host": pdf["host"], "key": pdf["key"], "tree": trees})

    schema = "host string, key binary, tree string"
    found = materialize(_shapes(pages).mapInPandas(as_template, schema), "shapes")
    while True:
        counts = found.groupBy("host").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return found.select("host", "tree")
        counts = small(counts, counts.count(), 128)
        part = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / FAN)).alias("part")
        dealt = found.join(counts, "host").select("host", "key", "tree", part)
        found = materialize(dealt.groupBy("host", "part").applyInPandas(_laid, schema), "templates")


def main_text(pages: DataFrame, url: str = "url", source: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``, the main text of each page, and ``n_chars``; columns of these names are replaced.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one line feed in
    the order of the page; nothing else is dropped or capped. Null html is empty, and its text too. Pages of a null url or
    one without a host are laid over each other as those of one host. Repeated rows count as often as they occur, which
    makes no text constant that is not the same on pages that differ elsewhere. Of a host with few pages elements and
    names alone decide. An empty table gives no rows.

    Pages are read twice, for the templates and for the text, and never shuffled: templates are broadcast where their
    measured size allows it, else joined by host.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    given = {c: f"{c}_given" for c in ("__host", "__html", "__tree")}
    named = pages.withColumnsRenamed(given).withColumns({"__host": host, "__html": F.col(source).cast("string")})
    found = templates(named)
    rows, size = found.agg(F.count("*"), F.coalesce(F.max(F.length("tree")), F.lit(0))).first()
    found = found.select(F.col("host").alias("__host"), F.col("tree").alias("__tree"))
    joined = named.join(small(found, rows, 4 * size + 256), "__host", "left")
    drop = ("__host", "__html", "__tree", out, "n_chars")
    schema = schema_with(joined.select(*[c for c in joined.columns if c not in drop]), **{out: "string", "n_chars": "bigint"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = lru_cache(64)(Template.of)
        kept = lru_cache(4096)(lambda tree, shape: content(Tree(*json.loads(shape)), template(tree)))
        for batch in batches:
            texts = []
            for text, tree in zip(batch.column("__html"), batch.column("__tree")):
                page = read_page(text.as_py() or "")
                texts.append("\n".join(blocks(page, kept(tree.as_py(), json.dumps([page.labels, page.parents])))))
            added = {out: pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}
            yield with_columns(batch, added, drop)

    return joined.mapInArrow(run, schema).withColumnsRenamed({v: k for k, v in given.items()})


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "html")
    return main_text(pages).select("page_id", "url", "text", "n_chars")
