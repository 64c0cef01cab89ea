"""Reading HTML as it comes: a page as a tree of labelled places and the runs of text that lie in them.

Elements of one parent that look alike (tag, classes, known roles) are one place, so that a page of a thousand paragraphs
and one of three have the same tree. Missing end tags are supplied as browsers do, inline elements that carry no role
make no place.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# -- fixed values: elements of HTML by their behaviour ---------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr"
    " main menu nav ol p pre search section summary table ul".split()
)
BLOCKS = CLOSES_P | frozenset("html head body li dt dd tr td th thead tbody tfoot caption optgroup option legend noscript select".split())
#: An opening tag ends open ones of these, up to the fence.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
P_FENCE = frozenset("table td th caption button object html".split())
# -- fixed values: elements and names that say what is not the article ------------------------------------------------
ASIDE_TAGS = frozenset(
    "head nav footer aside form script style noscript template iframe svg math button select textarea input dialog menu object"
    " canvas audio video map label".split()
)
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs comment comments consent cookie"
    " cookies copyright discussion disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice"
    " overlay pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar"
    " signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
ARTICLE_WORDS = frozenset(["articlebody", "main"])
HEADER_WORDS = frozenset(["header"])
# --------------------------------------------------------------------------------------------------------------------
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</[^a-zA-Z][^>]*>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
#: Elements nested deeper lie beside each other, as in browsers.
DEPTH = 256


@dataclass
class Page:
    """Places (``labels`` with their ``parents``, the root first) and runs (place, number of the block, text, in a link)."""

    labels: list[str] = field(default_factory=lambda: ["#"])
    parents: list[int] = field(default_factory=lambda: [-1])
    runs: list[tuple[int, int, str, bool]] = field(default_factory=list)


def tag_of(label: str) -> str:
    return label.partition(".")[0].partition("#")[0]


def words_of(label: str) -> set[str]:
    return set(_WORD.findall(label[len(tag_of(label)) :]))


def _label(tag: str, rest: str) -> str:
    """Tag, classes without digits, and of id, role and item property what names a part of a page."""
    if "=" not in rest and "hidden" not in rest:
        return tag
    found = {}
    for name, *values in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), html.unescape("".join(values)).lower())
    classes = sorted({re.sub(r"\d+", "", c) for c in found.get("class", "").split()} - {""})
    said = set(_WORD.findall(" ".join(found.get(a, "") for a in ("id", "role", "itemprop"))))
    roles = said & (ASIDE_WORDS | ARTICLE_WORDS | HEADER_WORDS)
    if "hidden" in found or "display:none" in found.get("style", "").replace(" ", ""):
        roles.add("hidden")
    return tag + "".join(f".{c}" for c in classes) + "".join(f"#{r}" for r in sorted(roles))


def read_page(text: str) -> Page:
    """The page; any string is one. Work and memory are in proportion to its length."""
    page = Page()
    places: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int, bool, bool]] = [("#", 0, True, False)]  # tag, place, whether a block, whether in a link
    block = at = 0

    def close_to(depth: int) -> None:
        nonlocal block
        if any(s[2] for s in stack[depth:]):
            block += 1
        del stack[depth:]

    def put(part: str) -> None:
        _, place, _, link = stack[-1]
        page.runs.append((place, block, html.unescape(part) if "&" in part else part, link))

    while True:
        token = _TOKEN.search(text, at)
        if token is None:
            break
        if token.start() > at:
            put(text[at : token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if token["end"]:
            if tag in ("body", "html") or tag in VOID and tag != "br":
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close_to(depth)
                    break
                if stack[depth][2] and (tag not in BLOCKS or stack[depth][0] in ("td", "th", "table") and tag not in ENDS and tag != "table"):
                    break  # an inline end tag ends nothing beyond its block, a block's nothing beyond its cell
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close_to(depth)
                    break
                if stack[depth][0] in P_FENCE:
                    break
        if tag in HEADINGS and stack[-1][0] in HEADINGS:
            close_to(len(stack) - 1)
        if tag in ENDS:
            ended, fence = ENDS[tag]
            lowest = 0
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in fence:
                    break
                if stack[depth][0] in ended:
                    lowest = depth
            if lowest:
                close_to(lowest)
        is_block = tag in BLOCKS
        if is_block:
            block += 1
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        parent, link = stack[-1][1], stack[-1][3] or tag == "a"
        label = _label(tag, token["rest"])
        place = parent
        if is_block or tag in ASIDE_TAGS or words_of(label) & ASIDE_WORDS:
            place = places.get((parent, label), -1)
            if place < 0:
                place = places[parent, label] = len(page.labels)
                page.labels.append(label)
                page.parents.append(parent)
        if len(stack) < DEPTH:
            stack.append((tag, place, is_block, link))
    if at < len(text):
        put(text[at:])
    return page


def blocks(page: Page, kept: list[bool]) -> list[str]:
    """Text of the kept places by block, each with its white space as single spaces; empty ones are left out."""
    out, last, held = [], -1, []
    for place, block, text, _ in [*page.runs, (0, -2, "", False)]:
        if block != last:
            if held and (joined := " ".join("".join(held).split())):
                out.append(joined)
            last, held = block, []
        if block >= 0 and kept[place]:
            held.append(text)
    return out
