"""Main text of web pages by tag-path ratios.

A page is read into blocks, each with its root-to-leaf path of element names and classes. Per path, text length and
punctuation are divided by the leaves of the path; both ratios are smoothed over neighbouring blocks in page order,
fused, lessened by the share of link text and weighted by what names say (weak evidence: a path through ``nav`` or a
class ``advert`` counts for less, one through ``article`` for more, and none decides alone). Paths whose score
reaches a share of the page's largest are content paths; no content path, no text. The content region is the deepest
container that holds most content text against other text. Inside it the other blocks (headings, short items, captions)
stay unless their own score or their names, against those of the region, speak for boilerplate; a headline or
the page's title right before the region belongs to it.

Only what a browser never shows as text (scripts, styles, templates, hidden parts, controls) is left out beforehand.
Paths are numbered by (number of the parent's path, label), sums run bottom-up once over the elements: the time is linear
in the page, however deep it nests.

Defined results: null and empty html give the empty text; text outside any element counts as a block of the body;
unclosed and stray tags are tolerated; equal rows get equal results; further columns are not read. Character
references are decoded, white space inside a block becomes one space (a line break too), blocks are joined by \\n.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)|([^>]*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text a browser does not show as part of the page.
UNSHOWN = frozenset("script style head title noscript template button select option textarea input iframe object svg canvas audio video".split())
#: A block of these holds text, not other blocks of an article: a region is never one of them.
LEAVES = frozenset("p blockquote pre li ul ol menu dl dt dd td th tr tbody thead tfoot table caption figure figcaption h1 h2 h3 h4 h5 h6 address summary legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
#: Names that speak against content, in tags (or roles) and in words of class and id values; and those that speak for it.
AGAINST_TAGS = frozenset("nav footer aside form menu dialog header fieldset".split())
AGAINST_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner breadcrumb breadcrumbs comment comments commentlist disqus respond cookie cookies consent gdpr notice notices notification popup modal overlay footer header menu menus nav navbar navigation sidebar sidebars aside widget widgets related recommended recommendations share sharing social newsletter subscribe subscription signup login pagination pager toolbar masthead skip".split())
FOR_TAGS = frozenset("article main".split())
AGAINST, FOR = 0.08, 1.6
#: Inside a region, a path that names make this much less likely than the region is boilerplate.
OUT_OF_PLACE = 0.5
CLOSES = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option", "p")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
PUNCTUATION = frozenset(".,;:!?…。，；：！？、¿¡\"'()«»„“”")
SMOOTHING = np.array([0.1, 0.2, 0.4, 0.2, 0.1])
THRESHOLD = 0.35
#: A path inside the region is out when its score is below this share of the largest and it holds mostly links.
REGION_THRESHOLD, LINKS = 0.12, 0.6


class Block(NamedTuple):
    element: int
    path: int
    text: str
    links: int  # characters inside links


class Page(NamedTuple):
    """Elements in opening order (name, parent, path), the prior of each path, blocks in page order, the title."""

    names: list[str]
    parents: list[int]
    paths: list[int]
    priors: list[float]
    blocks: list[Block]
    title: str


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}


def _hidden(name: str, a: dict[str, str]) -> bool:
    return name in UNSHOWN or bool(a) and ("hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower())


def _speaks_against(a: dict[str, str]) -> bool:
    words = re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{a.get('class', '')} {a.get('id', '')}").lower())
    return a.get("role", "").lower() in ROLES or not AGAINST_WORDS.isdisjoint(words)


def _evidence(name: str, a: dict[str, str], in_article: bool) -> float:
    """How much a name changes the odds of an element's text: a factor."""
    if name in FOR_TAGS:
        return FOR
    if name in ("html", "body"):
        return 1.0
    against = name in AGAINST_TAGS and not (name == "header" and in_article)
    return AGAINST if against or a and _speaks_against(a) else 1.0


def read(source: str) -> Page:
    names, parents, paths, priors = ["html"], [-1], [0], [1.0]
    hidden, in_article = [False], [False]
    number: dict[tuple[int, str], int] = {}
    stack, places = [0], {"html": [0]}  # open elements, and per name where they stand in the stack
    blocks: list[Block] = []
    held: list[str] = []
    titles: list[str] = []
    inline: list[tuple[str, bool]] = []  # open elements that make no block; true: its text is not shown
    inline_open: Counter = Counter()
    blocked = links = 0

    def path_number(parent: int, label: str, factor: float) -> int:
        if (parent, label) not in number:
            number[parent, label] = len(priors)
            priors.append(max(priors[parent] * factor, 1e-6))
        return number[parent, label]

    def end_block():
        nonlocal links
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                path = paths[stack[-1]]
                if 2 * links > len(text):  # the leaf is a link
                    path = path_number(path, "a", 1.0)
                blocks.append(Block(stack[-1], path, text, min(links, len(text))))
        links = 0

    def shown(piece: str):
        nonlocal links
        if not blocked and not hidden[stack[-1]]:
            held.append(html.unescape(piece) if "&" in piece else piece)
            if inline_open["a"]:
                links += len(held[-1])

    def cut(depth: int):
        nonlocal blocked
        for e in stack[depth:]:
            places[names[e]].pop()
        del stack[depth:]
        inline.clear(), inline_open.clear()
        blocked = 0

    def last(of) -> int:
        return max((places[x][-1] for x in of if places.get(x)), default=-1)

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            shown(source[at:])
            break
        if m.start() > at:
            shown(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, raw = m[2].lower(), m[3] or m[4] or ""
        if m[1]:
            if name in BLOCK:
                depth = last((name,))
                if depth > 0:
                    end_block()
                    cut(depth)
            elif inline_open[name]:
                while True:
                    x, s = inline.pop()
                    inline_open[x] -= 1
                    blocked -= s
                    if x == name:
                        break
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
            if name == "title":
                titles.append(" ".join(html.unescape(source[at : close.start() if close else n]).split()))
            at = close.end() if close else n
            continue
        if name in VOID and name != "hr":
            if name == "br":
                shown(" ")
            continue
        a = _attributes(raw)
        if name in BLOCK:
            end_block()
            if name in CLOSES:
                stop = last(SCOPE[name])
                while (depth := last(CLOSES[name])) > max(stop, 0):
                    cut(depth)
            elif names[stack[-1]] == "p":
                cut(len(stack) - 1)
            inline.clear(), inline_open.clear()
            blocked = 0
            if name in ("hr", "html") or name == "body" and places.get("body"):
                continue
            up = stack[-1]
            factor = _evidence(name, a, in_article[up])
            label = f"{name}.{'.'.join(sorted(a.get('class', '').split()))}.{factor}"
            places.setdefault(name, []).append(len(stack))
            stack.append(len(names))
            names.append(name), parents.append(up), paths.append(path_number(paths[up], label, factor))
            hidden.append(hidden[up] or _hidden(name, a)), in_article.append(in_article[up] or name == "article")
        elif not raw.endswith("/"):
            s = _hidden(name, a) or bool(a) and _speaks_against(a)
            inline.append((name, s))
            inline_open[name] += 1
            blocked += s
    end_block()
    return Page(names, parents, paths, priors, blocks, next((t for t in titles if t), ""))


def path_scores(page: Page) -> np.ndarray:
    """Per path number the fused score of its ratios; 0 for paths without text."""
    path = np.array([b.path for b in page.blocks])
    size = len(page.priors)
    length = np.array([len(b.text) for b in page.blocks], float)
    marks = np.array([sum(map(b.text.count, PUNCTUATION)) for b in page.blocks], float)
    leaves = np.maximum(np.bincount(path, minlength=size), 1)
    total = np.bincount(path, length, size)
    plain = 1 - np.bincount(path, [b.links for b in page.blocks], size) / np.maximum(total, 1)
    length_ratio, mark_ratio = total / leaves, np.bincount(path, marks, size) / leaves

    def smooth(x):
        return np.convolve(np.pad(x[path], 2, mode="edge"), SMOOTHING, "valid")

    fused = np.log1p(smooth(length_ratio)) * (1 + np.log1p(smooth(mark_ratio))) * np.log1p(length_ratio[path])
    return np.bincount(path, fused, size) / leaves * plain * np.array(page.priors)


def content_paths(page: Page, threshold: float = THRESHOLD) -> set[int]:
    """The paths whose score reaches the threshold, a share of the page's largest, and that hold more than a trifle of text."""
    score = path_scores(page)
    total = np.bincount([b.path for b in page.blocks], [len(b.text) for b in page.blocks], len(score))
    weight = score * np.sqrt(total / total.max())
    return set(np.flatnonzero((score > 0) & (score >= threshold * score.max()) & (weight >= 0.25 * weight.max())).tolist())


def region_of(page: Page, chosen: set[int]) -> int:
    """The deepest container with the largest content text less other text (headings count for neither)."""
    value, depth = [0.0] * len(page.names), [0] * len(page.names)
    for b in page.blocks:
        if b.path in chosen:
            value[b.element] += len(b.text)
        elif page.names[b.element] not in HEADINGS:
            value[b.element] -= len(b.text)
    for e in range(1, len(page.names)):
        depth[e] = depth[page.parents[e]] + 1
    for e in range(len(page.names) - 1, 0, -1):
        value[page.parents[e]] += value[e]
    boxes = [e for e, name in enumerate(page.names) if name not in LEAVES]
    return max(boxes, key=lambda e: (value[e], depth[e]))


def main_text(source: str) -> str:
    page = read(source)
    if not page.blocks:
        return ""
    chosen = content_paths(page)
    if not chosen:
        return ""
    region = region_of(page, chosen)
    inside = [False] * len(page.names)
    for e in range(len(page.names)):
        inside[e] = e == region or e > 0 and inside[page.parents[e]]
    score, prior = path_scores(page), page.priors[page.paths[region]]
    low = REGION_THRESHOLD * score.max()
    links, total = Counter(), Counter()
    for b in page.blocks:
        links[b.path] += b.links
        total[b.path] += len(b.text)

    def stays(b: Block) -> bool:
        if b.path in chosen:
            return True
        return page.priors[b.path] >= OUT_OF_PLACE * prior and not (score[b.path] < low and links[b.path] > LINKS * total[b.path])

    out = [i for i, b in enumerate(page.blocks) if inside[b.element] and stays(b)]
    if not out:
        return ""
    lead = out[0] - 1  # a headline outside the region's element
    if lead >= 0 and not inside[page.blocks[lead].element]:
        b = page.blocks[lead]
        if page.priors[b.path] >= OUT_OF_PLACE * min(prior, 1.0) and (page.names[b.element] in ("h1", "h2") or b.text == page.title):
            out.insert(0, lead)
    return "\n".join(page.blocks[i].text for i in out)


def extract(pages: list[bytes]) -> list[pa.Array]:
    texts = [main_text(p.decode()) for p in pages]
    return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]


def page_texts(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """One row per page: the kept columns, its main text and its length. No shuffle."""
    return common.per_row(pages, list(keep), html_col, extract, "text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(common.table(spark, sf_dir, "pages"))


QUERIES = {"op10_html_text": op10_html_text}
ORACLE: dict[str, str] = {}
