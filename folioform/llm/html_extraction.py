"""Main text of web pages by tag-path ratios.

A page's blocks (runs of text between block-level tags) are grouped by their path of block-level elements from the root, containers
with their classes. For each path the length of its text outside of links and its punctuation, each over its number of blocks, give two
ratios; their product, less the share of links, is the path's score. Scores are smoothed along the page, averaged again over each path,
and paths at or above a share of the page's mean, weighted by text, are content.

What HTML itself names as something else never counts: navigation, page headers and footers, asides, forms, scripts, hidden elements,
and elements whose class, id or role says so in a word (fixed list below). Where a page marks its article, the marked element in which
content paths have most text is the root, and all of its other blocks stay, but for paths made of links. Elsewhere the root is
the deepest element with nearly all text of the content paths, and blocks between content in the same elements stay too.

Pages are parsed one by one within Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Elements that take part in paths and part blocks from each other.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
    "search section summary table tbody td tfoot th thead tr ul head noscript template select optgroup option frameset object".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp svg math".split())
#: Elements whose text is never the article's.
_ELSE = frozenset("head nav header footer aside form button select optgroup option menu dialog noscript template object canvas audio video fieldset search datalist label".split())
#: Words of a class, id or role that say the same.
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner nav navbar navigation navi menu menus megamenu sidebar sidebars header footer masthead topbar toolbar breadcrumb "
    "breadcrumbs crumbs comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices announcement newsletter subscribe subscription signup login share sharing sharebar social related recommended "
    "recommendations trending widget widgets popup popover modal overlay pagination pager paging copyright skiplink contentinfo complementary navigation dialog alert alertdialog search searchbox form outbrain taboola".split()
)
#: Words before one of those that turn it round, as in has-sidebar.
_TURNED = frozenset("has with no without is not hide show".split())
#: Words before "header" that make it the article's.
_OWN_HEADER = frozenset("article post entry content story page section".split())
#: What a start tag closes, where it is open within the same barrier.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "tbody")}
_BARRIERS = frozenset("table td th caption ul ol dl button object template body html".split())
_IN_P = frozenset("tr td th tbody thead tfoot caption li dd dt option optgroup legend summary".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are named in paths without their classes.
_PLAIN = _HEADINGS | frozenset("p li dd dt td th tr tbody thead tfoot pre blockquote figcaption".split())

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TELLS = re.compile(r"\b(?:class|id|role|hidden|style|itemprop)\b", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？،؟।]")

#: Blocks on either side that a score is smoothed over, and their weights.
_SMOOTH = np.exp(-0.5 * (np.arange(-2, 3) / 1.0) ** 2) / np.exp(-0.5 * (np.arange(-2, 3) / 1.0) ** 2).sum()
#: Share of the page's mean score that makes a path content; share of links that makes a path none; share of content that a root holds.
CONTENT, LINKS, ROOT = 0.4, 0.66, 0.85


@lru_cache(maxsize=4096)
def _named(attributes: str) -> tuple[str, bool, bool]:
    """(label, whether the element says that it is something else, whether it says that it is the article) from its attributes."""
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
    names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}"
    other = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")))
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        other = other or any(w in _WORDS and not (k and (words[k - 1] in _TURNED or w == "header" and words[k - 1] in _OWN_HEADER)) for k, w in enumerate(words))
    marked = found.get("role", "").lower() in ("main", "article") or "articlebody" in found.get("itemprop", "").lower()
    return re.sub(r"\d+", "0", f"{found.get('class', '')}#{found.get('id', '')}"), other, marked


class _Page:
    """Elements and blocks of a page. Elements are numbered in page order, parents first; element 0 is the page."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.other, self.marked, self.path = [0], [""], [False], [False], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[str, int, int]] = []  # text, characters in links, element
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, nearest block element, whether its text is dropped
        self.count: defaultdict[str, int] = defaultdict(int)
        self.held: list[str] = []
        self.linked = 0
        self.parse(html)

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.blocks.append((text, min(self.linked, len(text)), self.open[-1][1]))
            self.held, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw and not self.open[-1][2]:
            raw = unescape(raw) if "&" in raw else raw
            self.held.append(raw)
            if self.count["a"]:
                self.linked += len(raw.strip())

    def close(self, names: tuple[str, ...], barriers: frozenset[str]) -> None:
        """Closes the outermost open element of these names that no barrier parts from here."""
        at = 0
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in names:
                at = k
            elif self.open[k][0] in barriers:
                break
        if at:
            self.pop(at)

    def pop(self, at: int) -> None:
        block = False
        for tag, _, _ in self.open[at:]:
            self.count[tag] -= 1
            block = block or tag in _BLOCKS
        if block:
            self.flush()
        del self.open[at:]

    def start(self, tag: str, attributes: str) -> None:
        block = tag in _BLOCKS
        if block:
            self.flush()
            if self.count["p"] and tag not in _IN_P:
                self.close(("p",), _BARRIERS)
        if tag in _CLOSES:
            names = _CLOSES[tag]
            if any(self.count[n] for n in names):
                self.close(names, (_BARRIERS if tag in ("li", "dt", "dd") else frozenset(("table",))) - frozenset(names))
        label, other, marked = _named(attributes) if attributes and _TELLS.search(attributes) else ("#", False, False)
        _, above, dropped = self.open[-1]
        if tag in _VOID:
            if tag in ("br", "wbr") and not dropped:
                self.held.append(" " if tag == "br" else "")
            return
        self.count[tag] += 1
        if not block:
            self.open.append((tag, above, dropped or tag in _ELSE or other))
            return
        self.tag.append(tag)
        self.parent.append(above)
        self.marked.append(marked or tag in ("article", "main"))
        self.other.append(tag in _ELSE or other and not (marked or tag in ("html", "body", "article", "main")) or other and tag == "article" and "comment" in label)
        name = tag if tag in _PLAIN else f"{tag}.{label}"
        self.path.append(self.paths.setdefault((self.path[above], name), len(self.paths) + 1))
        self.open.append((tag, len(self.tag) - 1, dropped))

    def end(self, tag: str) -> None:
        if not self.count[tag]:
            if tag in _BLOCKS or tag == "br":
                self.flush()
            return
        barrier = frozenset(("table", "td", "th")) if tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else frozenset()
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0]
            if name == tag:
                if tag in _BLOCKS or not any(n in _BLOCKS for n, _, _ in self.open[k + 1 :]):
                    self.pop(k)
                else:  # an inline element that began outside of the blocks that are open
                    self.count[tag] -= 1
                    self.open[k] = ("span", *self.open[k][1:])
                    self.count["span"] += 1
                return
            if name in barrier:
                return

    def parse(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            m = _TOKEN.search(html, at)
            if m is None:
                self.text(html[at:])
                break
            self.text(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
            elif tag in _RAW:
                if not m[3].endswith("/"):
                    stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                    at = stop.end() if stop else end
            else:
                self.start(tag, m[3])
        self.flush()


def _dropped(page: _Page) -> list[bool]:
    """For each element whether it is something else than the article, by itself or by what it lies in."""
    n = len(page.tag)
    holds = [False] * n  # an article or the main element
    for e in range(n - 1, 0, -1):
        if page.marked[e] and not page.other[e] or holds[e]:
            holds[page.parent[e]] = True
    inside, out = [False] * n, [False] * n
    for e in range(1, n):
        up = page.parent[e]
        inside[e] = inside[up] or page.marked[e]
        kept = page.tag[e] == "header" and inside[up]  # an article's own header, of which only headings stay
        own = page.other[e] and not (holds[e] and page.tag[e] not in _ELSE or kept)
        out[e] = own or out[up]
        if page.tag[up] == "header" and inside[up] and page.tag[e] not in _HEADINGS | {"hgroup", "div"}:
            out[e] = True
    return out


def _scores(page: _Page, blocks: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, link share, own path) of each block: its path's ratios, fused and smoothed, and the share of links in its path."""
    names, path = np.unique([page.path[e] for _, _, e in blocks], return_inverse=True)
    size = np.array([len(t) for t, _, _ in blocks], dtype=float)
    links = np.array([k for _, k, _ in blocks], dtype=float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t, _, _ in blocks], dtype=float)
    total = lambda x: np.bincount(path, weights=x, minlength=len(names))
    n = total(np.ones(len(blocks)))
    share = total(links) / np.maximum(total(size), 1)
    fused = np.log1p(total(size - links) / n) * np.log1p(total(marks) / n) * np.maximum(0, 1 - share)
    smooth = np.convolve(np.pad(fused[path], 2, mode="edge"), _SMOOTH, mode="valid")
    return (total(smooth) / n)[path] * (fused[path] > 0), share[path], path


def main_blocks(html: str | None) -> list[str]:
    """The blocks of a page's article in page order."""
    page = _Page(html or "")
    gone = _dropped(page)
    bare = lambda e: page.tag[e] == "header"  # noqa: E731  an article's header: its headings alone stay
    blocks = [b for b in page.blocks if not gone[b[2]] and not bare(b[2])]
    if not blocks:
        return []
    score, share, path = _scores(page, blocks)
    size = np.array([len(t) - k for t, k, _ in blocks], dtype=float)
    mean = (score * size).sum() / max(size.sum(), 1)
    chosen = (score >= CONTENT * mean) & (share < LINKS)
    if not chosen.any():
        chosen = share < LINKS
    weight = np.where(chosen, size, 0.0)
    # Text of content paths in each element, its descendants included; where a page marks articles, the one with most is the root.
    held = np.zeros(len(page.tag))
    np.add.at(held, [e for _, _, e in blocks], weight + np.where(share < LINKS, size, 0.0) * 1e-3)
    for e in range(len(page.tag) - 1, 0, -1):
        held[page.parent[e]] += held[e]
    marked = [e for e in range(1, len(page.tag)) if page.marked[e] and not gone[e] and held[e] > 0]
    root, by_mark = 0, False
    if marked:
        most = max(held[e] for e in marked)
        # The innermost marked element that holds nearly as much as any.
        root, by_mark = max(e for e in marked if held[e] >= ROOT * most), True
        if held[root] < 0.25 * held[0]:
            root, by_mark = 0, False
    if not by_mark:
        for e in range(1, len(page.tag)):  # parents come first
            if page.parent[e] == root and held[e] >= ROOT * held[0]:
                root = e
    below = [False] * len(page.tag)
    for e in range(len(page.tag)):
        below[e] = e == root or e > 0 and below[page.parent[e]]
    if by_mark:
        keep = [below[e] and share[k] < LINKS for k, (_, _, e) in enumerate(blocks)]
    else:
        parents = {page.parent[e] if page.tag[e] in _PLAIN else e for k, (_, _, e) in enumerate(blocks) if chosen[k] and below[e]} - {0, *(e for e, t in enumerate(page.tag) if t in ("body", "html"))}
        near = [False] * len(page.tag)
        for e in range(1, len(page.tag)):
            near[e] = e in parents or near[page.parent[e]]
        keep = [bool(below[e] and (chosen[k] or near[e] and share[k] < LINKS)) for k, (_, _, e) in enumerate(blocks)]
    # Headings right above what is kept belong to it.
    for k in range(len(blocks) - 2, -1, -1):
        e = blocks[k][2]
        if not keep[k] and keep[k + 1] and page.tag[e] in _HEADINGS and share[k] < LINKS:
            keep[k] = True
    return [t for (t, _, _), x in zip(blocks, keep) if x]


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row: the article's blocks, each with its white space as single spaces, joined by newlines.

    Character references are decoded. A page without an article, an empty or a null one gives an empty text; broken markup is read as far
    as it can be. A null or repeated page_id is a row like any other; an empty table gives no rows; other columns are ignored. Rows do
    not depend on each other.
    """

    def scan(batches):
        for batch in batches:
            texts = ["\n".join(main_blocks(h.as_py())) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = {k: pages.schema[k].dataType.simpleString() for k in ("page_id", "url")}
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(scan, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, and its length in code points."""
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
