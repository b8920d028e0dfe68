"""HTML extraction by tree scoring.

A page becomes a tree of elements and a list of blocks, the runs of text between borders of block elements. Parts that are no
article by their element, role or attributes (menus, headers, footers, sidebars, adverts, scripts, styles, hidden parts) are
never entered. A part named like a menu, advert, notice or readers' comments by its class or id is left out only if the whole
name says so, or if the name holds such a word and links fill half of the part; a form only if it doesn't hold the article.
Each block passes points for its length and commas to its container and, less, to the container's ancestors; a container's
points are discounted by the share of its text inside links. The best container, widened to the article element around it,
its siblings that score well or are text of their own, and other articles that score well give the main text. Time is linear
in the page, however deep it nests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasweave.llm._spark import bounded
from atlasweave.llm._text import pieces

# HTML elements by kind.
RAW = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("nav footer aside script style noscript template iframe object svg canvas audio video button select option textarea input label dialog menu head title fieldset datalist search".split())
PARAGRAPHS = frozenset("p pre td th li dd dt blockquote h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
# Words of class names and ids, our own choice. PLAIN ones name parts that are never the article; MAYBE ones may also name what
# an article is about, so they count outside articles only; NEUTRAL ones say nothing about the content.
PLAIN = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs captcha comment commentlist comments cookie cookies disqus footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted related recommended share sharing shoutbox sidebar sidenav signin signup social sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget widgets".split())
MAYBE = frozenset("bookmark community consent copyright disclaimer discussion donate extra feedback foot header hidden legal login paging privacy promotion recommend register remark reply respond responses rss search side skip skyscraper survey tags toc tweet warning".split())
NEUTRAL = frozenset("a and area bar block body bottom box button buttons center col column container content desktop first footer form group holder inline inner item items js large last layout left link links list main mobile module of on outer page panel post posts primary region right root row secondary section site slot small stories sub the title top unit wrap wrapper".split())
READERS = frozenset("comment comments commentlist disqus discussion responses related recommended".split())  # may hold articles that aren't the page's
#: An open element of the key is closed by the start of one of the values (to the nearest element that holds them).
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w-])(hidden)(?![\w-])")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


def _flag(tag: str, attributes: str, in_article: bool) -> tuple[bool, int, bool]:
    """Whether an element is never entered; if it is, 1: its name says it is no article, 2: a word of its name does, 3: a form;
    and whether it stays all the same if it holds the article."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True, 0, False
    form = 3 if tag == "form" else 0
    if not attributes:
        return False, form, True
    named: list[list[str]] = []
    for key, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        key = key.lower()
        if bare or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, 0, False
        if key == "role" and value.lower() in ROLES and tag not in ("html", "body") and value.lower() != "form":
            return True, 0, False
        if key in ("class", "id"):
            named += [[x.lower() for x in _NAMES.findall(token)] for token in value.split()]
    if tag in ("html", "body", "main"):
        return False, form, True
    flag, stays = form, True
    for words in named:
        if not words or {"with", "has", "no", "without"}.intersection(words):
            continue
        told = [w in PLAIN or not in_article and w in MAYBE for w in words]
        if not any(told) or tag == "article" and not READERS.intersection(words):
            continue
        whole = all(t or w in NEUTRAL for t, w in zip(told, words))
        if not whole and not in_article and tag not in PARAGRAPHS and words[-1] in PLAIN:
            whole = True  # such as top-nav
        flag = 1 if whole or flag == 1 else 2
        stays = stays and not READERS.intersection(words)
    return False, flag, stays


class Page:
    """The page as a tree: tags, parents and flags of the elements in page order, and blocks (element, text, length inside links)."""

    def __init__(self, html: str):
        self.tags, self.parents, self.flags, self.stays = ["#page"], [-1], [0], [True]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack = [0]  # open elements
        self._open: dict[str, list[int]] = {}  # where on the stack each tag is open
        self._borders = [0]  # open block elements
        self._parts: list[str] = []
        self._linked = self._links = self._articles = 0
        self._read(html)

    def _flush(self) -> None:
        if self._parts:
            text = _SPACE.sub(" ", unescape("".join(self._parts))).strip()
            if text:
                self.blocks.append((self._borders[-1], text, min(self._linked, len(text))))
            self._parts.clear()
        self._linked = 0

    def _push(self, tag: str, flag: int, stays: bool) -> None:
        self._open.setdefault(tag, []).append(len(self._stack))
        self.parents.append(self._stack[-1])
        self._stack.append(len(self.tags))
        if tag in BLOCKS:
            self._borders.append(len(self.tags))
        self.tags.append(tag)
        self.flags.append(flag)
        self.stays.append(stays)
        self._links += tag == "a"
        self._articles += tag in ("article", "main")

    def _close(self, at: int) -> None:
        """Closes all from a place on the stack on."""
        while len(self._stack) > at:
            tag = self.tags[self._stack[-1]]
            if tag in BLOCKS:
                self._flush()
                self._borders.pop()
            self._links -= tag == "a"
            self._articles -= tag in ("article", "main")
            self._open[tag].pop()
            self._stack.pop()

    def _last(self, tags) -> int:
        """The innermost place on the stack of any of the tags, else 0."""
        return max((self._open[t][-1] for t in tags if self._open.get(t)), default=0)

    def _end(self, tag: str) -> None:
        if at := self._last((tag,)):
            self._close(at)
        elif tag == "p":
            self._flush()

    def _skip(self, html: str, tag: str, pos: int) -> int:
        """The position behind an element that isn't entered; it ends at the latest where an open element around it ends."""
        inside, depth = {tag: 1}, 1
        while m := _TOKEN.search(html, pos):
            name = (m[2] or m[6] or "").lower()
            if name and (m[1] or m[5]):
                if inside.get(name):
                    inside[name] -= 1
                    if name == tag and not inside[name]:
                        return m.end()
                elif name in BLOCKS and self._open.get(name):
                    return m.start()
            elif name:
                if tag == "p" and name in BLOCKS or tag == name == "li" or name == "body":
                    return m.start()  # its end tag was left out
                if name in RAW:
                    end = re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I).search(html, m.end())
                    pos = end.end() if end else len(html)
                    continue
                if name not in VOID and not (m[3] or m[7] or "").endswith("/"):
                    inside[name] = inside.get(name, 0) + 1
            pos = m.end()
        return len(html)

    def _read(self, html: str) -> None:
        pos, n = 0, len(html)
        while pos < n:
            m = _TOKEN.search(html, pos)
            text = html[pos : m.start() if m else n]
            if text:
                self._parts.append(text)
                if self._links:
                    self._linked += len(text.strip())
            if not m:
                break
            pos = m.end()
            tag = (m[2] or m[6] or "").lower()
            if not tag:
                continue
            if m[0][-1] != ">":  # the page ends inside a tag
                break
            if m[1] or m[5]:
                self._end(tag)
                continue
            attributes = m[3] or m[7] or ""
            if tag in RAW:
                end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(html, pos)
                pos = end.end() if end else n
                continue
            if tag in BLOCKS:
                self._flush()
                p = self._last(("p",))
                if p and self._last(("table", "td", "li", "div", "article", "section")) < p:
                    self._close(p)
            if tag in CLOSES:
                ends, holds = CLOSES[tag]
                at, border = self._last(ends), self._last(holds)
                while at > border:
                    self._close(at)
                    at = self._last(ends)
            if tag in VOID:
                self._parts.append(" ") if tag == "br" else None
                continue
            dropped, flag, stays = _flag(tag, attributes, self._articles > 0)
            if dropped:
                if not attributes.endswith("/") or tag in BLOCKS:
                    if tag in BLOCKS:
                        self._flush()
                    pos = self._skip(html, tag, pos)
                    self._parts.append(" ")
                continue
            self._push(tag, flag, stays)
        self._close(1)
        self._flush()


def _sums(page: Page, left_out: list[bool] | None = None) -> tuple[list[int], list[int]]:
    """Length of the text below each element, and of that inside links."""
    size, inside = [0] * len(page.tags), [0] * len(page.tags)
    for node, text, link in page.blocks:
        if not left_out or not left_out[node]:
            size[node] += len(text)
            inside[node] += link
    for i in range(len(page.tags) - 1, 0, -1):
        size[page.parents[i]] += size[i]
        inside[page.parents[i]] += inside[i]
    return size, inside


def _left_out(page: Page) -> list[bool]:
    """Which elements are in parts that their names, or a form, tell to be no article."""
    tags, parents = page.tags, page.parents
    size, inside = _sums(page)
    holds, paragraphs = [False] * len(tags), [0] * len(tags)  # the article or its title; paragraphs
    for i in range(len(tags) - 1, 0, -1):
        if holds[i] or tags[i] in ("article", "main", "h1") and not page.flags[i]:
            holds[parents[i]] = True
        paragraphs[parents[i]] += paragraphs[i] + (tags[i] == "p")
    out = [False] * len(tags)
    for i in range(1, len(tags)):
        flag = page.flags[i]
        if flag == 3:
            drop = not holds[i] and not (paragraphs[i] >= 3 and 2 * size[i] > size[0])
        else:
            drop = flag == 1 or flag == 2 and 2 * inside[i] >= size[i]
            drop = drop and not (holds[i] and page.stays[i])
        out[i] = out[parents[i]] or drop
    return out


def main_text(html: str) -> str:
    """The main text of one page; blocks are joined by empty lines."""
    page = Page(html)
    tags, parents = page.tags, page.parents
    left_out = _left_out(page) if any(page.flags) else [False] * len(tags)
    blocks = [b for b in page.blocks if not left_out[b[0]]]
    if not blocks:
        return ""
    size, inside = _sums(page, left_out)
    points = [0.0] * len(tags)
    for node, text, _ in blocks:
        own = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3)
        if tags[node] in HEADINGS:
            own *= 0.2
        at = parents[node] if tags[node] in PARAGRAPHS and parents[node] >= 0 else node
        share = 1.0
        for _ in range(3):
            if at < 0:
                break
            points[at] += own * share
            at, share = parents[at], share * 0.5
    density = [x / max(1, y) for x, y in zip(inside, size)]
    extra = {"article": 10, "main": 8, "section": 3, "div": 5, "td": 3, "blockquote": 3, "pre": 3, "ul": -3, "ol": -3, "dl": -3}
    score = [(p + extra.get(t, 0)) * (1 - d) if p else 0.0 for p, t, d in zip(points, tags, density)]
    best = max(range(len(tags)), key=lambda i: (score[i], -i))
    if score[best] <= 0:
        return ""
    top = score[best]
    around = best
    while around > 0 and tags[around] not in ("article", "main"):
        around = parents[around]
    container = around if around > 0 else best
    chosen = {container}
    for i in range(1, len(tags)):
        if i == container or not size[i]:
            continue
        if parents[i] == parents[container]:
            paragraph = tags[i] in ("p", "article") and (size[i] > 80 and density[i] < 0.25 or density[i] == 0)
            heading = tags[i] in HEADINGS and density[i] < 0.25
            if score[i] >= max(10, 0.2 * top) or paragraph or heading:
                chosen.add(i)
        elif tags[i] in ("article", "main") and score[i] >= max(10, 0.2 * top) and density[i] < 0.5:
            chosen.add(i)
    kept = [False] * len(tags)
    for i in range(len(tags)):
        kept[i] = i in chosen or i > 0 and kept[parents[i]]
    return "\n\n".join(text for node, text, _ in blocks if kept[node])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 2):
        text = [main_text(h) if h else "" for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of (page_id, url, html).

    Null, empty and textless html give an empty text; a page cut off inside a tag or element is read as far as it goes; rows
    that repeat give equal rows; other columns are ignored.
    """
    pages = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_run, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
