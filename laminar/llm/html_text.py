"""HTML extraction by tree scoring.

A tolerant one-pass parser makes a tree of elements and, in page order, the text blocks between block-level tags. Paragraphs give points for
length and commas to their ancestors (all to the parent, half to the grandparent, less above), which are discounted by link density. The best container
wins, or the article or main element round it; of its siblings those are kept that score near it or are prose, and headings before it. Inside what is kept, scores decide again: containers that are mostly links go, and so do
elements whose tag, role or name says that they are something else (menus, forms, adverts, comments of readers ...), unless next to nothing would be left without them. A name says so only if
all of its words do: `ad-slot` is an advert, `legal-analysis`, `has-sidebar` and `overflow-hidden` are not.

Defined results: null or empty html gives the empty text; html without tags is one block; unclosed, crossed or unknown tags are repaired, never an
error; a page without any scored container gives all of its blocks that are content; repeated rows are extracted each; an empty table gives no rows; columns other than page_id, url and html are ignored.
The time is linear in the html, however long and however nested.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
GAP, NAME, EQUALS, BARE = re.compile(r"[\s/]*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
# HTML's element names by their role here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {n: re.compile(f"</{n}(?=[\\s/>])", re.I | re.A) for n in "script style noscript template textarea title iframe noembed noframes xmp".split()}
DROP = set("head button select option optgroup datalist svg math canvas audio video object applet map".split())
ASIDE = set("nav footer aside form fieldset dialog menu menuitem".split())
BLOCK = set(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "head", "option", "optgroup", "caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: A start tag closes an open element of these, up to the fence.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"thead"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
#: Words of names of what is no content, and words that may stand beside them without making it content.
NOT_CONTENT = set(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars side aside menu menus nav navbar navigation topnav subnav breadcrumb"
    " breadcrumbs pagination pager comment comments commentlist disqus reply replies respond footer foot colophon masthead cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe"
    " subscription signup login share sharing social related recommended recommendations recirc widget widgets toolbar skip form search hidden legal disclaimer copyright tags taboola outbrain".split()
)
BESIDE = set("area bar block bottom box button buttons container global group holder inner item items left link links list outer page panel post posts primary region right secondary section site slot stories thread top unit user wrap wrapper".split())
HEADER_WORDS = {"header", "topbar"}
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar tablist status log".split())
PROSE = {"p", "pre", "td", "blockquote", "div", "section", "article", "main", "dd", "li", "body"}
OWN = {"div", "section", "article", "main", "body", "td"}
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "details", "figure", "center"}
BONUS = {"article": 25.0, "main": 20.0}
SHARES = (1.0, 0.5, 0.25, 0.125)
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Shortest paragraph that gives points; least share of an unlikely element's points that must be left without it.
PARAGRAPH, REST = 25, 0.05


def says_no(names: str, within: bool) -> bool:
    """Whether one of the names of a class or id attribute says that the element is no content."""
    for name in names.split():
        words = {w.lower() for w in NAME_WORDS.findall(name)}
        if (words & NOT_CONTENT or (not within and words & HEADER_WORDS)) and words <= NOT_CONTENT | BESIDE | HEADER_WORDS:
            return True
    return False


class Page:
    """Elements as parallel lists (parent, tag, hidden, unlikely) and blocks (element, text, characters in links, links)."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.hidden, self.unlikely, self.block_at = [-1], ["#root"], [False], [False], [0]
        self.blocks: list[tuple[int, str, int, int]] = []
        self.text: list[str] = []
        self.linked = self.links = 0
        self._parse(html)

    def _flush(self, at: int) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((self.block_at[at], text, min(self.linked, len(text)), self.links))
            self.text, self.linked, self.links = [], 0, 0

    @staticmethod
    def _attributes(html: str, at: int, no_quote: set[str]) -> tuple[dict[str, str], int]:
        """The attributes of the tag whose name ends at `at`, and where it ends (after its >); -1 if it never does.

        Quotes count only where a value begins, and only if they are closed somewhere.
        """
        found: dict[str, str] = {}
        while True:
            at = GAP.match(html, at).end()
            if at >= len(html):
                return found, -1
            if html[at] == ">":
                return found, at + 1
            m = NAME.match(html, at)
            key, at, value = m[0].lower(), m.end(), ""
            eq = EQUALS.match(html, at)
            if eq:
                at = eq.end()
                quote = html[at : at + 1]
                close = html.find(quote, at + 1) if quote in ("'", '"') and quote not in no_quote else -1
                if close >= 0:
                    value, at = html[at + 1 : close], close + 1
                else:
                    if quote in ("'", '"'):
                        no_quote.add(quote)
                    m = BARE.match(html, at)
                    value, at = m[0], m.end()
            found.setdefault(key, value)

    def _parse(self, html: str) -> None:
        pos, n, no_quote = 0, len(html), set()
        stack: list[int] = [0]
        open_: dict[str, list[int]] = {}  # where on the stack the open elements of a tag are
        search = OPENING.search

        def add(raw: str) -> None:
            if raw and not self.hidden[stack[-1]]:
                t = unescape(raw) if "&" in raw else raw
                self.text.append(t)
                if open_.get("a"):
                    self.linked += len(t.strip())

        def cut(height: int) -> None:
            while len(stack) > height:
                open_[self.tag[stack.pop()]].pop()

        while pos < n:
            m = search(html, pos)
            if not m:
                add(html[pos:])
                break
            add(html[pos : m.start()])
            if m[3]:
                end = html.find("-->", m.end() - 2)
                pos = n if end < 0 else end + 3
                continue
            if not m[2]:
                end = html.find(">", m.end())
                if end < 0:
                    add(html[m.start() :])
                    break
                pos = end + 1
                continue
            name = m[2].lower()
            attributes, pos = self._attributes(html, m.end(), no_quote)
            if pos < 0:
                break
            if m[1]:
                if name in BLOCK or name == "br":
                    self._flush(stack[-1])
                if open_.get(name):
                    cut(open_[name][-1])
                continue
            if name == "br":
                add(" ")
                continue
            if name in VOID:
                if name in BLOCK:
                    self._flush(stack[-1])
                continue
            if name in RAW:
                m = RAW[name].search(html, pos)
                end = html.find(">", m.end()) if m else -1
                pos = n if end < 0 else end + 1
                continue
            if name in BLOCK:
                self._flush(stack[-1])
                if name in CLOSES_P and open_.get("p"):
                    cut(open_["p"][-1])
            if name in IMPLIED:
                closes, fences = IMPLIED[name]
                fence = max((open_[f][-1] for f in fences if open_.get(f)), default=0)
                above = [open_[c][i] for c in closes if open_.get(c) and (i := bisect_right(open_[c], fence)) < len(open_[c])]
                if above:
                    cut(min(above))
            up = stack[-1]
            at = len(self.tag)
            within = bool(open_.get("article") or open_.get("main"))
            self.parent.append(up)
            self.tag.append(name)
            self.hidden.append(self.hidden[up] or name in DROP or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(HIDDEN_STYLE.search(attributes.get("style", ""))))
            names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
            odd = name in ASIDE or (name == "header" and not within) or attributes.get("role", "").lower() in ROLES or says_no(names, within)
            self.unlikely.append(odd and name not in ("html", "body", "main"))
            self.block_at.append(at if name in BLOCK else self.block_at[up])
            open_.setdefault(name, []).append(len(stack))
            stack.append(at)
            self.links += name == "a"
        self._flush(stack[-1])

    def main_blocks(self) -> list[str]:
        parent, tag = self.parent, self.tag
        size = len(tag)
        # points, characters and links of the whole subtree of an element
        points, chars, linked, links, commas = [0.0] * size, [0] * size, [0] * size, [0] * size, [0] * size
        given: list[tuple[int, float]] = []
        for e, text, in_links, n in self.blocks:
            chars[e] += len(text)
            linked[e] += in_links
            links[e] += n
            commas[e] += text.count(",") + text.endswith((".", "!", "?", "\u3002"))
            if tag[e] in PROSE and len(text) >= PARAGRAPH:
                value = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - in_links / len(text))
                points[e] += value
                given.append((e, value))
        for e in range(size - 1, 0, -1):
            for sums in (points, chars, linked, links, commas):
                sums[parent[e]] += sums[e]
        out = [False] * size
        for e in range(1, size):
            spared = points[0] - points[e] < max(1.0, REST * points[e]) and chars[0] - chars[e] < chars[e]
            out[e] = out[parent[e]] or self.hidden[e] or (self.unlikely[e] and not spared)
        # text right inside a container counts for the container itself, else for the element above
        score = [0.0] * size
        for e, value in given:
            at = e if tag[e] in OWN else parent[e]
            for share in SHARES:
                if at < 0 or out[e]:
                    break
                score[at] += value * share
                at = parent[at]
        density = [linked[e] / chars[e] if chars[e] else 0.0 for e in range(size)]
        final = [(score[e] + BONUS.get(tag[e], 0.0) * (chars[e] > 0)) * (1 - density[e]) for e in range(size)]
        best = max((e for e in range(size) if final[e] > 0 and tag[e] in BLOCK and not out[e]), key=lambda e: (final[e], -e), default=0)
        top = self._round(best)
        kept = {top}
        if top == best and best > 0 and tag[best] not in ("body", "html", "article", "main"):
            limit, before = max(10.0, 0.2 * final[best]), True
            for e in (e for e in range(1, size) if parent[e] == parent[best] and not out[e]):
                before = before and e != best
                if final[e] >= limit or (tag[e] == "p" and chars[e] >= PARAGRAPH and density[e] < 0.25) or (before and tag[e] in ("h1", "h2") and chars[e]):
                    kept.add(e)
        inside = [e in kept or 0 in kept for e in range(size)]
        for e in range(1, size):
            # a container of links, with some words between them at most
            listing = e not in kept and tag[e] in CONTAINERS and links[e] > 1 and (density[e] > 0.5 or (density[e] > 0.25 and chars[e] < 100 and not commas[e]))
            out[e] = out[e] or out[parent[e]] or (listing and points[0] - points[e] >= 1)
            inside[e] = inside[e] or inside[parent[e]]
        return [text for e, text, _, _ in self.blocks if inside[e] and not out[e]]

    def _round(self, best: int) -> int:
        """The outermost article that holds an element, else the main element that does, else the element."""
        found, main, e = 0, 0, best
        while e > 0:
            found = e if self.tag[e] == "article" else found
            main = e if self.tag[e] == "main" else main
            e = self.parent[e]
        return found or main or best


def main_text(html: str | None) -> str:
    return "\n".join(Page(html).main_blocks()) if html else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py()) for x in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: a narrow map, one batch of pages in memory at a time."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(common.lean(_extract), f"page_id {kind}, url string, text string, n_chars bigint")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
