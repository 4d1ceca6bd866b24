"""Main text of web pages by line-block distribution.

1. Markup is stripped: comments, scripts, styles and whole parts of a page that are never its article (navigation, header,
   footer, sidebar, forms, dialogs, and blocks whose class, id or role says menu, advert, notice, comments and the like)
   leave empty lines; every other block leaves one line of text.
2. Text lengths are summed over a sliding window of WINDOW lines. Where the sum surges over the page's threshold a block of
   text begins; where the window is empty again it dives and the block ends. Text between is kept.
3. Lines that are mostly links count as empty, and the threshold is SURGE characters, or the densest window if none has as
   many. Where a marked article or main part holds at least half of the text that is left, only lines inside count, and any
   text there surges, so even a very short article is whole; a short teaser that is marked so does not hide the rest.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import lean, slices, table

WINDOW = 3
SURGE = 80
LINK_SHARE = 0.6

#: Element names by their part in a page.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "title", "math", "canvas", "audio", "video"}
BOILERPLATE = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "select", "head"}
BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | BOILERPLATE
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}  # their ids name a place to go to
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of a class, id or role that mark a part as no article.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo", "cookie", "cookies", "discussion", "discussions", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "reactions", "related", "replies", "respond", "responses", "search", "share", "sharing", "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Words that may stand beside these in a class or id; any other word makes it another thing (`related-work`).
LAYOUT = {"area", "article", "bar", "block", "body", "bottom", "box", "button", "buttons", "center", "column", "container", "content", "first", "form", "global", "group", "head", "header", "holder", "icon", "icons", "inner", "item", "items", "last", "left", "link", "links", "list", "main", "message", "module", "outer", "page", "panel", "post", "posts", "primary", "reader", "readers", "right", "secondary", "section", "site", "slot", "thread", "top", "unit", "user", "users", "visitor", "visitors", "wrap", "wrapper"}
#: First words of marks that tell a state, as in `has-sidebar`, and not what a part is.
STATES = {"has", "is", "no", "not", "with", "without"}
_PARTS = MARKS | LAYOUT
#: Elements that an opening element of another block closes.
CLOSES = {"p": BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}

_SPACE = re.compile(r"\s+")
_DECLARATION = re.compile(r"<!\[(?!CDATA\[)[^>]*>?")
_WORDS = re.compile(r"[a-z]+")


class Lines(HTMLParser):
    """Turns markup into lines (text, characters in links, inside an article)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool]] = []
        self.text: list[str] = []
        self.links = 0
        self.open: list[tuple[str, bool]] = []  # name, whether it begins a part that is dropped
        self.blocks: list[str] = []
        self.named: Counter[str] = Counter()
        self.dropped = 0

    @property
    def articles(self) -> int:
        return self.named["article"] + self.named["main"]

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.links, self.articles > 0))
        self.text, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            while self.blocks and tag in CLOSES.get(self.blocks[-1], ()):
                self.close(self.blocks[-1])
            self.end_line()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        drop = tag in RAW or tag in BOILERPLATE or tag == "header" and not self.articles or not self.whole(tag) and self.marked(tag, attrs)
        self.open.append((tag, drop))
        self.dropped += drop
        if drop and self.dropped == 1:
            self.lines.append(("", 0, False))
        self.named[tag] += 1
        if tag in BLOCK:
            self.blocks.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in RAW:  # XHTML form of an element without content
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.end_line()
        if self.named[tag]:
            self.close(tag)

    def handle_data(self, data):
        if not self.dropped:
            self.text.append(data)
            if self.named["a"]:
                self.links += len(data.strip())

    def close(self, tag: str) -> None:
        """Close the innermost open element of this name and, unless they are blocks around it, those within."""
        while self.open:
            t, drop = self.open.pop()
            self.dropped -= drop
            self.named[t] -= 1
            if t in BLOCK:
                self.blocks.pop()
            if drop:
                self.lines.append(("", 0, False))
            if t == tag:
                return

    def whole(self, tag: str) -> bool:
        """Whether this is the page or its outermost article, which no mark drops; an article within may be a comment."""
        return tag in ("body", "html") or tag in ("article", "main") and not self.articles

    @staticmethod
    def marked(tag: str, attrs) -> bool:
        for name, value in attrs:
            if name in ("class", "id", "role") and value and not (name == "id" and tag in HEADINGS):
                for mark in value.lower().split():
                    words = _WORDS.findall(mark)
                    if words and words[0] not in STATES and not MARKS.isdisjoint(words) and _PARTS.issuperset(words):
                        return True
        return any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs)


def page_lines(html: str) -> list[tuple[str, int, bool]]:
    p = Lines()
    if "<![" in html:  # browsers skip such declarations up to the next >
        html = _DECLARATION.sub(" ", html)
    try:
        p.feed(html)
        p.close_all()
    except AssertionError:  # the parser's own check of a broken declaration
        p.end_line()
    return p.lines


def _close_all(self: Lines) -> None:
    rest, self.rawdata = self.rawdata, ""
    if rest and not self.dropped and not rest.startswith("<"):
        self.handle_data(entities.unescape(rest))
    self.end_line()


Lines.close_all = _close_all


def kept_lines(lengths: np.ndarray, threshold: int) -> np.ndarray:
    """Which lines lie between a surge and the dive after it. Line i's window is lines i to i + WINDOW - 1."""
    n = len(lengths)
    total = np.concatenate([[0], np.cumsum(lengths), np.full(WINDOW, lengths.sum())])
    window = total[WINDOW : WINDOW + n] - total[:n]
    keep, inside = np.zeros(n, bool), False
    for i in range(n):
        if not inside and window[i] >= threshold and lengths[i]:
            inside = True
        elif inside and not window[i]:
            inside = False
        keep[i] = inside and lengths[i] > 0
    return keep


def main_text(html: str | None) -> str:
    lines = page_lines(html or "")
    if not lines:
        return ""
    lengths = np.array([0 if links > LINK_SHARE * len(text) else len(text) for text, links, _ in lines])
    inside = np.array([article for _, _, article in lines])
    if inside.any() and 2 * lengths[inside].sum() >= lengths.sum() and any(text for text, _, article in lines if article):
        lengths = np.array([len(text) if article else 0 for text, _, article in lines])
        threshold = 1
    else:
        sums = np.convolve(lengths, np.ones(WINDOW, np.int64))
        threshold = max(1, min(SURGE, int(sums.max(initial=0))))
    return "\n\n".join(lines[i][0] for i in np.flatnonzero(kept_lines(lengths, threshold)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    Null and empty html give an empty text. Unclosed and stray elements are read as browsers read them, as far as blocks go;
    cut-off pages give what there is. Repeated rows stay, null ids and urls stay null, other columns are not read, and an
    empty table gives an empty table.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return own.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
