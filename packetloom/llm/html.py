"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. Each block knows its words, the share of them in
links, the same of its neighbours, and the kind of region it stands in (article, boilerplate by tag
or by class name, or neither). A decision tree, grown on the blocks of a few invented pages
(labelled), says which blocks are main text; a run of link-only blocks is a menu even in an article,
a lone one between sentences is text. Scripts, styles, markup and comments never become blocks.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm._common import arrow_map, table

#: Tags whose text is never shown (fixed values).
SKIP = frozenset("script style noscript template iframe head title select textarea canvas audio video".split())
#: Tags that end a block (fixed values).
BLOCK = frozenset(
    "address article aside blockquote body br button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags of regions that are not main text (fixed values).
BOILER = frozenset("nav footer aside form header menu button dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BAD_NAME = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|notice|gdpr|nav(?:bar|igation)?|menu|breadcrumbs?|side-?bar|footer|masthead|site-header|comments?|comment-?list|replies|disqus|newsletter|subscribe|signup|login|popup|modal|widget|pagination|pager|toolbar)(?![a-z])"
)
#: Names that mean boilerplate on containers only: a paragraph of an article may have them too.
_BOX_NAME = re.compile(r"(?:^|[^a-z])(?:related|recommend(?:ed|ations)?|share|sharing|social|copyright|legal)(?![a-z])")
_BOX = frozenset("div section aside ul ol nav footer header form table dl".split())
_GOOD_NAME = re.compile(r"(?:^|[^a-z])(?:article(?:-?body)?|post(?:-?body|-?content)?|entry(?:-?content)?|story(?:-?body)?|main(?:-?content)?|content|body-?text)(?![a-z])")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>\"']*+(?:\"[^\"]*\"[^>\"']*+|'[^']*'[^>\"']*+)*+)>|<!--.*?(?:-->|\Z)|<[!?][^>]*>", re.S)
_OPEN_END = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")  # a page cut off inside a tag
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "template")}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "boiler", "region")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: bool
    boiler: bool
    region: bool  # does the page mark an article at all


def decode(text: str) -> str:
    """Character references decoded, once."""
    n = text.count("&")
    if not n:
        return text
    return text.replace("&amp;", "&") if text.count("&amp;") == n else _html.unescape(text)


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order; white space in a block is one space."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, opens an article, opens boilerplate
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked: list[str] = []
    state = [0, 0, 0]  # depth of articles, of boilerplate, of links

    def flush() -> None:
        if text:
            words = decode("".join(text)).split()
            if words:
                out.append(Block(" ".join(words), len(words), len(decode(" ".join(linked)).split()) if linked else 0, state[0] > 0, state[1] > 0, False))
            text.clear()
            linked.clear()

    def say(piece: str) -> None:
        if piece:
            text.append(piece)
            if state[2]:
                linked.append(piece)

    def close(tag: str) -> None:
        while stack:
            t, good, bad = stack.pop()
            opened[t] -= 1
            state[0] -= good
            state[1] -= bad
            state[2] -= t == "a"
            if t == tag:
                return

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            say(_OPEN_END.sub("", page[at:]))
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        if m.group(1):
            if opened[tag]:
                close(tag)
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID or m.group(3).rstrip().endswith("/"):
            continue
        if tag == "a" and state[2] or tag in ("p", "li") and stack and stack[-1][0] == tag:  # these end themselves
            close(tag)
        names = " ".join(a or b or c for _, a, b, c in _ATTR.findall(m.group(3))).lower() if "=" in m.group(3) else ""
        good = tag in ("article", "main") or bool(names and _GOOD_NAME.search(names))
        bad = tag in SKIP or bool(names and (_BAD_NAME.search(names) or tag in _BOX and _BOX_NAME.search(names))) or tag in BOILER and not (tag == "header" and state[0])
        stack.append((tag, good, bad))
        opened[tag] += 1
        state[0] += good
        state[1] += bad
        state[2] += tag == "a"
    flush()
    if any(b.article for b in out):
        for b in out:
            b.region = True
    return out


def block_features(found: list[Block]) -> np.ndarray:
    words = np.array([b.words for b in found], float)
    links = np.array([b.linked / b.words for b in found], float)
    before, after = np.concatenate([[0], words[:-1]]), np.concatenate([words[1:], [0]])
    l_before, l_after = np.concatenate([[0], links[:-1]]), np.concatenate([links[1:], [0]])
    flags = np.array([[b.article, b.boiler, b.region] for b in found], float).reshape(-1, 3)
    return np.column_stack([words, links, before, l_before, after, l_after, flags])


#: Each invented page is shown with paragraphs of these lengths, and a leaf of the tree holds LEAF blocks at least.
SCALES = (0.7, 1.0, 1.5, 2.5)
LEAF = 3


def _text(tag: str, *words: int, attrs: str = "") -> str:
    return "".join(f"<{tag}{attrs}>{'word ' * n}</{tag}>" for n in words)


def _links(n: int, words: int = 1) -> str:
    return "<ul>" + f"<li><a href=x>{'word ' * words}</a></li>" * n + "</ul>"


def _linked(words: int, of: int) -> str:
    """A paragraph of words of which the first are a link."""
    return f"<p><a href=x>{'word ' * of}</a> {'word ' * (words - of)}</p>"


def labelled(scale: float) -> list[list[tuple[int, str]]]:
    """Invented pages as runs of blocks with their label (1: main text). Fixed values, written by hand; paragraphs are longer by the scale."""
    p, bar, foot = (lambda *n: _text("p", *[max(1, round(k * scale)) for k in n])), "<nav>" + _links(6) + "</nav>", "<footer>" + _text("p", 8) + _links(3) + "</footer>"
    ad, opened, closed = _text("div", 9, attrs=" class=ad"), "<article>", "</article>"
    return [
        # pages that mark their article
        [(0, bar + ad + opened), (1, _text("h1", 6) + p(40, 3, 80, 12, 60)), (0, closed + foot)],
        [(0, opened), (1, _text("h1", 1) + p(2, 7) + _text("li", 1, 1, 3, 1) + p(1)), (0, closed + foot)],
        [(0, "<header>" + _links(2) + "</header>" + opened), (1, _text("h2", 5) + p(150) + _linked(12, 2) + p(30)), (0, "<aside>" + p(40) + _links(4) + "</aside>"), (1, p(45, 200)), (0, _links(9)), (1, p(18, 25)), (0, closed + foot)],
        [(0, bar + opened), (1, p(20) + _linked(4, 4) + p(35) + _linked(1, 1) + p(9) + _linked(14, 9) + p(50)), (0, "<div class=share>" + _links(4) + "</div><section class=comments>" + p(30, 12, 60) + "</section>" + closed)],
        [(0, opened), (1, p(25, 14) + _linked(40, 34) + p(60)), (0, _links(20, 2) + closed + "<div id=sidebar>" + p(80, 20) + _links(3) + "</div>")],
        [(0, "<main><div class=cookie-consent>" + p(30) + "</div>"), (1, _text("h1", 8) + p(70, 15) + _text("li", 6, 1, 9) + _linked(8, 2) + _text("li", 2, 4)), (0, _links(3, 3) + "</main>" + foot + p(14))],
        [(0, p(60) + _text("h3", 4) + _links(2) + opened), (1, p(1, 1, 1) + p(90)), (0, "<form>" + p(12, 3) + "</form>" + closed + p(45, 20))],
        [(0, opened), (1, _text("h1", 4) + p(33) + _linked(2, 2) + p(28)), (0, closed + "<h3>word word word</h3>" + p(25, 150, 9))],
        [(0, bar + opened), (1, _text("h1", 7) + p(35, 4, 50, 22))],  # cut off
        [(0, opened), (1, p(30) + _text("li", 2, 3) + p(2))],
        [(0, foot + opened), (1, p(1, 1) + _text("div", 1))],
        # pages that don't
        [(1, p(60))],
        [(1, p(30, 20))],
        [(0, _links(5)), (1, p(40, 50))],
        [(0, _links(7)), (1, _text("h1", 7) + p(60, 45, 12, 90, 8, 70)), (0, _links(5) + p(5))],
        [(0, _links(4) + _text("div", 3)), (0, _links(6)), (1, p(55, 20, 33, 15, 40)), (0, _text("h4", 2) + _links(8, 2) + _text("div", 4))],
        [(0, _text("h2", 2) + _links(9, 3) + _text("h2", 3) + _links(12, 2) + _text("h2", 1) + _links(5, 4) + p(6))],
        [(0, _links(3)), (1, p(48) + _linked(30, 4) + p(3, 75) + _linked(25, 6) + p(22, 18)), (0, _linked(20, 14) + _links(4) + _linked(12, 8))],
        [(0, ad + _links(5)), (1, _text("h1", 5) + p(80) + _text("li", 6, 9, 4, 11) + p(65)), (0, "<div class=newsletter>" + p(30) + "</div>" + _links(2) + p(7))],
        [(0, _text("div", 2) + _links(10)), (1, p(28, 19, 36)), (0, _links(6) + _text("div", 9) + _links(3, 5))],
        [(0, "<div class=banner>" + p(25, 60) + "</div>"), (1, p(120, 10, 14, 95)), (0, foot)],
        [(0, _text("span", 3) + _links(3) + "<form>" + p(10) + "</form>" + _links(4)), (1, p(42, 17, 21)), (0, _linked(16, 11) + _linked(18, 12) + _linked(9, 7))],
    ]


def training_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and label of every block of the labelled pages."""
    x, y = [], []
    for page in [page for scale in SCALES for page in labelled(scale)]:
        at, done = "", 0
        for label, run in page:
            at += run
            n = len(blocks(at))
            y += [label] * (n - done)
            done = n
        x.append(block_features(blocks(at)))
    return np.concatenate(x), np.array(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple:
    """A tree of (feature, cut, low side, high side) by Gini impurity; a leaf is its label."""
    label = int(2 * y.sum() >= len(y))
    if depth == 0 or len(set(y.tolist())) < 2:
        return (label,)
    best = None
    for f in range(x.shape[1]):  # of equal splits the first
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) < LEAF:
                continue
            cost = sum(s.sum() * (1 - (2 * y[s].mean() - 1) ** 2) for s in (low, ~low))
            if best is None or cost < best[0] - 1e-9:
                best = (cost, f, cut, low)
    if best is None:
        return (label,)
    _, f, cut, low = best
    return (f, float(cut), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@cache
def tree() -> tuple:
    return grow(*training_table())


def classify(x: np.ndarray, node: tuple | None = None) -> np.ndarray:
    node = node or tree()
    if len(node) == 1:
        return np.full(len(x), bool(node[0]))
    f, cut, low, high = node
    goes_low = x[:, f] <= cut
    out = np.empty(len(x), bool)
    out[goes_low], out[~goes_low] = classify(x[goes_low], low), classify(x[~goes_low], high)
    return out


def main_text(page: str | None) -> str:
    """The main blocks of a page, joined by newlines; empty for null, or if there is none."""
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, classify(block_features(found)), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points): one row for each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(c: dict[str, list]) -> dict[str, list]:
        text = [main_text(h) for h in c["html"]]
        return {"page_id": c["page_id"], "url": c["url"], "text": text, "n_chars": list(map(len, text))}

    return rows.mapInArrow(arrow_map(run, out), "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
