"""Main text of HTML pages: flat text blocks, classified by a decision tree over the words and links of neighbours.

A page is cut into blocks at block-level tags, in page order. A block is described by its number of words and its link
density, those of the blocks before and after it, whether it stands in a container of boilerplate (by tag, role, class or
id) and where it stands to the page's article, if the page marks one. A binary decision tree, grown by Gini impurity on
the small labelled table below, whose lines each label all combinations of some shapes, tells text from boilerplate. Pages that mark nothing are told by words and links alone.

Marks are a hint: long blocks with few links are text outside the marked article too, and in containers that are named by
their place on the page only (sidebar, header); lists of links are boilerplate inside it too. A mark around less long
text than stands outside of it, as a teaser's, counts as none. What a tag, a role, or a name of other texts (comments,
related) marks as boilerplate is believed: words and links can't tell a long comment from an article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words

#: Without their content: code, forms' fields, drawings, sources of formulas, and what browsers show only in place of what is embedded.
_RAW = "script|style|noscript|template|title|svg|annotation|annotation-xml|iframe|object|canvas|textarea|select|audio|video"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
#: Tags and names that say what an element is for.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button fieldset head".split())
_ARTICLE_TAGS = frozenset("article main".split())
_BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar form".split())
_BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside rail nav navbar navigation menu submenu topbar footer foot masthead "
    "header breadcrumb breadcrumbs crumbs cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog newsletter subscribe subscription signup login signin register "
    "share sharing social related recommended recommendations comment comments commentlist respond replies disqus discussion widget widgets toolbar pagination pager paging copyright skip search form".split()
)
#: Of these, the names of places on the page, which layouts also use for what stands beside them.
_LAYOUT_NAMES = frozenset("banner sidebar aside rail nav navbar navigation menu submenu topbar footer foot masthead header toolbar widget widgets".split())
#: Parts of names that say how a container is laid out, not what it is.
_HAVING = frozenset("has have with without no hide show".split())
_SIDES = frozenset("left right both one two double single top bottom".split())
_ARTICLE_NAMES = frozenset("article content post entry story main".split())

_ANY = ((0, 0.0), (2, 1.0), (6, 0.0), (30, 0.1), (90, 0.0))
_SMALL = ((0, 0.0), (2, 1.0), (4, 0.0), (30, 0.9))
_TEXT = ((20, 0.0), (30, 0.1), (90, 0.0))
_LINKS = ((2, 1.0), (30, 0.9))
_WORDS = ((0, 0.0), (4, 0.0))
#: Labelled by hand, a line for all combinations: words, link density; (words, link density) of the block before; of the
#: block after; in boilerplate (1: by a name of its place on the page, 2: by anything else); place to the article (0: none
#: marked, 1: inside, -1: outside); text?
LABELLED = (
    ((1, 3, 12, 60, 300), (0.0, 0.3), _ANY, _ANY, (0,), (1,), 1),
    ((1, 3, 12, 60), (0.8, 1.0), _TEXT + _WORDS, _TEXT + _WORDS, (0,), (1,), 1),
    ((1, 3, 12, 60), (0.8, 1.0), _LINKS, _TEXT + _SMALL, (0,), (1,), 0),
    ((1, 3, 12, 60), (0.8, 1.0), _TEXT + _SMALL, _LINKS, (0,), (1,), 0),
    ((1, 6, 40, 120, 300), (0.0, 0.1, 0.4, 1.0), _ANY, _ANY, (2,), (-1, 0, 1), 0),
    ((1, 6, 16), (0.0, 0.1, 0.4, 1.0), _ANY, _ANY, (1,), (-1, 0, 1), 0),
    ((40, 120, 300), (0.4, 1.0), _ANY, _ANY, (1,), (-1, 0, 1), 0),
    ((40, 120, 300), (0.0, 0.1), _ANY, _ANY, (1,), (-1, 0, 1), 1),
    ((1, 6, 16), (0.0, 0.1, 0.4, 1.0), _ANY, _ANY, (0,), (-1,), 0),
    ((40, 120, 300), (0.4, 1.0), _ANY, _ANY, (0,), (-1,), 0),
    ((40, 120, 300), (0.0, 0.1), _ANY, _ANY, (0,), (-1,), 1),
    ((12, 16, 25, 40, 100, 300), (0.0, 0.1, 0.25), _ANY, _ANY, (0,), (0,), 1),
    ((1, 3, 8), (0.0, 0.1, 0.25), _TEXT, _ANY, (0,), (0,), 1),
    ((1, 3, 8), (0.0, 0.1, 0.25), _SMALL, _TEXT, (0,), (0,), 1),
    ((1, 3, 8), (0.0, 0.1, 0.25), _SMALL, _SMALL, (0,), (0,), 0),
    ((1, 3, 8, 16, 40, 100), (0.45, 0.7, 1.0), _ANY, _ANY, (0,), (0,), 0),
)


def table() -> np.ndarray:
    """One row for each labelled combination: eight features and the label."""
    return np.array([(*((w, d, *b, *a, c, p)), y) for ws, ds, bs, as_, cs, ps, y in LABELLED for w in ws for d in ds for b in bs for a in as_ for c in cs for p in ps], float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1):
    """A binary tree by Gini impurity: a class, or (feature, threshold, tree where less or equal, tree where more)."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return int(share > 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < least:
                continue
            impurity = sum(m.mean() * 2 * y[m].mean() * (1 - y[m].mean()) for m in (left, ~left))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut))
    if best is None:
        return int(share > 0.5)
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)


@lru_cache(maxsize=1)
def tree():
    rows = table()
    return grow(rows[:, :-1], rows[:, -1], depth=16)


def classify(features: tuple, node=None) -> bool:
    node = tree() if node is None else node
    while isinstance(node, tuple):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return bool(node)


def _named(value: str) -> int:
    """What a class or id says: 0 nothing of boilerplate, 1 only a place on the page, 2 boilerplate."""
    level, sides, article = 0, False, False
    for name in value.split():
        parts = set(re.split(r"[^a-z0-9]+", name))
        article |= not _ARTICLE_NAMES.isdisjoint(parts)
        found = _BOILERPLATE_NAMES & parts
        if not found:
            continue
        if found <= _LAYOUT_NAMES:
            if not _HAVING.isdisjoint(parts):
                continue
            if not _SIDES.isdisjoint(parts):
                sides = True  # of a container of the article it says where the other column is
                continue
            level = max(level, 1)
        else:
            level = 2
    return max(level, int(sides and not article))


def _place(tag: str, attrs: str, in_article: bool) -> tuple[int, bool]:
    """Whether an element is a container of boilerplate (1: by a name of its place on the page, 2: by anything else), and of the article."""
    bad = 2 if tag in _BOILERPLATE_TAGS or (tag == "header" and not in_article) else 0
    good = tag in _ARTICLE_TAGS
    if attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id"):
                parts = set(re.split(r"[^a-z0-9]+", value))
                if tag not in ("body", "html"):
                    if not (tag in _ARTICLE_TAGS and not parts & {"comment", "comments", "ad", "advert", "related", "sponsored", "promo"}):
                        bad = max(bad, _named(value))
                    good |= tag in ("div", "section") and not _ARTICLE_NAMES.isdisjoint(parts)
            elif name == "role":
                bad = 2 if value in _BOILERPLATE_ROLES else bad
                good |= value in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                bad = 2
    return bad, good and not bad


def blocks(page: str) -> list[tuple[str, int, int, int, bool]]:
    """(text, words, words in links, in boilerplate, in the article) of each block that isn't empty."""
    found, parts = [], []
    n_words = n_links = 0
    stack: list[tuple[str, int, bool]] = []  # block elements: tag, in boilerplate, in the article
    opened: Counter[str] = Counter()  # of each tag on the stack, so that an end without a start costs no search
    bad, good, link = 0, False, False

    def flush() -> None:
        nonlocal n_words, n_links
        if parts:
            if text := " ".join("".join(parts).split()):
                found.append((text, n_words, n_links, bad, good))
            parts.clear()
            n_words = n_links = 0

    def add(raw: str) -> None:
        nonlocal n_words, n_links
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            n = len(text.split())
            n_words += n
            n_links += n if link else 0

    def close(to: int) -> None:
        nonlocal bad, good
        while len(stack) > to:
            opened[stack.pop()[0]] -= 1
        bad, good = (stack[-1][1], stack[-1][2]) if stack else (0, False)

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            link = not m["end"]
        elif tag in _INLINE:
            if tag == "img" or tag == "input":
                parts.append(" ")
        elif tag in _VOID:
            flush()
        elif m["end"]:
            flush()
            link = False
            if opened[tag]:
                to = len(stack) - 1
                while stack[to][0] != tag:
                    to -= 1
                close(to)
        else:
            flush()
            if stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            if tag == "body":
                close(0)
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                close(len(stack) - 1)
            b, g = _place(tag, m["attrs"], good)
            bad, good = max(bad, b), (good or g) and not b
            stack.append((tag, bad, good))
            opened[tag] += 1
    add(page[at:])
    flush()
    return found


def main_text(page: str | None) -> str:
    """The blocks of a page that the tree takes for text, joined by two line feeds."""
    own = blocks(page or "")
    marked = any(b[4] and not b[3] for b in own)
    shape = [(b[1], b[2] / b[1] if b[1] else 0.0) for b in own]
    # a mark around less long text than stands outside of it, as a teaser's, isn't the article's
    long_ = [0, 0]
    for b, (n, links) in zip(own, shape):
        if b[3] < 2 and n >= 25 and links <= 0.25:
            long_[b[4] and not b[3]] += n
    marked = marked and long_[1] >= long_[0]
    none = (0, 0.0)
    kept = []
    for i, b in enumerate(own):
        before, after = shape[i - 1] if i else none, shape[i + 1] if i + 1 < len(own) else none
        if classify((*shape[i], *before, *after, int(b[3]), (1 if b[4] else -1) if marked else 0)):
            kept.append(b[0])
    return "\n\n".join(kept)


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of each page.

    Null, empty and tagless pages give what the tree makes of them, so nothing for null and empty ones. Cut-off tags and
    unclosed elements end with the page. Repeated rows and null ids are kept. An empty table gives an empty result. Other
    columns are ignored.
    """
    base = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), pages[page].cast("string").alias("text"))

    def run(batches):
        for b in (part for whole in batches for part in words.slices(whole)):
            out = [main_text(x) for x in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    out = base.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": page_id, "url": url})


def op5(spark, sf_dir: str) -> DataFrame:
    """Contract query: the main text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
