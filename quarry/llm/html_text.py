"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Every paragraph (a block with text of its own) scores points for its commas
and its length and passes them to its parent, and half of them to its grandparent. A container's points are
discounted by its link density (the share of its text inside links). The best container is kept, with those of
its siblings that score well enough or are plain paragraphs next to it. Before scoring, elements that are never
main text go: by tag (menus, headers, footers, asides, forms, scripts, styles...) and by words in class, id or
role (adverts, notices, sidebars, reader comments...).

Text is taken block by block in page order: character references decoded, white space runs turned into one
space, trimmed, empty blocks left out, joined by one line feed. Nothing else is dropped or capped.

Null or empty html gives an empty text, as does a page without text. Broken markup is read leniently: an
unclosed tag, comment or script at the end of the page is markup, missing end tags are implied. Nesting is held
on a stack, not by recursion. Rows are independent, so ties and repeated rows repeat their result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"<(?:!--(?:.*?-->|.*\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)")  # a tag with an unclosed quote
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
SPACES = re.compile(r"[\s\x1c-\x1f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in
       ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template")}
#: never main text
DROP = frozenset("nav header footer aside form button select option input textarea label fieldset menu dialog "
                 "head title object embed applet canvas svg math audio video map noscript iframe template".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
                  "option p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset("p pre td blockquote li dd figcaption h1 h2 h3 h4 h5 h6".split())
#: start tags that end an open paragraph
ENDS_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"},
        "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"},
         "tr": {"table"}, "option": {"select"}}
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adverts|sponsor\w*|promo\w*|banner|breadcrumbs?|cookies?|consent|gdpr|notices?|alert|"
    r"comments?|comment-?list|commentlist|disqus|replies|respond|discussion|sidebar\w*|side|widget\w*|related\w*|recommend\w*|"
    r"share|sharing|social\w*|subscribe|newsletter|signup|login|popup|modal|overlay|menu\w*|navbar|nav|navigation|topbar|"
    r"masthead|header|footer\w*|foot|copyright|pagination|pager|toolbar|tags|rss|skip|hidden|complementary|contentinfo|"
    r"search|banner-ad|outbrain|taboola)(?=$|[\s_-])", re.I)
#: 'has-sidebar' and the like say what stands beside an element, not what it is
BESIDE = re.compile(r"(?:has|with|without|no)[_-][\w-]+", re.I)
NOT_ARTICLE = re.compile(r"comment|advert|promo|related|repl", re.I)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text|hentry)(?=$|[\s_-])", re.I)


class Node:
    __slots__ = ("tag", "parent", "kids", "drop", "points", "chars", "linked", "likely")

    def __init__(self, tag: str, parent: Node | None, drop: bool, likely: bool):
        self.tag, self.parent, self.drop, self.likely = tag, parent, drop, likely
        self.kids: list[Node | str] = []
        self.points, self.chars, self.linked = 0.0, 0, 0


def parse(html: str) -> Node:
    root = node = Node("#root", None, False, False)
    at, n = 0, len(html)
    opened: Counter[str] = Counter()

    def close(to: Node) -> Node:
        """Ends all elements up to and including ``to``."""
        x = node
        while x is not to:
            opened[x.tag] -= 1
            x = x.parent
        opened[x.tag] -= 1
        return x.parent

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            node.kids.append(html[at:lt])
        if lt == n:
            break
        m = TOKEN.match(html, lt)
        if m is None:
            m = LOOSE.match(html, lt)
            if m is None:  # a bare < is text
                node.kids.append("<")
                at = lt + 1
                continue
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if opened[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = close(up)
            elif tag == "p" and not node.drop:
                node.kids.append(Node("br", node, False, False))
            continue
        if opened["p"] > 0 and tag in ENDS_P:
            up = node
            while up.tag != "p":
                up = up.parent
            node = close(up)
        if tag in SELF and any(opened[x] > 0 for x in SELF[tag]):
            up = node
            while up.parent is not None and up.tag not in SCOPE[tag] and up.tag not in SELF[tag]:
                up = up.parent
            if up.tag in SELF[tag]:
                node = close(up)
        drop, likely, attrs = node.drop or tag in DROP or tag in RAW, False, m.group(3)
        if not drop and attrs and tag not in ("html", "body"):
            for a in ATTR.finditer(attrs):
                name, value = a.group(1).lower(), (a.group(2) or "").strip("\"'")
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    drop = True
                elif (NOT_ARTICLE if tag in ("article", "main") else UNLIKELY).search(BESIDE.sub("", value)):
                    drop = True
                elif name != "role" and LIKELY.search(value):
                    likely = True
        new = Node(tag, node, drop, likely)
        node.kids.append(new)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = RAW[tag].search(html, at)
            at = end.end() if end else n
            continue
        node = new
        opened[tag] += 1
    return root


def _walk(root: Node) -> list[Node]:
    """Kept elements, parents first."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if not x.drop:
            out.append(x)
            stack += [k for k in x.kids if not isinstance(k, str)]
    return out


def _inline_text(x: Node) -> tuple[str, int, int]:
    """The element's text outside nested blocks; its characters, and those in links."""
    parts, linked, stack = [], 0, [(x, x.tag == "a")]
    while stack:
        y, link = stack.pop()
        for k in y.kids:
            if isinstance(k, str):
                parts.append(k)
                linked += len(k) * link
            elif not k.drop and k.tag not in BLOCK:
                stack.append((k, link or k.tag == "a"))
    text = SPACES.sub(" ", "".join(parts)).strip()
    return text, len(text), min(linked, len(text))


def score(root: Node) -> list[Node]:
    """The elements to keep, in page order."""
    nodes = _walk(root)
    holders: dict[int, Node] = {}
    for x in nodes:
        if x.tag in BLOCK or x is root:
            text, x.chars, x.linked = _inline_text(x)
            if not text:
                continue
            points = 1 + text.count(",") + min(len(text) // 100, 3)
            own = x.tag not in PARAGRAPH  # loose text in a container counts for the container itself
            first = x if own or x.parent is None else x.parent
            for target, share in ((first, 1.0), (first.parent, 0.5)):
                if target is not None:
                    target.points += points * share
                    holders[id(target)] = target
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.chars += x.chars
            x.parent.linked += x.linked
    if not holders:
        return [root]

    def worth(x: Node) -> float:
        bonus = 25 if x.likely or x.tag in ("article", "main") else 0
        return (x.points + bonus) * (1 - x.linked / x.chars if x.chars else 0)

    order = {id(x): i for i, x in enumerate(nodes)}
    best = max(holders.values(), key=lambda x: (worth(x), -order[id(x)]))
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * worth(best))
    keep = []
    for s in best.parent.kids:
        if isinstance(s, str) or s.drop:
            continue
        density = s.linked / s.chars if s.chars else 0
        if s is best or id(s) in holders and worth(s) >= least or s.tag == "p" and s.chars and (
                density < 0.25 if s.chars > 80 else density == 0):
            keep.append(s)
    return keep


def block_texts(x: Node) -> list[str]:
    """Texts of the blocks below an element, in page order."""
    out: list[str] = []
    now: list[str] = []

    def flush():
        if now:
            text = SPACES.sub(" ", unescape("".join(now))).strip()
            if text:
                out.append(text)
            now.clear()

    stack: list = [x]
    while stack:
        y = stack.pop()
        if y is None:
            flush()
        elif isinstance(y, str):
            now.append(y)
        elif not y.drop:
            if y.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(y.kids)
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    return "\n".join(t for x in score(parse(html)) for t in block_texts(x))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars (code points), one row per page."""
    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), T.StructField(url, pages.schema[url].dataType),
                           T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                rows = batch.slice(part, 1000)
                texts = pa.array([main_text(v.as_py()) for v in rows.column(2)], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), texts], [key, url, "text"])

    return (pages.select(key, url, html).mapInArrow(run, schema)
            .select(key, url, "text", F.length("text").cast("long").alias("n_chars")))
