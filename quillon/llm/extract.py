"""Main text of web pages by tree scoring.

A page is read into a tree by a tolerant reader: void elements, implied ends of paragraphs, list
items and table cells, unclosed inline elements, raw text of scripts and styles. Blocks of
text pass points to their ancestors, one for themselves, one for each comma and one for
each hundred characters up to three: all to the parent, half to the grandparent, a third of
that share for each level above. A container's points are discounted by its link density and
by what its tag, class and id say of it. The best container is kept with those of its siblings
that score well or read like prose; menus, headers, footers, sidebars, adverts, forms and
comments are left out wherever they stand. One narrow map, no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import pieces, spare

TAG = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title noscript iframe noframes xmp template svg math".split())
#: Elements that never hold the article's text.
DROPPED = frozenset("head script style noscript template iframe object embed svg math canvas audio video map nav header footer aside form fieldset button select option textarea input label dialog menu title noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
INLINE = frozenset("b i em strong u s small font span code sub sup mark big tt".split())
#: What an opening tag ends, if it is open, up to one of the barriers.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: Words in a class, an id or a role that tell of something else than the article.
BAD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|contact|cookies?|consent|disqus|disclaimer|foot(?:er|note-nav)?|gdpr|header|login|masthead|menu|meta-?data|modal|nav(?:bar|igation)?|newsletter|notices?|pager|pagination|popup|promo\w*|related|respond|share|sharing|shoutbox|sidebar|signup|skip|social|sponsor\w*|subscribe|tags?|tool(?:bar|box)|widget|recommend\w*|copyright|alert|contentinfo|complementary|search|repl(?:y|ies))(?:$|[\s_-])", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|hentry|main|page|post|story|text|blog)(?:$|[\s_-])", re.I)
BASE = {"article": 30, "main": 25, "section": 5, "div": 5, "blockquote": 3, "td": 3, "pre": 3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "table": -3, "th": -5, "body": 0}


class Node:
    __slots__ = ("tag", "parent", "items", "mark", "size", "linked", "score", "out")

    def __init__(self, tag: str, parent: Node | None, mark: str = ""):
        self.tag, self.parent, self.items, self.mark = tag, parent, [], mark
        self.size = self.linked = 0
        self.score = 0.0
        self.out = tag in DROPPED


def parse(html: str) -> Node:
    """The tree; its text nodes are strings, character references not yet decoded."""
    root = now = Node("html", None)
    opened: Counter[str] = Counter()  # so that no search goes up the tree in vain

    def up(to: Node) -> Node:
        at = now
        while at is not to:
            opened[at.tag] -= 1
            at = at.parent
        return to

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if m is None:
            now.items.append(html[at:])
            break
        if m.start() > at:
            now.items.append(html[at : m.start()])
        at = m.end()
        if (name := m[2]) is None:
            continue
        name = name.lower()
        if m[1]:
            if opened[name]:
                now = up(_close(now, name))
            continue
        if name == "html":
            continue
        if name in BLOCKS:
            if opened["p"]:
                now = up(_end(now, {"p"}, {"button", "table", "td", "th"}))
            while now.tag in INLINE:  # a block ends the unclosed inline elements around it
                now = up(now.parent)
        if name in ENDS and any(opened[t] for t in ENDS[name][0]):
            now = up(_end(now, *ENDS[name]))
        node = Node(name, now, _mark(m[3]))
        if "hidden" in node.mark.split("\n")[1:]:
            node.out = True
        now.items.append(node)
        if name in VOID or m[3].endswith("/") and name not in BLOCKS and name != "a":
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*/?>", re.I).search(html, at)
            if end is None and name in ("title", "textarea", "template", "svg", "math", "noscript"):
                continue
            at = end.end() if end else n
            continue
        opened[name] += 1
        now = node
    return root


def _mark(attributes: str) -> str:
    """Class, id and role, and a last line "hidden" for what isn't shown."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return ""
    out, hidden = [], False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            out.append(value)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return " ".join(out).replace("\n", " ") + ("\nhidden" if hidden else "")


def _close(now: Node, name: str) -> Node:
    """The parent of the nearest open element of that name; unknown ends are passed over. Inline ends don't reach beyond their block."""
    at = now
    while at.parent is not None:
        if at.tag == name:
            return at.parent
        if name not in BLOCKS and at.tag in BLOCKS:
            return now
        at = at.parent
    return now


def _end(now: Node, tags: set[str], barriers: set[str]) -> Node:
    at, found = now, None
    while at.parent is not None and at.tag not in barriers:
        if at.tag in tags:
            found = at
        at = at.parent
    return found.parent if found is not None else now


def _measure(root: Node) -> list[Node]:
    """Elements in page order; text and link sizes of each, without what is left out."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.mark and not node.out and node.tag not in ("body", "article", "main"):
            first = node.mark.split("\n")[0]
            if BAD.search(first) and not (GOOD.search(first) and node.tag in ("div", "section")):
                node.out = True
        if node.out:
            continue
        order.append(node)
        stack.extend(x for x in reversed(node.items) if isinstance(x, Node))
    for node in reversed(order):
        for x in node.items:
            if isinstance(x, str):
                node.size += len(x.strip())
            elif not x.out:
                node.size += x.size
                node.linked += x.size if x.tag == "a" else x.linked
    return order


def _own(node: Node) -> tuple[int, int]:
    """Characters and commas of a node's text outside blocks below it."""
    size = commas = 0
    stack = [node]
    while stack:
        for x in stack.pop().items:
            if isinstance(x, str):
                text = x.strip()
                size += len(text)
                commas += sum(text.count(c) for c in ",、，")
            elif not x.out and x.tag not in BLOCKS:
                stack.append(x)
    return size, commas


def _blocks(node: Node, out: list[str], line: list[str]) -> None:
    """Texts of blocks in page order; `line` is the block that is being read."""
    stack: list = [(node, iter(node.items), node.tag in BLOCKS)]

    def flush() -> None:
        if line:
            text = SPACE.sub(" ", unescape("".join(line))).strip()
            if text:
                out.append(text)
            line.clear()

    if stack[0][2]:
        flush()
    while stack:
        _, items, block = stack[-1]
        for x in items:
            if isinstance(x, str):
                line.append(x)
            elif x.tag in ("br", "wbr"):
                line.append(" " if x.tag == "br" else "")
            elif not x.out:
                if below := x.tag in BLOCKS:
                    flush()
                stack.append((x, iter(x.items), below))
                break
        else:
            if block:
                flush()
            stack.pop()


def main_text(html: str | None) -> str:
    """The article's blocks, one a line. Empty if there are none."""
    if not html:
        return ""
    root = parse(html)
    order = _measure(root)
    scored: dict[int, Node] = {}
    for node in order:
        if node.tag not in BLOCKS or node.tag == "html":
            continue
        size, commas = _own(node)
        if not size:
            continue
        points = (1 + commas + min(size / 100, 3)) * (1 - (node.linked / node.size if node.size else 0))
        up, share = node.parent if node.tag != "body" else node, 1.0
        while up is not None and share > 0.001:
            if id(up) not in scored:
                scored[id(up)] = up
                first = up.mark.split("\n")[0]
                up.score += BASE.get(up.tag, 0) + (25 if first and GOOD.search(first) else 0)
            up.score += points * share
            up, share = up.parent, share / 2 if share == 1.0 else share / 3
    if not scored:
        best = root
    else:
        best = max(scored.values(), key=lambda x: x.score * (1 - (x.linked / x.size if x.size else 0)))
    kept = [best]
    if best.parent is not None:
        least = max(10.0, best.score * 0.2)
        kept = []
        for x in best.parent.items:
            if not isinstance(x, Node) or x.out:
                continue
            density = x.linked / x.size if x.size else 1.0
            prose = x.tag == "p" and x.size > 80 and density < 0.25
            if x is best or (id(x) in scored and x.score * (1 - density) >= least) or prose:
                kept.append(x)
    out: list[str] = []
    line: list[str] = []
    for x in kept:
        _blocks(x, out, line)
        if line:
            text = SPACE.sub(" ", unescape("".join(line))).strip()
            out += [text] if text else []
            line = []
    return "\n".join(out)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """`keep` columns, text and n_chars (code points) of every row.

    A null or empty page has an empty text; repeated rows stay; pages of any length are taken whole; no rows give no rows.
    `keep` can't have columns named text or n_chars, which are the result's.
    """
    if {c.lower() for c in keep} & {"text", "n_chars"}:
        raise ValueError("text and n_chars are columns of the result")
    (html,) = spare(pages, "html_of_row")
    rows = pages.select(*keep, F.col(html_col).cast("string").alias(html))

    def run(batches):
        for b in pieces(batches, html, 8 << 20):
            texts = [main_text(h) for h in b.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*keep, "text", "n_chars"])

    return rows.mapInArrow(run, rows.select(*keep).schema.add("text", "string").add("n_chars", "long"))
