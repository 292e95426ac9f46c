"""Main text of web pages by composite text density.

For every node of a page's tree: characters C, tags T, link characters LC and link tags LT of its
subtree. The density of a node is its characters per tag, scaled down where they sit in links. A
node's density sum adds the densities of its children. The node with the largest sum sets the
threshold: the smallest density on its path to the body. Going down from the body through nodes
that reach the threshold, the subtree with the largest density sum under each of them is marked; the
marked subtrees, with the short blocks that belong to them, are the main content.

Elements that cannot hold the article (scripts, menus, headers, footers, sidebars, notices, adverts,
forms, reader comments) are taken out by their tag, role, class or id before densities are computed,
unless they hold most of the page's article: such wrappers are left to the densities. What readers'
comments and the like hold doesn't count in that, however long it is.

Rules beside the densities, each for pages on which density alone goes wrong:

* A class or id whose first or last word names comments, adverts, sharing, related stories or subscriptions
  takes its element out, inside an article too, since such parts may be as dense as the article. It stays
  if it holds the page's first h1, or the first article or main element where none is elsewhere, or if
  nothing else on the page holds text (for names other than comments: if it holds most of the text).
* A header inside an article is the article's own, so its headline stays.
* An h1 beside the way from the body to a marked subtree stays: it is the headline, too short to be dense.
* If an article element holds text, the subtree of the largest sum is one that holds an article or lies in
  one, since a long list of plain text beside it may have the larger sum.
* Beside marked subtrees, parts stay whose text a tag is at least the body's and at most half in links: an
  article cut into blocks of different density stays whole. Where marked parts lie apart, plain blocks
  beside them and whatever lies between them stay as well.
"""

from __future__ import annotations

import html as references
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import add_columns, table

# HTML's element categories.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "ruby", "rb", "rt", "rp"}
SKIPPED = {"script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "math", "canvas", "audio", "video", "button", "select", "textarea", "input"}
ASIDE = {"nav", "header", "footer", "aside", "form", "dialog", "menu"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Blocks of running text, kept beside marked subtrees even if short.
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "dl", "li", "dt", "dd", "blockquote", "pre", "table", "figure", "figcaption", "hgroup"}
SAME_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "header", "masthead", "footer", "sidebar", "aside", "widget", "related", "recommended", "share", "sharing", "social", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "alert",
    "newsletter", "subscribe", "subscription", "signup", "login", "search", "form", "comment", "comments", "commentlist", "disqus", "discussion", "replies", "respond", "pagination", "pager", "toolbar", "copyright", "legal", "skip",
}
#: Words that may stand beside one of NAMES in a class or id and say nothing of what it holds.
PLACES = {
    "site", "page", "global", "main", "primary", "secondary", "top", "bottom", "left", "right", "upper", "lower", "bar", "box", "block", "area", "section", "container", "wrap", "wrapper", "inner", "outer",
    "list", "item", "items", "link", "links", "button", "buttons", "icons", "posts", "unit", "slot",
}
REPLIES = {"comment", "comments", "commentlist", "commenting", "disqus", "reply", "replies", "respond"}
#: Words that as the first or last of a class or id name what is never the article.
OTHERS = {
    "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertisements", "advertising", "sponsor", "sponsored", "share", "sharing", "social", "related", "recommended", "recommendations",
    "newsletter", "subscribe", "subscription", "signup", "breadcrumb", "breadcrumbs", "trending",
}
#: Pairs of words with the same meaning, and words that make a class tell of what an element has or lacks.
PAIRS = {("most", "read"), ("most", "popular"), ("most", "viewed"), ("also", "like")}
TELLING = {"no", "not", "has", "have", "with", "without", "hide", "show", "is"}

HOLDERS = {"article", "body", "main", "section", "div", "table"}
P_HOLDERS = {"article", "body", "div", "section", "main", "td", "th", "li", "blockquote", "table", "button"}
#: Elements whose content is no markup.
RAW = {n: re.compile(f"</{n}(?![a-z])", re.IGNORECASE) for n in ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")}
#: A slash before the end of these tags' marks closes nothing.
HTML_NAMES = (INLINE | CLOSES_P | ASIDE | SKIPPED | {"html", "body", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "option", "caption"}) - {"svg", "math"}

MARKUP = re.compile("<(?=[a-zA-Z!?]|/[a-zA-Z>])")
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>"'][^\s>]*+))?)?""")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "children", "density", "held", "links", "link_tags", "parent", "peak", "sum", "tag", "tags", "text")

    def __init__(self, tag: str, parent: Node | None, attrs: list | tuple = ()):
        self.tag, self.parent, self.attrs, self.children = tag, parent, attrs, []


class TreeBuilder:
    """A tree from any markup: unknown nesting is closed where the next block begins or the page ends.

    Every character is read a bounded number of times, and where an open element of some name lies is
    known without walking, so the time grows with the page's length whatever it holds. A comment, a
    tag or a script that is never closed ends with the page.
    """

    def __init__(self):
        self.root = Node("#root", None)
        self.open, self.places = [self.root], {}

    def feed(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            found = MARKUP.search(page, at)
            self._text(page[at : found.start() if found else end])
            at = self._markup(page, found.start()) if found else end

    def _text(self, data: str) -> None:
        if data:
            self.open[-1].children.append(references.unescape(data))

    def _markup(self, page: str, at: int) -> int:
        """Take in what begins at a ``<``; returns where it ends."""
        kind, end = page[at + 1], len(page)
        if kind in "!?":
            close = "-->" if page.startswith("<!--", at) else ">"
            found = page.find(close, at + 2)
            return end if found < 0 else found + len(close)
        name = NAME.match(page, at + 2 if kind == "/" else at + 1)
        tag = name[0].lower() if name else ""
        if kind == "/":
            found = page.find(">", at)
            if tag:
                self._end(tag)
            return end if found < 0 else found + 1
        attrs, at = [], name.end()
        while part := ATTRIBUTE.match(page, at):
            value = part[2] if part[2] is not None else part[3] if part[3] is not None else part[4]
            attrs.append((part[1].lower(), references.unescape(value or "")))
            at = part.end()
        at = page.find(">", at)
        if at < 0:
            return end
        self._start(tag, attrs, page[at - 1] == "/")
        if tag in RAW:
            found = RAW[tag].search(page, at + 1)
            self._end(tag)
            return end if not found else max(page.find(">", found.start()), found.start()) + 1
        return at + 1

    def _start(self, tag: str, attrs: list, closed: bool) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, P_HOLDERS)
        if tag in SAME_CLOSES:
            self._close(*SAME_CLOSES[tag])
        node = Node(tag, self.open[-1], attrs)
        self.open[-1].children.append(node)
        if tag not in VOID and not (closed and tag not in HTML_NAMES):
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def _last(self, tags: set[str]) -> int:
        """The place of the innermost open element of one of these names; 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _close_from(self, place: int) -> None:
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()

    def _end(self, tag: str) -> None:
        place = self._last({tag})
        if place and not (tag in INLINE and self._last(HOLDERS) > place):  # a stray end of an inline element closes no block
            self._close_from(place)

    def _close(self, tags: set[str], until: set[str]) -> None:
        place = self._last(tags)
        if place > self._last(until):
            self._close_from(place)


def named_aside(token: str) -> bool:
    """Whether a class or id is a name of boilerplate, as a whole or with words that only place it."""
    words = [w.lower() for w in WORDS.findall(token)]
    names = sum(w in NAMES for w in words)
    return names > 0 and all(w in NAMES or w in PLACES or w.isdigit() for w in words)


def names_of(node: Node) -> list[list[str]]:
    """The words of each class and id."""
    return [[w.lower() for w in WORDS.findall(token)] for n, v in node.attrs if n in ("class", "id") and v for token in v.split()]


def never_article(node: Node) -> str | None:
    """``reply`` or ``other`` if a name of the element says that it is no part of an article."""
    if node.tag in ("html", "body", "main"):
        return None
    found = None
    for words in names_of(node):
        if not words or TELLING & set(words):
            continue
        ends = {words[0], words[-1]}
        if ends & REPLIES:
            return "reply"
        if node.tag != "article" and (ends & OTHERS or PAIRS & set(zip(words, words[1:]))):
            found = "other"
    return found


def boilerplate(node: Node, in_article: bool = False) -> bool:
    if node.tag in ASIDE and not (in_article and node.tag == "header"):
        return True
    if node.tag in ("html", "body", "article", "main"):
        return False
    for name, value in node.attrs:
        if name in ("class", "id") and value and any(map(named_aside, value.split())):
            return True
        if name == "role" and (value or "").lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


def set_apart(root: Node) -> set[Node]:
    """The elements whose names keep them out of the article, without wrappers of the page's article."""
    order, stack, ends = [], [root], {}
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            ends[node[0]] = len(order)
            continue
        order.append(node)
        stack.append((node,))
        stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    named = [(i, ends[n], n, kind) for i, n in enumerate(order) if (kind := never_article(n))]
    if not named:
        return set()
    heading = next((i for i, n in enumerate(order) if n.tag == "h1"), -1)
    holders = [i for i, n in enumerate(order) if n.tag in ("article", "main") and never_article(n) != "reply"]
    sums, reply, until, aside = [[0], [0], [0]], 0, 0, 0
    for i, n in enumerate(order):  # characters so far: of all, outside replies, outside all that is no article
        own = 0 if n.tag == "a" else sum(len(SPACE.sub("", c)) for c in n.children if isinstance(c, str))
        kind = never_article(n)
        reply = max(reply, ends[n]) if kind == "reply" else reply
        until = max(until, ends[n]) if kind else until
        aside = max(aside, ends[n]) if boilerplate(n) else aside
        for total, counts in zip(sums, (True, i >= reply, i >= max(until, aside)), strict=True):
            total.append(total[-1] + own * counts)
    free, skip = [], 0
    for i, end, _, _ in named:
        free += [h for h in holders if skip <= h < i]
        skip = max(skip, end)
    free += [h for h in holders if h >= skip]
    found, after = set(), 0
    for i, end, node, kind in named:
        if i < after:
            continue  # inside one that is taken out
        if i <= heading < end or not free and holders and i <= holders[0] < end:
            continue
        if heading < 0 and not free:
            if kind == "other" and 2 * (sums[1][end] - sums[1][i]) > sums[1][-1] or kind == "reply" and not sums[2][-1]:
                continue
        found.add(node)
        after = end
    return found


def set_held(root: Node, apart: set[Node]) -> None:
    """Set, for each subtree, characters outside links and outside what is set apart: all, in articles, in articles or mains."""
    order, stack = [], [(root, False, False, False)]
    while stack:
        node, article, holder, out = stack.pop()
        article = article or node.tag == "article"
        holder, out = holder or article or node.tag == "main", out or node.tag == "a" or node in apart
        order.append((node, article, holder, out))
        stack += [(c, article, holder, out) for c in node.children if not isinstance(c, str)]
    for node, article, holder, out in reversed(order):
        own = 0 if out else sum(len(SPACE.sub("", c)) for c in node.children if isinstance(c, str))
        below = [c.held for c in node.children if not isinstance(c, str)]
        node.held = tuple(own * counts + sum(h[k] for h in below) for k, counts in enumerate((True, article, holder)))


def drop_skipped(root: Node) -> None:
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or c.tag not in SKIPPED]
        stack += [c for c in node.children if not isinstance(c, str)]


def measure(root: Node) -> list[Node]:
    """Take boilerplate out and set the counts of each subtree; nodes in page order.

    A subtree that holds most of the text in articles stays, or, on a page without any, most of that in mains or of all;
    what is set apart by its name neither counts nor stays.
    """
    drop_skipped(root)
    apart = set_apart(root)
    set_held(root, apart)
    kind = 1 if root.held[1] else 2 if root.held[2] else 0
    most = root.held[kind] / 2
    order, stack = [], [(root, False)]
    while stack:
        node, article = stack.pop()
        article = article or node.tag == "article"
        order.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or c not in apart and (c.held[kind] > most or not boilerplate(c, article))]
        stack += [(c, article) for c in reversed(node.children) if not isinstance(c, str)]
    for node in reversed(order):
        own = sum(len(SPACE.sub("", c)) for c in node.children if isinstance(c, str))
        kids = [c for c in node.children if not isinstance(c, str)]
        node.text = own + sum(c.text for c in kids)
        node.tags = sum(c.tags + 1 for c in kids)
        is_link = node.tag == "a"
        node.links = node.text if is_link else sum(c.links for c in kids)
        node.link_tags = 1 if is_link else sum(c.link_tags for c in kids)
    return order


def set_densities(order: list[Node], body: Node) -> None:
    ratio = body.links / body.text if body.text else 0.0
    for node in order:
        c, t, lc, lt = node.text, max(1, node.tags), node.links, max(1, node.link_tags)
        if not c:
            node.density = 0.0
            continue
        base = math.log(c * lc / max(1, c - lc) + ratio * c + math.e)
        node.density = c / t * math.log(max(1.0, c * t / (max(1, lc) * lt))) / base if lc < c else 0.0
    for node in reversed(order):
        node.sum = sum(c.density for c in node.children if not isinstance(c, str)) or node.density


def main_parts(order: list[Node]) -> list[Node | str]:
    body = next((n for n in order if n.tag == "body"), order[0])
    set_densities(order, body)
    inside, stack = [], [body]
    while stack:
        node = stack.pop()
        inside.append(node)
        stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    articles, around = [n for n in inside if n.tag == "article" and n.text], set()
    for node in articles:
        while node is not None and node not in around:
            around.add(node)
            node = node.parent
    stack = list(articles)
    while stack:
        node = stack.pop()
        around.add(node)
        stack += [c for c in node.children if not isinstance(c, str)]
    peak = max((n for n in inside if not articles or n in around), key=lambda n: n.sum)
    threshold, node = peak.density, peak
    while node is not body:
        node = node.parent
        threshold = min(threshold, node.density)
    for node in reversed(inside):  # the node of the largest sum in each subtree, the first of equals
        node.peak = node
        for child in reversed([c for c in node.children if not isinstance(c, str)]):
            if child.peak.sum >= node.peak.sum:
                node.peak = child.peak
        if node.sum >= node.peak.sum:
            node.peak = node
    marked, stack = {peak}, [body]
    while stack:
        node = stack.pop()
        if node.density >= threshold or node is body:
            marked.add(node.peak)
            stack += [c for c in node.children if not isinstance(c, str)]
    return kept_parts(body, marked)


def kept_parts(body: Node, marked: set[Node]) -> list[Node | str]:
    """The marked subtrees and what belongs between them, in page order.

    Inside an article everything is kept. Elsewhere each node above marked ones gives its marked parts, and of its
    other parts, unless most of their text is links, those with as much text a tag as the body; where the marked ones
    part, also the plain blocks beside them and whatever lies between the first and the last.
    """
    above: set[Node] = set()
    for node in marked:
        while node is not None and node not in above:
            above.add(node)
            node = node.parent if node is not body else None
    least, parted = body.text / max(1, body.tags), False

    def belongs(c: Node | str, beside: bool, between: bool) -> bool:
        if isinstance(c, str):
            return beside
        if c in above or c.tag == "h1":
            return True
        plain = c.tag in BLOCKS or c.tag in INLINE
        return 2 * c.links <= c.text and (c.text >= least * max(1, c.tags) or beside and (plain or between))

    found, stack = [], [body]
    while stack:
        node = stack.pop()
        if isinstance(node, str) or node in marked or node not in above or node.tag == "article":
            found.append(node)
            continue
        held = [i for i, c in enumerate(node.children) if not isinstance(c, str) and c in above]
        parted = parted or len(held) > 1 or node.tag == "main"
        stack += [c for i, c in reversed(list(enumerate(node.children))) if belongs(c, parted, held[0] < i < held[-1])]
    return found


def blocks(parts: list[Node | str]) -> list[str]:
    """Texts of the blocks under the nodes, each with its white space as single spaces."""
    found, now, stack = [], [], list(reversed(parts))

    def end() -> None:
        text = SPACE.sub(" ", "".join(now)).strip()
        now.clear()
        if text:
            found.append(text)

    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            now.append(item)
        elif item.tag == "br" or item.tag not in INLINE:
            end()
            stack.append(None)
            stack += reversed(item.children)
        else:
            stack += reversed(item.children)
    end()
    return found


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by line ends; empty if there is none."""
    builder = TreeBuilder()
    builder.feed(html or "")
    return "\n".join(blocks(main_parts(measure(builder.root))))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` but html, and text, n_chars (its code points).

    A null or empty html, and one without text, gives an empty text. Repeated rows are each read.
    Columns named text or n_chars are replaced.
    """

    def step(batch: pa.RecordBatch) -> list[list]:
        texts = [main_text(h) for h in batch.column(html).to_pylist()]
        return [texts, [len(t) for t in texts]]

    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    return add_columns(pages, keep, {"text": pa.string(), "n_chars": pa.int64()}, lambda: step)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html")))
