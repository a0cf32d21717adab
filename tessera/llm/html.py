"""Main text of web pages by tree scoring.

Each paragraph-like block passes points to its four nearest ancestors: one, one for each comma, one for
each 100 characters up to three; whole to its parent, half to the next, then a third and a quarter.
Points are discounted by link density. The best container is kept, with those siblings that score near
it or read like paragraphs; if it is a part of an article, of a main part or of a division, that is
taken instead, without the blocks in it that are made of links. What is never content (menus, forms,
scripts, comments of readers, adverts, notices: by tag, role, class or id) goes first, wherever it is;
so does what browsers show only in place of media.

Text is whole: character references are decoded, white space inside a block is one space, blocks are
joined in page order by one space. Of a body that is split, sibling articles stay that score ten points, and a
fifth of the best one's; so do sibling divisions that have a paragraph of sentences without links. Time is in proportion to the page, however it is nested or broken.

Defined cases: a null or empty page has no text; broken nesting is closed as browsers do; a page
without any scored block gives its article, main part or body, whichever comes first; very long pages
are read whole; repeated rows are alike; other columns are never read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg canvas audio video".split())
DROPPED = frozenset("nav footer aside form button select dialog menu head".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SCORED = frozenset("p pre td blockquote li h1 h2 h3 dd figcaption".split())
CLOSES_P = BLOCKS - {"body", "html"}
#: What an opening tag closes, up to the nearest of the second set.
SIBLINGS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
# Names in class, id and role of what isn't content, whole words between marks.
NOISE = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline-share comment comments disqus replies cookie cookies consent gdpr notice notification alert popup modal overlay newsletter signup subscribe promo promoted promotion sponsor sponsored related recommended outbrain taboola share sharing social sidebar sidenav side-bar menu nav navbar navigation toolbar footer header masthead pager pagination skip login search complementary contentinfo widget widgets".split()
)
#: What readers write, by how a name or a part of it begins; the second names are an author's.
READERS = re.compile(r"(?:comment(?!ary|aries|ator|ed)|respond$|replies|reply|disqus|reader-?(?:responses?|replies|letters?)|user-?(?:responses?|reviews?))|adsby|googleads?")
#: Before a name of NOISE these say how a page is laid out, not what the element is.
LAYOUT = frozenset("with has no without".split())
#: A header that these begin is that of an article.
OWN_HEADER = frozenset("post article entry story content".split())
#: Compounds of these are what they say, however much text they have.
NEVER_MAIN = frozenset("comment comments disqus replies cookie cookies consent gdpr modal popup newsletter".split())
#: A winner of these kinds is a part of the main part or division around it.
PARTS = frozenset("section ul ol dl li dd table thead tbody tfoot tr td blockquote".split())
#: Siblings of the best container that are kept, if they aren't made of links.
KEPT = frozenset("p h1 h2 h3 h4 h5 h6 pre table figure ul ol dl blockquote".split())
#: Divisions beside the best one are parts of a split body if they have a paragraph of so many characters that ends like a sentence, and next to no links.
BODY_PARTS, BODY_CHARS, BODY_DENSITY = frozenset("div section".split()), 80, 0.1
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*\s*$")
#: Head start of containers by kind: it breaks ties, and outweighs no paragraph.
BONUS = {"article": 1.0, "main": 1.0, "section": 0.5, "div": 0.4, "td": 0.2, "blockquote": 0.2}
#: A block of so many links or more, and so great a share of them, is a menu, as are so many paragraphs in a row.
MENU_LINKS, MENU_DENSITY = 3, 0.9
MENUS = frozenset("ul ol dl div section table p".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?][^<>]*>", re.S)
HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?![\w-])\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


class Node:
    __slots__ = ("children", "commas", "doubt", "links", "n_links", "noise", "own", "parent", "score", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False):
        self.tag, self.parent, self.noise = tag, parent, noise
        self.children: list[Node | str] = []
        self.score = 0.0
        self.doubt = False
        # Of the text: characters, commas, characters in links, links; and (characters, commas) outside of blocks.
        self.size = self.commas = self.links = self.n_links = 0
        self.own = (0, 0)


def _is_noise(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is noise, and whether that is in doubt: only a part of a compound name says so."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True, False
    noise = doubt = False
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return True, False
        if name in ("class", "id", "role") and tag not in ("body", "html", "article", "main"):
            for word in value.split():
                parts = re.split(r"[-_]+", word)
                if word in NOISE or parts[0] not in LAYOUT and (READERS.match(word) or any(READERS.match(p) for p in parts)):
                    return True, False
                if NOISE.isdisjoint(parts) or parts[0] in LAYOUT or parts[0] in OWN_HEADER and parts[1:] == ["header"]:
                    continue
                if not NEVER_MAIN.isdisjoint(parts):
                    return True, False
                noise = doubt = True
    return noise, doubt


def _points(size: int, commas: int) -> int:
    return 1 + commas + min(size // 100, 3) if size else 0


def _nodes(root: Node, doubtful: bool = False) -> list[Node]:
    """All elements in page order but noise and what is in it; with ``doubtful`` those in doubt too."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [c for c in reversed(x.children) if isinstance(c, Node) and (not c.noise or doubtful and c.doubt)]
    return out


def _measure(nodes: list[Node]) -> None:
    """Sizes of all elements of a list in page order, the inner ones first."""
    among = set(map(id, nodes))
    for x in reversed(nodes):
        x.size = x.commas = x.links = x.n_links = 0
        size = commas = 0
        for c in x.children:
            if isinstance(c, str):
                n, k = len("".join(c.split())), c.count(",")
                size, commas = size + n, commas + k
                x.size, x.commas = x.size + n, x.commas + k
            elif id(c) in among:
                x.size, x.commas, x.links, x.n_links = x.size + c.size, x.commas + c.commas, x.links + c.links, x.n_links + c.n_links
                if c.tag not in BLOCKS:
                    size, commas = size + c.own[0], commas + c.own[1]
        x.own = size, commas
        if x.tag == "a":
            x.links, x.n_links = x.size, 1


def _spare(root: Node) -> None:
    """Elements whose noise is in doubt stay if most of the page's paragraph points are theirs, unless an article or main part has points elsewhere."""
    nodes = _nodes(root, doubtful=True)
    if not any(x.noise for x in nodes):
        return
    _measure(nodes)
    total: dict[int, float] = {}  # points in each element, and those of them in an article or main part
    main: dict[int, float] = {}
    named = {id(root): False}
    for x in nodes[1:]:
        named[id(x)] = named[id(x.parent)] or x.tag in ("article", "main")
    for x in reversed(nodes):
        own = _points(x.size, x.commas) if x.tag in ("p", "pre", "blockquote") else 0
        total[id(x)] = total.get(id(x), 0) + own
        main[id(x)] = main.get(id(x), 0) + own * named[id(x)]
        if x.parent is not None:
            total[id(x.parent)] = total.get(id(x.parent), 0) + total[id(x)]
            main[id(x.parent)] = main.get(id(x.parent), 0) + main[id(x)]
    for x in nodes:
        if x.noise and x.doubt and 2 * total[id(x)] > total[id(root)] and main[id(x)] == main[id(root)]:
            x.noise = False


class _Open:
    """The open elements, by place and by tag."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.noisy: list[int] = []
        self.blocks = [0]  # how many of the elements up to each are blocks

    def top(self) -> Node:
        return self.stack[-1]

    def last(self, tag: str) -> int:
        """The place of the innermost open element of a tag; 0 if none is open."""
        own = self.places.get(tag)
        return own[-1] if own else 0

    def add(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.noise:
            self.noisy.append(len(self.stack))
        self.blocks.append(self.blocks[-1] + (node.tag in BLOCKS))
        self.stack.append(node)

    def close_from(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.places[self.stack.pop().tag].pop()
            self.blocks.pop()
        while self.noisy and self.noisy[-1] >= depth:
            self.noisy.pop()

    def close_any(self, tags: set[str], scope: set[str]) -> None:
        """Closes the innermost of ``tags`` unless an element of ``scope``, or noise, is open inside it."""
        depth = max(map(self.last, tags))
        if depth and depth > max(map(self.last, scope)) and depth >= (self.noisy[-1] if self.noisy else 0):
            self.close_from(depth)

    def end(self, tag: str) -> None:
        """An end tag: inline ones don't reach beyond an open block."""
        depth = self.last(tag)
        if depth and (tag in BLOCKS or self.blocks[-1] == self.blocks[depth - 1]):
            self.close_from(depth)


def parse(page: str) -> Node:
    """The page's tree, without comments and elements whose text is no text. Character references are decoded."""
    root = Node("root", None)
    opened, at, n = _Open(root), 0, len(page)
    unclosed: set[str] = set()  # raw elements without an end tag from here on
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            opened.top().children.append(references.unescape(page[at:]))
            break
        if m.start() > at:
            opened.top().children.append(references.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            opened.end(tag)
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/") and tag not in unclosed:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n if tag in ("script", "style") else at
                if not end:
                    unclosed.add(tag)
            continue
        if tag in CLOSES_P:
            opened.close_any({"p"}, {"button", "table", "td", "th"})
        if tag in SIBLINGS:
            opened.close_any(*SIBLINGS[tag])
        parent = opened.top()
        if tag in VOID:
            parent.children.append(" " if tag == "br" else Node(tag, parent) if tag == "hr" else "")
            continue
        noise, doubt = _is_noise(tag, m[3], bool(opened.last("article") or opened.last("main")))
        node = Node(tag, parent, noise)
        node.doubt = doubt
        parent.children.append(node)
        opened.add(node)
    return root


def text_of(node: Node) -> str:
    """The node's text, a space at each block's ends, white space as one space."""
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.noise:
            edge = " " if x.tag in BLOCKS else ""
            todo += [edge, *reversed(x.children), edge]
    return " ".join("".join(out).split())


def _link_density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def _without_menus(node: Node) -> str:
    """The text of an element but the blocks in it that are made of links."""
    todo = [node]
    while todo:
        x = todo.pop()
        row: list[Node] = []  # paragraphs of links that follow one another
        for c in [*x.children, None]:
            if isinstance(c, str) and not c.strip():
                continue
            made_of_links = isinstance(c, Node) and c.n_links > 0 and _link_density(c) >= MENU_DENSITY
            if made_of_links and c.tag == "p":
                row.append(c)
            else:
                if sum(y.n_links for y in row) >= MENU_LINKS:
                    for y in row:
                        y.noise = True
                row = []
                if made_of_links and c.tag in MENUS and c.n_links >= MENU_LINKS:
                    c.noise = True
        todo += [c for c in x.children if isinstance(c, Node) and not c.noise]
    return text_of(node)


def _part_of_body(node: Node) -> bool:
    """Whether a division beside the best one reads like more of the same body."""
    if node.tag not in BODY_PARTS or _link_density(node) > BODY_DENSITY:
        return False
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag not in ("p", "pre", "blockquote"):
            todo += [c for c in x.children if isinstance(c, Node) and not c.noise]
        elif x.size >= BODY_CHARS and SENTENCE.search(text_of(x)[-8:]):
            return True
    return False


def _ancestor(node: Node | None, stop) -> Node | None:
    while node is not None and not stop(node):
        node = node.parent
    return node


def main_text(page: str | None) -> str:
    """The article of a page."""
    if not page:
        return ""
    root = parse(page)
    _spare(root)
    nodes = _nodes(root)
    _measure(nodes)
    found: dict[int, Node] = {}
    for x in nodes:
        if x.tag not in SCORED and x.tag not in BONUS:
            continue
        points = _points(x.size, x.commas) if x.tag in SCORED else _points(*x.own)
        up, share = x.parent if x.tag in SCORED else x, 1
        while points and up is not None and up.tag != "root" and share <= 4:
            if id(up) not in found:
                found[id(up)] = up
                up.score = BONUS.get(up.tag, 0.0)
            up.score += points / share
            up, share = up.parent, share + 1
    if not found:
        best = next((x for tag in ("article", "main", "body") for x in nodes if x.tag == tag), root)
        return text_of(best)
    score = lambda x: x.score * (1 - _link_density(x)) if id(x) in found else 0.0
    best = max(found.values(), key=score)
    # The container may be a part of an article (a section, a list): then the article is the container.
    best = _ancestor(best, lambda x: x.tag == "article") or best
    # So may it be of a main part, or of a division that isn't made of links.
    up = _ancestor(best, lambda x: x.tag not in PARTS)
    if up is not None and (up.tag == "main" or up.tag == "div" and _link_density(up) < 0.25):
        best = up
    if best.parent is None or best.tag in ("main", "body"):
        return _without_menus(best)
    least = max(10.0, 0.2 * score(best))
    parts = []
    if best.tag == "article":  # a page may have its text in several, teasers beside it aren't it
        for x in best.parent.children:
            if isinstance(x, Node) and not x.noise and (x is best or x.tag == "article" and score(x) >= least and _link_density(x) < 0.25):
                parts.append(_without_menus(x))
        return " ".join(p for p in parts if p)
    for x in best.parent.children:
        if isinstance(x, str) or x.noise:
            continue
        headed = x.tag == "div" and any(c.tag == "h1" for c in _nodes(x))
        like_text = (x.tag in KEPT or headed) and _link_density(x) < 0.25
        if x is best or x.size and (score(x) >= least or like_text or _part_of_body(x)):
            parts.append(_without_menus(x))
    return " ".join(p for p in parts if p)


@F.pandas_udf(T.StringType())
def _main_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(main_text)


def extract_main_text(page: Column) -> Column:
    """The main text of a column of html."""
    return _main_text(page)
