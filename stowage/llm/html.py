"""Main text of web pages by scoring the tree of containers.

Every paragraph gives points, for its length and its commas, to the containers
around it; a container's points are discounted by the part of its text that is
in links. The best container is the article, and siblings of it that look like
parts of it are kept. Navigation and other furniture are left out by element or
role wherever they stand; forms, and elements whose name alone marks furniture,
are left out unless they hold most of the page's points.
"""

from __future__ import annotations

import functools
import html as references
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from stowage.llm.tables import free_name

#: Elements of HTML by their part in a page (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript template".split())
SKIPPED = frozenset(
    "script style noscript template iframe object embed svg math canvas audio video textarea select "
    "button input form fieldset dialog nav header footer aside menu head title map datalist".split()
)
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table "
    "thead tbody tfoot tr td th caption figure figcaption address hr details summary center "
    "nav header footer aside form fieldset menu dialog head".split()
)
PARAGRAPHS = frozenset("p pre blockquote li dd td h1 h2 h3 h4 h5 h6".split())
#: Elements that another element's start closes.
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table body html div article section main blockquote".split())
#: Elements of ``SKIPPED`` that are kept where they hold most of the page.
WRAPPERS = frozenset(["form", "fieldset"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Content that is kept beside the best container, if not mostly links.
BESIDE = PARAGRAPHS | frozenset("ul ol dl dt table figure figcaption details".split())
#: Words of names and roles that mark furniture, and words that mark an article.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie "
    "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations comment "
    "comments commentlist disqus reply replies respond discussion pagination pager widget toolbar "
    "search complementary contentinfo dialog toc skip disclaimer paywall".split()
)
ARTICLE = frozenset("article body content entry main post story text blog".split())
#: Furniture that may be longer than the article.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
#: Furniture that as id of a section can also be the subject of a chapter.
TOPICS = frozenset(
    "advertising alert consent cookies dialog disclaimer discussion login menu navigation notice "
    "notices notification related replies reply search sharing social sponsor subscription".split()
)
#: First words of names that tell what an element has or lacks, and last words without a meaning.
STATES = frozenset("no not non has have with without is hide show".split())
PLAIN = frozenset(
    "area bar block bottom box button buttons col column container group inner item items left link "
    "links list outer panel posts right row section top unit slot wrap wrapper".split()
)

#: How much more prose speaks for a larger part of the page, and the prose of a chapter (two paragraphs' points).
MORE, PROSE = 1.25, 2.5

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_NAMES = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Scanner:
    """Tags of a page in order; each character is looked at once, however broken the markup is."""

    def __init__(self, page: str):
        self.page = page
        self.last = {quote: page.rfind(quote) for quote in "\"'"}

    def _behind(self, mark: str, at: int) -> int:
        end = self.page.find(mark, at)
        return len(self.page) if end < 0 else end + len(mark)

    def attributes(self, at: int) -> tuple[int, int]:
        """Where the attributes that begin at a place end, and where their tag ends.

        A quote that is never closed is an ordinary character.
        """
        while found := _STOP.search(self.page, at):
            mark = found.group()
            if mark == ">":
                return found.start(), found.end()
            closed = found.start() < self.last[mark]
            at = self.page.find(mark, found.end()) + 1 if closed else found.end()
        return len(self.page), len(self.page)

    def next(self, at: int) -> tuple[int, int, str | None, str | None, str] | None:
        """Start and end of the next tag, whether it closes, its name and attributes; no name for others."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if found := _OPEN.match(page, start):
                stop, end = self.attributes(found.end())
                return start, end, found[1], found[2], page[found.end() : stop]
            if page.startswith("<!--", start):
                return start, self._behind("-->", start + 4), None, None, ""
            if page.startswith("<![CDATA[", start):
                return start, self._behind("]]>", start), None, None, ""
            if page.startswith(("<!", "<?"), start):
                return start, self._behind(">", start), None, None, ""
            at = start + 1
        return None


class _Node:
    """A block element: its blocks of text and children in page order, and its points."""

    __slots__ = ("tag", "parent", "content", "points", "chars", "linked", "furniture", "named",
                 "suspect", "level", "prose", "headed")

    def __init__(self, tag: str, parent: _Node | None, furniture: bool, named: bool,
                 suspect: _Suspect | None = None):
        self.tag, self.parent = tag, parent
        self.furniture, self.named, self.suspect = furniture, named, suspect
        self.level = 0 if parent is None else parent.level + 1
        self.content: list = []
        self.points = self.prose = 0.0
        self.chars = self.linked = 0
        self.headed = tag in HEADINGS


class _Suspect:
    """An element that may be furniture: its kind, the one around it, and what its nodes hold."""

    __slots__ = ("kind", "outer", "known", "points", "chars", "linked", "headed")

    def __init__(self, kind: str):
        self.kind = kind
        self.outer: _Suspect | None = None
        self.known = False
        self.points = 0.0
        self.chars = self.linked = 0
        self.headed = False


@functools.lru_cache(maxsize=8192)
def _meaning(token: str) -> str:
    """What one name speaks for: a word of ``FURNITURE``, "article", or nothing."""
    words = [w.lower() for w in _WORDS.findall(token)]
    if len(words) > 1 and words[0] in STATES:
        return ""
    while len(words) > 1 and words[-1] in PLAIN:
        words.pop()
    if not words:
        return ""
    if words[-1] in FURNITURE:
        return words[-1]
    if words[-1] in ARTICLE:
        return next((w for w in words if w in FURNITURE), "article")
    return ""


def _judged(tag: str, attributes: str) -> tuple[bool, str, bool]:
    """Whether an element is furniture, as which kind it may be so, and whether its name speaks
    for an article."""
    wrapper = tag in WRAPPERS
    if tag in SKIPPED and not wrapper:
        return True, "", False
    positive = tag in ("article", "main")
    kind = "form" if wrapper else ""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False, kind, positive
    found = ""
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, "", False
        if name == "style":
            if _HIDDEN.search(value):
                return True, "", False
        elif name in ("class", "id", "role"):
            for token in value.split():
                word = _meaning(token)
                if word == "article":
                    positive = True
                elif word and name == "id" and tag in HEADINGS:
                    continue  # made of the heading's text
                elif word and name == "id" and tag == "section" and word in TOPICS:
                    found = found or "topic"
                elif word:
                    found = "comments" if word in COMMENTS else "name"
    if wrapper:
        return False, kind, positive
    if positive or tag in ("body", "html"):
        found = ""
    return False, found, positive


def _tree(page: str) -> _Node:
    root = node = _Node("html", None, False, False)
    text: list[str] = []
    linked = depth = 0  # characters in links since the last block began, and open links
    # Open inline elements from the first one that is or may be furniture: tag, whether it or one
    # around it is furniture, the outermost suspect of its block, block. And the suspect of a text
    # all of which stands in one.
    inline: list[tuple[str, bool, _Suspect | None, _Node]] = []
    alone: _Suspect | None = None
    mixed = False

    def finish() -> None:
        nonlocal linked, alone, mixed
        if text:
            joined = "".join(text)
            text.clear()
            block = _SPACE.sub(" ", joined).strip()
            if block and not node.furniture:
                home = node
                if alone and not mixed and node.tag not in PARAGRAPHS:
                    home = _Node("span", node, False, False, alone)
                    node.content.append(home)
                home.content.append((block, min(linked, len(block))))
        linked = 0
        alone, mixed = None, False

    def add(part: str) -> None:
        nonlocal linked, alone, mixed
        if part and not node.furniture:
            if inline and inline[-1][1]:
                return
            part = references.unescape(part) if "&" in part else part
            text.append(part)
            if not mixed and not part.isspace():
                own = inline[-1][2] if inline and inline[-1][3] is node else None
                mixed = own is None or alone is not None and alone is not own
                alone = own
            if depth:
                linked += len(_SPACE.sub(" ", part).strip())

    def left() -> None:
        while inline and inline[-1][3].level > node.level:
            within[inline.pop()[0]] -= 1

    def ascend(to: _Node) -> None:
        nonlocal node
        while node is not to:
            around[node.tag] -= 1
            node = node.parent

    # How many elements of each tag are open: blocks, and inline ones in ``inline``.
    around: Counter[str] = Counter()
    within: Counter[str] = Counter()
    scanner = _Scanner(page)
    at, end = 0, len(page)
    while at < end:
        found = scanner.next(at)
        if not found:
            add(page[at:])
            break
        start, after, close, tag, attributes = found
        add(page[at:start])
        at = after
        if tag is None:
            continue
        tag = tag.lower()
        if close:
            if tag == "a":
                depth = max(0, depth - 1)
            elif tag in BLOCKS:
                finish()
                if around[tag]:
                    up = node
                    while up.tag != tag:
                        up = up.parent
                    ascend(up.parent)
                    left()
            elif tag == "br":
                add(" ")
            if within[tag] and tag not in BLOCKS:
                while within[tag]:
                    name = inline.pop()[0]
                    within[name] -= 1
                    if name == tag:
                        break
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = stop.start() if stop else end
            if tag not in SKIPPED and stop:
                continue
            at = scanner.next(at)[1] if stop else end
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        furniture, kind, named = _judged(tag, attributes)
        if tag in BLOCKS:
            finish()
            depth = 0
            while node.tag == "p" and node.parent is not None:  # a block ends an open paragraph
                ascend(node.parent)
            closes = CLOSED_BY.get(tag)
            if closes and any(around[c] for c in closes):
                up, to = node, node
                while up.parent is not None and up.tag not in SCOPES:
                    if up.tag in closes:
                        to = up.parent
                        if tag != "tr":
                            break
                    up = up.parent
                ascend(to)
            left()
            if tag == "hr":
                continue
            suspect = _Suspect(kind) if kind else None
            if inline:
                furniture = furniture or inline[-1][1]
                suspect = inline[-1][3] is node and inline[-1][2] or suspect
            child = _Node(tag, node, furniture or node.furniture, named, suspect)
            node.content.append(child)
            node = child
            around[tag] += 1
            continue
        if tag == "a":
            depth += 1
        if (inline or furniture or kind) and not attributes.endswith("/"):
            suspect = _Suspect(kind) if kind else None
            if inline:
                furniture = furniture or inline[-1][1]
                suspect = inline[-1][3] is node and inline[-1][2] or suspect
            inline.append((tag, furniture, suspect, node))
            within[tag] += 1
    finish()
    return root


def _own_points(node: _Node) -> tuple[float, int, int]:
    """Points of the text directly in a node, its length, and how much of it is in links."""
    own = [x for x in node.content if not isinstance(x, _Node)]
    if not own:
        return 0.0, 0, 0
    length = sum(len(t) for t, _ in own)
    in_links = sum(n for _, n in own)
    points = 1 + sum(t.count(",") for t, _ in own) + min(length / 100, 3)
    return points * (1 - min(1.0, in_links / length)), length, in_links


def _settle(root: _Node) -> None:
    """Makes furniture of those suspects that don't hold most of the page's points."""
    nodes, suspects, stack = [], [], [(root, None)]
    total, prose = 0.0, False
    while stack:
        node, around = stack.pop()
        nodes.append(node)
        if node.furniture:
            continue
        if node.suspect and node.suspect is not around:
            if not node.suspect.known:
                node.suspect.known, node.suspect.outer = True, around
                suspects.append(node.suspect)
            around = node.suspect
        points, chars, linked = _own_points(node)
        total += points
        if around:
            around.points += points
            around.chars += chars
            around.linked += linked
            around.headed |= node.tag in HEADINGS
        elif node.tag not in HEADINGS and chars >= 80 and linked < chars / 4:
            prose = True
        stack.extend((x, around) for x in reversed(node.content) if isinstance(x, _Node))
    for suspect in reversed(suspects):
        outer = suspect.outer
        if outer:
            outer.points += suspect.points
            outer.chars += suspect.chars
            outer.linked += suspect.linked
            outer.headed |= suspect.headed
    if not suspects:
        return
    for node in nodes:
        parent, suspect = node.parent, node.suspect
        if parent is not None and parent.furniture:
            node.furniture = True
        elif suspect and not node.furniture:
            most = suspect.points > total / 2
            if suspect.kind == "comments":
                spared = most and not prose
            elif suspect.kind == "topic":
                inside = parent
                while inside is not None and not inside.named:
                    inside = inside.parent
                chapter = suspect.headed or inside is not None
                spared = most or chapter and suspect.linked < suspect.chars / 4
            else:
                spared = most
            node.furniture = not spared
        if node.furniture:
            node.content = []


def _score(root: _Node) -> list[_Node]:
    """Gives points to containers; all nodes in page order."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(x for x in reversed(node.content) if isinstance(x, _Node))
    for node in reversed(nodes):
        for x in node.content:
            if isinstance(x, _Node):
                node.chars += x.chars
                node.linked += x.linked
                node.prose += x.prose
                node.headed |= x.headed and x.chars > 0
            else:
                node.chars += len(x[0])
                node.linked += x[1]
        if not node.furniture:
            node.prose += _own_points(node)[0]
    for node in nodes:
        points, length, _ = _own_points(node)
        if node.furniture or not length:
            continue
        if node.tag in PARAGRAPHS:
            up, share = node.parent, 1.0
        else:
            up, share = node, 1.0
        for _ in range(3):
            if up is None:
                break
            up.points += points * share
            share /= 2 if share == 1.0 else 1.5
            up = up.parent
    for node in nodes:
        if node.named:
            node.points = node.points * 1.5 + 5
        elif node.tag in ("html", "body"):
            node.points *= 0.8
        if node.chars:
            node.points *= 1 - node.linked / node.chars
    return nodes


def _kept(best: _Node) -> list[str]:
    """Blocks of the best container and of what belongs to it around it.

    Where the container's name says nothing, the page may be cut into several
    like it: then the search goes up while a larger part holds much more prose.
    On each level what is mostly links is left out, and what has neither a
    heading nor a chapter's prose; beside an ``article`` or ``main`` only more
    of the kind and plain content count.
    """
    sure = best.tag in ("article", "main")

    def belongs(x: _Node | tuple[str, int]) -> bool:
        if not isinstance(x, _Node):
            return x[1] < len(x[0]) / 2
        if x.furniture or not x.chars or x.linked >= x.chars / 2:
            return False
        return x.tag == best.tag or x.tag in BESIDE or x.named or not sure and (x.headed or x.prose >= PROSE)

    path, top, at = [best], 1, best
    while at.parent is not None:
        if not best.named and at.parent.prose > MORE * at.prose:
            top = len(path)
        at = at.parent
        path.append(at)
    levels = {id(x) for x in path[1 : top + 1]}
    inside = {id(x) for x in path[:top]}
    out: list[str] = []
    stack: list = [path[top] if len(path) > top else best]
    while stack:
        x = stack.pop()
        if not isinstance(x, _Node):
            out.append(x[0])
        elif id(x) in levels:
            stack.extend(y for y in reversed(x.content) if id(y) in inside or belongs(y))
        elif not x.furniture:
            stack.extend(reversed(x.content))
    return out


def main_text(page: str | None) -> str:
    """The article of one page; see ``extract``."""
    if not page:
        return ""
    root = _tree(page)
    _settle(root)
    nodes = [n for n in _score(root) if not n.furniture and n.chars]
    if not nodes:
        return ""
    best = max(nodes, key=lambda n: n.points)
    while best.tag in PARAGRAPHS and best.parent is not None:
        best = best.parent
    return "\n".join(_kept(best))


def extract(
    pages: DataFrame,
    html_col: str = "html",
    keep: list[str] | None = None,
    result_col: str = "text",
) -> DataFrame:
    """The columns of ``pages`` (or those in ``keep``) and the main text of each whole page.

    White space within a block becomes one space; blocks are joined by a line
    feed in page order.

    Defined cases: NULL, empty and textless pages have an empty text; unclosed,
    misplaced and cut-off tags are read as browsers do in the common cases;
    equal pages have equal texts; an input column with the result's name is
    replaced.
    """
    columns = [
        c for c in (pages.columns if keep is None else keep) if c.lower() != result_col.lower()
    ]
    source = pages.select(*columns, F.col(html_col).alias(free_name("html", columns)))

    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string())], names=[*columns, result_col]
            )

    schema = StructType([pages.schema[c] for c in columns]).add(result_col, "string")
    return source.mapInArrow(run, schema)
