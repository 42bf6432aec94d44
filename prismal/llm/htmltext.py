"""HTML extraction by tree scoring.

A scanner reads the markup into a light tree, in one pass whose cost is linear
in the page whatever the markup. Scripts, styles, comments, navigation, page
headers and footers, asides, buttons, dialogs and hidden elements are no text of
the page. What a class, an id or a role calls an advert, a notice, a sidebar,
a menu or reader comments is marked, and so is a form.

The tree is then scored from the leaves up. Paragraphs pass points to their
ancestors (one, one for each comma, and one for each 100 characters up to
three): the parent gets all, and each further ancestor a half of the one below.
Containers are moved up or down by their tag and their class, and points are
discounted by the share of text that lies in links. A mark lowers what it is on
to nothing, unless the page speaks against it: the element holds all of the
page's article and main elements; it is a form or bears a word for its place in
the layout, and has three quarters of the page's text outside of links; its
class also has a word for content, and it has a half of that text; it is a
heading, or a paragraph of prose marked by a word for its place alone. Where nothing is left, the page is read again without marks, so that a
page with text that scores is never empty.

The best container is kept, and it grows while its siblings are text: headings,
paragraphs and loose text of the same parent, and containers that score a fifth
of the best or are text with few links. Of what is kept nothing is dropped but
what is marked.

All text of what is kept is returned, block by block in page order: character
references decoded, white space inside a block made one space, blocks trimmed
and joined by one space. Nothing is capped.

Pages that don't close their tags are read as browsers do: a new block closes
an open paragraph, an end tag closes what is open inside its element. A quote
that never closes doesn't hide the rest of the page, and a < without a > is
text. A null or empty page has an empty text; of containers with equal points
the first is the best; an empty table gives no rows. Rows are read one by one,
whatever their id or url, so that repeated rows agree; other columns are left
alone, but those named text and n_chars, which the results replace.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from prismal.llm.common import steps
from prismal.session import ship

#: HTML element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg math canvas object audio video noembed noframes xmp".split())
DROPPED = RAW | frozenset("head title nav footer aside button select option datalist dialog menu fieldset label".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
PARAGRAPH = frozenset("p pre blockquote td th dd dt li h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("article main".split())
#: A start tag of the first kind closes open elements of the second.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr"), "tfoot": ("td", "th", "tr"), "option": ("option",)}
SCOPE = frozenset("table ul ol dl article section main body html div".split())

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
QUOTE = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Words of classes and ids. Those of the first kind say what an element is for, those of the second where it stands.
PURPOSE = re.compile(r"(?:^|[^a-z])(?:ad|ads|adv|adbox|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup|modal|overlay|newsletter|subscri\w*|signup|sign-up|login|comments?|comment-\w+|commentlist|disqus\w*|repl(?:y|ies)|respond|related\w*|recommend\w*|more-stories|pagination|pager|skip-link|breadcrumbs?)(?:$|[^a-z])")
PLACE = re.compile(r"(?:^|[^a-z])(?:share\w*|sharing|social\w*|sidebar\w*|side-bar|aside|rail|menu\w*|nav|navbar|navigation|footer\w*|foot|header|site-header|page-header|masthead|topbar|toolbar|widget\w*|search\w*|form|tags|tagcloud|copyright|legal|disclaimer)(?:$|[^a-z])")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar note status".split())
GOOD = re.compile(r"(?:^|[^a-z])(?:article|body|content|entry|hentry|main|page|post|text|blog|story)(?:$|[^a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Unclosed quotes after which a page's quotes mean nothing any more.
BAD_QUOTES = 3
#: The share of a page's text outside of links that speaks against a mark, without and with a word for content.
MOST, HALF = 0.75, 0.5
#: Characters from which a marked paragraph with few links counts as prose.
PROSE = 80


class Node:
    __slots__ = ("children", "commas", "good", "links", "mark", "own", "parent", "score", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, mark: int = 0, good: bool = False) -> None:
        self.tag, self.parent, self.mark, self.good = tag, parent, mark, good
        self.children: list[Node | str] = []
        self.score, self.size, self.links, self.commas, self.own = 0.0, 0, 0, 0, 0


def _attributes(raw: str) -> dict[str, str]:
    return {name.lower(): unescape(value.strip("\"'")).lower() for name, value in ATTRIBUTE.findall(raw)}


def tokens(html: str):
    """(text before, tag name, whether it is an end tag, its attributes) for each tag, and the text behind the last with no name. Linear in the page."""
    at, last, bad = 0, html.rfind(">"), 0
    begin = 0  # of the text before the next tag
    while (lt := html.find("<", at)) >= 0 and lt < last:
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            yield html[begin:lt], "", False, ""
            at = begin = len(html) if end < 0 else end + 3
            continue
        if html[lt + 1 : lt + 2] in ("!", "?"):
            yield html[begin:lt], "", False, ""
            at = begin = html.find(">", lt) + 1
            continue
        named = NAME.match(html, lt + 1)
        if not named:
            at = lt + 1
            continue
        end = inside = named.end()
        while bad < BAD_QUOTES:
            found = QUOTE.search(html, inside)
            if found and found[0] == ">":
                end = found.start()
                break
            inside = html.find(found[0], found.end()) + 1 if found else 0
            if not inside:  # a quote without an end, or none of a tag
                bad += 1
                end = html.find(">", end)
                break
        else:
            end = html.find(">", end)
        name = named[0].lower()
        yield html[begin:lt], name.lstrip("/"), name[0] == "/", html[named.end() : end]
        at = begin = end + 1
        if name in RAW and not html[end - 1] == "/":  # its content isn't markup
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = begin = close.end() if close else len(html)
            yield "", name, True, ""
    yield html[begin:], "", False, ""


def _mark(tag: str, attributes: dict[str, str], said: str) -> int:
    """0: none, 1: by its place, or a form, 2: by its purpose, 3: no text of the page at all."""
    if not attributes:
        return int(tag == "form")
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or HIDDEN.search(attributes.get("style", "")):
        return 3
    if attributes.get("role") in ROLES:
        return 2
    if tag not in HEADING and PURPOSE.search(said):
        return 2
    return int(tag == "form" or tag not in HEADING and tag not in ARTICLE and bool(PLACE.search(said)))


class Tree:
    """The elements that are open while a page is read; every step is of constant cost, but for closing what was opened."""

    def __init__(self) -> None:
        self.root = Node("html", None)
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # depths of the open elements, by tag
        self.scopes, self.blocks = [0], [0]

    def push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        depth = len(self.open)
        self.open.append(node)
        self.places.setdefault(node.tag, []).append(depth)
        if node.tag in SCOPE:
            self.scopes.append(depth)
        if node.tag not in INLINE:
            self.blocks.append(depth)

    def close(self, depth: int) -> None:
        while len(self.open) > depth:
            node = self.open.pop()
            self.places[node.tag].pop()
            if node.tag in SCOPE:
                self.scopes.pop()
            if node.tag not in INLINE:
                self.blocks.pop()

    def innermost(self, tag: str) -> int:
        return places[-1] if (places := self.places.get(tag)) else 0


def parsed(html: str) -> Node:
    tree = Tree()
    skip, depth = "", 0  # inside an element that is no text of the page
    for text, tag, ends, raw in tokens(html):
        if not skip and text:
            tree.open[-1].children.append(text)
        if not tag or tag in ("html", "body") and skip != "head":
            continue
        empty = raw.endswith("/")
        if skip:
            if tag == skip and not empty:
                depth += -1 if ends else 1
                if not depth:
                    skip = ""
            elif skip == "head" and tag == "body":
                skip = ""
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                tree.open[-1].children.append("\n")
            continue
        if ends:
            at = tree.innermost(tag)
            if at and (tag not in INLINE or at > tree.blocks[-1]):
                tree.close(at)
            elif tag == "p":
                tree.open[-1].children.append("\n")
            continue
        attributes = _attributes(raw) if "=" in raw or "hidden" in raw else {}
        said = f"{attributes.get('class', '')} {attributes.get('id', '')}" if attributes else ""
        mark = _mark(tag, attributes, said)
        if mark == 3 or tag in DROPPED or tag == "header" and not any(tree.innermost(t) for t in ARTICLE):
            if not empty:
                skip, depth = tag, 1
            tree.open[-1].children.append("\n")
            continue
        if tag not in INLINE:  # closes an open paragraph, and list items or cells of the same list or row
            for other in ("p", *CLOSES.get(tag, ())):
                if (at := tree.innermost(other)) > tree.scopes[-1]:
                    tree.close(at)
        node = Node(tag, tree.open[-1], mark, bool(said and GOOD.search(said)))
        tree.push(node)
        if empty and tag not in INLINE and tag not in PARAGRAPH:
            tree.close(len(tree.open) - 1)
    return tree.root


def _walk(root: Node) -> list[Node]:
    """All elements, parents first."""
    out = [root]
    for node in out:
        out.extend(c for c in node.children if isinstance(c, Node))
    return out


def _measured(nodes: list[Node]) -> None:
    """Sizes, links and commas of every element, children first."""
    for node in nodes:
        said = [c for c in node.children if isinstance(c, str)]
        node.size = node.own = sum(len(" ".join(c.split())) for c in said)
        node.commas = sum(c.count(",") + c.count("，") + c.count("、") for c in said)
        node.links, node.score = 0, 0.0
    for node in reversed(nodes):
        if node.tag == "a":
            node.links = node.size
        if (up := node.parent) is not None:
            up.size += node.size
            up.commas += node.commas
            up.links += node.links


def _without_marked(root: Node) -> None:
    """Take out what is marked, unless the page speaks against it."""
    nodes = _walk(root)
    if not any(n.mark for n in nodes):
        return
    articles = {id(n): n.tag in ARTICLE and not n.mark for n in nodes}  # those at or below each element
    for n in reversed(nodes):
        if n.parent is not None:
            articles[id(n.parent)] += articles[id(n)]
    total = articles[id(root)]
    for good in (False, True):  # first what has no word for content, so that it doesn't count as text of the page
        nodes = _walk(root)
        _measured(nodes)
        said = root.size - root.links
        gone: set[int] = set()
        for n in nodes:
            if n.parent is None or id(n.parent) in gone:
                if n.parent is not None:
                    gone.add(id(n))
                continue
            if not n.mark or n.good != good:
                continue
            text = n.size - n.links
            holds = total and articles[id(n)] == total and n.tag not in ARTICLE or (good or n.mark == 1) and text >= (HALF if good else MOST) * said > 0
            prose = n.mark == 1 and n.tag in PARAGRAPH and n.size > PROSE and 4 * n.links < n.size
            if not holds and not prose:
                gone.add(id(n))
        for n in nodes:
            if any(isinstance(c, Node) and id(c) in gone for c in n.children):
                n.children = ["\n" if isinstance(c, Node) and id(c) in gone else c for c in n.children]


def _text(node: Node) -> str:
    parts: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag in INLINE:
            todo.extend(reversed(x.children))
        else:
            todo.append("\n")
            todo.extend(reversed(x.children))
            todo.append("\n")
    return " ".join(unescape("".join(parts)).split())


def _weight(node: Node) -> float:
    by_tag = 5.0 if node.tag == "div" else 25.0 if node.tag in ARTICLE else 3.0 if node.tag in ("pre", "td", "blockquote") else 0.0
    return by_tag + 25.0 * node.good


def _scored(nodes: list[Node]) -> list[Node]:
    """The elements with points, in page order."""
    _measured(nodes)
    for node in reversed(nodes):  # children first: an element's score is complete when it is passed on
        up = node.parent
        if node.tag in PARAGRAPH or node.tag not in INLINE and node.own:
            size = node.size if node.tag in PARAGRAPH else node.own
            points = (1 + node.commas + min(size / 100, 3.0)) * (1 - min(1.0, node.links / node.size)) if node.size else 0.0
            if node.tag in PARAGRAPH and up is not None:
                up.score += points
            else:
                node.score += points
        if up is not None:
            up.score += node.score if node.tag in INLINE else node.score / 2
    found = [n for n in nodes if n.score > 0 and n.tag not in INLINE]
    for n in found:
        n.score = (n.score + _weight(n)) * (1 - min(1.0, n.links / n.size if n.size else 1.0))
    return found


def extracted(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    root = parsed(html)
    _without_marked(root)
    return _best(root) or _best(parsed(html))


def _is_text(x: Node | str, least: float) -> bool:
    """Whether a sibling of the best container is part of the text."""
    if isinstance(x, str):
        return True
    if not x.size:
        return False
    density = x.links / x.size
    if x.tag in HEADING or x.tag in INLINE or x.tag in PARAGRAPH:
        return density < 0.5
    return x.score >= least or density < 0.25


def _best(root: Node) -> str:
    scored = _scored(_walk(root))
    if not scored:
        return _text(root)
    best = max(scored, key=lambda n: n.score)
    least = max(10.0, best.score / 5)
    kept: list[Node | str] = [best]
    while (up := best.parent) is not None:
        around = [best if x is best else x for x in up.children if x is best or _is_text(x, least)]
        others = [x for x in up.children if x is not best and not isinstance(x, str) and x.size]
        kept = around
        if up.parent is None or any(not _is_text(x, least) for x in others):
            break
        best = up  # all that stands here is text: so may be what stands beside it
        kept = [best]
    whole = Node("div", None)
    whole.children = kept
    return _text(whole)


def main_text(pages: DataFrame, *, html_col: str = "html", drop_html: bool = True) -> DataFrame:
    """pages with text and n_chars, in place of the html."""
    ship(pages.sparkSession)
    kept = [c for c in pages.columns if not (drop_html and c == html_col) and c not in ("text", "n_chars")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema.fields)

    def run(batches):
        for whole in batches:
            for batch in steps(whole, html_col):
                texts = [extracted(h) for h in batch.column(batch.schema.get_field_index(html_col)).to_pylist()]
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.mapInArrow(run, f"{fields}, text string, n_chars bigint" if fields else "text string, n_chars bigint")


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
