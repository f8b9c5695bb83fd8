"""HTML and XML to Markdown with the standard library's parser.

Rules of recovery: a block element closes an open paragraph with its inline children; an end tag closes up to its start tag, and is
ignored without one. With ``compat`` comments count as text and texts within an element are joined without a blank.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

#: Elements that are left out, that have no end, and that close a paragraph.
DROPPED = frozenset(("script", "style", "nav", "footer", "header"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": "li", "tr": "tr", "td": "td th", "th": "td th", "dd": "dd dt", "dt": "dd dt", "option": "option"}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)

    def strings(self):
        for c in self.children:
            if isinstance(c, str):
                yield c
            else:
                yield from c.strings()

    def every(self, *tags: str):
        for c in self.children:
            if isinstance(c, Node):
                if c.tag in tags:
                    yield c
                yield from c.every(*tags)

    def text(self, joiner: str) -> str:
        return joiner.join(s for x in self.strings() if (s := x.strip()))


class Tree(HTMLParser):
    def __init__(self, comments: bool):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        self.comments = comments

    def _close(self, *tags: str, until: frozenset = frozenset(("table", "ul", "ol"))) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in until and tags[0] not in until:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._close("p")
        if tag in CLOSES:
            self._close(*CLOSES[tag].split())
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def handle_comment(self, data):
        if self.comments:
            self.open[-1].children.append(data)


def tree(html: str, compat: bool = True) -> Node:
    t = Tree(compat)
    t.feed(html)
    t.close()
    return t.root


#: Names of elements that speak for or against main content. Fixed values.
_FOR = re.compile(r"article|body|content|entry|main|page|post|story|text", re.I)
_AGAINST = re.compile(r"banner|comment|combx|contact|foot|hidden|masthead|media|meta|nav|outbrain|promo|related|scroll|shoutbox|sidebar|sponsor|shopping|tags|tool|widget|cookie|share", re.I)


def article(root: Node, least: int = 250) -> Node | None:
    """The element that holds a page's main content; None where none stands out.

    Paragraphs of 25 characters and more give a point, one for each comma, and one for each hundred characters up to three, to the element
    around them, half of it to the one around that. Names speak for or against an element, and the share of text in links is taken off.
    """
    score: dict[int, float] = {}
    seen: dict[int, Node] = {}

    def walk(node: Node, up: tuple[Node, ...]) -> None:
        for c in node.children:
            if isinstance(c, Node) and c.tag not in DROPPED:
                if c.tag in ("p", "td", "pre") and len(text := c.text(" ")) >= 25:
                    points = 1 + text.count(",") + min(len(text) // 100, 3)
                    for by, around in ((1.0, node), (0.5, up[-1] if up else None)):
                        if around is not None and around.tag not in ("", "html"):
                            if id(around) not in seen:
                                seen[id(around)] = around
                                named = f"{around.attrs.get('class', '')} {around.attrs.get('id', '')}"
                                score[id(around)] = 25 * bool(_FOR.search(named)) - 25 * bool(_AGAINST.search(named)) + {"div": 5, "article": 10, "main": 10, "section": 3, "blockquote": 3, "form": -3, "ul": -3, "ol": -3}.get(around.tag, 0)
                            score[id(around)] += by * points
                walk(c, (*up, node))

    walk(root, ())
    size = lambda n: max(len(n.text(" ")), 1)
    final = {k: v * (1 - sum(len(a.text(" ")) for a in seen[k].every("a")) / size(seen[k])) for k, v in score.items()}
    best = max(final, key=final.get, default=None)
    return seen[best] if best is not None and final[best] > 0 and len(seen[best].text(" ")) >= least else None


def markdown(html: str, compat: bool = True, root: Node | None = None, part: Node | None = None) -> str:
    """Markdown of a page, of its parsed tree ``root`` or of one element of it."""
    root = tree(html, compat) if root is None else root
    body = next(root.every("body"), root) if part is None else part
    out: list[str] = []
    joiner = "" if compat else " "

    def table(node: Node) -> None:
        rows = [[c.text(joiner) for c in tr.every("td", "th")] for tr in node.every("tr")]
        rows = [r for r in rows if r]
        if rows:
            wide = max(map(len, rows))
            lines = [f"| {' | '.join(r + [''] * (wide - len(r)))} |" for r in rows]
            out.extend(["", lines[0], f"| {' | '.join(['---'] * wide)} |", *lines[1:], ""])

    def listing(node: Node) -> None:
        for i, li in enumerate((c for c in node.children if isinstance(c, Node) and c.tag == "li"), 1):
            if text := li.text(joiner):
                out.append(f"{i}. {text}" if node.tag == "ol" else f"- {text}")
        out.append("")

    def leaf(form: str):
        def put(node: Node) -> None:
            if text := node.text(joiner):
                out.append(form.format(text))

        return put

    def link(node: Node) -> None:
        if text := node.text(joiner):
            out.append(f"[{text}]({node.attrs['href']})" if node.attrs.get("href") else text)

    def quote(node: Node) -> None:
        if text := node.text(joiner):
            out.append("\n".join(f"> {x}" for x in text.split("\n")))

    ways = {f"h{i}": leaf("\n" + "#" * i + " {}\n") for i in range(1, 7)} | {
        "p": leaf("\n{}\n"), "ul": listing, "ol": listing, "table": table, "strong": leaf("**{}**"), "b": leaf("**{}**"), "em": leaf("*{}*"), "i": leaf("*{}*"), "a": link, "blockquote": quote,
        "pre": lambda n: out.append(f"\n```\n{''.join(n.strings())}\n```\n"), "img": lambda n: out.append(f"![{n.attrs.get('alt', 'image')}]({n.attrs.get('src', '')})"),
        "hr": lambda n: out.append("\n---\n"), "br": lambda n: out.append("\n"),
    }

    def walk(node: Node) -> None:
        for c in node.children:
            if isinstance(c, str):
                if text := c.strip():
                    out.append(text)
            elif c.tag not in DROPPED:
                ways.get(c.tag, walk)(c)

    walk(body)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def metadata(html: str, root: Node | None = None) -> dict[str, str]:
    root = tree(html, False) if root is None else root
    title = next(root.every("title"), None)
    about = next((m for m in root.every("meta") if m.attrs.get("name") == "description"), None)
    return {"title": "".join(title.strings()) if title else "", "description": about.attrs.get("content", "") if about else ""}


def page(html: str, compat: bool = True, root: Node | None = None, article: bool = False) -> str:
    """The whole page, or its article, under its title, unless it begins with it."""
    root = tree(html, compat) if root is None else root
    text, title = markdown(html, compat, root, _article(root) if article else None), metadata(html, root)["title"].strip()
    return f"# {title}\n\n{text}" if title and not text.startswith(f"# {title}") else text


_article = article
