"""Elements of real-world HTML by simple selectors, as a vectorised function over columns.

A selector is one or more compounds separated by spaces (descendants) or `>` (children), several of them by commas; a compound is a tag,
`.class`, `#id` and `[attribute]` or `[attribute=value]` in any combination.

A page is parsed once for all selectors that are asked of it. The parser keeps elements as intervals: an element holds those that begin
after it and before its end, and the texts between its first and its last. End tags may be left out as browsers allow it.
"""

from __future__ import annotations

from collections.abc import Sequence
import re
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.failures import bad

#: Elements without content, and those whose text isn't shown.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style template".split())
PART = re.compile(r"(?P<tag>^[a-zA-Z][\w-]*|^\*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[\w:-]+)(?:=[\"']?(?P<value>[^\"'\]]*)[\"']?)?\]")


#: Fixed values, as HTML has them: what a start tag ends of the elements that are open, up to those in which it may stand again.
BLOCKS = tuple("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS = {
    **{tag: (frozenset({"p"}), frozenset({"button", "td", "th", "caption", "object"})) for tag in BLOCKS},
    "li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th", "p"}), frozenset({"table"})), "td": (frozenset({"td", "th", "p"}), frozenset({"table", "tr"})), "th": (frozenset({"td", "th", "p"}), frozenset({"table", "tr"})),
    **{tag: (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}), frozenset({"table"})) for tag in ("thead", "tbody", "tfoot")},
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})), "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "body": (frozenset({"head"}), frozenset()),
}
#: Elements that an end tag of something around them doesn't reach past.
WALLS = {"li": frozenset({"ul", "ol", "menu", "dir"}), "td": frozenset({"table"}), "th": frozenset({"table"}), "tr": frozenset({"table"}), "p": frozenset({"button", "table", "object"})}


class Compound(NamedTuple):
    tag: str | None
    classes: frozenset[str]
    ids: frozenset[str]
    attributes: tuple[tuple[str, str | None], ...]


CHILD = None
#: Compounds, and CHILD where the next one must be a child.
Way = list[Compound | None]


@dataclass
class Node:
    tag: str
    attributes: dict[str, str]
    parent: Node | None
    first: int  # of the page's texts, the first in it and the one after the last
    last: int = -1

    def fits(self, c: Compound) -> bool:
        if c.tag and c.tag != self.tag or c.ids and self.attributes.get("id") not in c.ids or len(c.ids) > 1:
            return False
        if c.classes and not c.classes <= set(self.attributes.get("class", "").split()):
            return False
        return all(name in self.attributes and (value is None or value == self.attributes[name]) for name, value in c.attributes)

    def inside(self, parts: Way) -> bool:
        """Whether it fits the last compound and its ancestors the others, in order; `>` asks for the parent itself."""
        if not self.fits(parts[-1]):
            return False
        rest, node = parts[:-1], self.parent
        while rest and node:
            if rest[-1] is CHILD:
                if not node.fits(rest[-2]):
                    return False
                rest = rest[:-2]
            elif node.fits(rest[-1]):
                rest = rest[:-1]
            node = node.parent
        return not rest


class Tree(HTMLParser):
    """All elements in document order, and the page's texts. An end tag closes the nearest open element of its name, and those in it; one
    that closes nothing is ignored."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.open: list[Node] = []
        self.nodes: list[Node] = []
        self.texts: list[tuple[str, str]] = []  # the element that a text stands in, and the text
        self.feed(html)
        self.close()
        self.end(0)

    def end(self, at: int) -> None:
        for node in self.open[at:]:
            node.last = len(self.texts)
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ended, kept = ENDS.get(tag, (frozenset(), frozenset()))
        at, lowest = len(self.open), len(self.open)
        while ended and at and self.open[at - 1].tag not in kept:
            at -= 1
            if self.open[at].tag in ended:
                lowest = at
            elif self.open[at].tag in BLOCKS:
                break  # a block of its own is open in between
        self.end(lowest)
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1] if self.open else None, len(self.texts))
        self.nodes.append(node)
        if tag in VOID:
            node.last = node.first
        else:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        walls = WALLS.get(tag, frozenset())
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag == tag:
                self.end(at)
                return
            if self.open[at].tag in walls:
                return

    def handle_data(self, data: str) -> None:
        if self.open:
            self.texts.append((self.open[-1].tag, data))

    def text(self, node: Node) -> str:
        return "\n".join(t for t in (t.strip() for tag, t in self.texts[node.first : node.last] if tag not in HIDDEN) if t)


def compound(part: str) -> Compound:
    found = list(PART.finditer(part))
    values = lambda group: frozenset(m[group] for m in found if m[group])
    tag = next((m["tag"].lower() for m in found if m["tag"] and m["tag"] != "*"), None)
    return Compound(tag, values("cls"), values("id"), tuple((m["attr"], m["value"]) for m in found if m["attr"]))


def parsed(selector: str) -> list[Way]:
    """The parts of each alternative; what isn't understood is an error of configuration, not a selector that fits anything."""
    ways = [w.replace(">", " > ").split() for w in selector.split(",")]
    for way in ways:
        if not way or way[0] == ">" or way[-1] == ">" or any(PART.sub("", part) for part in way if part != ">"):
            raise bad(f"no selector: {selector!r}")
    return [[CHILD if part == ">" else compound(part) for part in way] for way in ways]


def found(tree: Tree, ways: list[Way], attribute: str | None) -> list[str | None]:
    nodes = [n for n in tree.nodes if any(n.inside(w) for w in ways)]
    return [tree.text(n) or None if attribute is None else n.attributes[attribute].strip() if attribute in n.attributes else None for n in nodes]


def select(html: str, selector: str, attribute: str | None = None) -> list[str | None]:
    """Text, or an attribute's value (null if it has none), of every element that fits, in document order."""
    return found(Tree(html), parsed(selector), attribute)


def all_selected(html: Column, wants: Sequence[tuple[str, str | None]]) -> Column:
    """For each wanted (selector, attribute) an array of what `select` finds, a page parsed once; null for null pages."""
    ready = [(parsed(selector), attribute) for selector, attribute in wants]

    @F.pandas_udf("array<array<string>>")
    def find(pages: pd.Series) -> pd.Series:
        def each(page: str) -> list[list[str | None]]:
            tree = Tree(page)
            return [found(tree, ways, attribute) for ways, attribute in ready]

        return pages.map(lambda page: None if page is None else each(page))

    return find(html)


def selected(html: Column, selector: str, attribute: str | None = None) -> Column:
    """An array of what `select` finds in each page; empty for null pages."""
    return F.coalesce(F.get(all_selected(html, [(selector, attribute)]), F.lit(0)), F.array().cast("array<string>"))


def firsts(html: Column, **wants: tuple[str | None, str | None]) -> Column:
    """A struct with what the first element that fits each wanted selector has; null without a selector or an element."""
    asked = {name: want for name, want in wants.items() if want[0]}
    every = all_selected(html, list(asked.values())) if asked else F.lit(None).cast("array<array<string>>")
    place = {name: i for i, name in enumerate(asked)}
    one = lambda held, name: F.get(F.get(held, F.lit(place[name])), F.lit(0)) if name in place else F.lit(None).cast("string")
    return F.element_at(F.transform(F.array(every), lambda held: F.struct(*[one(held, name).alias(name) for name in wants])), 1)


def first(html: Column, selector: str | None, attribute: str | None = None) -> Column:
    """What the first fitting element has; null without a selector or an element."""
    return F.lit(None).cast("string") if not selector else F.get(selected(html, selector, attribute), F.lit(0))
