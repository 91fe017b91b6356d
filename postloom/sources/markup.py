"""Elements of one stored page: where each begins and ends, however deep it lies.

A page is one cell, so this is a helper for a row: one pass over the tags with
a stack of open elements, in time linear in the page.
"""

from __future__ import annotations

import html as references
import re
import sys
from dataclasses import dataclass

from pyspark import cloudpickle

# Fixed values of the markup language: elements without content, those whose content is no markup, ...
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title")
# ... those that may be closed before elements that they hold, ...
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
# ... those that the next of some names closes, up to the nearest of others, ...
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "option": ({"option"}, {"select", "datalist"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
}
# ... and those that end a paragraph and begin a line.
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
LINES = frozenset("p br h1 h2 h3 h4 h5 h6 li ul ol div tr".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<(/?)([a-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>""", re.I | re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

#: The name of an element, or name (* for any), attribute and its value.
Step = str | tuple[str, str, str]


@dataclass
class Element:
    name: str
    attributes: str
    open: int  # where its tag begins
    start: int  # where its content does
    end: int = -1
    stop: int = -1  # where the tag that closes it ends

    def value(self, attribute: str) -> str | None:
        """The first value of an attribute, its references decoded."""
        if attribute.lower() not in self.attributes.lower():
            return None
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == attribute.lower():
                return references.unescape(next((g for g in m.groups()[1:] if g is not None), ""))
        return None

    def fits(self, step: Step) -> bool:
        if isinstance(step, str):
            return step in ("*", self.name)
        return step[0] in ("*", self.name) and self.value(step[1]) == step[2]


def elements(page: str) -> list[Element]:
    """All elements in the order of their tags; unclosed ones end where their surroundings do."""
    found: list[Element] = []
    stack: list[Element] = []
    open_: dict[str, int] = {}

    def close(e: Element, end: int, stop: int) -> None:
        e.end, e.stop = end, stop
        open_[e.name] -= 1

    def pop_through(names: set[str] | frozenset[str], end: int, stop: int, limit: set[str] | frozenset[str] = frozenset()) -> None:
        """Close what is open up to the innermost of ``names``, unless one of ``limit`` is nearer."""
        depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].name in names or stack[k].name in limit), -1)
        if depth < 0 or stack[depth].name in limit:
            return
        while len(stack) > depth + 1:
            close(stack.pop(), end, end)
        close(stack.pop(), end, stop)

    at = 0
    while m := _TAG.search(page, at):
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if not open_.get(name):
                continue
            if name in FORMATTING:
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name)
                close(stack.pop(k), m.start(), m.end())
            else:
                pop_through({name}, m.start(), m.end())
            continue
        if name in ENDS and any(open_.get(n) for n in ENDS[name][0]):
            names, limit = ENDS[name]
            pop_through(names, m.start(), m.start(), limit)
            if name == "tr":
                pop_through({"tr"}, m.start(), m.start(), limit)
        if name in BLOCKS and open_.get("p"):
            pop_through({"p"}, m.start(), m.start(), BLOCKS - {"p"})
        e = Element(name, m[3], m.start(), m.end())
        found.append(e)
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            e.end = e.stop = m.end()
        elif name in RAW:
            closing = re.compile(f"</{name}[^>]*>", re.I).search(page, at)
            e.end, e.stop = closing.span() if closing else (len(page), len(page))
            at = e.stop
        else:
            stack.append(e)
            open_[name] = open_.get(name, 0) + 1
    for e in stack:
        e.end = e.stop = len(page)
    return found


def select(found: list[Element], path: list[Step]) -> list[Element]:
    """The elements that fit the last step and lie inside ones that fit the steps before, in order."""
    inside: list[Element] | None = None
    for step in path:
        here, limit, k = [], -1, 0
        for e in found:
            if inside is not None:
                while k < len(inside) and inside[k].start <= e.open:
                    limit = max(limit, inside[k].end)
                    k += 1
                if e.open >= limit:
                    continue
            if e.fits(step):
                here.append(e)
        inside = here
    return inside or []


def visible(page: str, part: Element, found: list[Element], hidden: list[Element] = ()) -> str:
    """Text of an element, references decoded: line elements break lines, other tags, comments and hidden elements vanish."""
    skip = sorted([(e.open, e.stop) for e in hidden if part.start <= e.open < part.end] + [(e.open, e.stop) for e in found if e.name in ("script", "style") and part.start <= e.open < part.end])
    out, at = [], part.start
    k = 0
    while at < part.end:
        while k < len(skip) and skip[k][1] <= at:
            k += 1
        if k < len(skip) and skip[k][0] <= at:
            at = skip[k][1]
            continue
        m = _TAG.search(page, at, part.end)
        until = min(m.start() if m else part.end, skip[k][0] if k < len(skip) else part.end)
        out.append(page[at:until])
        at = until
        if m and m.start() == at and not (k < len(skip) and skip[k][0] == at):
            if m[2] is not None and m[2].lower() in LINES:
                out.append("\n")
            at = m.end()
    # A blank that must not break is a blank here.
    return references.unescape("".join(out)).replace("\xa0", " ")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
