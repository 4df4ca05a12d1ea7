"""A small element tree of a saved page, for the few selectors that the page readers need."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from typing import Any

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template"))
#: Attributes by which the elements of a page are found without a walk, as by their classes.
_MARKS = ("id", "data-testid")
#: The markup of a page: what is between its texts. An address in quotes counts as a text, so its tag comes in two pieces.
_MARKUP = re.compile(r"""(<(?:a|img)\s[^<>]*?\b(?:href|src)=(?:'(?=[^'"<>]*'[^<>]*>)|"(?=[^'"<>]*"[^<>]*>)))[^'"<>]*(["'][^<>]*>)|(</?[a-zA-Z][^<>]*>|<!--[^<>]*-->|<![a-zA-Z][^<>]*>)""")
#: Markup that ends where it seems to, whatever text follows: quotes are closed.
_CLOSED = re.compile(r"""<[a-zA-Z][^\s<>"'/=]*+(?:\s+[^\s<>"'/=]++(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s<>"'=`]++))?)*\s*/?>|</[a-zA-Z][^\s<>"'/=]*\s*>|<!.*>""", re.DOTALL)
#: Stands for a text; what becomes of its reference tells whether texts are unescaped there.
_SIGN = "\ue000{}&amp;\ue001"
_SIGNS = re.compile("\ue000([0-9]+)(&|&amp;)\ue001")
#: Pieces of markup whose shapes are held for further pages, and shapes that are tried before a page's markup is looked up.
HELD, TRIED = 50_000, 8


class Element:
    """A tag with its attributes and what is in it, in order."""

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None = None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.content: list[Element | str] = []
        self.marked: dict[tuple[str, str], list[Element]] | None = None

    @property
    def children(self) -> list[Element]:
        return [x for x in self.content if isinstance(x, Element)]

    def walk(self) -> Iterator[Element]:
        """The elements below this one, in document order."""
        waiting = self.children[::-1]
        while waiting:
            found = waiting.pop()
            yield found
            waiting += found.children[::-1]

    def text(self) -> str:
        """Visible text with runs of white space as one space."""
        return " ".join("".join(self.visible()).split())

    def visible(self) -> list[str]:
        """The strings that are seen, in order."""
        parts: list[str] = []
        waiting: list[Element | str] = self.content[::-1]
        while waiting:
            found = waiting.pop()
            if isinstance(found, str):
                parts.append(found)
            elif found.tag == "br":
                parts.append(" ")
            elif found.tag not in _HIDDEN:
                waiting += found.content[::-1]
        return parts

    def is_a(self, tag: str = "", classes: tuple[str, ...] = (), **attributes: str) -> bool:
        """Whether tag, classes and attributes fit; underscores in attribute names stand for hyphens."""
        own = self.attributes.get("class", "").split()
        return (not tag or self.tag == tag) and all(c in own for c in classes) and all(self.attributes.get(k.replace("_", "-")) == v for k, v in attributes.items())

    def _likely(self, classes: tuple[str, ...], attributes: dict[str, str]) -> Iterator[Element] | list[Element]:
        """The elements below that can be meant: of a whole page only those that carry the class, id or test id asked for."""
        if self.marked is None:
            return self.walk()
        keys = [("class", c) for c in classes] + [(k, v) for k, v in ((k.replace("_", "-"), v) for k, v in attributes.items()) if k in _MARKS]
        return min((self.marked.get(k, []) for k in keys), key=len) if keys else self.walk()

    def all(self, tag: str = "", *classes: str, **attributes: str) -> list[Element]:
        return [e for e in self._likely(classes, attributes) if e.is_a(tag, classes, **attributes)]

    def first(self, tag: str = "", *classes: str, **attributes: str) -> Element | None:
        return next((e for e in self._likely(classes, attributes) if e.is_a(tag, classes, **attributes)), None)

    def following(self) -> list[Element]:
        """The elements after this one in its parent."""
        beside = self.parent.children if self.parent else [self]
        return beside[beside.index(self) + 1 :]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {})
        self.root.marked = {}

    def _made(self, tag: str, attrs: list[tuple[str, str | None]]) -> Element:
        made = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.content.append(made)
        for k in _MARKS:
            if k in made.attributes:
                self.root.marked.setdefault((k, made.attributes[k]), []).append(made)
        for c in dict.fromkeys(made.attributes.get("class", "").split()):
            self.root.marked.setdefault(("class", c), []).append(made)
        return made

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        made = self._made(tag, attrs)
        if tag not in _VOID:
            self.at = made

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._made(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        up: Element | None = self.at
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None and up.parent is not None:  # an end without a start is passed over
            self.at = up.parent

    def handle_data(self, data: str) -> None:
        self.at.content.append(data)


def parse(html: str | None) -> Element:
    """The tree of a page; open tags end where their parent ends. A null page is empty."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


# ---------------------------------------------------------------- readers of many pages of like markup


def said(found: Any) -> Any:
    """Elements as their text, pairs of an element and a name as its attribute, in lists and dicts of any depth; None stays."""
    if isinstance(found, Element):
        return found.text()
    if isinstance(found, tuple):
        return found[0].attributes.get(found[1])
    if isinstance(found, list):
        return [said(x) for x in found]
    return {k: said(x) for k, x in found.items()} if isinstance(found, dict) else found


def _text_of(parts: list[str]) -> Callable[[tuple[str, ...]], str]:
    """What ``Element.text`` gives of these strings, with a page's texts in place of the signs."""
    leaves: list[tuple[int, bool] | str] = []
    for part in parts:
        for i, x in enumerate(_SIGNS.split(part)):
            if i % 3 == 1:
                leaves.append((int(x), _SIGNS.split(part)[i + 1] == "&"))
            elif i % 3 == 0 and x:
                leaves.append(x)

    def one(texts: tuple[str, ...]) -> str:
        x = texts[at]
        return " ".join((unescape(x) if "&" in x else x).split())

    def many(texts: tuple[str, ...]) -> str:
        return " ".join("".join([x if isinstance(x, str) else unescape(texts[x[0]]) if x[1] else texts[x[0]] for x in leaves]).split())

    if len(leaves) == 1 and not isinstance(leaves[0], str) and leaves[0][1]:
        at = leaves[0][0]
        return one
    return many


def _teller(found: Any) -> Callable[[tuple[str, ...]], Any]:
    """``said``, as a function of a page's texts."""
    if isinstance(found, Element):
        return _text_of(found.visible())
    if isinstance(found, list):
        parts = [_teller(x) for x in found]
        return lambda texts: [f(texts) for f in parts]
    if isinstance(found, dict):
        fields = [(k, _teller(x)) for k, x in found.items()]
        return lambda texts: {k: f(texts) for k, f in fields}
    fixed = said(found)
    if fixed and (sign := _SIGNS.fullmatch(fixed)):
        at = int(sign[1])
        return lambda texts: texts[at]
    return lambda texts: fixed


class _Shape:
    """What a reader finds in all pages of one markup: which of a page's texts."""

    def __init__(self, find: Callable[[Element], Any], root: Element, markup: tuple[str, ...], addresses: set[int]):
        self.tell = _teller(find(root))
        # a text without "<" is read as text wherever one stands, and an address without quotes and references as an address
        texts = [r"([^<>&'\"]*+)" if i in addresses else "([^<]*+)" for i in range(len(markup) + 1)]
        self.fits = re.compile("".join(x for text, tag in zip(texts, markup) for x in (text, re.escape(tag))) + texts[-1]).fullmatch


def _shape(find: Callable[[Element], Any], markup: tuple[str, ...]) -> _Shape | None:
    """How pages of this markup are read, told by a page that has a sign for each text. None if a sign does not come back alone, as for a text inside a tag."""
    whole = "".join(markup)  # the two pieces of a tag with an address meet here, around an empty one
    if "\ue000" in whole or "\ue001" in whole or not all(map(_CLOSED.fullmatch, re.split("(?<=>)(?=<)", whole))):
        return None
    root = parse("".join(x for i, tag in enumerate(markup) for x in (_SIGN.format(i), tag)) + _SIGN.format(len(markup)))
    seen, addresses = [], set()
    for e in (root, *root.walk()):
        for x in e.content:
            if isinstance(x, str):
                parts = _SIGNS.split(x)
                if "&" in parts[2::3] and (len(parts) != 4 or parts[0] or parts[3]):
                    return None
                seen += map(int, parts[1::3])
        for name, value in e.attributes.items():
            if "\ue000" in value or "\ue001" in value:
                sign = _SIGNS.fullmatch(value)
                if name not in ("href", "src") or not sign or sign[2] != "&":
                    return None
                seen.append(int(sign[1]))
                addresses.add(int(sign[1]))
    return _Shape(find, root, markup, addresses) if sorted(seen) == list(range(len(markup) + 1)) else None


class Reader:
    """What ``find`` finds in a page, as ``said``. Of pages of equal markup only the first two are parsed.

    ``find`` gives elements, or pairs of an element and the name of an attribute, in lists and dicts, and goes by tags and attributes other
    than addresses, never by texts. A page with a text that could be read as markup is always parsed.
    """

    def __init__(self, find: Callable[[Element], Any]):
        self.find = find
        self.shapes: dict[tuple[str, ...], _Shape | None] = {}
        self.recent: list[_Shape] = []
        self.met: set[int] = set()
        self.held = 0

    def __call__(self, html: str | None) -> Any:
        html = html or ""
        for i, shape in enumerate(self.recent):
            if texts := shape.fits(html):
                if i:
                    self.recent.insert(0, self.recent.pop(i))
                return shape.tell(texts.groups())
        markup = tuple(x for found in _MARKUP.findall(html) for x in found if x)
        if markup not in self.shapes:
            if hash(markup) not in self.met:  # markup met once costs no more than its page
                if len(self.met) >= HELD:
                    self.met.clear()
                self.met.add(hash(markup))
                return said(self.find(parse(html)))
            if self.held + len(markup) > HELD:
                self.shapes.clear()
                self.recent.clear()
                self.held = 0
            self.held += len(markup)
            self.shapes[markup] = _shape(self.find, markup)
        shape = self.shapes[markup]
        texts = shape.fits(html) if shape else None
        if not texts:
            return said(self.find(parse(html)))
        self.recent = [shape, *[x for x in self.recent if x is not shape][: TRIED - 1]]
        return shape.tell(texts.groups())
