"""Lines of text of an HTML page, without what its markup itself declares not to be the article."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

# A comment; a tag, whose quotes count after an equals sign only; a declaration or other bogus
# comment. A tag that the end of the page cuts off has no ``end``.
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|</?(?P<name>[a-zA-Z][^\s/>]*+)"
    r"(?P<attributes>(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?P<end>>)?"
    r"|<(?:[!?]|/[^a-zA-Z>])[^>]*+(?:>|\Z)"
    r"|</>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(
    r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?"
)
_WORDS = re.compile(r"[^a-z0-9]+")
# Fixed value: the characters with the Unicode property White_Space.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

# Fixed values of HTML: elements whose content is not markup; inline elements; void elements;
# elements that hold no running text of the page; ARIA roles of the same meaning.
RAW = frozenset("script style title textarea iframe noembed noframes xmp plaintext".split())
INLINE = frozenset(
    "a abbr acronym b basefont bdi bdo big blink br cite code data del dfn em font i img ins kbd "
    "label map mark meter nobr output picture progress q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset(
    "area base basefont br col embed frame hr img input keygen link meta param source track "
    "wbr".split()
)
OUTSIDE = frozenset(
    "nav header footer aside dialog menu template noscript svg math select button datalist "
    "object audio video canvas applet head".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar "
    "toolbar tablist".split()
)
# Blocks that only hold one line each, and close one another without an end tag.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot pre hr option".split())
MAIN = frozenset(("main", "article"))
# Words of class names and ids by which pages mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav "
    "navbar navigation menu breadcrumb breadcrumbs sidebar widget footer masthead topbar cookie "
    "cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended comment comments disqus pagination pager "
    "toolbar".split()
)
# With one of these a class name says what surrounds the element, as in "has-sidebar".
ABOUT = frozenset("has with no without layout".split())


# How deep a line lies: outside the page's main element, in it, or in a container within it.
APART, MAIN_LINE, WITHIN = 0, 1, 2


class Line(NamedTuple):
    """A block's text, the number of its container within the page, and how deep it lies."""

    text: str
    container: int
    depth: int


class _Element(NamedTuple):
    name: str
    container: int = 0
    depth: int = APART
    article: bool = False
    form: bool = False
    # Place in the stack of the element that began what is not the article; 0 outside of such.
    outside: int = 0


def _marked(attributes: str) -> bool:
    """Whether attributes say that an element is hidden or not part of the article."""
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id"):
            for mark in map(_WORDS.split, value.split()):
                if not MARKS.isdisjoint(mark) and ABOUT.isdisjoint(mark):
                    return True
        elif key == "role":
            if not ROLES.isdisjoint(value.split()):
                return True
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        elif key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def _outside(name: str, attributes: str, inside: _Element) -> bool:
    """Whether an element begins something that is not the article."""
    if name in MAIN:
        # An article within an article is a comment on it.
        return name == "article" and inside.article
    if name in OUTSIDE:
        return name != "header" or inside.depth == APART
    if name in ("html", "body") or not attributes.strip():
        return False
    return _marked(attributes)


def _ended(stack: list[_Element], name: str) -> list[_Element]:
    """The elements that a block ``name`` ends without an end tag, of those begun outside."""
    first = stack[-1].outside
    if not first:
        return []
    begun = stack[first].name
    if name in MAIN and begun in ("nav", "header"):
        return stack[first:]
    if begun == "p" or (begun == name and name in LINES):
        inner = stack[first:]
        if all(element.name in LINES or element.name in INLINE for element in inner):
            return inner
    return []


def clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


def page_lines(html: str | None) -> list[Line]:
    """The lines of a page in order; nothing of scripts, forms, menus and the like.

    End tags close up to the nearest open element of their name and are ignored without one.
    Paragraphs, list items and cells end where the next one begins, and a menu or page header that
    was left open ends where the main element begins. A form that holds more of the text than there
    is outside it is no form but a wrapper, and stays.
    """
    html = html or ""
    lines: list[Line] = []
    in_form: list[bool] = []
    pieces: list[str] = []
    stack = [_Element("")]
    opened: Counter[str] = Counter()
    containers = at = 0

    def end_line() -> None:
        text = clean("".join(pieces))
        pieces.clear()
        if text:
            lines.append(Line(text, stack[-1].container, stack[-1].depth))
            in_form.append(stack[-1].form)

    while at < len(html):
        token = _TOKEN.search(html, at)
        start = token.start() if token else len(html)
        if start > at and not stack[-1].outside:
            piece = html[at:start]
            pieces.append(unescape(piece) if "&" in piece else piece)
        if not token:
            break
        at = token.end()
        if not token["name"]:
            continue
        if not token["end"]:
            break
        name, attributes = token["name"].lower(), token["attributes"]
        inline = name in INLINE
        if not inline:
            end_line()
        elif name == "br" and not stack[-1].outside:
            pieces.append(" ")
        if html[start + 1] == "/":
            # Without an open element of that name nothing ends.
            while opened[name]:
                opened[stack[-1].name] -= 1
                if stack.pop().name == name:
                    break
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            at = end.start() if end and name != "plaintext" else len(html)
            continue
        if name in VOID:
            continue
        if not inline:
            for element in _ended(stack, name):
                opened[element.name] -= 1
                stack.pop()
        inside = stack[-1]
        if name != "main" and (inside.outside or _outside(name, attributes, inside)):
            # Everything is followed here, so that nested end tags do not end it early.
            stack.append(inside._replace(name=name, outside=inside.outside or len(stack)))
        elif name in MAIN:
            containers += 1
            article = inside.article or name == "article"
            stack.append(_Element(name, containers, MAIN_LINE, article))
        elif not inline and name not in LINES:
            containers += 1
            depth = WITHIN if inside.depth else APART
            stack.append(inside._replace(
                name=name, container=containers, depth=depth, form=inside.form or name == "form"
            ))
        else:
            continue
        opened[name] += 1
    end_line()
    of_form = sum(len(line.text) for line, form in zip(lines, in_form, strict=True) if form)
    if 2 * of_form > sum(len(line.text) for line in lines):
        return lines
    return [line for line, form in zip(lines, in_form, strict=True) if not form]
