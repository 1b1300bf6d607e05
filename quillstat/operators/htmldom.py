"""Per-page helper for the extraction partition function.

One ``html.parser`` pass records every element (tag, attributes, parent, text
span); selectors of the rule subset (``tag``, ``tag[a="v"]``, ``tag[a^="v"]``,
descendant by space) are then matched in document order. End tags that may be
left out (p, li, td, th, tr, dt, dd, option) are implied by the start tags that end
them; other missing ones close at the parent's end; void tags hold no text.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
             "source", "track", "wbr"}

# Elements whose end tag may be left out, with the start tags that end them, and the
# elements that such an end does not reach across.
_BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3",
           "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_ENDED_BY = {"p": _BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
             "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
_SCOPES = {"body", "html", "div", "table", "ul", "ol", "dl", "select", "article", "section"}

_STEP = re.compile(r'^([a-zA-Z0-9]+)(?:\[([a-zA-Z0-9_.:-]+)(\^?=)"([^"]*)"\])?$')


class Page(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict] = []
        self.parent: list[int] = []
        self.start: list[int] = []
        self.end: list[int | None] = []
        self._text: list[str] = []
        self._stack: list[int] = []
        self.feed(html or "")
        self.close()
        n = len(self._text)
        self.end = [n if e is None else e for e in self.end]
        # element indices by tag, in document order: rules only look at their own tag
        self.by_tag: dict[str, list[int]] = {}
        for i, t in enumerate(self.tags):
            self.by_tag.setdefault(t, []).append(i)

    def _add(self, tag, attrs) -> int:
        i = len(self.tags)
        self.tags.append(tag)
        d = {}
        for k, v in attrs:
            d.setdefault(k, "" if v is None else v)
        self.attrs.append(d)
        self.parent.append(self._stack[-1] if self._stack else -1)
        self.start.append(len(self._text))
        self.end.append(None)
        return i

    def _implied_end(self, tag) -> None:
        """Close open elements that the start of ``tag`` ends."""
        for j in range(len(self._stack) - 1, -1, -1):
            name = self.tags[self._stack[j]]
            if tag in _ENDED_BY.get(name, ()):
                n = len(self._text)
                for k in self._stack[j:]:
                    self.end[k] = n
                del self._stack[j:]
                if name not in ("td", "th") or tag != "tr":  # a new row also ends the row around the cell
                    return
            elif name in _SCOPES:
                return

    def handle_starttag(self, tag, attrs):
        self._implied_end(tag)
        i = self._add(tag, attrs)
        if tag in VOID_TAGS:
            self.end[i] = len(self._text)
        else:
            self._stack.append(i)

    def handle_startendtag(self, tag, attrs):
        i = self._add(tag, attrs)
        self.end[i] = len(self._text)

    def handle_endtag(self, tag):
        for j in range(len(self._stack) - 1, -1, -1):
            if self.tags[self._stack[j]] == tag:
                n = len(self._text)
                for k in self._stack[j:]:
                    self.end[k] = n
                del self._stack[j:]
                return

    def handle_data(self, data):
        self._text.append(data)

    def text(self, i: int) -> str:
        return "".join(self._text[self.start[i]:self.end[i]])


def parse_selector(selector: str) -> list[tuple]:
    steps = []
    for part in selector.split():
        m = _STEP.match(part)
        if not m:
            raise ValueError(f"unsupported selector step: {part!r}")
        tag, attr, op, val = m.groups()
        steps.append((tag.lower(), attr.lower() if attr else None, op, val))
    return steps


def _step_ok(page: Page, i: int, step: tuple) -> bool:
    tag, attr, op, val = step
    if page.tags[i] != tag:
        return False
    if attr is None:
        return True
    have = page.attrs[i].get(attr)
    if have is None:
        return False
    return have == val if op == "=" else have.startswith(val)


def select_first(page: Page, steps: list[tuple]) -> int:
    """Index of the first element in document order matching the steps, or -1."""
    last = steps[-1]
    for i in page.by_tag.get(last[0], ()):
        if not _step_ok(page, i, last):
            continue
        k, j = len(steps) - 2, page.parent[i]
        while k >= 0 and j >= 0:
            if _step_ok(page, j, steps[k]):
                k -= 1
            j = page.parent[j]
        if k < 0:
            return i
    return -1


def find_first(page: Page, tag: str, attr: str, value: str) -> int:
    """``find(tag, {attr: value})``: exact value, or one of the classes for ``class``."""
    tag, attr = tag.lower(), attr.lower()
    for i in page.by_tag.get(tag, ()):
        have = page.attrs[i].get(attr)
        if have is None:
            continue
        if have == value or (attr == "class" and value in have.split()):
            return i
    return -1
