"""HTML to block text, by a small tree over the standard library's tolerant parser.

Which blocks survive depends on ancestors, attributes and sibling order, so extraction is a Python core
in Arrow batches. The result goes through `text.extracted`, which is native.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import NUMERIC_HEADING

#: Parts of patterns: a digit, a capital, a letter, blanks, any white space.
D = r"\d"
B = r"[ \t]"
S = r"\s"

HEADINGS = frozenset(f"h{n}" for n in range(1, 7))
BLOCKS = HEADINGS | {"blockquote", "pre", "li", "p"}
_VOID = frozenset("wbr track source param meta link input img hr embed col br base area".split())
_GONE = frozenset("noscript aside footer nav style script sup".split())
_BOXES = frozenset("li ul ol aside div section p".split())
_ENDS_P = BLOCKS | {"section", "div", "ol", "ul", "table", "header", "article", "aside", "nav", "footer"}
_NOTE_ID = re.compile(rf"(?:footnote|fnref|fn|endnote|noteref|note|en)[-:._a-z0-9]*|(?:en|n){D}+[a-z]?")
_MARKER = re.compile(r"[0-9]{1,4}[a-z]?[).]?", re.I)
_NUMERIC = re.compile(NUMERIC_HEADING)
_ROLE = {"title", "subtitle", "heading", "bridgehead"}
_TYPE = {"title", "subtitle", "part", "chapter", "bridgehead"}
_CLASS = {"title", "subtitle", "subheading", "section", "part", "heading", "chapter", "book"}
_CLASS_PART = re.compile("(?i)(?:^|[:_-])(?:(?:(?:book|part|section|chapter)?(?:sub)?title)|(?:sub)?heading)(?:[:_-]|$)")


class Node:
    def __init__(self, name: str, attrs: dict[str, str], parent: "Node | None"):
        self.name, self.attrs, self.parent, self.kids = name, attrs, parent, []

    def walk(self):
        for kid in list(self.kids):
            if isinstance(kid, Node):
                yield kid
                yield from kid.walk()

    def text(self) -> str:
        return "".join("\0" if isinstance(k, Node) and k.name == "br" else k.text() if isinstance(k, Node) else k for k in self.kids)

    def drop(self) -> None:
        if self.parent and self in self.parent.kids:
            self.parent.kids.remove(self)

    @property
    def id(self) -> str:
        return self.attrs.get("id", "").strip().lower()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._close("p", _ENDS_P - {"p"})
        if tag == "li":
            self._close("li", {"ol", "ul"})
        node = Node(tag, {k.lower(): v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _close(self, tag, stop=frozenset()) -> None:
        node = self.at
        while node.parent and node.name != tag and node.name not in stop:
            node = node.parent
        if node.name == tag and node.parent:
            self.at = node.parent

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        self.at.kids.append(data)


def tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def tokens(value: str) -> set[str]:
    return set(re.findall("[a-z0-9]+", value.lower()))


def is_note_id(value: str) -> bool:
    return bool(_NOTE_ID.fullmatch(value.strip().lower()))


def is_marker(text: str) -> bool:
    return bool(_MARKER.fullmatch(text.strip()))


def fragment(href: str) -> str:
    return unquote(href.split("#", 1)[1]).strip().lower() if "#" in href else ""


def is_heading(node: Node) -> bool:
    said = [*node.attrs.get("class", "").split(), node.attrs.get("id", "")]
    classes = set().union(*map(tokens, said))
    if any(map(_CLASS_PART.search, said)):
        return True
    return node.name in HEADINGS or bool(tokens(node.attrs.get("role", "")) & _ROLE or tokens(node.attrs.get("epub:type", "")) & _TYPE or classes & _CLASS)


def list_number(item: Node) -> int | None:
    """An ordered list item's number: `start` and `value` count, and reset what follows."""
    if not item.parent or item.parent.name != "ol":
        return None
    whole = lambda s, default: int(s) if re.fullmatch(rf"{S}*[+-]?{D}+{S}*", s or "") else default
    number = whole(item.parent.attrs.get("start"), 1)
    for kid in item.parent.kids:
        if isinstance(kid, Node) and kid.name == "li":
            number = whole(kid.attrs.get("value"), number)
            if kid is item:
                return number
            number += 1
    return None


def _block_text(node: Node) -> str:
    text = node.text().replace("\xa0", " ")
    if node.name == "pre":
        text = re.sub(rf"{B}+\n", "\n", text.replace("\0", "\n"))
        text = re.sub(rf"{B}{{2,}}", " ", _clamp(text))
    else:
        text = _clamp("\n".join(" ".join(part.split()) for part in text.split("\0")))
    return text.strip()


def _clamp(text: str) -> str:
    return re.sub(r"\n{3,}", lambda m: "\n" * (5 if len(m[0]) >= 5 else 3), text)


def blocks(html: str, note_ids: frozenset[str] = frozenset(), backrefs: frozenset[str] = frozenset()) -> str:
    """The text of the outermost blocks, joined by the breaks that their kinds ask for; of the whole page without any."""
    root = tree(html)
    body = next((n for n in root.walk() if n.name == "body"), root)
    for node in list(root.walk()):
        a = node.attrs
        semantic = a.get("epub:type") in ("noteref", "footnote") or a.get("role") in ("doc-noteref", "doc-footnote")
        if node.name in _GONE or semantic or (node.name == "header" and node.parent is body):
            node.drop()
    for node in list(root.walk()):
        if node.id in backrefs and (is_note_id(node.id) or node.name == "a"):
            node.drop()
        elif node.name == "a" and is_marker(node.text()) and fragment(node.attrs.get("href", "")) in note_ids | backrefs:
            node.drop()
    for node in list(root.walk()):
        classes = node.attrs.get("class", "").lower()
        if node.name in _BOXES and (any(w in classes for w in ("credit", "copyright", "endnote", "footnote")) or node.id.startswith(("endnote", "footnote", "fn"))):
            node.drop()

    def outermost(node: Node):
        for kid in node.kids:
            if isinstance(kid, Node):
                if kid.name in BLOCKS:
                    yield kid
                else:
                    yield from outermost(kid)

    found = []
    for node in outermost(body):
        text = _block_text(node)
        if text:
            number = list_number(node) if node.name == "li" else None
            found.append((f"{number}. {text}" if number is not None else text, is_heading(node)))
    if not found:
        return body.text().replace("\0", "")
    out = []
    for k, (text, heading) in enumerate(found):
        named = bool(text.split()) and not _NUMERIC.fullmatch(" ".join(text.split()))
        out += [text, "\n" * ((5 if k == 0 and named else 3) if heading else 2)]
    return "".join(out[:-1])


def footnotes(html: str) -> dict:
    """What a page says of notes: its notes' ids, whether it is a notes page, and its marker links."""
    root, ids, entries, links = tree(html), set(), set(), set()
    source = heading = marked = False
    for node in root.walk():
        a, classes = node.attrs, node.attrs.get("class", "").lower()
        if node.id and (a.get("epub:type") == "footnote" or a.get("role") == "doc-footnote"):
            ids.add(node.id)
            source = True
        if node.name in _BOXES | {"td"}:
            marked |= bool(re.search(rf"(?:^|[{S}_-])(?:(?:foot|end)?notes?){D}*(?:$|[{S}_-])", classes))
            if "footnote" in classes or "endnote" in classes:
                ids |= {node.id} - {""}
                source = True
            if node.id.startswith(("endnote", "footnote", "fn")):
                ids.add(node.id)
                source = True
            first = next((k for k in node.kids if isinstance(k, Node) or k.strip()), None)
            if node.id and isinstance(first, Node) and first.name == "a" and is_marker(first.text()) and fragment(first.attrs.get("href", "")):
                entries.add(node.id)
        if node.name in HEADINGS | {"p"} and " ".join(node.text().lower().split()) in ("endnotes", "footnotes", "notes"):
            heading = True
        if node.name == "a" and is_marker(node.text()):
            href = node.attrs.get("href", "")
            if fragment(href):
                links.add((unquote(href.split("#", 1)[0]), fragment(href)))
            if node.parent and node.parent.id and node.parent.text().strip() == node.text().strip():
                ids.add(node.parent.id)
    if entries and (heading or marked or len(entries) >= 8):
        ids |= entries
        source = True
    return {"note_ids": sorted(ids), "note_source": source, "links": [{"href": h, "fragment": f} for h, f in sorted(links)]}


def html_text(html: Column, note_ids: Column | None = None, backrefs: Column | None = None) -> Column:
    """Block text of pages, before `text.extracted`; note ids come as arrays of a book's footnote index."""
    @F.pandas_udf("string")
    def run(pages: pd.Series, ids: pd.Series, refs: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else blocks(p, frozenset(i), frozenset(r)) for p, i, r in zip(pages, ids, refs)])

    none = F.array().cast("array<string>")
    return run(html, F.coalesce(note_ids, none) if note_ids is not None else none, F.coalesce(backrefs, none) if backrefs is not None else none)


def note_facts(html: Column) -> Column:
    @F.pandas_udf("struct<note_ids: array<string>, note_source: boolean, links: array<struct<href: string, fragment: string>>>")
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([footnotes(p or "") for p in pages], columns=["note_ids", "note_source", "links"])

    return run(html)
