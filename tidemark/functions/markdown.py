"""HTML to canonical Markdown: a small node tree, rendered block by block.

The visible text of the result equals that of the page; script, style and the like are dropped. Blank space next to an emphasis or
link mark is moved outside it, list items keep their ordinals and depth, tables are flattened to text, and the result is NFKC.
"""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NORMALIZER = "md/1"
#: Which elements are left out, which end a block, and headings by level.
SKIPPED = frozenset({"script", "style", "noscript", "template", "head", "title"})
BLOCKS = frozenset({"p", "div", "section", "article", "header", "footer", "main", "aside", "table", "tr", "thead", "tbody", "blockquote", "pre", "figure", "nav"})
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
LISTS = ("ul", "ol")
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*"}
_BREAK = "\ue000"
_SPACE = re.compile(r"\s+")


class _Node:
    __slots__ = ("tag", "href", "children")

    def __init__(self, tag: str, href: str | None = None):
        self.tag, self.href, self.children = tag, href, []


class _Tree(HTMLParser):
    """Nodes and texts; an end tag closes the nearest open element of its name, or is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.open = [self.root]
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.hidden += 1
        elif not self.hidden:
            if tag == "li":  # an item ends the item before it in the same list
                for k in range(len(self.open) - 1, 0, -1):
                    if self.open[k].tag in LISTS:
                        break
                    if self.open[k].tag == "li":
                        del self.open[k:]
                        break
            node = _Node(tag, dict(attrs).get("href") if tag == "a" else None)
            self.open[-1].children.append(node)
            if tag not in VOID:
                self.open.append(node)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        elif not self.hidden:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    del self.open[k:]
                    break

    def handle_data(self, data):
        if not self.hidden:
            self.open[-1].children.append(data)


def parse(html: str) -> _Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


class _Writer:
    """Collects finished blocks as (kind, text); `line` is the inline text of the block that is being written."""

    def __init__(self):
        self.blocks: list[tuple[str, str]] = []
        self.line: list[str] = []

    def flush(self, prefix: str = "", every: str = "") -> None:
        text = _SPACE.sub(" ", "".join(self.line)).strip()
        text = re.sub(rf" ?{_BREAK} ?", "\n", text).strip()
        self.line = []
        if text:
            kind = "quote" if every else "item" if prefix and not prefix.startswith("#") else "other"
            self.blocks.append((kind, prefix + text if not every else "\n".join(every + t for t in text.split("\n"))))

    def walk(self, node: _Node, depth: int, marker: str, every: str) -> str:
        """Writes the children. marker: of the list item around, until its first text is out; returns what is left of it."""
        ordinal = 0
        for child in node.children:
            if isinstance(child, str):
                self.line.append(child)
            elif child.tag in MARKS or child.tag == "a":
                self.inline(child, depth, marker, every)
            elif child.tag == "br":
                self.line.append(_BREAK)
            elif child.tag in ("td", "th"):
                self.line.append(" ")
                self.walk(child, depth, marker, every)
            elif child.tag == "hr":
                self.flush(marker, every if not marker else "")
                self.blocks.append(("other", "---"))
            elif child.tag in HEADINGS:
                self.flush(marker, every if not marker else "")
                self.walk(child, depth, "", "")
                self.flush("#" * HEADINGS[child.tag] + " ")
            elif child.tag in LISTS:
                self.flush(marker, every if not marker else "")
                self.walk(child, depth + 1, "", every)
                self.flush("", every)
            elif child.tag == "li":
                self.flush(marker, every if not marker else "")
                ordinal += 1
                own = "  " * max(0, depth - 1) + (f"{ordinal}. " if node.tag == "ol" else "- ")
                self.walk(child, max(depth, 1), own, every)
                self.flush(own)
            elif child.tag == "blockquote":
                self.flush(marker, every if not marker else "")
                self.walk(child, depth, "", "> ")
                self.flush("", "> ")
            elif child.tag in BLOCKS and not marker:
                self.flush("", every)
                self.walk(child, depth, "", every)
                self.flush("", every)
            elif child.tag in BLOCKS:  # paragraphs of an item stay on its line
                self.line.append(" ")
                self.walk(child, depth, marker, every)
                self.line.append(" ")
            else:
                self.walk(child, depth, marker, every)
        return marker

    def inline(self, node: _Node, depth: int, marker: str, every: str) -> None:
        if any(not isinstance(c, str) and (c.tag in BLOCKS or c.tag in LISTS or c.tag in HEADINGS or c.tag == "li") for c in node.children):
            self.walk(node, depth, marker, every)  # a mark cannot hold a block
            return
        held, self.line = self.line, []
        self.walk(node, depth, marker, every)
        inner, self.line = "".join(self.line), held
        core = inner.strip()
        before = after = MARKS.get(node.tag, "")
        if node.tag == "a":
            before, after = "[", f"]({node.href})" if node.href else "]"
        if not core and node.tag != "a":
            self.line.append(inner)
            return
        at = inner.find(core) if core else 0
        self.line += [inner[:at], before, core, after, inner[at + len(core) :]]


def _kind_of(kind: str, text: str) -> str:
    """Text that only looks like an item, once it is written, follows what comes before it as an item does."""
    return "item" if kind != "quote" and _item_mark(text) else kind


def _item_mark(text: str) -> int:
    """The length of an item's mark, with what indents it, at the start of a line; 0 without one."""
    indent = len(text) - len(text.lstrip(" "))
    rest, digits = text[indent:], 0
    while digits < len(rest) and rest[digits].isdecimal():
        digits += 1
    if indent % 2:
        return 0
    if rest.startswith("- "):
        return indent + 2
    return indent + digits + 2 if digits and rest[digits : digits + 2] == ". " else 0


def to_markdown(html: str) -> str:
    """Blocks stand apart by a blank line, but items follow what is before them directly, and so do quotes that follow a quote."""
    writer = _Writer()
    writer.walk(parse(html), 0, "", "")
    writer.flush()
    out, last = [], ""
    for kind, text in writer.blocks:
        lines = [x.rstrip() for x in unicodedata.normalize("NFKC", text).split("\n")]
        kind = _kind_of(kind, lines[0])
        if out and not (kind == "item" or (kind == last == "quote")):
            out.append("")
        out += lines
        last = kind
    return "\n".join(out).strip()


def visible_text(html: str) -> str:
    """The page's text with one blank wherever a block, item or line ends."""
    out: list[str] = []

    def walk(node: _Node) -> None:
        edge = " " if node.tag in BLOCKS or node.tag in HEADINGS or node.tag in (*LISTS, "li", "br", "hr", "td", "th") else ""
        out.append(edge)
        for c in node.children:
            out.append(c) if isinstance(c, str) else walk(c)
        out.append(edge)

    walk(parse(html))
    return _SPACE.sub(" ", unicodedata.normalize("NFKC", "".join(out))).strip()


def letters(text: str) -> str:
    """Letters and digits only: what structure marks cannot change."""
    return "".join(filter(str.isalnum, text))


def _without_links(text: str) -> str:
    """[label](target) -> label, from left to right; brackets that do not close stay."""
    out, at = [], 0
    while (opened := text.find("[", at)) >= 0:
        closed = text.find("]", opened + 1)
        end = text.find(")", closed + 2) if closed >= 0 and text[closed + 1 : closed + 2] == "(" else -1
        if end < 0:
            out.append(text[at : opened + 1])
            at = opened + 1
        else:
            out += [text[at:opened], text[opened + 1 : closed]]
            at = end + 1
    return "".join([*out, text[at:]])


def _without_line_mark(line: str) -> str:
    if line == "---":
        return ""
    level = len(line) - len(line.lstrip("#"))
    if 1 <= level <= 6 and line[level : level + 1] == " ":
        return line[level + 1 :]
    return line[2:] if line.startswith("> ") else line[_item_mark(line) :]


def _without_emphasis(line: str) -> str:
    """Double stars go, and single ones that touch text on one side and no word on the other."""
    word = lambda c: c.isalnum() or c == "_"
    kept, i = [], 0
    while i < len(line):
        if line[i] != "*":
            kept.append(line[i])
            i += 1
            continue
        if line.startswith("**", i):
            i += 2
            continue
        before, after = line[i - 1 : i], line[i + 1 : i + 2]
        opens = bool(after) and not after.isspace() and not (before and word(before))
        closes = bool(before) and not before.isspace() and not (after and word(after))
        if not (opens or closes):
            kept.append("*")
        i += 1
    return "".join(kept)


def strip_markdown(text: str) -> str:
    """The words of a Markdown text, without the marks of lines, emphasis and links, on one line."""
    return " ".join(" ".join(_without_emphasis(_without_line_mark(x)) for x in _without_links(text).split("\n")).split())


def _each(fn):
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fn(t))

    return F.pandas_udf(run, StringType())


def markdown_column(html):
    return _each(to_markdown)(html)


def text_mismatch(html):
    """Null if the visible letters of the page and of its Markdown agree, else where they part."""

    def compare(h: str) -> str | None:
        a, b = letters(visible_text(h)), letters(re.sub(r"\]\([^)]*\)", "]", re.sub(r"(?m)^(?: {2})*\d+\. ", "", to_markdown(h))))
        if a == b:
            return None
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return f"{a[k : k + 30]}|{b[k : k + 30]}"

    return _each(compare)(html)
