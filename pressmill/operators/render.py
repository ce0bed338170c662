"""Article content as plain text and as Markdown."""

from __future__ import annotations

from ..functions import scalar as S
from .html_tree import Node, parse_fragment

FORMATS = ("html", "markdown", "text")
_BLOCKS = frozenset("p div section article figure figcaption header footer".split())
_WRAPS = {"strong": "**", "b": "**", "em": "*", "i": "*"}


def convert(content: str | None, form: str) -> str | None:
    if content is None or form == "html":
        return content
    return to_text(content) if form == "text" else to_markdown(content)


def to_text(html: str) -> str:
    """All text with white space collapsed; blocks add no separators."""
    return S.collapse(parse_fragment(html).text())


def to_markdown(html: str) -> str:
    return S.trim("".join(_render(c, 0) for c in parse_fragment(html).children)) + "\n"


def _render(node: Node, depth: int) -> str:
    if node.tag == "#text":
        return node.data
    if not node.is_element:
        return ""
    tag = node.tag
    if tag in ("ul", "ol"):
        return _items(node, depth)
    inner = "".join(_render(c, depth) for c in node.children)
    bare = S.trim(inner)
    if tag in _BLOCKS:
        return bare + "\n\n" if bare else ""
    if tag == "blockquote":
        return "".join(f"> {line.removesuffix(chr(13))}\n" for line in bare.split("\n")) if bare else ""
    if tag in _WRAPS:
        return _WRAPS[tag] + bare + _WRAPS[tag]
    match tag:
        case "h1" | "h2" | "h3" | "h4" | "h5" | "h6":
            return f"{'#' * int(tag[1])} {bare}\n\n"
        case "a":
            return f"[{inner}]({node.get('href')})"
        case "img":
            return f"![{node.get('alt')}]({node.get('src')})"
        case "code":
            return f"`{inner}`"
        case "pre":
            return f"```\n{bare}\n```\n\n"
        case "br":
            return "  \n"
        case "hr":
            return "---\n\n"
    return inner


def _items(node: Node, depth: int) -> str:
    lines = []
    for number, item in enumerate(node.child_elements(), 1):
        mark = f"{number}. " if node.tag == "ol" else "- "
        lines.append("  " * depth + mark + S.trim(_render(item, depth + 1)) + "\n")
    return "".join(lines) + "\n"
