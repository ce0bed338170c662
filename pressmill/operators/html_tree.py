"""HTML to an ordered tree and back: tokens, tree construction with error recovery, serialisation.

Construction follows the public HTML standard where pages in the wild depend
on it: implied heads and bodies, implied end tags, re-opened formatting
elements (three equal ones at most), mis-nested formatting (the adoption
agency) and content misplaced in tables (foster parenting). Attribute values
of equal names keep the first. Serialised attributes are in name order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape as _escape
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript plaintext".split())
ESCAPABLE = frozenset(["title", "textarea"])
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr main menu nav ol p pre search section summary table ul listing xmp plaintext li dd dt".split()
)
_SPECIAL = _CLOSES_P | frozenset(
    "applet area base basefont bgsound body br button caption col colgroup embed frame frameset head html iframe img input"
    " keygen link marquee meta noembed noframes noscript object param script select source style tbody td template textarea"
    " tfoot th thead title tr track wbr".split()
)
_SCOPE = frozenset("applet caption html table td th marquee object template #root".split())
_TABLE_SCOPE = frozenset(["html", "table", "template", "#root"])
_HEAD_ONLY = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TABLE_PARTS = frozenset("table tbody tfoot thead tr".split())
_MARKERS = frozenset("applet caption marquee object td th template".split())


class Node:
    """An element, a text (tag ``#text``), a comment (``#comment``) or the root of a tree (``#root``)."""

    __slots__ = ("tag", "attrs", "children", "parent", "data")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, data: str = ""):
        self.tag = tag
        self.attrs = attrs if attrs is not None else {}
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.data = data

    @property
    def is_element(self) -> bool:
        return self.tag[0] != "#"

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    def append(self, child: Node) -> Node:
        child.detach()
        child.parent = self
        self.children.append(child)
        return child

    def insert(self, at: int, child: Node) -> Node:
        child.detach()
        child.parent = self
        self.children.insert(at, child)
        return child

    def place(self) -> int:
        """Its position among its parent's children, by identity."""
        return next(k for k, c in enumerate(self.parent.children) if c is self)

    def detach(self) -> None:
        if self.parent is not None:
            del self.parent.children[self.place()]
            self.parent = None

    def replace_with(self, *nodes: Node) -> None:
        parent, at = self.parent, self.place()
        self.detach()
        for k, node in enumerate(nodes):
            parent.insert(at + k, node)

    def walk(self) -> Iterator[Node]:
        """All nodes below, in document order."""
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            yield node
            if node.children:
                stack.extend(node.children[::-1])

    def element_list(self) -> list[Node]:
        """All elements below, in document order."""
        found: list[Node] = []
        stack = [c for c in self.children[::-1] if c.tag[0] != "#"]
        while stack:
            node = stack.pop()
            found.append(node)
            if node.children:
                stack += [c for c in node.children[::-1] if c.tag[0] != "#"]
        return found

    def elements(self) -> Iterator[Node]:
        return iter(self.element_list())

    def ancestors(self) -> Iterator[Node]:
        """Elements above, nearest first."""
        up = self.parent
        while up is not None and up.tag != "#root":
            yield up
            up = up.parent

    def child_elements(self) -> list[Node]:
        return [c for c in self.children if c.tag[0] != "#"]

    def next_element(self) -> Node | None:
        if self.parent is None:
            return None
        return next((s for s in self.parent.children[self.place() + 1 :] if s.is_element), None)

    def previous_elements(self) -> list[Node]:
        """Element siblings before it, nearest first."""
        if self.parent is None:
            return []
        return [s for s in reversed(self.parent.children[: self.place()]) if s.is_element]

    def text(self) -> str:
        """All text below, with nothing between blocks."""
        if self.tag == "#text":
            return self.data
        parts: list[str] = []
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            if node.tag == "#text":
                parts.append(node.data)
            elif node.children:
                stack += node.children[::-1]
        return "".join(parts)

    def classes(self) -> list[str]:
        return self.get("class").split()

    def clone(self) -> Node:
        copy = Node(self.tag, dict(self.attrs), self.data)
        pairs = [(self, copy)]
        while pairs:
            old, new = pairs.pop()
            for child in old.children:
                twin = Node(child.tag, dict(child.attrs), child.data)
                twin.parent = new
                new.children.append(twin)
                if child.children:
                    pairs.append((child, twin))
        return copy

    def inner_html(self) -> str:
        return "".join(map(serialize, self.children))


def text_node(data: str) -> Node:
    return Node("#text", None, data)


def serialize(node: Node) -> str:
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.tag == "#text":
            raw = item.parent is not None and item.parent.tag in RAW and item.parent.tag != "noscript"
            raw = raw or (item.parent is not None and item.parent.tag == "noscript")
            out.append(item.data if raw else _escape(item.data, quote=False).replace("\xa0", "&nbsp;"))
        elif item.tag == "#comment":
            out.append(f"<!--{item.data}-->")
        elif item.tag == "#root":
            stack.extend(item.children[::-1])
        else:
            attrs = "".join(f' {k}="{_quote(v)}"' for k, v in sorted(item.attrs.items()))
            out.append(f"<{item.tag}{attrs}>")
            if item.tag not in VOID:
                stack.append(f"</{item.tag}>")
                stack.extend(item.children[::-1])
    return "".join(out)


def _quote(value: str) -> str:
    return value.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;")


_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?)?""")


def tokens(html: str) -> Iterator[tuple]:
    """("text", data), ("comment", data), ("start", tag, attrs, closed) and ("end", tag)."""
    html = html.replace("\r\n", "\n").replace("\r", "\n")
    at, size = 0, len(html)
    while at < size:
        open_ = html.find("<", at)
        if open_ < 0:
            yield "text", unescape(html[at:])
            return
        if open_ > at:
            yield "text", unescape(html[at:open_])
        if html.startswith("<!--", open_):
            end = html.find("-->", open_ + 4)
            if html[open_ + 4 : open_ + 5] == ">":
                yield "comment", ""
                at = open_ + 5
                continue
            yield "comment", html[open_ + 4 : end if end >= 0 else size]
            at = end + 3 if end >= 0 else size
            continue
        following = html[open_ + 1 : open_ + 2]
        if following in ("!", "?") or (following == "/" and not _TAG.match(html, open_)):
            end = html.find(">", open_)
            end = size if end < 0 else end
            body = html[open_ + 2 : end]
            if following == "/" and open_ + 2 >= size:
                yield "text", "</"
            elif not body[:7].lower() == "doctype" and not (following == "/" and not body):
                yield "comment", body
            at = end + 1
            continue
        found = _TAG.match(html, open_)
        if not found:
            yield "text", "<"
            at = open_ + 1
            continue
        tag, at = found[1].lower(), found.end()
        attrs: dict[str, str] = {}
        while at < size and html[at] != ">":
            m = _ATTR.match(html, at)
            if m.end() == at:
                at += 1
                continue
            at = m.end()
            if m[1] is not None:
                value = next((v for v in (m[2], m[3], m[4]) if v is not None), "")
                attrs.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
        if at >= size:
            return  # a tag that never ends is dropped
        closed, at = html[at - 1] == "/", at + 1
        if html[open_ + 1] == "/":
            yield "end", tag
            continue
        yield "start", tag, attrs, closed
        if tag in RAW or tag in ESCAPABLE:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at) if tag != "plaintext" else None
            stop = end.start() if end else size
            body = html[at:stop]
            if tag == "textarea" and body.startswith("\n"):
                body = body[1:]
            if body:
                yield "text", unescape(body) if tag in ESCAPABLE else body
            at = stop
            if end is None:
                yield "end", tag


class _Builder:
    """Open elements, the list of active formatting elements (None is a marker) and where nodes go."""

    def __init__(self, fragment: bool):
        self.root = Node("#root")
        self.fragment = fragment
        self.open: list[Node] = [self.root]
        self.active: list[Node | None] = []
        self.html = self.head = self.body = None
        self.form = None
        if fragment:
            self.body = self.root

    # -- places ---------------------------------------------------------

    @property
    def top(self) -> Node:
        return self.open[-1]

    def in_scope(self, tag: str, stop: frozenset = _SCOPE) -> bool:
        for node in reversed(self.open):
            if node.tag == tag:
                return True
            if node.tag in stop:
                return False
        return False

    def is_open(self, node: Node) -> bool:
        return any(n is node for n in self.open)

    def put(self, node: Node) -> Node:
        """Append at the current place; in bare table parts, before the table."""
        if self.top.tag in _TABLE_PARTS and self.foster:
            table = next((n for n in reversed(self.open) if n.tag == "table"), None)
            if table is not None and table.parent is not None:
                return table.parent.insert(table.place(), node)
        return self.top.append(node)

    foster = False

    def put_text(self, data: str) -> None:
        parent, before = self.top, None
        if parent.tag in _TABLE_PARTS and data.strip(" \t\n\f"):
            table = next((n for n in reversed(self.open) if n.tag == "table"), None)
            if table is not None and table.parent is not None:
                parent, before = table.parent, table.place()
        last = parent.children[(len(parent.children) if before is None else before) - 1 :][:1] if (before is None or before) else []
        if last and last[0].tag == "#text" and parent.children:
            last[0].data += data
        elif before is None:
            parent.append(text_node(data))
        else:
            parent.insert(before, text_node(data))

    def element(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        table_only = tag in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "style", "script", "template")
        self.foster = not table_only and not (tag == "input" and attrs.get("type", "").lower() == "hidden")
        self.put(node)
        self.foster = False
        if tag not in VOID:
            self.open.append(node)
        return node

    def pop_to(self, tag: str) -> None:
        while len(self.open) > 1:
            if self.open.pop().tag == tag:
                break

    def imply(self, but: str = "") -> None:
        while self.top.tag in _IMPLIED and self.top.tag != but:
            self.open.pop()

    def close_p(self) -> None:
        if self.in_scope("p", _SCOPE | {"button"}):
            self.imply("p")
            self.pop_to("p")

    def clear_to(self, tags: frozenset) -> None:
        while len(self.open) > 1 and self.top.tag not in tags:
            self.open.pop()

    def clear_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    # -- formatting -----------------------------------------------------

    def push_active(self, node: Node) -> None:
        same = []
        for k in range(len(self.active) - 1, -1, -1):
            entry = self.active[k]
            if entry is None:
                break
            if entry.tag == node.tag and entry.attrs == node.attrs:
                same.append(k)
        if len(same) >= 3:
            del self.active[same[-1]]
        self.active.append(node)

    def reopen(self) -> None:
        """Open again the formatting elements that were closed by their surroundings."""
        k = len(self.active)
        while k and self.active[k - 1] is not None and not self.is_open(self.active[k - 1]):
            k -= 1
        for at in range(k, len(self.active)):
            old = self.active[at]
            self.foster = True
            node = self.put(Node(old.tag, dict(old.attrs)))
            self.foster = False
            self.open.append(node)
            self.active[at] = node

    def drop_active(self, node: Node) -> None:
        self.active = [n for n in self.active if n is not node]

    def adopt(self, tag: str) -> None:
        """The end tag of a formatting element, with blocks nested wrongly inside it."""
        if self.top.tag == tag and all(n is not self.top for n in self.active):
            self.open.pop()
            return
        for _ in range(8):
            chosen = None
            for entry in reversed(self.active):
                if entry is None:
                    break
                if entry.tag == tag:
                    chosen = entry
                    break
            if chosen is None:
                self.close_other(tag)
                return
            if not self.is_open(chosen):
                self.drop_active(chosen)
                return
            if not self.in_scope(tag):
                return
            place = next(k for k, n in enumerate(self.open) if n is chosen)
            block_at = next((k for k in range(place + 1, len(self.open)) if self.open[k].tag in _SPECIAL), None)
            if block_at is None:
                del self.open[place:]
                self.drop_active(chosen)
                return
            block, above = self.open[block_at], self.open[place - 1]
            mark = next(k for k, n in enumerate(self.active) if n is chosen)
            last, k, count = block, block_at, 0
            while True:
                k -= 1
                node = self.open[k]
                if node is chosen:
                    break
                count += 1
                listed = any(n is node for n in self.active)
                if count > 3 and listed:
                    position = next(i for i, n in enumerate(self.active) if n is node)
                    if position < mark:
                        mark -= 1
                    self.drop_active(node)
                    listed = False
                if not listed:
                    del self.open[k]
                    block_at -= 1
                    continue
                twin = Node(node.tag, dict(node.attrs))
                position = next(i for i, n in enumerate(self.active) if n is node)
                self.active[position] = self.open[k] = twin
                if last is block:
                    mark = position + 1
                twin.append(last)
                last = twin
            if above.tag in _TABLE_PARTS and above.parent is not None:
                table = next((n for n in reversed(self.open) if n.tag == "table"), above)
                (table.parent or above).insert(table.place(), last) if table.parent else above.append(last)
            else:
                above.append(last)
            twin = Node(chosen.tag, dict(chosen.attrs))
            for child in list(block.children):
                twin.append(child)
            block.append(twin)
            position = next(i for i, n in enumerate(self.active) if n is chosen)
            del self.active[position]
            self.active.insert(mark - (position < mark), twin)
            self.open = [n for n in self.open if n is not chosen]
            self.open.insert(next(i for i, n in enumerate(self.open) if n is block) + 1, twin)

    # -- document frame ---------------------------------------------------

    def need_html(self) -> None:
        if self.html is None:
            self.html = self.root.append(Node("html"))
            self.open = [self.root, self.html]

    def need_head(self) -> None:
        self.need_html()
        if self.head is None:
            self.head = self.html.append(Node("head"))

    def need_body(self) -> None:
        if self.body is None:
            self.need_head()
            self.body = self.html.append(Node("body"))
            self.open = [self.root, self.html, self.body]

    # -- tokens -----------------------------------------------------------

    def text(self, data: str) -> None:
        data = data.replace("\0", "")
        if not data:
            return
        if self.top.tag in RAW or self.top.tag in ESCAPABLE:
            self.put_text(data)
            return
        if self.body is None:
            if not data.strip(" \t\n\f"):
                if self.head is not None and self.html is not None and self.top is self.html:
                    self.put_text(data)
                elif self.head is not None and self.top is self.head:
                    self.put_text(data)
                return
            if self.html is None or self.head is None:
                data = data.lstrip(" \t\n\f")
            self.need_body()
        self.reopen()
        self.put_text(data)

    def comment(self, data: str) -> None:
        (self.top if len(self.open) > 1 or self.fragment else self.root).append(Node("#comment", None, data))

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag == "html":
            if not self.fragment:
                self.need_html()
                for k, v in attrs.items():
                    self.html.attrs.setdefault(k, v)
            return
        if tag == "head":
            if not self.fragment and self.head is None:
                self.need_head()
                self.head.attrs.update(attrs)
                self.open.append(self.head)
            return
        if tag == "body":
            if self.fragment:
                return
            if self.body is None:
                self.need_body()
            for k, v in attrs.items():
                self.body.attrs.setdefault(k, v)
            return
        if self.body is None and tag in _HEAD_ONLY:
            self.need_head()
            if self.top is self.html:  # after the head: it still takes these
                self.open.append(self.head)
                self.element(tag, attrs)
                if tag in VOID:
                    self.open.pop()
                else:
                    self.open = [n for n in self.open if n is not self.head]
                return
            self.element(tag, attrs)
            return
        if tag == "frameset":
            return
        self.need_body()
        self.in_body(tag, attrs, closed)

    def in_body(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in ("caption", "colgroup", "tbody", "tfoot", "thead", "tr", "td", "th", "col"):
            self.table_part(tag, attrs)
            return
        if tag in _HEAD_ONLY:
            self.element(tag, attrs)
            return
        if tag == "option" or tag == "optgroup":
            if self.top.tag == "option":
                self.open.pop()
            if tag == "optgroup" and self.top.tag == "optgroup":
                self.open.pop()
            self.reopen()
            self.element(tag, attrs)
            return
        if tag == "select" and self.in_scope("select"):
            self.pop_to("select")
            return
        if tag in _CLOSES_P:
            if tag == "li":
                self.close_item(("li",))
            elif tag in ("dd", "dt"):
                self.close_item(("dd", "dt"))
            elif tag == "form":
                if self.form is not None and self.is_open(self.form):
                    return
            if tag == "table" and self.in_scope("table", _TABLE_SCOPE) and self.top.tag in _TABLE_PARTS:
                self.pop_to("table")
            self.close_p()
            if tag in _HEADINGS and self.top.tag in _HEADINGS:
                self.open.pop()
            node = self.element(tag, attrs)
            if tag == "form":
                self.form = node
            return
        if tag == "button" and self.in_scope("button"):
            self.imply()
            self.pop_to("button")
        if tag == "a":
            for entry in reversed(self.active):
                if entry is None:
                    break
                if entry.tag == "a":
                    self.adopt("a")
                    self.drop_active(entry)
                    self.open = [n for n in self.open if n is not entry]
                    break
        if tag == "nobr" and self.in_scope("nobr"):
            self.reopen()
            self.adopt("nobr")
        if tag == "image":
            tag = "img"
        if tag in ("rb", "rtc", "rp", "rt") and self.in_scope("ruby"):
            self.imply("rtc" if tag in ("rp", "rt") else "")
        self.reopen()
        node = self.element(tag, attrs)
        if tag in FORMATTING:
            self.push_active(node)
        elif tag in _MARKERS:
            self.active.append(None)
        elif closed and tag not in VOID and self.foreign(node):
            self.open.pop()

    def foreign(self, node: Node) -> bool:
        return node.tag in ("svg", "math") or any(a.tag in ("svg", "math") for a in node.ancestors())

    def close_item(self, tags: tuple[str, ...]) -> None:
        for node in reversed(self.open):
            if node.tag in tags:
                self.imply(node.tag)
                self.pop_to(node.tag)
                return
            if node.tag in _SPECIAL and node.tag not in ("address", "div", "p"):
                return

    def table_part(self, tag: str, attrs: dict[str, str]) -> None:
        if not self.in_scope("table", _TABLE_SCOPE):
            return  # outside a table these tags mean nothing
        if tag in ("td", "th"):
            if self.in_scope("td", _TABLE_SCOPE) or self.in_scope("th", _TABLE_SCOPE):
                self.close_cell()
            self.clear_to(frozenset(["tr", "tbody", "thead", "tfoot", "table", "html", "#root"]))
            if self.top.tag == "table":
                self.element("tbody", {})
            if self.top.tag != "tr":
                self.element("tr", {})
            self.element(tag, attrs)
            self.active.append(None)
            return
        if self.in_scope("td", _TABLE_SCOPE) or self.in_scope("th", _TABLE_SCOPE):
            self.close_cell()
        if tag == "tr":
            self.clear_to(frozenset(["tbody", "thead", "tfoot", "table", "html", "#root"]))
            if self.top.tag == "table":
                self.element("tbody", {})
            self.element("tr", attrs)
            return
        if tag == "col":
            if self.top.tag != "colgroup":
                self.clear_to(frozenset(["table", "html", "#root"]))
                self.element("colgroup", {})
            self.element("col", attrs)
            return
        self.clear_to(frozenset(["table", "html", "#root"]))
        self.element(tag, attrs)
        if tag == "caption":
            self.active.append(None)

    def close_cell(self) -> None:
        self.imply()
        while len(self.open) > 1:
            if self.open.pop().tag in ("td", "th"):
                break
        self.clear_marker()

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            if not self.fragment:
                self.need_body()
            return
        if tag == "head":
            self.need_head() if not self.fragment else None
            self.open = [n for n in self.open if n is not self.head]
            return
        if self.body is None and self.top.tag not in RAW and self.top.tag not in ESCAPABLE:
            if tag not in ("br", "template"):
                if self.is_open_tag(tag):
                    self.pop_to(tag)
                return
            self.need_body()
        if tag in FORMATTING:
            self.adopt(tag)
        elif tag == "p":
            if not self.in_scope("p", _SCOPE | {"button"}):
                self.need_body()
                self.element("p", {})
            self.close_p()
        elif tag == "br":
            self.reopen()
            self.element("br", {})
        elif tag in _HEADINGS:
            if any(self.in_scope(h) for h in _HEADINGS):
                self.imply()
                while len(self.open) > 1 and self.open.pop().tag not in _HEADINGS:
                    pass
        elif tag == "li":
            if self.in_scope("li", _SCOPE | {"ol", "ul"}):
                self.imply("li")
                self.pop_to("li")
        elif tag in ("td", "th"):
            if self.in_scope(tag, _TABLE_SCOPE):
                self.imply()
                self.pop_to(tag)
                self.clear_marker()
        elif tag in ("table", "tbody", "thead", "tfoot", "tr", "caption"):
            if self.in_scope(tag, _TABLE_SCOPE):
                self.pop_to(tag)
                if tag == "caption":
                    self.clear_marker()
                if tag == "table":
                    while self.active and self.active[-1] is not None and not self.is_open(self.active[-1]) and None in self.active:
                        break
        elif tag in _CLOSES_P or tag in ("button", "select", "applet", "marquee", "object", "dd", "dt"):
            if self.in_scope(tag):
                self.imply(tag if tag in ("dd", "dt") else "")
                self.pop_to(tag)
                if tag in _MARKERS:
                    self.clear_marker()
                if tag == "form":
                    self.form = None
        else:
            self.close_other(tag)

    def is_open_tag(self, tag: str) -> bool:
        return any(n.tag == tag for n in self.open)

    def close_other(self, tag: str) -> None:
        for node in reversed(self.open):
            if node.tag == tag:
                self.imply(tag)
                while len(self.open) > 1 and self.open.pop() is not node:
                    pass
                return
            if node.tag in _SPECIAL or node.tag == "#root":
                return


def _build(html: str, fragment: bool) -> Node:
    builder = _Builder(fragment)
    for token in tokens(html):
        kind = token[0]
        if kind == "text":
            builder.text(token[1])
        elif kind == "start":
            builder.start(token[1], token[2], token[3])
        elif kind == "end":
            builder.end(token[1])
        else:
            builder.comment(token[1])
    if not fragment:
        builder.need_body()
    return builder.root


def parse_document(html: str) -> Node:
    """The tree of a page: a root with an html element that has a head and a body."""
    return _build(html, fragment=False)


def parse_fragment(html: str) -> Node:
    """The tree of a piece of a page: a root with the piece's nodes."""
    return _build(html, fragment=True)
