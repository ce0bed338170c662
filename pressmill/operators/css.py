"""CSS selectors over the tree: parsed once, matched from the right-hand compound to the left."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator

from .html_tree import Node

Test = Callable[[Node], bool]
_IDENT = r"-?(?:[_a-zA-Z\u0080-\U0010ffff]|\\.)(?:[-\w\u0080-\U0010ffff]|\\.)*"
_NAME = re.compile(_IDENT)
_HASH = re.compile(r"(?:[-\w\u0080-\U0010ffff]|\\.)+")
_ATTRIBUTE = re.compile(
    rf"\[\s*((?:{_IDENT})(?:(?:\||\\:|:)(?:{_IDENT}))?)\s*(?:([~|^$*]?=)\s*(\"[^\"]*\"|'[^']*'|[^\]\s\"']+)\s*([iIsS])?\s*)?\]"
)
_NTH = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$", re.I)


class Invalid(ValueError):
    """The text is no selector."""


class Selector:
    """A list of complex selectors; a complex one is [(combinator, compound tests), ...] from left to right.

    A node is only tried against those whose last compound names its tag or no
    tag, and, if it has no attributes, against those that need none.
    """

    def __init__(self, chains: list[list[tuple[str, list[Test]]]]):
        self.chains = chains
        tags = [next((t.tag for t in chain[-1][1] if isinstance(t, _Tag)), None) for chain in chains]
        self.loose = [c for c, tag in zip(chains, tags) if tag is None]
        self.bare = [c for c in self.loose if not any(isinstance(t, _OnAttribute) for t in c[-1][1])]
        self.tagged = {tag: [c for c, own in zip(chains, tags) if own in (tag, None)] for tag in tags if tag}
        #: The tags, where the selector asks for nothing else.
        self.tags = frozenset(tags) if all(len(c) == 1 and len(c[0][1]) == 1 and tag for c, tag in zip(chains, tags)) else None
        #: What must be somewhere in the tree for each chain to match.
        self.needs = [frozenset(t.need for _, tests in chain for t in tests if getattr(t, "need", None)) for chain in chains]

    def tried(self, node: Node) -> list:
        return self.tagged.get(node.tag) or (self.loose if node.attrs else self.bare)

    def matches(self, node: Node, scope: Node | None = None) -> bool:
        return node.is_element and any(_chain(node, chain, len(chain) - 1, scope) for chain in self.tried(node))

    def select(self, nodes: Iterable[Node]) -> Iterator[Node]:
        """Those of the elements that match, in their order; what lies above them counts too."""
        if self.tags is not None:
            tags = self.tags
            yield from (node for node in nodes if node.tag in tags)
            return
        tagged, loose, bare = self.tagged, self.loose, self.bare
        for node in nodes:
            for chain in (tagged.get(node.tag) if tagged else None) or (loose if node.attrs else bare):
                if _chain(node, chain, len(chain) - 1, None):
                    yield node
                    break


class _Tag:
    def __init__(self, tag: str):
        self.tag, self.need = tag, ("tag", tag)

    def __call__(self, node: Node) -> bool:
        return node.tag == self.tag


class _OnAttribute:
    """A test that no element without attributes passes; ``need`` is a class or id that it asks for."""

    def __init__(self, test: Test, need: tuple[str, str] | None = None):
        self.test, self.need = test, need

    def __call__(self, node: Node) -> bool:
        return self.test(node)


def _chain(node: Node, chain: list, at: int, scope: Node | None) -> bool:
    combinator, tests = chain[at]
    for test in tests:
        if not test(node):
            return False
    if at == 0:
        if scope is None:
            return True
        return {" ": _below, ">": lambda n, s: n.parent is s, "+": _next_to, "~": _after}[combinator](node, scope)
    if combinator == ">":
        up = node.parent
        return up is not None and up.is_element and _chain(up, chain, at - 1, scope)
    if combinator == " ":
        return any(_chain(up, chain, at - 1, scope) for up in node.ancestors())
    before = node.previous_elements()
    return any(_chain(s, chain, at - 1, scope) for s in (before[:1] if combinator == "+" else before))


def _below(node: Node, scope: Node) -> bool:
    return any(up is scope for up in node.ancestors())


def _next_to(node: Node, scope: Node) -> bool:
    return any(s is scope for s in node.previous_elements()[:1])


def _after(node: Node, scope: Node) -> bool:
    return any(s is scope for s in node.previous_elements())


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def space(self) -> bool:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] in " \t\r\n\f":
            self.at += 1
        return self.at > start

    def take(self, pattern: re.Pattern) -> re.Match:
        found = pattern.match(self.text, self.at)
        if not found:
            raise Invalid(self.text)
        self.at = found.end()
        return found

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def list(self, relative: bool = False) -> Selector:
        chains = [self.complex(relative)]
        while self.peek() == ",":
            self.at += 1
            chains.append(self.complex(relative))
        if self.at < len(self.text):
            raise Invalid(self.text)
        return Selector(chains)

    def complex(self, relative: bool) -> list:
        self.space()
        combinator = " "
        if relative and self.peek() and self.peek() in ">+~":
            combinator = self.peek()
            self.at += 1
            self.space()
        chain = [(combinator, self.compound())]
        while True:
            gap = self.space()
            c = self.peek()
            if c and c in ">+~":
                self.at += 1
                self.space()
                chain.append((c, self.compound()))
            elif gap and c and c != ",":
                chain.append((" ", self.compound()))
            else:
                return chain

    def compound(self) -> list[Test]:
        tests: list[Test] = []
        if self.peek() == "*":
            self.at += 1
            tests.append(lambda n: True)
        elif _NAME.match(self.text, self.at):
            tests.append(_Tag(_plain(self.take(_NAME)[0]).lower()))
        while c := self.peek():
            if c == ".":
                self.at += 1
                name = _plain(self.take(_NAME)[0])
                tests.append(_OnAttribute(lambda n, name=name: name in n.classes(), ("class", name)))
            elif c == "#":
                self.at += 1
                name = _plain(self.take(_HASH)[0])
                tests.append(_OnAttribute(lambda n, name=name: n.attrs.get("id") == name, ("id", name)))
            elif c == "[":
                tests.append(_OnAttribute(_attribute(self.take(_ATTRIBUTE))))
            elif c == ":":
                tests.append(self.pseudo())
            else:
                break
        if not tests:
            raise Invalid(self.text)
        return tests

    def pseudo(self) -> Test:
        self.at += 1
        name = self.take(_NAME)[0].lower()
        argument = None
        if self.peek() == "(":
            depth, start = 0, self.at + 1
            while self.at < len(self.text):
                depth += {"(": 1, ")": -1}.get(self.text[self.at], 0)
                self.at += 1
                if depth == 0:
                    break
            if depth:
                raise Invalid(self.text)
            argument = self.text[start : self.at - 1]
        return _pseudo(name, argument)


def _attribute(m: re.Match) -> Test:
    name = _plain(m[1]).lower().replace("|", ":")
    if m[2] is None:
        return lambda n: name in n.attrs
    value = m[3][1:-1] if m[3][0] in "\"'" else _plain(m[3])
    fold = (m[4] or "").lower() == "i"
    value = value.lower() if fold else value
    read = (lambda n: n.attrs.get(name, "").lower()) if fold else (lambda n: n.attrs.get(name, ""))
    operator = m[2][0]
    if operator == "=":
        return lambda n: name in n.attrs and read(n) == value
    if operator == "~":
        return lambda n: bool(value) and value in read(n).split()
    if operator == "|":
        return lambda n: name in n.attrs and (read(n) == value or read(n).startswith(value + "-"))
    if not value:
        return lambda n: False
    if operator == "^":
        return lambda n: read(n).startswith(value)
    if operator == "$":
        return lambda n: read(n).endswith(value)
    return lambda n: value in read(n)


def _peers(node: Node, same: bool) -> list[Node]:
    siblings = node.parent.child_elements() if node.parent is not None else [node]
    return [s for s in siblings if s.tag == node.tag] if same else siblings


def _pseudo(name: str, argument: str | None) -> Test:
    if name in ("not", "is", "where", "matches", "has") and argument is not None:
        inner = _Reader(argument).list(relative=name == "has")
        if name == "not":
            return lambda n: not inner.matches(n)
        if name == "has":
            def has(n: Node) -> bool:
                reach = any(chain[0][0] in "+~" for chain in inner.chains)
                pool = n.parent.elements() if reach and n.parent is not None else n.elements()
                return any(inner.matches(x, scope=n) for x in pool)

            return has
        return inner.matches
    if argument is None:
        same = name.endswith("of-type")
        if name in ("first-child", "first-of-type"):
            return lambda n: _peers(n, same)[0] is n
        if name in ("last-child", "last-of-type"):
            return lambda n: _peers(n, same)[-1] is n
        if name in ("only-child", "only-of-type"):
            return lambda n: len(_peers(n, same)) == 1
        if name == "empty":
            return lambda n: not any(c.is_element or c.data for c in n.children if c.tag != "#comment")
        if name == "root":
            return lambda n: n.parent is not None and n.parent.tag == "#root"
    elif name.startswith("nth-"):
        found = _NTH.match(argument)
        if found:
            if found[1]:
                step, first = 2, int(found[1].lower() == "odd")
            elif found[5]:
                step, first = 0, int(found[5])
            else:
                step = int(found[2] + "1") if found[2] in ("", "+", "-") else int(found[2])
                first = int((found[3] or "+") + (found[4] or "0"))
            same, backward = name.endswith("of-type"), "last" in name

            def nth(n: Node) -> bool:
                peers = _peers(n, same)
                k = next(i for i, s in enumerate(reversed(peers) if backward else peers) if s is n) + 1 - first
                return k == 0 if step == 0 else k % step == 0 and k // step >= 0

            return nth
    raise Invalid(name)


@functools.lru_cache(4096)
def compile_selector(text: str) -> Selector | None:
    """The parsed selector; None if the text is none, which then matches nothing."""
    try:
        return _Reader(text.strip()).list()
    except Invalid:
        return None


def select(root: Node, selector: str) -> list[Node]:
    """Matching elements below ``root`` in document order."""
    found = compile_selector(selector)
    return list(found.select(root.elements())) if found else []


def first(root: Node, selector: str) -> Node | None:
    found = compile_selector(selector)
    return next(found.select(root.elements()), None) if found else None


class View:
    """Selections below a root that does not change meanwhile: its elements are listed once, with their tags, classes and ids.

    A selector that asks for what the page has nowhere is not tried on any element.
    """

    def __init__(self, root: Node):
        self.root, self.nodes = root, root.element_list()
        self.by_tag: dict[str, list[Node]] = {}
        self.held: set[tuple[str, str]] = set()
        for node in self.nodes:
            self.by_tag.setdefault(node.tag, []).append(node)
            if node.attrs:
                self.held.update(("class", name) for name in node.classes())
                if "id" in node.attrs:
                    self.held.add(("id", node.attrs["id"]))
        self.held.update(("tag", tag) for tag in self.by_tag)

    def found(self, selector: str) -> Iterator[Node]:
        compiled = compile_selector(selector)
        if compiled is None or not any(need <= self.held for need in compiled.needs):
            return iter(())
        if len(compiled.tagged) == 1 and not compiled.loose:
            return compiled.select(self.by_tag[next(iter(compiled.tagged))])
        return compiled.select(self.nodes)

    def select(self, selector: str) -> list[Node]:
        return list(self.found(selector))

    def first(self, selector: str) -> Node | None:
        return next(self.found(selector), None)


def matches(node: Node, selector: str) -> bool:
    found = compile_selector(selector)
    return bool(found) and found.matches(node)
