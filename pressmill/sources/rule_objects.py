"""Site rules out of JavaScript objects: the form in which many parsers' rules are written, to the engine's own JSON.

    python -m pressmill.sources.rule_objects rules.json FOLDER_OR_FILE...

Only literals are read. A function that changes an element becomes a named change, ``<domain>::<selector>``, which
``operators.transforms`` may know; a function that changes a value is left out.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import Any

_TOKEN = re.compile(
    r"""(?P<gap>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`)"""
    r"""|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\.\.\.|[^\s\w])""",
    re.S,
)
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_PAIRS = {"{": "}", "[": "]", "(": ")"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}


class Code:
    """Stands for what is no literal."""


CODE = Code()


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) without gaps; a slash where a value may begin opens a pattern."""
    found: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        begins = not found or (found[-1][0] == "mark" and found[-1][1] not in ")]}") or found[-1][1] in ("return", "typeof", "case")
        if text[at] == "/" and begins and not text.startswith(("//", "/*"), at) and (m := _PATTERN.match(text, at)):
            found.append(("pattern", m[0]))
        elif m := _TOKEN.match(text, at):
            if m.lastgroup != "gap":
                found.append((m.lastgroup, m[0]))
        else:
            raise ValueError(f"no token at {at}: {text[at : at + 20]!r}")
        at = m.end()
    return found


def unquoted(literal: str) -> str:
    known = lambda m: _ESCAPES.get(m[1], m[1]) if m[1] not in "ux" else m[0]
    body = re.sub(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1] or m[2], 16)), literal[1:-1])
    return re.sub(r"\\(.)", known, body, flags=re.S)


class Reader:
    """Reads values from tokens, one after the other."""

    def __init__(self, found: list[tuple[str, str]]):
        self.found, self.at = found, 0

    def peek(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.found[k][1] if k < len(self.found) else ""

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.found) or (wanted is not None and self.peek() != wanted):
            raise ValueError(f"expected {wanted or 'a value'} and found {self.peek() or 'the end'}")
        self.at += 1
        return self.found[self.at - 1]

    def skip_pair(self) -> None:
        """Past the bracket that closes the one here."""
        closing = [_PAIRS[self.take()[1]]]
        while closing:
            kind, text = self.take()
            if kind == "mark" and text in _PAIRS:
                closing.append(_PAIRS[text])
            elif kind == "mark" and text == closing[-1]:
                closing.pop()

    def skip_rest(self) -> Code:
        """Past an expression, to the comma or bracket that ends it."""
        while self.at < len(self.found) and self.peek() not in (",", "}", "]", ")", ";"):
            kind, text = self.found[self.at]
            if kind == "mark" and text in _PAIRS:
                self.skip_pair()
            else:
                self.at += 1
        return CODE

    def value(self) -> Any:
        kind, text = self.found[self.at] if self.at < len(self.found) else ("", "")
        literal: Any = CODE
        if text == "{" and kind == "mark":
            literal = self.object()
        elif text == "[" and kind == "mark":
            literal = self.array()
        elif kind == "string":
            literal = unquoted(self.take()[1])
            while self.peek() == "+" and self.found[self.at + 1][0] == "string":
                self.at += 1
                literal += unquoted(self.take()[1])
        elif text in ("true", "false", "null", "undefined"):
            literal = {"true": True, "false": False}.get(self.take()[1])
        return literal if self.peek() in (",", "}", "]", ")", ";", "") else self.skip_rest()

    def array(self) -> list:
        self.take("[")
        out = []
        while self.peek() != "]":
            out.append(self.value())
            if self.peek() != "]":
                self.take(",")
        self.take("]")
        return out

    def object(self) -> dict[str, Any]:
        self.take("{")
        out: dict[str, Any] = {}
        while self.peek() != "}":
            if self.peek() == "...":
                self.skip_rest()
            else:
                while self.peek() in ("async", "get", "set", "*") and self.peek(1) not in (":", "(", ",", "}"):
                    self.at += 1
                kind, key = self.take()
                key = unquoted(key) if kind == "string" else key
                if self.peek() == ":":
                    self.take(":")
                    out[key] = self.value()
                elif self.peek() in ("(", ",", "}"):  # a method, or a name that stands for itself
                    out[key] = self.skip_rest()
                else:
                    self.take(":")
            if self.peek() != "}":
                self.take(",")
        self.take("}")
        return out


def objects(text: str) -> Iterator[dict[str, Any]]:
    """The objects given to names or exported."""
    reader = Reader(tokens(text))
    while reader.at < len(reader.found):
        before, here = reader.found[reader.at - 1][1] if reader.at else "", reader.peek()
        if here == "{" and before in ("=", "default"):
            yield reader.object()
        elif reader.found[reader.at][0] == "mark" and here in _PAIRS:
            reader.skip_pair()
        else:
            reader.at += 1


def selector(given: Any, content: bool) -> Any:
    if not isinstance(given, list):
        return given
    if content:
        return {"all": given}
    return {"select": given[0], "attr": given[1]} if len(given) > 1 else given[0]


def literal(given: Any) -> bool:
    return not isinstance(given, Code) and not (isinstance(given, list) and any(isinstance(x, Code) for x in given[:2]))


def field_of(spec: Any, domain: str, content: bool = False) -> Any:
    """A field's selectors, with what else it says."""
    if isinstance(spec, str):
        return {"value": spec}
    if isinstance(spec, list):
        spec = {"selectors": spec}
    if not isinstance(spec, dict):
        return None
    out: dict[str, Any] = {"selectors": [selector(x, content) for x in spec.get("selectors", ()) if literal(x)]}
    for theirs, ours in (("timezone", "timezone"), ("format", "format"), ("clean", "clean"), ("defaultCleaner", "default_cleaner"), ("allowMultiple", "allow_multiple")):
        if theirs in spec and literal(spec[theirs]):
            out[ours] = spec[theirs]
    if isinstance(spec.get("transforms"), dict):
        out["transforms"] = [[s, {"tag": change} if isinstance(change, str) else {"named": f"{domain}::{s}"}] for s, change in spec["transforms"].items()]
    plain = out.keys() == {"selectors"} and not content
    return out["selectors"] if plain else out


def rule_of(given: dict[str, Any]) -> dict[str, Any]:
    """The engine's rule; fields that say nothing are left out."""
    domain = given["domain"]
    rule: dict[str, Any] = {"domain": domain}
    if given.get("supportedDomains"):
        rule["aliases"] = [d for d in given["supportedDomains"] if isinstance(d, str)]
    for name in ("title", "author", "date_published", "lead_image_url", "dek", "next_page_url", "excerpt", "content"):
        made = field_of(given.get(name), domain, name == "content")
        if made and (not isinstance(made, dict) or made.get("selectors") or made.get("value")):
            rule[name] = {"selectors": made} if name == "date_published" and isinstance(made, list) else made
    if isinstance(given.get("extend"), dict):
        rule["extend"] = {k: made if isinstance(made, dict) else {"selectors": made} for k, v in given["extend"].items() if (made := field_of(v, domain))}
    return rule


def rules_of(text: str) -> list[dict[str, Any]]:
    """The rules of a script: every named or exported object with a domain."""
    return [rule_of(o) for o in objects(text) if isinstance(o.get("domain"), str)]


def write_rules(out: str | Path, scripts: Iterable[str | Path]) -> int:
    """Write the rules of scripts, and of those in folders, in order of their paths; the number of rules."""
    paths = [p for s in map(Path, scripts) for p in (sorted(s.rglob("*.js")) if s.is_dir() else [s])]
    rules = [rule for p in paths for rule in rules_of(p.read_text(encoding="utf-8"))]
    Path(out).write_text(json.dumps({"rules": rules}, ensure_ascii=False, indent=1), encoding="utf-8")
    return len(rules)


if __name__ == "__main__":
    print(write_rules(sys.argv[1], sys.argv[2:]))
