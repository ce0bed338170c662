"""Site rules: which one holds for a page, and the fields it selects."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from ..functions import scalar as S
from . import css, transforms
from . import metadata as M
from .cleaning import absolute_links, clean_article, strip_tags
from .html_tree import Node, serialize

Rule = dict[str, Any]
#: Where the built-in rules are; any file of this form can stand in for it.
BUILT_IN = Path(__file__).with_name("site_rules.json")


def load_rules(path: str | Path = BUILT_IN) -> list[Rule]:
    """Rules of a JSON file ``{"rules": [...]}``, in order."""
    return json.loads(Path(path).read_text(encoding="utf-8"))["rules"]


@functools.lru_cache(1)
def built_in_rules() -> tuple[Rule, ...]:
    return tuple(load_rules())


#: Parts of a rule, and what those with parts of their own may hold.
_FIELDS = frozenset("domain aliases title author date_published lead_image_url dek next_page_url excerpt content extend".split())
_PARTS = frozenset("selectors clean transforms default_cleaner timezone format value allow_multiple".split())


def check_rule(rule: Rule) -> Rule:
    """The rule itself, if every part of it is one that the engine reads; else ValueError."""
    if not rule.get("domain"):
        raise ValueError("Unable to add custom extractor. Invalid parameters.")
    name = rule["domain"]
    if unknown := rule.keys() - _FIELDS:
        raise ValueError(f"rule {name}: no such fields: {', '.join(sorted(unknown))}")
    extras = {f"extend.{k}": v for k, v in rule.get("extend", {}).items()}
    for field_name, spec in [*rule.items(), *extras.items()]:
        if field_name in ("domain", "aliases", "extend"):
            continue
        if isinstance(spec, dict) and (not spec or spec.keys() - _PARTS):
            raise ValueError(f"rule {name}: {field_name} holds what is not read")
        if not isinstance(spec, dict) and not isinstance(spec, (list, tuple)):
            raise ValueError(f"rule {name}: {field_name} is neither a list of selectors nor an object")
        for selector in spec if not isinstance(spec, dict) else spec.get("selectors", ()):
            known = isinstance(selector, str) or (isinstance(selector, dict) and ({"select", "attr"} <= selector.keys() or "all" in selector))
            if not known:
                raise ValueError(f"rule {name}: {field_name} has a selector of no known form")
        for change in spec.get("transforms", ()) if isinstance(spec, dict) else ():
            kind = change[1]
            if "tag" not in kind and kind.get("named") not in transforms.NAMED:
                raise ValueError(f"rule {name}: no such change: {kind}")
    return rule


@dataclass
class RuleBook:
    """Rules given by the caller, which come first, and the built-in ones; the first of a key wins."""

    given: tuple[Rule, ...] = ()
    built_in: tuple[Rule, ...] = field(default_factory=built_in_rules)

    def __post_init__(self):
        self.keys = [self._index(map(check_rule, self.given)), self._index(self.built_in)]

    @staticmethod
    def _index(rules: Iterable[Rule]) -> dict[str, Rule]:
        found: dict[str, Rule] = {}
        for rule in rules:
            for key in [rule["domain"], *rule.get("aliases", ())]:
                found.setdefault(key, rule)
        return found

    def find(self, host: str | None) -> Rule | None:
        """By the host, then by its last two labels, in the caller's rules and then in the built-in ones."""
        if not host:
            return None
        for keys in self.keys:
            if rule := keys.get(host) or keys.get(S.base_domain(host)):
                return rule
        return None

    def has(self, host: str | None) -> bool:
        """Whether a rule holds for the host."""
        return self.find(host) is not None

    def detect(self, view: css.View) -> Rule | None:
        """By marks that publishing systems leave in meta tags."""
        # The marks and the rules they stand for.
        marks = [
            ('meta[name="al:ios:app_name"][value="Medium"]', "medium.com"),
            ('meta[name="generator"][value="blogger"]', "blogspot.com"),
            ('meta[name="generator"][value^="WordPress"]', "wordpress.org"),
        ]
        return next((self.find(domain) for selector, domain in marks if view.first(selector) is not None), None)


# -- selectors ----------------------------------------------------------------


def usable(view: css.View, selectors: list, content: bool, several: bool):
    """The first selector with a value: one match (or any number, if ``several``) that is not blank."""
    for selector in selectors:
        if isinstance(selector, dict) and "all" in selector:
            if content and all(view.first(s) is not None for s in selector["all"]):
                return selector
            continue
        path, attr = (selector["select"], selector["attr"]) if isinstance(selector, dict) else (selector, None)
        found = view.select(path)
        if not found or (len(found) != 1 and not several):
            continue
        if attr is None:
            value = found[0].text()
        else:
            value = next((n.attrs[attr] for n in found[:1] if attr in n.attrs), "")
        if S.trim(value):
            return selector
    return None


def values(view: css.View, selector, bare: bool = True) -> list[str]:
    """Attributes, or texts, without the white space at their ends if ``bare``."""
    if isinstance(selector, dict):
        return [S.trim(n.attrs[selector["attr"]]) for n in view.select(selector["select"]) if selector["attr"] in n.attrs]
    return [S.trim(n.text()) if bare else n.text() for n in view.select(selector)]


def select_value(page: M.Page, rule: Rule, name: str, excerpt: str | None = None) -> str | None:
    """A field by the rule; None where it has nothing usable."""
    spec = rule.get(name)
    if spec is None:
        return None
    if isinstance(spec, dict) and "value" in spec:
        return spec["value"] or None
    selectors = spec["selectors"] if isinstance(spec, dict) else spec
    several = name == "lead_image_url"
    chosen = usable(page.view, selectors, False, several)
    if chosen is None or (isinstance(chosen, dict) and "all" in chosen):
        return None
    found = values(page.view, chosen, bare=name != "title")  # a title is split as it stands, as without a rule: its last splitter may end it
    cleaned = [clean_value(page, name, v, spec, excerpt) or "" for v in (found if several else found[:1])]
    if not any(cleaned):
        return None
    return cleaned[0] or None


def clean_value(page: M.Page, name: str, value: str, spec, excerpt: str | None) -> str | None:
    match name:
        case "title":
            return M.clean_title(page, value)
        case "author":
            return S.clean_author(value)
        case "date_published":
            return page.date(value, spec.get("timezone"), spec.get("format"))
        case "dek":
            return S.clean_dek(value, excerpt, strip_tags)
        case "lead_image_url":
            return S.clean_lead_image_url(value)
    return value


def select_content(page: M.Page, rule: Rule, title: str) -> str | None:
    """The chosen elements in a div, with links made absolute, the rule's changes and the clean-up."""
    spec = rule.get("content")
    if spec is None:
        return None
    chosen = usable(page.view, spec["selectors"], True, False)
    if chosen is None or (isinstance(chosen, dict) and "attr" in chosen):
        return None
    nodes = [n for s in chosen["all"] for n in page.view.select(s)] if isinstance(chosen, dict) else page.view.select(chosen)[:1]
    tree, article = Node("#root"), Node("div")
    tree.append(article)
    for node in nodes:
        article.append(node.clone())
    absolute_links(tree, page.url, page.base())
    for selector in spec.get("clean", ()):
        for node in css.select(tree, selector):
            node.detach()
    for selector, change in spec.get("transforms", ()):
        for node in css.select(tree, selector):
            tag = change["tag"] if "tag" in change else transforms.apply(change["named"], node, tree, page.root)
            if tag:
                node.tag = tag
    clean_article(tree, article, title, page.url, spec.get("default_cleaner", True), page.base())
    return serialize(tree) or None


def select_extended(page: M.Page, extend: dict[str, Any]) -> dict[str, Any]:
    """Extra fields: a string, a list where several are allowed, or None."""
    found: dict[str, Any] = {}
    for name, spec in extend.items():
        several = bool(spec.get("allow_multiple"))
        chosen = usable(page.view, list(spec["selectors"]), False, several)
        got = values(page.view, chosen) if chosen is not None else []
        found[name] = None if chosen is None else got if several else (got[0] if got else "")
    return found
