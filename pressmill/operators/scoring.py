"""Scores of nodes and the choice of the article among them.

Scores live in each element's ``score`` attribute while a page is judged. An
element without one, or with zero, counts as not yet scored: reading it works
its score out and passes a quarter of it up, so the order of visits matters.
"""

from __future__ import annotations

import re

from ..functions import scalar as S
from . import css
from .cleaning import hint, link_density, strip_unlikely, to_paragraphs
from .html_tree import Node

# Hints in class and id, and sets of tags.
POSITIVE = (
    "article|articlecontent|instapaper_body|blog|body|content|entry-content-asset|entry|hentry|main|Normal|page|pagination|permalink"
    "|post|story|text|[-_]copy|\\Bcopy"
)
NEGATIVE = (
    "adbox|advert|author|bio|bookmark|bottom|byline|clear|com-|combx|comment|comment\\B|contact|copy|credit|crumb|date|deck|excerpt"
    "|featured|foot|footer|footnote|graf|head|info|infotext|instapaper_ignore|jump|linebreak|link|masthead|media|meta|modal|outbrain"
    "|promo|pr_|related|respond|roundcontent|scroll|secondary|share|shopping|shoutbox|side|sidebar|sponsor|stamp|sub|summary|tags"
    "|tools|widget"
)
POSITIVE_HINT, NEGATIVE_HINT = re.compile(POSITIVE), re.compile(NEGATIVE)
PHOTO_HINT = re.compile("(?i)figure|photo|image|caption")
ASSET_HINT = re.compile("(?i)entry-content-asset")
NEVER_TOP = frozenset("br b i label hr area base basefont input img link meta".split())
TAG_SCORES = {"div": 5.0, "td": 3.0, "blockquote": 3.0, "ol": 3.0, "ul": 3.0, "dl": 3.0, "address": -3.0, "form": -3.0, "th": -5.0}
TEXT_TAGS = frozenset(["p", "li", "span", "pre"])
HNEWS = [
    (".hentry", ".entry-content"),
    ("entry", ".entry-content"),
    (".entry", ".entry_content"),
    (".post", ".postbody"),
    (".post", ".post_body"),
    (".post", ".post-body"),
]


def hint_weight(text: str) -> float:
    return 25.0 * bool(POSITIVE_HINT.search(text)) - 25.0 * bool(NEGATIVE_HINT.search(text))


def weight(node: Node) -> float:
    """From the id and, where that says nothing, the class; photos and assets add to it."""
    names = node.get("class")
    total = hint_weight(node.get("id")) or hint_weight(names)
    return total + 10.0 * bool(PHOTO_HINT.search(names)) + 25.0 * bool(ASSET_HINT.search(names))


def length_bonus(size: int, tag: str) -> float:
    return min(max(size / 50 - (2.0 if tag in ("p", "pre") else 1.25), 0.0), 3.0) if size else 0.0


def paragraph_score(text: str) -> float:
    """A point, one for each comma and up to three for length; texts under 25 bytes have none."""
    text = S.trim(text)
    size = S.nbytes(text)
    return 0.0 if size < 25 else 1.0 + text.count(",") + length_bonus(size, "p") - float(text.endswith(":"))


def own_score(node: Node) -> float:
    return paragraph_score(node.text()) if node.tag in TEXT_TAGS else TAG_SCORES.get(node.tag, 0.0)


def stored(node: Node) -> float | None:
    try:
        return float(node.attrs["score"]) or None
    except (KeyError, ValueError):
        return None


def store(node: Node, score: float) -> None:
    node.attrs["score"] = repr(score)


def parent_element(node: Node) -> Node | None:
    return node.parent if node.parent is not None and node.parent.is_element else None


def settled_score(node: Node, weigh: bool = True) -> float:
    """The stored score, or the one it starts with; starting, every element above gets its share."""
    found = stored(node)
    if found is not None:
        return found
    chain = []  # the elements above that start too, as each passes a quarter on
    up, score = node, 0.0
    while up is not None and stored(up) is None:
        chain.append((up, own_score(up) + (weight(up) if weigh or up is not node else 0.0)))
        up = parent_element(up)
    shares = [start for _, start in chain]
    if up is not None:
        store(up, stored(up) + shares[-1] * 0.25)
    for (above, start), share in zip(reversed(chain[1:]), reversed(shares[:-1])):
        store(above, start + share * 0.25)
    score = shares[0]
    return score


def add(node: Node, amount: float) -> None:
    if node.tag == "span":
        node.tag = "div"
    store(node, settled_score(node) + amount)


def score_page(root: Node, weigh: bool) -> None:
    view = css.View(root)  # scoring moves no node, and renames none that is selected here
    for parent_selector, child_selector in HNEWS:
        for node in view.select(f"{parent_selector} {child_selector}"):
            up = parent_element(node)
            if up is not None and css.matches(up, parent_selector):
                store(up, settled_score(up) + 80.0)
    paragraphs = view.select("p, pre")
    for _ in range(2):
        for node in paragraphs:
            if "score" in node.attrs:
                continue
            store(node, settled_score(node, weigh))
            raw, up = own_score(node), parent_element(node)
            if up is not None:
                add(up, raw)
                above = parent_element(up)
                if above is not None:
                    add(above, raw / 2)


def top_candidate(root: Node) -> tuple[Node | None, float]:
    """The first element of the highest positive score; else the body, else any element."""
    best, top = None, 0.0
    for node in root.elements():
        if "score" in node.attrs and node.tag not in NEVER_TOP and (score := stored(node) or 0.0) > top:
            best, top = node, score
    if best is None:
        best = css.first(root, "body") or next(root.elements(), None)
    return best, top


def with_siblings(best: Node, top: float) -> list[Node] | None:
    """The candidate's siblings that belong to the article, itself included; None for itself alone."""
    if best.parent is None:
        return None
    chosen = []
    for node in best.parent.child_elements():
        score = stored(node)
        if node.tag in NEVER_TOP or score is None:
            continue
        if node is best:
            chosen.append(node)
            continue
        density = link_density(node)
        bonus = 20.0 * (density < 0.05) - 20.0 * (density >= 0.5)
        bonus += top * 0.2 * (node.attrs.get("class") == best.attrs.get("class"))
        belongs = score + bonus >= max(10.0, top * 0.25)
        if not belongs and node.tag == "p":
            size = S.text_bytes(node.text())
            belongs = density < 0.25 if size > 80 else density == 0 and S.has_sentence_end(node.text())
        if belongs:
            chosen.append(node)
    return None if len(chosen) == 1 and chosen[0] is best else chosen


def choose_article(root: Node, strip: bool, weigh: bool, whole: bool = False) -> tuple[Node, Node] | None:
    """(root, article) of a new tree with copies of the chosen nodes; ``root`` of the page is used up.

    Where nothing has a score the article is empty, or with ``whole`` all of the body.
    """
    if strip:
        strip_unlikely(root)
    to_paragraphs(root)
    score_page(root, weigh)
    best, top = top_candidate(root)
    if best is None:
        return None
    together = with_siblings(best, top)
    if together is None or whole and not together:
        article = best.clone()
    else:
        article = Node("div")
        for node in together:
            article.append(node.clone())
    new = Node("#root")
    new.append(article)
    return new, article


__all__ = ["choose_article", "hint", "score_page", "settled_score", "top_candidate", "weight", "with_siblings"]
