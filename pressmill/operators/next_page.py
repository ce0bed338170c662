"""The link to an article's next page: links of the same host, scored by text, place and likeness."""

from __future__ import annotations

import re

from ..functions import scalar as S
from .cleaning import hint
from .html_tree import Node
from .metadata import Page
from .scoring import NEGATIVE_HINT, POSITIVE_HINT

# Hints in link texts and addresses.
EXTRANEOUS = re.compile("(?i)print|archive|comment|discuss|e-mail|email|share|reply|all|login|sign|single|adx|entry-unrelated")
NEXT = re.compile(f"(?i)(next|weiter|continue|>([^|]|\\Z)|{chr(0xBB)}([^|]|\\Z))")
CAP = re.compile("(?i)(first|last|end)")
PREVIOUS = re.compile(f"(?i)(prev|earl|old|new|<|{chr(0xAB)})")
PAGING = re.compile("(?i)pag(e|ing|inat)")


def is_wordpress(page: Page) -> bool:
    return any(n.get("value").startswith("WordPress") for n in page.view.select('meta[name="generator"]'))


def is_candidate(href: str, text: str, here: str, base: str, page: Page) -> bool:
    if not href or href in (here, base) or href in page.visited:
        return False
    if S.host_of(href) != S.host_of(page.url) or not re.search("[0-9]", href.replace(base, "")):
        return False
    return S.nbytes(text) <= 25 and not EXTRANEOUS.search(text)


def parent_score(link: Node) -> float:
    """Of the five nearest elements above: one with paging in its names, one with names of extras."""
    names = [hint(up) for _, up in zip(range(5), link.ancestors())]
    score = 25.0 * any(PAGING.search(n) for n in names)
    return score - 25.0 * any(NEGATIVE_HINT.search(n) and EXTRANEOUS.search(n) and not POSITIVE_HINT.search(n) for n in names)


def number_score(text: str, page_number: int | None) -> float:
    """Small page numbers as link text are likely next pages, unless the address is further on."""
    text = S.trim(text)
    if not re.fullmatch("[0-9]{1,18}", text):
        return 0.0
    number = int(text)
    score = -30.0 if number < 2 else max(0.0, 10.0 - number)
    return score - 50.0 * (page_number is not None and page_number >= number)


def link_score(link: Node, href: str, text: str, here: str, base: str, wordpress: bool) -> float:
    data = f"{text} {link.get('class')} {link.get('id')}"
    number = S.page_number(href)
    onward = NEXT.search(data) is not None
    score = -25.0 * (not href.lower().startswith(base.lower()))
    score += 50.0 * onward - 65.0 * (onward and CAP.search(data) is not None) - 200.0 * (PREVIOUS.search(data) is not None)
    score += parent_score(link) - 25.0 * (EXTRANEOUS.search(href) is not None) + 50.0 * (number is not None and not wordpress)
    score += number_score(text, number)
    if score > 0:  # likeness counts on top of the score so far, which doubles it
        score += score - 250.0 * (1.0 - S.similarity(here, href) - 0.2)
    return score


def next_page_url(page: Page) -> str | None:
    """The best address with 50 points or more (the last of equal ones); a repeated address keeps its last score."""
    here, base = S.remove_anchor(page.url), S.article_base_url(page.url)
    wordpress = is_wordpress(page)
    scores: dict[str, float] = {}
    for link in page.view.select("a[href]"):
        href, text = S.remove_anchor(S.trim(link.get("href"))), link.text()
        if is_candidate(href, text, here, base, page):
            scores[href] = link_score(link, href, text, here, base, wordpress)
    best = None
    for href, score in scores.items():
        if score >= 50 and (best is None or score >= scores[best]):
            best = href
    return best
