"""Fields of a page without a site rule: ordered lists of places, the first usable one wins."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field
from datetime import datetime

from ..functions import dates
from ..functions import scalar as S
from . import css
from .cleaning import hint, strip_tags
from .html_tree import Node, parse_fragment
from .scoring import PHOTO_HINT

# Names of meta tags, selectors and patterns, in the order they are tried.
TITLE_METAS = ["tweetmeme-title", "dc.title", "rbtitle", "headline", "title"]
WEAK_TITLE_METAS = ["og:title"]
TITLE_SELECTORS = [".hentry .entry-title", "h1#articleHeader", "h1.articleHeader", "h1.article", ".instapaper_title", "#meebo-title"]
WEAK_TITLE_SELECTORS = [
    "article h1",
    "#entry-title",
    ".entry-title",
    "#entryTitle",
    "#entrytitle",
    ".entryTitle",
    ".entrytitle",
    "#articleTitle",
    ".articleTitle",
    "post post-title",
    "h1.title",
    "h2.article",
    "h1",
    "html head title",
    "title",
]
AUTHOR_METAS = ["byl", "clmst", "dc.author", "dcsext.author", "dc.creator", "rbauthors", "authors"]
AUTHOR_SELECTORS = [
    ".entry .entry-author",
    ".author.vcard .fn",
    ".author .vcard .fn",
    ".byline.vcard .fn",
    ".byline .vcard .fn",
    ".byline .by .author",
    ".byline .by",
    ".byline .author",
    ".post-author.vcard",
    ".post-author .vcard",
    "a[rel=author]",
    "#by_author",
    ".by_author",
    "#entryAuthor",
    ".entryAuthor",
    ".byline a[href*=author]",
    "#author .authorname",
    ".author .authorname",
    "#author",
    ".author",
    ".articleauthor",
    ".ArticleAuthor",
    ".byline",
]
AUTHOR_BYTES = 300
DATE_METAS = [
    "article:published_time",
    "displaydate",
    "dc.date",
    "dc.date.issued",
    "rbpubdate",
    "publish_date",
    "pub_date",
    "pagedate",
    "pubdate",
    "revision_date",
    "doc_date",
    "date_created",
    "content_create_date",
    "lastmodified",
    "created",
    "date",
]
DATE_SELECTORS = [
    ".hentry .dtstamp.published",
    ".hentry .published",
    ".hentry .dtstamp.updated",
    ".hentry .updated",
    ".single .published",
    ".meta .published",
    ".meta .postDate",
    ".entry-date",
    ".byline .date",
    ".postmetadata .date",
    ".article_datetime",
    ".date-header",
    ".story-date",
    ".dateStamp",
    "#story .datetime",
    ".dateline",
    ".pubdate",
]
DATE_IN_URL = [
    re.compile(r"(?i)/(20\d{2}/\d{2}/\d{2})/"),
    re.compile(r"(?i)(20\d{2}-[01]\d-[0-3]\d)"),
    re.compile(r"(?i)/(20\d{2}/(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)/[0-3]\d)/"),
]
IMAGE_METAS = ["og:image", "twitter:image", "image_src"]
EXCERPT_METAS = ["og:description", "twitter:description"]
URL_METAS = ["og:url"]


@dataclass
class Page:
    """A prepared page: its tree, its url, and the values of its named meta tags."""

    root: Node
    url: str
    now: datetime | None = None
    visited: list[str] = field(default_factory=list)
    metas: dict[str, list[str]] = field(init=False)
    view: css.View = field(init=False)

    def __post_init__(self):
        self.metas, self.view = {}, css.View(self.root)
        for node in self.view.nodes:
            if node.tag == "meta" and "name" in node.attrs:
                self.metas.setdefault(node.attrs["name"], []).append(S.trim(node.get("value")))

    def base(self) -> str | None:
        node = self.view.first("base[href]")
        return (S.trim(node.get("href")) or None) if node is not None else None

    def meta(self, names: list[str], strip: bool = True) -> str | None:
        """The value of the first name with exactly one non-empty value."""
        for name in names:
            found = [v for v in self.metas.get(name, ()) if v]
            if len(found) == 1:
                return strip_tags(found[0]) if strip else found[0]
        return None

    def place(self, selectors: list[str], most_children: int) -> str | None:
        """The text of the first selector that matches one element, plain enough and not in a comment."""
        for selector in selectors:
            found = self.view.select(selector)
            if len(found) != 1 or len(found[0].children) > most_children:
                continue
            if any("comment" in hint(up) for up in found[0].ancestors()):
                continue
            if text := found[0].text():
                return text
        return None

    def date(self, raw: str, zone: str | None = None, pattern: str | None = None) -> str | None:
        return dates.clean_date(raw, zone, pattern, self.now)


def clean_title(page: Page, title: str) -> str:
    if S.SPLITTERS.search(title):
        title = S.resolve_split_title(title, page.url)
    if S.nbytes(title) > 150:
        heads = page.view.select("h1")
        if len(heads) == 1:
            title = S.trim(heads[0].text())
    return S.normalize_spaces(S.trim(strip_tags(title)))


def title(page: Page) -> str:
    for raw in (
        lambda: page.meta(TITLE_METAS),
        lambda: page.place(TITLE_SELECTORS, 1),
        lambda: page.meta(WEAK_TITLE_METAS),
        lambda: page.place(WEAK_TITLE_SELECTORS, 1),
    ):
        if (found := raw()) is not None:
            return clean_title(page, found)
    return ""


def author(page: Page) -> str | None:
    for found in (page.meta(AUTHOR_METAS), page.place(AUTHOR_SELECTORS, 2)):
        if found is not None and S.nbytes(found) < AUTHOR_BYTES:
            return S.clean_author(found)
    for selector in ("#byline", ".byline"):
        nodes = page.view.select(selector)
        if len(nodes) == 1 and S.trim(nodes[0].text()).startswith("By"):
            return S.clean_author(S.trim(nodes[0].text()))
    return None


def date_published(page: Page) -> str | None:
    """The first raw date decides, whether it can be read or not."""
    raw = page.meta(DATE_METAS, strip=False)
    if raw is None:
        raw = page.place(DATE_SELECTORS, 1)
    if raw is None:
        raw = next((m[1] for p in DATE_IN_URL if (m := p.search(page.url))), None)
    return None if raw is None else page.date(raw)


def image_score(img: Node, index: int, total: int) -> float:
    """Hints in the address, its surroundings, its stated size and how early it comes."""
    src = img.get("src")
    ups = list(img.ancestors())
    score = S.image_url_score(src) + 5.0 * ("alt" in img.attrs) + 25.0 * any(up.tag == "figure" for up in ups)
    score += 15.0 * sum(PHOTO_HINT.search(hint(up)) is not None for up in ups[:2])
    after = img.next_element()
    if after is not None:
        score += 25.0 * (after.tag == "figcaption") + 15.0 * (PHOTO_HINT.search(hint(after)) is not None)
    width, height = S.leading_float(img.attrs.get("width")), S.leading_float(img.attrs.get("height"))
    score -= 50.0 * sum(side is not None and side <= 50 for side in (width, height))
    if width is not None and height is not None and "sprite" not in src:
        area = width * height
        score += -100.0 if area < 5000 else float(int(area / 1000 + 0.5))
    return score + total / 2 - index


@functools.lru_cache(2)
def content_tree(content: str) -> Node:
    """The tree of a content that several fields look at; nobody changes it."""
    return parse_fragment(content)


def lead_image_url(page: Page, content: str | None) -> str | None:
    raw = page.meta(IMAGE_METAS, strip=False)
    if raw is not None and (found := S.clean_lead_image_url(raw)):
        return found
    if content is not None and "<img" in content.lower():
        images = css.select(content_tree(content), "img")
        scored = [(image_score(img, k, len(images)), k, img.get("src")) for k, img in enumerate(images) if "src" in img.attrs]
        if scored:
            score, _, src = max(scored)  # the last of equal ones
            if score > 0 and (found := S.clean_lead_image_url(src)):
                return found
    link = page.view.first("link[rel=image_src]")
    if link is not None:
        for name in ("src", "href", "value"):
            if name in link.attrs and (found := S.clean_lead_image_url(link.attrs[name])):
                return found
    return None


def excerpt(page: Page, content: str | None) -> str | None:
    raw = page.meta(EXCERPT_METAS)
    if raw is not None:
        return S.clean_excerpt(strip_tags(raw))
    return None if content is None else S.clean_excerpt(parse_fragment(content[:1000]).text())


def word_count(content: str | None) -> int | None:
    """Words of the first div; where that is one word, of the whole without its tags."""
    if content is None:
        return None
    div = css.first(content_tree(content), "div") if "<div" in content.lower() else None
    count = len(S.words(div.text())) if div is not None else 0
    if count == 1:
        count = max(1, len(S.words(re.sub(r"<[^>]*(?:>|\Z)", "", content))))
    return count


def url_and_domain(page: Page) -> tuple[str, str | None]:
    """The canonical link as it stands, else og:url, else the page's own url; and that one's host."""
    link = page.view.first("link[rel=canonical]")
    found = link.attrs.get("href") if link is not None else None
    if found is None:
        found = page.meta(URL_METAS, strip=False)
    if found is None:
        found = page.url
    return found, S.host_of(found)
