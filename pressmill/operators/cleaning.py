"""Preparing a page's tree, and cleaning the part of it that was chosen as the article."""

from __future__ import annotations

import json
import re

from ..functions import scalar as S
from . import css
from .html_tree import Node, parse_fragment

# Names, patterns and sets that decide what stays.
SPACER = re.compile(r"(?i)transparent|spacer|blank")
KEPT_FRAMES = [
    "https://www.youtube.com",
    "https://www.youtube-nocookie.com",
    "http://www.youtube.com",
    "https://player.vimeo",
    "http://player.vimeo",
    "https://www.redditmedia.com",
]
JUNK_TAGS = "title, script, noscript, link, style, hr, embed, iframe, object"
KEPT_ATTRS = frozenset("src srcset sizes type href class id alt xlink:href width height".split())
CONDITIONAL_TAGS = "ul, ol, table, div, button, form"
HEADERS = "h2, h3, h4, h5, h6"
UNLIKELY = re.compile(
    "(?i)ad-break|adbox|advert|addthis|agegate|aux|blogger-labels|combx|comment|conversation|disqus|entry-unrelated|extra|foot|form"
    "|header|hidden|loader|login|menu|meta|nav|pager|pagination|predicta|presence_control_external|popup|printfriendly|related|remove"
    "|remark|rss|share|shoutbox|sidebar|sociable|sponsor|tools"
)
LIKELY = re.compile(
    "(?i)and|article|body|blogindex|column|content|entry-content-asset|format|hfeed|hentry|hatom|main|page|posts|shadow"
)
PARAGRAPH_BREAKERS = frozenset("a blockquote dl div img p pre table".split())
BLOCKS = frozenset(
    "article aside blockquote body br button canvas caption col colgroup dd div dl dt embed fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr li map object ol output p pre progress section table tbody textarea tfoot th thead tr ul"
    " video".split()
)
_LINK = re.compile(r"https?://")
_IMAGE = re.compile(r"\.(png|gif|jpe?g)")
_SRCSET = re.compile(r"\.(png|gif|jpe?g)(\?\S+)?(\s*[\d.]+[wx])")
#: Text without these reads as itself.
_READS_OTHERWISE = re.compile("[<&\r\0]")
#: Our mark on frames that stay; it is gone from results.
KEEP = "kept-frame"


def hint(node: Node) -> str:
    return f"{node.get('class')} {node.get('id')}"


# -- the whole page -----------------------------------------------------------


def prepare(root: Node) -> Node:
    """Meta tags as name and value, lazy images in src and srcset, no scripts, styles, forms or comments."""
    for node in list(root.elements()):
        if node.tag == "meta":
            for old, new in (("content", "value"), ("property", "name")):
                if old in node.attrs:
                    node.attrs[new] = node.attrs.pop(old)
        elif node.tag == "img":
            lift_lazy_image(node)
    for node in css.select(root, "script, style, form"):
        node.detach()
    for node in [n for n in root.walk() if n.tag == "#comment"]:
        node.detach()
    return root


def lift_lazy_image(img: Node) -> None:
    """Image addresses in any other attribute, in name order, replace src or srcset; the last one wins."""
    for name, value in sorted(img.attrs.items()):
        if not _LINK.search(value):
            continue
        if name != "srcset" and _SRCSET.search(value):
            img.attrs["srcset"] = value
        elif name not in ("src", "srcset") and _IMAGE.search(value):
            img.attrs["src"] = json_src(value) or value


def json_src(value: str) -> str | None:
    try:
        found = json.loads(value)
    except ValueError:
        return None
    src = found.get("src") if isinstance(found, dict) else None
    return src if isinstance(src, str) else None


def strip_tags(text: str) -> str:
    """The text of a value read as HTML; the value itself if there is none."""
    if not _READS_OTHERWISE.search(text):
        return S.trim(text) or text
    span = css.first(parse_fragment(f"<span>{text}</span>"), "span")
    return (S.trim(span.text()) if span is not None else "") or text


# -- before scoring -------------------------------------------------------------


def strip_unlikely(root: Node) -> None:
    for node in list(root.elements()):
        if node.tag == "a" or not (node.get("class") or node.get("id")):
            continue
        if UNLIKELY.search(hint(node)) and not LIKELY.search(hint(node)):
            node.detach()


def breaks_to_paragraphs(root: Node) -> None:
    """Of a run of br elements the last becomes a p around what follows it, up to the next block."""
    in_run = False
    for br in css.select(root, "br"):
        after = br.next_element()
        if after is not None and after.tag == "br":
            in_run = True
            br.detach()
        elif in_run:
            in_run = False
            following = []
            for node in br.parent.children[br.place() + 1 :]:
                if node.tag in BLOCKS:
                    break
                following.append(node)
            paragraph = Node("p")
            br.replace_with(paragraph)
            for node in following:
                paragraph.append(node)


def to_paragraphs(root: Node) -> None:
    breaks_to_paragraphs(root)
    for node in css.select(root, "div"):
        if not any(c.tag in PARAGRAPH_BREAKERS for c in node.children):
            node.tag = "p"
    for node in css.select(root, "span"):
        if not any(up.tag in ("p", "div", "li", "figcaption") for up in node.ancestors()):
            node.tag = "p"


# -- the article ------------------------------------------------------------------


def clean_article(root: Node, article: Node, title: str, url: str, default_cleaner: bool, base: str | None) -> None:
    """The fixed order of clean-up steps; ``default_cleaner`` adds those that may take too much."""
    for node in root.children:
        if node.tag in ("html", "body"):
            node.tag = "div"
    if default_cleaner:
        clean_images(article)
    absolute_links(root, url, base)
    mark_kept_frames(article, url)
    for node in css.select(article, JUNK_TAGS):
        if KEEP not in node.classes():
            node.detach()
    clean_headlines(article)
    clean_headers(article, title)
    if default_cleaner:
        clean_conditionally(article)
    for node in css.select(article, "p"):
        if not S.trim(node.text()) and css.first(node, "iframe, img") is None:
            node.detach()
    for node in root.elements():
        node.attrs = {k: v for k, v in node.attrs.items() if k.lower() in KEPT_ATTRS}
        if KEEP in node.classes():
            rest = [c for c in node.classes() if c != KEEP]
            node.attrs["class"] = " ".join(rest)
            if not rest:
                del node.attrs["class"]


def clean_images(article: Node) -> None:
    """Images stated to be below 10 in a dimension and spacers go; the others lose their height."""
    for img in css.select(article, "img"):
        width, height = S.leading_int(img.attrs.get("width")), S.leading_int(img.attrs.get("height"))
        if (width or 20) < 10 or (height or 20) < 10:
            img.detach()
            continue
        if height is not None:
            del img.attrs["height"]
        if SPACER.search(img.get("src")):
            img.detach()


def absolute_links(root: Node, url: str, base: str | None) -> None:
    """href and src against the page's base (else its url), srcset candidates against its url."""
    for node in root.elements():
        for name in ("href", "src"):
            if name in node.attrs and (found := S.join_url(base or url, node.attrs[name])) is not None:
                node.attrs[name] = found
        if "srcset" in node.attrs:
            entries = {}
            for candidate in node.attrs["srcset"].split(","):
                link, *size = S.words(candidate) or [""]
                if (found := S.join_url(url, link)) is not None:
                    entries[" ".join([found, *size])] = None
            if entries:
                node.attrs["srcset"] = ", ".join(entries)


def mark_kept_frames(article: Node, url: str) -> None:
    starts = list(KEPT_FRAMES)
    parts = S.parse_url(url)
    if parts is not None and parts.hostname:
        starts.append(f"{parts.scheme}://{parts.hostname}")
    for frame in css.select(article, "iframe[src]"):
        if frame.get("src").startswith(tuple(starts)) and KEEP not in frame.classes():
            frame.attrs["class"] = " ".join([*frame.classes(), KEEP])


def clean_headlines(article: Node) -> None:
    """One or two h1 repeat the title and go; more of them are sections."""
    found = css.select(article, "h1")
    for node in found:
        if len(found) < 3:
            node.detach()
        else:
            node.tag = "h2"


def clean_headers(article: Node, title: str) -> None:
    from .scoring import weight

    for node in css.select(article, HEADERS):
        led = any(s.tag == "p" for s in node.previous_elements())
        if not led or S.normalize_spaces(node.text()) == title or weight(node) < 0:
            node.detach()


def clean_conditionally(article: Node) -> None:
    from .scoring import settled_score

    for node in css.select(article, CONDITIONAL_TAGS):
        if KEEP in node.classes() or css.first(node, f".{KEEP}") is not None:
            continue
        score = settled_score(node)
        if score < 0 or is_junk(node, score):
            node.detach()


def is_junk(node: Node, score: float) -> bool:
    """Whether a container looks like navigation, a form or an empty frame rather than content."""
    if "entry-content-asset" in node.classes():
        return False
    text = S.normalize_spaces(node.text())
    if text.count(",") >= 10:
        return False
    count = {tag: 0 for tag in ("p", "input", "img", "script")}
    for below in node.elements():
        if below.tag in count:
            count[below.tag] += 1
    size = S.nbytes(text)
    if count["input"] > count["p"] // 3:
        return True
    if size < 25 and not count["img"]:
        return True
    density = link_density(node)
    if score < 25 and density > 0.2 and size > 75:
        return True
    if score >= 25 and density > 0.5:
        if node.tag in ("ol", "ul") and node.parent is not None:
            before = node.parent.children[: node.place()][-1:]
            if before and S.normalize_spaces(before[0].text()).endswith(":"):
                return False
        return True
    return count["script"] > 0 and size < 150


def link_density(node: Node) -> float:
    """Bytes of text in links (nested ones again) over bytes of text."""
    total = S.text_bytes(node.text())
    inside = ([node] if node.tag == "a" else []) + [n for n in node.elements() if n.tag == "a"]
    linked = S.text_bytes("".join(n.text() for n in inside))
    return linked / total if total else float(linked > 0)
