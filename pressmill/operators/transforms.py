"""Named changes of chosen content that some sites need; each may name a tag to rename its node to."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from ..functions import scalar as S
from . import css
from .html_tree import Node, parse_fragment, serialize


@dataclass
class Spot:
    """A matched node, the tree it is in, and the page that tree was taken from."""

    node: Node
    tree: Node
    page: Node

    def meta(self, selector: str) -> str | None:
        found = css.first(self.page, selector)
        return found.attrs.get("value") if found is not None else None

    def up(self, selector: str) -> Node | None:
        return next((a for a in self.node.ancestors() if css.matches(a, selector)), None)


Change = Callable[[Spot], str | None]
NAMED: dict[str, Change] = {}


def named(*names: str) -> Callable[[Change], Change]:
    def register(change: Change) -> Change:
        NAMED.update(dict.fromkeys(names, change))
        return change

    return register


def apply(name: str, node: Node, tree: Node, page: Node) -> str | None:
    change = NAMED.get(name)
    return change(Spot(node, tree, page)) if change else None


def pieces(html: str) -> list[Node]:
    return list(parse_fragment(html).children)


def swap(node: Node, html: str) -> None:
    if node.parent is not None:
        node.replace_with(*pieces(html))


def fill(node: Node, html: str) -> None:
    for child in list(node.children):
        child.detach()
    for piece in pieces(html):
        node.append(piece)


def lead(node: Node, html: str) -> None:
    for k, piece in enumerate(pieces(html)):
        node.insert(k, piece)


def only(node: Node, kept: list[Node]) -> None:
    for child in list(node.children):
        if not any(child is k for k in kept):
            child.detach()


def single_img(node: Node) -> bool:
    return len(node.children) == 1 and node.children[0].tag == "img"


def embed(video: str) -> str:
    return f'<iframe src="https://www.youtube.com/embed/{video}" frameborder="0" allowfullscreen></iframe>'


@named("arstechnica.com::h2")
def _paragraph_before(at: Spot) -> None:
    if at.node.parent is not None:
        at.node.parent.insert(at.node.place(), Node("p"))


@named("deadline.com::.embed-twitter")
def _unwrap(at: Spot) -> None:
    swap(at.node, at.node.inner_html())


@named('deadspin.com::iframe.lazyload[data-recommend-id^="youtube://"]')
def _youtube_by_id(at: Spot) -> None:
    _, mark, video = at.node.get("id").partition("youtube-")
    if mark:
        at.node.attrs["src"] = f"https://www.youtube.com/embed/{video}"


@named("ma.ttias.be::h2")
def _demote(at: Spot) -> str:
    at.node.attrs.pop("id", None)
    return "h3"


@named("ma.ttias.be::h1")
def _paragraph_after(at: Spot) -> None:
    at.node.attrs.pop("id", None)
    if at.node.parent is not None:
        at.node.parent.insert(at.node.place() + 1, Node("p"))


@named("ma.ttias.be::ul")
def _asset_list(at: Spot) -> None:
    at.node.attrs["class"] = "entry-content-asset"


@named("medium.com::section span:first-of-type")
def _drop_cap(at: Spot) -> None:
    html = at.node.inner_html()
    if re.fullmatch("[A-Za-z()]", html):
        swap(at.node, html)


@named("medium.com::iframe")
def _thumbnail_video(at: Spot) -> None:
    figure = at.up("figure")
    thumb = unquote(at.node.get("data-thumbnail"), errors="replace")
    found = re.search(r"https://i\.embed\.ly/.+url=https://i\.ytimg\.com/vi/(\w+)/", thumb)
    if found:
        at.node.attrs["src"] = f"https://www.youtube.com/embed/{found[1]}"
        if figure is not None:
            only(figure, [at.node, *css.select(figure, "figcaption")])
    elif figure is not None:
        figure.detach()


@named("medium.com::figure")
def _plain_figure(at: Spot) -> None:
    images = css.select(at.node, "img")
    if images and css.first(at.node, "iframe") is None:
        only(at.node, [images[-1], *css.select(at.node, "figcaption")])


@named("medium.com::img")
def _small_image(at: Spot) -> None:
    width = S.leading_int(at.node.attrs.get("width"))
    if width is not None and width < 100:
        at.node.detach()


@named("news.mynavi.jp::img")
def _original(at: Spot) -> None:
    if at.node.get("data-original"):
        at.node.attrs["src"] = at.node.attrs["data-original"]


@named("wikipedia.org::.infobox img")
def _infobox_image(at: Spot) -> None:
    box = at.up(".infobox")
    if box is not None and css.first(box, "img") is None:
        box.insert(0, at.node)


@named("wired.jp::img[data-original]")
def _joined_original(at: Spot) -> None:
    found = S.join_url(at.node.get("src"), at.node.get("data-original")) if "src" in at.node.attrs else None
    if found is not None:
        at.node.attrs["src"] = found


@named("www.abendblatt.de::p", "www.abendblatt.de::div")
def _shifted_text(at: Spot) -> None:
    """Characters of obfuscated text are one code point up, but for a few."""
    if "obfuscated" not in at.node.classes():
        return
    fixed = {177: "%", 178: "!", 180: ";", 181: "=", 32: " ", 10: "\n"}
    text = "".join(fixed.get(ord(c)) or (chr(ord(c) - 1) if ord(c) > 33 else "") for c in at.node.text())
    fill(at.node, text)
    at.node.attrs["class"] = "deobfuscated"


@named('www.apartmenttherapy.com::div[data-render-react-id="images/LazyPicture"]')
def _json_picture(at: Spot) -> None:
    try:
        src = json.loads(at.node.get("data-props"))["sources"][0]["src"]
    except (ValueError, KeyError, IndexError, TypeError):
        return
    if isinstance(src, str):
        swap(at.node, f'<img src="{src}"/>')


@named("www.buzzfeed.com::div.longform_custom_header_media")
def _header_media(at: Spot) -> str | None:
    both = css.first(at.node, "img") is not None and css.first(at.node, ".longform_header_image_source") is not None
    return "figure" if both else None


@named("www.cnet.com::figure.image")
def _figure_image(at: Spot) -> None:
    images = css.select(at.node, "img")
    for img in images:
        names = img.classes()
        img.attrs |= {"width": "100%", "height": "100%"}
        img.attrs["class"] = " ".join(names if "__image-lead__" in names else [*names, "__image-lead__"])
    for node in css.select(at.tree, ".imgContainer"):
        node.detach()
    if images:
        at.node.insert(0, images[-1])


@named("www.cnn.com::.zn-body__paragraph, .el__leafmedia--sourced-paragraph")
def _filled_paragraph(at: Spot) -> str | None:
    return "p" if at.node.children else None


@named("www.cnn.com::.zn-body__paragraph")
def _link_paragraph(at: Spot) -> None:
    link = css.first(at.node, "a")
    if link is not None and S.trim(link.text()) == S.trim(at.node.text()):
        at.node.detach()


@named("www.elecom.co.jp::table")
def _auto_width(at: Spot) -> None:
    at.node.attrs["width"] = "auto"


@named("www.fool.com::.caption img")
def _caption_figure(at: Spot) -> None:
    if at.node.parent is not None:
        swap(at.node.parent, f'<figure><img src="{at.node.get("src")}"/></figure>')


@named("www.fortinet.com::noscript", "www.si.com::noscript")
def _noscript_figure(at: Spot) -> str | None:
    return "figure" if single_img(at.node) else None


@named("www.theverge.com::noscript")
def _noscript_span(at: Spot) -> str | None:
    return "span" if single_img(at.node) else None


@named("www.gizmodo.jp::img.p-post-thumbnailImage", "www.lifehacker.jp::img.lazyload")
def _quoted_source(at: Spot) -> None:
    at.node.attrs["src"] = at.node.get("src").split("%27")[-1]


@named("www.latimes.com::.trb_ar_la")
def _inner_figure(at: Spot) -> None:
    figure = css.first(at.node, "figure")
    if figure is not None:
        swap(at.node, serialize(figure))


@named("www.msnbc.com::.pane-node-body")
def _page_image(at: Spot) -> None:
    src = at.meta('meta[name="og:image"]')
    if src is not None:
        lead(at.node, f'<img src="{src}" />')


@named("www.nationalgeographic.com::.parsys.content", "news.nationalgeographic.com::.parsys.content")
def _data_images(at: Spot) -> None:
    head = at.node.children[0] if at.node.children else None
    if head is not None and "imageGroup" in head.classes():
        box = css.first(head, ".media--medium__container")
        data = box.children[0].attrs if box is not None and box.children else {}
        one, two = data.get("data-platform-image1-path"), data.get("data-platform-image2-path")
        if one is not None and two is not None:
            lead(at.node, f'<div class="__image-lead__"><img src="{one}"/><img src="{two}"/></div>')
        return
    picture = css.first(at.node, ".image.parbase.section .picturefill")
    if picture is not None and "data-platform-src" in picture.attrs:
        lead(at.node, f'<img class="__image-lead__" src="{picture.attrs["data-platform-src"]}"/>')


@named("www.ndtv.com::.place_cont")
def _dateline(at: Spot) -> None:
    if at.node.parent is None or any(up.tag == "p" for up in at.node.ancestors()):
        return
    after = at.node.parent.children[at.node.place() + 1 :][:1]
    if after and after[0].tag == "p":
        after[0].insert(0, at.node)


@named("www.nytimes.com::img.g-lazy")
def _sized_source(at: Spot) -> None:
    at.node.attrs["src"] = at.node.get("src").replace("{{size}}", "640")


@named('www.reddit.com::div[role="img"]')
def _background_image(at: Spot) -> str | None:
    images, found = css.select(at.node, "img"), re.search(r"\((.*?)\)", at.node.get("style"))
    if len(images) != 1 or not found:
        return None
    images[0].attrs["src"] = found[1].strip("'\"")
    return "img"


@named("www.refinery29.com::div.loading noscript")
def _loaded(at: Spot) -> None:
    box = at.up(".loading")
    if box is not None:
        swap(box, at.node.inner_html())


@named("www.vox.com::figure .e-image__image noscript")
def _static_image(at: Spot) -> None:
    html, box = at.node.inner_html(), at.up(".e-image__image")
    if box is not None:
        for node in css.select(box, ".c-dynamic-image"):
            swap(node, html)


@named("www.washingtonpost.com::div.inline-content")
def _inline_media(at: Spot) -> str | None:
    if css.first(at.node, "img, iframe, video") is not None:
        return "figure"
    at.node.detach()
    return None


@named("nymag.com::noscript")
def _raw_noscript(at: Spot) -> str | None:
    found = list(parse_fragment(at.node.text()).elements())
    if len(found) == 1 and found[0].tag == "img":
        fill(at.node, serialize(found[0]))
        return "figure"
    return None


@named("twitter.com::.permalink[role=main]")
def _tweets(at: Spot) -> None:
    inner = "".join(map(serialize, css.select(at.node, ".tweet")))
    swap(at.node, f'<div id="TWEETS_GO_HERE">{inner}</div>')


@named("www.youtube.com::#player-api")
def _player(at: Spot) -> None:
    video = at.meta('meta[itemprop="videoId"]')
    if video is not None:
        fill(at.node, embed(video))


@named("www.youtube.com::#player-container-outer")
def _player_with_text(at: Spot) -> None:
    video, text = at.meta('meta[itemprop="videoId"]'), at.meta('meta[itemprop="description"]')
    if video is not None and text is not None:
        fill(at.node, f"{embed(video)}<div><span>{text}</span></div>")
