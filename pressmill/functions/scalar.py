"""String and URL values inside the page kernel; columns.py has the same for whole columns.

Lengths that thresholds refer to are UTF-8 bytes. White space is that of
Unicode, which unlike str.split() leaves out the separators 1C to 1F.
"""

from __future__ import annotations

import difflib
import functools
import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

_CODES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WS = "".join(map(chr, _CODES))
_RUN = re.compile(f"[{WS}]{{2,}}")
_SPACE = re.compile(f"[{WS}]+")
_STRIP = WS
_TAG = re.compile(r"(<[^>]*>)")
_KEEP = frozenset(["pre", "code", "textarea"])

# The page-number and charset patterns.
PAGE_IN_HREF = re.compile(r"(page|paging|(p(a|g|ag)?(e|enum|ewanted|ing|ination)))?(=|/)([0-9]{1,3})")
CHARSET = re.compile(r"charset=([\w-]+)\b")


def nbytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def trim(text: str) -> str:
    return text.strip(_STRIP)


def words(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w]


def collapse(text: str) -> str:
    return " ".join(words(text))


def normalize_spaces(text: str) -> str:
    """Runs of two or more white spaces become one space, within text between tags; not in pre, code, textarea."""
    out, kept = [], 0
    for k, part in enumerate(_TAG.split(text)):
        if k % 2:
            name = re.split(r"[\s/]", trim(part[1:-1]).lower().lstrip("/"), maxsplit=1)[0]
            if name in _KEEP:
                kept = max(0, kept - 1) if trim(part[1:-1]).startswith("/") else kept + 1
            out.append(part)
            continue
        head, mark, tail = part.partition("<")  # a tag that never closes: the rest is verbatim
        out += [head if kept else _RUN.sub(" ", head), mark, tail]
    return trim("".join(out))


def text_bytes(text: str) -> int:
    return nbytes(collapse(text))


def leading_int(text: str | None) -> int | None:
    found = re.match(rf"[{WS}]*([+-]?[0-9]+)", text or "")
    return int(found[1]) if found else None


def leading_float(text: str | None) -> float | None:
    found = re.match(rf"[{WS}]*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", text or "")
    return float(found[1]) if found else None


def has_sentence_end(text: str) -> bool:
    return re.search(f"[^\n\r{chr(0x2028)}{chr(0x2029)}](?: |\\Z)", text) is not None


def first_words(text: str, n: int) -> str:
    return " ".join(words(text)[:n])


def ellipsize(text: str, limit: int, mark: str) -> str:
    """At most ``limit`` bytes, cut at the last space within them where there is one, and the mark."""
    if nbytes(text) <= limit:
        return text
    head = text.encode("utf-8", "surrogatepass")[:limit].decode("utf-8", "ignore")
    cut = head.rfind(" ")
    return (head[:cut].rstrip(_STRIP) if cut >= 0 else head) + mark


def clean_excerpt(text: str, limit: int = 200) -> str:
    return ellipsize(collapse(text), limit, "&hellip;")


# -- URLs -------------------------------------------------------------------

_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
_SAFE = "!$%&'()*+,-./:;=@_~|[]^"


@functools.lru_cache(4096)
def parse_url(url: str):
    """The split, normalised URL (scheme and host in lower case, no default port), or None if it has no scheme."""
    try:
        parts = urlsplit(trim(url).replace("\\", "/") if re.match(r"(?i)\s*(https?|ftp|wss?):", url) else trim(url))
        scheme = parts.scheme.lower()
        if not scheme:
            return None
        if scheme in _PORTS:
            host = (parts.hostname or "").lower()
            if not host or re.search(r"[\s<>^|%#?@\\]", host):
                return None
            if not host.isascii():
                host = host.encode("idna").decode("ascii")
            port = parts.port
            net = host if ":" not in host else f"[{host}]"
            if parts.username is not None:
                net = parts.netloc.rpartition("@")[0] + "@" + net
            if port is not None and port != _PORTS[scheme]:
                net += f":{port}"
            path = quote(_dots(parts.path) or "/", _SAFE)
            return parts._replace(scheme=scheme, netloc=net, path=path, query=quote(parts.query, _SAFE + "?`{}"), fragment=quote(parts.fragment, _SAFE + "?{}#"))
        return parts._replace(scheme=scheme)
    except ValueError:
        return None


def _dots(path: str) -> str:
    if "/." not in path:
        return path
    out: list[str] = []
    pieces = path.split("/")
    for k, piece in enumerate(pieces):
        last = k == len(pieces) - 1
        if piece == "..":
            if len(out) > 1:
                out.pop()
            if last:
                out.append("")
        elif piece == ".":
            if last:
                out.append("")
        else:
            out.append(piece)
    return "/".join(out)


def host_of(url: str) -> str | None:
    parts = parse_url(url)
    return (parts.hostname or None) if parts is not None else None


def is_valid_url(url: str | None) -> bool:
    return bool(url) and host_of(url) is not None


def join_url(base: str, link: str) -> str | None:
    """The absolute form of a link; None if the base is no URL or the result is none."""
    start = parse_url(base)
    if start is None:
        return None
    try:
        link = trim(link)
        if not link:
            return urlunsplit(start._replace(fragment=""))
        joined = parse_url(urljoin(urlunsplit(start), link))
    except ValueError:
        return None
    return urlunsplit(joined) if joined is not None else None


def remove_anchor(url: str) -> str:
    return url.split("#", 1)[0].rstrip("/")


def page_number(url: str) -> int | None:
    found = PAGE_IN_HREF.search(url)
    return int(found[6]) if found and int(found[6]) < 100 else None


def base_domain(host: str) -> str:
    return ".".join(host.split(".")[-2:])


def article_base_url(url: str) -> str:
    """Scheme, host and the path without what looks like pagination; segments are judged from the last."""
    parts = parse_url(url)
    kept: list[str] = []
    letters = False
    for at, segment in enumerate(reversed((parts.path or "").split("/"))):
        name, dot, ending = segment.partition(".")
        if dot and re.fullmatch("[a-z]+", ending):
            segment = name
        if at < 2:
            segment = PAGE_IN_HREF.sub("", segment, count=1)
        if at == 0:
            letters = re.search("[a-z]", segment) is not None
        index_page = at == 0 and segment.lower() == "index"
        too_short = at < 2 and nbytes(segment) < 3 and not letters
        if not (index_page or too_short):
            kept.append(segment)
    return f"{parts.scheme}://{parts.hostname or ''}" + "/".join(reversed(kept))


def similarity(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def levenshtein_ratio(a: str, b: str) -> float:
    """One less the edit distance over the longer length; two empty strings are equal."""
    if not a and not b:
        return 1.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return 1.0 - row[-1] / max(len(a), len(b))


def known_charset(label: str) -> bool:
    import codecs

    try:
        codecs.lookup(label)
        return True
    except LookupError:
        return False


def charset_of(declared: str) -> str:
    """The declared charset where it is a known one, else utf-8."""
    found = CHARSET.search(declared)
    return found[1] if found and known_charset(found[1]) else "utf-8"


def decode_body(body: bytes, charset: str) -> str:
    """Bytes to text, bad ones replaced; the web's reading of Latin-1 labels is windows-1252."""
    if body.startswith(b"\xef\xbb\xbf"):
        return body[3:].decode("utf-8", "replace")
    name = charset.lower()
    if name in ("latin1", "latin-1", "iso-8859-1", "iso8859-1", "ascii", "us-ascii"):
        name = "cp1252"
    return body.decode(name if known_charset(name) else "utf-8", "replace")


# -- values of fields ---------------------------------------------------------

# Patterns of authors, deks, titles and web addresses.
_AUTHOR = re.compile(rf"(?i)^[{WS}]*(posted |written )?by[{WS}]*:?[{WS}]*(.*)")
_LINK = re.compile(r"(?i)http(s)?://")
SPLITTERS = re.compile(r": | - | \| ")
ENDINGS = re.compile(r"\.com\Z|\.net\Z|\.org\Z|\.co\.uk\Z")
_WEB = re.compile(r"^(https?|ftp)://")


def clean_author(author: str) -> str:
    return normalize_spaces(trim(_AUTHOR.sub(r"\2", author, count=1)))


def clean_lead_image_url(url: str) -> str | None:
    url = trim(url)
    return url if _WEB.match(url) else None


def clean_dek(dek: str, excerpt: str | None, strip_tags) -> str | None:
    if not 5 <= nbytes(dek) <= 1000:
        return None
    if excerpt is not None and first_words(excerpt, 10) == first_words(dek, 10):
        return None
    text = strip_tags(dek)
    return None if _LINK.search(text) else normalize_spaces(trim(text))


def split_title(title: str) -> list[str]:
    """The parts and the splitters between them, in order, without empty parts."""
    return [p for p in re.split(f"({SPLITTERS.pattern})", title) if p]


def resolve_split_title(title: str, url: str) -> str:
    """The title without a breadcrumb trail or the site's name at either end."""
    parts = split_title(title)
    if len(parts) == 1:
        return title
    if len(parts) >= 6:
        counts = {p: parts.count(p) for p in parts}
        term = max(counts, key=counts.get)  # the first of the most frequent
        pieces = title.split(term) if counts[term] >= 2 and nbytes(term) <= 4 else parts
        first, last = pieces[0], pieces[-1]
        longest = first if nbytes(first) > nbytes(last) else last
        return longest if nbytes(longest) > 10 else title
    host = host_of(url)
    if host is None:
        return title
    site = ENDINGS.sub("", host, count=1)
    slug = lambda part: part.lower().replace(" ", "")
    start, end = slug(parts[0]), slug(parts[-1])
    if nbytes(start) > 5 and levenshtein_ratio(start, site) > 0.4:
        return "".join(parts[2:])
    if nbytes(end) >= 5 and levenshtein_ratio(end, site) > 0.4:
        return "".join(parts[: max(0, len(parts) - 2)])
    return title


# Ranges of right-to-left code points, both ends excluded.
RTL_RANGES = [(0x0591, 0x05FE), (0x0601, 0x06FE), (0x07C1, 0x07FE), (0x0701, 0x074E), (0x0781, 0x07BE), (0x2D31, 0x2D7E)]
_RTL = "".join(f"{chr(a + 1)}-{chr(b - 1)}" for a, b in RTL_RANGES)
_NEUTRAL = f"{WS}\0'\"\\-+?!0-9"


def direction(title: str | None) -> str | None:
    if not title:
        return None
    left, right = chr(0x200E) in title, chr(0x200F) in title
    if not (left or right):
        right = re.search(f"[{_RTL}]", title) is not None
        left = re.search(f"[^{_NEUTRAL}{_RTL}]", title) is not None or (not right and re.search("[0-9]", title) is not None)
    return {(True, True): "bidi", (True, False): "ltr", (False, True): "rtl"}.get((left, right))


# Hints in image addresses.
IMAGE_GOOD = "upload|wp-content|large|photo|wp-image"
IMAGE_BAD = (
    "spacer|sprite|blank|throbber|gradient|tile|bg|background|icon|social|header|hdr|advert|spinner|loader|loading|default|rating"
    "|share|facebook|twitter|theme|promo|ads|wp-includes"
)
_IMAGE_SCORES = [
    (re.compile(f"(?i){IMAGE_GOOD}"), 20),
    (re.compile(f"(?i){IMAGE_BAD}"), -20),
    (re.compile(r"(?i)\.gif(\?.*)?\Z"), -10),
    (re.compile(r"(?i)\.jpe?g(\?.*)?\Z"), 10),
]


def image_url_score(url: str) -> float:
    url = trim(url)
    return float(sum(points for pattern, points in _IMAGE_SCORES if pattern.search(url)))
