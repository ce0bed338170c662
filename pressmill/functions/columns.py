"""String, URL and scoring functions as column expressions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import IMAGE_BAD, IMAGE_GOOD, RTL_RANGES

_PAGE = r"(page|paging|(p(a|g|ag)?(e|enum|ewanted|ing|ination)))?(=|/)([0-9]{1,3})"


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def url_host(url: Column) -> Column:
    """The host in lower case, without port; null for what is no absolute URL."""
    return empty_to_null(F.lower(F.regexp_extract(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)))


def is_valid_url(url: Column) -> Column:
    return F.coalesce(url_host(url).isNotNull(), F.lit(False))


def base_domain(host: Column) -> Column:
    """The last two labels of a host."""
    labels = F.split(host, r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")


def remove_anchor(url: Column) -> Column:
    return F.regexp_replace(F.split_part(url, F.lit("#"), F.lit(1)), r"/+\z", "")


def page_number(url: Column) -> Column:
    """The first page-like number of a URL; null where it is 100 or more."""
    number = F.regexp_extract(url, _PAGE, 6).try_cast("int")
    return F.when(number < 100, number)


def article_base_url(url: Column) -> Column:
    """Scheme, host and path without what looks like pagination, segment by segment from the last."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    segments = F.reverse(F.split(F.when(path == "", "/").otherwise(path), "/"))

    def shorten(segment: Column, at: Column) -> Column:
        named = F.when(segment.rlike(r"^[^.]*\.[a-z]+\z"), F.split_part(segment, F.lit("."), F.lit(1))).otherwise(segment)
        cut = F.regexp_replace(named, "^(.*?)" + _PAGE, "$1")  # the first one only
        return F.when(at < 2, cut).otherwise(named)

    short = F.transform(segments, shorten)
    letters = short[0].rlike("[a-z]")
    good = F.filter(
        short,
        lambda s, at: ~((at == 0) & (F.lower(s) == "index")) & ~((at < 2) & (F.octet_length(s) < 3) & ~letters),
    )
    return F.concat(scheme, F.lit("://"), url_host(url), F.array_join(F.reverse(good), "/"))


def collapse(text: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_spaces(text: Column) -> Column:
    """Runs of two or more white spaces become one space, for text without tags."""
    squeezed = F.regexp_replace(text, r"(?U)\s{2,}", " ")
    return F.regexp_replace(squeezed, r"(?U)^\s+|\s+\z", "")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(collapse(text), " "), 1, n), " ")


def word_count(text: Column) -> Column:
    packed = collapse(text)
    return F.when(packed == "", 0).otherwise(F.size(F.split(packed, " ")))


def text_bytes(text: Column) -> Column:
    return F.octet_length(collapse(text))


def ellipsize(text: Column, limit: int, mark: str) -> Column:
    """At most ``limit`` bytes, cut at the last space within them where there is one, and the mark.

    The cut is made in bytes; what it leaves of a character turns into a
    replacement character, which goes.
    """
    part = F.substring(text.cast("binary"), 1, limit).cast("string")
    head = F.rtrim(F.make_valid_utf8(part), F.lit(chr(0xFFFD)))
    cut = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    shorter = F.when(head.contains(" "), F.regexp_replace(cut, r"(?U)\s+\z", "")).otherwise(head)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(shorter, F.lit(mark)))


def clean_excerpt(text: Column, limit: int = 200) -> Column:
    return ellipsize(collapse(text), limit, "&hellip;")


def clean_author(author: Column) -> Column:
    bare = F.regexp_replace(author, r"(?iU)^\s*(posted |written )?by\s*:?\s*(.*)", "$2")
    return normalize_spaces(bare)


def clean_lead_image_url(url: Column) -> Column:
    bare = F.trim(url)
    return F.when(bare.rlike("^(https?|ftp)://"), bare)


def direction(text: Column) -> Column:
    """ltr, rtl, bidi or null, by direction marks or else by the scripts of the characters."""
    ranges = "".join(rf"\x{{{a + 1:04X}}}-\x{{{b - 1:04X}}}" for a, b in RTL_RANGES)
    neutral = r"\s\x00'\"\-+?!0-9"
    left_mark, right_mark = text.contains(chr(0x200E)), text.contains(chr(0x200F))
    marked = left_mark | right_mark
    has_right = text.rlike(f"[{ranges}]")
    has_left = text.rlike(f"(?U)[^{neutral}{ranges}]") | (~has_right & text.rlike("[0-9]"))
    left = F.when(marked, left_mark).otherwise(has_left)
    right = F.when(marked, right_mark).otherwise(has_right)
    return F.when(left & right, "bidi").when(left, "ltr").when(right, "rtl")


def image_url_score(url: Column) -> Column:
    bare = F.trim(url)
    points = lambda pattern, n: F.when(bare.rlike(pattern), n).otherwise(0)
    total = points(f"(?i){IMAGE_GOOD}", 20) + points(f"(?i){IMAGE_BAD}", -20)
    return total + points(r"(?i)\.gif(\?.*)?\z", -10) + points(r"(?i)\.jpe?g(\?.*)?\z", 10)


def paragraph_score(text: Column) -> Column:
    """A point, one for each comma, up to three for length; 0 under 25 bytes."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")
    size = F.octet_length(bare)
    commas = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))
    bonus = F.least(F.greatest(size / 50.0 - 2.0, F.lit(0.0)), F.lit(3.0))
    score = F.lit(1.0) + commas + bonus - F.when(bare.endswith(":"), 1.0).otherwise(0.0)
    return F.when(size < 25, 0.0).otherwise(score)


def hint_weight(names: Column) -> Column:
    """25 for a hint of content, -25 for a hint of surroundings, in a class or an id."""
    from ..operators.scoring import NEGATIVE, POSITIVE

    return F.when(names.rlike(POSITIVE), 25).otherwise(0) - F.when(names.rlike(NEGATIVE), 25).otherwise(0)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def validation_message(status: Column, content_type: Column, content_length: Column) -> Column:
    """Why a response is not read, or null; the first reason wins."""
    from ..operators import extract as E

    kind = F.lower(F.trim(content_type))
    return (
        F.when(status != 200, F.concat(*_around(E.NON_200, status)))
        .when(kind.isin("audio/mpeg", "image/gif", "image/jpeg", "image/jpg"), F.concat(*_around(E.BAD_TYPE, content_type)))
        .when(content_length > 5_242_880, E.TOO_LARGE)
        .when(~(content_type.contains("html") | content_type.contains("text")) | content_type.isNull(), E.NOT_TEXT)
    )


def _around(message: str, value: Column) -> list[Column]:
    before, after = message.split("{}")
    return [F.lit(before), value.cast("string"), F.lit(after)]


def charset(content_type: Column) -> Column:
    found = F.lower(F.regexp_extract(content_type, r"charset=([\w-]+)\b", 1))
    return F.when(found == "", "utf-8").otherwise(found)


def json_src(value: Column) -> Column:
    return F.get_json_object(value, "$.src")
