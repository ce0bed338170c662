"""Parts of the page kernel as column functions over html, one Arrow batch at a time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import css
from .html_tree import parse_document
from .render import FORMATS, convert


def select_texts(html: Column, selector: str) -> Column:
    """The texts of all elements that match, in document order; null html has none."""

    @F.arrow_udf("array<string>")
    def texts(pages: pa.Array) -> pa.Array:
        found = [[n.text() for n in css.select(parse_document(p.as_py() or ""), selector)] for p in pages]
        return pa.array(found, pa.list_(pa.string()))

    return texts(html)


def select_attrs(html: Column, selector: str, name: str) -> Column:
    """An attribute of all elements that match and have it, in document order."""

    @F.arrow_udf("array<string>")
    def attrs(pages: pa.Array) -> pa.Array:
        nodes = ([n for n in css.select(parse_document(p.as_py() or ""), selector) if name in n.attrs] for p in pages)
        return pa.array([[n.attrs[name] for n in own] for own in nodes], pa.list_(pa.string()))

    return attrs(html)


def rendered(content: Column, form: str) -> Column:
    """HTML as html, markdown or text; null stays null."""
    if form not in FORMATS:
        raise ValueError(f"no such format: {form}")

    @F.arrow_udf("string")
    def convert_all(contents: pa.Array) -> pa.Array:
        return pa.array([convert(c.as_py(), form) for c in contents], pa.string())

    return convert_all(content)
