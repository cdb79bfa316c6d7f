"""Harvest terms from a table of stored web pages."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted, strip

REFERENCE = r"&(?:#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]*);"
#: Named references, from the standard library's table.
NAMED = {f"&{n}": text for n, text in html5.items() if n.endswith(";")}


# Elements whose end tag may be omitted, with the elements that such a one cannot leave.
OPTIONAL_END = {
    "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "p": ("blockquote",),
    **dict.fromkeys(("tr", "td", "th", "tbody", "thead", "tfoot"), ("table",)),
}


def _decoded(reference: Column, names: Column) -> Column:
    """The text of one reference; an unknown name stays, an impossible number is U+FFFD."""
    hexadecimal = F.regexp_extract(reference, "&#[xX]([0-9a-fA-F]+);", 1)
    decimal = F.regexp_extract(reference, "&#([0-9]+);", 1)
    code = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).when(decimal != "", decimal).cast("bigint")
    real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    numbered = F.when(real, letter).otherwise(F.lit("\ufffd"))
    return F.when(code.isNotNull(), numbered).otherwise(F.coalesce(names[reference], reference))


def decode_references(text: Column) -> Column:
    """Text with all its character references, named and numeric, decoded."""
    names = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")
    gaps = F.split(text, REFERENCE)
    found = F.regexp_extract_all(text, F.lit(REFERENCE), 0)
    joined = F.zip_with(
        gaps, found, lambda gap, r: F.concat(gap, F.coalesce(_decoded(r, names), F.lit("")))
    )
    return F.when(text.rlike(REFERENCE), F.array_join(joined, "")).otherwise(text)


EVENT = "struct<depth:int,start:int,end:int,opens:boolean>"


def _events(html: Column, tag: str) -> Column:
    """The tags that open or end elements of one kind, with the depth at which they stand.

    One fold over the tags of the element and of its scopes. Where the end tag may be omitted, depth
    counts the open scopes, and an element ends at the next start or end of its kind in its scope, or
    with the scope. Elsewhere depth counts the open elements themselves.
    """
    scopes = OPTIONAL_END.get(tag)
    pattern = rf"(?is)</?(?:{'|'.join([tag, *(scopes or ())])})(?=[\s/>])[^>]*>"
    found = F.regexp_extract_all(html, F.lit(pattern), 0)
    tags = F.zip_with(F.split(html, pattern), found, lambda gap, t: F.struct(F.length(gap).alias("gap"), t.alias("tag")))

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + piece["gap"]
        end, depth = start + F.length(piece["tag"]), state["depth"]
        closes = piece["tag"].startswith("</")
        own = piece["tag"].rlike(rf"(?is)\A</?{tag}[\s/>]")
        inner = F.when(closes, F.greatest(depth - 1, F.lit(0))).otherwise(depth + 1)
        if scopes is None:
            at, after, event = F.when(closes, inner).otherwise(depth), inner, F.lit(True)
        else:
            at, after, event = depth, F.when(own, depth).otherwise(inner), own | closes
        made = F.struct(at.alias("depth"), start.alias("start"), end.alias("end"), (own & ~closes).alias("opens"))
        return F.struct(
            end.alias("at"),
            after.alias("depth"),
            F.when(event, F.concat(state["events"], F.array(made))).otherwise(state["events"]).alias("events"),
        ).cast(f"struct<at:int,depth:int,events:array<{EVENT}>>")

    none = F.array().cast(f"array<{EVENT}>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), none.alias("events"))
    return F.aggregate(F.filter(tags, lambda t: t["tag"].isNotNull()), start, step, lambda state: state["events"])


def _elements(html: Column, tag: str, children: bool = False) -> Column:
    """Contents of every element of one kind in order, nested ones too, or of the outermost only."""
    ordered = F.array_sort(_events(html, tag))

    def content(event: Column, i: Column) -> Column:
        after = F.get(ordered, i + 1)
        stop = F.when(after["depth"] == event["depth"], after["start"]).otherwise(F.length(html))
        inside = F.substring(html, event["end"] + 1, stop - event["end"])
        wanted = event["opens"] & (event["depth"] == 0) if children else event["opens"]
        return F.when(wanted, F.struct(event["start"].alias("start"), inside.alias("inside")))

    found = F.filter(F.transform(ordered, content), lambda x: x.isNotNull())
    return F.transform(F.array_sort(found), lambda x: x["inside"])


def first_text(fragment: Column) -> Column:
    """First text node of an HTML fragment, null if it has none."""
    text = F.regexp_extract(fragment, r"(?s)\A(?:<[^>]*>)*([^<]+)", 1)
    return F.nullif(decode_references(text), F.lit(""))


def split_terms(cell: Column) -> Column:
    """Drop newlines, strip, and split a cell's text at comma and space."""
    return F.split(strip(F.replace(cell, F.lit("\n"), F.lit(""))), ", ")


def extract_cells(
    pages: DataFrame,
    row_tag: str = "tr",
    cell_tag: str | None = "td",
    n: int = 4,
    container: str | None = "tbody",
    html: str = "html",
) -> DataFrame:
    """The n-th cell of every row element of every page, as text and as terms. Rows in cells are rows
    of their own, and their cells do not count for the outer row.

    Other columns of ``pages`` are kept. Pages without a ``container`` element give no
    rows. With ``cell_tag=None`` the row element's own first text is the cell.
    """
    kept = [quoted(c) for c in pages.columns if c != html]
    source = pages
    if container:
        source = source.where(quoted(html).rlike(rf"(?i)<{container}[\s>]"))
    rows = source.select(*kept, F.explode(_elements(quoted(html), row_tag)).alias("_row"))
    fragment = F.col("_row") if cell_tag is None else F.get(_elements(F.col("_row"), cell_tag, True), n - 1)
    cells = rows.select(*kept, first_text(fragment).alias("cell"))
    return cells.withColumn("terms", split_terms(F.col("cell")))
