"""Sections of HTML pages below their headings, without boxes that hold no content, at any nesting.

One pass over a page's tags keeps the open elements; where a box is closed, what it holds is taken out, so boxes are balanced
intervals. A closing tag closes the nearest open element of its name and those left open in it; one without an opening is
passed over. A box that is never closed is no box. Tags in scripts, styles and comments are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import html as H
from quern.functions.text import strip
from quern.session import prepare

#: Elements without content of the page, and words in the class or id of a division without any.
BOXES = frozenset(("nav", "footer", "header", "aside", "menu"))
DIVISIONS = re.compile(r"""(?is)<div[^>]+(?:class|id)=["'][^"']*(?:footer|sidebar|menu|cookie|banner|navigation|breadcrumb)""")
TAG = re.compile(r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<(/?)(nav|footer|header|aside|menu|div)\b[^>]*>")
HEADING = re.compile(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>")


def content(html: str) -> str:
    """A page without its boxes."""
    out: list[str] = []
    open_: list[tuple[str, int, bool]] = []  # name, pieces before it, whether it is a box
    at = 0
    for m in TAG.finditer(html):
        name = (m[3] or "").lower()
        if not name:
            continue
        out.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            open_.append((name, len(out), name in BOXES or bool(DIVISIONS.match(m[0]))))
            out.append(m[0])
            continue
        place = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), None)
        if place is None:
            out.append(m[0])
            continue
        _, before, box = open_[place]
        del open_[place:]
        if box:
            del out[before:]
        else:
            out.append(m[0])
    return "".join([*out, html[at:]])


def parts(html: str) -> list[tuple[int, str, str]]:
    """(level, title, body) as HTML: what stands before the first heading, at level 0, and each heading with what follows."""
    held, at, now = [], 0, (0, "")
    text = content(html)
    for m in HEADING.finditer(text):
        held.append((*now, text[at : m.start()]))
        now, at = (int(m[1]), m[2]), m.end()
    return [*held, (*now, text[at:])]


def sections(pages: DataFrame) -> DataFrame:
    """(page_id, pos, level, title, body) of pages (page_id, html), as text; a null page, or an empty beginning, has no row."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            rows = [(i, k, *p) for i, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, p in enumerate(parts(html or ""))]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=["page_id", "pos", "level", "title", "body"])

    made = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id bigint, pos int, level int, title string, body string")
    text = made.select("page_id", "pos", "level", strip(H.stripped(F.col("title"))).alias("title"), H.stripped(F.col("body")).alias("body"))
    return text.where((F.col("level") > 0) | (F.col("body") != ""))
