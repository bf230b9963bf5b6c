"""Main text of HTML pages, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

SKIP = {"script", "style", "nav", "footer", "aside", "header", "noscript", "template"}
BLOCKS = {"p", "div", "section", "article", "li", "h1", "h2", "h3", "h4", "blockquote", "tr", "br"}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.inside, self.parts, self.main = 0, 0, [], []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in SKIP
        self.inside += tag in ("article", "main")
        if tag in BLOCKS:
            self.handle_data("\n")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in SKIP))
        self.inside = max(0, self.inside - (tag in ("article", "main")))
        if tag in BLOCKS:
            self.handle_data("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.inside:
                self.main.append(data)


def readable(html: str | None) -> str:
    """Text of the article if there is one, else of the body, without scripts, menus and footers."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    lines = (" ".join(x.split()) for x in "".join(reader.main or reader.parts).split("\n"))
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text) of (page_id, html)."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([readable(h.as_py()) for h in b.column(1)], pa.string())], ["page_id", "text"])

    return pages.mapInArrow(run, "page_id long, text string")
