"""Text nodes of HTML pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import predicates as P
from ..functions import text as T

_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Elements that an opening tag of the same kind closes.
_ALONE = frozenset(("p", "li", "td", "th", "tr", "option", "dt", "dd"))
#: Characters of texts that a task holds before it hands them on, pages whole.
HELD = 1 << 22


class _Nodes(HTMLParser):
    """Collects (tag, text, start, end) of every text node; neighbouring character data is one node, markup of any kind is none.

    start and end are offsets of the node's source, in which characters may be written as references.
    """

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.nodes: list[tuple[str, str, int, int]] = []
        self.held: list[str] = []
        self.start = 0
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.size = len(source)
        self.feed(source)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _flush(self, end: int | None = None) -> None:
        if self.held:
            self.nodes.append((self.open[-1] if self.open else "", "".join(self.held), self.start, self._at() if end is None else end))
            self.held = []

    def handle_starttag(self, tag: str, attrs) -> None:
        self._flush()
        if tag in _ALONE and self.open and self.open[-1] == tag:
            self.open.pop()
        if tag not in _VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self._flush()

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_comment(self, data: str) -> None:
        self._flush()

    def handle_decl(self, decl: str) -> None:
        self._flush()

    def handle_pi(self, data: str) -> None:
        self._flush()

    def unknown_decl(self, data: str) -> None:
        self._flush()

    def handle_data(self, data: str) -> None:
        if not self.held:
            self.start = self._at()
        self.held.append(data)

    def close(self) -> None:
        super().close()
        self._flush(self.size)


def nodes_of(html: str | None) -> list[tuple[str, str]]:
    return [(tag, text) for tag, text, _, _ in _Nodes(html or "").nodes]


def with_nodes(html: str, texts: dict[int, str], skip: tuple[str, ...] = fixed.SKIPPED_TAGS) -> str:
    """The page with new texts for some nodes, numbered as text_nodes does; everything else stays as it is written."""
    out, at = [], 0
    nodes = [x for x in _Nodes(html).nodes if x[0] not in skip]
    for k, (_, _, start, end) in enumerate(nodes):
        if k in texts:
            out += [html[at:start], escape(texts[k], quote=False)]
            at = end
    return "".join([*out, html[at:]])


def node_batches(batches: Iterator[pa.RecordBatch], key: str, skip: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches (key, node_id, tag, text) of batches (key, html): pages are read one at a time, and nodes handed on when HELD is reached."""
    for batch in batches:
        own = batch.schema.field(key).type
        string = batch.schema.field("html").type
        made = lambda found: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (own, pa.int32(), string, string))], [key, "node_id", "tag", "text"])
        found, size = [], 0
        for k, source in zip(batch.column(key), batch.column("html")):
            for i, (tag, text) in enumerate(x for x in nodes_of(source.as_py()) if x[0] not in skip):
                found.append((k.as_py(), i, tag, text))
                size += len(text) + 64
            if size >= HELD:
                yield made(found)
                found, size = [], 0
        if found:
            yield made(found)


def text_nodes(pages: DataFrame, skip: tuple[str, ...] = fixed.SKIPPED_TAGS, key: str = "page_id") -> DataFrame:
    """(key, node_id, tag, prefix_ws, core, suffix_ws, translatable) of the text nodes of pages (key, html), those under skip left out."""
    nodes = pages.select(key, "html").mapInArrow(lambda batches: node_batches(batches, key, skip), f"{key} {dict(pages.dtypes)[key]}, node_id int, tag string, text string")
    before, core, after = T.outer_space(F.col("text"))
    return nodes.select(key, "node_id", "tag", before.alias("prefix_ws"), core.alias("core"), after.alias("suffix_ws"), P.html_text(core).alias("translatable"))


def replaced_nodes(nodes: DataFrame) -> DataFrame:
    """Adds new_text to nodes (prefix_ws, core, suffix_ws, translation): the translation on one line in the core's white space; null
    for a missing or empty one, whose node stays."""
    line = T.strip(T.one_line(F.col("translation")))
    return nodes.withColumn("new_text", F.when(F.col("translation") != "", T.rewrap(F.concat("prefix_ws", "core", "suffix_ws"), line)))


def rewritten_pages(pages: DataFrame, nodes: DataFrame, skip: tuple[str, ...] = fixed.SKIPPED_TAGS, key: str = "page_id") -> DataFrame:
    """(key, html, applied) of pages (key, html) with the new texts of nodes (key, node_id, new_text) put in.

    Nodes without a new text stay. Markup is copied as it is; a new text's '&', '<' and '>' become references. A null page stays null.
    """
    some = nodes.where("new_text is not null").groupBy(F.col(key).alias("__key")).agg(F.map_from_entries(F.collect_list(F.struct("node_id", "new_text"))).alias("texts"))
    both = pages.select(key, "html").join(some, F.col(key) == F.col("__key"), "left").select(key, "html", "texts")

    def write(batches):
        for batch in batches:
            schema = pa.schema([batch.schema.field(key), batch.schema.field("html"), pa.field("applied", pa.int64())])
            done, size = [], 0
            for k, source, some_ in zip(*(batch.column(c) for c in (key, "html", "texts"))):
                source, texts = source.as_py(), dict(some_.as_py() or ())
                done.append((k.as_py(), None if source is None else with_nodes(source, texts, skip), len(texts)))
                size += len(done[-1][1] or "")
                if size >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                    done, size = [], 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return both.mapInArrow(write, f"{key} {dict(pages.dtypes)[key]}, html string, applied long")


def image_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, page_no, width, height) of the divs of converted pages that have a size and a background image."""
    div = r"(?s)<div[^>]*id=\"page(\d+)-div\"[^>]*style=\"([^\"]*)\"[^>]*>[ \t\r\n]*<img"
    hits = F.arrays_zip(F.regexp_extract_all("html", F.lit(div), F.lit(1)).alias("no"), F.regexp_extract_all("html", F.lit(div), F.lit(2)).alias("style"))
    each = pages.select(key, F.explode(hits).alias("d"))
    sized = each.select(key, F.col("d.no").cast("int").alias("page_no"), T.css_pixels(F.col("d.style"), "width").alias("width"), T.css_pixels(F.col("d.style"), "height").alias("height"))
    return sized.where("width > 0 and height > 0")
