"""Pages as rows: blocks in order with their sections, table cells as a full grid, and notes with their tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.text import marked_unit, newest_period, number
from tidemark.shipping import ship_package

#: Tags without visible text, tags without an end, styles that hide, and what begins a note.
DROPPED = {"script", "style", "noscript", "template", "head"}
VOID = {"br", "img", "hr", "meta", "link", "input", "col", "source", "wbr", "area", "base", "embed", "track"}
HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
NOTE = r"^\s*(주\s*[0-9]+\)|주석\s*[:：]?|\*|※)"
BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "form", "address", "body", "table", "br", "hr", *(f"h{k}" for k in range(1, 7))}
#: Leading rows without a number that count as header, where no row is marked as one; and the largest span.
HEADER_ROWS, MAX_SPAN = 3, 1000
#: Characters of rows that a task holds before it passes them on, and what a row counts for beside its texts.
HELD, ROW = 4 << 20, 64
BLOCK_ROW = "seq int, kind string, level int, section string, text string"
NODE_ROW = BLOCK_ROW + ", header int, grid array<array<string>>"
CELL_ROW = "seq int, row int, col int, origin_row int, origin_col int, text string, header boolean, propagated boolean"


class _Page(HTMLParser):
    """Collects a page's blocks and, for tables, their rows of ``(text, rowspan, colspan, marked as header)``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, str, str]] = []
        self.tables: dict[int, list[list[tuple[str, int, int, bool]]]] = {}
        self.open: list[tuple[str, bool]] = []
        self.held: list[str] = []
        self.sections: list[tuple[int, str]] = []
        self.rows: list[list[tuple[str, int, int, bool]]] | None = None
        self.cell: tuple[int, int, bool] | None = None
        self.depth = 0

    def _hidden(self) -> bool:
        return any(hidden for _, hidden in self.open)

    def _text(self) -> str:
        out = " ".join("".join(self.held).split())
        self.held = []
        return out

    def _flush(self) -> None:
        text = self._text()
        if not text:
            return
        tags = [t for t, _ in self.open]
        heading = next((int(t[1]) for t in reversed(tags) if re.fullmatch("h[1-6]", t)), 0)
        if heading:
            self.sections = [s for s in self.sections if s[0] < heading] + [(heading, text)]
        kind = "heading" if heading else "list_item" if "li" in tags else "figure" if "figure" in tags else "paragraph"
        self._add(kind, heading, text)

    def _add(self, kind: str, level: int, text: str) -> None:
        self.blocks.append((kind, level, " > ".join(s for _, s in self.sections), text))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = dict(attrs)
        if tag == "table":
            if not self.depth and not self._hidden():
                self._flush()
                self.rows = []
            self.depth += 1
        elif self.depth == 1 and self.rows is not None and tag == "tr":
            self._end_cell()
            self.rows.append([])
        elif self.depth == 1 and self.rows is not None and tag in ("td", "th"):
            self._end_cell()
            span = lambda k: max(1, min(MAX_SPAN, int(re.match(r"\s*(\d+)|", named.get(k) or "")[1] or 1)))
            self.held, self.cell = [], (span("rowspan"), span("colspan"), tag == "th")
        elif not self.depth and tag in BLOCKS:
            self._flush()
            if tag == "img" and named.get("alt"):
                self._add("figure", 0, named["alt"])
        if self.depth and tag == "br":
            self.held.append(" ")
        if tag == "p":
            self._close("p")
        if tag not in VOID:
            self.open.append((tag, tag in DROPPED or "hidden" in named or bool(HIDDEN.search(named.get("style") or ""))))

    def _end_cell(self) -> None:
        if self.cell is not None and self.rows is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append((self._text(), *self.cell))
        self.cell = None

    def _close(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                return
            if tag == "p" and self.open[at][0] in BLOCKS:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            if self.depth == 1 and self.rows is not None:
                self._end_cell()
                self.tables[len(self.blocks)] = self.rows
                self._add("table", 0, " ".join(text for row in self.rows for text, *_ in row if text))
                self.rows, self.held = None, []
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self._end_cell()
        elif not self.depth and tag in BLOCKS:
            self._flush()
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self._hidden():
            self.held.append(data)

    def finish(self) -> _Page:
        self.close()
        self._flush()
        return self


def grid(rows: list[list[tuple[str, int, int, bool]]]) -> list[tuple[int, int, int, int, str, bool, bool]]:
    """Cells with their spans filled in: ``(row, col, origin row, origin col, text, header, propagated)``."""
    taken: dict[tuple[int, int], tuple[int, int, str, bool]] = {}
    for r, row in enumerate(rows):
        c = 0
        for text, down, across, marked in row:
            while (r, c) in taken:
                c += 1
            for i in range(r, min(r + down, len(rows))):
                for j in range(c, c + across):
                    taken.setdefault((i, j), (r, c, text, marked))
            c += across
    count = len(rows)
    heads: list[list[bool]] = [[] for _ in rows]
    for (r, _), (*_, head) in taken.items():
        heads[r].append(head)
    marked = [bool(row) and all(row) for row in heads]
    if not any(marked):
        for r in range(min(HEADER_ROWS, count - 1)):
            if any(re.search(r"\d", text) for (i, _), (_, _, text, _) in taken.items() if i == r):
                break
            marked[r] = True
    return [(r, c, o, p, text, marked[r], (r, c) != (o, p)) for (r, c), (o, p, text, _) in sorted(taken.items())]


def _parsed(pages: DataFrame, key: str, html: str, schema: str, rows_of) -> DataFrame:
    """The rows of each page; a task holds one Arrow batch of pages as it comes, and beside it one page and at most ``HELD`` characters of rows."""
    ship_package(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    told = f"`{key}` {kind}, {schema}"
    made = to_arrow_schema(T.StructType.fromDDL(told))
    texts, grids = ([at for at, part in enumerate(schema.split(", ")) if part.endswith(kind)] for kind in (" string", " array<array<string>>"))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[at] for r in rows], field.type) for at, field in enumerate(made)], schema=made)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for at in range(b.num_rows):
                k, page = b.column(0)[at].as_py(), _Page()
                page.feed(b.column(1)[at].as_py() or "")
                for row in rows_of(page.finish()):
                    rows.append((k, *row))
                    size += sum(len(row[c]) for c in texts) + ROW + sum(len(text) + ROW for c in grids for line in row[c] or () for text in line)
                    if size > HELD:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    return pages.select(key, html).mapInArrow(parse, told)


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key`` and ``BLOCK_ROW``: headings, paragraphs, list items, figures and tables in order, each with its path of sections."""
    return _parsed(pages, key, html, BLOCK_ROW, lambda page: [(i, *b) for i, b in enumerate(page.blocks)])


def _lines(rows: list[list[tuple[str, int, int, bool]]]) -> tuple[int | None, list[list[str]] | None]:
    """How many rows of a table are header, and the texts of its rows; nothing of a table without a cell."""
    lines: dict[int, list[str]] = {}
    heads = set()
    for r, _, _, _, text, head, _ in grid(rows):
        lines.setdefault(r, []).append(text)
        if head:
            heads.add(r)
    return (len(heads), list(lines.values())) if lines else (None, None)


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key`` and ``NODE_ROW``: ``blocks``, tables with their full grids, each page parsed once."""
    told = lambda page: [(i, *b, *(_lines(page.tables[i]) if i in page.tables else (None, None))) for i, b in enumerate(page.blocks)]
    return _parsed(pages, key, html, NODE_ROW, told)


def cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key``, ``CELL_ROW`` and ``value``: every cell of every table, ``seq`` being the table's block, with the number that it prints."""
    made = _parsed(pages, key, html, CELL_ROW, lambda page: [(i, *c) for i, rows in page.tables.items() for c in grid(rows)])
    return made.withColumn("value", F.when(~F.col("header"), number(F.col("text"))))


def column_paths(cells_: DataFrame, key: str = "page_id") -> DataFrame:
    """The path of header texts above each column of a table."""
    heads = cells_.filter("header and text <> ''").groupBy(key, "seq", "col").agg(F.array_sort(F.collect_set(F.struct("origin_row", "text"))).alias("h"))
    return heads.select(key, "seq", "col", F.array_join(F.array_distinct(F.col("h.text")), " > ").alias("path"))


def with_notes(blocks_: DataFrame, key: str = "page_id") -> DataFrame:
    """``blocks`` with ``table``, the block of the table that a note belongs to, and what its text says of unit and period.

    Notes and figures may stand between a table and its note; anything else ends its reach.
    """
    order = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    note = (F.col("kind") == "paragraph") & F.col("text").rlike(NOTE)
    anchor = F.when(~note & (F.col("kind") != "figure"), F.when(F.col("kind") == "table", F.col("seq")).otherwise(-1))
    before = F.last(anchor, ignorenulls=True).over(order)
    return blocks_.select("*", F.when(note & (before >= 0), before).alias("table"), marked_unit(F.col("text")).alias("unit"), newest_period(F.col("text"))["year"].alias("year"))
