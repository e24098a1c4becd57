"""Chunks of documents for a reader with a budget of tokens: packed within sections, tables cut by row, column and cell.

Tables are array expressions, texts are cut in Arrow batches. Tokens are counted in quarters: a sign or an
ideograph has four, a word one for each letter and four at least; a text's
tokens are its quarters over four, rounded up. Quarters of texts parted by white
space or signs add up, so a table's slices are sized without being written.

* A text over the limit is cut into the longest pieces within it, each moved
  back to the last blank or line end if that is in the piece's second half.
* A table over the limit is cut into the longest runs of rows that fit with its
  header. A row that does not fit is cut into the longest runs of columns that
  fit with their headings, its first column repeated as the key. A cell that
  does not fit beside the key is cut like a text. A key that leaves less than
  ``ROOM`` of the limit is not repeated, and headings that might are rows.
* Pieces of one section are packed in order: a chunk ends before a piece of
  another section, before one that would take it over the limit, and once it has
  reached its target.

Defined results: null and blank texts and tables without a cell make no piece; a
null section is a section of its own; ties in ``order`` are ordered by text;
short rows are filled up with empty cells.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.arrays import let
from tidemark.functions.text import PIECE
from tidemark.operators.budget import batches
from tidemark.shipping import ship_package
from tidemark.sources.scratch import materialize

#: The least share of the limit that repeated headers and keys leave to a slice.
ROOM = 0.25


def quarters(text: Column) -> Column:
    """Quarters of tokens of a text."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), F.lit(0).cast("long"), lambda acc, p: acc + F.greatest(F.lit(4), F.length(p)))


def tokens(q: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(q / 4).cast("long"))


def spans(text: Column, budget: Column, word: int) -> Column:
    """Start and end (exclusive) of the pieces of ``text`` that have at most ``budget`` quarters; ``word`` letters have at most a quarter of that."""
    parts = F.regexp_extract_all(text, F.lit(rf"[A-Za-z0-9_]{{1,{word}}}|[^A-Za-z0-9_]"), F.lit(0))
    pairs = lambda edge: F.transform(F.slice(edge, 1, F.size(edge) - 1), lambda x, k: F.struct(x.alias("start"), F.get(edge, k + 1).alias("end")))
    edges = lambda cuts: F.array_distinct(F.concat(F.array(F.lit(0)), cuts, F.array(F.length(text))))
    # bound once: a budget that is worked out from the row is not worked out again for each word
    return let(let(let(budget, lambda most: _cuts(parts, most)), edges), pairs)


def _cuts(parts: Column, budget: Column) -> Column:
    """Where pieces end, but for the last, of the words and signs ``parts``."""
    weight = lambda blank, n: F.when(blank | (n == 0), 0).otherwise(F.greatest(F.lit(4), n))

    def fitted(acc: Column) -> Column:
        """Ends a piece if what is left of the current word would take it over the budget."""
        over = acc["used"] + weight(acc["blank"], acc["left"]) > budget
        room = budget - acc["used"]
        take = F.when((acc["left"] > 1) & (room >= 4), F.least(room, acc["left"] - 1)).otherwise(0).cast("int")
        best = acc["at"] + take
        back = acc["mark"] > acc["start"] + F.floor((best - acc["start"]) / 2)
        cut = F.when(back, acc["mark"] + 1).otherwise(best).cast("int")
        ended = _state(
            cut, F.when(back, acc["at"]).otherwise(best).cast("int"), F.when(back, acc["since"]).otherwise(0).cast("int"), F.lit(-1), F.lit(0),
            F.when(back, acc["left"]).otherwise(acc["left"] - take).cast("int"), acc["blank"], F.concat(acc["cuts"], F.array(cut)),
        )
        return F.when(over, ended).otherwise(acc)

    def step(acc: Column, part: Column) -> Column:
        blank = part.isin(" ", "\n", "\t", "\r", "\f", "\x0b")
        begun = _state(acc["start"], acc["at"], acc["used"], acc["mark"], acc["since"], F.length(part), blank, acc["cuts"])

        def placed(a: Column) -> Column:
            w, stop = weight(a["blank"], a["left"]).cast("int"), part.isin(" ", "\n")
            marked = stop & (a["at"] > a["start"])
            return _state(
                a["start"], (a["at"] + a["left"]).cast("int"), (a["used"] + w).cast("int"), F.when(marked, a["at"]).otherwise(a["mark"]), F.when(marked, 0).otherwise(a["since"] + w).cast("int"), F.lit(0), F.lit(False), a["cuts"],
            )

        # a word can end a piece by its mark, and the next one within itself
        return let(let(let(begun, fitted), fitted), placed)

    zero = F.lit(0)
    start = _state(zero, zero, zero, F.lit(-1), zero, zero, F.lit(False), F.array().cast("array<int>"))
    return F.aggregate(parts, start, step, lambda acc: acc["cuts"])


def _state(start: Column, at: Column, used: Column, mark: Column, since: Column, left: Column, blank: Column, cuts: Column) -> Column:
    values = {"start": start, "at": at, "used": used, "mark": mark, "since": since, "left": left}
    return F.struct(*(v.cast("int").alias(k) for k, v in values.items()), blank.alias("blank"), cuts.alias("cuts"))


def _shown(cell: Column) -> Column:
    """A cell as it is written: signs that part cells are escaped, line ends become breaks."""
    return F.when(cell == "", " ").otherwise(F.replace(F.replace(cell, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")))


def _barred(shown: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(shown, " | "), F.lit(" |"))


def _line(cells: Column) -> Column:
    return _barred(F.transform(cells, _shown))


def _written(head: Column, lines: Column) -> Column:
    """Header rows, the line below them, and lines."""
    below = F.when(F.size(head) > 0, F.array(_barred(F.array_repeat(F.lit("---"), F.size(F.get(head, 0)))))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.transform(head, _line), below, lines), "\n")


_COUNTED, _BLANKS = re.compile(PIECE, re.ASCII), frozenset(" \n\t\r\f\x0b")
#: Characters of pieces that a task holds before it passes them on.
HELD = 4 << 20


def counted(text: str) -> int:
    """``quarters`` of a text in a task."""
    return sum(max(4, len(p)) for p in _COUNTED.findall(text))


def cut_at(text: str, budget: int, word: int) -> list[tuple[int, int]]:
    """``spans`` of a text in a task, by the same steps."""
    cuts: list[int] = []
    start = at = used = since = 0
    mark = -1
    for part in re.findall(rf"[A-Za-z0-9_]{{1,{word}}}|[^A-Za-z0-9_]", text):
        left, blank = len(part), part in _BLANKS
        w = 0 if blank else max(4, left)
        # a word can end a piece by its mark, and the next one within itself
        for _ in range(2):
            if used + w <= budget:
                break
            take = min(budget - used, left - 1) if left > 1 and budget - used >= 4 else 0
            best = at + take
            if mark > start + (best - start) // 2:
                start, used = mark + 1, since
            else:
                start = at = best
                used, left = 0, left - take
                w = 0 if blank else max(4, left)
            mark, since = -1, 0
            cuts.append(start)
        if (part == " " or part == "\n") and at > start:
            mark, since = at, 0
        else:
            since += w
        at, used = at + left, used + w
    edges = list(dict.fromkeys([0, *cuts, len(text)]))
    return list(zip(edges, edges[1:], strict=False))


def text_pieces(nodes: DataFrame, most: int) -> DataFrame:
    """Pieces of the texts of ``nodes(doc, order, section, kind, text)``: with ``sub``, ``start`` and ``end``, as text and quarters.

    A text is cut in the task that reads it: as an expression, a step for each
    word makes a new state of all its fields, which takes many times as long.
    """
    ship_package(nodes.sparkSession)
    kinds = dict(nodes.dtypes)
    told = f"doc {kinds['doc']}, order {kinds['order']}, sub long, section {kinds['section']}, kind string, text string, q long, start int, end int"
    made = to_arrow_schema(T.StructType.fromDDL(told))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[at] for r in rows], field.type) for at, field in enumerate(made)], schema=made)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for at in range(b.num_rows):
                doc, order, section, kind, text = (c[at].as_py() for c in b.columns)
                q = counted(text)
                pieces = [(0, len(text))] if max(1, -(-q // 4)) <= most else cut_at(text, 4 * most, most)
                if len(pieces) == 1:
                    rows.append((doc, order, 0, section, kind, text, q, 0, len(text)))
                else:
                    named = None if kind is None else f"{kind}_fragment"
                    rows += [(doc, order, sub, section, named, text[s:e], counted(text[s:e]), s, e) for sub, (s, e) in enumerate(pieces)]
                size += len(text) + 64 * len(pieces)
                if size > HELD:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    return nodes.filter(F.btrim("text") != "").select("doc", "order", "section", "kind", "text").mapInArrow(cut, told)


def table_pieces(tables: DataFrame, most: int) -> DataFrame:
    """Pieces of ``tables(doc, order, section, header, grid)``, ``grid`` being rows of cells, the first ``header`` of them headings.

    ``start`` and ``end`` tell the body rows of a slice, the columns of a column
    slice, and the characters of a fragment of a cell, with ``row`` and ``column``.
    """
    limit = F.lit(4 * most)
    wide = F.array_max(F.transform("grid", F.size))
    filled = lambda r: F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.coalesce(F.get(r, k), F.lit("")))
    square = tables.withColumn("width", wide).filter("width > 0").withColumn("grid", F.transform("grid", filled))
    header = F.least(F.coalesce("header", F.lit(0)), F.size("grid")).cast("int")
    split = square.withColumn("head", F.slice("grid", 1, header)).withColumn("body", F.slice("grid", header + 1, F.size("grid")))
    # a line of n cells has n + 1 bars, and the line below the header three signs a cell besides
    row_q = lambda r: quarters(_line(r))
    below = F.when(F.size("head") > 0, 12 * F.col("width") + 4 * (F.col("width") + 1)).otherwise(0).cast("long")
    told = split.withColumn("rows_q", F.transform("body", row_q)).withColumn("head_q", F.aggregate(F.transform("head", row_q), F.lit(0).cast("long"), lambda a, x: a + x) + below)
    # headings that leave too little room beside a key and its own are rows like others
    tall = lambda k: F.aggregate(F.transform("head", lambda h: quarters(_shown(F.get(h, k))) + 8), F.lit(28).cast("long"), lambda a, x: a + x)
    repeats = (F.size("head") > 0) & (2 * F.array_max(F.transform(F.sequence(F.lit(0), F.col("width") - 1), tall)) <= (1 - ROOM) * limit)
    repeats = repeats & ((F.size("body") > 0) | (F.col("head_q") <= limit))
    told = told.withColumn("repeats", F.coalesce(repeats, F.lit(False))).withColumn("lead", F.when(F.col("repeats"), F.col("head")).otherwise(F.array().cast("array<array<string>>")))
    told = told.withColumn("lead_q", F.when(F.col("repeats"), F.col("head_q")).otherwise(0).cast("long")).withColumn("body", F.when(F.col("repeats"), F.col("body")).otherwise(F.concat("head", "body")))
    told = told.withColumn("rows_q", F.transform("body", row_q))
    numbered = told.withColumn("batch", batches(F.col("rows_q"), limit - F.col("lead_q")))
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.array_max("batch"), F.lit(0))),
        lambda b: F.struct((F.array_position("batch", b) - 1).cast("int").alias("start"), (F.array_position("batch", b) - 1 + F.size(F.filter("batch", lambda x: x == b))).cast("int").alias("end")),
    )
    # a table of headings alone is one slice without rows
    alone = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))
    sliced = numbered.select("doc", "order", "section", "width", "lead", "lead_q", "body", F.posexplode(F.when(F.size("body") > 0, runs).otherwise(alone)).alias("run", "r"), F.size(runs).alias("n"))
    sliced = sliced.withColumn("rows", F.slice("body", F.col("r.start") + 1, F.col("r.end") - F.col("r.start")))
    sliced = sliced.withColumn("q", F.col("lead_q") + F.aggregate(F.transform("rows", row_q), F.lit(0).cast("long"), lambda a, x: a + x))
    # three kinds of slices are made of these
    sliced = materialize(sliced, "slices")
    fits = F.col("q") <= limit
    kind = F.when(F.col("n") == 1, "table").otherwise("table_slice")
    place = lambda run, sub: (F.col(run).cast("long") * F.lit(1 << 40) + sub).cast("long").alias("sub")
    whole = sliced.filter(fits).select("doc", "order", place("run", F.lit(0)), "section", kind.alias("kind"), _written(F.col("lead"), F.transform("rows", _line)).alias("text"), "q", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.col("r.start").alias("row"), F.lit(None).cast("int").alias("column"))

    # one row over the limit: columns beside the key, the first column
    one = sliced.filter(~fits).withColumn("cells", F.get("rows", 0)).drop("rows")
    column_q = lambda k: (
        F.aggregate(F.transform("lead", lambda h: quarters(_shown(F.get(h, k))) + 4), F.lit(0).cast("long"), lambda a, x: a + x) + F.when(F.size("lead") > 0, 16).otherwise(0) + quarters(_shown(F.get(F.col("cells"), k))) + 4
    )
    bars = 4 * (F.size("lead") + 1) + F.when(F.size("lead") > 0, 4).otherwise(0)
    keyed = one.withColumn("key_q", column_q(F.lit(0)) + bars)
    # alone, or too long to be repeated, the first column is cut like any other
    keyed = keyed.withColumn("keyed", (F.col("width") > 1) & (F.col("key_q") <= (1 - ROOM) * limit)).withColumn("base", F.when(F.col("keyed"), F.col("key_q")).otherwise(bars).cast("long"))
    first = F.when(F.col("keyed"), 1).otherwise(0)
    keyed = keyed.withColumn("columns", F.sequence(first, F.col("width") - 1)).withColumn("columns_q", F.transform("columns", column_q))
    keyed = keyed.withColumn("batch", batches(F.col("columns_q"), limit - F.col("base")))
    held = lambda b: F.filter("columns", lambda c: F.get("batch", c - F.get("columns", F.lit(0))) == b)
    groups = keyed.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.array_max("batch")), held)).alias("group", "own"))
    lead_only = F.when(F.col("keyed"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    groups = groups.withColumn("shown", F.concat(lead_only, "own")).withColumn("own_q", F.aggregate(F.transform("own", column_q), F.lit(0).cast("long"), lambda a, x: a + x))
    picked = lambda r: F.transform("shown", lambda k: F.get(r, k))
    inside = F.col("base") + F.col("own_q") <= limit
    sub = lambda extra: place("run", F.col("group").cast("long") * F.lit(1 << 20) + extra + 1)
    own_first, own_last = F.get("own", F.lit(0)), F.element_at("own", -1) + 1
    columns = groups.filter(inside).select("doc", "order", sub(F.lit(0)), "section", F.lit("table_column_slice").alias("kind"), _written(F.transform("lead", picked), F.array(_line(picked(F.col("cells"))))).alias("text"), (F.col("base") + F.col("own_q")).alias("q"), own_first.alias("start"), own_last.alias("end"), F.col("r.start").alias("row"), own_first.alias("column"))

    # one cell over the limit: its text in pieces, beside the key and below the header if they leave room
    long = groups.filter(~inside).withColumn("column", own_first).withColumn("cell", F.get("cells", F.col("column")))
    around = F.col("base") + F.col("own_q") - quarters(_shown(F.col("cell")))
    long = long.withColumn("bare", around > (1 - ROOM) * limit)
    long = long.withColumn("budget", F.when(F.col("bare"), limit - 8).otherwise(limit - around).cast("int"))
    # as it is written, but with blanks for line ends
    long = long.withColumn("cell", _shown(F.replace("cell", F.lit("\n"), F.lit(" "))))
    cut = long.withColumn("cuts", spans(F.col("cell"), F.col("budget"), max(1, int(most * ROOM)))).select("*", F.posexplode("cuts").alias("part", "s"))
    part = F.substring("cell", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    keys = F.transform(lead_only, lambda k: _shown(F.get("cells", k)))
    bare = F.col("bare")
    head = F.when(bare, F.array().cast("array<array<string>>")).otherwise(F.transform("lead", picked))
    text = _written(head, F.array(_barred(F.when(bare, F.array(part)).otherwise(F.concat(keys, F.array(part))))))
    fragments = cut.select("doc", "order", sub(F.col("part").cast("long")), "section", F.lit("table_cell_fragment").alias("kind"), text.alias("text"), quarters(text).alias("q"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("r.start").alias("row"), "column")
    return whole.unionByName(columns).unionByName(fragments)


def packed(pieces: DataFrame, target: int, most: int) -> DataFrame:
    """``(doc, chunk, section, kind, pieces, first, last, tokens, text)``: ``pieces(doc, order, sub, section, kind, text, q)`` packed in order."""
    order = F.array_sort(F.collect_list(F.struct("order", "sub", "section", "kind", "text", "q")))
    listed = pieces.groupBy("doc").agg(order.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        t = tokens(x["q"])
        ends = (acc["used"] > 0) & (~acc["section"].eqNullSafe(x["section"]) | (acc["used"] + t > most) | (acc["used"] >= target) | acc["full"])
        at = acc["at"] + ends.cast("int")
        return F.struct(at.alias("at"), (F.when(ends, 0).otherwise(acc["used"]) + t).cast("long").alias("used"), x["section"].alias("section"), (t >= most).alias("full"), F.concat(acc["out"], F.array(at)).alias("out"))

    small = F.transform("p", lambda x: F.struct(x["section"].alias("section"), x["q"].alias("q")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("used"), F.lit(None).cast(dict(pieces.dtypes)["section"]).alias("section"), F.lit(False).alias("full"), F.array().cast("array<int>").alias("out"))
    numbers = F.aggregate(small, start, step, lambda acc: acc["out"])
    each = listed.select("doc", F.arrays_zip(F.col("p"), numbers.alias("c")).alias("z")).select("doc", F.inline("z"))
    inner = F.array_sort(F.collect_list(F.struct("p.order", "p.sub", "p.section", "p.kind", "p.text", "p.q")))
    grouped = each.groupBy("doc", F.col("c").alias("chunk")).agg(inner.alias("p"))
    kinds = F.array_distinct(F.col("p.kind"))
    text = F.array_join(F.col("p.text"), "\n\n")
    return grouped.select(
        "doc", "chunk", F.get("p", F.lit(0))["section"].alias("section"), F.when(F.size(kinds) == 1, F.get(kinds, 0)).otherwise("mixed").alias("kind"), F.size("p").alias("pieces"),
        F.get("p", F.lit(0))["order"].alias("first"), F.element_at("p", -1)["order"].alias("last"), tokens(F.aggregate(F.col("p.q"), F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"), text.alias("text"),
    )


def semantic_chunks(nodes: DataFrame, target: int = 1500, most: int = 2500) -> DataFrame:
    """``packed`` over all pieces of ``nodes(doc, order, section, kind, text, header, grid)``; a node with a ``grid`` is a table."""
    if not 0 < target <= most:
        raise ValueError("the target must be above zero and within the limit")
    columns = ["doc", "order", "sub", "section", "kind", "text", "q"]
    # read for texts and for tables, so they are made once
    nodes = materialize(nodes, "nodes")
    texts = text_pieces(nodes.filter("grid is null"), most).select(*columns)
    return packed(texts.unionByName(table_pieces(nodes.filter("grid is not null"), most).select(*columns)), target, most)
