"""Chunks: the reader's rules by hand, and every piece and chunk against plain loops."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators.chunks import counted, cut_at, packed, quarters, semantic_chunks, spans, table_pieces, text_pieces
from tidemark.plans import reading
from tidemark.sources import html

PIECE = re.compile(r"[가-힣]|[一-龥]|[A-Za-z0-9_]+|[^\s]")
NODE = "doc long, order long, section string, kind string, text string, header int, grid array<array<string>>"


def weight(text):
    return sum(max(4, len(p)) for p in PIECE.findall(text))


def count(text):
    return max(1, math.ceil(weight(text) / 4))


def cut(text, budget):
    """The rule, one character at a time: the longest piece within the budget, back to a blank in its second half."""
    out, start = [], 0
    while start < len(text):
        end = start
        while end < len(text) and weight(text[start:end + 1]) <= budget:
            end += 1
        if end < len(text):
            mark = max(text.rfind(" ", start + 1, end), text.rfind("\n", start + 1, end))
            if mark > start + (end - start) // 2:
                end = mark + 1
        out.append((start, end))
        start = end
    return out


@pytest.mark.parametrize("seed", range(3))
def test_spans_against_a_loop(spark, seed):
    rng = random.Random(seed)
    parts = ["word", "a", "é", " ", "\n", "가나", ", ", "x" * 30, " long_" + "y" * 50, "12,3 ", "\t", "the end. "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["", " ", "z" * 400, "가" * 100]
    limit = 20
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", quarters(F.col("text")).alias("q"), spans(F.col("text"), F.lit(4 * limit), limit).alias("s")).collect()
    for r in rows:
        text, got = texts[r["id"]], [(x["start"], x["end"]) for x in r["s"]]
        assert r["q"] == weight(text)
        assert all(weight(text[a:b]) <= 4 * limit for a, b in got)
        assert "".join(text[a:b] for a, b in got) == text
        # words longer than the limit are cut at fixed places, where their parts may weigh a little more
        if not re.search(r"[A-Za-z0-9_]{21}", text):
            assert got == cut(text, 4 * limit)


def tables(spark, *grids, header=1):
    return spark.createDataFrame([(k, 0, "S", "table", None, header, g) for k, g in enumerate(grids)], NODE)


def test_rows_are_not_split_and_headers_repeat(spark):
    grid = [["Unit", "Product", "Sales"], *([f"parts {i}", f"product{i}", str(i * 100)] for i in range(1, 30))]
    out = semantic_chunks(tables(spark, grid), 100, 180).orderBy("chunk").collect()
    assert len(out) > 1 and all(r["kind"] == "table_slice" and r["tokens"] <= 180 and r["text"].startswith("| Unit | Product | Sales |\n| --- | --- | --- |\n") for r in out)
    assert [line for r in out for line in r["text"].split("\n")[2:]] == [f"| parts {i} | product{i} | {i * 100} |" for i in range(1, 30)]
    assert all(r["tokens"] == count(r["text"]) for r in out)


def test_wide_rows_are_cut_by_column(spark):
    grid = [["Kind", *(f"index{i}" for i in range(1, 41))], ["now", *(f"{i * 100:,}" for i in range(1, 41))]]
    out = table_pieces(tables(spark, grid), 180).orderBy("sub").collect()
    assert len(out) > 1 and {r["kind"] for r in out} == {"table_column_slice"}
    assert all(r["q"] <= 720 and r["q"] == weight(r["text"]) and r["text"].startswith("| Kind | ") for r in out)
    assert [k for r in out for k in range(r["start"], r["end"])] == list(range(1, 41))


@pytest.mark.parametrize("cells", [["Terms of shares", "Conversion", None, "1,000"], [None]])
def test_long_cells_are_cut_beside_their_key(spark, cells):
    told = "\n".join(f"condition {i}: terms | of exercise remain applicable." for i in range(200))
    row = [told if c is None else c for c in cells]
    grid = [["Category", "Kind", "Terms", "Amount"], row] if len(cells) > 1 else [row]
    out = table_pieces(tables(spark, grid, header=len(grid) - 1), 180).orderBy("sub").collect()
    parts = [r for r in out if r["kind"] == "table_cell_fragment"]
    assert len(parts) > 1 and all(r["q"] <= 720 and r["q"] == weight(r["text"]) for r in out)
    assert all(("Terms of shares" in r["text"]) == (len(cells) > 1) for r in parts)
    written = told.replace("\n", " ").replace("|", "\\|")
    assert [r["start"] for r in parts] == [0, *(r["end"] for r in parts[:-1])] and parts[-1]["end"] == len(written)
    assert {k for r in out if r["kind"] == "table_column_slice" for k in range(r["start"], r["end"])} == ({1, 3} if len(cells) > 1 else set())


def test_keys_and_headers_without_room(spark):
    long = "word " * 400
    for grid, header in (([[long, "b"], ["1", "2"]], 1), ([["a", "b"], [long, "2"]], 1), ([[long, long]], 0), ([["a", "b"]], 1), ([["", ""], []], 0)):
        out = table_pieces(tables(spark, grid, header=header), 50).collect()
        assert out and all(r["q"] <= 200 for r in out)
        text = " ".join(r["text"] for r in sorted(out, key=lambda r: r["sub"]))
        assert text.count("word") == sum(c.count("word") for row in grid for c in row)


def test_chunks_of_sections(spark):
    words = lambda n: " ".join(["abcd"] * n)
    nodes = [("A", words(40)), ("A", words(40)), ("A", words(40)), ("B", words(10)), ("A", words(250)), ("A", words(3)), (None, "x"), (None, ""), (None, None)]
    df = spark.createDataFrame([(1, k, s, "paragraph", t, None, None) for k, (s, t) in enumerate(nodes)], NODE)
    out = semantic_chunks(df, 60, 100).orderBy("chunk").collect()
    assert [(r["section"], r["tokens"]) for r in out] == [("A", 80), ("A", 40), ("B", 10), ("A", 100), ("A", 100), ("A", 53), (None, 1)]
    assert [r["kind"] for r in out] == ["paragraph"] * 3 + ["paragraph_fragment"] * 2 + ["mixed", "paragraph"]
    assert semantic_chunks(df.limit(0), 60, 100).count() == 0


def test_queries_lose_nothing(spark):
    sf = "/root/testdata/sf0.001"
    nodes = reading.page_nodes(spark, sf).collect()
    chunks = semantic_chunks(reading.page_nodes(spark, sf), 30, 50).collect()
    assert max(r["tokens"] for r in chunks) <= 50 and all(r["tokens"] == count(r["text"]) for r in chunks)
    words = lambda text: set(re.findall(r"\w+", text))
    for doc in {r["doc"] for r in nodes}:
        read = words(" ".join(r["text"] for r in chunks if r["doc"] == doc))
        assert set().union(*(words(r["text"]) for r in nodes if r["doc"] == doc and len(r["text"]) < 100)) <= read
    # a document's pieces, packed by a plain loop
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in reading.document_chunks(spark, sf).collect():
        got.setdefault(r["doc_id"], []).append((r["chunk"], r["tokens"], r["first"], r["last"]))
    for doc, text in docs.items():
        want, used, q = [], 0, 0
        for at, line in enumerate(text.split("\n")):
            for a, b in (cut(line, 4 * 2500) if count(line) > 2500 else [(0, len(line))]) if line.strip() else []:
                w = weight(line[a:b])
                t = max(1, math.ceil(w / 4))
                if not want or used + t > 2500 or used >= 1500:
                    want.append([at, at])
                    used = q = 0
                used, q, want[-1][1:] = used + t, q + w, [at, max(1, math.ceil((q + w) / 4))]
        assert sorted(got.get(doc, [])) == [(k, t, a, b) for k, (a, b, t) in enumerate(want)], doc


def test_texts_are_cut_in_tasks_as_the_expression_cuts_them(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "bc ", "word ", "\n", " ", "한", "中", ".", "x" * 30, "\t", "😀", " ", "é "]) for _ in range(rng.randint(1, 120))) for _ in range(150)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for budget, word in ((40, 10), (64, 16), (400, 100)):
        want = {r["i"]: ([(s["start"], s["end"]) for s in r["s"]], r["q"]) for r in rows.select("i", spans(F.col("t"), F.lit(budget), word).alias("s"), quarters(F.col("t")).alias("q")).collect()}
        for i, t in enumerate(texts):
            assert (cut_at(t, budget, word), counted(t)) == want[i]


def test_pages_are_parsed_once(spark):
    page = "<h1>T</h1><p>one</p><table><tr><th>a</th><th>b</th></tr><tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3</td></tr></table><table></table>"
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    made = html.nodes(pages)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = [tuple(r)[1:] for r in made.collect()]
    assert got == [
        (0, "heading", 1, "T", "T", None, None), (1, "paragraph", 0, "T", "one", None, None),
        (2, "table", 0, "T", "a b 1 2 3", 1, [["a", "b"], ["1", "2"], ["1", "3"]]), (3, "table", 0, "T", "", None, None),
    ]
