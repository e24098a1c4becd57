"""Blocks, grids and notes of small pages."""

import pyarrow as pa

from tidemark.sources import html
from tidemark.sources.html import blocks, cells, column_paths, with_notes

PAGE = """<html><head><title>no</title></head><body><h1>One</h1><p>First <b>bold</b> text<p>Second</p><script>x<y</script><div style="display:none">hidden</div>
<h2>Two</h2><ul><li>a</li><li>b <i>c</i></li></ul>
<table><tr><th rowspan=2>Name</th><th colspan="2">Year</th></tr><tr><th>2023</th><th>2024</th></tr><tr><td>Sales</td><td>1,200</td><td>(300)</td></tr><tr><td rowspan="2">Cost</td><td>5%</td><td>-</td></tr><tr><td>7</td></tr></table>
<figure><img src=x></figure><p>* a note (단위: 백만원) 2024년</p><p>plain</p><p>* late</p><h1>Three</h1>tail &amp; end</body></html>"""


def test_blocks_in_order_with_sections(spark):
    rows = blocks(spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>open")], "page_id long, html string")).orderBy("page_id", "seq").collect()
    got = [(r["kind"], r["section"], r["text"]) for r in rows if r["page_id"] == 1]
    assert got == [
        ("heading", "One", "One"), ("paragraph", "One", "First bold text"), ("paragraph", "One", "Second"), ("heading", "One > Two", "Two"), ("list_item", "One > Two", "a"), ("list_item", "One > Two", "b c"),
        ("table", "One > Two", "Name Year 2023 2024 Sales 1,200 (300) Cost 5% - 7"), ("paragraph", "One > Two", "* a note (단위: 백만원) 2024년"), ("paragraph", "One > Two", "plain"), ("paragraph", "One > Two", "* late"),
        ("heading", "Three", "Three"), ("paragraph", "Three", "tail & end"),
    ]
    assert [r["text"] for r in rows if r["page_id"] == 3] == ["open"] and not [r for r in rows if r["page_id"] == 2]


def test_grids_fill_spans(spark):
    made = cells(spark.createDataFrame([(1, PAGE)], "page_id long, html string"))
    got = {(r["row"], r["col"]): (r["text"], r["header"], r["propagated"], r["value"]) for r in made.collect()}
    assert len(got) == 14 and got[1, 0] == ("Name", True, True, None) and got[0, 2] == ("Year", True, True, None)
    assert got[2, 1] == ("1,200", False, False, 1200.0) and got[2, 2][3] == -300.0 and got[3, 1][3] == 0.05 and got[3, 2][3] is None and got[4, 0] == ("Cost", False, True, None) and got[4, 1][3] == 7.0
    assert {r["col"]: r["path"] for r in column_paths(made).collect()} == {0: "Name", 1: "Year > 2023", 2: "Year > 2024"}
    plain = "<table><tr><td>Item</td><td>Amount</td></tr><tr><td>a</td><td>1</td></tr></table>"
    assert [r["header"] for r in cells(spark.createDataFrame([(1, plain)], "page_id long, html string")).orderBy("row", "col").collect()] == [True, True, False, False]


def test_notes_find_their_table(spark):
    got = {r["text"][:6]: (r["table"], r["unit"], r["year"]) for r in with_notes(blocks(spark.createDataFrame([(1, PAGE)], "page_id long, html string"))).collect()}
    assert got["* a no"] == (6, "KRW_MILLION", 2024) and got["* late"][0] is None and got["plain"] == (None, None, None)


def test_rows_leave_a_task_in_small_batches(spark, monkeypatch):
    """One batch of many pages, some empty and some null, leaves in batches of bounded text; the last one too."""
    monkeypatch.setattr(html, "HELD", 500)
    pages = [(k, "".join(f"<p>{k} {i} {'x' * 90}</p>" for i in range(k % 7)) or None) for k in range(40)]
    df = spark.createDataFrame(pages, "page_id long, html string")
    want = [(k, i, f"{k} {i} {'x' * 90}") for k in range(40) for i in range(k % 7)]
    assert sorted((r["page_id"], r["seq"], r["text"]) for r in blocks(df).collect()) == want
    taken = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: taken.append(run))
    blocks(df)
    out = list(taken[0](iter([pa.RecordBatch.from_pydict({"page_id": [k for k, _ in pages], "html": [t for _, t in pages]})])))
    assert [(r["page_id"], r["seq"], r["text"]) for b in out for r in b.to_pylist()] == want
    assert max(b.num_rows for b in out) <= 4 and len(out) > 25
