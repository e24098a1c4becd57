"""Readers, sinks and stores on small files."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, stores


def written(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_price_panel_marks_faults(spark, tmp_path):
    lines = ["timestamp,ticker,adjusted_close,tradable,dollar_volume", "2025-01-02T16:00:00+00:00,AAA,100,,5", "2025-01-02T16:00:00+00:00,BBB,50,no,5", "2025-01-02T16:00:00,CCC,50,,5", "2025-01-02T16:00:00Z,,50,,5",
             "2025-01-02T16:00:00Z,DDD,-1,,", "2025-01-02T16:00:00Z,EEE,1,,", "2025-01-02T16:00:00Z,EEE,2,true,", "2025-01-02T16:00:00Z,FFF,x,,"]
    rows = files.price_panel(spark, written(tmp_path / "p.csv", "\n".join(lines)))
    got = sorted((str(r["ticker"]), str(r["fault"])) for r in rows.collect())
    assert got == sorted([("AAA", "None"), ("CCC", "NO_ZONED_TIME"), ("None", "NO_TICKER"), ("DDD", "NO_POSITIVE_CLOSE"), ("EEE", "DUPLICATE"), ("EEE", "DUPLICATE"), ("FFF", "NO_POSITIVE_CLOSE")])
    assert files.accepted(rows).count() == 1
    with pytest.raises(ValueError, match="adjusted_close"):
        files.price_panel(spark, written(tmp_path / "q.csv", "timestamp,ticker\n"))


def test_manifest_and_sectors(spark, tmp_path):
    path = written(tmp_path / "m.csv", "ticker,name,path\n1,A,x.html\n1,A,y.html\n2,B,z.html\n2,C,w.html\n")
    got = {r["ticker"]: (r["name"], len(r["documents"]), r["fault"]) for r in files.universe_manifest(spark, path, ("name",), ("path",)).collect()}
    assert got["000001"] == ("A", 2, None) and got["000002"][1:] == (2, "INCONSISTENT_NAME")
    path = written(tmp_path / "s.csv", "ticker,sector,effective_from,effective_to,published_at\n5,X,2020-01-01,,2020-02-01T00:00:00Z\n6,Y,2020-05-01,2020-01-01,2020-02-01T00:00:00Z\n7,,2020-05-01,,2020-02-01T00:00:00Z\n")
    assert {r["ticker"]: r["fault"] for r in files.sector_records(spark, path).collect()} == {"000005": None, "000006": "ENDS_BEFORE_START", "000007": "NO_TICKER_OR_SECTOR"}


def test_market_values_snapshots_and_sessions(spark, tmp_path):
    for year in (2020, 2021):
        spark.createDataFrame([(5, f"{year}-03-0{d}", 1.0, 2.0) for d in (2, 3)] + [(123456, f"{year}-03-02", 3.0, 4.0)], "Code long, Date string, Close double, Marcap double").write.parquet(str(tmp_path / f"{year}"))
    paths = [str(tmp_path / str(y)) for y in (2020, 2021)]
    rows = files.market_values(spark, paths, ("Close",), spark.createDataFrame([("000005",)], "ticker string"))
    assert rows.count() == 4 and {str(r["last_date"]) for r in rows.collect()} == {"2021-03-03"}
    assert [r["number"] for r in files.trading_sessions(rows, "date", 2020, 2021).orderBy("session").collect()] == [1, 2, 3, 4]
    written(tmp_path / "77_2020_3.csv", "account,amount\ncash,5\n")
    got = files.snapshots(spark, str(tmp_path / "*_*.csv"), month=True).first()
    assert (got["ticker"], got["fiscal_year"], got["fiscal_month"], got["amount"]) == ("000077", 2020, 3, "5")


def test_documents_archives_and_changes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    written(tmp_path / "d" / "a.html", '<meta charset="euc-kr">한글', "cp949")
    written(tmp_path / "d" / "b.html", "\ufeffplain é")
    read = lambda: spark.read.format("binaryFile").load(str(tmp_path / "d"))
    got = {r["path"][-6:]: r["text"] for r in files.documents(read()).collect()}
    assert got == {"a.html": '<meta charset="euc-kr">한글', "b.html": "plain é"}
    before = spark.createDataFrame(files.file_digests(spark, str(tmp_path / "d")).collect())
    written(tmp_path / "d" / "b.html", "other")
    written(tmp_path / "d" / "c.html", "new")
    assert {r["path"][-6:]: r["change"] for r in files.changed_files(before, files.file_digests(spark, str(tmp_path / "d"))).collect()} == {"b.html": "CHANGED", "c.html": "ADDED"}

    def archive(names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, b"x" * 10)
        return bytearray(out.getvalue())

    rows = spark.createDataFrame([("good", archive(["a/b.txt", "c.txt"])), ("bad", archive(["../e"])), ("big", archive(["a", "b", "c"])), ("none", bytearray(b"zzz"))], "path string, content binary")
    got = sorted((r["path"], r["member"] or "", r["fault"]) for r in files.members(rows, most_bytes=25).collect())
    assert got == [("bad", "", "UNSAFE_NAME"), ("big", "", "TOO_LARGE"), ("good", "a/b.txt", None), ("good", "c.txt", None), ("none", "", "NOT_AN_ARCHIVE")]


def test_reports_and_seals(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], 2.0), (2, [], None)], "id int, tags array<string>, v double")
    stores.write_csv(df, str(tmp_path / "r"))
    assert {(r["id"], r["tags"]) for r in spark.read.option("header", True).csv(str(tmp_path / "r")).collect()} == {("1", "a;b"), ("2", None)}
    stores.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    one, two = (stores.sealed(x, "id")[1].first() for x in (df, df.orderBy(F.desc("id"))))
    assert one == two and one["rows"] == 2 and one["distinct_keys"] == 2
    assert stores.sealed(df.withColumn("v", F.lit(3.0)), "id")[1].first()["seal"] != one["seal"]
    with pytest.raises(ValueError, match="outcome"):
        stores.sealed(df, "id", ("v",))
    stores.write_once(df, str(tmp_path / "s"))
    with pytest.raises(Exception, match="(?i)exists"):
        stores.write_once(df, str(tmp_path / "s"))
    assert [r["rank"] for r in stores.ranked(df, [], [F.desc("id")]).orderBy("id").collect()] == [2, 1]


def test_versions_ledger_and_replay(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *x: spark.createDataFrame(list(x), "source string, filing string, body string, at int")
    stores.save_versions(rows(("s", "f", "one", 1), ("s", "f", "one", 2), ("s", "g", "x", 1)), path, ["source", "filing"], "body", "at")
    stores.save_versions(rows(("s", "f", "two", 3), ("s", "g", "x", 9)), path, ["source", "filing"], "body", "at")
    assert spark.read.parquet(path).count() == 3
    got = {r["filing"]: (r["body"], r["supersedes"] is not None, r["intact"]) for r in stores.current_versions(spark, path, ["source", "filing"], "body", "at").collect()}
    assert got == {"f": ("two", True, True), "g": ("x", False, True)}

    t = lambda d: f"2025-01-0{d} 00:00:00"
    ledger = spark.sql(f"select 'A' ticker, 'e1' evidence_id, timestamp'{t(1)}' valid_from, cast(null as timestamp) valid_to, timestamp'{t(1)}' last_confirmed_at, 'old' fact union all select 'A', 'e2', timestamp'{t(1)}', null, timestamp'{t(1)}', 'kept'")
    merged = stores.merge_ledger(ledger, spark.createDataFrame([("A", "e1", "again"), ("A", "e3", "new")], "ticker string, evidence_id string, fact string"), t(5))
    assert {(r["evidence_id"], r["valid_from"].day, r["last_confirmed_at"].day, r["fact"]) for r in merged.collect()} == {("e1", 1, 5, "again"), ("e2", 1, 1, "kept"), ("e3", 5, 5, "new")}
    closed = stores.apply_relations(merged, spark.createDataFrame([("A", "e3", "e1", "UPDATES"), ("A", "e3", "e2", "CONTRADICTS"), ("A", "e3", "e3", "DUPLICATES")], "ticker string, from_id string, to_id string, relation string"), t(6))
    assert {(r["evidence_id"], r["superseded_by"], r["retracted_by"]) for r in closed.collect()} == {("e1", "e3", None), ("e2", None, "e3"), ("e3", None, None)}
    assert {r["evidence_id"] for r in stores.active(closed, t(7)).collect()} == {"e3"} and stores.active(closed, t(5)).count() == 3

    requests = spark.createDataFrame([("m", "p1"), ("m", "p2")], "model string, prompt string")
    keyed = stores.replayed(requests, spark.createDataFrame([], "key string, response string"), ["model", "prompt"])
    cache = keyed.filter("prompt = 'p1'").select("key", F.lit("answer").alias("response"))
    assert {r["prompt"]: r["status"] for r in stores.replayed(requests, cache, ["prompt", "model"]).collect()} == {"p1": "HIT", "p2": "MISS"}
