"""Readers of research files: price panels, manifests, sectors, snapshots, calendars and archives.

A reader never stops at a bad row: it gives the rows with a column that names
what is wrong with each, and ``accepted`` takes the others. So a load of any
size ends, and what was refused can be counted and shown.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.shipping import ship_package

#: What a price file writes for names that cannot be traded.
UNTRADABLE = ("0", "false", "no", "n")
#: Bounds of an archive: bytes and members.
ARCHIVE_BYTES, ARCHIVE_MEMBERS = 256 << 20, 10_000


def _csv(spark: SparkSession, path: str | list[str], required: tuple[str, ...], optional: tuple[str, ...] = ()) -> DataFrame:
    """All columns as trimmed text, blanks as null; missing optional ones are null."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    names = {c.lstrip("\ufeff"): c for c in rows.columns}
    lacking = sorted(set(required) - set(names))
    if lacking:
        raise ValueError(f"columns are missing: {lacking}")
    text = lambda c: F.nullif(F.trim(F.col(f"`{names[c]}`")), F.lit(""))
    return rows.select(*(text(c).alias(c) for c in required), *((text(c) if c in names else F.lit(None).cast("string")).alias(c) for c in optional))


def ticker(code: Column) -> Column:
    """A code as six digits or more."""
    return F.when(F.length(F.trim(code)) < 6, F.lpad(F.trim(code), 6, "0")).otherwise(F.trim(code))


def _flag(*faults: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for wrong, name in reversed(faults):
        out = F.when(wrong, name).otherwise(out)
    return out


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter("fault is null").drop("fault")


def price_panel(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(timestamp, ticker, adjusted_close, dollar_volume, fault)`` without names that cannot be traded.

    Times need a zone; a name's time that is given more than once is at fault in all its rows.
    """
    raw = _csv(spark, path, ("timestamp", "ticker", "adjusted_close"), ("tradable", "dollar_volume"))
    open_ = raw.filter(~F.lower(F.coalesce("tradable", F.lit("true"))).isin(*UNTRADABLE))
    zoned = F.col("timestamp").rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    typed = open_.select(F.when(zoned, F.expr("try_cast(timestamp as timestamp)")).alias("timestamp"), "ticker", *(F.expr(f"try_cast({c} as double)").alias(c) for c in ("adjusted_close", "dollar_volume")))
    times = F.count("*").over(Window.partitionBy("ticker", "timestamp"))
    return typed.withColumn("fault", _flag(
        (F.col("ticker").isNull(), "NO_TICKER"), (F.col("timestamp").isNull(), "NO_ZONED_TIME"), (F.coalesce(F.col("adjusted_close") <= 0, F.lit(True)), "NO_POSITIVE_CLOSE"), (F.col("dollar_volume") <= 0, "VOLUME_NOT_POSITIVE"), (times > 1, "DUPLICATE"),
    ))


def universe_manifest(spark: SparkSession, path: str, company: tuple[str, ...], document: tuple[str, ...]) -> DataFrame:
    """A company a row, ``documents`` being its files; columns of the company that disagree between its rows are at fault."""
    raw = _csv(spark, path, ("ticker", *company, *document))
    grouped = raw.groupBy(ticker(F.col("ticker")).alias("ticker")).agg(
        *(F.collect_set(c).alias(c) for c in company), F.array_sort(F.collect_list(F.struct(*document))).alias("documents"),
    )
    many = [(F.size(c) > 1, f"INCONSISTENT_{c.upper()}") for c in company]
    return grouped.withColumn("fault", _flag((F.col("ticker").isNull(), "NO_TICKER"), *many)).select("ticker", *(F.try_element_at(c, F.lit(1)).alias(c) for c in company), "documents", "fault")


def sector_records(spark: SparkSession, path: str) -> DataFrame:
    """Sectors with the days they hold, and when they were published; an end before the start is at fault."""
    raw = _csv(spark, path, ("ticker", "sector", "effective_from", "published_at"), ("effective_to",))
    typed = raw.select(ticker(F.col("ticker")).alias("ticker"), "sector", *(F.expr(f"try_cast({c} as date)").alias(c) for c in ("effective_from", "effective_to")), F.expr("try_cast(published_at as timestamp)").alias("published_at"))
    return typed.withColumn("fault", _flag((F.col("ticker").isNull() | F.col("sector").isNull(), "NO_TICKER_OR_SECTOR"), (F.col("effective_from").isNull() | F.col("published_at").isNull(), "NO_DATE"), (F.col("effective_to") < F.col("effective_from"), "ENDS_BEFORE_START")))


def market_values(spark: SparkSession, paths: list[str], columns: tuple[str, ...] = ("Close", "Marcap", "Stocks", "Amount"), names: DataFrame | None = None) -> DataFrame:
    """Yearly files as one table of ``ticker``, ``date`` and the columns asked for, for the tickers of ``names`` if given, with the last day of all."""
    rows = spark.read.parquet(*paths)
    lacking = sorted({"Code", "Date", *columns} - set(rows.columns))
    if lacking:
        raise ValueError(f"columns are missing: {lacking}")
    out = rows.select(ticker(F.col("Code").cast("string")).alias("ticker"), F.to_date("Date").alias("date"), *columns)
    bound = out.agg(F.max("date")).scalar()
    return (out.join(names.select("ticker").distinct(), "ticker", "left_semi") if names is not None else out).withColumn("last_date", bound)


def snapshots(spark: SparkSession, pattern: str, month: bool = False) -> DataFrame:
    """Files named ``<ticker>_<year>[_<month>].csv`` as one table, the key taken from each row's file."""
    name = r"([0-9A-Za-z]+)_([0-9]{4})" + (r"_([0-9]{1,2})" if month else "") + r"\.csv$"
    rows = spark.read.option("header", True).csv(pattern)
    at = F.col("_metadata.file_path")
    keys = {"ticker": ticker(F.regexp_extract(at, name, 1)), "fiscal_year": F.regexp_extract(at, name, 2).cast("int")} | ({"fiscal_month": F.regexp_extract(at, name, 3).cast("int")} if month else {})
    return rows.select("*", *(c.alias(k) for k, c in keys.items()))


def trading_sessions(rows: DataFrame, date: str, first_year: int, last_year: int) -> DataFrame:
    """Distinct days of the years asked for, numbered from 1; numbers come from counts by year, so that no task sorts all days."""
    days = rows.select(F.to_date(date).alias("session")).distinct().filter(F.year("session").between(first_year, last_year)).withColumn("y", F.year("session"))
    before = days.groupBy("y").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("y").orderBy("session"))
    return days.join(F.broadcast(before.select("y", "before")), "y").select("session", (F.col("before") + place).cast("long").alias("number"))


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """``(path, length, sha256)`` of files."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that were added, removed or changed between two ``file_digests``."""
    old, new = (x.select("path", F.col("sha256").alias(n)) for x, n in ((before, "old"), (after, "new")))
    change = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(F.col("old") != F.col("new"), "CHANGED")
    return old.join(new, "path", "full").select("path", change.alias("change")).filter("change is not null")


def decoded(content: bytes) -> str:
    """A page's text by its byte order mark, the charset it declares, UTF-8, or the Korean code page."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace")
    said = re.search(rb"""(?i)(?:charset|encoding)\s*=\s*["']?\s*([A-Za-z0-9._-]+)""", content[:4096])
    for name in ([said[1].decode("ascii").lower()] if said else []) + ["utf-8-sig", "cp949"]:
        try:
            return content.decode({"utf-8": "utf-8-sig", "utf8": "utf-8-sig", "euc-kr": "cp949", "ks_c_5601-1987": "cp949"}.get(name, name))
        except (LookupError, UnicodeDecodeError):
            continue
    return content.decode("utf-8", "replace")


def documents(files: DataFrame) -> DataFrame:
    """``(path, text)`` of ``files(path, content)``."""
    ship_package(files.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [decoded(bytes(c or b"")) for c in b["content"]]})

    return files.select("path", "content").mapInPandas(read, "path string, text string")


def members(archives: DataFrame, most_bytes: int = ARCHIVE_BYTES, most_members: int = ARCHIVE_MEMBERS) -> DataFrame:
    """``(path, member, content, fault)`` of ``archives(path, content)``; an archive over the bounds, or with a name that leads out of it, gives one row with a fault."""
    ship_package(archives.sparkSession)

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        infos = [i for i in z.infolist() if not i.is_dir()]
                        unsafe = any(i.filename.startswith(("/", "\\")) or ".." in i.filename.replace("\\", "/").split("/") for i in infos)
                        fault = "UNSAFE_NAME" if unsafe else "TOO_MANY_MEMBERS" if len(infos) > most_members else "TOO_LARGE" if sum(i.file_size for i in infos) > most_bytes else None
                        out += [(path, None, None, fault)] if fault else [(path, i.filename, z.read(i), None) for i in infos]
                except zipfile.BadZipFile:
                    out.append((path, None, None, "NOT_AN_ARCHIVE"))
            yield pd.DataFrame(out, columns=["path", "member", "content", "fault"])

    return archives.select("path", "content").mapInPandas(explode, "path string, member string, content binary, fault string")
