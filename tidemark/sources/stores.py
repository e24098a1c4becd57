"""Sinks and stores: reports as files, versions of filings, sealed sets, the evidence ledger and replayed answers.

Writers leave the commit to Spark, whose readers never see half a write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def flat(df: DataFrame) -> DataFrame:
    """Columns as a delimited file can hold them: arrays joined by ``;``, other nested values as JSON."""
    made = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        simple = kind == "array" and f.dataType.elementType.typeName() not in ("array", "struct", "map")
        made.append((F.array_join(f.name, ";") if simple else F.to_json(f.name) if kind in ("array", "struct", "map") else F.col(f.name)).alias(f.name))
    return df.select(*made)


def write_csv(df: DataFrame, path: str) -> None:
    """A report with a header in every file."""
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def ranked(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``rank`` from 1 within ``by``, as the first column."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).select("rank", *df.columns)


def row_hash(df: DataFrame) -> Column:
    """SHA-256 of a row's columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)


def sealed(df: DataFrame, key: str, forbidden: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows with ``row_sha256``, and one row ``(rows, distinct_keys, seal)`` that no order of rows changes.

    The seal is the hash of the buckets' hashes, a bucket's that of its rows' in
    the order of key and hash; so no task holds all hashes. Outcome columns that
    must not be known are refused.
    """
    known = sorted(set(forbidden) & set(df.columns))
    if known:
        raise ValueError(f"columns of the outcome: {known}")
    rows = df.withColumn("row_sha256", row_hash(df))
    pair = F.concat_ws("\t", F.col(key).cast("string"), "row_sha256")
    buckets = rows.groupBy(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 3).alias("b")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(pair)), "\n"), 256).alias("d"), F.count("*").alias("n"), F.count_distinct(F.col(key)).alias("k"),
    )
    seal = buckets.agg(F.sum("n").alias("rows"), F.sum("k").alias("distinct_keys"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", "d"))), "\n"), 256).alias("seal"))
    return rows, seal


def write_once(df: DataFrame, path: str) -> None:
    """A snapshot that may not be written again."""
    df.write.mode("errorifexists").parquet(path)


def save_versions(filings: DataFrame, path: str, keys: list[str], content: str, at: str) -> None:
    """Appends the versions of ``filings`` that the store at ``path`` does not hold; the same content is one version, whenever it arrives."""
    spark = filings.sparkSession
    order = Window.partitionBy(*keys, "version_sha256").orderBy(at)
    fresh = filings.withColumn("version_sha256", F.sha2(content, 256)).withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")
    if stored(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys, "version_sha256"), [*keys, "version_sha256"], "left_anti")
    fresh.write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def current_versions(spark: SparkSession, path: str, keys: list[str], content: str, at: str) -> DataFrame:
    """The latest version of each key, what it supersedes, and whether its content still has its hash."""
    order = Window.partitionBy(*keys).orderBy(at, "version_sha256")
    rows = spark.read.parquet(path).withColumn("supersedes", F.lag("version_sha256").over(order))
    last = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("version_sha256")))).filter("r = 1").drop("r")
    return last.withColumn("intact", F.sha2(content, 256) == F.col("version_sha256"))


def merge_ledger(ledger: DataFrame, current: DataFrame, as_of: str) -> DataFrame:
    """A ledger ``(ticker, evidence_id, valid_from, valid_to, last_confirmed_at, fact)`` with ``current(ticker, evidence_id, fact)`` seen at ``as_of``.

    New evidence is added, known evidence confirmed, all else carried.
    """
    at = F.lit(as_of).cast("timestamp")
    now = current.groupBy("ticker", "evidence_id").agg(F.min("fact").alias("seen"))
    both = ledger.join(now.withColumn("here", F.lit(True)), ["ticker", "evidence_id"], "full")
    return both.select(
        "ticker", "evidence_id", F.coalesce("valid_from", at).alias("valid_from"), "valid_to", F.when(F.col("here"), F.greatest(F.coalesce("last_confirmed_at", at), at)).otherwise(F.col("last_confirmed_at")).alias("last_confirmed_at"),
        F.coalesce("seen", "fact").alias("fact"),
    )


def apply_relations(ledger: DataFrame, relations: DataFrame, as_of: str) -> DataFrame:
    """Closes evidence that later evidence repeats, updates or contradicts: ``relations(ticker, from_id, to_id, relation)``."""
    closing = relations.filter(F.col("relation").isin("DUPLICATES", "UPDATES", "CONTRADICTS") & (F.col("from_id") != F.col("to_id")))
    one = closing.groupBy("ticker", F.col("to_id").alias("evidence_id")).agg(F.min(F.struct(F.col("relation") == "CONTRADICTS", "from_id")).alias("x"))
    joined = ledger.join(one, ["ticker", "evidence_id"], "left")
    against = F.col("x.col1")
    return joined.select(
        *(c for c in ledger.columns if c != "valid_to"), F.coalesce("valid_to", F.when(F.col("x").isNotNull(), F.lit(as_of).cast("timestamp"))).alias("valid_to"),
        F.when(~against, F.col("x.from_id")).alias("superseded_by"), F.when(against, F.col("x.from_id")).alias("retracted_by"),
    )


def active(ledger: DataFrame, as_of: str) -> DataFrame:
    """Evidence in force at a moment."""
    at = F.lit(as_of).cast("timestamp")
    return ledger.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def replayed(requests: DataFrame, cache: DataFrame, fields: list[str]) -> DataFrame:
    """``requests`` with the ``response`` that ``cache(key, response)`` holds for exactly these fields, and a status."""
    key = F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)
    met = requests.withColumn("key", key).join(cache.select("key", "response").dropDuplicates(["key"]), "key", "left")
    return met.withColumn("status", F.when(F.col("response").isNull(), "MISS").otherwise("HIT"))
