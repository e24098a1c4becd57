"""Queries over texts, pages and event streams in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import TOKEN
from tidemark.sources import html
from tidemark.sources.scratch import materialize
from tidemark.sources.tables import table
from tidemark.streaming import events as streams

#: Fixed values of the ranking function, and results a question.
K1, B, TOP = 1.5, 0.75, 12
#: Questions by lane; a token counts as often as it is asked.
QUESTIONS = {"english": "the of and to", "french": "la les des et", "german": "der die und fur"}


def token_counts(spark, sf_dir: str) -> DataFrame:
    """Words, Hangul runs and numbers of each text, and how many differ."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TOKEN), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("distinct_tokens"))


def ranked_texts(spark, sf_dir: str) -> DataFrame:
    """The best texts of each lane by BM25; ties to the smaller id.

    Only tokens that some question asks for leave the scan, counted per text there.
    """
    asked = {q for text in QUESTIONS.values() for q in text.split()}
    rows = [(lane, t, text.split().count(t)) for lane, text in QUESTIONS.items() for t in sorted(set(text.split()))]
    questions = F.broadcast(spark.createDataFrame(rows, "lane string, token string, times int"))
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TOKEN), F.lit(0)).alias("t"))
    # one scan: each text's length and its asked tokens are written, and all else comes from that
    asked_in = F.filter("t", lambda x: x.isin(*sorted(asked)))
    scanned = materialize(tokens.select("doc_id", F.size("t").alias("length"), asked_in.alias("asked")), "asked")
    size = scanned.agg(F.count("*").alias("docs"), F.avg("length").alias("mean")).first()
    counted = scanned.select("doc_id", "length", F.explode("asked").alias("token")).groupBy("doc_id", "length", "token").agg(F.count("*").alias("tf"))
    df = F.broadcast(counted.groupBy("token").agg(F.count("*").alias("df")))
    scale = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(size["mean"] or 1.0))
    weight = F.log(1 + (F.lit(size["docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / scale * F.col("times")
    scored = counted.join(df, "token").join(questions, "token").groupBy("lane", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"))
    # the first cut within salted parts leaves TOP rows of each, so that no task sorts a lane
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    best = [F.desc("score"), "doc_id"]
    short = scored.withColumn("r", F.row_number().over(Window.partitionBy("lane", part).orderBy(*best))).filter(F.col("r") <= TOP)
    return short.withColumn("r", F.row_number().over(Window.partitionBy("lane").orderBy(*best))).filter(F.col("r") <= TOP).select("lane", F.col("r").alias("rank"), "doc_id", "score")


def links(spark, sf_dir: str) -> DataFrame:
    """Each page's link targets in order."""
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("place", "href"))


def headings(spark, sf_dir: str) -> DataFrame:
    """Each page's headings in order, as level and text between the tags."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)<h[1-6][^>]*>.*?</h[1-6]>"), F.lit(0))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("place", "h"))
    return rows.select("page_id", "place", F.substring("h", 3, 1).cast("int").alias("level"), F.regexp_replace("h", "<[^>]*>", "").alias("heading"))


def page_blocks(spark, sf_dir: str) -> DataFrame:
    """Each page's blocks in order: kind, level, path of sections, and the SHA-256 of the text."""
    found = html.blocks(table(spark, sf_dir, "pages"))
    return found.select("page_id", "seq", "kind", "level", F.sha2("section", 256).alias("section_sha256"), F.sha2("text", 256).alias("text_sha256"))


def block_counts(spark, sf_dir: str) -> DataFrame:
    """Visible blocks of each page by kind, and their characters."""
    return html.blocks(table(spark, sf_dir, "pages")).groupBy("page_id", "kind").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


def sessions(spark, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"))


def first_events(spark, sf_dir: str) -> DataFrame:
    return streams.first_of_hour(table(spark, sf_dir, "events"))


QUERIES = {
    "token_count": token_counts,
    "bm25_topk": ranked_texts,
    "html_links": links,
    "html_headings": headings,
    "html_blocks": page_blocks,
    "html_text": block_counts,
    "events_session": sessions,
    "events_dedup_watermark": first_events,
}

ORACLE_SQL = {
    "token_count": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z][A-Za-z0-9_-]*|[가-힣]{2,}|[0-9]+(?:\.[0-9]+)?') AS t FROM documents)
SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens FROM t""",
    "bm25_topk": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z][A-Za-z0-9_-]*|[가-힣]{2,}|[0-9]+(?:\.[0-9]+)?') AS t FROM documents),
s AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM t),
q AS (SELECT lane, unnest(string_split(text, ' ')) AS token FROM (VALUES ('english', 'the of and to'), ('french', 'la les des et'), ('german', 'der die und fur')) AS v(lane, text)),
w AS (SELECT doc_id, len(t) AS length, unnest(t) AS token FROM t),
c AS (SELECT doc_id, length, token, count(*) AS tf FROM w WHERE token IN (SELECT token FROM q) GROUP BY 1, 2, 3),
d AS (SELECT token, count(*) AS df FROM c GROUP BY 1),
x AS (SELECT lane, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score FROM c JOIN d USING (token) JOIN q USING (token), s GROUP BY 1, 2),
r AS (SELECT lane, row_number() OVER (PARTITION BY lane ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x)
SELECT * FROM r WHERE rank <= 12""",
    "html_links": r"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)
SELECT page_id, unnest(range(len(l)))::INTEGER AS place, unnest(l) AS href FROM l""",
    "html_headings": r"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '(?s)<h[1-6][^>]*>.*?</h[1-6]>') AS l FROM pages),
h AS (SELECT page_id, unnest(range(len(l)))::INTEGER AS place, unnest(l) AS h FROM l)
SELECT page_id, place, substr(h, 3, 1)::INTEGER AS level, regexp_replace(h, '<[^>]*>', '', 'g') AS heading FROM h""",
    "events_session": """
WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE AS joined FROM events),
s AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS events FROM s GROUP BY user_id, s""",
    "events_dedup_watermark": "SELECT user_id, event_type, date_trunc('hour', ts) AS hour, min(event_id) AS event_id, count(*) AS events FROM events GROUP BY 1, 2, 3",
}
