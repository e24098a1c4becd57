"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator; verdicts against plain loops."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tidemark.llm.licenses import scan_licenses
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mix_sources
from tidemark.llm.packing import pack_documents
from tidemark.llm.pii import find_pii
from tidemark.llm.quality import Condition, base_failed, features, fit_rules, judge_quality, rejected_by, text_statistics
from tidemark.llm.shingles import one_of_alike
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.tokens import count_tokens

#: Names that operators use inside, or have used.
CLASHING = ("_doc", "_digest", "_own", "_rows", "_words", "_lines", "_email", "_ip", "_card", "_iban", "_spaced", "_pieces", "_hits", "_source", "_name", "_n", "_parts", "_cdf", "_at", "_h", "_task", "digest", "node", "key", "n", "fp", "u", "v", "words", "i", "at", "copies")
LONG = "word " * 30_000 + "\n" + "a line that comes twice here\n" * 2
ROWS = [(1, "Plain words of one text with a mail a@b.co", "s"), (1, "Plain words of one text with a mail a@b.co", "s"), (2, None, None), (2, "", "s"), (None, "nobody has this id at all today", "t"), (None, "nobody has this id at all today", "t"), (3, LONG, "t"), (4, "under the MIT License\nx", "s")]


@pytest.fixture(scope="module")
def odd(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in CLASHING)])
    return spark.createDataFrame([(*r, *range(len(CLASHING))) for r in ROWS], schema)


ROW_WISE = {
    "pii": lambda df: find_pii(df),
    "quality": lambda df: judge_quality(df, [(Condition("words", True, 5.0),)]),
    "licenses": lambda df: scan_licenses(df),
    "lines": lambda df: dedup_lines(df),
    "tokens": lambda df: count_tokens(df),
}


@pytest.mark.parametrize("name", ROW_WISE)
def test_row_wise_operators(spark, odd, name):
    """Every row stays, with all its columns; equal rows get equal results."""
    out = ROW_WISE[name](odd)
    kept = [c for c in odd.columns if c not in ("text",) and c in out.columns]
    assert set(CLASHING) <= set(kept) and out.count() == len(ROWS)
    rows = [tuple(map(str, r)) for r in out.filter("doc_id = 1 or doc_id is null").collect()]
    assert len(rows) == 4 and len(set(rows)) == 2
    assert all(r[c] == k for r in out.select(*CLASHING).collect() for k, c in enumerate(CLASHING))
    empty = ROW_WISE[name](odd.limit(0))
    assert empty.columns == out.columns and empty.count() == 0


def test_grouping_operators(spark, odd):
    near = near_duplicates(odd)
    assert near.count() == len(ROWS) and near_duplicates(odd.limit(0)).count() == 0
    assert {r["component_id"] for r in near.filter("doc_id = 2").collect()} == {2}
    one = one_of_alike(odd)
    assert one.columns == odd.columns and sorted(str(r["doc_id"]) for r in one.collect()) == ["1", "2", "3", "4", "None"]
    assert one_of_alike(odd.limit(0)).count() == 0
    mixed = mix_sources(odd)
    assert set(odd.columns) <= set(mixed.columns) and mix_sources(odd.limit(0)).count() == 0
    assert pack_documents(odd).count() >= len(ROWS) and pack_documents(odd.limit(0)).count() == 0


def test_rows_of_one_id_that_differ_elsewhere_keep_one_for_good(spark):
    rows = [(1, "same words here", k) for k in (3, 1, 2)]
    got = {one_of_alike(spark.createDataFrame(rows[i:] + rows[:i], "doc_id long, text string, extra int")).first()["extra"] for i in range(3)}
    assert len(got) == 1


def test_pipeline_keeps_extra_columns(spark, odd):
    at = odd.withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, at, "/root/testdata/sf0.001")
        assert out.columns == at.columns, name
        at = corpus_pipeline.materialize(out, f"x_{name}")


def test_learned_verdicts_by_a_plain_loop(spark):
    """``kept`` and ``rule`` from the rules' own numbers."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rules = fit_rules(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    rules = rules or [(Condition("words", True, 300.0), Condition("symbols_per_word", False, 0.01)), (Condition("word_length", False, 3.0),)]
    named = features()
    for r in judge_quality(docs, rules).select("*", *(c.alias(f"f_{k}") for k, c in named.items())).collect():
        fits = [all(r[f"f_{c.feature}"] >= c.cut if c.at_least else r[f"f_{c.feature}"] <= c.cut for c in rule) for rule in rules]
        want = fits.index(True) + 1 if any(fits) else 0
        assert r["rule"] == want and r["kept"] == (not r["base_failed"] and want == 0)
    one = text_statistics(docs.limit(1)).select(base_failed().alias("f"), rejected_by([]).alias("r")).first()
    assert one["r"] == 0


def luhn(d):
    x = [int(c) for c in d[::-1]]
    return sum(x[0::2] + [sum(divmod(2 * v, 10)) for v in x[1::2]]) % 10 == 0


def added(text):
    """IBAN by remainder, social security numbers and shorter cards, by a plain loop with the score's parts."""
    words = {"iban": r"(?i)iban|bank|account", "ssn": r"(?i)\bssn\b|social security", "short_card": r"(?i)card|amex|diners|credit|payment"}
    near = lambda m, kind: 0.2 if re.search(words[kind], text[max(0, m.start() - 40) : m.start()] + "\n" + text[m.end() : m.end() + 40]) else 0.0
    out = []
    for m in re.finditer(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", text):
        code = m[0].replace(" ", "")
        digits = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
        if 15 <= len(code) <= 34 and int(digits) % 97 == 1 and 0.7 + near(m, "iban") >= 0.5:
            out.append(("iban", m.start(), m.end()))
    for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text):
        if not re.search(r"^(000|666|9)|-00-|-0000$", m[0]) and 0.3 + near(m, "ssn") >= 0.5:
            out.append(("ssn", m.start(), m.end()))
    for m in re.finditer(r"[0-9](?:[ -]?[0-9])+", text):
        digits = re.sub(r"\D", "", m[0])
        if 13 <= len(digits) <= 15 and luhn(digits) and 0.5 + near(m, "short_card") >= 0.5:
            out.append(("short_card", m.start(), m.end()))
    return out


def test_added_personal_data_by_a_plain_loop(spark):
    texts = ["bank GB82 WEST 1234 5698 7654 32 ok", "GB82WEST12345698765433", "DE89370400440532013000", "ssn 123-45-6789 and 000-12-3456, 666-12-3456", "123-45-6789", "amex 3782 822463 10005", "378282246310006", "30569309025904 x", "é 378282246310005"]
    for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got = [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] in ("iban", "ssn", "short_card")]
        assert got == added(r["text"]), r["text"]


def test_license_labels_are_those_of_the_own_text(spark):
    cc, plain = "This work is licensed under a Creative Commons Attribution 4.0 International License.", "plain words only"
    rows = [(None, cc), (None, plain), (5, cc), (5, plain), (5, cc), (6, None)]
    got = sorted((str(r["doc_id"]), r["text"] or "", r["found"], r["score"]) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("body", F.col("text")), "body").collect())
    assert got == sorted((str(i), t or "", ["cc"] if t == cc else [], 1.0 if t == cc else 0.0) for i, t in rows)


def test_rows_without_ids_are_mixed_each_on_its_own(spark):
    """Half of all rows have no id, a third of these equal texts; the weights hold, and copies are spread over partitions."""
    rows = [(k if k % 2 else None, f"text {k}" if k % 3 else "the same", "a" if k % 4 < 2 else "b") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mix_sources(df, spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double"))
    sizes = [r["count"] for r in mixed.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 1.3 * sum(sizes) / len(sizes)
    for null in (True, False):
        part = mixed.filter(F.col("doc_id").isNull() if null else F.col("doc_id").isNotNull())
        share = part.filter("source = 'a'").count() / part.count()
        assert abs(share - 0.75) < 0.04
    same = mixed.filter("text = 'the same' and doc_id is null and source = 'a'").groupBy("n_copies").count().count()
    assert same > 2


def test_many_sources_are_salted(spark, monkeypatch):
    """Beyond the bound of a broadcast the same copies come."""
    rows = [(k, f"t{k}", None if k % 3 == 0 else "hot" if k % 3 == 1 else f"s{k}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, mix_sources(df).collect()))
    monkeypatch.setattr("tidemark.llm.mixing.small", lambda *_: False)
    assert sorted(map(str, mix_sources(df).select(*mix_sources(df).columns).collect())) == want
