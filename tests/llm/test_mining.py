"""Phrases, toxicity and spelling variants against SQL, held-out labels and brute force, with odd rows."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import phrases, toxicity, variants
from tidemark.llm.phrases import OP11_SQL, collocations, op11_phrases
from tidemark.llm.toxicity import Model, bags, fit_toxicity, score_toxicity
from tidemark.llm.variants import near_words, op13_variants, roots, spelling_variants
from tidemark.sources.tables import table

SF = "/root/testdata/sf0.01"


def in_sql(rows):
    con = duckdb.connect()
    con.register("documents", pa.table({"lang": pa.array([r[0] for r in rows], pa.string()), "text": pa.array([r[1] for r in rows], pa.string())}))
    return sorted(con.execute(OP11_SQL).fetchall())


def odd_texts(seed):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "City", "état", "x", "a-b", "1,000", "tab\tparted", "it's"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 7))) + rng.choice([".", "\n", ", ", ";", "!\r\n", " ", "  "])
    rows = [(rng.choice(["en", "en", "en", "de", None, "und"]), "".join(line() for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    rows += [("en", "new york city. " * 50), ("en", "new york city. " * 50), ("en", "same " * 400), (None, None), ("fr", ""), ("fr", " .;\t\n"), ("en", "w" * 5000 + " the of")]
    return rows


@pytest.mark.parametrize("settings", [{}, {"PART_BYTES": 300, "TRIGGER": 2, "FILTER_BITS": 64}, {"TRIGGER": 1, "SALTS": 2}, {"TRIGGER": 10**9}])
def test_phrases_of_odd_texts(spark, monkeypatch, settings):
    """Texts cut in parts, filters that let everything through, chunks of one word and of whole pieces: the same phrases."""
    for k, v in settings.items():
        monkeypatch.setattr(phrases, k, v)
    rows = odd_texts(len(settings))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, f int")
    got = sorted(tuple(r) for r in collocations(df).collect())
    assert got == in_sql(rows) and {r[0] for r in got} >= {"en", "und"}
    assert collocations(df.limit(0)).count() == 0


def test_phrases_rank_within_a_language(spark):
    rows = [("en", f"aa{k % 7} bb{k % 5}.") for k in range(3000)]
    best = collocations(spark.createDataFrame(rows, "lang string, text string"), top=3).orderBy("rank").collect()
    assert [tuple(r) for r in best] == [r for r in in_sql(rows) if r[1] <= 3]


def test_op11_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(tuple(r) for r in op11_phrases(spark, SF).collect()) == sorted(con.execute(OP11_SQL).fetchall())


def test_bags_against_a_loop():
    """Every n-gram of every word, once where it stands, in windows of words."""
    texts = ["A bad, BAD day", "", " . ", "x", "été " * 120, "one two"]
    b = bags(texts, width=48)
    counts = collections.Counter()
    for at, text in enumerate(texts):
        words = re.findall(r"[^\s.,]+", text.lower())
        for k, word in enumerate(words):
            for n in (3, 4, 5):
                counts[at, k // 48] += max(0, len(word) + 2 - n + 1)
    starts = {}
    for w, text in enumerate(b.text):
        starts[w] = (int(text), sum(1 for x in b.text[:w] if x == text))
    got = collections.Counter(starts[w] for w in b.window)
    assert got == collections.Counter({k: v for k, v in counts.items() if v})
    same = bags(["bad", "xx bad", "BAD."], width=1)
    assert {tuple(sorted(same.bucket[same.window == w])) for w in (0, 2, 3)} == {tuple(sorted(same.bucket[same.window == 0]))}


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").select("doc_id", "toxic")
    model = fit_toxicity(docs, labels)
    rows = score_toxicity(docs, model).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    caught = sum(r["predicted"] and r["toxic"] for r in held)
    assert caught >= 0.9 * sum(r["toxic"] for r in held) and caught >= 0.9 * sum(r["predicted"] for r in held)
    # spellings that no text has, in the words of a clean text
    clean = "The onerth it {} on thnt an ouha."
    low = model.logits([clean.format("thnt")])[0]
    assert low < 0 and all(model.logits([clean.format(w)])[0] > max(0, low) for w in ("stuupid", "moronn", "disgustng", "idiiot"))
    long = "thnt onerth it an ouha the " * 100_000
    assert model.logits([long])[0] < 0 < model.logits([long + "you stupid idiot, you moron " + long])[0]


def test_toxicity_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    words = ["plain", "words", "of", "every", "day", "talk", "about", "nothing"]
    rows = [(i, " ".join(rng.choice(words, 12)) + (" awful_slur" if i % 4 == 0 else "")) for i in range(400)]
    rows += [(None, None), (None, "awful_slur"), (1, None), (1, "plain words"), (7, ""), (8, "\n \n"), (9, "x" * 300_000)]
    docs = spark.createDataFrame([(*r, 0.5, 3) for r in rows], "doc_id long, text string, score double, bucket int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(1, None), (None, 1), (2, 1), (9999, 1)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    out = score_toxicity(docs, model)
    assert out.columns == ["doc_id", "text", "bucket", "score", "held_out", "predicted"] and out.count() == len(rows)
    got = out.collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["bucket"] == 3 for r in got)
    assert all(r["predicted"] for r in got if "awful_slur" in (r["text"] or "")) and not any(r["predicted"] for r in got if r["text"] in (None, "", "plain words", "\n \n"))
    assert all(r["held_out"] for r in got if r["doc_id"] is None)
    # held-out labels say nothing
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = fit_toxicity(docs, flipped)
    assert np.array_equal(again.weight, model.weight) and again.bias == model.bias
    # without both classes every score is the share of toxic ones
    for some, share in ((labels.filter("toxic = 0"), 0.0), (labels.limit(0), 0.0), (labels.filter("toxic = 1"), 1.0)):
        assert {round(r["score"], 6) for r in score_toxicity(docs, fit_toxicity(docs, some)).collect()} == {share}
    assert score_toxicity(docs.limit(0), model).count() == 0 and fit_toxicity(docs.limit(0), labels).bias < -20
    assert isinstance(model, Model)


def brute_variants(rows, slip):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            k = h % len(run)
            counts[run if h % slip else run[:k] + run[k + 1:]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and one_edit(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


@pytest.mark.parametrize("slip", [97, 3, 1])
def test_variants_against_brute_force(spark, monkeypatch, slip):
    """Runs of equal letters, letters beyond ASCII, ties, null ids and texts, and slips of every third run or of all."""
    monkeypatch.setattr(variants, "SLIP", slip)
    rng = random.Random(slip)
    stems = ["aaaaaa", "aaabaa", "abcdef", "abcde", "étéété", "straße", "ÉCOLES", "Zzzzzz", "x×y÷zz"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 12)):
            w = rng.choice(stems)
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abcé") + w[k + 1:], w[:k] + rng.choice("abz") + w[k:]])
            words.append(w)
        rows.append((rng.choice([i, None]), rng.choice([" ", "-", "1", "\n"]).join(words)))
    rows += [(1, None), (None, None), (2, ""), (3, "long " * 20_000 + "abcdef"), *[(4, "abcdef abcdeg")] * 9]
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n int, word string")
    got = {tuple(r) for r in spelling_variants(df).collect()}
    assert got == brute_variants(rows, slip) and any(r[1] for r in got)
    assert spelling_variants(df.limit(0)).count() == 0


def test_op13_against_brute_force(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    assert {tuple(r) for r in op13_variants(spark, "/root/testdata/sf0.001").collect()} == brute_variants(rows, 97)


def test_long_chains_of_forms(spark):
    """Each word one edit from the next and half as common; and a word with a neighbour for every letter."""
    chain = [("a" * (5 + k), 2**k) for k in range(30)]
    star = [("center", 10_000), *((f"cent{c}r", 3) for c in "abcdfghijklmnopqrstuvwxyz")]
    words = spark.createDataFrame(chain + star, "word string, n long")
    near = near_words(words)
    got = {r["word"]: r for r in near.collect()}
    assert got["center"]["n_near"] == 25 and got["center"]["form"] is None and got["centar"]["n_near"] == 25 and got["centar"]["form"] == "center"
    assert got["a" * 5]["n_near"] == 1 and got["a" * 6]["n_near"] == 2
    ends = {r["word"]: r["root"] for r in roots(near.filter("form is not null").select("word", "form")).collect()}
    assert {ends["a" * (5 + k)] for k in range(29)} == {"a" * 34} and ends["centar"] == "center"
