"""The numbered operators against brute force on whole small tables."""

import hashlib
import re
import struct
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from tidemark.llm import neighbours, registry, shingles, simhash, urls
from tidemark.llm.licenses import TEMPLATES, scan_licenses
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mix_sources
from tidemark.llm.neighbours import nearest
from tidemark.llm.packing import match_runs, pack_documents
from tidemark.llm.pii import find_pii
from tidemark.llm.quality import fit_rules, judge_quality
from tidemark.llm.simhash import linked, near_duplicates
from tidemark.llm.tokens import count_tokens, word_tokenizer

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def luhn(d):
    x = [int(c) for c in d[::-1]]
    return sum(x[0::2] + [sum(divmod(2 * v, 10)) for v in x[1::2]]) % 10 == 0


def base_spans(text):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(?:\.[0-9]+){3}", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15),
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]


def test_pii(spark, docs):
    for r in rows(spark, "op1_pii"):
        want = base_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), r["doc_id"]
        assert set(want) <= set(r["spans"].split(","))| {""}


def test_pii_hard_texts(spark):
    texts = ["a@b.c x 4111 1111 1111 1111 +1 (555) 123-4567", "1.2.3.4.5.6.7.8 256.1.1.1", "a@b@c.de.f", "é😀 x@y.zz", "1" * 5000, None, "", "+1 +2 555 555 5555 -", "..a@b..c.d"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii string")
    for r in find_pii(df).collect():
        got = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["pii"] if s["kind"] in ("email", "ip", "card", "phone")]
        assert got == base_spans(r["text"] or ""), r["text"]
    assert find_pii(df.limit(0)).count() == 0


def fingerprint(text, width=3):
    words = [w.encode().lower() for w in WORD.findall(text)]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    fp = {i: fingerprint(t) for i, t in docs.items()}
    name = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 2 and name[b] < name[a]:
                    name[a], changed = name[b], True
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op2_simhash")}
    assert got == {i: (f"{fp[i]:016x}", name[i]) for i in fp}


@pytest.mark.parametrize("distance", [2, 4, 7])
def test_links_of_crowded_keys_connect_the_same(spark, monkeypatch, distance):
    """Some groups of near fingerprints, some far ones and a chain, with tiles so small that keys hold several."""
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(5)
    seeds = [int(x) for x in rng.integers(0, 2**63, 6)]
    near = {s ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for s in seeds for _ in range(60)}
    chain = {(1 << k) - 1 for k in range(0, 60, 2)}
    far = {int(x) for x in rng.integers(0, 2**63, 100)}
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in near | chain | far)
    got = linked(spark.createDataFrame(list(zip(fps, range(len(fps)), strict=True)), "fp long, doc long"), distance).collect()

    def components(links):
        name = list(range(len(fps)))
        for a, b in links:
            low, high = sorted((name[a], name[b]))
            name = [low if x == high else x for x in name]
        return name

    apart = lambda a, b: ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count()
    want = [(a, b) for a in range(len(fps)) for b in range(a) if apart(a, b) <= distance]
    assert components(got) == components(want)


def test_simhash_many_near_fingerprints(spark):
    """Groups beyond the pair limit: every text of one word differs, all repeat a long common part."""
    body = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(i, f"{body} tail{i}") for i in range(60)] + [(90, None), (91, ""), (91, "")], "doc_id long, text string")
    got = near_duplicates(df).collect()
    fp = {r["doc_id"]: r["fp"] % 2**64 for r in got}
    for r in got:
        near = [i for i in fp if (fp[i] ^ fp[r["doc_id"]]).bit_count() <= 2]
        assert {x["component_id"] for x in got if x["doc_id"] in near} == {r["component_id"]}
    assert {r["component_id"] for r in got if r["doc_id"] >= 90} == {90}
    assert near_duplicates(df.limit(0)).count() == 0
    alone = near_duplicates(spark.createDataFrame([(None, "a b c"), (None, None)], "doc_id long, text string"), distance=7).collect()
    assert [r["component_id"] for r in alone] == [None, None]


def test_simhash_plans_stay_small(spark):
    """No plan for less than two fingerprints, and never more than ``MAX_KEYS`` keys, at any distance."""
    from math import comb

    for fps in ([], [5], [5, 6], list(range(0, 4000, 7))):
        for distance in (2, 5, 7):
            plan = simhash.plan_partitions(spark.createDataFrame([(x,) for x in fps], "fp long"), distance)
            assert (not plan) == (len(fps) < 2) and sum(comb(len(b), t) for b, t in plan) <= simhash.MAX_KEYS


def test_simhash_links_through_rows_without_id(spark, monkeypatch):
    """A null id joins two others that are too far apart to be linked themselves."""
    fps = {1: 0, None: 3, 2: 15}
    made = spark.createDataFrame(list(fps.items()), "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: made)
    got = near_duplicates(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, None: 1, 2: 1}


def test_quality(spark, docs):
    for r in rows(spark, "op3_quality"):
        text = docs[r["doc_id"]]
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        twice = {w for w in windows if windows.count(w) > 1} if len(set(windows)) < len(windows) else set()
        repeat = len({i + k for i, w in enumerate(windows) if w in twice for k in range(5)})
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = len(words) < 10 or 100 * repeat > 20 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_rules_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality is not null")
    rules = fit_rules(docs, labels.filter("doc_id % 2 = 0"))
    judged = judge_quality(docs, rules).join(labels.filter("doc_id % 2 = 1").dropDuplicates(["doc_id"]), "doc_id")
    good = judged.filter("quality = 1 and not base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good >= 0.95
    assert fit_rules(docs, labels.limit(0)) == []


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_tokenizer())
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in docs.items()}
    got = rows(spark, "op4_packing")
    assert len(got) == sum(-(-len(x) // 2048) for x in ids.values())
    seqs = {}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 2048 * r["piece"] and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r["ids_crc32"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= 1.03 * sum(map(len, ids.values())) / 2048 + 1


@pytest.mark.parametrize("counts", [{2048: 3, 1500: 7, 700: 20, 548: 5, 300: 40, 1: 90}, {1: 5000}, {1025: 4}, {1024: 5, 3: 1}, {2048: 2}, {}])
def test_match_runs_places_each_rank_once(spark, counts):
    """Every document has a place, no two overlap, and sequences are gapless and as few as tokens allow, within one in a hundred."""
    runs = match_runs(spark.createDataFrame(list(counts.items()), "length long, n long")).collect()
    seen, parts = {}, {}
    for r in runs:
        for k in range(r["n"]):
            seen.setdefault(r["size"], []).append(r["first"] + k)
            parts.setdefault(r["seq"] + k // r["each"], []).append((r["offset"] + k % r["each"] * r["size"], r["size"]))
    assert {length: sorted(ranks) for length, ranks in seen.items()} == {length: list(range(n)) for length, n in counts.items()}
    for spans in parts.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= 2048
    long = sum(n for length, n in counts.items() if length > 1024)
    assert len(parts) <= max(long, 1.01 * sum(length * n for length, n in counts.items()) / 2048 + 1)


def test_packing_of_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 7, 7)] * 5 + [(None, None, 1, 1), (None, "x " * 5000, 1, 1)], "doc_id long, text string, length int, sequence_id int")
    got = pack_documents(df, keep_ids=True).collect()
    assert sum(r["doc_id"] == 1 for r in got) == 5 and sorted(r["length"] for r in got)[:1] == [1]
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) == 9 and all(len(r["ids"]) == r["length"] for r in got)
    assert pack_documents(df.limit(0)).count() == 0


def test_neighbours(spark):
    data = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toArrow()
    keys, x = data["vec_id"].to_numpy(), np.array(data["embedding"].to_pylist(), dtype=float)
    got = {}
    for r in registry.QUERIES["op5_neighbours"](spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    hits = total = 0
    for q in keys[keys % 20 == 0]:
        s = x @ x[list(keys).index(q)]
        best = [k for k in keys[np.lexsort((keys, -s))] if k != q][:20]
        assert sorted(got[q]) == list(range(1, 21))
        hits, total = hits + len(set(best) & set(got[q].values())), total + 20
    assert hits / total >= 0.9
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, 0.0]), (5, [0.5, None]), (6, [0.5, 0.5])], "vec_id long, embedding array<double>")
    near = nearest(odd, F.col("id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in near] == [(4, 1.0), (6, 0.5)]
    assert nearest(odd.limit(0), F.col("id") == 0).count() == 0
    twice = spark.createDataFrame([(i, [float(k), 1.0], "x") for i in range(3) for k in (i + 1, i, 7)] * 2, "vec_id long, embedding array<double>, id string")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest(twice, F.col("id") == 1).collect()] == [(1, 1, 2, 3.0), (1, 2, 0, 1.0)]


@pytest.mark.parametrize("name", ["op6_urls", "op9_mixing"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    asked = con.execute(registry.ORACLE_SQL[name])
    at = [c[0] for c in asked.description]
    assert sorted(map(str, asked.fetchall())) == sorted(str(tuple(r[c] for c in at)) for r in rows(spark, name))


@pytest.mark.parametrize("shard_bytes", [1 << 24, 500])
def test_url_cascades_are_exact(spark, monkeypatch, shard_bytes):
    """Thousands of listed domains, so that cascades have several levels, whole and in shards."""
    monkeypatch.setattr(urls, "SHARD_BYTES", shard_bytes)
    rng = np.random.default_rng(8)
    hosts = [f"h{k}.d{k % 900}.{tld}" for k, tld in enumerate(rng.choice(["com", "org", "net"], 4000))]
    keys = {f"d{k}.com" for k in range(0, 900, 2)} | {h for h in hosts if h.endswith("org") and int(rng.integers(3))} | {"unseen.net"}
    built, depth = urls.build_cascade, []
    monkeypatch.setattr(urls, "build_cascade", lambda u: depth.append(built(u)) or depth[-1])
    pages = spark.createDataFrame([(i, f"x://{h}/a") for i, h in enumerate(hosts)], "page_id long, url string")
    got = urls.judge_urls(pages, spark.createDataFrame([(k,) for k in keys] + [(None,)], "key string"), rules=()).collect()
    assert {r["host"] for r in got if r["verdict"] == "block"} == {h for h in hosts if h in keys or h.split(".", 1)[1] in keys}
    assert max(map(len, depth)) > 2 and (len(depth) > 1) == (shard_bytes == 500)


def test_urls_edges(spark):
    rows = [(1, None, "p"), (2, "no scheme", "p"), (3, "http://SPAM-farm.example.org?x", "p"), (3, "http://SPAM-farm.example.org?x", "p"), (4, "http://a.example.net/en/", "p"), (5, "http://" + "a." * 2000 + "fr/", "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string").withColumns({"a": F.lit(1), "_a": F.lit(1)})
    got = sorted((r["page_id"], r["host"][:12], r["rule"], r["verdict"], r["a"], r["_a"]) for r in urls.judge_urls(df, urls.listed_domains(spark)).collect())
    blocked = (3, "spam-farm.ex", None, "block", 1, 1)
    want = [(1, "", None, "allow", 1, 1), (2, "", None, "allow", 1, 1), blocked, blocked, (4, "a.example.ne", "example.net/en/", "allow", 1, 1), (5, "a.a.a.a.a.a.", None, "allow", 1, 1)]
    assert got == want
    assert urls.judge_urls(df.limit(0), urls.listed_domains(spark)).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(df, urls.listed_domains(spark).limit(0)).collect()} == {"allow"}


def test_mixing_reaches_target_weights(spark):
    df = spark.createDataFrame([(i, "t", "a" if i % 4 else "b") for i in range(8000)] + [(None, None, None)], "doc_id long, text string, source string")
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    n = {r["source"]: r["count"] for r in mix_sources(df, w).groupBy("source").count().collect()}
    assert set(n) == {"a", "b"} and abs(n["a"] - n["b"]) < 0.08 * n["a"]


def test_licenses(spark, docs):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for r in rows(spark, "op7_licenses"):
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", docs[r["doc_id"]])]
        hits = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def test_line_dedup(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op8_line_dedup")}
    seen, want = {}, {}
    for i in sorted(docs):
        lines = docs[i].split("\n")
        for k, line in enumerate(lines):
            words = tuple(WORD.findall(line.lower()))
            if not words:
                continue
            near = words in seen or len(words) >= 5 and any(one_edit(words, x) for x in seen if len(x) >= 5 and abs(len(x) - len(words)) <= 1)
            seen.setdefault(words, (i, k))
            if near:
                want.setdefault(i, []).append(k)
        left = "\n".join(x for k, x in enumerate(lines) if k not in want.get(i, []))
        assert got[i]["dropped"] == ",".join(map(str, want.get(i, []))), i
        assert got[i]["text_sha256"] == hashlib.sha256(left.encode()).hexdigest()


def test_line_dedup_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e", 9), (2, "A  b\tc d e\nx", 9), (3, "a b c d f", 9), (4, None, 9), (5, "", 9), (6, "a b c d e g", 9)], "doc_id long, text string, n_lines int")
    got = {r["doc_id"]: r["text"] for r in dedup_lines(df).collect()}
    assert got == {1: "a b c d e", 2: "x", 3: "", 4: None, 5: "", 6: ""}
    assert dedup_lines(df.limit(0)).count() == 0


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_tokenizer())
    for r in rows(spark, "op10_token_counts"):
        text = docs[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
    texts = ["İstanbul ǅ ﬁ ÷× naïve café", "a<|endoftext|>b <|startoftext|>", "x y z\x1c\x85q", "don't WON'T 12345 !!!--", "日本語 テスト 😀😀", None, "", "́e é", "a" * 3000, "ſtrange K"]
    for r in count_tokens(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")).collect():
        assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids), r["text"]


def test_pipeline_stages_follow_each_other(spark):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    at, sizes = first, []
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.materialize(stage(spark, at, SF), f"t_{name}")
        sizes.append(at.count())
        if name != "packing":
            assert at.columns == first.columns
    assert sizes[0] < first.count() and sizes[1] == sizes[0] and 0 < sizes[2] <= sizes[1] and sizes[4] >= sizes[3]
    odd = spark.createDataFrame([(1, None, None, None, None)], first.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() >= 0 and stage(spark, first.limit(0), SF).count() == 0
    assert pack_documents(odd).first()["length"] == 1


@pytest.mark.parametrize("tile", [512, 8])
def test_near_dedup_links_at_similarity_of_four_fifths(spark, monkeypatch, tile):
    """Pairs from 0.5 to 1, a template with many documents at 0.6 to 0.75, a crowded group of near copies, a chain, null ids."""
    monkeypatch.setattr(shingles, "TILE", tile)
    rng = np.random.default_rng(11)
    texts = []

    def changed(words, n, tag):
        out = list(words)
        for i in rng.choice(len(out), n, replace=False):
            out[i] = f"{tag}x{i}"
        return out

    for k in range(60):
        body = [f"p{k}w{i}" for i in range(200)]
        texts += [body, changed(body, k % 14, f"c{k}")]
    template = [f"t{i}" for i in range(240)]
    texts += [template[:200] + [f"own{k}n{i}" for i in range(36)] for k in range(40)]
    near = [f"n{i}" for i in range(300)]
    texts += [changed(near, 2, f"m{k}") for k in range(50)]
    chain = [f"h{i}" for i in range(400)]
    texts += [chain[9 * k : 9 * k + 200] for k in range(20)]
    data = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, " ".join(near)), (None, "a lone text"), (None, "A  lone text"), (900, None), (901, "")]
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for _, t in data)]
    alike = lambda a, b: a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)) > 0
    name, order = list(range(len(data))), sorted(range(len(data)), key=lambda i: (data[i][0] is None, data[i][0] or 0))
    for i in range(len(data)):
        for j in range(i):
            if name[i] != name[j] and alike(sets[i], sets[j]):
                old, new = name[i], name[j]
                name = [new if x == old else x for x in name]
    want, seen = [], set()
    for i in order:
        if name[i] not in seen:
            seen.add(name[i])
            want.append(data[i][0])
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def neighbour_recall(spark, monkeypatch, x):
    """Of the 20 of largest inner product, with starts for searches among few of the nodes."""
    monkeypatch.setattr(neighbours, "ENTRIES", 256, raising=False)
    got = {}
    for r in nearest(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, len(x), 50):
        best = [k for k in np.argsort(-(x @ x[q])).tolist() if k != q][:20]
        hits += len(set(best) & got[q])
    return hits / (20 * len(range(0, len(x), 50)))


@pytest.mark.parametrize("kind", ["near copies", "outlier", "three decades"])
def test_neighbours_tells_fine_differences(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1, 64)) / 8 + 0.003 * rng.normal(size=(2500, 64)) if kind == "near copies" else rng.normal(size=(2500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 300 if kind == "outlier" else 1
    x *= 10 ** rng.uniform(-3, 0, (2500, 1)) if kind == "three decades" else 1
    assert neighbour_recall(spark, monkeypatch, x) >= 0.9


def test_neighbours_by_inner_product_of_varied_lengths(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2500, 64))
    x *= rng.uniform(0.2, 1, (2500, 1)) / np.linalg.norm(x, axis=1)[:, None]
    assert neighbour_recall(spark, monkeypatch, x) >= 0.9


def test_line_dedup_rows_of_one_id_are_told_apart(spark):
    """Null ids and different texts under one id: only lines that repeat go."""
    line = "a b c d e"
    texts = [(None, f"{line}\nu1 u2 u3 u4 u5"), (None, f"v1 v2 v3 v4 v5\n{line}"), (None, f"w1 w2 w3 w4 w5\nx1 x2 x3 x4 x5"), (7, f"{line}\ny1 y2 y3 y4 y5"), (7, "z1 z2 z3 z4 z5\nq1 q2 q3 q4 q5"), (7, "z1 z2 z3 z4 z5\nr1 r2 r3 r4 r5")]
    got = [x for r in dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect() for x in r["text"].split("\n") if x]
    assert sorted(got) == sorted({x for _, t in texts for x in t.split("\n")})


def test_mixing_takes_any_rate(spark):
    """A one-row source beside many rows: rates beyond one draw's, with means as asked for."""
    df = spark.createDataFrame([(i, "t", "a") for i in range(2000)] + [(5000 + i, "t", "b") for i in range(3)], "doc_id long, text string, source string")
    w = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    out = mix_sources(df, w).filter("source = 'b'").groupBy("doc_id").agg({"rate": "max", "n_copies": "max", "copy": "count"}).collect()
    assert len(out) == 3
    for r in out:
        assert abs(r["max(rate)"] - 0.75 * 2003 / 3) < 1e-9
        assert r["max(n_copies)"] == r["count(copy)"] and abs(r["count(copy)"] - r["max(rate)"]) < 6 * r["max(rate)"] ** 0.5
    assert len({r["count(copy)"] for r in out}) > 1


def test_pii_cards_without_adjacent_digits(spark):
    texts = [" ".join("4111111111111111"), "-".join("4111111111111111"), "pay " + " ".join("4111111111111112"), "4"]
    for r in find_pii(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect():
        got = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["pii"] if s["kind"] in ("email", "ip", "card", "phone")]
        assert got == base_spans(r["text"]), r["text"]


def test_licenses_of_wrapped_headers(spark, docs):
    """Labels and score against brute force over stretches of the whole text."""
    templates = [(label, t) for label, ts in TEMPLATES.items() for t in ts]
    texts = [f"{'lead ' * k}" + "\n * ".join(textwrap.wrap(t, 30 + 7 * k)) + "\n tail" * (40 * k) for k in range(3) for _, t in templates]
    texts += [t[: len(t) // 2] for _, t in templates] + [None] + list(docs.values())[:60]
    for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r["text"] if "text" in r else texts[r["doc_id"]] or "")]
        blocks = [set(words[at : at + 64]) for at in range(0, max(1, len(words)), 32)]
        held = [(max(len(b & set(t.split())) for b in blocks) / len(set(t.split())), label) for label, t in templates]
        met = [(s, label) for s, label in held if s >= 0.8]
        assert r["found"] == sorted({label for _, label in met}), texts[r["doc_id"]]
        assert r["score"] == max((s for s, _ in met), default=0.0)
