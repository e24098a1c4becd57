"""Relations of evidence: by hand, against a plain loop over the rule, and with groups longer than any stretch."""

import random
import re
from difflib import SequenceMatcher

import pytest

from tidemark.operators import relations
from tidemark.operators.positions import numbered
from tidemark.operators.relations import Ladder, evidence_relations
from tidemark.plans import graph

COLUMNS = "company string, id string, kind string, direction string, fact string"


def asked(spark, rows, **ladder):
    out = evidence_relations(spark.createDataFrame(rows, COLUMNS), "company", "id", "kind", "direction", "fact", Ladder(**ladder))
    return sorted(((r["company"], r["from_id"], r["to_id"], r["relation"]) for r in out.collect()), key=str)


def looped(rows, duplicate=0.92, contradict=0.72, update=0.82, support=0.55, weaken=0.45):
    """The rule as it is stated: all earlier pieces of the group and kind in order, the first that any rule ties."""
    number = re.compile(r"[-+]?[0-9][0-9,.]*(?:%|개월|년|월|일)?")
    flat = [re.sub(r"\s+", " ", r[4] or "").strip().casefold() for r in rows]
    order = sorted(range(len(rows)), key=lambda i: rows[i][1])
    out = []
    for at, i in enumerate(order):
        for j in order[:at]:
            if rows[i][0] != rows[j][0] or rows[i][2] != rows[j][2]:
                continue
            ratio = SequenceMatcher(None, flat[i], flat[j]).ratio()
            same, equal = rows[i][3] == rows[j][3], number.findall(flat[i]) == number.findall(flat[j])
            opposed = not same and "NEUTRAL" not in (rows[i][3], rows[j][3])
            said = None
            if same and equal and ratio >= duplicate:
                said = "DUPLICATES"
            elif same and not equal and ratio >= update:
                said = "UPDATES"
            elif opposed and ratio >= contradict:
                said = "CONTRADICTS"
            elif opposed and ratio >= weaken:
                said = "WEAKENS"
            elif same and ratio >= support:
                said = "SUPPORTS"
            if said:
                out.append((rows[i][0], rows[i][1], rows[j][1], said))
                break
    return sorted(out, key=str)


def test_duplicates_updates_and_contradictions(spark):
    fact = "Customer qualification takes {} months."
    rows = [("c", "E1", "t", "UP", fact.format(18)), ("c", "E2", "t", "UP", fact.format(18)), ("c", "E3", "t", "UP", fact.format(24)), ("c", "E4", "t", "DOWN", fact.format(18))]
    assert [r[3] for r in asked(spark, rows, update=0.70)] == ["DUPLICATES", "UPDATES", "CONTRADICTS"]


def test_supports_and_weakens(spark):
    rows = [("c", "E1", "t", "UP", "Qualification creates customer friction."), ("c", "E2", "t", "UP", "Integration creates customer friction."), ("c", "E3", "t", "DOWN", "Dual sourcing reduces customer friction.")]
    got = asked(spark, rows, duplicate=1.1, update=1.1, contradict=1.1, support=0.0, weaken=0.0)
    assert [r[3] for r in got] == ["SUPPORTS", "WEAKENS"]


@pytest.mark.parametrize("first, stretch", [(16, 256), (2, 4)])
def test_against_a_loop(spark, monkeypatch, first, stretch):
    """Nulls, empty facts, unrelated alphabets, and groups beyond all rounds."""
    monkeypatch.setattr(relations, "FIRST", first)
    monkeypatch.setattr(relations, "STRETCH", stretch)
    rng = random.Random(first)
    words = ["revenue rose 5%", "margin fell", "new plant", "qualification 18 months", "zzz qqq", "ÉÉÉ ööö", ""]
    rows = []
    for k in range(90):
        fact = " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
        rows.append((rng.choice(["a", "a", "a", "b", None]), f"{k:03}", rng.choice(["x", "y", None]), rng.choice(["UP", "DOWN", "NEUTRAL", None]), rng.choice([fact, fact, fact.upper(), None])))
    # many pieces with nothing in common, each of letters of its own
    rows += [("far", f"{k:03}", "x", "UP", chr(0x4E00 + k) * 5) for k in range(40)] + [("far", "zz", "x", "UP", chr(0x4E00 + 37) * 5)]
    assert sorted(asked(spark, rows), key=str) == looped(rows)


def test_empty_and_one(spark):
    assert asked(spark, [("c", "1", "t", "UP", "only one")]) == []
    assert evidence_relations(spark.createDataFrame([], COLUMNS), "company", "id", "kind", "direction", "fact").count() == 0


def test_numbered_places(spark):
    rows = spark.createDataFrame([(k % 3 or None, k) for k in range(500)], "g int, v int")
    got = {(r["g"], r["v"]): r["at"] for r in numbered(rows, ["g"], ["v"], "at").collect()}
    assert got == {(k % 3 or None, k): k // 3 for k in range(500)}


def test_queries_against_a_loop(spark):
    sf = "/root/testdata/sf0.001"
    cards = graph.sentence_cards(spark, sf).collect()
    want = looped([(r["conv_id"], r["card"], r["role"], r["direction"], r["text"]) for r in cards])
    got = sorted(((r["conv_id"], r["from_id"], r["to_id"], r["relation"]) for r in graph.relations(spark, sf).collect()), key=str)
    assert got == want and got
    closed = {r["evidence_id"]: r for r in graph.related_ledger(spark, sf).collect()}
    by_target = {}
    for _, source, target, relation in want:
        if relation in ("DUPLICATES", "UPDATES", "CONTRADICTS"):
            by_target.setdefault(target, []).append((relation == "CONTRADICTS", source))
    assert {k for k, r in closed.items() if r["closed_by"]} == set(by_target)
    assert all(closed[k]["closed_by"] == min(v)[1] for k, v in by_target.items())
    assert len(closed) == len(cards)


def test_matched_is_that_of_the_matcher():
    draw = random.Random(5)
    for length in (0, 1, 7, 60, 260):
        for _ in range(30):
            a, b = ("".join(draw.choice("aabcde fg") for _ in range(draw.randint(0, length))) for _ in range(2))
            m = SequenceMatcher(None, a, b)
            want = sum(x.size for x in m.get_matching_blocks())
            assert relations.matched(a, b, m.b2j, 0) == want
            assert relations.matched(a, b, m.b2j, want) == want
            assert relations.matched(a, b, m.b2j, want + 1) in (None, want)


@pytest.mark.parametrize("whole", [0, 3, 256])
def test_groups_of_any_size_have_the_same_relations(spark, monkeypatch, whole):
    draw = random.Random(9)
    words = "the margin grew by 12% in most of all years while costs fell to 30 and sales rose".split()
    rows = [(draw.choice(["a", "b", None]), f"{k:03d}", "n", draw.choice(["UP", "DOWN", "NEUTRAL"]), " ".join(draw.choice(words) for _ in range(8))) for k in range(60)]
    monkeypatch.setattr(relations, "WHOLE", whole)
    df = spark.createDataFrame(rows, "company string, id string, kind string, direction string, fact string")
    got = {(r["from_id"], r["to_id"], r["relation"]) for r in evidence_relations(df, "company", "id", "kind", "direction", "fact").collect()}
    want = set()
    for k, (company, id_, _, direction, fact) in enumerate(rows):
        earlier = [relations._Earlier(r[1], r[3], relations.folded(r[4])) for r in rows[:k] if r[0] == company]
        to, relation = relations._first(earlier, len(earlier), direction, relations.folded(fact), Ladder())
        if relation:
            want.add((id_, to, relation))
    assert got == want and want
