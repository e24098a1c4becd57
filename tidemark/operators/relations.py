"""Relations between pieces of evidence: each with the first earlier one that a ladder of similarities ties it to.

Two pieces of one group and kind are compared by the ratio of their matching
characters. The first rule that holds names the relation:

==============  ==============================  =============  ==========
relation        direction                       ratio at least  numbers
==============  ==============================  =============  ==========
DUPLICATES      the same                        ``duplicate``   equal
UPDATES         the same                        ``update``      differ
CONTRADICTS     opposite, neither neutral       ``contradict``
WEAKENS         opposite, neither neutral       ``weaken``
SUPPORTS        the same                        ``support``
==============  ==============================  =============  ==========

Only the first earlier piece that any rule ties it to counts, so a piece needs
no more comparisons than lead to it. Pieces are numbered within group and kind.
A group of at most ``WHOLE`` pieces is compared in one pass; of larger ones,
in rounds, those without a relation yet meet the next stretch of earlier ones,
twice as long each time, up to ``STRETCH``. A stretch is one bounded row for a
group, joined with salt where a group is large: no pairs are formed. What is
left after the rounds meets all further stretches in one job. Two bounds on the
ratio, from lengths and from counts of characters, come before it.

Null facts count as empty; a piece without a group, kind or direction meets
those that lack it too. Keys must be distinct within a group.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import NUMBER
from tidemark.operators.positions import numbered
from tidemark.operators.skew import join_per_key
from tidemark.shipping import ship_package
from tidemark.sources.scratch import materialize, release, sized

NEUTRAL = "NEUTRAL"
#: Earlier pieces to a stretch: of the first round, and at most.
FIRST, STRETCH = 16, 256
#: A group of no more pieces is compared within one task.
WHOLE = 256


@dataclass(frozen=True)
class Ladder:
    """The least ratio of each relation."""

    duplicate: float = 0.92
    contradict: float = 0.72
    update: float = 0.82
    support: float = 0.55
    weaken: float = 0.45

    def relation(self, same_direction: bool, opposed: bool, same_numbers: bool, ratio: float) -> str | None:
        if same_direction:
            if same_numbers and ratio >= self.duplicate:
                return "DUPLICATES"
            if not same_numbers and ratio >= self.update:
                return "UPDATES"
            return "SUPPORTS" if ratio >= self.support else None
        if not opposed:
            return None
        return "CONTRADICTS" if ratio >= self.contradict else "WEAKENS" if ratio >= self.weaken else None

    def least(self, same_direction: bool, opposed: bool, same_numbers: bool) -> float:
        """Below this ratio no rule can hold."""
        if same_direction:
            return min(self.support, self.duplicate if same_numbers else self.update)
        return min(self.contradict, self.weaken) if opposed else float("inf")


def folded(fact: str | None) -> str:
    """The fact as it is compared: white space joined, case folded."""
    return re.sub(r"\s+", " ", fact or "").strip().casefold()


def matched(a: str, b: str, places: dict[str, list[int]], least: float) -> int | None:
    """The characters in ``SequenceMatcher``'s matching blocks, ``places`` being its ``b2j``; nothing as soon as they must stay well below ``least``."""
    total, most, asked = 0, min(len(a), len(b)), [(0, len(a), 0, len(b))]
    while asked:
        alo, ahi, blo, bhi = asked.pop()
        i, j, size, ends = alo, blo, 0, {}
        for x in range(alo, ahi):
            now = {}
            for y in places.get(a[x], ()):
                if y < blo:
                    continue
                if y >= bhi:
                    break
                now[y] = k = ends.get(y - 1, 0) + 1
                if k > size:
                    i, j, size = x - k + 1, y - k + 1, k
            ends = now
        # characters that are too frequent to have places only lengthen a match
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        before = after = 0
        if size:
            total += size
            before, after = min(i - alo, j - blo), min(ahi - i - size, bhi - j - size)
            if before:
                asked.append((alo, i, blo, j))
            if after:
                asked.append((i + size, ahi, j + size, bhi))
        most += size + before + after - min(ahi - alo, bhi - blo)
        if most < least - 1e-6:
            return None
    return total


class _Earlier:
    """One earlier piece, ready to be compared with many later ones."""

    def __init__(self, key: str, direction: str | None, flat: str):
        self.key, self.direction, self.flat = key, direction, flat
        self.numbers = re.findall(NUMBER, flat)
        self.matcher = SequenceMatcher(None, "", flat)
        self.counts = Counter(flat)

    def ratio(self, flat: str, counts: Counter, least: float) -> float | None:
        """The ratio, or nothing where a bound is below ``least``."""
        if flat == self.flat:
            return 1.0
        total = len(flat) + len(self.flat)
        bounds = (lambda: min(len(flat), len(self.flat)), lambda: sum(min(n, self.counts[c]) for c, n in counts.items()))
        if any(2.0 * most() / total < least for most in bounds):
            return None
        most = matched(flat, self.flat, self.matcher.b2j, least * total / 2)
        return None if most is None else 2.0 * most / total


def _first(stretch: list[_Earlier], before: int, direction: str | None, flat: str, ladder: Ladder) -> tuple[str | None, str | None]:
    counts, numbers = Counter(flat), re.findall(NUMBER, flat)
    for prior in stretch[:before]:
        same = direction == prior.direction
        opposed = not same and NEUTRAL not in (direction, prior.direction)
        least = ladder.least(same, opposed, numbers == prior.numbers)
        ratio = prior.ratio(flat, counts, least) if least <= 1 else None
        found = ratio is not None and ladder.relation(same, opposed, numbers == prior.numbers, ratio)
        if found:
            return prior.key, found
    return None, None


def _compared(rows: DataFrame, ladder: Ladder) -> DataFrame:
    """Adds ``to_id`` and ``relation`` to rows with a ``stretch`` of earlier pieces that starts at ``start``."""
    kept = [c for c in rows.columns if c != "stretch"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ready: dict[tuple, list[_Earlier]] = {}
            to, relation = [], []
            for place, direction, flat, start, stretch in zip(b["place"], b["direction"], b["flat"], b["start"], b["stretch"], strict=True):
                known = (stretch[0]["id"], start, len(stretch), stretch[0]["flat"])
                if known not in ready:
                    if len(ready) > 64:
                        ready.clear()
                    ready[known] = [_Earlier(p["id"], p["direction"], p["flat"]) for p in stretch]
                x, y = _first(ready[known], max(0, place - start), direction, flat, ladder)
                to.append(x)
                relation.append(y)
            out = b[kept].copy()
            out["to_id"], out["relation"] = pd.Series(to, dtype=object, index=out.index), pd.Series(relation, dtype=object, index=out.index)
            yield out

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "to_id string", "relation string"]))


def _whole(pieces: DataFrame, ladder: Ladder) -> DataFrame:
    """``(by, id, to_id, relation)`` of the pieces that have one, of groups small enough to be held at once.

    The pieces take few bytes and their comparisons long, so tasks are as many
    as shuffles have, whatever the bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, earlier = None, []
        for b in batches:
            out = []
            for by, id_, direction, flat, g in zip(b["by"], b["id"], b["direction"], b["flat"], b["g"], strict=True):
                if g != group:
                    group, earlier = g, []
                to, relation = _first(earlier, len(earlier), direction, flat, ladder)
                if relation:
                    out.append((by, id_, to, relation))
                earlier.append(_Earlier(id_, direction, flat))
            yield pd.DataFrame(out, columns=["by", "id", "to_id", "relation"]).astype({"by": b["by"].dtype})

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.select("by", "id", "direction", "flat", "g", "place").repartition(parts, "g").sortWithinPartitions("g", "place").drop("place")
    return dealt.mapInPandas(run, f"`by` {dict(pieces.dtypes)['by']}, id string, to_id string, relation string")


def _stretches(pieces: DataFrame, width: int, low: int, high: int | None = None) -> DataFrame:
    """``(g, start, stretch)``: the pieces of each group from ``low`` to below ``high`` in stretches of ``width``."""
    inside = pieces.filter(F.col("place") >= low) if high is None else pieces.filter((F.col("place") >= low) & (F.col("place") < high))
    start = (F.floor((F.col("place") - low) / width) * width + low).cast("long")
    listed = F.array_sort(F.collect_list(F.struct("place", "id", "direction", "flat")))
    return inside.groupBy("g", start.alias("start")).agg(listed.alias("stretch"))


def evidence_relations(cards: DataFrame, by: str, key: str, kind: str, direction: str, fact: str, ladder: Ladder = Ladder()) -> DataFrame:
    """``(by, from_id, to_id, relation)`` of all pieces of ``cards`` that have a relation, in the order of ``key`` as text."""
    ship_package(cards.sparkSession)

    @F.pandas_udf("string")
    def fold(facts: pd.Series) -> pd.Series:
        return facts.map(folded)

    told = cards.select(F.col(by).alias("by"), F.col(kind).cast("string").alias("kind"), F.col(key).cast("string").alias("id"), F.col(direction).cast("string").alias("direction"), fold(F.col(fact)).alias("flat"))
    pieces = numbered(told, ["by", "kind"], ["id"], "place")
    group = F.sha2(F.to_json(F.struct("by", "kind"), {"ignoreNullFields": "false"}), 256)
    pieces = pieces.withColumn("g", group)
    sizes = materialize(pieces.groupBy("g").agg(F.count("*").alias("rows")).filter(F.col("rows") > WHOLE).select("g"), "large")
    found = [materialize(_whole(pieces.join(sized(sizes), "g", "left_anti"), ladder), "related")]
    pieces = pieces.join(sized(sizes), "g", "left_semi")
    state, low, width = materialize(pieces.filter("place > 0"), "waiting"), 0, FIRST
    while width <= STRETCH:
        total = state.count()
        if not total:
            break
        asked = state.groupBy("g").agg(F.count("*").alias("_rows"))
        single = _stretches(pieces, width, low, low + width).join(asked, "g")
        met = materialize(_compared(join_per_key(state, single, ["g"], "_rows", total, "id"), ladder), "met")
        found.append(met.filter("relation is not null"))
        low += width
        after = materialize(met.filter((F.col("relation").isNull()) & (F.col("place") > low)).select(*state.columns), "waiting")
        release(state)
        state, width = after, width * 2
    if width > STRETCH and state.limit(1).count():
        asked = state.withColumn("start", F.explode(F.sequence(F.lit(low).cast("long"), F.col("place") - 1, F.lit(STRETCH).cast("long"))))
        far = _compared(asked.join(_stretches(pieces, STRETCH, low), ["g", "start"]), ladder).filter("relation is not null")
        # stretches lie in order: the least start has the first
        first = far.groupBy("g", "id").agg(F.min(F.struct("start", "by", "to_id", "relation")).alias("x"))
        found.append(materialize(first.select("id", "x.by", "x.to_id", "x.relation"), "far"))
    release(state, sizes)
    rows = [x.select(F.col("by").alias(by), F.col("id").alias("from_id"), "to_id", "relation") for x in found]
    none = cards.limit(0).select(F.col(by), F.lit("").alias("from_id"), F.lit("").alias("to_id"), F.lit("").alias("relation"))
    return reduce(DataFrame.unionByName, rows, none)
