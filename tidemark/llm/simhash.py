"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints are made once per document in Arrow batches and collapsed to
distinct ones, so copies cost nothing further. Their 64 bits are grouped into
partitions of correlated bits. Each partition gets its own threshold, from -1
(not used) up, such that the thresholds sum to ``distance - partitions + 1``:
then two fingerprints within ``distance`` are within the threshold in some
partition. Dynamic programming picks them, and the number of partitions, for
the least keys and candidates, estimated from counts over all fingerprints.

Candidates share a key: a partition's bits with as many masked as its threshold
says. A key with few members gives pairs to verify. A key with many gives none:

* At distance two its members meet at the values one bit away from them. Two
  values are within two bits if and only if both are within one bit of a third,
  and at most 65 distinct fingerprints are within one bit of any value, so this
  is exact and linear for any group.
* At other distances its distinct fingerprints are dealt into tiles of bounded
  size such that each pair shares one, and a tile returns links that join the
  same fingerprints as all its pairs would, at most one a member. This is exact;
  the comparisons grow with the square of the fingerprints to a key, spread over
  the tiles.

Defined results: a null text is an empty one; a text without words has
fingerprint zero; texts of any length are taken whole; rows that repeat a
``doc_id`` are fingerprinted each and share a component with their equals; null
ids are linked but never name a component, unless all in it are null; an empty
table gives an empty result; of the input's columns only ``doc_id`` is returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.grouped import by_key, spans
from tidemark.operators.components import connected_components
from tidemark.operators.skew import join_per_key
from tidemark.shipping import ship_package
from tidemark.sources.scratch import materialize, release

BITS = 64
SHINGLE = 3
DISTANCE = 2
#: Most keys of one fingerprint; plans with more are not considered.
MAX_KEYS = 512
#: A key with more members than this meets at neighbouring values, not in pairs.
PAIR_LIMIT = 24
#: Fingerprints to a chunk; a tile holds two.
TILE = 2048
#: Fingerprints compared with a tile at once.
STRIP = 256
#: What one key costs against one candidate pair.
KEY_COST = 2.0
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The bits set in over half the hashes of the text's word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    ahead = [words[k:] for k in range(width)]
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*ahead, strict=False))
    hashes = np.array([xxh64_intdigest(s, 42) for s in shingles], dtype="<u8")
    n, ones = len(hashes), np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", text).mapInArrow(batches, T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())]))


def _bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have both bits i and j, over all of them."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), dtype=np.int64), 0
        for b in it:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            x = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (x.T @ x).astype(np.int64)
            n += len(fp)
        i, j = np.triu_indices(BITS)
        at, c = np.append(i * BITS + j, -1), np.append(both[i, j], n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(c)], names=["at", "c"])

    rows = distinct.select("fp").mapInArrow(count, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).collect()
    both, n = np.zeros(BITS * BITS), 0
    for r in rows:
        if r["at"] < 0:
            n = r["c"]
        else:
            both[r["at"]] = r["c"]
    both = both.reshape(BITS, BITS)
    return n, both + both.T - np.diag(np.diag(both))


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of about equal size, correlated ones together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        order = sorted(left)
        seed = order[int(corr[np.ix_(order, order)].sum(axis=1).argmax())]
        group = [seed]
        left.discard(seed)
        while len(group) < size:
            order = sorted(left)
            best = order[int(corr[np.ix_(order, group)].mean(axis=1).argmax())]
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def _mask(bits: list[int]) -> int:
    return int(np.array([sum(1 << b for b in bits)], dtype=np.uint64).view(np.int64)[0])


def _masked_cost(distinct: DataFrame, groups: list[list[int]]) -> list[float]:
    """For each group, the work its keys would give with no bit masked, over all fingerprints."""
    each = distinct.select(F.explode(F.array(*(F.struct(F.lit(k).alias("g"), F.col("fp").bitwiseAND(F.lit(_mask(b))).alias("v")) for k, b in enumerate(groups)))).alias("x"))
    work = F.least(F.col("c") * (F.col("c") - 1) / 2, F.col("c") * BITS)
    rows = each.groupBy("x.g", "x.v").agg(F.count("*").alias("c")).groupBy("g").agg(F.sum(work).alias("w")).collect()
    found = {r["g"]: float(r["w"]) for r in rows}
    return [found.get(k, 0.0) for k in range(len(groups))]


def allocate(n: int, p: np.ndarray, groups: list[list[int]], exact: list[float], distance: int) -> tuple[float, int, list[int]] | None:
    """Cost, keys and thresholds of least estimated cost, then of fewest keys, that sum to ``distance - len(groups) + 1``, by dynamic programming.

    Masking t bits joins, to each exact match, the values that differ in those
    bits alone; bits count as independent for that, with their odds to differ.
    """
    agree = p**2 + (1 - p) ** 2
    odds = (1 - agree) / np.maximum(agree, 1e-9)
    table: dict[int, tuple[float, int, list[int]]] = {0: (0.0, 0, [])}
    for bits, work in zip(groups, exact, strict=True):
        floor = max(work, n * n / 2 * float(np.prod(agree[bits])), n / 2.0**20)
        step: dict[int, tuple[float, int, list[int]]] = {}
        for used, (cost, keys, chosen) in table.items():
            for t in range(-1, min(distance, len(bits)) + 1):
                more, made = 0.0, 0
                if t >= 0:
                    symmetric = [1.0] + [0.0] * t
                    for o in odds[bits]:
                        for k in range(t, 0, -1):
                            symmetric[k] += symmetric[k - 1] * float(o)
                    made = comb(len(bits), t)
                    more = KEY_COST * n * made + (work if t == 0 else max(work, floor) * sum(symmetric))
                found = (cost + more, keys + made, [*chosen, t])
                if found[1] <= MAX_KEYS and (used + t not in step or found < step[used + t]):
                    step[used + t] = found
        table = step
    return table.get(distance - len(groups) + 1)


def plan_partitions(distinct: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """``(bits, threshold)`` of the partitions in use; none where there are no two fingerprints to link.

    From two partitions up to one more than ``distance``, where all thresholds
    may be zero, so that some plan stays within ``MAX_KEYS``.
    """
    n, both = _bit_counts(distinct)
    plans = []
    for parts in range(2, max(4, distance + 1) + 1) if n > 1 else ():
        groups = group_bits(n, both, parts)
        made = allocate(n, np.diag(both) / n, groups, _masked_cost(distinct, groups), distance)
        if made:
            plans.append((*made[:2], [(b, t) for b, t in zip(groups, made[2], strict=True) if t >= 0]))
    return min(plans)[2] if plans else []


def _keys(partitions: list[tuple[list[int], int]]) -> Column:
    keys, at = [], 0
    for bits, threshold in partitions:
        for hidden in combinations(bits, threshold):
            rest = _mask([b for b in bits if b not in hidden])
            keys.append(F.xxhash64(F.lit(at), F.col("fp").bitwiseAND(F.lit(rest))))
            at += 1
    return F.array(*keys)


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _forest(x: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(seed, others)`` of each group of ``x`` joined by steps of at most ``distance`` bits."""
    left = np.arange(len(x))
    while len(left):
        seed, left, edge, found = int(left[0]), left[1:], left[:1], []
        while len(edge) and len(left):
            strip, edge = edge[:STRIP], edge[STRIP:]
            near = (np.bitwise_count(x[strip][:, None] ^ x[left][None, :]) <= distance).any(axis=0)
            found.append(left[near])
            edge, left = np.concatenate([edge, left[near]]), left[~near]
        if found and sum(map(len, found)):
            yield seed, np.concatenate(found)


def _tiled(shared: DataFrame, distance: int) -> DataFrame:
    """``(u, v)`` that connect the members of each key within ``distance``, of ``(key, fp, doc, n)``."""
    parts = F.ceil(F.col("n") / TILE).cast("int")
    dealt = shared.select("key", "fp", "doc", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("c"))
    tile = lambda k: F.xxhash64("key", F.least("c", k), F.greatest("c", k))
    tiled = dealt.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), tile)).alias("tile"), "fp", "doc")

    def link(b: pa.RecordBatch) -> list:
        fp, u, v = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for s, e in spans(b.column("tile").to_numpy(zero_copy_only=False)):
            for seed, others in _forest(fp[s:e], distance):
                u.append(np.full(len(others), s + seed))
                v.append(s + others)
        return [b.column("doc").take(pa.array(np.concatenate(side))) for side in (u, v)]

    kind = shared.schema["doc"].dataType.simpleString()
    return by_key(tiled, "tile", link, f"u {kind}, v {kind}")


def linked(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(u, v)``: links between the ``doc`` of fingerprints that connect all within ``distance``, of ``(fp, doc)``."""
    kind = distinct.schema["doc"].dataType.simpleString()
    plan = plan_partitions(distinct, distance)
    if not plan:
        return distinct.sparkSession.createDataFrame([], f"u {kind}, v {kind}")
    keyed = materialize(distinct.select(F.explode(_keys(plan)).alias("key"), "fp", "doc"), "keys")
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    counted = sizes.withColumn("rows", F.col("n"))
    shared = materialize(join_per_key(keyed, counted, ["key"], "rows", keyed.count(), "fp"), "shared")
    release(keyed, sizes)

    few = shared.filter(F.col("n") <= PAIR_LIMIT).groupBy("key").agg(F.collect_list(F.struct("fp", "doc")).alias("m"))
    pairs = F.flatten(
        F.transform("m", lambda a, i: F.transform(F.filter(F.slice("m", i + 2, F.size("m")), lambda b: _apart(a["fp"], b["fp"]) <= distance), lambda b: F.struct(a["doc"].alias("u"), b["doc"].alias("v"))))
    )
    close = few.select(F.inline(pairs))
    crowded = shared.filter(F.col("n") > PAIR_LIMIT)
    if distance == 2:
        near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_mask([b]))) for b in range(BITS)))
        many = crowded.select("fp", "doc").distinct().select("doc", F.explode(near).alias("at"))
        met = many.groupBy("at").agg(F.min("doc").alias("v"), F.collect_set("doc").alias("m"))
        stars = met.filter(F.size("m") > 1).select(F.explode("m").alias("u"), "v").filter("u <> v")
    else:
        stars = _tiled(crowded, distance)
    links = materialize(close.unionByName(stars).distinct(), "links")
    release(shared)
    return links


def near_duplicates(docs: DataFrame, text: str = "text", width: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``docs``."""
    ship_package(docs.sparkSession)
    made = materialize(fingerprints(docs, text, width), "fingerprints")
    distinct = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")), "distinct")
    links = linked(distinct.select("fp", F.col("fp").alias("doc")), distance)
    found = connected_components(links)
    release(links)
    joined = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "doc", "n", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("doc").alias("component_id"), F.count("*").alias("fps"))
    named = materialize(join_per_key(joined, least, ["component"], "fps", distinct.count(), "fp").select("fp", "n", "component_id"), "named")
    release(distinct, found)
    return join_per_key(made, named, ["fp"], "n", made.count(), "doc_id").select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """``doc_id``, ``fingerprint`` in 16 hexadecimal digits, and ``component_id``."""
    from tidemark.sources.tables import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
