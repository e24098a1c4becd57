"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search in it.

Equal vectors collapse into one node. Vectors are divided by the greatest length
and sent in single precision. In the graph they have one more component that
makes their lengths equal; a query has zero there, so that what is nearest to it
has the largest inner product, whatever the lengths.

* Start: nodes that share a near pivot are compared block by block.
* NN-descent: in each round every node sends its vector to the nodes it links
  and to those that link it, of these to the ``REVERSE`` nearest, so that no hub
  hears from more; every node compares those it heard from: neighbours of
  neighbours meet. Better ones replace worse ones; only pairs with a link that
  is new are compared. Rounds go on until few links change.
* Search: each query starts at its own node and at the best of a bounded sample,
  one node in ``ENTRY_SHARE`` at most and half of it the longest vectors, and expands its best unexpanded candidates by
  inner product, until the best ``BEAM`` are expanded.
* The candidates found are scored again on the original vectors in double
  precision, and nodes are expanded into the rows they stand for.

Every search ends with at least ``TOP`` candidates, or all nodes: the sample has
so many.

Defined results: null ids, and vectors that are null, zero, of another length
than most, or with a null or non-finite component, take no part; ties go to the
smaller id; with fewer rows than asked for, all are returned; rows that repeat
an id count once, with the least of their vectors in order of components; an
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.grouped import by_key, spans
from tidemark.shipping import ship_package
from tidemark.sources.scratch import materialize, release, sized

TOP = 20
#: Links kept for each node, and pairs that a meeting proposes to each member.
LINKS, PROPOSED = 32, 14
#: Pivots (a bounded sample of nodes), nodes to a block, near pivots of a node.
MAX_PIVOTS, BLOCK, NEAR_PIVOTS = 4096, 512, 3
CHANGED = 0.01
#: Nodes that link a node and are kept with those that it links, nearest first.
REVERSE = 48
BEAM, WIDTH = 192, 64
#: Nodes among which a search looks for its starts, half of them the longest: so many, and one in so many, at most.
ENTRIES, ENTRY_SHARE = 4096, 16
#: Requests, queries and vectors of at most so many bytes are broadcast; more are shuffled.
BROADCAST_BYTES = 32 << 20


def clean_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, x)`` of the rows that take part, ``x`` in double."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    ok = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda v: v != 0)
    kept = rows.filter(ok).select(F.col(key).cast("long").alias("id"), x.alias("x")).groupBy("id").agg(F.min("x").alias("x"))
    sizes = kept.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return kept.filter(F.size("x") == (sizes["d"] if sizes else -1))


def _vectors(batch: pa.RecordBatch, code: str = "code") -> np.ndarray:
    """A batch's vectors, in double precision."""
    column = batch.column(code)
    if not len(column):
        return np.zeros((0, 0))
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(len(column), -1).astype(np.float64)


def _level(x: np.ndarray) -> np.ndarray:
    """Vectors with the component that makes all lengths one."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))[:, None]])


def _best_pairs(x: np.ndarray, ids: np.ndarray, least: np.ndarray, fresh: np.ndarray | None, most: int) -> tuple[np.ndarray, ...]:
    """For each of a few vectors its ``most`` nearest others beyond ``least``; at least one of a pair must be fresh."""
    # less one, so that single precision tells near copies apart
    sims = x @ x.T - 1.0
    sims[ids[:, None] == ids[None, :]] = -np.inf
    if fresh is not None:
        sims[~(fresh[:, None] | fresh[None, :])] = -np.inf
    sims[sims <= least[:, None]] = -np.inf
    if sims.shape[1] > most:
        cols = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        vals = np.take_along_axis(sims, cols, axis=1)
    else:
        cols, vals = np.broadcast_to(np.arange(len(ids)), sims.shape), sims
    row, at = np.nonzero(vals > -np.inf)
    return ids[row], ids[cols[row, at]], vals[row, at]


def _joined(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    kinds = (np.int64, np.int64, np.float32)
    return [np.concatenate([p[i] for p in parts]).astype(k) if parts else np.zeros(0, dtype=k) for i, k in enumerate(kinds)]


def _coded(nodes: DataFrame) -> DataFrame:
    """``(id, code)``: vectors over the greatest length, in single precision."""
    length = F.sqrt(F.aggregate(F.transform("x", lambda v: F.pow(v / F.col("_most"), F.lit(2.0))), F.lit(0.0), lambda a, v: a + v)) * F.col("_most")
    most = F.array_max(F.transform("x", F.abs))
    longest = min(nodes.withColumn("_most", most).agg(F.max(length)).first()[0] or 1.0, np.finfo(np.float64).max)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = (np.array(b.column("x").to_pylist(), dtype=np.float64) / longest).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "code"])

    return nodes.mapInArrow(code, "id long, code binary")


def _top_links(edges: DataFrame) -> DataFrame:
    """The ``LINKS`` best distinct ``v`` of each ``u``; a link seen before is not new."""

    def best(b: pa.RecordBatch) -> list:
        u, v = (b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v"))
        sim, new = b.column("sim").to_numpy(zero_copy_only=False), b.column("new").to_numpy(zero_copy_only=False)
        order = np.lexsort((new, v, u))
        u, v, sim, new = u[order], v[order], sim[order], new[order]
        first = np.ones(len(u), dtype=bool)
        first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        u, v, sim, new = u[first], v[first], sim[first], new[first]
        order = np.lexsort((v, -sim, u))
        u, v, sim, new = u[order], v[order], sim[order], new[order]
        start = np.concatenate([[0], np.flatnonzero(np.diff(u)) + 1])
        rank = np.arange(len(u)) - np.repeat(start, np.diff(np.append(start, len(u))))
        keep = rank < LINKS
        return [u[keep], v[keep], sim[keep], new[keep]]

    return by_key(edges, "u", best, "u long, v long, sim float, new boolean")


def _first_links(coded: DataFrame, n: int) -> DataFrame:
    """Links between nodes that share a near pivot, compared in blocks of about ``BLOCK``."""
    wanted = int(min(MAX_PIVOTS, max(1, NEAR_PIVOTS * n // BLOCK)))
    got = coded.orderBy(F.xxhash64("id"), "id").limit(wanted).toArrow().combine_chunks().to_batches()
    pivots = coded.sparkSession.sparkContext.broadcast(_level(_vectors(got[0])) if got else None)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sims = _level(_vectors(b)) @ pivots.value.T
                k = min(NEAR_PIVOTS, sims.shape[1])
                pick = np.argpartition(-sims, k - 1, axis=1)[:, :k].astype(np.int64)
                at = pa.array(np.repeat(np.arange(b.num_rows), k))
                yield pa.RecordBatch.from_arrays([pa.array(pick.ravel()), *(b.column(c).take(at) for c in ("id", "code"))], names=["pivot", "id", "code"])

    placed = materialize(coded.mapInArrow(near, "pivot long, id long, code binary"), "blocks")
    parts = placed.groupBy("pivot").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("_parts"))
    split = placed.join(F.broadcast(parts), "pivot")
    split = split.withColumn("block", F.xxhash64("pivot", F.pmod(F.xxhash64("id"), F.col("_parts")))).select("block", "id", "code")

    def compare(b: pa.RecordBatch) -> list:
        x, ids, out = _level(_vectors(b)), b.column("id").to_numpy(zero_copy_only=False), []
        for s, e in spans(b.column("block").to_numpy(zero_copy_only=False)):
            out.append(_best_pairs(x[s:e], ids[s:e], np.full(e - s, -3.0), None, LINKS))
        u, v, sim = _joined(out)
        return [u, v, sim, np.ones(len(u), dtype=bool)]

    return _top_links(by_key(split, "block", compare, "u long, v long, sim float, new boolean"))


def _linked(links: DataFrame) -> DataFrame:
    """``(center, id, new)``: the nodes that a node is linked with by ``links``, or that are among the nearest to link it."""
    order = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    back = links.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= REVERSE)
    both = links.select(F.col("u").alias("center"), F.col("v").alias("id"), "new").unionByName(back.select(F.col("v").alias("center"), F.col("u").alias("id"), "new"))
    return both.groupBy("center", "id").agg(F.max("new").alias("new"))


def build_graph(coded: DataFrame, n: int) -> DataFrame:
    """Links ``(u, v, sim, new)`` by NN-descent."""
    links = materialize(_first_links(coded, n), "links")

    def meet(b: pa.RecordBatch) -> list:
        x, out = _level(_vectors(b)), []
        ids, least, new = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "least", "new"))
        for s, e in spans(b.column("center").to_numpy(zero_copy_only=False)):
            if new[s:e].any():
                out.append(_best_pairs(x[s:e], ids[s:e], least[s:e], new[s:e], PROPOSED))
        u, v, sim = _joined(out)
        return [u, v, sim, np.ones(len(u), dtype=bool)]

    while True:
        worst = links.groupBy(F.col("u").alias("id")).agg(F.when(F.count("*") >= LINKS, F.min("sim")).otherwise(-3.0).cast("float").alias("least"))
        sent = _linked(links).join(coded.join(worst, "id", "left").fillna(-3.0, ["least"]), "id")
        better = by_key(sent, "center", meet, "u long, v long, sim float, new boolean")
        after = materialize(_top_links(links.withColumn("new", F.lit(False)).unionByName(better)), "links")
        release(links)
        links = after
        if links.filter("new").count() <= CHANGED * n * LINKS:
            return links


def _starts(coded: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query, id, sim)``: the ``WIDTH`` best by inner product of a bounded sample of nodes."""

    def length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((_vectors(b) ** 2).sum(axis=1))], names=["id", "code", "length"])

    # two halves that may be the same nodes still hold as many as a query asks for
    half = max(TOP + 1, min(ENTRIES, coded.count() // ENTRY_SHARE) // 2)
    long = coded.mapInArrow(length, "id long, code binary, length double").orderBy(F.desc("length"), "id").limit(half).select("id", "code")
    any_ = coded.orderBy(F.xxhash64("id"), "id").limit(half)
    got = long.unionByName(any_).dropDuplicates(["id"]).toArrow().combine_chunks().to_batches()
    entries = coded.sparkSession.sparkContext.broadcast((got[0].column("id").to_numpy(), _vectors(got[0])) if got else None)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, x = entries.value
                k = min(WIDTH, len(ids))
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    sims = _vectors(part, "q_code") @ x.T
                    pick = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                    names = part.column("query").to_numpy(zero_copy_only=False)
                    columns = (np.repeat(names, k), ids[pick.ravel()], np.take_along_axis(sims, pick, axis=1).ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "id", "sim"])

    return queries.mapInArrow(best, "query long, id long, sim double").filter("query <> id")


def search_graph(graph: DataFrame, queries: DataFrame, coded: DataFrame) -> DataFrame:
    """``(query, id)``: candidates by greedy search of ``graph(node, ids)`` from each query's own node and ``_starts``.

    ``queries(query, q_code)``: a query's name is its node. Ids go first; vectors
    meet only in pairs that are new to the query.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sims = (_vectors(b) * _vectors(b, "q_code")).sum(axis=1)
                ok = np.flatnonzero(sims > b.column("least").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(ok)) for c in ("query", "id")), pa.array(sims[ok])], names=["query", "id", "sim"])

    order = Window.partitionBy("query").orderBy(F.desc("sim"), "id")
    own = queries.select("query", F.col("query").alias("id"), F.lit(2.0).alias("sim"))
    beam = materialize(own.unionByName(_starts(coded, queries)).withColumn("done", F.lit(False)), "beam")
    near, told = sized(coded, BROADCAST_BYTES), sized(queries, BROADCAST_BYTES)
    while True:
        open_ = beam.filter("not done").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= WIDTH)
        asked = materialize(open_.select("query", F.col("id").alias("node")), "asked")
        if not asked.limit(1).count():
            release(asked)
            return beam.select("query", "id")
        least = beam.groupBy("query").agg(F.when(F.count("*") >= BEAM, F.min("sim")).otherwise(-2.0).alias("least"))
        pairs = graph.join(sized(asked, BROADCAST_BYTES), "node").select("query", F.explode("ids").alias("id")).filter("query <> id").distinct()
        fresh = pairs.join(beam.select("query", "id"), ["query", "id"], "left_anti").join(least, "query")
        found = fresh.join(near, "id").join(told, "query").select("query", "id", "least", "code", "q_code").mapInArrow(compare, "query long, id long, sim double")
        known = beam.unionByName(found.withColumn("done", F.lit(False))).unionByName(
            asked.select("query", F.col("node").alias("id"), F.lit(None).cast("double").alias("sim"), F.lit(True).alias("done"))
        )
        merged = known.groupBy("query", "id").agg(F.max("sim").alias("sim"), F.max("done").alias("done"))
        after = materialize(merged.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= BEAM).drop("r"), "beam")
        release(beam, asked)
        beam = after


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def nearest(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row with ``is_query`` (a condition on ``id``) the ``top`` nearest others found."""
    ship_package(rows.sparkSession)
    vectors = materialize(clean_vectors(rows, key, vector), "vectors")
    members = vectors.groupBy("x").agg(F.min("id").alias("node"))
    nodes = materialize(members.select(F.col("node").alias("id"), "x"), "nodes")
    named = materialize(vectors.join(members, "x").select("id", "node"), "named")
    coded = materialize(_coded(nodes), "coded")
    n = coded.count()
    links = build_graph(coded, n)

    ends = _linked(links).groupBy("center").agg(F.collect_list("id").alias("ids"))
    graph = materialize(ends.withColumnRenamed("center", "node"), "graph")
    release(links)
    asking = named.filter(is_query)
    wanted = asking.select(F.col("node").alias("query")).distinct()
    queries = materialize(wanted.join(coded, F.col("query") == F.col("id")).select("query", F.col("code").alias("q_code")), "queries")
    pairs = search_graph(graph, queries, coded)
    q, c = nodes.select(F.col("id").alias("query"), F.col("x").alias("qx")), nodes.select("id", F.col("x").alias("cx"))
    scored = pairs.join(q, "query").join(c, "id").select("query", F.col("id").alias("node"), _dot(F.col("qx"), F.col("cx")).alias("score"))

    spread = Window.partitionBy("node", "part").orderBy("id")
    within = Window.partitionBy("node").orderBy("id")
    salted = named.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(spread)).filter(F.col("r") <= top + 1)
    leading = materialize(salted.withColumn("r", F.row_number().over(within)).filter(F.col("r") <= top + 1).select("node", F.col("id").alias("vec_id")), "leading")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = scored.join(leading, "node").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top + 1)
    lists = materialize(listed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near")), "lists")
    own = asking.join(lists, F.col("node") == F.col("query")).select(
        F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, top).alias("near")
    )
    return own.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", "x.score")


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    from tidemark.sources.tables import table

    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
