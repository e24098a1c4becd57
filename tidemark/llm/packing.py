"""Best-fit packing of tokenized documents into sequences of at most ``capacity`` tokens.

Bulk-synchronous best fit. Documents are range-sorted by length, and a rank
within the length is each one's number in its range plus those of the ranges
before. Equal documents are a run, and so are equal gaps of open sequences:
``(size, first, n)``, of which ``capacity`` bounds the number and the data do
not. Rounds match runs of both, as distributed tables sorted by size:

* a successor sweep in each range of sizes gives each gap the longest documents
  that fit it, as many as it holds; smaller gaps choose first, and documents of
  one length go by rank, so that no two gaps get the same one;
* what finds nothing in its range meets in a second sweep across ranges;
* gaps are updated, at most halved by each round, and the next round begins.
  When no gap holds any document left, sequences are opened: ``OPENED`` of as
  many as the tokens left would fill.

The placed runs go back as a broadcast table, and each piece finds its place by
length and rank. The driver sees three numbers a round.

Defined results: a null text is an empty document of one token; the longest
texts are cut into pieces like others; repeated rows are packed each, ties in
the order of a hash; columns of the input but ``doc_id`` and ``text`` are left
out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.tokens import coder, share_tokenizer, word_tokenizer
from tidemark.sources.scratch import materialize, release

CAPACITY = 2048
#: Token that ends each document.
END_ID = 0
#: Ranges of size that are swept apart, and the share of the sequences still needed that is opened at once.
RANGES, OPENED = 8, 0.9
#: A run's columns, and its kinds in the order of a sweep.
RUN = ("part", "kind", "size", "first", "n", "seq", "offset", "each")
DOC, GAP, NEW, PLACED, LATER = range(5)


def tokenized_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``: a row per piece."""
    shared = share_tokenizer(docs.sparkSession, path or word_tokenizer())
    end = END_ID.to_bytes(4, "little")
    fields = [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared)
        for b in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for at, raw in enumerate(own.encode(b.column("text").to_pylist())):
                view = memoryview(raw + end)
                n = len(view) // 4
                for k, s in enumerate(range(0, n, capacity)):
                    part = view[4 * s : 4 * (s + capacity)]
                    row.append(at)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(part.cast("I").tolist())
            columns = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            columns += [pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(cut, T.StructType(fields))


def _sweep(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """One pass over runs sorted by ``(part, size, kind)``: each gap takes the longest documents that fit, nearest first.

    A gap of a part takes as many of a run's documents as it holds, or as there are.
    """
    out: list[tuple] = []
    waiting: list[list[int]] = []
    at = None

    def leave() -> None:
        out.extend((at, DOC, length, first, n, 0, 0, 0) for length, first, n in waiting)
        waiting.clear()

    for batch in batches:
        for part, kind, size, first, n, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != at:
                leave()
                at = part
            if kind == DOC:
                waiting.append([size, first, n])
            elif kind != GAP:
                out.append((part, kind, size, first, n, *rest))
            else:
                while n and waiting:
                    length, rank, left = waiting[-1]
                    each = min(size // length, left)
                    filled = min(n, left // each)
                    out.append((part, PLACED, length, rank, filled * each, first, capacity - size, each))
                    if size > each * length:
                        out.append((part, NEW, size - each * length, first, filled, 0, 0, 0))
                    first, n, rank, left = first + filled, n - filled, rank + filled * each, left - filled * each
                    if left:
                        waiting[-1] = [length, rank, left]
                    else:
                        waiting.pop()
                if n:
                    out.append((part, GAP, size, first, n, 0, 0, 0))
    leave()
    columns = list(zip(*out, strict=True)) or [()] * len(RUN)
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(RUN))


def _swept(runs: DataFrame, capacity: int) -> DataFrame:
    """Sweeps within ranges of size, then one over what found nothing in its range: the carried boundaries."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sweep(batches, capacity)

    schema = ", ".join(f"{c} long" for c in RUN)
    ranged = runs.withColumn("part", F.floor(F.col("size") * RANGES / (capacity + 1)).cast("long"))
    within = ranged.repartition(RANGES, "part").sortWithinPartitions("part", "size", "kind").mapInArrow(sweep, schema)
    across = within.withColumn("part", F.lit(0).cast("long")).repartition(1).sortWithinPartitions("size", "kind")
    return across.mapInArrow(sweep, schema)


def match_runs(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Where the documents of ``counts(length, n)`` go: a row for each run of equal documents in like sequences.

    ``(size, first, n, seq, offset, each)``: documents of length ``size`` with ranks from ``first``,
    ``n`` of them, lie from ``offset`` on in sequences from ``seq`` on, ``each`` to a sequence.
    """
    spark = counts.sparkSession
    zero = F.lit(0).cast("long")
    long = 2 * F.col("length") > capacity
    fields = {"part": zero, "kind": F.when(long, DOC).otherwise(LATER).cast("long"), "size": F.col("length").cast("long"), "first": zero, "n": F.col("n"), "seq": zero, "offset": zero, "each": zero}
    state = materialize(counts.select(*(c.alias(name) for name, c in fields.items())), "runs")
    asked = state.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("kind") == DOC, F.col("n"))), F.lit(0)).alias("long")).first()
    open_, sequences, left = state, asked["long"], asked["all"]
    fresh = [(0, GAP, capacity, 0, sequences, 0, 0, 0)]
    while left:
        if fresh:
            open_ = open_.unionByName(spark.createDataFrame(fresh, state.schema))
        seen = Observation()
        doc, gap = F.col("kind").isin(DOC, LATER), F.col("kind").isin(GAP, NEW)
        marks = (F.sum(F.when(doc, F.col("size") * F.col("n"))).alias("left"), F.min(F.when(doc, F.col("size"))).alias("least"), F.max(F.when(gap, F.col("size"))).alias("widest"))
        after = materialize(_swept(open_, capacity).observe(seen, *marks), "runs")
        release(state)
        state, fresh, (left, least, widest) = after, [], (seen.get[k] for k in ("left", "least", "widest"))
        if left and (widest or 0) < least:
            more = max(1, math.ceil(OPENED * left / capacity))
            fresh, sequences = [(0, GAP, capacity, sequences, more, 0, 0, 0)], sequences + more
        kind = F.when(F.col("kind") == NEW, GAP).when(F.col("kind") == LATER, DOC).otherwise(F.col("kind")).cast("long")
        open_ = state.withColumn("kind", kind).filter((F.col("kind") != GAP) | (F.col("size") >= (least or 0)))
    return state.filter(F.col("kind") == PLACED).drop("part", "kind")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id``, ``piece``, ``ids_crc32`` and ``length``."""
    ordered = pieces.withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32"))
    ordered = ordered.repartitionByRange("length", "_h").sortWithinPartitions("length", "_h").withColumn("_at", F.monotonically_increasing_id())
    ordered = materialize(ordered.drop("_h"), "ordered")
    # a task's numbers start at its number times 2 ** 33
    task = F.shiftright("_at", 33)
    sizes = materialize(ordered.groupBy("length", task.alias("_task")).agg(F.count("*").alias("n"), F.min("_at").alias("_first")), "sizes")
    plan = match_runs(sizes.groupBy("length").agg(F.sum("n").alias("n")), capacity)

    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    ranked = ordered.withColumn("_task", task).join(F.broadcast(starts), ["length", "_task"]).withColumn("_rank", F.col("_at") + F.col("_shift"))
    runs = plan.select(*(F.col(c).alias(f"_{c}") for c in plan.columns))
    within = F.col("_rank") - F.col("_first")
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("_size")) & (within >= 0) & (within < F.col("_n")))
    sequence = F.col("_seq") + F.floor(within / F.col("_each"))
    return placed.select(*pieces.columns, sequence.cast("long").alias("sequence_id"), (F.col("_offset") + within % F.col("_each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; with ``keep_ids`` also their tokens."""
    return pack_pieces(materialize(tokenized_pieces(docs, path, capacity, keep_ids), "pieces"), capacity)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    from tidemark.sources.tables import table

    return pack_documents(table(spark, sf_dir, "documents"))
