"""Arrow work on whole groups of a key, in rows that Spark has dealt and sorted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def runs(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches cut between keys, of rows sorted by key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = whole.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield whole.slice(0, cut)
            held = [whole.slice(cut)]
        else:
            held = [whole]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def spans(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and end of each run of equal keys."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True)


def by_key(df: DataFrame, key: str, work: Callable[[pa.RecordBatch], list], schema: str) -> DataFrame:
    """``work`` on whole groups of ``key``, many at a time; it returns columns."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, key):
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in work(b)], names=names)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)
