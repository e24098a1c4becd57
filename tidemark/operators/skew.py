"""Joins of a large table with one row a key, where a few keys may hold most of the large table's rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that are more than this share of all rows are split; so at most its inverse of keys are, whatever the data.
HEAVY_SHARE = 1 / 512


def join_per_key(large: DataFrame, single: DataFrame, keys: Sequence[str], count: str, total: int, spread: str) -> DataFrame:
    """``large`` with the columns of ``single``, which has one row for each of ``keys``.

    ``single[count]`` is the number of rows of the key in ``large`` and ``total``
    that of all. A heavy key is salted by the column ``spread`` of ``large``: its
    row in ``single`` is copied, once for each share of ``HEAVY_SHARE``, and its
    rows in ``large`` are dealt over the copies. Only the heavy keys, at most
    ``1 / HEAVY_SHARE``, are broadcast. Rows with a null key are left out.
    """
    names, share = list(keys), max(1.0, total * HEAVY_SHARE)
    copies = F.ceil(F.col(count) / share).cast("int")
    heavy = F.broadcast(single.filter(F.col(count) > share).select(*names, copies.alias("_copies")))
    salted = large.join(heavy, names, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_copies", F.lit(1))).cast("int"))
    copied = single.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop(count)
    return salted.drop("_copies").join(copied, [*names, "_salt"]).drop("_salt")
