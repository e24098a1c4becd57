"""Column helpers over arrays, all built from JVM functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds ``value`` once for ``body``, so that lambdas in it do not evaluate it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """Inclusive prefixes of an array of longs under an associative ``combine`` with zero as its neutral element.

    Appending to one growing array costs the square of its length, so prefixes
    are made within blocks and combined with the totals of the blocks before.
    """
    zero = F.lit(0).cast("long")

    def append(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(combine(F.element_at(acc, -1), x)))

    def blocks(xs: Column) -> Column:
        count = F.ceil(F.size(xs) / F.lit(block)).cast("int")
        part = lambda b: F.slice(xs, b * block + 1, block)
        starts = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.aggregate(part(b), zero, combine))
        return let(
            F.aggregate(starts, F.array(zero), append),
            lambda shift: F.flatten(
                F.transform(
                    F.sequence(F.lit(0), count - 1),
                    lambda b: F.slice(F.aggregate(part(b), F.array(F.get(shift, b)), append), 2, block),
                )
            ),
        )

    return let(values, lambda xs: F.when(F.size(xs) > 0, blocks(xs)).otherwise(xs))


def running_sum(values: Column) -> Column:
    """Inclusive prefix sums of an array of longs."""
    return running(values, lambda a, x: a + x)


def running_xor(values: Column) -> Column:
    """Inclusive prefixes of an array of longs under exclusive or."""
    return running(values, lambda a, x: a.bitwiseXOR(x))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
