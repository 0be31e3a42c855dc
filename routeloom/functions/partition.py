"""Multi-level partition ids.

``levels`` lists the branching factors from the bottom up.  A node stores its id at level 0;
the id at level k is that divided by the product of the first k factors.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F


def partition_id(partition: Column, level: int, levels: Sequence[int]) -> Column:
    return F.floor(partition / F.lit(prod(levels[:level]))).cast("long") if level else partition.cast("long")


def all_partition_ids(partition: Column, levels: Sequence[int]) -> Column:
    return F.array(*[partition_id(partition, k, levels) for k in range(len(levels) + 1)])


def differing_level(a: Column, b: Column, levels: Sequence[int]) -> Column:
    """Smallest level at which the ids agree: 0 in one cell, len(levels) at most."""
    out = F.lit(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        out = F.when(partition_id(a, k, levels) == partition_id(b, k, levels), F.lit(k)).otherwise(out)
    return out
