"""Filling containers of fixed capacity by hierarchical residual packing.

Every partition packs its items best-fit decreasing. Bins filled to the mark
are final; the others become items of the next round, in which fewer partitions
pack them again, by turns hashed anew and with bins of complementary fill together. Rounds end
when a single partition has packed everything or two rounds on end have combined nothing. A round reads a bin as a name and a fill, about
``group_items`` to a task; which bins went into which is kept apart and joined to the items at the end.

Defined results: an item larger than the capacity is cut into full containers
and one rest; an item of no size (null or empty text) lies in some container
of its partition; repeated ids are separate items; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.tables import written


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the items in each bin, best-fit decreasing; ties go to the item that comes first."""
    room: list[tuple[int, int]] = []  # (free space, bin), sorted
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        insort(room, (free - sizes[i], b))
    return bins


def _pack(frames: Iterator[pd.DataFrame], capacity: int) -> Iterator[pd.DataFrame]:
    """(bin, into, fill): the bin that each of a partition's bins goes into, by the name of its first, and what that then holds."""
    parts = [f for f in frames if len(f)]
    if not parts:
        return
    rows = pd.concat(parts).sort_values("bin")  # arrival order never shows in the result
    names, used = rows["bin"].tolist(), rows["used"].tolist()
    out = []
    for own in best_fit(used, capacity):
        fill, head = sum(used[i] for i in own), min(names[i] for i in own)
        out += [(names[i], head, fill) for i in own]
    yield pd.DataFrame(out, columns=["bin", "into", "fill"])


def pack(items: DataFrame, item: str, size: str, capacity: int, full_share: float = 0.995, group_items: int = 20_000) -> DataFrame:
    """(container, item, piece, size, used) of every piece of every item."""
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0))
    pieces = items.select(F.col(item).alias("item"), n.alias("n")).select(
        "item", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)))).alias("piece")
    ).select("item", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("size"))
    # numbered once, so that every round reads the same names
    pieces = written(pieces.withColumn("bin", F.monotonically_increasing_id()), "pieces")
    full, rounds, idle, number = int(capacity * full_share), [], 0, 0
    todo = pieces.filter(F.col("size") < capacity).select("bin", F.col("size").alias("used"))
    count = todo.count()
    while count and idle < 2:
        groups = -(-count // group_items)
        if groups == 1:
            spread = todo.coalesce(1)
        elif number % 2:
            # what could fill each other up lies at like distance from empty and from full
            spread = todo.repartitionByRange(groups, F.least("used", F.lit(capacity) - F.col("used")), F.xxhash64("bin", F.lit(number)))
        else:
            # a row's group comes from its name, so a recomputed task packs the same items again
            spread = todo.repartition(groups, F.xxhash64("bin", F.lit(number)))
        packed = written(spread.mapInPandas(partial(_pack, capacity=capacity), "bin bigint, into bigint, fill int"), "round")
        rounds.append(packed)
        if groups == 1:
            break
        heads = packed.filter("bin = into")
        todo = heads.filter(F.col("fill") < full).select("bin", F.col("fill").alias("used"))
        left = heads.count()
        idle, count, number = idle + 1 if left == count else 0, todo.count(), number + 1
    last = None
    for r in reversed(rounds):
        if last is None:
            last = r
            continue
        later = last.select(F.col("bin").alias("into"), F.col("into").alias("then"), F.col("fill").alias("more"))
        last = r.join(later, "into", "left").select("bin", F.coalesce("then", "into").alias("into"), F.coalesce("more", "fill").alias("fill"))
    if last is None:
        return pieces.select(F.col("bin").alias("container"), "item", "piece", "size", F.col("size").alias("used"))
    return pieces.join(last, "bin", "left").select(
        F.coalesce("into", "bin").alias("container"), "item", "piece", "size", F.coalesce("fill", "size").alias("used"))
