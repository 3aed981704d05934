"""Items into containers of fixed capacity, planned over the histogram of their sizes.

The plan needs only how many items have each size (at most as many rows as the capacity): best fit over
decreasing sizes is run on counts, groups of equally filled containers at a time. Items then take the planned
slots by their rank within their size, which is found by counts per (size, salt), so a size that a third of
all items have is no single task's work.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodewright.session import cut

SALTS = 256


@dataclass
class Group:
    """m containers with the same content: parts (size, how many of it), in order of placement."""

    m: int
    free: int
    parts: list[tuple[int, int]] = field(default_factory=list)


def best_fit(histogram: dict[int, int], capacity: int) -> list[Group]:
    """Best fit over decreasing sizes: each item goes where the least room is left for it, else into a new container.

    A container that takes one item stays the best fit for the next of this size, so a group's containers
    are filled one after the other, and a group splits in three at most: filled, partly filled, untouched.
    """
    by_free: dict[int, list[Group]] = {}
    frees: list[int] = []  # sorted keys of by_free
    done: list[Group] = []

    def put(g: Group) -> None:
        if not g.m:
            return
        if not g.free:
            done.append(g)
            return
        if g.free not in by_free:
            by_free[g.free] = []
            insort(frees, g.free)
        by_free[g.free].append(g)

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left > 0:
            k = bisect_left(frees, size)
            if k < len(frees):
                free = frees[k]
                g = by_free[free].pop()
                if not by_free[free]:
                    del by_free[free]
                    frees.pop(k)
            else:
                g = Group(-(-left // (capacity // size)), capacity)
            each = g.free // size
            full = min(g.m, left // each)
            put(Group(full, g.free - each * size, [*g.parts, (size, each)]))
            left -= full * each
            if full < g.m:
                if some := min(left, each):
                    put(Group(1, g.free - some * size, [*g.parts, (size, some)]))
                    left = 0
                rest = g.m - full - (1 if some else 0)
                if g.parts:
                    put(Group(rest, g.free, g.parts))
    return done + [g for f in frees for g in by_free[f]]


def slots(groups: list[Group]) -> pd.DataFrame:
    """Runs of planned slots: items of size with rank start..start + m * each - 1 go to containers base.., each of them `each`, from place on."""
    rows, used, base = [], {}, 0
    for g in groups:
        place = 0
        for size, each in g.parts:
            start = used.get(size, 0)
            rows.append((size, start, each, base, place))
            used[size] = start + g.m * each
            place += each
        base += g.m
    return pd.DataFrame(rows, columns=["size", "start", "each", "base", "place"]).sort_values(["size", "start"], ignore_index=True)


def items_of(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, token_start, size): one item per row (doc_id, n) with 0 < n; a larger one becomes full pieces and a rest."""
    n, k = F.col("n"), F.col("piece").cast("long")
    pieces = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / capacity).cast("int")))
    out = sizes.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", pieces.alias("piece"))
    return out.select("doc_id", "piece", (k * capacity).alias("token_start"), F.least(F.lit(capacity).cast("long"), n - k * capacity).cast("int").alias("size"))


def pack(sizes: DataFrame, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, token_start, size, container, position) of sizes (doc_id, n): where each document or piece goes.

    Documents without an id, or of null, zero or negative size, are left out; one of more than capacity is cut into full pieces
    and a rest, no other is cut. Containers count from 0, positions within one from 0. Repeated rows are items
    of their own. Deterministic: ranks go by (doc_id, piece). Empty tables give no rows.
    """
    items = cut(items_of(sizes, capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS))))
    counts = items.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    plan = slots(best_fit({r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}, capacity))  # at most `capacity` rows
    key = plan["size"].to_numpy(np.int64) << 40 | plan["start"].to_numpy(np.int64) if len(plan) else np.zeros(0, np.int64)
    each, base, place, start = (plan[c].to_numpy(np.int64) for c in ("each", "base", "place", "start"))

    def take(batches):
        for pdf in batches:
            rank = pdf["rank"].to_numpy()
            at = np.searchsorted(key, pdf["size"].to_numpy(np.int64) << 40 | rank, "right") - 1
            r = rank - start[at]
            yield pdf.drop(columns="rank").assign(container=base[at] + r // each[at], position=(place[at] + r % each[at]).astype(np.int32))

    before = counts.select("size", "salt", (F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "piece"))
    ranked = items.withColumn("local", local).join(before, ["size", "salt"])
    ranked = ranked.select("doc_id", "piece", "token_start", "size", (F.col("before") + F.col("local") - 1).alias("rank"))
    return ranked.mapInPandas(take, "doc_id long, piece int, token_start long, size int, container long, position int")
