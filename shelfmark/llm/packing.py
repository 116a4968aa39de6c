"""Filling containers of fixed capacity: variable-capacity best fit over the histogram of sizes.

How items of one size are placed doesn't depend on which items they are, so the packing is computed on the
histogram of sizes, whose length is bounded by the capacity and not by the data.  Sizes are placed from the largest
down.  Open containers with the same contents are one range of container numbers; a size's items go into the
containers with the least free space that takes them, as many into each as it takes (best fit).  Where none does, containers are opened: of the
permitted lengths the one with the least cost for each token it will hold, given how much of its free space the
smaller items still to come can fill; no more of them than those can fill, and the rest by the cost of their own items alone.
At the end every container is downsized to the shortest permitted length that takes its contents.

The result is a table of moves (from position, from container, items to a container), with which a distributed pass gives every item its container.
Its size doesn't grow with the items: a range that takes items keeps less than half of its free space, so it takes items of at most
log2(capacity) sizes, and a size opens or splits at most ``len(lengths) + 4`` ranges; so there are at most
sizes x (len(lengths) + 4) x (log2(capacity) + 2) moves, however many items a size has.

Defined results: null and empty texts get no container; a text larger than the capacity is cut into full pieces, each
with a container of its own, and a rest that is packed like any item; no other text is cut.  Equal sizes are ordered by
key.  Keys must be unique; repeated texts are items of their own.  An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tokens that a container costs besides its length (separators, padding to blocks, bookkeeping).
OVERHEAD = 16
#: Parts into which the items of one size are counted, so that a size that a third of all items has is no one's task.
CHUNKS = 256


def plan(histogram: Mapping[int, int], lengths: Sequence[int], overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray]:
    """(moves, containers) of the packing of ``histogram`` (size -> items) into containers of the permitted ``lengths``.

    moves: rows (position, container, per): the items from this position on, counted over sizes from the largest down, go to this container and
    the following ones, ``per`` to each.  containers: rows (container, number, length, used).
    """
    lengths = sorted(set(lengths))
    free: dict[int, list[tuple[int, int, int]]] = {}  # free space -> ranges (first container, number, length opened with)
    order: list[int] = []  # free spaces in use, ascending
    moves, position, opened = [], 0, 0
    ahead = sum(s * n for s, n in histogram.items())  # tokens not yet placed
    room = 0  # free tokens in open containers

    def put(space: int, start: int, number: int, length: int) -> None:
        if not number:
            return
        if space not in free:
            free[space] = []
            insort(order, space)
        ranges = free[space]
        if ranges and ranges[-1][0] + ranges[-1][1] == start and ranges[-1][2] == length:
            ranges[-1] = (ranges[-1][0], ranges[-1][1] + number, length)
        else:
            ranges.append((start, number, length))

    def fill(space: int, start: int, number: int, length: int, size: int, left: int) -> int:
        """Items of ``size`` put into a range, as many into each container as it takes; what isn't needed stays as it was."""
        nonlocal position
        per = space // size
        whole = min(number, left // per)
        if whole:
            moves.append((position, start, per))
            put(space - per * size, start, whole, length)
            position += whole * per
        rest = min(left - whole * per, per) if whole < number else 0
        if rest:
            moves.append((position, start + whole, rest))
            put(space - rest * size, start + whole, 1, length)
            position += rest
        put(space, start + whole + bool(rest), number - whole - bool(rest), length)
        return whole * per + rest

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            i = bisect_left(order, size)
            if i < len(order):
                space = order[i]
                start, number, length = free[space].pop()
                if not free[space]:
                    del free[space], order[i]
            else:
                spare = max(0, ahead - size * left - room)  # tokens of smaller items that no open container has room for
                fits = [x for x in lengths if x >= size]

                def cost(x: int) -> tuple[float, int]:
                    per = min(x // size, left)
                    return (x + overhead) / (per * size + min(x - per * size, spare * per / left)), -x

                length = min(fits, key=cost)
                per = min(length // size, left)
                number = -(-left // per)
                gap = length - per * size
                if gap and (fillable := int(spare // gap)) < number:
                    if fillable:
                        number = fillable
                    else:  # nothing is left to fill gaps with
                        length = min(fits, key=lambda x: ((x + overhead) / (min(x // size, left) * size), -x))
                        number = -(-left // min(length // size, left))
                space, start = length, opened
                opened += number
                room += length * number
            taken = fill(space, start, number, length, size, left)
            left -= taken
            ahead -= size * taken
            room -= size * taken
    rows = []
    for space, ranges in free.items():
        for start, number, length in ranges:
            used = length - space
            rows.append((start, number, lengths[bisect_left(lengths, used)], used))
    rows.sort()
    return np.array(moves, dtype=np.int64).reshape(-1, 3), np.array(rows, dtype=np.int64).reshape(-1, 4)


def items_of(sizes: DataFrame, profiles: Sequence[tuple[str, int]]) -> DataFrame:
    """(profile, capacity, key, piece, n_tokens, number) of (key, tokens): full pieces as one row, with their number, and the rest.

    ``piece`` is the number of the first piece that a row stands for.
    """
    rules = F.array(*[F.struct(F.lit(name).alias("profile"), F.lit(capacity).cast("bigint").alias("capacity")) for name, capacity in profiles])
    rows = sizes.filter("tokens > 0").select("key", F.col("tokens").cast("bigint").alias("tokens"), F.inline(rules))
    full, rest = F.expr("tokens div capacity"), F.col("tokens") % F.col("capacity")
    parts = F.array(F.struct(F.lit(0).cast("bigint").alias("piece"), F.col("capacity").alias("n_tokens"), full.alias("number")), F.struct(full.alias("piece"), rest.alias("n_tokens"), F.lit(1).cast("bigint").alias("number")))
    return rows.select("profile", "capacity", "key", F.inline(parts)).filter("number > 0 and n_tokens > 0")


def pack_profiles(sizes: DataFrame, profiles: Sequence[tuple[str, int]], lengths: Sequence[int] = (), overhead: int = OVERHEAD) -> DataFrame:
    """(profile, key, piece, first_token, n_tokens, container, container_tokens) for (key, tokens) and every (profile, capacity); keys unique.

    ``lengths``: permitted lengths of containers besides each capacity; those over a profile's capacity don't count for it.
    All profiles go through the same pass: counts per size and chunk, their running sums (small tables), and the order within a chunk.
    """
    chunked = items_of(sizes, profiles).withColumn("_chunk", F.pmod(F.xxhash64("key", "piece"), F.lit(CHUNKS)).cast("int"))
    counts = chunked.groupBy("profile", "n_tokens", "_chunk").agg(F.sum("number").alias("_n"))
    # At most the sum of the capacities rows: the histogram is bounded by the sizes there are, not by the items.
    histograms: dict[str, dict[int, int]] = {name: {} for name, _ in profiles}
    for r in counts.groupBy("profile", "n_tokens").agg(F.sum("_n").alias("n")).collect():
        histograms[r["profile"]][int(r["n_tokens"])] = int(r["n"])
    plans, starts = {}, {}
    for name, capacity in profiles:
        plans[name] = plan(histograms[name], sorted({x for x in lengths if x <= capacity} | {capacity}), overhead)
        total, starts[name] = 0, {}
        for size in sorted(histograms[name], reverse=True):
            starts[name][size] = total
            total += histograms[name][size]
    by_size = Window.partitionBy("profile", "n_tokens").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_start", F.coalesce(F.sum("_n").over(by_size), F.lit(0))).drop("_n")
    inside = Window.partitionBy("profile", "n_tokens", "_chunk").orderBy("key", "piece").rowsBetween(Window.unboundedPreceding, -1)
    ranked = chunked.join(offsets, ["profile", "n_tokens", "_chunk"]).withColumn("_rank", F.col("_start") + F.coalesce(F.sum("number").over(inside), F.lit(0)))
    each = ranked.select("profile", "capacity", "key", "n_tokens", "_rank", F.col("piece").alias("_first"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("number") - 1)).alias("_i"))
    each = each.select("profile", "key", (F.col("_first") + F.col("_i")).cast("int").alias("piece"), ((F.col("_first") + F.col("_i")) * F.col("capacity")).alias("first_token"), "n_tokens", (F.col("_rank") + F.col("_i")).alias("_rank"))
    shared = sizes.sparkSession.sparkContext.broadcast((starts, plans))  # bounded by the capacities, see above

    def look_up(profile: pd.Series, n_tokens: pd.Series, rank: pd.Series) -> pd.DataFrame:
        first, planned = shared.value
        container, length = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
        for name, rows in profile.groupby(profile).indices.items():
            moves, bins = planned[name]
            at = n_tokens.iloc[rows].map(first[name]).to_numpy(dtype=np.int64) + rank.iloc[rows].to_numpy(dtype=np.int64)
            m = np.searchsorted(moves[:, 0], at, side="right") - 1
            container[rows] = moves[m, 1] + (at - moves[m, 0]) // moves[m, 2]
            length[rows] = bins[np.searchsorted(bins[:, 0], container[rows], side="right") - 1, 2]
        return pd.DataFrame({"container": container, "container_tokens": length})

    found = each.withColumn("_c", F.pandas_udf(look_up, "struct<container bigint, container_tokens bigint>")("profile", "n_tokens", "_rank"))
    return found.select("profile", "key", "piece", "first_token", "n_tokens", "_c.container", "_c.container_tokens")


def pack(sizes: DataFrame, capacity: int, lengths: Sequence[int] | None = None, overhead: int = OVERHEAD) -> DataFrame:
    """(key, piece, first_token, n_tokens, container, container_tokens) for (key, tokens) and one capacity; keys unique."""
    return pack_profiles(sizes, [("", capacity)], lengths or (), overhead).drop("profile")
