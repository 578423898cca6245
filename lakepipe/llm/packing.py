"""Best-fit packing into bins of several permitted lengths.

Lengths are whole numbers up to the largest capacity, so all that packing depends on is how many pieces there are of each
length. That histogram goes to the driver and is packed by best-fit decreasing, whole groups of equal bins at a time: a
piece goes to the open bin with the least room that holds it; if none does, the capacity is opened whose cost for each
token it can expect to hold is least; in the end each bin shrinks to the smallest capacity that holds its contents. The
plan says, for ranges of the pieces of a length, in which bins they lie. Its size depends on the largest capacity, not
on the number of documents; the pieces then find their bins by their number among the pieces of their length.

Defined results: documents longer than the largest capacity are cut into pieces of it and a rest, in order; a document
without tokens gets one row of size 0 without a bin. Rows that are alike are packed each for itself. No rows: no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakepipe.llm.common import written

#: Permitted sequence lengths.
CAPACITIES = (512, 1024, 2048, 4096, 8192)


def bin_cost(capacity: int) -> float:
    """Tokens computed, a fixed share for each bin, and attention that grows with the square."""
    return capacity + 32 + capacity * capacity / 262_144


@dataclass(frozen=True)
class Plan:
    """Columns of segments, ordered by (size, first): pieces ``first…`` of ``size`` lie ``each`` to a bin from ``bin`` on,
    the first of them at ``offset``. ``starts`` and ``lengths``: ranges of bins and their final capacity."""

    size: np.ndarray
    first: np.ndarray
    bin: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    n_bins: int

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bin, offset and capacity of the pieces with that size and number among their size."""
        # size and rank as one key; ranks are below 2**46, sizes below 2**17
        keys = self.size.astype(np.int64) << 46 | self.first
        order = np.searchsorted(keys, size.astype(np.int64) << 46 | rank, side="right") - 1
        nth = rank - self.first[order]
        bins = self.bin[order] + nth // self.each[order]
        offset = self.offset[order] + nth % self.each[order] * size
        return bins, offset, self.lengths[np.searchsorted(self.starts, bins, side="right") - 1]


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = bin_cost) -> Plan:
    """Packs ``{size: pieces}``; sizes are from 1 to the largest capacity."""
    capacities = tuple(sorted(capacities))
    sizes = sorted((s for s, n in histogram.items() if n), reverse=True)
    if sizes and (sizes[0] > capacities[-1] or sizes[-1] < 1):
        raise ValueError("a piece does not fit any bin")
    smaller = np.zeros(capacities[-1] + 2)  # tokens of pieces up to a size, of those not yet packed
    for s in sizes:
        smaller[s] = s * histogram[s]
    smaller = smaller.cumsum()
    room: dict[int, list[tuple[int, int, int]]] = {}  # what is left -> ranges (first bin, bins, capacity opened)
    rooms: list[int] = []
    segments: list[tuple[int, int, int, int, int]] = []
    full: list[tuple[int, int, int]] = []  # first bin, bins, contents
    n_bins = 0

    def put(left: int, at: int, count: int, opened: int) -> None:
        if not count:
            return
        if left == 0:
            full.append((at, count, opened))
            return
        if left not in room:
            room[left] = []
            insort(rooms, left)
        room[left].append((at, count, opened))

    for s in sizes:
        todo, rank = histogram[s], 0
        waiting = smaller[s - 1]  # tokens of smaller pieces
        while todo:
            k = bisect_left(rooms, s)
            if k < len(rooms):
                left = rooms[k]
                at, count, opened = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(k)
            else:
                best = None
                for c in capacities:
                    if c >= s:
                        same = min(todo, c // s) * s
                        bins = -(-todo // (c // s))
                        fill = min(float(c), same + min(c - same, waiting / bins))
                        score = cost(c) / fill
                        if best is None or score < best[0] - 1e-12:
                            best = (score, c)
                opened = left = best[1]
                at, count = n_bins, -(-todo // (opened // s))
                n_bins += count
            each = left // s
            use = min(count, todo // each)
            if use:
                segments.append((s, rank, at, each, opened - left))
                put(left - each * s, at, use, opened)
                todo -= use * each
                rank += use * each
                put(left, at + use, count - use, opened)
            else:  # the last few share one bin
                segments.append((s, rank, at, todo, opened - left))
                put(left - todo * s, at, 1, opened)
                put(left, at + 1, count - 1, opened)
                todo = 0
    final = [(at, capacities[bisect_left(capacities, contents)]) for at, _, contents in full]
    final += [(at, capacities[bisect_left(capacities, opened - left)]) for left, ranges in room.items() for at, _, opened in ranges]
    final.sort()
    segments.sort()
    cols = np.array(segments, dtype=np.int64).reshape(-1, 5).T
    ends = np.array(final, dtype=np.int64).reshape(-1, 2).T
    return Plan(cols[0], cols[1], cols[2], cols[3], cols[4], ends[0], ends[1], n_bins)


def pack(sizes: DataFrame, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = bin_cost, doc_id: str = "doc_id", size: str = "size") -> DataFrame:
    """A row for each piece of a document: doc_id, piece, start, size, bin_id, bin_offset, bin_capacity.

    ``sizes``: ids and numbers of tokens. Pieces of one size are numbered in groups by a hash of their id (without one, by where
    they lie), so a size that very many documents have is no single task's work.
    """
    most = max(capacities)
    rows = sizes.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"))
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / most)).cast("int")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("piece").cast("long") * most
    pieces = pieces.select("doc_id", "piece", start.alias("start"), F.least(F.lit(most).cast("long"), F.col("n") - start).cast("int").alias("size"))
    # where a row lies is looked at once, and written
    at = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id", "piece"))
    pieces = written(pieces.withColumn("at", at), "pieces")
    total = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pieces = sum(total.values())
    found = plan({s: n for s, n in total.items() if s}, capacities, cost)

    salts = max(64, math.ceil(n_pieces / 500_000))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("size", "salt", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("size", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("nth", F.row_number().over(own)).join(groups, ["size", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "size", (F.col("base") + F.col("nth") - 1).alias("rank"))

    schema = ranked.drop("rank").schema.add("bin_id", "long").add("bin_offset", "integer").add("bin_capacity", "integer")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("size").to_numpy(), b.column("rank").to_numpy()
            none = length == 0
            bins, offset, capacity = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            if not none.all():
                bins[~none], offset[~none], capacity[~none] = found.place(length[~none], rank[~none])
            out = [pa.array(bins, pa.int64(), mask=none), pa.array(offset.astype(np.int32), pa.int32(), mask=none), pa.array(capacity.astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "size")), *out], names=[f.name for f in schema])

    return ranked.mapInArrow(place, schema)
