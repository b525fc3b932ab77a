"""Filling containers of fixed capacity by bulk-synchronous best-fit.

Each superstep sorts the documents still to be placed and the open gaps together by size, over all partitions, and
matches them by a successor sweep: going up the sizes, documents are put on a stack and each gap takes the largest one
below it. Within a partition a gap goes on taking the largest document that fits while more than `share` of it is left,
so gaps shrink by a fixed factor a superstep and many small documents need few of them. What a partition leaves open is
matched across partitions by rank: the counts of open documents and gaps of each partition, two numbers each, tell which
ranks of which partitions meet, and a join on partition and rank brings them together. Then gaps are updated and the
step repeats. A superstep that places nothing opens as many containers as the documents left would fill, and from then
on gaps are filled at once. Sizes are sorted together with row numbers, so a size that a third of all rows share is
split over the tasks. Only the counts and the number of what is left pass through the driver.

`pack_runs` is an exact best-fit-decreasing for moderate capacities, over runs of equal size; it leaves a little less
room unused, and goes through the runs one by one.

Defined cases: null sizes and sizes of zero or less get no container; an item larger than the capacity is divided into
full containers and one rest, which is placed like any other item; equal sizes and repeated ids are separate items;
an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import cut_lineage, written


#: The largest capacity that `pack` takes.
MAX_CAPACITY = 32_768


#: Of a gap that goes on taking documents in one superstep, so much has to be left.
SHARE = 0.25
#: Documents that one task sweeps.
ROWS = 50_000


def most_placed(runs: int, capacity: int) -> int:
    """The proven bound on placed runs."""
    return 2 * (runs + 3 * runs * (capacity.bit_length() + 1))


def best_fit_runs(runs: list[tuple[int, int]], capacity: int) -> tuple[np.ndarray, int]:
    """Placed runs (size, first rank, documents, first container, documents a container) and the number of containers.

    runs: (size, documents of this size), sizes from 1 to the capacity.

    Only the histogram of sizes and the list of placed runs pass through the driver, and both are bounded by the capacity C
    and not by the rows. Let there be D <= C document runs. A superstep takes one gap run. If it uses the run up, it leaves
    one run in its place, whose gap is the old one modulo the size and thus less than half of it; so a run is used up at
    most log2(C) + 1 times before its gap is 0. If it doesn't, it ends the document run and leaves at most three runs. So at
    most 3 D runs are ever made, there are at most D + 3 D (log2(C) + 1) supersteps, and each places at most two runs. With
    capacities above MAX_CAPACITY the list could pass 130 MB, so they are refused.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first container, containers), sorted
    bits = 0  # bit g is set while a container has gap g
    opened = 0
    placed: list[tuple[int, int, int, int, int]] = []

    def add(gap: int, first: int, n: int) -> None:
        nonlocal bits
        if gap and n:
            insort(gaps.setdefault(gap, []), (first, n))
            bits |= 1 << gap

    for size, count in sorted(runs, reverse=True):
        rank = 0
        while rank < count:
            above = bits >> size
            if above:
                gap = size + (above & -above).bit_length() - 1
                first, n = gaps[gap].pop(0)
                if not gaps[gap]:
                    bits ^= 1 << gap
            else:
                gap, first = capacity, opened
                n = -(-(count - rank) // (capacity // size))
                opened += n
            each = gap // size
            full = min(n, (count - rank) // each)
            if full:
                placed.append((size, rank, full * each, first, each))
                add(gap - each * size, first, full)
                rank += full * each
            if full < n:
                rest = min(count - rank, each)
                if rest:
                    placed.append((size, rank, rest, first + full, each))
                    add(gap - rest * size, first + full, 1)
                    rank += rest
                    full += 1
                add(gap, first + full, n - full)
    assert len(placed) <= most_placed(len(runs), capacity)
    return np.array(placed, np.int64).reshape(-1, 5), opened


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the rank of each row among the rows of its size in this partition."""
    seen: dict[int, int] = {}
    for b in batches:
        size = b.column("size").to_numpy()
        order = np.argsort(size, kind="stable")
        values, starts, counts = np.unique(size[order], return_index=True, return_counts=True)
        base = np.array([seen.get(int(v), 0) for v in values], np.int64)
        rank = np.empty(len(size), np.int64)
        rank[order] = np.arange(len(size)) - np.repeat(starts, counts) + np.repeat(base, counts)
        seen.update((int(v), int(x)) for v, x in zip(values, base + counts))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank)], names=[*b.schema.names, "local"])


def _items(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, part_no, start, size) of all items with a size; those over the capacity in parts."""
    base = sizes.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("whole")).where("whole > 0")
    parts = F.transform(F.sequence(F.lit(0), ((F.col("whole") - 1) / capacity).cast("int")), lambda i: i.cast("int"))
    return base.select("id", "whole", F.explode(parts).alias("k")).select("id", (F.col("k") + 1).cast("int").alias("part_no"), (F.col("k").cast("long") * capacity).alias("start"), F.least(F.lit(capacity), F.col("whole") - F.col("k").cast("long") * capacity).cast("int").alias("size"))


def _sweep(share: float):
    """One partition of (size, kind, ref) in order; kind 0: document, 1: gap. Gives (tag, pid, rank, size, ref, container).

    tag 0: a placed document; 1: one left over, ranked from the largest down; 2: a gap left over, ranked upwards; 3: what
    remains of a gap that took documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        sizes: list[int] = []  # the stack, always sorted
        refs: list[int] = []
        gaps = 0

        def made(rows: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
            tag, rank, size, ref, container = zip(*rows) if rows else ((),) * 5
            return pa.RecordBatch.from_arrays([pa.array(tag, pa.int32()), pa.array([pid] * len(tag), pa.int32()), pa.array(rank, pa.int64()), pa.array(size, pa.int32()), pa.array(ref, pa.int64()), pa.array(container, pa.int64())], names=["tag", "pid", "rank", "size", "ref", "container"])

        for b in batches:
            out = []
            for size, kind, ref in zip(*(b.column(c).to_pylist() for c in ("size", "kind", "ref"))):
                if kind == 0:
                    sizes.append(size)
                    refs.append(ref)
                elif not sizes:
                    out.append((2, gaps, size, -1, ref))
                    gaps += 1
                else:
                    left, at = size, len(sizes) - 1
                    while at >= 0:
                        left -= sizes[at]
                        out.append((0, 0, sizes.pop(at), refs.pop(at), ref))
                        at = bisect_right(sizes, left) - 1 if left > size * share else -1
                    if left:
                        out.append((3, 0, left, -1, ref))
            yield made(out)
        for i in range(0, len(sizes), 50_000):
            n = len(sizes)
            yield made([(1, k, sizes[n - 1 - k], refs[n - 1 - k], -1) for k in range(i, min(i + 50_000, n))])

    return run


def _segments(counts: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int]]:
    """(document partition, first rank, gap partition, first rank, n): what partitions have left over, matched by rank.

    counts: (partition, tag) to the number left over. In a partition the gaps left come before the documents left.
    """
    out, stack = [], []
    for pid in sorted({p for p, _ in counts}):
        gaps, at = counts.get((pid, 2), 0), 0
        while at < gaps and stack:
            of, first, n = stack.pop()
            take = min(n, gaps - at)
            out.append((of, first, pid, at, take))
            at += take
            if take < n:
                stack.append((of, first + take, n - take))
        if counts.get((pid, 1), 0):
            stack.append((pid, 0, counts[pid, 1]))
    return out


def superstep(rows: DataFrame, tasks: int, share: float) -> tuple[DataFrame, DataFrame, int]:
    """Rows left, (ref, container) of the documents placed, and their number. rows: (size, kind, ref)."""
    spark = rows.sparkSession
    order = ["size", "kind", "ref"]
    out = written(rows.select(*order).repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(_sweep(share), "tag int, pid int, rank long, size int, ref long, container long"))
    counts = {(r["pid"], r["tag"]): r["n"] for r in out.groupBy("pid", "tag").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments = _segments(counts)
    found = sum(n for (_, tag), n in counts.items() if tag == 0) + sum(n for *_, n in segments)
    document = lambda df: df.select("size", F.lit(0).alias("kind"), "ref")
    gap = lambda df: df.select("size", F.lit(1).alias("kind"), F.col("container").alias("ref"))
    placed = out.where("tag = 0").select("ref", "container")
    if not segments:  # each partition settled its own
        return document(out.where("tag = 1")).unionByName(gap(out.where("tag >= 2"))), placed, found

    meet = F.broadcast(spark.createDataFrame(segments, "of int, first long, pid int, at long, n long"))  # at most two a partition
    documents = out.where("tag = 1").select("rank", "size", "ref", F.col("pid").alias("of")).join(meet, "of").where("rank >= first AND rank < first + n")
    documents = documents.select("ref", "size", "pid", (F.col("at") + F.col("rank") - F.col("first")).alias("rank"))
    gaps = out.where("tag = 2").select("pid", "rank", "container", F.col("size").alias("gap"))
    pairs = written(documents.join(gaps.hint("merge"), ["pid", "rank"]).select("ref", "container", (F.col("gap") - F.col("size")).alias("size")))
    left = document(out.where("tag = 1").join(pairs.select("ref").hint("merge"), "ref", "left_anti"))
    for part in (out.where("tag = 3"), pairs.where("size > 0"), out.where("tag = 2").join(pairs.select("container").hint("merge"), "container", "left_anti")):
        left = left.unionByName(gap(part))
    return written(left), placed.unionByName(pairs.select("ref", "container")), found


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int, share: float = SHARE) -> DataFrame:
    """(id, part_no, start, size, container_id): where each item, or each part of a divided one, goes.

    part_no counts from 1 and start is the part's first unit within the item.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    spark = sizes.sparkSession
    items = written(_items(sizes, id_col, size_col, capacity).withColumn("ref", F.monotonically_increasing_id()))
    rows = items.where(F.col("size") < capacity).select("size", F.lit(0).alias("kind"), "ref")
    placed = items.where(F.col("size") == capacity).select("ref", (-1 - F.col("ref")).alias("container"))  # one each
    opened, found = 0, 0
    while True:
        n, room = rows.where("kind = 0").agg(F.count(F.lit(1)), F.sum("size")).first()
        if not n:
            break
        if not found:  # the first step, or one that could place nothing
            new = -(-room // capacity)
            share = share if not opened else 0.0
            rows = rows.unionByName(spark.range(opened, opened + new).select(F.lit(capacity).alias("size"), F.lit(1).alias("kind"), F.col("id").alias("ref")))
            opened += new
        rows, more, found = superstep(rows, 1 + n // ROWS, share)
        placed = placed.unionByName(more)
    return items.join(placed.hint("merge"), "ref").select("id", "part_no", "start", "size", F.col("container").alias("container_id"))


def pack_runs(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, part_no, start, size, container_id): where each item, or each part of a divided one, goes.

    part_no counts from 1 and start is the part's first unit within the item. Capacities over MAX_CAPACITY are refused.
    """
    if not 1 <= capacity <= MAX_CAPACITY:
        raise ValueError(f"the capacity must be from 1 to {MAX_CAPACITY}")
    spark = sizes.sparkSession
    items = cut_lineage(_items(sizes, id_col, size_col, capacity))
    kind = items.schema["id"].dataType.simpleString()

    tagged = items.withColumn("pid", F.spark_partition_id())
    counts = tagged.groupBy("pid", "size").agg(F.count(F.lit(1)).alias("n"))
    runs = [(r["size"], r["n"]) for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()]  # at most `capacity` rows
    table, _ = best_fit_runs(runs, capacity)
    key = (table[:, 0] << 44) + table[:, 1] if len(table) else np.empty(0, np.int64)
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[order], table[order]))

    before = Window.partitionBy("size").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pid", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = tagged.mapInArrow(_ranked, f"id {kind}, part_no int, start long, size int, pid int, local long").join(offsets, ["pid", "size"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shared.value
        for b in batches:
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(keys, (b.column("size").to_numpy().astype(np.int64) << 44) + rank, side="right") - 1
            container = rows[at, 3] + (rank - rows[at, 1]) // rows[at, 4] if len(rank) else rank
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "part_no", "start", "size")), pa.array(container, pa.int64())], names=["id", "part_no", "start", "size", "container_id"])

    return ranked.select("id", "part_no", "start", "size", (F.col("local") + F.col("offset")).alias("rank")).mapInArrow(place, f"id {kind}, part_no int, start long, size int, container_id long")
