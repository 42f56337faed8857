"""Filling fixed-capacity containers with items, by linear grouping.

Sizes are whole numbers of at most the capacity, so the multiset of sizes is a histogram of at most ``capacity`` counts,
however many items there are. The plan is made from that histogram alone:

1. items larger than the capacity are split into full pieces and a rest (only these are split);
2. large sizes (over ``small`` of the capacity) are grouped, in falling order, into ``groups`` of equal cardinality, and
   rounded up to their group's largest size;
3. the configurations of these few sizes (how many of each go into one container) are optimised by column generation: a
   linear programme over configurations, priced by a knapsack; its solution is rounded down, the rest is placed best-fit;
4. the actual items take the places, the largest of at most their group's size first; a container's last place takes the
   largest that fits, so what rounding up would waste is used; the room that each container has left is known exactly;
5. small items go best-fit: each into the fullest container that still has room for it.

Containers with the same contents are handled together as ranges, so the plan stays small. Every item then finds its
container by its size and its running number among the items of its size; a frequent size has as many buckets as its
count asks for, and numbers are counted by (size, bucket), never by gathering all items of a size.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CAPACITY = 2048
GROUPS = 32
#: Sizes of at most this share of the capacity are small.
SMALL = 0.3
#: The items of one size are numbered in buckets of about so many.
BUCKET_ROWS = 500_000


def optimise(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], float]]:
    """Configurations of the sizes and how often each is used, so that every count is covered by the fewest containers.

    Column generation: the basis starts with containers of a single size; the knapsack of the dual prices finds the
    configuration that pays most, until none does. A basis that comes again (pivots without gain, in a circle) ends it too: from
    there this rule finds nothing better.
    """
    n = len(sizes)
    size = np.array(sizes)
    order = np.argsort(size)
    basis = np.diag([float(capacity // s) for s in sizes])
    demand = np.array(counts, dtype="float64")
    seen: set[frozenset] = set()
    while (held := frozenset(map(tuple, basis.T.round().astype(int)))) not in seen:
        seen.add(held)
        prices = np.linalg.solve(basis.T, np.ones(n))
        value, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(size.min()), capacity + 1):
            fit = order[: np.searchsorted(size[order], room, side="right")]
            gain = value[room - size[fit]] + prices[fit]
            best = int(np.argmax(gain))
            if gain[best] > value[room - 1] + 1e-12:
                value[room], take[room] = gain[best], fit[best]
            else:
                value[room] = value[room - 1]
        if value[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), capacity
        while room > 0:
            if take[room] < 0:
                room -= 1
            else:
                column[take[room]] += 1
                room -= sizes[take[room]]
        step, use = np.linalg.solve(basis, column), np.linalg.solve(basis, demand)
        ratio = np.where(step > 1e-9, np.maximum(use, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    use = np.maximum(np.linalg.solve(basis, demand), 0)
    return [(tuple(int(round(x)) for x in basis[:, j]), float(use[j])) for j in range(n)]


class Plan:
    """Which container takes which items: ranges of running numbers per size."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.containers = 0
        self.rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> ranges [first, end) of containers
        self.order: list[int] = []  # the rooms that occur, sorted
        self.places: list[tuple[int, int, int, int, int]] = []  # size, first number, end, first container, items in each
        self.next: dict[int, int] = defaultdict(int)  # of each size, the numbers that are placed

    def leave(self, room: int, first: int, end: int) -> None:
        if first < end:
            if room not in self.rooms or not self.rooms[room]:
                if room not in self.rooms:
                    bisect.insort(self.order, room)
            self.rooms[room].append((first, end))

    def take(self, size: int, first_container: int, containers: int, each: int = 1) -> None:
        at = self.next[size]
        self.places.append((size, at, at + containers * each, first_container, each))
        self.next[size] = at + containers * each

    def open(self, containers: int) -> int:
        self.containers += containers
        return self.containers - containers

    def fill(self, segments: list[tuple[int, int, int]], left: list[int], most: int) -> list[tuple[int, int, int]]:
        """One more item into each container of the segments (first, end, room): the largest left of at most ``most`` that fits."""
        out = []
        for a, b, room in segments:
            while a < b:
                size = min(room, most)
                while size and not left[size]:
                    size -= 1
                if not size:
                    out.append((a, b, room))
                    break
                n = min(b - a, left[size])
                self.take(size, a, n)
                left[size] -= n
                out.append((a, a + n, room - size))
                a += n
        return out

    def best_fit(self, size: int, count: int) -> None:
        """Place ``count`` items of one size, each into the fullest container with room for it; new ones where there is none."""
        while count > 0:
            i = bisect.bisect_left(self.order, size)
            while i < len(self.order) and not self.rooms[self.order[i]]:
                del self.rooms[self.order[i]]
                del self.order[i]
            if i == len(self.order):
                each = self.capacity // size
                full, rest = divmod(count, each)
                first = self.open(full + (rest > 0))
                if full:
                    self.take(size, first, full, each)
                    self.leave(self.capacity - each * size, first, first + full)
                if rest:
                    self.take(size, first + full, 1, rest)
                    self.leave(self.capacity - rest * size, first + full, first + full + 1)
                return
            room = self.order[i]
            first, end = self.rooms[room].pop()
            each = room // size
            full = min(end - first, count // each)
            if full:
                self.take(size, first, full, each)
                self.leave(room - each * size, first, first + full)
                count -= full * each
            elif count:
                self.take(size, first, 1, count)
                self.leave(room - count * size, first, first + 1)
                full, count = 1, 0
            self.leave(room, first + full, end)


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> Plan:
    """The plan for ``histogram`` (size, from 0 to the capacity, with its number of items)."""
    plan = Plan(capacity)
    if n := histogram.get(capacity, 0):
        plan.take(capacity, plan.open(n), n)
    large = sorted((s for s, n in histogram.items() if small * capacity < s < capacity and n > 0), reverse=True)
    total = sum(histogram[s] for s in large)
    if total:
        # groups of equal cardinality; a size may fall into two of them
        bounds = sorted({round(total * k / groups) for k in range(groups + 1)})
        members: list[list[list[int]]] = []
        at, rest = 0, [[s, histogram[s]] for s in large]
        for low, high in zip(bounds, bounds[1:]):
            need, own = high - low, []
            while need:
                n = min(need, rest[at][1])
                own.append([rest[at][0], n])
                rest[at][1] -= n
                need -= n
                at += not rest[at][1]
            if members and members[-1][0][0] == own[0][0]:
                members[-1] += own
            else:
                members.append(own)
        tops = [m[0][0] for m in members]
        left = [0] * (capacity + 1)
        for s in large:
            left[s] = histogram[s]
        for pattern, use in optimise(tops, [sum(n for _, n in m) for m in members], capacity):
            places = [top for top, times in zip(tops, pattern) for _ in range(times)]
            containers = min(int(use + 1e-9), sum(left[: places[0] + 1])) if places else 0
            if not containers:
                continue
            first = plan.open(containers)
            segments = [(first, first + containers, capacity)]
            # a place takes the largest item of at most its group's size, the last one the largest that fits; so does what room is left
            for top in [*places[:-1], capacity]:
                segments = plan.fill(segments, left, top)
            while (more := plan.fill(segments, left, capacity)) != segments:
                segments = more
            for a, b, room in segments:
                plan.leave(room, a, b)
        for s in large:
            plan.best_fit(s, left[s])
    for s in sorted((s for s, n in histogram.items() if 0 < s <= small * capacity and n > 0), reverse=True):
        plan.best_fit(s, histogram[s])
    if n := histogram.get(0, 0):
        plan.containers = max(plan.containers, 1)
        plan.places.append((0, 0, n, 0, n))
    return plan


def pieces(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """Every item in pieces of at most the capacity; only items above it have more than one. Columns: key, piece, first, size."""
    last = F.greatest(F.ceil(F.col(size) / F.lit(capacity)).cast("int") - 1, F.lit(0))
    rows = sizes.select(F.col(key), F.col(size).alias("_all"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece") * F.lit(capacity)
    return rows.select(key, "piece", first.alias("first"), F.least(F.lit(capacity), F.col("_all") - first).cast("int").alias("size"))


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Assign items to containers. Columns: key, piece, first (offset of the piece in its item), size, container.

    sizes: a row per item with a unique key and its size (null counts as 0). Items without size all share the first
    container. Every piece is assigned once and no container holds more than ``capacity``. The histogram that is
    gathered has at most capacity + 1 rows, and a size with more than ``bucket_rows`` items one for each so many; the plan that is sent out, ranges of equal contents, is bounded by the
    capacity and the number of groups, not by the items.
    """
    spark = sizes.sparkSession
    own = pieces(sizes.withColumn(size, F.coalesce(F.col(size), F.lit(0))), key, size, capacity)
    histogram = {r["size"]: r["n"] for r in own.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1
    wide = {s: -(-n // bucket_rows) for s, n in histogram.items() if n > bucket_rows}
    bucket = F.lit(0)
    if wide:
        own = own.join(F.broadcast(spark.createDataFrame(list(wide.items()), "size int, _wide int")), "size", "left").select(key, "piece", "first", "size", "_wide")
        bucket = F.pmod(F.xxhash64(key, "piece"), F.coalesce("_wide", F.lit(1))).cast("int")
    own = own.withColumn("_bucket", bucket)
    before: dict[tuple[int, int], int] = {(s, 0): 0 for s in histogram}
    if wide:
        at: dict[int, int] = defaultdict(int)
        counts = own.where("_wide IS NOT NULL").groupBy("size", "_bucket").agg(F.count(F.lit(1)).alias("n"))
        for s, b, n in sorted((r["size"], r["_bucket"], r["n"]) for r in counts.collect()):  # one per bucket_rows items
            before[(s, b)] = at[s]
            at[s] += n
    plan = make_plan(histogram, capacity, groups, small)
    places = sorted(plan.places)
    firsts: dict[int, tuple[np.ndarray, ...]] = {}
    for s in {p[0] for p in places}:
        firsts[s] = tuple(np.array([p[i] for p in places if p[0] == s], dtype="int64") for i in (1, 3, 4))
    held = spark.sparkContext.broadcast((firsts, before))
    numbered = own.withColumn("_n", F.row_number().over(W.partitionBy("size", "_bucket").orderBy(key, "piece")) - 1)
    kind = sizes.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, before = held.value
        for batch in batches:
            size, bucket, n = (batch.column(i).to_numpy(zero_copy_only=False).astype("int64") for i in (3, 4, 5))
            container = np.zeros(len(size), dtype="int64")
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                number = n[at] + np.array([before[(int(s), int(b))] for b in bucket[at]], dtype="int64")
                start, first, each = firsts[int(s)]
                i = np.searchsorted(start, number, side="right") - 1
                container[at] = first[i] + (number - start[i]) // each[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(container)], names=[key, "piece", "first", "size", "container"])

    return numbered.select(key, "piece", "first", "size", "_bucket", "_n").mapInArrow(run, f"`{key}` {kind}, piece int, first int, size int, container long")
