"""Problem 9: documents packed into containers of fixed capacity by a linear grouping scheme.

What is decided on the driver depends on the histogram of sizes only, at most one number for each size up to the
capacity: large sizes are rounded up within groups of equal cardinality, the few rounded sizes are packed by column
generation over configurations, actual sizes are substituted as runs, and small sizes go best-fit into what is left.
The plan is a list of runs (size, ranks from..to, first container), whose length depends on the capacity and the number
of groups, not on the documents; documents find their run by their rank among documents of their size.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.runtime import cut, parallelism

CAPACITY = 2048
#: Groups of equal cardinality for the large sizes.
GROUPS = 32
#: A size is large from this share of the capacity on.
LARGE = 1 / 3
ROUNDS = 400


def best_pattern(sizes: np.ndarray, price: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity (unbounded knapsack)."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    usable = [i for i in range(len(sizes)) if price[i] > 1e-12]
    if not usable:
        return 0.0, np.zeros(len(sizes), int)
    s, p = sizes[usable], price[usable]
    for room in range(1, capacity + 1):
        fit = s <= room
        value[room] = value[room - 1]
        if fit.any():
            gain = np.where(fit, value[room - np.where(fit, s, 0)] + p, -1)
            k = int(np.argmax(gain))
            if gain[k] > value[room] + 1e-12:
                value[room], choice[room] = gain[k], usable[k]
    pattern, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(value[capacity]), pattern


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that hold all counts: the linear relaxation by column generation, rounded down, the rest best-fit."""
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    demand = counts.astype(float)
    times = np.linalg.solve(basis, demand)
    for _ in range(ROUNDS):
        price = np.linalg.solve(basis.T, np.ones(n))
        worth, pattern = best_pattern(sizes, price, counts, capacity)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(step > 1e-9, times / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = pattern
        times = np.maximum(np.linalg.solve(basis, demand), 0)
    left, plan = counts.copy(), []
    for k in np.argsort(-times):
        pattern = np.rint(basis[:, k]).astype(int)
        x = int(times[k] + 1e-9)
        used = pattern > 0
        x = min([x, *(left[used] // pattern[used])]) if used.any() else 0
        if x > 0:
            plan.append((pattern, x))
            left = left - pattern * x
    while left.any():  # fewer than the number of configurations' items are left
        pattern, room = np.zeros(n, int), capacity
        for i in np.argsort(-sizes, kind="stable"):
            take = min(int(left[i]), room // int(sizes[i]))
            pattern[i] += take
            room -= take * int(sizes[i])
        used = pattern > 0
        x = int(min(left[used] // pattern[used]))
        plan.append((pattern, x))
        left = left - pattern * x
    return plan


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (size, rank from, rank to, container of the first) that place every item of the histogram; number of containers."""
    sizes = sorted((s for s, n in histogram.items() if n > 0), reverse=True)
    if not sizes:
        return [], 0
    large = [s for s in sizes if s >= capacity * LARGE]
    small = [s for s in sizes if s < capacity * LARGE]
    types: list[list] = []  # [containers, [sizes], room]
    if large:
        total = sum(histogram[s] for s in large)
        per = max(1, -(-total // groups))
        parts: list[list[tuple[int, int]]] = [[]]
        filled = 0
        for s in large:
            n = histogram[s]
            while n:
                if filled == per:
                    parts.append([])
                    filled = 0
                take = min(n, per - filled)
                parts[-1].append((s, take))
                filled += take
                n -= take
        rounded = np.array([p[0][0] for p in parts])
        merged: dict[int, list[tuple[int, int]]] = defaultdict(list)  # groups may round to the same size
        for r, p in zip(rounded.tolist(), parts):
            merged[r] += p
        kinds = np.array(sorted(merged, reverse=True))
        counts = np.array([sum(n for _, n in merged[r]) for r in kinds.tolist()])
        supply = [list(reversed(merged[r])) for r in kinds.tolist()]  # pop() gives the largest that is left
        for pattern, times in configurations(kinds, counts, capacity):
            slots = [i for i in range(len(kinds)) for _ in range(pattern[i])]
            columns = []
            for i in slots:  # the next `times` actual items of the group, as runs of one size
                need, column = times, []
                while need:
                    s, n = supply[i].pop()
                    take = min(n, need)
                    column.append([s, take])
                    need -= take
                    if n > take:
                        supply[i].append((s, n - take))
                columns.append(column)
            done = 0
            while done < times:
                step = min(c[0][1] for c in columns)
                held = [c[0][0] for c in columns]
                types.append([step, held, capacity - sum(held)])
                for c in columns:
                    c[0][1] -= step
                    if not c[0][1]:
                        c.pop(0)
                done += step
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms: list[int] = []

    def put(k: int) -> None:
        room = types[k][2]
        if room:
            if not by_room[room]:
                bisect.insort(rooms, room)
            by_room[room].append(k)

    for k in range(len(types)):
        put(k)
    for s in small:
        n = histogram[s]
        while n:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                each = capacity // s
                whole, rest = divmod(n, each)
                if whole:
                    types.append([whole, [s] * each, capacity - s * each])
                    put(len(types) - 1)
                if rest:
                    types.append([1, [s] * rest, capacity - s * rest])
                    put(len(types) - 1)
                break
            room = rooms[at]
            k = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            each = room // s
            count, held, _ = types[k]
            fill = min(count, n // each)
            if fill:
                if fill < count:
                    types.append([count - fill, list(held), room])
                    put(len(types) - 1)
                types[k] = [fill, held + [s] * each, room - s * each]
                put(k)
                n -= fill * each
            else:  # fewer than one container takes
                if count > 1:
                    types.append([count - 1, list(held), room])
                    put(len(types) - 1)
                types[k] = [1, held + [s] * n, room - s * n]
                put(k)
                n = 0
    runs, base, rank = [], 0, defaultdict(int)
    for count, held, _ in types:
        for s in held:
            runs.append((s, rank[s], rank[s] + count, base))
            rank[s] += count
        base += count
    return sorted(runs), base


def pack(df: DataFrame, key: str, size: str, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """(key, part, size, container) for each piece of each row; no container holds more than `capacity`.

    A row of at most `capacity` is one piece, part 0; a larger one is cut in pieces of `capacity` and a rest, parts in
    order, because it can't be held whole. Rows with null, zero or negative size go into none. Rows with equal keys are
    separate items; a null key is allowed. An empty table gives no rows. Other columns are dropped.

    The histogram is the only thing that comes to the driver: one row for each size from 1 to `capacity`. Ranks are
    taken within (size, hash bucket), with the buckets' offsets from a table of capacity x buckets at most, so that a
    size shared by a third of all rows doesn't go through one task.
    """
    spark = df.sparkSession
    buckets = max(16, parallelism(spark))
    whole = F.col("_size")
    items = (
        df.select(F.col(key).alias("_key"), F.col(size).cast("long").alias("_size"))
        .where(whole > 0)
        .select("_key", whole.alias("_all"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((whole - 1) / capacity).cast("long"))).alias("_part"))
        .select("_key", F.col("_part").cast("int").alias("_part"), F.least(F.lit(capacity).cast("long"), F.col("_all") - F.col("_part") * capacity).cast("int").alias("_size"))
        .withColumn("_bucket", F.pmod(F.xxhash64("_key", "_part"), F.lit(buckets)).cast("int"))
    )
    items = cut(items)
    per_bucket = items.groupBy("_size", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = per_bucket.select("_size", "_bucket", (F.sum("_n").over(Window.partitionBy("_size").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    histogram = {r["_size"]: r["n"] for r in items.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan_runs(histogram, capacity, groups)
    held = spark.sparkContext.broadcast(tuple(np.array(x, np.int64) for x in zip(*runs)) if runs else tuple(np.zeros(0, np.int64) for _ in range(4)))

    @F.pandas_udf("long")
    def container(sizes: pd.Series, ranks: pd.Series) -> pd.Series:
        s, first, _, base = held.value
        at = np.searchsorted((s << 40) + first, (sizes.to_numpy(np.int64) << 40) + ranks.to_numpy(np.int64), side="right") - 1
        return pd.Series(base[at] + ranks.to_numpy(np.int64) - first[at])

    local = F.row_number().over(Window.partitionBy("_size", "_bucket").orderBy("_key", "_part")) - 1
    ranked = items.withColumn("_local", local).join(offsets, ["_size", "_bucket"])
    return ranked.select(F.col("_key").alias(key), F.col("_part").alias("part"), F.col("_size").alias("size"), container("_size", F.col("_local") + F.col("_before")).alias("container"))
