"""Filling containers of fixed capacity by exact complements (problem 9).

Only the histogram of item sizes decides how containers are composed, and it has at most
``capacity`` rows however large the corpus is. So the driver plans *patterns* (which sizes
share a container, and how many containers are composed that way) on the histogram:

* the largest size left opens a container;
* its gap is filled exactly where one, two or three sizes add up to it (sums are looked
  up by complement, under the counts still available);
* where no such combination exists, the largest size that fits is placed and the smaller
  gap is tried again; what cannot be closed exactly ends as a best-fit residual.

A pattern is applied as often as its counts allow, so each exhausts a size for its
multiplicity and their number is bounded by capacity * ln(capacity), not by the data.

The items follow the plan by their rank within their size. Ranks are taken in salted
groups (size, bucket) plus the offset of the bucket, so that one frequent size is not
ranked in a single task, and the rank finds its container by binary search in the plan.

Defined cases: an item larger than the capacity is split into full parts and one rest;
items of size 0 (null and empty texts) need no container and get a null one; a null
size counts as 0; rows with equal keys are separate items.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlens.session import materialise

ROWS_PER_BUCKET = 200_000  # a salted rank group holds about so many rows


def _largest(left: np.ndarray, most: int) -> int:
    """The largest size up to ``most`` that is available, or 0."""
    at = np.flatnonzero(left[: most + 1])
    return int(at[-1]) if len(at) else 0


def exact_fill(left: np.ndarray, gap: int) -> tuple[int, ...]:
    """One, two or three available sizes that add up to ``gap``, larger ones preferred; () if none."""
    if gap < len(left) and left[gap] > 0:
        return (gap,)

    def pair(total: int, most: int) -> tuple[int, int] | None:
        high = min(total - 1, most)
        low = (total + 1) // 2
        if high < low:
            return None
        a = np.arange(high, low - 1, -1)
        b = total - a
        ok = (left[a] > 0) & (left[b] > 0)
        if total % 2 == 0 and low <= high:
            ok[-1] = left[low] > 1
        hit = np.flatnonzero(ok)
        return (int(a[hit[0]]), int(b[hit[0]])) if len(hit) else None

    top = _largest(left, min(gap, len(left) - 1))
    if not top or 3 * top < gap:
        return ()
    if found := pair(gap, top):
        return found
    for a in np.flatnonzero(left[: min(top, gap - 2) + 1])[::-1]:
        a = int(a)
        if 3 * a < gap:
            break
        left[a] -= 1
        found = pair(gap - a, a)
        left[a] += 1
        if found:
            return (a, *found)
    return ()


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(sizes of one container with their multiplicity, number of such containers)]."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        if 0 < size <= capacity:
            left[size] += n
    plan = []
    while opener := _largest(left, capacity):
        pattern, trial, gap = Counter([opener]), left.copy(), capacity - opener
        trial[opener] -= 1
        while gap > 0:
            if found := exact_fill(trial, gap):
                pattern.update(found)
                break
            size = _largest(trial, gap)
            if not size:
                break
            pattern[size] += 1
            trial[size] -= 1
            gap -= size
        times = min(int(left[s]) // k for s, k in pattern.items())
        for s, k in pattern.items():
            left[s] -= k * times
        plan.append((dict(pattern), times))
    return plan


def _segments(plan: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by start: start key (size, rank), first container, containers of the segment."""
    used: Counter[int] = Counter()
    rows, first = [], 0
    for pattern, times in plan:
        for size, k in pattern.items():
            rows.append(((size << 44) + used[size], first, times))
            used[size] += k * times
        first += times
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2], np.array([first])


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, part, n_tokens, container_id): each item, or each part of an oversized one, in its container."""
    kind = items.schema[key].dataType.simpleString()
    parts = items.select(
        F.col(key).alias("_key"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("_n")
    ).select(
        "_key",
        "_n",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("_n") / capacity) - 1, F.lit(0)).cast("bigint"))).alias("part"),
    )
    parts = parts.select("_key", "part", F.least(F.col("_n") - F.col("part") * capacity, F.lit(capacity)).alias("_size"))
    # the histogram is bounded by the capacity
    counts = {r["_size"]: r["n"] for r in parts.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, firsts, times, _ = _segments(plan_patterns(counts, capacity))

    buckets = 8 + sum(counts.values()) // ROWS_PER_BUCKET
    full = parts.filter("_size > 0").withColumn("_bucket", F.pmod(F.xxhash64("_key", "part"), F.lit(buckets)).cast("int"))
    offsets = (
        full.groupBy("_size", "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.sum("_rows").over(Window.partitionBy("_size").orderBy("_bucket")) - F.col("_rows"))
        .drop("_rows")
    )
    ranked = full.withColumn("_rank", F.row_number().over(Window.partitionBy("_size", "_bucket").orderBy("_key", "part")) - 1)
    ranked = ranked.join(offsets, ["_size", "_bucket"]).select("_key", "part", "_size", (F.col("_rank") + F.col("_offset")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) << 44) + batch.column(3).to_numpy(zero_copy_only=False)
            k = np.searchsorted(starts, at, side="right") - 1
            container = firsts[k] + (at - starts[k]) % times[k] if len(at) else at
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(container, type=pa.int64())], names=[key, "part", "n_tokens", "container_id"])

    placed = ranked.mapInArrow(place, f"`{key}` {kind}, part bigint, n_tokens bigint, container_id bigint")
    empty = parts.filter("_size = 0").select(F.col("_key").alias(key), "part", F.col("_size").alias("n_tokens"), F.lit(None).cast("bigint").alias("container_id"))
    return placed.unionByName(empty)


def pack_texts(documents: DataFrame, key: str, text: str, capacity: int, count) -> DataFrame:
    """``pack`` with sizes from ``count`` (documents, key, text -> key, n_tokens), counted once and written."""
    return pack(materialise(count(documents, key, text), "token-counts"), key, "n_tokens", capacity)


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens, the least number of containers possible, and the share filled."""
    return packed.agg(
        F.count("container_id").alias("parts"),
        F.coalesce(F.max("container_id") + 1, F.lit(0)).alias("containers"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"),
    ).select(
        "parts",
        "containers",
        "tokens",
        F.ceil(F.col("tokens") / capacity).alias("least_containers"),
        F.round(F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity)), 6).alias("filled"),
    )
