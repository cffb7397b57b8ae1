"""A sample with given category proportions (problem 2).

Categories are counted, integer quotas are allocated on the (small, given) table of targets, and in
each category the rows with the smallest random keys are taken. The keys are digests of the row's
key, so reruns and other partitionings take the same rows.

Smallest keys without sorting a category in one task: rows are counted per category and
bucket of their random key, the bucket in which the quota is reached is found from these
counts, lower buckets are taken whole, and only that bucket is ranked. The number of buckets
follows from the largest category, so that the ranked bucket holds about ROWS rows at any size.

Defined cases: null, empty and unlisted categories have no quota and are never drawn; a target for
an absent category gives quota 0 and a shortfall; a null target share or floor counts as 0; an
empty table gives an empty sample. Categories compare as equal strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 50_000  # rows of a bucket of the random key, about
SEED = "quota-1"


def largest_remainder(shares: dict[str, int], total: int) -> dict[str, int]:
    """Integers proportional to ``shares`` that add up to ``total``; ties go to the lesser name."""
    whole = sum(shares.values())
    if not whole or total <= 0:
        return dict.fromkeys(shares, 0)
    quota = {k: total * v // whole for k, v in shares.items()}
    rest = sorted(shares, key=lambda k: (-(total * shares[k] % whole), k))
    for k in rest[: total - sum(quota.values())]:
        quota[k] += 1
    return quota


def allocate(targets: dict[str, tuple[int, int]], available: dict[str, int], total: int) -> dict[str, int]:
    """Quota of each category from its (share, floor), within its availability.

    Categories whose proportional part lies below their floor are set to it, those above their
    availability to that, and the rest of ``total`` is divided anew among the others. Floors
    hold even if they add up to more than ``total``.
    """
    floor = {k: min(f, available.get(k, 0)) for k, (_, f) in targets.items()}
    cap = {k: available.get(k, 0) for k in targets}
    fixed: dict[str, int] = {}
    while True:
        free = {k: s for k, (s, _) in targets.items() if k not in fixed}
        quota = largest_remainder(free, total - sum(fixed.values()))
        low = {k: floor[k] for k in free if quota[k] < floor[k]}
        high = {k: cap[k] for k in free if quota[k] > cap[k]}
        if not low and not high:
            return fixed | quota
        # set the side that moves more rows first, so that neither is set against a wrong rest
        if sum(floor[k] - quota[k] for k in low) >= sum(quota[k] - cap[k] for k in high):
            fixed |= low
        else:
            fixed |= high


def random_key(key: Column) -> Column:
    """52 bits of a digest of a row's key, uniform."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED + "|"), key.cast("string"))), 1, 13), 16, 10).cast("bigint")


def quota_table(rows: DataFrame, category: str, targets: DataFrame, divisor: int) -> DataFrame:
    """(category, target_bp, min_rows, available, wanted, quota, lacking, undrawn, short) of each target.

    ``wanted`` is the larger of the floor and the target share of floor(rows / divisor), rounded up. ``lacking`` is what
    the table has too few rows for (``short`` if any), ``undrawn`` what the quota stays below ``wanted``, be it for lack of
    rows, for rounding, or because the floors of others used up the total.
    """
    spark = rows.sparkSession
    wanted = {
        r["c"]: (r["s"], r["f"])
        for r in targets.filter(F.col(category).isNotNull())
        .groupBy(F.col(category).alias("c"))
        .agg(F.max(F.coalesce("target_bp", F.lit(0))).cast("bigint").alias("s"), F.max(F.coalesce("min_rows", F.lit(0))).cast("bigint").alias("f"))
        .collect()
    }  # the targets are a given parameter table
    named = F.broadcast(targets.select(F.col(category).alias("c")).distinct())
    counted = rows.groupBy(F.col(category).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    # one pass: all other categories are added up in one row, under null
    listed = counted.join(named.withColumn("k", F.col("c")), "c", "left").groupBy("k").agg(F.sum("n").alias("n")).collect()
    available = {r["k"]: r["n"] for r in listed if r["k"] is not None}
    total = sum(r["n"] for r in listed) // divisor
    quota = allocate(wanted, available, total)
    out = []
    for name, (share, floor) in wanted.items():
        goal, there = max(floor, -(-share * total // 10_000)), available.get(name, 0)
        # what the cap of the allocation takes from the goal, and what the draw falls short of it for any reason
        out.append((name, share, floor, there, goal, quota[name], goal - min(goal, there), goal - min(goal, quota[name])))
    kinds = ", ".join(f"{c} bigint" for c in ("target_bp", "min_rows", "available", "wanted", "quota", "lacking", "undrawn"))
    return spark.createDataFrame(out, f"`{category}` string, {kinds}").withColumn("short", F.col("lacking") > 0)


def quota_sample(rows: DataFrame, key: str, category: str, quotas: DataFrame) -> DataFrame:
    """(key, category) of the rows drawn: in each category the ``quota`` smallest random keys."""
    largest = quotas.agg(F.coalesce(F.max("available"), F.lit(0)).alias("n")).first()["n"]  # of the given targets
    bits = min(40, max(4, (largest // ROWS).bit_length()))
    keyed = rows.select(F.col(key), F.col(category)).withColumn("_r", random_key(F.col(key)))
    keyed = keyed.withColumn("_b", F.shiftright("_r", 52 - bits))
    wanted = F.broadcast(quotas.filter("quota > 0").select(category, "quota"))  # one row per given target
    keyed = keyed.join(wanted, category)
    counts = keyed.groupBy(category, "_b", "quota").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(category).orderBy("_b")
    counts = counts.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).filter("_before < quota")
    taken = keyed.drop("quota").join(counts, [category, "_b"])
    whole = taken.filter("_before + _n <= quota").select(key, category)
    last = Window.partitionBy(category).orderBy("_r", key)
    cut = taken.filter("_before + _n > quota").withColumn("_rank", F.row_number().over(last)).filter("_before + _rank <= quota").select(key, category)
    return whole.unionByName(cut)
