"""Reproducible subsamples of a corpus; order and identity of the items stay."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


RANKED = 20_000  # rows that are sorted together, about


def sample_key(seed: int, item_id: Column) -> Column:
    """A random rank of an item that depends on the seed and its id alone."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit("sample"), item_id), 256)


def _smallest(rows: DataFrame, groups: list[str], quota: Column) -> DataFrame:
    """Rows with the ``quota`` smallest keys of each group, without sorting a group as a whole.

    Rows are counted by the leading digits of their key; groups of digits below the quota are taken whole,
    and only the one in which it is reached is ranked. There are as many digits as leave some ten thousand rows to rank.
    """
    digits = min(10, max(2, math.ceil(math.log(rows.count() / RANKED + 1, 16))))
    lead = F.conv(F.substring("_key", 1, digits), 16, 10).cast("long")
    rows = rows.withColumns({"_lead": lead, "_quota": quota.cast("long")})
    counts = rows.groupBy(*groups, "_lead").agg(F.count(F.lit(1)).alias("_n"), F.first("_quota").alias("_q"))
    upto = Window.partitionBy(*groups).orderBy("_lead")  # one row for RANKED rows of the table, about
    counts = counts.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).filter("_before < _q").drop("_q")
    named = counts.withColumnsRenamed({c: f"_g_{c}" for c in groups} | {"_lead": "_g_lead"})
    on = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in groups] + [F.col("_lead") == F.col("_g_lead")]
    taken = rows.join(named, on).drop("_g_lead", *(f"_g_{c}" for c in groups))
    whole = taken.filter("_before + _n <= _quota")
    ranked = taken.filter("_before + _n > _quota").withColumn("_rank", F.row_number().over(Window.partitionBy(*groups, "_lead").orderBy("_key", "pos")))
    cut = ranked.filter("_before + _rank <= _quota").drop("_rank")
    return whole.unionByName(cut).drop("_key", "_lead", "_quota", "_n", "_before")


def simple_sample(items: DataFrame, size: int, seed: int) -> DataFrame:
    """``size`` items without replacement; the whole corpus if it has no more."""
    return _smallest(items.withColumn("_key", sample_key(seed, F.col("item_id"))), [], F.lit(size))


def subject_sizes(items: DataFrame) -> DataFrame:
    return items.groupBy(F.coalesce("subject", F.lit("")).alias("subject")).agg(F.count(F.lit(1)).alias("n"))


def subjects(items: DataFrame) -> DataFrame:
    """Distinct subjects in order, the empty one among them."""
    return items.select(F.coalesce("subject", F.lit("")).alias("subject")).distinct().orderBy("subject")


def quotas(items: DataFrame, size: int) -> DataFrame:
    """(subject, n, quota): proportional quotas rounded down; what is left goes to the largest fractions, ties by name.

    The sum is ``size``, or the corpus' size if that is less. One row per subject is sorted.
    """
    counted = subject_sizes(items)
    total = F.sum("n").over(Window.partitionBy())
    wanted = F.least(F.lit(size).cast("long"), total)
    rows = counted.withColumns({"_total": total, "_wanted": wanted})
    rows = rows.withColumns({"_floor": F.floor(F.col("_wanted") * F.col("n") / F.col("_total")).cast("long"), "_rest": F.col("_wanted") * F.col("n") % F.col("_total")})
    rank = F.row_number().over(Window.orderBy(F.desc("_rest"), "subject"))
    spare = F.col("_wanted") - F.sum("_floor").over(Window.partitionBy())
    rows = rows.withColumns({"_rank": rank, "_spare": spare})
    return rows.select("subject", "n", (F.col("_floor") + F.when(F.col("_rank") <= F.col("_spare"), 1).otherwise(0)).alias("quota"))


def stratified_sample(items: DataFrame, size: int, seed: int) -> DataFrame:
    """``size`` items with each subject's share kept."""
    rows = items.withColumns({"_s": F.coalesce("subject", F.lit("")), "_key": sample_key(seed, F.col("item_id"))})
    plan = quotas(items, size).select(F.col("subject").alias("_s"), F.col("quota").alias("_want"))
    return _smallest(rows.join(plan, "_s").filter("_want > 0"), ["_s"], F.col("_want")).drop("_s", "_want")


def subsample(items: DataFrame, name: str, size: int, seed: int, stratify: bool = False) -> tuple[DataFrame, str]:
    """A sample and its name; the corpus itself if ``size`` is its size."""
    n = items.count()
    if not 1 <= size <= n:
        raise ValueError(f"a size between 1 and {n} is needed")
    if size == n:
        return items, name
    drawn = stratified_sample(items, size, seed) if stratify else simple_sample(items, size, seed)
    return drawn, f"{name}[n={size},seed={seed}]"


def prepared(items: DataFrame, name: str, size: int | None, seed: int) -> tuple[DataFrame, str]:
    """What the command line audits: the whole corpus, or a stratified sample of it."""
    if size is None or size >= items.count():
        return items, name
    return subsample(items, name, size, seed, stratify=True)
