"""A reproducible sample that stays as data grows (problem 3).

Every key belongs for good to one of ``BUCKETS`` fine buckets, by a digest of the key alone. The
buckets stand in one fixed order (by a digest of their number), and a sample is a beginning of
that order: a larger share only appends buckets. Nothing depends on other rows, so reruns,
partitionings and later batches cannot take a chosen key away, and no shuffle is needed to
choose.

Defined cases: rows with a null key are never chosen; the empty key is a key like any other;
all rows of a key share its fate; keys compare as equal strings.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
SALT = "nested-1"


def bucket_of(key: Column) -> Column:
    """The key's permanent bucket, 0 .. BUCKETS - 1."""
    digest = F.md5(F.concat(F.lit(SALT + "|"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % BUCKETS


def bucket_order() -> list[int]:
    """All buckets in the fixed order in which samples take them up."""
    return sorted(range(BUCKETS), key=lambda b: (hashlib.md5(f"{SALT}-order|{b}".encode()).hexdigest(), b))


def chosen_buckets(share: float) -> list[int]:
    """The beginning of the order that holds ``share`` of the buckets; append-only in ``share``."""
    return bucket_order()[: round(share * BUCKETS)]


def stable_sample(rows: DataFrame, key: str, share: float) -> DataFrame:
    """The rows whose key lies in a chosen bucket; all columns are kept."""
    return rows.filter(F.col(key).isNotNull() & bucket_of(F.col(key)).isin(chosen_buckets(share)))


def growth_report(rows: DataFrame, key: str, batch: str, share: float) -> DataFrame:
    """(batch, ids, chosen): distinct keys first delivered in each batch, and how many of them are chosen."""
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(batch).alias(batch))
    picked = bucket_of(F.col(key)).isin(chosen_buckets(share))
    return first.groupBy(batch).agg(F.count(F.lit(1)).alias("ids"), F.count_if(picked).alias("chosen"))
