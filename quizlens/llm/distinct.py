"""How distinctive a term is for a record (problem 6).

The score is the positive pointwise mutual information of term and record,

    log2( tf * Z / (total(term) * n(record) ** ALPHA) ),  Z = sum over records of n ** ALPHA,

from joint counts tf, the terms' totals and the records' lengths n, the records (the contexts) being
smoothed by the exponent ALPHA. Terms of one record only score 0: they relate it to nothing.

Joint counts are made within a record, without a shuffle, and written once; everything else is
group-bys and joins on the term. The joined statistics have one row per term, and are
broadcast only while their counted number is small.

Defined cases: a term is a maximal run of letters, lower-cased; null or empty lists and null
members have no terms and give no rows; rows with a null key are left out; rows with equal keys
count as separate records.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.session import materialise

ALPHA = 0.75
BROADCAST_TERMS = 100_000  # terms up to which their statistics are broadcast (some 10 MB)
_LETTERS = regex.compile(r"\p{L}+").findall
_ASCII = regex.compile("[A-Za-z]+").findall


def term_counts(rows: DataFrame, key: str, texts: str) -> DataFrame:
    """(key, term, tf, n): the terms of each record with their count and the record's number of terms."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, terms, counts, sizes = [], [], [], []
            for i, parts in enumerate(batch.column(1).to_pylist()):
                text = "\n".join([p for p in parts or () if p])
                if not text:
                    continue
                found = _ASCII(text.lower()) if text.isascii() else [t.lower() for t in _LETTERS(text)]
                tf = Counter(found)
                terms += tf.keys()
                counts += tf.values()
                at += [i] * len(tf)
                sizes += [len(found)] * len(tf)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, type=pa.int64())), pa.array(terms, type=pa.string()), pa.array(counts, type=pa.int32()), pa.array(sizes, type=pa.int32())],
                names=[key, "term", "tf", "n"],
            )

    return rows.filter(F.col(key).isNotNull()).select(F.col(key), F.col(texts)).mapInArrow(run, f"`{key}` {kind}, term string, tf int, n int")


def term_scores(rows: DataFrame, key: str, texts: str, least_tf: int = 1, least_df: int = 1, most_df: int | None = None) -> DataFrame:
    """(key, term, tf, df, score) of all terms of all records; the limits restrict the result only,
    the counts are always those of all records."""
    joint = materialise(term_counts(rows, key, texts), "term-counts")
    stats = joint.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    # a record's part of Z is divided over its terms by their share of its length; decimals add up
    # to the same sum in any order
    part = (F.pow(F.col("n").cast("double"), F.lit(ALPHA)) * F.col("tf") / F.col("n")).cast("decimal(38,16)")
    z = joint.agg(F.sum(part).cast("double").alias("z")).first()["z"] or 0.0
    kept = stats.filter(f"df >= {least_df}" + (f" and df <= {most_df}" if most_df is not None else ""))
    if stats.count() <= BROADCAST_TERMS:
        kept = F.broadcast(kept)
    pmi = F.log2(F.col("tf") * F.lit(z) / (F.col("total") * F.pow(F.col("n").cast("double"), F.lit(ALPHA))))
    score = F.when(F.col("df") > 1, F.greatest(pmi, F.lit(0.0))).otherwise(0.0)
    return joint.filter(F.col("tf") >= least_tf).join(kept, "term").select(key, "term", F.col("tf").cast("bigint").alias("tf"), "df", F.round(score, 6).alias("score"))
