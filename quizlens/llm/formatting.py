"""Records that differ in formatting only, by dictionary encoding (problem 1).

1. Each record is reduced to its *writing*: a digest of the answer index and of the digests of its
   values, in order. Records that are written alike are one writing, so a record that was
   delivered a million times as it is goes through the rest once.
2. Every distinct value is canonicalised once: its runs of letters and digits, letter case aside,
   joined by a space. Distinct canonical values get integer identifiers; the dictionary (digest of
   a value to identifier) is written, so that identifiers stay fixed whatever is recomputed.
3. Each writing becomes a tuple of integers, sorted by slot: the order of the fields in the
   delivered text plays no part.
4. The compact tuples are grouped; every delivered row is counted, through its writing.

Texts are shuffled once, per task and distinct value; all other shuffles are of digests and integers,
with counts and distinct values aggregated before them. A row is told by its place, not its key.

Defined cases: a null question or choice is the empty sequence of runs, a null answer index
equals only a null; absent choices equal an empty list; records that are null or no JSON object are left
out; rows with the same key are separate copies, whether written alike or not (in pairs of keys a key
stands once); further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlens.session import materialise, release

RECORD = "question STRING, choices ARRAY<STRING>, answer_index BIGINT"


def canonical_value(value: Column) -> Column:
    """Runs of letters and digits in one case, separated by single spaces."""
    return F.lower(F.upper(F.trim(F.regexp_replace(value, r"[^\p{L}\p{N}]+", " "))))


def parsed_records(lines: DataFrame, key: str, record: str) -> DataFrame:
    """(key, question, choices, answer_index) of JSON records; unparsable and null ones are left out."""
    parsed = lines.select(F.col(key), F.from_json(F.col(record), RECORD).alias("r"))
    known = F.col("r.question").isNotNull() | F.col("r.choices").isNotNull() | F.col("r.answer_index").isNotNull()
    return parsed.filter(F.col("r").isNotNull() & known).select(key, "r.question", "r.choices", "r.answer_index")


def _value_digest(value: Column) -> Column:
    return F.unhex(F.md5(value))


def _values() -> Column:
    """Question and choices as one list; what is null is empty."""
    choices = F.coalesce(F.transform("choices", lambda c: F.coalesce(c, F.lit(""))), F.array().cast("array<string>"))
    return F.concat(F.array(F.coalesce("question", F.lit(""))), choices)


def _answer() -> Column:
    return F.coalesce(F.col("answer_index"), F.lit(-(1 << 62)))


def _writing(values: Column, answer: Column) -> Column:
    """Identity of a record as it is written, from the digests of its values and its answer."""
    return F.unhex(F.md5(F.concat_ws(",", answer.cast("string"), F.transform(values, lambda v: F.hex(v)))))


def writings(records: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, writing, answer, values) of each row; ``values`` are the digests of its values in order."""
    digested = records.select(*keep, _answer().alias("answer"), F.transform(_values(), _value_digest).alias("values"))
    return digested.select(*keep, _writing(F.col("values"), F.col("answer")).alias("writing"), "answer", "values")


def value_dictionary(records: DataFrame) -> DataFrame:
    """(value, number): the digest of each distinct value with the identifier of its canonical form; written."""
    texts = records.select(F.explode(_values()).alias("text")).distinct()
    distinct = materialise(texts.select(_value_digest(F.col("text")).alias("value"), _value_digest(canonical_value(F.col("text"))).alias("canonical")), "values")
    numbered = materialise(distinct.select("canonical").distinct().withColumn("number", F.monotonically_increasing_id()), "identifiers")
    dictionary = materialise(distinct.join(numbered, "canonical").select("value", "number"), "dictionary")
    release(distinct, numbered)
    return dictionary


def encoded_writings(written: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(writing, code): each distinct writing as its tuple of the answer index and the identifiers of its values
    in the order of their slots (the question first, then the choices)."""
    once = written.select("writing", "answer", "values").distinct()
    slots = once.select("writing", "answer", F.posexplode("values").alias("slot", "value")).join(dictionary, "value")
    tuples = slots.groupBy("writing", "answer").agg(F.array_sort(F.collect_list(F.struct("slot", "number"))).alias("slots"))  # the values of one record
    return tuples.select("writing", F.concat(F.array("answer"), F.col("slots.number")).alias("code"))


def formatting_groups(records: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(groups, rows): (code, keep_id, keep_writing, copies) of each group, and (key, writing, rows, code) of each key and writing."""
    written = materialise(writings(records, key), "writings")
    dictionary = value_dictionary(records)
    rows = written.groupBy(key, "writing").agg(F.count(F.lit(1)).alias("rows"))
    coded = materialise(rows.join(encoded_writings(written, dictionary), "writing"), "coded-rows")
    release(written, dictionary)
    least = F.min(F.struct(F.col(key).alias("k"), F.col("writing").alias("w")))
    groups = coded.groupBy("code").agg(least.alias("first"), F.sum("rows").alias("copies"))
    return groups.select("code", F.col("first.k").alias("keep_id"), F.col("first.w").alias("keep_writing"), "copies"), coded


def formatting_copies(records: DataFrame, key: str) -> DataFrame:
    """(keep_id, copy_id): every record that is not the least of its group."""
    groups, coded = formatting_groups(records, key)
    copies = coded.join(groups.filter("copies > 1").select("code", "keep_id"), "code").filter(F.col(key) != F.col("keep_id"))
    return copies.select("keep_id", F.col(key).alias("copy_id")).distinct()


def collapsed_records(records: DataFrame, key: str) -> DataFrame:
    """(keep_id, copies, question, choices, answer_index): one record of each group, that of the least key (and writing, if a
    key has several)."""
    groups, _ = formatting_groups(records, key)
    named = records.withColumnRenamed(key, "keep_id")
    written = writings(named, "keep_id", "question", "choices", "answer_index").withColumnRenamed("writing", "keep_writing")
    kept = written.join(groups.select("keep_id", "keep_writing", "copies"), ["keep_id", "keep_writing"]).dropDuplicates(["keep_id", "keep_writing"])
    return kept.select("keep_id", "copies", "question", "choices", "answer_index")
