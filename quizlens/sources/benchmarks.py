"""Published benchmark layouts as canonical item tables.

Every loader returns a DataFrame of ITEM_SCHEMA and refuses a file with a bad row, naming
file, line and fault: a dropped row would change every denominator. Validation is one
distributed pass over flags; only the first fault travels to the driver.

Line numbers come without an RDD: rows carry their split's file and offset and a running number within it,
and a small table of rows per split gives each split its offset within the file.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizlens.functions.text import label_index
from quizlens.judgement import ITEM_SCHEMA

MIN_CSV_COLUMNS = 4


class CorpusError(ValueError):
    """A corpus file that cannot be read as it stands."""


# -- shared parts ----------------------------------------------------------------------------------


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of all lines, in any number of files and splits; lines count from 1."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value", F.monotonically_increasing_id().alias("_id")
    )
    splits = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    # one row per split of a file
    return lines.join(F.broadcast(splits), ["file", "_block"]).select("file", (F.col("_id") - F.col("_first") + F.col("_offset") + 1).alias("line_no"), "value")


def _first_fault(*checks: tuple[Column, str]) -> Column:
    """The message of the first check that holds (a null condition does not), else null."""
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(message)) for bad, message in checks))


def _refuse(rows: DataFrame) -> DataFrame:
    """``rows`` without its fault column, or an error that names the first fault."""
    bad = rows.filter(F.col("fault").isNotNull()).orderBy("file", "line_no").select("file", "line_no", "fault").limit(1).collect()
    if bad:
        raise CorpusError(f"{PurePosixPath(bad[0]['file']).name}:{bad[0]['line_no']}: {bad[0]['fault']}")
    return rows.drop("fault")


def _finished(rows: DataFrame) -> DataFrame:
    """Items in the order of their files and lines, with ``pos`` counted from 0, ids unique."""
    if rows.isEmpty():
        raise CorpusError("the corpus has no items")
    twice = rows.groupBy("item_id").count().filter("count > 1").orderBy("item_id").limit(1).collect()
    if twice:
        raise CorpusError(f"the id {twice[0]['item_id']!r} occurs more than once")
    files = rows.groupBy("file").agg(F.max("line_no").alias("_lines"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0)))  # one row per file
    # positions follow (file, line); gaps of skipped lines are closed by rank in ranges of lines
    placed = rows.join(F.broadcast(files), "file").withColumn("_at", F.col("_before") + F.col("line_no"))
    placed = placed.withColumn("_range", F.floor(F.col("_at") / 100_000))
    ranges = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    ranges = ranges.withColumn("_offset", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("_at"))
    return placed.join(F.broadcast(ranges), "_range").select(
        (F.col("_offset") + rank - 1).cast("long").alias("pos"), "item_id", "question", "choices", F.col("answer_index").cast("int").alias("answer_index"), F.coalesce("subject", F.lit("")).alias("subject")
    )


def _objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value, v) of all lines that are not blank; v is the parsed object, or null."""
    rows = numbered_lines(spark, path).filter(F.trim("value") != "")
    return rows.withColumn("v", F.try_parse_json("value"))


def _kind(path: str) -> Column:
    """The type of a member as Spark names it; null if it is absent."""
    return F.schema_of_variant(F.try_variant_get("v", F.lit(path), "variant"))


def _not_object() -> tuple[Column, str]:
    return F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT"), "not a JSON object"


def _item_faults() -> list[tuple[Column, str]]:
    return [
        (F.coalesce(F.col("item_id"), F.lit("")) == "", "the id is missing or empty"),
        (F.size("choices") < 2, "fewer than two options"),
        (F.exists("choices", lambda c: c.isNull()), "an option is missing"),
        (F.col("answer_index").isNull(), "the answer names no option"),
        ((F.col("answer_index") < 0) | (F.col("answer_index") >= F.size("choices")), "the answer is outside the options"),
    ]


def _from_objects(rows: DataFrame, parsed: DataFrame, faults: list[tuple[Column, str]]) -> DataFrame:
    checked = parsed.withColumn("fault", _first_fault(_not_object(), *faults, *_item_faults()))
    return _finished(_refuse(checked.select("file", "line_no", "item_id", "question", "choices", "answer_index", "subject", "fault")))


# -- loaders ---------------------------------------------------------------------------------------


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Canonical JSON Lines: id, question, choices, answer_index and optionally subject."""
    rows = _objects(spark, path)
    parsed = rows.withColumns(
        {
            "item_id": F.try_variant_get("v", F.lit("$.id"), "string"),
            "question": F.try_variant_get("v", F.lit("$.question"), "string"),
            "choices": F.try_variant_get("v", F.lit("$.choices"), "array<string>"),
            "answer_index": F.try_variant_get("v", F.lit("$.answer_index"), "bigint"),
            "subject": F.try_variant_get("v", F.lit("$.subject"), "string"),
        }
    )
    wanted = (("id", "STRING"), ("question", "STRING"), ("choices", "ARRAY<STRING>"), ("answer_index", "BIGINT"))
    faults = [(_kind(f"$.{name}").isNull(), f"the field {name} is missing") for name, _ in wanted]
    faults += [(_kind(f"$.{name}") != kind, f"the field {name} is not of type {kind.lower()}") for name, kind in wanted]
    faults.append((~_kind("$.subject").isin("STRING", "VOID"), "the field subject is not of type string"))
    return _from_objects(rows, parsed, faults)


def read_arc_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """ARC JSON Lines: question.stem, question.choices[].{text, label}, answerKey."""
    layout = "id STRING, question STRUCT<stem: STRING, choices: ARRAY<STRUCT<text: STRING, label: STRING>>>, answerKey STRING"
    rows = _objects(spark, path).withColumn("r", F.from_json("value", layout))
    texts = F.col("r.question.choices.text")
    parsed = rows.withColumns(
        {"item_id": F.col("r.id"), "question": F.col("r.question.stem"), "choices": texts, "answer_index": key_index(F.col("r.answerKey"), F.col("r.question.choices.label"), F.size(texts)), "subject": F.lit("")}
    )
    faults = [
        (F.col("r.question.stem").isNull(), "question.stem is missing"),
        (F.col("r.question.choices").isNull(), "question.choices is missing"),
        (F.exists("r.question.choices.label", lambda x: x.isNull()), "an option has no label"),
    ]
    return _from_objects(rows, parsed, faults)


def key_index(key: Column, labels: Column, n: Column) -> Column:
    """The option whose own label is the key; else what the key names as a letter or number."""
    trimmed = F.trim(key)
    own = F.array_position(labels, trimmed)
    return F.when(own > 0, (own - 1).cast("int")).otherwise(label_index(trimmed, n))


def read_hellaswag(spark: SparkSession, path: str) -> DataFrame:
    """HellaSwag JSON Lines: ctx (or ctx_a), endings, label as a number or a string of one."""
    rows = _objects(spark, path)
    label = F.coalesce(F.try_variant_get("v", F.lit("$.label"), "string"), F.lit(""))
    parsed = rows.withColumns(
        {
            "item_id": F.try_variant_get("v", F.lit("$.ind"), "string"),
            "question": F.coalesce(F.try_variant_get("v", F.lit("$.ctx"), "string"), F.try_variant_get("v", F.lit("$.ctx_a"), "string")),
            "choices": F.try_variant_get("v", F.lit("$.endings"), "array<string>"),
            "answer_index": F.when(F.trim(label).rlike("^[0-9]{1,9}$"), F.trim(label).cast("int")),
            "subject": F.try_variant_get("v", F.lit("$.activity_label"), "string"),
        }
    )
    faults = [
        (F.trim(label) == "", "the label is empty: a split without labels cannot be audited"),
        (F.col("answer_index").isNull(), "the label is not a number"),
        (F.col("question").isNull(), "ctx and ctx_a are missing"),
        (F.col("choices").isNull() | (F.size("choices") == 0), "endings are missing"),
    ]
    return _from_objects(rows, parsed, faults)


def read_truthfulqa(spark: SparkSession, path: str) -> DataFrame:
    """TruthfulQA MC1: an ordered map of option to 0 or 1 with exactly one 1; ids from file and line."""
    rows = _objects(spark, path).withColumn("r", F.from_json("value", "question STRING, mc1_targets MAP<STRING, INT>, category STRING"))
    entries = F.map_entries("r.mc1_targets")
    flags = F.transform(entries, lambda e: e["value"])
    parsed = rows.withColumns(
        {
            "item_id": F.concat(_stem(F.col("file")), F.lit("-"), F.lpad(F.col("line_no").cast("string"), 5, "0")),
            "question": F.col("r.question"),
            "choices": F.transform(entries, lambda e: e["key"]),
            "answer_index": (F.array_position(flags, 1) - 1).cast("int"),
            "subject": F.col("r.category"),
        }
    )
    faults = [(F.col("r.mc1_targets").isNull(), "mc1_targets is missing"), (F.size(F.filter(flags, lambda x: x == 1)) != 1, "not exactly one correct option")]
    return _from_objects(rows, parsed, faults)


def _stem(file: Column) -> Column:
    return F.url_decode(F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", ""))


def read_mmlu_csv(spark: SparkSession, path: str, subject: str | None = None) -> DataFrame:
    """MMLU CSV, one file or a folder of them: question, options, answer letter; no header.

    Quoted fields may hold line breaks, so a file is parsed as a whole by one task, files in parallel.
    Blank rows are skipped but counted.
    """

    def parse(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in files:
            for file, text in zip(part["file"], part["value"]):
                found = [(file, i, row) for i, row in enumerate(csv.reader(io.StringIO(text)), start=1) if any(x.strip() for x in row)]
                yield pd.DataFrame(found, columns=["file", "line_no", "fields"])

    source = spark.read.text(path, wholetext=True, pathGlobFilter="*.csv").select(F.col("_metadata.file_path").alias("file"), "value")
    if source.isEmpty():
        raise CorpusError(f"no CSV file in {path}")
    rows = source.mapInPandas(parse, "file string, line_no long, fields array<string>")
    choices = F.slice("fields", 2, F.greatest(F.size("fields") - 2, F.lit(0)))
    named = F.lit(subject) if subject is not None else F.regexp_replace(_stem(F.col("file")), "_", " ")
    parsed = rows.withColumns(
        {
            "item_id": F.concat(_stem(F.col("file")), F.lit("-"), F.lpad(F.col("line_no").cast("string"), 5, "0")),
            "question": F.get("fields", 0),
            "choices": choices,
            "answer_index": label_index(F.element_at("fields", -1), F.size(choices)),
            "subject": named,
        }
    )
    short = (F.size("fields") < MIN_CSV_COLUMNS, f"fewer than {MIN_CSV_COLUMNS} columns")
    checked = parsed.withColumn("fault", _first_fault(short, *_item_faults()))
    return _finished(_refuse(checked.select("file", "line_no", "item_id", "question", "choices", "answer_index", "subject", "fault")))


def _parquet_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.row_index") + 1).alias("line_no"))


def read_arc_parquet(spark: SparkSession, path: str) -> DataFrame:
    """ARC parquet: id, question, choices as parallel lists of text and label, answerKey."""
    rows = _parquet_rows(spark, path)
    key = "answerKey" if "answerKey" in rows.columns else "answer_key"
    parsed = rows.select(
        "file", "line_no", F.col("id").alias("item_id"), "question", F.col("choices.text").alias("choices"), key_index(F.col(key), F.col("choices.label"), F.size("choices.text")).alias("answer_index"), F.lit("").alias("subject")
    )
    return _finished(_refuse(parsed.withColumn("fault", _first_fault((F.col("question").isNull(), "the question is missing"), *_item_faults()))))


def read_mmlu_parquet(spark: SparkSession, path: str) -> DataFrame:
    """MMLU parquet: question, choices, answer as an index, subject; ids from subject and row."""
    rows = _parquet_rows(spark, path)
    parsed = rows.select(
        "file",
        "line_no",
        F.concat(F.coalesce("subject", F.lit("")), F.lit("-"), F.lpad(F.col("line_no").cast("string"), 5, "0")).alias("item_id"),
        "question",
        "choices",
        F.col("answer").cast("int").alias("answer_index"),
        "subject",
    )
    return _finished(_refuse(parsed.withColumn("fault", _first_fault((F.col("question").isNull(), "the question is missing"), *_item_faults()))))


def from_items(spark: SparkSession, items: Iterable[tuple]) -> DataFrame:
    """A corpus of driver-side rows (id, question, choices, answer_index[, subject]), in their order; held to the same rules as files."""
    rows = [(k, i, q, list(c), a, *(subject or [""])) for k, (i, q, c, a, *subject) in enumerate(items)]
    frame = spark.createDataFrame(rows, ITEM_SCHEMA).withColumns({"file": F.lit("items"), "line_no": F.col("pos") + 1})
    checked = frame.drop("pos").withColumn("fault", _first_fault((F.col("question").isNull(), "the question is missing"), *_item_faults()))
    return _finished(_refuse(checked))


def union_corpora(corpora: list[DataFrame]) -> DataFrame:
    """One corpus after another; positions run on."""
    numbered = [c.withColumn("_part", F.lit(i)) for i, c in enumerate(corpora)]
    sizes = [c.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("n")).first()["n"] for c in corpora]
    shifted = [c.withColumn("pos", F.col("pos") + sum(sizes[:i])) for i, c in enumerate(numbered)]
    return reduce(DataFrame.unionByName, shifted).drop("_part")


LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "canonical": read_canonical,
    "mmlu": read_mmlu_csv,
    "mmlu-dir": read_mmlu_csv,
    "mmlu-parquet": read_mmlu_parquet,
    "arc": read_arc_jsonl,
    "arc-parquet": read_arc_parquet,
    "hellaswag": read_hellaswag,
    "truthfulqa": read_truthfulqa,
}


def write_canonical(items: DataFrame, path: str) -> None:
    """Canonical JSON Lines in corpus order, keys sorted, an empty subject left out."""
    subject = F.when(F.coalesce("subject", F.lit("")) != "", F.col("subject")).alias("subject")
    line = F.to_json(F.struct("answer_index", "choices", F.col("item_id").alias("id"), F.coalesce("question", F.lit("")).alias("question"), subject)).alias("value")
    items.orderBy("pos").select(line).write.mode("overwrite").text(path)
