"""Synthetic corpora with planted defects of known size, from ``spark.range`` and digests alone.

Any row can be computed from its number, so generation is one map without a shuffle, and the same on
every partitioning. All words have the same length, so that unpadded options tie in length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlens.functions.text import uniform

SUBJECTS = ("harbour records", "field surveys", "workshop notes", "ledger reviews")
QUESTION_WORDS, OPTION_WORDS, PADDING_WORDS = 11, 3, 5
MARKER = "zzmarkz"  # as long as every other word
VOCABULARY = 600
_VOWELS, _CONSONANTS = "aeiou", "bdfgklmnprst"


def vocabulary(size: int = VOCABULARY) -> list[str]:
    """Pronounceable words of seven letters, made from their number."""
    pattern = (_CONSONANTS, _VOWELS, _CONSONANTS, _CONSONANTS, _VOWELS, _CONSONANTS, _VOWELS)
    words, total = [], 1
    for letters in pattern:
        total *= len(letters)
    for i in range(size):
        rest, word = i * (total // size | 1) + 101, ""
        for letters in pattern:
            rest, k = divmod(rest, len(letters))
            word += letters[k]
        words.append(word)
    return words


# Each defect is planted at a rate of its own, independently of the others.
DEFECTS = ("position", "longest", "marker", "repeat")


def planted(rate: float, choices: int) -> float:
    """What a rate of ``position``, ``longest`` or ``marker`` makes of the chance 1 / choices: the share of keys at the
    favoured position, and the accuracy of picking the longest, or the marked, option."""
    return rate + (1 - rate) / choices


def repeats(n: int, rate: float) -> int:
    """Items that are appended once more, of a corpus of n."""
    return int(n * rate)


def _words(seed: int, name: str, key: Column, n: int) -> Column:
    """``n`` words of the vocabulary, four digits of one digest each."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(name), key.cast("string")), 256)
    pick = lambda k: (F.conv(F.substring(digest, k * 4 + 1, 4), 16, 10).cast("int") % VOCABULARY + 1)
    known = F.array(*map(F.lit, vocabulary()))
    return F.array_join(F.transform(F.array(*(pick(k) for k in range(n))), lambda i: F.element_at(known, i)), " ")


def generate(spark: SparkSession, n: int, seed: int = 0, choices: int = 4, favoured: int = 0, **rates: float) -> DataFrame:
    """Items ``syn-0000000`` .. in order; repeats of the first items follow under ids of their own."""
    if wrong := [name for name, rate in rates.items() if name not in DEFECTS or not 0 <= rate <= 1]:
        raise ValueError(f"defects are rates in [0, 1] of {DEFECTS}: {wrong}")
    if n < 1 or choices < 2 or not 0 <= favoured < choices:
        raise ValueError("an item, two options and a favoured position among them are the least")
    rate = lambda name: float(rates.get(name, 0.0))
    rows = spark.range(n + repeats(n, rate("repeat"))).withColumnRenamed("id", "pos").withColumn("src", F.col("pos") % n)
    hit = lambda name: uniform(seed, name, F.col("src"), 0) < rate(name)
    anywhere = F.floor(uniform(seed, "key", F.col("src"), 0) * choices).cast("int")
    rows = rows.withColumns({"answer_index": F.when(hit("position"), F.lit(favoured)).otherwise(anywhere), "question": _words(seed, "question", F.col("src"), QUESTION_WORDS)})

    def option(j: int) -> Column:
        plain = _words(seed, f"option-{j}", F.col("src"), OPTION_WORDS)
        marked = F.when(hit("marker"), F.concat(F.lit(MARKER), F.substring(plain, len(MARKER) + 1, 1000))).otherwise(plain)
        padded = F.when(hit("longest"), F.concat_ws(" ", marked, _words(seed, "padding", F.col("src"), PADDING_WORDS))).otherwise(marked)
        return F.when(F.col("answer_index") == j, padded).otherwise(plain)

    return rows.select(
        "pos",
        F.concat(F.lit("syn-"), F.lpad(F.col("pos").cast("string"), 7, "0")).alias("item_id"),
        F.concat(F.upper(F.substring("question", 1, 1)), F.substring("question", 2, 1000), F.lit("?")).alias("question"),
        F.array(*map(option, range(choices))).alias("choices"),
        "answer_index",
        F.element_at(F.array(*map(F.lit, SUBJECTS)), (F.col("src") % len(SUBJECTS) + 1).cast("int")).alias("subject"),
    )
