"""One form for text that looks the same (problem 5).

Two forms, both made once per distinct value of a batch, ASCII values by a fast path:

* ``visual_form`` keeps every visible difference: characters nobody sees are removed, all spaces become
  one kind, compatibility characters that only differ in width, joining, style or encoding (full and half
  width, ligatures, presentation forms, unit signs, mathematical letters) become ordinary ones, characters
  that are drawn alike become one of them, and the result is composed. Case, accents, raised
  digits, fractions, dashes of another length and the like stay.
* ``folded_form`` is the full compatibility form on top of it, with full case folding, for
  comparisons that ignore these too.

Which characters are drawn alike is public data of the Unicode consortium ("confusables"), which the ICU
library that Spark ships carries. That data is meant for names and goes further than a reader's
eye: it equates O and 0, or I, l and 1. So characters are alike here only if they also are of one kind (capital
letters, small letters, other letters, digits, signs); ASCII characters are never changed.

Defined cases: null stays null and equals only null; an empty text and one of invisible characters
only have the empty form; leading, trailing and repeated spaces count as one or none.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlens.session import materialise

# Code points that the Unicode standard lists as default-ignorable.
_IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

# Kinds of compatibility mapping that leave the look of a character.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
_KEPT = "ſ"  # mapped to s as <compat>, though it looks different
_TOLD_APART = "–"  # equated with a hyphen, though readers see its length

_ASKED_AT_ONCE = 20_000


def _kind(c: str) -> str | None:
    """What two characters must both be to count as alike."""
    category = unicodedata.category(c)
    return category if category[0] == "L" else category[0] if category[0] in "N" else "sign" if category[0] in "PS" else None


@lru_cache(maxsize=4)
def _alike(spark: SparkSession) -> Mapping[str, str]:
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    known = [c for c in map(chr, range(0x20, sys.maxunicode + 1)) if _kind(c)]
    groups: dict[tuple[str, str], list[str]] = defaultdict(list)
    for start in range(0, len(known), _ASKED_AT_ONCE):
        part = known[start : start + _ASKED_AT_ONCE]
        for c, skeleton in zip(part, checker.getSkeleton("\n".join(part)).split("\n"), strict=True):
            groups[skeleton, _kind(c)].append(c)
    return {c: group[0] for group in groups.values() for c in group[1:] if not c.isascii() and c not in _TOLD_APART}


def look_alikes(spark: SparkSession) -> Mapping[str, str]:
    """Character to the least one of its kind that is drawn alike; some thousand entries, asked of ICU once per session."""
    return _alike(spark)


def _is_invisible(c: str) -> bool:
    point = ord(c)
    return any(a <= point <= b for a, b in _IGNORABLE) or (unicodedata.category(c) == "Cc" and not c.isspace())


class _Table(dict):
    """Code point to its replacement, found by rule when first met; bounded by the number of characters."""

    def __init__(self, alike: Mapping[str, str]) -> None:
        super().__init__()
        self.alike = alike

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if _is_invisible(c):
            out = ""
        elif c.isspace():
            out = " "
        else:
            kind, _, mapped = unicodedata.decomposition(c).partition(" ")
            target = "".join(chr(int(x, 16)) for x in mapped.split()) if kind in _SAME_LOOK and c not in _KEPT else ""
            if target and not target.startswith(" "):  # a spacing accent is no accent after a space
                out = target.translate(self)
            else:
                out = self.alike.get(c, c)
        self[point] = out
        return out


_SPACES = re.compile(" +")


class Forms:
    """The two forms of a text, by a table of look-alikes."""

    def __init__(self, alike: Mapping[str, str]) -> None:
        self.table = _Table(alike)

    def visual(self, text: str) -> str:
        """The form that texts share if and only if they look the same."""
        if not text.isascii():
            # until nothing changes: removing and mapping can make characters meet that compose
            before = None
            while text != before:
                before = text
                text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(self.table)).translate(self.table))
        elif not text.isprintable():
            text = text.translate(self.table)
        return _SPACES.sub(" ", text).strip(" ")

    def folded(self, text: str) -> str:
        """The compatibility form in one case."""
        return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", self.visual(text)).casefold())


def _per_distinct(column: pa.Array, form: Callable[[str], str]) -> pa.Array:
    encoded = column.dictionary_encode()
    forms = pa.array([None if v is None else form(v) for v in encoded.dictionary.to_pylist()], type=pa.string())
    return forms.take(encoded.indices)


def text_forms(rows: DataFrame, key: str, text: str, texts: str, fold: bool = False, keep: tuple[Column, ...] = ()) -> DataFrame:
    """(key, kept columns, question, choices): one text and one list of texts of each row in their consistent form; no shuffle."""
    alike = dict(look_alikes(rows.sparkSession))
    source = rows.select(F.col(key), *keep, F.col(text).cast("string").alias("question"), F.col(texts).alias("choices"))
    names = source.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms(alike)
        form = forms.folded if fold else forms.visual
        for batch in batches:
            lists = batch.column(len(names) - 1)
            parts = _per_distinct(lists.flatten(), form)
            offsets, at = [], 0
            for n in lists.value_lengths().to_pylist():
                offsets.append(None if n is None else at)
                at += n or 0
            out = pa.ListArray.from_arrays(pa.array([*offsets, at], type=pa.int32()), parts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], _per_distinct(batch.column(len(names) - 2), form), out], names=names)

    return source.mapInArrow(run, f"{kinds}, question string, choices array<string>")


def _identity(text: Column, texts: Column) -> Column:
    """Digest of a row's texts; null differs from empty."""
    return F.unhex(F.md5(F.to_json(F.struct(text.alias("q"), texts.alias("c")))))


def look_alike_pairs(rows: DataFrame, key: str, text: str, texts: str) -> DataFrame:
    """(rec_a, rec_b): rows that look the same but differ in a character.

    Rows are reduced to digests of their form and of their spelling. The distinct spellings of a form
    are paired, not its rows, and rows are joined to the pairs at the end: equal rows, however
    many, are never compared with each other.
    """
    spelled = rows.filter(F.col(key).isNotNull())
    forms = text_forms(spelled, key, text, texts, keep=(_identity(F.col(text).cast("string"), F.col(texts)).alias("raw"),))
    marked = materialise(forms.select(key, "raw", _identity(F.col("question"), F.col("choices")).alias("form")), "look-alikes")
    spellings = marked.select("form", "raw").distinct()
    several = spellings.groupBy("form").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("form")
    near = materialise(spellings.join(several, "form", "left_semi"), "spellings")
    side = lambda x: near.select("form", F.col("raw").alias(f"raw_{x}"))
    pairs = side("a").join(side("b"), "form").filter("raw_a < raw_b").select("raw_a", "raw_b")
    named = lambda x: marked.select(F.col("raw").alias(f"raw_{x}"), F.col(key).alias(f"_{x}"))
    both = pairs.join(named("a"), "raw_a").join(named("b"), "raw_b")
    return both.select(F.least("_a", "_b").alias("rec_a"), F.greatest("_a", "_b").alias("rec_b"))
