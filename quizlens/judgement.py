"""Judged estimates: every number that an audit may print is a row of one table.

Detectors and attribution give rows of RAW. ``judged`` turns them into rows of JUDGED by column expressions: intervals are
widened to hold their points, p-values are corrected within their layer, the gate answers, and
the least detectable effect stands beside each. Reports are views of that table.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizlens.functions import statistics as st

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType(), "array<string>": T.ArrayType(T.StringType())}


def _schema(columns: str) -> T.StructType:
    """A schema from its DDL, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


ITEM_SCHEMA = _schema("pos bigint, item_id string, question string, choices array<string>, answer_index int, subject string")

# layer: share (of a score's drop), defect (of a corpus) or blind (a score that is only shown)
RAW = _schema("layer string, part string, what string, point double, low double, high double, p double, n bigint, se double, method string, note string")
JUDGED = _schema(
    "layer string, part string, what string, point double, low double, high double, p double, n bigint, method string, note string, "
    "adjusted double, detectable double, verdict string"
)
SHOWN_ONLY = "shown"  # verdict of the blind layer


@dataclass(frozen=True)
class Rule:
    """What must hold before a number is reported."""

    alpha: float = 0.01
    power: float = 0.80
    draws: int = 10_000
    min_effect: float = 0.005
    require_positive: bool = True

    def __post_init__(self) -> None:
        # fixed value: fewer draws than a thousand give no tail to speak of
        sound = {"alpha": 0 < self.alpha < 1, "power": 0 < self.power < 1, "draws": self.draws >= 1000, "min_effect": 0 <= self.min_effect < float("inf")}
        if wrong := [name for name, holds in sound.items() if not holds]:
            raise ValueError(f"out of range: {', '.join(wrong)}")

    def settings(self) -> dict[str, object]:
        return asdict(self)


def raw_row(layer: str, part: str, what: str, point: float, interval: tuple[float, float], p: float, n: int, method: str, se: float | None = None, note: str = "") -> dict[str, object]:
    return {"layer": layer, "part": part, "what": what, "point": float(point), "low": float(interval[0]), "high": float(interval[1]), "p": float(p), "n": int(n), "se": se, "method": method, "note": note}


def raw_table(spark: SparkSession, rows: Iterable[Mapping[str, object]]) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(c) for c in RAW.names) for r in rows], RAW)


def judged(raw: DataFrame, rule: Rule) -> DataFrame:
    """Rows of JUDGED in the order of their layer and part; the blind layer is shown without a verdict."""
    low, high = st.covering(F.col("low"), F.col("high"), F.col("point"))
    rows = st.holm(raw.withColumns({"low": low, "high": high}), "p", ["part"], ["layer"])
    by_interval = st.mde_from_interval(F.col("low"), F.col("high"), rule.alpha, rule.power)
    answer = st.gate(F.col("point"), F.col("low"), F.col("high"), F.col("adjusted"), rule.alpha, rule.min_effect, rule.require_positive)
    rows = rows.withColumns(
        {
            "detectable": F.coalesce(st.mde_from_se(F.col("se"), rule.alpha, rule.power), by_interval),
            "verdict": F.when(F.col("layer") == "blind", SHOWN_ONLY).otherwise(answer),
        }
    )
    return rows.select(*JUDGED.names).orderBy("layer", "part")


def established(table: DataFrame) -> DataFrame:
    """Rows that the gate lets through."""
    return table.filter(F.col("verdict") == st.ESTABLISHED)


def attributed_points(table: DataFrame) -> DataFrame:
    """One row: the sum of the established shares of a drop."""
    counts = (F.col("layer") == "share") & (F.col("verdict") == st.ESTABLISHED)
    return table.agg(F.coalesce(F.sum(F.when(counts, F.col("point"))), F.lit(0.0)).alias("attributed"))


def score_summary(table: DataFrame, reported: float, drop: float, chance: float) -> DataFrame:
    """One row: reported, chance, drop, attributed, assayed, purity."""
    assayed, pure = st.purity(F.lit(reported), F.col("attributed"))
    return attributed_points(table).select(
        F.lit(reported).alias("reported"), F.lit(chance).alias("chance"), F.lit(drop).alias("drop"), "attributed", assayed.alias("assayed"), pure.alias("purity")
    )


@dataclass(frozen=True)
class Findings:
    """The corpus layer: judged rows, detectors that the corpus is too small or unfit for (not the same as passed), and the number
    of repeats that were withheld from detectors which assume independent items."""

    rows: tuple[Row, ...]
    not_run: tuple[str, ...] = ()
    withheld: int = 0


@dataclass(frozen=True)
class Audit:
    """Judged rows with what produced them (``run``) and the scores that follow from them (``scores``)."""

    run: Mapping[str, object]
    scores: Mapping[str, float | None]
    rows: tuple[Row, ...]
    not_run: tuple[str, ...] = ()

    def layer(self, name: str) -> list[Row]:
        return [r for r in self.rows if r["layer"] == name]

    def charged(self) -> tuple[str, ...]:
        """Parts of the drop that are established."""
        return tuple(r["part"] for r in self.layer("share") if r["verdict"] == st.ESTABLISHED)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), JUDGED)
