"""Reports as JSON and as text, and the comparison of two runs.

A report is a view of the table of judged rows. The rule of its text: a number that is not established is never
printed, a dash and the least detectable effect stand in its place.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizlens.functions.statistics import ESTABLISHED, REFUSALS
from quizlens.judgement import JUDGED, SHOWN_ONLY, Audit, Findings

WIDTH = 78
SCHEMA_VERSION = 2  # of report files; others are refused


# -- JSON ------------------------------------------------------------------------------------------


def _plain(value: object) -> object:
    """Null for what JSON has no number for."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, Mapping):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def to_json(audit: Audit, indent: int = 2) -> str:
    """Keys in order, ASCII; one line if ``indent`` is 0."""
    content = {"version": SCHEMA_VERSION, "run": audit.run, "scores": audit.scores, "not_run": audit.not_run, "judgements": [r.asDict() for r in audit.rows]}
    return json.dumps(_plain(content), sort_keys=True, indent=indent or None, allow_nan=False)


def from_json(text: str) -> Audit:
    """The inverse of ``to_json``; a list of detectors that were not run may be absent."""
    content = json.loads(text)
    if content.get("version") != SCHEMA_VERSION:
        raise ValueError(f"a report of version {content.get('version')} is not read here, only of version {SCHEMA_VERSION}")
    make = Row(*JUDGED.names)
    number = lambda f, v: math.nan if v is None and isinstance(f.dataType, T.DoubleType) else v
    rows = tuple(make(*(number(f, r[f.name]) for f in JUDGED)) for r in content["judgements"])
    return Audit(content["run"], content["scores"], rows, tuple(content.get("not_run", ())))


# -- text ------------------------------------------------------------------------------------------


def percent(x: float | None) -> str:
    return f"{100 * x:.2f}%" if x is not None and math.isfinite(x) else "n/a"


def interval(row: Row) -> str:
    return f"{percent(row['point'])} [{percent(row['low'])}, {percent(row['high'])}]"


def short(digest: str) -> str:
    """The first twelve digits, after the name of the digest if there is one."""
    *kind, value = digest.split(":", 1)
    return ":".join([*kind, value[:12]])


def _block(title: str, lines: Iterable[str]) -> str:
    body = list(lines)
    return "\n".join([f"== {title} ".ljust(WIDTH, "="), *body]) if body else ""


def render_provenance(run: Mapping) -> str:
    s = run["settings"]
    lines = [
        f"corpus  {run['corpus']}, {run['items']} items, {short(run['corpus_hash'])}",
        f"scorer  {run['scorer']}",
        f"config  {short(run['settings_hash'])}, seed {s['seed']}, alpha {s['alpha']:g}, power {s['power']:g}, {s['draws']} draws",
        f"engine  {run['engine']}; " + ", ".join(f"{k} {v}" for k, v in sorted(run["libraries"].items())),
    ]
    return _block("provenance", lines + ["note    the scorer is not deterministic: another run may differ"] * (not run["deterministic"]))


def render_row(row: Row) -> str:
    """One judged row: its number if it is established, else what would have shown and why it is refused."""
    head = f"  {row['what']:<58.58} "
    if row["verdict"] == ESTABLISHED:
        return f"{head}{interval(row)}" + (f"\n      {row['note']}" if row["note"] else "")
    why = row["note"] if row["layer"] == "share" and row["note"] else REFUSALS[row["verdict"]]
    return f"{head}-\n      effects from {percent(row['detectable'])} would show; {why}"


def render_scores(audit: Audit) -> str:
    totals = [f"{name:<60} {percent(audit.scores[name])}" for name in ("reported", "assayed", "purity")]
    return _block("score", [totals[0], *map(render_row, audit.layer("share")), *totals[1:]])


def blind_remark(row: Row, chance: float) -> str:
    """Where the interval of the blind score lies against chance."""
    where = "above" if row["low"] > chance else "below" if row["high"] < chance else "around"
    return {"above": "the options carry part of the score by themselves", "below": "without the question the scorer does worse than guessing", "around": "no better than guessing, as far as this sample tells"}[where]


def render_blind(audit: Audit) -> str:
    chance = audit.scores["chance"]
    return _block("without the question", [x for r in audit.layer("blind") for x in (f"  {interval(r)}; guessing gives {percent(chance)}", f"  {blind_remark(r, chance)}")])


def render_corpus(found: Findings | Audit) -> str:
    lines = [render_row(r) for r in found.rows if r["layer"] == "defect"] + [f"  {name}: not run, the corpus does not allow it" for name in found.not_run]
    if isinstance(found, Findings):
        lines.append(f"  repeats withheld from detectors that assume independent items: {found.withheld}")
    return _block("corpus", lines)


def render(audit: Audit) -> str:
    return "\n\n".join(filter(None, (render_provenance(audit.run), render_scores(audit), render_blind(audit), render_corpus(audit))))


# -- comparison ------------------------------------------------------------------------------------


class NotComparable(ValueError):
    """Two runs that do not differ in the scorer alone."""


# What two runs must share, and what they must not, with the words for a run that does otherwise.
_SHARED = {"corpus_hash": "different corpora", "settings_hash": "different configurations"}
_OWN = {"scorer": "the same scorer"}


@dataclass(frozen=True)
class Comparison:
    """``scores``: (name, baseline, variant); ``parts``: rows (part, baseline, variant) of what is charged to either."""

    baseline: str
    variant: str
    items: int
    scores: tuple[tuple[str, float, float], ...]
    parts: tuple[Row, ...]

    def charged_to(self, one: str) -> tuple[str, ...]:
        """Parts charged to one of the two runs only."""
        other = {"baseline": "variant", "variant": "baseline"}[one]
        return tuple(r["part"] for r in self.parts if r[one] and not r[other])


def charged_difference(baseline: DataFrame, variant: DataFrame) -> DataFrame:
    """(part, baseline, variant): parts of the drop that are charged to one of two judged tables and not to the other."""
    side = lambda table, name: table.filter((F.col("layer") == "share") & (F.col("verdict") == ESTABLISHED)).select("part", F.lit(True).alias(name))
    both = side(baseline, "baseline").join(side(variant, "variant"), "part", "full")
    flags = both.select("part", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("baseline", "variant")))
    return flags.filter("baseline <> variant").orderBy("part")


def compare(spark: SparkSession, baseline: Audit, variant: Audit) -> Comparison:
    """What differs between two runs of different scorers; every reason against comparing them is named."""
    same = lambda key: baseline.run[key] == variant.run[key]
    against = [words for key, words in _SHARED.items() if not same(key)] + [words for key, words in _OWN.items() if same(key)]
    if against:
        raise NotComparable(f"the two runs have {' and '.join(against)}")
    scores = tuple((name, baseline.scores[name], variant.scores[name]) for name in ("reported", "assayed"))
    parts = tuple(charged_difference(baseline.table(spark), variant.table(spark)).collect())  # at most one row per player
    return Comparison(baseline.run["scorer"], variant.run["scorer"], baseline.run["items"], scores, parts)


def render_comparison(c: Comparison) -> str:
    lines = [f"baseline  {c.baseline}", f"variant   {c.variant}", f"items     {c.items}", f"{'':<12}{'baseline':>12}{'variant':>12}{'difference':>14}"]
    lines += [f"{name:<12}{percent(a):>12}{percent(b):>12}{100 * (b - a):>+13.2f}pp" for name, a, b in c.scores]
    lines += [f"charged to the {one} only: {', '.join(parts)}" for one in ("baseline", "variant") if (parts := c.charged_to(one))]
    return _block("comparison", lines)


__all__ = ["SHOWN_ONLY", "Comparison", "NotComparable", "blind_remark", "charged_difference", "compare", "from_json", "render", "render_comparison", "render_corpus", "to_json"]
