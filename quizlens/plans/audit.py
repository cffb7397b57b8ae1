"""The audit: coalition outcomes, their attribution, and the gate.

Spark reduces all presented items to the counts of distinct outcome vectors (at most a few thousand rows,
whatever the corpus' size); resampling works on these.
"""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Mapping, Sequence

import numpy as np
import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import quizlens
from quizlens import resampling as rs
from quizlens.functions import statistics as st
from quizlens.functions.text import item_digest, with_normal
from quizlens.judgement import Audit, Findings, Rule, judged, raw_row, raw_table, score_summary
from quizlens.operators.detectors import Detector, run_detectors
from quizlens.operators.interventions import PLAYERS, Player, coalitions, describe, name_of
from quizlens.operators.scoring import Scorer, SimulatedScorer, outcomes
from quizlens.session import materialise

MAX_PATTERNS = 1 << 26  # figures of distinct outcome vectors that the driver takes (half a GB)
_RANGE = 100_000  # positions that are folded together for the corpus hash


def presented(items: DataFrame, scorer: Scorer, seed: int, players: Sequence[Player] = PLAYERS) -> DataFrame:
    """(pos, mask, variant, prompt, correct): the scored outcome of every variant of every coalition."""
    if isinstance(scorer, SimulatedScorer):
        return outcomes(coalitions(items.withColumn("latents", scorer.latents()), seed, players, ["latents"]), scorer)
    return outcomes(coalitions(items, seed, players), scorer)


def coalition_outcomes(scored: DataFrame) -> DataFrame:
    """(pos, mask, hits, variants, mean): the share of an item's variants that are answered correctly."""
    rows = scored.groupBy("pos", "mask").agg(F.sum("correct").alias("hits"), F.count(F.lit(1)).alias("variants"))
    return rows.withColumn("mean", F.col("hits") / F.col("variants"))


def coalition_accuracy(by_item: DataFrame) -> DataFrame:
    """(mask, accuracy) over all items."""
    return by_item.groupBy("mask").agg(F.round(F.avg("mean"), 9).alias("accuracy"))


def shapley_shares(accuracy: DataFrame, players: Sequence[str] = PLAYERS) -> DataFrame:
    """(player, share): each player's exact part of the drop, as a fixed linear form of the accuracies."""
    matrix = rs.shapley_weights(len(players))
    terms = [F.struct(F.lit(name).alias("player"), F.round(F.sum(F.element_at(F.array(*map(F.lit, matrix[i].tolist())), F.col("mask") + 1) * F.col("accuracy")), 9).alias("share")) for i, name in enumerate(players)]
    return accuracy.agg(F.array(*terms).alias("all")).select(F.explode("all").alias("s")).select("s.player", "s.share")


def total_drop(accuracy: DataFrame, players: Sequence[str] = PLAYERS) -> DataFrame:
    full = (1 << len(players)) - 1
    pick = lambda mask: F.max(F.when(F.col("mask") == mask, F.col("accuracy")))
    return accuracy.agg(F.round(pick(0) - pick(full), 9).alias("total_drop"))


def outcome_patterns(by_item: DataFrame, masks: int) -> DataFrame:
    """(m0 .. m<masks - 1>, n): distinct vectors of outcomes with their number of items."""
    wide = by_item.groupBy("pos").agg(*(F.max(F.when(F.col("mask") == m, F.round("mean", 12))).alias(f"m{m}") for m in range(masks)))
    return wide.groupBy(*(f"m{m}" for m in range(masks))).agg(F.count(F.lit(1)).alias("n"))


def inert_flags(patterns: DataFrame, players: Sequence[str] = PLAYERS) -> DataFrame:
    """(player, inert): whether a player changes no item's outcome under any coalition, from distinct outcome vectors."""
    masks = range(1 << len(players))

    def unmoved(i: int) -> Column:
        without = [m for m in masks if not m >> i & 1]
        return F.bool_and(F.array(*(F.col(f"m{m}") for m in without)) == F.array(*(F.col(f"m{m | 1 << i}") for m in without)))

    flags = [F.struct(F.lit(name).alias("player"), unmoved(i).alias("inert")) for i, name in enumerate(players)]
    return patterns.agg(F.array(*flags).alias("all")).select(F.explode("all").alias("s")).select("s.player", "s.inert")


def blind_outcomes(items: DataFrame, scorer: Scorer) -> DataFrame:
    """(pos, mask, variant, prompt, correct): each item shown (mask 0) and with its question withheld (mask 1)."""
    carry = []
    if isinstance(scorer, SimulatedScorer):
        items, carry = items.withColumn("latents", scorer.latents()), ["latents"]
    rows = with_normal(items.select("pos", F.coalesce("question", F.lit("")).alias("question"), "choices", "answer_index", *carry))
    rows = rows.withColumns({"nq0": F.col("nq"), "nc0": F.col("nc"), "a0": F.col("answer_index"), "variant": F.lit(-1), "mask": F.explode(F.array(F.lit(0), F.lit(1)))})
    shown = lambda q: F.when(F.col("mask") == 0, F.col(q)).otherwise("")
    return outcomes(rows.withColumns({"question": shown("question"), "nq": shown("nq")}), scorer)


def paired_cells(by_item: DataFrame, control: int = 0, treatment: int = 1) -> DataFrame:
    """One row: n, both, control_only, treatment_only, neither, delta of two conditions of each item."""
    wide = by_item.groupBy("pos").agg(F.max(F.when(F.col("mask") == control, F.col("hits"))).alias("c"), F.max(F.when(F.col("mask") == treatment, F.col("hits"))).alias("t"))
    cells = wide.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("c") == 1) & (F.col("t") == 1)).alias("both"),
        F.count_if((F.col("c") == 1) & (F.col("t") == 0)).alias("control_only"),
        F.count_if((F.col("c") == 0) & (F.col("t") == 1)).alias("treatment_only"),
        F.count_if((F.col("c") == 0) & (F.col("t") == 0)).alias("neither"),
    )
    return cells.withColumn("delta", F.round((F.col("treatment_only") - F.col("control_only")) / F.col("n"), 9))


def chance_accuracy(items: DataFrame) -> DataFrame:
    """One row: expected accuracy of guessing; sums of counts, so equal in any order."""
    return items.groupBy(F.size("choices").alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.sum(F.col("n") / F.col("k")) / F.sum("n"), 9).alias("chance"))


# -- identity of a run -----------------------------------------------------------------------------


def range_digests(items: DataFrame) -> DataFrame:
    """(range, n, digest): an ordered fold of (id, item digest) over ranges of positions.

    Each range is folded by one task over at most _RANGE short digests, so no driver sees the items.
    """
    one = F.concat_ws("|", F.col("item_id"), item_digest(F.col("nq"), F.col("nc"), F.col("answer_index")))
    rows = with_normal(items).select("pos", F.floor(F.col("pos") / _RANGE).alias("range"), F.sha2(one, 256).alias("d"))
    folded = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("pos", "d"))).alias("all"))
    return folded.select("range", "n", F.sha2(F.array_join("all.d", ""), 256).alias("digest"))


def corpus_hash(items: DataFrame, name: str) -> str:
    """Identity of the corpus: its name and its items in order."""
    h = hashlib.sha256(name.encode())
    for r in range_digests(items).orderBy("range").toLocalIterator():
        h.update(f"|{r['n']}:{r['digest']}".encode())
    return f"sha256:{h.hexdigest()}"


def settings_hash(settings: Mapping[str, object]) -> str:
    return "sha256:" + hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()


def library_versions() -> dict[str, str]:
    return {"numpy": np.__version__, "pyspark": pyspark.__version__, "python": platform.python_version()}


# -- the audit -------------------------------------------------------------------------------------


def collected_patterns(patterns: DataFrame, masks: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct outcome vectors in a fixed order, and the number of items of each; refused where they would not fit the driver."""
    names = [f"m{m}" for m in range(masks)]
    if (found := patterns.count()) * masks > MAX_PATTERNS:
        raise ValueError(f"{found} distinct outcome vectors of {masks} coalitions are too many to resample: audit fewer players at once")
    rows = patterns.orderBy(*names).collect()  # bounded above
    return np.array([[r[m] for m in names] for r in rows]), np.array([r["n"] for r in rows])


def share_rows(patterns: np.ndarray, counts: np.ndarray, players: Sequence[Player], inert: set[str], rule: Rule, rng: np.random.Generator) -> list[dict]:
    """Rows of judgement.RAW, one per player, from distinct outcome vectors and their counts."""
    weights, n = rs.shapley_weights(len(players)).T, int(counts.sum())
    points = counts @ patterns / n @ weights
    replicates = rs.resampled_means(rng, patterns, counts, rule.draws) @ weights
    left_out = rs.left_out_means(patterns, counts) @ weights
    out = []
    for i, player in enumerate(players):
        point, drawn = float(points[i]), replicates[:, i]
        interval = rs.bca_interval(point, drawn, left_out[:, i], counts, rule.alpha)
        note = "it changed no outcome under any coalition" if name_of(player) in inert else ""
        out.append(raw_row("share", name_of(player), describe(player), point, interval, rs.bootstrap_p(point, drawn), n, "Shapley share, BCa bootstrap", float(drawn.std(ddof=1)), note))
    return out


def blind_row(items: DataFrame, scorer: Scorer, rule: Rule, rng: np.random.Generator) -> dict:
    """Accuracy without the question; p compares it with the shown items, paired."""
    cells = paired_cells(coalition_outcomes(blind_outcomes(items, scorer))).withColumn("p", st.mcnemar_p(F.col("control_only"), F.col("treatment_only"))).first()
    n, hits = cells["n"], cells["both"] + cells["treatment_only"]
    values, counts = np.array([0.0, 1.0]), np.array([n - hits, hits])
    replicates = rs.resampled_means(rng, values, counts, rule.draws)
    interval = rs.bca_interval(hits / n, replicates, rs.left_out_means(values, counts), counts, rule.alpha)
    return raw_row("blind", "blind", "accuracy without the question", hits / n, interval, cells["p"], n, "BCa bootstrap; paired exact p")


def run_audit(
    items: DataFrame, name: str, scorer: Scorer, seed: int = 0, rule: Rule = Rule(), players: Sequence[Player] = PLAYERS,
    detectors: Sequence[Detector] | None = None, blind: bool = True, corpus_layer: bool = True,
) -> Audit:
    """The whole audit of a corpus and a scorer."""
    spark, rng, names = items.sparkSession, np.random.default_rng(seed), [name_of(p) for p in players]
    items = materialise(items, "items")
    by_item = materialise(coalition_outcomes(presented(items, scorer, seed, players)), "outcomes")
    table = materialise(outcome_patterns(by_item, 1 << len(names)), "patterns")
    patterns, counts = collected_patterns(table, 1 << len(names))
    inert = {r["player"] for r in inert_flags(table, names).filter("inert").collect()}  # one row per player
    rows = share_rows(patterns, counts, players, inert, rule, rng) + ([blind_row(items, scorer, rule, rng)] if blind else [])
    shares = judged(raw_table(spark, rows), rule)
    corpus = run_detectors(items, seed, rule, detectors) if corpus_layer else Findings(())
    accuracy, chance = counts @ patterns / counts.sum(), chance_accuracy(items).first()["chance"]
    scores = score_summary(shares, float(accuracy[0]), float(accuracy[0] - accuracy[-1]), chance).first().asDict()
    settings = {"seed": seed, "blind": blind, "corpus_layer": corpus_layer, "players": names, **rule.settings()}
    run = {
        "corpus": name, "corpus_hash": corpus_hash(items, name), "items": int(counts.sum()), "scorer": scorer.scorer_id, "deterministic": scorer.deterministic,
        "settings": settings, "settings_hash": settings_hash(settings), "engine": quizlens.__version__, "libraries": library_versions(),
    }
    return Audit(run, scores, (*shares.collect(), *corpus.rows), corpus.not_run)
