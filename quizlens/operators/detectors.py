"""Corpus defects: each detector reduces items to a few counts, and judges those on the driver.

Sufficient statistics are bounded by the number of options, of option-count and value pairs, or are single counts, so
collecting them is independent of the corpus' size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlens import resampling as rs
from quizlens.functions.statistics import wilson
from quizlens.functions.text import longest_count, longest_credit, tokens
from quizlens.judgement import Findings, Rule, judged, raw_row, raw_table
from quizlens.operators.duplicates import census, deduplicated, with_digests
from quizlens.session import materialise, release

# Folds and smoothing of the option probe, and the least items of each detector.
FOLDS, SMOOTHING = 5, 1.0
MIN_ITEMS = {"longest_answer": 20, "choices_only": 50, "near_duplicate": 10}
DRAWS = 5000  # simulated corpora of a randomisation test, and replicates of an interval
BROADCAST_WEIGHTS = 200_000


class Detector(Protocol):
    name: str
    assumes_independent_items: bool

    def run(self, items: DataFrame, rng: np.random.Generator, rule: Rule) -> dict | None:
        """A row of judgement.RAW, or None where the corpus is too small or unfit."""


# -- relational parts ------------------------------------------------------------------------------


def largest_uniform(items: DataFrame) -> DataFrame:
    """Items of the most frequent option count; of two equally frequent ones the larger."""
    modal = items.groupBy(F.size("choices").alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("k")).limit(1)
    return items.withColumn("k", F.size("choices")).join(F.broadcast(modal.select("k")), "k", "left_semi")


def position_histogram(items: DataFrame) -> DataFrame:
    """(position, n) of the largest uniform group; positions that are never the key count 0."""
    chosen = largest_uniform(items)
    places = chosen.agg(F.max("k").alias("k")).filter("k is not null").select(F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("position"))
    counted = chosen.groupBy(F.col("answer_index").alias("position")).agg(F.count(F.lit(1)).alias("n"))
    return places.join(counted, "position", "left").select("position", F.coalesce("n", F.lit(0)).alias("n"))


def position_statistics(histogram: DataFrame) -> DataFrame:
    """One row: n, k, total variation, chi-square statistic, the modal position and its share."""
    whole = Window.partitionBy(F.lit(0))  # one row per position
    rows = histogram.withColumns({"t": F.sum("n").over(whole), "k": F.count(F.lit(1)).over(whole)})
    expected = F.col("t") / F.col("k")
    return rows.agg(
        F.max("t").alias("n"),
        F.max("k").alias("k"),
        F.round(F.sum(F.abs(F.col("n") / F.col("t") - 1 / F.col("k"))) / 2, 9).alias("total_variation"),
        F.round(F.sum(F.pow(F.col("n") - expected, 2) / expected), 9).alias("chi_square"),
        F.max_by("position", F.struct("n", -F.col("position"))).alias("modal_position"),
        F.round(F.max("n") / F.max("t"), 9).alias("modal_share"),
    )


def longest_histogram(items: DataFrame) -> DataFrame:
    """(k, winners, hit, n): option count, number of longest options, whether the key is one, items."""
    credit = longest_credit(F.col("choices"), F.col("answer_index"))
    return items.groupBy(F.size("choices").alias("k"), longest_count(F.col("choices")).alias("winners"), (credit > 0).alias("hit")).agg(F.count(F.lit(1)).alias("n"))


def longest_statistics(items: DataFrame) -> DataFrame:
    """One row: n, heuristic accuracy, chance, mean excess and ties."""
    value = F.when(F.col("hit"), 1.0 / F.col("winners")).otherwise(0.0)
    return longest_histogram(items).agg(
        F.sum("n").alias("n"),
        F.round(F.sum(value * F.col("n")) / F.sum("n"), 9).alias("accuracy"),
        F.round(F.sum(F.col("n") / F.col("k")) / F.sum("n"), 9).alias("chance"),
        F.round(F.sum((value - 1.0 / F.col("k")) * F.col("n")) / F.sum("n"), 9).alias("excess"),
        F.coalesce(F.sum(F.when(F.col("winners") > 1, F.col("n"))), F.lit(0)).alias("ties"),
    )


def fold_of(item_id: Column, seed: int) -> Column:
    return (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit("fold"), item_id.cast("string")), 256), 1, 8), 16, 10).cast("long") % FOLDS).cast("int")


def option_rows(items: DataFrame, seed: int) -> DataFrame:
    """(pos, fold, k, option, is_key, words): one row per option with its tokens."""
    return items.select("pos", fold_of(F.col("pos"), seed).alias("fold"), F.size("choices").alias("k"), "answer_index", F.posexplode("choices").alias("option", "text")).select(
        "pos", "fold", "k", "option", (F.col("option") == F.col("answer_index")).cast("int").alias("is_key"), tokens(F.coalesce("text", F.lit(""))).alias("words")
    )


def token_counts(options: DataFrame) -> DataFrame:
    """(fold, token, key_n, other_n): occurrences in keys and in other options."""
    return (
        options.select("fold", "is_key", F.explode("words").alias("token"))
        .groupBy("fold", "token")
        .agg(F.sum("is_key").alias("key_n"), F.sum(1 - F.col("is_key")).alias("other_n"))
    )


def token_weights(counts: DataFrame) -> DataFrame:
    """(fold, token, weight): log-odds of a token for the key, from all *other* folds.

    Training counts are totals less the fold's own, so the corpus is counted once, not once per fold.
    """
    totals = counts.groupBy("token").agg(F.sum("key_n").alias("kt"), F.sum("other_n").alias("ot"))
    grid = totals.withColumn("fold", F.explode(F.array(*map(F.lit, range(FOLDS)))))
    train = grid.join(counts, ["fold", "token"], "left").select(
        "fold", "token", (F.col("kt") - F.coalesce("key_n", F.lit(0))).alias("p"), (F.col("ot") - F.coalesce("other_n", F.lit(0))).alias("q")
    ).filter("p + q > 0")
    sums = train.groupBy("fold").agg(F.sum("p").alias("ps"), F.sum("q").alias("qs"), F.count(F.lit(1)).alias("v"))
    weight = F.log((F.col("p") + SMOOTHING) / (F.col("ps") + SMOOTHING * F.col("v"))) - F.log((F.col("q") + SMOOTHING) / (F.col("qs") + SMOOTHING * F.col("v")))
    return train.join(F.broadcast(sums), "fold").select("fold", "token", weight.alias("weight"))  # one row per fold


def probe_credit(items: DataFrame, seed: int = 0) -> DataFrame:
    """(pos, k, credit): expected credit of picking the option with the highest score; ties share it.

    Scores are sums of decimals, hence equal in any order of rows.
    """
    options = materialise(option_rows(items, seed), "options")
    weights = token_weights(token_counts(options)).withColumn("w", F.col("weight").cast("decimal(20,12)")).select("fold", "token", "w")
    weights = materialise(weights, "token-weights")
    if weights.count() <= BROADCAST_WEIGHTS:
        weights = F.broadcast(weights)
    spread = options.select("pos", "fold", "k", "option", "is_key", F.explode_outer("words").alias("token")).join(weights, ["fold", "token"], "left")
    scored = spread.groupBy("pos", "k", "option").agg(F.max("is_key").alias("is_key"), F.coalesce(F.sum("w"), F.lit(0).cast("decimal(30,12)")).alias("score"))
    best = scored.groupBy("pos", "k").agg(F.max("score").alias("top"), F.collect_list(F.struct("score", "is_key")).alias("all"))  # an item's options
    winners = F.filter("all", lambda x: x["score"] == F.col("top"))
    hit = F.aggregate(winners, F.lit(0), lambda n, x: n + x["is_key"])
    return best.select("pos", "k", (hit / F.size(winners)).alias("credit"))


def probe_histogram(items: DataFrame, seed: int = 0) -> DataFrame:
    return probe_credit(items, seed).groupBy("k", F.round("credit", 9).alias("credit")).agg(F.count(F.lit(1)).alias("n"))


# -- detectors -------------------------------------------------------------------------------------


def _mean_row(part: str, what: str, note: str, values: np.ndarray, counts: np.ndarray, simulated: np.ndarray, rng: np.random.Generator, rule: Rule, method: str) -> dict:
    """A mean over items, its percentile interval, and its randomisation p."""
    point = float(counts @ values / counts.sum())
    interval = rs.percentiles(rs.resampled_means(rng, values, counts, DRAWS), rule.alpha)
    return raw_row("defect", part, what, point, interval, rs.randomisation_p(point, simulated), counts.sum(), method, note=note)


class PositionSkew:
    name, assumes_independent_items = "position_skew", True

    def run(self, items: DataFrame, rng: np.random.Generator, rule: Rule) -> dict | None:
        histogram = position_histogram(items)
        counts = np.array([r["n"] for r in histogram.orderBy("position").collect()])  # one row per position
        k, n = len(counts), int(counts.sum())
        if k < 2 or n < 2 * k:
            return None
        found = position_statistics(histogram).first()
        even = np.full(k, 1 / k)
        distance = lambda draws: 0.5 * np.abs(draws / n - even).sum(axis=1)
        bias = float(distance(rng.multinomial(n, even, DRAWS)).mean())
        interval = rs.percentiles(distance(rng.multinomial(n, counts / n, DRAWS)) - bias, rule.alpha)
        p = rs.chi_square_tail(found["chi_square"], k - 1)
        note = f"position {found['modal_position']} holds {found['modal_share']:.1%} of {n} keys; {1 / k:.1%} would be even"
        return raw_row("defect", self.name, "keys are spread unevenly over the positions", found["total_variation"] - bias, interval, p, n, "total variation less its null mean", note=note)


class LongestAnswer:
    name, assumes_independent_items = "longest_answer", True

    def run(self, items: DataFrame, rng: np.random.Generator, rule: Rule) -> dict | None:
        rows = longest_histogram(items).orderBy("k", "winners", "hit").collect()  # at most two rows per pair of sizes
        k, winners, hit, counts = (np.array(x) for x in zip(*rows)) if rows else (np.zeros(0),) * 4
        n = int(counts.sum())
        if n < MIN_ITEMS[self.name]:
            return None
        credit = np.where(hit, 1 / winners, 0.0)
        simulated = np.zeros(DRAWS)
        for size, many in sorted(set(zip(k.tolist(), winners.tolist()))):
            c = int(counts[(k == size) & (winners == many)].sum())
            simulated += rng.binomial(c, many / size, DRAWS) / many - c / size
        note = f"picking the longest option scores {float(counts @ credit) / n:.1%}; {int(counts[winners > 1].sum())} items have several longest options"
        return _mean_row(self.name, "the key is the longest option too often", note, credit - 1 / k, counts, simulated / n, rng, rule, "mean excess over chance")


class ChoicesOnly:
    name, assumes_independent_items = "choices_only", True

    def run(self, items: DataFrame, rng: np.random.Generator, rule: Rule) -> dict | None:
        if items.count() < MIN_ITEMS[self.name]:
            return None
        k, credit, counts = (np.array(x) for x in zip(*probe_histogram(items, int(rng.integers(1 << 31))).orderBy("k", "credit").collect()))
        n = int(counts.sum())
        simulated = np.zeros(DRAWS)
        for size in np.unique(k).tolist():
            c = int(counts[k == size].sum())
            simulated += rng.binomial(c, 1 / size, DRAWS) - c / size
        note = f"a token model that sees the options only scores {float(counts @ credit) / n:.1%}, in {FOLDS} folds"
        return _mean_row(self.name, "the options give the key away", note, credit - 1 / k, counts, simulated / n, rng, rule, "cross-validated excess over chance")


class NearDuplicate:
    name, assumes_independent_items = "near_duplicate", False

    def run(self, items: DataFrame, rng: np.random.Generator, rule: Rule) -> dict | None:
        low, high = wilson(F.col("affected"), F.col("items"), rule.alpha)
        found = census(items).withColumns({"low": low, "high": high}).first()
        n, affected = found["items"], found["affected"]
        if n < MIN_ITEMS[self.name]:
            return None
        note = f"{affected} of {n} items; {found['redundant']} redundant copies; {found['contradictory']} items in contradictory groups"
        return raw_row("defect", self.name, "items repeat or contradict one another", affected / n, (found["low"], found["high"]), 0.0 if affected else 1.0, n, "census", note=note)


def default_detectors() -> list[Detector]:
    return [PositionSkew(), LongestAnswer(), ChoicesOnly(), NearDuplicate()]


def detector_rng(seed: int, name: str) -> np.random.Generator:
    return np.random.default_rng([seed, int.from_bytes(hashlib.sha256(name.encode()).digest()[:4], "big")])


def run_detectors(items: DataFrame, seed: int, rule: Rule, detectors: Sequence[Detector] | None = None) -> Findings:
    """All detectors, corrected as one family. Repeats are withheld from those that assume independent items only."""
    items = materialise(items, "items")
    unique = materialise(deduplicated(with_digests(items)).select(*items.columns), "unique-items")
    withheld = items.count() - unique.count()
    raw, not_run = [], []
    for detector in default_detectors() if detectors is None else detectors:
        row = detector.run(unique if detector.assumes_independent_items else items, detector_rng(seed, detector.name), rule)
        if row is None:
            not_run.append(detector.name)
        else:
            raw.append(row)
    rows = tuple(judged(raw_table(items.sparkSession, raw), rule).collect())  # one row per detector
    release(items, unique)
    return Findings(rows, tuple(not_run), withheld)
