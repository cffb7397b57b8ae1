"""Scorers, the score cache as a distinct-and-join, and the tie rule.

A scorer sees a prompt table without a key column, so it cannot read the answer. Equal prompts are
scored once: the first presentation (by mask, position, variant) decides for all.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlens.functions.text import GAP, LETTERS, cloze_prompt, labelled_prompt, letter, parsed_reply, prompt_digest, tie_key, uniform
from quizlens.session import materialise


class Scorer(Protocol):
    """Turns prompts (prompt, pos, question, choices and, for simulations, the originals) into scores."""

    scorer_id: str
    deterministic: bool

    def score(self, prompts: DataFrame) -> DataFrame:
        """(prompt, scores): one list of scores per prompt, higher is likelier."""


# -- prediction ------------------------------------------------------------------------------------


def predicted(scores: Column, question: Column, choices: Column) -> Column:
    """The option with the highest score; ties go to the least digest of question and option
    (both in normal form), whatever the options' order."""
    top = F.array_max(scores)
    keyed = F.transform(choices, lambda c, i: F.when(F.get(scores, i) == top, F.struct(tie_key(question, c).alias("k"), i.alias("i"))))
    return F.array_min(F.filter(keyed, lambda x: x.isNotNull()))["i"]


def outcomes(variants: DataFrame, scorer: Scorer) -> DataFrame:
    """(pos, mask, variant, prompt, correct) of presented items, as ``coalitions`` gives them; correct is 0 or 1.

    One shuffle groups the prompts, one joins the winners back; only digests and numbers are
    shuffled besides one copy of each prompt.
    """
    rows = variants.withColumn("prompt", prompt_digest(scorer.scorer_id, F.col("nq"), F.col("nc")))
    if isinstance(scorer, SimulatedScorer):
        # the simulation is an expression of the row itself, so texts need not be shuffled to be scored
        rows = rows.select("pos", "mask", "variant", "answer_index", F.unhex(F.substring("prompt", 8, 64)).alias("prompt"), scorer.winner().alias("winner"))
        rows = materialise(rows, "choices-made")
        first = rows.groupBy("prompt").agg(F.min(F.struct("mask", "pos", "variant", "winner"))["winner"].alias("_first"))
        done = rows.drop("winner").join(first, "prompt")
        return done.select("pos", "mask", "variant", "prompt", (F.col("_first") == F.col("answer_index")).cast("int").alias("correct"))
    shown = F.struct("question", "choices", "nq", "nc")
    prompts = rows.groupBy("prompt").agg(F.min_by(shown, F.struct("mask", "pos", "variant")).alias("p")).select("prompt", "p.*")
    prompts = materialise(prompts, "prompts")
    scored = materialise(scorer.score(prompts.select("prompt", "question", "choices")), "scores")
    best = scored.join(prompts, "prompt").select("prompt", predicted(F.col("scores"), F.col("nq"), F.col("nc")).alias("_first"))
    done = rows.select("pos", "mask", "variant", "answer_index", "prompt").join(best, "prompt")
    return done.select("pos", "mask", "variant", "prompt", (F.col("_first") == F.col("answer_index")).cast("int").alias("correct"))


def cache_counters(presented: DataFrame) -> DataFrame:
    """One row: lookups, misses (distinct prompts) and hits."""
    return presented.agg(F.count(F.lit(1)).alias("lookups"), F.countDistinct("prompt").alias("misses")).withColumn("hits", F.col("lookups") - F.col("misses"))


# -- simulated scorer ------------------------------------------------------------------------------


def _wrong(options: Column, answer: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(options, lambda x: x != answer)))


# How a simulated model can come to the key, each with the condition under which it does, of the shown item (nq, nc) and
# the original (nq0, nc0, answer). The place in this table is the mechanism's uniform number.
MECHANISMS: dict[str, Callable[[Column], Column]] = {
    "skill": lambda answer: F.col("nq") != "",
    "memory": lambda answer: F.col("nq") == F.col("nq0"),
    "distractors": lambda answer: _wrong(F.col("nc"), answer) == _wrong(F.col("nc0"), answer),
    "options": lambda answer: F.lit(True),
}
PREFERENCE, GUESS = len(MECHANISMS), len(MECHANISMS) + 1  # the uniform numbers of the favoured position and of the guess


class SimulatedScorer:
    """A model with known mechanisms. It knows the original item, finds the key by its text, and never reads the answer index
    of the presented item.

    ``rates`` says how often each of MECHANISMS works, ``position`` how often the favoured position is taken where none does;
    what is left is guessed. One uniform number per item and mechanism decides, the same in every coalition, so each rate is
    the exact expectation of what an intervention that breaks the mechanism takes away.
    """

    deterministic = True

    def __init__(self, rates: Mapping[str, float], position: float = 0.0, favoured: int = 0, seed: int = 0) -> None:
        unknown = set(rates) - set(MECHANISMS)
        outside = [name for name, rate in (*rates.items(), ("position", position)) if not 0 <= rate <= 1]
        if unknown or outside or favoured < 0:
            raise ValueError(f"not a simulation: unknown {sorted(unknown)}, rates outside [0, 1] {outside}, favoured position {favoured}")
        self.rates, self.position, self.favoured, self.seed = {k: rates.get(k, 0.0) for k in MECHANISMS}, position, favoured, seed

    @property
    def scorer_id(self) -> str:
        at_work = {k: v for k, v in self.rates.items() if v} | ({f"position {self.favoured}": self.position} if self.position else {})
        return f"simulated({', '.join(f'{k} {v:g}' for k, v in at_work.items()) or 'guesses only'}; seed {self.seed})"

    def latents(self) -> Column:
        """An item's uniform numbers; made once per item, not per variant."""
        return F.array(*(uniform(self.seed, "simulated", F.col("pos"), slot) for slot in range(GUESS + 1)))

    def winner(self) -> Column:
        u = lambda slot: F.get("latents", slot)
        answer, k = F.element_at("nc0", F.col("a0") + 1), F.size("choices")
        at = F.array_position("nc", answer).cast("int") - 1
        knows = reduce(Column.__or__, ((u(slot) < self.rates[name]) & holds(answer) for slot, (name, holds) in enumerate(MECHANISMS.items())))
        guess = F.floor(u(GUESS) * k).cast("int")
        return F.when(at < 0, guess).when(knows, at).when(u(PREFERENCE) < self.position, F.least(F.lit(self.favoured), k - 1)).otherwise(guess)

    def score(self, presented: DataFrame) -> DataFrame:
        """(prompt, scores): 1 for the chosen option, 0 for the others."""
        one_hot = F.transform(F.sequence(F.lit(0), F.size("choices") - 1), lambda j: F.when(j == F.col("_w"), 1.0).otherwise(0.0))
        return presented.withColumn("latents", self.latents()).withColumn("_w", self.winner()).select("prompt", one_hot.alias("scores"))


# -- external scorers ------------------------------------------------------------------------------


class ApiScorer:
    """Asks a hosted model for a letter. ``client(prompt) -> reply`` must pickle; ``backends.hosted`` makes one.

    A reply without a usable label is an abstention: all scores are zero, and it is counted.
    """

    deterministic = False

    def __init__(self, model: str, client: Callable[[str], str]) -> None:
        self.model, self.client = model, client

    @property
    def scorer_id(self) -> str:
        return f"api[{self.model}]"

    def describe(self) -> dict[str, object]:
        return {"kind": "api", "model": self.model, "deterministic": False}

    def replies(self, prompts: DataFrame) -> DataFrame:
        """(prompt, n, reply, choice): one call per prompt, in Arrow batches on the workers."""
        client = self.client

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                yield part.assign(reply=[client(t) for t in part.pop("text")])[["prompt", "n", "reply"]]

        checked = F.when(F.size("choices") <= len(LETTERS), labelled_prompt(F.col("question"), F.col("choices"))).otherwise(
            F.raise_error(F.lit(f"more than {len(LETTERS)} options cannot be lettered")).cast("string")
        )
        shown = prompts.select("prompt", F.size("choices").alias("n"), checked.alias("text"))
        asked = shown.mapInPandas(ask, "prompt string, n int, reply string")
        return asked.withColumn("choice", parsed_reply(F.col("reply"), F.col("n")))

    def score(self, prompts: DataFrame) -> DataFrame:
        one_hot = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.when(j == F.col("choice"), 1.0).otherwise(0.0))
        return self.replies(prompts).select("prompt", one_hot.alias("scores"))


def abstentions(replies: DataFrame) -> DataFrame:
    return replies.agg(F.count_if(F.col("choice").isNull()).alias("abstentions"), F.count(F.lit(1)).alias("replies"))


# Memory below which a worker loads no model, and cores that a model leaves to others.
LEAST_FREE_MB = 1500
SPARE_CORES = 4


def free_memory_mb() -> float | None:
    """Memory the machine can still give, where it can be told."""
    try:
        with open("/proc/meminfo") as lines:
            return next(int(x.split()[1]) / 1024 for x in lines if x.startswith("MemAvailable"))
    except (OSError, StopIteration):
        return None


def default_threads() -> int:
    """Threads for a local model."""
    return max(1, (os.cpu_count() or 1) - SPARE_CORES)


class LocalScorer:
    """Log-likelihoods of a local causal model, loaded once per worker.

    ``load()`` returns an object with ``log_likelihoods(prompts, continuations) -> list[list[float]]`` and
    ``lengths(continuations)``; ``backends.causal`` makes one of a model folder. Style ``cloze`` scores each option
    as the continuation of a prompt that does not list them; ``labelled`` lists them and scores the letters.
    """

    deterministic = True

    def __init__(self, model: str, load: Callable[[], object], style: str = "cloze", normalise: bool = True, dtype: str = "float32", threads: int | None = None) -> None:
        if style not in ("cloze", "labelled"):
            raise ValueError("the style is cloze or labelled")
        self.model, self.load, self.style, self.normalise, self.dtype, self.threads = model, load, style, normalise, dtype, threads or default_threads()

    @property
    def scorer_id(self) -> str:
        return f"local[{self.model};{self.style};{self.dtype};{'mean' if self.normalise else 'sum'}]"

    def describe(self) -> dict[str, object]:
        return {"kind": "local", "model": self.model, "style": self.style, "dtype": self.dtype, "threads": self.threads, "normalised": self.normalise}

    def score(self, prompts: DataFrame) -> DataFrame:
        load, normalise, floor = self.load, self.normalise, LEAST_FREE_MB
        labelled = self.style == "labelled"
        if labelled:
            text = F.concat(labelled_prompt(F.col("question"), F.col("choices")), F.lit(GAP))
            continuations = F.transform("choices", lambda c, i: F.concat(F.lit(" "), letter(i)))
        else:
            text, continuations = cloze_prompt(F.col("question")), F.transform("choices", lambda c: F.concat(F.lit(" "), c))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            free = free_memory_mb()
            if free is not None and free < floor:
                raise MemoryError(f"{free:.0f} MB are free; a model is not loaded below {floor}")
            model = load()
            for part in batches:
                options = [list(x) for x in part["continuations"]]
                scores = model.log_likelihoods(list(part["text"]), options)
                if normalise:
                    scores = [[s / max(1, n) for s, n in zip(a, model.lengths(b))] for a, b in zip(scores, options)]
                yield pd.DataFrame({"prompt": part["prompt"], "scores": scores})

        return prompts.select("prompt", text.alias("text"), continuations.alias("continuations")).mapInPandas(run, "prompt string, scores array<double>")
