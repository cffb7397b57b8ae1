"""Controlled rewritings of items, as column expressions and row generators.

Every intervention keeps the number of options. Random draws depend on (seed, intervention, item)
alone, so an item is rewritten in the same way in every coalition and on every partitioning.

A coalition is a bit mask over the players. All masks are applied in one pass: the draws
are made once per item, each mask picks the rewritten or the plain columns, and the
permutation, which has one variant per option, is exploded last.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlens.functions.text import uniform, with_normal
from quizlens.session import materialise

# Fixed value: the order in which interventions compose.
ORDER = ("stronger_distractor", "neutral_reframing", "hide_question", "permute_options")
PLAYERS = ("stronger_distractor", "neutral_reframing", "permute_options")
DESCRIPTIONS = {
    "stronger_distractor": "a wrong option replaced by another item's correct answer",
    "neutral_reframing": "the question announced in neutral words, quotes set typographically",
    "hide_question": "the question withheld",
    "permute_options": "the options rotated so that the key stands at each position once",
}
PREFIX = "Here is an item from a question set. "
BLOCK = 16  # pool entries that are looked up under one key


@dataclass(frozen=True)
class Rewriting:
    """An intervention of one's own. ``variants(question, choices, answer_index, pos)`` gives an array of structs
    (question, choices, answer_index); the number of options must stay. ``after`` names the built-in one it follows."""

    name: str
    text: str
    variants: Callable[[Column, Column, Column, Column], Column]
    after: str = "hide_question"


Player = str | Rewriting


def name_of(player: Player) -> str:
    return player if isinstance(player, str) else player.name


def describe(player: Player) -> str:
    return DESCRIPTIONS[player] if isinstance(player, str) else player.text


def ordered(players: Sequence[Player]) -> list[Player]:
    """Interventions in composition order, each once; an unknown name is an error."""
    known = {name_of(p): p for p in players}
    place = {name: (i, "") for i, name in enumerate(ORDER)} | {n: (ORDER.index(p.after), n) for n, p in known.items() if isinstance(p, Rewriting) and p.after in ORDER}
    if unknown := [n for n in known if n not in place]:
        raise ValueError(f"unknown interventions: {', '.join(unknown)}")
    return sorted(known.values(), key=lambda p: place[name_of(p)])


def hidden(question: Column) -> Column:
    return F.lit("")


def reframed(question: Column) -> Column:
    """A blank question stays as it is."""
    text = F.coalesce(question, F.lit(""))
    return F.when(F.trim(text) == "", text).otherwise(F.concat(F.lit(PREFIX), F.translate(text, "\"'", "”’")))


def rotated(choices: Column, answer_index: Column, at: Column) -> Column:
    """The options turned so that the key stands at ``at``."""
    k = F.size(choices)
    return F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.element_at(choices, (F.pmod(j + answer_index - at, k) + 1).cast("int")))


def permute_options(items: DataFrame) -> DataFrame:
    """One variant per option, numbered by the key's position."""
    variants = items.withColumn("variant", F.explode(F.sequence(F.lit(0), F.size("choices") - 1)))
    return variants.withColumns({"choices": rotated(F.col("choices"), F.col("answer_index"), F.col("variant")), "answer_index": F.col("variant")})


def distractor_pool(items: DataFrame) -> DataFrame:
    """(pos, subject, answer) of every item."""
    return items.select("pos", F.coalesce("subject", F.lit("")).alias("subject"), F.element_at("choices", F.col("answer_index") + 1).alias("answer"))


def pool_without(pool: DataFrame, pos: int) -> DataFrame:
    return pool.filter(F.col("pos") != pos)


def numbered_pool(normal: DataFrame) -> DataFrame:
    """(subject, nanswer, answer, n, before): the distinct answers of each subject, in the order of their digests, with the
    number of entries that come before; ``n`` entries have this answer, ``answer`` is its least spelling. Written.

    Offsets come from the totals of 4,096 groups of digests a subject, so neither a large subject nor a
    frequent answer is sorted in one task.
    """
    pool = normal.select(F.coalesce("subject", F.lit("")).alias("subject"), F.get("choices", F.col("answer_index")).alias("answer"), F.get("nc", F.col("answer_index")).alias("nanswer"))
    groups = pool.groupBy("subject", "nanswer").agg(F.min("answer").alias("answer"), F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("_key", F.md5("nanswer")).withColumn("_lead", F.substring("_key", 1, 3))
    upto = Window.partitionBy("subject").orderBy("_lead")
    totals = groups.groupBy("subject", "_lead").agg(F.sum("n").alias("_t"))
    totals = totals.withColumn("_offset", F.sum("_t").over(upto) - F.col("_t")).drop("_t")
    within = F.sum("n").over(Window.partitionBy("subject", "_lead").orderBy("_key"))
    numbered = groups.withColumn("_within", within - F.col("n")).join(totals, ["subject", "_lead"])
    return materialise(numbered.select("subject", "nanswer", "answer", "n", (F.col("_within") + F.col("_offset")).alias("before")), "distractor-pool")


def drawn_distractors(normal: DataFrame, seed: int) -> DataFrame:
    """(pos, distractor, ndistractor): a random usable answer of another item of the same subject, and its
    normal form; items without one are left out.

    An answer is usable if it is none of the item's own options, in normal form. One draw is exact: its number among the
    usable entries becomes a number among all entries of the subject by stepping over the item's own options,
    whose places are looked up, and the entry of that number is looked up in turn. No item meets its subject's pool, and
    repeated answers weigh as often as they occur.
    """
    pool = numbered_pool(normal)
    sizes = pool.groupBy("subject").agg(F.sum("n").alias("_size"))
    base = normal.select("pos", F.coalesce("subject", F.lit("")).alias("subject"), "nc")
    options = base.select("pos", "subject", F.explode(F.array_distinct("nc")).alias("nanswer"))
    own = options.join(pool.select("subject", "nanswer", "n", "before"), ["subject", "nanswer"]).groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("before", "n"))).alias("_own"))  # an item's options
    rows = base.select("pos", "subject").join(sizes, "subject").join(own, "pos", "left")
    usable = F.col("_size") - F.aggregate("_own", F.lit(0).cast("long"), lambda t, x: t + x["n"])
    rows = rows.withColumn("_usable", F.coalesce(usable, F.col("_size"))).filter("_usable > 0")
    drawn = F.floor(uniform(seed, "stronger_distractor", F.col("pos"), 0) * F.col("_usable")).cast("long")
    stepped = F.aggregate("_own", F.col("_at"), lambda g, x: F.when(g >= x["before"], g + x["n"]).otherwise(g))
    rows = rows.withColumn("_at", drawn).withColumn("_at", F.coalesce(stepped, F.col("_at"))).select("pos", "subject", "_at", F.floor(F.col("_at") / BLOCK).alias("_block"))
    first, last = F.floor(F.col("before") / BLOCK), F.floor((F.col("before") + F.col("n") - 1) / BLOCK)
    placed = pool.select("subject", "nanswer", "answer", "n", "before", F.explode(F.sequence(first, last)).alias("_block"))
    found = rows.join(placed, ["subject", "_block"]).filter("_at >= before and _at < before + n")
    return found.select("pos", F.col("answer").alias("distractor"), F.col("nanswer").alias("ndistractor"))


def with_distractor(normal: DataFrame, seed: int) -> DataFrame:
    """Adds ``distracted`` and ``ndistracted``: the options, one wrong one replaced by the drawn distractor."""
    rows = normal.join(drawn_distractors(normal, seed), "pos", "left")
    wrong = F.floor(uniform(seed, "stronger_distractor", F.col("pos"), 99) * (F.size("choices") - 1)).cast("int")
    rows = rows.withColumn("_slot", F.when(F.col("distractor").isNotNull(), F.when(wrong >= F.col("answer_index"), wrong + 1).otherwise(wrong)))
    swapped = lambda column, new: F.transform(column, lambda c, i: F.when(i == F.col("_slot"), F.col(new)).otherwise(c))
    return rows.withColumns({"distracted": swapped("choices", "distractor"), "ndistracted": swapped("nc", "ndistractor")}).drop("distractor", "ndistractor", "_slot")


def stronger_distractor(items: DataFrame, seed: int) -> DataFrame:
    return with_distractor(with_normal(items), seed).withColumn("choices", F.col("distracted")).drop("distracted", "ndistracted", "nq", "nc")


def _rewritten(rows: DataFrame, player: Rewriting, shown: Column) -> DataFrame:
    """Rows with the variants of an intervention of one's own where ``shown`` holds."""
    now = F.struct("question", "choices", "answer_index")
    variants = player.variants(F.col("question"), F.col("choices"), F.col("answer_index"), F.col("pos"))
    rows = rows.withColumn("_v", F.explode(F.when(shown, variants).otherwise(F.array(now))))
    rows = rows.withColumns({"question": F.coalesce("_v.question", F.lit("")), "choices": F.col("_v.choices"), "answer_index": F.col("_v.answer_index").cast("int")})
    return with_normal(rows.drop("_v"))


def coalitions(items: DataFrame, seed: int, players: Sequence[Player] = PLAYERS, carry: Sequence[str] = ()) -> DataFrame:
    """Every item under every subset of the players: pos, mask, variant, question, choices, answer_index, the normal
    forms nq and nc, and those of the original item, nq0 and nc0, with its key a0.

    Bit i of the mask stands for player i; columns in ``carry`` are kept. Normal forms are made once per item and rewritten
    alongside: each built-in rewriting maps normal forms to normal forms; after one's own they are made anew.
    """
    names, steps = [name_of(p) for p in players], ordered(players)
    rows = with_normal(items.select("pos", F.coalesce("question", F.lit("")).alias("question"), "choices", "answer_index", "subject", *carry))
    if "stronger_distractor" in names:
        rows = with_distractor(rows, seed)
    rows = rows.withColumns({"nq0": F.col("nq"), "nc0": F.col("nc"), "a0": F.col("answer_index"), "variant": F.lit(-1)}).drop("subject")
    rows = rows.withColumn("mask", F.explode(F.array(*(F.lit(m) for m in range(1 << len(names))))))
    for player in steps:
        shown = F.col("mask").bitwiseAND(F.lit(1 << names.index(name_of(player)))) != 0
        if isinstance(player, Rewriting):
            rows = _rewritten(rows, player, shown)
            numbers = Window.partitionBy("pos", "mask").orderBy(F.xxhash64("question", "choices", "answer_index"), "variant")
            rows = rows.withColumn("variant", F.when(shown, F.row_number().over(numbers) - 1).otherwise(F.col("variant")))
        elif player == "stronger_distractor":
            swap = lambda plain, new: F.when(shown, F.col(new)).otherwise(F.col(plain))
            rows = rows.withColumns({"choices": swap("choices", "distracted"), "nc": swap("nc", "ndistracted")}).drop("distracted", "ndistracted")
        elif player == "permute_options":
            rows = rows.withColumn("_at", F.explode(F.when(shown, F.sequence(F.lit(0), F.size("choices") - 1)).otherwise(F.array(F.lit(-1)))))
            rows = rows.withColumn("_key", F.col("answer_index"))  # inside lambdas a name may stand for the column that replaces it
            turned = lambda c: F.when(shown, rotated(F.col(c), F.col("_key"), F.col("_at"))).otherwise(F.col(c))
            moved = {"choices": turned("choices"), "nc": turned("nc"), "answer_index": F.when(shown, F.col("_at")).otherwise(F.col("answer_index"))}
            number = F.when(shown, F.greatest(F.col("variant"), F.lit(0)) * F.size("choices") + F.col("_at")).otherwise(F.col("variant"))
            rows = rows.withColumns(moved | {"variant": number}).drop("_at", "_key")
        else:
            change = hidden if player == "hide_question" else reframed
            rows = rows.withColumns({c: F.when(shown, change(F.col(c))).otherwise(F.col(c)) for c in ("question", "nq")})
    return rows


def apply_coalition(items: DataFrame, players: Sequence[Player], seed: int) -> DataFrame:
    """Items under one set of interventions, in composition order; the empty set changes nothing."""
    for player in ordered(players):
        if isinstance(player, Rewriting):
            items = _rewritten(items, player, F.lit(True)).drop("nq", "nc")
        elif player == "stronger_distractor":
            items = stronger_distractor(items, seed)
        elif player == "permute_options":
            items = permute_options(items)
        else:
            items = items.withColumn("question", hidden(F.col("question")) if player == "hide_question" else reframed(F.col("question")))
    return items
