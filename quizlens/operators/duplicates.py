"""Exact, contradictory and near-duplicate items of a corpus.

Groups are partial aggregations on digests, so a group of any size costs one row per task before
the shuffle. Near pairs come from an exact prefix join: ordered by rarity, two sets with
Jaccard similarity t must share one of their first n - ceil(t n) + 1 shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlens.functions.text import item_digest, item_tokens, shingles, stem_digest, with_normal
from quizlens.session import materialise

NEAR_NUM, NEAR_DEN = 9, 10  # near-duplicates agree in nine tenths of their shingles


def with_digests(items: DataFrame) -> DataFrame:
    """Items with their normal form and its digests: nq, nc, stem, digest."""
    return with_normal(items).withColumns({"stem": stem_digest(F.col("nq"), F.col("nc")), "digest": item_digest(F.col("nq"), F.col("nc"), F.col("answer_index"))})


def exact_groups(digested: DataFrame) -> DataFrame:
    """(digest, first_pos, n): items that are equal up to id and subject, two or more."""
    return digested.groupBy("digest").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def contradiction_groups(digested: DataFrame) -> DataFrame:
    """(stem, first_pos, n, answers): equal question and options whose keys differ in text (in normal form)."""
    answer = F.element_at("nc", F.col("answer_index") + 1)
    groups = digested.groupBy("stem").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"), F.min(answer).alias("_a"), F.max(answer).alias("_b"), F.collect_set(answer).alias("_s"))
    # the distinct keys of one stem are at most its options
    return groups.filter("n > 1 and _a <> _b").select("stem", "first_pos", "n", F.size("_s").cast("long").alias("answers"))


def redundant_copies(groups: DataFrame) -> DataFrame:
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"))


def deduplicated(digested: DataFrame) -> DataFrame:
    """The first item of each digest in corpus order; the choice is an aggregation, not a window."""
    first = digested.groupBy("digest").agg(F.min("pos").alias("pos"))
    return digested.join(first.select("pos"), "pos", "left_semi")


def shingle_sets(items: DataFrame) -> DataFrame:
    """(pos, shingles): distinct three-token runs of question and options; items without tokens left out."""
    return items.select("pos", shingles(item_tokens(F.col("question"), F.col("choices"))).alias("shingles")).filter(F.size("shingles") > 0)


def shingle_frequency(sets: DataFrame) -> DataFrame:
    """(shingle, df): in how many items a shingle occurs."""
    return sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))


def rarest_shingles(sets: DataFrame, k: int = 3) -> DataFrame:
    """(pos, shingle, df, rank): the k rarest shingles of each item, ties by text."""
    rows = sets.select("pos", F.explode("shingles").alias("shingle")).join(shingle_frequency(sets), "shingle")
    order = Window.partitionBy("pos").orderBy("df", "shingle")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def set_classes(sets: DataFrame) -> DataFrame:
    """(rep, pos): every item with the least item whose set equals its own."""
    coded = sets.select("pos", F.unhex(F.md5(F.array_join(F.array_sort("shingles"), "\u0001"))).alias("code"))
    first = coded.groupBy("code").agg(F.min("pos").alias("rep"))
    return coded.join(first, "code").select("rep", "pos")


def candidate_classes(sets: DataFrame, classes: DataFrame, rare: int = 3) -> DataFrame:
    """(rep_a, rep_b): representatives of different sets of which one has a shingle that is among the rarest of the other.

    Frequencies are those over all items. Items with equal sets have equal candidates, so none but representatives are
    joined; all their items are candidates of one another and of each other's.
    """
    reps = materialise(sets.join(classes.filter("rep = pos").select("pos"), "pos", "left_semi"), "representatives")
    rows = reps.select("pos", F.explode("shingles").alias("shingle")).join(shingle_frequency(sets), "shingle")
    rank = F.row_number().over(Window.partitionBy("pos").orderBy("df", "shingle"))
    probes = rows.withColumn("_rank", rank).filter(F.col("_rank") <= rare).select(F.col("pos").alias("_p"), "shingle")
    postings = reps.select(F.col("pos").alias("_q"), F.explode("shingles").alias("shingle"))
    pairs = probes.join(postings, "shingle").filter("_p <> _q")
    return pairs.select(F.least("_p", "_q").alias("rep_a"), F.greatest("_p", "_q").alias("rep_b")).distinct()


def ceiling_flags(pairs: DataFrame, classes: DataFrame, ceiling: int = 400) -> DataFrame:
    """(pos, candidates, over): how many candidates each item has, and whether more than ``ceiling``; items without any left out.

    Counted from the sizes of classes, without expanding them. The flag only reports; no candidate is dropped."""
    sizes = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    both = pairs.select(F.col("rep_a").alias("_c"), F.col("rep_b").alias("rep")).union(pairs.select(F.col("rep_b").alias("_c"), F.col("rep_a").alias("rep")))
    others = both.join(sizes, "rep").groupBy(F.col("_c").alias("rep")).agg(F.sum("size").alias("others"))
    counted = sizes.join(others, "rep", "left").select("rep", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("candidates")).filter("candidates > 0")
    return classes.join(counted, "rep").select("pos", "candidates", (F.col("candidates") > ceiling).alias("over"))


def _needed(n: Column, num: int, den: int) -> Column:
    return F.ceil(n * num / F.lit(den)).cast("int")


def near_pairs(sets: DataFrame, num: int = NEAR_NUM, den: int = NEAR_DEN) -> DataFrame:
    """(pos_a, pos_b, similarity) of all pairs with Jaccard similarity of at least num/den; exact.

    Equal sets are collapsed first, so many copies of one item are compared once and joined back.
    """
    links, members = _linked_classes(materialise(_sorted(sets), "shingle-sets"), num, den)
    across = (
        links.join(members.withColumnsRenamed({"rep": "ra", "pos": "_p"}), "ra")
        .join(members.withColumnsRenamed({"rep": "rb", "pos": "_q"}), "rb")
        .select("_p", "_q", "similarity")
    )
    within = members.withColumnRenamed("pos", "_p").join(members.withColumnRenamed("pos", "_q"), "rep").filter("_p < _q").select("_p", "_q", F.lit(1.0).alias("similarity"))
    return across.union(within).select(F.least("_p", "_q").alias("pos_a"), F.greatest("_p", "_q").alias("pos_b"), F.round("similarity", 9).alias("similarity"))


def _sorted(sets: DataFrame) -> DataFrame:
    """(pos, set, code): the sets as 64-bit hashes of their shingles, in order, and a digest by which equal ones are grouped.

    Numbers are half the shuffle of texts; two shingles of one pair of items meet in a hash once in 10^15 pairs.
    """
    ordered = sets.select("pos", F.array_sort(F.array_distinct(F.transform("shingles", lambda x: F.xxhash64(x)))).alias("set"))
    return ordered.withColumn("code", F.unhex(F.md5(F.array_join(F.col("set").cast("array<string>"), " "))))


def _linked_classes(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(ra, rb, similarity) of similar classes of equal sets, and (rep, pos) of all members."""
    first = sets.groupBy("code").agg(F.min("pos").alias("rep"))
    members = materialise(sets.select("code", "pos").join(first, "code").select("rep", "pos"), "set-members")
    classes = sets.join(members.filter("rep = pos").select("pos"), "pos", "left_semi").select(F.col("pos").alias("rep"), "set")
    rows = classes.select("rep", F.size("set").alias("n"), F.explode("set").alias("shingle")).join(shingle_frequency(classes.withColumnRenamed("set", "shingles")).filter("df > 1"), "shingle")
    # shingles of one item only cannot match, but they come first in the order and use up the prefix
    ordered = rows.groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("by_df"))  # the shingles of one item
    kept = F.greatest(F.lit(0), F.size("by_df") - _needed(F.col("n"), num, den) + 1)
    prefix = materialise(ordered.select("rep", "n", F.explode(F.slice("by_df", F.lit(1), kept)).alias("s")).select("s.shingle", "rep", "n"), "prefixes")
    a, b = (prefix.select("shingle", F.col("rep").alias(f"r{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    pairs = a.join(b, "shingle").filter(f"ra < rb and na * {den} >= nb * {num} and nb * {den} >= na * {num}").select("ra", "rb").distinct()
    both = pairs.join(classes.withColumnsRenamed({"rep": "ra", "set": "sa"}), "ra").join(classes.withColumnsRenamed({"rep": "rb", "set": "sb"}), "rb")
    both = both.withColumn("_i", F.size(F.array_intersect("sa", "sb"))).withColumn("_u", F.size("sa") + F.size("sb") - F.col("_i"))
    links = both.filter(f"_i * {den} >= _u * {num}").select("ra", "rb", (F.col("_i") / F.col("_u")).alias("similarity"))
    return materialise(links, "set-links"), members


def near_members(sets: DataFrame, num: int = NEAR_NUM, den: int = NEAR_DEN) -> DataFrame:
    """(pos): items that have a near-duplicate, without expanding groups of equal sets into pairs."""
    links, members = _linked_classes(materialise(_sorted(sets), "shingle-sets"), num, den)
    several = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rep")
    hit = several.union(links.select("ra")).union(links.select("rb")).distinct()
    return members.join(hit, "rep", "left_semi").select("pos")


def census_keys(items: DataFrame) -> DataFrame:
    """(pos, stem, digest, answer): all that exact and contradictory groups need of an item; written once, narrow."""
    keys = with_digests(items).select("pos", F.unhex(F.substring("stem", 8, 64)).alias("stem"), F.unhex(F.substring("digest", 8, 64)).alias("digest"), F.unhex(F.md5(F.get("nc", F.col("answer_index")))).alias("answer"))
    return materialise(keys, "census-keys")


def affected_items(items: DataFrame) -> DataFrame:
    """(pos, exact, contradictory, near): items of the census with the reasons that apply."""
    return _affected(items, census_keys(items))


def _affected(items: DataFrame, keys: DataFrame) -> DataFrame:
    # one pass by stem: an item equals another if its digest recurs, and contradicts one if its stem has two answers
    digests = keys.groupBy("stem", "digest", "answer").agg(F.count(F.lit(1)).alias("n"))
    stems = digests.groupBy("stem").agg((F.min("answer") != F.max("answer")).alias("contradictory"), F.max(F.col("n") > 1).alias("some")).filter("contradictory or some")
    hit = keys.join(stems.select("stem", "contradictory"), "stem").join(digests.select("stem", "digest", "answer", (F.col("n") > 1).alias("exact")), ["stem", "digest", "answer"])
    near = near_members(shingle_sets(items)).select("pos", F.lit(False).alias("exact"), F.lit(False).alias("contradictory"), F.lit(True).alias("near"))
    rows = hit.filter("exact or contradictory").select("pos", "exact", "contradictory", F.lit(False).alias("near")).union(near)
    return rows.groupBy("pos").agg(*(F.max(c).alias(c) for c in ("exact", "contradictory", "near")))


def census(items: DataFrame) -> DataFrame:
    """One row: items, affected items, redundant copies, contradictory items, near-only items."""
    keys = census_keys(items)
    copies = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    total = copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"))
    affected = _affected(items, keys).agg(
        F.count(F.lit(1)).alias("affected"), F.count_if("contradictory").alias("contradictory"), F.count_if(F.col("near") & ~F.col("exact")).alias("near_only")
    )
    return total.unionByName(affected, True).agg(*(F.max(c).alias(c) for c in ("items", "redundant", "affected", "contradictory", "near_only")))
