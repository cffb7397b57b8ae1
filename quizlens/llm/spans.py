"""Long verbatim spans shared between records (problem 10).

Compact windows. Every position of a text gets the hash of the ``GRAM`` characters that begin
there. In the Cartesian tree over these hashes a node c with the subtree [l, r] stands for all
subsequences inside [l, r] that contain c: they all have the hash of c as their least
one. Subsequences of a fixed length only meet the nodes whose subtree is at least as long,
about two in ``length``; these are found by a vectorised sliding minimum, and the tree is
built over them alone (the boundaries of such a node's subtree are such nodes again).

Two texts with a common span of ``length`` characters have, for this span, the same least
hash, at the same distance x from the span's beginning. For verbatim spans one hash function is
enough, as equal spans agree under each. A span with x beyond the middle also agrees in
the characters from the node back to the middle's distance, any other in as many after it; so a
node is indexed by one or two *long* contents rather than by its few characters, each with its
interval of distances x. An equi-join on these, followed by an overlap of the intervals, has every
true pair, and little else. The pairs are then verified on the characters around the nodes.

Skew: equal surroundings in different texts are one class, compared once. Contents with many
classes are not paired at all: their spans are grouped by their characters instead, so
only pairs that are results are ever made.

Defined cases: null, empty and shorter texts share nothing; a span within one text only does
not count; positions and lengths are code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlens.session import materialise

GRAM = 16  # characters of a position's hash; a power of two
SEGMENT = 1 << 20  # longer texts are handled in overlapping segments of so many characters
BATCH = 1 << 20  # characters that are hashed at once
BROADCAST_KEYS = 500_000  # candidate records up to which the texts are filtered by a broadcast (at most 24 MB)
DENSE = 48  # classes of a content from which spans are grouped by content rather than paired
_POSITION_BITS = 22  # of a position within a hashed batch (at most BATCH + SEGMENT characters)
_EDGE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of the GRAM code points from each position, by doubling; the last GRAM - 1 are not made."""
    h = _mix(codes.astype(np.uint64) + np.uint64(0x51ED270B))
    width, factor = 1, 0x2545F4914F6CDD1D
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = (factor * factor + 0x632BE5A6) % (1 << 64)
        width *= 2
    return _mix(h)


def _sliding_least(h: np.ndarray, t: int) -> np.ndarray:
    """Least value of h[i : i + t] for each i, in a few passes whatever t is."""
    n = len(h)
    padded = np.full(-(-n // t) * t, _EDGE, dtype=np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, t)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - t + 1], ahead[t - 1 : n])


def _subtrees(order: list[int], ends: list[tuple[int, int]], at: list[int]) -> tuple[list[int], list[int]]:
    """Cartesian tree over the nodes of one text: first and last position of each node's subtree."""
    left, right, stack = [0] * len(at), [0] * len(at), []
    for i, value in enumerate(order):
        while stack and order[stack[-1]] > value:
            right[stack.pop()] = at[i] - 1
        left[i] = at[stack[-1]] + 1 if stack else ends[0]
        stack.append(i)
    for i in stack:
        right[i] = ends[1]
    return left, right


def compact_windows(codes: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Nodes of all texts of a batch: text number, position c, least and most distance of a span's
    beginning before c, and the hashes of all positions. ``codes`` holds the texts one after
    another, ``bounds`` their limits."""
    t = length - GRAM + 1
    empty = np.zeros(0, dtype=np.int64)
    if len(codes) < length:
        return empty, empty, empty, empty, empty.view(np.uint64)
    h = _gram_hashes(codes)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    least = _sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), t)
    node = (least & low).astype(np.int64)  # of the span that begins here
    starts, stops = bounds[:-1], bounds[1:]
    spans = np.maximum(stops - starts - length + 1, 0)  # spans of each text
    text = np.repeat(np.arange(len(starts)), spans)
    if not len(text):
        return empty, empty, empty, empty, h
    begin = np.arange(len(text)) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(starts, spans)
    node = node[begin]
    new = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (text[1:] != text[:-1])])
    c, of = node[new], text[new]
    lefts, rights = np.empty(len(c), dtype=np.int64), np.empty(len(c), dtype=np.int64)
    order, at = (h[c] & ~low).tolist(), c.tolist()
    cut = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)].tolist()
    for a, b in zip(cut, cut[1:]):
        i = of[a]
        lefts[a:b], rights[a:b] = _subtrees(order[a:b], (int(starts[i]), int(stops[i]) - GRAM), at[a:b])
    # spans of the given length within the subtree that contain the node
    most = c - np.maximum(lefts, c - t + 1)
    fewest = c - np.minimum(c, rights - t + 1)
    return of, c, fewest, most, h


def _content(h: np.ndarray, at: np.ndarray, width: int, tag: int) -> np.ndarray:
    """Hash of ``width`` characters from each position, of the hashes of its grams."""
    out = np.full(len(at), tag, dtype=np.uint64)
    for k in [*range(0, width - GRAM, GRAM), width - GRAM]:
        out = out * np.uint64(0x9FB21C651E98DF25) + h[at + k]
    return _mix(out)


def indexed_nodes(codes: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Index entries of a batch: text number, content, position of the node, interval of distances."""
    of, c, fewest, most, h = compact_windows(codes, bounds, length)
    half = (length - GRAM + 1) // 2
    back, ahead = most >= half, fewest < half  # spans with x >= half hold the half before c, others that after it
    width = half + GRAM
    content = np.r_[_content(h, c[back] - half, width, 1), _content(h, c[ahead], width, 2)]
    return (
        np.r_[of[back], of[ahead]],
        content,
        np.r_[c[back], c[ahead]],
        np.r_[np.maximum(fewest[back], half), fewest[ahead]],
        np.r_[most[back], np.minimum(most[ahead], half - 1)],
    )


def _segments(texts: list[str | None], length: int) -> Iterator[tuple[list[int], list[int], str, np.ndarray]]:
    """Batches of texts (long ones in overlapping segments): row numbers, offsets, characters, bounds."""
    rows, offsets, parts, size = [], [], [], 0
    for i, text in enumerate(texts):
        if text is None or len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, SEGMENT):
            part = text[at : at + SEGMENT + length - 1]
            rows.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
            if size >= BATCH:
                yield rows, offsets, "".join(parts), np.cumsum([0, *map(len, parts)])
                rows, offsets, parts, size = [], [], [], 0
    if parts:
        yield rows, offsets, "".join(parts), np.cumsum([0, *map(len, parts)])


def window_nodes(documents: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """(hash, key, at): the index entries of each text, one pass without a shuffle. ``at`` packs the
    node's position and its interval of distances (16 bits each)."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for rows, offsets, chars, bounds in _segments(texts, length):
                codes = np.frombuffer(chars.encode("utf-32-le"), dtype=np.uint32)
                of, content, c, fewest, most = indexed_nodes(codes, bounds, length)
                at = c - bounds[of] + np.array(offsets, dtype=np.int64)[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(content.view(np.int64)), keys.take(pa.array(np.array(rows, dtype=np.int64)[of])), pa.array((at << 32) | (fewest << 16) | most)],
                    names=["hash", key, "at"],
                )

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"hash bigint, `{key}` {kind}, at bigint")


def _candidates(documents: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """Nodes whose content two texts have: (hash, key, fewest, most, chars, begin), written.

    ``chars`` runs from the first span's beginning (``begin``) to the last span's end.
    """
    if length - GRAM >= 1 << 16 or length < 2 * GRAM:
        raise ValueError(f"the length must be between {2 * GRAM} and {1 << 16}")
    nodes = materialise(window_nodes(documents, key, text, length), "span-nodes")
    # partial aggregation leaves a row per map task and content, so a frequent one is no hot spot
    shared = nodes.groupBy("hash").agg(F.min(key).alias("_a"), F.max(key).alias("_b")).filter("_a <> _b").select("hash")
    near = nodes.join(shared, "hash", "left_semi")
    near = near.select("hash", key, F.shiftright("at", 32).cast("int").alias("at"), F.expr("cast((at >> 16) & 65535 as int)").alias("fewest"), F.expr("cast(at & 65535 as int)").alias("most"))
    near = materialise(near, "span-shared")
    texts = documents.select(F.col(key), F.col(text).alias("_text"))
    if (wanted := near.select(key).distinct()).count() <= BROADCAST_KEYS:
        texts = texts.join(F.broadcast(wanted), key, "left_semi")
    around = near.join(texts, key).select(
        "hash",
        key,
        "fewest",
        "most",
        F.expr(f"substring(_text, at - most + 1, most - fewest + {length})").alias("chars"),
        (F.col("at") - F.col("most")).alias("begin"),
    )
    return materialise(around, "span-contents")


def _common_extent(a: str, b: str, ia: int, ib: int) -> tuple[int, int]:
    """Characters that agree before and from the positions ia, ib."""
    n = min(ia, ib)
    x, y = a[ia - n : ia], b[ib - n : ib]
    before = n
    if x != y:
        low, high = 0, n  # the longest common suffix, by halving
        while low < high:
            middle = (low + high + 1) // 2
            if x[n - middle :] == y[n - middle :]:
                low = middle
            else:
                high = middle - 1
        before = low
    n = min(len(a) - ia, len(b) - ib)
    x, y = a[ia : ia + n], b[ib : ib + n]
    if x == y:
        return before, n
    low, high = 0, n
    while low < high:
        middle = (low + high + 1) // 2
        if x[:middle] == y[:middle]:
            low = middle
        else:
            high = middle - 1
    return before, low


def _verified(pairs: DataFrame, length: int) -> DataFrame:
    """(class_a, class_b, a_from, a_to, b_from, b_to): pairs of classes that share a span of ``length`` characters
    around their node, and the shared part of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            for i, (am, ac, bm, bc) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 6)))):
                before, after = _common_extent(ac, bc, am, bm)
                if before + after >= length:
                    keep.append(i)
                    found.append((am - before, am + after, bm - before, bm + after))
            take = pa.array(keep, type=pa.int64())
            ends = [pa.array([f[k] for f in found], type=pa.int32()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *ends], names=["class_a", "class_b", "a_from", "a_to", "b_from", "b_to"])

    return pairs.select("class_a", "class_b", "a_most", "a_chars", "b_most", "b_chars").mapInArrow(
        run, "class_a binary, class_b binary, a_from int, a_to int, b_from int, b_to int"
    )


def _classes(around: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Equal contents are one class: (class, hash, fewest, most, chars, low, high, alike) with the least and greatest key
    and the number of classes of the content's hash; and the members (class, key, begin)."""
    content = ["hash", "fewest", "most", "chars"]
    named = around.withColumn("class", F.unhex(F.md5(F.concat_ws(" ", *content))))
    classes = named.groupBy("class").agg(*(F.first(c).alias(c) for c in content), F.min(key).alias("low"), F.max(key).alias("high"))
    alike = classes.groupBy("hash").agg(F.count(F.lit(1)).alias("alike"))
    return materialise(classes.join(alike, "hash"), "span-classes"), named.select("class", key, "begin")


def _sparse_links(classes: DataFrame, length: int, dense: int) -> DataFrame:
    """Verified pairs of the classes of hashes that few classes have."""
    sparse = classes.filter(F.col("alike").between(2, dense))
    a = sparse.select("hash", F.col("class").alias("class_a"), *(F.col(c).alias(f"a_{c}") for c in ("fewest", "most", "chars")))
    b = sparse.select("hash", F.col("class").alias("class_b"), *(F.col(c).alias(f"b_{c}") for c in ("fewest", "most", "chars")))
    pairs = a.join(b, "hash").filter("class_a < class_b and a_fewest <= b_most and b_fewest <= a_most")
    return _verified(pairs, length)


def shared_span_pairs(documents: DataFrame, key: str, text: str, length: int = 160, dense: int = DENSE) -> DataFrame:
    """(doc_a, doc_b): pairs of records with a common verbatim span of ``length`` code points or more."""
    classes, members = _classes(_candidates(documents, key, text, length), key)
    members = materialise(members.select("class", key).distinct(), "span-members")

    linked = _sparse_links(classes, length, dense).select("class_a", "class_b").distinct()
    left = members.select(F.col("class").alias("class_a"), F.col(key).alias("_a"))
    right = members.select(F.col("class").alias("class_b"), F.col(key).alias("_b"))
    between = linked.join(left, "class_a").join(right, "class_b").select("_a", "_b")

    inside = members.join(classes.filter("low <> high").select("class"), "class", "left_semi")
    within = inside.select("class", F.col(key).alias("_a")).join(inside.select("class", F.col(key).alias("_b")), "class").filter("_a < _b").select("_a", "_b")

    # many classes of one hash: by the span's content, which only true pairs share
    crowded = classes.filter(F.col("alike") > dense).select("class", F.explode(_span_keys(length)).alias("span")).distinct()
    spans = crowded.join(members, "class").select("span", F.col(key).alias("_a")).distinct()
    dense_pairs = spans.join(spans.select("span", F.col("_a").alias("_b")), "span").filter("_a < _b").select("_a", "_b")

    found = between.unionByName(within).unionByName(dense_pairs)
    return found.select(F.least("_a", "_b").alias("doc_a"), F.greatest("_a", "_b").alias("doc_b")).filter("doc_a < doc_b").distinct()


def _span_keys(length: int):
    """Content keys of all spans of a class: 16 bytes of a digest of the characters themselves."""
    return F.expr(f"transform(sequence(0, most - fewest), i -> unhex(md5(substring(chars, i + 1, {length}))))")


def shared_coverage(documents: DataFrame, key: str, text: str, length: int = 160, dense: int = DENSE) -> DataFrame:
    """(key, n_chars, shared_chars, share): how much of each record lies in spans that another record has too.

    The shared parts of classes, from verified pairs and from groups of equal contents, are laid over
    the records that have them; what they cover together is counted. Pairs of records are never
    made. Records that are null or empty have share 0.
    """
    classes, members = _classes(_candidates(documents, key, text, length), key)
    other = classes.select(F.col("class").alias("_o"), "low", "high")
    links = materialise(_sparse_links(classes, length, dense), "span-links")
    ways = (("class_a", "a_from", "a_to", "class_b"), ("class_b", "b_from", "b_to", "class_a"))
    parts = [links.select(F.col(c).alias("class"), F.col(f).alias("from"), F.col(t).alias("to"), F.col(o).alias("_o")).join(other, "_o").drop("_o") for c, f, t, o in ways]
    parts.append(classes.filter("low <> high").select("class", F.lit(0).alias("from"), F.length("chars").alias("to"), "low", "high"))
    spread = classes.filter(F.col("alike") > dense).select("class", "low", "high", F.posexplode(_span_keys(length)).alias("from", "span"))
    spread = materialise(spread, "span-keys")
    common = spread.groupBy("span").agg(F.min("low").alias("_l"), F.max("high").alias("_h")).filter("_l <> _h")
    parts.append(spread.drop("low", "high").join(common, "span").select("class", "from", (F.col("from") + length).alias("to"), F.col("_l").alias("low"), F.col("_h").alias("high")))
    shared = reduce(DataFrame.unionByName, parts)
    # a class that only the record itself has is not shared elsewhere
    laid = members.join(shared, "class").filter(~((F.col("low") == F.col("high")) & (F.col("low") == F.col(key))))
    laid = laid.select(key, (F.col("begin") + F.col("from")).alias("from"), (F.col("begin") + F.col("to")).alias("to")).distinct()
    order = Window.partitionBy(key).orderBy("from", "to")
    reached = F.coalesce(F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = laid.withColumn("_new", F.greatest(F.lit(0), F.col("to") - F.greatest("from", reached))).groupBy(key).agg(F.sum("_new").alias("shared_chars"))
    return (
        documents.select(F.col(key), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars"))
        .join(covered, key, "left")
        .select(
            key,
            "n_chars",
            F.coalesce("shared_chars", F.lit(0)).cast("bigint").alias("shared_chars"),
            F.round(F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")).otherwise(0.0), 6).alias("share"),
        )
    )
