"""Near-duplicate records by token-combination prefixes (problem 7).

A record is the set of its runs of ``width`` successive tokens (shingles). Two records match
if their sets' Jaccard similarity reaches ``num/den``.

1. A sketch of bounded size counts all shingles of all records. Its counts never fall short of the
   true ones. Each task counts its own records and hands on the counters it used; these are added
   up as a stream in two rounds of at most FAN_IN parts, so no task holds more than one block of
   counters, whatever the number of tasks. Counters are wide while they are added and are kept as levels,
   exact up to 32 and logarithmic beyond, so they still tell frequent shingles from rare ones when
   every counter is shared by many shingles.
2. Records with equal sets are one class. Only its representative, the one with the least key, is indexed.
3. All shingles are put in one global order, rare ones first. A record can lack at most
   e = n - ceil(n * num / den) of its n shingles in a partner. Its prefix is *extended* until
   its capacity reaches e + links: a rare shingle counts 1; the frequent ones are divided into
   classes by their hash, and m of one class count m - 1. The index holds the rare shingles of
   the prefix singly and the *pairs* of frequent ones of one class. A partner lacks at most e
   shingles and each lowers the capacity by at most 1, so true pairs share at least ``links``
   entries. Unique shingles count but are not indexed; a record left with fewer entries has no partner.
   Records too small for that capacity, and those that can be their partners, also have *plain*
   entries, of which one is enough: the shingles of the first e + 1 that are not frequent,
   and pairs within two classes of the frequent ones among the first e + 3. If the first common
   shingle is frequent then so are the second and third, and two of three are in one class.
4. An entry that more than ``hot`` representatives have is not joined. Of a record's hot entries the
   pairs are indexed instead: a pair of records that shares three entries shares one that is
   not hot or two that are. Plain entries are combinations already and are joined in any case, by a
   join that splits its largest partitions.
5. Records that share enough entries are verified on their whole sets.

Sketch at scale: 2**sketch_bits counters over D shingles add about D / 2**sketch_bits to each count.
While that is below ``rare``, unique shingles are left out; beyond it more of the shingles count as
frequent and a record has up to twice the entries, but the order by frequency stays.

Sizes that are broadcast or reach the driver: the sketch, 2**sketch_bits bytes, and the keys of candidate
records up to BROADCAST_KEYS. Both are bounded; beyond the latter the same join shuffles.

Defined cases: null parts count as absent; a record with fewer tokens than ``width`` has no
shingle and no partner; rows with a null key are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlens.operators.components import connected_components
from quizlens.session import materialise, release

TOKENS = re.compile(r"[a-z0-9]+(?:[-'][a-z0-9]+)*").findall  # fixed value: the tokens of the task

BROADCAST_KEYS = 500_000  # candidate keys up to which the records are filtered by a broadcast (at most 24 MB)
FAN_IN = 1024  # parts of the sketch that one task adds up
_BLOCK_BITS = 11  # counters of a block of the sketch
_BLOCKS_AT_ONCE = 256
_EXACT_LEVEL = 32
_FLUSH = 1 << 22
_TOKEN_MEMO = 1 << 18
_HASH_BITS = 50  # of a shingle's hash; two of a pair of records are confused once in 10^11 pairs
_ROWS = 1 << (64 - _HASH_BITS)  # records that are sorted at once


@dataclass(frozen=True)
class Index:
    """Parameters of the index; results do not depend on them."""

    sketch_bits: int = 24  # counters of the sketch, one byte each once added up
    rare: int = 4  # a shingle counted at most so often is indexed singly
    single: int = 64  # the same for plain entries
    classes: int = 8  # classes of the frequent shingles; a power of two
    links: int = 3  # entries that a pair must share
    hot: int = 256  # representatives of an entry up to which they are joined by it


class _TokenIds(dict):
    """Token to a 64-bit number; bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) >= _TOKEN_MEMO:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
        self[token] = value
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def shingle_batch(texts: list[str | None], width: int, ids: dict) -> tuple[np.ndarray, np.ndarray]:
    """(row number, hash) of the distinct shingles of lower-cased texts, sorted by row, then hash."""
    if len(texts) > _ROWS:
        parts = [shingle_batch(texts[at : at + _ROWS], width, ids) for at in range(0, len(texts), _ROWS)]
        return np.concatenate([row + k * _ROWS for k, (row, _) in enumerate(parts)]), np.concatenate([h for _, h in parts])
    tokens: list[str] = []
    counts = []
    for text in texts:
        found = TOKENS(text) if text else []
        tokens += found
        counts.append(len(found))
    n = np.array(counts, dtype=np.int64)
    runs = np.maximum(n - width + 1, 0)
    if not runs.sum():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    numbers = np.fromiter(map(ids.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    h = np.zeros(len(numbers) - width + 1, dtype=np.uint64)
    for k in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + numbers[k : len(numbers) - width + 1 + k]
    h = _mix(h)
    row = np.repeat(np.arange(len(n)), runs)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(np.cumsum(n) - n, runs)
    # row and hash in one number, which sorts far faster than two
    both = np.sort((row.astype(np.uint64) << np.uint64(_HASH_BITS)) | (h[begin] >> np.uint64(64 - _HASH_BITS)))
    both = both[np.r_[True, both[1:] != both[:-1]]]
    return (both >> np.uint64(_HASH_BITS)).astype(np.int64), both << np.uint64(64 - _HASH_BITS)


def shingle_set_digests(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Row numbers that have shingles, and a 128-bit digest of each one's set."""
    if not len(row):
        return row, pa.array([], type=pa.binary())
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    rows = row[at]
    sums = [np.add.reduceat(_mix(h * np.uint64(k) + np.uint64(k >> 7)), at) for k in (0x9E6C63D0676A9A99, 0xE2C6F0B5D1A4F38B)]
    data = np.column_stack(sums).astype("<u8").tobytes()
    offsets = np.arange(0, 16 * len(rows) + 1, 16, dtype=np.int32)
    return rows, pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte each: exact up to 32, then eight steps for each doubling."""
    c = np.maximum(counts, 1).astype(np.float64)
    grown = _EXACT_LEVEL + np.floor(8 * np.log2(c / _EXACT_LEVEL))
    return np.where(counts <= _EXACT_LEVEL, counts, np.minimum(grown, 255)).astype(np.uint8)


def _packed_blocks(counts: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(block, places, counts) of the used counters of each block; a count beyond a byte takes several entries."""
    at = np.flatnonzero(counts)
    n = counts[at].astype(np.int64)
    times = (n + 254) // 255
    parts = np.full(int(times.sum()), 255, dtype=np.uint8)
    parts[np.cumsum(times) - 1] = n - 255 * (times - 1)
    at = np.repeat(at, times)
    size = 1 << _BLOCK_BITS
    bounds = np.searchsorted(at, np.arange(0, len(counts) + size, size)).tolist()
    at, parts = (at & (size - 1)).astype("<u2").tobytes(), parts.tobytes()
    for block, (i, j) in enumerate(zip(bounds, bounds[1:])):
        if i < j:
            yield block, at[2 * i : 2 * j], parts[i:j]


def _added(batches: Iterator[pa.RecordBatch], width: int, names: tuple[str, ...], pack) -> Iterator[pa.RecordBatch]:
    """Sums of parts that arrive in order of their ``width`` leading key columns, one sum in memory at a time."""
    total, last, rows = np.zeros(1 << _BLOCK_BITS), None, []  # doubles hold whole numbers exactly

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int32() if i < width else pa.binary()) for i, c in enumerate(zip(*rows))], names=list(names))

    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(width))))
        for key, at, n in zip(keys, batch.column(width), batch.column(width + 1)):
            if key != last:
                if last is not None:
                    rows.append((*last, *pack(total)))
                    if len(rows) >= _BLOCKS_AT_ONCE:
                        yield flushed()
                        rows.clear()
                total[:] = 0
                last = key
            total += np.bincount(np.frombuffer(at.as_buffer(), dtype="<u2"), np.frombuffer(n.as_buffer(), dtype=np.uint8), 1 << _BLOCK_BITS)
    if last is not None:
        rows.append((*last, *pack(total)))
        yield flushed()


def shingle_sketch(records: DataFrame, text: str, width: int, bits: int) -> np.ndarray:
    """Levels of the counts of all shingles of all records, 2**bits bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sketch, held, size = _TokenIds(), np.zeros(1 << bits, dtype=np.uint32), [], 0

        def flush() -> None:
            slot, n = np.unique(np.concatenate(held), return_counts=True)
            sketch[slot] += n.astype(np.uint32)

        for batch in batches:
            _, h = shingle_batch(batch.column(0).to_pylist(), width, ids)
            held.append(_slot(h, bits).astype(np.uint32))
            size += len(h)
            if size > _FLUSH:
                flush()
                held, size = [], 0
        if size:
            flush()
        team, packed = TaskContext.get().partitionId() // FAN_IN, _packed_blocks(sketch)
        while rows := list(islice(packed, _BLOCKS_AT_ONCE)):
            used, at, n = zip(*rows)
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip((used, [team] * len(used), at, n), kinds)], names=["block", "team", "at", "n"])

    def teams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _added(batches, 2, ("block", "team", "at", "n"), lambda total: next(_packed_blocks(total))[1:])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _added(batches, 1, ("block", "level"), lambda total: (levels(total).tobytes(),))

    parts = records.select(text).mapInArrow(count, "block int, team int, at binary, n binary")
    parts = parts.repartition("block", "team").sortWithinPartitions("block", "team").mapInArrow(teams, parts.schema)
    sums = parts.drop("team").repartition("block").sortWithinPartitions("block").mapInArrow(whole, "block int, level binary")
    sketch = np.zeros((1 << (bits - _BLOCK_BITS), 1 << _BLOCK_BITS), dtype=np.uint8)
    for r in sums.collect():  # 2**bits bytes in all
        sketch[r["block"]] = np.frombuffer(r["level"], dtype=np.uint8)
    return sketch.ravel()


def _rarest_first(row: np.ndarray, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Order by row, then count, then hash; ``h`` is in order within its row."""
    if len(row) and row[-1] >= _ROWS:
        return np.lexsort((h, counts, row))
    key = (row.astype(np.uint64) << np.uint64(_HASH_BITS)) | (counts.astype(np.uint64) << np.uint64(_HASH_BITS - 8)) | (h >> np.uint64(64 - _HASH_BITS + 8))
    order = np.argsort(key)
    key = key[order]
    if np.any(key[1:] == key[:-1]):  # hashes that only differ in their last bits
        return np.lexsort((h, counts, row))
    return order


def _class_pairs(at: np.ndarray, key: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (the first of each pair) and combined hashes of all pairs of equal key; ``key`` is in order."""
    step = 1
    while step < len(at):
        same = key[step:] == key[:-step]
        if not same.any():
            return
        a, b = at[:-step][same], at[step:][same]
        x, y = np.minimum(h[a], h[b]), np.maximum(h[a], h[b])
        yield a, _mix(x * np.uint64(0xA0761D6478BD642F) + y)
        step += 1


def prefix_entries(row: np.ndarray, h: np.ndarray, counts: np.ndarray, num: int, den: int, use: Index = Index()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index entries of records: row numbers, entries (sorted by row), and the records' sizes.

    ``row`` and ``h`` as of ``shingle_batch``, ``counts`` the level of each shingle's count. The last bit of an entry tells plain ones.
    """
    n = np.bincount(row) if len(row) else np.zeros(0, dtype=np.int64)
    if not len(row):
        return row, h, n
    order = _rarest_first(row, h, counts)
    row, h, counts = row[order], h[order], counts[order]
    start = np.cumsum(n) - n
    rank = np.arange(len(row)) - start[row]
    lack = n - -(-n * num // den)
    alone = n * (den - num) < num  # too few shingles for any partner but an equal set

    rare = counts <= use.rare
    bits = (h >> np.uint64(64 - _HASH_BITS)).astype(np.int64)
    group = bits & (use.classes - 1)
    # the first of each class counts nothing, every other one 1; the order within a row stays
    gain = np.ones(len(row), dtype=np.int64)
    common = np.flatnonzero(~rare)
    if len(common):
        _, first = np.unique(row[common] * use.classes + group[common], return_index=True)
        gain[common[first]] = 0
    total = np.cumsum(gain)
    before = total - gain
    inside = before - before[start[row]] < lack[row] + use.links
    out_row, out = [], []
    single = inside & rare & (counts > 1)
    out_row.append(row[single])
    out.append(h[single])
    c = np.flatnonzero(inside & ~rare)
    c = c[np.lexsort((c, group[c], row[c]))]
    for a, entry in _class_pairs(c, row[c] * use.classes + group[c], h):
        out_row.append(row[a])
        out.append(entry)
    entry_row, entry = np.concatenate(out_row), np.concatenate(out)
    enough = (np.bincount(entry_row, minlength=len(n)) >= use.links) & ~alone
    keep = enough[entry_row]
    entry_row, entry = [entry_row[keep]], [entry[keep] & ~np.uint64(1)]

    least = (use.classes + use.links - 1) * den // num  # up to so many shingles the capacity may not be reached
    small = ((n * num <= least * den) & ~alone)[row]
    tiny = (n * num <= 2 * den)[row]  # may share fewer than three shingles with a partner
    frequent = counts > use.single
    one = small & (rank <= lack[row]) & (counts > 1) & (~frequent | tiny)
    entry_row.append(row[one])
    entry.append(h[one] | np.uint64(1))
    c = np.flatnonzero(small & frequent & (rank <= lack[row] + 2))
    half = bits[c] & 1
    by = np.lexsort((c, half, row[c]))
    c, half = c[by], half[by]
    for a, pair in _class_pairs(c, row[c] * 2 + half, h):
        entry_row.append(row[a])
        entry.append(pair | np.uint64(1))
    entry_row, entry = np.concatenate(entry_row), np.concatenate(entry)
    by = np.argsort(entry_row, kind="stable")
    return entry_row[by], entry[by], n


def token_text(*columns: str | Column) -> Column:
    """The lower-cased text whose tokens, in order, are those of the columns one after another."""
    return F.lower(F.concat_ws(" ", *columns))


def _shared_entries(reps: DataFrame, num: int, den: int, use: Index) -> DataFrame:
    """(rep_a, rep_b): representatives that share enough entries. ``reps`` is a written table (rep, n, entries)."""
    posted = reps.select("rep", "n", F.explode("entries").alias("entry"))
    plain = F.col("entry").bitwiseAND(F.lit(1))
    hot = posted.filter(plain == 0).groupBy("entry").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > use.hot).select("entry")
    hot = materialise(hot, "near-hot")
    n_hot = hot.count()
    posted = posted.withColumn("some_hot", F.lit(False))
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
        of_hot = posted.join(hot, "entry", "left_semi").select("rep", "n", "entry")
        held = of_hot.groupBy("rep", "n").agg(F.array_sort(F.collect_set("entry")).alias("hot"))  # at most a record's entries
        held = materialise(held, "near-hot-records")
        posted = posted.drop("some_hot").join(hot, "entry", "left_anti").join(held.select("rep", F.lit(True).alias("some_hot")), "rep", "left")
        posted = posted.withColumn("some_hot", F.coalesce("some_hot", F.lit(False)))
    side = lambda rows, x: rows.select("entry", *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "n", "some_hot")))
    sizes = f"rep_a < rep_b and n_a * {den} >= n_b * {num} and n_b * {den} >= n_a * {num}"
    pairs = (
        side(posted, "a")
        .join(side(posted, "b"), "entry")
        .filter(sizes)
        .groupBy("rep_a", "rep_b")
        .agg(F.count(F.lit(1)).alias("links"), F.max(plain).alias("plain"), F.max(F.col("some_hot_a") & F.col("some_hot_b")).alias("both_hot"))
        # of a pair with one hot entry in common, the other entries are counted
        .filter(f"plain = 1 or links >= {use.links} or (both_hot and links >= {use.links - 1})")
        .select("rep_a", "rep_b")
    )
    if n_hot:
        two = held.select("rep", "n", F.explode(F.expr("flatten(transform(hot, (x, i) -> transform(slice(hot, i + 2, size(hot)), y -> xxhash64(x, y))))")).alias("entry"), F.lit(True).alias("some_hot"))
        pairs = pairs.union(side(two, "a").join(side(two, "b"), "entry").filter(sizes).select("rep_a", "rep_b")).distinct()
    return pairs


def similar_classes(records: DataFrame, key: str, text: Column, width: int, num: int, den: int, use: Index = Index()) -> tuple[DataFrame, DataFrame]:
    """(links, members): pairs (rep_a, rep_b) of similar representatives of different sets, and
    (rep, key) of every record whose set another record has too. ``rep`` is the least key of a set."""
    base = records.filter(F.col(key).isNotNull()).select(F.col(key), text.alias("_text"))
    kind = base.schema[key].dataType.simpleString()
    sketch = base.sparkSession.sparkContext.broadcast(shingle_sketch(base, "_text", width, use.sketch_bits).tobytes())

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts = _TokenIds(), np.frombuffer(sketch.value, dtype=np.uint8)
        for batch in batches:
            row, h = shingle_batch(batch.column(1).to_pylist(), width, ids)
            rows, copy = shingle_set_digests(row, h)
            if not len(rows):
                continue
            entry_row, entry, n = prefix_entries(row, h, counts[_slot(h, use.sketch_bits)], num, den, use)
            bounds = np.r_[np.searchsorted(entry_row, rows), len(entry)].astype(np.int32)
            entries = pa.ListArray.from_arrays(pa.array(bounds), pa.array(entry.view(np.int64)))
            yield pa.RecordBatch.from_arrays([copy, batch.column(0).take(pa.array(rows)), pa.array(n[rows].astype(np.int32)), entries], names=["copy", "rep", "n", "entries"])

    indexed = materialise(base.select(key, "_text").mapInArrow(index, f"copy binary, rep {kind}, n int, entries array<bigint>"), "near-index")
    # classes of equal sets; all but their representatives leave the index
    groups = indexed.groupBy("copy").agg(F.min("rep").alias("_r"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("copy", "_r")
    members = materialise(indexed.select("copy", "rep").join(groups, "copy").select(F.col("_r").alias("rep"), F.col("rep").alias(key)), "near-members")
    others = members.filter(F.col("rep") != F.col(key)).select(F.col(key).alias("rep"))
    if others.count() <= BROADCAST_KEYS:
        others = F.broadcast(others)
    reps = indexed.filter(F.size("entries") > 0).join(others, "rep", "left_anti").select("rep", "n", "entries")
    pairs = materialise(_shared_entries(reps, num, den, use), "near-candidates")
    release(indexed)

    wanted = pairs.select(F.col("rep_a").alias(key)).union(pairs.select("rep_b")).distinct()
    if pairs.count() <= BROADCAST_KEYS // 2:
        wanted = F.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _TokenIds()
        for batch in batches:
            row, h = shingle_batch(batch.column(1).to_pylist(), width, ids)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(h.view(np.int64)))], names=["_k", "_s"])

    whole = base.join(wanted, key, "left_semi").mapInArrow(sets, f"_k {kind}, _s array<bigint>")
    both = (
        pairs.join(whole.select(F.col("_k").alias("rep_a"), F.col("_s").alias("_x")), "rep_a")
        .join(whole.select(F.col("_k").alias("rep_b"), F.col("_s").alias("_y")), "rep_b")
        .withColumn("_both", F.size(F.array_intersect("_x", "_y")))
    )
    links = both.filter(f"_both * {den} >= (size(_x) + size(_y) - _both) * {num}").select("rep_a", "rep_b")
    return links, members


def near_duplicate_pairs(records: DataFrame, key: str, text: Column, width: int = 5, num: int = 4, den: int = 5, use: Index = Index()) -> DataFrame:
    """(pos_a, pos_b): all pairs of similar records, copies included."""
    links, members = similar_classes(records, key, text, width, num, den, use)
    within = members.select("rep", F.col(key).alias("_a")).join(members.select("rep", F.col(key).alias("_b")), "rep").filter("_a < _b").select("_a", "_b")
    side = lambda r, out: members.select(F.col("rep").alias(r), F.col(key).alias(out))
    between = (
        links.join(side("rep_a", "_a"), "rep_a", "left")
        .join(side("rep_b", "_b"), "rep_b", "left")
        .select(F.coalesce("_a", "rep_a").alias("_a"), F.coalesce("_b", "rep_b").alias("_b"))
    )
    return within.unionByName(between).select(F.least("_a", "_b").alias("pos_a"), F.greatest("_a", "_b").alias("pos_b"))


def near_duplicate_groups(records: DataFrame, key: str, text: Column, width: int = 5, num: int = 4, den: int = 5, use: Index = Index()) -> DataFrame:
    """(key, group_id, n_links): one row per record; the group is the least key of its component,
    n_links the number of similar representatives of other sets. Records with a null key are left out."""
    links, members = similar_classes(records, key, text, width, num, den, use)
    links = materialise(links, "near-links")
    component = connected_components(links, "rep_a", "rep_b")
    ends = links.select(F.col("rep_a").alias("node")).union(links.select("rep_b")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    rows = records.filter(F.col(key).isNotNull()).select(key).join(members, key, "left").withColumn("node", F.coalesce("rep", key))
    return (
        rows.join(component, "node", "left")
        .join(ends, "node", "left")
        .select(key, F.coalesce("component", "node").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    )
