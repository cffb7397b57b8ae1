"""Byte-level BPE as a bounded-lookahead streaming transducer (problem 8).

The merge list is compiled once per worker. From it follows a *sufficient
lookahead* D: whether two neighbouring tokens are ever merged across a byte
boundary p depends on no byte beyond p + D. A long run of bytes is therefore
encoded through a window of bounded size: every token that ends at least D bytes
before the end of the window is final, is emitted, and leaves the window. Memory is
constant in the length of the run.

Texts are first cut into the tokenizer's pre-tokens, in blocks; the pre-token that
touches the end of a block is carried over, because it may still grow. One that fills a
block is a run of one class of characters: it is fed to the transducer block by block, as
far as it is certain to belong to it, and never held as a whole. Pre-tokens
recur, so the ids of short ones are memoised in a table of bounded size.

Decoding is the reverse state machine: bytes of ids are fed to an incremental UTF-8
decoder that holds back incomplete sequences.

Defined cases: a null and an empty text have the empty list of ids; strings that
look like special tokens are ordinary text; lone surrogates cannot occur in
parquet strings.
"""

from __future__ import annotations

import base64
import codecs
import heapq
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The default folder of the public tokenizer files and the name used by the queries.
TOKENIZER_DIR = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k"

# White space of the Unicode standard, which the published pattern's \s stands for.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

MEMO_ENTRIES = 1 << 17  # bound of the pre-token memo of a worker
MEMO_BYTES = 64  # longer pre-tokens are not memoised
BLOCK_CHARS = 1 << 16  # a text is cut into pre-tokens block by block
WINDOW_BYTES = 4096  # bytes a run may hold beyond the lookahead before tokens are emitted


def _pattern(letters: str, digits: str, space: str) -> str:
    return (
        rf"{_CONTRACTIONS}| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+"
        rf"|[{space}]+(?![^{space}])|[{space}]+"
    )


def _runs(letters: str, digits: str, space: str) -> tuple:
    """What a long pre-token can go on with: white space, letters, digits, or anything else."""
    return tuple(regex.compile(f"[{inside}]*+").match for inside in (space, letters, digits, f"^{space}{letters}{digits}"))


_UNICODE_RUNS = _runs(r"\p{L}", r"\p{N}", _SPACE)
_UNICODE_PIECES = regex.compile(_pattern(r"\p{L}", r"\p{N}", _SPACE)).findall
_ASCII_PIECES = re.compile(_pattern("A-Za-z", "0-9", r"\t-\r ")).findall


def load_ranks(name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> dict[bytes, int]:
    """Token bytes to id; the id of a merged token is also the rank of its merge."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_bytes(data: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Tokens of one run of bytes: the lowest-ranked pair is merged first, the leftmost on ties.

    ``below`` leaves out merges of that rank and above. A heap over a linked list keeps
    the cost at n log n.
    """
    n = len(data)
    limit = len(ranks) + 1 if below is None else below
    if n < 2:
        return [data] if n else []
    end = list(range(1, n + 1))  # end of the token that begins at i
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(data[i : i + 2])
        if rank is not None and rank < limit:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        rank, i, stop = heapq.heappop(heap)
        middle = end[i]
        if gone[i] or middle >= n or end[middle] != stop:
            continue
        gone[middle] = 1
        end[i] = stop
        if stop < n:
            before[stop] = i
            new = ranks.get(data[i : end[stop]])
            if new is not None and new < limit:
                heapq.heappush(heap, (new, i, end[stop]))
        left = before[i]
        if left >= 0:
            new = ranks.get(data[left:stop])
            if new is not None and new < limit:
                heapq.heappush(heap, (new, left, stop))
    out, i = [], 0
    while i < n:
        out.append(data[i : end[i]])
        i = end[i]
    return out


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes beyond a boundary on which merges across it can depend.

    A merge r = (a, b) at boundary p can only be prevented from the right by an earlier
    merge r' that takes a suffix of b together with what follows b. So its reach is
    len(b) plus the largest reach of an earlier merge whose left side is a suffix of b; in
    rank order that is one pass over the merge list.
    """
    reach_of_left: dict[bytes, int] = {}
    most = 0
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = merge_bytes(token, ranks, below=rank)
        if len(parts) != 2:
            continue
        left, right = parts
        reach = len(right) + max((reach_of_left.get(right[k:], 0) for k in range(len(right))), default=0)
        if reach > reach_of_left.get(left, 0):
            reach_of_left[left] = reach
        most = max(most, reach)
    return most


class RunTransducer:
    """Tokens of a run of bytes that arrives in parts; holds a bounded window."""

    def __init__(self, ranks: dict[bytes, int], lookahead: int, window: int = WINDOW_BYTES) -> None:
        self.ranks, self.lookahead, self.window, self.held = ranks, lookahead, window, b""

    def feed(self, data: bytes) -> Iterator[int]:
        step = self.window
        for at in range(0, len(data), step):
            self.held += data[at : at + step]
            if len(self.held) >= self.window + self.lookahead:
                yield from self._emit(len(self.held) - self.lookahead)

    def finish(self) -> Iterator[int]:
        yield from self._emit(len(self.held))

    def _emit(self, stable: int) -> Iterator[int]:
        done = 0
        for token in merge_bytes(self.held, self.ranks):
            if done + len(token) > stable:
                break
            done += len(token)
            yield self.ranks[token]
        self.held = self.held[done:]


class _Memo(dict):
    """Pre-token to its ids, packed as little-endian int32; emptied when full."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        packed = self.encode(piece)
        if len(piece) <= MEMO_BYTES:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = packed
        return packed


class Encoder:
    """Encoder and decoder of one tokenizer; one per Python worker."""

    def __init__(self, name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> None:
        self.ranks = load_ranks(name, folder)
        self._lookahead: int | None = None
        self._memo = _Memo(self._encode_piece)
        self._tokens: dict[int, bytes] | None = None

    @property
    def lookahead(self) -> int:
        if self._lookahead is None:  # needed for long runs only
            self._lookahead = sufficient_lookahead(self.ranks)
        return self._lookahead

    def _encode_piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        rank = self.ranks.get(data)
        if rank is not None:
            return rank.to_bytes(4, "little")
        if len(data) <= WINDOW_BYTES:
            ids = [self.ranks[t] for t in merge_bytes(data, self.ranks)]
        else:
            run = RunTransducer(self.ranks, self.lookahead)
            ids = [*run.feed(data), *run.finish()]
        return np.array(ids, dtype="<i4").tobytes()

    def packed_parts(self, text: str, block: int = BLOCK_CHARS) -> Iterator[bytes]:
        """Ids of a text as little-endian int32, in parts; beside the text a bounded amount is held."""
        find, get = (_ASCII_PIECES if text.isascii() else _UNICODE_PIECES), self._memo.__getitem__
        block = max(block, 4)
        start = end = 0
        while start < len(text):
            end = min(len(text), max(end, start) + block)
            pieces, kept = find(text[start:end]), 0
            single = len(pieces) == 1
            if end < len(text):
                # a pre-token is settled once three characters follow it: contractions and the
                # look at the next character after white space reach no further
                while pieces and kept < 3:
                    kept += len(pieces.pop())
            if pieces or end == len(text):
                yield b"".join(map(get, pieces))
                start = end = end - kept
            elif single:
                start = end = yield from self._long_run(text, start, block)

    def _long_run(self, text: str, start: int, block: int) -> Iterator[bytes]:
        """Ids of the pre-token of one class of characters that begins at ``start``; returns where it ends."""
        at = start + 1 if text[start] == " " and _UNICODE_RUNS[0](text, start + 1, start + 2).end() == start + 1 else start
        first = next(find for find in _UNICODE_RUNS if find(text, at, at + 1).end() > at)
        spaces = first is _UNICODE_RUNS[0]
        run, done, at = RunTransducer(self.ranks, self.lookahead), start, at
        while True:
            stop = first(text, at, min(len(text), at + block)).end()
            over = stop == len(text) or stop < at + block
            # before anything else the last of several spaces is left to what follows
            last = stop - 1 if spaces and stop < len(text) and stop - start > 1 else stop
            if last > done:
                yield np.fromiter(run.feed(text[done:last].encode("utf-8")), dtype="<i4").tobytes()
                done = last
            at = stop
            if over:
                yield np.fromiter(run.finish(), dtype="<i4").tobytes()
                return done

    def packed(self, text: str, block: int = BLOCK_CHARS) -> bytes:
        """Ids of a text as little-endian int32."""
        if len(text) <= block:
            return b"".join(map(self._memo.__getitem__, (_ASCII_PIECES if text.isascii() else _UNICODE_PIECES)(text)))
        return b"".join(self.packed_parts(text, block))

    def count(self, text: str) -> int:
        """Number of ids of a text."""
        return sum(map(len, self.packed_parts(text))) // 4

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<i4").tolist() if text else []

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of a stream of ids, in parts; incomplete UTF-8 is held back until complete."""
        if self._tokens is None:
            self._tokens = {rank: token for token, rank in self.ranks.items()}
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if part := state.decode(self._tokens[i]):
                yield part
        if part := state.decode(b"", final=True):
            yield part


@lru_cache(maxsize=2)
def encoder(name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> Encoder:
    """The worker's encoder; kept between tasks of a reused worker."""
    return Encoder(name, folder)


def _packed_column(column: pa.Array, coder: Encoder) -> list[bytes]:
    packed = coder.packed
    return [packed(t) if t else b"" for t in column.to_pylist()]


def encode_column(df: DataFrame, key: str, text: str, out: str = "ids", name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids): one row per input row; no shuffle, one Arrow pass.

    Null and empty texts give an empty list. Other columns of ``df`` are not read, so their
    names cannot clash. A null key is kept as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(name, folder)
        for batch in batches:
            packed = _packed_column(batch.column(1), coder)
            offsets = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            ids = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"), type=pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(offsets), ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, `{out}` array<int>")


def count_column(df: DataFrame, key: str, text: str, out: str = "n_tokens", name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, number of tokens): as ``encode_column``, without building the lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(name, folder)
        for batch in batches:
            counts = [coder.count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, type=pa.int64())], names=[key, out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, `{out}` bigint")


def decode_column(df: DataFrame, key: str, ids: str, out: str = "text", name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, text): the inverse of ``encode_column``; an empty or null list gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(name, folder)
        for batch in batches:
            texts = ["".join(coder.decode(x or ())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=[key, out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, `{out}` string")
