"""Problems 5, 8 and 9: visual forms, encoding, container filling."""

import os
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs

from quizlens.llm import bpe, packing, visual

tiktoken = pytest.importorskip("tiktoken")
if not os.path.isdir(bpe.TOKENIZER_DIR):
    pytest.skip("no tokenizer files", allow_module_level=True)


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder()


@pytest.fixture(scope="module")
def reference(coder):
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=coder.ranks, special_tokens={})


PIECES = ["a", "b", " ", "  ", "\n", "\r\n", "\t", "'s", "'", "'re", "'ll", "1", "é", "中", "\x1c", "\x85", " ", " ", "​", "!", "the", "<|endoftext|>", "\U0001f642", "ab" * 9, "_", "́", "x=[i*", "----"]


@settings(max_examples=300, deadline=None)
@given(hs.lists(hs.sampled_from(PIECES), max_size=40), hs.integers(4, 40))
def test_ids_equal_the_library(coder, reference, parts, block):
    text = "".join(parts)
    want = reference.encode_ordinary(text)
    assert coder.encode(text) == want
    assert np.frombuffer(coder.packed(text, block=block), dtype="<i4").tolist() == want
    assert "".join(coder.decode(want)) == text


@settings(max_examples=200, deadline=None)
@given(hs.text(max_size=60))
def test_any_text(coder, reference, text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    # letters newer than a library's Unicode tables may be cut differently; all others agree
    if all(unicodedata.category(c) != "Cn" for c in text) and text.isprintable():
        assert "".join(coder.decode(coder.encode(text))) == text


@pytest.mark.parametrize("letters", ["ab", "a", "abcdefghijtion", "中文字"])
def test_long_runs_go_through_the_window(coder, reference, letters):
    rng = random.Random(4)
    text = "".join(rng.choice(letters) for _ in range(6000))
    assert coder.encode(text) == reference.encode_ordinary(text)


def test_the_transducer_holds_a_bounded_window(coder):
    run = bpe.RunTransducer(coder.ranks, coder.lookahead)
    rng = random.Random(5)
    out, data, most = [], b"", 0
    for _ in range(200):
        part = bytes(rng.choice(b"etaoin") for _ in range(rng.randint(1, 400)))
        data += part
        out += run.feed(part)
        most = max(most, len(run.held))
    out += run.finish()
    assert most <= coder.lookahead + 2 * bpe.WINDOW_BYTES
    assert out == [coder.ranks[t] for t in bpe.merge_bytes(data, coder.ranks)]


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(runs=hs.lists(hs.tuples(hs.sampled_from(["a", "\n", " ", "\t", "1", "é", "中", "'", "-", "'s", "\u3000", "\x1c"]), hs.integers(1, 40)), max_size=8), block=hs.integers(4, 24))
def test_long_pre_tokens_in_small_blocks(coder, reference, runs, block):
    text = "".join(c * n for c, n in runs)
    assert np.frombuffer(coder.packed(text, block=block), dtype="<i4").tolist() == reference.encode_ordinary(text)


@pytest.mark.parametrize("unit", ["a", "ab1", "-", " ", "中", "\n "])
def test_memory_does_not_grow_with_a_run(coder, unit):
    import tracemalloc

    peaks = []
    coder.encode("warm up " + unit * 10_000)  # the lookahead is computed and the memo holds what recurs
    for size in (1 << 14, 1 << 17):
        text = unit * (size // len(unit))
        tracemalloc.start()
        n = sum(len(p) for p in coder.packed_parts(text, block=1 << 11)) // 4
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert n > 0
    assert peaks[1] < 1.3 * peaks[0] + (1 << 16)


def test_decoding_holds_back_incomplete_characters(coder):
    ids = coder.encode("é🙂中")
    parts = list(coder.decode(ids))
    assert "".join(parts) == "é🙂中" and all("�" not in p for p in parts)


def test_columns(spark):
    frame = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "", "z"), (None, "<|endoftext|>", "w")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode_column(frame, "doc_id", "text").collect()}
    assert got[2] == [] and got[3] == [] and len(got[1]) == 2 and len(got[None]) > 1
    assert {r.doc_id: r.n_tokens for r in bpe.count_column(frame, "doc_id", "text").collect()} == {k: len(v) for k, v in got.items()}
    back = bpe.decode_column(bpe.encode_column(frame, "doc_id", "text"), "doc_id", "ids")
    assert {r.doc_id: r.text for r in back.collect()} == {1: "a b", 2: "", 3: "", None: "<|endoftext|>"}
    assert bpe.encode_column(frame.limit(0), "doc_id", "text").count() == 0


# -- containers ------------------------------------------------------------------------------------


def check_packing(spark, sizes, capacity):
    frame = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "doc_id long, n_tokens long")
    rows = packing.pack(frame, "doc_id", "n_tokens", capacity).collect()
    used, parts = {}, {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append((r.part, r.n_tokens))
        if r.container_id is None:
            assert r.n_tokens == 0
        else:
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
    for k, s in enumerate(sizes):
        got = sorted(parts[k])
        assert [p for p, _ in got] == list(range(max(1, -(-(s or 0) // capacity))))
        assert sum(n for _, n in got) == (s or 0) and all(n == capacity for _, n in got[:-1])
    assert all(v <= capacity for v in used.values()) and sorted(used) == list(range(len(used)))
    return len(used), sum(s or 0 for s in sizes)


def test_containers(spark):
    rng = random.Random(2)
    n, total = check_packing(spark, [rng.randint(0, 130) for _ in range(1500)] + [None, 500, 100, 1000], 100)
    assert n <= total / 100 * 1.03 + 1
    assert check_packing(spark, [60] * 50 + [40] * 50, 100)[0] == 50
    assert check_packing(spark, [50, 30, 20] * 20, 100)[0] == 20
    assert check_packing(spark, [7] * 1000, 100)[0] == -(-1000 // 14)
    assert check_packing(spark, [0, None, 0], 100) == (0, 0)


def test_containers_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, n_tokens long, container_id string")
    packed = packing.pack(empty, "doc_id", "n_tokens", 10)
    assert packed.count() == 0 and packing.packing_report(packed, 10).first().containers == 0


@settings(max_examples=200, deadline=None)
@given(hs.dictionaries(hs.integers(1, 30), hs.integers(0, 9), max_size=12), hs.integers(1, 30))
def test_plans_use_every_item_once(counts, capacity):
    plan = packing.plan_patterns(counts, capacity)
    used = {}
    for pattern, times in plan:
        assert times > 0 and sum(s * k for s, k in pattern.items()) <= capacity
        for s, k in pattern.items():
            used[s] = used.get(s, 0) + k * times
    assert used == {s: n for s, n in counts.items() if n and s <= capacity}


@settings(max_examples=300, deadline=None)
@given(hs.lists(hs.integers(0, 2), min_size=2, max_size=16), hs.integers(1, 40))
def test_exact_fill_finds_a_combination_if_there_is_one(available, gap):
    left = np.array([0, *available[1:]])
    found = packing.exact_fill(left.copy(), gap)
    bag = [s for s, n in enumerate(left) for _ in range(n)]
    exists = any(
        sum(c) == gap for r in (1, 2, 3) for c in __import__("itertools").combinations(bag, r)
    )
    assert bool(found) == exists
    if found:
        assert sum(found) == gap and all(found.count(s) <= left[s] for s in found)


# -- visual forms ----------------------------------------------------------------------------------

SAME = [
    ("abc", "ａｂｃ"), ("a b", "a b"), ("a b", "a　b"), ("a b", "a b"), ("a b", "a b"), ("ab", "a​b"), ("ab", "a­b"), ("ab", "﻿ab"),
    ("é", "é"), ("é", "e‍́"), ("ｅ́", "é"), ("pace", "расе"), ("fine", "ﬁne"), ("Ω", "Ω"), ("K", "K"), ("Å", "Å"),
    ("μ", "µ"), ("ё", "ë"), ("ó", "ό"), ("(1)", "（1）"), ("sin", "ѕіn"), ("A", "Α"), ("ç", "ç"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("2", "²"), ("m5", "m⁵"), ("1/2", "½"), ("s", "ſ"), ("a.", "a"), ("б", "6"), ("-", "–"), ("π", "n"), ("a b", "ab"), ("①", "1")]


SAME += [("v", "ν"), ("p", "ρ"), ("a", "α"), ("æ", "ӕ"), ("r", "г"), ("-", "\u2010"), ("'", "\u2019"), ("-", "\u2212"), ("i", "ı"), ("l", "ℓ"), ("a", "𝐚"), ("a", "𝖺"), ("І", "I"), ("ꓮ", "ꓮ\u200b")]
DIFFERENT += [("I", "l"), ("l", "1"), ("O", "0"), ("О", "0"), ("І", "l"), ("a", "ª"), ("x", "×"), ("m", "rn"), ("σ", "s"), ("`", "'"), ("α", "A"), ("ł", "l"), ("ø", "o")]


@pytest.fixture(scope="module")
def forms(spark):
    return visual.Forms(visual.look_alikes(spark))


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(forms, a, b):
    assert forms.visual(a) == forms.visual(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different_look(forms, a, b):
    assert forms.visual(a) != forms.visual(b)


def test_ascii_is_never_changed(forms):
    text = "".join(map(chr, range(33, 127)))
    assert forms.visual(text) == text and forms.visual(text + "é") == text + "é"
    assert len(forms.table.alike) > 3000


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=hs.text(max_size=20))
def test_forms_are_stable(forms, text):
    form = forms.visual(text)
    assert forms.visual(form) == form
    folded = forms.folded(text)
    assert forms.folded(folded) == folded or text.isascii() is False
    assert forms.folded(text) == forms.folded(form)


def test_many_equal_rows_and_one_variant(spark):
    """Equal rows are not compared with one another: their number is that of the results."""
    frame = spark.range(100_000).selectExpr("id AS rec_id", "'pa ce' AS question", "array('x', 'y') AS texts").union(spark.sql("SELECT 200000L, 'pа ce', array('x', 'y')"))
    got = visual.look_alike_pairs(frame, "rec_id", "question", "texts")
    assert got.count() == 100_000 and got.filter("rec_b = 200000").count() == 100_000


def test_look_alike_pairs(spark):
    rows = [
        (1, "a b", ["x", "y"]), (2, "a b", ["x", "y"]), (3, "a b", ["x", "y"]), (4, "a b", ["y", "x"]), (5, "A b", ["x", "y"]), (6, None, None), (7, None, None),
        (8, "", None), (9, "q", [None, "x"]), (10, "q", [None, "х"]), (11, "q", ["", "x"]), (None, "a b", ["x", "у"]),
    ]
    frame = spark.createDataFrame(rows, "rec_id long, question string, texts array<string>")
    got = {(r.rec_a, r.rec_b) for r in visual.look_alike_pairs(frame, "rec_id", "question", "texts").collect()}
    assert got == {(1, 2), (2, 3), (9, 10)}
    forms = {r.rec_id: (r.question, r.choices) for r in visual.text_forms(frame, "rec_id", "question", "texts").collect()}
    assert forms[2] == forms[1] and forms[6] == (None, None) and forms[10][1] == [None, "x"]
    assert visual.text_forms(frame, "rec_id", "question", "texts", fold=True).filter("rec_id = 5").first().question == "a b"
    assert visual.look_alike_pairs(frame.limit(0), "rec_id", "question", "texts").count() == 0
