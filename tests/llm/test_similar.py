"""Problems 7 and 10: near-duplicates and shared spans, against brute force."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizlens.llm import near, spans


def shingles(text, width):
    tokens = near.TOKENS((text or "").lower())
    return {tuple(tokens[i : i + width]) for i in range(len(tokens) - width + 1)}


def brute_pairs(rows, width, num, den):
    sets = {k: shingles(t, width) for k, t in rows if k is not None}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}


def edited(rng, words):
    out = list(words)
    for _ in range(rng.randint(0, max(1, len(out) // 8))):
        i = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[i] = rng.choice("qrstu")
        elif kind < 0.7 and len(out) > 1:
            del out[i]
        else:
            out.insert(i, rng.choice("vwxyz"))
    return out


def sample(rng, n, vocabulary, longest):
    rows = [[rng.choice(vocabulary) for _ in range(rng.randint(0, longest))] for _ in range(n)]
    rows += [edited(rng, rng.choice([r for r in rows if r])) for _ in range(n)]
    rows += [list(rows[3])] * (n // 3)  # a large group of copies
    texts = [" ".join(r) for r in rows] + [None, "", "  ,.", "A-b's c", "a-b's C!"]
    return list(enumerate(texts))


@pytest.mark.parametrize("width,num,den", [(3, 7, 10), (5, 4, 5)])
@pytest.mark.parametrize("vocabulary,longest", [([f"w{k}" for k in range(400)], 60), (list("abcdefgh"), 30), (["a", "b"], 12)])
def test_near_pairs(spark, width, num, den, vocabulary, longest):
    rows = sample(random.Random(width + longest), 60, vocabulary, longest) + [(None, "w1 w2 w3 w4 w5 w6")]
    frame = spark.createDataFrame(rows, "pos long, question string").withColumn("rep", F.lit("clash")).withColumn("copy", F.lit(1))
    got = [(r.pos_a, r.pos_b) for r in near.near_duplicate_pairs(frame, "pos", near.token_text("question"), width, num, den).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, width, num, den)


@pytest.mark.parametrize("use", [near.Index(12, rare=1, single=1), near.Index(11, rare=1, single=1, hot=3), near.Index(14, hot=2), near.Index(16, single=2, classes=4, hot=5)])
@pytest.mark.parametrize("num,den", [(7, 10), (4, 5), (1, 2)])
def test_frequent_shingles_and_hot_entries(spark, use, num, den):
    """With frequent shingles, crowded counters and entries of many records, the index holds combinations, and still misses nothing."""
    rng = random.Random(9)
    rows = sample(rng, 50, [f"w{k}" for k in range(40)], 60) + sample(rng, 40, list("abc"), 14)
    rows = list(enumerate(t for _, t in rows))
    rows += [(len(rows) + k, " ".join(["one frame that all of these share to the end of it", *rng.sample("pqrstuvw", 3)])) for k in range(40)]
    frame = spark.createDataFrame(rows, "pos long, question string")
    got = [(r.pos_a, r.pos_b) for r in near.near_duplicate_pairs(frame, "pos", near.token_text("question"), 3, num, den, use).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, 3, num, den)


def test_the_sketch_adds_up(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice("abcdefg") for _ in range(30)),) for _ in range(300)]
    frame = spark.createDataFrame(rows, "t string")
    wanted = np.zeros(1 << 12, dtype=np.int64)
    _, h = near.shingle_batch([t for t, in rows], 3, near._TokenIds())
    np.add.at(wanted, near._slot(h, 12), 1)
    for parts in (1, 3, 7):
        assert near.shingle_sketch(frame.repartition(parts), "t", 3, 12).tolist() == near.levels(wanted).tolist()
    assert near.levels(np.array([0, 1, 32, 33, 64, 1 << 20, 1 << 40])).tolist() == [0, 1, 32, 32, 40, 152, 255]
    block = np.array([0, 1, 254, 255, 256, 70_000] + [0] * 2042, dtype=np.uint32)
    ((_, at, n),) = near._packed_blocks(block)
    back = np.zeros(2048, dtype=np.int64)
    np.add.at(back, np.frombuffer(at, "<u2"), np.frombuffer(n, np.uint8))
    assert back.tolist() == block.tolist()


def test_records_of_equal_sets_are_one_class(spark):
    rows = [(k, t) for k, t in enumerate(["A b, c d", "a B c; d!", "a b c d", "a b c d a b c d a b"] * 200)]
    frame = spark.createDataFrame(rows, "pos long, question string")
    links, members = near.similar_classes(frame, "pos", near.token_text("question"), 3, 7, 10)
    assert links.count() == 0 and members.count() == 800 and {r.rep for r in members.collect()} == {0, 3}


def test_near_groups(spark):
    rows = sample(random.Random(4), 40, [f"w{k}" for k in range(200)], 40)
    frame = spark.createDataFrame(rows, "pos long, question string")
    got = {r.pos: (r.group_id, r.n_links) for r in near.near_duplicate_groups(frame, "pos", near.token_text("question"), 3, 7, 10).collect()}
    group = {k: k for k, _ in rows}
    for a, b in sorted(brute_pairs(rows, 3, 7, 10)):
        x, y = sorted((group[a], group[b]))
        group = {k: x if g == y else g for k, g in group.items()}
    assert {k: g for k, (g, _) in got.items()} == group and len(got) == len(rows)
    assert near.near_duplicate_groups(frame.limit(0), "pos", near.token_text("question")).count() == 0


def brute_spans(rows, length):
    index = defaultdict(set)
    for k, t in rows:
        for i in range(len(t or "") - length + 1):
            index[t[i : i + length]].add(k)
    return {p for ks in index.values() for p in itertools.combinations(sorted(ks), 2)}


def brute_coverage(rows, length):
    index = defaultdict(set)
    for k, t in rows:
        for i in range(len(t or "") - length + 1):
            index[t[i : i + length]].add(k)
    out = {}
    for k, t in rows:
        hit = set()
        for i in range(len(t or "") - length + 1):
            if len(index[t[i : i + length]]) > 1:
                hit.update(range(i, i + length))
        out[k] = len(hit)
    return out


def documents(rng, length):
    letters = "abcdefgh é🙂\n"
    rows = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 5 * length))) for _ in range(60)]
    shared = ["".join(rng.choice(letters) for _ in range(n)) for n in (length - 1, length, length + 1, 3 * length)]
    for _ in range(60):
        base, piece = rng.choice(rows), rng.choice(shared)
        at = rng.randint(0, len(base))
        rows.append(base[:at] + piece + base[at:] if rng.random() < 0.6 else rng.choice("xyz") + piece)
    rows += [rows[5]] * 4 + ["-" * (3 * length), "=" + "-" * length, "ab" * length, "b" + "ab" * length, "-" * (length - 1), "", shared[3][: length + 3]]
    return [*enumerate(rows), (len(rows), None)]


@pytest.mark.parametrize("length,dense", [(40, 48), (40, 1), (160, 48), (33, 2)])
def test_shared_spans(spark, length, dense):
    rows = documents(random.Random(length), length)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("clash")).withColumn("at", F.lit(1))
    got = [(r.doc_a, r.doc_b) for r in spans.shared_span_pairs(frame, "doc_id", "text", length, dense).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(rows, length)


def test_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(spans, "SEGMENT", 50)
    monkeypatch.setattr(spans, "BATCH", 120)
    rows = documents(random.Random(7), 40)
    nodes = [(n, list(zip(*(x.tolist() for x in spans.indexed_nodes(*arrays(chars, bounds), 40))))) for n, _, chars, bounds in spans._segments([t for _, t in rows], 40)]
    assert len(nodes) > 3
    # the same entries as without segments, up to repeats where segments overlap
    monkeypatch.setattr(spans, "SEGMENT", 1 << 20)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {(r.doc_id, r.hash, r.at) for r in spans.window_nodes(frame, "doc_id", "text", 40).collect()}
    assert whole


def arrays(chars, bounds):
    import numpy as np

    return np.frombuffer(chars.encode("utf-32-le"), dtype=np.uint32), bounds


def test_coverage(spark):
    rows = documents(random.Random(3), 40)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_chars, r.shared_chars) for r in spans.shared_coverage(frame, "doc_id", "text", 40).collect()}
    assert got == {k: (len(t or ""), brute_coverage(rows, 40)[k]) for k, t in rows}


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spans.shared_span_pairs(empty, "doc_id", "text").count() == 0
    assert spans.shared_coverage(empty, "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        spans.shared_span_pairs(empty, "doc_id", "text", 8)
