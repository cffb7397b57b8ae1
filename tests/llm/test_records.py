"""Problems 1, 2, 3 and 6, and every query with SQL against it."""

import json
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import same_rows
from quizlens.llm import distinct, formatting, nested, queries, quota


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_its_sql(spark, data, duck, name):
    frame = queries.queries()[name](spark, data)
    if name in queries.oracle_sql():
        same_rows(frame, duck, queries.oracle_sql()[name])
    else:
        assert frame.count() == frame.distinct().count()


# -- formatting ------------------------------------------------------------------------------------


def code(record):
    runs = lambda t: tuple(x.lower() for x in re.findall(r"[^\W_]+", t or ""))
    return runs(record.get("question")), tuple(runs(c) for c in record.get("choices") or []), record.get("answer_index")


def test_formatting_groups(spark):
    rng = random.Random(3)
    base = [{"question": f"What is {k} of the thing", "choices": ["a one", f"b {k}", "ÉTÉ c"], "answer_index": k % 3} for k in range(8)]

    def rewritten(r):
        r = json.loads(json.dumps(r))
        style = rng.choice([str.upper, str.title, lambda t: t.replace(" ", "  "), lambda t: t.replace(" ", "_"), lambda t: f"«{t}»...", lambda t: t.replace(" ", " - ")])
        r["question"] = style(r["question"])
        r["choices"] = [style(c) for c in r["choices"]]
        keys = list(r)
        rng.shuffle(keys)
        return {k: r[k] for k in keys} | {"id": rng.random()}

    records = [rewritten(rng.choice(base)) for _ in range(150)] + [rewritten(base[0]) for _ in range(100)]
    records += [base[0] | {"choices": base[0]["choices"][::-1]}, base[0] | {"answer_index": None}, base[0] | {"answer_index": None, "x": 1}, base[1] | {"question": None}, base[1] | {"question": ""}]
    records += [base[2] | {"choices": None}, base[2] | {"choices": []}, base[3] | {"choices": ["a", None]}, base[3] | {"choices": ["a", ""]}, base[3] | {"choices": ["a"]}]
    lines = [(k, json.dumps(r), "clash") for k, r in enumerate(records)] + [(9998, None, ""), (9999, "[]", ""), (9997, "nonsense", "")]
    frame = spark.createDataFrame(lines, "line_id long, record string, value string")
    parsed = formatting.parsed_records(frame, "line_id", "record")
    groups = defaultdict(list)
    for k, r in enumerate(records):
        groups[code(r)].append(k)
    want = {(g[0], k) for g in groups.values() for k in g[1:]}
    assert {(r.keep_id, r.copy_id) for r in formatting.formatting_copies(parsed, "line_id").collect()} == want
    assert {r.keep_id: r.copies for r in formatting.collapsed_records(parsed, "line_id").collect()} == {g[0]: len(g) for g in groups.values()}
    assert formatting.formatting_copies(formatting.parsed_records(frame.limit(0), "line_id", "record"), "line_id").count() == 0


def test_repeated_keys_are_copies(spark):
    """Two rows with one key are two records, and a group is never fused from them."""
    record = lambda q: json.dumps({"question": q, "choices": ["a", "B"], "answer_index": 0})
    lines = [(1, record("Q?")), (1, record("q")), (2, record("Q")), (3, record("other")), (3, record("other")), (4, record("OTHER"))]
    parsed = formatting.parsed_records(spark.createDataFrame(lines, "line_id long, record string"), "line_id", "record")
    got = {r.keep_id: (r.copies, r.question) for r in formatting.collapsed_records(parsed, "line_id").collect()}
    assert set(got) == {1, 3} and got[1][0] == 3 and got[1][1] in ("Q?", "q") and got[3] == (3, "other")
    assert formatting.collapsed_records(parsed, "line_id").count() == 2
    assert sorted((r.keep_id, r.copy_id) for r in formatting.formatting_copies(parsed, "line_id").collect()) == [(1, 2), (3, 4)]
    rows = parsed.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("x")
    assert {r.keep_id: r.copies for r in formatting.collapsed_records(rows, "line_id").collect()} == {1: 1500, 3: 1500}


# -- quotas ----------------------------------------------------------------------------------------


def test_largest_remainder():
    assert quota.largest_remainder({"a": 60, "b": 30, "c": 10}, 30) == {"a": 18, "b": 9, "c": 3}
    assert quota.largest_remainder({"b": 1, "a": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 0}
    assert quota.largest_remainder({}, 5) == {} and quota.largest_remainder({"a": 0}, 5) == {"a": 0}


def test_allocation_respects_floors_and_availability():
    rng = random.Random(1)
    for _ in range(300):
        names = [f"s{k}" for k in range(rng.randint(1, 12))]
        targets = {n: (rng.randint(0, 3000), rng.randint(0, 12)) for n in names}
        available = {n: rng.randint(0, 60) for n in names if rng.random() < 0.9}
        total = rng.randint(0, 200)
        got = quota.allocate(targets, available, total)
        floors = {n: min(f, available.get(n, 0)) for n, (_, f) in targets.items()}
        assert all(floors[n] <= got[n] <= available.get(n, 0) for n in names)
        able = sum(available.get(n, 0) for n, (s, _) in targets.items() if s) + sum(floors[n] for n, (s, _) in targets.items() if not s)
        assert sum(got.values()) == max(sum(floors.values()), min(total, able))


def test_quota_sample(spark):
    rows = [(k, "big" if k % 3 else "mid" if k % 5 else None) for k in range(3000)] + [(5000, "rare"), (5001, "rare"), (5002, ""), (5003, "other")]
    frame = spark.createDataFrame(rows, "pos long, subject string").withColumn("quota", F.lit("clash"))
    targets = spark.createDataFrame([("big", 5000, 3), ("mid", 4000, 3), ("rare", 900, 5), ("absent", 100, 0), ("nothing", 0, None)], "subject string, target_bp int, min_rows int")
    table = quota.quota_table(frame, "subject", targets, 10)
    got = {r.subject: r for r in table.collect()}
    n = len(rows) // 10
    assert {k for k, r in got.items() if r.short} == {"rare", "absent"}
    assert got["rare"].quota == 2 and got["absent"].quota == 0 and sum(r.quota for r in got.values()) == n
    drawn = quota.quota_sample(frame, "pos", "subject", table).collect()
    assert Counter(r.subject for r in drawn) == {k: r.quota for k, r in got.items() if r.quota}
    keys = {r.pos: r.k for r in frame.select("pos", quota.random_key(F.col("pos")).alias("k")).collect()}
    for subject in ("big", "mid"):
        pool = sorted((keys[p], p) for p, s in rows if s == subject)
        assert {p for _, p in pool[: got[subject].quota]} == {r.pos for r in drawn if r.subject == subject}
    again = quota.quota_sample(frame.repartition(7), "pos", "subject", table).collect()
    assert {r.pos for r in again} == {r.pos for r in drawn}
    assert quota.quota_sample(frame.limit(0), "pos", "subject", quota.quota_table(frame.limit(0), "subject", targets, 10)).count() == 0


# -- nested buckets --------------------------------------------------------------------------------


def test_stable_sample(spark):
    rows = [(k, f"id-{k % 4000}", k % 5 + 1) for k in range(6000)] + [(7000, None, 1), (7001, "", 1)]
    frame = spark.createDataFrame(rows, "pos long, id string, batch int")
    chosen = lambda f: {r.id for r in nested.stable_sample(f, "id", 0.1).collect()}
    whole = chosen(frame)
    assert 0.06 < len(whole) / 4001 < 0.14
    assert chosen(frame.repartition(11)) == whole
    for k in range(1, 5):
        assert chosen(frame.filter(F.col("batch") <= k)) <= whole
    assert nested.stable_sample(frame, "id", 0.1).count() == sum(1 for _, i, _ in rows if i in whole)
    assert {r.id for r in nested.stable_sample(frame, "id", 0.05).collect()} <= whole
    assert nested.chosen_buckets(0.05) == nested.chosen_buckets(0.1)[: len(nested.chosen_buckets(0.05))]
    assert nested.stable_sample(frame.limit(0), "id", 0.1).count() == 0


# -- distinctive terms -----------------------------------------------------------------------------


def test_term_scores(spark):
    rng = random.Random(6)
    words = ["alpha", "Beta", "gamma", "Été", "straße", "x_y", "a1b", "δ"]
    rows = [(k, [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 3))]) for k in range(60)]
    rows += [(100, None), (101, []), (102, [None, ""]), (103, ["alone alone"]), (104, ["--- 12"]), (None, ["alpha"])]
    frame = spark.createDataFrame(rows, "pos long, choices array<string>").withColumn("term", F.lit("clash"))
    counts = {k: Counter(t.lower() for c in cs or [] for t in re.findall(r"[^\W\d_]+", c or "")) for k, cs in rows if k is not None}
    df, total = Counter(), Counter()
    for c in counts.values():
        df.update(c.keys())
        total.update(c)
    z = sum(sum(c.values()) ** distinct.ALPHA for c in counts.values() if c)
    want = {}
    for k, c in counts.items():
        for t, tf in c.items():
            score = max(0.0, math.log2(tf * z / (total[t] * sum(c.values()) ** distinct.ALPHA))) if df[t] > 1 else 0.0
            want[k, t] = (tf, df[t], pytest.approx(score, abs=2e-6))
    got = {(r.pos, r.term): (r.tf, r.df, r.score) for r in distinct.term_scores(frame, "pos", "choices").collect()}
    assert got == want
    few = {(r.pos, r.term) for r in distinct.term_scores(frame, "pos", "choices", 2, 2, 30).collect()}
    assert few == {k for k, (tf, d, _) in want.items() if tf >= 2 and 2 <= d <= 30}
    assert distinct.term_scores(frame.limit(0), "pos", "choices").count() == 0
