"""Operators of the core: every registered query against its SQL, and small cases of its own."""

import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import same_rows
from quizlens.functions import text as tx
from quizlens.functions import statistics as st
from quizlens.judgement import Rule
from quizlens.operators import detectors as dt
from quizlens.operators import duplicates as du
from quizlens.operators import interventions as iv
from quizlens.operators import sampling, scoring
from quizlens.operators.components import connected_components
from quizlens.plans import audit as au
from quizlens.plans import queries as core
from quizlens.plans import report as rp
from quizlens.session import materialise
from quizlens.sources.benchmarks import CorpusError, from_items
from quizlens.sources.synthetic import generate, planted


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_its_sql(spark, data, duck, name):
    frame = core.QUERIES[name](spark, data)
    if name in core.SQL:
        same_rows(frame, duck, core.SQL[name])
    else:
        assert frame.columns and frame.count() >= 0


def corpus(spark, *rows):
    return from_items(spark, [(f"i{k}", q, c, a, s) for k, (q, c, a, s) in enumerate(rows)])


def test_text_functions(spark):
    row = spark.createDataFrame([("The Cat's HAT, well-worn!", "é  a b\x1cc ", "")], "a string, b string, c string")
    got = row.select(tx.tokens(F.col("a")).alias("t"), tx.normalise_text(F.col("b")).alias("n"), tx.shingles(tx.tokens(F.col("a"))).alias("s"), tx.shingles(tx.tokens(F.col("c"))).alias("e")).first()
    assert got.t == ["the", "cat's", "hat", "well-worn"]
    assert got.n == "é a b c"
    assert got.s == ["the cat's hat", "cat's hat well-worn"] and got.e == []
    assert spark.range(1).select(tx.normalise_text(F.lit(None).cast("string")).alias("x")).first().x is None


def test_digests_ignore_id_subject_and_spacing(spark):
    rows = corpus(spark, ("q  x", ["a", "b"], 0, "s"), ("q x", ["a ", "b"], 0, ""), ("q x", ["a", "b"], 1, ""), ("q x", ["b", "a"], 0, ""))
    d = {r.pos: (r.digest, r.stem) for r in du.with_digests(rows).collect()}
    assert d[0] == d[1] and d[2][1] == d[0][1] and d[2][0] != d[0][0] and d[3][1] != d[0][1]


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    sets = {k: {rng.choice(words) for _ in range(rng.randint(1, 14))} for k in range(120)}
    for k in range(120, 160):
        base = set(sets[k - 100])
        if rng.random() < 0.5 and len(base) > 1:
            base.pop()
        sets[k] = base
    frame = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "pos long, shingles array<string>")
    for num, den in ((9, 10), (7, 10), (1, 2)):
        want = {(a, b) for a in sets for b in sets if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}
        got = du.near_pairs(frame, num, den).collect()
        assert {(r.pos_a, r.pos_b) for r in got} == want and len(got) == len(want)
        assert {r.pos for r in du.near_members(frame, num, den).collect()} == {x for p in want for x in p}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(5, 5), (None, 3), (200, 201), (200, 202), (202, 203)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    nodes = {x for a, b in links if a is not None and a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {n: find(n) for n in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_interventions(spark):
    rows = corpus(spark, ('Say "it"', ["a", "b", "c"], 1, "s"), ("  ", ["d", "e"], 0, "s"), ("alone", ["x", "y"], 0, "t"))
    turned = iv.permute_options(rows.filter("pos = 0")).orderBy("variant").collect()
    assert [(r.choices, r.answer_index) for r in turned] == [(["b", "c", "a"], 0), (["a", "b", "c"], 1), (["c", "a", "b"], 2)]
    q = {r.pos: r.question for r in iv.apply_coalition(rows, ["neutral_reframing"], 1).collect()}
    assert q[0].startswith(iv.PREFIX) and "”it”" in q[0] and q[1] == "  "
    swapped = {r.pos: r for r in iv.stronger_distractor(rows, 1).collect()}
    assert swapped[0].choices[1] == "b" and "d" in swapped[0].choices and len(swapped[0].choices) == 3
    assert swapped[1].choices == ["d", "b"]
    assert swapped[2].choices == ["x", "y"]  # its own answer is all its subject's pool has
    with pytest.raises(ValueError):
        iv.ordered(["rotate"])
    grid = iv.coalitions(rows, 1)
    assert grid.filter("pos = 0").count() == 4 + 4 * 3
    assert grid.filter("size(choices) <> size(nc0)").count() == 0


def test_swaps_do_not_depend_on_the_partitioning(spark):
    rows = generate(spark, 60, 2)
    a = {r.pos: r.choices for r in iv.stronger_distractor(rows, 4).collect()}
    b = {r.pos: r.choices for r in iv.stronger_distractor(rows.repartition(5), 4).collect()}
    assert a == b


def test_scorers_never_see_the_key(spark):
    seen = []

    class Probe:
        scorer_id, deterministic = "probe", True

        def score(self, prompts):
            seen.append(prompts.columns)
            return prompts.select("prompt", F.transform("choices", lambda c: F.lit(0.0)).alias("scores"))

    rows = corpus(spark, ("q", ["a", "b"], 0, ""), ("q", ["a", "b"], 1, ""), ("r", ["a", "b"], 1, ""))
    got = au.presented(rows, Probe(), 1)
    assert seen == [["prompt", "question", "choices"]]
    # ties are decided by the options' text: of two equal prompts with different keys exactly one is right
    first = {(r.pos): r.correct for r in got.filter("mask = 0").collect()}
    assert first[0] + first[1] == 1
    counters = scoring.cache_counters(got).first()
    assert counters.hits + counters.misses == counters.lookups


def test_api_scorer(spark):
    def client(prompt):
        return "b" if "keen" in prompt else "(A)." if "plain" in prompt else "no idea"

    rows = corpus(spark, ("keen", ["x", "y"], 1, ""), ("plain", ["x", "y"], 0, ""), ("odd", ["x", "y"], 0, ""))
    scorer = scoring.ApiScorer("m", client)
    prompts = rows.select(F.col("item_id").alias("prompt"), "question", "choices")
    assert {r.prompt: r.scores for r in scorer.score(prompts).collect()} == {"i0": [0.0, 1.0], "i1": [1.0, 0.0], "i2": [0.0, 0.0]}
    assert scoring.abstentions(scorer.replies(prompts)).first().abstentions == 1
    assert scorer.scorer_id == "api[m]" and not scorer.deterministic


def test_local_scorer(spark):
    class Fake:
        def log_likelihoods(self, prompts, continuations):
            return [[-float(len(c)) * (1 + k) for k, c in enumerate(cs)] for cs in continuations]

        def lengths(self, continuations):
            return [len(c) for c in continuations]

    rows = corpus(spark, ("q", ["long one", "b"], 1, "")).select(F.col("item_id").alias("prompt"), "question", "choices")
    assert scoring.LocalScorer("m", Fake).score(rows).first().scores == [-1.0, -2.0]
    assert scoring.LocalScorer("m", Fake, normalise=False).score(rows).first().scores == [-9.0, -4.0]
    assert scoring.LocalScorer("m", Fake, style="labelled").score(rows).first().scores == [-1.0, -2.0]
    with pytest.raises(ValueError):
        scoring.LocalScorer("m", Fake, style="other")


def test_replies(spark):
    cases = [("B", 1), ("(b).", 1), ("The answer is C) because", 2), ("I choose D", 3), ("H", None), ("A cat", 0), ("", None), (None, None), ("Answer: E", None)]
    frame = spark.createDataFrame([(r,) for r, _ in cases], "r string")
    assert [x.c for x in frame.select(tx.parsed_reply(F.col("r"), F.lit(4)).alias("c")).collect()] == [c for _, c in cases]


def test_sampling(spark):
    rows = corpus(spark, *[(f"q{k}", ["a", "b"], 0, "x" if k < 60 else "y" if k < 90 else "z") for k in range(100)])
    quota = {r.subject: r.quota for r in sampling.quotas(rows, 30).collect()}
    assert quota == {"x": 18, "y": 9, "z": 3}
    drawn, name = sampling.subsample(rows, "c", 30, 4, stratify=True)
    assert name == "c[n=30,seed=4]" and {r.subject: r["count"] for r in drawn.groupBy("subject").count().collect()} == quota
    assert {r.pos for r in drawn.collect()} == {r.pos for r in sampling.subsample(rows.repartition(9), "c", 30, 4, True)[0].collect()}
    assert sampling.subsample(rows, "c", 100, 4)[1] == "c" and sampling.prepared(rows, "c", None, 1)[1] == "c"
    assert sampling.simple_sample(rows, 7, 1).count() == 7
    with pytest.raises(ValueError):
        sampling.subsample(rows, "c", 101, 4)


def planted_defects():
    return {
        "position_skew": ({"position": 0.5}, 0.375),
        "longest_answer": ({"longest": 0.4}, planted(0.4, 4) - 0.25),
        "choices_only": ({"marker": 0.3}, planted(0.3, 4) - 0.25),
        "near_duplicate": ({"repeat": 0.1}, 120 / 660),
    }


@pytest.mark.parametrize("name", planted_defects())
def test_a_planted_defect_fires_its_detector_only(spark, name):
    rates, effect = planted_defects()[name]
    found = dt.run_detectors(generate(spark, 600, 1, **rates), 7, Rule())
    fired = [r for r in found.rows if r.verdict == st.ESTABLISHED]
    assert [r.part for r in fired] == [name]
    assert fired[0].point == pytest.approx(effect, abs=0.06)
    assert found.withheld == (60 if name == "near_duplicate" else 0) and found.not_run == ()


def test_clean_and_tiny_corpora(spark):
    assert all(r.verdict != st.ESTABLISHED for r in dt.run_detectors(generate(spark, 500, 9), 7, Rule()).rows)
    tiny = dt.run_detectors(generate(spark, 6, 9), 7, Rule())
    assert tiny.rows == () and set(tiny.not_run) == {"position_skew", "longest_answer", "choices_only", "near_duplicate"}
    assert dt.run_detectors(generate(spark, 30, 9), 7, Rule()).not_run == ("choices_only",)


def test_corpora_out_of_range(spark):
    for wrong in ({"n": 0}, {"n": 5, "choices": 1}, {"n": 5, "favoured": 4}, {"n": 5, "marker": 1.5}, {"n": 5, "other": 0.1}):
        with pytest.raises(ValueError):
            generate(spark, **wrong)
    for wrong in ([("", "q", ["a", "b"], 0, "")], [("i", "q", ["a"], 0, "")], [("i", "q", ["a", "b"], 2, "")], [("i", "q", ["a", "b"], 0, "")] * 2, [("i", None, ["a", "b"], 0, "")], []):
        with pytest.raises(CorpusError):
            from_items(spark, wrong)


def test_a_pool_of_two_answers(spark):
    """In a subject whose answers are mostly Yes or No no item meets the pool: each draw is one look-up, and exact."""
    rows = [(k, f"i{k}", f"q{k}", ["Yes", "No"], k % 2, "s") for k in range(3000)] + [(5000, "x", "q", ["Yes", "maybe"], 1, "s"), (5001, "y", "q", ["perhaps", "No"], 0, "s"), (5002, "z", "q", ["a", "b"], 0, "alone")]
    frame = spark.createDataFrame(rows, "pos long, item_id string, question string, choices array<string>, answer_index int, subject string")
    drawn = {r.pos: r.distractor for r in iv.drawn_distractors(tx.with_normal(frame), 3).collect()}
    assert 5002 not in drawn and len(drawn) == 3002
    share = [drawn[k] for k in range(3000)].count("maybe") / 3000
    assert set(drawn.values()) <= {"Yes", "No", "maybe", "perhaps"} and {drawn[k] for k in range(3000)} == {"maybe", "perhaps"} and 0.45 < share < 0.55
    assert drawn[5000] in ("No", "perhaps") and drawn[5001] in ("Yes", "maybe")
    plan = iv.drawn_distractors(tx.with_normal(frame), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
    # uniform over usable entries, repeated answers weighing as often as they occur
    many = [(k, f"i{k}", f"q{k}", ["o", "p"], 0, "s") for k in range(2000)] + [(9000 + k, f"j{k}", "q", ["common", "x"] if k < 30 else [f"rare{k}", "x"], 0, "s") for k in range(40)]
    got = [r.distractor for r in iv.drawn_distractors(tx.with_normal(spark.createDataFrame(many, frame.schema)), 5).filter("pos < 9000").collect()]
    assert 0.70 < got.count("common") / 2000 < 0.80


def test_many_copies_are_one_class(spark):
    frame = spark.range(100_000).selectExpr("id AS pos", "array('a b c', 'b c d') AS shingles").union(spark.sql("SELECT 200000L, array('a b c', 'x y z')"))
    classes = materialise(du.set_classes(frame))
    pairs = du.candidate_classes(frame, classes)
    assert [tuple(r) for r in pairs.collect()] == [(0, 200_000)]
    flags = du.ceiling_flags(pairs, classes)
    assert flags.count() == 100_001 and flags.filter("over and candidates = 100000").count() == 100_001


def test_interventions_of_ones_own(spark):
    rows = corpus(spark, ("one", ["a", "b", "c"], 2, "s"), ("two", ["d", "e"], 0, "s"))
    shout = iv.Rewriting("shout", "the question in capitals", lambda q, c, a, pos: F.array(F.struct(F.upper(q).alias("question"), c.alias("choices"), a.alias("answer_index"))))
    both_ends = iv.Rewriting("ends", "the key first or last", lambda q, c, a, pos: F.array(*(F.struct(q.alias("question"), iv.rotated(c, a, at).alias("choices"), at.cast("int").alias("answer_index")) for at in (F.lit(0), F.size(c) - 1))))
    assert [iv.name_of(p) for p in iv.ordered(["permute_options", shout, "neutral_reframing"])] == ["neutral_reframing", "shout", "permute_options"]
    with pytest.raises(ValueError):
        iv.ordered([iv.Rewriting("x", "x", shout.variants, after="nothing")])
    assert {r.question for r in iv.apply_coalition(rows, [shout], 1).collect()} == {"ONE", "TWO"}
    grid = iv.coalitions(rows, 1, [shout, both_ends, "permute_options"])
    assert grid.count() == 2 * 2 + 2 * 2 * 2 + 2 * (3 + 2) + 2 * 2 * (3 + 2)
    assert grid.filter("question <> IF(mask % 2 = 1, upper(question), lower(question))").count() == 0
    assert grid.filter("element_at(choices, answer_index + 1) <> element_at(nc0, a0 + 1)").count() == 0
    assert grid.groupBy("pos", "mask", "variant").count().filter("count > 1").count() == 0
    audit = au.run_audit(materialise(generate(spark, 60, 4)), "c", scoring.SimulatedScorer({"memory": 0.5}, seed=2), 7, Rule(draws=1000), [shout], blind=False, corpus_layer=False)
    assert [r.part for r in audit.rows] == ["shout"] and audit.rows[0].what == "the question in capitals" and audit.rows[0].point > 0


def test_contradictions(spark):
    rows = corpus(spark, ("same", ["a", "b"], 0, ""), ("same", ["a", "b"], 1, ""), ("same", ["a ", "b"], 0, ""), ("other", ["a", "b"], 0, ""))
    got = du.contradiction_groups(du.with_digests(rows)).collect()
    assert [(r.first_pos, r.n, r.answers) for r in got] == [(0, 3, 2)]


@pytest.fixture(scope="module")
def audit(spark):
    items = materialise(generate(spark, 400, 11))
    return au.run_audit(items, "c", scoring.SimulatedScorer({"skill": 0.4, "memory": 0.3}, seed=11), 7, Rule(draws=2000))


def test_audit_charges_what_was_planted(audit):
    assert audit.charged() == ("neutral_reframing",)
    shares = {r.part: r for r in audit.layer("share")}
    share = shares["neutral_reframing"]
    assert share.low <= (1 - 0.4) * 0.3 * 0.75 <= share.high
    assert sum(r.point for r in shares.values()) == pytest.approx(audit.scores["drop"], abs=1e-12)
    assert audit.scores["assayed"] == pytest.approx(audit.scores["reported"] - share.point)
    assert 0 < audit.scores["purity"] < 1 and audit.run["items"] == 400
    assert shares["stronger_distractor"].note and [r.verdict for r in audit.layer("blind")] == ["shown"] and len(audit.layer("defect")) == 4


def test_report_round_trip_and_text(spark, audit):
    text = rp.to_json(audit)
    assert rp.from_json(text) == audit
    assert list(json.loads(text)) == sorted(json.loads(text)) and json.loads(text)["version"] == rp.SCHEMA_VERSION
    assert "\n" not in rp.to_json(audit, 0)
    with pytest.raises(ValueError, match="version"):
        rp.from_json(text.replace(f'"version": {rp.SCHEMA_VERSION}', '"version": 1'))
    without = json.loads(text)
    del without["not_run"]
    assert rp.from_json(json.dumps(without)).not_run == ()
    shown = rp.render(audit)
    assert shown.index("provenance") < shown.index("== score") and all(len(x) <= rp.WIDTH + 40 for x in shown.split("\n"))
    for row in audit.rows:
        assert (rp.interval(row) in shown) == (row.verdict in (st.ESTABLISHED, "shown"))
    # figures that are undefined come through
    odd = audit.rows[0].asDict() | {"point": float("nan"), "verdict": "undefined"}
    broken = type(audit)(audit.run, audit.scores | {"purity": None}, (type(audit.rows[0])(**odd),))
    back = rp.from_json(rp.to_json(broken))
    assert back.rows[0].point != back.rows[0].point and "n/a" in rp.render(back)
    assert audit.table(spark).count() == len(audit.rows)


def test_compare(spark, audit):
    import dataclasses

    other = dataclasses.replace(audit, run=audit.run | {"scorer": "other"}, rows=tuple(audit.layer("blind")))
    c = rp.compare(spark, audit, other)
    assert c.charged_to("baseline") == ("neutral_reframing",) and c.charged_to("variant") == () and c.scores[0][1] == c.scores[0][2]
    text = rp.render_comparison(c)
    assert "comparison" in text and "charged to the baseline only: neutral_reframing" in text
    for change, message in (({"corpus_hash": "x", "scorer": "y"}, "corpora"), ({"settings_hash": "x", "scorer": "y"}, "configurations"), ({}, "same scorer"), ({"corpus_hash": "x"}, "corpora and the same scorer")):
        with pytest.raises(rp.NotComparable, match=message):
            rp.compare(spark, audit, dataclasses.replace(audit, run=audit.run | change))


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(au, "MAX_PATTERNS", 3)
    with pytest.raises(ValueError, match="too many"):
        au.collected_patterns(spark.createDataFrame([(0.0, 1.0, 4), (1.0, 0.0, 2)], "m0 double, m1 double, n long"), 2)


def test_simulations_out_of_range():
    for rates, more in (({"skil": 0.1}, {}), ({"skill": 1.1}, {}), ({}, {"position": -0.1}), ({}, {"favoured": -1})):
        with pytest.raises(ValueError):
            scoring.SimulatedScorer(rates, **more)
    assert "guesses only" in scoring.SimulatedScorer({}).scorer_id


def test_continuation_model():
    import numpy as np

    from quizlens.operators.backends import ContinuationModel, HostedChat

    vocabulary = {c: i + 1 for i, c in enumerate("abc ")}

    def logits(ids, mask):
        assert ids.shape == mask.shape and np.all(ids[mask == 0] == 0)
        out = np.zeros((*ids.shape, 5))
        out[..., 2] = np.log(3)  # "b" is three times as likely as any other token, anywhere
        return out

    model = ContinuationModel(lambda text: [vocabulary[c] for c in text], logits, pad=0, context=6)
    (got,) = model.log_likelihoods(["ab"], [[" b", " a", "", "bbbbbbbb"]])
    assert got == pytest.approx([np.log(3 / 49), np.log(1 / 49), np.log(1 / 7), 5 * np.log(3 / 7)])
    assert model.lengths([" b", "", "abc"]) == [2, 1, 3]
    client = HostedChat("http://localhost/v1/chat", "m", "k")
    body = json.loads(client.request("Q?").data)
    assert body["model"] == "m" and [m["role"] for m in body["messages"]] == ["system", "user"] and client.request("Q?").get_header("Authorization") == "Bearer k"


def test_corpus_hash_follows_content_and_order(spark):
    rows = corpus(spark, ("q", ["a", "b"], 0, ""), ("r", ["a", "b"], 0, ""))
    flipped = corpus(spark, ("r", ["a", "b"], 0, ""), ("q", ["a", "b"], 0, ""))
    assert au.corpus_hash(rows, "c") == au.corpus_hash(rows.repartition(3), "c")
    assert len({au.corpus_hash(rows, "c"), au.corpus_hash(rows, "d"), au.corpus_hash(flipped, "c")}) == 3


def test_command_line(spark, tmp_path, capsys):
    from quizlens.cli import main

    assert main(["pathology", str(tmp_path / "none.jsonl")]) == 2
    assert main(["demo", "--bootstrap", "1000", "--json", str(tmp_path / "a.json")]) == 0
    assert "assayed" in capsys.readouterr().out
    assert main(["compare", str(tmp_path / "a.json"), str(tmp_path / "a.json")]) == 2
    assert "same scorer" in capsys.readouterr().err
    assert main(["audit", str(tmp_path / "none.jsonl"), "m", "--backend", "api"]) == 2
    with pytest.raises(SystemExit):
        main(["--version"])
    assert "quizlens" in capsys.readouterr().out
