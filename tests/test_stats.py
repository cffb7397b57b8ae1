"""Statistics, against known values and brute force: resampling on the driver, the rest as Columns."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from quizlens import judgement as jd
from quizlens import resampling as rs
from quizlens.functions import statistics as st


def adjusted(spark, ps):
    rows = spark.createDataFrame([(k, float(p)) for k, p in enumerate(ps)], "k int, p double")
    return [r.adjusted for r in st.holm(rows, "p", ["k"]).orderBy("k").collect()]


def test_holm(spark):
    assert adjusted(spark, [0.01, 0.02, 0.03]) == pytest.approx([0.03, 0.04, 0.04])
    assert adjusted(spark, []) == []
    ps = np.random.default_rng(3).random(12)
    got = adjusted(spark, ps)
    assert all(a >= p for a, p in zip(got, ps)) and [x for _, x in sorted(zip(ps, got))] == sorted(got)
    two = spark.createDataFrame([("a", 1, 0.01), ("a", 2, 0.04), ("b", 1, 0.03)], "f string, k int, p double")
    assert {(r.f, r.k): r.adjusted for r in st.holm(two, "p", ["k"], ["f"]).collect()} == pytest.approx({("a", 1): 0.02, ("a", 2): 0.04, ("b", 1): 0.03})


def test_mcnemar(spark):
    cases = [(7, 3), (0, 0), (2, 5), (0, 12), (4000, 4100), (1, 2000)]

    def exact(b, c):
        d = b + c
        return min(1.0, 2 * sum(math.comb(d, i) for i in range(min(b, c) + 1)) / 2**d) if d else 1.0

    got = spark.createDataFrame(cases, "b long, c long").select("b", "c", st.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()
    assert {(r.b, r.c): r.p for r in got} == pytest.approx({x: exact(*x) for x in cases}, rel=1e-9)
    assert exact(7, 3) == pytest.approx(0.34375)


def test_wilson_and_detectable_effects(spark):
    low, high = st.wilson(F.col("hits"), F.col("n"), 0.05)
    got = spark.createDataFrame([(5, 10), (0, 10), (10, 10), (0, 0)], "hits long, n long").select(low.alias("l"), high.alias("h")).collect()
    assert tuple(got[0]) == pytest.approx((0.2366, 0.7634), abs=1e-4)
    assert got[1].l == pytest.approx(0, abs=1e-15) and got[2].h == pytest.approx(1) and tuple(got[3]) == (None, None)
    z = st.quantile(0.995)
    row = spark.range(1).select(st.mde_from_discordance(F.lit(0.0), F.lit(10), 0.01, 0.8), st.mde_from_interval(F.lit(0.1), F.lit(0.3), 0.01, 0.8)).first()
    assert row[0] == 0 and row[1] == pytest.approx((z + st.quantile(0.8)) * 0.1 / z)


def test_chi_square_tail():
    assert rs.chi_square_tail(2.0, 3) == pytest.approx(0.57241, abs=1e-5)
    assert rs.chi_square_tail(0, 3) == 1
    assert rs.chi_square_tail(9.0, 2) == pytest.approx(math.exp(-4.5))


def test_shapley_two_players():
    assert rs.shapley_weights(2).tolist() == [[0.5, -0.5, 0.5, -0.5], [0.5, 0.5, -0.5, -0.5]]
    for players in (0, rs.MAX_PLAYERS + 1):
        with pytest.raises(ValueError):
            rs.shapley_weights(players)


@given(hs.integers(1, 5), hs.randoms(use_true_random=False))
def test_shapley_axioms(players, random):
    accuracy = np.array([random.random() for _ in range(1 << players)])
    shares = rs.shapley_weights(players) @ accuracy
    assert shares.sum() == pytest.approx(accuracy[0] - accuracy[-1], abs=1e-12)
    # a player that changes nothing has no share
    dummy = np.array([accuracy[m & ~1] for m in range(1 << players)])
    assert (rs.shapley_weights(players) @ dummy)[0] == pytest.approx(0, abs=1e-12)


def test_left_out_means_are_deletion(spark):
    items = np.array([[1.0, 0.0], [1.0, 0.0], [0.5, 1.0]])
    patterns, counts = np.array([[1.0, 0.0], [0.5, 1.0]]), np.array([2, 1])
    left = rs.left_out_means(patterns, counts)
    assert left[0] == pytest.approx(np.delete(items, 0, axis=0).mean(axis=0))
    assert left[1] == pytest.approx(np.delete(items, 2, axis=0).mean(axis=0))
    with pytest.raises(ValueError):
        rs.left_out_means(patterns[:1], np.array([1]))
    rows = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "x double")
    assert sorted(r[0] for r in rows.select(st.jackknife(rows, "x")).collect()) == [1.5, 3.5, 4.0]
    assert rows.limit(1).select(st.jackknife(rows.limit(1), "x")).first()[0] is None


def test_resampled_means_have_the_bootstrap_moments():
    rng = np.random.default_rng(1)
    values, counts = np.array([0.0, 0.25, 1.0]), np.array([50, 30, 20])
    draws = rs.resampled_means(rng, values, counts, 20_000)
    mean = float(counts @ values / 100)
    var = float(counts @ (values - mean) ** 2 / 100 / 100)
    assert draws.mean() == pytest.approx(mean, abs=0.001)
    assert draws.var() == pytest.approx(var, rel=0.05)


def test_bootstrap_p():
    assert rs.bootstrap_p(0.0, np.ones(10)) == 1
    assert rs.bootstrap_p(0.5, np.full(999, 0.4)) == pytest.approx(2 / 1000)
    assert rs.bootstrap_p(-0.5, np.r_[np.full(998, -0.4), 0.1]) == pytest.approx(4 / 1000)
    assert rs.bootstrap_p(0.5, np.array([1e-13] * 10)) == 1


def test_bca_is_always_defined():
    replicates = np.linspace(0.1, 0.9, 1001)
    flat, one = np.array([0.5]), np.array([10])
    # neither bias nor acceleration: the plain interval
    assert rs.bca_interval(0.5, replicates, flat, one, 0.01) == pytest.approx(rs.percentiles(replicates, 0.01))
    # all replicates on one side, or all equal: still an interval within them
    low, high = rs.bca_interval(2.0, replicates, flat, one, 0.01)
    assert 0.1 <= low <= high <= 0.9
    assert rs.bca_interval(0.3, np.full(50, 0.3), flat, one, 0.05) == (0.3, 0.3)
    # a known case: the mean of skewed data, against the textbook formula item by item
    rng = np.random.default_rng(4)
    data = rng.exponential(size=60)
    draws = data[rng.integers(0, 60, (20_000, 60))].mean(axis=1)
    left = (data.sum() - data) / 59
    z0 = rs._NORMAL.inv_cdf(float(np.mean(draws < data.mean())))
    d = left.mean() - left
    a = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
    z = np.array([rs._NORMAL.inv_cdf(0.025), rs._NORMAL.inv_cdf(0.975)])
    want = np.quantile(draws, [rs._NORMAL.cdf(float(z0 + (z0 + x) / (1 - a * (z0 + x)))) for x in z])
    assert rs.bca_interval(float(data.mean()), draws, left, np.ones(60), 0.05) == pytest.approx(want, abs=1e-3)


def verdict(spark, point, low, high, p, min_effect=0.05):
    values = [F.lit(x).cast("double") for x in (point, low, high, p)]
    return spark.range(1).select(st.gate(*values, 0.01, min_effect)).first()[0]


def test_gate_order_and_limits(spark):
    assert verdict(spark, 0.1, 0.01, 0.2, 0.01) == "established"  # equality passes
    assert verdict(spark, 0.05, 0.01, 0.2, 0.0) == "established"
    assert verdict(spark, 0.1, 0.0, 0.2, 0.02) == "p"
    assert verdict(spark, 0.1, 0.0, 0.2, 0.0) == "zero"
    assert verdict(spark, 0.01, 0.005, 0.02, 0.0) == "small"
    assert verdict(spark, -0.1, -0.2, -0.05, 0.0) == "sign"


@pytest.mark.parametrize("bad", [float("nan"), None, float("inf"), -float("inf")])
@pytest.mark.parametrize("place", range(4))
def test_the_gate_refuses_what_is_undefined(spark, bad, place):
    values = [0.1, 0.05, 0.2, 0.001]
    values[place] = bad
    assert verdict(spark, *values) == "undefined"


def test_the_gate_refuses_what_is_out_of_range(spark):
    assert verdict(spark, 0.1, 0.05, 0.2, -0.1) == verdict(spark, 0.1, 0.05, 0.2, 1.5) == verdict(spark, 0.1, 0.2, 0.05, 0.0) == "undefined"


def test_judged_rows(spark):
    raw = [
        jd.raw_row("share", "a", "A", 0.1, (0.05, 0.15), 0.001, 10, "m", 0.01),
        jd.raw_row("share", "b", "B", 0.2, (0.05, 0.15), float("nan"), 10, "m"),
        jd.raw_row("defect", "a", "C", 0.1, (0.05, 0.15), 0.006, 10, "m"),
        jd.raw_row("blind", "blind", "D", 0.3, (0.2, 0.4), 0.5, 10, "m"),
    ]
    table = jd.judged(jd.raw_table(spark, raw), jd.Rule())
    got = {(r.layer, r.part): r for r in table.collect()}
    assert {k: r.verdict for k, r in got.items()} == {("share", "a"): "established", ("share", "b"): "undefined", ("defect", "a"): "established", ("blind", "blind"): "shown"}
    assert got["share", "a"].adjusted == pytest.approx(0.002) and got["defect", "a"].adjusted == 0.006
    assert got["share", "b"].high == 0.2  # widened to hold the point
    assert got["share", "a"].detectable == pytest.approx((st.quantile(0.995) + st.quantile(0.8)) * 0.01)
    assert jd.attributed_points(table).first().attributed == pytest.approx(0.1)
    assert jd.established(table).count() == 2
    assert jd.score_summary(table, 0.4, 0.3, 0.25).first().purity == pytest.approx(0.75)
    assert jd.judged(jd.raw_table(spark, []), jd.Rule()).count() == 0


def test_rules():
    for bad in ({"alpha": 0}, {"power": 1}, {"draws": 10}, {"min_effect": -1}, {"min_effect": float("nan")}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            jd.Rule(**bad)
