"""Profiles against literal expectations on tiny frames."""

from __future__ import annotations

import math

import pytest

from tessera.operators.frame import frame_of
from tessera.operators.profiles import PROFILES
from tessera.plans.options import BucketOptions, ClipOptions, EmaOptions, ExpandingOptions, LagOptions, RollingOptions


@pytest.fixture(scope="module")
def signals(spark):
    return frame_of(spark, [(0, 1.0, 2.0), (1, 3.0, 2.0), (2, 2.0, 2.0), (3, 5.0, 4.0), (4, None, 5.0), (5, 6.0, 0.0)], "rid int, fast double, slow double")


@pytest.fixture(scope="module")
def labels(spark):
    return frame_of(spark, [(0, True, True), (1, False, True), (2, True, False), (3, None, False), (4, True, True)], "rid int, actual boolean, predicted boolean")


def values(frame, name):
    return [r[name] for r in frame.collect()]


def near(got, expected):
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        if b is None:
            assert a is None
        elif isinstance(b, float) and math.isnan(b):
            assert math.isnan(a)
        else:
            assert a == pytest.approx(b)


NAN = math.nan


def test_every_profile_is_listed():
    assert len(PROFILES) == 59


def test_crossover(signals):
    out = signals.crossoverProfile("fast", "slow", "p", LagOptions(1))
    near(values(out, "p_ratio"), [0.5, 1.5, 1.0, 1.25, None, NAN])
    near(values(out, "p_cross_above"), [None, True, False, True, None, None])


def test_rolling_crossover(signals):
    out = signals.rollingCrossoverProfile("fast", "slow", "p", LagOptions(1), RollingOptions(3, 2))
    assert values(out, "p_rolling_cross_count") == [1, 2, 3, 3, 2, 2]
    near(values(out, "p_rolling_cross_above_rate"), [None, 0.5, 1 / 3, 2 / 3, 0.5, 0.5])
    near(values(out, "p_rolling_mean_abs_spread"), [None, 1.0, 2 / 3, 2 / 3, 0.5, 3.5])


def test_correlation(signals):
    out = signals.rollingCorrelationProfile("fast", "slow", "p", RollingOptions(3, 2))
    near(values(out, "p_rolling_covariance"), [None, 0.0, 0.0, 10 / 9, 1.5, -1.0])
    near(values(out, "p_rolling_correlation"), [None, NAN, NAN, 0.944911182523068, 1.0, -1.0])


def test_classification(labels):
    out = labels.rollingClassificationProfile("actual", "predicted", "p", RollingOptions(3, 2))
    assert values(out, "p_rolling_class_count") == [1, 2, 3, 2, 2]
    near(values(out, "p_rolling_accuracy"), [None, 0.5, 1 / 3, 0.0, 0.5])
    near(values(out, "p_rolling_precision"), [None, 0.5, 0.5, 0.0, 1.0])


def test_bool_transition(labels):
    out = labels.boolTransitionProfile("actual", "p", LagOptions(1))
    assert values(out, "p_toggled") == [None, True, True, None, None]
    assert values(out, "p_true_streak") == [1, 0, 1, None, 1]


def test_linear_fit(spark):
    f = frame_of(spark, [(0, 1.0, 3.0), (1, 2.0, 5.0), (2, 3.0, 8.0), (3, 4.0, 9.0), (4, None, 11.0)], "rid int, x double, y double")
    out = f.linearFitProfile("x", "y", "p", ExpandingOptions(3))
    near(values(out, "p_fitted"), [3.1, 5.2, 7.3, 9.4, None])
    near(values(out, "p_residual_zscore"), [-0.23904572186687895, -0.4780914437337579, 1.6733200530681511, -0.9561828874675167, None])
    roll = f.rollingLinearFitProfile("x", "y", "p", RollingOptions(3, 2))
    near(values(roll, "p_rolling_slope"), [None, 2.0, 2.5, 2.0, 1.0])
    near(values(roll, "p_rolling_residual_zscore"), [None, NAN, 0.7071067811865475, -0.7071067811865475, None])


def test_bucket(signals):
    out = signals.bucketProfile("fast", "p", BucketOptions(3, 0.34, 0.84))
    near(values(out, "p_ecdf"), [0.2, 0.6, 0.4, 0.8, None, 1.0])
    assert values(out, "p_bucket") == [0, 1, 0, 1, None, 2]


def test_constant_input_gives_nan_not_an_error(spark):
    f = frame_of(spark, [(i, 4.0) for i in range(4)], "rid int, x double")
    near(values(f.standardize_profile("x", "p"), "p_zscore"), [NAN] * 4)
    near(values(f.rolling_moment_profile("x", "p", RollingOptions(2, 1)), "p_rolling_skewness"), [NAN] * 4)
    near(values(f.robust_profile("x", "p"), "p_mad_zscore"), [NAN] * 4)


def test_ema_skips_nulls(signals):
    near(values(signals.emaProfile("fast", "p", EmaOptions(0.5, 2)), "p_ema"), [None, 2.0, 2.0, 3.5, None, 4.75])


def test_trend_resets_on_nulls(signals):
    out = signals.trendProfile("fast", "p")
    assert values(out, "p_trend") == [None, 1, -1, 1, None, None]
    assert values(out, "p_reversal") == [None, False, True, True, None, None]


def test_validity_runs(signals):
    out = signals.validityProfile("fast", "p")
    assert values(out, "p_valid_streak") == [1, 2, 3, 4, 0, 1]
    assert values(out, "p_null_streak") == [0, 0, 0, 0, 1, 0]


def test_rolling_drawdown_takes_the_latest_peak(spark):
    f = frame_of(spark, [(0, 5.0), (1, 5.0), (2, 3.0)], "rid int, x double")
    assert values(f.rolling_drawdown_profile("x", "p", RollingOptions(3, 1)), "p_rolling_peak_age") == [0, 0, 1]


def test_clip_bounds_must_be_ordered():
    with pytest.raises(ValueError):
        ClipOptions(2, 1)


def test_empty_frame(spark):
    f = frame_of(spark, [], "rid int, x double")
    assert f.rolling_profile("x", "p", RollingOptions(3)).df.count() == 0
    assert f.expanding_rank_profile("x", "p", ExpandingOptions()).df.count() == 0


@pytest.mark.parametrize("blocks", [1, 4, 50])
def test_blocks_give_what_one_window_gives(spark, blocks):
    rows = [(i, float((i * 37) % 11) if i % 5 else None) for i in range(120)]
    f = frame_of(spark, rows, "rid int, x double")
    o = RollingOptions(5, 2)
    whole = f.rolling_profile("x", "p", o).lead_profile("x", "q", LagOptions(2))
    block = f.rolling_blocked(lambda g: g.rolling_profile("x", "p", o).lead_profile("x", "q", LagOptions(2)), behind=4, ahead=2, blocks=blocks)
    assert block.df.columns == whole.df.columns
    assert [repr(tuple(r)) for r in block.collect()] == [repr(tuple(r)) for r in whole.collect()]


def test_ema_leaves_other_columns_alone(spark):
    big = [9007199254740993, None, 9007199254740995]
    f = frame_of(spark, [(i, v, NAN, b, i % 2) for i, (v, b) in enumerate(zip([1.0, None, 3.0], big, strict=True))], "rid int, x double, other double, big long, k int")
    out = f.ema_profile("x", "e", EmaOptions(0.5, 1))
    assert values(out, "big") == big and all(math.isnan(v) for v in values(out, "other"))
    near(values(out, "e_ema"), [1.0, None, 2.0])
    split = type(f)(f.df, ["rid"], ["k"]).ema_profile("x", "e", EmaOptions(0.5, 2))
    near(values(split, "e_ema"), [None, None, 2.0])


@pytest.fixture(scope="module")
def gaps(spark):
    return frame_of(spark, [(0, 1.0), (1, NAN), (2, 3.0), (3, 2.0), (4, None)], "rid int, x double")


def test_nan_compares_as_ieee_has_it(gaps):
    c = gaps.clip_profile("x", "c", ClipOptions(1.5, 2.5))
    near(values(c, "c_clipped"), [1.5, 1.5, 2.5, 2.0, None])
    assert values(c, "c_above") == [False, False, True, False, None] and values(c, "c_below") == [True, False, False, False, None]
    assert values(c, "c_in_range") == [False, True, False, True, None]
    t = gaps.threshold_profile("x", "t", 1.5)
    assert values(t, "t_above") == [False, False, True, True, None] and values(t, "t_at") == [False, False, False, False, None]
    assert values(gaps.sign_profile("x", "s", LagOptions()), "s_sign") == [1, 0, 1, 1, None]
    assert values(gaps.change_point_profile("x", "p", 0.5, LagOptions()), "p_change_point") == [None, False, False, True, None]
    assert values(gaps.trend_profile("x", "d", LagOptions()), "d_trend") == [None, 0, 0, -1, None]


def test_running_extremes_pass_over_a_later_nan(gaps, spark):
    near(values(gaps.drawdown_profile("x", "d"), "d_running_peak"), [1.0, 1.0, 3.0, 3.0, None])
    e = gaps.extrema_profile("x", "e")
    near(values(e, "e_running_high"), [1.0, 1.0, 3.0, 3.0, None])
    near(values(e, "e_running_low"), [1.0, 1.0, 1.0, 1.0, None])
    assert values(e, "e_new_high") == [True, False, True, False, None]
    near(values(gaps.rolling_range_profile("x", "r", RollingOptions(2, 1)), "r_rolling_high"), [1.0, 1.0, NAN, 3.0, None])
    near(values(gaps.rolling_drawdown_profile("x", "w", RollingOptions(2, 1)), "w_rolling_peak"), [1.0, 1.0, NAN, 3.0, None])


def test_statistics_of_a_whole_frame_are_no_single_task(spark):
    f = frame_of(spark, [(i, float(i * i % 7), float(i)) for i in range(50)], "rid int, x double, y double")
    for out in (f.standardize_profile("x", "s"), f.linear_fit_profile("x", "y", "l"), f.argsort_by("x"), f.rank_profile_by("x", "r")):
        plan = out.df._jdf.queryExecution().executedPlan().toString()
        assert not any("SinglePartition" in line and "BroadcastExchange" not in line and "Exchange" in line and "Window" in plan for line in plan.split("\n")), plan
    keyed = type(f)(f.df.selectExpr("*", "1 as k"), ["rid"], ["k"])
    for name in ("s_zscore", "s_minmax", "s_centered"):
        near(values(f.standardize_profile("x", "s"), name), values(keyed.standardize_profile("x", "s"), name))
    for name in ("l_fitted", "l_residual_zscore", "l_slope"):
        near(values(f.linear_fit_profile("x", "y", "l"), name), values(keyed.linear_fit_profile("x", "y", "l"), name))
    for name in ("r_ordinal_rank", "r_competition_rank", "r_dense_rank", "r_percent_rank", "r_cume_dist"):
        near(values(f.rank_profile_by("x", "r"), name), values(keyed.rank_profile_by("x", "r"), name))
    assert values(f.argsort_by("x"), "argsort") == values(keyed.argsort_by("x"), "argsort")


def test_order_statistics_so_far_equal_numpy(monkeypatch):
    import numpy as np

    from tessera.operators.profiles import Ordered

    monkeypatch.setattr(Ordered, "SIZE", 4)
    rng = np.random.default_rng(6)
    for values_ in (rng.integers(0, 9, 120).astype(float), rng.normal(size=120), np.repeat(3.0, 40)):
        seen = Ordered()
        for i, v in enumerate(values_.tolist()):
            seen.add(v)
            x = values_[: i + 1]
            assert seen.rank(v) == ((x < v).sum(), (x == v).sum())
            assert [seen.quantile(q) for q in (0.25, 0.5, 0.75)] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.75]).tolist())
            m, n = seen.quantile(0.5), i + 1
            assert (seen.deviation(m, (n - 1) // 2) + seen.deviation(m, n // 2)) / 2 == pytest.approx(np.median(np.abs(x - np.median(x))))
