import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborfolio.operators import frontier as fr


def problem(rng, n):
    days = rng.normal(size=(40 + n, n)) * rng.uniform(0.005, 0.03, n) + rng.normal(size=n) * 0.002
    days[:, 1:] += 0.5 * days[:, :1]
    lo = rng.choice([0.0, 0.02, -0.1], n)
    hi = lo + rng.choice([0.3, 0.5, 1.0], n) + 1.2 / n
    return np.atleast_2d(np.cov(days.T)), days.mean(axis=0), lo, hi


def residual(q, c, lo, hi, w):
    """How far the weights are from the conditions of the minimum of w'qw / 2 - c'w."""
    slope = q @ w - c
    low, high = w <= lo + 1e-9, w >= hi - 1e-9
    inner = ~low & ~high
    price = slope[inner].mean() if inner.any() else (slope[high].max(initial=-np.inf) + slope[low].min(initial=np.inf)) / 2
    gap = slope - price
    wrong = np.where(inner, np.abs(gap), np.where(low, np.maximum(-gap, 0), np.maximum(gap, 0)))
    return max(wrong.max() / np.diag(q).mean(), abs(w.sum() - 1), (lo - w).max(), (w - hi).max())


def test_bounded_minimum_meets_its_conditions():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 25):
        for _ in range(40):
            q, m, lo, hi = problem(rng, n)
            if fr._infeasible(lo, hi):
                continue
            for t in (0.0, 0.1, 0.4, 100.0):
                w = fr.bounded_minimum(q, t * m, lo, hi)
                assert residual(q, t * m, lo, hi, w) < 1e-7 * max(1.0, t)


def test_path_is_the_minimum_at_every_tolerance():
    rng = np.random.default_rng(2)
    for n in (2, 3, 8, 20):
        for _ in range(25):
            q, m, lo, hi = problem(rng, n)
            if fr._infeasible(lo, hi):
                continue
            path = fr.efficient_path(q, m, lo, hi)
            tolerances = [t for t, _ in path]
            assert tolerances == sorted(tolerances)
            for (t0, w0), (t1, w1) in zip(path, path[1:]):
                for share in (0.0, 0.3, 1.0):
                    if np.isfinite(t1):
                        t, w = t0 + share * (t1 - t0), w0 + share * (w1 - w0)
                        assert residual(q, t * m, lo, hi, w) < 1e-6 * max(1.0, t)
            order, best, spare = np.argsort(-m), lo.copy(), 1 - lo.sum()
            for k in order:
                more = min(spare, hi[k] - lo[k])
                best[k], spare = best[k] + more, spare - more
            assert m @ path[-1][1] == pytest.approx(m @ best, abs=1e-9)


def tables(spark, seed=3, folds=3, n=3):
    rng = np.random.default_rng(seed)
    rows = [(f, f"i{k}", d, float(x)) for f in range(folds) for k in range(n) for d, x in enumerate(rng.normal(0.001 * (k + f), 0.01 * (k + 1), 60))]
    series = spark.createDataFrame(rows, "fold_id int, instrument string, date int, ret double")
    bounds = spark.createDataFrame([(f"i{k}", 0.05, 0.8) for k in range(n)], "instrument string, lo double, hi double")
    data = {f: np.array([[r[3] for r in rows if r[0] == f and r[1] == f"i{k}"] for k in range(n)]).T for f in range(folds)}
    return series, bounds, data


def grid(step=0.005):
    points = [(a, b, 1 - a - b) for a, b in itertools.product(np.arange(0.05, 0.8001, step), repeat=2)]
    return np.array([p for p in points if 0.05 - 1e-9 <= p[2] <= 0.8 + 1e-9])


@pytest.mark.parametrize("objective", ["min_risk", "max_return", "max_utility", "max_ratio"])
def test_objectives_beat_a_grid(spark, objective):
    series, bounds, data = tables(spark)
    found = {r.fold_id: r for r in fr.pick(fr.frontier(series, bounds, ["fold_id"]), ["fold_id"], objective).collect()}
    for f, x in data.items():
        m, q, g = x.mean(axis=0), np.cov(x.T), grid()
        e, v = g @ m, np.einsum("ij,jk,ik->i", g, q, g)
        score = {"min_risk": -np.sqrt(v), "max_return": e, "max_utility": e - 1.25 * v, "max_ratio": e / np.sqrt(v)}[objective]
        w = np.array(found[f].weights)
        own = {"min_risk": -np.sqrt(w @ q @ w), "max_return": m @ w, "max_utility": m @ w - 1.25 * w @ q @ w, "max_ratio": m @ w / np.sqrt(w @ q @ w)}[objective]
        assert own >= score.max() - 1e-10 and found[f].score == pytest.approx(own, abs=1e-9)
        assert own <= score.max() + 0.02 * abs(score.max()) + 1e-4
        assert w.sum() == pytest.approx(1) and w.min() >= 0.05 - 1e-9 and w.max() <= 0.8 + 1e-9


def test_exact_volatility(spark):
    series, bounds, data = tables(spark)
    steps = fr.frontier(series, bounds, ["fold_id"])
    for goal in (0.011, 0.015, 0.02, 0.022):
        for r in fr.pick(steps, ["fold_id"], "max_return", target=F.lit(goal), hard_fail=True).collect():
            x = data[r.fold_id]
            m, q, g = x.mean(axis=0), np.cov(x.T), grid()
            vol = np.sqrt(np.einsum("ij,jk,ik->i", g, q, g))
            near = np.abs(vol - goal) < 3e-5
            if r.route == "failed":
                assert r.weights is None and r.problem and not near.any()
                continue
            w = np.array(r.weights)
            assert abs(np.sqrt(w @ q @ w) - goal) < 2e-6 and w.sum() == pytest.approx(1)
            if r.route == "frontier" and near.any():
                assert m @ w >= (g @ m)[near].max() - 1e-5
    low = fr.pick(steps, ["fold_id"], "max_return", target=F.lit(1e-4)).collect()
    assert {r.route for r in low} == {"nearest"} and all(r.weights for r in low)


def test_bounds_that_cannot_be_met_are_rows_with_a_problem(spark):
    series, _, _ = tables(spark)
    bounds = spark.createDataFrame([("i0", 0.5, 0.8), ("i1", 0.6, 0.8), ("i2", 0.0, 1.0)], "instrument string, lo double, hi double")
    found = fr.pick(fr.frontier(series, bounds, ["fold_id"]), ["fold_id"], "min_risk").collect()
    assert {(r.route, r.problem, r.weights) for r in found} == {("failed", "lower bounds exceed the budget", None)} and len(found) == 3
    assert fr.frontier(series.where("false"), bounds, ["fold_id"]).count() == 0


@pytest.mark.parametrize("objective", ["min_risk", "max_return", "max_utility"])
def test_tracking_error_cap(spark, objective):
    series, bounds, data = tables(spark)
    base = np.array([0.2, 0.3, 0.5])
    reference = spark.createDataFrame([(f"i{k}", float(b)) for k, b in enumerate(base)], "instrument string, weight double")
    seen = set()
    for cap in (0.0005, 0.003, 0.05):
        for r in fr.capped(series, bounds, reference, ["fold_id"], objective, cap).collect():
            x = data[r.fold_id]
            m, q, g = x.mean(axis=0), np.cov(x.T), grid()
            w = np.array(r.weights)
            error = np.sqrt(np.einsum("ij,jk,ik->i", g - base, q, g - base))
            value = {"min_risk": lambda p: -p @ q @ p, "max_return": lambda p: m @ p, "max_utility": lambda p: m @ p - 1.25 * p @ q @ p}[objective]
            own = np.sqrt((w - base) @ q @ (w - base))
            assert own <= cap + 2e-6 and r.tev == pytest.approx(own**2, abs=1e-12)
            assert value(w) >= max(value(p) for p in g[error <= cap]) - 1e-7
            if r.status == "binding":
                assert own == pytest.approx(cap, abs=2e-6)
            seen.add(r.status)
    assert "binding" in seen and "slack" in seen
    away = spark.createDataFrame([("i0", 3.0), ("i1", -1.0), ("i2", -1.0)], "instrument string, weight double")
    assert {r.status for r in fr.capped(series, bounds, away, ["fold_id"], objective, 0.001).collect()} == {"nearest"}
    assert {(r.status, r.weights) for r in fr.capped(series, bounds, away, ["fold_id"], objective, 0.001, hard_fail=True).collect()} == {("failed", None)}


def test_audit_of_targets_caps_and_errors(spark):
    series, bounds, _ = tables(spark)
    reference = spark.createDataFrame([("i0", 0.2), ("i1", 0.3), ("i2", 0.5)], "instrument string, weight double")
    steps = fr.frontier(series, bounds, ["fold_id"], reference=reference)
    met = fr.pick(steps, ["fold_id"], "max_return", target=F.lit(0.015))
    for r in fr.full_audit(met, bounds, ["fold_id"], 252, "max_return", target=F.lit(0.015 * 252**0.5), te_cap=0.01).collect():
        assert r.target_status == "met" and r.tev_status == "missed" and r.cap_status == "not_requested" and r.objective == "max_return_at_target"
        assert r.soft_violation == pytest.approx(((r.annual_tev - 0.01) / 0.01) ** 2, rel=1e-3)
        assert r.sum_weights == pytest.approx(1) and min(r.lower_slack, r.upper_slack) > -1e-9
    low = fr.pick(steps, ["fold_id"], "max_return", target=F.lit(1e-4))
    assert {r.target_status for r in fr.full_audit(low, bounds, ["fold_id"], 252, "max_return", target=F.lit(1e-4 * 252**0.5)).collect()} == {"missed"}


@pytest.mark.parametrize("leverage", [1.0, 1.5])
def test_financing_is_solved_in_both_regimes(spark, leverage):
    series, bounds, data = tables(spark)
    rates = spark.createDataFrame([(f, 0.0001, 0.0004) for f in range(3)], "fold_id int, lend double, borrow double")
    solved, chosen = fr.financing(series, bounds.withColumn("lo", F.lit(0.0)).withColumn("hi", F.lit(leverage)), rates, ["fold_id"], "max_utility", leverage, aversion=4.0)
    rows = {(r.fold_id, r.regime): r for r in solved.collect()}
    assert len(rows) == (6 if leverage > 1 else 3)
    best = {}
    for (f, regime), r in rows.items():
        x, rate = data[f], 0.0001 if regime == "lend" else 0.0004
        w = dict(zip(r.names, r.weights))
        cash = w.pop("cash:LEND" if regime == "lend" else "cash:BORROW")
        assert cash >= -1e-9 if regime == "lend" else 1 - leverage - 1e-9 <= cash <= 1e-9
        full = np.column_stack([np.full(60, rate), x])
        q, m = np.cov(full.T), full.mean(axis=0)
        lo, hi = np.array([0.0 if regime == "lend" else 1 - leverage, 0, 0, 0]), np.array([1.0 if regime == "lend" else 0.0] + [leverage] * 3)
        ws = np.array([cash, *(w[f"i{k}"] for k in range(3))])
        assert residual(q * 4, m, lo, hi, ws) < 1e-6
        best[f] = max(best.get(f, -1), m @ ws - 2 * ws @ q @ ws - 0.0001)
    for r in chosen.collect():
        assert r.score == pytest.approx(best[r.fold_id], abs=1e-9) and r.cash + r.risky == pytest.approx(1)
        assert r.regime in ({"lend", "fully_invested"} if leverage == 1 else {"lend", "borrow", "fully_invested"})
