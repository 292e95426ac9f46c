import hashlib
import json
import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborfolio.operators import allocation as al
from arborfolio.operators import catalog as ca
from arborfolio.operators import hierarchy as hi
from arborfolio.operators import inference as inf
from arborfolio.operators import ledger as le
from arborfolio.operators import folds as fo
from arborfolio.operators import moments as mo
from arborfolio.operators import pruning as pru
from arborfolio.operators import regimes as rg


def days(n):
    return [date(2024, 1, 1) + timedelta(k) for k in range(n)]


def panel(spark, t=60, names="ABCD", seed=3, fold=1):
    r = np.random.default_rng(seed).normal(0.0004, 0.01, (t, len(names)))
    rows = [(fold, d, n, float(r[k, j])) for k, d in enumerate(days(t)) for j, n in enumerate(names)]
    return r, spark.createDataFrame(rows, "fold_id int, date date, instrument string, ret double")


def test_ledger_equals_a_plain_loop(spark):
    r, first = panel(spark, 30, "AB", 1)
    r2, second = panel(spark, 20, "AB", 2, fold=2)
    weights = {1: np.array([0.7, 0.3]), 2: np.array([0.2, 0.9])}
    targets = spark.createDataFrame([(f, "X", n, float(x)) for f, w in weights.items() for n, x in zip("AB", w)], "fold_id int, arm string, instrument string, weight double")
    grown = le.growth(targets, first.union(second))
    got = {(x.fold_id, x.date): x.ret for x in le.ledger_returns(grown).collect()}
    costs = {x.fold_id: x.turnover for x in le.turnover_costs(targets, le.drifted_weights(grown), 10).collect()}
    held = np.zeros(2)
    for f, rows in ((1, r), (2, r2)):
        assert costs[f] == pytest.approx(np.abs(weights[f] - held).sum())
        held = weights[f]
        for k, d in enumerate(days(len(rows))):
            day = held @ rows[k]
            assert got[f, d] == pytest.approx(day, abs=1e-12)
            held = held * (1 + rows[k]) / (1 + day)


def test_cost_is_taken_once(spark):
    returns = spark.createDataFrame([("X", 1, d, 0.01) for d in days(3)], "arm string, fold_id int, date date, ret double")
    costs = spark.createDataFrame([("X", 1, 1.4, 0.0014)], "arm string, fold_id int, turnover double, cost double")
    assert [round(x.ret, 6) for x in le.net_returns(returns, costs).orderBy("date").collect()] == [0.0086, 0.01, 0.01]


def test_metrics_and_drawdown(spark):
    v = np.random.default_rng(4).normal(0.0005, 0.01, 300)
    curves = spark.createDataFrame([("X", d, float(x)) for d, x in zip(days(300), v)], "arm string, date date, ret double")
    m = le.metrics(curves, ["arm"], F.lit(0.02)).first()
    excess, wealth = v - 0.02 / 252, np.cumprod(1 + v)
    assert m.cagr == pytest.approx(wealth[-1] ** (252 / 300) - 1) and m.annualized_sharpe == pytest.approx(excess.mean() / excess.std(ddof=1) * 252**0.5)
    assert m.annualized_sortino == pytest.approx(excess.mean() * 252 / (np.sqrt((np.minimum(excess, 0) ** 2).mean()) * 252**0.5))
    assert le.max_drawdown(curves, ["arm"]).first().max_drawdown == pytest.approx((wealth / np.maximum.accumulate(wealth) - 1).min())


def test_evidence_ends_before_the_signal(spark):
    curves = spark.createDataFrame([("X", d, r) for d, r in zip(days(4), (0.01, -0.005, 0.80, -0.90))], "arm string, date date, ret double")
    signals = spark.createDataFrame([(days(3)[2],)], "signal date")
    assert le.metrics_before(curves, signals).first().n_obs == 2 and le.metrics_before(curves, signals, inclusive=True).first().n_obs == 3


def test_moments_equal_numpy(spark):
    r, rows = panel(spark)
    cov = {(x.i, x.j): x.cov for x in mo.covariance(rows).collect()}
    want = np.cov(r.T, ddof=1)
    assert all(cov[a, b] == pytest.approx(want[i, j]) for i, a in enumerate("ABCD") for j, b in enumerate("ABCD"))
    x = r - r.mean(axis=0)
    s = x.T @ x / len(x)
    m = np.trace(s) / 4
    d2 = ((s - m * np.eye(4)) ** 2).sum()
    b2 = min(d2, sum(((np.outer(v, v) - s) ** 2).sum() for v in x) / len(x) ** 2)
    lw = {(q.i, q.j): q.cov for q in mo.ledoit_wolf(rows).collect()}
    done = (1 - b2 / d2) * s + b2 / d2 * m * np.eye(4)
    assert all(lw[a, b] == pytest.approx(done[i, j]) for i, a in enumerate("ABCD") for j, b in enumerate("ABCD"))


def test_moments_from_sums_equal_those_of_training_rows(spark):
    rng = np.random.default_rng(8)
    r = rng.normal(0.001, 0.02, (30, 3)) + [0.0, 0.5, -0.2]  # levels far from zero, where sums cancel
    panel_ = spark.createDataFrame([(d, n, float(v)) for d, row in zip(days(30), r) for n, v in zip("ABC", row)], "date date, instrument string, ret double")
    windows = {1: (1, 10), 2: (1, 20), 3: (11, 20), 4: (15, 16), 5: (7, 7), 6: (3, 29)}  # from the start, expanding, apart, two periods, one, overlapping
    folds = spark.createDataFrame([(f, a, b) for f, (a, b) in windows.items()], "fold_id int, first_e int, last_e int")
    sums = mo.fold_sums(panel_, folds, fo.estimation_ordinals(panel_)).persist()
    rows = fo.training_rows(folds, panel_).persist()
    cell = lambda frame, name: {(x.fold_id, x.i, x.j): x[name] for x in frame.collect()}
    for got, want, name in (
        (mo.covariance_of_sums(sums), mo.covariance(rows), "cov"), (mo.shrunk(mo.covariance_of_sums(sums, ddof=0)), mo.shrunk_covariance(rows), "cov"),
        (mo.ledoit_wolf_of_sums(sums.where("fold_id <> 5")), mo.ledoit_wolf(rows.where("fold_id <> 5")), "cov"), (mo.correlation_distance_of_sums(sums.where("fold_id <> 5")), mo.correlation_distance(rows.where("fold_id <> 5")), "rho"),
    ):
        a, b = cell(got, name), cell(want, name)
        assert a.keys() == b.keys() and all((a[k] is None and b[k] is None) or a[k] == pytest.approx(b[k], rel=1e-7, abs=1e-13) for k in a)
    assert mo.fold_sums(panel_.limit(0), folds.limit(0), fo.estimation_ordinals(panel_.limit(0))).count() == 0


def test_screening_equals_plain_loops(spark):
    r, rows = panel(spark)
    held = {"P": (0.5, 0.5, 0.0, 0.0), "Q": (0.1, 0.2, 0.3, 0.4)}
    candidates = spark.createDataFrame([(1, c, n, w) for c, ws in held.items() for n, w in zip("ABCD", ws) if w], "fold_id int, candidate string, instrument string, weight double")
    reference = spark.createDataFrame([(n, 0.25) for n in "ABCD"], "instrument string, weight double")
    got = {x.candidate: x for x in al.screen(candidates, rows, mo.mean(rows), mo.covariance(rows), reference).collect()}
    for c, ws in held.items():
        day, w = r @ ws, np.array(ws)
        assert got[c].expected == pytest.approx(day.mean()) and got[c].realized_vol == pytest.approx(day.std(ddof=1))
        assert got[c].model_vol == pytest.approx(np.sqrt(w @ np.cov(r.T) @ w)) and got[c].tracking_error == pytest.approx((day - r.mean(axis=1)).std(ddof=1))
    assert al.screen(candidates.limit(0), rows, mo.mean(rows), mo.covariance(rows), reference).count() == 0


def test_views_closed_form_equals_matrix_form(spark):
    _, rows = panel(spark)
    cov, mu = mo.covariance(rows).persist(), mo.mean(rows).persist()
    view = spark.createDataFrame([("A", 1.0), ("B", -1.0)], "instrument string, coef double")
    one = {x.instrument: x.mu for x in mo.single_view_mean(cov, mu, view, 0.001, 0.6).collect()}
    stated = spark.createDataFrame([(1, "A", 1.0, 0.001, 0.6), (1, "B", -1.0, 0.001, 0.6)], "view_id int, instrument string, coef double, q double, confidence double")
    many = {x.instrument: x.mu for x in mo.multi_view_mean(cov, mu, stated).collect()}
    assert all(one[n] == pytest.approx(many[n], abs=1e-12) for n in "ABCD")


def test_shrunk_means_stay_between_mean_and_anchor(spark):
    r, rows = panel(spark)
    for method in ("bayes_stein", "james_stein"):
        got = np.array([x.mu for x in mo.shrunk_means(rows, method).orderBy("instrument").collect()])
        assert got.std() <= r.mean(axis=0).std() + 1e-12


def test_bounded_rules(spark):
    b = spark.createDataFrame([("k", "A", 0.1, 0.5), ("k", "B", 0.0, 0.4), ("k", "C", 0.2, 0.6)], "key string, instrument string, lo double, hi double")
    mu = spark.createDataFrame([("k", "A", 0.3), ("k", "B", 0.2), ("k", "C", 0.1)], "key string, instrument string, mu double")
    assert {x.instrument: round(x.weight, 9) for x in al.max_return(mu, b, ["key"]).collect()} == {"A": 0.5, "B": 0.3, "C": 0.2}
    filled = {x.instrument: round(x.weight, 9) for x in al.water_fill(b, ["key"]).collect()}
    assert sum(filled.values()) == pytest.approx(1) and filled == {"A": round(0.1 + 0.7 / 3, 9), "B": round(0.7 / 3, 9), "C": round(0.2 + 0.7 / 3, 9)}
    tight = spark.createDataFrame([("k", "A", 0.0, 0.1), ("k", "B", 0.0, 1.0)], "key string, instrument string, lo double, hi double")
    assert {x.instrument: round(x.weight, 9) for x in al.water_fill(tight, ["key"]).collect()} == {"A": 0.1, "B": 0.9}


def test_minimum_variance_meets_its_conditions(spark):
    r, rows = panel(spark)
    w = np.array([x.weight for x in al.minimum_variance(mo.covariance(rows)).orderBy("instrument").collect()])
    g = np.cov(r.T, ddof=1) @ w
    assert w.sum() == pytest.approx(1) and (w >= 0).all()
    assert np.ptp(g[w > 1e-6]) < 1e-8 and (g >= g[w > 1e-6].min() - 1e-8).all()


def test_bootstrap_intervals_and_small_samples(spark):
    rng = np.random.default_rng(0)
    rows = [("GOOD", d, float(x + 0.002), float(x)) for d, x in zip(days(120), rng.normal(0, 0.001, 120))] + [("FEW", d, 0.01, 0.0) for d in days(20)]
    paired = spark.createDataFrame(rows, "arm string, date date, c double, b double").withColumn("diff", F.col("c") - F.col("b"))
    got = {x.arm: x for x in inf.bootstrap(paired, ["arm"], 100).collect()}
    assert got["GOOD"].mean_lo == pytest.approx(0.002 * 252) and got["FEW"].mean_p is None and got["FEW"].note
    again = {x.arm: x for x in inf.bootstrap(paired.orderBy(F.desc("date")), ["arm"], 100).collect()}
    assert again["GOOD"].sharpe_hi == pytest.approx(got["GOOD"].sharpe_hi)


def test_holm_does_not_depend_on_order(spark):
    rows = [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)]
    want = {"a": 0.03, "b": 0.06, "c": 0.06, "d": None}
    for order in (rows, rows[::-1]):
        got = {x.test: x.adjusted for x in inf.holm(spark.createDataFrame(order, "test string, p double")).collect()}
        assert {k: v if v is None else round(v, 9) for k, v in got.items()} == want


def test_pruning_decisions(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    rows = [(p, n, s, sh, dd, 0.1) for p in ("rolling", "expanding") for n, s, sh, dd in (("a", "NODE", 0.6, -0.1), ("a", "FATHER", 0.5, -0.1), ("b", "NODE", 0.51, -0.1), ("b", "FATHER", 0.5, -0.1))]
    measured = spark.createDataFrame(rows, "protocol string, node_id string, side string, sharpe double, max_drawdown double, volatility double")
    got = {x.node_id: x for x in pru.decisions(pru.observations(nodes, measured, ["rolling", "expanding"])).collect()}
    assert (got["a"].decision, got["b"].decision, got["c"].decision) == ("retain", "prune", "prune") and "missing" in got["c"].reason


def test_contraction_lifts_once_and_cuts_twice(spark):
    tree = spark.createDataFrame([("R", None, 0), ("p", "R", 1), ("k", "R", 1), ("up", "p", 2), ("pp", "p", 2), ("cut", "pp", 3), ("leaf", "cut", 4), ("ok", "k", 2)], "node_id string, parent_id string, depth int")
    decided = spark.createDataFrame([("p", "prune"), ("k", "retain"), ("up", "retain"), ("pp", "prune"), ("cut", "retain"), ("leaf", "retain"), ("ok", "retain")], "node_id string, decision string")
    got = {x.node_id: (x.action, x.new_parent) for x in pru.contraction(tree, decided).collect()}
    assert got["p"][0] == "contracted" and got["up"] == ("lifted", "R") and got["pp"][0] == "removed_with_ancestor"
    assert got["cut"][0] == got["leaf"][0] == "removed_with_ancestor" and got["ok"] == ("kept", "k") and got["k"] == ("kept", "R")


def test_hierarchical_risk_parity(spark):
    assert al.ward_order(np.array([[0, 9, 1, 9], [9, 0, 9, 2], [1, 9, 0, 9], [9, 2, 9, 0.0]])) == [0, 2, 1, 3]
    s = np.diag([1.0, 4.0, 1.0, 4.0])
    s[0, 2] = s[2, 0] = 0.5
    rows = [(f, f"n{i}", f"n{j}", float(s[i, j]) * (f + 1)) for f in range(2) for i in range(4) for j in range(4)]
    got = al.hierarchical_risk_parity(spark.createDataFrame(rows, "fold_id int, i string, j string, cov double")).collect()
    for f in range(2):
        w = np.array([r.weight for r in sorted(got, key=lambda r: r.instrument) if r.fold_id == f])
        # halves {0, 2} and {1, 3}: variances 0.75 and 2, so 8/11 and 3/11, each split evenly
        assert np.allclose(w, [4 / 11, 1.5 / 11, 4 / 11, 1.5 / 11])


def test_baseline_arms_are_invested_and_of_least_variance(spark):
    from arborfolio.plans import tree_queries as tq
    from arborfolio.plans.risk_queries import covariances

    sf = "/root/testdata/sf0.001"
    arms = tq.baseline_arms(spark, sf).toPandas()
    assert set(arms.arm) == {"EQUAL_WEIGHT", "DECLARED_BENCHMARK", "SAMPLE_MIN_VARIANCE", "SHRUNK_FIXED_MIN_VARIANCE", "LEDOIT_WOLF_MIN_VARIANCE", "HRP_WARD_PEARSON"}
    assert np.allclose(arms.groupby(["arm", "fold_id"]).weight.sum(), 1) and (arms.weight >= -1e-12).all()
    cov = covariances(spark, sf).toPandas()
    for fold, rows in arms[arms.arm == "SAMPLE_MIN_VARIANCE"].groupby("fold_id"):
        s = cov[cov.fold_id == fold].pivot(index="i", columns="j", values="cov")
        w = rows.set_index("instrument").weight.reindex(s.index).to_numpy()
        slope = s.to_numpy() @ w
        assert (slope >= w @ slope - 1e-6 * abs(w @ slope)).all()
    assert tq.baseline_curves(spark, sf).select("arm").distinct().count() == 6


def test_compose_weights(spark):
    root = spark.createDataFrame([("R",)], "node_id string")
    children = spark.createDataFrame([("R", "x", 0.6), ("R", "y", 0.3), ("x", "z", 0.5)], "parent_id string, child_id string, weight double")
    own = spark.createDataFrame([("R", "A", 0.1), ("x", "A", 0.5), ("y", "B", 1.0), ("z", "C", 1.0), ("z", "D", 0.0)], "node_id string, instrument string, weight double")
    got = {x.instrument: round(x.weight, 9) for x in hi.compose(root, children, own).collect()}
    assert got == {"A": 0.4, "B": 0.3, "C": 0.3}


def test_regimes(spark):
    rows = [(d, s, p) for d, s, p in zip(days(5), ("calm", "calm", "stress", "stress", "calm"), (0.0, 0.0, 1.0, 1.0, 0.0))]
    regimes = spark.createDataFrame(rows, "date date, state string, p double")
    assert [x.date.day for x in rg.transitions(regimes).orderBy("date").collect()] == [1, 3, 5]
    asked = spark.createDataFrame([(date(2023, 12, 1),), (days(3)[2],), (date(2025, 1, 1),)], "date date")
    assert [x.state for x in rg.as_of(asked, regimes).orderBy("date").collect()] == [None, "stress", "calm"]


def test_text_rules(spark):
    texts = {
        "mail a.b@c.org or 415-555-1234 or +1 (415) 555-1234, id 123456789": "mail [redacted-email] or [redacted-phone] or [redacted-phone], id [redacted-number]",
        "4155551234 1-415-555-1234 +494155551234": "[redacted-phone] [redacted-phone] [redacted-phone]",
        "card 123456789012 and 12345678": "card [redacted-number] and 12345678",
        "x1234567890.y@z.com": "[redacted-email]",
    }
    frame = spark.createDataFrame(list(texts.items()), "t string, want string")
    assert all(r[0] == r[1] for r in frame.select(ca.redact_pii(F.col("t")), "want").collect())
    entries = spark.createDataFrame([({"b": "1", "my_Token": "x", "a": "2"},)], "m map<string,string>")
    assert entries.select(ca.canonical_json(ca.redact_keys(F.col("m")))).first()[0] == '{"a":"2","b":"1","my_Token":"***"}'


def test_canonical_json_escapes(spark):
    maps = [{"a": 'x","b":"y'}, {"b": "y", "a": "x"}, {'q"\\': "l\n\té€"}, {"k": None}, {}]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i int, m map<string,string>").select("i", ca.canonical_json(F.col("m")), ca.content_hash(F.col("m"))).orderBy("i").collect()
    for m, (_, text, digest) in zip(maps, rows):
        assert text == json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert digest == "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def test_long_revision_chain_and_deep_trees(spark):
    revisions = spark.createDataFrame([(1, i, i, i - 1 if i else None) for i in range(31)] + [(2, 100, 1, 101), (2, 101, 0, 100)], "tree_id int, revision_id int, created int, parent_id int")
    got = [(r.tree_id, r.revision_id, r.step) for r in ca.revision_chain(revisions, ca.heads(revisions)).collect()]
    assert sorted(got) == sorted([(1, 30 - k, k) for k in range(31)] + [(2, 100, 0), (2, 101, 1)])
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(15)] + [("n9", "n3")], "parent_id string, child_id string")
    root = spark.createDataFrame([("n0",)], "node_id string")
    assert sorted(r.depth for r in hi.walk(edges, root).collect()) == list(range(16))
    shares = edges.withColumn("weight", F.lit(0.5))
    assert {r.node_id: r.weight for r in hi.node_weights(root, shares).collect()} == {f"n{i}": 0.5**i for i in range(16)}
    nodes = spark.createDataFrame([(f"n{i}", "x") for i in range(16)] + [("a", "x"), ("b", "x")], "node_id string, proxy string")
    broken = edges.union(spark.createDataFrame([("a", "b"), ("b", "a")], edges.schema))
    found = {(r.node_id, r.rule) for r in ca.tree_violations(nodes, broken, "n0").collect()}
    rest = {("a", "unreachable"), ("b", "unreachable"), ("n3", "two parents"), ("n3", "shared proxy"), ("n10", "shared proxy")}
    assert found == rest | {(n, "cycle") for n in ("a", "b", *(f"n{i}" for i in range(3, 10)))}


def test_proxies_names_and_instruments_of_a_tree(spark):
    nodes = spark.createDataFrame([("R", None, None), ("A", "p", "one"), ("B", "p", "two"), ("C", "q", "two"), ("D", "p", None)], "node_id string, proxy string, name string")
    edges = spark.createDataFrame([("R", "A"), ("R", "B"), ("R", "C"), ("C", "D")], "parent_id string, child_id string")
    held = spark.createDataFrame([("R", "q"), ("A", "x"), ("A", "x"), ("D", "p")], "node_id string, instrument string")
    found = {(r.node_id, r.rule) for r in ca.tree_violations(nodes, edges, "R", held).collect()}
    assert found == {("A", "shared proxy"), ("B", "shared proxy"), ("B", "duplicate name"), ("C", "duplicate name"), ("C", "colliding proxy"), ("A", "duplicate instrument")}


def brute_pass(slots, returns, backward):
    """Weights by node of one fold: every node takes the best means up to its bounds."""
    def solve(node):
        own = [s for s in slots if s[0] == node]
        series, weights = {}, {}
        for _, name, child, lo, hi_ in own:
            if child and backward:
                inner = solve(child)
                series[name + "_SYNTH"] = ([sum(x) for x in zip(*([w * v for v in inner[1][n]] for n, w in inner[0].items()))], lo, hi_)
            else:
                series[name] = (returns[name], lo, hi_)
        spare = 1 - sum(lo for _, lo, _ in series.values())
        for name in sorted(series, key=lambda n: (-sum(series[n][0]), n)):
            _, lo, hi_ = series[name]
            weights[name] = lo + min(spare, hi_ - lo)
            spare -= weights[name] - lo
        return weights, {n: v[0] for n, v in series.items()}

    return {node: solve(node)[0] for node in {s[0] for s in slots}}


def test_passes_over_a_tree_of_three_levels(spark):
    slots = [("R", "A", None, 0.1, 0.6), ("R", "P", "x", 0.1, 0.7), ("x", "B", None, 0.0, 0.8), ("x", "Q", "y", 0.2, 0.9), ("y", "C", None, 0.1, 0.9), ("y", "D", None, 0.1, 0.9)]
    rng = random.Random(4)
    returns = {(f, n): [rng.uniform(-0.1, 0.1) for _ in range(6)] for f in range(4) for n in "ABCDPQ"}
    rows = [(f, n, date(2024, 1, 1 + d), r) for (f, n), rs in returns.items() for d, r in enumerate(rs)]
    series = spark.createDataFrame(rows, "fold_id int, instrument string, date date, ret double")
    frame = spark.createDataFrame(slots, "node_id string, instrument string, child_id string, lo double, hi double")
    depths = spark.createDataFrame([("R", 0), ("x", 1), ("y", 2)], "node_id string, depth int")
    forward = hi.forward_pass(frame, series)
    passes = {"forward": forward, "backward": hi.backward_pass(frame, depths, series, forward=forward), "direct": hi.backward_pass(frame, depths, series)}
    found = {}
    for name, weights in passes.items():
        found[name] = {(r.fold_id, r.node_id, r.instrument): round(r.weight, 9) for r in weights.collect()}
        for f in range(4):
            for node, want in brute_pass(slots, {n: returns[f, n] for n in "ABCDPQ"}, name != "forward").items():
                assert {i: w for (g, m, i), w in found[name].items() if (g, m) == (f, node)} == {i: round(w, 9) for i, w in want.items()}
    assert found["backward"] == found["direct"] != found["forward"]
    held = hi.terminal_weights(passes["backward"], depths.select("node_id")).groupBy("fold_id", "top").agg(F.sum("weight").alias("w"), F.collect_set("instrument").alias("i")).collect()
    assert len(held) == 12 and all(abs(r.w - 1) < 1e-9 and not {"P", "Q"} & set(r.i) for r in held)


@pytest.mark.parametrize("inclusive", [False, True])
def test_metrics_before_equal_those_of_the_days_in_reach(spark, inclusive):
    start = date(2024, 1, 1)
    rows = [(a, start + timedelta(k), ((k * 13 + len(a)) % 7 - 3) / 100 if k != 4 else None) for a, n in (("A", 30), ("BB", 12)) for k in range(20 if a == "BB" else 0, 20 + n)]
    curves = spark.createDataFrame(rows, "arm string, date date, ret double")
    signals = [start, start + timedelta(9), start + timedelta(20), start + timedelta(25), start + timedelta(90)]
    got = {(r.arm, r.signal): r.asDict() for r in le.metrics_before(curves, spark.createDataFrame([(s,) for s in [*signals, signals[1]]], "signal date"), inclusive).collect()}
    want = {}
    for s in signals:
        seen = curves.where(F.col("date") <= s if inclusive else F.col("date") < s)
        deepest = {r.arm: r.max_drawdown for r in le.max_drawdown(seen, ["arm"]).collect()}
        want |= {(r.arm, s): {**r.asDict(), "signal": s, "max_drawdown": deepest[r.arm]} for r in le.metrics(seen, ["arm"]).collect()}
    assert got.keys() == want.keys() and len(got) >= 6
    for key, row in want.items():
        assert got[key] == pytest.approx(row)
