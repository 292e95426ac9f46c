import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborfolio.operators import adaptive as ad
from arborfolio.operators import catalog as ca
from arborfolio.operators import frontier as fr
from arborfolio.operators import hierarchy as hi
from arborfolio.operators import ledger as le
from arborfolio.operators import pruning as pru
from arborfolio.sources import exports as ex


def plain_metrics(ret):
    wealth = np.cumprod(1 + ret)
    sd = ret.std(ddof=1) if len(ret) > 1 else 0.0
    down = np.sqrt(np.mean(np.minimum(ret, 0) ** 2))
    return {
        "cagr": wealth[-1] ** (252 / len(ret)) - 1, "annualized_volatility": sd * 252**0.5, "annualized_sharpe": ret.mean() / sd * 252**0.5 if sd > 0 else 0.0,
        "annualized_sortino": ret.mean() * 252**0.5 / down if down > 0 else 0.0, "max_drawdown": (wealth / np.maximum.accumulate(wealth) - 1).min(), "n_obs": len(ret),
    }


@pytest.mark.parametrize("years, inclusive", [(1, False), (0.1, True), (None, False)])
def test_window_metrics_equal_plain_loops(spark, years, inclusive):
    rng = np.random.default_rng(1)
    days = pd.bdate_range("2020-01-01", periods=700)
    curves = {"A": pd.Series(rng.normal(0.0005, 0.01, 700), days), "B": pd.Series(rng.normal(0, 0.02, 300), days[200:500]), "C": pd.Series([0.01], days[:1])}
    rows = [(a, d.date(), float(v)) for a, c in curves.items() for d, v in c.items()]
    signals = [days[k] for k in (0, 1, 2, 130, 333, 500, 699)] + [pd.Timestamp("2021-08-01")]
    frame = spark.createDataFrame(rows, "arm string, date date, ret double").repartition(5)
    got = {(r.arm, pd.Timestamp(r.signal)): r for r in ad.window_metrics(frame, spark.createDataFrame([(s.date(),) for s in signals], "signal date"), years, inclusive).collect()}
    want = {}
    for a, c in curves.items():
        for s in signals:
            start = pd.Timestamp.min if years is None else s - pd.DateOffset(years=years) if float(years).is_integer() else s - pd.Timedelta(days=int(years * 365.2425))
            own = c[(c.index <= s if inclusive else c.index < s) & (c.index >= start)]
            if len(own):
                want[a, s] = plain_metrics(own.to_numpy())
    assert set(got) == set(want)
    for k, w in want.items():
        for name, value in w.items():
            assert got[k][name] == pytest.approx(value, rel=1e-7, abs=1e-9), (k, name)


def test_common_dates_leave_what_both_sides_have(spark):
    rows = [("NODE:a", 1), ("NODE:a", 2), ("FATHER:a", 2), ("FATHER:a", 3), ("NODE:b", 2), ("FINAL", 2)]
    curves = spark.createDataFrame([(a, f"2020-01-0{d}", 0.1) for a, d in rows], "arm string, date string, ret double")
    assert sorted((r.arm, r.date) for r in ad.common_dates(curves).collect()) == [("FATHER:a", "2020-01-02"), ("NODE:a", "2020-01-02")]


SLOT = "node_id string, instrument string, child_id string, lo double, hi double"


def tree(spark):
    return spark.createDataFrame(
        [("R", "r1", None, 0.1, 0.9), ("R", "pa", "A", 0.1, 0.7), ("R", "pb", "B", 0.2, 0.6), ("A", "a1", None, 0.0, 1.0), ("A", "pc", "C", 0.1, 0.8), ("B", "b1", None, 0.0, 1.0), ("B", "b2", None, 0.0, 0.5), ("C", "c1", None, 0.0, 1.0), ("C", "pd", "D", 0.0, 0.4), ("D", "d1", None, 0.0, 1.0)], SLOT
    )


@pytest.mark.parametrize(
    "pruned, actions, slots",
    [
        ("", {"A": "kept", "B": "kept", "C": "kept", "D": "kept"}, {("R", "r1", None), ("R", "pa", "A"), ("R", "pb", "B"), ("A", "a1", None), ("A", "pc", "C"), ("B", "b1", None), ("B", "b2", None), ("C", "c1", None), ("C", "pd", "D"), ("D", "d1", None)}),
        ("A", {"A": "contracted", "B": "kept", "C": "lifted", "D": "kept"}, {("R", "r1", None), ("R", "pa", None), ("R", "pb", "B"), ("R", "pc", "C"), ("B", "b1", None), ("B", "b2", None), ("C", "c1", None), ("C", "pd", "D"), ("D", "d1", None)}),
        ("AC", {"A": "contracted", "B": "kept", "C": "removed_with_ancestor", "D": "removed_with_ancestor"}, {("R", "r1", None), ("R", "pa", None), ("R", "pb", "B"), ("B", "b1", None), ("B", "b2", None)}),
        ("CB", {"A": "kept", "B": "contracted", "C": "contracted", "D": "lifted"}, {("R", "r1", None), ("R", "pa", "A"), ("R", "pb", None), ("A", "a1", None), ("A", "pc", None), ("A", "pd", "D"), ("D", "d1", None)}),
    ],
)
def test_contraction_promotes_proxies_and_moves_slots(spark, pruned, actions, slots):
    decided = spark.createDataFrame([(f, n, "prune" if n in pruned and f == 1 else "retain") for f in (1, 2) for n in "ABCD"], "fold_id int, node_id string, decision string")
    acted, own = ad.fold_trees(tree(spark), decided)
    assert {r.node_id: r.action for r in acted.where("fold_id = 1").collect()} == actions
    assert {(r.node_id, r.instrument, r.child_id) for r in own.where("fold_id = 1").collect()} == slots
    assert own.where("fold_id = 2").count() == 10
    bounds = {r.instrument: (r.lo, r.hi) for r in own.where("fold_id = 1 AND node_id = 'R'").collect()}
    assert bounds["pa"] == (0.1, 0.7)


def test_a_promoted_proxy_that_is_held_already_stays_once(spark):
    slots = spark.createDataFrame([("R", "p", None, 0.0, 0.3), ("R", "p2", "A", 0.1, 0.7), ("R", "p", "B", 0.2, 0.6), ("A", "a", None, 0.0, 1.0), ("B", "b", None, 0.0, 1.0)], SLOT)
    for gone, want in (("B", [("p", None, 0.3), ("p2", "A", 0.7)]), ("", [("p", "B", 0.6), ("p2", "A", 0.7)])):
        decided = spark.createDataFrame([(1, n, "prune" if n == gone else "retain") for n in "AB"], "fold_id int, node_id string, decision string")
        own = ad.fold_trees(slots, decided)[1].where("node_id = 'R'")
        assert sorted((r.instrument, r.child_id, r.hi) for r in own.collect()) == want


def test_adaptive_run_leaves_the_burn_in_and_looks_only_back(spark):
    rng = np.random.default_rng(3)
    names = ["r1", "pa", "pb", "pc", "pd", "a1", "b1", "b2", "c1", "d1"]
    folds = spark.createDataFrame([(f, pd.Timestamp(2020, f, 1).date(), pd.Timestamp(2020, f, 2).date()) for f in range(1, 7)], "fold_id int, signal date, holding_start date")
    data = [(f, n, pd.Timestamp(2019, 1, d + 1).date(), float(x)) for f in range(1, 7) for n in names for d, x in enumerate(rng.normal(0, 0.01, 20))]
    returns = spark.createDataFrame(data, "fold_id int, instrument string, date date, ret double")
    depths = spark.createDataFrame([("R", 0), ("A", 1), ("B", 1), ("C", 2), ("D", 3)], "node_id string, depth int")
    slots = tree(spark)
    forward = hi.forward_pass(slots, returns)
    backward = hi.backward_pass(slots, depths, returns, forward=forward)
    top = spark.createDataFrame([("R",)], "node_id string")
    static = hi.terminal_weights(backward, top).withColumn("arm", F.lit("FINAL")).unionByName(hi.terminal_weights(forward, top).withColumn("arm", F.lit("FORWARD_FINAL")))
    decide = lambda gone: spark.createDataFrame([(f, n, "prune" if (f, n) in gone else "retain") for f in range(1, 7) for n in "ABCD"], "fold_id int, node_id string, decision string")
    plain = lambda frame: {(r.fold_id, r.arm, r.instrument): pytest.approx(r.weight, abs=1e-12) for r in frame.collect()}
    run = ad.adaptive_run(slots, depths, returns, folds, static, decide({(2, "A"), (5, "B"), (6, "A"), (6, "B"), (6, "C")}), 0.2)
    assert {r.fold_id for r in run.where("burn_in").collect()} == {1, 2, 3}
    got, before = plain(run), plain(static)
    for f in (1, 2, 3, 4):
        assert {k: v for k, v in got.items() if k[0] == f} == {k: v for k, v in before.items() if k[0] == f}
    assert {k[2] for k in got if k[:2] == (6, "FINAL")} <= {"r1", "pa", "pb"}
    assert not any(k[0] == 5 and k[2] in ("b1", "b2") for k in got)
    for f in range(1, 7):
        assert sum(r.weight for r in run.where(f"fold_id = {f} AND arm = 'FINAL'").collect()) == pytest.approx(1)


def test_decisions_need_evidence(spark):
    days = pd.bdate_range("2020-01-01", periods=300)
    rng = np.random.default_rng(5)
    rows = [(arm, d.date(), float(m + x)) for arm, m in (("NODE:good", 0.003), ("FATHER:good", 0.0), ("NODE:bad", -0.002), ("FATHER:bad", 0.0), ("NODE:alone", 0.01)) for d, x in zip(days, rng.normal(0, 0.005, 300))]
    folds = spark.createDataFrame([(1, days[0].date()), (2, days[250].date())], "fold_id int, signal date")
    nodes = spark.createDataFrame([("good",), ("bad",), ("alone",)], "node_id string")
    got = {(r.fold_id, r.node_id): r.decision for r in ad.fold_decisions(spark.createDataFrame(rows, "arm string, date date, ret double"), folds, nodes, 1).collect()}
    assert got == {(1, "good"): "prune", (1, "bad"): "prune", (1, "alone"): "prune", (2, "good"): "retain", (2, "bad"): "prune", (2, "alone"): "prune"}
    assert pru.pruned_edges(spark.createDataFrame([("x", "kept", "p")], "node_id string, action string, new_parent string")).count() == 1


def test_recurrence_equals_closed_form(spark):
    rng = np.random.default_rng(7)
    days = pd.bdate_range("2020-01-01", periods=30)
    holding = spark.createDataFrame([(f, d.date(), i, float(x) if x < 0.02 else None) for f in (1, 2) for i in "xyz" for d, x in zip(days[15 * f - 15 : 15 * f], rng.normal(0, 0.01, 15))], "fold_id int, date date, instrument string, ret double")
    targets = spark.createDataFrame([(f, "FINAL", i, w) for f in (1, 2) for i, w in (("x", 0.5), ("y", 0.8), ("z", -0.3))], "fold_id int, arm string, instrument string, weight double")
    curves = le.ledger_returns(le.growth(targets, holding))
    want = {(r.fold_id, r.date): r.ret for r in curves.collect()}
    got = {(r.fold_id, r.date): r.ret for r in le.recurrence_returns(targets, holding).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-14) for k in want)
    assert le.reconciled(curves, targets, holding).count() == 0
    off = curves.withColumn("ret", F.col("ret") + F.when(F.col("fold_id") == 2, 1e-3).otherwise(0.0)).where(F.col("date") > F.lit(days[0].date()))
    assert {(r.fold_id, r.problem) for r in le.reconciled(off, targets, holding).collect()} == {(1, "dates differ"), (2, "returns differ")}


def test_exports_are_published_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "export")
    rows = spark.createDataFrame([("a", 2020, 1.0), ("a", 2020, 1.0), ("b", 2021, None)], "arm string, year int, ret double")
    ex.write_export({"curves": (rows, ["arm", "year"]), "costs": (rows.where("false"), [])}, path)
    told = {r.name: (r.n_rows, r.verified) for r in ex.verify_export(spark, path).collect()}
    assert told == {"curves": (3, True), "costs": (0, True)}
    assert sorted(map(str, map(tuple, ex.read_export(spark, path, "curves").collect()))) == sorted(map(str, map(tuple, rows.collect())))
    before = ex.manifest_of(spark, path)
    checksum = before["tables"]["curves"]["checksum"]
    assert checksum == str(sum(r[0] for r in rows.select(F.xxhash64("arm", "ret", "year")).collect()))
    with pytest.raises(Exception):
        ex.write_export({"curves": (rows.withColumn("ret", F.raise_error(F.lit("broken")).cast("double")), [])}, path)
    assert ex.manifest_of(spark, path) == before
    with pytest.raises(FileNotFoundError):
        ex.manifest_of(spark, str(tmp_path / "none"))
    folder = tmp_path / "export" / before["tables"]["curves"]["folder"]
    lost = next(folder.rglob("part-*.parquet"))
    lost.unlink()
    assert {r.name: r.verified for r in ex.verify_export(spark, path).collect()} == {"curves": False, "costs": True}


def test_a_chain_of_ten_thousand_steps_takes_few_jobs(spark):
    n = 10_000
    revisions = spark.range(n).select(F.lit(1).alias("tree_id"), F.col("id").alias("revision_id"), F.col("id").alias("created"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    group = "chain"
    spark.sparkContext.setJobGroup(group, group)
    rows = ca.revision_chain(revisions, ca.heads(revisions)).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r.step, r.revision_id) for r in rows) == [(k, n - 1 - k) for k in range(n)]
    assert jobs < 120


def test_views_without_effect(spark):
    rng = np.random.default_rng(9)
    series = spark.createDataFrame([(1, i, d, float(x)) for i in "xyz" for d, x in enumerate(rng.normal(0.001, 0.01, 50))], "fold_id int, instrument string, date int, ret double")
    bounds = spark.createDataFrame([(i, 0.0, 1.0) for i in "xyz"], "instrument string, lo double, hi double")
    mu = series.groupBy("fold_id", "instrument").agg(F.avg("ret").alias("mu"))
    viewed = mu.withColumn("view_id", F.lit(1)).unionByName(mu.withColumn("view_id", F.lit(2)).withColumn("mu", F.when(F.col("instrument") == "x", 0.01).otherwise(F.col("mu"))))
    got = {r.view_id: (r.problem, r.most_moved > 0.01) for r in fr.view_effects(series, bounds, viewed, ["fold_id"], "max_utility").collect()}
    assert got == {"1": ("no effect on weights", False), "2": (None, True)}
