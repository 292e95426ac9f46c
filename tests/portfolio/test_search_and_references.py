import hashlib
import json
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborfolio.operators import allocation as al
from arborfolio.operators import catalog as ca
from arborfolio.operators import frontier as fr
from arborfolio.operators import hierarchy as hi
from arborfolio.operators import ledger as le
from arborfolio.operators import regimes as rg


def days(n):
    return [date(2024, 1, 1) + timedelta(k) for k in range(n)]


@pytest.fixture(scope="module")
def catalog(spark):
    listings = spark.createDataFrame([("AAA", "X", None), ("AAA", "B", None), ("BBB", "X", None), ("CCC", "X", date(2020, 1, 1)), ("DDD", "X", None)], "symbol string, exchange string, active_to date")
    instruments = spark.createDataFrame([("AAA", "First", "etf"), ("BBB", "an AAA like fund", "etf"), ("CCC", "Gone", "etf"), ("DDD", None, None)], "symbol string, name string, kind string")
    classes = spark.createDataFrame([("aaa", "Equity", "World", None, None, None, None), ("BBB", "Bonds", "Europe", "g_v", None, None, "green")], "symbol string, asset_class string, area string, category string, sub_group string, sector string, theme string")
    coverage = spark.createDataFrame([("AAA", 100, date(2001, 1, 1), date(2024, 1, 1)), ("BBB", 5, date(2020, 1, 1), date(2024, 1, 1))], "symbol string, observations long, first_date date, last_date date")
    return listings, instruments, classes, coverage


@pytest.mark.parametrize(
    "text,least,start,limit,want",
    [
        ("aaa", 0, None, 100, [("AAA", "B"), ("AAA", "X"), ("BBB", "X")]), ("bbb", 0, None, 100, [("BBB", "X")]), ("GREEN", 0, None, 100, [("BBB", "X")]), ("etf", 0, None, 100, []), ("ccc", 0, None, 100, []),
        ("G_V", 0, None, 100, [("BBB", "X")]), ("w_rld", 0, None, 100, [("AAA", "B"), ("AAA", "X")]), ("a", 0, None, 100, []), ("", 6, None, 100, [("AAA", "B"), ("AAA", "X")]), ("", 0, "2020-01-01", 100, [("AAA", "B"), ("AAA", "X"), ("BBB", "X")]),
        ("", 0, "2019-12-31", 1, [("AAA", "B")]), (" ddd ", 0, None, 0, [("DDD", "X")]), ("ddd", 0, "2024-01-01", 100, []),
    ],
)
def test_search_fields_days_and_order(catalog, text, least, start, limit, want):
    found = ca.search(*catalog, text, least, start, limit).collect()
    assert [(r.symbol, r.exchange) for r in found] == want


def test_fingerprints_of_trees(spark):
    universes = [(1, "ticker:b"), (1, " Ticker: a "), (1, "A"), (1, "none"), (2, None), (3, "x"), (3, None), (4, "b")]
    rows = [("a", date(2024, 1, 2), 7, "r1"), ("B", date(2024, 1, 5), 9, None), ("C", date(2025, 1, 1), 1, "r")]
    coverage = spark.createDataFrame(rows, "symbol string, last_date date, observations long, run string")
    got = {r.tree_id: (r.as_of, r.fingerprint) for r in ca.fingerprints(spark.createDataFrame(universes, "tree_id int, instrument string"), coverage).collect()}
    digest = lambda lines: hashlib.sha256(json.dumps(lines, separators=(",", ":")).encode()).hexdigest()
    b = ["B", "2024-01-05", "9", "None"]
    assert got == {1: ("2024-01-05", digest([b, ["a", "2024-01-02", "7", "r1"]])), 2: (None, "no-instruments"), 3: (None, "no-coverage"), 4: ("2024-01-05", digest([b]))}
    changed = coverage.withColumn("run", F.coalesce("run", F.lit("r2")))
    assert {r.tree_id: r.fingerprint for r in ca.fingerprints(spark.createDataFrame(universes, "tree_id int, instrument string"), changed).collect()}[4] != got[4][1]


def test_relative_references(spark):
    rng = np.random.default_rng(2)
    r = {(f, n): rng.normal(0, 0.01, 12) for f in (1, 2) for n in "ABP"}
    returns = spark.createDataFrame([(f, n, d, float(x)) for (f, n), v in r.items() for d, x in zip(days(12), v)], "fold_id int, instrument string, date date, ret double")
    benchmark = spark.createDataFrame([("A", 0.25), ("B", 0.75)], "instrument string, weight double")
    forward = returns.where("instrument = 'B'").select("fold_id", "date", "ret")
    asked = [("R", True, None, k, None) for k in ("benchmark", "father_proxy", "forward_root_reference", None)] + [("n", False, "P", k, 0.1) for k in ("benchmark", "father_proxy", "forward_root_reference", "manual", "current_parent_synthetic", "aunt")] + [("m", False, "lost", "father_proxy", None)]
    nodes = spark.createDataFrame(asked, "node_id string, is_root boolean, proxy string, reference string, manual double")
    got = {(x.fold_id, x.node_id, x.reference): (x.target, x.problem) for x in al.reference_targets(nodes, returns, benchmark, forward, 252).collect()}
    assert len(got) == 2 * len(asked)
    for f in (1, 2):
        measured = {"benchmark": 0.25 * r[f, "A"] + 0.75 * r[f, "B"], "father_proxy": r[f, "P"], "forward_root_reference": r[f, "B"]}
        for kind, v in measured.items():
            assert got[f, "n", kind] == (pytest.approx(v.std(ddof=1) * 252**0.5), None)
        assert got[f, "n", "manual"] == (0.1, None) and got[f, "R", None] == (None, None) and got[f, "R", "benchmark"] == got[f, "n", "benchmark"]
        problems = {k: p for k, (t, p) in got.items() if k[0] == f and p}
        assert problems == {
            (f, "R", "father_proxy"): "father reference requires a proxy", (f, "R", "forward_root_reference"): "forward reference on the root", (f, "n", "current_parent_synthetic"): "reference is reserved",
            (f, "n", "aunt"): "unsupported reference", (f, "m", "father_proxy"): "reference series missing",
        }
        assert all(got[k][0] is None for k in problems)
    short = spark.createDataFrame([("A", 0.5), ("unknown", 0.5)], "instrument string, weight double")
    missing = al.reference_targets(nodes.where("node_id = 'R' AND reference = 'benchmark'"), returns, short, forward, 252).collect()
    assert [(x.target, x.problem) for x in missing] == [(None, "reference series missing")] * 2


def test_state_allocations_take_any_allocator(spark):
    n = 40
    state = ["stress" if k % 3 == 0 else "calm" for k in range(n)]
    rng = np.random.default_rng(5)
    r = {name: rng.normal(0.001, 0.01, n) for name in "ABC"}
    rows = [(f, d, name, float(r[name][k])) for f in (1, 2) for name in "ABC" for k, d in enumerate(days(n)) if f == 1 or state[k] == "calm" or k < 6]
    training = spark.createDataFrame(rows, "fold_id int, date date, instrument string, ret double")
    states = spark.createDataFrame(list(zip(days(n), state)), "date date, state string")
    signals = spark.createDataFrame([(1, 0.3), (2, 1.0)], "fold_id int, p double")
    bounds = spark.createDataFrame([(x, 0.1, 0.6) for x in "ABC"], "instrument string, lo double, hi double")

    def best(k):
        order = sorted("ABC", key=lambda x: -np.mean(r[x][k]))
        return dict(zip(order, (0.6, 0.3, 0.1)))

    stress, calm = ([k for k in range(n) if state[k] == s] for s in ("stress", "calm"))
    high, low = best(stress), best(calm)
    got = {(x.fold_id, x.instrument): x.weight for x in rg.blended(training, states, signals, bounds, hi.by_mean_return).collect()}
    for x in "ABC":
        assert got[1, x] == pytest.approx(0.3 * high[x] + 0.7 * low[x])
        assert got[2, x] == pytest.approx(low[x])  # two days of stress are too few, and the rest takes the whole
    for objective in ("min_risk", "max_utility"):
        other = rg.blended(training, states, signals, bounds, fr.allocator(objective)).groupBy("fold_id").agg(F.sum("weight").alias("w"), F.min("weight").alias("lo"), F.max("weight").alias("hi")).collect()
        assert len(other) == 2 and all(x.w == pytest.approx(1) and x.lo >= 0.1 - 1e-9 and x.hi <= 0.6 + 1e-9 for x in other)


def test_audit_series_of_a_fold(spark):
    returns = spark.createDataFrame([(1, n, d, x) for n, v in {"A": (0.1, 0.2), "B": (0.3, -0.1), "P": (0.05, 0.06)}.items() for d, x in zip(days(2), v)], "fold_id int, instrument string, date date, ret double")
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    forward = table([(1, "R", "A", 0.5), (1, "R", "P", 0.5), (1, "x", "B", 1.0)], "fold_id int, node_id string, instrument string, weight double")
    backward = table([(1, "R", "A", 0.4), (1, "R", "B", 0.6), (1, "x", "B", 1.0)], forward.schema)
    done = le.audit_series(returns, table([("A", 0.5), ("P", 0.5)], "instrument string, weight double"), table([("x", "P")], "node_id string, proxy string"), forward, backward, table([(1, "A", 0.5), (1, "B", 0.5)], "fold_id int, instrument string, weight double"))
    got = {}
    for r in done.orderBy("date").collect():
        got.setdefault(r.series, []).append(round(r.ret, 9))
    assert got == {
        "RAW:A": [0.1, 0.2], "RAW:B": [0.3, -0.1], "RAW:P": [0.05, 0.06], "REFERENCE:B0_RAW": [0.075, 0.13], "REFERENCE:FATHER:x": [0.05, 0.06], "FORWARD_OUTPUT:R": [0.075, 0.13], "FORWARD_OUTPUT:x": [0.3, -0.1],
        "RESULT_OUTPUT:R": [0.22, 0.02], "RESULT_OUTPUT:x": [0.3, -0.1], "BACKWARD_INPUT:P_SYNTH": [0.3, -0.1], "DIAGNOSTIC:B0_SYNTH": [0.2, 0.05],
    }
