from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from arborfolio.functions.periods import last_business_day, period_is_complete, period_label
from arborfolio.operators import folds as fo
from arborfolio.operators import panel as pa
from arborfolio.sources import prices as pr

LEVELS = "date date, instrument string, level double"


def days(n, start=date(2024, 1, 1)):
    return [start + timedelta(k) for k in range(n)]


def frame(spark, columns):
    n = len(next(iter(columns.values())))
    return spark.createDataFrame([(d, name, v) for name, values in columns.items() for d, v in zip(days(n), values) if v is not None], LEVELS)


def test_interior_gap_gives_zero_then_return(spark):
    levels = frame(spark, {"US": [100.0, 101.0, 102.0], "LOCAL": [100.0, None, 101.0]})
    got = {r.date: r.ret for r in pa.simple_returns(pa.align(levels)).where("instrument = 'LOCAL'").collect()}
    assert [got[d] for d in days(3)][1] == 0.0 and got[days(3)[2]] == pytest.approx(0.01)


def test_live_edge_and_long_gap(spark):
    edge = pa.align(frame(spark, {"US": [1.0, 1.0, 1.0], "LOCAL": [1.0, 1.0, None]}))
    assert tuple(pa.alignment_counters(edge).first()) == (0, 1)
    long = pa.align(frame(spark, {"US": [1.0] * 8, "LOCAL": [1.0, *[None] * 6, 2.0]}))
    assert tuple(pa.alignment_counters(long).first()) == (5, 0)
    leading = pa.align(frame(spark, {"US": [1.0] * 3, "LOCAL": [None, 1.0, 1.0]}))
    assert leading.where("instrument = 'LOCAL' AND level IS NULL").count() == 1


def test_currency_conversion(spark):
    levels = frame(spark, {"X": [20.0, 21.0, 19.5], "Y": [80.0, 84.0, 82.0]})
    native = spark.createDataFrame([("X", "GBP"), ("Y", "USD")], "instrument string, currency string")
    pound = [1.25, 1.28, 1.2]
    rates = spark.createDataFrame([(d, c, r) for d, p in zip(days(3), pound) for c, r in (("GBP", p), ("USD", 1.0))], "date date, currency string, usd_per_unit double")
    for target, want in (("USD", [25.0, 26.88, 23.4, 80.0, 84.0, 82.0]), ("GBP", [20.0, 21.0, 19.5, 64.0, 65.625, 82.0 / 1.2])):
        got = pa.convert_levels(levels, native, rates, target).orderBy("instrument", "date").collect()
        assert [r.level for r in got] == pytest.approx(want)


def test_yen_is_turned_over(spark):
    pairs = spark.createDataFrame([(days(1)[0], "USDJPY=X", "JPY", 150.0), (days(1)[0], "EURUSD=X", "EUR", 1.1)], "date date, pair string, currency string, level double")
    got = {r.currency: r.usd_per_unit for r in pr.usd_per_unit(pairs).collect()}
    assert got == {"JPY": 1 / 150.0, "EUR": 1.1, "USD": 1.0}


def test_period_rules(spark):
    rows = spark.createDataFrame([(date(2024, 3, 29),), (date(2024, 3, 30),), (date(2024, 6, 28),), (date(2024, 12, 31),)], "d date")
    got = rows.select(*(period_label(F.col("d"), f) for f in "DWMQ"), last_business_day(F.last_day("d")), *(period_is_complete(F.col("d"), f) for f in "WMQ")).collect()
    assert tuple(got[0]) == (date(2024, 3, 29), date(2024, 3, 29), date(2024, 3, 31), date(2024, 3, 31), date(2024, 3, 29), True, True, True)
    assert got[1][1] == date(2024, 4, 5) and tuple(got[1])[5:] == (False, False, False)
    assert tuple(got[2])[4:] == (date(2024, 6, 28), True, True, True) and tuple(got[3])[5:] == (False, True, True)


def walk_forward(spark, n, train, expanding=False):
    rows = [(d, i, 0.001 * ((k * 7 + j) % 5 - 2)) for k, d in enumerate(days(n)) for j, i in enumerate(("A", "B"))]
    v = spark.createDataFrame(rows, "date date, instrument string, ret double")
    w = fo.resample(v, "W")
    return v, w, fo.folds(v, w, fo.rebalance_schedule(v, "M"), train, expanding)


@pytest.mark.parametrize("expanding", [False, True])
def test_folds_equal_a_plain_loop(spark, expanding):
    v, w, got = walk_forward(spark, 200, 6, expanding)
    weeks = sorted({r.date for r in w.collect()})
    ds = sorted({r.date for r in v.collect()})
    signals = sorted(r.signal for r in fo.rebalance_schedule(v, "M").collect())
    want = []
    for s, nxt in zip(signals, signals[1:]):
        past = [x for x in weeks if x <= s]
        held = [d for d in ds if s < d <= nxt]
        if len(past) >= 6 and held:
            want.append((s, past[0] if expanding else past[-6], past[-1], held[0], held[-1]))
    rows = got.orderBy("fold_id").collect()
    assert [(r.signal, r.training_start, r.training_end, r.holding_start, r.holding_end) for r in rows] == want
    sizes = {r.fold_id: r["count"] for r in fo.training_rows(got, w).groupBy("fold_id").count().collect()}
    assert sizes == {r.fold_id: 2 * (r.last_e - r.first_e + 1) for r in rows}
    held = {r.fold_id: r["count"] for r in fo.holding_rows(got, v).groupBy("fold_id").count().collect()}
    assert held == {r.fold_id: 2 * ((r.holding_end - r.holding_start).days + 1) for r in rows}


def test_future_rows_do_not_change_past_folds(spark):
    _, _, short = walk_forward(spark, 160, 6)
    _, _, long = walk_forward(spark, 260, 6)
    early = {tuple(r) for r in short.drop("next_signal").collect()}
    assert early and early <= {tuple(r) for r in long.drop("next_signal").collect()}


def test_canonical_ids(spark):
    names = spark.createDataFrame([("abc",), (" ticker:ABC",), ("macro:x",), ("Ticker:q",)], "name string")
    got = {r.instrument: (r.n, r.problem) for r in pa.canonical_ids(names).collect()}
    assert got == {"ticker:ABC": (2, "duplicate"), "macro:x": (1, "foreign"), "ticker:Q": (1, None)}


def test_short_panels_are_an_error(spark):
    metadata = pa.dataset_metadata(pa.align(frame(spark, {"A": [1.0, 2.0]})))
    with pytest.raises(ValueError, match="complete rows"):
        pa.check_dataset(metadata, 1)
