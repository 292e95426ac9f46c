"""Queries on sources, panels, calendars and folds."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfolio.functions.periods import period_is_complete, period_label, rounded
from arborfolio.operators import folds as fo
from arborfolio.operators import panel as pa
from arborfolio.plans.registry import query, view
from arborfolio.sources import prices as pr
from arborfolio.sources.prices import table
from arborfolio.sources.written import shared

TRAIN = 52


def levels_sql(key: str, more: str = "JOIN part ON l_partkey = p_partkey") -> str:
    return f"""SELECT CAST(l_shipdate AS DATE) AS date, 'ticker:' || upper(trim({key})) AS instrument,
      round(100 * (1 + avg(l_discount) - avg(l_tax)), 8) AS level
      FROM lineitem {more} WHERE l_shipdate IS NOT NULL AND {key} IS NOT NULL GROUP BY 1, 2"""


view("type_levels", levels_sql("p_type"))
view("brand_levels", levels_sql("p_brand"))
view("nation_levels", levels_sql("n_name", "JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"))
for kind in ("type", "brand", "nation"):
    view(f"{kind}_grid", f"""SELECT d.date, u.instrument, l.level FROM (SELECT DISTINCT date FROM {kind}_levels) d
      CROSS JOIN (SELECT DISTINCT instrument FROM {kind}_levels) u LEFT JOIN {kind}_levels l USING (date, instrument)""")
    view(f"{kind}_filled", f"""SELECT date, instrument, level AS raw,
      last_value(level IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS level FROM {kind}_grid""")
    view(f"{kind}_aligned", f"""SELECT date, instrument, raw, last_seen, CASE WHEN date <= last_seen THEN level END AS level FROM (
      SELECT *, max(CASE WHEN raw IS NOT NULL THEN date END) OVER (PARTITION BY instrument) AS last_seen FROM {kind}_filled)""")
    view(f"{kind}_returns", f"SELECT date, instrument, level / lag(level) OVER (PARTITION BY instrument ORDER BY date) - 1 AS ret FROM {kind}_aligned")
    view(f"{kind}_valuation", f"""SELECT * FROM {kind}_returns WHERE date IN (SELECT date FROM {kind}_returns GROUP BY date
      HAVING count(ret) = (SELECT count(DISTINCT instrument) FROM {kind}_returns))""")

LABELS = {
    "D": "date",
    "W": "CAST(date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS DATE)",
    "M": "last_day(date)",
    "Q": "last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE))",
}
COMPLETE = {
    "W": "isodow(last_day) = 5",
    "M": "CAST(last_day(last_day) - CAST(greatest(isodow(last_day(last_day)) - 5, 0) AS INTEGER) AS DATE) = last_day",
    "Q": "CAST({q} - CAST(greatest(isodow({q}) - 5, 0) AS INTEGER) AS DATE) = last_day".replace("{q}", LABELS["Q"].replace("date,", "x,").replace("'quarter', date", "'quarter', last_day")),
}
COMPLETE["Q"] = COMPLETE["Q"].replace("x,", "date,")
for f in ("W", "M", "Q"):
    view(f"resampled_{f.lower()}", f"""SELECT date, instrument, ret FROM (SELECT *, count(*) OVER (PARTITION BY date) AS have FROM (
      SELECT {LABELS[f]} AS date, instrument, product(1 + ret) - 1 AS ret FROM type_valuation WHERE ret IS NOT NULL GROUP BY 1, 2))
      WHERE have = (SELECT count(DISTINCT instrument) FROM type_valuation)""")
    view(f"final_{f.lower()}", f"SELECT last_day, {LABELS[f].replace('date)', 'last_day)').replace('CAST(date ', 'CAST(last_day ')} AS label, {COMPLETE[f]} AS complete FROM (SELECT max(date) AS last_day FROM type_valuation)")
    view(f"schedule_{f.lower()}", f"SELECT DISTINCT {LABELS[f]} AS signal FROM type_valuation WHERE {LABELS[f]} NOT IN (SELECT label FROM final_{f.lower()} WHERE NOT complete)")
view("ordinals", "SELECT date, row_number() OVER (ORDER BY date) AS e FROM (SELECT DISTINCT date FROM resampled_w)")
view("signals", "SELECT signal, lead(signal) OVER (ORDER BY signal) AS next_signal FROM schedule_m")


def folds_view(expanding: bool) -> str:
    first = "1" if expanding else f"k.last_e - {TRAIN} + 1"
    return f"""SELECT row_number() OVER (ORDER BY k.signal) AS fold_id, k.signal, k.next_signal, {first} AS first_e, k.last_e,
      a.date AS training_start, b.date AS training_end, h.holding_start, h.holding_end
      FROM (SELECT s.signal, s.next_signal, max(o.e) AS last_e FROM signals s JOIN ordinals o ON o.date <= s.signal WHERE s.next_signal IS NOT NULL GROUP BY ALL) k
      JOIN ordinals a ON a.e = {first} JOIN ordinals b ON b.e = k.last_e
      JOIN (SELECT s.signal, min(v.date) AS holding_start, max(v.date) AS holding_end FROM signals s JOIN (SELECT DISTINCT date FROM type_valuation) v
            ON v.date > s.signal AND v.date <= s.next_signal GROUP BY 1) h ON h.signal = k.signal
      WHERE k.last_e >= {TRAIN}"""


view("folds_r", folds_view(False))
view("folds_x", folds_view(True))
view("train_expanding", "SELECT f.fold_id, w.date, w.instrument, w.ret FROM folds_x f JOIN ordinals o ON o.e BETWEEN f.first_e AND f.last_e JOIN resampled_w w ON w.date = o.date")
view("train", "SELECT f.fold_id, w.date, w.instrument, w.ret FROM folds_r f JOIN ordinals o ON o.e BETWEEN f.first_e AND f.last_e JOIN resampled_w w ON w.date = o.date")
view("hold", "SELECT f.fold_id, v.date, v.instrument, v.ret FROM folds_r f JOIN type_valuation v ON v.date > f.signal AND v.date <= f.next_signal")
view("pairs", """SELECT CAST(o_orderdate AS DATE) AS date, pair, currency, round(base * (1 + 0.05 * (avg(o_totalprice) / 250000 - 1)), 8) AS level
  FROM orders JOIN (VALUES ('1-URGENT', 'EURUSD=X', 'EUR', 1.1), ('2-HIGH', 'GBPUSD=X', 'GBP', 1.27), ('3-MEDIUM', 'USDJPY=X', 'JPY', 150.0)) p(prio, pair, currency, base)
  ON o_orderpriority = prio GROUP BY 1, 2, 3, base""")
view("rates", """SELECT date, currency, CASE WHEN pair = 'USDJPY=X' THEN 1 / level ELSE level END AS usd_per_unit FROM pairs
  UNION ALL SELECT DISTINCT date, 'USD', 1.0 FROM pairs""")
view("natives", """SELECT 'ticker:' || upper(n_name) AS instrument, CASE WHEN n_nationkey = 24 THEN 'CHF' ELSE currency END AS currency FROM nation
  JOIN region ON n_regionkey = r_regionkey LEFT JOIN (VALUES ('AFRICA', 'USD'), ('AMERICA', 'USD'), ('ASIA', 'JPY'), ('EUROPE', 'EUR'), ('MIDDLE EAST', 'GBP')) c(r, currency) ON r_name = r""")
view("rates_aligned", """SELECT date, currency, CASE WHEN date <= max(CASE WHEN usd_per_unit IS NOT NULL THEN date END) OVER (PARTITION BY currency) THEN
    last_value(usd_per_unit IGNORE NULLS) OVER (PARTITION BY currency ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END AS usd_per_unit
  FROM (SELECT DISTINCT date FROM nation_levels) CROSS JOIN (SELECT DISTINCT currency FROM rates) LEFT JOIN rates USING (date, currency)""")


# Shared inputs of the queries

@shared
def aligned(spark: SparkSession, sf: str, kind: str = "type") -> DataFrame:
    return pa.align(getattr(pr, f"{kind}_levels")(spark, sf))


@shared
def valuation(spark: SparkSession, sf: str, kind: str = "type") -> DataFrame:
    return pa.complete_case(pa.simple_returns(aligned(spark, sf, kind)))


@shared
def estimation(spark: SparkSession, sf: str) -> DataFrame:
    return fo.resample(valuation(spark, sf), "W")


@shared
def rolling(spark: SparkSession, sf: str, expanding: bool = False) -> DataFrame:
    v = valuation(spark, sf)
    return fo.folds(v, estimation(spark, sf), fo.rebalance_schedule(v, "M"), TRAIN, expanding)


@shared
def train(spark: SparkSession, sf: str) -> DataFrame:
    return fo.training_rows(rolling(spark, sf), estimation(spark, sf))


@shared
def hold(spark: SparkSession, sf: str) -> DataFrame:
    return fo.holding_rows(rolling(spark, sf), valuation(spark, sf))


def rates(spark: SparkSession, sf: str) -> DataFrame:
    return pr.usd_per_unit(pr.pair_levels(table(spark, sf, "orders")))


# Sources

@query("price_levels", "SELECT date, instrument, round(level, 6) AS level FROM brand_levels WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND instrument IN (SELECT 'ticker:' || upper(p_brand) FROM part WHERE p_size > 25)")
def price_levels(spark, sf):
    chosen = table(spark, sf, "part").where("p_size > 25").select(pa.canonical(F.col("p_brand")).alias("instrument"))
    return pr.read_levels(pr.brand_levels(spark, sf), chosen, date(1996, 1, 1), date(1999, 12, 31)).select("date", "instrument", F.round("level", 6).alias("level"))


@query("fx_usd_per_unit", "SELECT date, currency, round(usd_per_unit, 8) AS usd_per_unit FROM rates")
def fx_usd_per_unit(spark, sf):
    return rates(spark, sf).select("date", "currency", F.round("usd_per_unit", 8).alias("usd_per_unit"))


WANTED = "SELECT DISTINCT 'ticker:' || upper(n_name) AS instrument FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT DISTINCT 'ticker:' || upper(c_mktsegment) FROM customer"


def wanted(spark, sf):
    nations = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(pa.canonical(F.col("n_name")).alias("instrument"))
    return nations.union(table(spark, sf, "customer").select(pa.canonical(F.col("c_mktsegment")))).distinct()


CURRENCY_SQL = f"SELECT instrument, currency, CASE WHEN currency IS NULL THEN 'unknown' WHEN currency NOT IN ('USD', 'EUR', 'GBP', 'JPY') THEN 'unsupported' END AS problem FROM ({WANTED}) LEFT JOIN natives USING (instrument)"


@query("instrument_currency", f"SELECT instrument, currency FROM ({CURRENCY_SQL}) WHERE problem IS NULL")
def instrument_currency(spark, sf):
    return pr.instrument_currencies(wanted(spark, sf), pr.nation_currencies(spark, sf)).where("problem IS NULL").drop("problem")


@query("currency_violations", f"SELECT * FROM ({CURRENCY_SQL}) WHERE problem IS NOT NULL")
def currency_violations(spark, sf):
    return pr.instrument_currencies(wanted(spark, sf), pr.nation_currencies(spark, sf)).where("problem IS NOT NULL")


@query("dataset_metadata", """SELECT count(DISTINCT date) AS n_rows, count(DISTINCT instrument) AS instruments,
  count(*) FILTER (raw IS NULL AND level IS NOT NULL) AS filled_cells, count(*) FILTER (date > last_seen) AS trailing_gap_cells,
  (SELECT count(DISTINCT date) FROM brand_valuation) AS complete_rows FROM brand_aligned""")
def dataset_metadata(spark, sf):
    return pa.dataset_metadata(aligned(spark, sf, "brand"))


# Panel

SPELLED = "SELECT CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN ' ticker:' || lower(p_brand) WHEN 2 THEN 'Ticker:' || p_brand ELSE CASE WHEN p_size = 7 THEN 'macro:' || p_type ELSE p_type END END AS name FROM part"


@query("canonical_ids", f"""SELECT instrument, count(DISTINCT name) AS n, CASE WHEN bool_or(foreign_) THEN 'foreign' WHEN count(DISTINCT name) > 1 THEN 'duplicate' END AS problem FROM (
  SELECT name, starts_with(name, 'macro:') AS foreign_, CASE WHEN starts_with(name, 'macro:') THEN name ELSE 'ticker:' || upper(regexp_replace(trim(name), '^[Tt]icker:', '')) END AS instrument FROM ({SPELLED})) GROUP BY 1""")
def canonical_ids(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey") % 4
    other = F.when(F.col("p_size") == 7, F.concat(F.lit("macro:"), "p_type")).otherwise(F.col("p_type"))
    name = F.when(k == 0, F.col("p_brand")).when(k == 1, F.concat(F.lit(" ticker:"), F.lower("p_brand"))).when(k == 2, F.concat(F.lit("Ticker:"), "p_brand")).otherwise(other)
    return pa.canonical_ids(p.select(name.alias("name")))


@query("trading_grid", "SELECT date, instrument, round(level, 6) AS level FROM brand_grid")
def trading_grid(spark, sf):
    return pa.trading_grid(pr.brand_levels(spark, sf)).select("date", "instrument", F.round("level", 6).alias("level"))


@query("bounded_ffill", "SELECT date, instrument, round(raw, 6) AS raw, round(level, 6) AS level FROM brand_filled")
def bounded_ffill(spark, sf):
    return pa.bounded_fill(pa.trading_grid(pr.brand_levels(spark, sf))).select("date", "instrument", F.round("raw", 6).alias("raw"), F.round("level", 6).alias("level"))


@query("live_edge_mask", "SELECT date, instrument, last_seen, round(level, 6) AS level FROM nation_aligned")
def live_edge_mask(spark, sf):
    return aligned(spark, sf, "nation").select("date", "instrument", "last_seen", F.round("level", 6).alias("level"))


@query("alignment_counters", "SELECT count(*) FILTER (raw IS NULL AND level IS NOT NULL) AS filled_cells, count(*) FILTER (date > last_seen) AS trailing_gap_cells FROM brand_aligned")
def alignment_counters(spark, sf):
    return pa.alignment_counters(aligned(spark, sf, "brand"))


@query("simple_returns", "SELECT date, instrument, round(ret, 6) + 0.0 AS ret FROM brand_returns")
def simple_returns(spark, sf):
    return pa.simple_returns(aligned(spark, sf, "brand")).select("date", "instrument", rounded(F.col("ret")).alias("ret"))


@query("fx_realigned", "SELECT date, currency, round(usd_per_unit, 8) AS usd_per_unit FROM rates_aligned")
def fx_realigned(spark, sf):
    return pa.realign_rates(pr.nation_levels(spark, sf), rates(spark, sf)).select("date", "currency", F.round("usd_per_unit", 8).alias("usd_per_unit"))


@query("fx_convert_levels", """SELECT l.date, l.instrument, round(CASE WHEN n.currency = 'EUR' THEN l.level ELSE l.level * o.usd_per_unit / t.usd_per_unit END, 6) AS level
  FROM nation_levels l JOIN natives n USING (instrument) LEFT JOIN rates_aligned o ON o.date = l.date AND o.currency = n.currency
  LEFT JOIN rates_aligned t ON t.date = l.date AND t.currency = 'EUR'""")
def fx_convert_levels(spark, sf):
    levels = pr.nation_levels(spark, sf)
    done = pa.convert_levels(levels, pr.nation_currencies(spark, sf), pa.realign_rates(levels, rates(spark, sf)), "EUR")
    return done.select("date", "instrument", F.round("level", 6).alias("level"))


@query("complete_case", "SELECT date, instrument, round(ret, 6) + 0.0 AS ret FROM brand_valuation")
def complete_case(spark, sf):
    return valuation(spark, sf, "brand").select("date", "instrument", rounded(F.col("ret")).alias("ret"))


@query("required_universe", """SELECT instrument, arg_min(role, place) AS role FROM (
  SELECT 'ticker:' || upper(p_brand) AS instrument, 0 AS place, 'terminal' AS role FROM part UNION ALL SELECT 'ticker:' || upper(p_type), 1, 'proxy' FROM part
  UNION ALL SELECT 'ticker:' || upper(p_brand), 2, 'benchmark' FROM part WHERE p_size < 3 UNION ALL SELECT 'ticker:' || upper(r_name), 2, 'benchmark' FROM region
  UNION ALL SELECT DISTINCT 'cash:RF@' || n_nationkey, 3, 'financing' FROM nation) GROUP BY 1""")
def required_universe(spark, sf):
    p = table(spark, sf, "part")
    name = lambda c: pa.canonical(F.col(c)).alias("instrument")
    benchmark = p.where("p_size < 3").select(name("p_brand")).union(table(spark, sf, "region").select(name("r_name")))
    cash = table(spark, sf, "nation").select(F.concat(F.lit("cash:RF@"), F.col("n_nationkey").cast("string")).alias("instrument"))
    return pa.required_universe([("terminal", p.select(name("p_brand"))), ("proxy", p.select(name("p_type"))), ("benchmark", benchmark), ("financing", cash)])


# Calendar and folds

@query("period_labels", f"SELECT DISTINCT date, {LABELS['W']} AS week, {LABELS['M']} AS month, {LABELS['Q']} AS quarter FROM type_levels")
def period_labels(spark, sf):
    days = pr.type_levels(spark, sf).select("date").distinct()
    return days.select("date", *(period_label(F.col("date"), f).alias(n) for f, n in (("W", "week"), ("M", "month"), ("Q", "quarter"))))


def _resampled(frequency):
    def run(spark, sf):
        return fo.resample(valuation(spark, sf), frequency).select("date", "instrument", rounded(F.col("ret")).alias("ret"))

    return run


for f in ("W", "M", "Q"):
    query(f"resample_{f.lower()}", f"SELECT date, instrument, round(ret, 6) + 0.0 AS ret FROM resampled_{f.lower()}")(_resampled(f))


@query("rebalance_schedule", "SELECT 'W' AS frequency, signal FROM schedule_w UNION ALL SELECT 'M', signal FROM schedule_m UNION ALL SELECT 'Q', signal FROM schedule_q")
def rebalance_schedule(spark, sf):
    v = valuation(spark, sf)
    w, m, q = (fo.rebalance_schedule(v, f).select(F.lit(f).alias("frequency"), "signal") for f in ("W", "M", "Q"))
    return w.union(m).union(q)


@query("final_period_complete", "SELECT 'W' AS frequency, * FROM final_w UNION ALL SELECT 'M', * FROM final_m UNION ALL SELECT 'Q', * FROM final_q")
def final_period_complete(spark, sf):
    v = valuation(spark, sf)
    w, m, q = (fo.final_period(v, f).select(F.lit(f).alias("frequency"), "*") for f in ("W", "M", "Q"))
    return w.union(m).union(q)


FOLD_COLUMNS = ["fold_id", "signal", "training_start", "training_end", "holding_start", "holding_end"]


@query("folds_rolling", f"SELECT {', '.join(FOLD_COLUMNS)} FROM folds_r")
def folds_rolling(spark, sf):
    return rolling(spark, sf).select(FOLD_COLUMNS)


@query("folds_expanding", f"SELECT {', '.join(FOLD_COLUMNS)} FROM folds_x")
def folds_expanding(spark, sf):
    return rolling(spark, sf, True).select(FOLD_COLUMNS)


@query("fold_training_rows", "SELECT fold_id, date, instrument, round(ret, 6) + 0.0 AS ret FROM train")
def fold_training_rows(spark, sf):
    return train(spark, sf).withColumn("ret", rounded(F.col("ret")))


@query("fold_holding_rows", "SELECT fold_id, date, instrument, round(ret, 6) + 0.0 AS ret FROM hold")
def fold_holding_rows(spark, sf):
    return hold(spark, sf).withColumn("ret", rounded(F.col("ret")))


@query("latest_window", f"SELECT date, instrument, round(ret, 6) + 0.0 AS ret FROM resampled_w WHERE date IN (SELECT DISTINCT date FROM resampled_w ORDER BY date DESC LIMIT {TRAIN})")
def latest_window(spark, sf):
    return fo.latest_window(estimation(spark, sf), TRAIN).withColumn("ret", rounded(F.col("ret")))
