"""Allocation under bounds by quadratic objectives: efficient frontiers as tables, tracking-error caps, financing.

The frontier of a key (a fold, a fold and node, a regime) is the path of the weights that minimise
w'Cw / 2 - t m'w within the bounds and the budget of one, as the tolerance t grows from none. The path
is linear between breakpoints, at which a weight meets or leaves a bound. One grouped call a key
follows it (its matrix is bounded by the key's universe) and gives a row a breakpoint, with the
means and quadratic forms that a stretch needs. Every objective is then a lookup in that table by
column expressions: the point of a tolerance, the best ratio (a linear equation on each stretch)
or the point of an exact volatility (a quadratic one).

A cap on the tracking error is a second quadratic form, taken into the objective with a multiplier
that is halved in until the cap is met. Series of a key are compared on the dates that all its
instruments have.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborfolio.operators.allocation import TOLERANCE, ZERO

TIGHT = 1e-12


def _joint(q: np.ndarray, free: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve for the free weights and the budget's multiplier; ``right`` holds one column a right side."""
    n = int(free.sum())
    matrix = np.zeros((n + 1, n + 1))
    matrix[:n, :n], matrix[:n, n], matrix[n, :n] = q[np.ix_(free, free)], -1.0, 1.0
    try:
        return np.linalg.solve(matrix, right)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(matrix, right, rcond=None)[0]


def _slopes_wrong(gap: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far each bound's multiplier has the wrong sign; ``gap`` is the slope of the objective less the budget's multiplier."""
    return np.where(low & high, 0.0, np.where(low, -gap, np.where(high, gap, 0.0)))


def bounded_minimum(q: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The weights of sum one within the bounds that minimise w'qw / 2 - c'w, by a primal active set."""
    scale = max(float(np.mean(np.diag(q))), 1e-300)
    q, c = q / scale, c / scale
    room = (hi - lo).sum()
    w = lo + (hi - lo) * ((1 - lo.sum()) / room if room > 0 else 0.0)
    free = (w > lo + TIGHT) & (w < hi - TIGHT)
    for _ in range(100 + 50 * len(w)):
        slope = q @ w - c
        low, high = ~free & (w <= lo + TIGHT), ~free & (w >= hi - TIGHT)
        if free.any():
            fixed = np.where(free, 0.0, w)
            found = _joint(q, free, np.append(c[free] - q[free] @ fixed, 1 - fixed.sum()))
            move, wanted = found[:-1] - w[free], found[-1]
            if np.abs(move).max() > TIGHT:
                to = np.where(move > 0, hi[free], lo[free])
                with np.errstate(divide="ignore", invalid="ignore"):
                    steps = np.where(np.abs(move) > 1e-15, (to - w[free]) / move, np.inf)
                blocked = int(np.argmin(steps))
                w[free] += min(1.0, max(0.0, float(steps[blocked]))) * move
                if steps[blocked] < 1:
                    at = np.flatnonzero(free)[blocked]
                    w[at], free[at] = to[blocked], False
                continue
            wrong = _slopes_wrong(slope - wanted, low, high)
            worst = int(np.argmax(wrong))
            if wrong[worst] <= 1e-11 * max(1.0, np.abs(slope).max()):
                return w
            free[worst] = True
        else:
            rise, fall = np.where(low & ~high, slope, np.inf), np.where(high & ~low, slope, -np.inf)
            i, j = int(np.argmin(rise)), int(np.argmax(fall))
            if not rise[i] < fall[j] - 1e-11 * max(1.0, np.abs(slope).max()):
                return w
            free[[i, j]] = True
    raise ArithmeticError("the active set did not settle")


def efficient_path(q: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """(tolerance, weights) at every breakpoint from the least variance to the highest mean."""
    scale = max(float(np.mean(np.diag(q))), 1e-300)
    q, c = q / scale, m / scale
    w = bounded_minimum(q, np.zeros(len(m)), lo, hi)
    free = (w > lo + TIGHT) & (w < hi - TIGHT)
    now, path, changed = 0.0, [(0.0, w.copy())], -1
    for _ in range(200 + 40 * len(w)):
        fixed = np.where(free, 0.0, w)
        start, turn = np.where(free, 0.0, w), np.zeros(len(w))
        if free.any():
            right = np.zeros((int(free.sum()) + 1, 2))
            right[:-1, 0], right[-1, 0], right[:-1, 1] = -(q[free] @ fixed), 1 - fixed.sum(), c[free]
            found = _joint(q, free, right)
            start[free], turn[free] = found[:-1, 0], found[:-1, 1]
            gap, change = q @ start - found[-1, 0], q @ turn - c - found[-1, 1]
        low, high = ~free & (w <= lo + TIGHT), ~free & (w >= hi - TIGHT)
        events: list[tuple[float, tuple[int, ...]]] = []
        with np.errstate(divide="ignore", invalid="ignore"):
            if free.any():
                bound = np.where(turn > 0, hi, lo)
                meets = np.where(free & (np.abs(turn) > 1e-14), (bound - start) / turn, np.inf)
                leaves = np.where((low & ~high & (change < -1e-14)) | (high & ~low & (change > 1e-14)), -gap / change, np.inf)
                events = [(float(t), (k,)) for k, t in enumerate(np.minimum(meets, leaves)) if np.isfinite(t)]
            else:
                slope = q @ w
                for i in np.flatnonzero(low & ~high):
                    for j in np.flatnonzero(high & ~low):
                        if c[i] > c[j]:
                            events.append((float((slope[i] - slope[j]) / (c[i] - c[j])), (int(i), int(j))))
        events = [e for e in events if e[0] >= now - 1e-10 * (1 + now) and not (changed in e[1] and e[0] <= now + 1e-10 * (1 + now))]
        if not events:
            path.append((np.inf, start + (0.0 if not free.any() else turn * now))) if not np.allclose(path[-1][1], start + turn * now, atol=1e-12) else None
            return path
        then, who = min(events)
        then = max(then, now)
        w = np.clip(start + turn * then, lo, hi)
        for k in who:
            if free[k]:
                w[k] = hi[k] if turn[k] > 0 else lo[k]
            free[k] = not free[k]
        changed = who[0] if len(who) == 1 else -1
        if then > now or not np.allclose(path[-1][1], w, atol=1e-12):
            path.append((then, w.copy()))
        now = then
    raise ArithmeticError("the path did not end")


def most_volatile(real: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of the portfolios that fill one instrument first and the rest in order of variance, the one of most variance."""
    order, best = np.argsort(-np.diag(real), kind="stable"), None
    for first in range(len(lo)):
        w, spare = lo.copy(), 1 - lo.sum()
        for k in [first, *(o for o in order if o != first)]:
            more = min(spare, hi[k] - lo[k])
            w[k] += more
            spare -= more
        if best is None or w @ real @ w > best @ real @ best:
            best = w
    return best


def _infeasible(lo: np.ndarray, hi: np.ndarray) -> str | None:
    if (lo > hi + TIGHT).any():
        return "crossed"
    if lo.sum() > 1 + TOLERANCE:
        return "lower bounds exceed the budget"
    return "upper bounds miss the budget" if hi.sum() < 1 - TOLERANCE else None


def _moments(rows: pd.DataFrame, shrink: float) -> tuple:
    """Names, means, objective's covariance, sample covariance, bounds and reference weights of one key's rows."""
    wide = rows.pivot_table(index="date", columns="instrument", values="ret", dropna=False).dropna()
    own = rows.groupby("instrument", sort=True)[["lo", "hi", "base"]].first()
    values = wide[own.index].to_numpy()
    real = np.atleast_2d(np.cov(values.T)) if len(values) > 1 else np.zeros((len(own),) * 2)
    model = real
    if shrink:
        pop = real * (len(values) - 1) / max(1, len(values))
        model = (1 - shrink) * pop + shrink * np.mean(np.diag(pop)) * np.eye(len(own))
    means = values.mean(axis=0) if len(values) else np.zeros(len(own))
    if "mu" in rows:
        told = rows.groupby("instrument", sort=True)["mu"].first().reindex(own.index).to_numpy(float)
        means = np.where(np.isnan(told), means, told)
    return list(own.index), means, model, real, own["lo"].to_numpy(float), own["hi"].to_numpy(float), own["base"].fillna(0.0).to_numpy(float)


def _rows_of(series: DataFrame, bounds: DataFrame, key: list[str], reference: DataFrame | None, means: DataFrame | None = None) -> DataFrame:
    """One row for each return, with the bounds, the reference weight and the stated mean of its instrument."""
    rows = series.join(bounds, [c for c in bounds.columns if c in (*key, "instrument")])
    if means is not None:
        stated = means.select(*key, "instrument", "mu")
        return _rows_of(series, bounds, key, reference).join(stated, [*key, "instrument"], "left")
    if reference is None:
        return rows.select(*key, "instrument", "date", "ret", "lo", "hi", F.lit(0.0).alias("base"))
    base = reference.withColumnRenamed("weight", "base")
    rows = rows.join(base, [c for c in base.columns if c in (*key, "instrument")], "left")
    return rows.select(*key, "instrument", "date", "ret", "lo", "hi", F.coalesce("base", F.lit(0.0)).alias("base"))


def _grouped(rows: DataFrame, key: list[str], made: str, solve: Callable[[pd.DataFrame], list[dict]]) -> DataFrame:
    """``solve`` for each key; its dicts become rows of the columns ``made``."""
    kinds = {k: rows.schema[k].dataType.simpleString() for k in key} | dict(c.split() for c in made.split(", "))
    schema = pa.schema([(c, ARROW[t]) for c, t in kinds.items()])

    def run(group: pa.Table) -> pa.Table:
        own = {k: group.column(k)[0].as_py() for k in key}
        return pa.Table.from_pylist([own | r for r in solve(group.to_pandas())], schema=schema)

    return rows.groupBy(key).applyInArrow(run, ", ".join(f"`{c}` {t}" for c, t in kinds.items()))


ARROW = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}
STEPS = "step int, beyond boolean, tolerance double, expected double, variance double, cross double, real double, real_cross double, tev double, tev_cross double, names array<string>, weights array<double>, problem string"


def frontier(series: DataFrame, bounds: DataFrame, key: list[str], shrink: float = 0.0, reference: DataFrame | None = None, means: DataFrame | None = None) -> DataFrame:
    """(key.., step, tolerance, forms, names, weights, problem): the breakpoints of each key's efficient frontier.

    ``series`` (key.., instrument, date, ret), ``bounds`` ([key..,] instrument, lo, hi), ``reference``
    ([key..,] instrument, weight), ``means`` (key.., instrument, mu) in place of the sample's. variance is w'Cw of the objective's covariance, real that of the sample
    covariance, tev the squared tracking error; the cross columns pair a step with the next. A last row
    ``beyond`` is the portfolio of most realized variance, which ends the stretch past the highest
    mean. A key whose bounds can't be met has one row with its problem.
    """

    def solve(rows: pd.DataFrame) -> list[dict]:
        names, m, model, real, lo, hi, base = _moments(rows, shrink)
        if problem := _infeasible(lo, hi):
            return [{"step": -1, "beyond": False, "names": names, "problem": problem}]
        path = [(t, w, False) for t, w in efficient_path(model, m, lo, hi)]
        last = most_volatile(real, lo, hi)
        if last @ real @ last > path[-1][1] @ real @ path[-1][1] + 1e-15:
            path.append((None, last, True))
        out = []
        for k, (t, w, beyond) in enumerate(path):
            to = path[k + 1][1] if k + 1 < len(path) else w
            out.append({
                "step": k, "beyond": beyond, "tolerance": t, "expected": m @ w, "variance": w @ model @ w, "cross": w @ model @ to, "real": w @ real @ w, "real_cross": w @ real @ to,
                "tev": (w - base) @ real @ (w - base), "tev_cross": (w - base) @ real @ (to - base), "names": names, "weights": w.tolist(),
            })
        return out

    return _grouped(_rows_of(series, bounds, key, reference, means), key, STEPS, solve)


def _form(a: str, cross: str, b: str) -> Column:
    """A quadratic form between two breakpoints, at ``share`` of the way."""
    s = F.col("share")
    return (1 - s) * (1 - s) * F.col(a) + 2 * s * (1 - s) * F.col(cross) + s * s * F.col(b)


def stretches(steps: DataFrame, key: list[str]) -> DataFrame:
    """Each breakpoint with the next one's columns, named next_*; the last breakpoint is followed by itself."""
    order = Window.partitionBy(key).orderBy("step")
    names = ("beyond", "tolerance", "expected", "variance", "real", "tev", "weights")
    return steps.where("problem IS NULL").withColumns({f"next_{n}": F.coalesce(F.lead(n).over(order), F.col(n)) for n in names})


def pick(steps: DataFrame, key: list[str], objective: str, aversion: float = 2.5, risk_free: float = 0.0, target: Column | None = None, hard_fail: bool = False) -> DataFrame:
    """(key.., route, expected, variance, real, tev, score, names, weights, problem): each key's best portfolio.

    Objectives are min_risk, max_return, max_utility and max_ratio (over ``risk_free`` a period; where no
    portfolio earns more, the best of the efficient ones). With a ``target`` (a column of steps: the
    volatility a period, measured on the sample) the objective is the highest mean at exactly that
    volatility, and route says how it is met: ``frontier`` on the efficient frontier of the sample
    covariance, ``beyond`` past its highest mean, where no portfolio is claimed to be best, or
    ``nearest`` if no portfolio on the path has it; with ``hard_fail`` such a key is a row without
    weights and with a problem.
    """
    s = stretches(steps, key)
    inner = ~F.col("beyond") & ~F.col("next_beyond")
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    if target is not None:
        goal = target * target
        bend, lean, rest = F.expr("real - 2 * real_cross + next_real"), F.expr("real_cross - real"), F.col("real") - goal
        root = F.sqrt(F.greatest(lean * lean - bend * rest, F.lit(0.0)))
        share = F.when(F.abs(bend) > 1e-18, F.greatest((-lean + root) / bend, F.when(F.abs((-lean - root) / bend - 0.5) <= 0.5, (-lean - root) / bend))).otherwise(F.try_divide(-rest, 2 * lean))
        share = F.coalesce(F.when(goal <= F.least("real", "next_real"), F.when(F.col("real") <= F.col("next_real"), 0.0).otherwise(1.0)), clip(share), F.lit(0.0))
    elif objective == "max_utility":
        wide = F.col("next_tolerance") - F.col("tolerance")
        share = F.when(inner & (wide > 0) & (F.col("next_tolerance") < float("inf")), clip((1 / aversion - F.col("tolerance")) / wide)).otherwise(0.0)
    elif objective == "max_ratio":
        e, de, lean = F.col("expected") - risk_free, F.col("next_expected") - F.col("expected"), F.expr("cross - variance")
        bend = F.expr("variance - 2 * cross + next_variance")
        share = F.when(inner, F.coalesce(clip(F.try_divide(e * lean - de * F.col("variance"), de * lean - e * bend)), F.lit(0.0))).otherwise(0.0)
    else:
        share = F.lit(0.0)
    at = s.withColumn("share", share).withColumns({
        "e": F.expr("expected + share * (next_expected - expected)"), "v": _form("variance", "cross", "next_variance"), "r": _form("real", "real_cross", "next_real"), "te": F.greatest(_form("tev", "tev_cross", "next_tev"), F.lit(0.0)),
        "w": F.zip_with("weights", "next_weights", lambda a, b: a + F.col("share") * (b - a)),
    })
    utility = F.col("e") - risk_free - aversion / 2 * F.col("v")
    score = {"min_risk": -F.sqrt(F.greatest("v", F.lit(0.0))), "max_return": F.col("e"), "max_utility": utility, "max_ratio": F.coalesce(F.try_divide(F.col("e") - risk_free, F.sqrt(F.greatest("v", F.lit(0.0)))), F.lit(0.0))}[objective]
    off = F.abs(F.sqrt(F.greatest("r", F.lit(0.0))) - target) if target is not None else F.lit(0.0)
    at = at.withColumns({"off": off, "score": F.col("e") if target is not None else score})
    allowed = at if target is not None else at.where(~F.col("beyond"))
    miss = F.when(F.col("off") > TOLERANCE, F.col("off")).otherwise(0.0)
    best = allowed.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(miss, F.desc("score"), "step"))).where("k = 1")
    route = F.when(miss > 0, "nearest").when(F.col("beyond") | (F.col("next_beyond") & (F.col("share") > 0)), "beyond").otherwise("frontier")
    failed = (miss > 0) & F.lit(hard_fail)
    found = best.select(
        *key, F.when(failed, "failed").otherwise(route).alias("route"), F.col("e").alias("expected"), F.col("v").alias("variance"), F.col("r").alias("real"), F.col("te").alias("tev"), "score", "names",
        F.when(~failed, F.transform("w", lambda x: F.when(F.abs(x) < ZERO, 0.0).otherwise(x))).alias("weights"), F.when(failed, "no portfolio has the volatility").alias("problem"),
    )
    none = [F.lit(None).cast("double").alias(c) for c in ("expected", "variance", "real", "tev", "score")]
    return found.unionByName(steps.where("problem IS NOT NULL").select(*key, F.lit("failed").alias("route"), *none, "names", F.lit(None).cast("array<double>").alias("weights"), "problem"))


def weights_of(picked: DataFrame, key: list[str]) -> DataFrame:
    """(key.., instrument, weight) of the portfolios that were found."""
    pairs = F.explode(F.arrays_zip(F.col("names").alias("instrument"), F.col("weights").alias("weight")))
    return picked.where("weights IS NOT NULL").select(*key, pairs.alias("p")).select(*key, F.col("p.instrument").alias("instrument"), F.col("p.weight").alias("weight"))


def allocator(objective: str, aversion: float = 2.5, risk_free: float = 0.0, shrink: float = 0.0) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """An ``Allocator`` of the passes over a tree: every fold and node by its efficient frontier."""
    key = ["fold_id", "node_id"]

    def allocate(series: DataFrame, bounds: DataFrame) -> DataFrame:
        return weights_of(pick(frontier(series, bounds, key, shrink), key, objective, aversion, risk_free), key)

    return allocate


CAPPED = "status string, multiplier double, expected double, variance double, real double, tev double, names array<string>, weights array<double>, problem string"


def capped(series: DataFrame, bounds: DataFrame, reference: DataFrame, key: list[str], objective: str, te_cap: float, aversion: float = 2.5, shrink: float = 0.0, hard_fail: bool = False) -> DataFrame:
    """(key.., status, multiplier, ..): the best portfolio of each key whose tracking error is at most ``te_cap`` a period.

    status is ``slack`` if the cap doesn't bind, ``binding`` if the error is at the cap, ``nearest`` if no
    portfolio within the bounds meets it (then the one of least error, or with ``hard_fail`` a row
    without weights), ``failed`` if the bounds can't be met.
    """
    risk, gain = {"min_risk": (1.0, 0.0), "max_return": (1e-9, 1.0), "max_utility": (aversion, 1.0)}[objective]

    def solve(rows: pd.DataFrame) -> list[dict]:
        names, m, model, real, lo, hi, base = _moments(rows, shrink)
        if problem := _infeasible(lo, hi):
            return [{"status": "failed", "names": names, "problem": problem}]
        error = lambda w: float(np.sqrt(max((w - base) @ real @ (w - base), 0.0)))
        at = lambda v: bounded_minimum(risk * model + v * real, gain * m + v * (real @ base), lo, hi)
        w, v, status, problem = at(0.0), 0.0, "slack", None
        if error(w) > te_cap + TOLERANCE / 10:
            least = bounded_minimum(real, real @ base, lo, hi)
            if error(least) > te_cap + TOLERANCE:
                w, v, status = least, None, "nearest"
                problem = "no portfolio meets the tracking error" if hard_fail else None
            else:
                low, high = 0.0, 1.0
                while error(at(high)) > te_cap and high < 1e12:
                    low, high = high, 4 * high
                for _ in range(100):
                    middle = (low + high) / 2
                    low, high = (middle, high) if error(at(middle)) > te_cap else (low, middle)
                    if high - low <= 1e-13 * high:
                        break
                w, v, status = at(high), high, "binding"
        w = np.where(np.abs(w) < ZERO, 0.0, w)
        return [{
            "status": "failed" if problem else status, "multiplier": v, "expected": m @ w, "variance": w @ model @ w, "real": w @ real @ w, "tev": error(w) ** 2, "names": names,
            "weights": None if problem else w.tolist(), "problem": problem,
        }]

    return _grouped(_rows_of(series, bounds, key, reference), key, CAPPED, solve)


def full_audit(picked: DataFrame, bounds: DataFrame, key: list[str], periods: int, objective: str, target: Column | None = None, te_cap: float | None = None, vol_cap: float | None = None, aversion: float = 2.5, risk_free: float = 0.0) -> DataFrame:
    """A row a key: budget and bound slacks, annual figures, status of target, cap and tracking error, objective value and soft violation.

    ``target``, ``te_cap``, ``vol_cap`` and ``risk_free`` are annual. The soft violation adds the squared relative
    misses of the target and of the tracking error.
    """
    held = weights_of(picked, key).join(bounds, [c for c in bounds.columns if c in (*key, "instrument")])
    slack = held.groupBy(key).agg(F.sum("weight").alias("sum_weights"), F.min(F.col("weight") - F.col("lo")).alias("lower_slack"), F.min(F.col("hi") - F.col("weight")).alias("upper_slack"))
    year = F.sqrt(F.lit(float(periods)))
    vol = F.sqrt(F.greatest("real" if target is not None or vol_cap is not None else "variance", F.lit(0.0))) * year
    tev, mean = F.sqrt(F.greatest("tev", F.lit(0.0))) * year, F.col("expected") * periods
    value = {
        "max_return": mean, "max_ratio": (mean - risk_free) / F.greatest(vol, F.lit(1e-12)), "max_utility": mean - risk_free - aversion / 2 * vol * vol, "min_risk": vol,
    }["max_return" if target is not None else objective]
    scale = float(np.sqrt(periods)) * TOLERANCE
    part = lambda x, of: F.pow(x / F.greatest(F.abs(of), F.lit(1e-8)), 2)
    soft = F.lit(0.0)
    if target is not None:
        soft = soft + part(vol - target, target)
    if te_cap is not None:
        soft = soft + part(F.greatest(tev - te_cap, F.lit(0.0)), F.lit(te_cap))
    state = lambda bad, asked: F.lit("not_requested") if not asked else F.when(F.col("weights").isNull(), "failed").when(bad, "missed").otherwise("met")
    told = picked.withColumns({
        "objective": F.lit("max_return_at_target" if target is not None else objective), "objective_value": value, "annual_return": mean, "annual_volatility": vol, "annual_tev": tev,
        "target_status": state(F.abs(vol - target) > scale if target is not None else None, target is not None), "cap_status": state(vol > vol_cap + scale if vol_cap is not None else None, vol_cap is not None),
        "tev_status": state(tev > te_cap + scale if te_cap is not None else None, te_cap is not None), "soft_violation": soft,
    })
    figures = ("objective", "objective_value", "annual_return", "annual_volatility", "annual_tev", "target_status", "cap_status", "tev_status", "soft_violation", "problem")
    return told.select(*key, *figures).join(slack, key, "left")


def financing(series: DataFrame, bounds: DataFrame, rates: DataFrame, key: list[str], objective: str, leverage: float, aversion: float = 2.5, shrink: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The solved portfolio of both financing regimes of each key, and (key.., regime, score, cash, risky) of the better one.

    ``rates`` (key.., lend, borrow): what a period of lending and borrowing earns and costs. The lending
    regime adds a cash leg in [0, 1], the borrowing regime, if the leverage exceeds one, a leg in
    [1 - leverage, 0]; both are rows of one job, and the sign of a leg is kept by its bounds. Without
    cash the portfolio is fully invested.
    """
    legs = [("lend", "cash:LEND", 0.0, 1.0)] + ([("borrow", "cash:BORROW", 1.0 - leverage, 0.0)] if leverage > 1 else [])
    legs = F.array(*(F.struct(F.lit(r).alias("regime"), F.lit(c).alias("instrument"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for r, c, lo, hi in legs))
    regimes = F.explode(F.transform(legs, lambda x: x["regime"])).alias("regime")
    wide = [*key, "regime"]
    cash_bounds = rates.select(*key, F.inline(legs)).select(*wide, "instrument", "lo", "hi")
    risky = series.select(*key, "instrument").distinct().join(bounds, [c for c in bounds.columns if c in (*key, "instrument")]).select(*key, "instrument", "lo", "hi")
    all_bounds = risky.select(*key, regimes, "instrument", "lo", "hi").unionByName(cash_bounds)
    days = series.select(*key, "date").distinct().join(rates, key).select(*key, "date", "lend", "borrow", F.explode(legs).alias("leg"))
    cash = days.select(*key, F.col("leg.regime").alias("regime"), F.col("leg.instrument").alias("instrument"), "date", F.when(F.col("leg.regime") == "lend", F.col("lend")).otherwise(F.col("borrow")).alias("ret"))
    both = series.select(*key, regimes, "instrument", "date", "ret").unionByName(cash)
    solved = pick(frontier(both, all_bounds, wide, shrink), wide, objective, aversion)
    leg = F.aggregate(F.filter(F.arrays_zip("names", "weights"), lambda p: p["names"].startswith("cash:")), F.lit(0.0), lambda a, p: a + p["weights"])
    scored = solved.where("weights IS NOT NULL").join(rates, key).withColumns({"cash": leg, "score": F.when(F.lit(objective == "max_utility"), F.col("score") - F.col("lend")).otherwise(F.col("score"))})
    best = scored.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("score", 12)), F.desc("regime")))).where("k = 1")
    chosen = best.select(*key, F.when(F.abs("cash") < ZERO, "fully_invested").otherwise(F.col("regime")).alias("regime"), "score", "cash", (1 - F.col("cash")).alias("risky"))
    return solved, chosen


def view_effects(series: DataFrame, bounds: DataFrame, viewed: DataFrame, key: list[str], objective: str, aversion: float = 2.5, least: float = 1e-6) -> DataFrame:
    """(key.., view_id, most_moved, problem): how far each view moves a weight; problem says if it has no effect on weights.

    ``viewed`` (key.., view_id, instrument, mu) has the means under each view alone. The portfolios without views
    and under each view are one job, told apart by a scenario.
    """
    wide = [*key, "scenario"]
    named = viewed.select(*key, F.col("view_id").cast("string").alias("scenario"), "instrument", "mu")
    scenarios = named.select(wide).distinct().unionByName(series.select(*key, F.lit("without").alias("scenario")).distinct())
    solved = pick(frontier(series.join(scenarios, key), bounds, wide, means=named), wide, objective, aversion)
    weights = weights_of(solved, wide)
    base = weights.where("scenario = 'without'").select(*key, "instrument", F.col("weight").alias("base"))
    moved = weights.where("scenario <> 'without'").join(base, [*key, "instrument"]).groupBy(wide).agg(F.max(F.abs(F.col("weight") - F.col("base"))).alias("most_moved"))
    return moved.select(*key, F.col("scenario").alias("view_id"), "most_moved", F.when(F.col("most_moved") <= least, "no effect on weights").alias("problem"))
