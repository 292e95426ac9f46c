"""Set-based allocation rules per fold (or any group key).

Inputs are long: means (key.., instrument, mu), bounds (key.., instrument, lo, hi), candidates
(key.., candidate, instrument, weight). Every rule is a window or a grouped aggregate per key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborfolio.operators.catalog import RESERVED

TOLERANCE, ZERO = 2e-6, 1e-10


def node_bounds(components: DataFrame) -> DataFrame:
    """(node_id, instrument, lo, hi) from (node_id, instrument, min_weight, max_weight, cap); cash legs have bounds of their own.

    A lending leg lies in [0, 1], a borrowing leg in [1 - leverage, 0].
    """
    lo = F.when(F.col("instrument").startswith("cash:BORROW"), 1 - F.col("leverage")).when(F.col("instrument").startswith("cash:"), 0.0).otherwise(F.coalesce("min_weight", F.lit(0.0)))
    hi = F.when(F.col("instrument").startswith("cash:BORROW"), 0.0).when(F.col("instrument").startswith("cash:"), 1.0).otherwise(F.least(F.coalesce("max_weight", F.lit(1.0)), F.coalesce("cap", F.lit(1.0)), F.lit(1.0)))
    return components.select("node_id", "instrument", lo.alias("lo"), hi.alias("hi"))


def bound_violations(bounds: DataFrame) -> DataFrame:
    """(node_id, problem): crossed bounds, lower bounds above the budget, upper bounds below it."""
    crossed = bounds.where("lo > hi").select("node_id", F.lit("crossed").alias("problem")).distinct()
    sums = bounds.groupBy("node_id").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
    low = sums.where(F.col("lo") > 1 + TOLERANCE).select("node_id", F.lit("lower bounds exceed the budget").alias("problem"))
    high = sums.where(F.col("hi") < 1 - TOLERANCE).select("node_id", F.lit("upper bounds miss the budget").alias("problem"))
    return crossed.unionByName(low).unionByName(high)


def _fill(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """lo plus room handed out in ``order`` until the budget of one is spent."""
    ahead = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spare = 1 - F.sum("lo").over(Window.partitionBy(key))
    before = F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(ahead), F.lit(0.0))
    return rows.withColumn("weight", F.col("lo") + F.least(F.greatest(spare - before, F.lit(0.0)), F.col("hi") - F.col("lo")))


def max_return(means: DataFrame, bounds: DataFrame, key: list[str]) -> DataFrame:
    """The weights of highest mean return with sum one within the bounds; ties go to the first name."""
    joined = means.join(bounds, [c for c in bounds.columns if c in (*key, "instrument")])
    return _fill(joined, key, [F.desc("mu"), F.col("instrument")]).select(*key, "instrument", "weight")


def water_fill(bounds: DataFrame, key: list[str]) -> DataFrame:
    """Equal fill above the lower bounds, each up to its upper bound, to a sum of one.

    With rooms in rising order r_1.., the level is (spare - sum of the k smallest) / (n - k) for the
    first k at which it does not exceed r_(k+1).
    """
    room = bounds.withColumn("room", F.col("hi") - F.col("lo"))
    order = Window.partitionBy(key).orderBy("room", "instrument")
    own = Window.partitionBy(key)
    spare = 1 - F.sum("lo").over(own)
    before = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (spare - before) / (F.count("*").over(own) - F.row_number().over(order) + 1)
    marked = room.withColumns({"level": level, "k": F.row_number().over(order)})
    first = F.min(F.when(F.col("level") <= F.col("room"), F.struct("k", "level"))).over(own)
    filled = marked.withColumn("at", first)
    add = F.when(F.col("at").isNull() | (F.col("k") < F.col("at.k")), F.col("room")).otherwise(F.greatest(F.col("at.level"), F.lit(0.0)))
    return filled.select(*key, "instrument", (F.col("lo") + F.least("room", add)).alias("weight"))


def vertex_candidates(bounds: DataFrame, key: list[str]) -> DataFrame:
    """(key.., candidate, instrument, weight): each instrument filled first, the rest in order of name."""
    first = bounds.select(*key, F.col("instrument").alias("candidate"))
    rows = first.join(bounds, key)
    return _fill(rows, [*key, "candidate"], [(F.col("instrument") != F.col("candidate")), F.col("instrument")]).select(*key, "candidate", "instrument", "weight")


def screen(candidates: DataFrame, returns: DataFrame, means: DataFrame, cov: DataFrame, reference: DataFrame) -> DataFrame:
    """(fold_id, candidate, expected, model_vol, realized_vol, tracking_error) of each candidate portfolio.

    A fold is one call on four small matrices (candidates, window, means, covariances), bounded by its
    universe and window, so no row is made for a candidate's day or pair of positions. An instrument
    without a number counts as zero; a fold needs all four and a day of the reference.
    """
    base = reference.join(returns, "instrument").groupBy("fold_id", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("value"))
    text, day = F.lit(None).cast("string"), F.lit(None).cast("date")
    row = lambda frame, kind, a, b, date, value: frame.select("fold_id", F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), date.alias("date"), F.col(value).alias("value"))
    c = F.col
    tagged = row(candidates, "held", c("candidate"), c("instrument"), day, "weight")
    for more in (row(returns, "ret", text, c("instrument"), c("date"), "ret"), row(means, "mean", text, c("instrument"), day, "mu"), row(cov, "cov", c("i"), c("j"), day, "cov"), row(base, "base", text, text, c("date"), "value")):
        tagged = tagged.unionByName(more)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = dict(tuple(rows.groupby("kind")))
        if len(part) < 5:
            return pd.DataFrame(columns=["fold_id", "candidate", "expected", "model_vol", "realized_vol", "tracking_error"], dtype=object)
        held = part["held"].pivot(index="a", columns="b", values="value").fillna(0.0)
        names, w = held.columns, held.to_numpy()
        mu = part["mean"].set_index("b")["value"].reindex(names, fill_value=0.0).to_numpy()
        s = part["cov"].pivot(index="a", columns="b", values="value").reindex(index=names, columns=names).fillna(0.0).to_numpy()
        base = part["base"].set_index("date")["value"]
        x = part["ret"].pivot(index="date", columns="b", values="value").reindex(index=base.index, columns=names).fillna(0.0).to_numpy()
        days = x @ w.T
        spread = lambda v: v.std(axis=0, ddof=1) if len(v) > 1 else np.full(v.shape[1], np.nan)
        risk = np.sqrt(np.maximum(((w @ s) * w).sum(axis=1), 0))
        return pd.DataFrame({"fold_id": rows["fold_id"].iloc[0], "candidate": held.index, "expected": w @ mu, "model_vol": risk, "realized_vol": spread(days), "tracking_error": spread(days - base.to_numpy()[:, None])})

    done = tagged.groupBy("fold_id").applyInPandas(run, "fold_id int, candidate string, expected double, model_vol double, realized_vol double, tracking_error double")
    return done.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in ("realized_vol", "tracking_error")})


def select_best(screened: DataFrame, objective: str, vol_cap: float, te_cap: float, aversion: float = 2.5) -> DataFrame:
    """The best feasible candidate of each fold by objective; without one, the nearest: least tracking excess, then least volatility excess, then objective."""
    score = {
        "min_risk": F.col("model_vol"),
        "max_return": -F.col("expected"),
        "max_ratio": -F.try_divide("expected", "model_vol"),
        "max_utility": -(F.col("expected") - aversion / 2 * F.col("model_vol") * F.col("model_vol")),
    }[objective]
    te, vol = F.greatest(F.col("tracking_error") - te_cap, F.lit(0.0)), F.greatest(F.col("realized_vol") - vol_cap, F.lit(0.0))
    marked = screened.withColumns({"te_excess": F.when(te > TOLERANCE, te).otherwise(0.0), "vol_excess": F.when(vol > TOLERANCE, vol).otherwise(0.0), "score": score})
    marked = marked.withColumn("feasible", (F.col("te_excess") == 0) & (F.col("vol_excess") == 0))
    order = Window.partitionBy("fold_id").orderBy(F.round("te_excess", 10), F.round("vol_excess", 10), F.round("score", 10), "candidate")
    return marked.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def minimum_variance(cov: DataFrame, steps: int = 4000) -> DataFrame:
    """Long-only weights of least variance by fold: accelerated projected gradient on each fold's small matrix."""

    def project(v: np.ndarray) -> np.ndarray:
        u = np.sort(v)[::-1]
        k = np.nonzero(u * np.arange(1, len(u) + 1) > np.cumsum(u) - 1)[0][-1]
        return np.maximum(v - (np.cumsum(u)[k] - 1) / (k + 1), 0)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        c = rows.pivot(index="i", columns="j", values="cov").sort_index().sort_index(axis=1)
        s = c.to_numpy()
        w = look = np.full(len(s), 1 / len(s))
        rate, t = 1 / max(np.linalg.eigvalsh(s)[-1], 1e-300), 1.0
        for _ in range(steps):
            new = project(look - rate * (s @ look))
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            look = new + (t - 1) / t_new * (new - w)
            if np.abs(new - w).max() < 1e-14:
                break
            w, t = new, t_new
        return pd.DataFrame({"fold_id": rows["fold_id"].iloc[0], "instrument": c.index, "weight": w})

    return cov.groupBy("fold_id").applyInPandas(run, "fold_id int, instrument string, weight double")


def ward_order(far: np.ndarray) -> list[int]:
    """The leaves of the Ward linkage of a small distance matrix, left to right."""
    members = {i: [i] for i in range(len(far))}
    gap = {(i, j): float(far[i, j]) ** 2 for i in members for j in members if i < j}
    fresh = len(far)
    while len(members) > 1:
        (a, b), near = min(gap.items(), key=lambda x: (round(x[1], 14), x[0]))
        na, nb = len(members[a]), len(members[b])
        for c in members:
            if c not in (a, b):
                nc, ac, bc = len(members[c]), gap.pop((min(a, c), max(a, c))), gap.pop((min(b, c), max(b, c)))
                gap[c, fresh] = ((na + nc) * ac + (nb + nc) * bc - nc * near) / (na + nb + nc)
        del gap[a, b]
        members[fresh] = members.pop(a) + members.pop(b)
        fresh += 1
    return next(iter(members.values()))


def hierarchical_risk_parity(cov: DataFrame) -> DataFrame:
    """Weights by fold: leaves in the order of a Ward linkage of correlation distances, halved again and again.

    Each half gets a share opposite to the variance of its inverse-variance portfolio. A fold's matrix
    is bounded by its universe.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        c = rows.pivot(index="i", columns="j", values="cov").sort_index().sort_index(axis=1)
        s = c.to_numpy()
        risk = np.sqrt(np.maximum(np.diag(s), 1e-300))
        far = np.sqrt(np.maximum((1 - np.clip(s / np.outer(risk, risk), -1, 1)) / 2, 0))
        profile = np.sqrt(np.maximum(((far[:, None, :] - far[None, :, :]) ** 2).sum(axis=2), 0))
        weights, open_ = np.ones(len(s)), [ward_order(profile)]

        def variance(part: list[int]) -> float:
            inner = 1 / np.maximum(np.diag(s)[part], 1e-300)
            inner /= inner.sum()
            return float(inner @ s[np.ix_(part, part)] @ inner)

        while open_:
            part = open_.pop()
            if len(part) > 1:
                left, right = part[: len(part) // 2], part[len(part) // 2 :]
                vl, vr = variance(left), variance(right)
                share = 1 - vl / (vl + vr) if vl + vr > 0 else 0.5
                weights[left] *= share
                weights[right] *= 1 - share
                open_ += [left, right]
        return pd.DataFrame({"fold_id": rows["fold_id"].iloc[0], "instrument": c.index, "weight": weights})

    return cov.groupBy("fold_id").applyInPandas(run, "fold_id int, instrument string, weight double")


def canonical(weights: DataFrame, key: list[str]) -> DataFrame:
    """Tiny weights become zero and the rest is rescaled to one."""
    kept = F.when(F.abs("weight") < ZERO, 0.0).otherwise(F.col("weight"))
    return weights.withColumn("weight", kept).withColumn("weight", F.try_divide(F.col("weight"), F.sum("weight").over(Window.partitionBy(key))))


def audit(weights: DataFrame, bounds: DataFrame, key: list[str]) -> DataFrame:
    """Per key: budget error, least slack to the lower and upper bounds, and status."""
    joined = weights.join(bounds, [c for c in bounds.columns if c in (*key, "instrument")])
    slack = joined.groupBy(key).agg((F.sum("weight") - 1).alias("budget_error"), F.min(F.col("weight") - F.col("lo")).alias("lower_slack"), F.min(F.col("hi") - F.col("weight")).alias("upper_slack"))
    bad = (F.abs("budget_error") > 1e-6) | (F.col("lower_slack") < -1e-6) | (F.col("upper_slack") < -1e-6)
    return slack.withColumn("status", F.when(bad, "violated").otherwise("ok"))


def regime_choice(scored: DataFrame, objective: str) -> DataFrame:
    """(node_id, regime): the best of a node's financing regimes (node_id, regime, score, cash); no cash is fully invested."""
    order = F.col("score") if objective == "min_risk" else F.desc("score")
    best = scored.withColumn("k", F.row_number().over(Window.partitionBy("node_id").orderBy(order, "regime"))).where("k = 1")
    return best.select("node_id", F.when(F.abs("cash") < ZERO, "fully_invested").otherwise(F.col("regime")).alias("regime"), "score")


def effective_settings(nodes: DataFrame, root: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Each setting of a node: its own, else the root's, else the default; with the source of each."""
    up = root.select(*(F.col(c).alias(f"root_{c}") for c in defaults))
    joined = nodes.crossJoin(F.broadcast(up.limit(1)))
    values = [F.coalesce(c, f"root_{c}", F.lit(d)).alias(c) for c, d in defaults.items()]
    sources = [F.when(F.col(c).isNotNull(), "node").when(F.col(f"root_{c}").isNotNull(), "root").otherwise("default").alias(f"{c}_source") for c in defaults]
    return joined.select("node_id", *values, *sources)


def volatility_targets(nodes: DataFrame, series: DataFrame, periods: int) -> DataFrame:
    """(node_id, target, source): the manual value, else the annual deviation of the node's reference series."""
    measured = series.groupBy("reference").agg((F.stddev_samp("ret") * F.sqrt(F.lit(float(periods)))).alias("measured"))
    joined = nodes.join(measured, "reference", "left")
    return joined.select("node_id", F.coalesce("manual", "measured").alias("target"), F.when(F.col("manual").isNotNull(), "manual").when(F.col("measured").isNotNull(), F.col("reference")).otherwise("none").alias("source"))


def reference_targets(nodes: DataFrame, returns: DataFrame, benchmark: DataFrame, forward: DataFrame, periods: int) -> DataFrame:
    """(fold_id, node_id, reference, target, problem): the volatility that each node of each fold is held to.

    ``nodes`` (node_id, is_root, proxy, reference, manual), ``returns`` (fold_id, instrument, date, ret), ``benchmark`` (instrument,
    weight), ``forward`` (fold_id, date, ret): what the root earns by a forward pass. The references benchmark, father_proxy and
    forward_root_reference measure the annual deviation of that series on the fold's rows; none, manual and declared take the manual
    value, which may be null. A reference that a node cannot have gives a problem instead of a target. Every deviation
    is measured once a fold, whatever number of nodes asks for it.
    """
    deviation = (F.stddev_samp("ret") * F.sqrt(F.lit(float(periods)))).alias("measured")
    whole = benchmark.agg(F.count("*").alias("parts"))
    held = returns.join(benchmark, "instrument").groupBy("fold_id", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"), F.count("ret").alias("n"))
    of_benchmark = held.crossJoin(whole).groupBy("fold_id").agg(deviation, F.min(F.col("n") == F.col("parts")).alias("complete")).where("complete").drop("complete")
    proxies = nodes.where("reference = 'father_proxy' AND proxy IS NOT NULL").select(F.col("proxy").alias("instrument")).distinct()
    of_proxies = returns.join(proxies, "instrument", "left_semi").groupBy("fold_id", F.col("instrument").alias("proxy")).agg(deviation)
    none = F.lit(None).cast("string").alias("proxy")
    measured = of_benchmark.select("fold_id", F.lit("benchmark").alias("reference"), none, "measured")
    measured = measured.unionByName(forward.groupBy("fold_id").agg(deviation).select("fold_id", F.lit("forward_root_reference").alias("reference"), none, "measured"))
    measured = measured.unionByName(of_proxies.select("fold_id", F.lit("father_proxy").alias("reference"), "proxy", "measured"))
    asked = returns.select("fold_id").distinct().crossJoin(nodes)  # the rows of the result
    on = (asked["fold_id"] == measured["fold_id"]) & (asked["reference"] == measured["reference"]) & (measured["proxy"].isNull() | (asked["proxy"] == measured["proxy"]))
    joined = asked.join(measured, on, "left").select(asked["fold_id"], "node_id", "is_root", asked["proxy"], asked["reference"], "manual", "measured")
    kind = F.coalesce("reference", F.lit("none"))
    given, relative = kind.isin("none", "manual", "declared"), kind.isin("benchmark", "father_proxy", "forward_root_reference")
    problem = (
        F.when(kind.isin(*RESERVED), "reference is reserved")
        .when(~given & ~relative, "unsupported reference")
        .when((kind == "forward_root_reference") & F.col("is_root"), "forward reference on the root")
        .when((kind == "father_proxy") & F.col("proxy").isNull(), "father reference requires a proxy")
        .when(relative & F.col("measured").isNull(), "reference series missing")
    )
    target = F.when(problem.isNull(), F.when(given, F.col("manual")).otherwise(F.col("measured")))
    return joined.select("fold_id", "node_id", "reference", target.alias("target"), problem.alias("problem"))
