"""Means and covariances per fold, and Black-Litterman views.

Long tables: returns (fold_id, date, instrument, ret), means (fold_id, instrument, mu), covariances
(fold_id, i, j, cov) with both orders of a pair present.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHRINKAGE = 0.1


def mean(returns: DataFrame) -> DataFrame:
    return returns.groupBy("fold_id", "instrument").agg(F.avg("ret").alias("mu"))


def pair_rows(returns: DataFrame) -> DataFrame:
    """(fold_id, date, i, j, x, y) for every ordered pair on the same day."""
    x = returns.select("fold_id", "date", F.col("instrument").alias("i"), F.col("ret").alias("x"))
    y = returns.select("fold_id", "date", F.col("instrument").alias("j"), F.col("ret").alias("y"))
    return x.join(y, ["fold_id", "date"])


def _symmetric(upper: DataFrame, value: str) -> DataFrame:
    return upper.unionByName(upper.where("i < j").select("fold_id", F.col("j").alias("i"), F.col("i").alias("j"), value))


def covariance(returns: DataFrame, ddof: int = 1) -> DataFrame:
    """(fold_id, i, j, cov): only pairs with i <= j are aggregated, the rest mirrored."""
    agg = F.covar_samp("x", "y") if ddof else F.covar_pop("x", "y")
    return _symmetric(pair_rows(returns).where("i <= j").groupBy("fold_id", "i", "j").agg(agg.alias("cov")), "cov")


def fold_sums(estimation: DataFrame, folds: DataFrame, ordinals: DataFrame) -> DataFrame:
    """(fold_id, i, j, n, x, y, xy, xxy, xyy, xxyy), i <= j: sums of products over each fold's training periods.

    A panel's rows are paired once, whatever the number of folds and however they overlap or expand: products
    are summed between neighbouring fold edges (combined before the shuffle), then along the edges of a pair,
    and a fold is the difference of two of those. Series are centred on their whole-sample mean first,
    which keeps the differences exact enough. The panel must be complete (every instrument in every period).
    """
    order = Window.orderBy("e")  # one row a period
    edges = folds.select(F.explode(F.array(F.col("first_e") - 1, "last_e")).alias("e")).distinct().withColumn("seg", F.row_number().over(order))
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    periods = ordinals.join(edges, "e", "left").select("date", "e", F.first("seg", True).over(ahead).alias("seg")).where("seg IS NOT NULL")
    level = estimation.groupBy("instrument").agg(F.avg("ret").alias("m"))
    centred = estimation.join(level, "instrument").select("date", "instrument", (F.col("ret") - F.col("m")).alias("ret")).join(periods, "date")
    x = centred.select("e", "seg", F.col("instrument").alias("i"), F.col("ret").alias("a"))
    y = centred.select("e", F.col("instrument").alias("j"), F.col("ret").alias("b"))
    a, b = F.col("a"), F.col("b")
    products = {"x": a, "y": b, "xy": a * b, "xxy": a * a * b, "xyy": a * b * b, "xxyy": a * a * b * b}
    parts = x.join(y, "e").where("i <= j").groupBy("i", "j", "seg").agg(*(F.sum(v).alias(n) for n, v in products.items()))
    so_far = Window.partitionBy("i", "j").orderBy("seg")
    sums = parts.select("i", "j", "seg", *(F.sum(n).over(so_far).alias(n) for n in products))
    at = lambda edge, name: folds.select("fold_id", (F.col("last_e") - F.col("first_e") + 1).alias("n"), edge.alias("e")).join(edges, "e").select("fold_id", "n", F.col("seg").alias(name))
    late = at(F.col("last_e"), "seg").join(sums, "seg").drop("seg")
    early = at(F.col("first_e") - 1, "seg").drop("n").join(sums, "seg").select("fold_id", "i", "j", *(F.col(n).alias(f"{n}0") for n in products))
    both = late.join(early, ["fold_id", "i", "j"], "left")
    return both.select("fold_id", "i", "j", "n", *((F.col(n) - F.coalesce(F.col(f"{n}0"), F.lit(0.0))).alias(n) for n in products))


def _central(sums: DataFrame) -> DataFrame:
    """``sums`` with the mean product and the mean squared product of deviations from a fold's own means."""
    u, v = F.col("x") / F.col("n"), F.col("y") / F.col("n")
    own = sums.where("i = j").select("fold_id", F.col("i").alias("of"), F.col("xy").alias("square"))
    sums = sums.join(own.withColumnsRenamed({"of": "i", "square": "xx"}), ["fold_id", "i"]).join(own.withColumnsRenamed({"of": "j", "square": "yy"}), ["fold_id", "j"])
    fourth = F.col("xxyy") - 2 * v * F.col("xxy") - 2 * u * F.col("xyy") + v * v * F.col("xx") + u * u * F.col("yy") + 4 * u * v * F.col("xy") - 3 * F.col("n") * u * u * v * v
    return sums.select("fold_id", "i", "j", "n", (F.col("xy") / F.col("n") - u * v).alias("cov"), (fourth / F.col("n")).alias("fourth"))


def covariance_of_sums(sums: DataFrame, ddof: int = 1) -> DataFrame:
    """(fold_id, i, j, cov) from ``fold_sums``; null for one period and ddof 1."""
    cov = F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.col("n") - ddof)
    return _symmetric(sums.select("fold_id", "i", "j", cov.alias("cov")), "cov")


def correlation_distance_of_sums(sums: DataFrame) -> DataFrame:
    """(fold_id, i, j, rho, distance) for i < j from ``fold_sums``; null for a series that does not move."""
    cov = sums.select("fold_id", "i", "j", (F.col("xy") - F.col("x") * F.col("y") / F.col("n")).alias("cov"))
    own = cov.where("i = j")
    joined = cov.where("i < j").join(own.select("fold_id", "i", F.col("cov").alias("vi")), ["fold_id", "i"]).join(own.select("fold_id", "j", F.col("cov").alias("vj")), ["fold_id", "j"])
    rho = joined.select("fold_id", "i", "j", F.try_divide("cov", F.sqrt(F.greatest(F.col("vi") * F.col("vj"), F.lit(0.0)))).alias("rho"))
    return rho.withColumn("distance", F.sqrt(F.greatest((1 - F.col("rho")) / 2, F.lit(0.0))))


def rolling_covariance(estimation: DataFrame, folds: DataFrame, ordinals: DataFrame) -> DataFrame:
    """The sample covariance of folds from sums between fold edges; equals ``covariance`` of their training rows up to rounding."""
    return covariance_of_sums(fold_sums(estimation, folds, ordinals))


def shrunk_covariance(returns: DataFrame, delta: float = SHRINKAGE) -> DataFrame:
    """(1 - delta) S + delta (trace S / p) I with the population covariance S."""
    return shrunk(covariance(returns, ddof=0), delta)


def shrunk(s: DataFrame, delta: float = SHRINKAGE) -> DataFrame:
    """The same from S itself."""
    level = s.where("i = j").groupBy("fold_id").agg(F.avg("cov").alias("level"))
    own = F.when(F.col("i") == F.col("j"), delta * F.col("level")).otherwise(F.lit(0.0))
    return s.join(level, "fold_id").select("fold_id", "i", "j", ((1 - delta) * F.col("cov") + own).alias("cov"))


def ledoit_wolf(returns: DataFrame) -> DataFrame:
    """Shrinkage to a scaled identity with the data-driven weight of Ledoit and Wolf (2004).

    With S the population covariance, m = trace(S)/p, d2 = |S - mI|^2 / p and
    b2 = min(d2, (sum over days of |x x' - S|^2) / (n^2 p)), the weight of mI is b2 / d2.
    """
    centre = returns.join(mean(returns), ["fold_id", "instrument"]).select("fold_id", "date", "instrument", (F.col("ret") - F.col("mu")).alias("ret"))
    pairs = pair_rows(centre).where("i <= j")
    return _ledoit_wolf(pairs.groupBy("fold_id", "i", "j").agg(F.avg(F.col("x") * F.col("y")).alias("cov"), F.avg(F.col("x") * F.col("x") * F.col("y") * F.col("y")).alias("fourth"), F.count("*").alias("n")))


def ledoit_wolf_of_sums(sums: DataFrame) -> DataFrame:
    """The same from ``fold_sums``."""
    return _ledoit_wolf(_central(sums))


def _ledoit_wolf(s: DataFrame) -> DataFrame:
    level = s.where("i = j").groupBy("fold_id").agg(F.avg("cov").alias("level"), F.count("*").alias("p"))
    joined = s.join(level, "fold_id")
    target = F.when(F.col("i") == F.col("j"), F.col("level")).otherwise(F.lit(0.0))
    times = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)  # a pair stands for both of its orders
    sizes = joined.groupBy("fold_id").agg(
        F.sum(times * (F.col("cov") - target) * (F.col("cov") - target)).alias("d2"),
        F.sum(times * (F.col("fourth") - F.col("cov") * F.col("cov")) / F.col("n")).alias("b2"),
    )
    weight = F.when(F.col("d2") > 0, F.least("b2", "d2") / F.col("d2")).otherwise(F.lit(0.0))
    done = joined.join(sizes.select("fold_id", weight.alias("delta")), "fold_id")
    return _symmetric(done.select("fold_id", "i", "j", ((1 - F.col("delta")) * F.col("cov") + F.col("delta") * target).alias("cov")), "cov")


def correlation_distance(returns: DataFrame) -> DataFrame:
    """(fold_id, i, j, rho, distance) for i < j, distance = sqrt((1 - rho) / 2)."""
    rho = pair_rows(returns).where("i < j").groupBy("fold_id", "i", "j").agg(F.corr("x", "y").alias("rho"))
    return rho.withColumn("distance", F.sqrt(F.greatest((1 - F.col("rho")) / 2, F.lit(0.0))))


def equilibrium_mean(cov: DataFrame, reference: DataFrame, aversion: float, risk_free: float) -> DataFrame:
    """mu = aversion * cov * reference + risk_free for reference (instrument, weight)."""
    held = cov.join(reference.select(F.col("instrument").alias("j"), "weight"), "j")
    return held.groupBy("fold_id", F.col("i").alias("instrument")).agg((aversion * F.sum(F.col("cov") * F.col("weight")) + risk_free).alias("mu"))


def reference_gaps(universe: DataFrame, reference: DataFrame) -> DataFrame:
    """(instrument, problem): components without a weight, and weights of unknown components."""
    missing = universe.select("instrument").distinct().join(reference, "instrument", "left_anti").select("instrument", F.lit("missing").alias("problem"))
    unknown = reference.select("instrument").join(universe, "instrument", "left_anti").select("instrument", F.lit("unknown").alias("problem"))
    return missing.unionByName(unknown)


def shrunk_means(returns: DataFrame, method: str) -> DataFrame:
    """Shrunk means by fold: 'james_stein', 'bayes_stein' (Jorion 1986) or 'bodnar_okhrin' (Bodnar et al. 2019).

    A fold is one small matrix (its training window by instruments), so it is handled in one piece.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.pivot(index="date", columns="instrument", values="ret").sort_index(axis=1)
        t, p = x.shape
        mu, cov, one = x.to_numpy().mean(axis=0), np.cov(x.to_numpy().T, ddof=1).reshape(p, p), np.ones(p)
        inverse = np.linalg.pinv(cov)
        if method == "bodnar_okhrin":
            target = one / p
            a, b, c = mu @ inverse @ mu, mu @ inverse @ target, target @ inverse @ target
            slope = ((a - p / (t - p)) * c - b * b) / max(a * c - b * b, 1e-300) if t > p else 1.0
            shift = (1 - slope) * b / c
            done = slope * mu + shift * target
        else:
            anchor = one @ inverse @ mu / (one @ inverse @ one) if method == "bayes_stein" else mu.mean()
            gap = mu - anchor
            if method == "bayes_stein":
                weight = (p + 2) / (p + 2 + t * (gap @ inverse @ gap))
            else:
                values = np.linalg.eigvalsh(cov)
                weight = min(1.0, max(0.0, (p * values.mean() - 2 * values.max()) / (t * max(gap @ gap, 1e-300))))
            done = (1 - weight) * mu + weight * anchor
        return pd.DataFrame({"fold_id": rows["fold_id"].iloc[0], "instrument": x.columns, "mu": done})

    return returns.groupBy("fold_id").applyInPandas(run, "fold_id int, instrument string, mu double")


def with_cash(means: DataFrame, cov: DataFrame, rate: float, name: str = "cash:RF") -> tuple[DataFrame, DataFrame]:
    """Means and covariances with an asset of fixed return and no risk."""
    mu = means.unionByName(means.select("fold_id").distinct().select("fold_id", F.lit(name).alias("instrument"), F.lit(rate).alias("mu")))
    risky = cov.select("fold_id", "i").distinct()
    zero = F.lit(0.0).alias("cov")
    row = risky.select("fold_id", F.lit(name).alias("i"), F.col("i").alias("j"), zero)
    column = risky.select("fold_id", "i", F.lit(name).alias("j"), zero)
    corner = risky.select("fold_id").distinct().select("fold_id", F.lit(name).alias("i"), F.lit(name).alias("j"), zero)
    return mu, cov.unionByName(row).unionByName(column).unionByName(corner)


def portfolio_volatility(returns: DataFrame, cov: DataFrame, weights: DataFrame) -> DataFrame:
    """(fold_id, realized, model): the deviation of the held return, and sqrt(w' cov w)."""
    held = returns.join(weights, "instrument").groupBy("fold_id", "date").agg(F.sum(F.col("ret") * F.col("weight")).alias("r"))
    realized = held.groupBy("fold_id").agg(F.stddev_samp("r").alias("realized"))
    wi, wj = (weights.select(F.col("instrument").alias(c), F.col("weight").alias(f"w{c}")) for c in ("i", "j"))
    model = cov.join(wi, "i").join(wj, "j").groupBy("fold_id").agg(F.sqrt(F.sum(F.col("wi") * F.col("wj") * F.col("cov"))).alias("model"))
    return realized.join(model, "fold_id")


def _view_sums(cov: DataFrame, means: DataFrame, view: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per fold and instrument (cov p), and per fold p' cov p and p' mu, for one view (instrument, coef)."""
    push = cov.join(view.select(F.col("instrument").alias("j"), "coef"), "j").groupBy("fold_id", F.col("i").alias("instrument")).agg(F.sum(F.col("cov") * F.col("coef")).alias("push"))
    own = push.join(view, "instrument").groupBy("fold_id").agg(F.sum(F.col("coef") * F.col("push")).alias("spread"))
    prior = means.join(view, "instrument").groupBy("fold_id").agg(F.sum(F.col("coef") * F.col("mu")).alias("prior"))
    return push, own.join(prior, "fold_id")


def single_view_mean(cov: DataFrame, means: DataFrame, view: DataFrame, q: float, confidence: float) -> DataFrame:
    """mu + c cov p (q - p'mu) / (p' cov p): the posterior mean of one view with confidence c."""
    push, scalars = _view_sums(cov, means, view)
    joined = means.join(push, ["fold_id", "instrument"]).join(scalars, "fold_id")
    shift = F.try_divide(confidence * F.col("push") * (q - F.col("prior")), F.col("spread"))
    return joined.select("fold_id", "instrument", (F.col("mu") + shift).alias("mu"))


def single_view_cov(cov: DataFrame, means: DataFrame, view: DataFrame, confidence: float, tau: float = 0.05) -> DataFrame:
    """cov + tau (cov - c cov p p' cov / (p' cov p)): the posterior covariance of one view."""
    push, scalars = _view_sums(cov, means, view)
    pi, pj = (push.select("fold_id", F.col("instrument").alias(c), F.col("push").alias(f"p{c}")) for c in ("i", "j"))
    joined = cov.join(pi, ["fold_id", "i"]).join(pj, ["fold_id", "j"]).join(scalars, "fold_id")
    after = F.col("cov") + tau * (F.col("cov") - F.try_divide(confidence * F.col("pi") * F.col("pj"), F.col("spread")))
    return joined.select("fold_id", "i", "j", after.alias("cov"))


def view_details(cov: DataFrame, means: DataFrame, view: DataFrame, q: float, confidence: float, periods: int) -> DataFrame:
    """(fold_id, prior_view, posterior_view): the view's return before and after, annualized."""
    after = single_view_mean(cov, means, view, q, confidence)
    seen = lambda m, n: m.join(view, "instrument").groupBy("fold_id").agg((F.sum(F.col("coef") * F.col("mu")) * periods).alias(n))
    return seen(means, "prior_view").join(seen(after, "posterior_view"), "fold_id")


def multi_view_mean(cov: DataFrame, means: DataFrame, views: DataFrame, tau: float = 0.05) -> DataFrame:
    """Posterior means of several views (view_id, instrument, coef, q, confidence) by fold.

    A fold is one small matrix. Linearly dependent views make the system singular, which is an error.
    """
    packed = cov.groupBy("fold_id").agg(F.collect_list(F.struct("i", "j", "cov")).alias("cov")).join(means.groupBy("fold_id").agg(F.collect_list(F.struct("instrument", "mu")).alias("mu")), "fold_id")
    known = [r.asDict() for r in views.collect()]  # the stated views, a handful of rows

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(m["instrument"] for m in rows["mu"].iloc[0])
        place = {n: k for k, n in enumerate(names)}
        mu, s = np.zeros(len(names)), np.zeros((len(names), len(names)))
        for m in rows["mu"].iloc[0]:
            mu[place[m["instrument"]]] = m["mu"]
        for c in rows["cov"].iloc[0]:
            s[place[c["i"]], place[c["j"]]] = c["cov"]
        ids = sorted({v["view_id"] for v in known})
        p, q, conf = np.zeros((len(ids), len(names))), np.zeros(len(ids)), np.zeros(len(ids))
        for v in known:
            k = ids.index(v["view_id"])
            p[k, place[v["instrument"]]], q[k], conf[k] = v["coef"], v["q"], v["confidence"]
        prior = p @ (tau * s) @ p.T
        omega = np.diag(np.diag(prior) * (1 / conf - 1))
        after = mu + tau * s @ p.T @ np.linalg.solve(prior + omega, q - p @ mu)
        return pd.DataFrame({"fold_id": rows["fold_id"].iloc[0], "instrument": names, "mu": after})

    return packed.groupBy("fold_id").applyInPandas(run, "fold_id int, instrument string, mu double")


def view_issues(views: DataFrame, universe: DataFrame) -> DataFrame:
    """(node_id, view_id, issue) for views (node_id, view_id, instrument, coef, q, confidence) and universe (node_id, instrument).

    Issues: financing_target, outside_universe, non_finite, all_zero, duplicate, opposite, extreme_return.
    """
    at = ["node_id", "view_id"]
    say = lambda rows, text: rows.select(*at, F.lit(text).alias("issue")).distinct()
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    heads = views.groupBy(at).agg(
        F.max("q").alias("q"),
        F.max(F.abs("coef")).alias("largest"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.concat_ws(":", "instrument", F.format_number(F.col("coef") + 0.0, 6))))).alias("picks"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.concat_ws(":", "instrument", F.format_number(0.0 - F.col("coef"), 6))))).alias("turned"),
    )
    a, b = heads.alias("a"), heads.alias("b")
    later = (F.col("a.node_id") == F.col("b.node_id")) & (F.col("a.view_id") > F.col("b.view_id"))
    repeat = lambda other: a.join(b, later & (F.col("a.picks") == F.col(f"b.{other}"))).select("a.node_id", "a.view_id")
    out = say(views.where(F.col("instrument").startswith("cash:")), "financing_target")
    for rows, text in (
        (views.where(~F.col("instrument").startswith("cash:")).join(universe, ["node_id", "instrument"], "left_anti"), "outside_universe"),
        (views.where(~finite("coef") | ~finite("q")), "non_finite"),
        (heads.where("largest = 0"), "all_zero"),
        (repeat("picks"), "duplicate"),
        (repeat("turned"), "opposite"),
        (heads.where("abs(q) > 1"), "extreme_return"),
    ):
        out = out.unionByName(say(rows, text))
    return out


def weight_delta(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """The union of two weight tables (key, instrument, weight) with the change of each weight."""
    a = before.withColumnRenamed("weight", "before")
    b = after.withColumnRenamed("weight", "after")
    joined = a.join(b, [*key, "instrument"], "full").fillna(0.0, ["before", "after"])
    return joined.withColumn("delta", F.col("after") - F.col("before"))


def one_way_turnover(delta: DataFrame, key: list[str]) -> DataFrame:
    return delta.groupBy(key).agg((0.5 * F.sum(F.abs("delta"))).alias("turnover"))
