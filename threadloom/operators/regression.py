"""Regressions from sufficient statistics: one pass per (label, cluster), one per label.

Nothing but sums is shuffled, so the size of a cluster does not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import staged


def ols_binary(df: DataFrame, by: str, y: str, x: str, cluster: str) -> DataFrame:
    """y ~ 1 + x with cluster-robust SE, factor G/(G-1) * (n-1)/(n-2); null if x does not vary.

    The slope's influence is linear in the cluster sums of residuals with and without x.
    """
    d = df.select(by, cluster, F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
    per = d.groupBy(by, cluster).agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    total = per.groupBy(by).agg(*[F.sum(c).alias("t_" + c) for c in ("n", "sx", "sy", "sxy")], F.count("*").alias("g"))
    n, sx, sy, sxy = (F.col("t_" + c) for c in ("n", "sx", "sy", "sxy"))
    fit = total.withColumns({"mean1": F.when(sx > 0, sxy / sx), "mean0": F.when(n > sx, (sy - sxy) / (n - sx))})
    b0, b1 = F.col("mean0"), F.col("mean1") - F.col("mean0")
    r1 = F.col("sxy") - F.col("mean1") * F.col("sx")
    r0 = (F.col("sy") - F.col("sxy")) - b0 * (F.col("n") - F.col("sx"))
    # With a 0/1 predictor the slope is a difference of means: its scores separate by group.
    score = r1 / sx - r0 / (n - sx)
    out = per.join(fit, by).groupBy(by).agg(
        F.first("t_n").alias("n"), F.first("g").alias("clusters"), F.first(b0).alias("intercept"), F.first(b1).alias("slope"), F.sum(score * score).alias("v")
    )
    factor = F.col("clusters") / (F.col("clusters") - 1) * (F.col("n") - 1) / (F.col("n") - 2)
    return out.select(by, "n", "clusters", "intercept", "slope", F.when((F.col("clusters") > 1) & (F.col("n") > 2) & F.col("slope").isNotNull(), F.sqrt(factor * F.col("v"))).alias("se"))


def ols_with_control(df: DataFrame, by: str, y: str, x: str, t: str, cluster: str) -> DataFrame:
    """y ~ 1 + x + t with cluster-robust SE of x's slope, factor G/(G-1) * (n-1)/(n-3)."""
    d = df.select(by, cluster, *[F.col(c).cast("double").alias(a) for c, a in ((y, "y"), (x, "x"), (t, "t"))])
    names = {"n": F.lit(1.0), "x": F.col("x"), "t": F.col("t"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "xt": F.col("x") * F.col("t"),
             "tt": F.col("t") * F.col("t"), "xy": F.col("x") * F.col("y"), "ty": F.col("t") * F.col("y")}
    per = d.groupBy(by, cluster).agg(*[F.sum(v).alias(k) for k, v in names.items()])
    total = per.groupBy(by).agg(*[F.sum(k).alias("t_" + k) for k in names], F.count("*").alias("g"))
    N, X, T, Y, XX, XT, TT, XY, TY = (F.col("t_" + k) for k in names)
    # Centred sums leave a 2 x 2 system.
    sxx, sxt, stt = XX - X * X / N, XT - X * T / N, TT - T * T / N
    sxy, sty = XY - X * Y / N, TY - T * Y / N
    det = sxx * stt - sxt * sxt
    ok = F.abs(det) > 1e-9
    fit = total.withColumns({
        "bx": F.when(ok, (stt * sxy - sxt * sty) / det), "bt": F.when(ok, (sxx * sty - sxt * sxy) / det), "wx": F.when(ok, stt / det), "wt": F.when(ok, -sxt / det),
        "mx": X / N, "mt": T / N, "my": Y / N,
    })
    a = F.col("my") - F.col("bx") * F.col("mx") - F.col("bt") * F.col("mt")
    e = lambda s, sx, st: s - a * sx[0] - F.col("bx") * sx[1] - F.col("bt") * st
    rx = e(F.col("xy"), (F.col("x"), F.col("xx")), F.col("xt"))
    rt = e(F.col("ty"), (F.col("t"), F.col("xt")), F.col("tt"))
    r1 = e(F.col("y"), (F.col("n"), F.col("x")), F.col("t"))
    score = F.col("wx") * (rx - F.col("mx") * r1) + F.col("wt") * (rt - F.col("mt") * r1)
    out = per.join(fit, by).groupBy(by).agg(
        F.first("t_n").cast("bigint").alias("n"), F.first("g").alias("clusters"), F.first("bx").alias("slope_x"), F.first("bt").alias("slope_t"), F.sum(score * score).alias("v")
    )
    factor = F.col("clusters") / (F.col("clusters") - 1) * (F.col("n") - 1) / (F.col("n") - 3)
    return out.select(by, "n", "clusters", "slope_x", "slope_t", F.when((F.col("clusters") > 1) & (F.col("n") > 3), F.sqrt(factor * F.col("v"))).alias("se_x"))


def effect_summary(fitted: DataFrame, slope: str = "slope", se: str = "se") -> DataFrame:
    """exp of a log-outcome slope with its interval."""
    b, s = F.col(slope), F.col(se)
    return fitted.withColumns({"effect": F.exp(b), "effect_low": F.exp(b - 1.96 * s), "effect_high": F.exp(b + 1.96 * s)})


def p_value(df: DataFrame, slope: str = "slope", se: str = "se") -> DataFrame:
    """Two-sided normal p-value; a Python function over one row per label, as Spark has no erfc."""
    @F.pandas_udf("double")
    def two_sided(t: pd.Series) -> pd.Series:
        return t.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))

    return df.withColumn("p", two_sided(F.when(F.col(se) > 0, F.col(slope) / F.col(se))))


def poisson(df: DataFrame, y: str, features: list[str]) -> list[tuple[str, float]]:
    """Coefficients of a fixed-effects Poisson regression (M04); rows with nulls are left out."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    clean = df.select(F.col(y).cast("double").alias("label"), *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    data = VectorAssembler(inputCols=features, outputCol="features").transform(clean)
    fit = GeneralizedLinearRegression(family="poisson", link="log", maxIter=25).fit(data)
    return [("intercept", float(fit.intercept)), *zip(features, map(float, fit.coefficients))]


def poisson_by(df: DataFrame, by: str, y: str, features: list[str], rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """(by, n, term, coefficient): one fixed-effects Poisson regression per group, all fitted together.

    Reweighted least squares from sums: each round shuffles one row of weighted moments per group and
    the driver solves one small system per group, so neither a group nor their number costs a job of its
    own. Rows with nulls are left out; a group that does not determine its coefficients, or whose fit does
    not settle, has null ones.
    """
    spark = df.sparkSession
    terms = ["intercept", *features]
    clean = staged(df.select(by, F.col(y).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]).dropna(), "poisson")
    x = [F.lit(1.0), *[F.col(f"`{f}`") for f in features]]
    k = len(x)
    upper = [(a, b) for a in range(k) for b in range(a, k)]

    def moments(rows: DataFrame, mu, eta) -> dict:
        z = eta + (F.col("_y") - mu) / mu
        sums = [F.sum(mu * x[a] * x[b]) for a, b in upper] + [F.sum(mu * x[a] * z) for a in range(k)]
        return {r[0]: (r[1], [float(v) for v in r[2]]) for r in rows.groupBy(by).agg(F.count("*").alias("n"), F.array(*sums).alias("s")).collect()}

    def solved(sums: list[float]) -> np.ndarray | None:
        m, v = np.zeros((k, k)), np.array(sums[len(upper) :])
        for (a, b), value in zip(upper, sums):
            m[a, b] = m[b, a] = value
        scale = np.sqrt(np.diag(m))
        if not (np.isfinite(m).all() and np.isfinite(v).all() and (scale > 0).all()):
            return None
        scaled = m / np.outer(scale, scale)
        return np.linalg.solve(scaled, v / scale) / scale if np.linalg.cond(scaled) < 1e12 else None

    first = F.greatest(F.col("_y"), F.lit(0.1))
    sums = moments(clean, first, F.log(first))
    sizes = {g: n for g, (n, _) in sums.items()}
    beta = {g: solved(s) for g, (_, s) in sums.items()}
    open_ = {g for g, b in beta.items() if b is not None}
    for _ in range(rounds):
        if not open_:
            break
        now = spark.createDataFrame([(g, [float(v) for v in beta[g]]) for g in open_], f"_g {dict(df.dtypes)[by]}, _b array<double>")
        eta = F.greatest(F.least(sum((F.col("_b")[a] * x[a] for a in range(k)), F.lit(0.0)), F.lit(200.0)), F.lit(-200.0))
        rows = clean.join(now, F.col(by) == F.col("_g"))
        for g, (_, s) in moments(rows, F.exp(eta), eta).items():
            new = solved(s)
            if new is None or np.abs(new - beta[g]).max() <= tolerance * (1 + np.abs(new).max()):
                open_.discard(g)
            beta[g] = new
    for g in open_:
        beta[g] = None
    out = [(g, sizes[g], t, None if b is None else float(b[a])) for g, b in beta.items() for a, t in enumerate(terms)]
    return spark.createDataFrame(out, f"`{by}` {dict(df.dtypes)[by]}, n bigint, term string, coefficient double")
