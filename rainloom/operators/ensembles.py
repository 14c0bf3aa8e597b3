"""Ensemble verification: everything per sample happens inside the row, then one aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rainloom.functions import draws as D, ensemble as EN, order as O, scalar as S
from rainloom.operators import bias as B
from rainloom.operators.stats import safe_corr, share

WET_MM = 1.0


def samples(df: DataFrame, members="members", truth="truth") -> DataFrame:
    """Usable samples with their mean, error, variance and fair CRPS."""
    d = df.where(EN.usable(members, truth))
    return d.withColumn("_mean", EN.mean(members)).withColumn("_var", EN.variance(members)).withColumn(
        "_err", F.col("_mean") - F.col(truth)).withColumn("_crps", EN.fair_crps(members, truth))


def _rmse() -> Column:
    return F.sqrt(F.avg(F.col("_err") * F.col("_err")))


def crps_scores(df: DataFrame, keys=(), members="members", truth="truth") -> DataFrame:
    """Fair and plain CRPS side by side; they are different estimators."""
    d = df.where(EN.usable(members, truth))
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(EN.fair_crps(members, truth)).alias("fair_crps"),
                                F.avg(EN.plain_crps(members, truth)).alias("plain_crps"))


def point_metrics(df: DataFrame, keys=(), members="members", truth="truth", wet=WET_MM) -> DataFrame:
    """CRPS, MAE split dry/wet, bias, RMSE, correlation, root-mean-variance spread, 90 % coverage."""
    d = samples(df, members, truth)
    a, t = F.abs(F.col("_err")), F.col(truth)
    g = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(t >= wet).alias("n_wet"), F.avg("_crps").alias("crps"), F.avg(a).alias("mae"),
        F.avg(F.when(t < wet, a)).alias("dry_mae"), F.avg(F.when(t >= wet, a)).alias("wet_mae"), F.avg("_err").alias("bias"), _rmse().alias("rmse"),
        safe_corr("_mean", truth).alias("correlation"), F.sqrt(F.avg("_var")).alias("spread"), share(EN.inside(members, truth, 0.05, 0.95)).alias("coverage_90"))
    return g.withColumn("spread_skill", S.ratio(F.col("spread"), F.col("rmse")))


def scale_scores(df: DataFrame, keys=(), members="members", truth="truth") -> DataFrame:
    """Scores whose spread is the mean of the member SD, with per-member RMSE, correlation and energy."""
    d = samples(df, members, truth)
    t, m = F.col(truth), F.col("_mean")
    base = d.groupBy(*keys).agg(
        F.count("*").alias("n"), _rmse().alias("rmse"), F.avg(F.abs("_err")).alias("mae"), F.avg("_err").alias("bias"), F.avg("_crps").alias("crps"),
        safe_corr("_mean", truth).alias("correlation"), F.coalesce(F.avg(F.sqrt("_var")), F.lit(0.0)).alias("spread"),
        share(EN.inside(members, truth, 0.05, 0.95)).alias("coverage_90"), F.avg(t * t).alias("_energy"), F.avg(m * m).alias("_me"))
    p = d.select(*keys, truth, F.posexplode(members).alias("member", "v"))
    e = F.col("v") - t
    per = p.groupBy(*keys, "member").agg(F.sqrt(F.avg(e * e)).alias("r"), safe_corr("v", truth).alias("c"), F.avg(F.col("v") * F.col("v")).alias("q"))
    per = per.groupBy(*keys).agg(F.avg("r").alias("mean_member_rmse"), F.avg("c").alias("mean_member_correlation"), F.avg("q").alias("_q"))
    j = base.join(per, list(keys)) if keys else base.withColumn("_one", F.lit(1)).join(per.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return j.withColumn("spread_skill", S.ratio(F.col("spread"), F.col("rmse"))).withColumn(
        "ensemble_mean_energy_ratio", S.ratio(F.col("_me"), F.col("_energy"))).withColumn(
        "mean_member_energy_ratio", S.ratio(F.col("_q"), F.col("_energy"))).withColumn("truth_rms", F.sqrt("_energy")).drop("_energy", "_me", "_q")


def finite_size_scores(df: DataFrame, keys=(), members="members", truth="truth") -> DataFrame:
    """Mean SD inflated by sqrt((M+1)/M) over RMSE, beside the population-SD variant."""
    d = samples(df, members, truth)
    n = F.size(members)
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), _rmse().alias("rmse"), F.avg(F.sqrt("_var")).alias("spread"),
                             F.avg(EN.std(members, 0)).alias("spread_pop"), F.sqrt(F.first((n + 1) / n)).alias("_k"))
    return g.select(*keys, "n", "rmse", "spread", "spread_pop", S.ratio(F.col("spread") * F.col("_k"), F.col("rmse")).alias("spread_skill"),
                    S.ratio(F.col("spread_pop"), F.col("rmse")).alias("spread_skill_pop"))


def spread_skill(df: DataFrame, keys=(), members="members", truth="truth", obs_var=0.0) -> DataFrame:
    d = samples(df, members, truth)
    n = F.size(members)
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), _rmse().alias("skill"), F.sqrt(F.avg("_var") * F.first((n + 1) / n) + obs_var).alias("spread"))
    return g.withColumn("ratio", S.ratio(F.col("spread"), F.col("skill")))


def bin_index(value: Column, edges) -> Column:
    """Index of the half-open bin [lo, hi)."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((value >= float(edges[i])) & (value < float(edges[i + 1])), F.lit(i)).otherwise(out)
    return out


def spread_skill_by_bin(df: DataFrame, edges=(0, 1, 10, 25, 50, 100, 1e9), min_n=20, truth="truth", obs_var=0.0, members="members") -> DataFrame:
    d = df.withColumn("bin", bin_index(F.col(truth), edges)).where("bin is not null")
    return spread_skill(d, ["bin"], members, truth, obs_var).where(F.col("n") >= min_n)


def rank_histogram(df: DataFrame, size: int, keys=(), members="members", truth="truth", noise_sd=0.0, sample_key="sample_id",
                   seed=0, ties="below") -> DataFrame:
    """Counts of every rank 0..size, empty ranks included.

    noise_sd perturbs the members by the observation error; ties='random' places a
    truth among equal members by a hashed draw.
    """
    d = df.where(EN.usable(members, truth))
    m = F.col(members)
    if noise_sd > 0:
        m = F.transform(m, lambda x, i: x + D.draw_normal(seed, F.col(sample_key), i) * noise_sd)
    r = EN.rank(m, truth)
    if ties == "random":
        r = r + D.draw_below(F.size(F.filter(m, lambda x: x == F.col(truth))) + 1, seed, F.col(sample_key))
    c = d.groupBy(*keys, r.cast("int").alias("rank")).agg(F.count("*").alias("n"))
    per = c.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "n"))).alias("h"))
    e = per.select(*keys, "h", F.explode(F.sequence(F.lit(0), F.lit(size))).alias("rank"))
    return e.select(*keys, "rank", F.coalesce(F.try_element_at("h", F.col("rank")), F.lit(0)).alias("n"))


def flatness(histogram: DataFrame, keys=()) -> DataFrame:
    """Half the absolute departure of the rank shares from uniform."""
    w = W.partitionBy(*(keys or [F.lit(0)]))
    d = histogram.withColumn("_p", F.col("n") / F.sum("n").over(w)).withColumn("_q", F.lit(1.0) / F.count("*").over(w))
    return d.groupBy(*keys).agg((F.sum(F.abs(F.col("_p") - F.col("_q"))) / 2).alias("deviation"))


def fit_inflation(df: DataFrame, keys=(), members="members", truth="truth", obs_var=0.0, low=0.5, high=6.0) -> DataFrame:
    d = samples(df, members, truth)
    n = F.size(members)
    g = d.groupBy(*keys).agg(F.avg(F.col("_err") * F.col("_err")).alias("mse"), (F.avg("_var") * F.first((n + 1) / n)).alias("sp2"))
    a = F.sqrt(F.greatest(F.col("mse") - obs_var, F.lit(1e-9)) / F.nullif(F.col("sp2"), F.lit(0.0)))
    return g.select(*keys, F.when(F.col("sp2") > 0, S.clip(a, low, high)).otherwise(F.lit(1.0)).alias("alpha"))


def inflate(members, alpha, floor=0.0) -> Column:
    mu = EN.mean(members)
    return F.transform(S.col(members), lambda x: F.greatest(mu + alpha * (x - mu), F.lit(floor)))


def fit_recalibration(df: DataFrame, n_q=21, keys=(), members="members", truth="truth") -> DataFrame:
    """Empirical quantiles of the relative rank; ranks take M + 1 values, so the buffer is bounded."""
    d = df.where(EN.usable(members, truth))
    probs = [i / (n_q - 1) for i in range(n_q)]
    r = EN.rank(members, truth) / F.size(members)
    return d.groupBy(*keys).agg(F.percentile(r, F.array(*[F.lit(p) for p in probs])).alias("empirical")).withColumn(
        "nominal", F.array(*[F.lit(p) for p in probs]))


def recalibrate(members, empirical: Column, nominal: Column) -> Column:
    """Remap member levels and pick the sorted member at the half-even rounded index."""
    def once(value: Column, use) -> Column:
        # An argument of a lambda is worked out once, an expression at each of its uses.
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def picked(m):
        n = F.size(m)
        def place(_x, k):
            return F.bround(B.interpolate((k + 0.5) / n, empirical, nominal) * n - 0.5).cast("int")
        return once(F.transform(m, place), lambda at: F.transform(at, lambda i: F.get(m, F.least(F.greatest(i, F.lit(0)), n - 1))))
    return once(F.array_sort(S.col(members)), picked)


def threshold_probability(df: DataFrame, thresholds, keys=(), members="members", truth="truth") -> DataFrame:
    """Brier score and contingency of the share of members at or above each threshold."""
    d = df.where(EN.usable(members, truth)).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    d = d.withColumn("p", EN.share_at_least(members, F.col("threshold"))).withColumn("e", F.col(truth) >= F.col("threshold"))
    f, e = F.col("p") >= 0.5, F.col("e")
    g = d.groupBy(*keys, "threshold").agg(
        F.count("*").alias("n"), F.count_if(e).alias("events"), F.avg((F.col("p") - e.cast("double")) * (F.col("p") - e.cast("double"))).alias("brier"),
        F.avg("p").alias("probability_mean"), F.count_if(f & e).alias("hits"), F.count_if(~f & e).alias("misses"), F.count_if(f & ~e).alias("false_alarms"))
    h, m, a = F.col("hits").cast("double"), F.col("misses"), F.col("false_alarms")
    return g.withColumn("pod", S.ratio(h, (h + m))).withColumn("far", S.ratio(a.cast("double"), h + a)).withColumn("csi", S.ratio(h, h + m + a))


def reliability(df: DataFrame, threshold: float, bins=5, keys=(), members="members", truth="truth") -> DataFrame:
    """Mean probability and observed frequency per bin; only the last bin is closed."""
    d = df.where(EN.usable(members, truth)).withColumn("p", EN.share_at_least(members, threshold))
    d = d.withColumn("bin", F.least(F.floor(F.col("p") * bins + 1e-12), F.lit(bins - 1)).cast("int"))
    return d.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("forecast_probability"), share(F.col(truth) >= threshold).alias("observed_frequency"))


def interval_coverage(df: DataFrame, levels=(50, 80, 90), keys=(), members="members", truth="truth") -> DataFrame:
    d = df.where(EN.usable(members, truth))
    aggs = []
    for lv in levels:
        lo, hi = (1 - lv / 100.0) / 2, 1 - (1 - lv / 100.0) / 2
        aggs += [share(EN.inside(members, truth, lo, hi)).alias(f"coverage_{lv}"), F.avg(EN.quantile(members, hi) - EN.quantile(members, lo)).alias(f"width_{lv}")]
    return d.groupBy(*keys).agg(F.count("*").alias("n"), *aggs)


def jensen_audit(df: DataFrame, keys=(), members="members", truth="truth", kind="log1p", eps=0.1) -> DataFrame:
    """Mean, median and transform-mean estimators, their gap, and the log-space spread."""
    d = df.where(EN.usable(members, truth))
    z = F.transform(S.col(members), lambda x: S.rain_forward(x, kind, eps))
    d = d.withColumn("_z", z)
    est = {"mean": EN.mean(members), "median": EN.median(members), "transform_mean": S.rain_inverse(EN.mean("_z"), kind, eps)}
    for k, e in est.items():
        d = d.withColumn(k, e)
    aggs = [F.count("*").alias("n")]
    for k in est:
        x = F.col(k) - F.col(truth)
        aggs += [F.sqrt(F.avg(x * x)).alias(f"{k}_rmse"), F.avg(F.abs(x)).alias(f"{k}_mae"), F.avg(x).alias(f"{k}_bias"), safe_corr(k, truth).alias(f"{k}_corr")]
    aggs.append(F.avg(EN.std("_z", 0)).alias("sigma_z"))
    return d.groupBy(*keys).agg(*aggs).withColumn("jensen_gap", F.col("mean_bias") - F.col("median_bias"))


def point_scale_members(members, sigma_rep: float, sample_key, seed=0, kind="log1p", eps=0.1) -> Column:
    """Members perturbed by the representativeness error in transformed space."""
    return F.transform(S.col(members), lambda x, i: S.rain_inverse(
        S.rain_forward(x, kind, eps) + D.draw_normal(seed, S.col(sample_key), i) * sigma_rep, kind, eps))


def innovation_statistics(df: DataFrame, background: str, analysis: str, truth="truth", sigma_obs=0.1, sigma_rep=0.5, keys=(), kind="log1p", eps=0.1) -> DataFrame:
    """Innovation variance against claimed variance, and the Desroziers estimate of R."""
    d = df.where(EN.usable(background, truth) & EN.usable(analysis))
    b = F.transform(background, lambda x: S.rain_forward(x, kind, eps))
    a = F.transform(analysis, lambda x: S.rain_forward(x, kind, eps))
    d = d.select(*keys, S.rain_forward(truth, kind, eps).alias("_t"), EN.mean(b).alias("_b"), EN.variance(b).alias("_v"), EN.mean(a).alias("_a"))
    o, r = F.col("_t") - F.col("_b"), F.col("_t") - F.col("_a")
    R = sigma_obs ** 2 + sigma_rep ** 2
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(o).alias("innovation_mean"), F.var_samp(o).alias("innovation_var"), F.avg("_v").alias("background_var"),
                             F.avg(r).alias("residual_mean"), F.var_samp(r).alias("residual_var"), F.avg(r * o).alias("desroziers_r"))
    return g.where("n >= 3").withColumn("expected_var", F.col("background_var") + R).withColumn(
        "consistency_ratio", F.col("innovation_var") / F.col("expected_var"))


def spread_error_bins(df: DataFrame, n_bins=5, members="members", truth="truth") -> DataFrame:
    """RMSE of the mean by spread quantile; bins are closed at both ends, so an edge value counts twice. Two scans: squared errors travel with the buckets that find the edges."""
    d = samples(df, members, truth).select(F.sqrt("_var").alias("spread"), (F.col("_err") * F.col("_err")).alias("ee"))
    hist, detail, q = O.shared_quantiles(d, {"spread": [i / n_bins for i in range(n_bins + 1)]}, sums={"ee": F.col("ee")})
    p = O.pieces(hist, detail, sums=["ee"]).withColumn("_q", O.edges_of(q.where("n > 8")).scalar())
    p = p.select("low", "n", "total", "ee", F.posexplode(F.arrays_zip(F.slice("_q", F.lit(1), F.greatest(F.size("_q") - 1, F.lit(0))).alias("lo"), F.slice("_q", F.lit(2), F.greatest(F.size("_q") - 1, F.lit(0))).alias("hi"))).alias("bin", "b"))
    p = p.where("low >= b.lo and low <= b.hi")
    return p.groupBy("bin").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("spread"), F.sqrt(F.sum("ee") / F.sum("n")).alias("rmse")).where("n >= 2")


def centre_scores(df: DataFrame, keys=(), members="members", truth="truth") -> DataFrame:
    """Scores of the ensemble mean beside those of the ensemble median."""
    d = df.where(EN.usable(members, truth)).withColumn("mean", EN.mean(members)).withColumn("median", EN.median(members))
    aggs = [F.count("*").alias("n")]
    for k in ("mean", "median"):
        x = F.col(k) - F.col(truth)
        aggs += [F.avg(x).alias(f"{k}_bias"), F.avg(F.abs(x)).alias(f"{k}_mae"), F.sqrt(F.avg(x * x)).alias(f"{k}_rmse"), safe_corr(k, truth).alias(f"{k}_corr")]
    return d.groupBy(*keys).agg(*aggs)
