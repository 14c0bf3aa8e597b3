"""Bootstrap and permutation significance with hashed draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rainloom.functions import draws as D, ensemble as EN, order as O, scalar as S
from rainloom.operators import temporal as T
from rainloom.operators.checks import guard


def day_sums(df: DataFrame, keys, value: str, date="date") -> DataFrame:
    """Reduce samples to one (sum, n) per day, so stations of a day stay together and only days are resampled."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, date).agg(F.sum(value).alias("num"), F.count(value).alias("den"))


def block_bootstrap(daily: DataFrame, keys, block: int, replicates: int, seed: int, date="date", segmented=False, levels=(2.5, 97.5)) -> DataFrame:
    """Circular day-block bootstrap of sum(num)/sum(den) per key.

    Positions come from the calendar of a series, and the replicate rows join the
    daily table on (series, position). Segmented blocks never cross a date gap.
    """
    k = list(keys)
    d = T.segments(daily, k, date) if segmented else daily.withColumn("segment", F.lit(0))
    w = W.partitionBy(*k, "segment")
    d = d.withColumn("_pos", (F.row_number().over(w.orderBy(date)) - 1).cast("bigint"))
    size = d.groupBy(*k, "segment").agg(F.count("*").alias("_n"))
    size = size.withColumn("_w", F.greatest(F.lit(1), F.least(F.lit(block), F.col("_n").cast("int"))))
    r = size.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    r = r.withColumn("_k", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_n") / F.col("_w")) - 1).cast("int"))))
    r = r.withColumn("_s", D.draw_below(F.col("_n"), seed, *k, "segment", "rep", "_k"))
    r = r.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_w") - 1))).where(F.col("_k") * F.col("_w") + F.col("_j") < F.col("_n"))
    r = r.select(*k, "segment", "rep", ((F.col("_s") + F.col("_j")) % F.col("_n")).alias("_pos"))
    est = r.join(d.select(*k, "segment", "_pos", "num", "den"), [*k, "segment", "_pos"]).groupBy(*k, "rep").agg((F.sum("num") / F.sum("den")).alias("e"))
    ci = est.groupBy(*k).agg(F.percentile("e", levels[0] / 100).alias("ci_low"), F.percentile("e", levels[1] / 100).alias("ci_high"))
    base = d.groupBy(*k).agg((F.sum("num") / F.sum("den")).alias("mean"), F.count("*").alias("n_days"), F.countDistinct("segment").alias("n_segments"))
    out = base.join(ci, k) if k else base.withColumn("_1", F.lit(1)).join(ci.withColumn("_1", F.lit(1)), "_1").drop("_1")
    return out.withColumn("significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


#: P(at most k) of a Poisson law of mean one, for k from 0: a draw's weight is the number of these it reaches.
POISSON = [math.fsum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(14)]


def sample_bootstrap(df: DataFrame, keys, value: str, id_col: str, replicates: int, seed: int, levels=(2.5, 97.5)) -> DataFrame:
    """Paired bootstrap of a mean in its mergeable form: in each replicate a sample weighs Poisson(1), drawn by a hash of its id.

    For many samples that is the law of drawing n positions with replacement. Weighted sums are added up before the
    shuffle, so a task sends one row for each key and replicate, whatever its samples; nothing is joined or numbered.
    Rows that share an id share their weights. A replicate in which all weights are zero has no mean and does not count.
    """
    k, v, w = list(keys), F.col(value), F.col("_w")
    d = df.where(v.isNotNull()).select(*k, F.col(id_col).alias("_i"), v.cast("double").alias(value)).withColumn("rep", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1))))
    u = D.draw(seed, *k, "rep", "_i") / D.SPAN
    weight = F.when(F.col("rep") < 0, F.lit(1)).otherwise(F.size(F.filter(F.array(*[F.lit(p) for p in POISSON]), lambda p: p <= u)))
    s = d.withColumn("_w", weight).groupBy(*k, "rep").agg(F.sum(w).alias("_n"), S.ratio(F.sum(v * w), F.sum(w).cast("double")).alias("e"))
    own, e = F.col("rep") < 0, F.when(F.col("rep") >= 0, F.col("e"))
    out = s.groupBy(*k).agg(F.max(F.when(own, F.col("_n"))).alias("n"), F.max(F.when(own, F.col("e"))).alias("mean"),
                            F.percentile(e, levels[0] / 100).alias("ci_low"), F.percentile(e, levels[1] / 100).alias("ci_high"))
    return out.withColumn("significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


STRIDE = 256


def position_bootstrap(df: DataFrame, keys, value: str, id_col: str, replicates: int, seed: int, levels=(2.5, 97.5)) -> DataFrame:
    """Paired i.i.d. bootstrap of a mean: every replicate draws n positions with replacement.

    Positions follow (id modulo STRIDE, id). Draws are made from the sample rows themselves, so the work is spread
    like the samples, and equal draws collapse to counts before the join.
    """
    k = list(keys)
    d = df.where(F.col(value).isNotNull()).select(*k, F.col(id_col).alias("_i"), F.col(value).cast("double").alias("_y"))
    d = d.withColumn("_s", (F.col("_i") % STRIDE).cast("double")).withColumn("_t", F.floor(F.col("_i") / STRIDE ** 2))
    d = O.ordinal_rank(d, "_s", "_t", "_i", "_pos", k).select(*k, (F.col("_pos") - 1).alias("_pos"), "_y")
    n = d.groupBy(*k).agg(F.count("*").alias("n"), F.avg("_y").alias("mean"))
    r = d.select(*k, F.col("_pos").alias("_i")).join(n.select(*k, "n"), k).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    r = r.withColumn("_pos", D.draw_below(F.col("n"), seed, *k, "rep", "_i")).groupBy(*k, "rep", "_pos").agg(F.count("*").alias("_m"))
    est = r.join(d, [*k, "_pos"]).groupBy(*k, "rep").agg((F.sum(F.col("_y") * F.col("_m")) / F.sum("_m")).alias("e"))
    ci = est.groupBy(*k).agg(F.percentile("e", levels[0] / 100).alias("ci_low"), F.percentile("e", levels[1] / 100).alias("ci_high"))
    return n.join(ci, k).withColumn("significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def paired_crps(df: DataFrame, first: str, second: str, keys=("date", "station_id"), method="method", members="members", truth="truth", tolerance=1e-5, extra=()) -> DataFrame:
    """Per-sample CRPS difference of two methods; a different truth stops the job."""
    def side(name, c):
        return df.where((F.col(method) == name) & EN.usable(members, truth)).select(*keys, *(extra if c == "a" else ()), EN.fair_crps(members, truth).alias(f"_{c}"), F.col(truth).alias(f"_t{c}"))
    j = side(first, "a").join(side(second, "b"), list(keys))
    j = j.where(guard(~(F.abs(F.col("_ta") - F.col("_tb")) <= tolerance), F.lit("runs were scored against different truth")))
    return j.select(*keys, *extra, (F.col("_a") - F.col("_b")).alias("diff"))


def contrasts(df: DataFrame, pairs, **kw) -> DataFrame:
    """Daily mean CRPS difference per named contrast."""
    out = None
    for a, b in pairs:
        d = day_sums(paired_crps(df, a, b, **kw).withColumn("contrast", F.lit(f"{a}-{b}")), ["contrast"], "diff")
        out = d if out is None else out.unionByName(d)
    return out


def member_subsets(spark, size_list, total: int, draws: int, seed: int) -> DataFrame:
    """Subsets without replacement: members ordered by the hash of (size, draw, member)."""
    rows = spark.range(draws).select(F.col("id").cast("int").alias("draw")).withColumn("size", F.explode(F.array(*[F.lit(int(s)) for s in size_list])))
    rows = rows.where((F.col("size") < total) | (F.col("draw") == 0))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(total - 1)), lambda m: F.struct(D.draw(seed, F.col("size"), F.col("draw"), m).alias("h"), m.alias("m"))))
    return rows.select("size", "draw", F.transform(F.slice(order, F.lit(1), F.col("size")), lambda x: x["m"]).alias("picks"))


def crps_by_size(df: DataFrame, sizes, total: int, draws: int = 40, seed: int = 0, members="members", truth="truth") -> DataFrame:
    """Fair CRPS against ensemble size; the few subsets ride along each sample as one array."""
    s = member_subsets(df.sparkSession, sizes, total, draws, seed).agg(F.collect_list(F.struct("size", "draw", "picks"))).scalar()
    d = df.where(EN.usable(members, truth)).withColumn("_s", s).select(members, truth, F.explode("_s").alias("s"))
    d = d.withColumn("_sub", F.transform("s.picks", lambda i: F.get(F.col(members), i)))
    per = d.groupBy(F.col("s.size").alias("size"), F.col("s.draw").alias("draw")).agg(F.avg(EN.fair_crps("_sub", truth)).alias("c"))
    return per.groupBy("size").agg(F.avg("c").alias("crps"), F.percentile("c", 0.025).alias("low"), F.percentile("c", 0.975).alias("high"), F.count("*").alias("n_draws"))


def placement_test(df: DataFrame, block_keys, candidate: str, truth: str, order: str, permutations: int, seed: int) -> DataFrame:
    """Within-block permutation test of placement.

    A block is one row of two short arrays; each permutation reorders the candidate
    by a hash and contributes only its cross product, because sums and squares of a
    block do not change. One aggregation over the permutation number remains.
    """
    b = df.where(F.col(candidate).isNotNull() & F.col(truth).isNotNull()).groupBy(*block_keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(candidate).alias("c"), F.col(truth).alias("t")))).alias("x"))
    c, t = F.transform("x", lambda r: r["c"]), F.transform("x", lambda r: r["t"])
    b = b.withColumn("_c", c).withColumn("_t", t).withColumn("perm", F.explode(F.sequence(F.lit(-1), F.lit(permutations - 1))))
    h = F.array_sort(F.transform("x", lambda r: F.struct(D.draw(seed, *block_keys, F.col("perm"), r["o"]).alias("h"), r["c"].alias("c"))))
    shuffled = F.when(F.col("perm") < 0, F.col("_c")).otherwise(F.transform(h, lambda r: r["c"]))
    cross = EN.total(F.zip_with(shuffled, F.col("_t"), lambda p, q: p * q))
    sq = lambda a: EN.total(F.transform(a, lambda v: v * v))
    g = b.groupBy("perm").agg(F.sum(F.size("_c")).alias("n"), F.sum(cross).alias("ct"), F.sum(EN.total(F.col("_c"))).alias("sc"), F.sum(EN.total(F.col("_t"))).alias("st"),
                              F.sum(sq(F.col("_c"))).alias("cc"), F.sum(sq(F.col("_t"))).alias("tt"))
    n = F.col("n")
    r = (F.col("ct") - F.col("sc") * F.col("st") / n) / F.sqrt((F.col("cc") - F.col("sc") * F.col("sc") / n) * (F.col("tt") - F.col("st") * F.col("st") / n))
    g = g.select("perm", r.alias("r"), ((F.col("cc") - F.col("ct") * 2 + F.col("tt")) / n).alias("mse"))
    o = g.where("perm < 0").select(F.struct("r", "mse").alias("o")).scalar()
    g = g.withColumn("_o", o)
    null = F.col("perm") >= 0
    m = F.count_if(null)
    return g.agg(F.max(F.when(~null, F.col("r"))).alias("observed_corr"), F.avg(F.when(null, F.col("r"))).alias("null_corr_mean"),
                 ((F.count_if(null & (F.col("r") >= F.col("_o.r"))) + 1) / (m + 1)).alias("corr_p"), F.max(F.when(~null, F.col("mse"))).alias("observed_mse"),
                 F.avg(F.when(null, F.col("mse"))).alias("null_mse_mean"), ((F.count_if(null & (F.col("mse") <= F.col("_o.mse"))) + 1) / (m + 1)).alias("mse_p"))
