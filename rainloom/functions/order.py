"""Exact order statistics of groups too large for one task.

Spark's percentile keeps every distinct value of a group in one buffer. That suits
a station or a cell, whose rows are bounded by the calendar. For whole tables these
helpers locate the wanted ranks through two histograms of an order-preserving
bucket number and then sort only the few rows of the buckets that hold a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rainloom.session import cut_lineage

STEPS_PER_OCTAVE = 2 ** 17
COARSE = 1024


def order_bucket(v: Column) -> Column:
    """Integer that never decreases with v; about 131072 buckets per factor of two."""
    m = F.floor(F.log2(F.abs(v)) * STEPS_PER_OCTAVE) + 2 ** 28
    return F.when(v == 0, F.lit(0)).when(v > 0, m).otherwise(-m).cast("bigint")


def _running(hist: DataFrame, part, by: str) -> DataFrame:
    w = W.partitionBy(*part).orderBy(by)
    return hist.withColumn("_cum", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)))


def quantiles(df: DataFrame, value: str, probs, keys=()) -> DataFrame:
    """Linear-interpolation quantiles per key as rows: keys, idx, prob, value, n.

    probs: numbers, or for very many an array Column of structs (idx, prob), so that the plan does not hold each of them.
    """
    k = list(keys) or ["_all"]
    d = df if keys else df.withColumn("_all", F.lit(0))
    d = d.where(F.col(value).isNotNull()).select(*k, F.col(value).alias("_v"), order_bucket(F.col(value)).alias("_f"))
    d = d.withColumn("_c", F.floor(F.col("_f") / COARSE))

    h = _running(d.groupBy(*k, "_c").agg(F.count("*").alias("n")), k, "_c")
    h = h.withColumn("_total", F.sum("n").over(W.partitionBy(*k)))
    wanted = probs if isinstance(probs, Column) else F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(float(p)).alias("prob")) for i, p in enumerate(probs)])
    t = h.withColumn("_p", F.explode(wanted)).withColumn("_pos", F.col("_p.prob") * (F.col("_total") - 1))
    t = t.withColumn("_end", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "_rank", F.when(F.col("_end") == 0, F.floor("_pos")).otherwise(F.ceil("_pos")))
    t = t.where((F.col("_rank") < F.col("_cum")) & (F.col("_rank") >= F.col("_cum") - F.col("n"))).select(
        *k, "_c", "_p.idx", "_p.prob", "_end", "_pos", "_total", (F.col("_rank") - (F.col("_cum") - F.col("n"))).alias("_r"))

    h2 = d.join(t.select(*k, "_c").distinct(), [*k, "_c"], "left_semi").groupBy(*k, "_c", "_f").agg(F.count("*").alias("n"))
    h2 = _running(h2, [*k, "_c"], "_f")
    t2 = t.join(h2, [*k, "_c"]).where((F.col("_r") < F.col("_cum")) & (F.col("_r") >= F.col("_cum") - F.col("n")))
    t2 = t2.withColumn("_r", F.col("_r") - (F.col("_cum") - F.col("n"))).drop("n", "_cum", "_c")

    h3 = d.join(t2.select(*k, "_f").distinct(), [*k, "_f"], "left_semi").groupBy(*k, "_f", "_v").agg(F.count("*").alias("n"))
    h3 = _running(h3, [*k, "_f"], "_v")
    t3 = t2.join(h3, [*k, "_f"]).where((F.col("_r") < F.col("_cum")) & (F.col("_r") >= F.col("_cum") - F.col("n")))

    out = _between(t3, k)
    return out if keys else out.drop("_all")


def _between(t: DataFrame, k) -> DataFrame:
    """Interpolate between the values _v at both ends of each wanted position."""
    lo, hi = F.min_by("_v", "_end"), F.max_by("_v", "_end")
    frac = F.first("_pos") - F.floor(F.first("_pos"))
    return t.groupBy(*k, "idx", "prob").agg((lo + (hi - lo) * frac).alias("value"), F.first("_total").alias("n"))


def _within(t: DataFrame, hist: DataFrame, part, by: str) -> DataFrame:
    """The entry of a histogram that holds rank _r of its part; _r becomes the rank inside the entry."""
    j = t.join(_running(hist, part, by), list(part)).where((F.col("_r") < F.col("_cum")) & (F.col("_r") >= F.col("_cum") - F.col("n")))
    return j.withColumn("_r", F.col("_r") - (F.col("_cum") - F.col("n"))).drop("n", "_cum")


def shared_quantiles(df: DataFrame, wanted: dict, keys=(), sums: dict | None = None, groups: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quantiles of several columns, with sums by bucket and by group, in two scans of the source.

    wanted: column -> probabilities; sums: name -> Column, added up beside every bucket; groups: name -> (grouping
    Column, value Column), a table of its own counted in the first scan.

    Returns (hist, detail, quantiles), each written or computed from written tables:
    hist: keys, column, c, g, rows, n (values), total, low, high and the sums, by coarse bucket c of a column or by label g of a group;
    detail: keys, column, c, f, v, n and the sums, by distinct value of the buckets that hold a wanted rank;
    quantiles: keys, column, idx, prob, value, n. A bucket without a wanted rank lies on one side of every quantile of its column.
    """
    k, sums, empty = [*keys, "column"], sums or {}, F.lit(None).cast("string")
    some = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"), empty.alias("g")) for c in wanted]
    some += [F.struct(F.lit(name).alias("column"), v.cast("double").alias("v"), F.coalesce(by.cast("string"), F.lit("")).alias("g")) for name, (by, v) in (groups or {}).items()]
    d = df.select(*keys, *(c.alias(name) for name, c in sums.items()), F.explode(F.array(*some)).alias("_e")).select(*keys, *sums, "_e.*")
    bucket = F.when(F.col("g").isNull(), order_bucket(F.col("v")))
    d = d.where("v is not null or g is not null").withColumn("f", bucket).withColumn("c", F.floor(F.col("f") / COARSE))
    added = [F.sum(name).alias(name) for name in sums]

    hist = cut_lineage(d.groupBy(*k, "c", "g").agg(F.count("*").alias("rows"), F.count("v").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"), *added))
    h = _running(hist.where("g is null").select(*k, "c", "n"), k, "c").withColumn("_total", F.sum("n").over(W.partitionBy(*k)))
    probs = F.lit(None).cast("array<struct<idx:int,prob:double>>")
    for c, p in wanted.items():
        probs = F.when(F.col("column") == c, F.array(*(F.struct(F.lit(i).alias("idx"), F.lit(float(x)).alias("prob")) for i, x in enumerate(p)))).otherwise(probs)
    t = h.withColumn("_p", F.explode(probs)).withColumn("_pos", F.col("_p.prob") * (F.col("_total") - 1)).withColumn("_end", F.explode(F.array(F.lit(0), F.lit(1))))
    t = t.withColumn("_rank", F.when(F.col("_end") == 0, F.floor("_pos")).otherwise(F.ceil("_pos"))).where("_rank < _cum and _rank >= _cum - n")
    t = t.select(*k, "c", "_p.idx", "_p.prob", "_end", "_pos", "_total", (F.col("_rank") - (F.col("_cum") - F.col("n"))).alias("_r"))

    held = d.where("g is null").join(t.select(*k, "c").distinct(), [*k, "c"], "left_semi")
    detail = cut_lineage(held.groupBy(*k, "c", "f", "v").agg(F.count("*").alias("n"), *added))
    t = _within(t, detail.groupBy(*k, "c", "f").agg(F.sum("n").alias("n")), [*k, "c"], "f")
    t = _within(t, detail.select(*k, "c", "f", F.col("v").alias("_v"), "n"), [*k, "c", "f"], "_v")
    return hist, detail, _between(t, k)


def edges_of(q: DataFrame) -> DataFrame:
    """The distinct quantiles of one column, ascending, as one array in one row (empty without values)."""
    return q.agg(F.array_sort(F.collect_set("value")).alias("edges"))


def pieces(hist: DataFrame, detail: DataFrame, keys=(), sums=()) -> DataFrame:
    """All values of the columns of shared_quantiles in pieces that no quantile cuts: keys, column, low, high, n, total and the sums."""
    k = [*keys, "column"]
    whole = hist.where("g is null").join(detail.select(*k, "c").distinct(), [*k, "c"], "left_anti").select(*k, "low", "high", "n", "total", *sums)
    return whole.unionByName(detail.select(*k, F.col("v").alias("low"), F.col("v").alias("high"), "n", (F.col("v") * F.col("n")).alias("total"), *sums))


def quantile_array(df: DataFrame, value: str, probs, keys=()) -> DataFrame:
    """The same quantiles as one array per key."""
    q = quantiles(df, value, probs, keys)
    g = q.groupBy(*keys) if keys else q.groupBy()
    return g.agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("q"),
                 F.first("n").alias("n"))


def ordinal_rank(df: DataFrame, value: str, tie: str, last: str, out: str, keys=()) -> DataFrame:
    """Global 1-based ordinal rank by (value, tie, last) without a single-task sort.

    A value shared by a third of all rows is split by `tie` (a date, say); the rank
    is the sum of the counts before the bucket and the position inside it.
    """
    k = list(keys) or ["_all"]
    d = df if keys else df.withColumn("_all", F.lit(0))
    d = d.withColumn("_f", order_bucket(F.col(value))).withColumn("_c", F.floor(F.col("_f") / COARSE))
    h = d.groupBy(*k, "_c", "_f", value, tie).agg(F.count("*").alias("n"))

    def before(hist, part, by):
        r = hist.groupBy(*part, *by).agg(F.sum("n").alias("n"))
        w = W.partitionBy(*part).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
        return r.select(*part, *by, F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_b_" + by[0].strip("_")))

    a = before(h, k, ["_c"])
    b = before(h, [*k, "_c"], ["_f"])
    c = before(h, [*k, "_c", "_f"], [value, tie])
    base = c.join(b, [*k, "_c", "_f"]).join(a, [*k, "_c"])
    base = base.select(*k, "_f", value, tie, (F.col("_b_c") + F.col("_b_f") + F.col("_b_" + value.strip("_"))).alias("_base"))
    w = W.partitionBy(*k, "_f", value, tie).orderBy(last)
    r = d.join(base, [*k, "_f", value, tie]).withColumn(out, F.col("_base") + F.row_number().over(w))
    return r.drop("_base", "_f", "_c", *([] if keys else ["_all"]))
