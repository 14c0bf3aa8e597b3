"""Flagship: coverage screen, calendar blocks, paired scores per window, and the 1/N error split."""

from pyspark.sql import functions as F

from rainloom.operators import stats as ST, temporal as T
from rainloom.plans import views as V
from rainloom.plans.registry import query
from rainloom.plans.scalars import q6
from rainloom.plans.stats import report
from rainloom.plans.temporal import CAL, record
from rainloom.plans.views import sql
from rainloom.session import cut_lineage


@query("flagship_error_averaging", sql("fx_obs fx_pair", f"""with {CAL.replace("from fx_pair, w", "from fx_pair, w where station_id in (select station_id from fx_obs group by 1 having count(distinct date)/30e0>=0.5e0)")},
s as (select window_days as w, count(*) as n, avg(pow(pred-obs,2)) as mse, avg(pred-obs) as b, corr(pred,obs) as c from m group by 1),
f as (select greatest(regr_intercept(mse,1e0/w),0) as a, regr_slope(mse,1e0/w) as r from s where n>10)
select cast(w as int) as window_days, n, {q6("mse","mse")}, {q6("b","bias")}, {q6("c","correlation")}, floor(a*1e3+0.5e0)/1e3 as systematic_mse, floor(r*1e3+0.5e0)/1e3 as random_mse from s, f"""))
def flagship(spark, sf):
    """How much of the product-versus-gauge error averages away with longer windows."""
    start, end = record()
    kept = T.coverage(V.obs(spark, sf), start, end, 0.5).where("kept").select("station_id")
    m = T.calendar_blocks(V.pair(spark, sf).join(kept, "station_id", "left_semi"), ["station_id"], ["obs", "pred"], [1, 5, 10, 30], start, end)
    d = F.col("pred") - F.col("obs")
    s = m.groupBy("window").agg(F.count("*").alias("n"), F.avg(d * d).alias("mse"), F.avg(d).alias("bias"), ST.safe_corr("pred", "obs").alias("correlation"))
    s = cut_lineage(s)
    fit = ST.aggregation_decomposition(s.where("n > 10")).select(F.struct("systematic_mse", "random_mse").alias("f")).scalar()
    s = report(s).withColumn("_f", fit)
    split = [(F.floor(F.col(f"_f.{k}") * 1e3 + 0.5) / 1e3).alias(k) for k in ("systematic_mse", "random_mse")]
    return s.select(F.col("window").alias("window_days"), "n", "mse", "bias", "correlation", *split)
