"""Queries over the temporal operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rainloom.functions import ensemble as EN, scalar as S
from rainloom.functions.lattice import VIEW_LATTICE as G
from rainloom.operators import temporal as T
from rainloom.plans import views as V
from rainloom.plans.registry import query
from rainloom.plans.scalars import q6
from rainloom.plans.views import sql, table

R = S.rounded


def record():
    """First and last day of the event record."""
    return F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date")


@query("tmp01_reporting_day", sql("fx_halfhour", f"""
select station_id, cast(cast(ts - interval 3 hour as date) + 1 as date) as date,
 case when count(rate)>=2 then floor((sum(rate*0.5e0))*1e6+0.5e0)/1e6 end as precip_mm,
 case when count(rate)>=2 then floor((sqrt(sum(pow(rate*0.05e0,2))))*1e6+0.5e0)/1e6 end as error_mm, count(rate) as n_valid
from fx_halfhour group by 1,2"""))
def tmp01(spark, sf):
    h = V.halfhour(spark, sf).withColumn("err", F.col("rate") * 0.1)
    w = T.accumulate_windows(h, ["station_id"], min_count=2, error="err")
    return w.select("station_id", "date", R("precip_mm").alias("precip_mm"), R("error_mm").alias("error_mm"), "n_valid")


@query("tmp02_daily_mean", sql("fx_halfhour", f"""
select station_id, cast(ts as date) as date, {q6("avg(rate)","rate")}, count(rate) as n from fx_halfhour group by 1,2"""))
def tmp02(spark, sf):
    return T.daily_mean(V.halfhour(spark, sf), ["station_id"], "rate").withColumn("rate", R("rate"))


@query("tmp03_daily_total", f"""
select event_type, cast(ts - interval 1 hour as date) as date, case when count(distinct date_trunc('hour', ts))>=24 then floor((1000*sum(value))*1e4+0.5e0)/1e4 end as value,
 count(distinct date_trunc('hour', ts)) as n_hours from events group by 1,2""")
def tmp03(spark, sf):
    d = T.daily_total(table(spark, sf, "events"), ["event_type"], "value")
    return d.select("event_type", "date", R("value", 4).alias("value"), "n_hours")


CAL = """w as (select unnest([1,5,10,30]) as window_days),
b as (select station_id, window_days, cast(floor((date - date '2024-01-01')/window_days) as int) as block, obs, pred from fx_pair, w),
m as (select station_id, window_days, block, avg(obs) as obs, avg(pred) as pred, count(*) as n from b
 where block < floor(30e0/window_days) group by 1,2,3 having count(*) >= 0.8e0*window_days)"""


@query("tmp04_calendar_blocks", sql("fx_pair", f"""with {CAL}
select station_id, window_days, block, {q6("obs","obs")}, {q6("pred","pred")}, n as n_days from m"""))
def tmp04(spark, sf):
    m = T.calendar_blocks(V.pair(spark, sf), ["station_id"], ["obs", "pred"], [1, 5, 10, 30], *record())
    return m.select("station_id", F.col("window").alias("window_days"), "block", R("obs").alias("obs"), R("pred").alias("pred"), "n_days")


@query("tmp05_row_blocks", sql("fx_pair", f"""
with i as (select *, row_number() over (partition by station_id order by date)-1 as i, count(*) over (partition by station_id) as n from fx_pair),
b as (select station_id, w as window_days, cast(floor(i/w) as int) as block, obs, pred from i, (select unnest([1,3,5]) as w) where floor(i/w) < floor(n/w))
select station_id, window_days, block, {q6("avg(obs)","obs")}, {q6("avg(pred)","pred")} from b group by 1,2,3"""))
def tmp05(spark, sf):
    m = T.row_blocks(V.pair(spark, sf), ["station_id"], ["obs", "pred"], [1, 3, 5])
    return m.select("station_id", F.col("window").alias("window_days"), "block", R("obs").alias("obs"), R("pred").alias("pred"))


PERIOD = """r as (select strftime(date,'%Y-%m') as period, ceil(0.8e0*count(distinct date)-1e-9) as required from fx_methods group by 1),
e as (select strftime(date,'%Y-%m') as period, station_id, method, date, truth, list_avg(members) as mm, unnest(members) as v, unnest(range(16)) as k from fx_methods),
p as (select period, station_id, method, k, avg(v) as v, avg(truth) as truth, stddev_pop(truth) as tsd, stddev_pop(mm) as psd, count(distinct date) as n from e group by 1,2,3,4),
s as (select period, station_id, method, list(v order by k) as members, any_value(truth) as truth, any_value(tsd) as tsd, any_value(psd) as psd, any_value(n) as n from p group by 1,2,3),
k as (select s.* from s join r using(period) where n>=required)"""


def _monthly(spark, sf):
    m = V.methods(spark, sf).withColumn("period", F.date_format("date", "yyyy-MM"))
    return T.period_ensembles(m, "period")


@query("tmp06_monthly_samples", sql("fx_methods", f"""with {PERIOD}
select period, station_id, method, {q6("truth","truth")}, {q6("list_avg(members)","mean_mm")}, {q6("list_max(members)","max_member")}, n as n_days from k"""))
def tmp06(spark, sf):
    return _monthly(spark, sf).select("period", "station_id", "method", R("truth").alias("truth"), R(EN.mean("members")).alias("mean_mm"),
                                      R(F.array_max("members")).alias("max_member"), "n_days")


@query("tmp07_period_variability", sql("fx_methods", f"""with {PERIOD}
select period, station_id, method, {q6("truth","truth")}, {q6("tsd","truth_sd")}, {q6("psd","predicted_sd")} from k"""))
def tmp07(spark, sf):
    return _monthly(spark, sf).select("period", "station_id", "method", R("truth").alias("truth"), R("truth_sd").alias("truth_sd"),
                                      R("predicted_sd").alias("predicted_sd"))


@query("tmp08_window_correlation", sql("fx_grid", f"""
with s as (select cast(floor((day - (select min(day) from fx_grid))/90e0) as int) as block, iy, ix, sum(value) as a, sum(ref) as b from fx_grid group by 1,2,3)
select block, count(*) as n, {q6("case when count(*)>=3 and stddev_pop(a)>0 and stddev_pop(b)>0 then corr(a,b) end","corr")} from s group by 1"""))
def tmp08(spark, sf):
    first = V.grid(spark, sf).agg(F.min("day")).scalar()
    return T.window_pattern_correlation(V.grid(spark, sf), "value", "ref", 90, first).select("block", "n", R("corr").alias("corr"))


@query("tmp09_doy_climatology", """
with g as (select dayofyear(l_shipdate)-1 as doy, cast(l_shipdate as date) as day, cast(l_partkey%4 as int) as iy, cast(l_suppkey%4 as int) as ix, l_quantity as v from lineitem),
n as (select doy, count(distinct day) as nd from g group by 1),
s as (select g.doy, iy, ix, sum(v)/any_value(nd) as c from g join n on g.doy=n.doy group by 1,2,3),
c as (select w.doy, w.iy, w.ix, coalesce(s.c, 0e0) as c from (select distinct iy, ix, y.doy from g, (select unnest(range(366)) as doy) y) w left join s on s.doy=w.doy and s.iy=w.iy and s.ix=w.ix)
select cast((doy+o+366)%366 as int) as doy, iy, ix, floor((sum(c)/5)*1e6+0.5e0)/1e6 as climatology from c, (select unnest([-2,-1,0,1,2]) as o) group by 1,2,3""")
def tmp09(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.to_date("l_shipdate").alias("day"), (F.col("l_partkey") % 4).cast("int").alias("iy"),
        (F.col("l_suppkey") % 4).cast("int").alias("ix"), F.col("l_quantity").alias("value"))
    return T.doy_climatology(li, smooth=5).withColumn("climatology", R("climatology"))


@query("tmp10_cell_ceiling", sql("fx_grid", f"select iy, ix, {q6('greatest(max(value),1)','ceiling')} from fx_grid group by 1,2"))
def tmp10(spark, sf):
    return T.cell_ceiling(V.grid(spark, sf)).withColumn("ceiling", R("ceiling"))


@query("tmp11_temporal_stats", sql("fx_grid", f"""
select iy, ix, {q6("avg(case when value>10 then value end)","v_mean")}, {q6("stddev_pop(case when value>10 then value end)","v_std")}, count(case when value>10 then value end) as v_n from fx_grid group by 1,2"""))
def tmp11(spark, sf):
    g = V.grid(spark, sf).withColumn("v", F.when(F.col("value") > 10, F.col("value")))
    return T.temporal_statistics(g, ["v"]).select("iy", "ix", R("v_mean").alias("v_mean"), R("v_std").alias("v_std"), "v_n")


SEASON_SQL = "case when month(day) in (12,1,2) then 'DJF' when month(day) in (3,4,5) then 'MAM' when month(day) in (6,7,8,9) then 'JJAS' else 'ON' end"


@query("tmp12_period_climatology", sql("fx_grid", f"""
with y as (select {SEASON_SQL} as period, year(day) as yr, iy, ix, avg(value) as m, stddev_pop(value) as s from fx_grid group by 1,2,3,4)
select period, iy, ix, {q6("avg(m)","mean")}, {q6("avg(s)","within_sd")}, count(m) as n_years from y group by 1,2,3"""))
def tmp12(spark, sf):
    c = T.period_climatology(V.grid(spark, sf), S.season("day"))
    return c.select("period", "iy", "ix", R("mean").alias("mean"), R("within_sd").alias("within_sd"), "n_years")


@query("tmp13_coverage", sql("fx_obs", f"""
select station_id, count(distinct date) as n_obs, 30::bigint as n_days, {q6("count(distinct date)/30e0","coverage")}, count(distinct date)/30e0>=0.75e0 as kept
from fx_obs where precip_mm is not null and date between date '2024-01-01' and date '2024-01-30' group by 1"""))
def tmp13(spark, sf):
    return T.coverage(V.obs(spark, sf), *record(), 0.75).withColumn("coverage", R("coverage"))


@query("tmp13_on_spine", sql("fx_obs", f"""
with d as (select station_id, d.d as date from (select distinct station_id from fx_obs), (select cast(unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day)) as date) as d) d)
select d.station_id, d.date, {q6("o.precip_mm","precip_mm")} from d left join fx_obs o on o.station_id=d.station_id and o.date=d.date"""))
def tmp13b(spark, sf):
    return T.on_spine(V.obs(spark, sf), *record()).withColumn("precip_mm", R("precip_mm"))


@query("tmp14_stuck_runs", """
with s as (select l_partkey as station_id, cast(l_shipdate as date) as date, max(l_quantity) as v from lineitem group by 1,2),
q as (select station_id, date, floor(v/12e0) as v from s),
b as (select *, case when v = lag(v) over w and v>0 then 0 else 1 end as brk from q window w as (partition by station_id order by date)),
r as (select *, sum(brk) over (partition by station_id order by date rows unbounded preceding) as run from b),
g as (select station_id, run, count(*) as n, count(*) filter (where v>3) as o from r group by 1,2)
select station_id, max(n) as longest_run, cast(sum(o) as bigint) as n_over_max, (sum(o)>0 or max(n)>=5) as suspicious from g group by 1""")
def tmp14(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("station_id"), F.to_date("l_shipdate").alias("date")).agg(
        F.floor(F.max("l_quantity") / 12).cast("double").alias("precip_mm"))
    return T.stuck_runs(s, max_mm=3, flag_at=5)


@query("tmp15_segments", sql("fx_obs", """
with b as (select station_id, date, case when date - lag(date) over (partition by station_id order by date) > 1 then 1 else 0 end as g from fx_obs)
select station_id, date, cast(sum(g) over (partition by station_id order by date rows unbounded preceding) as int) as segment from b"""))
def tmp15(spark, sf):
    return T.segments(V.obs(spark, sf).select("station_id", "date"), ["station_id"])


SHIP = "d as (select distinct cast(l_shipdate as date) as date from lineitem)"


@query("tmp16_even_days", f"""with {SHIP}, i as (select date, row_number() over (order by date)-1 as i, count(*) over () as n from d)
select date from i where i in (select cast(floor(k*((select any_value(n) from i)-1)/39e0) as bigint) from (select unnest(range(40)) as k))""")
def tmp16(spark, sf):
    return T.evenly_spaced_days(table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")), 40)


@query("tmp16_balanced_days", f"""with {SHIP}, m as (select date, strftime(date,'%Y-%m') as period from d where month(date) in (6,7,8)),
i as (select *, row_number() over (partition by period order by date)-1 as i, count(*) over (partition by period) as size, dense_rank() over (order by period)-1 as g from m),
q as (select *, row_number() over (order by i, g) as deal from i),
c as (select *, count(*) filter (where deal<=50) over (partition by period) as quota from q)
select period, date from c where quota>0 and i in (select cast(floor((k+0.5e0)*size/quota) as bigint) from (select unnest(range(50)) as k) where k<quota)""")
def tmp16b(spark, sf):
    return T.balanced_days(table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")), 50, (6, 7, 8))


AREA = """a as (select day, sum(value*w)/sum(w) as a, sum(ref*w)/sum(w) as b from (select *, cos(radians(20e0+(iy+0.5e0)*0.5e0)) as w from fx_grid) group by 1)"""


def _area_series(spark, sf):
    return T.area_mean_series(V.grid(spark, sf), F.cos(F.radians(G.lat())), ["value", "ref"])


@query("tmp17_area_mean", sql("fx_grid", f"with {AREA} select day, {q6('a','value')}, {q6('b','ref')} from a"))
def tmp17(spark, sf):
    return _area_series(spark, sf).select("day", R("value").alias("value"), R("ref").alias("ref"))


@query("tmp18_lag_correlations", sql("fx_obs fx_prod", f"""
with s as (select o.date, o.a, p.b from (select date, avg(precip_mm) as a from fx_obs group by 1) o join (select date, avg(product_mm) as b from fx_prod group by 1) p on o.date=p.date)
select l as lag, {q6("corr(x.a,y.b)","corr")}, count(*) as n from s x, s y, (select unnest([-2,-1,0,1,2]) as l) where y.date = x.date + cast(l as int) group by 1"""))
def tmp18(spark, sf):
    s = V.obs(spark, sf).groupBy("date").agg(F.avg("precip_mm").alias("a")).join(
        V.prod(spark, sf).groupBy("date").agg(F.avg("product_mm").alias("b")), "date")
    return T.lag_correlations(s, "a", "b", [-2, -1, 0, 1, 2]).withColumn("corr", R("corr"))


@query("tmp19_lag_scan", sql("fx_obs fx_multi", f"""
with g as (select product, l as lag, count(*) as n, corr(pred,precip_mm) as c, avg(pred-precip_mm) as b, sqrt(avg(pow(pred-precip_mm,2))) as r
 from fx_obs o, fx_multi p, (select unnest([-2,-1,0,1,2]) as l) where p.station_id=o.station_id and p.date = o.date + cast(l as int) group by 1,2 having count(*)>=30)
select product, lag, n, {q6("c","corr")}, {q6("b","bias")}, {q6("r","rmse")}, row_number() over (partition by product order by c desc, lag)=1 as best from g"""))
def tmp19(spark, sf):
    g = T.lag_scan(V.obs(spark, sf).withColumnRenamed("precip_mm", "obs"), V.multi(spark, sf), [-2, -1, 0, 1, 2])
    return g.select("product", "lag", "n", R("corr").alias("corr"), R("bias").alias("bias"), R("rmse").alias("rmse"), "best")


@query("tmp20_case_days", sql("fx_grid", f"""with {AREA},
q as (select unnest([0.1e0,0.5e0,0.9e0]) as quantile, unnest(quantile_cont(a,[0.1e0,0.5e0,0.9e0])) as t from a),
p as (select quantile, day, a, row_number() over (partition by quantile order by abs(a-t), day) as r from a, q)
select quantile, day, {q6("a","value")} from p where r=1"""))
def tmp20(spark, sf):
    return T.case_days(_area_series(spark, sf).select("day", "value"), [0.1, 0.5, 0.9]).withColumn("value", R("value"))
