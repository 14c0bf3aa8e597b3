"""Queries over summaries, fits, geostatistics and bias correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainloom.functions import ensemble as EN, order as O, scalar as S
from rainloom.functions.lattice import VIEW_LATTICE as G
from rainloom.operators import bias as B, grid as GR, stats as ST, temporal as T
from rainloom.plans import views as V
from rainloom.plans.registry import query
from rainloom.plans.scalars import TEXT_CELL_SQL, hav, q6, text_cells
from rainloom.plans.temporal import CAL, SEASON_SQL, record
from rainloom.plans.views import sql, table

R = S.rounded


def report(df, ints=()):
    """Round every double column for the report."""
    return df.select(*[R(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("agg01_station_summary", sql("fx_obs", f"""
select station_id, count(precip_mm) as n_obs, {q6("count(precip_mm)/30e0","coverage")}, {q6("avg(case when precip_mm>0 then 1e0 else 0e0 end)","wet_fraction")},
 {q6("avg(precip_mm)","mean_mm")}, {q6("quantile_cont(precip_mm,0.95)","p95_mm")}, {q6("max(precip_mm)","max_mm")}, {q6("sum(precip_mm)","total_mm")} from fx_obs group by 1"""))
def agg01(spark, sf):
    return report(ST.station_summary(V.obs(spark, sf), 30).drop("p99_mm"))


@query("agg02_station_p99", sql("fx_obs", f"""
select station_id, count(precip_mm) as n_obs, {q6("count(precip_mm)/30e0","coverage")}, {q6("avg(precip_mm)","mean_mm")},
 {q6("quantile_cont(precip_mm,0.99)","p99_mm")}, {q6("max(precip_mm)","max_mm")} from fx_obs group by 1"""))
def agg02(spark, sf):
    return report(ST.station_summary(V.obs(spark, sf), 30).drop("p95_mm", "wet_fraction", "total_mm"))


@query("agg03_ingest_report", f"""
with c as (select {TEXT_CELL_SQL} as cell from events),
 n as (select upper(trim(cell)) in ('','***','NA','N/A','NULL','NONE') as miss, try_cast(trim(cell) as double) as raw from c),
 v as (select miss, raw, case when miss then null else raw end as v from n),
 g as (select *, case when v in (-999,-9999,-99.9,999,9999) or v<0 or v>1000 then null else v end as good from v)
select count(*) as cells, count(good) as valid, count(*) filter (where v in (-999,-9999,-99.9,999,9999)) as sentinels, count(*) filter (where v<0) as negatives,
 count(*) filter (where v>1000) as over_max, count(*) filter (where not miss and raw is null) as unknown_tokens, {q6("count(good)/count(*)","coverage")},
 {q6("avg(case when good>0 then 1e0 when good is not null then 0e0 end)","wet_fraction")}, {q6("avg(good)","mean_mm")}, {q6("max(good)","max_mm")} from g""")
def agg03(spark, sf):
    return report(ST.ingest_report(text_cells(spark, sf), "cell"))


ARCHIVE = f"""ar as (select *, upper(trim(cell)) in ('','***','NA','N/A','NULL','NONE') as miss, try_cast(trim(cell) as double) as raw from (select {TEXT_CELL_SQL} as cell, 'Station '||(user_id%7) as catalogued,
 case when user_id%3=0 then 'Old station-'||(user_id%7) else 'station_'||(user_id%7) end as source, try_cast(strftime(ts,'%Y-%m-')||lpad(cast(1+event_id%31 as varchar),2,'0') as date) as date from events)),
av as (select *, case when miss then null else raw end as v from ar where date is not null), ag as (select *, case when v in (-999,-9999,-99.9,999,9999) or v<0 or v>1000 then null else v end as good from av)"""


def archive_cells(spark, sf):
    """Text cells with archive and catalogue names and a day of the month that need not exist."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    k = (F.col("user_id") % 7).cast("string")
    d = text_cells(spark, sf).join(e, "event_id").withColumn("catalogued", F.concat(F.lit("Station "), k))
    d = d.withColumn("source", F.concat(F.when(F.col("user_id") % 3 == 0, F.lit("Old station-")).otherwise(F.lit("station_")), k))
    return d, F.try_to_date(F.concat(F.date_format("ts", "yyyy-MM-"), F.lpad((F.col("event_id") % 31 + 1).cast("string"), 2, "0")), "yyyy-MM-dd")


@query("agg03_archive_report", f"""with {ARCHIVE}
select (select count(*) from ar where date is null) as invalid_calendar_cells, min(date) as date_start, max(date) as date_end, count(distinct catalogued) as stations, (select count(distinct source||catalogued) from ag where source like 'Old%') as aliases,
 1000e0 as max_mm_threshold, count(*) as cells, count(good) as valid, count(*) filter (where v in (-999,-9999,-99.9,999,9999)) as sentinels, count(*) filter (where v<0) as negatives,
 count(*) filter (where v>1000) as over_max, count(*) filter (where not miss and raw is null) as unknown_tokens, {q6("count(good)/count(*)","coverage")},
 {q6("avg(case when good>0 then 1e0 when good is not null then 0e0 end)","wet_fraction")}, {q6("avg(good)","mean_mm")}, {q6("max(good)","max_mm")} from ag""")
def agg03_archive(spark, sf):
    d, date = archive_cells(spark, sf)
    return report(ST.archive_report(d, "cell", date, "source", "catalogued"))


@query("agg03_aliases_used", f"with {ARCHIVE} select distinct source, catalogued from ag where source like 'Old%'")
def agg03_aliases(spark, sf):
    d, date = archive_cells(spark, sf)
    return ST.aliases_used(d, date, "source", "catalogued")


@query("agg04_satellite_report", sql("fx_grid", f"""
with g as (select *, case when value>8 then value end as v from fx_grid), d as (select day, avg(case when v is not null then 1e0 else 0e0 end) as f from g group by 1)
select {q6("(select avg(case when v is not null then 1e0 else 0e0 end) from g)","valid_fraction")}, {q6("(select min(f) from d)","daily_valid_min")},
 {q6("(select median(f) from d)","daily_valid_median")}, {q6("(select max(f) from d)","daily_valid_max")}, {q6("avg(v)","mean_mm")}, {q6("quantile_cont(v,0.99)","p99_mm")},
 {q6("max(v)","max_mm")}, {q6("quantile_cont(ref,0.5)","error_median")}, {q6("quantile_cont(ref,0.9)","error_p90")} from g"""))
def agg04(spark, sf):
    g = V.grid(spark, sf).withColumn("value", F.when(F.col("value") > 8, F.col("value")))
    return report(ST.satellite_report(g, error="ref"))


@query("agg05_transform_fit", sql("fx_obs", f"select {q6('avg(ln(1+precip_mm/0.1e0))','mu')}, {q6('stddev_pop(ln(1+precip_mm/0.1e0))+1e-12','sd')} from fx_obs"))
def agg05(spark, sf):
    return report(ST.fit_transform(V.obs(spark, sf), "precip_mm"))


@query("agg06_channel_stats", sql("fx_multi", f"""
with c as (select case product when 'signup' then 'era5_tp' else 'era5_cape' end as channel, pred from fx_multi),
y as (select channel, pred, case channel when 'era5_tp' then ln(1+pred/0.1e0) else sqrt(pred) end as y from c)
select channel, {q6("avg(y)","mean")}, {q6("stddev_pop(y)","std")}, count(pred) as n, {q6("avg(case when pred>=1 then 1e0 else 0e0 end)","wet_fraction")}, {q6("max(pred)","max_mm")} from y group by 1"""))
def agg06(spark, sf):
    d = V.multi(spark, sf).withColumn("channel", F.when(F.col("product") == "signup", "era5_tp").otherwise("era5_cape"))
    return report(ST.channel_statistics(d, "channel", "pred"))


@query("agg07_residual_stats", sql("fx_pair", f"""
with r as (select ln(1+obs/0.1e0) as t, ln(1+pred/0.1e0) as b from fx_pair), s as (select count(*) as n, avg(t-b) as m, stddev_pop(t-b) as sd, corr(t,b) as c, max(t-b) hi, min(t-b) lo from r)
select n, {q6("m","mean")}, {q6("sd","std")}, {q6("c","base_corr")}, {q6("greatest(abs((hi-m)/sd),abs((lo-m)/sd))","encoded_abs_max")} from s"""))
def agg07(spark, sf):
    return report(ST.residual_statistics(V.pair(spark, sf), S.rain_forward("obs"), S.rain_forward("pred")))


PAIR_SQL = f"""count(*) as n, {q6("corr(pred,obs)","corr")}, {q6("avg(pred-obs)","bias")}, {q6("avg(abs(pred-obs))","mae")}, {q6("sqrt(avg(pow(pred-obs,2)))","rmse")}"""


@query("agg08_running_pair", sql("fx_multipair", f"select product, {PAIR_SQL} from fx_multipair group by 1"))
def agg08(spark, sf):
    return report(ST.finish_pair(ST.running_pair(V.multipair(spark, sf), ["product"]), ["product"]))


@query("agg09_drizzle", sql("fx_multi", f"""
select product, {q6("avg(case when pred>0 then case when pred<5 then 1e0 else 0e0 end end)","drizzle_cells")}, {q6("sum(case when pred>0 and pred<5 then pred else 0 end)/sum(case when pred>0 then pred end)","drizzle_mass")} from fx_multi group by 1"""))
def agg09(spark, sf):
    return report(ST.drizzle(V.multi(spark, sf), "pred", 5.0, ["product"]))


@query("agg10_daily_spatial", sql("fx_grid", f"""
select day, {q6("avg(value)","domain_mean")}, {q6("stddev_pop(value)","spatial_std")}, {q6("avg(case when value>=25 then 1e0 else 0e0 end)","wet_area")}, {q6("quantile_cont(value,0.95)","p95")} from fx_grid group by 1"""))
def agg10(spark, sf):
    return report(ST.daily_spatial(V.grid(spark, sf), "value", wet=25.0))


@query("agg11_physical_summary", f"""
select l_returnflag, count(l_extendedprice) as n, {q6("avg(l_extendedprice)","mean")}, {q6("quantile_cont(l_extendedprice,0.99)","p99")}, {q6("quantile_cont(l_extendedprice,0.999)","p999")}, {q6("max(l_extendedprice)","max")} from lineitem group by 1""")
def agg11(spark, sf):
    return report(ST.physical_summary(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]))


VARIO = f"""e as (select * from (values (0,0e0,30e0),(1,30e0,60e0),(2,60e0,100e0),(3,100e0,150e0)) t(bin,lo,hi)),
pp as (select a.station_id as a, b.station_id as b, {hav("a.lat","a.lon","b.lat","b.lon")} as km from fx_station a join fx_station b on a.station_id<b.station_id),
pb as (select pp.*, bin, lo, hi from pp join e on km>=lo and km<hi),
vg as (select bin, any_value(lo) as lo, any_value(hi) as hi, 0.5e0*avg(pow(x.precip_mm-y.precip_mm,2)) as g, avg(km) as d, count(*) as n from pb join fx_obs x on x.station_id=a join fx_obs y on y.station_id=b and x.date=y.date group by 1),
vb as (select bin, case when n>=30 then d else (lo+hi)/2 end as h, case when n>=30 then g end as g, n from vg)"""
EDGES = [0.0, 30.0, 60.0, 100.0, 150.0]


@query("agg12_variogram", sql("fx_station fx_obs", f"with {VARIO} select bin, {q6('h','distance_km')}, {q6('g','gamma')}, n as n_pairs from vb"))
def agg12(spark, sf):
    return report(ST.empirical_variogram(V.obs(spark, sf), V.station(spark, sf), EDGES))


VFIT = """u as (select h, g, n/(sum(n) over ()) as w from vb where g is not null),
lim as (select min(h) as lo, greatest(max(h)*5, min(h)*10) as hi from u),
rg as (select k, exp(ln(lo)+k/399e0*(ln(hi)-ln(lo))) as r from lim, (select unnest(range(400)) as k)),
sm as (select k, r, sum(w*(1-exp(-h/r))) s1, sum(w*pow(1-exp(-h/r),2)) s2, sum(w*g) g0, sum(w*g*(1-exp(-h/r))) g1 from u, rg group by 1,2),
so as (select *, (g0*s2-g1*s1)/(s2-s1*s1) as nn, (g1-s1*g0)/(s2-s1*s1) as ss from sm),
pr as (select k, r, case when ss<0 then greatest(g0,0) when nn<0 then 0 else nn end as nugget, case when ss<0 then 0 when nn<0 then greatest(g1/greatest(s2,1e-12),0) else ss end as sill from so),
sc as (select k, r, nugget, sill, sum(w*pow(g-(nugget+sill*(1-exp(-h/r))),2)) as score from pr, u group by 1,2,3,4),
ft as (select r, nugget, sill, score from sc order by score, k limit 1)"""


@query("agg13_variogram_fit", sql("fx_station fx_obs", f"with {VARIO}, {VFIT} select floor((nugget)*1e3+0.5e0)/1e3 as nugget, floor((sill)*1e3+0.5e0)/1e3 as sill, floor((sqrt(score))*1e3+0.5e0)/1e3 as fit_rmse, (select count(*) from u)::int as n_bins from ft where (select count(*) from u)>=3"))
def agg13(spark, sf):
    f = ST.fit_variogram(ST.empirical_variogram(V.obs(spark, sf), V.station(spark, sf), EDGES))
    return f.select(R("nugget", 3).alias("nugget"), R("sill", 3).alias("sill"), R("fit_rmse", 3).alias("fit_rmse"), "n_bins")


@query("agg14_block_dispersion", sql("fx_station fx_obs", f"""with {VARIO}, {VFIT},
pt as (select i*12+j as id, (i+0.5e0)/12*5 as x, (j+0.5e0)/12*5 as y from (select unnest(range(12)) as i), (select unnest(range(12)) as j)),
pd as (select sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) as h from pt a join pt b on a.id<b.id)
select floor((avg(nugget+sill*(1-exp(-h/greatest(r,1e-9)))))*1e3+0.5e0)/1e3 as block_variance, floor((sqrt(avg(nugget+sill*(1-exp(-h/greatest(r,1e-9))))))*1e3+0.5e0)/1e3 as rep_sigma from ft, pd having (select count(*) from u)>=3"""))
def agg14(spark, sf):
    f = ST.fit_variogram(ST.empirical_variogram(V.obs(spark, sf), V.station(spark, sf), EDGES))
    return ST.block_dispersion(f, 5.0).select(R("block_variance", 3).alias("block_variance"), R("rep_sigma", 3).alias("rep_sigma"))


def window_scores(spark, sf):
    m = T.calendar_blocks(V.pair(spark, sf), ["station_id"], ["obs", "pred"], [1, 5, 10, 30], *record())
    d = F.col("pred") - F.col("obs")
    return m.groupBy("window").agg(F.avg(d * d).alias("mse"), F.count("*").alias("n")).where("n > 10")


@query("agg15_aggregation_decomposition", sql("fx_pair", f"""with {CAL},
s as (select window_days as w, avg(pow(pred-obs,2)) as mse from m group by 1 having count(*)>10),
f as (select count(*) as n, regr_intercept(mse,1e0/w) as a0, regr_slope(mse,1e0/w) as b from s), g as (select *, greatest(a0,0) as a from f)
select any_value(n) as n_windows, floor((any_value(a))*1e3+0.5e0)/1e3 as systematic_mse, floor((any_value(b))*1e3+0.5e0)/1e3 as random_mse, floor((sqrt(any_value(a)))*1e3+0.5e0)/1e3 as systematic_rmse, floor((sqrt(greatest(any_value(b),0)))*1e3+0.5e0)/1e3 as random_rmse_daily,
 floor((1-sum(pow(mse-a-b/w,2))/sum(pow(mse-(select avg(mse) from s),2)))*1e5+0.5e0)/1e5 as r_squared, any_value(a0<0) as intercept_was_negative, any_value(b<0) as error_grows, any_value(a0>=0 and b>=0) as model_is_valid from s, g having count(*)>=2"""))
def agg15(spark, sf):
    f = ST.aggregation_decomposition(window_scores(spark, sf))
    return f.select("n_windows", *[R(c, 3).alias(c) for c in ("systematic_mse", "random_mse", "systematic_rmse", "random_rmse_daily")],
                    R("r_squared", 5).alias("r_squared"), "intercept_was_negative", "error_grows", "model_is_valid")


@query("agg16_observation_error", sql("fx_multipair", f"""
with d as (select product, k as scope, ln(1+pred/0.1e0)-ln(1+obs/0.1e0) as d from fx_multipair, (values ('all'),('wet')) s(k) where k='all' or obs>=1),
g as (select product, scope, count(d) as n, avg(d) as m, var_samp(d) as v from d group by 1,2)
select product, scope, n, {q6("m","mean_difference")}, {q6("sqrt(v)","total_sigma")}, {q6("case when v-0.25e0>0 then sqrt(v-0.25e0) end","sigma_obs")}, {q6("0.25e0/v","representativeness_share")}, v-0.25e0>0 as split_is_valid from g"""))
def agg16(spark, sf):
    d = V.multipair(spark, sf).withColumn("scope", F.explode(F.when(F.col("obs") >= 1, F.array(F.lit("all"), F.lit("wet"))).otherwise(F.array(F.lit("all")))))
    return report(ST.observation_error(d, S.rain_forward("pred"), S.rain_forward("obs"), 0.5, ["product", "scope"]))


IBINS = """x as (select ln(1+obs/0.1e0) as x, ln(1+pred/0.1e0)-ln(1+obs/0.1e0) as d from fx_pair),
ed as (select list_sort(list_distinct(quantile_cont(x,[0,1/12,2/12,3/12,4/12,5/12,6/12,7/12,8/12,9/12,10/12,11/12,1]))) as e from x),
ib as (select len([q for q in e if q<=x])-1 as bin, len(e) as ne, x, d from x, ed),
bn as (select cast(bin as int) as bin, avg(x) as centre, stddev_samp(d) as sigma, count(*) as n from ib where bin<ne-1 group by 1)"""


@query("agg17_intensity_bins", sql("fx_pair", f"with {IBINS} select bin, {q6('centre','centre')}, {q6('sigma','sigma')}, n from bn"))
def agg17(spark, sf):
    return report(ST.intensity_bins(V.pair(spark, sf), "obs", S.rain_forward("pred") - S.rain_forward("obs")))


@query("agg17_intensity_fit", sql("fx_pair", f"""with {IBINS}, k as (select * from bn where n>=10),
s as (select count(*) bins, sum(n) w, sum(n*centre) wx, sum(n*sigma) wy, sum(n*centre*centre) wxx, sum(n*centre*sigma) wxy, max(sigma) mx, avg(sigma) my from k),
f as (select *, (w*wxy-wx*wy)/(w*wxx-wx*wx) as b from s), h as (select *, (wy-b*wx)/w as a from f)
select any_value(bins) as bins, {q6("any_value(a)","sigma_floor")}, {q6("any_value(b)","sigma_slope")}, {q6("any_value(mx)","max_sigma")}, {q6("1-sum(pow(sigma-a-b*centre,2))/sum(pow(sigma-my,2))","r_squared")} from k, h"""))
def agg17b(spark, sf):
    b = ST.intensity_bins(V.pair(spark, sf), "obs", S.rain_forward("pred") - S.rain_forward("obs"))
    return report(ST.fit_intensity_error(b, 10))


def cut_sql(rounding):
    return f"""with a as (select station_id, list_sort(list(pred)) as s, avg(case when obs>=20 then 1e0 else 0e0 end) as f from fx_pair group by 1),
k as (select *, len(s) as n, cast({rounding} as int) as nw from a)
select station_id, {q6("f","wet_fraction")}, {q6("case when nw<=0 then s[n]+1 when nw>=n then 0 else s[n-nw+1] end","cut")}, cast(n as int) as n from k"""


@query("agg18_frequency_cut", sql("fx_pair", cut_sql("round_even(len(s)*f,0)")))
def agg18(spark, sf):
    return report(B.frequency_cut(V.pair(spark, sf), ["station_id"], "pred", "obs", 20.0))


@query("agg18_frequency_cut_truncated", sql("fx_pair", cut_sql("floor(len(s)*f)")))
def agg18b(spark, sf):
    return report(B.frequency_cut(V.pair(spark, sf), ["station_id"], "pred", "obs", 20.0, rounding="truncate"))


def _samples(spark, sf, pool=3):
    g = V.grid(spark, sf).select("day", "iy", "ix", "value", "ref", F.year("day").alias("year"), S.season("day").alias("stratum"))
    return g, (GR.pool_neighbourhood(g, pool, 16, 16) if pool > 1 else g)


QMAP = f"""g0 as (select day, iy, ix, value, ref, year(day) as yr, {SEASON_SQL} as stratum from fx_grid),
pool as (select iy+dy as iy, ix+dx as ix, value, ref, yr, stratum from g0, (select unnest([-1,0,1]) as dy), (select unnest([-1,0,1]) as dx) where iy+dy between 0 and 15 and ix+dx between 0 and 15),
hy as (select distinct yr as holdout from g0),
gr as (select holdout, stratum, iy, ix, list_sort(list(ref)) as s, list_sort(list(value)) as t from pool join hy on yr<>holdout group by 1,2,3,4),
w1 as (select *, len(s) as n, [x for x in t if x>=20] as wt, round_even(len([x for x in t if x>=20])*1e0/len(s)*len(s),0) as nw from gr),
w2 as (select *, case when n<20 then 0e0 when nw<=0 then s[n]+1 when nw>=n then 0e0 else s[cast(n-nw+1 as int)] end as cut from w1),
w3 as (select *, [x for x in s if x>=cut and x>0] as ws from w2),
kn as (select holdout, stratum, iy, ix, n, cut,
 case when n<20 or len(ws)<2 or len(wt)<2 then [0e0,1e0] else [ws[cast(floor((len(ws)-1)*(k/10e0)) as int)+1] + ((len(ws)-1)*(k/10e0)-floor((len(ws)-1)*(k/10e0)))*(ws[cast(least(floor((len(ws)-1)*(k/10e0))+1,len(ws)-1) as int)+1]-ws[cast(floor((len(ws)-1)*(k/10e0)) as int)+1]) for k in range(11)] end as sk,
 case when n<20 or len(ws)<2 or len(wt)<2 then [0e0,1e0] else [wt[cast(floor((len(wt)-1)*(k/10e0)) as int)+1] + ((len(wt)-1)*(k/10e0)-floor((len(wt)-1)*(k/10e0)))*(wt[cast(least(floor((len(wt)-1)*(k/10e0))+1,len(wt)-1) as int)+1]-wt[cast(floor((len(wt)-1)*(k/10e0)) as int)+1]) for k in range(11)] end as tk from w3)"""


@query("agg19_quantile_map_fit", sql("fx_grid", f"""with {QMAP}
select cast(holdout as int) as holdout, stratum, iy, ix, cast(n as int) as n, {q6("cut","cut")}, {q6("sk[1]","s_low")}, {q6("sk[len(sk)]","s_top")}, {q6("tk[1]","t_low")}, {q6("tk[len(tk)]","t_top")}, floor((list_sum(sk))*1e3+0.5e0)/1e3 as s_sum, floor((list_sum(tk))*1e3+0.5e0)/1e3 as t_sum from kn"""))
def agg19(spark, sf):
    _, pooled = _samples(spark, sf)
    m = B.fit_quantile_map(pooled, "ref", "value", n_knots=11, wet_mm=20.0, min_samples=20)
    s, t = F.col("source_knots"), F.col("target_knots")
    return m.select("holdout", "stratum", "iy", "ix", "n", R("cut").alias("cut"), R(s[0]).alias("s_low"), R(F.element_at(s, -1)).alias("s_top"), R(t[0]).alias("t_low"),
                    R(F.element_at(t, -1)).alias("t_top"), R(EN.total(s), 3).alias("s_sum"), R(EN.total(t), 3).alias("t_sum"))


APPLY = f"""{QMAP}, ap as (select g0.*, cut, sk, tk, cast(len([x for x in sk if x<=ref]) as int) as k from g0 join kn on kn.holdout=g0.yr and kn.stratum=g0.stratum and kn.iy=g0.iy and kn.ix=g0.ix),
co as (select day, iy, ix, value, ref, yr, stratum, case when ref>=cut and ref>0 then greatest(0e0, case when sk[len(sk)]>0 and ref>sk[len(sk)] then ref*tk[len(tk)]/sk[len(sk)]
 when k=0 then tk[1] when k=len(sk) then tk[len(tk)] else tk[k]+(ref-sk[k])*(tk[k+1]-tk[k])/(sk[k+1]-sk[k]) end) else 0e0 end as corrected from ap)"""


def _corrected(spark, sf):
    g, pooled = _samples(spark, sf)
    m = B.fit_quantile_map(pooled, "ref", "value", n_knots=11, wet_mm=20.0, min_samples=20)
    return B.apply_quantile_map(g, m, "ref")


@query("agg20_quantile_map_apply", sql("fx_grid", f"with {APPLY} select day, iy, ix, {q6('corrected','corrected')} from co"))
def agg20(spark, sf):
    return _corrected(spark, sf).select("day", "iy", "ix", R("corrected").alias("corrected"))


@query("agg21_correction_report", sql("fx_grid", f"""with {APPLY}
select stratum, count(corrected-value) as n, {q6("avg(ref-value)","raw_bias")}, {q6("avg(corrected-value)","corrected_bias")}, {q6("sqrt(avg(pow(ref-value,2)))","raw_rmse")}, {q6("sqrt(avg(pow(corrected-value,2)))","corrected_rmse")},
 {q6("avg(case when ref>=1 then 1e0 else 0e0 end)","raw_wet")}, {q6("avg(case when corrected>=1 then 1e0 else 0e0 end)","corrected_wet")}, {q6("avg(case when value>=1 then 1e0 else 0e0 end)","target_wet")} from co group by rollup(stratum)"""))
def agg21(spark, sf):
    return report(B.correction_report(_corrected(spark, sf), "ref", "corrected", "value", ["stratum"]))


@query("agg21_bias_persistence", sql("fx_grid", f"""
with y as (select {SEASON_SQL} as stratum, year(day) as yr, avg(ref-value) as b from fx_grid group by 1,2), s as (select stratum, count(*) n, sum(b) s from y group by 1)
select y.stratum, count(*) as years, {q6("avg(b)","mean_bias")}, {q6("stddev_pop(b)","sd_bias")}, {q6("avg(abs(b-(s-b)/(n-1)))","loyo_error")} from y join s on s.stratum=y.stratum group by 1"""))
def agg21b(spark, sf):
    g, _ = _samples(spark, sf, 1)
    return report(B.bias_persistence(g, "ref", "value", ["stratum"]))


@query("agg22_fisher_pooled", sql("fx_multipair", f"""
with s as (select product, station_id, count(*) as n, case when stddev_pop(pred)>0 and stddev_pop(obs)>0 then corr(pred,obs) end as c, avg(pow(pred-obs,2)) as mse, avg(abs(pred-obs)) as mae from fx_multipair group by 1,2),
f as (select *, greatest(n-3,1) as w, case when c is not null then atanh(least(greatest(c,-0.999999e0),0.999999e0)) end as z from s)
select product, {q6("tanh(sum(z*w)/sum(case when z is not null then w end))","corr")}, {q6("sqrt(sum(mse*n)/sum(n))","rmse")}, {q6("sum(mae*n)/sum(n)","mae")} from f group by 1"""))
def agg22(spark, sf):
    d = F.col("pred") - F.col("obs")
    s = V.multipair(spark, sf, steady=True).groupBy("product", "station_id").agg(F.count("*").alias("n"), ST.safe_corr("pred", "obs").alias("c"),
                                                                     F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"))
    return report(s.groupBy("product").agg(ST.fisher_pooled("c", "n").alias("corr"), F.sqrt(ST.weighted_mean("mse", "n")).alias("rmse"),
                                           ST.weighted_mean("mae", "n").alias("mae")))


@query("agg23_mean_of_days", sql("fx_multipair", f"""
with d as (select product, date, avg(pred-obs) as b, sqrt(avg(pow(pred-obs,2))) as r, case when stddev_pop(pred)>0 and stddev_pop(obs)>0 then corr(pred,obs) end as c from fx_multipair group by 1,2)
select product, count(*) as days, {q6("avg(b)","bias")}, {q6("avg(r)","rmse")}, {q6("avg(c)","corr")} from d group by 1"""))
def agg23(spark, sf):
    d = F.col("pred") - F.col("obs")
    s = V.multipair(spark, sf).groupBy("product", "date").agg(F.avg(d).alias("b"), F.sqrt(F.avg(d * d)).alias("r"), ST.safe_corr("pred", "obs").alias("c"))
    return report(s.groupBy("product").agg(F.count("*").alias("days"), F.avg("b").alias("bias"), F.avg("r").alias("rmse"), F.avg("c").alias("corr")))


@query("agg24_score_cube", sql("fx_multipair", f"""
with w as (select unnest([1,5,10]) as window_days),
b as (select product, station_id, window_days, floor((date - date '2024-01-01')/window_days) as block, avg(obs) as obs, avg(pred) as pred, count(*) as n from fx_multipair, w
 where floor((date - date '2024-01-01')/window_days) < floor(30e0/window_days) group by 1,2,3,4 having count(*)>=0.8e0*window_days)
select product, window_days, count(*) as n, {q6("avg(pred-obs)","bias")}, {q6("avg(abs(pred-obs))","mae")}, {q6("sqrt(avg(pow(pred-obs,2)))","rmse")} from b group by grouping sets ((product,window_days),(product),())"""))
def agg24(spark, sf):
    m = T.calendar_blocks(V.multipair(spark, sf), ["product", "station_id"], ["obs", "pred"], [1, 5, 10], *record())
    d = F.col("pred") - F.col("obs")
    g = m.withColumnRenamed("window", "window_days").rollup("product", "window_days").agg(F.count("*").alias("n"), F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))
    return report(g)


@query("agg25_binned_profile", sql("fx_pair", f"""
with b as (select case when obs>=0 and obs<10 then 0 when obs>=10 and obs<50 then 1 when obs>=50 and obs<100 then 2 when obs>=100 and obs<500 then 3 end as bin, pred from fx_pair)
select bin, {q6("avg(pred)","mean")}, count(pred) as n from b where bin is not null group by 1"""))
def agg25(spark, sf):
    return report(ST.binned_profile(V.pair(spark, sf), F.col("obs"), "pred", [0, 10, 50, 100, 500]))


@query("agg26_exceedance_attribution", sql("fx_grid", f"""
with r as (select least(iy,15-iy,ix,15-ix)<2 as near_edge, ref>38 as high_ground, value>35 as hit from fx_grid),
g as (select near_edge, high_ground, count(*) as cells, count(*) filter (where hit) as hits from r group by cube(near_edge,high_ground)), t as (select count(*) as c, count(*) filter (where hit) as h from r)
select near_edge, high_ground, cells, hits, {q6("cells/c","area_share")}, {q6("hits/h","hit_share")}, {q6("(hits/h)/(cells/c)","enrichment")} from g, t"""))
def agg26(spark, sf):
    g = V.grid(spark, sf).select((ST.edge_distance(16, 16) < 2).alias("near_edge"), (F.col("ref") > 38).alias("high_ground"), "value")
    return report(ST.exceedance_attribution(g, F.col("value") > 35, ["near_edge", "high_ground"]))


@query("agg27_mask_distances", sql("fx_grid", f"""
with m as (select iy, ix, max(value)>=49.9e0 as ok from fx_grid group by 1,2)
select a.iy, a.ix, least(a.iy,15-a.iy,a.ix,15-a.ix) as edge_cells, {q6("min(sqrt(pow(a.iy-b.iy,2)+pow(a.ix-b.ix,2)))","distance")} from m a left join m b on not b.ok where a.ok group by 1,2"""))
def agg27(spark, sf):
    m = V.grid(spark, sf).groupBy("iy", "ix").agg((F.max("value") >= 49.9).alias("ok"))
    return ST.distance_to_false(m, "ok").select("iy", "ix", ST.edge_distance(16, 16).alias("edge_cells"), R("distance").alias("distance"))


@query("agg28_improved_area", sql("fx_grid", f"""
with c as (select day, iy, ix, abs(ref-value)-abs(0.5e0*(ref+value)+1-value) as gain, least(iy,ix) as d from fx_grid)
select case when d<1 then 0 when d<2 then 1 when d<3 then 2 when d<5 then 3 when d<8 then 4 when d<12 then 5 else 6 end as bin, {q6("avg(case when gain>0 then 1e0 else 0e0 end)","improved")}, {q6("avg(gain)","reduction")}, count(*) as n from c group by 1"""))
def agg28(spark, sf):
    g = V.grid(spark, sf).withColumn("an", (F.col("ref") + F.col("value")) * 0.5 + 1)
    g = g.withColumn("gain", F.abs(F.col("ref") - F.col("value")) - F.abs(F.col("an") - F.col("value"))).withColumn("improved", (F.col("gain") > 0).cast("double"))
    d, edges = F.least("iy", "ix").cast("double"), [0, 1, 2, 3, 5, 8, 12, 20, 30, float("inf")]
    a = ST.binned_profile(g, d, "improved", edges).withColumnRenamed("mean", "improved").drop("n")
    return report(a.join(ST.binned_profile(g, d, "gain", edges).withColumnRenamed("mean", "reduction"), "bin"))


@query("agg29_station_sd", sql("fx_multipair", f"""
with s as (select product, station_id, stddev_pop(pred) p, stddev_pop(obs) o from fx_multipair group by 1,2 having count(*)>=2)
select product, count(*) as stations, {q6("corr(p,o)","corr")}, {q6("avg(p-o)","bias")}, {q6("sqrt(avg(pow(p-o,2)))","rmse")}, {q6("avg(p)/avg(o)","amplitude_ratio")} from s group by 1"""))
def agg29(spark, sf):
    return report(ST.station_sd_metrics(V.multipair(spark, sf), keys=["product"]))


@query("agg30_network_days", sql("fx_multipair", f"""
select product, date, cast(date - 1 as date) as product_date, {q6("avg(pred)","mean")}, {q6("stddev_pop(pred)","sd")}, {q6("avg(case when pred>=1 then 1e0 else 0e0 end)","wet")}, count(pred) as n from fx_multipair group by 1,2"""))
def agg30(spark, sf):
    g = V.multipair(spark, sf).groupBy("product", "date").agg(F.avg("pred").alias("mean"), F.stddev_pop("pred").alias("sd"), ST.share(F.col("pred") >= 1).alias("wet"), F.count("pred").alias("n"))
    return report(g.select("product", "date", F.date_add("date", -1).alias("product_date"), "mean", "sd", "wet", "n"))


@query("agg31_member_moments", sql("fx_rain_ens", f"""
select sample_id, {q6("list_avg(members)","mean")}, {q6("list_stddev_samp(members)","spread")}, {q6("list_stddev_samp(members)-list_stddev_samp(members[1:8])","spread_change")} from fx_rain_ens"""))
def agg31(spark, sf):
    e = V.rain_ens(spark, sf)
    return e.select("sample_id", R(EN.mean("members")).alias("mean"), R(EN.std("members")).alias("spread"),
                    R(EN.std("members") - EN.std(F.slice("members", 1, 8))).alias("spread_change"))


@query("agg32_member_summaries", sql("fx_rain_ens", f"""
with p as (select day, unnest(range(16)) as k, unnest(members) as v, list_avg(members) as m from fx_rain_ens),
s as (select day, k, avg(v) a, avg(case when v>=1 then 1e0 else 0e0 end) w, max(v) x, quantile_cont(v,0.99) q, stddev_pop(v) sd, avg(m) em, avg(case when m>=1 then 1e0 else 0e0 end) ew, max(m) ex, quantile_cont(m,0.99) eq from p group by 1,2)
select day, {q6("avg(a)","member_mean")}, {q6("round(avg(w),9)","member_wet")}, {q6("avg(x)","member_max")}, {q6("avg(q)","member_p99")}, count(*) filter (where sd=0) as constant_members, {q6("any_value(em)","mean_mean")}, {q6("any_value(ew)","mean_wet")}, {q6("any_value(ex)","mean_max")}, {q6("any_value(eq)","mean_p99")} from s group by 1"""))
def agg32(spark, sf):
    s = ST.member_summaries(V.rain_ens(spark, sf), ["day"])
    # A share of members and samples can lie just between two of six digits.
    return report(s.withColumn("member_wet", F.round("member_wet", 9)))
