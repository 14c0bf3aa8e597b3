"""Queries over the Column helpers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rainloom.functions import scalar as S
from rainloom.functions.lattice import VIEW_LATTICE as G, Lattice
from rainloom.operators import grid as GR, temporal as TM
from rainloom.plans import views as V
from rainloom.plans.registry import query
from rainloom.plans.views import sql, table

R = S.rounded


def q6(e: str, name: str) -> str:
    return f"floor((cast({e} as double))*1e6+0.5e0)/1e6 as {name}"


@query("scl01_rain_transform", sql("fx_obs", f"""
select station_id, date, {q6("(ln(1+precip_mm/0.1e0)-1e0)/2e0","y_log1p")}, {q6("(sqrt(precip_mm)-1e0)/2e0","y_sqrt")},
 {q6("(pow(precip_mm,1e0/3e0)-1e0)/2e0","y_cbrt")}, {q6("(precip_mm-1e0)/2e0","y_none")}, {q6("precip_mm","back_log1p")},
 {q6("pow(greatest(sqrt(precip_mm)-3e0,0e0),2)","back_sqrt")} from fx_obs"""))
def scl01(spark, sf):
    d, p = V.obs(spark, sf), F.col("precip_mm")
    fwd = [R(S.rain_forward(p, k, 0.1, 1.0, 2.0)).alias(f"y_{k}") for k in ("log1p", "sqrt", "cbrt", "none")]
    back = S.rain_inverse(S.rain_forward(p, "log1p", 0.1, 1.0, 2.0), "log1p", 0.1, 1.0, 2.0)
    return d.select("station_id", "date", *fwd, R(back).alias("back_log1p"),
                    R(S.rain_inverse(F.sqrt(p) - 3.0, "sqrt")).alias("back_sqrt"))


@query("scl02_channel_transform", sql("fx_multi", f"""
with c as (select *, case product when 'signup' then 'era5_tp' else 'era5_cape' end as channel from fx_multi)
select station_id, date, channel, {q6("case channel when 'era5_tp' then ln(1+pred/0.1e0) else sqrt(pred) end","y")},
 {q6("pred","back")} from c"""))
def scl02(spark, sf):
    d = V.multi(spark, sf).withColumn(
        "channel", F.when(F.col("product") == "signup", "era5_tp").otherwise("era5_cape"))
    y = S.channel_forward("pred", "channel")
    return d.select("station_id", "date", "channel", R(y).alias("y"), R(S.channel_inverse(y, "channel")).alias("back"))


@query("scl03_residual_code", sql("fx_pair", f"""
select station_id, date, {q6("(ln(1+obs)-ln(1+pred)-0.5e0)/2e0","code")}, {q6("ln(1+obs)","decoded")}, {q6("-0.25e0","fill")} from fx_pair"""))
def scl03(spark, sf):
    d = V.pair(spark, sf).select("station_id", "date", F.log1p("obs").alias("t"), F.log1p("pred").alias("b"))
    d = d.withColumn("code", S.residual_encode("t", "b", F.lit(0.5), F.lit(2.0)))
    return d.select("station_id", "date", R("code").alias("code"),
                    R(S.residual_decode("code", "b", F.lit(0.5), F.lit(2.0))).alias("decoded"),
                    R(S.residual_fill(F.lit(0.5), F.lit(2.0))).alias("fill"))


@query("scl04_standardize", sql("fx_obs", f"""
with s as (select avg(precip_mm) mu, stddev_pop(precip_mm) sd from fx_obs)
select station_id, date, {q6("(precip_mm-mu)/sd","z")}, {q6("precip_mm","back")} from fx_obs, s"""))
def scl04(spark, sf):
    d = V.obs(spark, sf)
    s = V.obs(spark, sf).agg(F.avg("precip_mm").alias("mu"), F.stddev_pop("precip_mm").alias("sd"))
    mu, sd = s.select("mu").scalar(), s.select("sd").scalar()
    d = d.withColumn("z", S.standardize("precip_mm", mu, sd))
    return d.select("station_id", "date", R("z").alias("z"), R(S.unstandardize("z", mu, sd)).alias("back"))


TEXT_CELL_SQL = """case event_id % 11 when 0 then ' *** ' when 1 then 'na' when 2 then 't' when 3 then '-999' when 4 then '9999.0'
 when 5 then '-' || cast(value as varchar) when 6 then '' when 7 then 'x7' else cast(value as varchar) end"""


def text_cells(spark, sf):
    """Events as raw text cells, with every kind of missing mark."""
    v = F.col("value").cast("string")
    k = F.col("event_id") % 11
    cell = (F.when(k == 0, " *** ").when(k == 1, "na").when(k == 2, "t").when(k == 3, "-999").when(k == 4, "9999.0")
            .when(k == 5, F.concat(F.lit("-"), v)).when(k == 6, "").when(k == 7, "x7").otherwise(v))
    return table(spark, sf, "events").select("event_id", cell.alias("cell"))


@query("scl05_token_cleaning", f"""
with c as (select event_id, {TEXT_CELL_SQL} as cell from events),
 n as (select *, case when upper(trim(cell)) in ('','***','NA','N/A','NULL','NONE') then null else try_cast(trim(cell) as double) end as v from c)
select event_id, {q6("case when v in (-999,-9999,-99.9,999,9999) or v<0 or v>1000 then null else v end","legacy_mm")},
 {q6("case when upper(trim(cell))='T' then 0.05e0 when v in (-999,-9999,-99.9,999) or v<0 then null else v end","station_mm")},
 (upper(trim(cell)) not in ('','***','NA','N/A','NULL','NONE') and try_cast(trim(cell) as double) is null) as unknown_token
from n""")
def scl05(spark, sf):
    return text_cells(spark, sf).select(
        "event_id", R(S.clean_legacy("cell")).alias("legacy_mm"), R(S.clean_station("cell")).alias("station_mm"),
        S.is_unknown_token("cell").alias("unknown_token"))


HAV = "2*{r}*asin(sqrt(least(1e0,pow(sin((radians({b})-radians({a}))/2),2)+cos(radians({a}))*cos(radians({b}))*pow(sin((radians({d})-radians({c}))/2),2))))"


def hav(a, c, b, d, r="6371.0088e0"):
    return HAV.format(a=a, b=b, c=c, d=d, r=r)


@query("scl06_great_circle", sql("fx_station", f"""
select station_id, {q6(hav("lat","lon","23.7e0","90.4e0"),"km")}, {q6(hav("lat","lon","23.7e0","90.4e0","6371e0"),"km_round_earth")} from fx_station"""))
def scl06(spark, sf):
    c = (F.lit(23.7), F.lit(90.4))
    return V.station(spark, sf).select(
        "station_id", R(S.haversine_km("lat", "lon", *c)).alias("km"),
        R(S.haversine_km("lat", "lon", *c, radius=6371.0)).alias("km_round_earth"))


TAN = "111e0*sqrt(pow(23.7e0-lat,2)+pow(cos(radians(lat))*(90.4e0-lon),2))"
GC = """case when r<=1 then 1-5e0/3*pow(r,2)+5e0/8*pow(r,3)+0.5e0*pow(r,4)-0.25e0*pow(r,5)
 when r<2 then greatest(0e0,4-5*r+5e0/3*pow(r,2)+5e0/8*pow(r,3)-0.5e0*pow(r,4)+pow(r,5)/12-2/(3*r)) else 0e0 end"""


@query("scl07_tangent_distance", sql("fx_station", f"select station_id, {q6(TAN,'km')} from fx_station"))
def scl07(spark, sf):
    return V.station(spark, sf).select(
        "station_id", R(S.tangent_km("lat", "lon", F.lit(23.7), F.lit(90.4))).alias("km"))


@query("scl08_compact_taper", sql("fx_station", f"with d as (select station_id, 2*({TAN})/300e0 as r from fx_station) select station_id, {q6(GC,'weight')} from d"))
def scl08(spark, sf):
    km = S.tangent_km("lat", "lon", F.lit(23.7), F.lit(90.4))
    return V.station(spark, sf).select("station_id", R(S.gaspari_cohn(km, 300.0)).alias("weight"))


@query("scl09_cell_area", sql("fx_grid", """
with a as (select distinct iy, 20e0+(iy+0.5e0)*0.5e0 as lat from fx_grid),
e as (select iy, lat, coalesce((lag(lat) over (order by iy)+lat)/2, lat-(lead(lat) over (order by iy)-lat)/2) as lo,
 coalesce((lead(lat) over (order by iy)+lat)/2, lat+(lat-lag(lat) over (order by iy))/2) as hi from a)
select iy, floor((lo)*1e6+0.5e0)/1e6 as lat_south, floor((hi)*1e6+0.5e0)/1e6 as lat_north,
 floor((pow(6371000e0,2)*(sin(radians(hi))-sin(radians(lo)))*radians(0.5e0)/1e6)*1e6+0.5e0)/1e6 as area_km2 from e"""))
def scl09(spark, sf):
    axis = V.grid(spark, sf).select("iy").distinct().withColumn("lat", G.lat())
    e = GR.axis_edges(axis, "lat")
    return e.select("iy", R("edge_low").alias("lat_south"), R("edge_high").alias("lat_north"),
                    R(S.cell_area_m2("edge_low", "edge_high", G.res) / 1e6).alias("area_km2"))


@query("scl10_lattice_algebra", sql("fx_station", f"""
with c as (select *, cast(floor((lat-20e0)/0.5e0) as int) as iy, cast(floor((lon-86e0)/0.5e0) as int) as ix from fx_station)
select station_id, iy, ix, cast(floor(iy/4e0) as int) as coarse_iy, cast(floor(ix/4e0) as int) as coarse_ix,
 iy-2 as crop_iy, ix-4 as crop_ix, {q6("20e0+(iy+0.5e0)*0.5e0","cell_lat")}, {q6("86e0+(ix+0.5e0)*0.5e0","cell_lon")},
 (lon>88e0 and lon<92e0 and lat>21e0 and lat<26e0) as in_crop from c"""))
def scl10(spark, sf):
    coarse, inner = G.coarser(4), Lattice(88.0, 21.0, 8, 10, 0.5)
    dy, dx = inner.offsets_in(G)
    d = V.station(spark, sf).withColumn("iy", S.nearest_index("lat", G.lat_min + G.res / 2, G.res)).withColumn(
        "ix", S.nearest_index("lon", G.lon_min + G.res / 2, G.res))
    return d.select("station_id", "iy", "ix", S.nearest_index("lat", coarse.lat_min + coarse.res / 2, coarse.res).alias("coarse_iy"),
                    S.nearest_index("lon", coarse.lon_min + coarse.res / 2, coarse.res).alias("coarse_ix"),
                    (F.col("iy") - dy).alias("crop_iy"), (F.col("ix") - dx).alias("crop_ix"),
                    R(G.lat()).alias("cell_lat"), R(G.lon()).alias("cell_lon"), inner.contains("lat", "lon").alias("in_crop"))


@query("scl11_orientation", sql("", """
with p as (select event_id, case when event_id%2=0 then 88.05e0+(event_id%40)*0.1e0 else 88.05e0+(event_id%40)*0.1e0+(event_id%5)*0.001e0-360e0+720e0*(event_id%3//2) end as lon from events),
w as (select event_id, case when lon>180 then lon-360e0 else lon end as lon from p)
select event_id, floor((lon)*1e6+0.5e0)/1e6 as lon, cast(floor((lon-88.05e0)/0.1e0+0.5e0) as int) as ix,
 abs(lon-(88.05e0+floor((lon-88.05e0)/0.1e0+0.5e0)*0.1e0))<=2.0001e-3 as matched from w"""))
def scl11(spark, sf):
    k = F.col("event_id")
    base = (k % 40) * F.lit(0.1) + 88.05
    odd = base + (k % 5) * F.lit(0.001) - 360.0 + F.floor((k % 3) / 2) * F.lit(720.0)
    d = table(spark, sf, "events").select("event_id", S.wrap_longitude(F.when(k % 2 == 0, base).otherwise(odd)).alias("lon"))
    ix = S.nearest_index("lon", 88.05, 0.1)
    return d.select("event_id", R("lon").alias("lon"), ix.alias("ix"),
                    (F.abs(F.col("lon") - (ix * F.lit(0.1) + 88.05)) <= 2.0001e-3).alias("matched"))


@query("scl12_season_strata", """
select case when month(o_orderdate) in (12,1,2) then 'DJF' when month(o_orderdate) in (3,4,5) then 'MAM'
 when month(o_orderdate) in (6,7,8,9) then 'JJAS' else 'ON' end as season, strftime(o_orderdate,'M%m') as month_stratum,
 count(*) as n from orders group by 1,2""")
def scl12(spark, sf):
    return table(spark, sf, "orders").groupBy(
        S.season("o_orderdate").alias("season"), S.month_stratum("o_orderdate").alias("month_stratum")).agg(F.count("*").alias("n"))


@query("scl13_seasonal_encoding", f"""
select o_orderkey, {q6("sin(2*pi()*(dayofyear(o_orderdate)-1)/365.25e0)","season_sin")},
 {q6("cos(2*pi()*(dayofyear(o_orderdate)-1)/365.25e0)","season_cos")} from orders""")
def scl13(spark, sf):
    a = S.seasonal_angle("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", R(F.sin(a)).alias("season_sin"), R(F.cos(a)).alias("season_cos"))


@query("scl14_year_split", """
select case when year(o_orderdate) between 1992 and 1995 then 'train' when year(o_orderdate)=1996 then 'val'
 when year(o_orderdate) between 1997 and 1998 then 'test' end as split, strftime(o_orderdate,'%Y-%m') as period,
 cast(day(last_day(o_orderdate)) as int) as month_days, count(*) as n from orders group by 1,2,3""")
def scl14(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").groupBy(
        S.year_split(d, (1992, 1995), (1996, 1996), (1997, 1998)).alias("split"),
        F.date_format(d, "yyyy-MM").alias("period"), F.dayofmonth(F.last_day(d)).alias("month_days")).agg(F.count("*").alias("n"))


@query("scl15_confirmatory", sql("fx_obs", """
with d as (select cast(date - interval 20 months as date) as date, precip_mm from fx_obs),
y as (select year(l_shipdate) as yr, count(distinct cast(l_shipdate as date)) as n from lineitem where month(l_shipdate) between 5 and 9 group by 1)
select 'daily' as rule, count(*) filter (where not (date between date '2022-05-01' and date '2022-05-10')) as kept, count(*) as total from d
union all select 'monthly', count(*) filter (where strftime(date,'%Y-%m')<>'2022-05'), count(*) from d
union all select 'yearly', count(*) filter (where year(date)<>2022), count(*) from d
union all select 'complete_may_sep', count(*) filter (where n=153), count(*) from y"""))
def scl15(spark, sf):
    d = V.obs(spark, sf).select(F.add_months("date", -20).alias("date"))
    one = d.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in (
        ("daily", S.confirmatory_day("date")), ("monthly", S.confirmatory_month("date")), ("yearly", S.confirmatory_year("date")))])
    rules = one.unpivot("total", ["daily", "monthly", "yearly"], "rule", "kept").select("rule", "kept", "total")
    years = TM.complete_season_years(table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")), "date")
    comp = years.agg(F.count_if("complete").alias("kept"), F.count("*").alias("total")).select(
        F.lit("complete_may_sep").alias("rule"), "kept", "total")
    return rules.unionByName(comp)


@query("scl16_secant_variance", sql("fx_pair", f"""
select station_id, date, {q6("pow(greatest(1e-4,0.5e0*abs(ln(1+(pred*1.3e0)/0.1e0)-ln(1+greatest(pred-pred*0.3e0,0)/0.1e0))),2)+0.04e0","variance")} from fx_pair"""))
def scl16(spark, sf):
    v = S.secant_variance(F.col("pred"), F.col("pred") * 0.3, rep=0.2)
    return V.pair(spark, sf).select("station_id", "date", R(v).alias("variance"))


@query("scl17_intensity_error", sql("fx_pair", f"""
select station_id, date, {q6("pow(least(1.5e0,0.3e0+0.15e0*ln(1+pred)),2)","variance")},
 {q6("case when pred<1 then 0.2e0 when pred<10 then 0.35e0 when pred<50 then 0.6e0 else 1.1e0 end","binned_sigma")} from fx_pair"""))
def scl17(spark, sf):
    return V.pair(spark, sf).select(
        "station_id", "date", R(S.intensity_variance("pred")).alias("variance"),
        R(S.binned_sigma("pred", [0.0, 1.0, 10.0, 50.0, 500.0], [0.2, None, 0.6, 1.1], 0.35)).alias("binned_sigma"))


@query("scl18_stream_variance", sql("fx_multi", f"""
select product, station_id, date, {q6("case product when 'signup' then 0.01e0 else 0.25e0 end + 0.09e0","variance")} from fx_multi"""))
def scl18(spark, sf):
    return V.multi(spark, sf).select(
        "product", "station_id", "date", R(S.stream_variance("product", {"signup": 0.1, "error": 0.5}, rep=0.3)).alias("variance"))


@query("scl19_verdicts", sql("fx_pair", f"""
with s as (select station_id, avg(obs) o, avg(pred) p, avg(pred-obs) d, stddev_samp(pred-obs) sd, count(*) n from fx_pair group by 1),
e as (select quantile_cont(o,0.25) lo, quantile_cont(o,0.75) hi from s)
select station_id, case when p<lo then 'BELOW' when p>hi then 'ABOVE' else 'inside' end as envelope,
 case when sd is null then 'unresolved' when d-1.96e0*sd/sqrt(n)>0 then 'worse' when d+1.96e0*sd/sqrt(n)<0 then 'better' else 'unresolved' end as verdict,
 n<5 as thin from s, e"""))
def scl19(spark, sf):
    def stats():
        return V.pair(spark, sf).groupBy("station_id").agg(
            F.avg("obs").alias("o"), F.avg("pred").alias("p"), F.avg(F.col("pred") - F.col("obs")).alias("d"),
            F.stddev_samp(F.col("pred") - F.col("obs")).alias("sd"), F.count("*").alias("n"))
    e = stats().agg(F.percentile("o", 0.25).alias("lo"), F.percentile("o", 0.75).alias("hi"))
    half = F.col("sd") * 1.96 / F.sqrt("n")
    return stats().select(
        "station_id", S.verdict_envelope("p", e.select("lo").scalar(), e.select("hi").scalar()).alias("envelope"),
        S.verdict_interval(F.col("d") - half, F.col("d") + half).alias("verdict"), (F.col("n") < 5).alias("thin"))


@query("scl20_jensen_forms", sql("fx_pair", f"""
with s as (select station_id, median(pred) med, avg(pred) mean, stddev_pop(ln(1+pred)) sp from fx_pair group by 1)
select station_id, {q6("exp(sp*sp/2)","inflation")}, {q6("med*exp(sp*sp/2)","implied_mean")},
 {q6("case when med<>0 and mean/med>=1 then sqrt(2*ln(mean/med)) end","spread_for_bias")} from s"""))
def scl20(spark, sf):
    s = V.pair(spark, sf).groupBy("station_id").agg(
        F.median("pred").alias("med"), F.avg("pred").alias("mean"), F.stddev_pop(F.log1p("pred")).alias("sp"))
    return s.select("station_id", R(S.jensen_inflation("sp")).alias("inflation"),
                    R(S.jensen_implied_mean("med", "sp")).alias("implied_mean"),
                    R(S.jensen_spread_for("mean", "med")).alias("spread_for_bias"))


@query("scl21_round_trip_audit", sql("fx_obs", f"""
with t as (select 'log1p' as kind, precip_mm as p, (ln(1+precip_mm/0.1e0)-1.5e0)/2.5e0 as y from fx_obs union all select 'sqrt', precip_mm, (sqrt(precip_mm)-1.5e0)/2.5e0 from fx_obs
 union all select 'cbrt', precip_mm, (pow(precip_mm,1e0/3)-1.5e0)/2.5e0 from fx_obs union all select 'none', precip_mm, (precip_mm-1.5e0)/2.5e0 from fx_obs),
b as (select kind, abs(case kind when 'log1p' then (exp(y*2.5e0+1.5e0)-1)*0.1e0 when 'sqrt' then pow(y*2.5e0+1.5e0,2) when 'cbrt' then pow(y*2.5e0+1.5e0,3) else y*2.5e0+1.5e0 end - p) as err from t)
select kind, count(*) as n, max(err)<1e-3 as clean, {q6("max(err)","max_error")} from b group by 1"""))
def scl21(spark, sf):
    d = V.obs(spark, sf)
    p, kinds = F.col("precip_mm"), ("log1p", "sqrt", "cbrt", "none")
    errs = d.select(*[F.abs(S.rain_inverse(S.rain_forward(p, k, 0.1, 1.5, 2.5), k, 0.1, 1.5, 2.5) - p).alias(k) for k in kinds])
    long = errs.unpivot([], list(kinds), "kind", "err")
    return long.groupBy("kind").agg(F.count("*").alias("n"), (F.max("err") < 1e-3).alias("clean"), R(F.max("err")).alias("max_error"))


@query("scl22_record_access", f"""
with s as (select event_type, cast(json_extract_string(props,'$.k') as double) as k, coalesce(json_extract_string(props,'$.none'),'n/a') as absent, value from events),
a as (select event_type, absent, avg(k) as ref, avg(value) as val from s group by 1,2)
select event_type, absent, {q6("ref","ref")}, {q6("100*(ref-val)/ref","percent_reduction")},
 {q6("100*(abs(ref)-abs(val))/abs(ref)","bias_change")}, {q6("100*(val-ref)","corr_points")},
 {q6("100*(abs(ref-0.9e0)-abs(val-0.9e0))/abs(ref-0.9e0)","coverage_change")} from a""")
def scl22(spark, sf):
    e = table(spark, sf, "events").select(
        "event_type", S.json_path("props", "$.k").cast("double").alias("k"), S.json_path("props", "$.none", "n/a").alias("absent"), "value")
    a = e.groupBy("event_type", "absent").agg(F.avg("k").alias("ref"), F.avg("value").alias("val"))

    def change(m):
        return R(S.directional_change(F.lit(m), "ref", "val"))
    return a.select("event_type", "absent", R("ref").alias("ref"), R(S.percent_reduction("ref", "val")).alias("percent_reduction"),
                    change("bias").alias("bias_change"), change("correlation").alias("corr_points"), change("coverage").alias("coverage_change"))


@query("scl23_predictors", sql("fx_grid", f"""
with z as (select iy, ix, avg(ref) as z from fx_grid group by 1,2),
g as (select iy, ix, case when lag(z) over x is null and lead(z) over x is null then 0e0 when lag(z) over x is null then (lead(z) over x - z)/(lead(ix) over x - ix)
  when lead(z) over x is null then (z-lag(z) over x)/(ix-lag(ix) over x) else (lead(z) over x - lag(z) over x)/(lead(ix) over x - lag(ix) over x) end as gx,
 case when lag(z) over y is null and lead(z) over y is null then 0e0 when lag(z) over y is null then (lead(z) over y - z)/(lead(iy) over y - iy)
  when lead(z) over y is null then (z-lag(z) over y)/(iy-lag(iy) over y) else (lead(z) over y - lag(z) over y)/(lead(iy) over y - lag(iy) over y) end as gy
 from z window x as (partition by iy order by ix), y as (partition by ix order by iy))
select f.day, f.iy, f.ix, {q6("sqrt(f.value)","sqrt_rain")}, 1 as valid,
 {q6("f.value*0.1e0*g.gx+f.ref*0.1e0*g.gy","ascent")}, {q6("abs(f.value*0.1e0*g.gx+f.ref*0.1e0*g.gy)","ascent_abs")}
from fx_grid f join g on f.iy=g.iy and f.ix=g.ix"""))
def scl23(spark, sf):
    g = V.grid(spark, sf)
    z = V.grid(spark, sf).groupBy("iy", "ix").agg(F.avg("ref").alias("z"))
    wind = g.select("day", "iy", "ix", "value", (F.col("value") * 0.1).alias("u"), (F.col("ref") * 0.1).alias("v"))
    d = GR.terrain_ascent(wind, z)
    return d.select("day", "iy", "ix", R(F.sqrt("value")).alias("sqrt_rain"), F.col("value").isNotNull().cast("int").alias("valid"),
                    R("ascent").alias("ascent"), R(F.abs("ascent")).alias("ascent_abs"))
