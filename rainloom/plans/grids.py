"""Queries over regridding and block algebra."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rainloom.functions import scalar as S
from rainloom.functions.lattice import VIEW_LATTICE as G, Lattice
from rainloom.operators import grid as GR, joins as J
from rainloom.plans import views as V
from rainloom.plans.registry import query
from rainloom.plans.scalars import q6
from rainloom.plans.stats import report
from rainloom.plans.views import sql, table

R = S.rounded
LAT = "(20e0+(iy+0.5e0)*0.5e0)"
AREA = f"cos(radians({LAT}))"


def area():
    return F.cos(F.radians(G.lat()))


def edges_sql(name, src, i, c):
    return f"""{name} as (select {i}, coalesce((lag({c}) over (order by {c})+{c})/2, {c}-(lead({c}) over (order by {c})-{c})/2) as lo,
 coalesce((lead({c}) over (order by {c})+{c})/2, {c}+({c}-lag({c}) over (order by {c}))/2) as hi from {src})"""


WEIGHTS = f"""ay as (select distinct iy, {LAT} as lat from fx_grid), ax as (select distinct ix, 86e0+(ix+0.5e0)*0.5e0 as lon from fx_grid),
by_ as (select distinct cast(floor(iy/2) as int) as ty, 20.75e0+floor(iy/2) as lat from fx_grid),
bx_ as (select distinct cast(floor(ix/2) as int) as tx, 86.75e0+floor(ix/2) as lon from fx_grid),
{edges_sql("eay","ay","iy","lat")}, {edges_sql("eax","ax","ix","lon")}, {edges_sql("eby","by_","ty","lat")}, {edges_sql("ebx","bx_","tx","lon")},
oy as (select ty, iy, sin(radians(least(t.hi,s.hi)))-sin(radians(greatest(t.lo,s.lo))) as o, sin(radians(t.hi))-sin(radians(t.lo)) as f from eby t join eay s on t.lo<s.hi and s.lo<t.hi),
ox as (select tx, ix, least(t.hi,s.hi)-greatest(t.lo,s.lo) as o, t.hi-t.lo as f from ebx t join eax s on t.lo<s.hi and s.lo<t.hi),
wy as (select ty, iy, o/sum(o) over (partition by ty) as w, sum(o) over (partition by ty)/f as c from oy),
wx as (select tx, ix, o/sum(o) over (partition by tx) as w, sum(o) over (partition by tx)/f as c from ox)"""


def _weights(spark, sf):
    g = V.grid(spark, sf)
    ay = g.select("iy").distinct().withColumn("lat", G.lat())
    ax = g.select("ix").distinct().withColumn("lon", G.lon())
    ty = g.select(F.floor(F.col("iy") / 2).cast("int").alias("ty")).distinct().withColumn("lat", F.col("ty") + 20.75)
    tx = g.select(F.floor(F.col("ix") / 2).cast("int").alias("tx")).distinct().withColumn("lon", F.col("tx") + 86.75)
    return (GR.overlap_weights(ay, ty, "iy", "ty", "lat", latitude=True), GR.overlap_weights(ax, tx, "ix", "tx", "lon"))


@query("grd01_overlap_weights", sql("fx_grid", f"""with {WEIGHTS}
select 'lat' as axis, ty as target, iy as source, {q6("w","weight")}, {q6("c","coverage")} from wy union all select 'lon', tx, ix, {q6("w","weight")}, {q6("c","coverage")} from wx"""))
def grd01(spark, sf):
    wy, wx = _weights(spark, sf)
    a = wy.select(F.lit("lat").alias("axis"), F.col("ty").alias("target"), F.col("iy").alias("source"), "weight", "coverage")
    return report(a.unionByName(wx.select(F.lit("lon").alias("axis"), F.col("tx").alias("target"), F.col("ix").alias("source"), "weight", "coverage")))


@query("grd02_conservative_regrid", sql("fx_grid", f"""with {WEIGHTS}
select day, ty, tx, {q6("sum(greatest(value,0)*wy.w*wx.w)","value")} from fx_grid g join wy on wy.iy=g.iy and wy.c>=1-1e-6 join wx on wx.ix=g.ix and wx.c>=1-1e-6 group by 1,2,3"""))
def grd02(spark, sf):
    wy, wx = _weights(spark, sf)
    ok = F.col("coverage") >= 1 - 1e-6
    return report(GR.conservative_regrid(V.grid(spark, sf), wy.where(ok), wx.where(ok)))


CORNERS = """c as (select station_id, (lat-20.25e0)/0.5e0 as y, (lon-86.25e0)/0.5e0 as x from fx_station),
k as (select station_id, cast(floor(y) as int)+dy as iy, cast(floor(x) as int)+dx as ix, (case when dy=1 then y-floor(y) else 1-(y-floor(y)) end)*(case when dx=1 then x-floor(x) else 1-(x-floor(x)) end) as w
 from c, (values (0,0),(0,1),(1,0),(1,1)) d(dy,dx))"""


@query("grd03_coverage_interpolation", sql("fx_grid fx_station", f"""with {CORNERS},
s as (select station_id, day, sum(w*value) as s, sum(w) as w from fx_grid g join k on k.iy=g.iy and k.ix=g.ix where value between 10 and 40 group by 1,2),
sp as (select station_id, day from fx_station, (select distinct day from fx_grid))
select sp.station_id, sp.day, {q6("case when coalesce(w,0)>1e-6 then s/w else 0e0 end","value")}, {q6("least(coalesce(w,0),1)","coverage")} from sp left join s on s.station_id=sp.station_id and s.day=sp.day"""))
def grd03(spark, sf):
    g = V.grid(spark, sf)
    gaps = g.withColumn("value", F.when(F.col("value").between(10, 40), F.col("value")))
    return report(GR.coverage_interpolate(gaps, V.station(spark, sf), G))


@query("grd04_nearest_regrid", sql("fx_grid", f"""
with t as (select distinct cast(floor(iy/2) as int) as ty, cast(floor(ix/2) as int) as tx from fx_grid)
select day, ty, tx, {q6("value","value")} from t join fx_grid g on g.iy=cast(floor((20.6e0+ty-20.25e0)/0.5e0+0.5e0) as int) and g.ix=cast(floor((86.6e0+tx-86.25e0)/0.5e0+0.5e0) as int)"""))
def grd04(spark, sf):
    t = V.grid(spark, sf).select(GR.block("iy", 2).alias("ty"), GR.block("ix", 2).alias("tx")).distinct().select(
        "ty", "tx", (F.col("ty") + 20.6).alias("lat"), (F.col("tx") + 86.6).alias("lon"))
    return GR.nearest_regrid(V.grid(spark, sf), G, t).select("day", "ty", "tx", R("value").alias("value"))


@query("grd05_bin_average", sql("fx_grid", f"""
with b as (select day, cast(floor(({LAT}-20.1e0)/1.5e0) as int) as ty, cast(floor((86e0+(ix+0.5e0)*0.5e0-86.1e0)/1.5e0) as int) as tx, value, case when value is not null then {AREA} end as w from fx_grid)
select day, ty, tx, {q6("sum(value*w)/sum(w)","value")} from b where ty between 0 and 4 and tx between 0 and 4 group by 1,2,3"""))
def grd05(spark, sf):
    return report(GR.bin_average(V.grid(spark, sf), G, Lattice(86.1, 20.1, 5, 5, 1.5)))


BLK3 = 'cast(floor(iy/3) as int) as "by", cast(floor(ix/3) as int) as bx'
BLK = 'cast(floor(iy/4) as int) as "by", cast(floor(ix/4) as int) as bx'


@query("grd06_block_mean", sql("fx_grid", f"""
select day, {BLK3}, {q6("avg(value)","value")}, {q6("min(ref)","lowest")}, {q6("sqrt(avg(ref*ref))","rms")}, count(value) as n_valid from fx_grid group by 1,2,3"""))
def grd06(spark, sf):
    g = V.grid(spark, sf)
    m = GR.block_mean(g, 3)
    lo = GR.block_mean(g, 3, ("ref",), how="min").select("day", "by", "bx", F.col("ref").alias("lowest"))
    rms = GR.block_mean(g, 3, ("ref",), how="rms").select("day", "by", "bx", F.col("ref").alias("rms"))
    return report(m.join(lo, ["day", "by", "bx"]).join(rms, ["day", "by", "bx"]).select("day", "by", "bx", "value", "lowest", "rms", "n_valid"))


@query("grd07_block_mean_fraction", sql("fx_grid", f"""
select day, {BLK}, {q6("case when count(v)>=16 then avg(v) end","full_only")}, {q6("case when count(v)>=8 then avg(v) end","half")}, count(v) as n_valid
from (select *, case when value>8 then value end as v from fx_grid) group by 1,2,3"""))
def grd07(spark, sf):
    g = V.grid(spark, sf).withColumn("value", F.when(F.col("value") > 8, F.col("value")))
    a = GR.block_mean(g, 4, min_fraction=0.999).withColumnRenamed("value", "full_only")
    b = GR.block_mean(g, 4, min_fraction=0.5).select("day", "by", "bx", F.col("value").alias("half"))
    return report(a.join(b, ["day", "by", "bx"]).select("day", "by", "bx", "full_only", "half", "n_valid"))


ABM = f"""select day, {BLK}, case when coalesce(sum(case when v is not null then {AREA} end),0)/sum({AREA})>=0.8e0 then floor((sum(v*{AREA})/sum(case when v is not null then {AREA} end))*1e6+0.5e0)/1e6 else 0e0 end as value,
 coalesce(sum(case when v is not null then {AREA} end),0)/sum({AREA})>=0.8e0 as retained, {q6(f"coalesce(sum(case when v is not null then {AREA} end),0)/sum({AREA})","valid_fraction")}"""


@query("grd08_area_block_mean", sql("fx_grid", f"{ABM} from (select *, case when value>8 then value end as v from fx_grid) group by 1,2,3"))
def grd08(spark, sf):
    g = V.grid(spark, sf).withColumn("value", F.when(F.col("value") > 8, F.col("value")))
    return report(GR.area_block_mean(g, 4, area(), 0.8))


@query("grd09_upsample", sql("fx_grid", f"""with b as (select day, {BLK3}, avg(value) as c from fx_grid group by 1,2,3) select g.day, iy, ix, {q6('c','value')} from fx_grid g join b on b.day=g.day and b."by"=cast(floor(iy/3) as int) and b.bx=cast(floor(ix/3) as int)"""))
def grd09(spark, sf):
    coarse = GR.block_mean(V.grid(spark, sf), 3).select("day", "by", "bx", "value")
    cells = V.grid(spark, sf).select("day", "iy", "ix")
    return GR.upsample(coarse, cells, 3).select("day", "iy", "ix", R("value").alias("value"))


W3 = "over (partition by day, floor(iy/3), floor(ix/3))"
W4 = "over (partition by day, floor(iy/4), floor(ix/4))"


@query("grd10_scale_decompose", sql("fx_grid", f"select day, iy, ix, {q6(f'avg(value) {W3}','coarse')}, {q6(f'value-avg(value) {W3}','residual')} from fx_grid"))
def grd10(spark, sf):
    return GR.scale_decompose(V.grid(spark, sf), 3).select("day", "iy", "ix", R("coarse").alias("coarse"), R("residual").alias("residual"))


@query("grd11_relative_anomaly", sql("fx_grid", f"select day, iy, ix, {q6(f'value/(sum(value*{AREA}) {W4}/sum({AREA}) {W4})-1','relative')} from fx_grid"))
def grd11(spark, sf):
    return GR.relative_anomaly(V.grid(spark, sf), 4, area()).select("day", "iy", "ix", R("relative").alias("relative"))


@query("grd12_eligible_mask", sql("fx_grid", f"select day, iy, ix, (count(value) {W4} >= 14) as eligible from fx_grid"))
def grd12(spark, sf):
    return GR.eligible(V.grid(spark, sf), 4, 0.85).select("day", "iy", "ix", "eligible")


@query("grd13_null_models", sql("fx_grid", f"""
with n as (select day, value, ref, avg(value) {W4} as fp from fx_grid)
select day, {q6("sqrt(avg(pow(ref-value,2)))","coarse_input_rmse")}, {q6("sqrt(avg(pow(fp-value,2)))","footprint_perfect_rmse")} from n group by 1"""))
def grd13(spark, sf):
    d = GR.scale_decompose(V.grid(spark, sf), 4)

    def rmse(c):
        return F.sqrt(F.avg((F.col(c) - F.col("value")) * (F.col(c) - F.col("value"))))
    return report(d.groupBy("day").agg(rmse("ref").alias("coarse_input_rmse"), rmse("coarse").alias("footprint_perfect_rmse")))


@query("grd14_block_error", sql("fx_grid", f"""
with p as (select i*0.1e0*111.32e0 as y, j*0.1e0*111.32e0*cos(radians(24e0)) as x from (select unnest(range(4)) as i), (select unnest(range(4)) as j)),
f as (select avg(exp(-sqrt(pow(a.y-b.y,2)+pow(a.x-b.x,2))/40e0)) as f from p a, p b),
b as (select day, {BLK}, sqrt(avg(ref*ref)) as r, count(ref) as n from fx_grid group by 1,2,3)
select day, "by", bx, n as n_valid, {q6("r","rms")}, {q6("r*sqrt(f)","sigma")}, {q6("r/sqrt(n)","sigma_independent")} from b, f"""))
def grd14(spark, sf):
    f = GR.geometric_factor(4, 0.1, 24.0, 40.0)
    return report(GR.block_error(V.grid(spark, sf), 4, f, "ref"))


@query("grd15_coarse_wet", sql("fx_grid", f"select day, {BLK}, bool_or(value>=48) as wet from fx_grid group by 1,2,3"))
def grd15(spark, sf):
    return GR.coarse_wet(V.grid(spark, sf), 4, 48.0)


@query("grd16_allocation_weights", sql("fx_grid", f"""
with a as (select day, iy, ix, value, {AREA} as a, sum(value*{AREA}) {W4}/sum({AREA}) {W4} as b from fx_grid),
r as (select *, value>=10 as wet, ln(greatest(value/greatest(b,1e-6),1e-6)) as raw from a)
select day, iy, ix, wet, {q6(f"case when wet then raw-sum(case when wet then a*raw end) {W4}/sum(case when wet then a end) {W4} else 0e0 end","log_weight")} from r"""))
def grd16(spark, sf):
    return GR.allocation_weights(V.grid(spark, sf), 4, area(), wet_mm=10.0).select("day", "iy", "ix", "wet", R("log_weight").alias("log_weight"))


def lift_sql(name, src, col):
    """Bilinear lift of a 4 x 4 block table (edges repeated) onto the cells."""
    return f"""{name} as (select s.day, c.iy, c.ix, sum(c.w*coalesce(s.{col},0)) as l from lw c join {src} s on s."by"=c."by" and s.bx=c.bx group by 1,2,3)"""


SMOOTH = f"""cl as (select distinct iy, ix from fx_grid), ps as (select iy, ix, greatest((iy+0.5e0)/4-0.5e0,0) as py, greatest((ix+0.5e0)/4-0.5e0,0) as px from cl),
lw as (select iy, ix, cast(least(floor(py)+dy,3) as int) as "by", cast(least(floor(px)+dx,3) as int) as bx, (case when dy=1 then py-floor(py) else 1-(py-floor(py)) end)*(case when dx=1 then px-floor(px) else 1-(px-floor(px)) end) as w
 from ps, (values (0,0),(0,1),(1,0),(1,1)) d(dy,dx)),
t as (select day, {BLK}, sum(value*{AREA})/sum({AREA}) as t from fx_grid group by 1,2,3),
{lift_sql("b0","t","t")}, m0 as (select day, {BLK}, sum(l*{AREA})/sum({AREA}) as m from b0 group by 1,2,3), r0 as (select t.*, least(greatest(t/m,0),1000) as r from t join m0 using(day,"by",bx)),
{lift_sql("u0","r0","r")}, b1 as (select b0.day, b0.iy, b0.ix, b0.l*u0.l as l from b0 join u0 on u0.day=b0.day and u0.iy=b0.iy and u0.ix=b0.ix),
m1 as (select day, {BLK}, sum(l*{AREA})/sum({AREA}) as m from b1 group by 1,2,3), r1 as (select t.*, least(greatest(t/m,0),1000) as r from t join m1 using(day,"by",bx)),
{lift_sql("u1","r1","r")}, b2 as (select b1.day, b1.iy, b1.ix, b1.l*u1.l as l from b1 join u1 on u1.day=b1.day and u1.iy=b1.iy and u1.ix=b1.ix),
m2 as (select day, {BLK}, sum(l*{AREA})/sum({AREA}) as m from b2 group by 1,2,3),
sm as (select b2.day, b2.iy, b2.ix, l*t/m as v, t.t from b2 join m2 on m2.day=b2.day and m2."by"=floor(b2.iy/4) and m2.bx=floor(b2.ix/4) join t on t.day=b2.day and t."by"=floor(b2.iy/4) and t.bx=floor(b2.ix/4))"""


def smooth(spark, sf):
    g = V.grid(spark, sf)
    coarse = GR.area_block_mean(g, 4, area(), 0.0).select("day", "by", "bx", "value")
    return GR.smooth_upsample(coarse, V.grid(spark, sf), 4, area(), 4, 4)


@query("grd17_smooth_upsample", sql("fx_grid", f"with {SMOOTH} select day, iy, ix, floor((v)*1e5+0.5e0)/1e5 as value from sm"))
def grd17(spark, sf):
    return smooth(spark, sf).select("day", "iy", "ix", R("value", 5).alias("value"))


def grad_sql(v, i, part):
    w = f"over (partition by {part} order by {i})"
    return f"coalesce((coalesce(lead({v}) {w},{v})-coalesce(lag({v}) {w},{v}))/nullif(coalesce(lead({i}) {w},{i})-coalesce(lag({i}) {w},{i}),0),0e0)"


@query("grd18_static_predictors", sql("fx_grid", f"""
with c as (select iy, ix, avg(ref)*10 as elev, count(case when value>5 then 1 end)>0 as land from fx_grid group by 1,2),
g as (select *, {grad_sql("elev","iy","ix")}/(0.5e0*111320e0) as gy, {grad_sql("elev","ix","iy")}/(0.5e0*111320e0*cos(radians({LAT}))) as gx, sqrt(greatest(elev,0)) as e from c),
s as (select *, sqrt(gy*gy+gx*gx) as sl from g), t as (select min(e) e0, max(e) e1, avg(case when land then sl end) mu, stddev_pop(case when land then sl end) sd from s)
select iy, ix, {q6("(e-e0)/(e1-e0+1e-6)","elevation")}, {q6("case when land then (sl-mu)/(sd+1e-6) else 0 end","slope")}, cast(land as int) as land,
 {q6("sin(pi()*ix/15e0)","sin_u")}, {q6("cos(pi()*ix/15e0)","cos_u")}, {q6("sin(pi()*iy/15e0)","sin_v")}, {q6("cos(pi()*iy/15e0)","cos_v")} from s, t"""))
def grd18(spark, sf):
    c = V.grid(spark, sf).groupBy("iy", "ix").agg((F.avg("ref") * 10).alias("elev"), (F.count(F.when(F.col("value") > 5, 1)) > 0).alias("land"))
    return report(GR.static_predictors(c, G))


@query("grd19_neighbourhood_pool", sql("fx_grid", f"""
select iy+dy as iy, ix+dx as ix, count(*) as n, {q6("avg(value)","mean")} from fx_grid, (select unnest([-1,0,1]) as dy), (select unnest([-1,0,1]) as dx) where iy+dy between 0 and 15 and ix+dx between 0 and 15 group by 1,2"""))
def grd19(spark, sf):
    p = GR.pool_neighbourhood(V.grid(spark, sf), 3, 16, 16)
    return report(p.groupBy("iy", "ix").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("grd20_archive_coarsening", sql("fx_grid", f"""
with l as (select day, iy, ix, 'target' as channel, value as v from fx_grid union all select day, iy, ix, 'cond', ref from fx_grid)
select channel, day, cast(floor(iy/2) as int) as "by", cast(floor(ix/2) as int) as bx, {q6(f"case when sum({AREA})/any_value(t)>=0.5e0 then sum(v*{AREA})/sum({AREA}) else 0e0 end","value")}, sum({AREA})/any_value(t)>=0.5e0 as retained
from (select l.*, 2*cos(radians(20e0+(floor(iy/2)*2+0.5e0)*0.5e0))+2*cos(radians(20e0+(floor(iy/2)*2+1.5e0)*0.5e0)) as t from l) group by 1,2,3,4"""))
def grd20(spark, sf):
    long = V.grid(spark, sf).select("day", "iy", "ix", F.col("value").alias("target"), F.col("ref").alias("cond")).unpivot(
        ["day", "iy", "ix"], ["target", "cond"], "channel", "value")
    row = F.floor(F.col("iy") / 2) * 2
    full = F.max(F.cos(F.radians(G.lat(row))) * 2 + F.cos(F.radians(G.lat(row + 1))) * 2)
    d = GR.area_block_mean(long, 2, area(), 0.5, keys=("channel", "day"), total_area=full)
    return report(d.drop("valid_fraction"))


@query("grd21_crop", sql("fx_grid", f"select day, iy-4 as iy, ix-2 as ix, {q6('value','value')} from fx_grid where iy between 4 and 11 and ix between 2 and 9"))
def grd21(spark, sf):
    return GR.crop(V.grid(spark, sf), 4, 2, 8, 8).select("day", "iy", "ix", R("value").alias("value"))


@query("grd22_wet_crop_origins", sql("fx_grid", f"""
with q as (select day, quantile_cont(value,0.9) as t from fx_grid group by 1), land as (select iy, ix from fx_grid group by 1,2 having avg(ref)>37.5e0),
o as (select y as r0, x as c0 from (select unnest(range(11)) as y), (select unnest(range(11)) as x)),
lf as (select r0, c0, count(l.iy)/36e0 as lf from o left join land l on l.iy between r0 and r0+5 and l.ix between c0 and c0+5 group by 1,2),
w as (select g.day, r0, c0, count(*) as n from fx_grid g join q on q.day=g.day and g.value>=t join o on iy between r0 and r0+5 and ix between c0 and c0+5 group by 1,2,3)
select day, cast(w.r0 as int) as r0, cast(w.c0 as int) as c0, n as n_wet, {q6("lf","land_fraction")} from w join lf on lf.r0=w.r0 and lf.c0=w.c0 where lf>=0.5e0"""))
def grd22(spark, sf):
    land = V.grid(spark, sf).groupBy("iy", "ix").agg((F.avg("ref") > 37.5).alias("land"))
    return report(GR.wet_crop_origins(V.grid(spark, sf).select("day", "iy", "ix", "value"), land, 6, 0.9, 0.5, 16, 16))


@query("grd23_replicate_driver", sql("fx_grid", f"""
with t as (select distinct iy*2+dy as fy, ix*2+dx as fx, iy, ix from fx_grid, (select unnest([0,1]) as dy), (select unnest([0,1]) as dx))
select day, cast(fy as int) as fy, cast(fx as int) as fx, {q6("value","value")} from t join fx_grid g on g.iy=t.iy and g.ix=t.ix"""))
def grd23(spark, sf):
    fine = Lattice(86.0, 20.0, 32, 32, 0.25)
    two = F.sequence(F.lit(0), F.lit(1))
    t = V.grid(spark, sf).select("iy", "ix").distinct().withColumn("dy", F.explode(two)).withColumn("dx", F.explode(two)).select(
        (F.col("iy") * 2 + F.col("dy")).alias("fy"), (F.col("ix") * 2 + F.col("dx")).alias("fx"))
    t = t.select("fy", "fx", fine.lat("fy").alias("lat"), fine.lon("fx").alias("lon"))
    return GR.replicate_driver(V.grid(spark, sf), G, t, fine.res).select("day", "fy", "fx", R("value").alias("value"))
