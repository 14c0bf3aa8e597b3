"""Queries over the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainloom.functions import draws as D, ensemble as EN, scalar as S
from rainloom.functions.lattice import VIEW_LATTICE as G
from rainloom.operators import checks as C, grid as GR, joins as J, stats as ST
from rainloom.plans import views as V
from rainloom.plans.ensembles import FAIR, snormal
from rainloom.plans.grids import CORNERS
from rainloom.plans.registry import query
from rainloom.plans.scalars import hav, q6
from rainloom.plans.stats import report
from rainloom.plans.views import sql, table

R = S.rounded


@query("joi01_many_to_one", sql("fx_obs fx_station", f"select o.station_id, date, {q6('lat','lat')}, {q6('lon','lon')}, {q6('precip_mm','precip_mm')} from fx_obs o join fx_station s on s.station_id=o.station_id"))
def joi01(spark, sf):
    j = J.many_to_one(V.obs(spark, sf), V.station(spark, sf), "station_id", "lat")
    return report(j.select("station_id", "date", "lat", "lon", "precip_mm"))


@query("joi02_day_offset_pairing", sql("fx_obs fx_multi", f"""
select o.station_id, o.date, p.date as product_date, p.product, {q6("precip_mm","obs")}, {q6("pred","pred")} from fx_obs o join fx_multi p on p.station_id=o.station_id and p.date=o.date - 1"""))
def joi02(spark, sf):
    j = J.pair_by_day(V.obs(spark, sf), V.multi(spark, sf), -1)
    return j.select("station_id", "date", "product_date", "product", R("precip_mm").alias("obs"), R("pred").alias("pred"))


GAPS = "g as (select day, iy, ix, case when value>10 then value end as v from fx_grid)"


def gaps(spark, sf):
    return V.grid(spark, sf).withColumn("value", F.when(F.col("value") > 10, F.col("value")))


def sample_sql(expr):
    return f"""with {CORNERS}, {GAPS}, s as (select station_id, day, coalesce(sum(w*v),0) as s, sum(case when v is not null then w end) as w from g join k on k.iy=g.iy and k.ix=g.ix group by 1,2)
select station_id, day, {q6(expr, "value")}, {q6("coalesce(w,0)", "coverage")} from s"""


@query("joi03_bilinear_zero", sql("fx_grid fx_station", sample_sql("s")))
def joi03a(spark, sf):
    return report(J.bilinear_sample(gaps(spark, sf), V.station(spark, sf), G, missing="zero"))


@query("joi03_bilinear_renormalised", sql("fx_grid fx_station", sample_sql("s/w")))
def joi03b(spark, sf):
    return report(J.bilinear_sample(gaps(spark, sf), V.station(spark, sf), G))


@query("joi03_bilinear_strict", sql("fx_grid fx_station", sample_sql("case when w>=1-1e-9 then s end")))
def joi03c(spark, sf):
    return report(J.bilinear_sample(gaps(spark, sf), V.station(spark, sf), G, missing="strict"))


def grid_members(spark, sf):
    """Six-member field in mm around the grid view."""
    return V.grid(spark, sf).select("day", "iy", "ix", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.greatest(
        F.col("value") + (k - 2.5) * (F.col("ref") - 38) * 0.2, F.lit(0.0))).alias("members"))


GM = "gm as (select day, iy, ix, [greatest(value+(k-2.5e0)*(ref-38)*0.2e0,0e0) for k in range(6)] as members from fx_grid)"
GS = "gs as (select station_id, day, i, sum(w*members[i+1]) as v from gm join k on k.iy=gm.iy and k.ix=gm.ix, (select unnest(range(6)) as i) group by 1,2,3), ms as (select station_id, day, list(v order by i) as members from gs group by 1,2)"


@query("joi04_bilinear_members", sql("fx_grid fx_station", f"with {CORNERS}, {GM}, {GS} select station_id, day, {q6('ln(1+list_avg(members))','mean')}, {q6('ln(1+list_max(members))','top')}, {q6('ln(1+members[1])','first')} from ms"))
def joi04(spark, sf):
    s = J.bilinear_members(grid_members(spark, sf), V.station(spark, sf), G)
    return report(s.select("station_id", "day", F.log1p(EN.mean("members")).alias("mean"), F.log1p(F.array_max("members")).alias("top"), F.log1p(F.get("members", F.lit(0))).alias("first")))


@query("joi05_pseudo_stations", sql("fx_grid fx_station", f"""with {CORNERS}, s as (select station_id, day, sum(w*value) as v from fx_grid g join k on k.iy=g.iy and k.ix=g.ix group by 1,2)
select station_id, day, {q6("v","clean")}, {q6("greatest(v+2e0*" + snormal("'5'", "station_id", "day") + ",0e0)","noisy")} from s"""))
def joi05(spark, sf):
    s = J.bilinear_sample(V.grid(spark, sf), V.station(spark, sf), G, missing="zero")
    noisy = F.greatest(F.col("value") + D.draw_normal(5, "station_id", "day") * 2.0, F.lit(0.0))
    return s.select("station_id", "day", R("value").alias("clean"), R(noisy).alias("noisy"))


@query("joi06_nearest_cell", sql("fx_station", """select station_id, cast(least(greatest(floor((lat-20.25e0)/0.5e0+0.5e0),0),15) as int) as iy, cast(least(greatest(floor((lon-86.25e0)/0.5e0+0.5e0),0),15) as int) as ix from fx_station"""))
def joi06(spark, sf):
    return J.nearest_cell(V.station(spark, sf), G).select("station_id", "iy", "ix")


KM = hav("a.lat", "a.lon", "b.lat", "b.lon")


@query("joi07_station_pairs", sql("fx_station", f"select * from (select a.station_id as a, b.station_id as b, {q6(KM,'km')} from fx_station a join fx_station b on a.station_id<b.station_id where {KM}<=150)"))
def joi07(spark, sf):
    return J.pairs_within(V.station(spark, sf), 150.0).select("a", "b", R("km").alias("km"))


@query("joi07_nearest_neighbour", sql("fx_station", f"with p as (select a.station_id, {KM} as km from fx_station a join fx_station b on a.station_id<>b.station_id) select station_id, {q6('min(km)','km')} from p group by 1"))
def joi07b(spark, sf):
    s = V.station(spark, sf)
    return J.nearest_point(s, s, "station_id", exclude_self=True).select("station_id", R("km").alias("km"))


KNN = """m as (select cos(radians(avg(lat))) as c from fx_station),
n as (select a.station_id as s, b.station_id as t, b.lat-a.lat as dy, (b.lon-a.lon)*c as dx from fx_station a join fx_station b on a.station_id<>b.station_id, m),
k as (select *, row_number() over (partition by s order by dy*dy+dx*dx, t) as r from n)"""


@query("joi08_bearing_gap", sql("fx_station", f"""with {KNN}, b as (select s, (degrees(atan2(dy,dx))+360e0)%360e0 as b from k where r<=6),
g as (select s, b - lag(b) over (partition by s order by b) as g from b), w as (select s, 360-(max(b)-min(b)) as w from b group by 1), x as (select s, max(g) as g from g group by 1)
select f.station_id, {q6("coalesce(greatest(coalesce(x.g,0),w.w),360)","gap_deg")} from fx_station f left join w on w.s=f.station_id left join x on x.s=f.station_id"""))
def joi08(spark, sf):
    return report(J.bearing_gap(V.station(spark, sf)))


@query("joi09_cell_to_station", sql("fx_grid fx_station", f"""with c as (select distinct iy, ix, 20e0+(iy+0.5e0)*0.5e0 as lat, 86e0+(ix+0.5e0)*0.5e0 as lon from fx_grid)
select a.iy, a.ix, floor(min({KM})*1e6+0.5e0)/1e6 as km from c a, fx_station b group by 1,2"""))
def joi09(spark, sf):
    cells = V.grid(spark, sf).select("iy", "ix").distinct().withColumn("lat", G.lat()).withColumn("lon", G.lon())
    return J.nearest_point(cells, V.station(spark, sf), ["iy", "ix"]).select("iy", "ix", R("km").alias("km"))


def polygons(spark, sf):
    """A square with a square hole per nation, placed on the view lattice."""
    n = F.col("n_nationkey")
    cx, cy = F.lit(86.83) + (n % 5) * 1.61, F.lit(20.77) + F.floor(n / 5) * 1.57

    def ring(i, h, hole):
        xs, ys = [cx - h, cx + h, cx + h, cx - h], [cy - h, cy - h * 0.9, cy + h, cy + h * 0.8]
        return [F.struct(F.lit(i).alias("ring_id"), F.lit(hole).alias("is_hole"), xs[a].alias("x1"), ys[a].alias("y1"), xs[(a + 1) % 4].alias("x2"), ys[(a + 1) % 4].alias("y2")) for a in range(4)]
    e = F.explode(F.array(*ring(0, 0.71, False), *ring(1, 0.33, True)))
    return table(spark, sf, "nation").select(n.alias("poly_id"), e.alias("e")).select("poly_id", "e.*")


POLY = """cn as (select n_nationkey as poly_id, 86.83e0+(n_nationkey%5)*1.61e0 as cx, 20.77e0+floor(n_nationkey/5)*1.57e0 as cy from nation),
rg as (select poly_id, r as ring_id, r=1 as is_hole, cx, cy, case when r=0 then 0.71e0 else 0.33e0 end as h from cn, (select unnest([0,1]) as r)),
vt as (select poly_id, ring_id, is_hole, [cx-h,cx+h,cx+h,cx-h] as xs, [cy-h,cy-h*0.9e0,cy+h,cy+h*0.8e0] as ys from rg),
ed as (select poly_id, ring_id, is_hole, xs[a] as x1, ys[a] as y1, xs[a%4+1] as x2, ys[a%4+1] as y2 from vt, (select unnest([1,2,3,4]) as a)),
hit as (select station_id, poly_id, ring_id, is_hole, count(*)%2 as odd from fx_station p join ed on (y1>lat)<>(y2>lat) and lon < x1+(lat-y1)*(x2-x1)/nullif(y2-y1,0) group by 1,2,3,4),
ins as (select distinct station_id from (select station_id, poly_id, max(case when not is_hole and odd=1 then 1 else 0 end) as s, max(case when is_hole and odd=1 then 1 else 0 end) as h from hit group by 1,2) where s=1 and h=0)"""


@query("joi10_polygon_mask", sql("fx_station", f"with {POLY} select s.station_id, i.station_id is not null as inside from fx_station s left join ins i on i.station_id=s.station_id"))
def joi10(spark, sf):
    return J.points_in_polygons(V.station(spark, sf), polygons(spark, sf), "station_id").select("station_id", "inside")


@query("joi10_polygon_tolerance", sql("fx_station", f"""with {POLY}, t as (select station_id, lat, lon, x1,y1,x2,y2, greatest(0e0,least(1e0,coalesce(((lon-x1)*(x2-x1)+(lat-y1)*(y2-y1))/nullif(pow(x2-x1,2)+pow(y2-y1,2),0),0))) as u from fx_station, ed)
select distinct station_id from t where pow(lon-(x1+u*(x2-x1)),2)+pow(lat-(y1+u*(y2-y1)),2)<=pow(0.05e0,2)"""))
def joi10b(spark, sf):
    return J.near_polygon_edge(V.station(spark, sf), polygons(spark, sf), "station_id", 0.05)


@query("joi11_box_filter", sql("fx_station", f"select station_id, {q6('lat','lat')}, {q6('lon','lon')} from fx_station where lon>86.25e0 and lon<91.75e0 and lat>20.75e0 and lat<25.25e0"))
def joi11(spark, sf):
    from rainloom.functions.lattice import Lattice
    return report(V.station(spark, sf).where(Lattice(86.0, 20.5, 12, 10, 0.5).contains("lat", "lon", 0.25)).select("station_id", "lat", "lon"))


@query("joi12_match_by_set", sql("fx_methods", """
with a as (select fold as l, list_sort(list_distinct(list(station_id))) as m from fx_methods where method='background' group by 1), b as (select (fold+2)%5 as l, list_sort(list_distinct(list(station_id))) as m from fx_methods where method='combined' group by 1)
select cast(a.l as int) as label_a, cast(b.l as int) as label_b, cast(len(a.m) as int) as stations from a join b on a.m=b.m"""))
def joi12(spark, sf):
    m = V.methods(spark, sf)
    a, b = m.where("method = 'background'"), m.where("method = 'combined'").withColumn("fold", (F.col("fold") + 2) % 5)
    return J.match_by_set(a, b, "fold", "station_id").select("label_a", "label_b", F.size("members").alias("stations"))


@query("joi13_shared_folds", sql("fx_methods", f"""
with a as (select date, station_id, fold, truth, {FAIR} as c from fx_methods where method='background' and fold<>1), b as (select date, station_id, fold, truth + case when fold=3 then 1 else 0 end as truth, {FAIR} as c from fx_methods where method='combined'),
j as (select a.fold, a.c-b.c as d, abs(a.truth-b.truth)<=1e-5 as same from a join b on a.date=b.date and a.station_id=b.station_id and a.fold=b.fold), k as (select fold from j group by 1 having bool_and(same))
select j.fold, count(*) as n, {q6("avg(d)","diff")} from j join k on k.fold=j.fold group by 1"""))
def joi13(spark, sf):
    m = V.methods(spark, sf)
    a = m.where("method = 'background' and fold <> 1").select("date", "station_id", "fold", "truth", EN.fair_crps("members", "truth").alias("ca"))
    b = m.where("method = 'combined'").select("date", "station_id", "fold", (F.col("truth") + F.when(F.col("fold") == 3, 1).otherwise(0)).alias("tb"), EN.fair_crps("members", "truth").alias("cb"))
    g = a.join(b, ["date", "station_id", "fold"]).groupBy("fold").agg(F.count("*").alias("n"), F.avg(F.col("ca") - F.col("cb")).alias("diff"), F.bool_and(F.abs(F.col("truth") - F.col("tb")) <= 1e-5).alias("same"))
    return report(g.where("same").drop("same"))


@query("joi14_run_alignment", sql("fx_methods", """
with a as (select * from fx_methods where method='background' and date<date '2024-05-20'), b as (select * from fx_methods where method='combined')
select a.fold, count(*) as rows, count(distinct a.date) as dates, count(*) filter (where abs(a.truth-b.truth)>1e-5) as truth_differs, count(*) filter (where len(a.members)<>len(b.members)) as members_differ, count(*) filter (where b.date is null) as unmatched
from a left join b on a.date=b.date and a.station_id=b.station_id group by 1"""))
def joi14(spark, sf):
    m = V.methods(spark, sf)
    a = m.where("method = 'background' and date < date '2024-05-20'")
    b = m.where("method = 'combined'").select("date", "station_id", F.col("truth").alias("tb"), F.size("members").alias("nb"))
    j = a.join(b, ["date", "station_id"], "left")
    return j.groupBy("fold").agg(F.count("*").alias("rows"), F.countDistinct("date").alias("dates"), F.count_if(F.abs(F.col("truth") - F.col("tb")) > 1e-5).alias("truth_differs"),
                                 F.count_if(F.size("members") != F.col("nb")).alias("members_differ"), F.count_if(F.col("nb").isNull()).alias("unmatched"))


@query("joi15_common_sample", sql("fx_multipair", f"""
with c as (select station_id, date from fx_multipair group by 1,2 having count(distinct product)=2)
select product, p.station_id, p.date, {q6("pred","pred")} from fx_multipair p join c on c.station_id=p.station_id and c.date=p.date"""))
def joi15(spark, sf):
    c = J.common_sample(V.multipair(spark, sf), ["station_id", "date"], "product", "pred", 2)
    return c.select("product", "station_id", "date", R("pred").alias("pred"))


@query("joi16_attach_product", sql("fx_obs fx_prod", f"select o.station_id, o.date, {q6('precip_mm','precip_mm')}, {q6('product_mm','product_mm')} from fx_obs o left join fx_prod p on p.station_id=o.station_id and p.date=o.date"))
def joi16(spark, sf):
    return report(V.obs(spark, sf).join(V.prod(spark, sf), ["station_id", "date"], "left"))


@query("joi17_prefixed_merge", sql("fx_multipair", f"""
with a as (select product as method, count(*) as n, avg(pred) as mean from fx_multipair where date<date '2024-01-16' group by 1), b as (select product as method, count(*) as n, avg(pred) as mean from fx_multipair where date>=date '2024-01-16' group by 1)
select coalesce(a.method,b.method) as method, a.n as early_n, {q6("a.mean","early_mean")}, b.n as late_n, {q6("b.mean","late_mean")} from a full join b on a.method=b.method"""))
def joi17(spark, sf):
    m = V.multipair(spark, sf).withColumnRenamed("product", "method")

    def t(c):
        return m.where(c).groupBy("method").agg(F.count("*").alias("n"), F.avg("pred").alias("mean"))
    return report(J.prefixed_merge({"early": t("date < date '2024-01-16'"), "late": t("date >= date '2024-01-16'")}, "method"))


@query("joi18_end_hour_shift", sql("fx_obs fx_multi", f"""
with p as (select product, station_id, cast(date - case product when 'signup' then 1 else 0 end as date) as date, date as product_date, pred from fx_multi)
select p.product, o.station_id, o.date, product_date, {q6("pred","pred")} from fx_obs o join p on p.station_id=o.station_id and p.date=o.date"""))
def joi18(spark, sf):
    p = V.multi(spark, sf).withColumn("end_hour", F.when(F.col("product") == "signup", 3).otherwise(24))
    p = p.withColumn("product_date", F.col("date")).withColumn("date", F.date_add("date", -J.end_hour_offset("end_hour", 1)))
    return V.obs(spark, sf).select("station_id", "date").join(p, ["station_id", "date"]).select("product", "station_id", "date", "product_date", R("pred").alias("pred"))
