"""Queries over ranking, selection, set operations, checks, resampling, the ensemble update and streaming."""

from __future__ import annotations


from pyspark.sql import functions as F

from rainloom.functions import draws as D, ensemble as EN, scalar as S
from rainloom.functions.lattice import VIEW_LATTICE as G
from rainloom.operators import checks as C, ensembles as E, grid as GR, resample as B, select as SE, stats as ST, temporal as T, update as U, verify as X
from rainloom.plans import views as V
from rainloom.plans.ensembles import FAIR, per_sample, sdraw
from rainloom.plans.grids import AREA, BLK, CORNERS, SMOOTH, W3, area, smooth
from rainloom.plans.joins import GM, GS, KM, KNN, grid_members
from rainloom.plans.registry import query
from rainloom.plans.scalars import q6
from rainloom.plans.stats import report
from rainloom.plans.verify import FIELD, corr_sql, field
from rainloom.plans.views import sql, table
from rainloom.session import new_folder
from rainloom.streaming import windows as ST_W

R = S.rounded


# ---- ranking --------------------------------------------------------------

@query("win01_spearman", sql("fx_pair", f"""
with r as (select row_number() over (order by pred, date, station_id) as a, row_number() over (order by obs, date, station_id) as b from fx_pair) select {q6("corr(a,b)","spearman")}, count(*) as n from r"""))
def win01(spark, sf):
    return report(SE.spearman(V.pair(spark, sf), "pred", "obs", "date", "station_id"))


SCORES = f"sc as (select method, fold, avg({FAIR}) as crps, sqrt(avg(pow(list_avg(members)-truth,2))) as rmse, avg(list_avg(members)-truth) as bias, corr(list_avg(members),truth) as corr, count(*) as n from fx_methods group by 1,2)"


def fold_scores(spark, sf):
    return E.point_metrics(V.methods(spark, sf), ["method", "fold"])


@query("win02_winners", sql("fx_methods", f"""with {SCORES}
select fold, method, {q6("crps","crps")}, cast(row_number() over (partition by fold order by crps, method) as int) as rank, row_number() over (partition by fold order by crps, method)=1 as winner,
 crps-min(crps) over (partition by fold) <= greatest(0.05e0, 0.01e0*min(crps) over (partition by fold)) as co_winner from sc"""))
def win02(spark, sf):
    return report(SE.winners(fold_scores(spark, sf).select("fold", "method", "crps"), ["fold"], "method", "crps", 0.01, 0.05))


@query("win02_factorial_effects", sql("fx_methods", f"""with {SCORES}, c as (select avg(case when method='gauges' and fold=0 then crps end) a, avg(case when method='gauges' and fold=1 then crps end) b, avg(case when method='combined' and fold=0 then crps end) c, avg(case when method='combined' and fold=1 then crps end) d from sc)
select {q6("((c+d)-(a+b))/2","effect_first")}, {q6("((b+d)-(a+c))/2","effect_second")}, {q6("(d-c)-(b-a)","interaction")} from c"""))
def win02b(spark, sf):
    return report(SE.factorial_effects(fold_scores(spark, sf), "method", "fold", "crps", ("gauges", "combined"), (0, 1)))


@query("win03_best_rows", sql("fx_methods", f"""with {SCORES}, l as (select 'crps' as metric, method||'/'||fold as name, crps as value, -crps as g from sc union all select 'correlation', method||'/'||fold, corr, corr from sc union all select 'bias', method||'/'||fold, bias, -abs(bias-0) from sc),
r as (select *, row_number() over (partition by metric order by g desc, name) as r from l) select metric, name, {q6("value","value")} from r where r=1"""))
def win03(spark, sf):
    s = fold_scores(spark, sf).withColumn("name", F.concat_ws("/", "method", F.col("fold").cast("string"))).select("name", "crps", "correlation", "bias")
    long = s.unpivot("name", ["crps", "correlation", "bias"], "metric", "value")
    return report(SE.best_rows(long, {"crps": "min", "correlation": "max", "bias": 0.0}).select("metric", "name", "value"))


@query("win04_synergy", sql("fx_methods", f"""with {SCORES}, g as (select fold, min(case when method in ('background','gauges') then crps end) as s, max(case when method='combined' then crps end) as c from sc group by 1)
select fold, {q6("s","best_single")}, {q6("c","combined")}, {q6("100*(s-c)/s","synergy_percent")} from g"""))
def win04(spark, sf):
    return report(SE.synergy(fold_scores(spark, sf), ["background", "gauges"], "combined", keys=["fold"]))


@query("win05_configuration_selection", sql("fx_methods fx_grid", f"""with {SCORES}, g as (select method, sum(crps*n)/sum(n) as crps, sum(bias*n)/sum(n) as bias from sc group by 1),
w as (select method, avg(case when list_avg(members)>=1 then 1e0 else 0e0 end) as wet from fx_methods group by 1), e as (select avg(case when value>=25 then 1e0 else 0e0 end) as a, avg(case when ref>=38 then 1e0 else 0e0 end) as b from fx_grid)
select g.method, {q6("crps","crps")}, {q6("bias","bias")}, {q6("wet","wet_area")}, wet between least(a,b) and greatest(a,b) as wet_inside, row_number() over (order by crps, g.method)=1 as selected from g join w on w.method=g.method, e"""))
def win05(spark, sf):
    m = V.methods(spark, sf)
    g = E.point_metrics(m, ["method"]).select("method", "crps", "bias")
    w = m.groupBy("method").agg(ST.share(EN.mean("members") >= 1).alias("wet_area"))
    e = V.grid(spark, sf).agg(F.array(ST.share(F.col("value") >= 25), ST.share(F.col("ref") >= 38)).alias("e")).scalar()
    d = SE.winners(g.join(w, "method"), [], "method", "crps").withColumn("_e", e)
    return report(d.select("method", "crps", "bias", "wet_area", F.col("wet_area").between(F.array_min("_e"), F.array_max("_e")).alias("wet_inside"), F.col("winner").alias("selected")))


@query("win06_fusion_gate", sql("fx_methods", f"""with {SCORES}, d as (select a.method as c, a.fold, a.crps-b.crps as d, a.n from sc a join sc b on b.fold=a.fold and b.method='background' where a.method<>'background'),
g as (select c, sum(d*n)/sum(n) as p, count(*) filter (where d<0) as w, count(*) as f from d group by 1), h as (select *, p<0 and w>=ceil(f/2e0) as ok from g)
select c as "case", {q6("p","pooled")}, w as wins, f as folds, ok as passes, ok and row_number() over (partition by ok order by p, c)=1 as best from h"""))
def win06(spark, sf):
    s = fold_scores(spark, sf)
    b = s.where("method = 'background'").select("fold", F.col("crps").alias("b"))
    d = s.where("method <> 'background'").join(b, "fold").select(F.col("method").alias("case"), "fold", (F.col("crps") - F.col("b")).alias("d"), "n")
    return report(SE.fusion_gate(d, "case", "d", "n"))


def as_rows(spark, ids, name="station_id"):
    return spark.createDataFrame([(int(i),) for i in ids], f"{name} bigint")


D2 = "floor((({a}y-{y})*({a}y-{y})+({a}x-{x})*({a}x-{x}))*1e9+0.5e0)/1e9"


def far_sql(n):
    """Farthest-point selection of n stations, one CTE per step."""
    d = lambda t: D2.format(a="p.", y=f"{t}.y", x=f"{t}.x")
    out = ["m as (select cos(radians(avg(lat))) as c from fx_station)", "p as (select station_id, lat as y, lon*c as x from fx_station, m)", "c0 as (select avg(y) as y, avg(x) as x from p)",
           f"s1 as (select p.* from p, c0 order by {d('c0')} desc, station_id limit 1)"]
    for k in range(2, n + 1):
        least = ",".join(f"{d(f's{j}')}" for j in range(1, k))
        srcs = ",".join(f"s{j}" for j in range(1, k))
        out.append(f"s{k} as (select p.* from p, {srcs} where p.station_id not in ({','.join(f's{j}.station_id' for j in range(1, k))}) order by least({least}) desc, p.station_id limit 1)")
    return "with " + ", ".join(out) + " " + " union all ".join(f"select station_id from s{k}" for k in range(1, n + 1))


@query("win07_spread_holdout", sql("fx_station", far_sql(6)))
def win07(spark, sf):
    return SE.farthest_order(V.station(spark, sf), 6).select("station_id")


def supported_sql(count, radius, gap):
    """The supported holdout: eligible stations, farthest-point picks, and one swap a step until every pick has support."""
    d = lambda t: D2.format(a="p.", y=f"{t}.y", x=f"{t}.x")
    picks = [f"s1 as (select p.* from p, c0 order by {d('c0')} desc, station_id limit 1)"]
    for k in range(2, count + 1):
        ids, srcs = ",".join(f"s{j}.station_id" for j in range(1, k)), ",".join(f"s{j}" for j in range(1, k))
        picks.append(f"s{k} as (select p.* from p, {srcs} where p.station_id not in ({ids}) order by least({','.join(d(f's{j}') for j in range(1, k))}) desc, p.station_id limit 1)")
    chosen = " union all ".join(f"select station_id, {k} as pos from s{k}" for k in range(1, count + 1))
    return f"""with {KNN}, kb as (select s, (degrees(atan2(dy,dx))+360e0)%360e0 as b from k where r<=6), kg as (select s, b - lag(b) over (partition by s order by b) as g from kb),
gp as (select kb.s, greatest(coalesce(any_value(kx.g),0), 360-(max(b)-min(b))) as gap from kb left join (select s, max(g) as g from kg group by 1) kx on kx.s=kb.s group by 1),
km as (select a.station_id as a, b.station_id as b, {KM} as km from fx_station a join fx_station b on a.station_id<>b.station_id),
el as (select f.* from fx_station f join gp on gp.s=f.station_id where gap<={gap} and exists (select 1 from km where a=f.station_id and km<={radius})),
p as (select station_id, lat as y, lon*c as x from el, m), c0 as (select avg(y) as y, avg(x) as x from p), {", ".join(picks)}, ch as ({chosen}),
st as (select cast(0 as bigint) as k, f.station_id as id, e.station_id is not null as ok, cast(ch.pos as int) as pos, cast(0 as bigint) as turn from fx_station f left join el e on e.station_id=f.station_id left join ch on ch.station_id=f.station_id
 union all select k+1, id, ok, case when id=best then wpos when id=worst then null else pos end, case when id=worst then k+1 else turn end from (
 select *, first_value(id) over (order by case when ok and pos is null then 0 else 1 end, least(u, coalesce(kw, 1e9)), turn, id) as best from (
 select w.*, km.km as kw from (
 select *, first_value(id) over o as worst, first_value(pos) over o as wpos, first_value(u) over o as wu from (
 select s.k, s.id, s.ok, s.pos, s.turn, coalesce(min(case when o.pos is null then km.km end), 1e9) as u from st s join km on km.a=s.id join st o on o.id=km.b group by 1,2,3,4,5)
 window o as (order by case when pos is null then 1 else 0 end, u desc, pos)) w left join km on km.a=w.id and km.b=w.worst) where wu>{radius}))
select id as station_id from st where pos is not null and k=(select max(k) from st)"""


@query("win08_supported_holdout", sql("fx_station", supported_sql(4, "150e0", "300e0")).replace("with fx_station", "with recursive fx_station", 1))
def win08(spark, sf):
    return as_rows(spark, SE.supported_holdout(V.station(spark, sf), 4, radius_km=150.0, max_gap_deg=300.0, fewer=True))


FOLDS = f"""m as (select cos(radians(avg(lat))) as c from fx_station), p as (select station_id, lat as y, lon*c as x from fx_station, m), c0 as (select avg(y) as y, avg(x) as x from p),
s1 as (select p.* from p, c0 order by {D2.format(a='p.', y='c0.y', x='c0.x')} desc, station_id limit 1),
st as (select cast(0 as bigint) as k, p.station_id, p.y, p.x, case when p.station_id=s1.station_id then 1e300 else {D2.format(a='p.', y='s1.y', x='s1.x')} end as d, [1e300,1e300,1e300,1e300,1e300] as f, cast(null as int) as fold, [0,0,0,0,0] as sizes from p, s1
 union all select k+1, station_id, y, x, least(d,dp), [case when i=g then least(f[i],dp) else f[i] end for i in range(1,6)], case when station_id=pid then cast(g-1 as int) else fold end, [sizes[i]+case when i=g then 1 else 0 end for i in range(1,6)] from (
 select *, {D2.format(a='', y='py', x='px')} as dp, list_position(r, list_max(r)) as g from (
 select *, [case when sizes[i]=list_min(sizes) then pf[i] else -1e0 end for i in range(1,6)] as r from (
 select *, first_value(station_id) over w as pid, first_value(y) over w as py, first_value(x) over w as px, first_value(f) over w as pf, first_value(fold) over w as pfold from st
 window w as (order by case when fold is null then 0 else 1 end, d desc, station_id)) where pfold is null)))"""


@query("win09_spread_folds", sql("fx_station", f"with {FOLDS} select station_id, fold from st where k=(select max(k) from st)").replace("with fx_station", "with recursive fx_station", 1))
def win09(spark, sf):
    return SE.spread_folds(V.station(spark, sf), 5)


@query("win10_random_folds", sql("fx_station", f"select station_id, cast(ntile(5) over (order by {sdraw(chr(39) + '9' + chr(39), 'station_id')}, station_id)-1 as int) as fold from fx_station"))
def win10(spark, sf):
    return SE.random_folds(V.station(spark, sf), 5, 9)


@query("win11_member_subset", sql("fx_rain_ens", f"select sample_id, {q6('list_avg([members[i+1] for i in [0,4,8,11,15]])','mean')} from fx_rain_ens"))
def win11(spark, sf):
    return V.rain_ens(spark, sf).select("sample_id", R(EN.mean(SE.member_subset("members", 16, 5))).alias("mean"))


@query("win12_distinct_arms", sql("fx_methods", f"""with b as (select * from fx_methods where method='gauges'), a as (select case when method='combined' then 'alias' else method end as method, date, station_id, case when method='combined' then null else members end as members from fx_methods where method in ('background','combined')),
j as (select a.method, a.members as m, b.members as n from a join b on a.date=b.date and a.station_id=b.station_id),
k as (select method, unnest(coalesce(m,n)) as x, unnest(n) as y from (select method, m, n from j)) select method, {q6("max(abs(x-y))","max_gap")}, max(abs(x-y))>1e-8 as "distinct" from k group by 1"""))
def win12(spark, sf):
    m = V.methods(spark, sf)
    g = m.where("method = 'gauges'")
    alias = g.withColumn("method", F.lit("alias"))
    return report(SE.distinct_arms(m.where("method in ('gauges', 'background')").unionByName(alias), "gauges", ["date", "station_id"]))


@query("win12_duplicate_runs", sql("fx_obs", """
with s as (select station_id%40 as r, station_id, floor(sum(precip_mm)/40) as a, count(*) as n from fx_obs group by 1,2), g as (select a, n, list_sort(list(cast(station_id as varchar))) as l from s group by 1,2 having count(*)>1)
select array_to_string(l,'=') as runs, cast(len(l) as int) as n from g"""))
def win12b(spark, sf):
    s = V.obs(spark, sf, exact=True).groupBy(F.col("station_id").cast("string").alias("run")).agg(F.floor(F.sum("precip_mm") / 40).alias("a"), F.count("*").alias("c"))
    return SE.duplicate_runs(s, "run", ["a", "c"])


# ---- sets and checks ------------------------------------------------------

@query("set01_union", sql("fx_obs fx_prod", f"select 'obs' as source, station_id, date, {q6('precip_mm','mm')} from fx_obs union all select 'product', station_id, date, {q6('product_mm','mm')} from fx_prod"))
def set01(spark, sf):
    a = V.obs(spark, sf).select(F.lit("obs").alias("source"), "station_id", "date", F.col("precip_mm").alias("mm"))
    return report(a.unionByName(V.prod(spark, sf).select(F.lit("product").alias("source"), "station_id", "date", F.col("product_mm").alias("mm"))))


@query("set02_missing_days", "select distinct cast(l_shipdate as date) as day from lineitem except select distinct cast(o_orderdate as date) from orders")
def set02(spark, sf):
    have = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    return C.missing_days(have, table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")))


@query("set03_shared_keys", sql("fx_obs fx_multi", "select station_id, date from fx_obs intersect select station_id, date from fx_multi where product='signup' intersect select station_id, date from fx_multi where product='error'"))
def set03(spark, sf):
    k = ["station_id", "date"]
    m = V.multi(spark, sf)
    return V.obs(spark, sf).select(k).intersect(m.where("product = 'signup'").select(k)).intersect(m.where("product = 'error'").select(k))


COVER = "with p as (select method, station_id, count(distinct fold) as f, count(distinct date) as d from fx_methods group by 1,2), s as (select method, count(*) as st, count(*) filter (where f<>1) as no, min(d) as lo, max(d) as hi from p group by 1), q as (select method, count(distinct fold) as f, min(fold) as a, max(fold) as b from fx_methods group by 1) select s.method, st as stations, no as not_once, lo as min_days, hi as max_days, f as folds, f=5 and a=0 and b=4 as folds_complete from s join q on q.method=s.method"


@query("set04_exhaustive_cover", sql("fx_methods", "with f as (select method, count(distinct fold) as folds, count(distinct station_id) as u, count(distinct (fold, station_id)) as t from fx_methods group by 1), p as (select count(distinct station_id) as pool from fx_methods) select method, folds, u=t as disjoint, u=pool as covers from f, p"))
def set04(spark, sf):
    m = V.methods(spark, sf)
    pool = m.agg(F.countDistinct("station_id")).scalar()
    g = m.groupBy("method").agg(F.countDistinct("fold").alias("folds"), F.countDistinct("station_id").alias("u"), F.countDistinct("fold", "station_id").alias("t"))
    return g.select("method", "folds", (F.col("u") == F.col("t")).alias("disjoint"), (F.col("u") == pool).alias("covers"))


@query("chk01_duplicate_keys", "select l_partkey, l_suppkey, count(*) as n from lineitem group by 1,2 having count(*)>1")
def chk01(spark, sf):
    return C.duplicates(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


@query("chk02_missing_steps", sql("fx_obs", "select s.station_id, d.date from (select distinct station_id from fx_obs) s cross join (select cast(unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day)) as date) as date) d where (s.station_id, d.date) not in (select (station_id, date) from fx_obs)"))
def chk02(spark, sf):
    return C.missing_steps(V.obs(spark, sf), "date", F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"), keys=["station_id"])


@query("chk03_units", "select p_partkey, case p_size%4 when 0 then 'mm/day' when 1 then ' MM/D ' when 2 then 'kg' else null end as units from part where p_size%4>=2")
def chk03(spark, sf):
    u = F.when(F.col("p_size") % 4 == 0, "mm/day").when(F.col("p_size") % 4 == 1, " MM/D ").when(F.col("p_size") % 4 == 2, "kg")
    return C.wrong_units(table(spark, sf, "part").select("p_partkey", u.alias("units")), "units", C.UNITS_PER_DAY)


@query("chk04_fold_cover", sql("fx_methods", COVER))
def chk04(spark, sf):
    return C.fold_cover(V.methods(spark, sf), 5)


@query("chk05_truth_differences", sql("fx_obs fx_prod", f"select coalesce(o.station_id,p.station_id) as station_id, coalesce(o.date,p.date) as date, {q6('precip_mm','value_a')}, {q6('product_mm','value_b')} from fx_obs o full join fx_prod p on o.station_id=p.station_id and o.date=p.date where not coalesce(abs(precip_mm-product_mm)<=50, false)"))
def chk05(spark, sf):
    b = V.prod(spark, sf, exact=True).withColumnRenamed("product_mm", "precip_mm")
    d = C.truth_differences(V.obs(spark, sf, exact=True), b, ["station_id", "date"], "precip_mm", 50.0)
    return report(d.withColumns({c: F.col(c).cast("double") for c in ("value_a", "value_b")}))


@query("chk05_identical_control", sql("fx_obs", "select count(*) as matched, cast(0 as bigint) as unmatched, count(*) filter (where station_id%7=0) as different from fx_obs"))
def chk05b(spark, sf):
    b = V.obs(spark, sf).withColumn("precip_mm", F.when(F.col("station_id") % 7 == 0, F.col("precip_mm") + 1e-9).otherwise(F.col("precip_mm")))
    return C.identical(V.obs(spark, sf), b, ["station_id", "date"], "precip_mm")


@query("chk06_axis_spacing", sql("fx_grid", f"with a as (select distinct cast(day - date '1970-01-01' as double) as x from fx_grid), s as (select x, x-lag(x) over (order by x) as step from a) select x, step from s where abs(step-31)>1e-6"))
def chk06(spark, sf):
    a = V.grid(spark, sf).select(F.datediff("day", F.lit("1970-01-01").cast("date")).cast("double").alias("x")).distinct()
    return C.spacing(a, "x", 31.0)


@query("chk07_conservation", sql("fx_grid", f"""with {SMOOTH},
f as (select day, {BLK}, sum(v*{AREA})/sum({AREA}) as v from sm group by 1,2,3), c as (select day, {BLK}, sum(value*{AREA})/sum({AREA}) as v from fx_grid group by 1,2,3)
select {q6("max(abs(f.v-c.v))","max_error")}, count(*) as blocks from f join c using (day, "by", bx)"""))
def chk07(spark, sf):
    coarse = GR.area_block_mean(V.grid(spark, sf), 4, area(), 0.0).select("day", "by", "bx", "value")
    c = C.conservation(smooth(spark, sf), coarse, ["day", "by", "bx"], area())
    return report(c)


@query("chk08_store_agreement", sql("fx_multi", "with p as (select product as store, date as day, count(*) as c from fx_multi group by 1,2) select store, count(*) as days, min(day) as first_day, max(day) as last_day, min(c) as min_cells, max(c) as max_cells, count(*)=max(day)-min(day)+1 as contiguous, min(c)=max(c) as same_mask from p group by 1"))
def chk08(spark, sf):
    m = V.multi(spark, sf).select(F.col("product").alias("store"), F.col("date").alias("day"), F.col("pred").alias("value"))
    return C.store_agreement(m, "store")


# ---- resampling -----------------------------------------------------------

def boot_sql(source, seed, block, reps, keys="", segmented=False):
    """Hashed circular block bootstrap over a (keys, date, num, den) CTE named in source."""
    k = f"{keys}, " if keys else ""
    ks = "".join(f"a.{x}=b.{x} and " for x in keys.split(", ") if x)
    part = f"partition by {k}segment" if True else ""
    seg = f"sum(g) over (partition by {keys or '0'} order by date rows unbounded preceding)" if segmented else "0"
    return f"""b0 as (select *, case when date-lag(date) over (partition by {keys or '0'} order by date)>1 then 1 else 0 end as g from {source}),
b1 as (select *, cast({seg} as int) as segment from b0), b2 as (select *, row_number() over ({part} order by date)-1 as pos from b1),
sz as (select {k}segment, count(*) as n, greatest(1,least({block},count(*))) as w from b2 group by {k}segment),
rp as (select {k}segment, n, w, rep, kk from (select *, unnest(range({reps})) as rep from sz), (select unnest(range(4000)) as kk) where kk*w<n),
dr as (select *, {sdraw(f"'{seed}'", *[x for x in keys.split(', ') if x], "segment", "rep", "kk")}%n as s from rp),
ex as (select {k}segment, rep, (s+j)%n as pos from dr, (select unnest(range({block})) as j) where j<w and kk*w+j<n),
es as (select {''.join(f'a.{x}, ' for x in keys.split(', ') if x)}rep, sum(num)/sum(den) as e from ex a join b2 b on {ks} a.segment=b.segment and a.pos=b.pos group by {''.join(f'a.{x}, ' for x in keys.split(', ') if x)}rep),
ci as (select {k}quantile_cont(e,0.025) as lo, quantile_cont(e,0.975) as hi from es group by {keys or 'true'}),
ba as (select {k}sum(num)/sum(den) as mean, count(*) as n_days, count(distinct segment) as n_segments from b2 group by {keys or 'true'})"""


BOOT_OUT = f"""{q6("mean","mean")}, n_days, n_segments, {q6("lo","ci_low")}, {q6("hi","ci_high")}, (lo>0 or hi<0) as significant"""


@query("boo01_day_block_bootstrap", sql("fx_multipair", f"""with d as (select product, date, avg(pred-obs) as num, 1 as den from fx_multipair group by 1,2), {boot_sql("d", 1, 3, 200, "product")}
select ba.product, {BOOT_OUT} from ba join ci on ci.product=ba.product"""))
def boo01(spark, sf):
    d = V.multipair(spark, sf).groupBy("product", "date").agg(F.avg(F.col("pred") - F.col("obs")).alias("num")).withColumn("den", F.lit(1))
    return report(B.block_bootstrap(d, ["product"], 3, 200, 1))


@query("boo02_day_station_bootstrap", sql("fx_multipair", f"""with d as (select product, date, sum(pred-obs) as num, count(*) as den from fx_multipair group by 1,2), {boot_sql("d", 2, 3, 200, "product")}
select ba.product, {BOOT_OUT} from ba join ci on ci.product=ba.product"""))
def boo02(spark, sf):
    d = B.day_sums(V.multipair(spark, sf).withColumn("diff", F.col("pred") - F.col("obs")), ["product"], "diff")
    return report(B.block_bootstrap(d, ["product"], 3, 200, 2))


@query("boo03_segmented_bootstrap", sql("fx_multipair", f"""with d as (select product, date, sum(pred-obs) as num, count(*) as den from fx_multipair group by 1,2), {boot_sql("d", 3, 4, 200, "product", True)}
select ba.product, {BOOT_OUT} from ba join ci on ci.product=ba.product"""))
def boo03(spark, sf):
    m = V.multipair(spark, sf).withColumn("diff", F.col("pred") - F.col("obs"))
    return report(B.block_bootstrap(B.day_sums(m, ["product"], "diff"), ["product"], 4, 200, 3, segmented=True))


PAIRC = f"""cr as (select method, date, station_id, fold, truth, {FAIR} as c from fx_methods),
dd as (select 'combined-background' as contrast, a.date, a.station_id, a.fold, a.c-b.c as d from cr a join cr b on a.date=b.date and a.station_id=b.station_id and a.method='combined' and b.method='background'
 union all select 'combined-gauges', a.date, a.station_id, a.fold, a.c-b.c from cr a join cr b on a.date=b.date and a.station_id=b.station_id and a.method='combined' and b.method='gauges')"""


@query("boo04_sample_bootstrap", sql("fx_methods", f"""with {PAIRC}, s as (select contrast, d, (datediff('day', date '2024-05-01', date)+station_id*50) as id from dd),
ix as (select *, row_number() over (partition by contrast order by id%256, id)-1 as pos, count(*) over (partition by contrast) as n from s),
r as (select contrast, rep, {sdraw("'4'", "contrast", "rep", "pos")}%n as p from ix, (select unnest(range(50)) as rep)), e as (select r.contrast, rep, avg(d) as e from r join ix on ix.contrast=r.contrast and ix.pos=r.p group by 1,2),
c as (select contrast, quantile_cont(e,0.025) as lo, quantile_cont(e,0.975) as hi from e group by 1), m as (select contrast, count(*) as n, avg(d) as mean from s group by 1)
select m.contrast, n, {q6("mean","mean")}, {q6("lo","ci_low")}, {q6("hi","ci_high")}, (lo>0 or hi<0) as significant from m join c on c.contrast=m.contrast"""))
def boo04(spark, sf):
    m = V.methods(spark, sf)
    d = None
    for other in ("background", "gauges"):
        x = B.paired_crps(m, "combined", other).withColumn("contrast", F.lit(f"combined-{other}"))
        d = x if d is None else d.unionByName(x)
    d = d.withColumn("id", F.datediff("date", F.lit("2024-05-01").cast("date")) + F.col("station_id") * 50)
    return report(B.position_bootstrap(d, ["contrast"], "diff", "id", 50, 4))


@query("boo05_daily_contrasts", sql("fx_methods", f"with {PAIRC} select contrast, date, {q6('sum(d)','num')}, count(d) as den from dd group by 1,2"))
def boo05(spark, sf):
    return report(B.contrasts(V.methods(spark, sf), [("combined", "background"), ("combined", "gauges")]))


@query("boo06_crps_by_size", sql("fx_rain_ens", f"""
with sd as (select s as size, d as draw, m, {sdraw("'6'", "s", "d", "m")} as h from (select unnest([2,4,8,16]) as s), (select unnest(range(10)) as d), (select unnest(range(16)) as m) where s<16 or d=0),
pk as (select size, draw, m from (select *, row_number() over (partition by size, draw order by h, m) as r from sd) where r<=size),
pl as (select size, draw, list(m) as p from pk group by 1,2), x as (select size, draw, truth, [members[i+1] for i in p] as members from fx_rain_ens, pl),
c as (select size, draw, avg({FAIR}) as c from x group by 1,2) select cast(size as int) as size, {q6("avg(c)","crps")}, {q6("quantile_cont(c,0.025)","low")}, {q6("quantile_cont(c,0.975)","high")}, count(*) as n_draws from c group by 1"""))
def boo06(spark, sf):
    return report(B.crps_by_size(V.rain_ens(spark, sf), [2, 4, 8, 16], 16, 10, 6))


@query("boo07_placement_permutation", sql("fx_grid", f"""
with r as (select day, cast(floor(iy/3) as int) as "by", cast(floor(ix/3) as int) as bx, iy*16+ix as o, ref-avg(ref) {W3} as c, value-avg(value) {W3} as t from fx_grid),
p as (select r.*, q from r, (select unnest(range(20)) as q)), h as (select *, {sdraw("'8'", "day", '"by"', "bx", "q", "o")} as h from p),
a as (select day, "by", bx, q, row_number() over (partition by day, "by", bx, q order by h, c) as k, c from h), b as (select day, "by", bx, q, row_number() over (partition by day, "by", bx, q order by o) as k, t from h),
n as (select a.q, corr(a.c,b.t) as r, avg(pow(a.c-b.t,2)) as m from a join b on a.day=b.day and a."by"=b."by" and a.bx=b.bx and a.q=b.q and a.k=b.k group by 1), ob as (select corr(c,t) as r, avg(pow(c-t,2)) as m from r)
select {q6("any_value(ob.r)","observed_corr")}, {q6("avg(n.r)","null_corr_mean")}, {q6("(1+count(*) filter (where n.r>=ob.r))/(1e0+count(*))","corr_p")}, {q6("any_value(ob.m)","observed_mse")}, {q6("avg(n.m)","null_mse_mean")}, {q6("(1+count(*) filter (where n.m<=ob.m))/(1e0+count(*))","mse_p")} from n, ob"""))
def boo07(spark, sf):
    d = GR.scale_decompose(GR.scale_decompose(V.grid(spark, sf), 3).withColumnRenamed("residual", "t").drop("coarse"), 3, "ref").withColumnRenamed("residual", "c")
    d = d.withColumn("o", F.col("iy") * 16 + F.col("ix"))
    return report(B.placement_test(d, ["day", "by", "bx"], "c", "t", "o", 20, 8))


@query("boo08_fold_comparison", sql("fx_methods", f"""with {PAIRC}, d as (select fold, date, sum(d) as num, count(d) as den from dd where contrast='combined-background' group by 1,2), {boot_sql("d", 9, 1, 100, "fold")}
select ba.fold, {BOOT_OUT} from ba join ci on ci.fold=ba.fold"""))
def boo08(spark, sf):
    p = B.paired_crps(V.methods(spark, sf), "combined", "background", extra=("fold",))
    return report(B.block_bootstrap(B.day_sums(p, ["fold"], "diff"), ["fold"], 1, 100, 9))


# ---- ensemble update ------------------------------------------------------

def update_inputs(spark, sf, gauges):
    """State in transformed units, and one observation of every gauge for each day."""
    f = grid_members(spark, sf).withColumn("members", F.transform("members", lambda x: S.rain_forward(x)))
    days = V.grid(spark, sf).groupBy("day").agg(F.avg("value").alias("m")).agg(F.collect_list(F.struct("day", "m"))).scalar()
    o = gauges.select("station_id", F.inline(days))
    return f, o.select("station_id", "day", (F.col("m") * 1.3 + F.col("station_id")).alias("obs_mm"))


ENSU = f"""{CORNERS.replace("fx_station", "(select * from fx_station where station_id=1)")}, {GM}, {GS},
hh as (select day, [ln(1+x/0.1e0) for x in members] as h from ms), ob as (select day, ln(1+(avg(value)*1.3e0+1)/0.1e0) as y from fx_grid group by 1),
hy as (select hh.day, h, list_avg(h) as hm, list_var_samp(h)+0.3e0 as den, y, lat as la, lon as lo from hh join ob on ob.day=hh.day, (select lat, lon from fx_station where station_id=1)),
st as (select gm.day, iy, ix, [ln(1+x/0.1e0) for x in members] as s, hy.* exclude (day), 111e0*sqrt(pow(20e0+(iy+0.5e0)*0.5e0-la,2)+pow(cos(radians(la))*(86e0+(ix+0.5e0)*0.5e0-lo),2)) as km from gm left join hy on hy.day=gm.day),
wt as (select *, list_avg(s) as m, 2*km/300e0 as r from st),
gn as (select *, case when r<=1 then 1-5e0/3*pow(r,2)+5e0/8*pow(r,3)+0.5e0*pow(r,4)-0.25e0*pow(r,5) when r<2 then greatest(0e0,4-5*r+5e0/3*pow(r,2)+5e0/8*pow(r,3)-0.5e0*pow(r,4)+pow(r,5)/12-2/(3*r)) else 0e0 end as w,
 list_sum([(s[i]-m)*(h[i]-hm) for i in range(1,7)])/5 as cov from wt),
up as (select day, iy, ix, case when w>0 then [s[i]+w*cov/den*(y-hm)-1/(1+sqrt(0.3e0/den))*w*cov/den*(h[i]-hm) for i in range(1,7)] else s end as u from gn)"""


@query("ens01_single_gauge_update", sql("fx_grid fx_station", f"with {ENSU} select day, iy, ix, {q6('list_avg(u)','mean')}, {q6('list_var_samp(u)','variance')} from up"))
def ens01(spark, sf):
    g = V.station(spark, sf).where("station_id = 1")
    f, o = update_inputs(spark, sf, g)
    u = U.update_once(f, g, o, G, 0.3, 300.0)
    return report(u.select("day", "iy", "ix", EN.mean("members").alias("mean"), EN.variance("members").alias("variance")))


HAT = "greatest(0e0,1-abs(r-iy))*greatest(0e0,1-abs(c-ix))"
SEEN = ", ".join(f"ln(1+(sum(u*greatest(exp(s[{i}])-1,0)*0.1e0) over (partition by day))/0.1e0)" for i in range(1, 7))
SEEN_BY = ", ".join(f"ln(1+sum(u*greatest(exp(s[{i}])-1,0)*0.1e0)/0.1e0)" for i in range(1, 7))
SERIAL = f"""gm0 as ({GM.removeprefix("gm as (")},
g as (select *, row_number() over (order by {sdraw("'2'", "station_id")}, station_id) as k, least(greatest((lat-20.25e0)/0.5e0,0),15) as r, least(greatest((lon-86.25e0)/0.5e0,0),15) as c from fx_station),
ob as (select day, avg(value)*1.3e0 as m from fx_grid group by 1),
st as (select cast(0 as bigint) as k, day, iy, ix, [ln(1+x/0.1e0) for x in members] as s from gm0 union all
 select k, day, iy, ix, case when n>0 and den>1e-8 and w>0 then [s[i]+w*cov/den*(y-hm)-1/(1+sqrt(0.3e0/den))*w*cov/den*(h[i]-hm) for i in range(1,7)] else s end from (
 select *, case when q<=1 then 1-5e0/3*pow(q,2)+5e0/8*pow(q,3)+0.5e0*pow(q,4)-0.25e0*pow(q,5) when q<2 then greatest(0e0,4-5*q+5e0/3*pow(q,2)+5e0/8*pow(q,3)-0.5e0*pow(q,4)+pow(q,5)/12-2/(3*q)) else 0e0 end as w,
  list_sum([(s[i]-list_avg(s))*(h[i]-hm) for i in range(1,7)])/5 as cov from (
 select *, list_avg(h) as hm, list_var_samp(h)+0.3e0 as den from (
 select *, [{SEEN}] as h, sum(case when u>0 then 1 else 0 end) over (partition by day) as n from (
 select g.k, st.day, iy, ix, s, {HAT} as u, ln(1+(m+station_id)/0.1e0) as y, 2*111e0*sqrt(pow(20e0+(iy+0.5e0)*0.5e0-lat,2)+pow(cos(radians(lat))*(86e0+(ix+0.5e0)*0.5e0-lon),2))/300e0 as q
 from st join g on g.k=st.k+1 join ob on ob.day=st.day))))),
hx as (select st.k, st.day, station_id, [{SEEN_BY}] as h from (select st.k, day, station_id, s, {HAT} as u from st, g where st.k in (0, (select max(k) from g))) st where u>0 group by 1,2,3),
e as (select hx.k, hx.day, sqrt(avg(pow(ln(1+(m+station_id)/0.1e0)-list_avg(h),2))) as rmse, count(*) as n from hx join ob on ob.day=hx.day group by 1,2)"""


@query("ens02_serial_update", sql("fx_grid fx_station", f"""with {SERIAL}
select a.day, {q6("a.rmse","before")}, a.n as n_gauges, {q6("b.rmse","after")} from e a join e b on b.day=a.day and a.k=0 and b.k>0""").replace("with fx_grid", "with recursive fx_grid", 1))
def ens02(spark, sf):
    """Every gauge, in hash order."""
    g = V.station(spark, sf)
    f, o = update_inputs(spark, sf, g)
    before = U.innovation_rmse(f, g, o, G).select("day", F.col("rmse").alias("before"), "n_gauges")
    after = U.innovation_rmse(U.update_serial(f, g, o, D.draw(2, "station_id"), G, 0.3, 300.0), g, o, G).select("day", F.col("rmse").alias("after"))
    return report(before.join(after, "day"))


# ---- streaming ------------------------------------------------------------

def _folder(spark):
    return new_folder(spark, "stream")


@query("str01_reporting_windows", """
with w as (select user_id as station_id, cast(cast(ts - interval 3 hour as date) + 1 as date) as date, sum(value*0.5e0) as p, count(value) as n from events group by 1,2), m as (select max(ts) - interval 6 hour as wm from events)
select station_id, date, case when n>=2 then floor(p*1e6+0.5e0)/1e6 end as precip_mm, n as n_valid from w, m where cast(date as timestamp) + interval 3 hour <= wm""")
def str01(spark, sf):
    out = _folder(spark)
    s = ST_W.event_stream(spark, sf).select(F.col("user_id").alias("station_id"), "event_id", ST_W.event_time("ts").alias("ts"), F.col("value").alias("rate"))
    ST_W.run_to_files(ST_W.reporting_windows(s, ["station_id"], 2, granule="event_id"), f"{out}/data", f"{out}/checkpoint")
    return report(spark.read.parquet(f"{out}/data"))


@query("str02_running_scores", f"""
with p as (select event_type as product, value as pred, cast(json_extract_string(props,'$.k') as double) as obs from events)
select product, count(*) as n, {q6("corr(pred,obs)","corr")}, {q6("avg(pred-obs)","bias")}, {q6("avg(abs(pred-obs))","mae")}, {q6("sqrt(avg(pow(pred-obs,2)))","rmse")} from p group by 1""")
def str02(spark, sf):
    out = _folder(spark)
    s = ST_W.event_stream(spark, sf).select(F.col("event_type").alias("product"), F.col("value").alias("pred"), F.get_json_object("props", "$.k").cast("double").alias("obs"))
    ST_W.run_updates(ST_W.running_scores(s, ["product"]), f"{out}/data", f"{out}/checkpoint")
    return report(ST_W.latest_scores(spark, f"{out}/data", ["product"]))


@query("str03_stream_packing", "select cast(year(ts) as int) as year, event_type, count(*) as n, count(distinct cast(ts as date)) as days from events group by 1,2")
def str03(spark, sf):
    out = _folder(spark)
    ST_W.pack_stream(ST_W.event_stream(spark, sf), out, f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data").groupBy("year", "event_type").agg(F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days"))
