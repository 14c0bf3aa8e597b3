"""Queries over deterministic and spatial verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainloom.functions import ensemble as EN, scalar as S
from rainloom.functions.lattice import VIEW_LATTICE as G
from rainloom.operators import ensembles as E, grid as GR, joins as J, stats as ST, verify as X
from rainloom.plans import views as V
from rainloom.plans.grids import AREA, BLK, CORNERS, W3, W4, area
from rainloom.plans.registry import query
from rainloom.plans.scalars import hav, q6
from rainloom.plans.stats import PAIR_SQL, report
from rainloom.plans.temporal import SEASON_SQL
from rainloom.plans.views import sql, table

R = S.rounded


def field(spark, sf):
    """Grid view as a forecast (ref) against a truth (value)."""
    return V.grid(spark, sf).select("day", "iy", "ix", F.col("ref").alias("pred"), F.col("value").alias("obs"))


FIELD = "f as (select day, iy, ix, ref as pred, value as obs from fx_grid)"


def corr_sql(a, b):
    return f"case when stddev_pop({a})>0 and stddev_pop({b})>0 then corr({a},{b}) end"


def cat_sql(t):
    h, f, m = (f"count(*) filter (where pred>={t} and obs>={t})", f"count(*) filter (where pred>={t} and obs<{t})", f"count(*) filter (where pred<{t} and obs>={t})")
    r = f"(({h}+{m})*({h}+{f})*1e0/count(*))"
    return f"""{q6(f"{h}/nullif({h}+{m},0)", f"t{t}_pod")}, {q6(f"{f}/nullif({h}+{f},0)", f"t{t}_far")}, {q6(f"{h}/nullif({h}+{f}+{m},0)", f"t{t}_csi")},
 {q6(f"({h}-{r})/nullif({h}+{f}+{m}-{r},0)", f"t{t}_ets")}, {q6(f"({h}+{f})/nullif({h}+{m},0)", f"t{t}_freq_bias")}"""


BASIC = f"""count(*) as n, {q6("sqrt(avg(pow(pred-obs,2)))","rmse")}, {q6("avg(abs(pred-obs))","mae")}, {q6("avg(pred-obs)","bias")}"""


@query("ver01_summary", sql("fx_multipair", f"select product, {BASIC}, {cat_sql(1)}, {cat_sql(10)}, {cat_sql(50)}, {cat_sql(100)} from fx_multipair group by 1"))
def ver01(spark, sf):
    return report(X.summarize(V.multipair(spark, sf), [1, 10, 50, 100], ["product"]))


PAIRED = f"""{BASIC}, {q6("avg(pow(pred-obs,2))","mse")}, {q6("avg(obs)","gauge_mean")}, {q6("avg(pred)","product_mean")}, {q6(corr_sql("pred","obs"),"correlation")}, {q6("avg(case when pred>=1 then 1e0 else 0e0 end)","wet_product")},
 {q6("avg(case when obs>=1 then 1e0 else 0e0 end)","wet_gauge")}, {q6("avg(case when obs>=1 then abs(pred-obs) end)","wet_mae")}, {q6("stddev_pop(pred)/stddev_pop(obs)","sd_ratio")}, {q6("median(pred-obs)","median_bias")}"""


@query("ver02_paired_scores", sql("fx_multipair", f"select product, {PAIRED} from fx_multipair group by 1 having count(*)>=2"))
def ver02(spark, sf):
    return report(X.paired_scores(V.multipair(spark, sf), ["product"]))


PATTERN = f"{FIELD}, p as (select day, count(*) as cells, case when count(*)>=10 then {corr_sql('pred','obs')} end as c from f group by 1)"


@query("ver03_pattern_correlation", sql("fx_grid", f"with {PATTERN} select day, cells, {q6('c','corr')} from p"))
def ver03(spark, sf):
    return report(X.pattern_correlation(field(spark, sf), min_cells=10))


@query("ver03_mean_pattern_correlation", sql("fx_grid", f"with {PATTERN} select {q6('avg(c)','corr')}, count(c) as days from p"))
def ver03b(spark, sf):
    return report(X.pattern_correlation(field(spark, sf), min_cells=10).agg(F.avg("corr").alias("corr"), F.count("corr").alias("days")))


@query("ver04_field_metrics", sql("fx_grid", f"""with {FIELD} select day, {BASIC}, {q6(corr_sql("pred","obs"),"correlation")}, {q6("stddev_pop(pred-obs)","centred_rmse")}, {q6("stddev_pop(pred)/nullif(stddev_pop(obs),0)","sd_ratio")},
 {q6("var_pop(pred)/nullif(var_pop(obs),0)","variance_ratio")} from f group by 1"""))
def ver04(spark, sf):
    return report(X.field_metrics(field(spark, sf), ["day"]))


@query("ver05_base_comparison", sql("fx_multipair", f"""
select product, {BASIC}, {q6(corr_sql("pred","obs"),"correlation")}, {q6("corr(ln(1+pred/0.1e0),ln(1+obs/0.1e0))","transformed_correlation")}, {q6("stddev_pop(pred)","candidate_std")}, {q6("stddev_pop(obs)","target_std")},
 {q6("pow(greatest(corr(pred,obs),0),2)","variance_explained")}, {q6("stddev_pop(pred)/stddev_pop(obs)","std_ratio")} from fx_multipair group by 1"""))
def ver05(spark, sf):
    return report(X.base_comparison(V.multipair(spark, sf), "product"))


@query("ver05_coarse_comparison", sql("fx_grid", f"""with {FIELD}, b as (select day, {BLK}, avg(pred) as pred, avg(obs) as obs from f group by 1,2,3 having count(*)>=8)
select {BASIC}, {q6(corr_sql("pred","obs"),"correlation")}, {q6("(select var_pop(obs) from f)-var_pop(obs)","variance_gap")} from b"""))
def ver05b(spark, sf):
    b = GR.block_mean(field(spark, sf), 4, ("pred", "obs"), min_fraction=0.5).where("pred is not null")
    fine = field(spark, sf).agg(F.var_pop("obs")).scalar()
    return report(b.agg(*X.basic(), ST.safe_corr("pred", "obs").alias("correlation"), (fine - F.var_pop("obs")).alias("variance_gap")))


@query("ver06_contingency", sql("fx_multipair", f"""
with g as (select product, cast(t as double) as threshold, count(*) as n, count(*) filter (where pred>=t and obs>=t) as h, count(*) filter (where pred<t and obs>=t) as m, count(*) filter (where pred>=t and obs<t) as f from fx_multipair, (select unnest([5,20,80]) as t) group by 1,2),
r as (select *, (h+m)*(h+f)*1e0/n as l from g)
select product, threshold, n, h as hits, m as misses, f as false_alarms, {q6("h/nullif(h+m,0)","pod")}, {q6("f/nullif(h+f,0)","far")}, {q6("h/nullif(h+m+f,0)","csi")}, {q6("(h-l)/nullif(h+m+f-l,0)","ets")}, {q6("(h+f)/nullif(h+m,0)","freq_bias")} from r"""))
def ver06(spark, sf):
    return report(X.contingency(V.multipair(spark, sf), [5, 20, 80], ["product"]))


ANOM = f"""count(*) as n, {q6(corr_sql("pred","obs"),"correlation")}, {q6("sqrt(avg(pow(pred-obs,2)))","rmse")}, {q6("1-avg(pow(pred-obs,2))/nullif(avg(obs*obs),0)","mse_skill")}, {q6("avg(pred-obs)","bias")},
 {q6("var_pop(pred)/nullif(var_pop(obs),0)","variance_ratio")}, {q6("avg(case when abs(obs)>=1 then case when sign(pred)=sign(obs) then 1e0 else 0e0 end end)","sign_agreement")}"""


@query("ver07_anomaly_metrics", sql("fx_grid", f"""with r as (select year(day) as year, round(ref-avg(ref) {W3}, 9) as pred, round(value-avg(value) {W3}, 9) as obs from fx_grid) select cast(year as int) as year, {ANOM} from r group by 1"""))
def ver07(spark, sf):
    d = GR.scale_decompose(V.grid(spark, sf), 3).withColumnRenamed("residual", "obs").drop("coarse")
    d = GR.scale_decompose(d, 3, "ref").withColumnRenamed("residual", "pred")
    return report(X.anomaly_metrics(d.withColumn("year", F.year("day")), ["year"]))


@query("ver08_skill_against_null", sql("fx_methods", f"""
with s as (select method, station_id, avg(pow(list_avg(members)-truth,2)) as mse, avg(list_avg([abs(x-truth) for x in members]) - list_sum([x*(2*i-17) for x, i in list_sort(members)])/240) as crps from fx_methods group by 1,2)
select a.method, a.station_id, {q6("1-a.mse/b.mse","mse_skill")}, {q6("1-a.crps/b.crps","crps_skill")} from s a join s b on a.station_id=b.station_id and b.method='background' where a.method<>'background'"""))
def ver08(spark, sf):
    s = E.samples(V.methods(spark, sf)).groupBy("method", "station_id").agg(F.avg(F.col("_err") * F.col("_err")).alias("mse"), F.avg("_crps").alias("crps"))
    k = X.skill_against(s.where("method <> 'background'"), s.where("method = 'background'"), ["station_id"])
    return report(k.drop("mse", "crps"))


def fss_sql(ok_rule: bool, pad: int = 0, windows=(1, 3, 5), thresholds=(20, 30)):
    """Dense lattice, 0/1 fields and sliding sums in SQL; pad repeats the border."""
    cond = "ok and " if ok_rule else ""
    frame = lambda h: f"rows between {h} preceding and {h} following"
    xs = ", ".join(f"sum(pb) over (partition by day,t,iy order by ix {frame(w // 2)}) as px{w}, sum(ob) over (partition by day,t,iy order by ix {frame(w // 2)}) as ox{w}" for w in windows)
    ys = ", ".join(f"sum(px{w}) over (partition by day,t,ix order by iy {frame(w // 2)})/{w * w}e0 as p{w}, sum(ox{w}) over (partition by day,t,ix order by iy {frame(w // 2)})/{w * w}e0 as o{w}" for w in windows)
    inside = f"iy between 0 and 15 and ix between 0 and 15" + (" and ok" if ok_rule else "")
    parts = " union all ".join(f"select day, t, {w} as w, avg(pow(p{w}-o{w},2)) as num, avg(p{w}*p{w})+avg(o{w}*o{w}) as den from fz where {inside} group by 1,2" for w in windows)
    return _fss_tail(cond, pad, thresholds, xs, ys, parts)


def _fss_tail(cond, pad, thresholds, xs, ys, parts):
    rng = f"range({-pad},{16 + pad})"
    return f"""dd as (select d.day, y as iy, x as ix, cast(t as double) as t, g.ref as p, g.value as o from (select distinct day from fx_grid) d cross join (select unnest({rng}) as y) cross join (select unnest({rng}) as x) cross join (select unnest([{','.join(map(str, thresholds))}]) as t)
 left join fx_grid g on g.day=d.day and g.iy=least(greatest(y,0),15) and g.ix=least(greatest(x,0),15)),
db as (select day, iy, ix, t, (p is not null and o is not null) as ok, p, o from dd),
dc as (select day, iy, ix, t, ok, case when {cond}p>=t then 1 else 0 end as pb, case when {cond}o>=t then 1 else 0 end as ob from db),
fx_ as (select *, {xs} from dc), fz as (select *, {ys} from fx_),
fd as ({parts}),
fc as (select day, t, count(*) filter (where ok) as n_ok, sum(pb) as np, sum(ob) as no from dc where iy between 0 and 15 and ix between 0 and 15 group by 1,2)"""


def _fss(spark, sf, **kw):
    return X.fss_days(field(spark, sf), [20, 30], [1, 3, 5], 16, 16, **kw)


@query("ver09_fss_zero_padded", sql("fx_grid", f"with {fss_sql(False)} select day, t as threshold, cast(w as int) as window_cells, {q6('case when den>0 then 1-num/den end','fss')} from fd"))
def ver09(spark, sf):
    return report(X.fss_single(_fss(spark, sf)).withColumnRenamed("window", "window_cells"))


@query("ver09_fss_pooled", sql("fx_grid", f"with {fss_sql(False)} select t as threshold, cast(w as int) as window_cells, {q6('1-sum(num)/nullif(sum(den),0)','fss')} from fd group by 1,2"))
def ver09b(spark, sf):
    return report(X.fss_pooled(_fss(spark, sf)).withColumnRenamed("window", "window_cells"))


FSST = f"{fss_sql(True)}, ft as (select fd.t, w, avg(case when den>0 then 1-num/den end) as s, avg(no*1e0/n_ok) as f0, count(case when den>0 then 1 end) as d from fd join fc on fc.day=fd.day and fc.t=fd.t where n_ok>=16 and (np>0 or no>0) group by 1,2)"


@query("ver09_fss_table", sql("fx_grid", f"with {FSST} select t as threshold, cast(w as int) as window_cells, {q6('s','fss')}, {q6('f0','base_rate')}, d as days, {q6('0.5e0+f0/2','target')} from ft"))
def ver09c(spark, sf):
    return report(X.fss_table(_fss(spark, sf, cells="paired")).withColumnRenamed("window", "window_cells"))


@query("ver09_fss_replicated_edge", sql("fx_grid", f"with {fss_sql(False, 2).replace('ix between 0 and 15 group', 'ix between 0 and 15 and ok group', 3)} select day, t as threshold, cast(w as int) as window_cells, {q6('case when den>0 then 1-num/den end','fss')} from fd"))
def ver09d(spark, sf):
    g = field(spark, sf)
    d = X.fss_days(g, [20, 30], [1, 3, 5], 16, 16, edge="replicate", cells="land")
    return report(X.fss_single(d).withColumnRenamed("window", "window_cells"))


@query("ver10_skillful_scale", sql("fx_grid", f"with {FSST} select t as threshold, cast(min(case when s>=0.5e0+f0/2 then w end) as int) as skillful_window from ft group by 1"))
def ver10(spark, sf):
    return X.skillful_scale(X.fss_table(_fss(spark, sf, cells="paired")))


LADDER = f"""e as (select f.*, fa as factor from (select day, iy, ix, ref as pred, value as obs from fx_grid) f, (select unnest([1,3,5,7]) as fa)),
c as (select *, avg(pred) over (partition by day, factor, floor(iy/factor), floor(ix/factor)) as pc, avg(obs) over (partition by day, factor, floor(iy/factor), floor(ix/factor)) as oc from e),
r as (select *, pred-pc as pr, obs-oc as orr from c)"""


def ladder_cols(p, o, n):
    return f"""{q6(f"sqrt(avg(pow({p}-{o},2)))", f"{n}_rmse")}, {q6(f"avg({p}-{o})", f"{n}_bias")}, {q6(f"avg({p}*{p})/nullif(avg({o}*{o}),0)", f"{n}_energy_ratio")}, {q6(f"1-avg(pow({p}-{o},2))/nullif(avg({o}*{o}),0)", f"{n}_skill")}"""


@query("ver26_scale_ladder", sql("fx_grid", f"with {LADDER} select cast(factor as int) as factor, count(*) as n, {ladder_cols('pc','oc','block')}, {ladder_cols('pr','orr','residual')} from r group by 1"))
def ver26(spark, sf):
    return report(X.scale_ladder(field(spark, sf), [1, 3, 5, 7]))


@query("ver27_downscaling_claims", sql("fx_grid", f"""
with m as (select day, iy, ix, value as obs, ref as coarse, 0.5e0*(ref+value) as an, case when value<20 then 'light' when value<30 then 'moderate' else 'heavy' end as intensity, count(value) {W3} as nb from fx_grid),
k as (select *, avg(obs) {W3} as oc, avg(an) {W3} as ac from m where nb>=9),
s as (select *, obs-oc as os, an-ac as as_ from k),
l as (select 'all' as stratum, * from s union all select intensity, * from s union all select cast(year(day) as varchar), * from s)
select stratum, count(*) as n, {q6("1-avg(pow(an-obs,2))/nullif(avg(pow(coarse-obs,2)),0)","claim_a_skill")}, {q6("1-avg(pow(as_-os,2))/nullif(avg(os*os),0)","claim_b_skill")}, {q6("sqrt(avg(pow(ac-oc,2)))","footprint_rmse")} from l group by 1 having count(*)>=64"""))
def ver27(spark, sf):
    g = V.grid(spark, sf).withColumn("an", (F.col("ref") + F.col("value")) * 0.5)
    k = GR.eligible(g, 3, 1.0).where("eligible")
    k = GR.scale_decompose(GR.scale_decompose(k, 3).withColumnRenamed("residual", "os").withColumnRenamed("coarse", "oc"), 3, "an").withColumnRenamed("residual", "as").withColumnRenamed("coarse", "ac")
    v = F.col("value")
    strata = F.array(F.lit("all"), F.when(v < 20, "light").when(v < 30, "moderate").otherwise("heavy"), F.year("day").cast("string"))
    d = k.withColumn("stratum", F.explode(strata))

    def mse(a, b):
        return F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
    out = d.groupBy("stratum").agg(F.count("*").alias("n"), (1 - S.ratio(mse("an", "value"), mse("ref", "value"))).alias("claim_a_skill"),
                                   (1 - S.ratio(mse("as", "os"), F.avg(F.col("os") * F.col("os")))).alias("claim_b_skill"), F.sqrt(mse("ac", "oc")).alias("footprint_rmse"))
    return report(out.where("n >= 64"))


@query("ver28_daily_residual_skill", sql("fx_grid", f"""
with m as (select *, count(*) {W3} as nb from fx_grid), s as (select day, ref-avg(ref) {W3} as r, value-avg(value) {W3} as o from m where nb=9)
select day, {q6("1-avg(pow(r-o,2))/nullif(avg(o*o),0)","skill")}, count(*) as n from s group by 1"""))
def ver28(spark, sf):
    return report(X.daily_residual_skill(field(spark, sf), 3))


SEMI = """l as (select unnest([1,2,4,8]) as lag),
v as (select a.day, lag, 'y' as dir, 0.5e0*avg(pow(a.value-b.value,2)) as g from fx_grid a, l, fx_grid b where b.day=a.day and b.ix=a.ix and b.iy=a.iy-lag group by 1,2
 union all select a.day, lag, 'x', 0.5e0*avg(pow(a.value-b.value,2)) from fx_grid a, l, fx_grid b where b.day=a.day and b.iy=a.iy and b.ix=a.ix-lag group by 1,2)"""


@query("ver29_semivariance", sql("fx_grid", f"with {SEMI} select cast(lag as int) as lag, {q6('avg(g)','semivariance')}, count(g) as terms from v group by 1"))
def ver29(spark, sf):
    return report(X.semivariance(V.grid(spark, sf)))


@query("ver30_field_energy", sql("fx_grid", f"""with {SEMI}, a as (select value-avg(value) over (partition by day) as a from fx_grid)
select (select {q6("avg(2*g)","x").rsplit(" as ",1)[0]} from v where lag=1) as gradient_energy, {q6("avg(value*value)","energy")}, (select {q6("avg(a*a)","x").rsplit(" as ",1)[0]} from a) as anomaly_energy from fx_grid"""))
def ver30(spark, sf):
    return report(X.field_energy(V.grid(spark, sf)))


@query("ver31_seam_index", sql("fx_grid", f"""
with d as (select abs(a.value-b.value) as g, a.iy%4=0 as seam from fx_grid a join fx_grid b on b.day=a.day and b.ix=a.ix and b.iy=a.iy-1 union all select abs(a.value-b.value), a.ix%4=0 from fx_grid a join fx_grid b on b.day=a.day and b.iy=a.iy and b.ix=a.ix-1)
select {q6("avg(case when seam then g end)","edge")}, {q6("avg(case when not seam then g end)","interior")}, {q6("avg(case when seam then g end)/avg(case when not seam then g end)","seam_index")} from d"""))
def ver31(spark, sf):
    return report(X.seam_index(V.grid(spark, sf), 4))


def spec_sql(col):
    """Direct separable DFT of one column of the grid view."""
    return f"""(with mu as (select day, avg({col}) as m from fx_grid group by 1 having count(*)>=16),
wk as (select g.day, iy, ix, ({col}-m)*(0.5e0-0.5e0*cos(2*pi()*iy/15))*(0.5e0-0.5e0*cos(2*pi()*ix/15)) as v from fx_grid g join mu on mu.day=g.day),
rw as (select day, iy, k as kx, sum(v*cos(2*pi()*k*ix/16)) as re, sum(-v*sin(2*pi()*k*ix/16)) as im from wk, (select unnest(range(16)) as k) group by 1,2,3),
cl as (select day, kx, k as ky, sum(re*cos(2*pi()*k*iy/16)+im*sin(2*pi()*k*iy/16)) as re, sum(im*cos(2*pi()*k*iy/16)-re*sin(2*pi()*k*iy/16)) as im from rw, (select unnest(range(16)) as k) group by 1,2,3),
pw as (select day, cast(floor((sqrt(pow((case when kx<8 then kx else kx-16 end)/16e0,2)+pow((case when ky<8 then ky else ky-16 end)/16e0,2))-0.0625e0)/0.0546875e0) as int) as bin, re*re+im*im as p from cl)
select day, bin, avg(p) as power, 55.5e0/(0.0625e0+(bin+0.5e0)*0.0546875e0) as wl from pw where bin between 0 and 7 group by 1,2 having avg(p)>0)"""


@query("ver32_power_spectrum", sql("fx_grid", f"select day, bin, floor(power*1e3+0.5e0)/1e3 as power, {q6('wl','wavelength_km')} from {spec_sql('value')}"))
def ver32(spark, sf):
    p = X.power_spectrum(V.grid(spark, sf), 16, 16, res_deg=0.5)
    return p.select("day", "bin", R("power", 3).alias("power"), R("wavelength_km").alias("wavelength_km"))


def _spectra(spark, sf):
    long = V.grid(spark, sf).select("day", "iy", "ix", F.col("value").alias("truth"), "ref", ((F.col("ref") + F.col("value")) * 0.5).alias("blend"))
    long = long.unpivot(["day", "iy", "ix"], ["truth", "ref", "blend"], "name", "value")
    return X.spectral_summary(X.power_spectrum(long, 16, 16, keys=("name", "day"), res_deg=0.5))


SPEC = f"""s as (select 'truth' as name, * from {spec_sql('value')} union all select 'ref', * from {spec_sql('ref')} union all select 'blend', * from {spec_sql('(0.5e0*(ref+value))')}),
m as (select name, bin, wl, avg(power) as p from s group by 1,2,3), r as (select a.name, a.bin, a.wl, a.p, a.p/t.p as ratio from m a join m t on t.name='truth' and t.bin=a.bin where a.name<>'truth')"""


@query("ver33_spectral_summary", sql("fx_grid", f"with {SPEC} select name, bin, {q6('wl','wavelength_km')}, {q6('ratio','power_ratio')} from r"))
def ver33(spark, sf):
    return report(_spectra(spark, sf).select("name", "bin", "wavelength_km", "power_ratio"))


@query("ver33_effective_resolution", sql("fx_grid", f"""with {SPEC}, p as (select *, coalesce(lag(wl) over (partition by name order by wl desc), wl) as prev, not (ratio between 0.5e0 and 2e0) as o from r)
select name, {q6("coalesce(max_by(prev, wl) filter (where o), min(wl))","effective_resolution_km")} from p group by 1"""))
def ver33b(spark, sf):
    return report(X.effective_resolution(_spectra(spark, sf)))


@query("ver34_subgrid_report", sql("fx_grid", f"""
with l as (select 'ref' as candidate, day, iy, ix, ref as pred, value as obs from fx_grid union all select 'blend', day, iy, ix, 0.5e0*(ref+value), value from fx_grid),
r as (select candidate, pred, pred-avg(pred) over (partition by candidate, day, floor(iy/3), floor(ix/3)) as r, obs-avg(obs) over (partition by candidate, day, floor(iy/3), floor(ix/3)) as o from l)
select candidate, count(*) as n, {q6("avg(r*r)/avg(o*o)","residual_variance_ratio")}, {q6("corr(r,o)","residual_corr")}, {q6("avg(r*r)/var_pop(pred)","subgrid_fraction")}, {q6("sqrt(avg(pow(r-o,2)))","increment_rms")}, {q6("pow(corr(r,o),2)","coherent_fraction")} from r group by 1"""))
def ver34(spark, sf):
    g = V.grid(spark, sf).select("day", "iy", "ix", F.col("value").alias("obs"), "ref", ((F.col("ref") + F.col("value")) * 0.5).alias("blend"))
    return report(X.subgrid_report(g.unpivot(["day", "iy", "ix", "obs"], ["ref", "blend"], "candidate", "pred"), 3, "candidate"))


@query("ver35_product_comparison", sql("fx_multipair", f"""
with c as (select * from fx_multipair where (station_id, date) in (select (station_id, date) from fx_multipair group by station_id, date having count(distinct product)=2)),
st as (select product, station_id, count(*) as n, {corr_sql("pred","obs")} as c, avg(pred) as mp, avg(obs) as mo from c group by 1,2),
d as (select product, count(*) as n, avg(pred-obs) as b, sqrt(avg(pow(pred-obs,2))) as r, corr(pred,obs) as c from c group by 1),
f as (select product, tanh(sum(case when c is not null then atanh(least(greatest(c,-0.999999e0),0.999999e0)) end*greatest(n-3,1))/sum(case when c is not null then greatest(n-3,1) end)) as z, corr(mp,mo) as lc, avg(mp-mo) as lb, count(*) as stations from st group by 1)
select d.product, n, stations, {q6("b","daily_bias")}, {q6("r","daily_rmse")}, {q6("c","daily_corr")}, {q6("z","station_corr")}, {q6("lc","longterm_corr")}, {q6("lb","longterm_bias")} from d join f on f.product=d.product"""))
def ver35(spark, sf):
    c = J.common_sample(V.multipair(spark, sf, steady=True), ["station_id", "date"], "product", "pred", 2)
    d = F.col("pred") - F.col("obs")
    daily = c.groupBy("product").agg(F.count("*").alias("n"), F.avg(d).alias("daily_bias"), F.sqrt(F.avg(d * d)).alias("daily_rmse"), ST.safe_corr("pred", "obs").alias("daily_corr"))
    st = c.groupBy("product", "station_id").agg(F.count("*").alias("n"), ST.safe_corr("pred", "obs").alias("c"), F.avg("pred").alias("mp"), F.avg("obs").alias("mo"))
    lt = st.groupBy("product").agg(F.count("*").alias("stations"), ST.fisher_pooled("c", "n").alias("station_corr"), ST.safe_corr("mp", "mo").alias("longterm_corr"), F.avg(F.col("mp") - F.col("mo")).alias("longterm_bias"))
    return report(daily.join(lt, "product"))


@query("ver36_scale_matrix", sql("fx_multipair", f"""
with l as (select 'daily' as scale, product, station_id, date as period, pred, obs from fx_multipair union all select 'pentad', product, station_id, cast(date '2024-01-01' + cast(floor((date-date '2024-01-01')/5)*5 as int) as date), avg(pred), avg(obs) from fx_multipair group by 2,3,4
 union all select 'monthly', product, station_id, cast(date_trunc('month',date) as date), avg(pred), avg(obs) from fx_multipair group by 2,3,4)
select scale, product, {PAIR_SQL} from l group by 1,2"""))
def ver36(spark, sf):
    m = V.multipair(spark, sf)
    first = F.lit("2024-01-01").cast("date")
    p = F.array(F.struct(F.lit("daily").alias("scale"), F.col("date").alias("period")),
                F.struct(F.lit("pentad").alias("scale"), F.date_add(first, (F.floor(F.datediff("date", first) / 5) * 5).cast("int")).alias("period")),
                F.struct(F.lit("monthly").alias("scale"), F.trunc("date", "month").alias("period")))
    d = m.select("product", "station_id", "pred", "obs", F.explode(p).alias("p")).groupBy("p.scale", "product", "station_id", "p.period").agg(F.avg("pred").alias("pred"), F.avg("obs").alias("obs"))
    return report(d.groupBy("scale", "product").agg(F.count("*").alias("n"), ST.safe_corr("pred", "obs").alias("corr"), F.avg(F.col("pred") - F.col("obs")).alias("bias"),
                                                    F.avg(F.abs(F.col("pred") - F.col("obs"))).alias("mae"), F.sqrt(F.avg((F.col("pred") - F.col("obs")) * (F.col("pred") - F.col("obs")))).alias("rmse")))


@query("ver37_stratified_scores", sql("fx_multipair", f"""
with l as (select product, 'bin '||case when obs<1 then 0 when obs<10 then 1 when obs<50 then 2 else 3 end as stratum, pred, obs from fx_multipair union all select product, 'station '||station_id, pred, obs from fx_multipair)
select product, stratum, {BASIC} from l group by 1,2"""))
def ver37(spark, sf):
    o = F.col("obs")
    b = F.when(o < 1, "0").when(o < 10, "1").when(o < 50, "2").otherwise("3")
    d = V.multipair(spark, sf).withColumn("stratum", F.explode(F.array(F.concat(F.lit("bin "), b), F.concat(F.lit("station "), F.col("station_id").cast("string")))))
    return report(d.groupBy("product", "stratum").agg(*X.basic()))


VARIANTS = """va as (select day, ref as v, iy, ix, unnest([{n:'identity',y:iy,x:ix},{n:'lat_flip',y:15-iy,x:ix},{n:'lon_flip',y:iy,x:15-ix},{n:'lat_lon_flip',y:15-iy,x:15-ix},{n:'transpose',y:ix,x:iy},
 {n:'lat_shift+1',y:iy+1,x:ix},{n:'lat_shift-1',y:iy-1,x:ix},{n:'lon_shift+1',y:iy,x:ix+1},{n:'lon_shift-1',y:iy,x:ix-1},{n:'lat_shift+2',y:iy+2,x:ix},{n:'lat_shift-2',y:iy-2,x:ix},{n:'lon_shift+2',y:iy,x:ix+2},{n:'lon_shift-2',y:iy,x:ix-2}]) as k from fx_grid),
vj as (select k.n as variant, va.day, v, g.value as r from va join fx_grid g on g.day=va.day and g.iy=k.y and g.ix=k.x),
vd as (select variant, day, case when count(*)>=3 then """ + corr_sql("v", "r") + """ end as c from vj group by 1,2)"""


@query("ver38_misregistration", sql("fx_grid", f"with {VARIANTS} select variant, {q6('avg(c)','corr')}, count(c) as days from vd group by 1"))
def ver38(spark, sf):
    g = V.grid(spark, sf)
    return report(X.misregistration(g, V.grid(spark, sf), 16, 16, "ref", "value"))


LAGGED = """lj as (select l as lag, a.day, a.ref as v, b.value as r from fx_grid a, (select unnest([-1,0,1]) as l), fx_grid b where b.iy=a.iy and b.ix=a.ix and b.day=cast(a.day - to_months(cast(l as int)) as date)),
la as (select lag, v-avg(v) over (partition by lag, day) as v, r-avg(r) over (partition by lag, day) as r, count(*) over (partition by lag, day) as n from lj)"""


@query("ver38_lagged_pattern", sql("fx_grid", f"with {LAGGED} select cast(lag as int) as lag, count(*) as n, {q6('sum(v*r)/sqrt(sum(v*v)*sum(r*r))','corr')} from la where n>=3 group by 1"))
def ver38b(spark, sf):
    return report(X.lagged_pattern(V.grid(spark, sf), V.grid(spark, sf), [-1, 0, 1], "ref", "value", lambda d, lag: F.add_months(d, -lag)))


@query("ver38_alignment_diagnosis", sql("fx_grid", f"""with {VARIANTS}, {LAGGED}, sp as (select variant, avg(c) as c from vd group by 1), tm as (select lag, sum(v*r)/sqrt(sum(v*v)*sum(r*r)) as c from la where n>=3 group by 1),
b as (select max_by(variant,c) as bv, max(c)-max(case when variant='identity' then c end) as sg from sp), t as (select max_by(lag,c) as bl, max(c)-max(case when lag=0 then c end) as tg from tm)
select bv as best_variant, case when bl<>0 and tg>=0.05e0 and bv<>'identity' and sg>=0.05e0 then 'mixed_timing_and_spatial_signal' when bl<>0 and tg>=0.05e0 then 'possible_timing_signal' when bv<>'identity' and sg>=0.05e0 then 'possible_spatial_displacement' else 'no_clear_fixed_lag_or_shift' end as diagnosis from b, t"""))
def ver38c(spark, sf):
    sp = X.misregistration(V.grid(spark, sf), V.grid(spark, sf), 16, 16, "ref", "value")
    tm = X.lagged_pattern(V.grid(spark, sf), V.grid(spark, sf), [-1, 0, 1], "ref", "value", lambda d, lag: F.add_months(d, -lag))
    return X.alignment_label(tm, sp)


@query("ver39_idw_baseline", sql("fx_station fx_obs", f"""
with k as (select cos(radians(avg(lat))) as c from fx_station),
p as (select w.station_id as e, s.station_id as s, pow(greatest(sqrt(pow((s.lon-w.lon)*k.c,2)+pow(s.lat-w.lat,2)),1e-6),-2) as w from fx_station w, fx_station s, k where w.station_id%5=0 and s.station_id%5<>0)
select e as station_id, date, {q6("sum(precip_mm*w)/sum(w)","idw")}, count(*) as n_gauges from p join fx_obs o on o.station_id=p.s group by 1,2"""))
def ver39(spark, sf):
    o = V.obs(spark, sf)
    return report(X.idw(o.where("station_id % 5 <> 0"), V.station(spark, sf).where("station_id % 5 = 0"), V.station(spark, sf), "precip_mm"))


@query("ver40_single_day_comparison", sql("fx_grid fx_station", f"""
with g as (select day, iy, ix, value as t, ref as bg, 0.5e0*(ref+value) as an, value-avg(value) {W3} as tr, ref-avg(ref) {W3} as br, 0.5e0*(ref+value)-avg(0.5e0*(ref+value)) {W3} as ar from fx_grid),
c as (select distinct cast(floor((lat-20.25e0)/0.5e0+0.5e0) as int) as y, cast(floor((lon-86.25e0)/0.5e0+0.5e0) as int) as x from fx_station),
n as (select distinct y+a as iy, x+b as ix from c, (select unnest(range(-1,2)) as a), (select unnest(range(-1,2)) as b)), f as (select distinct y+a as iy, x+b as ix from c, (select unnest(range(-5,6)) as a), (select unnest(range(-5,6)) as b)),
z as (select g.*, n.iy is not null as near, f.iy is null as far from g left join n on n.iy=g.iy and n.ix=g.ix left join f on f.iy=g.iy and f.ix=g.ix)
select day, {q6("sqrt(avg(pow(an-t,2)))","field_rmse")}, {q6("sqrt(avg(pow(bg-t,2)))","background_rmse")}, {q6(corr_sql("an","t"),"field_corr")}, {q6(corr_sql("bg","t"),"background_corr")}, {q6(corr_sql("ar","tr"),"subgrid_corr")}, {q6(corr_sql("br","tr"),"background_subgrid_corr")},
 {q6("100*(sqrt(avg(pow(bg-t,2)))-sqrt(avg(pow(an-t,2))))/sqrt(avg(pow(bg-t,2)))","rmse_gain_percent")}, {q6("avg(case when near then abs(an-bg) end)/avg(case when far then abs(an-bg) end)","bullseye")} from z group by 1"""))
def ver40(spark, sf):
    g = V.grid(spark, sf).withColumn("an", (F.col("ref") + F.col("value")) * 0.5)
    return report(X.single_day_comparison(g, V.station(spark, sf), G, 3, truth="value", background="ref", analysis="an"))


@query("ver41_coarse_product_correlation", sql("fx_grid", f"""with b as (select day, {BLK}, sum(ref*{AREA})/sum({AREA}) as p, sum(value*{AREA})/sum({AREA}) as o from fx_grid group by 1,2,3),
d as (select day, case when count(*)>=3 then {corr_sql("p","o")} end as c from b group by 1) select {q6("avg(c)","corr")}, count(c) as days from d"""))
def ver41(spark, sf):
    p = GR.area_block_mean(V.grid(spark, sf), 4, area(), 0.0, "ref").select("day", "by", "bx", F.col("ref").alias("pred"))
    o = GR.area_block_mean(V.grid(spark, sf), 4, area(), 0.0).select("day", "by", "bx", F.col("value").alias("obs"))
    c = X.pattern_correlation(p.join(o, ["day", "by", "bx"]))
    return report(c.agg(F.avg("corr").alias("corr"), F.count("corr").alias("days")))


SAL = """l as (select day, iy, ix, 'pred' as s, greatest(ref-38,0) as v from fx_grid union all select day, iy, ix, 'obs', greatest(value-25,0) from fx_grid),
w as (select day, s, avg(v) as mean, sum(v*iy)/nullif(sum(v),0) as cy, sum(v*ix)/nullif(sum(v),0) as cx, quantile_cont(case when v>0 then v end,0.95)/15 as thr from l group by 1,2),
c as (select l.*, iy*100+ix as id from l join w using(day,s) where v>=thr and v>0),
r as (select day, s, iy, ix, id, id as lab from c union select n.day, n.s, n.iy, n.ix, n.id, r.lab from r join c n on n.day=r.day and n.s=r.s and abs(n.iy-r.iy)<=1 and abs(n.ix-r.ix)<=1 and r.lab<n.id),
m as (select day, s, id, min(lab) as lab from r group by 1,2,3),
o as (select c.day, c.s, lab, sum(v) as m, max(v) as top, sum(v*iy)/sum(v) as oy, sum(v*ix)/sum(v) as ox from c join m on m.day=c.day and m.s=c.s and m.id=c.id group by 1,2,3),
p as (select o.day, o.s, sum(m*m/top)/sum(m) as volume, sum(m*sqrt(pow(oy-cy,2)+pow(ox-cx,2)))/sum(m) as r from o join w on w.day=o.day and w.s=o.s group by 1,2),
a as (select w.day, max(case when w.s='pred' then mean end) as pm, max(case when w.s='obs' then mean end) as om, max(case when w.s='pred' then cy end) as py, max(case when w.s='obs' then cy end) as oy, max(case when w.s='pred' then cx end) as px, max(case when w.s='obs' then cx end) as ox,
 max(case when w.s='pred' then volume end) as pv, max(case when w.s='obs' then volume end) as ov, max(case when w.s='pred' then r end) as pr, max(case when w.s='obs' then r end) as orr from w left join p on p.day=w.day and p.s=w.s group by 1)"""


@query("ver42_structure_amplitude_location", sql("fx_grid", f"with {SAL} select day, {q6('2*(pv-ov)/nullif(pv+ov,0)','structure')}, {q6('2*(pm-om)/nullif(pm+om,0)','amplitude')}, {q6('sqrt(pow(py-oy,2)+pow(px-ox,2))/sqrt(512e0)+2*abs(pr-orr)/sqrt(512e0)','location')} from a").replace("with fx_grid", "with recursive fx_grid", 1))
def ver42(spark, sf):
    return report(X.sal(field(spark, sf).withColumn("pred", F.greatest(F.col("pred") - 38, F.lit(0.0))).withColumn("obs", F.greatest(F.col("obs") - 25, F.lit(0.0))), 16, 16))


@query("ver43_field_verification", sql("fx_rain_ens", f"""with p as (select *, list_avg(members) as m, list_stddev_samp(members) as s from fx_rain_ens)
select day, {q6("sqrt(avg(pow(m-truth,2)))","rmse")}, {q6("avg(m-truth)","bias")}, {q6("avg(case when m>=1 then 1e0 else 0e0 end)-avg(case when truth>=1 then 1e0 else 0e0 end)","wet_share_error")}, {q6("max(m)","max_pred")}, {q6("max(truth)","max_truth")}, {q6("avg(s)","mean_spread")} from p group by 1"""))
def ver43(spark, sf):
    return report(X.field_verification(V.rain_ens(spark, sf), ["day"]))
