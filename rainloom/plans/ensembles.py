"""Queries over ensemble verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainloom.functions import ensemble as EN, scalar as S
from rainloom.operators import ensembles as E
from rainloom.plans import views as V
from rainloom.plans.registry import query
from rainloom.plans.scalars import q6
from rainloom.plans.stats import report
from rainloom.plans.views import sql, table

R = S.rounded

FAIR = "list_avg([abs(x-truth) for x in members]) - list_sum([x*(2*i-len(members)-1) for x, i in list_sort(members)])/(len(members)*(len(members)-1))"
PLAIN = "list_avg([abs(x-truth) for x in members]) - list_sum([x*(2*i-len(members)-1) for x, i in list_sort(members)])/(len(members)*len(members))"


def lq(q, m="members"):
    """Linear quantile of a 16-member list."""
    pos = 15 * q
    lo = int(pos)
    return f"(list_sort({m})[{lo + 1}] + {pos - lo!r}e0*(list_sort({m})[{min(lo + 2, 16)}]-list_sort({m})[{lo + 1}]))"


def per_sample(view):
    return f"""ps as (select *, list_avg(members) as mn, list_var_samp(members) as vr, list_avg(members)-truth as er, {FAIR} as crps,
 case when truth>={lq(0.05)} and truth<={lq(0.95)} then 1e0 else 0e0 end as ins from {view})"""


CORR = "case when stddev_pop(mn)>0 and stddev_pop(truth)>0 then corr(mn,truth) end"


@query("ver11_fair_crps", sql("fx_rain_ens", f"select sample_id, {q6(FAIR,'crps')} from fx_rain_ens"))
def ver11(spark, sf):
    return V.rain_ens(spark, sf).select("sample_id", R(EN.fair_crps("members", "truth")).alias("crps"))


@query("ver11_fair_crps_mean", sql("fx_ens", f"select fold, count(*) as n, {q6(f'avg({FAIR})','fair_crps')} from fx_ens group by 1"))
def ver11b(spark, sf):
    return report(E.crps_scores(V.ens(spark, sf), ["fold"]).drop("plain_crps"))


@query("ver12_plain_crps", sql("fx_rain_ens", f"select fold, count(*) as n, {q6(f'avg({FAIR})','fair_crps')}, {q6(f'avg({PLAIN})','plain_crps')} from fx_rain_ens group by 1"))
def ver12(spark, sf):
    return report(E.crps_scores(V.rain_ens(spark, sf), ["fold"]))


POINT = f"""count(*) as n, count(*) filter (where truth>=1) as n_wet, {q6("avg(crps)","crps")}, {q6("avg(abs(er))","mae")}, {q6("avg(case when truth<1 then abs(er) end)","dry_mae")},
 {q6("avg(case when truth>=1 then abs(er) end)","wet_mae")}, {q6("avg(er)","bias")}, {q6("sqrt(avg(er*er))","rmse")}, {q6(CORR,"correlation")}, {q6("sqrt(avg(vr))","spread")},
 {q6("avg(ins)","coverage_90")}, {q6("sqrt(avg(vr))/sqrt(avg(er*er))","spread_skill")}"""


@query("ver13_point_metrics", sql("fx_methods", f"with {per_sample('fx_methods')} select method, {POINT} from ps group by 1"))
def ver13(spark, sf):
    return report(E.point_metrics(V.methods(spark, sf), ["method"]))


@query("ver14_scale_scores", sql("fx_methods", f"""with {per_sample('fx_methods')},
p as (select method, truth, unnest(members) as v, unnest(range(16)) as k from fx_methods),
m as (select method, k, sqrt(avg(pow(v-truth,2))) as r, corr(v,truth) as c, avg(v*v) as q from p group by 1,2),
mm as (select method, avg(r) as r, avg(c) as c, avg(q) as q from m group by 1)
select ps.method, count(*) as n, {q6("sqrt(avg(er*er))","rmse")}, {q6("avg(abs(er))","mae")}, {q6("avg(er)","bias")}, {q6("avg(crps)","crps")}, {q6(CORR,"correlation")}, {q6("avg(sqrt(vr))","spread")}, {q6("avg(ins)","coverage_90")},
 {q6("any_value(mm.r)","mean_member_rmse")}, {q6("any_value(mm.c)","mean_member_correlation")}, {q6("avg(sqrt(vr))/sqrt(avg(er*er))","spread_skill")}, {q6("avg(mn*mn)/avg(truth*truth)","ensemble_mean_energy_ratio")},
 {q6("any_value(mm.q)/avg(truth*truth)","mean_member_energy_ratio")}, {q6("sqrt(avg(truth*truth))","truth_rms")} from ps join mm on mm.method=ps.method group by 1"""))
def ver14(spark, sf):
    return report(E.scale_scores(V.methods(spark, sf), ["method"]))


@query("ver15_finite_size_spread", sql("fx_methods", f"""with {per_sample('fx_methods')}
select method, count(*) as n, {q6("sqrt(avg(er*er))","rmse")}, {q6("avg(sqrt(vr))","spread")}, {q6("avg(list_stddev_pop(members))","spread_pop")}, {q6("avg(sqrt(vr))*sqrt(17e0/16)/sqrt(avg(er*er))","spread_skill")},
 {q6("avg(list_stddev_pop(members))/sqrt(avg(er*er))","spread_skill_pop")} from ps group by 1"""))
def ver15(spark, sf):
    return report(E.finite_size_scores(V.methods(spark, sf), ["method"]))


SPSK = f"""count(*) as n, {q6("sqrt(avg(er*er))","skill")}, {q6("sqrt(avg(vr)*17e0/16+0.25e0)","spread")}, {q6("sqrt(avg(vr)*17e0/16+0.25e0)/sqrt(avg(er*er))","ratio")}"""


@query("ver16_spread_skill", sql("fx_methods", f"with {per_sample('fx_methods')} select method, {SPSK} from ps group by 1"))
def ver16(spark, sf):
    return report(E.spread_skill(V.methods(spark, sf), ["method"], obs_var=0.25))


@query("ver16_spread_skill_by_bin", sql("fx_rain_ens", f"""with {per_sample('fx_rain_ens')}
select case when truth>=0 and truth<1 then 0 when truth<10 then 1 when truth<25 then 2 when truth<50 then 3 when truth<100 then 4 else 5 end as bin, {SPSK} from ps group by 1 having count(*)>=20"""))
def ver16b(spark, sf):
    return report(E.spread_skill_by_bin(V.rain_ens(spark, sf), obs_var=0.25))


def sdraw(*keys):
    """SQL text of the hashed 48-bit draw."""
    return f"(('0x'||substr(md5(concat_ws(':',{','.join(keys)})),1,12))::BIGINT)"


def snormal(*keys):
    u = f"(({sdraw(keys[0], chr(39) + 'u' + chr(39), *keys[1:])}+0.5e0)/281474976710656e0)"
    v = f"(({sdraw(keys[0], chr(39) + 'v' + chr(39), *keys[1:])}+0.5e0)/281474976710656e0)"
    return f"(sqrt(-2e0*ln({u}))*cos(2*pi()*{v}))"


def hist_sql(rank, view):
    return f"""with r as (select cast({rank} as int) as rank from {view}), s as (select cast(unnest(range(17)) as int) as rank)
select s.rank, count(r.rank) as n from s left join r on r.rank=s.rank group by 1"""


@query("ver17_rank_histogram", sql("fx_ens", hist_sql("len([x for x in members if x<truth])", "fx_ens")))
def ver17(spark, sf):
    return E.rank_histogram(V.ens(spark, sf), 16)


@query("ver17_rank_histogram_noise", sql("fx_ens", f"""
with p as (select sample_id, truth, unnest(members) as x, unnest(range(16)) as i from fx_ens),
r as (select sample_id, cast(count(*) filter (where x+0.1e0*{snormal("'7'","sample_id","i")}<truth) as int) as rank from p group by 1), s as (select cast(unnest(range(17)) as int) as rank)
select s.rank, count(r.rank) as n from s left join r on r.rank=s.rank group by 1"""))
def ver17b(spark, sf):
    return E.rank_histogram(V.ens(spark, sf), 16, noise_sd=0.1, seed=7)


@query("ver17_rank_histogram_ties", sql("fx_rain_ens", hist_sql(f"len([x for x in members if x<truth]) + {sdraw(chr(39)+'3'+chr(39),'sample_id')}%(len([x for x in members if x=truth])+1)", "fx_rain_ens")))
def ver17c(spark, sf):
    return E.rank_histogram(V.rain_ens(spark, sf), 16, ties="random", seed=3)


@query("ver17_flatness", sql("fx_methods", f"""
with r as (select method, len([x for x in members if x<truth]) as rank from fx_methods), m as (select distinct method from fx_methods), s as (select method, unnest(range(17)) as rank from m),
h as (select s.method, s.rank, count(r.rank) as n from s left join r on r.rank=s.rank and r.method=s.method group by 1,2), p as (select method, n/(sum(n) over (partition by method)) as p from h)
select method, {q6("sum(abs(p-1e0/17))/2","deviation")} from p group by 1"""))
def ver17d(spark, sf):
    return report(E.flatness(E.rank_histogram(V.methods(spark, sf), 16, ["method"]), ["method"]))


@query("ver18_inflation", sql("fx_methods", f"""with {per_sample('fx_methods')},
f as (select method, least(greatest(sqrt(greatest(avg(er*er)-0.25e0,1e-9)/(avg(vr)*17e0/16)),0.5e0),6e0) as a from ps group by 1)
select p.method, date, station_id, {q6("a","alpha")}, {q6("list_avg([greatest(mn+a*(x-mn),0e0) for x in members])","inflated_mean")} from ps p join f on f.method=p.method"""))
def ver18(spark, sf):
    a = E.fit_inflation(V.methods(spark, sf), ["method"], obs_var=0.25)
    d = V.methods(spark, sf).join(a, "method").withColumn("inflated_mean", EN.mean(E.inflate("members", F.col("alpha"))))
    return report(d.select("method", "date", "station_id", "alpha", "inflated_mean"))


RECAL = """rk as (select len([x for x in members if x<truth])/16e0 as r from fx_ens),
cal as (select quantile_cont(r,[0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) as e from rk)"""


@query("ver19_recalibration_fit", sql("fx_ens", f"with {RECAL} select {q6('unnest(e)','empirical')}, unnest(range(11))/10e0 as nominal from cal"))
def ver19(spark, sf):
    f = E.fit_recalibration(V.ens(spark, sf), 11)
    return f.select(F.posexplode("empirical").alias("k", "e"), "nominal").select(R("e").alias("empirical"), F.get("nominal", F.col("k")).alias("nominal"))


@query("ver19_recalibration_apply", sql("fx_ens", f"""with {RECAL}, lv as (select k, (k+0.5e0)/16 as l, e, cast(len([x for x in e if x<=(k+0.5e0)/16]) as int) as j from cal, (select unnest(range(16)) as k)),
nw as (select k, case when j=0 then 0e0 when j=11 then 1e0 else (j-1)/10e0+(l-e[j])*0.1e0/(e[j+1]-e[j]) end as nl from lv),
ix as (select list(least(greatest(cast(round_even(nl*16-0.5e0,0) as int),0),15)+1 order by k) as ii from nw)
select sample_id, {q6("list_avg([list_sort(members)[i] for i in ii])","mean")}, {q6("list_max([list_sort(members)[i] for i in ii])","top")} from fx_ens, ix"""))
def ver19b(spark, sf):
    f = E.fit_recalibration(V.ens(spark, sf), 11).select(F.struct("empirical", "nominal").alias("c")).scalar()
    d = V.ens(spark, sf).withColumn("_c", f)
    # Exploded, so that the members are remapped once and not at each use of them.
    d = d.select("sample_id", F.explode(F.array(E.recalibrate("members", F.col("_c.empirical"), F.col("_c.nominal")))).alias("m"))
    return d.select("sample_id", R(EN.mean("m")).alias("mean"), R(F.array_max("m")).alias("top"))


@query("ver20_threshold_probability", sql("fx_methods", f"""
with d as (select method, t as threshold, len([x for x in members if x>=t])/16e0 as p, truth>=t as e from fx_methods, (select unnest([1e0,5e0,10e0]) as t)),
g as (select method, threshold, count(*) n, count(*) filter (where e) as ev, avg(pow(p-cast(e as int),2)) as b, avg(p) as pm, count(*) filter (where p>=0.5e0 and e) as h, count(*) filter (where p<0.5e0 and e) as m, count(*) filter (where p>=0.5e0 and not e) as f from d group by 1,2)
select method, threshold, n, ev as events, {q6("b","brier")}, {q6("pm","probability_mean")}, h as hits, m as misses, f as false_alarms, {q6("case when h+m>0 then h/(h+m) end","pod")}, {q6("case when h+f>0 then f/(h+f) end","far")}, {q6("case when h+m+f>0 then h/(h+m+f) end","csi")} from g"""))
def ver20(spark, sf):
    return report(E.threshold_probability(V.methods(spark, sf), [1, 5, 10], ["method"]))


@query("ver21_reliability", sql("fx_methods", f"""
with d as (select method, len([x for x in members if x>=5])/16e0 as p, truth>=5 as e from fx_methods)
select method, cast(least(floor(p*5+1e-12),4) as int) as bin, count(*) as n, {q6("avg(p)","forecast_probability")}, {q6("avg(cast(e as int))","observed_frequency")} from d group by 1,2"""))
def ver21(spark, sf):
    return report(E.reliability(V.methods(spark, sf), 5.0, 5, ["method"]))


def cov_sql(lv):
    lo, hi = (1 - lv / 100) / 2, 1 - (1 - lv / 100) / 2
    return f"""{q6(f"avg(case when truth>={lq(lo)} and truth<={lq(hi)} then 1e0 else 0e0 end)", f"coverage_{lv}")}, {q6(f"avg({lq(hi)}-{lq(lo)})", f"width_{lv}")}"""


@query("ver22_interval_coverage", sql("fx_rain_ens", f"select fold, count(*) as n, {cov_sql(50)}, {cov_sql(80)}, {cov_sql(90)} from fx_rain_ens group by 1"))
def ver22(spark, sf):
    return report(E.interval_coverage(V.rain_ens(spark, sf), keys=["fold"]))


def centre_sql(k):
    return f"""{q6(f"sqrt(avg(pow({k}-truth,2)))", f"{k}_rmse")}, {q6(f"avg(abs({k}-truth))", f"{k}_mae")}, {q6(f"avg({k}-truth)", f"{k}_bias")}, {q6(f"case when stddev_pop({k})>0 and stddev_pop(truth)>0 then corr({k},truth) end", f"{k}_corr")}"""


@query("ver23_jensen_audit", sql("fx_methods", f"""
with e as (select method, truth, list_avg(members) as mean, {lq(0.5)} as median, 0.1e0*(exp(list_avg([ln(1+x/0.1e0) for x in members]))-1) as transform_mean, list_stddev_pop([ln(1+x/0.1e0) for x in members]) as sz from fx_methods)
select method, count(*) as n, {centre_sql("mean")}, {centre_sql("median")}, {centre_sql("transform_mean")}, {q6("avg(sz)","sigma_z")}, {q6("avg(mean-truth)-avg(median-truth)","jensen_gap")} from e group by 1"""))
def ver23(spark, sf):
    return report(E.jensen_audit(V.methods(spark, sf), ["method"]))


@query("ver24_point_scale_crps", sql("fx_rain_ens", f"""
with p as (select sample_id, truth, unnest(members) as x, unnest(range(16)) as i from fx_rain_ens),
m as (select sample_id, truth, list(greatest(0e0,0.1e0*(exp(ln(1+x/0.1e0)+0.5e0*{snormal("'11'","sample_id","i")})-1)) order by i) as members from p group by 1,2)
select sample_id, {q6("list_avg(members)","mean")}, {q6(FAIR,"crps")} from m"""))
def ver24(spark, sf):
    d = V.rain_ens(spark, sf).withColumn("members", E.point_scale_members("members", 0.5, "sample_id", 11))
    return d.select("sample_id", R(EN.mean("members")).alias("mean"), R(EN.fair_crps("members", "truth")).alias("crps"))


def arms(spark, sf):
    m = V.methods(spark, sf)
    b = m.where("method = 'background'").select("date", "station_id", "fold", "truth", F.col("members").alias("background"))
    a = m.where("method = 'combined'").select("date", "station_id", F.col("members").alias("analysis"))
    return b.join(a, ["date", "station_id"])


@query("ver25_innovations", sql("fx_methods", f"""
with j as (select b.fold, ln(1+b.truth/0.1e0) as t, [ln(1+x/0.1e0) for x in b.members] as b, [ln(1+x/0.1e0) for x in a.members] as a from fx_methods b join fx_methods a on a.date=b.date and a.station_id=b.station_id and b.method='background' and a.method='combined'),
s as (select fold, t-list_avg(b) as o, list_var_samp(b) as v, t-list_avg(a) as r from j)
select fold, count(*) as n, {q6("avg(o)","innovation_mean")}, {q6("var_samp(o)","innovation_var")}, {q6("avg(v)","background_var")}, {q6("avg(r)","residual_mean")}, {q6("var_samp(r)","residual_var")}, {q6("avg(r*o)","desroziers_r")},
 {q6("avg(v)+0.26e0","expected_var")}, {q6("var_samp(o)/(avg(v)+0.26e0)","consistency_ratio")} from s group by 1"""))
def ver25(spark, sf):
    return report(E.innovation_statistics(arms(spark, sf), "background", "analysis", keys=["fold"]))


@query("ver44_spread_error_bins", sql("fx_rain_ens", f"""with {per_sample('fx_rain_ens')},
s as (select sqrt(vr) as sp, er from ps), e as (select list_sort(list_distinct(quantile_cont(sp,[0,0.2,0.4,0.6,0.8,1.0]))) as q from s),
b as (select unnest(range(len(q)-1)) as bin, unnest(q[1:len(q)-1]) as lo, unnest(q[2:]) as hi from e)
select cast(bin as int) as bin, count(*) as n, {q6("avg(sp)","spread")}, {q6("sqrt(avg(er*er))","rmse")} from s join b on sp>=lo and sp<=hi group by 1 having count(*)>=2"""))
def ver44(spark, sf):
    return report(E.spread_error_bins(V.rain_ens(spark, sf)))


def centre2(k):
    return f"""{q6(f"avg({k}-truth)", f"{k}_bias")}, {q6(f"avg(abs({k}-truth))", f"{k}_mae")}, {q6(f"sqrt(avg(pow({k}-truth,2)))", f"{k}_rmse")}, {q6(f"case when stddev_pop({k})>0 and stddev_pop(truth)>0 then corr({k},truth) end", f"{k}_corr")}"""


@query("ver45_mean_and_median", sql("fx_methods", f"""
with e as (select method, truth, list_avg(members) as mean, {lq(0.5)} as median from fx_methods) select method, count(*) as n, {centre2("mean")}, {centre2("median")} from e group by 1"""))
def ver45(spark, sf):
    return report(E.centre_scores(V.methods(spark, sf), ["method"]))
