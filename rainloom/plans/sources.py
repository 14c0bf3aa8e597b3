"""Queries over the source parsers, with text and file names derived from the given tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from rainloom.functions import ensemble as EN, scalar as S
from rainloom.functions.lattice import VIEW_LATTICE as G
from rainloom.operators import joins as J
from rainloom.plans import views as V
from rainloom.plans.grids import CORNERS
from rainloom.plans.registry import query
from rainloom.plans.scalars import q6
from rainloom.plans.stats import report
from rainloom.plans.views import sql, table
from rainloom.session import new_folder
from rainloom.sources import archive as A, granules as GN, stations as ST

R = S.rounded


def raw_catalog(spark, sf):
    """Suppliers as catalogue text rows, with mixed case, blanks and punctuation in the names."""
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        s.cast("string").alias("StationNumber"), F.concat(F.lit("  Gauge-"), s.cast("string"), F.lit(" East ")).alias("Station"),
        (F.lit(20.0) + s * 0.01).cast("string").alias("Latitude"), (F.lit(88.0) + (s % 40) * 0.1).cast("string").alias("Longitude"))


CAT = "cat as (select s_suppkey as station_id, 'Gauge-'||s_suppkey||' East' as catalog_name, 20e0+s_suppkey*0.01e0 as lat, 88e0+(s_suppkey%40)*0.1e0 as lon, 'gauge'||s_suppkey||'east' as station_key from supplier)"


@query("src01_station_catalog", f"with {CAT} select station_id, catalog_name, {q6('lat','lat')}, {q6('lon','lon')}, station_key from cat")
def src01(spark, sf):
    return report(ST.parse_catalog(raw_catalog(spark, sf)))


def month_matrix(spark, sf):
    """Lineitem as station-month text rows: one column per day, marks for missing values."""
    li = table(spark, sf, "lineitem")
    d = li.groupBy("l_suppkey", F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"), F.dayofmonth("l_shipdate").alias("d")).agg(F.max("l_quantity").alias("q"))
    q = F.col("q").cast("int")
    cell = F.when(q % 10 == 0, "***").when(q % 10 == 1, " na ").when(q % 10 == 2, "-999").when(q % 10 == 3, F.concat(F.lit("-"), q.cast("string"))).otherwise(q.cast("string"))
    g = d.withColumn("cell", cell).groupBy("l_suppkey", "y", "m").agg(F.map_from_entries(F.collect_list(F.struct(F.col("d").cast("string"), "cell"))).alias("c"))
    name = F.concat(F.lit("GAUGE "), F.col("l_suppkey").cast("string"), F.lit(" east"))
    return g.select(name.alias("Stati"), F.col("y").cast("string").alias("Year"), F.col("m").cast("string").alias("Month"), *[F.coalesce(F.try_element_at("c", F.lit(k)), F.lit("")).alias(k) for k in ST.DAYS])


LEGACY = f"""{CAT}, d as (select l_suppkey as s, cast(l_shipdate as date) as date, cast(max(l_quantity) as int) as q from lineitem group by 1,2),
mo as (select distinct s, date_trunc('month',date) as m0 from d), sp as (select s, cast(m0 + to_days(cast(k as int)) as date) as date from mo, (select unnest(range(31)) as k) where date_trunc('month', m0 + to_days(cast(k as int)))=m0),
lg as (select sp.s as station_id, 'GAUGE '||sp.s||' east' as name, lat, lon, sp.date, case when q%10 in (0,1,2,3) then null else cast(q as double) end as precip_mm from sp join cat on cat.station_id=sp.s left join d on d.s=sp.s and d.date=sp.date)"""


@query("src02_legacy_matrix", f"with {LEGACY} select station_id, name, {q6('lat','lat')}, {q6('lon','lon')}, date, precip_mm from lg where date>=date '1995-01-01' and date<=date '1995-06-30'")
def src02(spark, sf):
    d = ST.legacy_days(month_matrix(spark, sf), ST.parse_catalog(raw_catalog(spark, sf)), "1995-01-01", "1995-06-30")
    return d.select("station_id", "name", R("lat").alias("lat"), R("lon").alias("lon"), "date", "precip_mm")


@query("src03_station_files", f"""with {CAT}, r as (select n_nationkey as k, case when n_nationkey%3=0 then 'gauge'||(n_nationkey%9+1)||'east' when n_nationkey%3=1 then 'gauge'||(n_nationkey%9+1) else 'oldgauge'||(n_nationkey%9+1)||'eastern' end as fk from nation),
f as (select distinct fk from r), m as (select fk, station_id, catalog_name, row_number() over (partition by fk order by case when station_key=fk then 0 else 1 end, station_id) as rn from f join cat on contains(fk, station_key) or contains(station_key, fk)),
e as (select m.fk, m.station_id, m.catalog_name as name, cast(o_orderdate as date) as date, case when o_orderkey%7=0 then null else cast(floor(o_totalprice/500) as double) end as v, o_orderkey from orders join customer on c_custkey=o_custkey join r on r.k=c_nationkey join m on m.fk=r.fk and m.rn=1)
select station_id, name, date, count(*) as n, max(case when v>1000 or v=999 then null else v end) as top_mm from e group by 1,2,3""")
def src03(spark, sf):
    k = F.col("n_nationkey")
    g = (k % 9 + 1).cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("Gauge_"), g, F.lit("_EAST.csv"))).when(k % 3 == 1, F.concat(F.lit("gauge "), g, F.lit(".csv"))).otherwise(F.concat(F.lit("old-gauge"), g, F.lit("eastern.csv")))
    files = table(spark, sf, "nation").select("n_nationkey", name.alias("file"))
    m = ST.match_files(files, ST.parse_catalog(raw_catalog(spark, sf)))
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(files, F.col("c_nationkey") == F.col("n_nationkey"))
    cell = F.when(F.col("o_orderkey") % 7 == 0, "junk").otherwise(F.floor(F.col("o_totalprice") / 500).cast("string"))
    rows = o.select("file", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_text"), cell.alias("cell"))
    d = ST.station_file_rows(rows, m)
    return d.groupBy("station_id", "name", "date").agg(F.count("*").alias("n"), F.max("precip_mm").alias("top_mm"))


@query("src04_daily_inventory", """
with f as (select strftime(l_shipdate,'%Y%m%d') as d, l_returnflag from lineitem group by 1,2),
c as (select cast(strptime(d,'%Y%m%d') as date) as day, count(*) as files, min('sat.'||d||'-S000000-E235959.'||l_returnflag||'.bin') as file from f group by 1),
s as (select cast(unnest(generate_series(date '1994-01-01', date '1996-12-31', interval 1 day)) as date) as day)
select s.day, coalesce(files,0) as files, file, case when files is null then 'missing' when files>1 then 'duplicate' else 'ok' end as status from s left join c on c.day=s.day""")
def src04(spark, sf):
    f = table(spark, sf, "lineitem").select(
        F.concat(F.lit("sat."), F.date_format("l_shipdate", "yyyyMMdd"), F.lit("-S000000-E235959."), "l_returnflag", F.lit(".bin")).alias("file")).distinct()
    d = GN.daily_inventory(f, F.lit("1994-01-01").cast("date"), F.lit("1996-12-31").cast("date"))
    return d.select("day", F.col("files").cast("bigint").alias("files"), "file", "status")


@query("src05_half_hour_inventory", """
with h as (select time_bucket(interval 30 minutes, ts) as t, event_type, event_id%50=0 as bad from events),
f as (select distinct t, event_type from h where not bad), c as (select t, count(*) as n from f group by 1),
d as (select cast(unnest(generate_series(date '2024-01-02', date '2024-01-30', interval 1 day)) as date) as date),
s as (select date, cast(date as timestamp) - interval 21 hours + to_minutes(cast(30*k as int)) as slot from d, (select unnest(range(48)) as k))
select date, count(*) filter (where n is null) as missing, count(*) filter (where n>1) as duplicated from s left join c on c.t=s.slot group by 1""")
def src05(spark, sf):
    e = table(spark, sf, "events")
    t0 = F.date_trunc("hour", "ts").cast("timestamp_ntz") + F.make_dt_interval(mins=F.when(F.minute("ts") >= 30, 30).otherwise(0))
    e = e.select(t0.alias("t"), (F.col("event_id") % 50 == 0).alias("bad"), "event_type").distinct()
    end = F.when(F.col("bad"), "5900").otherwise(F.when(F.minute("t") >= 30, "5959").otherwise("2959"))
    f = e.select(F.concat(F.lit("sat."), F.date_format("t", "yyyyMMdd"), F.lit("-S"), F.date_format("t", "HHmmss"), F.lit("-E"), F.date_format("t", "HH"), end, F.lit("."), "event_type").alias("file")).distinct()
    s = GN.half_hour_inventory(f, F.lit("2024-01-02").cast("date"), F.lit("2024-01-30").cast("date"))
    return GN.window_status(s)


@query("src06_daily_field", f"""
with d as (select user_id as station_id, cast(ts as date) as date, sum(value) as v, stddev_samp(value) as e, count(*) as n from events group by 1,2)
select station_id, date, n as n_valid, {q6("case when n>=3 and v>=0 then v end","precip_mm")}, {q6("case when n>=3 and v>=0 then e end","error_mm")} from d""")
def src06(spark, sf):
    d = table(spark, sf, "events").groupBy(F.col("user_id").alias("station_id"), F.to_date("ts").alias("date")).agg(
        F.sum("value").alias("precip_mm"), F.stddev_samp("value").alias("error_mm"), F.count("*").alias("n_valid"))
    return report(GN.daily_field(d, min_count=3))


@query("src07_window_subset", f"""
with w as (select cast(l_shipdate as date) as day, l_linenumber as shard, l_quantity from lineitem where cast(l_shipdate as date) between date '1995-03-01' and date '1995-08-31'), f as (select day, min(shard) as shard from w group by 1)
select w.day, w.shard, count(*) as n, {q6("sum(l_quantity)","total")} from w join f on f.day=w.day and f.shard=w.shard group by 1,2""")
def src07(spark, sf):
    li = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.col("l_linenumber").alias("shard"), "l_quantity")
    return report(GN.subset_shards(li, "1995-03-01", "1995-08-31", "shard", complete=False).groupBy("day", "shard").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total")))


@query("src07_complete_window", f"""
with w as (select cast(ts as date) as day, event_type as shard, value from events where cast(ts as date) between date '2024-01-05' and date '2024-01-20'), f as (select day, min(shard) as shard from w group by 1)
select w.day, w.shard, count(*) as n, {q6("sum(value)","total")} from w join f on f.day=w.day and f.shard=w.shard group by 1,2""")
def src07b(spark, sf):
    e = table(spark, sf, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("shard"), "value", F.lit("mm / day").alias("units"), F.lit(3).alias("hour"),
                                       F.lit("half-hourly").alias("frequency"))
    return report(GN.subset_shards(e, "2024-01-05", "2024-01-20", "shard", units="units", end_hour="hour", frequency="frequency").groupBy("day", "shard").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@query("src08_checked_concat", sql("fx_grid", f"""
with b as (select day, floor(iy/8) as iy, floor(ix/8) as ix, avg(value) as v, avg(ref) as r from fx_grid group by 1,2,3),
u as (select 0 as o, day, iy, ix, v from b where day<date '1996-01-01' union all select 1, day, iy, ix, r from b where day>=date '1996-01-01')
select o as file_order, day, count(*) as cells, {q6("avg(v)","mean")} from u group by 1,2"""))
def src08b(spark, sf):
    g = V.grid(spark, sf).groupBy("day", F.floor(F.col("iy") / 8).alias("iy"), F.floor(F.col("ix") / 8).alias("ix")).agg(F.avg("value").alias("v"), F.avg("ref").alias("r"))
    d = GN.concat_products([g.where("day < date '1996-01-01'").drop("r"), g.where("day >= date '1996-01-01'").select("day", "iy", "ix", F.col("r").alias("v"))])
    return report(d.groupBy(F.col("_file_order").alias("file_order"), "day").agg(F.count("*").alias("cells"), F.avg("v").alias("mean")))


@query("src08_product_concat", sql("fx_grid", f"""
with u as (select 0 as o, day, iy, ix, value as v from fx_grid where day<date '1996-01-01' union all select 1, day, iy, ix, case when ref*25 between 0 and 1000 then ref*25 end from fx_grid where day>=date '1995-06-01')
select o as file_order, day, count(*) as cells, count(v) as valid, {q6("round(avg(v),9)","mean")} from u group by 1,2"""))
def src08(spark, sf):
    g = V.grid(spark, sf)
    a = g.where("day < date '1996-01-01'").select("day", "iy", "ix", F.col("value").alias("v"))
    b = g.where("day >= date '1995-06-01'").select("day", "iy", "ix", (F.col("ref") * 25).alias("v")).withColumn("v", GN.bounded("v"))
    d = GN.merge_products([a, b]).withColumnRenamed("_file_order", "file_order")
    return report(d.groupBy("file_order", "day").agg(F.count("*").alias("cells"), F.count("v").alias("valid"), F.round(F.avg("v"), 9).alias("mean")))


@query("src09_pending_years", """
with y as (select year(l_shipdate) as year, count(distinct cast(l_shipdate as date)) as days, count(*) as rows from lineitem group by 1)
select cast(year as int) as year, days, rows, days = cast(make_date(year+1,1,1)-make_date(year,1,1) as bigint) as complete from y where year not in (select year(o_orderdate) from orders where o_orderkey<=10)""")
def src09(spark, sf):
    done = table(spark, sf, "orders").where("o_orderkey <= 10").select(F.year("o_orderdate").alias("year")).distinct()
    return A.pending_years(table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")), done)


@query("src10_archive_moments", sql("fx_methods", f"""
select method, date, station_id, {q6("case when station_id%4<>0 then list_avg(members) end","ensemble_mean")}, {q6("case when station_id%4<>0 then list_stddev_samp(members) end","ensemble_std")} from fx_methods"""))
def src10(spark, sf):
    d = A.derived_moments(V.methods(spark, sf), F.col("station_id") % 4 != 0)
    return report(d.select("method", "date", "station_id", "ensemble_mean", "ensemble_std"))


@query("src10_archive_round_trip", sql("fx_methods", f"""
select method, count(*) as n, count(distinct date) as days, {q6("avg(list_avg(members))","ensemble_mean")}, {q6("avg(list_stddev_samp(members))","ensemble_std")} from fx_methods group by 1"""))
def src10b(spark, sf):
    path = new_folder(spark, "archive")
    A.write_ensemble(V.methods(spark, sf), path, ["background", "gauges", "combined", "satellite"], day="date")
    back = spark.read.parquet(path).groupBy("method").agg(F.count("*").alias("n"), F.countDistinct("date").alias("days"), F.avg("ensemble_mean").alias("ensemble_mean"), F.avg("ensemble_std").alias("ensemble_std"))
    return report(back)


@query("src11_season_union", sql("fx_methods", f"select method, strftime(date,'%Y-%m') as month, count(distinct date) as days, count(*) as n, {q6('avg(truth)','truth')} from fx_methods group by 1,2"))
def src11(spark, sf):
    m = V.methods(spark, sf)
    u = A.union_seasons([m.where("date < date '2024-05-20'"), m.where("date >= date '2024-05-20'")], day="date", grid=["station_id"])
    return report(u.groupBy("method", F.date_format("date", "yyyy-MM").alias("month")).agg(F.countDistinct("date").alias("days"), F.count("*").alias("n"), F.avg("truth").alias("truth")))


@query("src12_report_rows", sql("fx_multipair", f"""
select 'product '||product as label, count(*) as n, {q6("avg(pred-obs)","bias")}, cast(null as double) as days from fx_multipair group by 1
union all select 'date '||date, count(*), null, cast(count(distinct station_id) as double) from fx_multipair group by 1"""))
def src12(spark, sf):
    m = V.multipair(spark, sf)
    a = m.groupBy(F.concat(F.lit("product "), "product").alias("label")).agg(F.count("*").alias("n"), F.avg(F.col("pred") - F.col("obs")).alias("bias"))
    b = m.groupBy(F.concat(F.lit("date "), F.col("date").cast("string")).alias("label")).agg(F.count("*").alias("n"), F.countDistinct("station_id").cast("double").alias("days"))
    return report(A.finite_columns(A.unite_rows([a, b])))


@query("src13_fold_dumps", sql("fx_methods", f"select 'p'||(fold%2) as period, fold, method, count(*) as n, count(distinct station_id) as stations, {q6('avg(truth)','truth')} from fx_methods group by 1,2,3"))
def src13(spark, sf):
    m = V.methods(spark, sf).drop("fold")
    frames = {(f"p{k % 2}", k): m.where(F.col("station_id") % 5 == k) for k in range(5)}
    u = A.union_dumps(frames)
    return report(u.groupBy("period", "fold", "method").agg(F.count("*").alias("n"), F.countDistinct("station_id").alias("stations"), F.avg("truth").alias("truth")))


@query("src14_chunk_merge", f"""
with c as (select l_returnflag as arm, l_suppkey%7 as chunk, count(distinct cast(l_shipdate as date)) as days, case when l_suppkey%7=3 then null else avg(l_quantity) end as v, max(l_extendedprice) as worst from lineitem group by 1,2, l_suppkey%7)
select arm, cast(sum(days) as bigint) as days, {q6("sum(v*days)/sum(case when v is not null then days end)","v")}, {q6("max(worst)","worst")}, 'mm' as units from c group by 1""")
def src14(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), (F.col("l_suppkey") % 7).alias("chunk")).agg(
        F.countDistinct(F.to_date("l_shipdate")).alias("days"), F.avg("l_quantity").alias("v"), F.max("l_extendedprice").alias("worst"))
    c = c.withColumn("v", F.when(F.col("chunk") == 3, F.lit(float("nan"))).otherwise(F.col("v"))).withColumn("units", F.lit("mm"))
    return report(A.merge_chunks(c, ["arm"], ["v"], "days", ["worst"], ["units"]))


@query("src15_products_at_stations", sql("fx_grid fx_station", f"""with {CORNERS},
u as (select 0 as o, day, iy, ix, value as v from fx_grid where day<date '1996-06-01' union all select 1, day, iy, ix, ref from fx_grid where day>=date '1996-01-01'),
l as (select day, iy, ix, max_by(v,o) as v from u group by 1,2,3), s as (select station_id, day, sum(w*v)/sum(w) as v from l join k on k.iy=l.iy and k.ix=l.ix group by 1,2)
select station_id, cast(day + 1 as date) as date, day as product_day, {q6("ln(1+v)","log_value")} from s"""))
def src15(spark, sf):
    g = V.grid(spark, sf)
    a = g.where("day < date '1996-06-01'").select("day", "iy", "ix", "value")
    b = g.where("day >= date '1996-01-01'").select("day", "iy", "ix", F.col("ref").alias("value"))
    one = GN.latest_wins(GN.merge_products([a, b]), ["day", "iy", "ix"])
    s = GN.at_stations(one, V.station(spark, sf), G)
    return report(s.select("station_id", F.date_add("day", 1).alias("date"), F.col("day").alias("product_day"), F.log1p("value").alias("log_value")))


@query("src15_footprints_at_stations", sql("fx_grid fx_station", f"""with {CORNERS},
b as (select day, cast(floor(iy/2) as int) as by_, cast(floor(ix/2) as int) as bx_, avg(value) as v from fx_grid group by 1,2,3),
s as (select station_id, day, sum(w*v)/sum(w) as v, sum(w) as c from b join k on floor(k.iy/2)=b.by_ and floor(k.ix/2)=b.bx_ where k.iy between 0 and 15 and k.ix between 0 and 15 and day<date '1997-01-01' group by 1,2)
select station_id, cast(day + 1 as date) as date, {q6("ln(1+v)","log_value")} from s"""))
def src15_footprints(spark, sf):
    g = V.grid(spark, sf)
    coarse = g.groupBy("day", F.floor(F.col("iy") / 2).cast("int").alias("iy"), F.floor(F.col("ix") / 2).cast("int").alias("ix")).agg(F.avg("value").alias("value"))
    asked = g.where("day < date '1997-01-01'").select(F.date_add("day", 1).alias("date"))
    s = GN.at_stations(coarse, V.station(spark, sf), G, requested=asked, offset_days=-1, factor=2)
    return report(s.select("station_id", F.date_add("day", 1).alias("date"), F.log1p("value").alias("log_value")))
