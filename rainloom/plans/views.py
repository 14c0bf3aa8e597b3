"""Rainfall-shaped views over the given tables, in Spark and as SQL text for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def station(spark, sf):
    ids = table(spark, sf, "events").select(F.col("user_id").alias("station_id")).distinct()
    return ids.select(
        "station_id",
        (F.lit(20.6) + ((F.col("station_id") * 37) % 61) * F.lit(0.1)).alias("lat"),
        (F.lit(88.0) + ((F.col("station_id") * 53) % 47) * F.lit(0.1)).alias("lon"),
    )


def halfhour(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("station_id"), "ts", F.col("value").alias("rate"))


def steady_sum(value):
    """Sum of doubles that does not depend on the order of its rows: added as decimals of 18 places. Values beyond 1e10, infinities and NaN are added as doubles."""
    v = F.col(value)
    plain = F.abs(v) < 1e10
    small, large = F.sum(F.when(plain, v).cast("decimal(28,18)")).cast("double"), F.sum(F.when(~plain, v))
    return F.when(large.isNull(), small).otherwise(F.coalesce(small, F.lit(0.0)) + large)


def _daily(spark, sf, kinds, name, extra=(), exact=False, steady=False):
    """Day sums. exact: as decimals, so that a sum on a limit falls on the same side whatever the order of its rows. steady: as doubles, equal for days of equal events."""
    e = table(spark, sf, "events").where(F.col("event_type").isin(kinds))
    total = steady_sum("value") if steady else F.sum(F.col("value").cast("decimal(28,10)") if exact else "value")
    return e.groupBy(F.col("user_id").alias("station_id"), F.to_date("ts").alias("date"), *extra).agg(total.alias(name))


def obs(spark, sf, exact=False, steady=False):
    return _daily(spark, sf, ["view", "click", "purchase"], "precip_mm", exact=exact, steady=steady)


def prod(spark, sf, exact=False):
    return _daily(spark, sf, ["signup", "error"], "product_mm", exact=exact)


def multi(spark, sf, steady=False):
    """Two products as long rows: product, station_id, date, pred."""
    return _daily(spark, sf, ["signup", "error"], "pred", (F.col("event_type").alias("product"),), steady=steady)


def pair(spark, sf):
    return obs(spark, sf).join(prod(spark, sf), ["station_id", "date"]).select(
        "station_id", "date", F.col("precip_mm").alias("obs"), F.col("product_mm").alias("pred"))


def multipair(spark, sf, steady=False):
    """steady: for correlations of a station, since one whose days hold equal events has no spread and rounding noise must not become its correlation."""
    return multi(spark, sf, steady=steady).join(obs(spark, sf, steady=steady), ["station_id", "date"]).select(
        "product", "station_id", "date", F.col("precip_mm").alias("obs"), "pred")


def grid(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("day"),
        (F.col("l_partkey") % 16).cast("int").alias("iy"),
        (F.col("l_suppkey") % 16).cast("int").alias("ix"),
    ).agg(F.avg("l_quantity").alias("value"), (F.avg("l_extendedprice") / 1000).alias("ref"))


def _ens(spark, sf):
    """Four samples of 16 members from each vector of 64 components."""
    part = F.explode(F.sequence(F.lit(0), F.lit(3)))
    e = table(spark, sf, "embeddings").withColumn("c", part)
    st = (F.floor(F.col("vec_id") / 50) * 4 + F.col("c")).cast("int")
    return e.select(
        (F.col("vec_id") * 4 + F.col("c")).alias("sample_id"), (F.col("vec_id") % 50).cast("int").alias("day"),
        st.alias("station"), (st % 5).cast("int").alias("fold"),
        (F.col("label") * F.lit(0.05) - F.lit(0.2)).alias("truth"),
        F.transform(F.slice("embedding", F.col("c") * 16 + 1, 16), lambda x: x.cast("double")).alias("members"))


def ens(spark, sf):
    return _ens(spark, sf)


def rain_ens(spark, sf):
    """Non-negative ensembles in mm: negative draws are dry."""
    def wet(x):
        return F.greatest(x, F.lit(0.0)) * 100

    return ens(spark, sf).withColumn("members", F.transform("members", wet)).withColumn(
        "truth", wet(F.col("truth")))


def methods(spark, sf):
    """Four methods over the same truth, as long rows keyed by method; dates are real."""
    arms = F.explode(F.array(*[
        F.struct(F.lit(name).alias("method"), F.slice("embedding", first, 16).alias("m"))
        for name, first in (("background", 1), ("gauges", 17), ("combined", 33), ("satellite", 49))]))
    e = table(spark, sf, "embeddings").withColumn("arm", arms)
    st = F.floor(F.col("vec_id") / 50).cast("int")
    return e.select(
        F.col("arm.method").alias("method"),
        F.date_add(F.lit("2024-05-01").cast("date"), (F.col("vec_id") % 50).cast("int")).alias("date"),
        st.alias("station_id"), (st % 5).cast("int").alias("fold"),
        (F.greatest(F.col("label") * F.lit(0.05) - F.lit(0.2), F.lit(0.0)) * 100).alias("truth"),
        F.transform("arm.m", lambda x: F.greatest(x.cast("double"), F.lit(0.0)) * 100).alias("members"))


# SQL text of the same views for the DuckDB side of the check.
SQL = {
    "fx_station": "select station_id, 20.6e0+((station_id*37)%61)*0.1e0 as lat, 88.0e0+((station_id*53)%47)*0.1e0 as lon from (select distinct user_id as station_id from events) t",
    "fx_halfhour": "select user_id as station_id, ts, value as rate from events",
    "fx_obs": "select user_id as station_id, cast(ts as date) as date, sum(value) as precip_mm from events where event_type in ('view','click','purchase') group by 1, 2",
    "fx_prod": "select user_id as station_id, cast(ts as date) as date, sum(value) as product_mm from events where event_type in ('signup','error') group by 1, 2",
    "fx_multi": "select user_id as station_id, cast(ts as date) as date, event_type as product, sum(value) as pred from events where event_type in ('signup','error') group by 1, 2, 3",
    "fx_pair": "select o.station_id, o.date, o.precip_mm as obs, p.product_mm as pred from fx_obs o join fx_prod p on o.station_id=p.station_id and o.date=p.date",
    "fx_multipair": "select p.product, p.station_id, p.date, o.precip_mm as obs, p.pred from fx_multi p join fx_obs o on o.station_id=p.station_id and o.date=p.date",
    "fx_grid": "select cast(date_trunc('month', l_shipdate) as date) as day, cast(l_partkey%16 as int) as iy, cast(l_suppkey%16 as int) as ix, avg(l_quantity) as value, avg(l_extendedprice)/1000 as ref from lineitem group by 1,2,3",
    "fx_ens": "select vec_id*4+c as sample_id, cast(vec_id%50 as int) as day, cast(floor(vec_id/50)*4+c as int) as station, cast(floor(vec_id/50)*4+c as int)%5 as fold, label*0.05e0-0.2e0 as truth, [cast(x as double) for x in embedding[c*16+1:c*16+16]] as members from embeddings, (select unnest(range(4)) as c)",
    "fx_rain_ens": "select sample_id, day, station, fold, greatest(truth,0e0)*100 as truth, [greatest(x,0e0)*100 for x in members] as members from fx_ens",
    "fx_methods": "select a.method, cast(date '2024-05-01' + cast(vec_id%50 as int) as date) as date, cast(floor(vec_id/50) as int) as station_id, cast(floor(vec_id/50) as int)%5 as fold, greatest(label*0.05e0-0.2e0,0e0)*100 as truth, [greatest(cast(x as double),0e0)*100 for x in embedding[a.f:a.f+15]] as members from embeddings, (values ('background',1),('gauges',17),('combined',33),('satellite',49)) a(method,f)",
}
NEEDS = {"fx_pair": ["fx_obs", "fx_prod"], "fx_multipair": ["fx_multi", "fx_obs"], "fx_rain_ens": ["fx_ens"]}


def sql(names: str, body: str) -> str:
    """Prefix the views a check needs; the body may start with its own WITH list."""
    wanted: list[str] = []
    for n in names.split():
        for d in NEEDS.get(n, []) + [n]:
            if d not in wanted:
                wanted.append(d)
    ctes = ", ".join(f"{n} as ({SQL[n]})" for n in wanted)
    body = body.strip()
    if not wanted:
        return body
    rest = ", " + body[5:] if body.lower().startswith("with ") else " " + body
    return f"with {ctes}{rest}"
