"""Joins: intervals, points on lattices, neighbours, polygons, date offsets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rainloom.functions import ensemble as EN, scalar as S
from rainloom.functions.lattice import Lattice
from rainloom.operators.checks import guard
from rainloom.session import cut_lineage


def interval_join(left: DataFrame, right: DataFrame, l_lo, l_hi, r_lo, r_hi, width: float, on=()) -> DataFrame:
    """Overlap join as an equi join on bucket numbers, each pair kept once.

    Buckets are `width` wide; a pair meets in several buckets, and only the first
    shared one is kept, so no distinct is needed afterwards.
    """
    def bucketed(df, lo, hi, name, first):
        a = F.floor(F.col(lo) / width).cast("bigint")
        b = F.floor(F.col(hi) / width).cast("bigint")
        return df.withColumn(first, a).withColumn(name, F.explode(F.sequence(a, b)))

    le = bucketed(left, l_lo, l_hi, "_bucket", "_lb")
    ri = bucketed(right, r_lo, r_hi, "_bucket", "_rb")
    j = le.join(ri, [*on, "_bucket"])
    keep = (F.col("_bucket") == F.greatest("_lb", "_rb")) & (F.col(l_lo) < F.col(r_hi)) & (F.col(r_lo) < F.col(l_hi))
    return j.where(keep).drop("_bucket", "_lb", "_rb")


def spread_over(df: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Give every row each value of a bounded calendar or axis (one-column frame)."""
    axis = values.agg(F.sort_array(F.collect_set(name)).alias("a")).scalar()
    return df.withColumn(name, F.explode(axis))


# ---- lookups and pairing --------------------------------------------------

def many_to_one(facts: DataFrame, dim: DataFrame, key: str, required: str, keep: Column | None = None) -> DataFrame:
    """Left join to a unique dimension; an unmatched row stops the job, whether `keep` holds for it or not."""
    j = facts.join(dim, key, "left")
    bad = F.concat(F.lit(f"no match for {key}="), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    return j.where(guard(F.col(required).isNull(), bad, keep))


def pair_by_day(obs: DataFrame, product: DataFrame, offset: int, keys=("station_id",), date="date") -> DataFrame:
    """Pair an observation day with product day obs + offset, keeping both dates."""
    p = product.withColumn("product_date", F.col(date)).withColumn(date, F.date_add(date, -offset))
    return obs.join(p, [*keys, date])


def end_hour_offset(end_hour, gauge_offset: int) -> Column:
    """Day shift implied by a product's accumulation end hour; other hours are an error."""
    h = S.col(end_hour)
    return (F.when(h == 3, F.lit(gauge_offset)).when(h.isin(0, 24), F.lit(0))
            .otherwise(F.raise_error(F.concat(F.lit("unsupported end hour "), h.cast("string"))).cast("int")))


def prefixed_merge(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Wide merge of metric tables: columns prefixed by source, one row per key."""
    out = None
    for name, df in frames.items():
        df = df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key])
        out = df if out is None else out.join(df, key, "full")
    return out


def common_sample(long: DataFrame, keys, product: str, value: str, n_products: int) -> DataFrame:
    """Keep the keys for which every product has a value."""
    w = W.partitionBy(*keys)
    n = F.size(F.collect_set(F.when(F.col(value).isNotNull(), F.col(product))).over(w))
    return long.withColumn("_n", n).where(F.col("_n") == n_products).drop("_n")


def match_by_set(a: DataFrame, b: DataFrame, label: str, member: str) -> DataFrame:
    """Match group labels of two runs by the set of members, not by the label."""
    def sets(df, name):
        return df.groupBy(F.col(label).alias(name)).agg(F.sort_array(F.collect_set(member)).alias("members"))
    return sets(a, "label_a").join(sets(b, "label_b"), "members")


# ---- points on a lattice --------------------------------------------------

FOUR = [(dy, dx) for dy in (0, 1) for dx in (0, 1)]


def _around(points: DataFrame, lattice: Lattice, clamp: bool) -> DataFrame:
    """The first (_fy, _fx) of the four cells around each point, and the weights _w0 to _w3 of the cells in the order of FOUR."""
    row, column = lattice.row("lat"), lattice.column("lon")
    if clamp:
        row, column = S.clip(row, 0.0, lattice.nlat - 1.0), S.clip(column, 0.0, lattice.nlon - 1.0)
    p = points.withColumn("_y", row).withColumn("_x", column)
    fy, fx = F.floor("_y").cast("int"), F.floor("_x").cast("int")
    wy, wx = F.col("_y") - fy, F.col("_x") - fx
    return p.select(*points.columns, fy.alias("_fy"), fx.alias("_fx"), *[
        ((wy if dy else 1 - wy) * (wx if dx else 1 - wx)).alias(f"_w{k}") for k, (dy, dx) in enumerate(FOUR)])


def corners(points: DataFrame, lattice: Lattice, clamp: bool = False) -> DataFrame:
    """Four weighted cell keys per point."""
    four = F.array(*[F.struct((F.col("_fy") + dy).alias("iy"), (F.col("_fx") + dx).alias("ix"), F.col(f"_w{k}").alias("w")) for k, (dy, dx) in enumerate(FOUR)])
    return _around(points, lattice, clamp).withColumn("_c", F.explode(four)).select(*points.columns, "_c.*")


def _with_cells(field: DataFrame, keys, points: DataFrame, point_key, lattice: Lattice, clamp: bool, cells) -> DataFrame:
    """Each point with the four cells around it on each key of the field, in one row.

    The four cells of a square of the lattice are gathered once for all points in it, so what is grouped follows the
    field; the points only look them up. cells: the columns of corner k, from a function of the condition that a row is that corner.
    """
    squares = F.explode(F.array(*[F.struct((F.col("iy") - dy).alias("_fy"), (F.col("ix") - dx).alias("_fx"), F.lit(k).alias("_k")) for k, (dy, dx) in enumerate(FOUR)]))
    near = field.withColumn("_c", squares).select("*", "_c.*").groupBy("_fy", "_fx", *keys).agg(*[c for k in range(4) for c in cells(k, F.col("_k") == k)])
    shares = int(field.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = _around(points.select(point_key, "lat", "lon"), lattice, clamp).drop("lat", "lon")
    # A row of a point makes a row of each key: few small points must not end up in one task.
    return at.repartition(shares, point_key).join(near, ["_fy", "_fx"])


def bilinear_sample(field: DataFrame, points: DataFrame, lattice: Lattice, value: str = "value",
                    keys=("day",), point_key: str = "station_id", missing: str = "renormalise") -> DataFrame:
    """Sample a long field at points; one equi join on the square of four cells around a point, no grouping of points.

    missing: 'zero' counts absent cells as zero, 'renormalise' divides by the weight
    present (edge clamped), 'strict' needs the full weight inside the domain.
    """
    if missing not in ("zero", "renormalise", "strict"):
        raise ValueError(f"unknown missing rule {missing!r}")
    v = F.col(value)
    g = _with_cells(field.select(*keys, "iy", "ix", v), keys, points, point_key, lattice, missing == "renormalise", lambda k, here: [
        F.sum(F.when(here, v)).alias(f"_v{k}"), F.count(F.when(here, v)).alias(f"_n{k}")])
    known = sum((F.col(f"_n{k}") for k in range(1, 4)), F.col("_n0")) > 0
    total = lambda c: F.when(known, sum((c(k) for k in range(1, 4)), c(0)))
    g = g.withColumn("_s", total(lambda k: F.coalesce(F.col(f"_v{k}") * F.col(f"_w{k}"), F.lit(0.0)))).withColumn("_w", total(lambda k: F.col(f"_n{k}") * F.col(f"_w{k}")))
    if missing == "zero":
        out = F.coalesce(F.col("_s"), F.lit(0.0))
    elif missing == "renormalise":
        out = S.ratio(F.col("_s"), F.col("_w"))
    else:
        out = F.when(F.col("_w") >= 1 - 1e-9, F.col("_s"))
    return g.select(point_key, *keys, out.alias(value), F.coalesce(F.col("_w"), F.lit(0.0)).alias("coverage"))


def bilinear_members(field: DataFrame, points: DataFrame, lattice: Lattice, members: str = "members",
                     keys=("day",), point_key: str = "station_id", clamp: bool = False) -> DataFrame:
    """Sample every member; the four weighted arrays of a point are added by position, so rows do not follow the ensemble's size.

    clamp: a point beyond the outermost centres reads the border, else the corners it lacks count as zero.
    """
    m = F.col(members)
    g = _with_cells(field.select(*keys, "iy", "ix", m), keys, points, point_key, lattice, clamp, lambda k, here: [
        EN.added(F.collect_list(F.when(here, m))).alias(f"_m{k}"), F.count(F.when(here, 1)).alias(f"_n{k}")])
    read = [(F.col(f"_w{k}") > 0) & (F.col(f"_n{k}") > 0) if clamp else F.col(f"_n{k}") > 0 for k in range(4)]
    part = lambda k: F.when(read[k], F.transform(f"_m{k}", lambda v: v * F.col(f"_w{k}")))
    parts = F.filter(F.array(*[part(k) for k in range(4)]), lambda p: p.isNotNull())
    if clamp:
        g = g.where(read[0] | read[1] | read[2] | read[3])
    return g.withColumn("_parts", parts).select(point_key, *keys, EN.added("_parts").alias(members))


def nearest_cell(points: DataFrame, lattice: Lattice) -> DataFrame:
    """Nearest cell of a point, clipped to the lattice."""
    def near(pos, n):
        return F.least(F.greatest(F.floor(pos + 0.5), F.lit(0)), F.lit(n - 1)).cast("int")
    return points.withColumn("iy", near(lattice.row("lat"), lattice.nlat)).withColumn(
        "ix", near(lattice.column("lon"), lattice.nlon))


# ---- neighbours -----------------------------------------------------------

def blocked_join(left: DataFrame, right: DataFrame, on: str, left_id, right_id, block: int = 4096) -> DataFrame:
    """Every left row with every right row of the same `on`, where one value may hold a large part of either side.

    The rows of a value are dealt by hash into chunks of about `block`, as many as its own rows ask for; a chunk of one
    side meets a chunk of the other on (on, chunk, chunk), so no task holds more than about block times block pairs.
    """
    many = lambda name: F.ceil(F.count("*") / block).cast("int").alias(name)
    n = left.groupBy(on).agg(many("_nl")).join(right.groupBy(on).agg(many("_nr")), on)
    chunk = lambda ids, k: F.pmod(F.xxhash64(*ids), F.col(k)).cast("int")
    all_of = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    a = left.join(n, on).withColumn("_cl", chunk(left_id, "_nl")).withColumn("_cr", all_of("_nr")).drop("_nl", "_nr")
    b = right.join(n, on).withColumn("_cr", chunk(right_id, "_nr")).withColumn("_cl", all_of("_nl")).drop("_nl", "_nr")
    return a.join(b, [on, "_cl", "_cr"]).drop("_cl", "_cr")


def _band_keys(max_km: float):
    """Latitude bands are max_km tall, so a partner sits in the same or an adjacent band."""
    return max_km / 111.0 if max_km < 111.0 * 90 else 90.0


def places(points: DataFrame, key, keep: int) -> DataFrame:
    """Points of equal coordinates as one row: lat, lon, _ids with the `keep` smallest keys. Points without coordinates are left out."""
    d = points.select(F.col(key).alias("_id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where("lat is not null and lon is not null").distinct()
    r = F.row_number().over(W.partitionBy("lat", "lon").orderBy("_id"))
    return d.withColumn("_r", r).where(F.col("_r") <= keep).groupBy("lat", "lon").agg(F.sort_array(F.collect_list("_id")).alias("_ids"))


CROWD, FINEST = 64, 6


def uncrowded(places: DataFrame, widest: float) -> float:
    """The widest of `widest`, a quarter of it, and so on, whose square cells hold at most CROWD places each; the finest of FINEST steps if none is."""
    steps = [widest / 4.0 ** j for j in range(FINEST + 1)]
    at = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.floor(F.col("lat") / s).alias("y"), F.floor(F.col("lon") / s).alias("x")) for j, s in enumerate(steps)]))
    n = places.select(at.alias("c")).groupBy("c").agg(F.count("*").alias("n")).groupBy("c.j").agg(F.max("n").alias("n"))
    return steps[n.agg(F.coalesce(F.min(F.when(F.col("n") <= CROWD, F.col("j"))), F.lit(FINEST))).first()[0]]


def pairs_within(points: DataFrame, max_km: float, key: str = "station_id", block: int = 256) -> DataFrame:
    """Unordered point pairs no farther than max_km: a < b, km.

    Places meet on grid buckets, so a distance is worked out once for a pair of places. The points of a place travel in
    lists of about `block`; each list of one place meets each of the other, and only that row is unfolded into pairs.
    """
    shares = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = points.select(F.col(key).alias("_k"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where("lat is not null and lon is not null")
    at = cut_lineage(places(points, key, 1).select(F.get("_ids", F.lit(0)).alias("_p"), "lat", "lon"))
    of = cut_lineage(d.join(at, ["lat", "lon"]).select("_p", "_k"))
    n = of.groupBy("_p").agg(F.ceil(F.count("*") / block).alias("_n"))
    lists = cut_lineage(of.join(n, "_p").groupBy("_p", F.pmod(F.xxhash64("_k"), F.col("_n")).alias("_c")).agg(F.collect_list("_k").alias("_l")))
    met = neighbours_within(at, at, max_km, "_p").where(F.col("a") < F.col("b")).select(F.col("a").alias("_p"), F.col("b").alias("_q"), "km")
    met = met.unionByName(at.where(F.lit(max_km >= 0)).select("_p", F.col("_p").alias("_q"), F.lit(0.0).alias("km")))
    # A row of two places makes a row of each pair of their points: dealt evenly, whatever the sizes of the buckets.
    met = cut_lineage(met).repartition(shares, "_p", "_q")
    half = blocked_join(met, lists.select("_p", F.col("_c").alias("_ca"), F.col("_l").alias("_la")), "_p", ["_q"], ["_ca"])
    both = blocked_join(half, lists.select(F.col("_p").alias("_q"), F.col("_c").alias("_cb"), F.col("_l").alias("_lb")), "_q", ["_p", "_ca"], ["_cb"])
    both = both.withColumn("_a", F.explode("_la")).withColumn("_b", F.explode("_lb"))
    both = both.where((F.col("_p") != F.col("_q")) | (F.col("_a") < F.col("_b")))
    return both.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "km")


def neighbours_within(left: DataFrame, points: DataFrame, max_km: float, key: str = "station_id") -> DataFrame:
    """Ordered pairs (a of left, b of points) no farther than max_km, by an equi join on grid buckets.

    Buckets are one search radius wide in latitude and, at the highest latitude in a
    band, at least one radius wide in longitude, so only adjacent buckets can pair. Dense
    buckets are cut into chunks, so no task grows with a cluster of points.
    """
    step = _band_keys(max_km)

    def with_keys(df):
        band = F.floor((F.col("lat") + 90.0) / step).cast("bigint")
        return df.withColumn("_band", band)

    def lon_bucket(band, lon):
        # The widest |lat| over this band and its two neighbours fixes the bucket width.
        lo, hi = (band - 1) * step - 90.0, (band + 2) * step - 90.0
        top = F.least(F.greatest(F.abs(lo), F.abs(hi)), F.lit(90.0))
        n = F.greatest(F.floor(F.cos(F.radians(top)) * 360.0 / step), F.lit(1))
        return F.floor(F.pmod(lon, F.lit(360.0)) / 360.0 * n).cast("bigint"), n.cast("bigint")

    a = with_keys(left.select(F.col(key).alias("a"), F.col("lat").alias("lat"), F.col("lon").alias("lon")))
    # The left point looks from its own band; the right point is filed under each band that may look at it.
    bucket, _ = lon_bucket(F.col("_band"), F.col("lon"))
    left = a.withColumn("_bucket", bucket).select(
        "a", F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), "_band", "_bucket")
    r = with_keys(points.select(F.col(key).alias("b"), F.col("lat").alias("lat"), F.col("lon").alias("lon")))
    r = r.withColumn("_band", F.explode(F.sequence(F.col("_band") - 1, F.col("_band") + 1)))
    bucket, n = lon_bucket(F.col("_band"), F.col("lon"))
    r = r.withColumn("_bucket", F.explode(F.array_distinct(F.transform(
        F.sequence(bucket - 1, bucket + 1), lambda k: F.pmod(k, n)))))
    right = r.select("b", F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), "_band", "_bucket")
    cell = F.concat_ws(":", "_band", "_bucket")
    j = blocked_join(left.withColumn("_cell", cell).drop("_band", "_bucket"), right.withColumn("_cell", cell).drop("_band", "_bucket"), "_cell", ["a"], ["b"]).where(F.col("a") != F.col("b"))
    km = S.haversine_km("lat_a", "lon_a", "lat_b", "lon_b")
    return j.withColumn("km", km).where(F.col("km") <= max_km).drop("_cell")


def nearest_point(targets: DataFrame, points: DataFrame, target_key, point_key: str = "station_id",
                  first_deg: float = 1.0, exclude_self: bool = False, levels: int = 16) -> DataFrame:
    """Exact nearest point for every target by widening buckets.

    Targets and points of equal coordinates travel as one place, points with their smallest
    ids: one, or two where a target must not find itself. Each level joins the still-open
    places with the points of the 3 x 3 buckets around them and settles those whose best
    distances are inside the radius the neighbourhood guarantees; only the rest goes on to
    wider buckets. The first buckets are at most `first_deg` wide and so narrow that none is
    crowded. The last level spans the globe: points are dealt by hash and each share meets
    every place still open. Open places are checkpointed between levels, so the plan stays
    short and a lost executor costs one level.
    """
    keys = [target_key] if isinstance(target_key, str) else list(target_key)
    m = 2 if exclude_self else 1
    pts = cut_lineage(places(points, point_key, m).select("_ids", F.col("lat").alias("_plat"), F.col("lon").alias("_plon")))
    targets = targets.select(*keys, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).distinct()
    open_ = targets.select("lat", "lon").where("lat is not null and lon is not null").distinct()
    shares = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done, step = None, uncrowded(pts.select(F.col("_plat").alias("lat"), F.col("_plon").alias("lon")), first_deg)
    for level in range(levels):
        last = step >= 180.0 or level == levels - 1
        nlon = max(1, int(360.0 // step)) if not last else 1
        width = 360.0 / nlon

        def ky(lat):
            return F.floor((lat + 90.0) / step).cast("bigint") if not last else F.lit(0).cast("bigint")

        def kx(lon):
            return F.pmod(F.floor(F.pmod(lon, F.lit(360.0)) / width).cast("bigint"), F.lit(nlon))

        filed = pts.withColumn("_by", ky(F.col("_plat"))).withColumn("_bx", kx(F.col("_plon")) if not last else F.pmod(F.xxhash64("_ids"), F.lit(shares)))
        look = open_.withColumn("_ty", ky(F.col("lat"))).withColumn("_tx", kx(F.col("lon")))
        span = (-1, 0, 1) if nlon > 2 else range(nlon)
        around = F.array(*[F.struct((F.col("_ty") + dy).alias("_by"), F.pmod(F.col("_tx") + dx, F.lit(nlon)).alias("_bx"))
                           for dy in (-1, 0, 1) for dx in span]) if not last else F.transform(
            F.sequence(F.lit(0), F.lit(shares - 1)), lambda k: F.struct(F.lit(0).cast("bigint").alias("_by"), k.cast("bigint").alias("_bx")))
        look = look.withColumn("_k", F.explode(around)).select("lat", "lon", "_k.*")
        cell = F.concat_ws(":", "_by", "_bx")
        j = blocked_join(look.withColumn("_cell", cell).drop("_by", "_bx"), filed.withColumn("_cell", cell).drop("_by", "_bx"), "_cell", ["lat", "lon"], ["_plat", "_plon"])
        j = j.select("lat", "lon", S.haversine_km("lat", "lon", "_plat", "_plon").alias("km"), F.explode("_ids").alias("near_id"))
        # The best of each task go on, so no list holds a dense neighbourhood.
        j = j.withColumn("_r", F.row_number().over(W.partitionBy("lat", "lon").orderBy("km", "near_id"))).where(F.col("_r") <= m)
        best = j.groupBy("lat", "lon").agg(F.sort_array(F.collect_list(F.struct("km", "near_id"))).alias("_b"))
        # Nothing outside the 3 x 3 buckets is nearer than one bucket in either direction.
        cross = F.asin(F.cos(F.radians(F.col("lat"))) * math.sin(math.radians(min(width, 90.0)))) * S.EARTH_KM
        reach = F.least(F.lit(S.EARTH_KM * math.radians(step)), cross if nlon > 2 else F.lit(1e9))
        if last:
            settled = best
        else:
            best = cut_lineage(best.withColumn("_sure", (F.size("_b") >= m) & (F.element_at("_b", -1)["km"] <= reach)))
            settled = best.where("_sure").drop("_sure")
            open_ = cut_lineage(open_.join(settled.select("lat", "lon"), ["lat", "lon"], "left_anti"))
        done = settled if done is None else done.unionByName(settled)
        if last or open_.isEmpty():
            break
        step *= 4.0
    other = F.filter("_b", lambda x: x["near_id"] != F.col(keys[0])) if exclude_self else F.col("_b")
    return targets.join(done, ["lat", "lon"], "left").select(*keys, F.get(other, F.lit(0)).alias("_n")).select(*keys, "_n.near_id", "_n.km")


def k_nearest(points: DataFrame, k: int = 6, key: str = "station_id", first_km: float = 100.0) -> DataFrame:
    """k nearest neighbours in the plane scaled by the cosine of the mean latitude.

    Points of equal coordinates travel as one place with its k + 1 smallest keys, of which a
    point passes over itself. A place is settled once its last planar distance lies inside
    what the search radius guarantees; the rest goes on with four times the radius, up to the
    globe, so no neighbour is missed. The first radius is at most `first_km` and so short
    that no bucket is crowded, so dense networks never collect more than they need.
    """
    scale = F.cos(F.radians(points.agg(F.avg("lat")).scalar()))
    at = cut_lineage(places(points, key, k + 1).withColumn("_p", F.get("_ids", F.lit(0))))
    open_, done, radius = at.select("_p", "lat", "lon"), None, 111.0 * uncrowded(at, first_km / 111.0)
    while True:
        last = radius >= 20100.0
        p = neighbours_within(open_, at, radius, "_p").withColumn("_c", scale)
        p = p.select("a", "b", (F.col("lat_b") - F.col("lat_a")).alias("dy"), ((F.col("lon_b") - F.col("lon_a")) * F.col("_c")).alias("dx"))
        p = p.unionByName(open_.select(F.col("_p").alias("a"), F.col("_p").alias("b"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx")))
        # The best of each task go on, so no list holds a dense neighbourhood; the places kept hold the points wanted.
        ahead = F.row_number().over(W.partitionBy("a").orderBy("d2", "b"))
        p = p.withColumn("d2", F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).withColumn("_r", ahead).where(F.col("_r") <= k + 1)
        p = p.join(at.select(F.col("_p").alias("b"), "_ids"), "b").select("a", "d2", F.explode("_ids").alias("b"), "dy", "dx")
        g = p.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("d2", "b", "dy", "dx"))), 1, k + 1).alias("n"))
        # Beyond the radius a planar distance in degrees is at least radius * cos(mean lat) / km per degree.
        sure = (F.size("n") > k) & (F.sqrt(F.get("n", F.lit(k))["d2"]) <= scale * (radius / 111.2))
        g = g.withColumn("_sure", F.coalesce(sure, F.lit(False)))
        if last:
            settled = g
        else:
            g = cut_lineage(g)
            settled = g.where("_sure")
            open_ = cut_lineage(open_.join(settled.select(F.col("a").alias("_p")), "_p", "left_anti"))
        settled = settled.select(F.col("a").alias("_p"), "n")
        done = settled if done is None else done.unionByName(settled)
        if last or open_.isEmpty():
            break
        radius *= 4.0
    done = done.join(at.select("_p", "lat", "lon"), "_p")
    own = points.select(key, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).join(done, ["lat", "lon"])
    others = F.slice(F.filter("n", lambda x: x["b"] != F.col(key)), 1, k)
    return own.select(key, F.posexplode(others).alias("rank", "n")).select(key, "rank", "n.*")


def bearing_gap(points: DataFrame, k: int = 6, key: str = "station_id") -> DataFrame:
    """Largest circular gap between the bearings to the k nearest; 360 without neighbours."""
    n = k_nearest(points, k, key)
    b = F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(360.0))
    s = n.groupBy(key).agg(F.sort_array(F.collect_list(b)).alias("b"))
    inner = F.zip_with(F.slice("b", 1, F.size("b") - 1), F.slice("b", F.lit(2), F.size("b") - 1), lambda x, y: y - x)
    wrap = F.lit(360.0) - (F.element_at("b", -1) - F.element_at("b", 1))
    gap = s.select(key, F.greatest(F.coalesce(F.array_max(inner), F.lit(0.0)), wrap).alias("gap"))
    return points.select(key).join(gap, key, "left").select(key, F.coalesce("gap", F.lit(360.0)).alias("gap_deg"))


# ---- polygons -------------------------------------------------------------

EDGE = ("poly_id", "ring_id", "x1", "y1", "x2", "y2")


def points_in_polygons(points: DataFrame, edges: DataFrame, key, band_deg: float = 0.5, block: int = 4096) -> DataFrame:
    """Even-odd membership: inside a shell and inside no hole of the same polygon.

    Points meet edges on latitude bands, so a point is tested only against edges
    that cross its band; crossings are counted by chunk of a band and added up per ring,
    so a polygon of any number of edges, or a band of any number of points, splits over tasks.
    """
    keys = [key] if isinstance(key, str) else list(key)
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = edges.withColumn("_band", F.explode(F.sequence(
        F.floor(lo / band_deg).cast("bigint"), F.floor(hi / band_deg).cast("bigint"))))
    p = points.withColumn("_band", F.floor(F.col("lat") / band_deg).cast("bigint"))
    j = blocked_join(p, e, "_band", keys, EDGE, block)
    straddles = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    x_at = F.col("x1") + (F.col("lat") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    hits = j.where(straddles & (F.col("lon") < x_at))
    rings = hits.groupBy(*keys, "poly_id", "ring_id", "is_hole").agg((F.count("*") % 2).alias("odd")).where("odd = 1")
    poly = rings.groupBy(*keys, "poly_id").agg(F.max(F.when(~F.col("is_hole"), 1).otherwise(0)).alias("shell"),
                                               F.max(F.when(F.col("is_hole"), 1).otherwise(0)).alias("hole"))
    inside = poly.where("shell = 1 and hole = 0").select(*keys).distinct().withColumn("inside", F.lit(True))
    return points.join(inside, keys, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def near_polygon_edge(points: DataFrame, edges: DataFrame, key, tolerance: float, block: int = 4096) -> DataFrame:
    """Points within a tolerance in degrees of any edge, by the same latitude bands and chunks."""
    keys = [key] if isinstance(key, str) else list(key)
    band = max(tolerance * 4, 0.25)
    lo, hi = F.least("y1", "y2") - tolerance, F.greatest("y1", "y2") + tolerance
    e = edges.withColumn("_band", F.explode(F.sequence(F.floor(lo / band).cast("bigint"), F.floor(hi / band).cast("bigint"))))
    j = blocked_join(points.withColumn("_band", F.floor(F.col("lat") / band).cast("bigint")), e, "_band", keys, EDGE, block)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = ((F.col("lon") - F.col("x1")) * dx + (F.col("lat") - F.col("y1")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.least(F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    ex, ey = F.col("lon") - (F.col("x1") + t * dx), F.col("lat") - (F.col("y1") + t * dy)
    return j.where(ex * ex + ey * ey <= tolerance * tolerance).select(*keys).distinct()
