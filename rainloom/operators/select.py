"""Ranking, winners, and station selection."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rainloom.functions import draws as D, order as O, scalar as S
from rainloom.operators import joins as J
from rainloom.session import cut_lineage


def spearman(df: DataFrame, a: str, b: str, tie: str, last: str) -> DataFrame:
    """Correlation of ordinal ranks, ties broken by position."""
    r = O.ordinal_rank(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, tie, last, "_ra")
    r = O.ordinal_rank(r, b, tie, last, "_rb")
    return r.agg(F.corr("_ra", "_rb").alias("spearman"), F.count("*").alias("n"))


def winners(scores: DataFrame, keys, name: str, score: str, relative=0.01, absolute=0.0) -> DataFrame:
    """Rank per group with the winner and every practical tie within the tolerance."""
    w = W.partitionBy(*(keys or [F.lit(0)]))
    best = F.min(score).over(w)
    tol = F.greatest(F.lit(absolute), best * relative)
    return scores.withColumn("rank", F.row_number().over(w.orderBy(score, name))).withColumn("winner", F.col("rank") == 1).withColumn(
        "co_winner", F.col(score) - best <= tol)


def factorial_effects(scores: DataFrame, first: str, second: str, score: str, first_levels, second_levels) -> DataFrame:
    """Main effects and interaction of a 2 x 2 design; levels are (low, high) pairs."""
    def cell(i, j):
        here = (F.col(first) == first_levels[i]) & (F.col(second) == second_levels[j])
        return F.avg(F.when(here, F.col(score)))
    g = scores.agg(cell(0, 0).alias("a"), cell(0, 1).alias("b"), cell(1, 0).alias("c"), cell(1, 1).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    return g.select((((c + d) - (a + b)) / 2).alias("effect_first"), (((b + d) - (a + c)) / 2).alias("effect_second"),
                    ((d - c) - (b - a)).alias("interaction"))


def goodness(value: Column, objective) -> Column:
    """Higher is better for max, min or a numeric target."""
    if objective == "max":
        return value
    if objective == "min":
        return -value
    return -F.abs(value - float(objective))


def best_rows(long: DataFrame, objectives: dict, metric="metric", name="name", value="value") -> DataFrame:
    """Best row per metric column, first name on ties."""
    g = F.lit(None).cast("double")
    for m, o in objectives.items():
        g = F.when(F.col(metric) == m, goodness(F.col(value), o)).otherwise(g)
    d = long.withColumn("_g", g).where("_g is not null")
    r = F.row_number().over(W.partitionBy(metric).orderBy(F.desc("_g"), name))
    return d.withColumn("_r", r).where("_r = 1").select(metric, name, value)


def synergy(scores: DataFrame, single, combined: str, name="method", score="crps", keys=()) -> DataFrame:
    """Gain of the combined method over the better single source, in percent."""
    s = F.min(F.when(F.col(name).isin(list(single)), F.col(score)))
    c = F.max(F.when(F.col(name) == combined, F.col(score)))
    g = scores.groupBy(*keys).agg(s.alias("best_single"), c.alias("combined"))
    return g.withColumn("synergy_percent", S.ratio((F.col("best_single") - F.col("combined")) * 100.0, F.col("best_single")))


def fusion_gate(folds: DataFrame, case: str, diff: str, weight: str) -> DataFrame:
    """A case passes when its pooled difference is negative and it wins at least half of the folds."""
    g = folds.groupBy(case).agg((F.sum(F.col(diff) * F.col(weight)) / F.sum(weight)).alias("pooled"), F.count_if(F.col(diff) < 0).alias("wins"), F.count("*").alias("folds"))
    g = g.withColumn("passes", (F.col("pooled") < 0) & (F.col("wins") >= F.ceil(F.col("folds") / 2)))
    w = W.partitionBy("passes").orderBy("pooled", case)
    return g.withColumn("best", F.col("passes") & (F.row_number().over(w) == 1))


def random_folds(stations: DataFrame, n_folds: int, seed: int, key="station_id") -> DataFrame:
    """Near-equal folds over a hash order: what ntile gives, from ranks that no single task sorts."""
    d = stations.select(key).distinct().withColumn("_h", D.draw(seed, key))
    r = O.ordinal_rank(d, "_h", key, key, "_r").withColumn("_r", F.col("_r") - 1)
    n = d.agg(F.count("*")).scalar()
    size, longer = F.floor(n / n_folds), n % n_folds
    edge = longer * (size + 1)
    late = longer + F.floor((F.col("_r") - edge) / F.greatest(size, F.lit(1)))
    return r.select(key, F.when(F.col("_r") < edge, F.floor(F.col("_r") / (size + 1))).otherwise(late).cast("int").alias("fold"))


def member_subset(members, count: int, requested: int) -> Column:
    """Evenly spaced members at half-even rounded positions."""
    k = max(1, min(requested, count))
    idx = sorted({round(i * (count - 1) / (k - 1)) if k > 1 else 0 for i in range(k)})
    return F.array(*[F.get(S.col(members), F.lit(i)) for i in idx])


def distinct_arms(df: DataFrame, base: str, keys, method="method", members="members", tolerance=1e-8) -> DataFrame:
    """Arms whose members differ somewhere from the base arm."""
    b = df.where(F.col(method) == base).select(*keys, F.col(members).alias("_b"))
    j = df.where(F.col(method) != base).join(b, list(keys))
    gap = F.array_max(F.zip_with(members, "_b", lambda x, y: F.abs(x - y)))
    return j.groupBy(method).agg(F.max(gap).alias("max_gap")).withColumn("distinct", F.col("max_gap") > tolerance)


def duplicate_runs(scores: DataFrame, name: str, columns) -> DataFrame:
    """Runs that share their whole score signature."""
    g = scores.groupBy(*columns).agg(F.sort_array(F.collect_set(name)).alias("runs"))
    return g.where(F.size("runs") > 1).select(F.array_join("runs", "=").alias("runs"), F.size("runs").alias("n"))


# ---- farthest-point selection ---------------------------------------------

def _scaled(stations: DataFrame, key: str, mean_lat=None) -> DataFrame:
    """Planar coordinates with longitude scaled by the cosine of the mean latitude."""
    m = stations.agg(F.avg("lat")).scalar() if mean_lat is None else F.lit(float(mean_lat))
    return cut_lineage(stations.select(key, F.col("lat").alias("_y"), (F.col("lon") * F.cos(F.radians(m))).alias("_x")))


def _d2(row) -> Column:
    """Squared distance to nine digits: on a regular network many distances are equal, and rounding noise must not choose among them."""
    dy, dx = F.col("_y") - row["_y"], F.col("_x") - row["_x"]
    return F.floor((dy * dy + dx * dx) * 1e9 + 0.5) / 1e9


def _farthest(points: DataFrame, score: Column, key: str):
    """The row with the largest score, lowest key on ties: one aggregation, one row on the driver."""
    return points.agg(F.max_by(F.struct("*"), F.struct(score, -F.col(key))).alias("r")).first()["r"]


FRONT = 4096


def _front(state: DataFrame, key: str) -> tuple[dict, tuple | None]:
    """The FRONT most distant rows as arrays in the order of their keys, and distance and key of the last of them, which comes before every other row."""
    rows = state.orderBy(F.desc("_d"), key).limit(FRONT).collect()
    last = (rows[-1]["_d"], rows[-1][key]) if len(rows) == FRONT else None
    rows = sorted(rows, key=lambda r: r[key])
    return {c: np.array([r[c] for r in rows]) for c in (key, "_y", "_x", "_d", "_f")}, last


def _apart(at: dict, i: int):
    """_d2 of a row to all rows on the driver."""
    dy, dx = at["_y"] - at["_y"][i], at["_x"] - at["_x"][i]
    return np.floor((dy * dy + dx * dx) * 1e9 + 0.5) / 1e9


def _smallest(sizes: list, distances) -> int:
    """The smallest fold that is farthest away, the first of them on ties."""
    low = min(sizes)
    fold = max((i for i, n in enumerate(sizes) if n == low), key=lambda i: (distances[i], -i))
    sizes[fold] += 1
    return fold


def _nearer(state: DataFrame, picks: list, n_splits: int) -> DataFrame:
    """Distances of all rows to the ordered set and to every fold after picks (_y, _x, fold)."""
    p = state.sparkSession.createDataFrame(picks, "_y double, _x double, fold int")
    for i in range(n_splits):
        state = state.withColumn(f"_p{i}", p.where(F.col("fold") == i).agg(F.collect_list(F.struct("_y", "_x"))).scalar())
    to = [F.array_min(F.transform(f"_p{i}", _d2)) for i in range(n_splits)]
    f = F.array(*[F.least(F.get("_f", F.lit(i)), to[i]) for i in range(n_splits)])
    return state.withColumn("_f", f).withColumn("_d", F.least("_d", *to)).drop(*[f"_p{i}" for i in range(n_splits)])


TURNS = 16


def _settled(open_rows: DataFrame, key: str, side: float, reach: int) -> DataFrame:
    """The best row of each cell that no better row can precede within its own distance: key, _y, _x, _d, _cy, _cx.

    The diagonal of a cell is shorter than any distance in question, so of a cell only its best row can be next. A
    better row elsewhere lies in a cell whose best row is better too; if no such cell touches the circle around a
    row, its distance is final.
    """
    best = open_rows.groupBy("_cy", "_cx").agg(F.max_by(F.struct(key, "_y", "_x", "_d"), F.struct(F.col("_d"), -F.col(key))).alias("r")).select("_cy", "_cx", "r.*")
    offset = F.sequence(F.lit(-reach), F.lit(reach))
    asks = best.withColumn("_oy", F.explode(offset)).withColumn("_ox", F.explode(offset)).select(
        F.col(key).alias("_k"), F.col("_y").alias("_py"), F.col("_x").alias("_px"), F.col("_d").alias("_pd"), (F.col("_cy") + F.col("_oy")).alias("_cy"), (F.col("_cx") + F.col("_ox")).alias("_cx"))

    def gap(at, cell):
        return F.greatest(F.abs(F.col(at) - (F.col(cell) + 0.5) * side) - side / 2, F.lit(0.0))

    better = (F.col("_d") > F.col("_pd")) | ((F.col("_d") == F.col("_pd")) & (F.col(key) < F.col("_k")))
    touches = gap("_py", "_cy") * gap("_py", "_cy") + gap("_px", "_cx") * gap("_px", "_cx") <= F.col("_pd") + 1e-9
    blocked = asks.join(best, ["_cy", "_cx"]).where(better & touches).select(F.col("_k").alias(key))
    return best.join(blocked, key, "left_anti")


def farthest_order(stations: DataFrame, count: int | None = None, key="station_id", mean_lat=None) -> DataFrame:
    """Farthest-point order of all stations, or of the first `count`: key, rank from 1. Lower keys go first on ties.

    A row's distance to the rows before it only shrinks, so picks come in falling order of it, and a pick changes
    only rows nearer to it than its own distance. All rows without a better row within their distance are therefore
    settled in one pass: a pass writes them with their distances and applies them by a join on cells. Only the
    largest distance left and a count reach the driver; a pass settles at least one row, and as a rule a fixed share
    of what the halved distance holds. Rows at the place of an earlier pick come last. Keys must be numbers, each once.
    """
    p = _scaled(stations, key, mean_lat)
    c = p.agg(F.avg("_y").alias("_y"), F.avg("_x").alias("_x")).first()
    first = _farthest(p, _d2(c), key)
    if first is None:
        return p.select(key, F.lit(0).alias("rank")).limit(0)
    state = p.withColumn("_d", _d2(first)).withColumn("_v", F.when(F.col(key) == first[key], F.lit(1e300)))
    while True:
        left, n = state.agg(F.max(F.when(F.col("_v").isNull(), F.col("_d"))), F.count("_v")).first()
        # Nothing that is still open can come before a pick at a larger distance.
        if not left or (count is not None and n >= count and state.where(F.col("_v") > left).limit(count).count() >= count):
            break
        low = math.floor(left * 1e9 / 4) / 1e9
        side = 0.999 * math.sqrt(max(low, 5e-10) / 2)
        reach = math.ceil(math.sqrt(left + 1e-9) / side)
        celled = state.withColumn("_cy", F.floor(F.col("_y") / side)).withColumn("_cx", F.floor(F.col("_x") / side))
        new = _settled(celled.where(F.col("_v").isNull() & (F.col("_d") > low)), key, side, reach)
        offset = F.sequence(F.lit(-reach), F.lit(reach))
        near = new.withColumn("_cy", F.explode(F.transform(offset, lambda o: F.col("_cy") + o))).withColumn("_cx", F.explode(F.transform(offset, lambda o: F.col("_cx") + o)))
        # Picks lie apart, so a cell meets few of them; a cell that a third of all stations share is dealt over turns.
        near = near.groupBy("_cy", "_cx").agg(F.collect_list(F.struct(F.col(key).alias("k"), "_y", "_x", F.col("_d").alias("v"))).alias("_near"))
        near = near.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))))
        j = celled.withColumn("_turn", F.pmod(F.xxhash64(key), F.lit(TURNS)).cast("int")).join(near, ["_cy", "_cx", "_turn"], "left")
        closer = F.array_min(F.filter(F.transform("_near", lambda n: F.when(_d2(n) < n["v"], _d2(n))), lambda x: x.isNotNull()))
        own = F.exists("_near", lambda n: n["k"] == F.col(key))
        state = cut_lineage(j.select(key, "_y", "_x", F.when(own, F.col("_d")).otherwise(F.least("_d", closer)).alias("_d"), F.when(own, F.col("_d")).otherwise(F.col("_v")).alias("_v")))
    done = state.where(F.col("_v") > left) if left else state
    done = done.withColumn("_fall", -F.coalesce("_v", F.lit(0.0)))
    ranked = O.ordinal_rank(done, "_fall", key, key, "rank")
    return (ranked if count is None else ranked.where(F.col("rank") <= count)).select(key, F.col("rank").cast("int"))


def spread_holdout(stations: DataFrame, count: int, key="station_id", mean_lat=None) -> list:
    """The first `count` stations of the farthest-point order, as a list."""
    chosen = [r[key] for r in farthest_order(stations, count, key, mean_lat).orderBy("rank").collect()]
    if len(chosen) < count:
        raise ValueError(f"only {len(chosen)} stations to choose from")
    return chosen


def spread_folds(stations: DataFrame, n_splits: int, key="station_id") -> DataFrame:
    """Farthest-point order; each station joins the smallest fold it is farthest from. Keys must be numbers, each once.

    Stations of equal coordinates share their distances to the ordered set and to every fold, which are columns of a
    table of places. Distances only shrink, so a row of a front that still comes before the front's last row comes
    before every row outside it: one job settles many places. Once no place has a distance left, the other stations
    follow by key, a front a job, and only the first of a place in a fold changes a distance. When no place has a
    distance to any fold, the rest take the folds in turn by rank, without the driver, which never holds more than
    the fold sizes and a front.
    """
    p = _scaled(stations, key)
    at = p.groupBy("_y", "_x").agg(F.min(key).alias(key))
    c = p.agg(F.avg("_y").alias("_y"), F.avg("_x").alias("_x")).first()
    first = _farthest(p, _d2(c), key)
    if first is None:
        return p.select(key, F.lit(0).alias("fold")).limit(0)
    far, spark = float("inf"), stations.sparkSession
    # The seed has no predecessor: an infinite distance puts it at the head of the front.
    state = at.withColumn("_d", F.when(F.col(key) == first[key], F.lit(far)).otherwise(_d2(first)))
    state = cut_lineage(state.withColumn("_f", F.array(*[F.lit(far)] * n_splits)))
    sizes, parts, out = [0] * n_splits, [], f"{key} {dict(p.dtypes)[key]}, fold int"
    rest = p
    while True:
        front, last = _front(state.where("_d > 0"), key)
        open_, picks, d = np.ones(len(front[key]), bool), [], front["_d"]
        while open_.any():
            i = int(np.argmax(np.where(open_, d, -1.0)))
            if d[i] <= 0 or (picks and last and (-d[i], front[key][i]) > (-last[0], last[1])):
                break
            fold = _smallest(sizes, front["_f"][i])
            near, open_[i] = _apart(front, i), False
            d = np.minimum(d, near)
            front["_f"][:, fold] = np.minimum(front["_f"][:, fold], near)
            picks.append((front[key][i].item(), fold, front["_y"][i].item(), front["_x"][i].item()))
        if not picks:
            break
        parts.append(cut_lineage(spark.createDataFrame([x[:2] for x in picks], out)))
        # A picked place is at distance zero from itself and leaves the front.
        state = cut_lineage(_nearer(state, [(y, x, fold) for _, fold, y, x in picks], n_splits))
    placed = parts[0]
    for x in parts[1:]:
        placed = placed.unionByName(x)
    rest = cut_lineage(rest.join(placed, key, "left_anti"))
    while True:
        if state.where(F.array_max("_f") > 0).join(rest, ["_y", "_x"], "left_semi").isEmpty():
            break
        rows = rest.join(state.select("_y", "_x", "_f"), ["_y", "_x"]).orderBy(key).limit(FRONT).collect()
        spots = sorted({(r["_y"], r["_x"], *r["_f"]) for r in rows})
        front = {"_y": np.array([s[0] for s in spots]), "_x": np.array([s[1] for s in spots]), "_f": np.array([s[2:] for s in spots])}
        where, picks, folds = {s[:2]: i for i, s in enumerate(spots)}, [], []
        for r in rows:
            i = where[r["_y"], r["_x"]]
            fold = _smallest(sizes, front["_f"][i])
            folds.append((r[key], fold))
            if front["_f"][i, fold] > 0:
                front["_f"][:, fold] = np.minimum(front["_f"][:, fold], _apart(front, i))
                picks.append((r["_y"], r["_x"], fold))
        placed = placed.unionByName(cut_lineage(spark.createDataFrame(folds, out)))
        rest = rest.where(F.col(key) > rows[-1][key])
        state = cut_lineage(_nearer(state, picks, n_splits)) if picks else state
    low = [i for i in range(n_splits) if sizes[i] == min(sizes)]
    turn = F.col("_r") - 1 - len(low)
    fold = F.when(turn < 0, F.get(F.array(*[F.lit(i) for i in low]), (F.col("_r") - 1).cast("int"))).otherwise(F.pmod(turn, F.lit(n_splits))).cast("int")
    r = O.ordinal_rank(rest.select(key, F.lit(0.0).alias("_v"), F.floor(F.col(key) / FRONT).alias("_t")), "_v", "_t", key, "_r")
    return placed.unionByName(r.select(key, fold.alias("fold")))


def supported_holdout(stations: DataFrame, count: int, radius_km=75.0, max_gap_deg=200.0, neighbours=6, key="station_id", fewer=False) -> list:
    """Spread holdout among stations with a near neighbour and neighbours all around.

    Picks that lose their support are swapped for the best-supported unused candidate
    until every withheld station keeps an assimilated neighbour inside the radius, or
    as many swaps as candidates were made. A swapped-out station goes back to the pool,
    behind the others where candidates tie. Runs a few small jobs for each swap. Fewer
    candidates than asked for are an error, or with `fewer` all of them are withheld.
    """
    near = J.nearest_point(stations, stations, key, key, exclude_self=True).where(F.col("km") <= radius_km)
    gaps = J.bearing_gap(stations, neighbours, key).where(F.col("gap_deg") <= max_gap_deg)
    eligible = cut_lineage(stations.join(near.select(key), key, "left_semi").join(gaps.select(key), key, "left_semi"))
    n = eligible.count()
    count = min(count, n) if fewer else count
    if not count:
        return []
    if n < count:
        raise ValueError(f"only {n} stations qualify, fewer than the {count} to be withheld")
    mean_lat = stations.agg(F.avg("lat")).first()[0]
    chosen = spread_holdout(eligible, count, key, mean_lat)
    back: list = []

    def nearest(of: DataFrame, gone: list) -> DataFrame:
        left = stations.where(~F.col(key).isin(gone)) if gone else stations
        return J.nearest_point(of, left, key, key, exclude_self=True).select(key, "km")

    for _ in range(n + 1):
        sup = {r[key]: r["km"] for r in nearest(stations.where(F.col(key).isin(chosen)), chosen).collect() if r["km"] is not None}
        worst = max(chosen, key=lambda s: (sup.get(s, math.inf), -chosen.index(s)))
        if sup.get(worst, math.inf) <= radius_km:
            break
        free = eligible.where(~F.col(key).isin(chosen))
        turn = F.coalesce(F.array_position(F.array(*[F.lit(b) for b in back]), F.col(key)), F.lit(0)) if back else F.lit(0)
        best = nearest(free, [h for h in chosen if h != worst]).agg(F.min_by(key, F.struct("km", turn, key)).alias("s")).first()["s"]
        if best is None:
            raise ValueError("cannot leave every withheld station an assimilated neighbour")
        back = [b for b in back if b != best] + [worst]
        chosen[chosen.index(worst)] = best
    return sorted(chosen)
