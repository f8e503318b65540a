"""Transit statements on the shared relations of ``marts``; their SQL twins are written by hand in ``transit_sql``.

Results are rounded at the end, and ranks are taken on rounded values, so that they do not hang on the order
of additions. Percentiles are those of ``percentile_approx`` with an accuracy of 10,000: exact up to so many
values of a group, beyond that off by at most 1/10,000 of its rows in rank.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareline.functions import expr as E
from fareline.operators.aggregates import most_frequent, union_all
from fareline.operators.ranks import dense_ranks, exact_quantiles
from fareline.operators.windows import history_median
from fareline.plans.marts import HOURS, Mart, mart, seconds
from fareline.plans.transit_sql import SQL
from fareline.session import stored

RELATIONS: dict[str, Callable[[Mart], DataFrame]] = {}
CELL = ["route_id", "direction", "day_class", "period"]
PEAKS = ("am_peak", "pm_peak")
CONGESTION = ("traffic", "boarding", "road works")


def statement(f: Callable[[Mart], DataFrame]) -> Callable[[Mart], DataFrame]:
    """A relation of a mart; built once per mart where other statements read it, see ``of``."""
    RELATIONS[f.__name__] = f
    return f


def of(m: Mart, name: str) -> DataFrame:
    """The stored result of a statement that others build on."""
    kept = m.__dict__.setdefault("results", {})
    if name not in kept:
        kept[name] = stored(RELATIONS[name](m))
    return kept[name]


def r(c: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def n_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def p(value: str, share: float) -> Column:
    return F.percentile_approx(value, share, 10_000)


def mean_ratio(a: str, b: str) -> Column:
    """Mean of a / b over whole numbers, to 15 digits. Decimals are added, so it is the same in any order of the
    rows and a mean on the border of two roundings stays on it; 0 in b and nulls count on neither side."""
    each = F.try_divide(F.col(a).cast("decimal(28,18)"), F.col(b).cast("decimal(10,0)"))
    return F.round(F.avg(each.cast("decimal(28,18)")), 15).cast("double")


def hours() -> Column:
    return F.create_map([F.lit(x) for pair in HOURS.items() for x in pair])[F.col("period")]


OVER, UNDER = ("high", "over"), ("low",)


@statement
def an_holidays(m: Mart) -> DataFrame:
    return m.holidays


@statement
def an_trip_view(m: Mart) -> DataFrame:
    rounded = ("delay", "occupancy", "planned", "travelled", "arrival_late", "departure_late")
    return m.trips.select("trip_id", "route_id", "direction", "service_date", "service_id", "trip_type", "h", "ym", "dow", "period", "day_class", "holiday", "route_type", "distance_km", "boardings", "max_load", "denied", "load_stop", "capacity", "band", "ran", "headway", "runtime", "peak_share", "peak", *[r(c).alias(c) for c in rounded])


@statement
def an_ticket_view(m: Mart) -> DataFrame:
    return m.rides.select("ticket_id", "passenger_id", "route_id", "direction", "route_type", "service_date", "day_class", "day_type", "period", "entry_h", "entry_period", "exit_period", r(F.col("ride_s") / 60, 2).alias("ride_min"), r("factor", 6).alias("factor"), r("km", 8).alias("km"))


@statement
def an_expansion_factor(m: Mart) -> DataFrame:
    return m.factors.withColumn("factor", r("factor", 6))


@statement
def an_special_event_route_days(m: Mart) -> DataFrame:
    return m.route_days.select("route_id", "service_date", "dow", "day_type", r("demand", 2).alias("demand"), "n", r("expected", 2).alias("expected"), "against", F.col("holiday").isNotNull().alias("is_holiday"), "holiday", "extra_trips", "state")


@statement
def an_special_event_dates(m: Mart) -> DataFrame:
    spike, drop = F.col("state") == "spike", F.col("state") == "drop"
    d = m.route_days.groupBy("service_date").agg(F.count(F.lit(1)).alias("routes"), n_if(spike).alias("spikes"), n_if(drop).alias("drops"), F.array_join(F.array_sort(F.collect_set(F.when(spike, F.col("route_id")))), ",").alias("spiking"), F.max("holiday").alias("holiday"))
    return d.withColumn("city_wide", F.col("spikes") >= 3)


@statement
def an_normal_days(m: Mart) -> DataFrame:
    return m.normal_days


@statement
def an_route_demand(m: Mart) -> DataFrame:
    code = m.table("routes").where("route_id != ''").select("route_id", "route_code", "route_type", "launch_date").distinct()
    d = m.route_days.groupBy("route_id").agg(F.count(F.lit(1)).alias("days"), r(F.sum("demand"), 1).alias("total"), r(F.avg("demand"), 2).alias("per_day"), r(F.avg(E.ratio(F.col("measured"), F.col("operated")))).alias("coverage"))
    return dense_ranks(code.join(d, "route_id"), "per_day", "demand_rank")


def _taps_by_stop(m: Mart, entry: dict[str, str], out: dict[str, str]) -> DataFrame:
    """Entries and exits of a stop by further keys, in one pass: (keys, taps_in, taps_out, est_in, est_out)."""
    keys = list(entry)

    def side(of: dict[str, str], is_in: bool) -> Column:
        return F.struct(*[F.col(c).alias(k) for k, c in of.items()], F.lit(is_in).alias("is_in"))

    both = m.rides.select("factor", F.explode(F.array(side(entry, True), side(out, False))).alias("s")).select("factor", "s.*").where("stop_id != ''")
    into = F.col("is_in")
    sums = [n_if(into).alias("taps_in"), n_if(~into).alias("taps_out"), F.coalesce(F.sum(F.when(into, F.col("factor"))), F.lit(0.0)).alias("est_in"), F.coalesce(F.sum(F.when(~into, F.col("factor"))), F.lit(0.0)).alias("est_out")]
    return both.groupBy(*keys).agg(*sums)


@statement
def an_stop_usage(m: Mart) -> DataFrame:
    g = _taps_by_stop(m, {"stop_id": "entry_stop_id"}, {"stop_id": "exit_stop_id"})
    span = m.trips.agg(F.struct(F.min("service_date").alias("a"), F.max("service_date").alias("b"))).scalar()
    first, last = span.getField("a"), span.getField("b")
    s = m.table("stops").select("stop_id", "stop_name", "zone", "stop_type", (F.datediff(last, F.greatest(F.coalesce("opened_date", first), first)) + 1).alias("days_open"))
    u = s.join(g, "stop_id", "left").fillna(0, ["taps_in", "taps_out", "est_in", "est_out"])
    per_day = {"in_per_day": F.col("est_in"), "out_per_day": F.col("est_out"), "turnover": F.col("est_in") + F.col("est_out")}
    return dense_ranks(u.select("stop_id", "stop_name", "zone", "stop_type", "days_open", "taps_in", "taps_out", *[r(c / F.col("days_open"), 2).alias(k) for k, c in per_day.items()]), "turnover", "usage_rank")


def _days_of(m: Mart, *keys: str) -> DataFrame:
    return m.trips.groupBy(*keys).agg(F.countDistinct("service_date").alias("days"))


@statement
def an_peak_hours(m: Mart) -> DataFrame:
    g = m.trips.groupBy("day_class", "h").agg(F.countDistinct("service_date").alias("days"), F.count(F.lit(1)).alias("trips"), F.count("boardings").alias("measured"), F.sum("boardings").alias("b"), n_if(F.col("ran")).alias("operated"), F.avg("occupancy").alias("o"), F.avg(F.col("peak").cast("double")).alias("k"))
    return g.select("day_class", "h", "days", "trips", "measured", r(E.ratio(F.col("b"), F.col("measured"))).alias("per_trip"), r(E.ratio(F.col("b") * F.col("operated"), F.col("measured") * F.col("days"))).alias("per_day"), r("o").alias("occupancy"), r("k").alias("peak_rate"))


@statement
def an_stop_patterns(m: Mart) -> DataFrame:
    g = _taps_by_stop(m, {"stop_id": "entry_stop_id", "day_class": "day_class", "period": "entry_period"}, {"stop_id": "exit_stop_id", "day_class": "day_class", "period": "exit_period"})
    g = g.withColumns({"a": r("est_in"), "b": r("est_out")}).join(_days_of(m, "day_class"), "day_class")
    pattern = F.when(F.col("a") >= 1.5 * F.col("b"), "origin").when(F.col("b") >= 1.5 * F.col("a"), "destination").otherwise("balanced")
    return g.select("stop_id", "day_class", "period", r(F.col("a") / F.col("days"), 6).alias("in_per_day"), r(F.col("b") / F.col("days"), 6).alias("out_per_day"), r((F.col("a") - F.col("b")) / F.col("days"), 6).alias("net_per_day"), pattern.alias("pattern"))


@statement
def an_od_pairs(m: Mart) -> DataFrame:
    days = m.trips.agg(F.countDistinct("service_date")).scalar()
    g = m.rides.where("exit_stop_id != ''").groupBy("entry_stop_id", "exit_stop_id").agg(F.count(F.lit(1)).alias("journeys"), r(F.sum("factor"), 3).alias("est"), r(F.avg("km"), 3).alias("km"), r(F.avg("ride_s") / 60, 2).alias("ride_min"), F.countDistinct("route_id").alias("routes"))
    return dense_ranks(g.withColumn("per_day", r(F.col("est") / days)), "est", "flow_rank")


@statement
def an_load_profile(m: Mart) -> DataFrame:
    keys = {"route_id": "route_id", "direction": "direction"}
    g = _taps_by_stop(m, keys | {"stop_id": "entry_stop_id"}, keys | {"stop_id": "exit_stop_id"})
    way = m.places.join(g, ["route_id", "direction", "stop_id"], "left").fillna(0, ["est_in", "est_out"]).join(_days_of(m, "route_id"), "route_id")
    on = F.sum(F.col("est_in") - F.col("est_out")).over(Window.partitionBy("route_id", "direction").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return way.select("route_id", "direction", "seq", "stop_id", "place", r(F.col("est_in") / F.col("days")).alias("in_per_day"), r(F.col("est_out") / F.col("days")).alias("out_per_day"), r(on / F.col("days")).alias("on_board"))


@statement
def an_od_matrix(m: Mart) -> DataFrame:
    keys = ["entry_stop_id", "exit_stop_id", "route_id", "route_type", "direction", "entry_period", "day_class", "day_type"]
    g = m.rides.groupBy(*keys).agg(F.count(F.lit(1)).alias("journeys"), r(F.sum("factor"), 3).alias("est"), F.countDistinct("service_date").alias("days"))
    names = m.table("stops").select("stop_id", "stop_name")
    for end in ("entry", "exit"):
        g = g.join(names.select(F.col("stop_id").alias(f"{end}_stop_id"), F.col("stop_name").alias(f"{end}_stop")), f"{end}_stop_id", "left")
    return g


@statement
def an_peak_period_summary(m: Mart) -> DataFrame:
    c = m.trips.groupBy("day_class", "period").agg(F.count(F.lit(1)).alias("trips"), n_if(F.col("ran")).alias("operated"), F.count("boardings").alias("measured"), F.sum("boardings").alias("b"), F.avg("occupancy").alias("o"), F.count("peak").alias("judged"), F.avg(F.col("peak").cast("double")).alias("k"))
    e = c.join(_days_of(m, "day_class"), "day_class").withColumn("per_day", E.ratio(F.col("b") * F.col("operated"), F.col("measured") * F.col("days")))
    part = E.ratio(F.col("per_day"), F.sum("per_day").over(Window.partitionBy("day_class")))
    return e.select("day_class", "period", "days", "trips", "measured", "judged", r(E.ratio(F.col("b"), F.col("measured"))).alias("per_trip"), r("per_day").alias("per_day"), r(part).alias("share_of_day"), r("o").alias("occupancy"), r("k").alias("peak_rate"), (r("k") >= 0.5).alias("is_peak"))


@statement
def an_stop_hours(m: Mart) -> DataFrame:
    h = m.rides.where("entry_h is not null").groupBy(F.col("entry_stop_id").alias("stop_id"), "day_class", F.col("entry_h").alias("h")).agg(F.count(F.lit(1)).alias("taps"), F.sum("factor").alias("est"))
    d = h.join(_days_of(m, "day_class"), "day_class").withColumn("per_day", r(F.col("est") / F.col("days")))
    w = Window.partitionBy("stop_id", "day_class")  # at most 24 hours
    z = r(F.try_divide(F.col("per_day") - F.avg("per_day").over(w), F.stddev("per_day").over(w)), 3)
    return d.withColumn("z", z).select("stop_id", "day_class", "h", "taps", "per_day", "z", F.coalesce(F.col("z") >= 1.5, F.lit(False)).alias("is_peak"))


@statement
def an_persistent_overcrowding(m: Mart) -> DataFrame:
    cell = ["route_id", "direction", "dow", "period"]
    hit = F.max(F.when(F.col("band").isin(*OVER), 1).otherwise(0))
    d = m.trips.where("band is not null").groupBy(*cell, "service_date").agg(hit.alias("hit"), F.max("occupancy").alias("most"))
    d = d.join(m.normal_days.withColumn("normal", F.lit(True)), ["route_id", "service_date"], "left").withColumn("normal", F.col("normal").isNotNull())
    normal = F.col("normal")
    c = d.groupBy(*cell).agg(n_if(normal).alias("days"), F.sum(F.when(normal, F.col("hit")).otherwise(0)).alias("overloaded"), F.sum(F.when(~normal, F.col("hit")).otherwise(0)).alias("on_event_days"), r(F.max(F.when(normal, F.col("most")))).alias("most"))
    part = F.try_divide(F.col("overloaded"), F.col("days"))
    pattern = F.when(F.col("days") < 4, "unknown").when((F.col("overloaded") >= 4) & (part >= 0.5), "persistent").when(F.col("overloaded") == 0, "none").when(F.col("overloaded") <= 2, "one_off").otherwise("recurring")
    return c.select(*cell, "days", "overloaded", "on_event_days", "most", r(part).alias("part"), pattern.alias("pattern"))


def _supply(m: Mart) -> DataFrame:
    """Service and use by route, direction, day class and period: what the three statements on supply read."""
    share = E.share(F.col("band").isin(*OVER), F.col("band"))
    return m.trips.groupBy(*CELL).agg(
        F.max("distance_km").alias("distance_km"), F.countDistinct("service_date").alias("days"), F.count(F.lit(1)).alias("trips"), n_if(F.col("ran")).alias("operated"), F.count("occupancy").alias("measured"), mean_ratio("max_load", "capacity").alias("occupancy"), p("occupancy", 0.9).alias("p90"),
        F.avg("boardings").alias("per_trip"), share.alias("overload"), F.avg(F.col("peak").cast("double")).alias("peak_rate"), F.try_divide(F.sum("arrival_s"), F.count("arrival_s") * 60.0).alias("arrival_late"),
    )


@statement
def an_underutilized(m: Mart) -> DataFrame:
    c = _supply(m).withColumns({"an_hour": F.try_divide(F.col("operated"), F.col("days") * hours()), "per_km": r(E.ratio(F.col("per_trip"), F.col("distance_km")), 6)})
    middle = c.groupBy("period").agg(F.expr("percentile_disc(0.5) within group (order by per_km)").alias("middle"))  # exact: of cells, not rows
    empty = (F.col("occupancy") < 0.3) & (F.col("p90") < 0.5) & (F.col("per_km") < F.col("middle"))
    state = F.when(F.col("measured") < 5, "unknown").when(empty & (F.col("an_hour") >= 0.1), "underused").when(empty, "rare_and_empty").otherwise("used")
    rounded = ("an_hour", "occupancy", "p90", "per_trip")
    return c.join(middle, "period").select(*CELL, "distance_km", "days", "operated", "measured", "per_km", "middle", state.alias("state"), *[r(x).alias(x) for x in rounded])


@statement
def an_service_frequency(m: Mart) -> DataFrame:
    c = _supply(m).withColumn("an_hour", F.col("trips") / (F.col("days") * hours()))
    state = F.when(F.col("measured") < 5, "unknown").when((r("occupancy", 6) >= 0.85) | (r("overload", 6) >= 0.2), "too_little").when((F.col("occupancy") < 0.3) & (F.col("p90") < 0.5) & (F.col("an_hour") >= 0.1), "too_much").otherwise("matched")
    rounded = ("an_hour", "per_trip", "occupancy", "p90", "overload", "peak_rate", "arrival_late")
    return c.select(*CELL, "days", "trips", "operated", "measured", state.alias("state"), *[r(x).alias(x) for x in rounded])


@statement
def an_demand_supply_gap(m: Mart) -> DataFrame:
    load, size = F.col("max_load"), F.col("capacity")
    c = m.trips.where(F.col("ran")).groupBy(*CELL).agg(F.countDistinct("service_date").alias("days"), F.count(F.lit(1)).alias("operated"), F.count(load).alias("measured"), F.avg(size).alias("have"), F.sum(F.when(size.isNotNull(), load)).alias("loads"), F.sum(F.when(load.isNotNull(), size)).alias("seats"), p("max_load", 0.9).alias("p90_load"), F.avg("denied").alias("denied"))
    types = m.table("vehicles").where("capacity_total is not null").groupBy("vehicle_type").agg(F.max("capacity_total").alias("size"))
    # a few vehicle types, smallest first, carried along as one value instead of a join by inequality
    sizes = types.agg(F.sort_array(F.collect_list(F.struct("size", "vehicle_type")))).scalar()
    g = c.withColumns({"an_hour": F.col("operated") / (F.col("days") * hours()), "utilisation": E.ratio(F.col("loads"), F.col("seats")), "need": F.col("p90_load") / 0.85, "sizes": sizes})
    g = g.withColumns({"fit": F.get(F.filter("sizes", lambda s: s["size"] >= F.col("need")), F.lit(0)), "largest": F.element_at("sizes", -1)["size"]})
    full, empty = (r("utilisation", 6) >= 0.9) | (r("denied", 6) >= 1), r("utilisation", 6) < 0.3
    gap = F.when((F.col("measured") < 5) | F.col("utilisation").isNull(), "unknown").when(full, "excess_demand").when(empty, "excess_supply").otherwise("balanced")
    g = g.withColumns({"gap": gap, "fits": F.col("fit.vehicle_type"), "size": F.col("fit.size")})
    wants, larger = F.col("gap") == "excess_demand", F.coalesce(F.col("size") > F.col("have"), F.lit(False))
    suggestion = F.when(wants & larger, "larger").when(wants, "add_trips").when((F.col("gap") == "excess_supply") & (F.col("size") < F.col("have")), "smaller").when(F.col("gap") == "excess_supply", "fewer_trips").otherwise("keep")
    wanted = F.ceil(r(F.col("an_hour") * F.col("p90_load") / (0.85 * F.col("largest")), 6))
    extra = F.when(wants & ~larger, F.greatest(F.lit(0.0), wanted - F.col("an_hour")))
    return g.select(*CELL, "days", "operated", "measured", "p90_load", "fits", "size", "gap", suggestion.alias("suggestion"), r(extra).alias("extra_trips"), *[r(x).alias(x) for x in ("an_hour", "have", "utilisation", "denied", "need")])


#: Scores of a route and their weights. Ranked ones are percent ranks of a median of daily values, from low to
#: high (1) or from high to low (-1); the others come from the medians alone.
RANKED = {"demand": ("demand", 1), "punctuality": ("on_time", 1), "delay": ("late", -1), "travel": ("stretch", -1), "reliability": ("spread", -1), "load": ("p90", -1)}
WEIGHTS = {"demand": 0.2, "occupancy": 0.15, "punctuality": 0.15, "delay": 0.1, "travel": 0.1, "reliability": 0.1, "load": 0.05, "use": 0.05, "crowding": 0.1}


@statement
def an_route_performance(m: Mart) -> DataFrame:
    """Nine scores per route from medians of its normal days, a weighted mean, a class and the reason for it."""
    band = F.col("band")
    severity = F.avg(F.when(band == "over", 1.0).when(band == "high", 0.5).when(band.isNotNull(), 0.0))
    t = m.trips.join(m.normal_days, ["route_id", "service_date"], "left_semi")
    day = t.groupBy("route_id", "service_date").agg(
        F.avg("occupancy").alias("occupancy"), p("occupancy", 0.9).alias("p90"), E.share(F.col("arrival_late").between(-1, 5), F.col("arrival_late")).alias("on_time"), E.share(F.col("delay") >= 5, F.col("delay")).alias("late"),
        F.avg(E.ratio(F.col("travelled_s"), F.col("planned_s"))).alias("stretch"), F.stddev("arrival_s").alias("spread"), E.share(band.isin(*UNDER), band).alias("under"), E.share(band.isin(*OVER), band).alias("over"), severity.alias("severity"), F.count("occupancy").alias("measured"), n_if(F.col("ran")).alias("operated"),
    )
    medians = ("occupancy", "p90", "on_time", "late", "stretch", "spread", "under", "over", "severity")
    day = day.select("route_id", "measured", "operated", *[r(x, 6).alias(x) for x in medians])
    a = day.groupBy("route_id").agg(F.count(F.lit(1)).alias("days"), E.ratio(F.sum("measured"), F.sum("operated")).alias("coverage"), *[p(x, 0.5).alias(x) for x in medians])
    demand = m.route_days.join(m.normal_days, ["route_id", "service_date"], "left_semi").groupBy("route_id").agg(r(p("demand", 0.5), 2).alias("demand"))
    cells = of(m, "an_persistent_overcrowding")
    known, lasting = F.col("pattern") != "unknown", F.col("pattern") == "persistent"
    c = cells.groupBy("route_id").agg(n_if(lasting).alias("cells"), n_if(F.col("pattern").isin("one_off", "recurring")).alias("other_cells"), r(F.coalesce(E.ratio(n_if(lasting), n_if(known)), F.lit(0.0)), 6).alias("cell_share"), F.array_join(F.array_sort(F.collect_set(F.when(lasting, F.col("direction").cast("string")))), ",").alias("directions"))
    spots = t.where(band.isin(*OVER) & F.col("load_stop").isNotNull()).groupBy("route_id", "load_stop").agg(F.count(F.lit(1)).alias("n"))
    spot = spots.groupBy("route_id").agg(F.max_by("load_stop", F.struct("n", "load_stop")).alias("hot_stop"), r(E.ratio(F.max("n"), F.sum("n"))).alias("hot_share"))
    odd = m.route_days.groupBy("route_id").agg(n_if(F.col("state").isin("spike", "drop") | F.col("holiday").isNotNull()).alias("odd_days"))
    b = reduce(lambda x, y: x.join(y, "route_id", "left"), [m.table("routes").where("route_id != ''").select("route_id", "route_type").distinct(), a, demand, c, spot, odd]).fillna(0, ["days", "cells", "other_cells", "cell_share", "odd_days"])
    b = b.withColumn("eligible", F.coalesce((F.col("days") >= 20) & (F.col("coverage") >= 0.5) & F.col("demand").isNotNull() & F.col("occupancy").isNotNull(), F.lit(False)))
    b = b.withColumn("penalty", r(0.5 * F.col("severity") + 0.5 * F.col("cell_share"), 6))

    def place(of: str, sign: int = 1) -> Column:  # one row per route
        return F.percent_rank().over(Window.partitionBy("eligible").orderBy((F.col(of) * sign).asc_nulls_first()))

    scores = {k: 100 * place(x, sign) for k, (x, sign) in RANKED.items()}
    scores |= {"occupancy": 100 * F.greatest(F.lit(0.0), 1 - F.abs(F.col("occupancy") - 0.7) / 0.7), "use": 100 * (1 - F.col("under")), "crowding": 100 * F.greatest(F.lit(0.0), 1 - F.col("penalty") / 0.5)}
    s = b.withColumns({f"{k}_score": r(F.when(F.col("eligible"), x), 2) for k, x in scores.items()})
    s = s.withColumns({"score": r(sum((w * F.col(f"{k}_score") for k, w in WEIGHTS.items()), F.lit(0.0)), 3), "steady": r((F.col("punctuality_score") + F.col("delay_score") + F.col("reliability_score")) / 3, 3)})
    s = s.withColumns({"score_place": r(F.when(F.col("eligible"), place("score"))), "steady_place": r(F.when(F.col("eligible"), place("steady")))})
    crowded, shaky = F.col("over") >= 0.2, (F.col("demand_score") >= 70) & (F.col("steady_place") <= 0.3)
    idle = (F.col("steady_place") >= 0.7) & ((F.col("demand_score") <= 30) | (F.col("under") >= 0.5))
    kind = F.when(~F.col("eligible"), "too_little_known").when(F.col("score_place") >= 0.7, "strong").when(F.col("score_place") <= 0.3, "weak").when(crowded, "crowded").when(shaky, "wanted_but_shaky").when(idle, "steady_but_idle").otherwise("mixed")
    s = s.withColumn("class", kind)
    said = F.when(~F.col("eligible"), F.concat_ws("; ", F.when(F.col("days") < 20, F.concat(F.lit("normal days "), F.col("days"))), F.when(F.col("coverage") < 0.5, F.lit("few trips counted")))).when(F.col("class").isin("strong", "weak"), "place of the score").when(F.col("class") == "crowded", "overloads of the median day").when(F.col("class") == "mixed", "no criterion of the middle band").otherwise("demand against steadiness")
    scope = F.when(F.col("cells") > 0, F.when(F.col("directions").contains(","), "both").otherwise(F.concat(F.lit("direction "), "directions")))
    where = F.when(F.col("cells") > 0, F.when(F.col("hot_share") >= 0.6, "one_stop").otherwise("whole_route"))
    return s.select(
        "route_id", "route_type", "eligible", "days", "odd_days", r("coverage").alias("coverage"), "demand", *[r(x).alias(x) for x in medians], "cells", "other_cells", "cell_share", "penalty", *[f"{k}_score" for k in WEIGHTS], "score", "score_place", "steady_place", "class",
        said.alias("reason"), (F.col("cells") > 0).alias("overcrowded"), scope.alias("scope"), where.alias("location"), "hot_stop", "hot_share",
    )


def _late_records(m: Mart) -> DataFrame:
    d = m.table("delays").where("delay_minutes between -60 and 600 and stop_id != ''").select("delay_id", "trip_id", "stop_id", "delay_minutes", F.lower(F.trim("delay_reason")).alias("why")).distinct()
    return d.join(m.trips.select("trip_id", "route_id", "direction", "route_type", "period"), "trip_id")


@statement
def an_delay_by_stop(m: Mart) -> DataFrame:
    d = _late_records(m)
    a = d.groupBy("stop_id").agg(F.count(F.lit(1)).alias("records"), r(F.avg("delay_minutes"), 6).alias("mean_delay"), n_if(F.col("why").isin(*CONGESTION)).alias("congestion"))
    main = most_frequent(d, ["stop_id"], "why", "main_reason").drop("main_reason_n")
    ops = m.trips.groupBy("route_id", "direction").agg(n_if(F.col("ran")).alias("operated"))
    e = m.places.join(ops, ["route_id", "direction"]).groupBy("stop_id").agg(F.sum("operated").alias("served"), F.countDistinct("route_id").alias("routes"))
    j = m.table("stops").select("stop_id", "stop_name", "zone", "stop_type").join(e, "stop_id").join(a, "stop_id", "left").join(main, "stop_id", "left").fillna(0, ["records", "congestion"])
    j = j.withColumns({"record_rate": r(E.ratio(F.col("records"), F.col("served")), 6), "congestion_rate": r(E.ratio(F.col("congestion"), F.col("served")), 6)})
    j = j.withColumn("place", r(F.percent_rank().over(Window.orderBy(F.asc_nulls_first("congestion_rate")))))  # a row per stop
    return j.withColumn("bottleneck", F.coalesce((F.col("place") >= 0.95) & (F.col("congestion") >= 3), F.lit(False)))


@statement
def an_delay_position(m: Mart) -> DataFrame:
    d = _late_records(m).join(m.places.select("route_id", "direction", "stop_id", "seq", "stops"), ["route_id", "direction", "stop_id"])
    decile = F.least(F.lit(9), F.expr("10 * (seq - 1) div greatest(stops - 1, 1)")).cast("int")
    return d.groupBy("route_type", "period", decile.alias("decile")).agg(F.count(F.lit(1)).alias("records"), r(F.avg("delay_minutes"), 6).alias("mean_delay"))


@statement
def an_stop_performance(m: Mart) -> DataFrame:
    days = m.trips.agg(F.countDistinct("service_date")).scalar()
    usage, late, patterns = (of(m, x) for x in ("an_stop_usage", "an_delay_by_stop", "an_stop_patterns"))
    weekday = patterns.where("day_class = 'weekday'").groupBy("stop_id").agg(*[r(F.sum(F.when(F.col("period").isin(*of_), F.col("in_per_day"))), 6).alias(k) for k, of_ in (("am_peak", ("am_peak",)), ("midday", ("midday",)), ("pm_peak", ("pm_peak",)), ("offpeak", ("early", "evening")))])
    late = late.select("stop_id", "routes", "records", "mean_delay", "record_rate", "congestion_rate", "main_reason", "bottleneck", r(F.col("served") / days).alias("served_per_day"))
    j = usage.select("stop_id", "stop_name", "zone", "in_per_day", "out_per_day", "turnover", "usage_rank").join(late, "stop_id", "left").join(weekday, "stop_id", "left")
    return j.withColumns({"bottleneck": F.coalesce("bottleneck", F.lit(False)), "per_served": r(E.ratio(F.col("turnover"), F.col("served_per_day")), 3)})


@statement
def an_schedule_adherence(m: Mart) -> DataFrame:
    late = F.col("arrival_s")
    a = m.trips.groupBy("route_id", "day_class").agg(F.count(F.lit(1)).alias("trips"), n_if(F.col("trip_status") == "cancelled").alias("missed"), F.count(late).alias("arrived"), n_if(late <= -120).alias("early"), n_if((late > -120) & (late < 300)).alias("on_time"), n_if(late >= 300).alias("late"))
    h = m.spark.sql(headway_sql()).join(m.trips.select("trip_id", "day_class"), "trip_id").where("state != 'not_judged'")
    i = h.groupBy("route_id", "day_class").agg(F.count(F.lit(1)).alias("intervals"), n_if(F.col("state").isin("bunched", "gap")).alias("irregular"))
    j = a.join(i, ["route_id", "day_class"], "left")
    shares = {"early": "arrived", "on_time": "arrived", "late": "arrived", "missed": "trips", "irregular": "intervals"}
    return j.select("*", *[r(E.ratio(F.col(x), F.col(y))).alias(f"{x}_share") for x, y in shares.items()])


def headway_sql() -> str:
    from fareline.plans.analytics import STATEMENTS
    from fareline.plans.dialect import Spark

    return STATEMENTS["an_headway"](Spark())


def _signal(df: DataFrame, kind: str, entity: str, name: str, observed: Column, expected: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.lit(entity).alias("entity_type"), F.col(name).alias("entity"), "service_date", r(observed.cast("double"), 3).alias("observed"), r(expected.cast("double"), 3).alias("expected"), detail.alias("detail"))


@statement
def an_anomalies(m: Mart) -> DataFrame:
    none, route = F.lit(None), F.col("route_id")
    t, days = m.trips, m.route_days
    stretch = E.ratio(F.col("travelled_s"), F.col("planned_s"))
    found = [_signal(days.where(F.col("state") == x), f"demand_{x}", "route", "route_id", F.col("demand"), F.col("expected"), F.coalesce("holiday", F.lit(""))) for x in ("spike", "drop")]
    found += [
        _signal(t.where("delay >= 60"), "long_delay", "trip", "trip_id", F.col("delay"), none, route),
        _signal(t.where("max_load > boardings"), "load_over_boardings", "trip", "trip_id", F.col("max_load"), F.col("boardings"), route),
        _signal(t.where("denied > 0 and occupancy < 0.5"), "denied_though_empty", "trip", "trip_id", F.col("denied"), F.col("occupancy"), route),
        _signal(t.where((stretch < 0.5) | (stretch > 2)), "travel_time", "trip", "trip_id", F.col("travelled_s"), F.col("planned_s"), route),
    ]
    # taps at stops that the trip's route does not serve
    served = m.places.select("route_id", "stop_id", F.lit(True).alias("on")).distinct()
    k = m.rides
    for end in ("entry", "exit"):
        k = k.join(served.select("route_id", F.col("stop_id").alias(f"{end}_stop_id"), F.col("on").alias(f"{end}_on")), ["route_id", f"{end}_stop_id"], "left")
    off = F.concat_ws(" ", route, F.when(F.col("entry_on").isNull(), F.concat(F.lit("entry "), "entry_stop_id")), F.when(F.col("exit_on").isNull(), F.concat(F.lit("exit "), "exit_stop_id")))
    found.append(_signal(k.where("entry_on is null or exit_on is null"), "stop_not_on_route", "ticket", "ticket_id", none, none, off))
    # a second tap at the same stop within two minutes, or before the ride before has ended
    w = Window.partitionBy("passenger_id").orderBy("entry_time", "ticket_id")
    k = m.rides.where("passenger_id != '' and entry_time is not null").withColumns({"in_before": F.lag("entry_time").over(w), "out_before": F.lag("exit_time").over(w), "stop_before": F.lag("entry_stop_id").over(w)})
    since = seconds("in_before", "entry_time")
    overlap = F.col("entry_time") < F.col("out_before")
    again = ((since <= 120) & (F.col("entry_stop_id") == F.col("stop_before"))) | overlap
    found.append(_signal(k.where(again), "repeated_tap", "ticket", "ticket_id", since, none, F.when(overlap, "overlap").otherwise("repeat")))
    # a stop's day against the median of its weekdays before
    d = m.rides.groupBy(F.col("entry_stop_id").alias("stop_id"), "service_date", "dow", "day_no").agg(F.count(F.lit(1)).alias("taps"))
    d = history_median(d, ["stop_id", "dow"], "day_no", "taps", -56, -7, "usual", least=4, lower=True).where("usual >= 3 and (taps >= 3 * usual or taps <= 0.2 * usual)")
    found.append(_signal(d, "stop_activity", "stop", "stop_id", F.col("taps"), F.col("usual"), F.lit("")))
    return union_all(found)


@statement
def an_anomaly_summary(m: Mart) -> DataFrame:
    return of(m, "an_anomalies").groupBy("kind").agg(F.count(F.lit(1)).alias("signals"), F.countDistinct("entity").alias("entities"), F.countDistinct("service_date").alias("days"))


@statement
def an_passenger_segments(m: Mart) -> DataFrame:
    k = m.rides.where("passenger_id != ''")
    part = {"weekday": F.col("day_class") == "weekday", "weekend": F.col("day_class") == "weekend", "peak": F.coalesce(F.col("entry_period").isin(*PEAKS), F.lit(False))}
    span = F.greatest(F.lit(1.0), (F.datediff(F.max("service_date"), F.min("service_date")) + 1) / 7.0)
    g = k.groupBy("passenger_id").agg(F.count(F.lit(1)).alias("rides"), F.countDistinct("service_date").alias("days"), span.alias("weeks"), *[r(F.avg(x.cast("double"))).alias(n) for n, x in part.items()], r(F.avg("km")).alias("km"), r(F.sum("factor"), 2).alias("stands_for"))
    kind = most_frequent(k, ["passenger_id"], "fare_category", "category").drop("category_n")
    g = stored(g)
    g = g.join(kind, "passenger_id", "left").withColumns({"a_week": r(F.col("days") / F.col("weeks"), 3), "long_km": exact_quantiles(g, [], "km", [0.8]).scalar()})
    segment = F.when((F.col("a_week") >= 3) & (F.col("weekday") >= 0.8), "commuter").when(F.col("weekend") >= 0.5, "weekend").when(F.col("km") >= F.col("long_km"), "long_distance").when(F.col("peak") >= 0.7, "peak_hour").otherwise("occasional")
    return g.withColumn("weeks", r("weeks", 2)).withColumn("segment", segment)


@statement
def an_segment_summary(m: Mart) -> DataFrame:
    s = of(m, "an_passenger_segments")
    g = s.groupBy("segment").agg(F.count(F.lit(1)).alias("passengers"), *[r(F.avg(c), 8).alias(c) for c in ("rides", "a_week", "peak", "km")], r(F.sum("stands_for"), 2).alias("stands_for"))
    whole = Window.partitionBy()  # a row per segment
    g = g.withColumns({"part": r(F.col("passengers") / F.sum("passengers").over(whole)), "part_of_journeys": r(F.col("stands_for") / F.sum("stands_for").over(whole))})
    return g.join(most_frequent(s, ["segment"], "category", "main_category").drop("main_category_n"), "segment", "left")


#: Results that other statements read: stored when they are first wanted.
SHARED = ("an_persistent_overcrowding", "an_stop_usage", "an_delay_by_stop", "an_stop_patterns", "an_anomalies", "an_passenger_segments")


def run(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = mart(spark, sf_dir)
        register(m)
        return of(m, name) if name in SHARED else RELATIONS[name](m)

    return query


def register(m: Mart) -> None:
    """The views that statements in SQL read."""
    m.trips.createOrReplaceTempView("an_base_trips")
    m.taps.createOrReplaceTempView("an_base_taps")


QUERIES = {name: run(name) for name in RELATIONS}
SQL = {name: SQL[name] for name in RELATIONS if name in SQL}
