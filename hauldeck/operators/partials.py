"""Summary figures as mergeable states, so that a refresh reads the changes and the states, not the fact.

A state has, per key, one row of counts and exact sums, and one row per value
of the columns whose distinct values or extremes a summary shows, with the
number of trips that have it. States of added trips and of removed ones (with
minus signs) add up to the state of what is left, in any order; a value whose
count is back at zero is gone, so extremes and distinct counts stay exact
under removals, too.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..functions.trips import route_label
from .summaries import name_routes

RELIABLE = "eta_data_status = 'available' AND trip_duration_minutes IS NOT NULL"


@dataclass(frozen=True)
class Partial:
    """Keys (name -> SQL expression), the trips that count, the summed columns, and those whose values are kept."""

    keys: tuple[tuple[str, str], ...]
    where: str
    sums: tuple[str, ...]
    values: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [k for k, _ in self.keys]


DRIVER = Partial((("driver_id", "driver_id"),), f"{RELIABLE} AND trip_duration_minutes > 0 AND driver_id IS NOT NULL",
                 ("trip_duration_minutes", "avg_speed_kmph", "trip_km", "eta_delay_minutes"), ("vehicle_id", "trip_duration_minutes"))
ROUTE = Partial((("origin_id", "origin_id"), ("destination_id", "destination_id")), f"{RELIABLE} AND trip_duration_minutes > 0 AND origin_id IS NOT NULL AND destination_id IS NOT NULL",
                ("trip_duration_minutes", "avg_speed_kmph", "trip_km"))
VEHICLE = Partial((("vehicle_id", "vehicle_id"),), f"{RELIABLE} AND trip_duration_minutes > 0 AND vehicle_id IS NOT NULL", ("avg_speed_kmph", "trip_km"), ("driver_id",))
DAILY = Partial((("stat_date", "to_date(trip_start)"),), f"{RELIABLE} AND trip_start IS NOT NULL", ("trip_km", "avg_speed_kmph"), ("driver_id", "vehicle_id"))

EXACT = "decimal(38,6)"


def state_of(trips: DataFrame, partial: Partial, sign: int = 1) -> DataFrame:
    """The state of these trips (sign -1: of their removal)."""
    parts = F.array(F.struct(F.lit("").alias("part"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(c).alias("part"), F.col(c).cast("string").alias("value")) for c in partial.values])
    rows = trips.filter(partial.where).select(
        *[F.expr(x).alias(k) for k, x in partial.keys], F.when(F.col("eta_met") == 1, sign).otherwise(0).cast("long").alias("met"),
        *[(F.col(c) * sign).cast(EXACT).alias(f"s_{c}") for c in partial.sums], *[F.when(F.col(c).isNotNull(), sign).otherwise(0).cast("long").alias(f"k_{c}") for c in partial.sums], F.explode(parts).alias("p"))
    rows = rows.filter("p.part = '' OR p.value IS NOT NULL").select(*partial.names, "p.part", "p.value", F.lit(sign).cast("long").alias("n"), "met", *[f"{x}_{c}" for c in partial.sums for x in "sk"])
    return _summed(rows, partial)


def _summed(rows: DataFrame, partial: Partial) -> DataFrame:
    total = lambda c: F.sum(F.when(F.col("part") == "", F.col(c))).cast(rows.schema[c].dataType).alias(c)
    out = rows.groupBy(*partial.names, "part", "value").agg(F.sum("n").alias("n"), total("met"), *[total(f"{x}_{c}") for c in partial.sums for x in "sk"])
    return out.filter("n <> 0 OR part = ''")


def combined(partial: Partial, *states: DataFrame) -> DataFrame:
    """The sum of changes; a key whose number of trips stays the same can still have other sums."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return _summed(out, partial)


def merged(partial: Partial, *states: DataFrame) -> DataFrame:
    """The state that a state and its changes add up to; keys without a trip are gone."""
    return combined(partial, *states).filter("n <> 0")


def figures(state: DataFrame, partial: Partial) -> DataFrame:
    """One row per key: n, met, s_ and k_ (sum and number of values) of each summed column, d_, lo_ and hi_ (distinct values, extremes) of each kept one."""
    own = F.col("part") == ""
    one = lambda c: F.max(F.when(own, F.col(c))).alias(c)
    value = lambda c: F.when(F.col("part") == c, F.col("value").cast("decimal(38,6)"))
    kept = [x for c in partial.values for x in (F.count(value(c)).alias(f"d_{c}"), F.min(value(c)).alias(f"lo_{c}"), F.max(value(c)).alias(f"hi_{c}"))]
    return state.groupBy(*partial.names).agg(one("n"), one("met"), *[one(f"{x}_{c}") for c in partial.sums for x in "sk"], *kept)


def _mean(c: str) -> Column:
    return rnd(F.try_divide(F.col(f"s_{c}").cast("double"), F.col(f"k_{c}").cast("double")))


def _rate() -> Column:
    return rnd(F.col("met").cast("double") * 100 / F.col("n").cast("double"))


def _sum(c: str) -> Column:
    return rnd(F.when(F.col(f"k_{c}") > 0, F.col(f"s_{c}")))


def driver_summary(state: DataFrame, drivers: DataFrame) -> DataFrame:
    names = drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name"), F.col("mobile1").alias("driver_mobile"))
    return figures(state, DRIVER).join(names, "driver_id").select(
        "driver_id", "driver_name", "driver_mobile", F.col("n").alias("total_trips"), F.col("met").alias("eta_met_count"), _rate().alias("eta_success_rate"), _mean("trip_duration_minutes").alias("avg_duration_min"),
        rnd("hi_trip_duration_minutes").alias("max_duration_min"), rnd("lo_trip_duration_minutes").alias("min_duration_min"), _mean("avg_speed_kmph").alias("avg_speed_kmph"), F.col("d_vehicle_id").alias("vehicles_used"),
        _sum("trip_km").alias("total_distance_km"), _mean("trip_km").alias("avg_distance_km"), _mean("eta_delay_minutes").alias("avg_eta_delay_min"))


def route_summary(state: DataFrame, locations: DataFrame, arrow: str = " -> ") -> DataFrame:
    named = name_routes(figures(state, ROUTE), locations)
    return named.select(
        "origin_id", "destination_id", "origin", "destination", route_label(F.col("origin"), F.col("destination"), arrow).alias("route_name"), F.col("n").alias("trip_count"),
        _mean("trip_duration_minutes").alias("avg_duration_min"), _mean("avg_speed_kmph").alias("avg_speed_kmph"), _rate().alias("eta_success_rate"), _mean("trip_km").alias("avg_distance_km"))


def vehicle_summary(state: DataFrame, vehicles: DataFrame) -> DataFrame:
    names = vehicles.select(F.col("id").alias("vehicle_id"), "asset_id", "asset_type")
    return figures(state, VEHICLE).join(names, "vehicle_id").select(
        "vehicle_id", "asset_id", "asset_type", F.col("n").alias("total_trips"), F.col("d_driver_id").alias("drivers_used"), _mean("avg_speed_kmph").alias("avg_speed_kmph"),
        _sum("trip_km").alias("total_distance_km"), _mean("trip_km").alias("avg_distance_km"), _rate().alias("eta_success_rate"))


def daily_fleet_stats(state: DataFrame) -> DataFrame:
    return figures(state, DAILY).select(
        "stat_date", F.col("n").alias("total_trips"), _sum("trip_km").alias("total_distance_km"), _mean("avg_speed_kmph").alias("avg_speed"), _rate().alias("eta_success_rate"),
        F.col("d_driver_id").alias("active_drivers"), F.col("d_vehicle_id").alias("active_vehicles"))


def refreshed(state: DataFrame, partial: Partial, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The state after a change set: trips that are new or have their new version, and the old versions of changed and deleted ones."""
    return merged(partial, state, state_of(added, partial), state_of(removed, partial, -1))
