"""Usage and its cost: storage and index hours, traffic, tiers, billing frequencies and large events.

Instants are text in ISO form or datetimes, checked on the driver. Nulls: documents without an org or a creation time and traffic without a time or
a user are nobody's; null sizes and volumes are 0; an org without a billing frequency at an instant has no period then.
"""

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.schemas import FREQUENCIES

MB = float(1 << 20)
#: Upper bound of usage, name of the tier, price of a unit. A choice of this library.
TIERS = ((100.0, "small", 0.02), (10_000.0, "medium", 0.015), (float("inf"), "large", 0.01))
LARGE_MB = 200.0


def instant(at: str | datetime.datetime) -> Column:
    """A constant timestamp without a zone; ValueError for what is no instant of the years 1 to 9999."""
    when = at if isinstance(at, datetime.datetime) else datetime.datetime.fromisoformat(at)
    if when.tzinfo is not None:
        raise ValueError("an instant has no zone here")
    return F.lit(when.isoformat(" ")).cast("timestamp_ntz")


def checked(frequency: str) -> str:
    if frequency not in FREQUENCIES:
        raise ValueError(f"not a billing frequency: {frequency}")
    return frequency


def tier(usage: Column, field: int) -> Column:
    """Name (1) or price (2) of the tier that usage falls into."""
    out = F.lit(TIERS[-1][field])
    for bound in reversed(TIERS[:-1]):
        out = F.when(usage < bound[0], F.lit(bound[field])).otherwise(out)
    return out


def overlap_hours(start: Column, end: Column) -> Column:
    """Hours of [created_at, removed_at) inside [start, end), as a double."""
    first, last = F.greatest(F.col("created_at"), start), F.least(F.coalesce(F.col("removed_at"), end), end)
    micros = F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    return F.greatest(micros / F.lit(3.6e9), F.lit(0.0))


def billing_details(documents: DataFrame, index_sizes: DataFrame, traffic: DataFrame, users: DataFrame, periods: DataFrame) -> DataFrame:
    """One row per org of periods (org_id, period_start, period_end): MB-hours of documents and of their index, MB of traffic, their tiers
    and costs, and the total.

    documents has created_at, removed_at and size_bytes; index_sizes (doc_id, index_bytes). Only the earliest start and the latest end come to the
    driver: they bound what is read of traffic. Every aggregate combines on the map side and shuffles a row per org or user and task.
    """
    start, end = F.col("period_start"), F.col("period_end")
    low, high = periods.agg(F.min(start), F.max(end)).first()
    mine = documents.filter("org_id is not null and created_at is not null").join(periods, "org_id")
    hours = mine.join(index_sizes, "doc_id", "left").withColumn("hours", overlap_hours(start, end))
    held = hours.groupBy("org_id").agg(
        F.sum(F.coalesce("size_bytes", F.lit(0)) / F.lit(MB) * F.col("hours")).alias("doc_mbh"),
        F.sum(F.coalesce("index_bytes", F.lit(0)) / F.lit(MB) * F.col("hours")).alias("search_mbh"),
    )
    read = traffic.filter((F.col("time") >= instant(low)) & (F.col("time") < instant(high))) if low else traffic.limit(0)
    days = read.groupBy("user_id", F.date_trunc("day", "time").cast("timestamp_ntz").alias("day")).agg(F.sum("incoming").alias("incoming"), F.sum("outgoing").alias("outgoing"))
    moved = (
        days.join(users.select("user_id", "org_id"), "user_id")
        .join(periods, "org_id")
        .filter((F.col("day") >= start) & (F.col("day") < end))
        .groupBy("org_id")
        .agg(F.sum("incoming").alias("incoming_mb"), F.sum("outgoing").alias("outgoing_mb"))
    )
    zero = {k: 0.0 for k in ("doc_mbh", "search_mbh", "incoming_mb", "outgoing_mb")}
    usage = periods.select("org_id", "period_start", "period_end").join(held, "org_id", "left").join(moved, "org_id", "left").fillna(zero)
    both = F.col("incoming_mb") + F.col("outgoing_mb")
    cost = {"doc": F.col("doc_mbh"), "search": F.col("search_mbh"), "traffic": both}
    priced = usage.select(
        "org_id",
        "period_start",
        "period_end",
        *zero,
        *[tier(u, 1).alias(f"{k}_tier") for k, u in cost.items()],
        *[(u * tier(u, 2)).alias(f"{k}_cost") for k, u in cost.items()],
    )
    return priced.withColumn("total_cost", F.col("doc_cost") + F.col("search_cost") + F.col("traffic_cost"))


def same_period(orgs: DataFrame, start: str, end: str) -> DataFrame:
    """One period for every org. Periods begin and end with a day."""
    return orgs.select("org_id", instant(start).alias("period_start"), instant(end).alias("period_end"))


def own_periods(frequencies: DataFrame, at: str | datetime.datetime, caller: DataFrame | None = None) -> DataFrame:
    """(org_id, period_start, period_end): the calendar month or year that holds at, by the frequency that each org has then. With caller (org_id),
    that org's only."""
    mine = frequencies if caller is None else frequencies.join(F.broadcast(caller.limit(1)), "org_id", "left_semi")
    yearly = F.col("frequency") == "YEARLY"
    month, year = (F.date_trunc(unit, instant(at)).cast("timestamp_ntz") for unit in ("month", "year"))
    start = F.when(yearly, year).otherwise(month)
    end = F.add_months(start, F.when(yearly, F.lit(12)).otherwise(F.lit(1))).cast("timestamp_ntz")
    return frequency_asof(mine, at).select("org_id", start.alias("period_start"), end.alias("period_end"))


def nested_bill(priced: DataFrame) -> DataFrame:
    """The flat bill as nested records."""
    return priced.select(
        "org_id",
        "period_start",
        "period_end",
        "total_cost",
        F.struct(F.col("doc_cost").alias("cost"), F.col("doc_mbh").alias("size"), F.col("doc_tier").alias("tier")).alias("documents"),
        F.struct(F.col("search_cost").alias("cost"), F.col("search_mbh").alias("size"), F.col("search_tier").alias("tier")).alias("search"),
        F.struct(F.col("traffic_cost").alias("cost"), F.col("incoming_mb").alias("incoming"), F.col("outgoing_mb").alias("outgoing"), F.col("traffic_tier").alias("tier")).alias("traffic"),
    )


def frequency_list(frequencies: DataFrame, now: str | None = None) -> DataFrame:
    """frequencies with valid_to, the start of the next one (half-open), and, at now, whether each is past, current or next."""
    out = frequencies.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("org_id").orderBy("valid_from")))
    if now is None:
        return out
    at = instant(now)
    return out.withColumn("state", F.when(F.col("valid_from") > at, "next").when(F.col("valid_to") <= at, "past").otherwise("current"))


def set_next_frequency(frequencies: DataFrame, org_id: int, frequency: str, valid_from: str) -> DataFrame:
    """frequencies with a further one; one with the same start is replaced."""
    at = instant(valid_from)
    rest = frequencies.filter(~((F.col("org_id") == org_id) & (F.col("valid_from") == at)))
    one = frequencies.select("org_id").filter(F.col("org_id") == org_id).distinct().select("org_id", F.lit(checked(frequency)).alias("frequency"), at.alias("valid_from"))
    return frequency_list(rest.select("org_id", "frequency", "valid_from").unionByName(one))


def frequency_asof(frequencies: DataFrame, at: str) -> DataFrame:
    """The frequency that holds for each org at an instant: the latest started one, by one map-side combined aggregate."""
    started = frequencies.filter(F.col("valid_from") <= instant(at))
    return started.groupBy("org_id").agg(F.max_by("frequency", "valid_from").alias("frequency"), F.max("valid_from").alias("valid_from"))


def period_of(at: str | datetime.datetime, frequency: str) -> tuple[Column, Column]:
    """Start and end of the calendar month or year that holds at; constants."""
    unit, months = ("month", 1) if checked(frequency) == "MONTHLY" else ("year", 12)
    start = F.date_trunc(unit, instant(at))
    return start.cast("timestamp_ntz"), F.add_months(start, months).cast("timestamp_ntz")


def large_traffic(traffic: DataFrame, at: str | datetime.datetime, frequency: str = "MONTHLY", large_mb: float = LARGE_MB) -> DataFrame:
    """Traffic of at least large_mb inside the billing period that holds at; the filters reach the scan."""
    start, end = period_of(at, frequency)
    big = (F.col("incoming") >= large_mb) | (F.col("outgoing") >= large_mb)
    return traffic.filter((F.col("time") >= start) & (F.col("time") < end) & big)


def large_traffic_of(traffic: DataFrame, users: DataFrame, frequencies: DataFrame, caller: DataFrame, at: str | datetime.datetime, large_mb: float = LARGE_MB) -> DataFrame:
    """The caller's org's large traffic in its own billing period, with the period. caller: (org_id), none or one row (accounts.caller_org); it and the
    org's frequency at the instant come to the driver, so that the period's bounds reach the scan. Without either there is no row."""
    kind = frequency_asof(frequencies.join(F.broadcast(caller.limit(1)), "org_id", "left_semi"), at).first()
    start, end = period_of(at, kind["frequency"] if kind else "MONTHLY")
    theirs = users.join(F.broadcast(caller.limit(1)), "org_id", "left_semi").select("user_id")
    out = large_traffic(traffic, at, kind["frequency"], large_mb) if kind else traffic.limit(0)
    return out.join(theirs, "user_id", "left_semi").select(*traffic.columns, start.alias("period_start"), end.alias("period_end"))


def traffic_daily(traffic: DataFrame) -> DataFrame:
    day = F.date_trunc("day", "time").cast("date").alias("day")
    return traffic.groupBy(day).agg(F.count("*").alias("n"), F.sum("incoming").alias("incoming_mb"), F.sum("outgoing").alias("outgoing_mb"))
