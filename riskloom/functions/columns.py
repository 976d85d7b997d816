"""Column expressions. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import labels as L


def band(value: Column, bands: tuple[Sequence[float], Sequence[str]]) -> Column:
    """Label of the first band whose inclusive upper bound holds ``value``.

    A null compares with nothing and so takes the last label, like any value beyond the bounds.
    """
    uppers, names = bands
    first, *rest = zip(uppers, names)
    chain = F.when(value <= first[0], first[1])
    for upper, name in rest:
        chain = chain.when(value <= upper, name)
    return chain.otherwise(names[-1])


def account_age_band(days: Column) -> Column:
    return band(days, L.ACCOUNT_AGE_BANDS)


def age_band(age: Column) -> Column:
    return band(age, L.AGE_BANDS)


def clv_band(value: Column) -> Column:
    return band(value, L.CLV_BANDS)


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole elapsed days, floored: one hour before is -1, one hour after is 0.

    Counts midnights and takes one back where the last day is not complete. Works on zoneless
    timestamps, so the session time zone has no say.
    """
    midnights = F.date_diff(later, earlier)
    incomplete = earlier + F.make_dt_interval(midnights) > later
    return (midnights - F.when(incomplete, 1).otherwise(0)).cast("bigint")


def hour_label(hour: Column) -> Column:
    """5 becomes ``05hs``."""
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit("hs"))


def shift(hour: Column) -> Column:
    """Night or day shift; a missing hour counts as day."""
    night = (hour >= L.NIGHT_FROM_HOUR) | (hour <= L.NIGHT_UNTIL_HOUR)
    return F.when(night, L.NIGHT_SHIFT).otherwise(L.DAY_SHIFT)


def shift_hour_index(hour: Column) -> Column:
    """Hours since 18h, so that a night is one unbroken block: 18h is 0, 5h is 11, 17h is 23."""
    return F.pmod(hour + (24 - L.NIGHT_FROM_HOUR), F.lit(24))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.when(condition, 1).otherwise(0)


def bad_payer(orders: Column, cancelled: Column, returned: Column) -> Column:
    """1 for customers with enough orders of which at least half were cancelled or returned."""
    lost_share = F.try_divide(cancelled + returned, orders)
    return flag((orders >= L.BAD_PAYER_MIN_ORDERS) & (lost_share >= L.BAD_PAYER_MIN_SHARE))


def order_value(items: Column) -> Column:
    return items * F.lit(L.UNIT_PRICE)


def round_cents(value: Column) -> Column:
    """Round to two decimals, ties to even (``round`` would take them up)."""
    return F.rint(value * 100) / 100


def percent_label(rate: Column, decimals: int) -> Column:
    """0.0625 becomes ``6.2%`` at one decimal: the exact value is rounded, ties to even."""
    return F.concat(F.format_number(rate * 100, decimals), F.lit("%"))


def naive_utc(df: DataFrame, column: str = "created_at") -> DataFrame:
    """Turn a timestamp with a zone, or text, into the zoneless UTC time the tables hold.

    Text with an offset is converted to UTC, text without one is taken as UTC. A zoneless
    timestamp stays as it is; the session time zone has no say.
    """
    kind = df.schema[column].dataType.typeName()
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")

    def in_utc(moment: Column) -> Column:
        return F.timestamp_add("MICROSECOND", F.unix_micros(moment), epoch)

    if kind == "timestamp":
        return df.withColumn(column, in_utc(F.col(column)))
    if kind == "string":
        text = F.trim(column)
        zoned = text.rlike(r"(?:[Zz]|UTC|GMT|[+-][0-9]{1,2}(?::?[0-9]{2})?)$") & text.contains(":")
        there = in_utc(F.to_timestamp(F.when(zoned, text)))
        return df.withColumn(
            column, F.coalesce(there, F.to_timestamp_ntz(F.when(~zoned, text)))
        )
    return df
