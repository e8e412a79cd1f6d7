"""Date expressions: months, periods and interval texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subtract_months(d: Column, n: Column | int) -> Column:
    """S2. Whole months back, the day clamped to the month's end."""
    return F.add_months(d, -n)


def anchor_date(text: Column) -> Column:
    """The date of an ISO text, or of the end of a ``start/end`` text."""
    last = F.trim(F.element_at(F.split(text, "/"), -1))
    return F.to_date(F.split(last, "T")[0])


def periods(anchor: Column, n: int, days: int, offset_days: int = 0) -> Column:
    """S3. ``n`` adjoining periods, oldest first, as ``array<struct(t, start, end)>``."""
    if n < 1 or days < 1:
        raise ValueError("n and days must be at least 1")
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda t: F.struct(
            t.alias("t"),
            F.date_add(anchor, offset_days - (n - t) * days).alias("start"),
            F.date_add(anchor, offset_days - (n - 1 - t) * days).alias("end"),
        ),
    )


def pre_post_periods(event: Column, n_pre: int = 4, n_post: int = 4, pre_offset: int = 300,
                     post_offset: int = 7, days: int = 30) -> Column:
    """S4. Periods before and after an event, each tagged with its side."""
    def side(name: str, arr: Column) -> Column:
        return F.transform(arr, lambda p: F.struct(F.lit(name).alias("side"), p["t"].alias("t"),
                                                   p["start"].alias("start"), p["end"].alias("end")))

    return F.concat(side("pre", periods(event, n_pre, days, -pre_offset)),
                    side("post", periods(event, n_post, days, post_offset)))


def timestamp_dmy(d: Column) -> Column:
    """S5. ``struct(day, month counted from 0, year)``."""
    return F.struct(F.dayofmonth(d).alias("day"), (F.month(d) - 1).alias("month0"), F.year(d).alias("year"))


def midpoint(start: Column, end: Column) -> Column:
    """S5. The date used for a period without a scene."""
    return F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int"))


def to_rfc3339(text: Column) -> Column:
    """S6. Pad dates to instants, on both sides of a ``start/end`` text."""
    def piece(p: Column) -> Column:
        p = F.trim(p)
        return (F.when(~p.contains("T"), F.concat(p, F.lit("T00:00:00Z")))
                .when(p.endswith("Z"), p).otherwise(F.concat(p, F.lit("Z"))))

    return F.array_join(F.transform(F.split(text, "/", 2), piece), "/")
