"""Column helpers: calendar, clock, predicates, ratios and rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values --------------------------------------------------------------
URGENCY_ORDINAL = {"routine": 0, "urgent": 1, "emergency": 2}
URGENCY_WEIGHT = {"routine": 1.0, "urgent": 3.0, "emergency": 8.0}
SMOOTHING_STRENGTH = 5.0
GRID_MINUTES = 15
SLACK_FRACTION = 0.15
SLACK_MAX_MINUTES = 15
MIN_DURATION, MAX_DURATION = 5.0, 240.0
YEAR_DAYS = 365.25
MINUTES_PER_DAY = 24 * 60
# ----------------------------------------------------------------------------


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def lookup(values: dict, key, default) -> Column:
    """Literal map lookup as a ``CASE`` chain (stays in generated code)."""
    expr = None
    for name, value in values.items():
        expr = F.when(col(key) == F.lit(name), F.lit(value)) if expr is None else expr.when(
            col(key) == F.lit(name), F.lit(value)
        )
    return expr.otherwise(F.lit(default))


# --- clock and calendar -------------------------------------------------------
def hour_of(minute="start_minute") -> Column:
    return F.floor(col(minute) / 60).cast("int")


def weekday0(day="appointment_date") -> Column:
    """Monday = 0, the encoding of the feature columns."""
    return F.weekday(col(day))


def iso_weekday(day="appointment_date") -> Column:
    """Monday = 1, the encoding of the availability table."""
    return F.weekday(col(day)) + 1


def week_start(day="appointment_date") -> Column:
    return F.date_sub(col(day), F.weekday(col(day)))


def week_label(day="appointment_date") -> Column:
    first = week_start(day)
    return F.concat_ws(
        " - ", F.date_format(first, "dd MMM"), F.date_format(F.date_add(first, 6), "dd MMM yyyy")
    )


def lead_days(appointment="appointment_date", booked="booked_at") -> Column:
    return F.greatest(F.datediff(col(appointment), F.to_date(col(booked))), F.lit(0))


def season_angle(day="appointment_date") -> Column:
    return F.lit(2.0) * F.pi() * F.dayofyear(col(day)) / F.lit(YEAR_DAYS)


def wall_clock(minute) -> Column:
    m = col(minute)
    return F.concat(
        F.lpad(F.floor(m / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad(F.pmod(m, F.lit(60)).cast("string"), 2, "0"),
    )


def minute_of(clock) -> Column:
    c = col(clock)
    return (F.substring(c, 1, 2).cast("int") * 60 + F.substring(c, 4, 2).cast("int")).cast("int")


def doctor_name(first="first_name", last="last_name") -> Column:
    return F.concat_ws(" ", F.lit("Dr."), col(first), col(last))


# --- predicates ---------------------------------------------------------------
def overlaps(a_start, a_end, b_start, b_end) -> Column:
    """Half-open: back-to-back intervals do not overlap."""
    return (col(a_start) < col(b_end)) & (col(b_start) < col(a_end))


def effective_on(day, start="effective_from", end="effective_to") -> Column:
    """Inclusive at both ends; an open end is NULL."""
    return (col(start) <= col(day)) & (col(end).isNull() | (col(end) >= col(day)))


def occupies(status="status") -> Column:
    return col(status) != "cancelled"


def resolved(status="status") -> Column:
    return col(status).isin("completed", "no_show")


def outcome(status="status") -> Column:
    """1 for a no-show, 0 for an attendance, NULL when there is no outcome."""
    return F.when(col(status) == "no_show", 1).when(col(status) == "completed", 0)


# --- ratios and rounding ------------------------------------------------------
def half_even(value, digits: int, exact: bool = False) -> Column:
    """Round half to even on the binary value.

    The noise of a floating sum is removed first, so a tie does not depend on the
    order in which partitions were added. ``exact`` keeps the value as it is, for
    ratios of counts, which have no such noise.
    """
    scale = 10.0**digits
    v = col(value).cast("double")
    return F.rint((v if exact else F.round(v, 9)) * scale) / scale + F.lit(0.0)


def percent_change(current, previous) -> Column:
    cur, prev = col(current).cast("double"), col(previous).cast("double")
    return F.when(prev != 0, half_even((cur - prev) / prev * 100, 1, exact=True))


def reduction_pct(before, after) -> Column:
    b, a = col(before).cast("double"), col(after).cast("double")
    return F.when(b > 0, half_even((b - a) / b * 100.0, 2)).otherwise(F.lit(0.0))


def ratio(numerator, denominator) -> Column:
    """0 when the denominator is 0."""
    d = col(denominator)
    return F.when(d != 0, col(numerator) / d).otherwise(F.lit(0.0))


def shrunk_rate(hits, trials, base, strength: float = SMOOTHING_STRENGTH) -> Column:
    return (col(hits) + F.lit(strength) * col(base)) / (col(trials) + F.lit(strength))


# --- scheduling arithmetic ----------------------------------------------------
def urgency_ordinal(urgency="urgency") -> Column:
    return lookup(URGENCY_ORDINAL, urgency, 0)


def urgency_weight(urgency="urgency") -> Column:
    return lookup(URGENCY_WEIGHT, urgency, 1.0)


def grid_up(minute, grid: int = GRID_MINUTES) -> Column:
    return (F.ceil(col(minute) / grid) * grid).cast("int")


def grid_down(minute, grid: int = GRID_MINUTES) -> Column:
    return (F.floor(col(minute) / grid) * grid).cast("int")


def slack_buffer(duration, fraction: float = SLACK_FRACTION, cap: int = SLACK_MAX_MINUTES) -> Column:
    return F.least(half_even(col(duration) * F.lit(fraction), 0, exact=True), F.lit(cap)).cast("int")


def booking_end(start, duration, default=None) -> Column:
    """End minute, or NULL when the visit would run past midnight."""
    length = col(duration) if default is None else F.coalesce(col(duration), col(default))
    end = col(start) + length
    return F.when(end < MINUTES_PER_DAY, end)


def clip_duration(minutes) -> Column:
    return F.least(F.greatest(col(minutes), F.lit(MIN_DURATION)), F.lit(MAX_DURATION))
