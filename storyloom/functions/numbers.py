"""Column functions over scores, prices, dates and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_change(now: Column, before: Column) -> Column:
    """Null where the base is null or 0."""
    return F.when(before != 0, (now - before) / before * 100)


def logistic_importance(score: Column, steepness: float, midpoint: float) -> Column:
    """A score on a scale from 0 to 100."""
    x = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -steepness * (score - midpoint)))
    return 100.0 / (1.0 + F.exp(x))


def blend_importance(det: Column, grade: Column, weight: float = 0.65, down: float = 25.0, up: float = 100.0) -> Column:
    """The deterministic score blended with a grade and held near it; a null grade leaves it as it is."""
    mixed = det * (1 - weight) + grade * weight
    held = F.greatest(F.greatest(F.lit(0.0), det - down), F.least(F.least(F.lit(100.0), det + up), mixed))
    return F.when(grade.isNull(), det).otherwise(held)


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def conservative_tokens(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)) + 512


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar."""
    def div(a, b):
        return F.floor(a / b).cast("int")

    a, b, c = year % 19, div(year, 100), year % 100
    d, e = div(b, 4), b % 4
    g = div(8 * b + 13, 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = div(a + 11 * h + 19 * m, 433)
    month = div(h + m - 7 * n + 90, 25)
    return F.make_date(year, month, (h + m - 7 * n + 33 * month + 19) % 32)


def nyse_holiday(day: Column) -> Column:
    """Whether the exchange is closed for a holiday on a weekday."""
    y, m, d, w = F.year(day), F.month(day), F.dayofmonth(day), F.weekday(day)

    def nth(month: int, weekday: int, n: int) -> Column:
        return (m == month) & (w == weekday) & (F.floor((d - 1) / 7) == n - 1)

    def observed(month: int, date: int) -> Column:
        own = F.make_date(y, F.lit(month), F.lit(date))
        return day == F.when(F.weekday(own) == 5, F.date_sub(own, 1)).when(F.weekday(own) == 6, F.date_add(own, 1)).otherwise(own)

    new_year = (m == 1) & (((d == 1) & (w < 5)) | ((d == 2) & (w == 0)))
    memorial = (m == 5) & (w == 0) & (d >= 25)
    juneteenth = observed(6, 19) & (y >= 2022)
    return new_year | nth(1, 0, 3) | nth(2, 0, 3) | (day == F.date_sub(easter(y), 2)) | memorial | juneteenth | observed(7, 4) | nth(9, 0, 1) | nth(11, 3, 4) | observed(12, 25)


def trading_day(day: Column) -> Column:
    return (F.weekday(day) < 5) & ~nyse_holiday(day)
