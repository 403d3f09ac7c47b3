"""Market rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A news item after this second of the day may use the day's own close (fixed value: 15:30:00).
CLOSE_SECOND = 55_800
#: Returns from this size on have a direction (fixed value).
DIRECTION_THRESHOLD = 0.0075


def second_of_day(at: Column) -> Column:
    return F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)


def after_close(at: Column) -> Column:
    return (second_of_day(at) > CLOSE_SECOND) | ((second_of_day(at) == CLOSE_SECOND) & (F.date_trunc("second", at) < at))


def prediction_cutoff(at: Column) -> Column:
    """The last date whose close may be known when the item appears; strictly after 15:30:00 it is the same day."""
    return F.when(after_close(at), at.cast("date")).otherwise(F.date_sub(at.cast("date"), 1))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return F.when(b != 0, a / b)


def change_rate(now: Column, base: Column) -> Column:
    """now / base - 1, null where the base is null or 0."""
    return F.when(base != 0, now / base - 1)


def direction(rate: Column, threshold: float = DIRECTION_THRESHOLD) -> Column:
    return F.when(rate.isNull(), F.lit(None).cast("string")).when(rate >= threshold, "POSITIVE").when(rate <= -threshold, "NEGATIVE").otherwise("NEUTRAL")


def exchanges(tag: Column) -> Column:
    """The exchanges that a tag stands for."""
    return F.when(tag == "BOTH", F.array(F.lit("NSE"), F.lit("BSE"))).when(tag == "BSE", F.array(F.lit("BSE"))).otherwise(F.array(F.lit("NSE")))


def session_phase(at: Column) -> tuple[Column, Column]:
    """Whether a time is before 09:15 and whether it is after 15:30, fractions of a second included."""
    return second_of_day(at) < 9 * 3600 + 15 * 60, after_close(at)


def action_type(subject: Column) -> Column:
    """Type of a corporate action by the first keyword that its subject holds."""
    text = F.upper(subject)
    has = lambda *words: F.rlike(text, F.lit("|".join(words)))
    return (
        F.when(subject.isNull() | (F.trim(subject) == ""), "OTHER")
        .when(has("DIVIDEND"), "DIVIDEND").when(has("BONUS"), "BONUS").when(has("RIGHTS"), "RIGHTS")
        .when(has("BUY BACK", "BUYBACK"), "BUYBACK").when(has("BOARD"), "BOARD_MEETING")
        .when(has("SPLIT"), "STOCK_SPLIT").when(has("MERGER"), "MERGER").otherwise("OTHER")
    )


def dividend_amount(subject: Column) -> Column:
    """First number after RS or RE in a subject, null without one."""
    return F.nullif(F.regexp_extract(F.upper(subject), r"(?:RS|RE)\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("decimal(18,4)")


def outcome_v1(predicted: Column, rate_percent: Column) -> Column:
    """CONFIRMED, UNRESOLVED or NOT_ENOUGH_DATA from a predicted direction and the next session's percent return."""
    same = ((predicted == "POSITIVE") & (rate_percent >= 0.75)) | ((predicted == "NEGATIVE") & (rate_percent <= -0.75))
    return F.when(rate_percent.isNull(), "NOT_ENOUGH_DATA").when(same, "CONFIRMED").otherwise("UNRESOLVED")


def outcome_reason_v1(predicted: Column, rate_percent: Column) -> Column:
    other = ((predicted == "POSITIVE") & (rate_percent <= -0.75)) | ((predicted == "NEGATIVE") & (rate_percent >= 0.75))
    return F.when(rate_percent.isNull(), F.lit(None).cast("string")).when(other, "CONTRADICTORY_MARKET_REACTION").when(outcome_v1(predicted, rate_percent) == "UNRESOLVED", "UNKNOWN")


def outcome_v10(predicted: Column, rate: Column, excess: Column, volume_ratio: Column) -> tuple[Column, Column]:
    """Status and reason with the excess over a benchmark and the volume ratio."""
    sign = F.when(predicted == "POSITIVE", 1).when(predicted == "NEGATIVE", -1).otherwise(0)
    same = (sign * rate) > 0
    against = (sign * rate) < 0
    status = F.when(rate.isNull(), "NOT_ENOUGH_DATA").when(same, "CONFIRMED").otherwise("UNRESOLVED")
    reason = F.when(rate.isNull() | same, F.lit(None).cast("string")).when(against & (sign * excess >= 0), "MARKET_OR_SECTOR_MOVE").when(against & (volume_ratio >= 2), "UNUSUAL_PRICE_ACTIVITY").when(against, "CONTRADICTORY_MARKET_REACTION").otherwise("UNKNOWN")
    return status, reason
