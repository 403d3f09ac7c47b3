"""Ordered classification rules: the first that holds decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Series of debt and of equity (fixed values).
DEBT_SERIES = ("G", "GS", "SG", "TB", "GB")
EQUITY_SERIES = ("EQ", "BE", "BZ", "SM", "ST", "SZ", "E1", "P1", "X1")
OTHER_SERIES = ("IV", "RR")
DEBT_NAME = r"BOND|NCD|DEBENTURE|TAX FREE|TFB|\b[0-9.]+%\b|^GS"


def asset_category(name: Column, symbol: Column, series: Column, isin: Column, scrip_code: Column) -> Column:
    """ETF, MUTUAL_FUND, BOND, EQUITY or OTHER; null if no rule holds."""
    name, symbol = F.coalesce(F.upper(name), F.lit("")), F.coalesce(F.upper(symbol), F.lit(""))
    return (
        F.when(name.contains("ETF") | symbol.contains("ETF"), "ETF")
        .when(scrip_code.startswith("9") | isin.startswith("INF") | name.contains("MUTUAL FUND"), "MUTUAL_FUND")
        .when(series.isin(*DEBT_SERIES) | F.rlike(series, F.lit("^(?:N|Y|Z|A|B|D)[0-9A-Z]*$")), "BOND")
        .when(F.rlike(name, F.lit(DEBT_NAME)), "BOND")
        .when(series.isin(*EQUITY_SERIES), "EQUITY")
        .when(isin.startswith("INE") & F.rlike(scrip_code, F.lit("^[0-9]+$")) & (name != ""), "EQUITY")
        .when(F.rlike(symbol, F.lit("PP1?$")) & scrip_code.isNotNull(), "EQUITY")
        .when(series.isin(*OTHER_SERIES) | F.rlike(name, F.lit("WARRANT|RIGHTS")), "OTHER")
    )


def canonical_decision(strong: Column, continuity: Column) -> Column:
    """MATCH for one strong hit with established continuity, REVIEW for several or a plausible one, else NO_CANONICAL_MATCH."""
    return F.when((strong == 1) & (continuity == "ESTABLISHED"), "MATCH").when((strong > 1) | (continuity == "PLAUSIBLE"), "REVIEW").otherwise("NO_CANONICAL_MATCH")


def normalized_level(text: Column) -> Column:
    """HIGH, MEDIUM, LOW or NONE of a free-text impact."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    return F.when(upper.contains("HIGH"), "HIGH").when(upper.contains("MED"), "MEDIUM").when(upper.contains("LOW"), "LOW").otherwise("NONE")


def outcome_label(predicted: Column, actual: Column) -> Column:
    """CORRECT or DIFFERENT once the actual direction is known, else PENDING."""
    return F.when(actual.isNull(), "PENDING").when(predicted == actual, "CORRECT").otherwise("DIFFERENT")


#: Names whose asset class is known (fixed values).
KNOWN_ASSETS = {"360 ONE ASSET MANAGEMENT LIMITED": "MUTUAL_FUND", "WATERMARKE ESTATES PVT LTD": "OTHER"}
#: Words that tell an issuer, and words that tell an instrument (fixed values).
ISSUER_WORDS = ("ASSET MANAGEMENT", "ASSET MANAGERS", "FUNDS MANAGEMENT", "INVESTMENT MANAGERS")
INSTRUMENT_WORDS = ("FUND", "INTERVAL", "DIRECT", "REGULAR", "GROWTH", "DIVIDEND", "PAYOUT", "PLAN", "OPTION", "SERIES")


def news_asset(name: Column, code: Column) -> Column:
    """Asset class of a security that the master lacks: known names, codes from 9, ETF, bond, other."""
    known = reduce(lambda c, x: c.when(name == x[0], x[1]), list(KNOWN_ASSETS.items())[1:], F.when(name == next(iter(KNOWN_ASSETS)), KNOWN_ASSETS[next(iter(KNOWN_ASSETS))]))
    rest = F.when(F.startswith(F.coalesce(code, F.lit("")), F.lit("9")), "MUTUAL_FUND").when(F.contains(name, F.lit("ETF")), "ETF").when(F.contains(name, F.lit("BOND")), "BOND").otherwise("OTHER")
    return F.coalesce(known, rest)


def identity_type(symbol: Column, name: Column) -> Column:
    """What an unresolved identity is: a symbol, an issuer, an instrument or a company."""
    words = F.split(name, " ")
    issuer = F.array_contains(words, "AMC") | reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in ISSUER_WORDS])
    instrument = F.arrays_overlap(words, F.array(*map(F.lit, INSTRUMENT_WORDS)))
    return F.when(F.coalesce(symbol, F.lit("")) != "", "HISTORICAL_SYMBOL").when(issuer, "ISSUER_NAME").when(instrument, "SPECIFIC_INSTRUMENT").otherwise("COMPANY_NAME")


def horizon_status(status: Column, predicted: Column, featured: Column, published: Column, history: Column) -> Column:
    """Why an item has or lacks a prediction on one horizon; a null status is not NOT_MAPPED."""
    return (
        F.when(status != "MAPPED", "NOT_MAPPED").when(predicted, "AVAILABLE").when(featured, "NO_PREDICTION").when(published.isNull(), "NO_PUBLISHED_AT").when(history == 0, "NO_HISTORY").when(history < 20, "INSUFFICIENT_HISTORY").otherwise("NO_FEATURES")
    )


def valid_or(value: Column, allowed: tuple[str, ...], other: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(other))


def clamped_confidence(value: Column) -> Column:
    """A confidence of 0 to 100; what is no number counts as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(value.try_cast("double"), F.lit(0.0))))


def first_facts(facts: Column, n: int = 10) -> Column:
    """The first cleaned facts that are not empty."""
    return F.slice(F.filter(F.transform(facts, lambda f: F.trim(F.regexp_replace(f, r"\s+", " "))), lambda f: f != ""), 1, n)
