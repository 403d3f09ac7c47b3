"""Features of the session that an event may know, in one sorted run for each security.

Bars and events are dealt once, by security, and sorted so that a security's
bars come before its events.  A task reads them batch by batch: features of
the bars are computed over arrays, and every event takes those of the last bar
at or before its day.  A task holds one batch and the bars of one security, of
which there is one a day; the number of events of a security does not matter.

The sums follow each frame from its oldest row to its newest, as those of
``series.session_features``, of which this gives the values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close", "volume", "turnover")
_SPANS = (5, 10, 20)
_NO_DAY = -(2**31)

#: Values and which of them are known.
_Known = tuple[np.ndarray, np.ndarray]


class _Run:
    """Columns of bars sorted by security and day; ``code`` numbers the securities."""

    def __init__(self, code: np.ndarray):
        n = len(code)
        at, new = np.arange(n), np.concatenate([[True], code[1:] != code[:-1]])[:n]
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, n))
        self.place = at - np.repeat(first, sizes)
        self.ahead = np.repeat(sizes, sizes) - 1 - self.place

    def lag(self, x: _Known, k: int) -> _Known:
        """The value ``k`` sessions before; after, if ``k`` is negative."""
        if not k:
            return x
        v, known = np.roll(x[0], k), np.roll(x[1], k)
        return v, known & (self.place >= k if k > 0 else self.ahead >= -k)

    def lags(self, x: _Known, n: int = 20) -> list[_Known]:
        return [self.lag(x, k) for k in range(n)]


def _ratio(a: _Known, b: _Known) -> _Known:
    """a / b where b is known and not 0."""
    known = a[1] & b[1] & (b[0] != 0)
    return a[0] / np.where(known, b[0], 1.0), known


def _rate(now: _Known, base: _Known) -> _Known:
    v, known = _ratio(now, base)
    return v - 1, known


def _mean(lags: list[_Known], full: bool = False) -> _Known:
    total, n = np.zeros(len(lags[0][0])), np.zeros(len(lags[0][0]), np.int64)
    for v, known in reversed(lags):
        total += np.where(known, v, 0.0)
        n += known
    return total / np.maximum(n, 1), n == len(lags) if full else n > 0


def _deviation(lags: list[_Known], full: bool = False) -> _Known:
    """Sample deviation, by one update for each value."""
    size = len(lags[0][0])
    n, mean, m2 = np.zeros(size), np.zeros(size), np.zeros(size)
    for v, known in reversed(lags):
        n += known
        delta = np.where(known, v - mean, 0.0)
        step = delta / np.maximum(n, 1)
        mean += step
        m2 += delta * (delta - step)
    return np.sqrt(m2 / np.maximum(n - 1, 1)), n == len(lags) if full else n > 1


def _slope(lags: list[_Known], place: np.ndarray) -> _Known:
    """Slope over the number of the session."""
    size = len(place)
    n, mx, my, c, m2 = (np.zeros(size) for _ in range(5))
    for k, (v, known) in reversed(list(enumerate(lags))):
        x = place + (1.0 - k)
        n += known
        count = np.maximum(n, 1)
        dx, dy = np.where(known, x - mx, 0.0), np.where(known, v - my, 0.0)
        mx += dx / count
        my += dy / count
        c += np.where(known, dx * (v - my), 0.0)
        m2 += dx * np.where(known, x - mx, 0.0)
    return c / np.where(m2 == 0, 1.0, m2), (n > 1) & (m2 != 0)


def _drawdown(lags: list[_Known]) -> _Known:
    size = len(lags[0][0])
    top, worst = np.full(size, -np.inf), np.zeros(size)
    for v, known in reversed(lags):
        top = np.where(known, np.maximum(top, v), top)
        worst = np.where(known, np.fmin(worst, v / top - 1), worst)
    return worst, np.ones(size, bool)


def _extreme(lags: list[_Known], f, none: float) -> _Known:
    out = np.full(len(lags[0][0]), none)
    for v, known in lags:
        out = f(out, np.where(known, v, none))
    return out, np.ones(len(out), bool)


def features(code: np.ndarray, columns: dict[str, _Known]) -> dict[str, _Known]:
    """``series.session_features`` of bars (all with a close) sorted by security and day."""
    run = _Run(code)
    close, volume = columns["close"], columns["volume"]
    out = dict(columns)
    closes, volumes = run.lags(close, 21), run.lags(volume)
    out["daily_return"] = daily = _rate(close, closes[1])
    days = run.lags(daily)
    for n in _SPANS:
        out[f"sma_{n}"] = _mean(closes[:n], full=True)
    out["volatility_5d"] = _deviation(days[:5], full=True)
    out["relative_volume_20"] = _ratio(volume, _mean(volumes, full=True))
    out["volume_ratio_5"] = _ratio(volume, _mean(volumes[1:6], full=True))
    out["range_percent"] = _ratio((columns["high"][0] - columns["low"][0], columns["high"][1] & columns["low"][1]), close)
    out["close_vs_sma20"] = _rate(close, out["sma_20"])
    shaken, traded = run.lags(out["volatility_5d"]), run.lags(out["volume_ratio_5"])
    for n in _SPANS:
        out[f"momentum_{n}"] = _rate(close, closes[n])
        out[f"return_mean_{n}d"], out[f"return_std_{n}d"] = _mean(days[:n]), _deviation(days[:n])
        out[f"volatility_mean_{n}d"], out[f"volume_ratio_mean_{n}d"] = _mean(shaken[:n]), _mean(traded[:n])
    for n in (5, 20):
        out[f"volume_mean_{n}d"] = _mean(volumes[:n])
    out["high_20d"], out["low_20d"] = _extreme(closes[:20], np.maximum, -np.inf), _extreme(closes[:20], np.fmin, np.inf)
    out["distance_from_high_20d"], out["distance_from_low_20d"] = _rate(close, out["high_20d"]), _rate(close, out["low_20d"])
    out["max_drawdown_20d"] = _drawdown(closes[:20])
    out["price_trend_20d"], out["volume_trend_20d"] = _slope(closes[:20], run.place), _slope(volumes, run.place)
    for n in (1, 5, 10):
        out[f"backward_return_{n}d"] = _rate(close, closes[n])
    for n in (1, 3, 5, 10):
        out[f"forward_return_{n}d"] = _rate(run.lag(close, -n), close)
    out["session"] = run.place + 1, np.ones(len(code), bool)
    return out


def _known(column: pa.Array) -> _Known:
    return np.array(column.fill_null(0.0)), np.array(column.is_valid())


def _placed(names: list[str], grid: float | None, exact: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None  # the bars of the last security so far
        for batch in batches:
            if not batch.num_rows:
                continue
            key, bar = batch.column("security_id").to_numpy(zero_copy_only=False), np.array(batch.column("side_")) == 0
            day = np.array(batch.column("on_").cast(pa.int32()).fill_null(_NO_DAY)).astype(np.int64)
            columns = {c: _known(batch.column(c)) for c in PRICES}
            bars = {"key": key[bar], "day": day[bar]} | {c: (v[bar], known[bar]) for c, (v, known) in columns.items()}
            before = 0
            if held is not None:
                before = len(held["key"])
                bars = {c: tuple(map(np.concatenate, zip(held[c], x, strict=True))) if c in PRICES else np.concatenate([held[c], x]) for c, x in bars.items()}
            last = bars["key"] == key[-1]
            held = {c: (x[0][last], x[1][last]) if c in PRICES else x[last] for c, x in bars.items()}
            if bar.all():
                continue
            every = np.concatenate([bars["key"][:before], key])
            code = np.cumsum(np.concatenate([[False], every[1:] != every[:-1]]))
            is_bar = np.concatenate([np.ones(before, bool), bar])
            bar_code, code, asked = code[is_bar], code[~is_bar], day[~bar]
            place = lambda c, d: (c << 33) + (d - _NO_DAY)
            at = np.searchsorted(place(bar_code, bars["day"]), place(code, asked), side="right") - 1
            some = len(bar_code) > 0
            found = (at >= 0) & (asked != _NO_DAY)
            if some:
                found &= (bar_code[at] == code) & (bars["day"][at] != _NO_DAY)
            closed = bars["close"][1]
            own = (np.cumsum(closed) - 1)[at] if some else at
            has = found & closed[at] if some else found
            with np.errstate(all="ignore"):
                got = features(bar_code[closed], {c: (bars[c][0][closed], bars[c][1][closed]) for c in PRICES}) if has.any() else None
            base = np.where(found, bars["day"][at], 0) if some else np.zeros(len(at), np.int64)
            out = [batch.column("event_").filter(pa.array(~bar)), pa.array(base.astype(np.int32), pa.int32(), mask=~found).cast(pa.date32())]
            safe = np.where(has, own, 0)
            for c, step in (("session", None), *((c, grid) for c in names), *((c, None) for c in exact)):
                kind = pa.int32() if c == "session" else pa.float64()
                if got is None:
                    out.append(pa.nulls(len(at), kind))
                else:
                    v, known = got[c]
                    v = v[safe] if step is None else np.floor(v[safe] * step + 0.5) / step
                    out.append(pa.array(v.astype(kind.to_pandas_dtype()), kind, mask=~(known[safe] & has)))
            yield pa.RecordBatch.from_arrays(out, names=["event_", "event_trade_date", "session", *names, *[f"{c}_exact" for c in exact]])

    return run


def at_events(events: DataFrame, bars: DataFrame, at: str, names: list[str], grid: float | None = None, exact: list[str] = ()) -> DataFrame:
    """Events with ``event_trade_date``, ``session`` and the features ``names`` of the last bar at or before ``at`` (a date column).

    Events without an earlier bar get nulls, as do those whose bar has no close but for its date; events without a security are left out.
    With ``grid`` the features are cut to parts of 1 / grid, as ``facades.quantized`` does: in the task, for there are many;
    those of ``exact`` come uncut as well, as ``<name>_exact``.
    """
    left = events.select("security_id", F.col(at).alias("on_"), F.lit(1).alias("side_"), F.struct(*events.columns).alias("event_"))
    right = bars.select("security_id", F.col("trade_date").alias("on_"), F.lit(0).alias("side_"), *[F.col(c).cast("double").alias(c) for c in PRICES])
    run = right.unionByName(left, allowMissingColumns=True).filter("security_id IS NOT NULL").repartition("security_id").sortWithinPartitions("security_id", "side_", "on_")
    out = T.StructType([left.schema["event_"]]).add("event_trade_date", "date").add("session", "integer")
    more = [*names, *[f"{c}_exact" for c in exact]]
    for c in more:
        out = out.add(c, "double")
    return run.mapInArrow(_placed(list(names), grid, list(exact)), out).select("event_.*", "event_trade_date", "session", *more)
