"""Trend detectors over batch rows: finite windows as windows, the rest as ordered folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.operators.ordered import (bounded_windows, clamped_scan, exact_quantiles, islands, ordered_fold, row_index)
from driftgauge.session import stored

DOUBLE = T.DoubleType()
# Spans and decays of the three competing averages.
EXPERTS = (("short", 0.75), ("medium", 0.90), ("long", 0.97))


# ---- finite windows --------------------------------------------------------------------------

def _slope(value: Column, w, reach: int) -> Column:
    frame = w.rowsBetween(-(reach - 1), 0)
    n = F.count(value).over(frame)
    return F.when(n >= 4, (F.last(value).over(frame) - F.first(value).over(frame)) / (n - 1)).otherwise(0.0)


def _trend(w) -> Column:
    frame = w.rowsBetween(-31, 0)
    rate, conf, out = F.col("positive_rate"), F.col("mean_conf"), F.col("output_score")
    rates = F.stddev_pop(rate).over(frame) + F.abs(rate - F.percentile(rate, F.lit(0.5)).over(frame))
    confs = F.abs(conf - F.avg(conf).over(frame))
    outs = F.greatest(F.lit(0.0), out - F.percentile(out, F.lit(0.25)).over(frame))
    raw = F.least(F.lit(1.0), 0.45 * rates + 0.30 * confs + 0.25 * outs)
    return F.when(F.count(rate).over(frame) >= 8, raw).otherwise(0.0)


def trend_columns(signals: DataFrame, rows: int | None = None) -> DataFrame:
    """Drift detector score, slopes of shift and of loss, change of shift since the last batch."""
    def columns(w):
        score = F.col("score")
        return {"drift_score": _trend(w), "shift_slope": _slope(score, w, 12),
                "loss_slope": _slope(score + F.col("collapse_risk"), w, 16),
                "shift_delta": score - F.lag(score, 1).over(w)}

    out = bounded_windows(signals, ["stream_id"], "step", 32, columns, rows)
    return out.withColumn("proactive_hold", F.col("shift_slope") >= 0.04).withColumn(
        "loss_block", F.col("loss_slope") >= 0.08)


def severe_runs(signals: DataFrame, rows: int | None = None) -> DataFrame:
    """Number of severe batches in a row up to each batch."""
    on = islands(signals.select("stream_id", "step", "severe"), ["stream_id"], "step", F.col("severe"), rows)
    first = on.groupBy("stream_id", "island").agg(F.min("step").alias("_first"))
    runs = on.join(first, ["stream_id", "island"]).select(
        "stream_id", "step", (F.col("step") - F.col("_first") + 1).alias("severe_run"))
    return signals.select("stream_id", "step").join(runs, ["stream_id", "step"], "left").na.fill({"severe_run": 0})


def episodes(decisions: DataFrame, keys: Sequence[str] = ("stream_id", "strategy"), rows: int | None = None
             ) -> DataFrame:
    """Unbroken runs of eventful batches with their peaks and action counts."""
    eventful = F.col("risk_alert") | F.col("retrain_recommended") | (F.col("shift_score") >= 1.0)
    on = islands(decisions, keys, "step", eventful, rows)
    by = [*keys, "island"]
    peaks = on.groupBy(*by).agg(
        F.min("step").alias("start_step"), F.max("step").alias("end_step"),
        F.max("shift_score").alias("peak_shift_score"), F.max("capital").alias("peak_risk_capital"),
        F.bool_or("retrain_recommended").alias("retrain_recommended"))
    # A run has at most a handful of action names, counted before they meet in one list.
    counts = on.groupBy(*by, "action_taken").agg(F.count(F.lit(1)).alias("_n"))
    text = counts.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(
        F.concat_ws(":", "action_taken", F.col("_n").cast("string")))), ", ").alias("action_summary"))
    return peaks.join(text, by).drop("island")


def budget_use(decisions: DataFrame, window: int = 24, rows: int | None = None) -> DataFrame:
    """Logged actions and resets of the last `window` steps, this one left out: a check of the audit log."""
    def columns(w):
        frame = w.rangeBetween(-(window - 1), -1)
        acted = (~F.col("action_taken").isin("none", "hold", "abstain")).cast("long")
        reset = (F.col("action_taken") == "reset").cast("long")
        return {"actions_in_window": F.coalesce(F.sum(acted).over(frame), F.lit(0)),
                "resets_in_window": F.coalesce(F.sum(reset).over(frame), F.lit(0))}

    return bounded_windows(decisions, ["stream_id", "strategy"], "step", window, columns, rows)


# ---- folds -----------------------------------------------------------------------------------

def ewm(values: np.ndarray, decay: float, start: float) -> np.ndarray:
    """Exponential mean after each value: decay * previous + (1 - decay) * value."""
    s = pd.Series(np.concatenate([[start], values]))
    return s.ewm(alpha=1.0 - decay, adjust=False).mean().to_numpy()[1:]


def ema_columns(df: DataFrame, inputs: Mapping[str, tuple[str, float, float]],
                keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """Named exponential means: name -> (column, decay, start)."""
    free = float("inf")
    return clamped_scan(df, keys, "step", {n: (F.lit(d), F.lit(1.0 - d) * F.col(c), -free, free, s) for n, (c, d, s) in inputs.items()})


def timescales(signals: DataFrame) -> DataFrame:
    """Most urgent of three averages of shift and output; the first one wins ties."""
    inputs = {}
    for name, decay in EXPERTS:
        inputs[f"{name}_shift"] = ("score", decay, 0.0)
        inputs[f"{name}_output"] = ("output_score", decay, 0.0)
    e = ema_columns(signals, inputs)
    urgency = {n: 0.6 * F.col(f"{n}_shift") + 0.4 * F.col(f"{n}_output") for n, _ in EXPERTS}
    top = F.greatest(*urgency.values())
    expert = F.coalesce(*[F.when(u == top, F.lit(n)) for n, u in urgency.items()])
    gain = {n: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * F.col(f"{n}_shift") + 0.5 * F.col(f"{n}_output")))
            for n, _ in EXPERTS}
    out = e.withColumn("expert", expert)
    pick = F.coalesce(*[F.when(F.col("expert") == n, g) for n, g in gain.items()])
    return out.withColumn("gain", pick).select("stream_id", "step", "expert", "gain")


def conformal_alpha(first_rows: DataFrame, coverage: float = 0.90, rate: float = 0.05, low: float = 0.02,
                    high: float = 0.40, start: float = 0.10) -> DataFrame:
    """Miscoverage level after each batch; `miss` is 1 when the batch's first row was predicted wrong."""
    shift = F.lit(rate) * (F.col("miss") - F.lit(1.0 - coverage))
    return clamped_scan(first_rows, ["stream_id"], "step", {"alpha": (F.lit(1.0), shift, low, high, start)})


def page_hinkley(df: DataFrame, value: str, least: int = 30, delta: float = 0.005, limit: float = 50.0) -> DataFrame:
    """Page-Hinkley test for a rising mean; it starts anew after an alarm."""
    def block(state, pdf):
        n, mean, total, low = state
        stat, alarm = np.empty(len(pdf)), np.zeros(len(pdf), dtype=bool)
        for i, x in enumerate(pdf[value].to_numpy(float)):
            n += 1
            mean += (x - mean) / n
            total += x - mean - delta
            low = min(low, total)
            stat[i] = total - low
            if n >= least and total - low > limit:
                alarm[i] = True
                n, mean, total, low = 0.0, 0.0, 0.0, 0.0
        return np.array([n, mean, total, low]), pd.DataFrame({"statistic": stat, "drift": alarm})

    fields = [T.StructField("statistic", DOUBLE), T.StructField("drift", T.BooleanType())]
    return ordered_fold(df.select("stream_id", "step", value), ["stream_id"], "step", [0, 0, 0, 0], block, fields)


class SplitSums:
    """Sums of a growing window and bounds of them by blocks, so that only splits that may be cut are tried.

    A block of splits keeps the extremes of its sums about the line through its last one. At any later time they bound how far its
    sums lie from the line of the whole window, and so whether one of its splits can pass the test. Blocks of `SIZES[1]` splits are
    asked first, the ones of `SIZES[0]` inside them next, and what remains is tested as the method says, so the first split found is the same.
    """

    SIZES = (256, 16_384)

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.values = np.empty(max(1024, 2 * self.n))
        self.sums = np.empty(len(self.values))
        self.values[:self.n] = values
        self.sums[:self.n] = np.cumsum(values)
        self.largest = np.abs(values).max(initial=0.0)
        self.bounds = tuple(np.empty((5, 64)) for _ in self.SIZES)
        self.closed = [0 for _ in self.SIZES]
        self._close()

    def add(self, x: float) -> None:
        if self.n == len(self.values):
            self.values, self.sums = (np.concatenate([v, np.empty(len(v))]) for v in (self.values, self.sums))
        self.values[self.n] = x
        # Added in order, as a cumulative sum does.
        self.sums[self.n] = self.sums[self.n - 1] + x if self.n else x
        self.n += 1
        self.largest = max(self.largest, abs(x))
        if self.n % self.SIZES[0] == 0:
            self._close()

    def _close(self) -> None:
        for level, size in enumerate(self.SIZES):
            while (self.closed[level] + 1) * size <= self.n:
                k = self.closed[level]
                first, last = k * size + 1, (k + 1) * size
                slope = self.sums[last - 1] / last
                off = self.sums[first - 1:last] - slope * np.arange(first, last + 1)
                if k == self.bounds[level].shape[1]:
                    self.bounds = tuple(np.hstack([t, np.empty_like(t)]) if i == level else t for i, t in enumerate(self.bounds))
                self.bounds[level][:, k] = off.min(), off.max(), slope, first, last
                self.closed[level] += 1

    def _open(self, level: int, start: int, stop: int, log: float) -> np.ndarray:
        """Blocks of a level that may hold a cut, rounding included; one that cannot be judged may."""
        low, high, slope, first, last = self.bounds[level][:, start:stop]
        n = self.n
        turn = slope - self.sums[n - 1] / n
        one, two = first * turn, last * turn
        far = np.maximum(high + np.maximum(one, two), -(low + np.minimum(one, two))) + 1e-10 * last * self.largest
        least = np.minimum(first * (n - first), last * (n - last)) * (0.5 * log / n)
        return start + np.flatnonzero(~((far < 0) | (far * far < least * (1 - 1e-9))))

    def _tested(self, start: int, stop: int, log: float) -> int | None:
        """The first of the splits after `start` to `stop` values whose two means differ too much."""
        n0 = np.arange(start + 1, stop + 1)
        n1 = self.n - n0
        head, whole = self.sums[start:stop], self.sums[self.n - 1]
        wide = np.abs(head / n0 - (whole - head) / n1) >= np.sqrt(0.5 * (1 / n0 + 1 / n1) * log)
        return start + int(np.argmax(wide)) + 1 if wide.any() else None

    def cut(self, delta: float) -> int | None:
        """Values before the first split that passes the test, or None."""
        log = np.log(2.0 * self.n / delta)
        small, large = self.SIZES
        each, end = large // small, self.n - 1
        with np.errstate(invalid="ignore", over="ignore"):
            # A block that ends with the whole window is no split in its last place; it is tested value by value.
            outer = min(self.closed[1], end // large)
            for k in self._open(1, 0, outer, log) if outer else ():
                for j in self._open(0, k * each, (k + 1) * each, log):
                    found = self._tested(j * small, (j + 1) * small, log)
                    if found:
                        return found
            inner = min(self.closed[0], end // small)
            for j in self._open(0, outer * each, inner, log) if inner > outer * each else ():
                found = self._tested(j * small, (j + 1) * small, log)
                if found:
                    return found
            return self._tested(inner * small, end, log) if end > inner * small else None


def adaptive_window(df: DataFrame, value: str, delta: float = 0.002) -> DataFrame:
    """Adaptive windowing: cut the window at the first split whose two means differ too much.

    The state is the window itself, which grows until a cut, as the method asks. Every split is judged at every value, most by bounds of their block.
    """
    def block(state, pdf):
        size, fired = np.empty(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=bool)
        for i, x in enumerate(pdf[value].to_numpy(float)):
            state.add(x)
            found = state.cut(delta) if state.n >= 8 else None
            if found:
                fired[i] = True
                state = SplitSums(state.values[found:state.n])
            size[i] = state.n
        return state, pd.DataFrame({"window_size": size, "drift": fired})

    fields = [T.StructField("window_size", T.LongType()), T.StructField("drift", T.BooleanType())]
    return ordered_fold(df.select("stream_id", "step", value), ["stream_id"], "step", lambda: SplitSums(np.empty(0)), block, fields)


def bucketed_window(df: DataFrame, value: str, delta: float = 0.002, most: int = 5) -> DataFrame:
    """Adaptive windowing over an exponential histogram: splits are tried between buckets only, so a value costs O(log n) work and a stream O(log n) state.

    Buckets hold 1, 2, 4, ... values, at most `most` of each size, the oldest first; the two oldest of a size that has too many become one of
    the next size. The window is cut at the first split whose two means differ too much. For short streams `adaptive_window` tries every split.
    """
    def block(state, pdf):
        levels, sums = list(state[0]), list(state[1])
        out = []
        for x in pdf[value].to_numpy(float):
            levels.append(0)
            sums.append(x)
            level = 0
            while levels.count(level) > most:
                i = levels.index(level)
                levels[i:i + 2], sums[i:i + 2] = [level + 1], [sums[i] + sums[i + 1]]
                level += 1
            sizes = np.exp2(levels)
            n, cut = sizes.sum(), False
            if n >= 8:
                n0, head = np.cumsum(sizes)[:-1], np.cumsum(sums)
                n1 = n - n0
                wide = np.abs(head[:-1] / n0 - (head[-1] - head[:-1]) / n1) >= np.sqrt(0.5 * (1 / n0 + 1 / n1) * np.log(2 * n / delta))
                if wide.any():
                    cut, first = True, int(np.argmax(wide)) + 1
                    levels, sums = levels[first:], sums[first:]
            out.append((int(np.exp2(levels).sum()), len(levels), cut))
        return (levels, sums), pd.DataFrame(out, columns=["window_size", "buckets", "drift"])

    fields = [T.StructField("window_size", T.LongType()), T.StructField("buckets", T.LongType()), T.StructField("drift", T.BooleanType())]
    return ordered_fold(df.select("stream_id", "step", value), ["stream_id"], "step", lambda: ([], []), block, fields)


def score_histograms(batched: DataFrame, value: str = "p", bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1))
    got = batched.groupBy("stream_id", "step").agg(*[F.count_if(b == i).cast("double").alias(f"_b{i}")
                                                     for i in range(bins)])
    return got.select("stream_id", "step", F.array(*[f"_b{i}" for i in range(bins)]).alias("counts"))


def rolling_psi(histograms: DataFrame, window: int = 5, limit: float = 0.2, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Stability index of the last `window` batches against the first ones; it restarts after a firing."""
    def shares(counts):
        return np.maximum(counts / max(1.0, counts.sum()), floor)

    # State: batches seen, batches since the last start, reference counts, then the last `window` histograms.
    def block(state, pdf):
        seen, since = state[0], state[1]
        ref, ring = state[2:2 + bins].copy(), state[2 + bins:].reshape(window, bins).copy()
        psi, fired = np.full(len(pdf), np.nan), np.zeros(len(pdf), dtype=bool)
        for i, h in enumerate(pdf["counts"]):
            h = np.asarray(h, dtype=float)
            if seen < window:
                ref += h
            else:
                ring = np.vstack([ring[1:], h])
                since += 1
                if since >= window:
                    c, r = shares(ring.sum(axis=0)), shares(ref)
                    psi[i] = float(((c - r) * np.log(c / r)).sum())
                    if psi[i] >= limit:
                        fired[i], since = True, 0.0
            seen += 1
        out = pd.DataFrame({"drift": fired})
        out["psi"] = [None if np.isnan(v) else v for v in psi]
        return np.concatenate([[seen, since], ref, ring.ravel()]), out

    fields = [T.StructField("psi", DOUBLE), T.StructField("drift", T.BooleanType())]
    start = [0.0] * (2 + bins + window * bins)
    return ordered_fold(histograms, ["stream_id"], "step", start, block, fields)


def rolling_psi_open(histograms: DataFrame, window: int = 5, bins: int = 10, floor: float = 1e-4,
                     rows: int | None = None) -> DataFrame:
    """The same index without restarts: a sum of count arrays over a finite window."""
    def columns(w):
        frame = w.rowsBetween(-(window - 1), 0)
        return {f"_c{i}": F.sum(F.col("counts")[i]).over(frame) for i in range(bins)}

    ref = histograms.where(F.col("step") < window).groupBy("stream_id").agg(
        *[F.sum(F.col("counts")[i]).alias(f"_r{i}") for i in range(bins)])
    w = bounded_windows(histograms, ["stream_id"], "step", window, columns, rows).join(ref, "stream_id")

    def share(k, i):
        return F.greatest(F.col(f"_{k}{i}") / sum((F.col(f"_{k}{j}") for j in range(bins)), F.lit(0.0)), F.lit(floor))

    psi = sum(((share("c", i) - share("r", i)) * F.log(share("c", i) / share("r", i)) for i in range(bins)), F.lit(0.0))
    return w.where(F.col("step") >= 2 * window - 1).select("stream_id", "step", psi.alias("psi"))


def temporal_context(rows_df: DataFrame, key: str, time: str, features: Sequence[str], order: Sequence[Column],
                     rows: int | None = None) -> DataFrame:
    """Eight context features per row: place in time, gap, row shape, distance from two running means."""
    k = len(features)
    base = row_index(rows_df, [key], order, rows, index="idx", total="_n")

    def lagged(w):
        return {"_prev": F.lag(time, 1).over(w)}

    base = bounded_windows(base, [key], "idx", 1, lagged, rows)
    gap = F.coalesce(F.col(time) - F.col("_prev"), F.lit(0)).cast("double")
    # Stored, so that the quantiles and both passes of the scan read it and do not order the rows again.
    base = stored(base.withColumn("gap", gap).drop("_prev"))
    # Stored, so that the few rows are broadcast and the rows are not dealt by key.
    mid = stored(exact_quantiles(base.where(F.col("gap") > 0).select(key, "gap"), [key], "gap", {"_median": 0.5}, rows))

    # Running means start at the first row; the mean before a row follows from the mean after it.
    first, free = F.col("idx") == 0, float("inf")
    decays = {"_short": 0.85, "_long": 0.97}
    scan = {f"{n}{j}": (F.when(first, 0.0).otherwise(d), F.when(first, F.col(f)).otherwise((1 - d) * F.col(f)), -free, free, 0.0)
            for n, d in decays.items() for j, f in enumerate(features)}
    joined = clamped_scan(base, [key], "idx", scan, [c for c in base.columns if c not in (key, "idx")]).join(mid, key, "left")

    def before(n: str, j: int) -> Column:
        x, d = F.col(features[j]).cast("double"), decays[n]
        return F.when(first, x).otherwise((F.col(f"{n}{j}") - (1 - d) * x) / d)

    def over(make) -> Column:
        return sum((make(j) for j in range(k)), F.lit(0.0)) / k

    off = lambda n: lambda j: F.col(features[j]) - before(n, j)
    joined = joined.withColumns({
        "short_abs": over(lambda j: F.abs(off("_short")(j))), "long_abs": over(lambda j: F.abs(off("_long")(j))),
        "short_rms": F.sqrt(over(lambda j: off("_short")(j) * off("_short")(j))), "trend": over(lambda j: before("_short", j) - before("_long", j))})
    mean = sum((F.col(f) for f in features), F.lit(0.0)) / k
    var = sum(((F.col(f) - mean) * (F.col(f) - mean) for f in features), F.lit(0.0)) / k
    return joined.select(
        *rows_df.columns, "idx", (F.col("idx") / F.greatest(F.lit(1), F.col("_n") - 1)).alias("place"),
        F.log1p(F.greatest(F.lit(0.0), F.col("gap")) / F.greatest(F.coalesce("_median", F.lit(1.0)), F.lit(1e-6)))
        .alias("log_gap"), mean.alias("row_mean"), F.sqrt(var).alias("row_std"),
        "short_abs", "long_abs", "short_rms", "trend")
