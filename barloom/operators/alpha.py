"""The 158-feature panel: nine shapes of a bar, four prices, 29 rolling features over each of five windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.panel import div, in_order, lead

WINDOWS = (5, 10, 20, 30, 60)
EPS = 1e-12
SHAPES = ("KMID", "KLEN", "KMID2", "KUP", "KUP2", "KLOW", "KLOW2", "KSFT", "KSFT2")
PRICES = ("OPEN0", "HIGH0", "LOW0", "VWAP0")
ROLLING = ("ROC", "MA", "STD", "BETA", "RSQR", "RESI", "MAX", "MIN", "QTLU", "QTLD", "RANK", "RSV", "IMAX", "IMIN", "IMXD", "CORR", "CORD", "CNTP", "CNTN", "CNTD", "SUMP", "SUMN", "SUMD", "VMA", "VSTD", "WVMA", "VSUMP", "VSUMN", "VSUMD")


def feature_names(windows: tuple[int, ...] = WINDOWS) -> list[str]:
    return [*SHAPES, *PRICES, *(f"{k}{d}" for k in ROLLING for d in windows)]


def shapes() -> dict[str, Column]:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    reach = h - low + EPS
    top, bottom = h - F.greatest(o, c), F.least(o, c) - low
    over = {"KMID": c - o, "KLEN": h - low, "KUP": top, "KLOW": bottom, "KSFT": 2 * c - h - low}
    out = {k: div(v, o) for k, v in over.items()} | {f"{k}2": v / reach for k, v in over.items() if k != "KLEN"}
    return {k: out[k] for k in SHAPES}


def prices(bars: DataFrame) -> dict[str, Column]:
    """Relative to the close; the average price is vwap, else amount by volume, else the typical price."""
    c = F.col("close")
    if "vwap" in bars.columns:
        average = F.col("vwap")
    elif "amount" in bars.columns:
        average = div(F.col("amount"), F.col("volume"))
    else:
        average = (F.col("high") + F.col("low") + c) / 3
    return {"OPEN0": div(F.col("open"), c), "HIGH0": div(F.col("high"), c), "LOW0": div(F.col("low"), c), "VWAP0": div(average, c)}


def _divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, unknown where b is zero."""
    return a / np.where(b == 0, np.nan, b)


def _correlated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The correlation of each window's pairs, unknown where a side is constant."""
    flat = (x.max(axis=1) == x.min(axis=1)) | (y.max(axis=1) == y.min(axis=1))
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    spread = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    return np.where(flat, np.nan, (x * y).sum(axis=1) / np.where(flat, np.nan, spread))


def rolling(d: int, kinds: set[str], rn: np.ndarray, close: np.ndarray, high: np.ndarray, low: np.ndarray, volume: np.ndarray) -> dict[str, np.ndarray]:
    """The features of ``kinds`` over d bars, for bars of one symbol after another; rn numbers a symbol's bars from 1.

    A feature is unknown (NaN) before a symbol's d-th bar, and where its window
    holds an unknown input.
    """
    out: dict[str, np.ndarray] = {}

    def windows(x: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(d - 1, np.nan), x]), d)

    def before(x: np.ndarray, n: int) -> np.ndarray:
        y = np.concatenate([np.full(n, np.nan), x])[: len(x)]
        return np.where(rn > n, y, np.nan)

    def mean(x: np.ndarray) -> np.ndarray:
        return windows(x).mean(axis=1)

    def deviation(x: np.ndarray) -> np.ndarray:
        w = windows(x)
        return np.sqrt(np.square(w - w.mean(axis=1, keepdims=True)).sum(axis=1) / (d - 1))

    def both(name: str, change: np.ndarray) -> dict[str, np.ndarray]:
        w = windows(change)
        total = np.abs(w).sum(axis=1) + EPS
        plus, minus = np.maximum(w, 0).sum(axis=1) / total, np.maximum(-w, 0).sum(axis=1) / total
        return {f"{name}P": plus, f"{name}N": minus, f"{name}D": plus - minus}

    was, volume_was = before(close, 1), before(volume, 1)
    c = windows(close)
    if kinds & {"ROC"}:
        out["ROC"] = _divided(before(close, d), close)
    if kinds & {"MA", "STD"}:
        out |= {"MA": _divided(mean(close), close), "STD": _divided(deviation(close), close)}
    if kinds & {"BETA", "RSQR", "RESI"}:
        k = np.arange(d) - (d - 1) / 2
        middle = c.mean(axis=1)
        slope = (c * k).sum(axis=1) / (k * k).sum()
        spread = np.square(c - middle[:, None]).sum(axis=1)
        flat = c.max(axis=1) == c.min(axis=1)
        out |= {"BETA": _divided(slope, close), "RSQR": slope**2 * (k * k).sum() / np.where(flat, np.nan, spread), "RESI": _divided(close - (middle + slope * ((d - 1) / 2)), close)}
    if kinds & {"MAX", "MIN", "RSV", "IMAX", "IMIN", "IMXD"}:
        top, bottom = windows(high), windows(low)
        most, least = top.max(axis=1), bottom.min(axis=1)
        since_top, since_bottom = (np.where(np.isnan(x), np.nan, d - 1 - i) for x, i in ((most, top.argmax(axis=1)), (least, bottom.argmin(axis=1))))
        out |= {"MAX": _divided(most, close), "MIN": _divided(least, close), "RSV": (close - least) / (most - least + EPS), "IMAX": since_top / d, "IMIN": since_bottom / d, "IMXD": (since_top - since_bottom) / d}
    if kinds & {"QTLU", "QTLD"}:
        order = np.sort(c, axis=1)  # unknown values last
        order[np.isnan(order[:, -1])] = np.nan
        for name, share in (("QTLU", 0.8), ("QTLD", 0.2)):
            at, part = divmod((d - 1) * share, 1)
            lower, upper = order[:, int(at)], order[:, min(int(at) + 1, d - 1)]
            out[name] = _divided(lower * (1 - part) + upper * part, close)
    if kinds & {"RANK"}:
        known = np.where(np.isnan(c).any(axis=1), np.nan, 1.0)
        out["RANK"] = known * ((c < close[:, None]).sum(axis=1) + ((c == close[:, None]).sum(axis=1) + 1) / 2) / d
    if kinds & {"CORR"}:
        out["CORR"] = _correlated(c, windows(np.log(volume + EPS)))
    if kinds & {"CORD"}:
        out["CORD"] = _correlated(windows(_divided(close, was)), windows(np.log(_divided(volume, volume_was) + 1)))
    if kinds & {"CNTP", "CNTN", "CNTD"}:
        up, down = mean((close > was).astype(float)), mean((close < was).astype(float))
        out |= {"CNTP": up, "CNTN": down, "CNTD": up - down}
    if kinds & {"SUMP", "SUMN", "SUMD"}:
        out |= both("SUM", close - was)
    if kinds & {"VMA", "VSTD"}:
        out |= {"VMA": mean(volume) / (volume + EPS), "VSTD": deviation(volume) / (volume + EPS)}
    if kinds & {"WVMA"}:
        moved = np.abs(_divided(close, was) - 1) * volume
        out["WVMA"] = deviation(moved) / (mean(moved) + EPS)
    if kinds & {"VSUMP", "VSUMN", "VSUMD"}:
        out |= both("VSUM", volume - volume_was)
    return {f"{k}{d}": np.where(rn >= d, x, np.nan) for k, x in out.items() if k in kinds}


def panel(bars: DataFrame, windows: tuple[int, ...] = WINDOWS, names: list[str] | None = None, least: int | None = None, horizon: int | None = None) -> DataFrame:
    """symbol, date and the features (all, or ``names``) of symbols with at least ``least`` bars (the longest window and ten); with ``horizon``, the label of :func:`forward_return` too.

    One exchange by symbol.  The rolling features are taken from a symbol's bars
    in order as they stream by, in whole arrays over all symbols of an Arrow
    batch; of what went before, only the longest window is kept.
    """
    least = max(windows) + 10 if least is None else least
    wanted = names or feature_names(windows)
    still = shapes() | prices(bars)
    moving = {n: (d, k) for k in ROLLING for d in windows if (n := f"{k}{d}") in wanted}
    out = bars.repartition("symbol").withColumns({"__n": F.count(F.lit(1)).over(Window.partitionBy("symbol")), "__rn": F.row_number().over(in_order())})
    keep = ["symbol", "date"]
    if horizon is not None:
        out, keep = out.withColumn("label", div(lead("close", horizon), F.col("close")) - 1), [*keep, "label"]
    kept = [*keep, *(n for n in wanted if n in still)]
    out = out.filter(F.col("__n") >= least).select(*keep, *(still[n].alias(n) for n in kept if n in still), F.col("__rn").cast("double").alias("__rn"), *(F.col(c).cast("double").alias(f"__{c}") for c in ("close", "high", "low", "volume")))
    out = out.sortWithinPartitions("symbol", "date")
    schema = T.StructType([out.schema[n] if n in kept else T.StructField(n, T.DoubleType()) for n in [*keep, *wanted]])
    by_length: dict[int, set[str]] = {}
    for d, k in moving.values():
        by_length.setdefault(d, set()).add(k)
    reach = max(by_length, default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((5, 0))
        for batch in batches:
            new = np.vstack([batch.column(len(kept) + i).to_numpy(zero_copy_only=False) for i in range(5)])
            whole = np.hstack([last, new])
            with np.errstate(all="ignore"):
                made = {n: x[last.shape[1] :] for d, kinds in by_length.items() for n, x in rolling(d, kinds, *whole).items()}
            last = whole[:, max(0, whole.shape[1] - reach) :]
            columns = [batch.column(kept.index(n)) if n in kept else pa.array(made[n], pa.float64(), from_pandas=True) for n in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return out.mapInArrow(run, schema) if moving else out.select(*schema.names)


def forward_return(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """symbol, date, label: close ``horizon`` bars ahead over this one, less 1."""
    return bars.select("symbol", "date", (div(lead("close", horizon), F.col("close")) - 1).alias("label"))
