"""The 38 window features by group: each group is matrix arithmetic over a batch of windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import series
from .windows import members, stride_of

SCALES = (2, 4, 8, 16, 32)
#: The features of each group, in the model matrix's order.
GROUPS = {
    "statistical": ["mean", "std", "median", "min", "max", "ptp", "skewness", "kurtosis", "slope", "intercept", "mad", "rms", "mean_abs_diff", "max_abs_diff"],
    "frequency": ["fft_amp_1", "fft_amp_2", "fft_amp_3", "dominant_freq", "spectral_entropy", "spectral_centroid", "spectral_rolloff"],
    "wavelet": [*[f"cwt_energy_scale{k}" for k in range(1, 6)], "wavelet_entropy", "max_energy_scale"],
    "autocorrelation": ["acf_lag1", "acf_lag5", "acf_lag10", "acf_first_zero", "acf_decay_rate"],
    "shape": ["asymmetry", "flatness", "edge_gradient_ratio", "min_position", "beyond_1sigma_frac"],
}


def names(groups: list[str] | None = None) -> list[str]:
    return [f for g in groups or GROUPS for f in GROUPS[g]]


def arrays(df: DataFrame, ws: int = 50) -> DataFrame:
    """One row per full window: series_id, window_id, label (if df has one), t and x in order."""
    label = [F.max("label").alias("label")] if "label" in df.columns else []
    kept = members(df, ws).select("series_id", "window_id", "pos", "time", "flux", *(["label"] if label else []))
    held = kept.groupBy("series_id", "window_id").agg(F.array_sort(F.collect_list(F.struct("pos", "time", "flux"))).alias("m"), *label)
    return held.select("series_id", "window_id", *(["label"] if label else []), F.col("m.time").alias("t"), F.col("m.flux").alias("x"))


def _moment(x: np.ndarray, k: int) -> np.ndarray:
    return ((x - x.mean(1, keepdims=True)) ** k).mean(1)


def _mad(x: np.ndarray) -> np.ndarray:
    return np.median(np.abs(x - np.median(x, axis=1, keepdims=True)), axis=1)


def statistical(x: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
    var, step = _moment(x, 2), np.abs(np.diff(x, axis=1))
    dt = t - t.mean(1, keepdims=True)
    slope = (dt * x).sum(1) / (dt * dt).sum(1)
    return [x.mean(1), np.sqrt(var), np.median(x, axis=1), x.min(1), x.max(1), np.ptp(x, axis=1), _moment(x, 3) / var**1.5, _moment(x, 4) / var**2 - 3, slope, x.mean(1) - slope * t.mean(1), _mad(x), np.sqrt((x * x).mean(1)), step.mean(1), step.max(1)]


def frequency(x: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
    n = x.shape[1]
    if n < 4:
        return [np.zeros(len(x))] * 7
    size = np.abs(np.fft.rfft(x - x.mean(1, keepdims=True), axis=1))[:, 1:]
    freq = np.fft.rfftfreq(n)[1:]
    top = np.sort(size, axis=1)[:, ::-1][:, :3]
    top = np.pad(top, ((0, 0), (0, 3 - top.shape[1])))
    share = size**2 / ((size**2).sum(1, keepdims=True) + 1e-12)
    entropy = -(share * np.log2(share + 1e-12)).sum(1)
    roll = np.minimum((np.cumsum(share, axis=1) < 0.85).sum(1), len(freq) - 1)
    return [*top.T, freq[size.argmax(1)], entropy, share @ freq, freq[roll]]


@lru_cache(maxsize=64)
def ricker(n: int, scale: int) -> np.ndarray:
    """The (n, n) matrix that takes a window to its Mexican-hat coefficients at a scale.

    The wavelet is integrated on 1,024 places of [-8, 8] and read at the scale's steps; coefficients are differences of the
    convolution with that integral, cut to the window's middle.
    """
    at = np.linspace(-8, 8, 1024)
    step = at[1] - at[0]
    integral = np.cumsum(2 / (np.sqrt(3) * np.pi**0.25) * (1 - at**2) * np.exp(-(at**2) / 2)) * step
    read = np.minimum((np.arange(16 * scale + 1) / (scale * step)).astype(int), 1023)
    kernel = np.diff(np.concatenate([[0.0], integral[read][::-1], [0.0]]))  # kernel[r + 1] is the step from place r to r + 1
    r = 8 * scale - 1 + np.arange(n)[:, None] - np.arange(n)[None, :] + 1
    return -np.sqrt(scale) * np.where((r >= 0) & (r < len(kernel)), kernel[np.clip(r, 0, len(kernel) - 1)], 0.0)


def wavelet(x: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
    n = x.shape[1]
    scales = [s for s in SCALES if s < n // 2]
    if n < 8 or not scales:
        return [np.zeros(len(x))] * 7
    c = x - x.mean(1, keepdims=True)
    energy = np.stack([((c @ ricker(n, s).T) ** 2).sum(1) for s in scales], axis=1)
    share = energy / (energy.sum(1, keepdims=True) + 1e-12)
    padded = np.pad(energy, ((0, 0), (0, 5 - len(scales))))
    return [*padded.T, -(share * np.log2(share + 1e-12)).sum(1), energy.argmax(1) + 1.0]


def autocorrelation(x: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
    n = x.shape[1]
    if n < 12:
        return [np.zeros(len(x))] * 5
    c, var = x - x.mean(1, keepdims=True), x.var(1)
    last = min(n // 2, 30)
    acf = np.stack([(c[:, : n - k] * c[:, k:]).mean(1) / np.maximum(var, 1e-300) for k in range(last + 1)], axis=1)
    lag = lambda k: acf[:, k] if k <= last else np.zeros(len(x))
    under = acf[:, 1:] <= 0
    zero = np.where(under.any(1), under.argmax(1) + 1.0, float(last))
    decay = np.where((np.abs(lag(1)) > 1e-6) & (last >= 5), -np.log(np.abs(lag(5)) + 1e-12) / 5, 0.0)
    return [np.where(var < 1e-12, 0.0, v) for v in (lag(1), lag(5), lag(10), zero, decay)]


def shape(x: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
    n = x.shape[1]
    if n < 4:
        return [np.zeros(len(x))] * 5
    step, edge, std = np.abs(np.diff(x, axis=1)), max(1, n // 5), x.std(1)
    centre = step[:, edge:-edge].mean(1) if n > 2 * edge + 1 else np.full(len(x), 1e-12)
    edges = step[:, :edge].mean(1) + step[:, -edge:].mean(1)
    far = np.abs(x - x.mean(1, keepdims=True)) > std[:, None]
    return [x[:, : n // 2].mean(1) - x[:, n // 2 :].mean(1), _mad(x) / (std + 1e-12), edges / (centre + 1e-12), x.argmin(1) / (n - 1), far.mean(1)]


_OF: dict[str, Callable] = {"statistical": statistical, "frequency": frequency, "wavelet": wavelet, "autocorrelation": autocorrelation, "shape": shape}


def _finished(own: list, x: np.ndarray, t: np.ndarray, wanted: list[str], columns: list[str]) -> pa.RecordBatch:
    """The columns of some windows with their features beside them."""
    with np.errstate(all="ignore"):
        values = [v for g in wanted for v in _OF[g](x, t)] if len(x) else [np.zeros(0)] * len(names(wanted))
    out = [pa.array(np.asarray(v, dtype=float), pa.float64(), mask=~np.isfinite(v)) for v in values]
    return pa.RecordBatch.from_arrays([*own, *out], names=columns)


def features(df: DataFrame, ws: int = 50, groups: list[str] | None = None) -> DataFrame:
    """series_id, window_id, label (if df has one) and the features of the groups (all: 38). A value that is not finite, such as
    the skewness of a constant window, is null. Only groups that are asked for are computed.

    A task reads its series' points in order and cuts the windows out of them, so no point is multiplied or collected; a series in parts
    (`cut_points`) is no one task's, and its windows are gathered point by point.
    """
    wanted = [g for g in GROUPS if groups is None or g in groups]
    told = ["label"] if "label" in df.columns else []
    columns, numbers = ["series_id", "window_id", *told, *names(wanted)], "".join(f", {c} double" for c in names(wanted))
    kinds = dict(df.dtypes)
    label = f", label {kinds['label']}" if told else ""
    if "part" in df.columns:

        def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                t, x = (np.asarray(b.column(2 + len(told) + k).flatten(), dtype=float).reshape(-1, ws) for k in range(2))
                yield _finished(b.columns[: 2 + len(told)], x, t, wanted, columns)

        return arrays(df, ws).mapInArrow(computed, f"series_id {kinds['series_id']}, window_id int{label}{numbers}")

    st = stride_of(ws)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            rest.append(b)
            b = pa.Table.from_batches(rest).combine_chunks()
            held = len(b) - ws + 1
            rest = b.slice(max(0, held)).to_batches()
            if held <= 0:
                continue
            # A window's last point is ws - 1 on if no other series begins between, and no place of a given idx is missing.
            k, place = b.column(1).to_numpy(), b.column(2).to_numpy()
            at = np.flatnonzero((place[:held] % st == 0) & (k[ws - 1 :] == k[:held] + ws - 1) & (place[ws - 1 :] == place[:held] + ws - 1))
            t, x, *y = (np.lib.stride_tricks.sliding_window_view(b.column(3 + c).to_numpy().astype(float, copy=False), ws)[at] for c in range(2 + len(told)))
            largest = [np.fmax.reduce(v, axis=1) for v in y]
            own = [b.column(0).take(pa.array(at)).combine_chunks(), pa.array(place[at] // st, pa.int32()), *[pa.array(v, pa.float64(), mask=np.isnan(v)) for v in largest]]
            yield _finished(own, x, t, wanted, columns)

    order = "idx" if "idx" in df.columns else "ord"
    k = F.row_number().over(series().orderBy(order))
    place = F.col("idx") if order == "idx" else k - 1
    ordered = df.select("series_id", order, k.alias("k"), place.alias("place"), *[F.col(c).cast("double").alias(c) for c in ("time", "flux", *told)]).sortWithinPartitions("series_id", order)
    found = ordered.drop(order).mapInArrow(cut, f"series_id {kinds['series_id']}, window_id int{', label double' if told else ''}{numbers}")
    return found.withColumn("label", F.col("label").cast(kinds["label"])) if told else found


def model_matrix(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """features() with every null, NaN or infinity as 0, as models take them."""
    wanted = set(names(groups))
    fit = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c))
    return df.select(*[fit(c).alias(c) if c in wanted else F.col(c) for c in df.columns if c in wanted or c not in names()])
