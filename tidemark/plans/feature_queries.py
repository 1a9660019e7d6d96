"""Queries of window features, smoothing, gap filling, periodograms and the windows' say on points, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clean as C
from tidemark.operators import features as X
from tidemark.operators import periods as P
from tidemark.operators import smooth as S
from tidemark.operators import windows as W
from tidemark.plans.queries import _K, _LC, _US, _WIN, _keyed, _round
from tidemark.sources import bindings as B


def _z(s, d):
    """Normalised series: features of unit size, so that rounding means the same in every engine."""
    return C.normalize(B.lc_supplier(s, d)).drop("flux_mean", "flux_std")


def _group(s, d, group, *names):
    return _round(X.features(_z(s, d), groups=[group]).select("series_id", "window_id", *names))


def win_trend(s, d):
    return _group(s, d, "statistical", "slope", "intercept")


def win_diff(s, d):
    return _group(s, d, "statistical", "mean_abs_diff", "max_abs_diff")


def win_fft_amps(s, d):
    return _group(s, d, "frequency", "fft_amp_1", "fft_amp_2", "fft_amp_3", "dominant_freq")


def win_spectral(s, d):
    return _group(s, d, "frequency", "spectral_entropy", "spectral_centroid", "spectral_rolloff")


def win_cwt(s, d):
    return _group(s, d, "wavelet", *X.GROUPS["wavelet"])


def win_acf(s, d):
    return _group(s, d, "autocorrelation", *X.GROUPS["autocorrelation"])


def win_shape(s, d):
    return _group(s, d, "shape", *X.GROUPS["shape"])


def window_features(s, d):
    """All 38, as models take them."""
    return _round(X.model_matrix(X.features(_z(s, d))))


def _gappy(s, d):
    rows = C.index_points(C.spread(B.lc_supplier(s, d)))
    return rows.withColumn("flux", F.when(F.col("ord.l_partkey") % 3 == 0, F.col("flux")))


def fill_gaps(s, d):
    """Rounded far beyond halves of the data's cents."""
    filled = S.fill_gaps(_gappy(s, d))
    return _round(filled.select("series_id", "ord.l_orderkey", "ord.l_linenumber", "ord.l_partkey", "flux"), 8)


def preprocess(s, d):
    return _keyed(S.preprocess(C.spread(B.lc_supplier(s, d)), 2.0), "flux")


def first_difference(s, d):
    return _round(S.differences(B.lc_supplier(s, d)).select("series_id", "idx", "diff"))


def running_mean(s, d):
    return _round(S.running_mean(B.lc_supplier(s, d)).select("series_id", "idx", "running_mean"))


def savgol(s, d):
    return _round(S.savgol(_z(s, d)).select("series_id", "idx", "smooth"))


def periodogram(s, d):
    return _round(P.lomb_scargle(B.lc_daily(s, d)).select("k", "frequency", "power"), 6)


def lomb_scargle(s, d):
    return _round(P.lomb_scargle_features(B.lc_daily(s, d)), 5)


def bls_features(s, d):
    return _round(P.box_features(B.lc_daily(s, d)))


def bls_detector(s, d):
    return P.box_detector(B.lc_daily(s, d)).select("series_id", "time", "is_anomaly")


def _scored_windows(s, d):
    rows = C.spread(B.lc_supplier(s, d))
    return rows, W.members(rows).groupBy("series_id", "window_id").agg(F.max("label").alias("flag"), (-F.round(F.max("flux") - F.min("flux"))).alias("score"))


def points_any(s, d):
    points, flags = _scored_windows(s, d)
    return W.to_points(points, flags).select("series_id", "idx", "is_any", "n_windows")


def points_score(s, d):
    points, flags = _scored_windows(s, d)
    return _round(W.to_points(points, flags).select("series_id", "idx", "point_score", "is_score"))


def window_sequences(s, d):
    """Runs of ten windows, by the sums of their values: what a recurrent model reads."""
    runs = S.sequences(W.statistics(B.lc_supplier(s, d)), ["max", "min"])
    total = F.aggregate("rows", F.lit(0.0), lambda t, r: t + F.get(r, F.lit(0)))
    return _round(runs.select("series_id", "start", F.size("rows").alias("length"), total.alias("total")))


def sequence_scores(s, d):
    """An error for each run of ten windows (its start, here), as the mean over the runs that cover a window."""
    windows = W.statistics(B.lc_supplier(s, d))
    errors = S.sequences(windows, ["max"]).select("series_id", "start", F.col("start").cast("double").alias("error"))
    return _round(S.sequence_scores(errors, windows))


QUERIES = {f.__name__: f for f in (win_trend, win_diff, win_fft_amps, win_spectral, win_cwt, win_acf, win_shape, window_features, fill_gaps, preprocess, first_difference, running_mean, savgol, periodogram, lomb_scargle, bls_features, bls_detector, points_any, points_score, window_sequences, sequence_scores)}

_LZ = _LC.replace("lc as (", "lc0 as (", 1) + ", lc as (select * replace ((flux - avg(flux) over (partition by series_id)) / stddev_samp(flux) over (partition by series_id) as flux) from lc0)"
_W = f"{_LZ}, {_WIN}, w0 as (select series_id, window_id, list(flux order by idx) as x, list(time order by idx) as t from win group by 1, 2), w1 as (select *, list_avg(x) as mu, list_aggregate(x, 'stddev_pop') as sd, list_aggregate(x, 'median') as md from w0), w as (select *, list_transform(x, lambda v: v - mu) as c, list_transform(range(1, 50), lambda i: abs(x[i + 1] - x[i])) as g, list_aggregate(list_transform(x, lambda v: abs(v - md)), 'median') as mad from w1)"
_FFT = f"{_W}, f0 as (select series_id, window_id, list_transform(range(1, 26), lambda k: sqrt(pow(list_sum(list_transform(range(0, 50), lambda j: c[j + 1] * cos(2 * pi() * k * j / 50))), 2) + pow(list_sum(list_transform(range(0, 50), lambda j: c[j + 1] * sin(2 * pi() * k * j / 50))), 2))) as m from w), f1 as (select *, list_sum(list_transform(m, lambda v: v * v)) + 1e-12 as total from f0), f as (select *, list_transform(m, lambda v: v * v / total) as p, list_reverse_sort(m) as top from f1)"
_CWT = f"{_W}, psi as (select k, sum(2 / (sqrt(3) * pow(pi(), 0.25)) * (1 - u * u) * exp(-u * u / 2)) over (order by k) * 16 / 1023 as v from (select k, -8 + 16.0::double * k / 1023 as u from range(0, 1024) r(k))), scale as (select unnest([2, 4, 8, 16]) as s), place as (select s, r from scale, range(-200, 400) q(r) where r between 8 * s - 50 and 8 * s + 48), ker as (select s, list(coalesce(a.v, 0) - coalesce(b.v, 0) order by r) as h from place left join psi a on r + 1 between 0 and 16 * s and a.k = ((16 * s - r - 1) * 1023) // (16 * s) left join psi b on r between 0 and 16 * s and b.k = ((16 * s - r) * 1023) // (16 * s) group by s), e as (select series_id, window_id, s, s * list_sum(list_transform(range(0, 50), lambda p: pow(list_sum(list_transform(range(0, 50), lambda i: c[i + 1] * h[p - i + 50])), 2))) as e from w, ker), e1 as (select series_id, window_id, max(e) filter (s = 2) as e1, max(e) filter (s = 4) as e2, max(e) filter (s = 8) as e3, max(e) filter (s = 16) as e4, sum(e) + 1e-12 as total, case arg_max(s, e) when 2 then 1.0 when 4 then 2.0 when 8 then 3.0 else 4.0 end as best from e group by 1, 2)"
_ACF = f"{_W}, a0 as (select series_id, window_id, list_transform(range(0, 26), lambda k: list_sum(list_transform(range(1, 51 - k), lambda i: c[i] * c[i + k])) / (50 - k) / (sd * sd)) as a from w)"
_LS = "dy as (select epoch_us(l_shipdate) / 86400e6 as time, sum(round(l_extendedprice)::bigint)::double as flux from lineitem group by 1), st as (select count(*) as n, avg(flux) as mu, 1 / (max(time) - min(time)) as low, 1 / (2 * median(dt)) as high from (select *, time - lag(time) over (order by time) as dt from dy)), gr as (select k, low + k * (high - low) / 999 as w, n, mu from st, range(0, 1000) r(k)), sm as (select k, w, n, sum((flux - mu) * cos(w * time)) as yc, sum((flux - mu) * sin(w * time)) as ys, sum((flux - mu) * (flux - mu)) as yy, atan2(sum(sin(2 * w * time)), sum(cos(2 * w * time))) / 2 as turn, sqrt(pow(sum(cos(2 * w * time)), 2) + pow(sum(sin(2 * w * time)), 2)) as r from gr, dy group by k, w, n), pw as (select k, w, (pow(yc * cos(turn) + ys * sin(turn), 2) / ((n + r) / 2) + pow(ys * cos(turn) - yc * sin(turn), 2) / ((n - r) / 2)) / yy as power from sm)"
_SC = f"{_LC}, {_WIN}, fl as (select series_id, window_id, max(label) as flag, -round(max(flux) - min(flux)) as score from win group by 1, 2), v as (select win.series_id, win.idx, max(flag) > 0 as is_any, count(*) as n_windows, avg(score) as ps from win join fl using (series_id, window_id) group by 1, 2), pt as (select lc.series_id, lc.idx::int as idx, coalesce(is_any, false) as is_any, coalesce(n_windows, 0) as n_windows, coalesce(ps, 0.0) as ps from lc left join v using (series_id, idx))"
_SQ = f"{_LC}, {_WIN}, sw as (select series_id, window_id, max(flux) as mx, row_number() over (partition by series_id order by window_id) - 1 as place, count(*) over (partition by series_id) as m from win group by 1, 2)"

ORACLES = {
    "win_trend": f"with {_LZ}, {_WIN} select series_id, window_id, round(regr_slope(flux, time), 4) as slope, round(regr_intercept(flux, time), 4) as intercept from win group by 1, 2",
    "win_diff": f"with {_W} select series_id, window_id, round(list_avg(g), 4) as mean_abs_diff, round(list_max(g), 4) as max_abs_diff from w",
    "win_fft_amps": f"with {_FFT} select series_id, window_id, round(top[1], 4) as fft_amp_1, round(top[2], 4) as fft_amp_2, round(top[3], 4) as fft_amp_3, round(list_position(m, top[1]) / 50, 4) as dominant_freq from f",
    "win_spectral": f"with {_FFT} select series_id, window_id, round(-list_sum(list_transform(p, lambda v: v * log2(v + 1e-12))), 4) as spectral_entropy, round(list_sum(list_transform(range(1, 26), lambda k: p[k] * k / 50)), 4) as spectral_centroid, round((least(24, len(list_filter(range(1, 26), lambda k: list_sum(p[1:k]) < 0.85))) + 1) / 50, 4) as spectral_rolloff from f",
    "win_cwt": f"with {_CWT} select series_id, window_id, round(e1, 4) as cwt_energy_scale1, round(e2, 4) as cwt_energy_scale2, round(e3, 4) as cwt_energy_scale3, round(e4, 4) as cwt_energy_scale4, 0.0::double as cwt_energy_scale5, round(-(e1 / total * log2(e1 / total + 1e-12) + e2 / total * log2(e2 / total + 1e-12) + e3 / total * log2(e3 / total + 1e-12) + e4 / total * log2(e4 / total + 1e-12)), 4) as wavelet_entropy, best::double as max_energy_scale from e1",
    "win_acf": f"with {_ACF} select series_id, window_id, round(a[2], 4) as acf_lag1, round(a[6], 4) as acf_lag5, round(a[11], 4) as acf_lag10, coalesce(list_min(list_filter(range(1, 26), lambda k: a[k + 1] <= 0)), 25)::double as acf_first_zero, round(case when abs(a[2]) > 1e-6 then -ln(abs(a[6]) + 1e-12) / 5 else 0.0 end, 4) as acf_decay_rate from a0",
    "win_shape": f"with {_W} select series_id, window_id, round(list_avg(x[1:25]) - list_avg(x[26:50]), 4) as asymmetry, round(mad / (sd + 1e-12), 4) as flatness, round((list_avg(g[1:10]) + list_avg(g[40:49])) / (list_avg(g[11:39]) + 1e-12), 4) as edge_gradient_ratio, round((list_position(x, list_min(x)) - 1) / 49, 4) as min_position, round(len(list_filter(x, lambda v: abs(v - mu) > sd)) / 50, 4) as beyond_1sigma_frac from w",
    "fill_gaps": f"with {_LC}, g as (select * replace (case when l_partkey % 3 = 0 then flux end as flux) from lc), a as (select *, case when flux is not null then idx end as here from g), b as (select *, max(here) over (partition by series_id order by idx) as ai, min(here) over (partition by series_id order by idx desc) as bi from a), f as (select b.*, p.flux as av, q.flux as bv from b left join g p on p.series_id = b.series_id and p.idx = ai left join g q on q.series_id = b.series_id and q.idx = bi) select {_K}, round(coalesce(flux, case when idx - ai <= 5 then av + coalesce((bv - av) * (idx - ai) / (bi - ai), 0) end), 8) as flux from f",
    "preprocess": f"with {_LC}, m as (select *, median(flux) over (partition by series_id) as md, stddev_pop(flux) over (partition by series_id) as sd from lc), k as (select * from m where abs(flux - md) < 2 * sd) select {_K}, round((flux - avg(flux) over (partition by series_id)) / stddev_samp(flux) over (partition by series_id), 4) as flux from k",
    "first_difference": f"with {_LC} select series_id, idx::int as idx, round(flux - lag(flux) over (partition by series_id order by idx), 4) as diff from lc",
    "running_mean": f"with {_LC}, a as (select *, least(50, n // 10) as w from lc), b as (select a.series_id, a.idx, max(a.w) as w, count(*) as m, avg(c.flux) as v from a join lc c on c.series_id = a.series_id and c.idx between a.idx - a.w // 2 and a.idx + a.w - 1 - a.w // 2 group by 1, 2) select series_id, idx::int as idx, round(case when m = w then v end, 4) as running_mean from b",
    "savgol": f"with {_LZ}, a as (select *, greatest(0, least(idx - 10, n - 21)) as low from lc), b as (select a.series_id, a.idx, (a.idx - low - 10)::double as u, (c.idx - low - 10)::double as v, c.flux as y from a join lc c on c.series_id = a.series_id and c.idx between low and low + 20) select series_id, idx::int as idx, round(sum(y * (1.0 / 21 + u * v / 770 + (u * u - 110.0 / 3) * (v * v - 110.0 / 3) / (10.0 * 11 * 19 * 21 * 23 / 45) + (u * u * u - 65.8 * u) * (v * v * v - 65.8 * v) / (9.0 * 10 * 11 * 12 * 19 * 21 * 23 / 175))), 4) as smooth from b group by 1, 2",
    "periodogram": f"with {_LS} select k::int as k, round(w, 6) as frequency, round(power, 6) as power from pw",
    "lomb_scargle": f"with {_LS}, t as (select *, row_number() over (order by power desc) as o from pw) select 1 as series_id, round(max(power), 5) as ls_max_power, round(max(1 / (w + 1e-12)) filter (o = 1), 5) as ls_dominant_period, round(max(power) filter (o = 2), 5) as ls_second_power, round(max(power) filter (o = 2) / (max(power) + 1e-12), 5) as ls_power_ratio from t",
    "points_any": f"with {_SC} select series_id, idx, is_any, n_windows from pt",
    "points_score": f"with {_SC} select series_id, idx, round(ps, 4) as point_score, ps < quantile_cont(ps, 0.1) over (partition by series_id) - 1e-9 * abs(quantile_cont(ps, 0.1) over (partition by series_id)) as is_score from pt",
    "window_sequences": f"with {_SQ} select a.series_id, a.place::int as start, 10 as length, round(sum(b.mx), 4) as total from sw a join sw b on b.series_id = a.series_id and b.place between a.place and a.place + 9 where a.place = 0 or a.place + 10 <= a.m group by 1, 2",
    "sequence_scores": f"with {_SQ} select a.series_id, a.place::int as place, round(-avg(b.place), 4) as score from sw a join sw b on b.series_id = a.series_id and b.place between a.place - 9 and a.place and (b.place = 0 or b.place + 10 <= b.m) group by 1, 2",
}
_NAMES = {"win_stats": ["mean", "std", "median", "min", "max", "ptp", "skewness", "kurtosis", "mad", "rms"]}
ORACLES["window_features"] = (
    f"with st as (with {_W} select series_id, window_id, mu as mean, sd as std, md as median, list_min(x) as min, list_max(x) as max, list_max(x) - list_min(x) as ptp, list_avg(list_transform(c, lambda v: v * v * v)) / pow(sd, 3) as skewness, list_avg(list_transform(c, lambda v: pow(v, 4))) / pow(sd, 4) - 3 as kurtosis, mad, sqrt(list_avg(list_transform(x, lambda v: v * v))) as rms from w), lb as (with {_LC}, {_WIN} select series_id, window_id, max(label) as label from win group by 1, 2)"
    + "".join(f", {n} as ({ORACLES[n]})" for n in ("win_trend", "win_diff", "win_fft_amps", "win_spectral", "win_cwt", "win_acf", "win_shape"))
    + " select series_id, window_id, label, " + ", ".join(f"round(st.{n}, 4) as {n}" for n in _NAMES["win_stats"])
    + ", " + ", ".join(n for g in X.GROUPS.values() for n in g if n not in _NAMES["win_stats"])
    + " from st join lb using (series_id, window_id)" + "".join(f" join {n} using (series_id, window_id)" for n in ("win_trend", "win_diff", "win_fft_amps", "win_spectral", "win_cwt", "win_acf", "win_shape"))
)
