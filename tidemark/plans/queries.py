"""Queries over the test tables, and the same in DuckDB SQL. Floats are rounded on both sides: sums differ in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import evaluate
from tidemark.operators import clean as C
from tidemark.operators import detect as D
from tidemark.operators import windows as W
from tidemark.sources import bindings as B


def _round(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


KEY = ["series_id", "l_orderkey", "l_linenumber", "l_partkey"]


def _keyed(df: DataFrame, *cols: str) -> DataFrame:
    """Rows by their source keys instead of the order struct."""
    return _round(df.select("series_id", *[F.col(f"ord.{k}").alias(k) for k in KEY[1:]], *cols))


def lc_clean(s: SparkSession, d: str) -> DataFrame:
    return _keyed(C.clean(B.lc_supplier(s, d)), "time", "flux", "flux_err", "label")


def lc_summary(s, d):
    return _round(C.summary(B.lc_supplier(s, d)))


def lc_global_stats(s, d):
    return _round(C.global_stats(B.lc_supplier(s, d)))


def sigma_clip(s, d):
    return _keyed(C.sigma_clip(B.lc_supplier(s, d), 2.0), "flux")


def normalize_flux(s, d):
    return _keyed(C.normalize(B.lc_supplier(s, d)), "flux", "flux_mean", "flux_std")


def denormalize_flux(s, d):
    return _keyed(C.denormalize(C.normalize(B.lc_supplier(s, d))), "flux")


def index_points(s, d):
    return _keyed(C.index_points(B.lc_supplier(s, d)), "idx", "n")


def win_stats(s, d):
    return _round(W.statistics(B.lc_supplier(s, d)))


def win_labels(s, d):
    return W.members(B.lc_supplier(s, d)).groupBy("series_id", "window_id").agg(F.max("label").alias("label"))


def points_vote_all(s, d):
    """Every point, uncovered ones too."""
    points = C.spread(B.lc_supplier(s, d))
    flags = W.members(points).groupBy("series_id", "window_id").agg(F.max("label").alias("flag"))
    return W.to_points(points, flags).drop("n_windows")


def points_vote(s, d):
    """The points that a window covers, as its SQL has them."""
    points = C.spread(B.lc_supplier(s, d))
    flags = W.members(points).groupBy("series_id", "window_id").agg(F.max("label").alias("flag"))
    return W.to_points(points, flags).filter("n_windows > 0").drop("n_windows")


def transits_simple(s, d):
    return _round(D.simple_transits(B.lc_user(s, d), 0.5).select("series_id", "time", "flux"))


def point_anomalies(s, d):
    return _round(D.point_anomalies(B.lc_user(s, d), 2.0).select("series_id", "time", "flux", "z_score", "kind"))


def transit_events(s, d):
    return _round(D.transit_events(C.index_points(B.lc_supplier(s, d)), 0.01, 3))


def phase_labels(s, d):
    return _keyed(D.phase_labels(B.lc_supplier(s, d), B.catalog(s, d)), "phase", "in_transit")


def catalog_targets(s, d):
    return B.catalog(s, d).filter(F.col("mission").like("%A%") & F.col("period").isNotNull()).orderBy("magnitude", "target_id").limit(20)


def non_hosts(s, d):
    hosts = B.catalog(s, d).filter(F.col("period").isNotNull()).select("target_id")
    return B.catalog(s, d).select("target_id", "mission").join(hosts, "target_id", "left_anti")


def _by_type(s, d):
    e = B.lc_user(s, d)
    return e.select("type", (F.pmod("series_id", F.lit(2)) == 0).cast("int").alias("truth"), (F.col("flux") > 20).cast("int").alias("predicted"), F.round("flux", 1).alias("score"))


def confusion_by_type(s, d):
    return _round(evaluate.confusion(_by_type(s, d), "type"))


def areas_by_type(s, d):
    return _round(evaluate.areas(_by_type(s, d), "type"))


QUERIES = {f.__name__: f for f in (lc_clean, lc_summary, lc_global_stats, sigma_clip, normalize_flux, denormalize_flux, index_points, win_stats, win_labels, points_vote, points_vote_all, transits_simple, point_anomalies, transit_events, phase_labels, catalog_targets, non_hosts, confusion_by_type, areas_by_type)}

_LC = "lc as (select l_suppkey as series_id, epoch_us(l_shipdate) / 86400e6 as time, l_extendedprice as flux, (l_quantity >= 50 and l_discount >= 0.09)::int as label, l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as idx, count(*) over (partition by l_suppkey) as n from lineitem)"
_US = "us as (select user_id as series_id, epoch_us(ts) / 86400e6 as time, value as flux, event_type as type from events)"
_CAT = "cat as (select s_suppkey as target_id, r_name as mission, s_acctbal as magnitude, n_name as hostname, case when s_suppkey % 5 <> 0 then (700 + 10 * (s_suppkey % 40))::double end as period, case when s_suppkey % 5 <> 0 then (9100 + 50 * (s_suppkey % 7))::double end as epoch, case when s_suppkey % 5 <> 0 then 480.0::double end as duration_hours from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
_WIN = "win as (select lc.*, w.window_id::int as window_id from lc, lateral (select unnest(generate_series(greatest(0, ceil((idx - 49) / 12.0))::bigint, least(floor(idx / 12.0), floor((n - 50) / 12.0))::bigint)) as window_id) w where n >= 50)"
_BT = "bt as (select type, (series_id % 2 = 0)::int as truth, (flux > 20)::int as predicted, round(flux, 1) as score from us)"
_K = "series_id, l_orderkey, l_linenumber, l_partkey"

ORACLES = {
    "lc_clean": f"with {_LC} select {_K}, round(time, 4) as time, round(flux, 4) as flux, round(0.01 * stddev_samp(flux) over (partition by series_id), 4) as flux_err, label from lc where n >= 10",
    "lc_summary": f"with {_LC} select series_id, count(*) as n_points, round(max(time) - min(time), 4) as time_span, round(min(time), 4) as start_time, round(max(time), 4) as end_time, round(avg(flux), 4) as flux_mean, round(stddev_samp(flux), 4) as flux_std, round(min(flux), 4) as flux_min, round(max(flux), 4) as flux_max, round(median(flux), 4) as flux_median from lc group by 1",
    "lc_global_stats": f"with {_LC}, m as (select *, abs(flux - median(flux) over (partition by series_id)) as d, avg(flux) over (partition by series_id) as mu from lc) select series_id, round(avg(flux), 4) as mean, round(stddev_pop(flux), 4) as std, round(median(flux), 4) as median, round(median(d), 4) as mad, round(avg((flux - mu) ** 3) / avg((flux - mu) ** 2) ** 1.5, 4) as skew, round(kurtosis_pop(flux), 4) as kurtosis, round(quantile_cont(flux, 0.05), 4) as p05, round(quantile_cont(flux, 0.25), 4) as p25, round(quantile_cont(flux, 0.75), 4) as p75, round(quantile_cont(flux, 0.95), 4) as p95, round(quantile_cont(flux, 0.75) - quantile_cont(flux, 0.25), 4) as iqr from m group by 1",
    "sigma_clip": f"with {_LC}, m as (select *, median(flux) over (partition by series_id) as md, stddev_pop(flux) over (partition by series_id) as sd from lc) select {_K}, round(flux, 4) as flux from m where abs(flux - md) < 2 * sd",
    "normalize_flux": f"with {_LC}, m as (select *, avg(flux) over (partition by series_id) as mu, stddev_samp(flux) over (partition by series_id) as sd from lc) select {_K}, round((flux - mu) / nullif(sd, 0), 4) as flux, round(mu, 4) as flux_mean, round(sd, 4) as flux_std from m",
    "denormalize_flux": f"with {_LC} select {_K}, round(flux, 4) as flux from lc",
    "index_points": f"with {_LC} select {_K}, idx::int as idx, n from lc",
    "win_stats": f"with {_LC}, {_WIN}, m as (select *, median(flux) over (partition by series_id, window_id) as md, avg(flux) over (partition by series_id, window_id) as mu from win) select series_id, window_id, max(label) as label, round(avg(flux), 4) as mean, round(stddev_pop(flux), 4) as std, round(min(flux), 4) as min, round(max(flux), 4) as max, round(max(flux) - min(flux), 4) as ptp, round(avg((flux - mu) ** 3) / avg((flux - mu) ** 2) ** 1.5, 4) as skewness, round(kurtosis_pop(flux), 4) as kurtosis, round(sqrt(avg(flux * flux)), 4) as rms, round(median(flux), 4) as median, round(median(abs(flux - md)), 4) as mad from m group by 1, 2",
    "win_labels": f"with {_LC}, {_WIN} select series_id, window_id, max(label) as label from win group by 1, 2",
    "points_vote": f"with {_LC}, {_WIN}, f as (select series_id, window_id, max(label) as flag from win group by 1, 2) select win.series_id, win.idx::int as idx, avg(flag) > 0.5 as is_vote, max(flag) > 0 as is_any from win join f using (series_id, window_id) group by 1, 2",
    "points_vote_all": f"with {_LC}, {_WIN}, f as (select series_id, window_id, max(label) as flag from win group by 1, 2), v as (select win.series_id, win.idx, avg(flag) > 0.5 as is_vote, max(flag) > 0 as is_any from win join f using (series_id, window_id) group by 1, 2) select lc.series_id, lc.idx::int as idx, coalesce(is_vote, false) as is_vote, coalesce(is_any, false) as is_any from lc left join v using (series_id, idx)",
    "transits_simple": f"with {_US}, m as (select *, median(flux) over (partition by series_id) - 0.5 * stddev_pop(flux) over (partition by series_id) as t from us) select series_id, round(time, 4) as time, round(flux, 4) as flux from m where flux < t",
    "point_anomalies": f"with {_US}, m as (select *, (flux - avg(flux) over (partition by series_id)) / nullif(stddev_pop(flux) over (partition by series_id), 0) as z from us) select series_id, round(time, 4) as time, round(flux, 4) as flux, round(z, 4) as z_score, case when z < 0 then 'dip' else 'spike' end as kind from m where abs(z) > 2",
    "transit_events": f"with {_LC}, r as (select *, flux / median(flux) over (partition by series_id) as rel from lc), b as (select *, (rel < 0.99)::int as below, idx - sum((rel < 0.99)::int) over (partition by series_id order by idx) as island from r) select series_id, min(idx)::int as start_idx, (max(idx) + 1)::int as end_idx, count(*) as duration, round(min(time), 4) as start_time, round(max(time), 4) as end_time, round(1 - min(rel), 4) as depth, round(avg(flux), 4) as mean_flux, round(max(time) - min(time), 4) as time_duration from b where below = 1 group by series_id, island having count(*) >= 3 and max(idx) + 1 < max(n)",
    "phase_labels": f"with {_LC}, {_CAT}, p as (select lc.*, (((time - epoch) % period) + period) % period / period as phase, duration_hours / 24 / period / 2 as h from lc left join cat on series_id = target_id) select {_K}, round(phase, 4) as phase, coalesce((phase < h or phase > 1 - h)::int, 0) as in_transit from p",
    "catalog_targets": f"with {_CAT} select * from cat where mission like '%A%' and period is not null order by magnitude, target_id limit 20",
    "non_hosts": f"with {_CAT} select target_id, mission from cat where target_id not in (select target_id from cat where period is not null)",
    "confusion_by_type": f"with {_US}, {_BT}, c as (select type, count(*) filter (truth = 1 and predicted = 1) as tp, count(*) filter (truth = 0 and predicted = 1) as fp, count(*) filter (truth = 1 and predicted = 0) as fn, count(*) filter (truth = 0 and predicted = 0) as tn from bt group by 1) select *, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) as f1 from c",
    "areas_by_type": f"with {_US}, {_BT}, a as (select type, score, sum(truth) as pos, sum(1 - truth) as neg from bt group by 1, 2), c as (select *, sum(pos) over (partition by type order by score desc) as tp, sum(neg) over (partition by type order by score desc) as fp, sum(pos) over (partition by type) as p, sum(neg) over (partition by type) as q from a) select type, round(sum(neg * (tp - pos / 2.0)) / max(p * q), 4) as roc_auc, round(sum(pos * tp / (tp + fp)) / max(p), 4) as avg_precision from c group by 1",
}
