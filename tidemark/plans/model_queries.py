"""Queries of models, metrics, data sets and comparisons, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import evaluate as E
from tidemark.operators import clean as C
from tidemark.operators import features as X
from tidemark.operators import models as M
from tidemark.operators import windows as W
from tidemark.operators.stitch import first_segments, stitch
from tidemark.plans import experiments as T
from tidemark.plans.queries import _CAT, _LC, _US, _WIN, KEY, _by_type, _keyed, _round
from tidemark.sources import bindings as B


def _model(rows, model):
    return M.fit_scored(rows, model).select("id", "score", "is_anomaly")


def lof_embeddings(s, d):
    return _round(_model(B.vectors(s, d), M.LocalOutlierFactor()))


def dbscan_distance(s, d):
    """All 64 components: in so many, rows lie far apart, so eps is large."""
    return _round(_model(B.vectors(s, d), M.DensityClusters(eps=9.25)))


def dbscan_no_cluster(s, d):
    return _round(_model(B.vectors(s, d), M.DensityClusters()))


def isolation_forest(s, d):
    return _model(B.vectors(s, d), M.IsolationForest())


def one_class_svm(s, d):
    return _model(B.vectors(s, d), M.OneClassMachine())


def if_and_lof(s, d):
    return _model(B.vectors(s, d), M.BothAgree())


def autoencoder(s, d):
    return _model(B.vectors(s, d), M.Autoencoder(rounds=15))


def _flags(s, d):
    """Three models' flags of one table: outlying by neighbours, by clusters, by the first component."""
    flag = lambda c, name: F.col(c).cast("int").alias(name)
    far = (F.abs(F.get("features", F.lit(0))) > 1).cast("int").alias("far")
    return M.fit_scored_both(B.vectors(s, d), M.LocalOutlierFactor(), M.DensityClusters(eps=9.25)).select("id", flag("is_anomaly", "lof"), flag("cluster_anomaly", "dbscan"), far)


def and_ensemble(s, d):
    return _flags(s, d).select("id", ((F.col("lof") == 1) & (F.col("dbscan") == 1)).alias("is_anomaly"))


def weighted_vote(s, d):
    """Weights 1, 1 and 0.5; over half of them."""
    return _flags(s, d).select("id", (F.col("lof") + F.col("dbscan") + 0.5 * F.col("far") > 1.25).alias("is_anomaly"))


def model_agreement(s, d):
    return E.agreement(_flags(s, d), ["lof", "dbscan", "far"])


def detection_rates(s, d):
    return _round(E.detections(_flags(s, d), ["lof", "dbscan", "far"]))


def evaluation_summary(s, d):
    return _round(E.score_summary(lof_embeddings(s, d)))


def rates_by_type(s, d):
    return _round(E.rates(_by_type(s, d), "type"))


def roc_points(s, d):
    return _round(E.roc_points(_by_type(s, d), "type"))


def pr_points(s, d):
    return _round(E.pr_points(_by_type(s, d), "type"))


def score_classes(s, d):
    return E.areas(_by_type(s, d), "type").select("type", E.score_class(F.col("roc_auc")).alias("roc_class"), E.score_class(F.col("avg_precision")).alias("pr_class"))


def temporal_folds(s, d):
    return E.folds(B.vectors(s, d), 5, "id", "temporal").select("id", "fold")


def stratified_folds(s, d):
    """Rows by label and fold: the labels' shares are the same in every fold."""
    return E.folds(B.vectors(s, d), 5).groupBy("truth", "fold").agg(F.count("*").alias("n"))


def fold_aggregate(s, d):
    """Metrics of each fold of the users' events, and their mean and std."""
    rows = _by_type(s, d).withColumn("fold", F.pmod(F.col("score") * 10, F.lit(5)).cast("int"))
    per = E.rates(rows.drop("type"), "fold")
    return _round(E.over_folds(per, "precision", "recall", "f1"))


def cross_validation(s, d):
    return _round(T.cross_validate(B.vectors(s, d), lambda: M.LocalOutlierFactor()))


def bootstrap(s, d):
    """Five metrics' means, bounds and deviations over a thousand resamples of the users' events."""
    return E.bootstrap_table(_by_type(s, d))


def _of_windows(s, d):
    return W.statistics(C.normalize(B.lc_supplier(s, d)))


_SOME = ["mean", "std", "ptp", "rms"]


def feature_statistics(s, d):
    return _round(E.feature_statistics(_of_windows(s, d), _SOME))


def effect_sizes(s, d):
    return _round(E.effect_sizes(_of_windows(s, d), _SOME))


def feature_correlations(s, d):
    return _round(E.correlations(_of_windows(s, d), _SOME))


def flux_histogram(s, d):
    return _round(E.histogram(B.lc_user(s, d).withColumn("flux", F.floor(F.col("flux") * 100)), "flux", 80).drop("density"), 3)


def _metadata(s, d):
    points = B.lc_supplier(s, d)
    return E.dataset_metadata(points, B.catalog(s, d))


def dataset_metadata(s, d):
    return _round(_metadata(s, d))


def dataset_summary(s, d):
    return _round(E.dataset_summary(_metadata(s, d)))


def brightest_of_host(s, d):
    """Confirmed targets, the brightest of each host, in order of magnitude."""
    known = B.catalog(s, d).dropna(subset=["period", "epoch", "duration_hours", "magnitude"])
    place = Window.partitionBy("hostname").orderBy("magnitude", "target_id")
    return known.withColumn("k", F.row_number().over(place)).filter("k = 1").drop("k").orderBy("magnitude", "target_id").limit(20)


def faint_non_hosts(s, d):
    """The first ten targets that are no host and lie within a range of magnitudes."""
    hosts = B.catalog(s, d).filter(F.col("period").isNotNull()).select("target_id")
    return B.catalog(s, d).filter(F.col("magnitude").between(0, 8000)).join(hosts, "target_id", "left_anti").select("target_id", "magnitude").orderBy("target_id").limit(10)


def folded_curve(s, d):
    """Mean flux in 20 bins of phase around the transit."""
    points = B.lc_supplier(s, d).withColumn("flux", F.round("flux"))
    return _round(T.folded(points, B.catalog(s, d), 20), 3)


def analysis_windows(s, d):
    """All windows of the suppliers' curves, scored by an isolation forest."""
    return M.fit_scored(T.rows_of(C.spread(B.lc_supplier(s, d))), M.IsolationForest(), keep=["series_id", "window_id"])


def _quarters(s, d):
    return B.lc_supplier(s, d).withColumn("segment", F.floor(F.col("time") / 90))


def first_quarters(s, d):
    return _keyed(first_segments(_quarters(s, d), 5), "segment")


def stitch_segments(s, d):
    """The suppliers' curves out of their quarters; the keys are in what was the order before."""
    level = stitch(_quarters(s, d))
    return _round(level.select("series_id", *[F.col(f"ord.ord.{k}").alias(k) for k in KEY[1:]], "segment", "flux"))


def _window_flags(s, d):
    """Windows whose mean is far from the series' are odd: flag, and score (lower: odder) in thousandths."""
    means = W.members(C.normalize(C.spread(B.lc_supplier(s, d)))).groupBy("series_id", "window_id").agg(F.round(1000 * F.avg("flux")).alias("mean"))
    return means.select("series_id", "window_id", (F.abs("mean") > 200).cast("int").alias("flag"), (0.0 - F.abs("mean")).alias("score"))


def labelled_evaluation(s, d):
    """Labelled curves to metrics of their points, by series."""
    return _round(T.evaluate_labelled(C.spread(B.lc_supplier(s, d)), _window_flags(s, d), 50, "vote", "series_id"))


def detection_examples(s, d):
    """Points of the first three targets with and without a transit: what the windows say beside the truth."""
    points = C.index_points(C.spread(B.lc_supplier(s, d)))
    got = T.examples(points, _metadata(s, d), 3, W.to_points(points, _window_flags(s, d)))
    return got.select("series_id", "idx", "label_type", "truth", "predicted", "outcome")


QUERIES = {f.__name__: f for f in (lof_embeddings, dbscan_distance, dbscan_no_cluster, isolation_forest, one_class_svm, if_and_lof, autoencoder, and_ensemble, weighted_vote, model_agreement, detection_rates, evaluation_summary, rates_by_type, roc_points, pr_points, score_classes, temporal_folds, stratified_folds, fold_aggregate, cross_validation, bootstrap, feature_statistics, effect_sizes, feature_correlations, flux_histogram, dataset_metadata, dataset_summary, brightest_of_host, faint_non_hosts, folded_curve, analysis_windows, first_quarters, stitch_segments, labelled_evaluation, detection_examples)}


def _pairs(n: int, tag: str) -> str:
    return f"d{tag} as (select vec_id, unnest(range(1, {n + 1})) as j, unnest(list_transform(embedding[1:{n}], lambda x: x::double)) as x from embeddings), s{tag} as (select j, avg(x) as mu, stddev_pop(x) as sd from d{tag} group by j), z{tag} as (select vec_id, list((x - mu) / sd order by j) as z from d{tag} join s{tag} using (j) group by 1), p{tag} as (select a.vec_id as a, b.vec_id as b, list_distance(a.z, b.z) as d from z{tag} a, z{tag} b)"


_LOF = _pairs(64, "l") + ", n1 as (select * from (select *, row_number() over (partition by a order by d, b) as k from pl where a <> b) where k <= 20), r as (select a, max(d) as reach from n1 group by 1), den as (select n1.a, 1 / (avg(greatest(d, reach)) + 1e-10) as den from n1 join r on r.a = n1.b group by 1), fac as (select n1.a, max(o.den) as own, avg(q.den) / max(o.den) as fac from n1 join den q on q.a = n1.b join den o on o.a = n1.a group by 1), n2 as (select * from (select *, row_number() over (partition by a order by d, b) as k from pl) where k <= 20), lof as (select n2.a as id, -avg(q.den) * (avg(greatest(d, reach)) + 1e-10) as score from n2 join r on r.a = n2.b join den q on q.a = n2.b group by 1), lofa as (select id, score, score < (select quantile_cont(-fac, 0.1) from fac) as is_anomaly from lof)"
_DB = _pairs(64, "b") + ", core as (select a from pb where d <= 9.25 group by a having count(*) >= 5), mem as (select distinct pb.a from pb join core on core.a = pb.b where d <= 9.25), dbs as (select pb.a as id, -min(d) as score from pb join mem on mem.a = pb.b group by 1), dba as (select id, score, score < (select quantile_cont(score, 0.1) from dbs) as is_anomaly from dbs)"
_FL = f"{_LOF}, {_DB}, flags as (select v.vec_id as id, lofa.is_anomaly::int as lof, dba.is_anomaly::int as dbscan, (abs(v.embedding[1]::double) > 1)::int as far from embeddings v join lofa on lofa.id = v.vec_id join dba on dba.id = v.vec_id)"
_BTS = f"{_US}, bt as (select type, (series_id % 2 = 0)::int as truth, (flux > 20)::int as predicted, round(flux, 1) as score from us)"
_CV = f"{_BTS}, a as (select type, score, sum(truth) as pos, sum(1 - truth) as neg from bt group by 1, 2), c as (select *, sum(pos) over (partition by type order by score desc) as tp, sum(neg) over (partition by type order by score desc) as fp, sum(pos) over (partition by type) as p, sum(neg) over (partition by type) as q from a)"
_ST = f"{_LC.replace('lc as (', 'lc0 as (', 1)}, lc as (select * replace ((flux - avg(flux) over (partition by series_id)) / stddev_samp(flux) over (partition by series_id) as flux) from lc0), {_WIN}, st as (select series_id, window_id, max(label) as label, avg(flux) as mean, stddev_pop(flux) as std, max(flux) - min(flux) as ptp, sqrt(avg(flux * flux)) as rms from win group by 1, 2)"
_LONG = ", lo as (unpivot (select label, mean, std, ptp, rms from st) on mean, std, ptp, rms into name feature value v)"
_MD = f"{_LC}, {_CAT}, md as (select cat.*, m.n_points, m.n_anomalies, m.anomaly_fraction, case when period is not null then 'transit' else 'normal' end as label_type, target_id || '.csv' as filename from cat join (select series_id, count(*) as n_points, sum(label)::bigint as n_anomalies, avg(label) as anomaly_fraction from lc group by 1) m on m.series_id = target_id)"

# Windows of normalised curves with their flags and scores, and what they say on every point.
_PV = f"{_ST.split(', st as (')[0]}, wf as (select series_id, window_id, (abs(m) > 200)::int as flag, -abs(m) as score from (select series_id, window_id, round(1000 * avg(flux)) as m from win group by 1, 2)), v as (select win.series_id, win.idx, avg(flag) > 0.5 as vote, avg(score) as point_score from win join wf using (series_id, window_id) group by 1, 2), pv as (select lc.series_id, lc.idx::int as idx, lc.label as truth, coalesce(vote, false)::int as said, coalesce(point_score, 0) as score from lc left join v using (series_id, idx))"

ORACLES = {
    "lof_embeddings": f"with {_LOF} select id, round(score, 4) as score, is_anomaly from lofa",
    "dbscan_distance": f"with {_DB} select id, round(score, 4) as score, is_anomaly from dba",
    "dbscan_no_cluster": "select vec_id as id, 0.0::double as score, false as is_anomaly from embeddings",
    "and_ensemble": f"with {_FL} select id, lof = 1 and dbscan = 1 as is_anomaly from flags",
    "weighted_vote": f"with {_FL} select id, lof + dbscan + 0.5 * far > 1.25 as is_anomaly from flags",
    "model_agreement": f"with {_FL} select count(*) as n_points, count(*) filter (lof + dbscan + far = 3) as unanimous, count(*) filter ((lof + dbscan + far) * 2 > 3) as majority, count(*) filter (lof + dbscan + far > 0) as any from flags",
    "detection_rates": f"with {_FL}, x as (unpivot (select lof, dbscan, far from flags) on lof, dbscan, far into name model value v) select model, sum(v)::bigint as n_detections, round(avg(v), 4) as rate from x group by 1",
    "evaluation_summary": f"with {_LOF} select count(*) as n_windows, sum(is_anomaly::int)::bigint as n_anomalies, round(avg(is_anomaly::int), 4) as anomaly_rate, round(avg(round(score, 4)), 4) as mean_score, round(min(score), 4) as min_score, round(max(score), 4) as max_score from lofa",
    "rates_by_type": f"with {_BTS}, c as (select type, count(*) filter (truth = 1 and predicted = 1) as tp, count(*) filter (truth = 0 and predicted = 1) as fp, count(*) filter (truth = 1 and predicted = 0) as fn, count(*) filter (truth = 0 and predicted = 0) as tn from bt group by 1) select *, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) as f1, tp + fn as n_true_anomalies, tp + fp as n_pred_anomalies, tp + fp + fn + tn as n_total, round((tp + fn) / (tp + fp + fn + tn), 4) as anomaly_rate_true, round((tp + fp) / (tp + fp + fn + tn), 4) as anomaly_rate_pred from c",
    "roc_points": f"with {_CV} select type, round(score, 4) as threshold, round(fp / q, 4) as fpr, round(tp / p, 4) as tpr from c union all select distinct type, null, 0.0, 0.0 from bt",
    "pr_points": f"with {_CV} select type, round(score, 4) as threshold, round(tp / (tp + fp), 4) as precision, round(tp / p, 4) as recall from c union all select distinct type, null, 1.0, 0.0 from bt",
    "score_classes": f"with {_CV}, a2 as (select type, sum(neg * (tp - pos / 2.0)) / max(p * q) as r, sum(pos * tp / (tp + fp)) / max(p) as a from c group by 1) select type, case when r is null then 'na' when r >= 0.7 then 'good' when r >= 0.4 then 'ok' else 'poor' end as roc_class, case when a is null then 'na' when a >= 0.7 then 'good' when a >= 0.4 then 'ok' else 'poor' end as pr_class from a2",
    "temporal_folds": "select vec_id as id, (ntile(5) over (order by vec_id) - 1)::int as fold from embeddings",
    "stratified_folds": "with c as (select (label = 0)::int as truth, count(*) as n from embeddings group by 1) select truth, f::int as fold, n // 5 + (f < n % 5)::int as n from c, range(0, 5) r(f)",
    "fold_aggregate": f"with {_BTS}, f as (select *, (((score * 10) % 5 + 5) % 5)::int as fold from (select *, round(score * 10) / 10 as s from bt)), c as (select trunc(((score * 10) % 5 + 5) % 5)::int as fold, count(*) filter (truth = 1 and predicted = 1) as tp, count(*) filter (truth = 0 and predicted = 1) as fp, count(*) filter (truth = 1 and predicted = 0) as fn from bt group by 1), m as (select coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as r, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f from c) select round(avg(p), 4) as precision_mean, round(stddev_pop(p), 4) as precision_std, round(avg(r), 4) as recall_mean, round(stddev_pop(r), 4) as recall_std, round(avg(f), 4) as f1_mean, round(stddev_pop(f), 4) as f1_std from m",
    "feature_statistics": f"with {_ST}{_LONG} select feature, round(avg(v), 4) as mean, round(stddev_pop(v), 4) as std, round(min(v), 4) as min, round(max(v), 4) as max, 0::bigint as nan_count from lo group by 1",
    "effect_sizes": f"with {_ST}{_LONG} select feature, round(abs(avg(v) filter (label = 1) - avg(v) filter (label = 0)) / (stddev_pop(v) filter (label = 0) + 1e-10), 4) as effect from lo group by 1",
    "feature_correlations": f"with {_ST}, names as (select unnest(['mean', 'std', 'ptp', 'rms']) as f), l as (select series_id, window_id, unnest(['mean', 'std', 'ptp', 'rms']) as f, unnest([mean, std, ptp, rms]) as v from st) select a.f as feature_a, b.f as feature_b, round(corr(a.v, b.v), 4) as corr from l a join l b using (series_id, window_id) group by 1, 2",
    "flux_histogram": f"with {_US}, h as (select floor(flux * 100)::bigint as x from us), e as (select min(x) as lo, (max(x) - min(x)) / 80 as w from h) select least(floor((x - lo) / w), 79)::int as bin, round(lo + least(floor((x - lo) / w), 79) * w, 3) as bin_start, count(*) as n from h, e group by 1, 2",
    "dataset_metadata": f"with {_MD} select * replace (round(anomaly_fraction, 4) as anomaly_fraction) from md",
    "dataset_summary": f"with {_MD} select count(*) as total_targets, count(*) filter (label_type = 'transit') as planet_hosts, count(*) filter (label_type = 'normal') as non_planet, sum(n_points)::bigint as total_points, round(avg(anomaly_fraction), 4) as mean_fraction, round(median(anomaly_fraction), 4) as median_fraction from md",
    "brightest_of_host": f"with {_CAT} select * from (select * from cat where period is not null and magnitude is not null qualify row_number() over (partition by hostname order by magnitude, target_id) = 1) order by magnitude, target_id limit 20",
    "faint_non_hosts": f"with {_CAT} select target_id, magnitude from cat where magnitude between 0 and 8000 and period is null order by target_id limit 10",
    "folded_curve": f"with {_LC}, {_CAT}, p as (select series_id, round(flux) as flux, (((time - epoch) % period) + period) % period / period as ph from lc join cat on series_id = target_id where period is not null), c as (select *, case when ph > 0.5 then ph - 1 else ph end as phase from p) select series_id, least(floor((phase + 0.5) * 20), 19)::int as bin, round(avg(flux), 3) as mean_flux, count(*) as n from c group by 1, 2",
    "first_quarters": f"with {_LC}, q as (select *, floor(time / 90)::bigint as segment from lc), r as (select *, dense_rank() over (partition by series_id order by segment) as k from q) select series_id, l_orderkey, l_linenumber, l_partkey, segment from r where k <= 5",
    "stitch_segments": f"with {_LC}, q as (select *, floor(time / 90)::bigint as segment from lc), a as (select * replace (flux / median(flux) over (partition by series_id, segment) as flux) from q) select series_id, l_orderkey, l_linenumber, l_partkey, segment, round(flux / median(flux) over (partition by series_id), 4) as flux from a",
    "labelled_evaluation": f"with {_PV}, g as (select series_id, -score as score, sum(truth) as pos, sum(1 - truth) as neg from pv group by 1, 2), c as (select *, sum(pos) over (partition by series_id order by score desc) as tp, sum(neg) over (partition by series_id order by score desc) as fp, sum(pos) over (partition by series_id) as p, sum(neg) over (partition by series_id) as q from g), ar as (select series_id, round(sum(neg * (tp - pos / 2.0)) / nullif(max(p * q), 0), 4) as roc_auc, round(sum(pos * tp / (tp + fp)) / nullif(max(p), 0), 4) as avg_precision from c group by 1), cf as (select series_id, count(*) filter (truth = 1 and said = 1) as tp, count(*) filter (truth = 0 and said = 1) as fp, count(*) filter (truth = 1 and said = 0) as fn, count(*) filter (truth = 0 and said = 0) as tn from pv group by 1) select cf.*, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) as f1, tp + fn as n_true_anomalies, tp + fp as n_pred_anomalies, tp + fp + fn + tn as n_total, round((tp + fn) / (tp + fp + fn + tn), 4) as anomaly_rate_true, round((tp + fp) / (tp + fp + fn + tn), 4) as anomaly_rate_pred, roc_auc, avg_precision from cf join ar using (series_id)",
    "detection_examples": f"with {_PV}, {_CAT}, t as (select distinct target_id, case when period is not null then 'transit' else 'normal' end as label_type from cat join pv on series_id = target_id), f as (select * from t qualify row_number() over (partition by label_type order by target_id) <= 3) select series_id, idx, label_type, truth, said as predicted, case when truth = said then 'T' else 'F' end || case when said = 1 then 'P' else 'N' end as outcome from pv join f on series_id = target_id",
}
