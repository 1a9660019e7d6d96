"""Training, cross-validation and comparisons over feature windows. Models see bounded samples; every window is scored."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import evaluate as E
from tidemark.operators import detect as D
from tidemark.operators import features as X
from tidemark.operators import models as M
from tidemark.operators import periods as P
from tidemark.operators import windows as W
from tidemark.operators.clean import clean, index_points, summary
from tidemark.operators.density import NeighbourFactor
from tidemark.operators.smooth import preprocess
from tidemark.sources.shared import stored

METRICS = ("precision", "recall", "f1", "roc_auc", "avg_precision")


def rows_of(points: DataFrame, ws: int = 50, groups: list[str] | None = None) -> DataFrame:
    """The model matrix: id, series_id, window_id, features (array) and truth (any labelled point)."""
    m = X.model_matrix(X.features(points, ws, groups))
    truth = (F.col("label") > 0).cast("int") if "label" in m.columns else F.lit(None).cast("int")
    return m.select(F.xxhash64("series_id", "window_id").alias("id"), "series_id", "window_id", F.array(*X.names([g for g in X.GROUPS if groups is None or g in groups])).alias("features"), truth.alias("truth"))


def train(points: DataFrame, name: str = "isolation_forest", ws: int = 50, normal_only: bool = False, **options) -> M.Model:
    """A model fitted on the windows of cleaned, preprocessed curves; normal_only: on those without a labelled point."""
    rows = rows_of(preprocess(clean(points)), ws)
    return M.fitted(M.create(name, **options), rows.filter("truth = 0") if normal_only else rows)


def metrics(scored: DataFrame, *by: str) -> DataFrame:
    """rates() and areas() of scored rows with a truth, by the columns given."""
    told = scored.select(F.struct(F.lit("all").alias("__all"), *by).alias("__key"), "truth", F.col("is_anomaly").cast("int").alias("predicted"), (-F.col("score")).alias("score"))
    rates = E.rates(told, "__key")
    return rates.join(E.areas(told, "__key"), "__key").select(*[F.col(f"__key.{c}").alias(c) for c in by], *[c for c in rates.columns if c != "__key"], "roc_auc", "avg_precision")


def cross_validate(rows: DataFrame, factory: Callable[[], M.Model], k: int = 5, strategy: str = "stratified") -> DataFrame:
    """fold and its metrics: each fold's rows are scored by a model of the others'. The dealt rows and the scored ones are stored once.

    The outlier factor's models of all folds share one search for neighbours."""
    dealt = stored(E.folds(rows.drop("fold"), k, "id", strategy).select("id", "fold", "features", "truth"), "folds")
    if isinstance(table := factory().over_rows(), NeighbourFactor):
        return metrics(stored(table.cross_score(dealt, k).drop("features"), "scored"), "fold")
    every = None
    for fold in range(k):
        model = M.fitted(factory(), dealt.filter(F.col("fold") != fold))
        part = M.scored(dealt.filter(F.col("fold") == fold), model).drop("features")
        every = part if every is None else every.union(part)
    return metrics(stored(every, "scored"), "fold")


def compare(rows: DataFrame, factories: dict[str, Callable[[], M.Model]], k: int = 5) -> DataFrame:
    """model, fold and metrics of each model over the same folds."""
    out = None
    for name, factory in factories.items():
        own = cross_validate(rows, factory, k).withColumn("model", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def aggregated(folds: DataFrame, *by: str) -> DataFrame:
    return E.over_folds(folds, *METRICS, by=by)


def ablation(points: DataFrame, factory: Callable[[], M.Model], ws: int = 50, k: int = 5) -> DataFrame:
    """step, groups and metrics' means as feature groups are added one by one."""
    out, order = None, list(X.GROUPS)
    for step in range(1, len(order) + 1):
        own = aggregated(cross_validate(rows_of(points, ws, order[:step]), factory, k)).select(F.lit(step).alias("step"), F.lit("+".join(order[:step])).alias("groups"), "*")
        out = own if out is None else out.union(own)
    return out


def sensitivity(points: DataFrame, factory: Callable[[float], M.Model], contaminations: tuple[float, ...] = (0.01, 0.05, 0.1, 0.15, 0.2, 0.3), sizes: tuple[int, ...] = (10, 20, 30, 50, 75, 100, 150), k: int = 5) -> DataFrame:
    """parameter, value and metrics' means, for shares of anomalies at 50 points and for window sizes at a tenth."""
    out = None
    for parameter, value in [("contamination", c) for c in contaminations] + [("window_size", s) for s in sizes]:
        rows = rows_of(points, int(value) if parameter == "window_size" else 50)
        own = aggregated(cross_validate(rows, lambda v=value, p=parameter: factory(v if p == "contamination" else 0.1), k)).select(F.lit(parameter).alias("parameter"), F.lit(float(value)).alias("value"), "*")
        out = own if out is None else out.union(own)
    return out


def grid_search(rows: DataFrame, name: str, grid: dict[str, list], k: int = 5, metric: str = "f1") -> list[dict]:
    """Every combination with its mean and std, the best first. One that fails stays, with NaN and its error; so does one without the metric, after the others."""
    found, none = [], float("nan")
    for values in product(*grid.values()):
        options = dict(zip(grid, values, strict=True))
        try:
            got = aggregated(cross_validate(rows, lambda o=options: M.create(name, **o), k)).first()
            mean, std = got[f"{metric}_mean"], got[f"{metric}_std"]
            found.append(options | {"mean": none if mean is None else mean, "std": none if std is None else std, "error": None})
        except Exception as e:  # noqa: BLE001  (one bad combination must not end the search; it is told)
            found.append(options | {"mean": none, "std": none, "error": str(e)})
    return sorted(found, key=lambda r: -r["mean"] if r["mean"] == r["mean"] else float("inf"))


def significance(folds: DataFrame, metric: str = "f1") -> list[dict]:
    """Paired tests of every two models over their folds (few rows), with stars."""
    values: dict[str, list[float]] = {}
    for r in folds.orderBy("model", "fold").collect():
        values.setdefault(r["model"], []).append(float(r[metric]) if r[metric] is not None else float("nan"))
    out = []
    for a, b in combinations(sorted(values), 2):
        tests = E.paired_tests(values[a], values[b])
        out.append({"model_a": a, "model_b": b, **tests, "stars": E.stars(tests["ttest_pvalue"])})
    return out


def importance(rows: DataFrame, names: list[str], **options) -> list[tuple[str, float]]:
    """Features by their share of the rows that an isolation forest's splits part."""
    share = {r.feature: r.share for r in M.fitted(M.IsolationForest(**options), rows).table.importances().collect()}
    return sorted(((n, float(share.get(k, 0.0))) for k, n in enumerate(names)), key=lambda x: -x[1])


def predictions(points: DataFrame, rows: DataFrame, fitted: dict[str, M.Model], ws: int = 50, method: str = "vote") -> DataFrame:
    """series_id, idx and one 0/1 column a model: its windows' say on the points (vote, any or score)."""
    if method not in ("vote", "any", "score"):
        raise ValueError(f"no method {method}")
    out = None
    for name, model in fitted.items():
        flags = M.scored(rows, model).select("series_id", "window_id", F.col("is_anomaly").cast("int").alias("flag"), "score")
        own = W.to_points(points, flags, ws).select("series_id", "idx", F.col(f"is_{method}").cast("int").alias(name))
        out = own if out is None else out.join(own, ["series_id", "idx"])
    return out


def judged(points: DataFrame, predicted: DataFrame, flag: str = "is_vote") -> DataFrame:
    """Predictions (series_id, idx, flag, and point_score if there is one) beside the points' truth (label): truth, predicted, score (greater: odder) and outcome TP, FP, FN or TN."""
    truth = (points if "idx" in points.columns else index_points(points)).select("series_id", "idx", (F.col("label") > 0).cast("int").alias("truth"))
    score = [(0.0 - F.col("point_score")).alias("score")] if "point_score" in predicted.columns else []
    met = truth.join(predicted.select("series_id", "idx", F.col(flag).cast("int").alias("predicted"), *score), ["series_id", "idx"])
    right = F.col("truth") == F.col("predicted")
    return met.withColumn("outcome", F.concat(F.when(right, "T").otherwise("F"), F.when(F.col("predicted") == 1, "P").otherwise("N")))


def evaluate_labelled(points: DataFrame, flags: DataFrame, ws: int = 50, method: str = "vote", *by: str) -> DataFrame:
    """Labelled points and their windows' flags and scores to metrics of the points: the windows' say on every point meets its truth.

    by: "series_id" for one row a series."""
    if "label" not in points.columns:
        raise ValueError("an evaluation needs a label column")
    if method not in ("vote", "any", "score"):
        raise ValueError(f"no method {method}")
    indexed = points if "idx" in points.columns else index_points(points)
    told = judged(indexed, W.to_points(indexed, flags, ws), f"is_{method}")
    return metrics(told.select("series_id", "truth", (F.col("predicted") == 1).alias("is_anomaly"), (0.0 - F.col("score")).alias("score")), *by)


def evaluate_model(points: DataFrame, model: M.Model, ws: int = 50, method: str = "vote", *by: str) -> DataFrame:
    """evaluate_labelled() of a model that is fitted on the points' own windows."""
    cleaned = index_points(clean(points).drop("idx", "n"))
    rows = stored(rows_of(preprocess(cleaned), ws), "windows")
    flags = M.fit_scored(rows, model).select("series_id", "window_id", F.col("is_anomaly").cast("int").alias("flag"), "score")
    return evaluate_labelled(cleaned, stored(flags, "flags"), ws, method, *by)


def examples(points: DataFrame, metadata: DataFrame, n: int = 3, predicted: DataFrame | None = None, flag: str = "is_vote") -> DataFrame:
    """Points of the first n transit and first n normal targets, by id; with predictions also truth, predicted and outcome of each point."""
    first = metadata.filter("label_type = 'transit'").orderBy("target_id").limit(n).union(metadata.filter("label_type = 'normal'").orderBy("target_id").limit(n))
    chosen = points.join(F.broadcast(first.select(F.col("target_id").alias("series_id"), "label_type")), "series_id")
    if predicted is None:
        return chosen
    chosen = chosen if "idx" in chosen.columns else index_points(chosen)
    return chosen.join(judged(chosen, predicted, flag), ["series_id", "idx"])


def analysis(points: DataFrame, model: M.Model | None = None, ws: int = 50, n_frequencies: int = 1000) -> dict[str, DataFrame]:
    """All that is said of curves: summary, points (with z-scores' anomalies), transit events, periodogram, and with a model its windows and points."""
    cleaned = index_points(clean(points)) if "ord" in points.columns else clean(points)
    out = {"summary": summary(cleaned), "point_anomalies": D.point_anomalies(cleaned), "transits": D.transit_events(cleaned), "periodogram": P.lomb_scargle(cleaned, n_frequencies)}
    if model is not None:
        rows = rows_of(cleaned, ws)
        scored = M.scored(rows, model).drop("features")
        flags = scored.select("series_id", "window_id", F.col("is_anomaly").cast("int").alias("flag"), "score")
        out |= {"windows": scored, "window_summary": E.score_summary(scored, "series_id"), "points": W.to_points(cleaned, flags, ws)}
    return out


def folded(points: DataFrame, targets: DataFrame, bins: int | None = None) -> DataFrame:
    """Phase, centred on the transit (-0.5 to 0.5), of the points of targets with an ephemeris; with bins, the mean flux of each bin."""
    met = D.phase_labels(points, targets).filter(F.col("phase").isNotNull())
    centred = met.withColumn("phase", F.when(F.col("phase") > 0.5, F.col("phase") - 1).otherwise(F.col("phase")))
    if bins is None:
        return centred
    at = F.least(F.floor((F.col("phase") + 0.5) * bins), F.lit(bins - 1)).cast("int")
    return centred.groupBy("series_id", at.alias("bin")).agg(F.avg("flux").alias("mean_flux"), F.count("*").alias("n"))
