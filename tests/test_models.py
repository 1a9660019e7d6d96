"""Models, metrics and experiments against plain definitions."""

from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import evaluate as E
from tidemark.operators import models as M
from tidemark.plans import experiments as T
from tidemark.sources import bindings as B

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(0)
    return np.vstack([rng.normal(size=(380, 6)), rng.normal(size=(20, 6)) * 0.3 + 6 * rng.choice([-1, 1], size=(20, 6))])


@pytest.mark.parametrize("model", [M.IsolationForest(), M.LocalOutlierFactor(neighbours=40), M.OneClassMachine(), M.DensityClusters(eps=1.2), M.BothAgree(), M.Autoencoder(rounds=30, latent=2), M.Autoencoder(rounds=30, latent=2, kind="dense")])
def test_models_rank_planted_rows_last(planted, model):
    score = model.fit(planted).score(planted)
    truth = np.arange(400) >= 380
    assert np.mean([(score[truth][:, None] < s).mean() for s in score[~truth]]) > 0.9
    assert set(np.unique(model.predict(planted))) <= {-1, 1}
    again = M.loads(M.dumps(model))
    assert np.allclose(again.score(planted), score) and (again.predict(planted) == model.predict(planted)).all()


def test_one_class_machine_meets_its_conditions(planted):
    m = M.OneClassMachine(0.1)
    m.fit(planted)
    assert m.weight.sum() == pytest.approx(40) and m.weight.max() <= 1 + 1e-9
    z = m.scale(planted)
    score = m.of_scaled(z)
    assert (score < m.offset - 1e-4).sum() <= 40  # at most the share may lie outside
    assert (score[[i for i in range(400) if not (np.abs(m.rows - z[i]).sum(1) < 1e-12).any()]] >= m.offset - 1e-4).all()


def test_autoencoder_gradients():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, 10))
    for kind in ("conv", "dense"):
        m = M.Autoencoder(latent=3, kind=kind)
        w = [v + rng.normal(size=v.shape) * 0.1 for v in m._start(10, rng)]
        grads = m._run(x, w, x)[1]
        for k in range(len(w)):
            at = tuple(rng.integers(0, n) for n in w[k].shape)
            losses = []
            for step in (1e-6, -1e-6):
                moved = [v.copy() for v in w]
                moved[k][at] += step
                losses.append(((m._run(x, moved) - x) ** 2).mean())
            assert (losses[0] - losses[1]) / 2e-6 == pytest.approx(grads[k][at], rel=1e-3, abs=1e-7)


def test_votes_registry_and_files(planted, tmp_path):
    vote = M.WeightedVote([M.LocalOutlierFactor(), M.IsolationForest(), M.DensityClusters(eps=1.2)], [1.0, 1.0, 0.5]).fit(planted)
    says = [m.predict(planted) == -1 for m in vote.parts]
    assert ((vote.predict(planted) == -1) == (says[0] * 1.0 + says[1] + 0.5 * says[2] > 1.25)).all()
    with pytest.raises(ValueError):
        M.WeightedVote([], [])
    with pytest.raises(ValueError):
        M.create("none of that name")
    assert M.load(tmp_path / "lof.npz") is None
    M.save(M.create("lof").fit(planted), tmp_path / "lof.npz")
    assert np.allclose(M.load(tmp_path / "lof.npz").score(planted), vote.parts[0].score(planted))
    assert [r["model"] for r in M.inventory(tmp_path) if r["has_artifact"]] == ["lof"]
    forest = vote.parts[1]
    forest.centre = None
    assert (M.recalibrated(forest, planted).predict(planted) == -1).mean() == pytest.approx(0.1, abs=0.01)
    constant = np.ones((30, 3))
    for name in M.REGISTRY:
        assert np.isfinite(M.create(name).fit(constant).score(constant)).all()


def test_scored_rows_and_missing_vectors(spark, planted):
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(planted)] + [(1000, None), (1001, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    model = M.fitted(M.LocalOutlierFactor(), df.filter("id < 400"))
    got = {r.id: r for r in M.scored(df, model).collect()}
    assert got[1000].score is None and got[1000].is_anomaly is None and got[1001].score is not None
    assert np.allclose([got[i].score for i in range(400)], M.LocalOutlierFactor().fit(planted).score(planted))


def test_paired_tests():
    a, b = [0.81, 0.79, 0.85, 0.9, 0.77, 0.8], [0.7, 0.75, 0.83, 0.85, 0.74, 0.81]
    d = np.array(a) - b
    t = d.mean() / (d.std(ddof=1) / np.sqrt(6))
    got = E.paired_tests(a, b)
    # The tail by the trapezoid rule over the density with five degrees of freedom.
    x = np.linspace(abs(t), 400, 4_000_001)
    y = 8 / (3 * np.pi * np.sqrt(5)) * (1 + x * x / 5) ** -3
    assert got["ttest_statistic"] == pytest.approx(t) and got["ttest_pvalue"] == pytest.approx(2 * ((y[1:] + y[:-1]) / 2 * np.diff(x)).sum(), rel=1e-3)
    assert got["wilcoxon_statistic"] == 1 and got["wilcoxon_pvalue"] == pytest.approx(2 * 2 / 64)
    assert E._student(2.0, 4) == pytest.approx(0.11612, abs=1e-5) and E._student(0.0, 4) == pytest.approx(1)
    assert np.isnan(E.paired_tests([1, 2], [2, 1])["ttest_pvalue"]) and np.isnan(E.paired_tests([1.0] * 6, [1.0] * 6)["wilcoxon_pvalue"])
    assert [E.stars(p) for p in (0.0001, 0.005, 0.03, 0.2, None)] == ["***", "**", "*", "ns", ""]


def test_bootstrap_is_the_binomial(spark):
    rows = [(1, 1)] * 30 + [(0, 1)] * 10 + [(1, 0)] * 20 + [(0, 0)] * 40
    got = E.bootstrap(spark.createDataFrame(rows, "truth int, predicted int"))
    assert got["precision"]["mean"] == pytest.approx(0.75, abs=0.02) and got["recall"]["mean"] == pytest.approx(0.6, abs=0.02)
    share = sum(comb(50, k) * 0.6**k * 0.4 ** (50 - k) for k in range(51) if got["recall"]["lower"] <= k / 50 <= got["recall"]["upper"])
    assert share > 0.9
    assert np.isnan(E.bootstrap(spark.createDataFrame([(1, 1)], "truth int, predicted int"))["f1"]["mean"])


def test_folds_cover_and_balance(spark):
    df = spark.range(103).withColumn("truth", (F.col("id") % 7 == 0).cast("int"))
    kept = E.folds(df, 5).collect()
    assert len(kept) == 103 and len({r.id for r in kept}) == 103
    for label in (0, 1):
        n = [sum(r.truth == label and r.fold == f for r in kept) for f in range(5)]
        assert max(n) - min(n) <= 1
    order = [r.fold for r in E.folds(df, 5, strategy="temporal").orderBy("id").collect()]
    assert order == [0] * 21 + [1] * 21 + [2] * 21 + [3] * 20 + [4] * 20
    with pytest.raises(ValueError):
        E.folds(df, 5, strategy="other")


def test_experiments(spark):
    rows = B.vectors(spark, SF)
    folds = T.compare(rows, {"lof": lambda: M.LocalOutlierFactor(), "dbscan": lambda: M.DensityClusters(eps=9.0)}, 2).cache()
    assert folds.count() == 4 and T.aggregated(folds, "model").count() == 2
    told = T.significance(folds)
    assert [(r["model_a"], r["model_b"]) for r in told] == [("dbscan", "lof")]
    found = T.grid_search(rows, "lof", {"neighbours": [5, 20], "nothing": [1]}, 2)
    assert [(r["neighbours"], r["mean"] == r["mean"]) for r in found] == [(5, False), (20, False)] and all("nothing" in r["error"] for r in found)
    found = T.grid_search(rows, "one_class_svm", {"contamination": [0.05, 0.2]}, 2)
    assert [r["mean"] for r in found] == sorted((r["mean"] for r in found), reverse=True) and len(found) == 2


def test_analysis_of_planted_curves(spark):
    from tidemark.sources import synthetic

    points = synthetic.curves(spark, n_points=600)
    assert points.groupBy("series_id").count().filter("count = 600").count() == 5
    kinds = {(r.series_id, r.type) for r in points.select("series_id", "type").distinct().collect()}
    assert ("normal_star", "transit") not in kinds and ("noisy_outliers", "outlier") in kinds and ("exoplanet_transit", "transit") in kinds
    assert synthetic.training_curves(spark, 20, 0.2, 50).groupBy("series_id").agg(F.max("label").alias("m")).filter("m = 1").count() <= 4
    model = T.train(points, "isolation_forest", normal_only=True)
    said = T.analysis(points, model, n_frequencies=50)
    assert said["windows"].count() == said["window_summary"].agg(F.sum("n_windows")).first()[0]
    assert said["points"].count() == 3000 and said["periodogram"].count() == 250
    assert len(T.importance(T.rows_of(points), T.X.names())) == 38
    both = T.predictions(points, T.rows_of(points), {"a": model, "b": M.fitted(M.LocalOutlierFactor(), T.rows_of(points))})
    assert both.columns == ["series_id", "idx", "a", "b"] and both.count() == 3000
