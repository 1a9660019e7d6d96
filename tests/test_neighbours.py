"""Neighbour joins and the models on them against plain numpy, over every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import density as D
from tidemark.operators import models as M
from tidemark.operators import neighbours as N


def table(spark, x, **more):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>")


def distances(a, b):
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(N, "ROWS", 40)
    monkeypatch.setattr(N, "CELL", 60)


@pytest.mark.parametrize("width,kind", [(2, "grid"), (3, "clusters"), (16, "normal")])
def test_nearest_and_within(spark, small_blocks, width, kind):
    rng = np.random.default_rng(width)
    x = rng.integers(0, 30, (700, width)) if kind == "grid" else rng.normal(size=(700, width)) * (0.2 if kind == "clusters" else 1) + (rng.integers(0, 3, (700, 1)) * 5 if kind == "clusters" else 0)
    x = np.unique(x.astype(float), axis=0)[rng.permutation(len(np.unique(x, axis=0)))]
    n = rng.integers(1, 4, len(x))
    vectors = spark.createDataFrame([(i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, n, strict=True))], "vid long, n long, z array<double>")
    blocks = N.deal(vectors, N.pivots_of(vectors))
    assert blocks.rows.count() > 1 or len(x) <= 40
    d = distances(x, x)
    for k in (1, 45):
        got = {r.vid: [(round(v.distance, 9), v.vid) for v in r.near] for r in N.nearest(blocks, blocks, k).collect()}
        want = {i: [(round(float(d[i, j]), 9), int(j)) for j in np.lexsort((np.arange(len(x)), d[i]))[:k]] for i in range(len(x))}
        assert got == want
    for eps in (0.0, 1.0):
        assert {r.vid: r.n for r in N.within(blocks, blocks, eps).collect()} == dict(enumerate(((d <= eps) @ n).tolist()))


def test_exact_quantile(spark):
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=3000), np.repeat([1.0, 2.0], [2500, 500]), np.repeat([1.0, 2.0, 5.0], [10, 2000, 10]), np.array([3.0]), rng.integers(0, 9, 2000)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        for q in (0.1, 0.8333, 1.0):
            assert N.exact_quantile(df, "x", q, room=100) == pytest.approx(np.quantile(x, q), abs=1e-12)
    assert N.exact_quantile(df.limit(0), "x", 0.5) is None


def test_models_over_more_rows_than_a_sample_holds(spark):
    """10,500 rows, of which a third are one vector: flags and scores of plain numpy over all of them."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(6900, 5)), rng.normal(size=(100, 5)) * 4, np.full((3500, 5), 0.5)])[rng.permutation(10_500)]
    df = table(spark, x)
    z = (x - x.mean(0)) / x.std(0)
    lof = D.NeighbourFactor(0.1, 20)
    got = lof.fit_score(df).select("id", "score", "is_anomaly").toPandas().sort_values("id")
    k, order = 20, np.arange(len(z))
    lists = [np.empty((len(z), k), int) for _ in range(2)]
    near = [np.empty((len(z), k)) for _ in range(2)]
    for i in range(0, len(z), 500):
        d = distances(z[i : i + 500], z)
        for own in (0, 1):
            if own == 0:
                d[np.arange(len(d)), np.arange(i, i + len(d))] += np.inf
            else:
                d[np.arange(len(d)), np.arange(i, i + len(d))] = 0.0
            cut = np.partition(d, k - 1, axis=1)[:, k - 1]
            for r in range(len(d)):
                at = np.flatnonzero(d[r] <= cut[r])
                at = at[np.lexsort((order[at], d[r, at]))][:k]
                lists[own][i + r], near[own][i + r] = at, d[r, at]
    reach = near[0].max(1)
    dens = 1 / (np.maximum(near[0], reach[lists[0]]).mean(1) + 1e-10)
    offset = np.quantile(-dens[lists[0]].mean(1) / dens, 0.1)
    score = -dens[lists[1]].mean(1) * (np.maximum(near[1], reach[lists[1]]).mean(1) + 1e-10)
    assert lof.offset == pytest.approx(offset, rel=1e-6)
    assert np.allclose(got.score, score, rtol=1e-6)
    sure = np.abs(score - offset) > 1e-6 * abs(offset)
    assert (got.is_anomaly.to_numpy() == (score < offset))[sure].all() and got.is_anomaly.sum() > 300

    for eps in (0.35, 1.0):
        said = D.ClusterDistance(0.02, eps, 5)
        got = said.fit_score(df).select("id", "score", "is_anomaly").toPandas().sort_values("id")
        core = np.concatenate([(distances(z[i : i + 500], z) <= eps).sum(1) >= 5 for i in range(0, len(z), 500)])
        member = np.concatenate([(distances(z[i : i + 500], z[core]) <= eps).any(1) for i in range(0, len(z), 500)])
        score = -np.concatenate([distances(z[i : i + 500], z[member]).min(1) for i in range(0, len(z), 500)])
        assert np.allclose(got.score, score, atol=1e-9) and (got.is_anomaly.to_numpy() == (got.score.to_numpy() < np.quantile(got.score, 0.02))).all()
        assert got.is_anomaly.sum() > 50


def test_models_of_odd_tables(spark, tmp_path):
    one = table(spark, [[1.0, 2.0]])
    assert D.NeighbourFactor().fit_score(one).first().score == pytest.approx(-1.0)
    alike = table(spark, [[1.0, 2.0]] * 30)
    assert [r.score for r in D.NeighbourFactor().fit_score(alike).collect()] == pytest.approx([-1.0] * 30)
    with pytest.raises(ValueError):
        D.NeighbourFactor().fit(one.limit(0))
    assert D.ClusterDistance().fit(one).score(one).first().is_anomaly is False
    rng = np.random.default_rng(3)
    rows = table(spark, rng.normal(size=(200, 3)))
    other = rows.union(spark.createDataFrame([(500, None), (501, [float("nan"), None, float("inf")])], rows.schema)).withColumns({"z": F.lit(1), "vid": F.lit(2), "n": F.lit(3)})
    for model, kind in ((D.NeighbourFactor(0.1, 7), D.NeighbourFactor), (D.ClusterDistance(0.1, 0.8), D.ClusterDistance)):
        model.fit(rows)
        got = {r.id: (r.score, r.is_anomaly, r.z, r.vid) for r in model.score(other).collect()}
        again = D.NeighbourFactor(0.1, 7) if kind is D.NeighbourFactor else D.ClusterDistance(0.1, 0.8)
        assert {r.id: r.score for r in again.fit_score(rows).collect()} == {k: v[0] for k, v in got.items() if k < 200}
        assert len(got) == 202 and got[500][:2] == (None, None) and got[501][0] is not None
        model.save(f"{tmp_path}/{kind.__name__}")
        again = kind.load(spark, f"{tmp_path}/{kind.__name__}")
        assert {r.id: (r.score, r.is_anomaly, r.z, r.vid) for r in again.score(other).collect()} == got


def test_votes_do_not_depend_on_batches(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(500, 4)), rng.normal(size=(20, 4)) * 5])
    df = table(spark, x)
    vote = M.fitted(M.WeightedVote([M.LocalOutlierFactor(), M.DensityClusters(eps=0.9)], [1.0, 0.6]), df)
    parts = [m.table.score(df).select("id", F.col("is_anomaly").cast("int").alias("v")) for m in vote.parts]
    want = {r.id: (-(r.v + 0.6 * r.w), r.v + 0.6 * r.w > 0.8) for r in parts[0].join(parts[1].withColumnRenamed("v", "w"), "id").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    got = {r.id: (r.score, r.is_anomaly) for r in M.scored(df.repartition(13), vote).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    both = M.fitted(M.BothAgree(), df)
    assert M.scored(df, both).filter("is_anomaly").count() <= M.scored(df, both.parts[1]).filter("is_anomaly").count()
