"""What grows with the square of a table, or piles up in one task, must not come back."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import clean as C
from tidemark.operators import density as D
from tidemark.operators import features as X
from tidemark.operators import forest as O
from tidemark.operators import models as M
from tidemark.operators import neighbours as N
from tidemark.operators import smooth as S
from tidemark.operators import windows as W
from tidemark.plans import experiments as T
from tidemark.sources.shared import arrow_rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_meet_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(N, "ROWS", 40)
    monkeypatch.setattr(N, "CELL", 60)
    x = np.random.default_rng(1).normal(size=(400, 8))
    vectors = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vid long, n long, z array<double>")
    blocks = N.deal(vectors, N.pivots_of(vectors))
    pairs = N._everywhere(blocks.rows.withColumn("limit", F.transform("vid", lambda _: F.lit(9.0))), blocks)
    assert "CartesianProduct" in plan(pairs) and "Exchange" not in plan(pairs)
    assert pairs.count() == blocks.rows.count() ** 2


def test_points_are_not_multiplied(spark):
    points = spark.range(2000).select(F.lit(1).alias("series_id"), F.col("id").cast("int").alias("idx"), F.lit(2000).alias("n"))
    flags = spark.range(163).filter("id % 7 <> 3").select(F.lit(1).alias("series_id"), F.col("id").cast("int").alias("window_id"), (F.col("id") % 2).cast("int").alias("flag"), F.col("id").cast("double").alias("score"))
    got = {r.idx: r for r in W.to_points(points, flags).collect()}
    assert len(got) == 2000
    for idx, r in got.items():
        of = [w for w in range(163) if w % 7 != 3 and 12 * w <= idx < 12 * w + 50]
        assert (r.n_windows, r.is_any, r.is_vote) == (len(of), any(w % 2 for w in of), bool(of) and sum(w % 2 for w in of) > len(of) / 2)
        assert abs(r.point_score - (sum(of) / len(of) if of else 0.0)) < 1e-9
    # Of the explosions, none is of points: they would be left of the join.
    assert plan(W.to_points(points, flags)).count("explode(") == 1


def test_series_are_spread_by_their_number_of_points(spark):
    rows = spark.range(1000).select((F.col("id") % 50).alias("series_id"))
    assert C.spread(rows, 100).rdd.getNumPartitions() == 10
    assert C.spread(rows, 1000).rdd.getNumPartitions() == rows.rdd.getNumPartitions()


def test_gaps_are_filled_without_a_frame_to_the_end(spark):
    points = spark.range(40_000).select(F.lit(1).alias("series_id"), F.col("id").cast("int").alias("idx"), F.lit(40_000).alias("n"), F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).alias("flux"))
    filled = S.fill_gaps(points)
    assert "specifiedwindowframe(RowFrame, currentrow$(), unboundedfollowing$())" not in plan(filled)
    assert filled.filter("idx < 39999 and abs(flux - idx) > 1e-9").count() == 0


def test_folds_share_one_search(spark, monkeypatch):
    """Many pivots and blocks; copies within and between folds, more than neighbours; a constant component, a far row, rows without a vector."""
    for name, value in (("ROWS", 40), ("CELL", 60)):
        monkeypatch.setattr(N, name, value)
    x = np.random.default_rng(3).normal(size=(400, 6))
    x[50:130], x[:, 4], x[7, 2] = x[50], 2.0, 1e9
    rows = spark.createDataFrame([(i, None if i % 97 == 96 else v.tolist(), int(i % 5 == 0), i * 7 % 3) for i, v in enumerate(x)], "id long, features array<double>, truth int, fold int")
    got = {r.id: (r.score, r.is_anomaly) for r in D.NeighbourFactor(neighbours=4).cross_score(rows, 3).collect()}
    want = {}
    for fold in range(3):
        model = D.NeighbourFactor(neighbours=4).fit(rows.filter(F.col("fold") != fold))
        want |= {r.id: (r.score, r.is_anomaly) for r in model.score(rows.filter(F.col("fold") == fold)).collect()}
    assert got.keys() == want.keys() and len(got) == 400
    for k, (score, odd) in want.items():
        assert got[k][1] == odd and (score is None) == (got[k][0] is None)
        assert score is None or abs(got[k][0] - score) <= 1e-6 * abs(score)
    searches = []
    own = N._nearest
    monkeypatch.setattr(N, "_nearest", lambda *a: searches.append(1) or own(*a))
    assert T.cross_validate(rows, lambda: M.LocalOutlierFactor(neighbours=4), 3).count() == 3
    assert len(searches) == 1


def test_quantiles_of_groups_are_exact(spark):
    x = np.random.default_rng(5).normal(size=30_000)
    x[:9000:2] = 0.25
    rows = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(x)] + [(2, 1.5)], "g int, x double")
    for q in (0.0, 0.1, 0.5, 0.77, 1.0):
        got = N.exact_quantiles(rows, "x", q, "g")
        assert got.keys() == {0, 1, 2} and got[2] == 1.5
        assert all(abs(got[g] - np.quantile(x[g::2], q)) < 1e-12 for g in (0, 1))


def test_windows_are_cut_in_order_without_gathering(spark):
    """Batches of a few points: windows over batches' borders, series of one window, of none, labels with nulls; equal to the windows gathered point by point."""
    rng = np.random.default_rng(4)
    rows = [(name, float(k // 2), float(v), None if k % 5 == 0 else int(k % 40 == 7), k) for name, n in (("a", 300), ("b", 49), ("c", 50), ("d", 61), ("e", 62)) for k, v in enumerate(rng.normal(size=n))]
    points = spark.createDataFrame(rows, "series_id string, time double, flux double, label int, k int").select("series_id", "time", "flux", "label", F.struct("time", "k").alias("ord")).repartition(3)
    parted = C.index_points(points).withColumn("part", F.lit(0))
    want = {(r.series_id, r.window_id): r for r in X.features(parted).collect()}
    assert len(want) == 21 + 0 + 1 + 1 + 2
    for df in (points, C.index_points(points)):
        with arrow_rows(spark, 7):
            found = X.features(df)
            assert found.schema == X.features(parted).schema
            got = {(r.series_id, r.window_id): r for r in found.collect()}
        assert got.keys() == want.keys()
        for k, r in want.items():
            assert got[k].label == r.label
            assert all((got[k][c] is None) == (r[c] is None) and (r[c] is None or abs(got[k][c] - r[c]) <= 1e-9 * max(1, abs(r[c]))) for c in X.names())
    # Places that are gone take their windows with them; the others keep their numbers.
    missing = C.index_points(points).filter("series_id = 'a' and idx not in (100, 150)")
    assert {r.window_id for r in X.features(missing).collect()} == {w for w in range(21) if not any(12 * w <= i < 12 * w + 50 for i in (100, 150))}
    assert "collect_list" not in plan(X.features(points)) and "Generate" not in plan(X.features(points))


def test_rows_are_made_and_scored_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, v.tolist() if i != 9 else None) for i, v in enumerate(np.random.default_rng(6).normal(size=(300, 5)))], "id long, features array<double>")
    forest = O.Forest(trees=20, sample=64)
    want = {r.id: (r.score, r.is_anomaly) for r in forest.fit(rows).score(rows).collect()}
    passes = []
    own = O.Forest._scored
    monkeypatch.setattr(O.Forest, "_scored", lambda *a: passes.append(1) or own(*a))
    got = M.fit_scored(rows, M.IsolationForest(trees=20, sample=64), keep=["id"])
    assert got.columns == ["id", "score", "is_anomaly"] and len(passes) == 1
    assert {r.id: (r.score, r.is_anomaly) for r in got.collect()} == want


def test_points_are_sorted_once(spark):
    points = spark.range(600).select((F.col("id") % 4).alias("series_id"), F.col("id").cast("double").alias("time"), F.col("id").cast("double").alias("flux"), F.struct("id").alias("ord"))
    for df in (points, C.spread(points, 100)):
        assert plan(X.features(df)).split("== Initial Plan ==")[-1].count("Sort [") == 1
