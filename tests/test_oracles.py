"""Every query of the engine against the same in DuckDB."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.plans import registry as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(Q.ORACLES[name]).df()
    got = Q.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = lambda df: sorted(map(repr, ([None if x != x or x is None else (float(x) + 0.0 if isinstance(x, float) else str(x)) for x in row] for row in df[cols].itertuples(index=False))))
    assert len(got) > 0 and key(got) == key(want)


def test_vote_has_every_point(spark):
    from tidemark.operators import windows as W

    points = spark.createDataFrame([("long", k) for k in range(60)] + [("short", k) for k in range(9)], "series_id string, idx int").withColumn("n", F.when(F.col("series_id") == "long", 60).otherwise(9))
    flags = spark.createDataFrame([("long", 0, 1)], "series_id string, window_id int, flag int")
    got = {(r.series_id, r.idx): (r.is_vote, r.is_any) for r in W.to_points(points, flags).collect()}
    assert got == {("long", k): (k < 50, k < 50) for k in range(60)} | {("short", k): (False, False) for k in range(9)}


def test_vote_with_scores(spark):
    from tidemark.operators import windows as W

    points = spark.createDataFrame([("long", k, 62) for k in range(62)], "series_id string, idx int, n int")
    flags = spark.createDataFrame([("long", 0, 1, -4.0), ("long", 1, 0, -2.0)], "series_id string, window_id int, flag int, score double")
    got = {r.idx: (r.is_vote, r.is_any, r.n_windows, r.point_score, r.is_score) for r in W.to_points(points, flags).collect()}
    assert got == {k: (k < 12, k < 50, 1 + (12 <= k < 50), -4.0 if k < 12 else -3.0 if k < 50 else -2.0, False) for k in range(62)}


def test_features_of_odd_windows(spark):
    import numpy as np

    from tidemark.operators import features as X

    rows = [("flat", float(k), 1.0) for k in range(60)] + [("short", float(k), 1.0) for k in range(49)]
    df = spark.createDataFrame(rows, "series_id string, time double, flux double").withColumn("ord", F.struct("time"))
    got = X.features(df).collect()
    assert [r.series_id for r in got] == ["flat"] and got[0].skewness is None and got[0].acf_lag1 == 0 and got[0].std == 0
    assert X.model_matrix(X.features(df)).first().skewness == 0
    assert X.features(df, groups=["shape"]).columns == ["series_id", "window_id", *X.GROUPS["shape"]]
    x = np.random.default_rng(1).normal(size=(3, 9))
    for group in X._OF.values():
        assert all(np.shape(v) == (3,) for v in group(x, np.arange(27.0).reshape(3, 9)))


def test_gaps_of_every_kind(spark):
    from tidemark.operators import smooth as S

    flux = [None, 1.0, None, None, 4.0] + [None] * 7 + [12.0, None]
    df = spark.createDataFrame([(1, k, 14, float(k), x) for k, x in enumerate(flux)], "series_id int, idx int, n int, time double, flux double")
    got = [r.flux for r in S.fill_gaps(df).orderBy("idx").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, None, None, 12.0, 12.0]
    assert [r.flux for r in S.fill_gaps(df, max_gap=2.0).orderBy("idx").collect()] == flux
    assert [r.flux for r in S.fill_gaps(df, max_gap=1.0).orderBy("idx").collect()] == got


def test_savgol_of_short_series(spark):
    import numpy as np

    from tidemark.operators import smooth as S

    rows = [(n, k, n, float((k * 7919) % 13)) for n in (3, 4, 5, 8, 20, 21, 30) for k in range(n)]
    got = {(r.series_id, r.idx): r.smooth for r in S.savgol(spark.createDataFrame(rows, "series_id int, idx int, n int, flux double")).collect()}
    for n in (3, 4, 5, 8, 20, 21, 30):
        x = np.array([r[3] for r in rows if r[0] == n])
        size = 21 if n >= 21 else n - (n % 2 == 0)
        for k in range(n):
            low = max(0, min(k - size // 2, n - size))
            want = x[k] if size < 5 else np.polyval(np.polyfit(np.arange(size), x[low : low + size], 3), k - low)
            assert got[n, k] == pytest.approx(want, abs=1e-8)


def test_box_finds_a_planted_period(spark):
    import numpy as np

    from tidemark.operators import periods as P

    t = np.arange(0, 40, 0.02)
    dip = (t % 3.0) < 0.15
    df = spark.createDataFrame([("star", float(a), float(1 - 0.1 * b)) for a, b in zip(t, dip, strict=True)], "series_id string, time double, flux double")
    best = P.box_features(df).first()
    # Every whole multiple of the period up to the half span fits too; folded, the dip is the deepest box.
    assert abs(best.bls_period / 3 - round(best.bls_period / 3)) < 0.02 and 0.1 <= best.bls_duration <= 0.2
    plain = P.box_powers(t, np.where(dip, 0.9, 1.0), np.array([3.0]), np.array([0.15]))
    inside = [((t % 3.0) >= a) & ((t % 3.0) < a + 0.15) for a in np.arange(0, 2.85, 0.015)]
    y = np.where(dip, 0.9, 1.0)
    want = max(0.5 * m.sum() * (y[~m].mean() - y[m].mean()) ** 2 for m in inside)
    assert plain.power[0] == pytest.approx(want, rel=0.02)
    found = P.box_detector(df, 400, (0.05, 0.2, 5)).toPandas()
    assert found[found.is_anomaly].flux.mean() < found[~found.is_anomaly].flux.mean()
    assert P.box_features(df.limit(20)).first().bls_power == 0
