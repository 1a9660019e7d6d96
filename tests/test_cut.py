"""Long series in parts, running counts by ranges, and resamples, against plain definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import evaluate as E
from tidemark.operators import clean as C
from tidemark.operators import smooth as S


@pytest.fixture
def many_tasks(spark):
    """Small partitions are not put together: they show where rows are dealt."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def curves(spark):
    """Series of 1,200, 90, 30 and 3 points, with ties in time, nulls (some over a part's border) and odd steps."""
    rng = np.random.default_rng(2)
    rows = []
    for name, n in (("long", 1200), ("some", 90), ("few", 30), ("three", 3)):
        time = np.sort(rng.integers(0, n, n)).astype(float)
        flux = [None if v < 0.2 or 95 < k < 104 or 118 < k < 122 or 150 <= k < 260 else float(v) for k, v in enumerate(rng.random(n))]
        rows += [(name, float(t), f, k) for k, (t, f) in enumerate(zip(time, flux, strict=True))]
    return spark.createDataFrame(rows, "series_id string, time double, flux double, k int").select("series_id", "time", "flux", F.struct("time", "k").alias("ord"))


def values(df, column):
    return {(r.series_id, r.idx): None if r.v is None else round(r.v, 9) for r in df.select("series_id", "idx", F.col(column).cast("double").alias("v")).collect()}


OPERATORS = {
    "idx": (lambda p: p, "idx"),
    "differences": (S.differences, "diff"), "mean": (S.running_mean, "running_mean"), 
    "smooth": (lambda p: S.savgol(p.fillna(0.5, "flux")), "smooth"), "fill": (S.fill_gaps, "flux"), "fill two": (lambda p: S.fill_gaps(p, 2.0, 60), "flux"), 
}


def test_parts_make_no_difference(curves):
    whole, cut = C.index_points(curves).cache(), C.cut_points(curves, 100).cache()
    assert cut.select("series_id", "part").distinct().count() == 12 + 3
    for name, (run, column) in OPERATORS.items():
        want = values(run(whole), column)
        assert len(want) == 1323 and values(run(cut), column) == want, name


def test_places_among_cuts(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 15, 16, 255):
        cuts = np.sort(rng.integers(0, 40, n)).astype(float)
        df = spark.createDataFrame([(float(x), cuts.tolist()) for x in np.arange(-1, 42, 0.5)] + [(1.0, None)], "x double, cuts array<double>")
        got = [r.k for r in df.select(C.count_below("cuts", F.col("x"), n).alias("k")).collect()]
        assert got == [int((cuts < x).sum()) for x in np.arange(-1, 42, 0.5)] + [None]


def test_a_million_points_are_many_tasks(spark, many_tasks):
    """Exact in closed form: a cubic is its own smooth curve."""
    t = F.col("id") / 1e6
    rows = spark.range(1_000_000).select(F.lit(1).alias("series_id"), F.col("id").cast("double").alias("time"), (t * t * t - 2 * t * t + t).alias("flux"), F.struct(F.col("id").alias("k")).alias("ord"))
    got = S.savgol(C.cut_points(rows, 100_000)).withColumn("task", F.spark_partition_id())
    told = got.agg(F.count("*"), F.max(F.abs(F.col("smooth") - F.col("flux"))), F.max(F.abs(F.col("idx") - F.col("time")))).first()
    assert told[0] == 1_000_000 and told[1] < 1e-9 and told[2] == 0
    got = C.by_part(C.cut_points(rows, 100_000), 20)[0].withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in got.groupBy("task").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 700_000


def plain_areas(truth, score):
    pos, neg = score[truth == 1], score[truth == 0]
    roc = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
    step = sum((pos == s).sum() / len(pos) * (pos >= s).sum() / (score >= s).sum() for s in np.unique(pos))
    return roc, step


def test_running_counts_of_many_scores(spark, many_tasks):
    rng = np.random.default_rng(3)
    rows = [("many", int(v > 0.4), float(v + rng.normal())) for v in rng.random(3000)] + [("ties", int(v > 0.5), float(round(v * 3))) for v in rng.random(500)] + [(None, k % 2, float(k // 5)) for k in range(40)] + [("one", 1, 0.5)] * 3
    df = spark.createDataFrame(rows, "kind string, truth int, score double")
    got = {r.kind: (r.roc_auc, r.avg_precision) for r in E.areas(df, "kind").collect()}
    for kind in ("many", "ties", None):
        own = np.array([(t, s) for k, t, s in rows if k == kind])
        assert got[kind] == pytest.approx(plain_areas(own[:, 0], own[:, 1]))
    assert got["one"] == (None, 1.0)
    curve = E.curve(df, "kind").withColumn("task", F.spark_partition_id())
    assert curve.filter("kind = 'many'").select("task").distinct().count() > 1


def test_resamples_have_the_spread_of_plain_ones(spark):
    rng = np.random.default_rng(5)
    truth = (rng.random(1500) < 0.3).astype(int)
    score = np.round(truth + rng.normal(size=1500), 2)
    said = (score > 0.8).astype(int)
    df = spark.createDataFrame([(int(t), int(p), float(s)) for t, p, s in zip(truth, said, score, strict=True)], "truth int, predicted int, score double")
    got = E.bootstrap(df, 400)
    plain = []
    for _ in range(400):
        at = rng.integers(0, 1500, 1500)
        t, p = truth[at], said[at]
        tp, fp, fn = (t & p).sum(), ((1 - t) & p).sum(), (t & (1 - p)).sum()
        plain.append((tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), *plain_areas(t, score[at])))
    for name, v in zip(("precision", "recall", "f1", "roc_auc", "avg_precision"), np.array(plain).T, strict=True):
        assert got[name]["mean"] == pytest.approx(v.mean(), abs=4 * v.std() / 20) and got[name]["std"] == pytest.approx(v.std(), rel=0.2)
        assert got[name]["lower"] == pytest.approx(np.percentile(v, 2.5), abs=v.std()) and got[name]["upper"] == pytest.approx(np.percentile(v, 97.5), abs=v.std())
    assert E.bootstrap(df, 400) == got
    assert np.isnan(E.bootstrap(df.filter("truth = 1"), 50)["roc_auc"]["mean"])
