"""The forest that is grown from tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forest
from tidemark.operators import models as M


def test_forest_of_a_table(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(6000, 4)), rng.normal(size=(60, 4)) * 0.3 + 6 * rng.choice([-1, 1], size=(60, 4))])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(9000, None), (9001, [None, float("nan"), 0.0, float("inf")])], "id long, features array<double>")
    f = forest.Forest(0.01, trees=40).fit(df.filter("id < 9000"))
    nodes = f.nodes.toPandas()
    # Every tree has 256 rows, and each node's rows are its children's.
    assert (nodes[nodes.node == 1].n == 256).all() and nodes.tree.nunique() == 40 and nodes.node.max() < 2**9
    n = {(r.tree, r.node): r.n for r in nodes.itertuples()}
    split = nodes[nodes.feature.notna()]
    assert all(n[r.tree, 2 * r.node] + n[r.tree, 2 * r.node + 1] == r.n for r in split.itertuples())
    got = {r.id: (r.score, r.is_anomaly) for r in f.score(df).collect()}
    # The score by walking each tree.
    paths = {}
    told = {(r.tree, r.node): (r.feature, r.cut, r.path) for r in nodes.itertuples()}
    for i in (0, 17, 5999, 6000, 6059):
        lengths = []
        for t in range(40):
            node = 1
            while (at := told[t, node])[0] == at[0] and at[0] is not None:
                node = 2 * node + int(x[i, int(at[0])] > at[1])
            lengths.append(told[t, node][2])
        paths[i] = -(2 ** (-np.mean(lengths) / forest.mean_path(256)))
    assert {i: got[i][0] for i in paths} == pytest.approx(paths)
    assert got[9000] == (None, None) and got[9001][0] is not None
    truth, score = np.arange(6060) >= 6000, np.array([got[i][0] for i in range(6060)])
    assert np.mean([(score[truth][:, None] < s).mean() for s in score[~truth]]) > 0.95
    assert np.mean([got[i][1] for i in range(6060)]) == pytest.approx(0.01, abs=0.001)
    share = {r.feature: r.share for r in f.importances().collect()}
    assert share == pytest.approx((split.groupby("feature").n.sum() / split.n.sum()).to_dict()) and sum(share.values()) == pytest.approx(1)
    f.save(f"{tmp_path}/forest")
    assert {r.id: (r.score, r.is_anomaly) for r in forest.Forest.load(spark, f"{tmp_path}/forest").score(df.repartition(3)).collect()} == got
    # Rows come from the whole table alike: a tree's rows do not depend on how the table lies.
    again = forest.Forest(0.01, trees=40).fit(df.filter("id < 9000").repartition(5, F.col("id") % 3))
    assert again.nodes.toPandas().sort_values(["tree", "node"]).reset_index(drop=True).equals(nodes.sort_values(["tree", "node"]).reset_index(drop=True))
    alike = df.limit(5).withColumn("features", F.array(F.lit(1.0), F.lit(2.0)))
    assert forest.Forest(trees=3).fit(alike).score(alike).filter("is_anomaly").count() == 0
    with pytest.raises(ValueError):
        forest.Forest().fit(df.limit(0))


def test_detector_methods(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(rng.normal(size=(120, 3)))], "id long, features array<double>")
    d = M.Detector(0.1)
    with pytest.raises(ValueError):
        d.predict(df)
    d.fit(df)
    with pytest.raises(ValueError):
        d.predict(df, "none of that name")
    got = {m: {r.id: (r.score, r.is_anomaly) for r in d.predict(df, m).collect()} for m in d.METHODS}
    one, two, both = (got[m] for m in d.METHODS)
    assert both == {i: (pytest.approx((one[i][0] + two[i][0]) / 2), one[i][1] and two[i][1]) for i in one}
