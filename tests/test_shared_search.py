"""Flags of neighbours and of clusters come out of one search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import density as D
from tidemark.operators import models as M
from tidemark.operators import neighbours as N
from tidemark.plans import model_queries as Q

SF = "/root/testdata/sf0.001"


def rows_of(spark, x, gap=None):
    return spark.createDataFrame([(i, None if gap and i % gap == gap - 1 else v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")


@pytest.mark.parametrize("eps,least,neighbours", [(0.25, 12, 4), (1e-9, 60, 4), (1e-9, 500, 4)])
def test_both_equal_two_fits(spark, monkeypatch, eps, least, neighbours):
    """A cloud, copies (more than a list names), a far group that is no cluster and names none, lone rows, rows without a vector."""
    for name, value in (("ROWS", 40), ("CELL", 60)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(330, 3)), np.full((70, 3), 0.3), 40 + rng.normal(size=(30, 3)) * 2, rng.normal(size=(10, 3)) * 9])
    df = rows_of(spark, x[rng.permutation(len(x))], 97)
    lof, clusters = M.LocalOutlierFactor(0.1, neighbours), M.DensityClusters(0.1, eps, least)
    a, b = ({r.id: (r.score, r.is_anomaly) for r in M.fit_scored(df, m).collect()} for m in (lof, clusters))
    got = {r.id: r for r in M.fit_scored_both(df, lof, clusters).collect()}
    assert got.keys() == a.keys() == b.keys() and len(got) == 440
    for k, r in got.items():
        assert (r.cluster_score, r.cluster_anomaly) == b[k] and r.is_anomaly == a[k][1]
        assert r.score == a[k][0] or abs(r.score - a[k][0]) <= 1e-9 * abs(a[k][0])
    assert len({v[1] for v in b.values()}) == (2 if least == 500 else 3)


@pytest.mark.parametrize("query", [Q.weighted_vote, Q.model_agreement, Q.detection_rates, Q.and_ensemble])
def test_flags_share_one_search(spark, monkeypatch, query):
    searches = []
    own = N._nearest
    monkeypatch.setattr(N, "_nearest", lambda queries, *a: searches.append(queries.rows.agg(F.sum(F.size("vid"))).first()[0]) or own(queries, *a))
    monkeypatch.setattr(N, "within", lambda *a: pytest.fail("a second search of every row"))
    assert query(spark, SF).count() > 0
    assert searches[0] == 500 and all(n < 500 for n in searches[1:])


def test_lists_leave_few_rows_to_search(spark, monkeypatch):
    """Only rows that name no row of a cluster are searched for; without such a row no cluster's blocks are made."""
    monkeypatch.setattr(N, "ROWS", 40)
    rng = np.random.default_rng(5)
    far = []
    own = D.ClusterDistance._far
    monkeypatch.setattr(D.ClusterDistance, "_far", lambda self, queries: far.append(queries.rows.agg(F.sum(F.size("vid"))).first()[0]) or own(self, queries))
    near = rng.normal(size=(200, 2))
    for x, want in ((near, []), (np.vstack([near, [[30.0, 30.0]]]), []), (np.vstack([near, 60 + 8 * rng.normal(size=(6, 2))]), [6])):
        far.clear()
        got = M.fit_scored_both(rows_of(spark, x), M.LocalOutlierFactor(0.1, 4), M.DensityClusters(0.01, 0.4, 4))
        assert got.count() == len(x) and far == want


def test_blocks_of_queries_are_sent_once_a_part(spark, monkeypatch):
    for name, value in (("ROWS", 40), ("CELL", 60), ("PARTS", 2)):
        monkeypatch.setattr(N, name, value)
    vectors = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(np.random.default_rng(1).normal(size=(600, 8)))], "vid long, n long, z array<double>")
    blocks = N.deal(vectors, N.pivots_of(vectors))
    cells = [r.cell for r in blocks.rows.select("cell").collect()]
    pairs = N._everywhere(blocks.rows.withColumn("limit", F.transform("vid", lambda _: F.lit(99.0))), blocks, others=True)
    sent, limits, met = pairs.agg(F.count("za"), F.count("limit"), F.count("zb")).first()
    assert met == sum(a != b for a in cells for b in cells)
    assert len(cells) <= sent == limits <= 2 * len(cells) < met


def test_rows_without_a_candidate_are_left_out():
    rng = np.random.default_rng(7)
    for kind in (np.float32, np.float64):
        low, most = rng.random((50, 70)).astype(kind), rng.random(50) * 0.03
        low[3], low[4, 5], most[6], most[7], low[8, 9] = np.inf, np.nan, np.inf, -1.0, most[8]
        for rows in (slice(None), slice(6, 7), slice(0, 0)):
            want = np.nonzero(low[rows] <= np.nextafter(most[rows].astype(kind), np.inf)[:, None])
            assert all((a == b).all() and len(a) == len(b) for a, b in zip(N._Compared.under(low[rows], most[rows]), want, strict=True))
