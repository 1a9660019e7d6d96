"""Exact top-k search by norm-bucketed retrieval.

Vectors are grouped in buckets of near lengths, longest first, and large buckets in blocks. The longest blocks give each
query a first lower bound for its k-th score. A bucket whose greatest length is l can hold a better one only at a cosine of
bound / (|q| l) or more, the local threshold: over 1, the block is skipped for that query; else rows are pruned by length
(low thresholds) or by the range a query's largest coordinate leaves to a row's (high thresholds), and the rest verified by
integer products.

Blocks that no query of a query block can need are left out before any row is copied. Products are exact: in doubles where
Cauchy-Schwarz keeps every partial sum under 2^53, else in 64-bit integers under 2^63, else in Python's integers.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor do rows without an id;
shorter vectors count as if filled up with zeros; rows with the query's own vec_id are no candidates; repeated rows count row
by row, and rows that share a query's id share its list, as in the SQL; ties go to the smaller vec_id; components and scores
beyond 64 bits are cut to the nearest long; an empty table has no result. Only the two named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, stored

K, EVERY, BUCKETS, BLOCK, QUERY_BLOCK, COSINE = 5, 50, 16, 4096, 8192, 0.5
#: Relative room for rounding in bounds.
ROOM = 1e-9
TOP = "query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>, norm): floor(256 x) of each component."""
    x = F.col(vector_col)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    v = F.transform(x, lambda c: F.floor(256 * c.cast("double")))
    return df.filter(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(odd, F.lit(True)) & (F.size(x) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _products(rows: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Exact integer products; most: the product of the greatest lengths, which bounds every partial sum."""
    if most < 2.0**52:
        return (rows.astype(float) @ q.astype(float)).astype(np.int64)
    if most < 2.0**62:
        return rows @ q
    return rows.astype(object) @ q.astype(object)


def _best(ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray | None, k: int) -> pd.DataFrame:
    x, y = rows.astype(float), queries.astype(float)
    norms, lengths = np.sqrt((x**2).sum(1)), np.sqrt((y**2).sum(1))
    found = []
    top = norms.max(initial=0)
    exact = x if top * lengths.max(initial=0) < 2.0**52 else rows
    for q, at, own, length, bound in zip(queries, y, query_ids, lengths, bounds if bounds is not None else np.full(len(queries), -np.inf), strict=True):
        keep = np.arange(len(ids))
        if bound > 0:
            if length * top * (1 + ROOM) < bound:
                continue
            local = min(1.0, bound / (length * top)) * (1 - ROOM)
            keep = np.flatnonzero(norms * length >= bound * (1 - ROOM))
            if local >= COSINE and len(keep):
                f = int(np.abs(at).argmax())
                u, rest = at[f] / length, np.sqrt(max((at**2).sum() - at[f] ** 2, 0.0)) / length
                # The row's angle to the axis lies within the query's angle plus or minus arccos(local).
                reach = rest * np.sqrt(1 - local * local)
                low, high = -1 if u <= -local else u * local - reach, 1 if u >= local else u * local + reach
                share = x[keep, f] / np.maximum(norms[keep], 1e-300)
                keep = keep[(share >= low - ROOM) & (share <= high + ROOM)]
        keep = keep[ids[keep] != own]
        score = _products(exact[keep], q, top * length)
        order = np.lexsort((ids[keep], -score))[:k] if score.dtype != object else sorted(range(len(keep)), key=lambda i: (-score[i], ids[keep[i]]))[:k]
        found += [(own, ids[keep[i]], max(-(2**63), min(2**63 - 1, int(score[i])))) for i in order]
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k(df: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row whose id is divisible by `every`, over all other rows."""
    vectors = stored(integer_vectors(df, id_col, vector_col), "vectors")
    n, width, n_queries = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count(F.when(F.pmod("vec_id", F.lit(every)) == 0, 1))).first()
    cuts = sorted(set(vectors.approxQuantile("norm", [i / BUCKETS for i in range(1, BUCKETS)], 0.01))) if n else []
    bucket = sum((F.when(F.col("norm") <= c, 1).otherwise(0) for c in cuts), F.lit(0))  # 0: the longest
    blocks = max(1, -(-n // (max(1, len(cuts)) * BLOCK)))
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    dealt = vectors.withColumn("bucket", bucket).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    queries = vectors.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("norm").alias("length"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("query_block"))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block")
    longest = dealt.filter("bucket = 0 and block = 0").select("vec_id", "v", every_block)

    def first_bound(_, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"query_id": [], "bound": []}).astype({"query_id": "int64", "bound": "float64"})
        top = _best(rows["vec_id"].to_numpy(), _matrix(rows["v"], width), _matrix(asked["q"], width), asked["query_id"].to_numpy(), None, k)
        kth = top.groupby("query_id")["score"].agg(lambda s: float(s.min()) if len(s) >= k else -np.inf)
        return pd.DataFrame({"query_id": asked["query_id"], "bound": asked["query_id"].map(kth).fillna(-np.inf).astype(float)})

    bounds = longest.groupBy("query_block").cogroup(queries.groupBy("query_block")).applyInPandas(first_bound, "query_id long, bound double")
    asked = stored(queries.join(bounds.groupBy("query_id").agg(F.max("bound").alias("bound")), "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))), "queries")
    # A query block needs a block of rows only if one of its queries can reach its bound with the block's longest row.
    blocks_of = stored(dealt.groupBy("bucket", "block").agg(F.max("norm").alias("top")), "blocks")
    reach = asked.groupBy("query_block").agg(F.min(F.when(F.col("bound") <= 0, float("-inf")).otherwise(F.col("bound") / F.col("length"))).alias("least"))
    n_pairs = blocks_of.count() * query_blocks
    pairs = stored(blocks_of.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).join(small(reach, query_blocks), "query_block").filter(F.col("top") * (1 + ROOM) >= F.col("least")).select("bucket", "block", "query_block"), "pairs")
    sides = asked.join(small(pairs, n_pairs), "query_block")
    rows = dealt.select("bucket", "block", "vec_id", "v").join(small(pairs, n_pairs), ["bucket", "block"])

    def verified(_, own: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return _best(own["vec_id"].to_numpy(), _matrix(own["v"], width), _matrix(q["q"], width), q["query_id"].to_numpy(), q["bound"].to_numpy(), k)

    keys = ["bucket", "block", "query_block"]
    found = rows.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInPandas(verified, TOP)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
