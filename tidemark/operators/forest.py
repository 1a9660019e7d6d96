"""An isolation forest grown from all rows of a table: each tree's rows by one aggregation, one task a tree, trees as a table.

A tree's rows are the `sample` rows of the whole table with the least hash of (tree, id), so every row is as likely as any other and a rerun
chooses the same. Trees are bounded (trees x 2 x sample nodes), so they are broadcast to score every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from tidemark.sources.shared import stored

from .neighbours import exact_quantile, known

#: tree, node (1 is the root, children 2k and 2k + 1), n (rows there), feature and cut (null in a leaf), path (a leaf's depth and what n rows would add).
NODES = "tree int, node long, n long, feature int, cut double, path double"


def mean_path(n: float) -> float:
    """Mean depth of a failed search among n rows."""
    return 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else 1.0 if n == 2 else 0.0


def grow(rows: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple]:
    """(node, n, feature, cut, path) of one tree: random cuts of a random feature that is not constant, until one row or the depth is reached."""
    out, todo = [], [(1, 0, rows)]
    while todo:
        node, level, part = todo.pop()
        wide = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(part) > 1 and level < depth else np.array([], int)
        if not len(wide):
            out.append((node, len(part), None, None, level + mean_path(len(part))))
            continue
        feature = int(rng.choice(wide))
        cut = float(rng.uniform(part[:, feature].min(), part[:, feature].max()))
        out.append((node, len(part), feature, cut, None))
        todo += [(2 * node, level + 1, part[part[:, feature] <= cut]), (2 * node + 1, level + 1, part[part[:, feature] > cut])]
    return out


class Forest:
    """score: -2^(-mean path / usual path), lower is odder; the threshold is the contamination's quantile of the table's own scores."""

    def __init__(self, contamination: float = 0.1, trees: int = 100, sample: int = 256, seed: int = 42):
        self.contamination, self.trees, self.sample, self.seed = contamination, trees, sample, seed

    def _grow(self, rows: DataFrame, vector_col: str, id_col: str) -> None:
        """The trees of stored rows."""
        given = rows.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(vector_col, known).alias("x"))
        n = given.count()
        if not n:
            raise ValueError("no row has a vector")
        m = min(self.sample, n)
        self.m, depth, seed = m, max(1, int(np.ceil(np.log2(max(m, 2))))), self.seed
        # Of a hash's 2^63 values only the least are asked for: some more than m rows a tree, so that fewer than m come about once in 10^15 trees.
        share = min(1.0, (m + 9 * np.sqrt(m) + 60) / n)
        place = lambda t: F.xxhash64(F.lit(seed), t, F.col("id")).bitwiseAND(2**63 - 1)
        few = F.filter(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: place(t) <= F.lit(min(2**63 - 1, int(share * 2**63))))
        drawn = given.withColumn("tree", F.explode(few)).withColumn("place", place(F.col("tree")))
        chosen = drawn.withColumn("k", F.row_number().over(Window.partitionBy("tree").orderBy("place", "id"))).filter(F.col("k") <= m)

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            nodes = grow(np.array(pdf.sort_values("k")["x"].tolist(), dtype=float), np.random.default_rng([seed, tree]), depth)
            return pd.DataFrame(nodes, columns=["node", "n", "feature", "cut", "path"]).assign(tree=tree).astype({"feature": "Int32"})[["tree", "node", "n", "feature", "cut", "path"]]

        self.nodes = stored(chosen.groupBy("tree").applyInPandas(one, NODES), "trees")

    def fit(self, df: DataFrame, vector_col: str = "features", id_col: str = "id") -> Forest:
        self.fit_score(df.select(vector_col, id_col), vector_col, id_col, [])
        return self

    def fit_score(self, df: DataFrame, vector_col: str = "features", id_col: str = "id", keep: list[str] | None = None) -> DataFrame:
        """score() of the rows that the forest is grown from, with the columns `keep` (none given: all): rows are made and scored once."""
        given = stored(df, "rows")
        self._grow(given, vector_col, id_col)
        scored = stored(self._scored(given, vector_col, keep), "scores")
        self.offset = exact_quantile(scored, "score", self.contamination)
        return self._flagged(scored)

    def _flagged(self, scored: DataFrame) -> DataFrame:
        return scored.withColumn("is_anomaly", (F.col("score") < self.offset).cast(BooleanType()))

    def _arrays(self) -> tuple[np.ndarray, ...]:
        """feature, cut, path, children (left, right) by dense number, roots: nodes of all trees end to end. A leaf is its own child, whatever a row has."""
        t = self.nodes.toPandas().sort_values(["tree", "node"])
        key = {k: i for i, k in enumerate(zip(t.tree, t.node, strict=True))}
        below = np.array([[key.get((a, 2 * b + side), i) for side in (0, 1)] for i, (a, b) in enumerate(zip(t.tree, t.node, strict=True))])
        return t.feature.fillna(0).astype(int).to_numpy(), t.cut.fillna(0.0).to_numpy(), t.path.fillna(0.0).to_numpy(), below.reshape(-1), np.flatnonzero(t.node.to_numpy() == 1), int(t.node.max()).bit_length() - 1

    def _scored(self, df: DataFrame, vector_col: str, keep: list[str] | None = None) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self._arrays())
        usual, columns, at = float(mean_path(self.m)) or 1.0, df.columns if keep is None else keep, df.columns.index(vector_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            feature, cut, path, child, roots, depth = sent.value
            for b in batches:
                rows = b.column(at)
                there = np.flatnonzero(~rows.is_null().to_numpy(zero_copy_only=False))
                score, missing = np.zeros(len(rows)), np.ones(len(rows), dtype=bool)
                if len(there):
                    x = rows.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(there), -1)
                    first, x = np.arange(len(x)) * x.shape[1], np.where(np.isfinite(x), x, 0.0).reshape(-1)
                    total = np.zeros(len(there))
                    for root in roots:
                        node = np.full(len(there), root)
                        for _ in range(depth):
                            node = child[2 * node + (x[first + feature[node]] > cut[node])]
                        total += path[node]
                    score[there], missing[there] = -(2.0 ** (-total / len(roots) / usual)), False
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(score, pa.float64(), mask=missing)], names=[*columns, "score"])

        return df.mapInArrow(run, StructType([*[df.schema[c] for c in columns], StructField("score", DoubleType())]))

    def score(self, df: DataFrame, vector_col: str = "features") -> DataFrame:
        """df with score and is_anomaly; rows without a vector have neither."""
        return self._flagged(self._scored(df, vector_col))

    def importances(self) -> DataFrame:
        """feature (its number), share: of all rows that splits part, those that the feature's splits part."""
        split = self.nodes.filter("feature is not null").groupBy("feature").agg(F.sum("n").alias("n"))
        return split.select("feature", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))

    def save(self, folder: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{folder}/trees")
        told = [(self.contamination, self.trees, self.sample, self.seed, self.m, self.offset)]
        self.nodes.sparkSession.createDataFrame(told, "contamination double, trees int, sample int, seed int, m int, offset double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/numbers")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Forest:
        told = spark.read.parquet(f"{folder}/numbers").first().asDict()
        model = cls.__new__(cls)
        vars(model).update(told)
        model.nodes = spark.read.parquet(f"{folder}/trees")
        return model
