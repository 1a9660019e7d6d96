"""Exact neighbour joins of vectors: the k nearest, or all within a distance, of every vector, over every row of a table.

Vectors are dealt to their nearest pivot, and each pivot's vectors to blocks of about `ROWS` by their distance from it. The triangle
inequality and the plane between two pivots say which blocks can hold a neighbour, so a block of queries meets only those
blocks of data. Nearest neighbours are sought twice: in the queries' own cells first, then, with the distance found there, wherever a
nearer vector can be. In many dimensions bounds leave few blocks out, and the work nears that of all pairs of blocks; results are exact always.

No block is shuffled to meet another: a task reads one partition of queries and one of at most `PARTS` parts of the data (more only where a part
would have over PART_BLOCKS blocks), and what it found of a block of queries is one row. So what is shuffled and written follows the number of vectors, also where the
comparisons are all pairs. A task holds its part of the data and a pair of blocks.

Pivots (at most PIVOTS vectors, chosen by hash) and the bounds of their cells travel with the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.shared import arrow_rows, stored

#: Vectors a block is meant to have, pivots at most, vectors a pivot is meant for, blocks in a worker's batch.
ROWS, PIVOTS, CELL, BATCH = 2048, 1024, 1024, 4
#: Parts of the data that queries meet, blocks that a part has at most, files of a table of blocks at most.
PARTS, PART_BLOCKS, FILES = 8, 128, 256
#: Share of the squares' size within which two squared distances count as possibly equal before they are computed from differences.
SLACK = 1e-11
#: Queries that are compared with a block at once, and pairs whose distances are computed at once.
STEP, EXACT = 512, 1 << 15


@dataclass
class Scale:
    """Means and standard deviations (ddof 0) by component, of n rows; a constant component is only centred."""

    centre: list[float]
    spread: list[float]
    n: int = 0

    def of(self, vector: str) -> Column:
        centre, spread = F.lit(self.centre), F.lit(self.spread)
        return F.transform(vector, lambda x, i: (known(x) - F.get(centre, i)) / F.get(spread, i))


def known(x: Column) -> Column:
    """Null, NaN and infinities as 0."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def scale_of(df: DataFrame, vector: str) -> Scale:
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    rows = df.filter(F.col(vector).isNotNull()).select(array_to_vector(F.transform(vector, known)).alias("v"))
    if rows.isEmpty():
        return Scale([], [])
    s = rows.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).first().s
    spread = np.sqrt(s["variance"].toArray() * (s["count"] - 1) / s["count"])
    return Scale(s["mean"].toArray().tolist(), np.where(spread > 0, spread, 1.0).tolist(), s["count"])


def scales_of_others(df: DataFrame, vector: str, k: int) -> list[Scale]:
    """For each of k folds, the scale of the rows (fold, vector) of all others."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    rows = df.filter(F.col(vector).isNotNull()).select("fold", array_to_vector(F.transform(vector, known)).alias("v"))
    told = rows.groupBy("fold").agg(F.count("*").alias("n")).collect()  # as many as folds
    n = [sum(r.n for r in told if r.fold != f) for f in range(k)]
    if not all(n):
        return [Scale([], [], c) for c in n]
    # A row of weight 0 is none.
    each = rows.select(*[Summarizer.metrics("mean", "variance").summary(F.col("v"), F.when(F.col("fold") != f, 1.0).otherwise(0.0)).alias(f"s{f}") for f in range(k)]).first()
    spreads = [np.sqrt(each[f]["variance"].toArray() * (n[f] - 1) / n[f]) for f in range(k)]
    return [Scale(each[f]["mean"].toArray().tolist(), np.where(spreads[f] > 0, spreads[f], 1.0).tolist(), n[f]) for f in range(k)]


def narrowest(scales: list[Scale]) -> tuple[Scale, np.ndarray]:
    """A scale that takes each component's centre and spread from whichever of the scales has the least spread; and by what (at most 1)
    each scale's differences of each component are these ones'. So a far row that one scale leaves out costs that one no digit."""
    centres, spreads = np.array([s.centre for s in scales]), np.array([s.spread for s in scales])
    at, every = spreads.argmin(0), np.arange(spreads.shape[1])
    return Scale(centres[at, every].tolist(), spreads[at, every].tolist(), max(s.n for s in scales)), spreads[at, every] / spreads


def distinct(rows: DataFrame, most: int, *by: str) -> tuple[DataFrame, DataFrame]:
    """rows (id, z) as (vid, n, z), one row a vector, vid its least id and n its rows; and (vid, id) of the `most` least ids of each.

    by: columns that both have too; equal vectors are one within them only. Equal vectors are one key, however many: ids are limited before they are shuffled.
    """
    place = F.row_number().over(Window.partitionBy("z", *by).orderBy("id"))
    ids = rows.withColumn("k", place).filter(F.col("k") <= most).groupBy("z", *by).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    counts = rows.groupBy("z", *by).agg(F.min("id").alias("vid"), F.count("*").alias("n"))
    both = stored(counts.join(ids, ["z", *by]), "vectors")
    return both.select("vid", "n", "z", *by), both.select("vid", *by, F.explode("ids").alias("id"))


def _between(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and how far each may be from the truth."""
    la, lb = (a * a).sum(1)[:, None], (b * b).sum(1)[None, :]
    return np.maximum(la + lb - 2 * a @ b.T, 0.0), SLACK * (la + lb)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(-1))


def pivots_of(vectors: DataFrame) -> np.ndarray:
    n = max(1, min(PIVOTS, vectors.count() // CELL))
    return np.array([r.z for r in vectors.orderBy(F.xxhash64("vid"), "vid").limit(n).select("z").collect()], dtype=float)


def _lists(column: pa.Array, kind=np.float64) -> list[np.ndarray]:
    values, at = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))])
    return [values[at[i] : at[i + 1]] for i in range(len(column))]


@dataclass
class Blocks:
    """block, cell, low, high (distances from the pivot), vid[], n[], z (all vectors end to end, as bytes of doubles); the pivots; each cell's bounds."""

    rows: DataFrame
    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _doubles(column: pa.Array, width: int) -> list[np.ndarray]:
    """Vectors out of bytes."""
    return [np.frombuffer(v.as_buffer(), dtype=np.float64).reshape(-1, width) for v in column]


def deal(vectors: DataFrame, pivots: np.ndarray) -> Blocks:
    """vectors (vid, n, z) in blocks. A cell of many vectors is cut at quantiles of the distance, and what is still too large by hash."""

    def nearest_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else np.zeros((0, pivots.shape[1]))
            cell = _between(z, pivots)[0].argmin(1) if len(batch) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(_exact(z, pivots[cell]), pa.float64())], names=["vid", "n", "z", "cell", "far"])

    each = vectors.select("vid", "n", "z").mapInArrow(nearest_pivot, "vid long, n long, z array<double>, cell int, far double")
    count = vectors.count()
    if count <= ROWS and len(pivots) == 1:
        # So few are one block: what follows would find no more.
        return _blocks(each.withColumn("ring", F.lit(0)).withColumn("part", F.lit(0)), pivots, 1)
    each = stored(each, "cells")
    cuts = each.groupBy("cell").agg(F.count("*").alias("c"), F.percentile_approx("far", [k / 16 for k in range(1, 16)], 1000).alias("cuts")).filter(F.col("c") > ROWS)
    # As many rings as blocks are needed, up to 16.
    rings = F.least(F.lit(16), F.ceil(F.col("c") / ROWS))
    cuts = cuts.select("cell", F.filter("cuts", lambda x, i: F.floor((i + 1) * rings / 16) > F.floor(i * rings / 16)).alias("cuts"))
    ringed = each.join(cuts, "cell", "left").withColumn("ring", F.coalesce(F.size(F.filter("cuts", lambda x: x < F.col("far"))), F.lit(0))).drop("cuts")
    sizes = ringed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / ROWS).alias("parts"))
    keyed = ringed.join(sizes, ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")))
    return _blocks(keyed, pivots, max(1, min(FILES, count // (2 * ROWS))))


def _blocks(keyed: DataFrame, pivots: np.ndarray, files: int) -> Blocks:
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([z.tobytes() for z in _lists(batch.column(len(batch.columns) - 1))], pa.binary())], names=batch.schema.names)

    grouped = keyed.repartition(files, "cell", "ring", "part").groupBy("cell", "ring", "part").agg(F.collect_list(F.struct("vid", "n", "z", "far")).alias("x"), F.min("far").alias("low"), F.max("far").alias("high"))
    listed = grouped.select(F.monotonically_increasing_id().alias("block"), "cell", "low", "high", F.col("x.vid").alias("vid"), F.col("x.n").alias("n"), F.flatten("x.z").alias("z"))
    with arrow_rows(keyed.sparkSession, BATCH):
        rows = stored(listed.mapInArrow(packed, "block long, cell int, low double, high double, vid array<bigint>, n array<bigint>, z binary"), "blocks")
    low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in rows.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # as many as pivots
        low[r.cell], high[r.cell] = r.low, r.high
    return Blocks(rows, pivots, low, high)


def _wanting(queries: DataFrame, data: Blocks) -> DataFrame:
    """block, cell, limit, z of queries with first[] and last[] by cell: distances from its pivot between which vectors may be within `limit[]` of one of them."""
    pivots, low, high = data.pivots, data.low, data.high
    apart = np.sqrt(_between(pivots, pivots)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for cell, limit, z in zip(batch.column(1).to_pylist(), _lists(batch.column(2)), _doubles(batch.column(3), pivots.shape[1]), strict=True):
                first, last = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
                for k in range(0, len(z), STEP):
                    square, slack = _between(z[k : k + STEP], pivots)
                    far, reach = np.sqrt(square), limit[k : k + STEP, None] + np.sqrt(slack) + 1e-9
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = np.where(apart[cell] > 0, (square - square[:, [cell]]) / (2 * apart[cell]), 0.0)
                    needs = (far - reach <= high) & (far + reach >= low) & (plane <= reach)
                    first, last = np.minimum(first, np.where(needs, far - reach, np.inf).min(0)), np.maximum(last, np.where(needs, far + reach, -np.inf).max(0))
                out.append((first, last))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([o[k] for o in out], pa.list_(pa.float64())) for k in (0, 1)]], names=["block", "cell", "limit", "z", "first", "last"])

    return queries.select("block", "cell", "limit", "z").mapInArrow(run, "block long, cell int, limit array<double>, z binary, first array<double>, last array<double>")


def _everywhere(queries: DataFrame, data: Blocks, others: bool = False) -> DataFrame:
    """a, limit, za, vid, n, zb of the pairs of blocks that _wanting() leaves; others: without those of one cell. Partitions meet as they lie in files.

    A block of queries goes to a worker once for each part of the data, with the part's first block: elsewhere za and limit are null. Where that block is not wanted, its zb is.
    """
    files = max(1, min(FILES, queries.count() // 2))
    bound = stored(_wanting(queries.repartition(files, "block"), data), "bound").select(F.col("block").alias("a"), F.col("cell").alias("of"), "limit", F.col("z").alias("za"), "first", "last")
    parts = max(PARTS, -(-data.rows.count() // PART_BLOCKS))
    can = (F.get("first", F.col("cell")) <= F.col("high")) & (F.get("last", F.col("cell")) >= F.col("low"))
    can = can & (F.col("of") != F.col("cell")) if others else can
    first_of_part = F.monotonically_increasing_id().bitwiseAND(2**33 - 1) == 0
    part = data.rows.coalesce(parts).select("cell", "low", "high", "vid", "n", F.col("z").alias("zb"), first_of_part.alias("lead"))
    met = bound.hint("shuffle_replicate_nl").join(part, F.col("lead") | can)
    return met.select("a", *[F.when(F.col("lead"), F.col(c)).alias(c) for c in ("limit", "za")], *[F.when(can, F.col(c)).alias(c) for c in ("vid", "n", "zb")])


class _Compared:
    """Queries beside blocks of data: which squared distances can be under a threshold, by one product of matrices of single precision and a bound of its error."""

    def __init__(self, a: np.ndarray, limit: np.ndarray):
        self.a, self.limit, self.square = a, limit.copy(), (a * a).sum(1)
        self.left = self._left(np.float32)

    def _left(self, kind: type) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.concatenate([-2 * self.a, np.ones((len(self.a), 1))], axis=1).astype(kind)

    def against(self, b: np.ndarray) -> Iterator[tuple]:
        """first row, low, slack of STEP queries at a time: low[i, j] is at most the squared distance, low + slack[i] at least."""
        lb = (b * b).sum(1)
        large = max(self.square.max(initial=0.0), lb.max(initial=0.0)) > 1e30
        kind, unit, left = (np.float64, 2.0**-53, self._left(np.float64)) if large else (np.float32, 2.0**-24, self.left)
        share = 4 * (b.shape[1] + 8) * unit
        right = np.concatenate([b, (lb * (1 - share))[:, None]], axis=1).astype(kind).T
        most = lb.max(initial=0.0)
        for k in range(0, len(self.a), STEP):
            la = self.square[k : k + STEP]
            # What every element of a row has in common is added to the thresholds instead.
            yield k, left[k : k + STEP] @ right, la * (1 - share) - 1e-30, 2 * share * (la + most) + 2e-30

    @staticmethod
    def under(low: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """i, j of all low[i, j] <= most[i]. Most rows have none, as their least element tells."""
        most = np.nextafter(most.astype(low.dtype), np.inf)
        some = np.flatnonzero(~(low.min(1, initial=np.inf) > most))
        part, limit = (low, most) if len(some) == len(low) else (low[some], most[some])
        i, j = np.divmod(np.flatnonzero(part <= limit[:, None]), max(1, low.shape[1]))
        return some[i], j

    def exact(self, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[_exact(self.a[i[k : k + EXACT]], b[j[k : k + EXACT]]) for k in range(0, len(i), EXACT)]])


class _Nearest(_Compared):
    """The k nearest of each query, by distance, then id. Whatever lies under its bound is kept until it is much; then the k least are, and the bound is theirs."""

    def __init__(self, a: np.ndarray, limit: np.ndarray, k: int):
        super().__init__(a, limit)
        self.k, self.some, self.more = k, (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)), []

    def add(self, vid: np.ndarray, n: np.ndarray, b: np.ndarray) -> None:
        for at, low, common, slack in self.against(b):
            limit = self.limit[at : at + STEP]
            most = limit * limit
            if len(b) >= self.k and (free := np.isinf(limit)).any():
                most[free] = np.partition(low[free], self.k - 1, axis=1)[:, self.k - 1] + (common + slack)[free]
            i, j = self.under(low, most - common)
            self.more.append((i + at, self.exact(i + at, b, j), vid[j]))
            if sum(len(m[0]) for m in self.more) > 4 * len(self.a) * self.k:
                self.settle()

    def settle(self) -> None:
        i, d, v = (np.concatenate(x) for x in zip(self.some, *self.more, strict=True))
        order = np.lexsort((v, d, i))
        i, d, v = i[order], d[order], v[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        kept = place < self.k
        self.some, self.more = (i[kept], d[kept], v[kept]), []
        last = place == self.k - 1
        self.limit[i[last]] = np.minimum(self.limit[i[last]], d[last])

    def result(self) -> list[np.ndarray]:
        self.settle()
        i, d, v = self.some
        place = np.arange(len(i)) - np.searchsorted(i, i)
        out = np.full((len(self.a), self.k), np.inf), np.full((len(self.a), self.k), -1, dtype=np.int64)
        out[0][i, place], out[1][i, place] = d, v
        return list(out)


class _NearestOfOthers(_Compared):
    """The k nearest of each query for each of several models, which leave one fold of the data out each and stretch the components' differences.

    One comparison serves them all: by the least and the greatest stretch, a distance bounds the models' own, and only for what lies under
    the bounds are these computed. What stands for a vector's number of rows here is its fold.
    """

    def __init__(self, a: np.ndarray, limit: np.ndarray, k: int, stretch: np.ndarray):
        super().__init__(a, limit)
        self.k, self.weight, self.least, self.most = k, stretch**2, stretch.min(1), stretch.max(1)
        self.limits = limit[:, None] * self.most * (1 + 1e-9) + 1e-9
        self.some = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)) for _ in stretch]
        self.more: list[list[tuple]] = [[] for _ in stretch]

    def add(self, vid: np.ndarray, fold: np.ndarray, b: np.ndarray) -> None:
        others = [np.flatnonzero(fold != f) for f in range(len(self.weight))]
        for at, low, common, slack in self.against(b):
            limit = self.limit[at : at + STEP]
            most = limit * limit
            if (free := np.isinf(limit)).any() and all(len(o) >= self.k for o in others):
                kth = [np.partition(low[np.ix_(free, o)], self.k - 1, axis=1)[:, self.k - 1] for o in others]
                most[free] = np.max([(x + (common + slack)[free]) * (m / n) ** 2 for x, m, n in zip(kth, self.most, self.least, strict=True)], axis=0) * (1 + 1e-9)
            i, j = self.under(low, most - common)
            for k in range(0, len(i), EXACT):
                self._keep(i[k : k + EXACT] + at, j[k : k + EXACT], vid, fold, b)
            if sum(len(m[0]) for more in self.more for m in more) > 4 * self.limits.size * self.k:
                self.settle()

    def _keep(self, i: np.ndarray, j: np.ndarray, vid: np.ndarray, fold: np.ndarray, b: np.ndarray) -> None:
        square = (self.a[i] - b[j]) ** 2
        for f, weight in enumerate(self.weight):
            d = np.sqrt((square * weight).sum(1))
            kept = (fold[j] != f) & (d <= self.limits[i, f])
            self.more[f].append((i[kept], d[kept], vid[j[kept]]))

    def settle(self) -> None:
        for f, (some, more) in enumerate(zip(self.some, self.more, strict=True)):
            i, d, v = (np.concatenate(x) for x in zip(some, *more, strict=True))
            order = np.lexsort((v, d, i))
            i, d, v = i[order], d[order], v[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            kept, last = place < self.k, place == self.k - 1
            self.some[f], self.more[f] = (i[kept], d[kept], v[kept]), []
            self.limits[i[last], f] = np.minimum(self.limits[i[last], f], d[last])
        self.limit = np.minimum(self.limit, (self.limits / self.least).max(1) * (1 + 1e-9) + 1e-9)

    def result(self) -> list[np.ndarray]:
        """d and v, a query's models one after the other."""
        self.settle()
        shape = (*self.limits.shape, self.k)
        out = np.full(shape, np.inf), np.full(shape, -1, dtype=np.int64)
        for f, (i, d, v) in enumerate(self.some):
            place = np.arange(len(i)) - np.searchsorted(i, i)
            out[0][i, f, place], out[1][i, f, place] = d, v
        return list(out)


class _Within(_Compared):
    """How many rows lie within each query's limit."""

    def __init__(self, a: np.ndarray, limit: np.ndarray):
        super().__init__(a, limit)
        self.counts = np.zeros(len(a), np.int64)

    def add(self, vid: np.ndarray, n: np.ndarray, b: np.ndarray) -> None:
        single = (n == 1).all()
        for at, low, common, slack in self.against(b):
            limit = self.limit[at : at + STEP]
            perhaps = low <= np.nextafter((limit * limit - common).astype(low.dtype), np.inf)[:, None]
            sure = low < np.nextafter((limit * limit - common - slack).astype(low.dtype), -np.inf)[:, None]
            counts = np.count_nonzero(sure, axis=1) if single else (sure.astype(float) @ n.astype(float)).astype(np.int64)
            i, j = np.nonzero(perhaps & ~sure)
            inside = self.exact(i + at, b, j) <= limit[i]
            np.add.at(counts, i[inside], n[j[inside]])
            self.counts[at : at + STEP] += counts

    def result(self) -> list[np.ndarray]:
        return [self.counts]


def _meet(pairs: DataFrame, width: int, start: Callable, kinds: str) -> DataFrame:
    """Pairs (a, limit, za, vid, n, zb), those of one block a one after the other, the first with za: start(za, limit) meets each (vid, n, zb), and its result is a row beside a."""
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), *[pa.array([x.reshape(-1)], pa.list_(pa.float64() if f"{n} array<double>" in kinds else pa.int64())) for n, x in zip(names, state.result(), strict=True)]], names=["a", *names])
        for batch in batches:
            limits, vids, counts = _lists(batch.column(1)), _lists(batch.column(3), np.int64), _lists(batch.column(4), np.int64)
            for k, a in enumerate(batch.column(0).to_pylist()):
                if a != now:
                    if now is not None:
                        yield row()
                    if not batch.column(2)[k].is_valid:
                        raise ValueError("a block of queries came without its vectors")
                    now, state = a, start(_doubles(batch.column(2).slice(k, 1), width)[0].copy(), limits[k])
                if batch.column(5)[k].is_valid:
                    state.add(vids[k], counts[k], _doubles(batch.column(5).slice(k, 1), width)[0])
        if now is not None:
            yield row()

    return pairs.select("a", "limit", "za", "vid", "n", "zb").mapInArrow(run, f"a long, {kinds}")


def _merged(parts: DataFrame, merge: Callable, kinds: str) -> DataFrame:
    """The rows of each block a made one by merge(so far, next); a task holds two rows at a time."""
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), *[pa.array([x.reshape(-1)], pa.list_(pa.float64() if f"{n} array<double>" in kinds else pa.int64())) for n, x in zip(names, kept, strict=True)]], names=["a", *names])
        for batch in batches:
            columns = [_lists(batch.column(1 + k), float if f"{n} array<double>" in kinds else np.int64) for k, n in enumerate(names)]
            for a, *arrays in zip(batch.column(0).to_pylist(), *columns, strict=True):
                if a == now:
                    kept = merge(kept, arrays)
                    continue
                if now is not None:
                    yield row()
                now, kept = a, arrays
        if now is not None:
            yield row()

    return parts.repartition("a").sortWithinPartitions("a").mapInArrow(run, f"a long, {kinds}")


def _first(d: np.ndarray, vid: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's k least by (distance, id)."""
    order = np.lexsort((vid, d), axis=1)[:, :k]
    return [np.take_along_axis(d, order, 1), np.take_along_axis(vid, order, 1)]


def nearest(queries: Blocks, data: Blocks, k: int) -> DataFrame:
    """vid, near: the k nearest vectors of data to each query, array<struct<distance, vid>>, by distance, then vid; itself too where it is among them."""
    return _nearest(queries, data, k, lambda a, limit: _Nearest(a, limit, k), [1.0]).drop("model")


def nearest_of_others(queries: Blocks, data: Blocks, k: int, stretch: np.ndarray) -> DataFrame:
    """vid, model, near: nearest() for each of len(stretch) models. Model f knows the data's vectors whose n is not f, and its differences are the blocks' times stretch[f]."""
    return _nearest(queries, data, k, lambda a, limit: _NearestOfOthers(a, limit, k, stretch), stretch.min(1).tolist())


def _nearest(queries: Blocks, data: Blocks, k: int, start: Callable, least: list[float]) -> DataFrame:
    """vid, model, near of as many models as `least` has numbers: the blocks' distance is at most a model's own by its number."""
    spark, width, models = queries.rows.sparkSession, data.pivots.shape[1], len(least)
    kinds = "d array<double>, v array<bigint>"

    def merge(kept, more):
        d, v = (np.concatenate([x.reshape(-1, k), y.reshape(-1, k)], axis=1) for x, y in zip(kept, more, strict=True))
        return _first(d, v, k)

    with arrow_rows(spark, BATCH):
        open_ = queries.rows.withColumn("limit", F.transform("vid", lambda _: F.lit(float("inf"))))
        own = open_.select(F.col("block").alias("a"), "cell", "limit", F.col("z").alias("za")).join(data.rows.select("cell", "vid", "n", F.col("z").alias("zb")), "cell")
        best = first = stored(_merged(_meet(own, width, start, kinds), merge, kinds), "near")
        if len(data.pivots) > 1:
            # The second search: wherever a vector can be nearer than the k-th that was found.
            last = lambda i: [F.element_at("d", ((i - 1) * models * k + (f + 1) * k).cast("int")) for f in range(models)]
            reach = lambda i: F.array_max(F.array(*[x / F.lit(n) * (1 + 1e-9) + 1e-9 for x, n in zip(last(i), least, strict=True)])) if models > 1 else last(i)[0]
            found = first.select(F.col("a").alias("block"), F.transform(F.sequence(F.lit(1), (F.size("d") / (models * k)).cast("int")), reach).alias("found"))
            bound = open_.join(found, "block", "left").withColumn("limit", F.coalesce("found", "limit"))
            best = stored(_merged(first.unionByName(_meet(_everywhere(bound, data, others=True), width, start, kinds)), merge, kinds), "near")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vid, d, v in zip(*[_lists(batch.column(c), t) for c, t in ((0, np.int64), (1, float), (2, np.int64))], strict=True):
                there = d < np.inf
                at = np.concatenate([[0], there.reshape(-1, k).sum(1).cumsum()]).astype(np.int32)
                near = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(d[there]), pa.array(v[there])], names=["distance", "vid"]))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(vid, models)), pa.array(np.tile(np.arange(models, dtype=np.int32), len(vid))), near], names=["vid", "model", "near"])

    # The lists of a block are long: to explode them would copy them for every vector.
    flat = best.join(queries.rows.select(F.col("block").alias("a"), F.col("vid").alias("of")), "a")
    return flat.select("of", "d", "v").mapInArrow(each, "vid long, model int, near array<struct<distance: double, vid: bigint>>")


def within(queries: Blocks, data: Blocks, eps: float) -> DataFrame:
    """vid, n: how many rows of data lie within eps of each query."""
    kinds = "n array<bigint>"
    with arrow_rows(queries.rows.sparkSession, BATCH):
        bound = queries.rows.withColumn("limit", F.transform("vid", lambda _: F.lit(float(eps))))
        counts = stored(_merged(_meet(_everywhere(bound, data), data.pivots.shape[1], _Within, kinds), lambda x, y: [x[0] + y[0]], kinds), "within")
    none = F.transform("vid", lambda _: F.lit(0).cast("long"))
    flat = queries.rows.select(F.col("block").alias("a"), "vid").join(counts, "a", "left")
    return flat.select(F.explode(F.arrays_zip("vid", F.coalesce("n", none).alias("n"))).alias("x")).select("x.vid", F.col("x.n").alias("n"))


def exact_quantile(df: DataFrame, column: str, q: float, room: int = 10_000) -> float | None:
    """The q quantile, linear between the two rows around it; null without rows. No more than `room` rows are ever sorted together."""
    rows = df.select(F.col(column).cast("double").alias("x")).filter("x is not null")
    n = rows.count()
    if not n:
        return None
    at = q * (n - 1)
    low = _at_place(rows, n, int(at), room)
    return low if at == int(at) else low + (at - int(at)) * (_at_place(rows, n, int(at) + 1, room) - low)


def exact_quantiles(df: DataFrame, column: str, q: float, by: str) -> dict:
    """exact_quantile() of each group, few groups at once: approximate quantiles bracket the places, and only the distinct values between them are sorted."""
    rows, margin, out = df.select(F.col(by).alias("by"), F.col(column).cast("double").alias("x")).filter("x is not null"), 1e-3, {}
    while True:
        between = F.percentile_approx("x", [max(0.0, q - margin), min(1.0, q + margin)], 10_000) if margin < 1 else F.array(F.min("x"), F.max("x"))
        ends = rows.groupBy("by").agg(F.count("*").alias("n"), between.alias("ends"))
        met = rows.join(F.broadcast(ends), "by")
        less = met.groupBy("by", "n").agg(F.count(F.when(F.col("x") < F.col("ends")[0], 1)).alias("less"))
        inside = met.filter((F.col("x") >= F.col("ends")[0]) & (F.col("x") <= F.col("ends")[1])).groupBy("by", "x").agg(F.count("*").alias("c"))
        upto = inside.join(F.broadcast(less), "by").withColumn("upto", F.col("less") + F.sum("c").over(Window.partitionBy("by").orderBy("x")))
        at = F.lit(q) * (F.col("n") - 1)
        first = lambda place: F.min(F.when((F.col("less") <= place) & (F.col("upto") > place), F.col("x")))
        told = upto.groupBy("by", "n").agg(first(F.floor(at)).alias("low"), first(F.ceil(at)).alias("high")).collect()
        out |= {r.by: r.low + (q * (r.n - 1) - int(q * (r.n - 1))) * (r.high - r.low) for r in told if r.low is not None and r.high is not None}
        rows, margin = rows.filter(~F.col("by").isin(list(out))) if out else rows, 10 * margin
        if len(told) == sum(r.by in out for r in told):
            return out


def _at_place(rows: DataFrame, n: int, place: int, room: int) -> float:
    """The value (x) at a place of the order, from 0: approximate quantiles bracket it, counts confirm, what lies between the bracket's ends is left."""
    margin = 0.01
    while n > room:
        low, high = rows.approxQuantile("x", [max(0.0, place / n - margin), min(1.0, (place + 1) / n + margin)], margin / 4)
        count = lambda c: F.count(F.when(c, 1))
        less, first, inside, last = rows.agg(count(F.col("x") < low), count(F.col("x") == low), count((F.col("x") > low) & (F.col("x") < high)), count(F.col("x") == high)).first()
        if less <= place < less + first:
            return low
        if less + first <= place < less + first + inside:
            rows, n, place = rows.filter((F.col("x") > low) & (F.col("x") < high)), inside, place - less - first
        elif less + first + inside <= place < less + first + inside + last:
            return high
        else:
            margin *= 2
    return rows.orderBy("x").limit(place + 1).agg(F.max("x")).first()[0]
