"""MinHash near-dedup with ProbMinHash over word shingles.

Equal word sequences are one node. A node's distinct shingles (five words) arrive as Poisson processes: each arrival picks a
register, a register keeps its first arrival, and an element stops once its next arrival comes after the slowest register's.
Here all shingles of a node have one weight, however often they occur, for then the probability Jaccard similarity, with which
two registers agree, is the plain Jaccard similarity by which links are defined; weights from counts (signatures() takes them)
would lose near copies in which one text repeats lines. Bands of registers make buckets; in each bucket all nodes are compared with one pivot, the same smallest node for
most buckets; in buckets that still hold several classes, with the most linked node, `HUB_ROUNDS` times; then nodes of
different classes that share one of their rarest shingles, where every similar pair must meet. Pairs are verified by the
exact Jaccard similarity of their shingle sets; with pivots and hubs only those whose registers agree in `FLOOR` or more, as
similar pairs that these leave apart meet again by a rare shingle. Classes are the connected components of the links.

Defined results: texts of one to four words are one shingle; texts without words, and null, are copies of each other; rows of
one text share a class whatever their ids. class_id is the class's smallest doc_id (null if no row of it has one). Rows that
are repeated are all representatives if one is; stage() keeps exactly one row a class. Very long texts are compared whole. No
rows give no classes. Only the two named columns are read; stage() returns all columns of docs as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, small, stored, words

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 4
REGISTERS = BANDS * ROWS
#: Share of equal registers from which a pair with a pivot or hub is verified: 0.8 less five standard deviations of the estimate.
FLOOR = 0.6
#: Parts into which shingles are dealt by hash, so that their counts bound what two sets share.
PARTS = 64
#: Rounds in which the most linked node of a bucket is compared with all others of other classes.
HUB_ROUNDS = 2
#: A text that more than one in HOT rows share is broadcast to them instead of being a join key.
HOT = 1000
#: Words that are hashed together, and documents that go to Python in one batch: both bound a worker's memory.
WORDS_AT_ONCE, ROWS_AT_ONCE = 50_000, 256
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finalizer for 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def elements(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count) of the distinct shingles, by row and hash. values: word hashes of all rows, offsets: where each row's begin and end."""
    n = np.diff(offsets)
    v = values.astype(np.uint64)
    row = np.repeat(np.arange(len(n)), np.maximum(n - SHINGLE + 1, np.minimum(n, 1)))
    first = np.zeros(len(n), dtype=np.int64)
    counts = np.maximum(n - SHINGLE + 1, np.minimum(n, 1))
    first[1:] = np.cumsum(counts)[:-1]
    start = offsets[:-1][row] + (np.arange(len(row)) - first[row])
    s = np.zeros(len(row), dtype=np.uint64)
    for k in range(SHINGLE):
        there = k < n[row]
        s = np.where(there, _mix(s + v[np.minimum(start + k, len(v) - 1)] * np.uint64(2 * k + 3)), s) if len(v) else s
    order = np.lexsort((s, row))
    row, s = row[order], s[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    return row[at], s[at], np.diff(np.append(at, len(s)))


def signatures(values: np.ndarray, offsets: np.ndarray, registers: int = REGISTERS, weighted: bool = False) -> np.ndarray:
    """(rows, registers) int32: element hashes of the rows that values and offsets give, as for elements().

    weighted: an element arrives at a rate of its count, and registers agree with the probability Jaccard similarity of the
    counts; else all arrive alike, and it is that of sets.
    """
    n = np.diff(offsets)
    row, s, count = elements(values, offsets)
    rate = count.astype(float) if weighted else np.ones(len(s))
    arrival = np.full((len(n), registers), np.inf)
    element = np.zeros((len(n), registers), dtype=np.uint64)
    flat, ids = arrival.reshape(-1), element.reshape(-1)
    clock = np.zeros(len(s))
    turn = 0
    while len(s):
        turn += 1
        h = _mix(s + np.uint64((turn * MIX[2]) & 0xFFFFFFFFFFFFFFFF))
        clock = clock - np.log(((h >> np.uint64(11)).astype(float) + 0.5) / 2**53) / rate
        to = row * registers + (_mix(h) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(flat, to, clock)
        won = flat[to] == clock
        ids[to[won]] = s[won]
        busy = np.unique(row)
        slowest = np.zeros(len(n))
        slowest[busy] = arrival[busy].max(1)
        go = clock < slowest[row]
        row, s, clock, rate = row[go], s[go], clock[go], rate[go]
    return _mix(element).astype(np.uint32).view(np.int32)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """ROWS_AT_ONCE holds for what is run (not only planned) inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, ROWS_AT_ONCE)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, word hashes, offsets) for runs of rows with about WORDS_AT_ONCE words, so that memory is bounded."""
    for whole in batches:
        ends = np.asarray(whole.column(1).offsets, dtype=np.int64)
        at = 0
        while at < whole.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + WORDS_AT_ONCE, side="right")) - 1)
            offsets = ends[at : to + 1]
            yield whole.column(0).slice(at, to - at), np.asarray(whole.column(1).values)[offsets[0] : offsets[-1]], offsets - offsets[0]
            at = to


def _lists(flat: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, values, offsets in _runs(batches):
        sig = signatures(values, offsets)
        yield pa.RecordBatch.from_arrays([keys, _lists(sig.reshape(-1), np.arange(0, sig.size + 1, REGISTERS), pa.int32())], names=["fp", "sig"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row its shingle hashes, and how many of them fall in each of PARTS parts."""
    for keys, values, offsets in _runs(batches):
        row, s, _ = elements(values, offsets)
        parts = np.bincount(row * PARTS + (s % np.uint64(PARTS)).astype(np.int64), minlength=len(keys) * PARTS)
        ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(keys))))
        yield pa.RecordBatch.from_arrays([keys, _lists(s.view(np.int64), ends, pa.int64()), _lists(parts.astype(np.int32), np.arange(0, parts.size + 1, PARTS), pa.int32())], names=["node", "x", "parts"])


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose registers agree in FLOOR or more."""
    sig = nodes.select("node", "sig")
    return pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").filter(F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) >= FLOOR * REGISTERS).select("a", "b")


def _links(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that exact comparison confirms."""
    both = pairs.join(shingles.select("node", "x").toDF("a", "xa"), "a").join(shingles.select("node", "x").toDF("b", "xb"), "b").withColumn("common", F.size(F.array_intersect("xa", "xb")))
    return both.filter(F.col("common") >= similarity * (F.size("xa") + F.size("xb") - F.col("common"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each linked node's component. Labels spread along links and jump to their labels' labels; each round is stored."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        spread = edges.join(labels.toDF("b", "other"), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        low = labels.join(spread, "node").select("node", F.col("label").alias("was"), F.least("label", "other").alias("label"))
        jumped = low.join(labels.toDF("label", "beyond"), "label", "left").select("node", "was", F.least("label", F.coalesce("beyond", "label")).alias("label"))
        after = stored(jumped, "labels")
        if after.filter("was <> label").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def _mixed(members: DataFrame, links: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members (key, node, label, degree), and the buckets that hold several classes (key, led: the member with most links)."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    known = found.join(degree, "node", "left")
    placed = stored(members.join(known, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree")), "placed")
    led = placed.groupBy("key").agg(F.max(F.struct("degree", "node", "label")).alias("led"), F.min("label").alias("low"), F.max("label").alias("high"))
    return placed, led.filter("low <> high").select("key", "led")


def _sharing_prefix(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different classes that may be similar, from sets (node, label, x, parts); exact.

    Shingles are ordered: first those of a single class, which no such pair shares, then rare before frequent. Of n
    shingles, a partner shares at least similarity * n, so it shares one of the first n - ceil(similarity * n) + 1, and one
    that is among its own first ones too. Once both sizes are known, so is the least number shared, and the first shared
    shingle must have so many places from it to the end of either set, and the counts of the parts, the lesser of the two
    in each part, must add up to it. What is a copy's own takes up its first places, so a
    group makes few pairs.
    """
    bound = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda t, c: t + c)
    each = sets.select("node", "label", F.size("x").alias("n"), F.explode("x").alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("f"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("s", "f")
    ranked = each.join(shared, "s").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("live"))
    own = F.col("n") - F.size("live")
    room = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1 - own
    first = stored(ranked.withColumn("room", room.cast("int")).filter("room > 0").select("node", "label", "n", own.alias("own"), F.posexplode(F.slice("live", F.lit(1), F.col("room"))["s"]).alias("i", "s")).select("node", "label", "n", (F.col("own") + F.col("i")).alias("i"), "s").join(sets.select("node", "parts"), "node"), "prefixes").select("node", "label", "n", "i", "s", "parts")
    least = F.ceil((F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-9)
    met = first.toDF("a", "la", "na", "ia", "s", "pa").join(first.toDF("b", "lb", "nb", "ib", "s", "pb"), "s").filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (F.col("ia") <= F.col("na") - least) & (F.col("ib") <= F.col("nb") - least) & (bound >= least))
    return met.select("a", "b").distinct()


def classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, class_id, is_representative."""
    texts, of_text = _classed(docs, similarity, id_col, text_col)
    met = _with_class(texts, of_text)
    return met.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("is_representative"))


def _with_class(texts: DataFrame, of_text: DataFrame) -> DataFrame:
    """texts with the columns of of_text (unique by fp). A text that many rows share is no hot key: those of more than one row
    in HOT, so fewer than HOT texts, are broadcast."""
    hot = F.broadcast(of_text.filter("n > total / %d" % HOT))
    few = texts.join(hot, "fp")
    rest = texts.join(hot.select("fp"), "fp", "left_anti").join(of_text, "fp")
    return few.unionByName(rest)


def _classed(docs: DataFrame, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(texts: doc_id, fp, h, row_key), stored, and of each distinct text (fp, n, total, class_id, keep: the row_key to keep of its class), stored."""
    hashed = lambda w: F.struct(F.md5(F.array_join(w, " ").cast("binary")).alias("fp"), F.transform(w, lambda x: F.xxhash64(x)).alias("h"))
    texts = stored(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_key"), let(words(F.col(text_col)), hashed).alias("of")).select("doc_id", "row_key", "of.fp", "of.h"), "texts")
    of_docs, told = texts.select("doc_id", "row_key", "fp"), texts.select("fp", "h")
    signed = told.filter(F.size("h") > 0).mapInArrow(_signed, "fp string, sig array<int>")
    with _small_batches(docs.sparkSession):
        nodes = stored(signed.groupBy("fp").agg(F.first("sig").alias("sig")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.slice("sig", k * ROWS + 1, ROWS)))
    keyed = nodes.select("node", F.explode(band).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).filter("n > 1")
    members = stored(keyed.join(shared, "key").select("key", "node", "pivot"), "members")
    wanted = stored(members.select("node").distinct().join(nodes.select("node", "fp"), "node"), "wanted")
    n = wanted.count()
    met = told.join(small(wanted, n), "fp").select("node", "h")
    with _small_batches(docs.sparkSession):
        shingles = stored(met.mapInArrow(_shingled, f"node {dict(wanted.dtypes)['node']}, x array<bigint>, parts array<int>").dropDuplicates(["node"]), "shingles")
    stars = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(_links(_estimated(stars, nodes), shingles, similarity), "links")
    found = components(links)
    for _ in range(HUB_ROUNDS):
        placed, mixed = _mixed(members, links, found)
        stars = placed.join(mixed, "key").filter("label <> led.label").select(F.col("led.node").alias("a"), F.col("node").alias("b")).distinct()
        more = stored(_links(_estimated(stars, nodes), shingles, similarity), "links")
        if more.isEmpty():
            break
        links = links.union(more)
        found = components(links)
    placed, mixed = _mixed(members, links, found)
    apart = placed.join(mixed, "key").select("node", "label").distinct()
    more = stored(_links(_sharing_prefix(shingles.join(apart, "node"), similarity), shingles, similarity), "links")
    if not more.isEmpty():
        found = components(links.union(more))
    named = nodes.select("node", "fp").join(found, "node", "left").select("fp", F.coalesce("label", "node").alias("label"))
    # By text, then by class, each combined before its shuffle: a class with a third of all rows is few rows here.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row_key").alias("row_key"))).alias("first")
    by_text = of_docs.groupBy("fp").agg(F.count("*").alias("n"), first)
    total = of_docs.count()
    grouped = stored(by_text.join(named, "fp", "left").withColumn("group", F.coalesce(F.col("label").cast("string"), "fp")).select("fp", "n", "first", "group"), "grouped")
    best = grouped.groupBy("group").agg(F.min("first").alias("best"))
    of_text = grouped.join(best, "group").select("fp", "n", F.lit(total).alias("total"), F.col("best.doc_id").alias("class_id"), F.col("best.row_key").alias("keep"))
    return texts.select("doc_id", "row_key", "fp"), stored(of_text, "classes")


def stage(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that of the smallest id (of rows without one, any one), with its own columns."""
    texts, of_text = _classed(docs, similarity, id_col, text_col)
    kept = stored(of_text.select(F.col("keep").alias("row_key")).distinct().join(texts.select("row_key"), "row_key").groupBy("row_key").agg(F.count("*").alias("n")), "kept")
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)], F.xxhash64(id_col, text_col).alias("key"))
    columns = [f"c{k}" for k in range(len(docs.columns))]
    n_repeated = kept.filter("n > 1").count()
    one = own.join(kept.filter("n = 1").select(F.col("row_key").alias("key")), "key", "left_semi").select(*columns)
    if n_repeated:
        again = own.join(small(kept.filter("n > 1").select(F.col("row_key").alias("key")), n_repeated), "key", "left_semi")
        one = one.union(again.dropDuplicates(["key"]).select(*columns))
    return one.toDF(*docs.columns)
