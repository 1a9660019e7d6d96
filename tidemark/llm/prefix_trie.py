"""A trie of conversations that share first turns.

`numbered` gives every turn its place and a digest of role and text; only these narrow rows are shuffled, never texts. Every
prefix has a chained digest, and one aggregation finds, for each, its least conversation (its owner) and how many have it.
A conversation that owns a prefix owns every longer one of its own, so its first owned depth is found by binary search: each round
probes one depth of every undecided conversation by a join with those minima on (digest, conversation), which only owners
meet, so that no key is hot. From there to its end a conversation owns a chain of nodes; the chains hang on each
other, and their sums travel bottom-up by doubling: after round k a chain has gathered all below it within 2^k chains.

Conversations of any length: places come from ranges of rows, digests and running sums from segments of `SEGMENT` turns whose
totals are chained in turn, so a conversation with a third of all turns is many tasks' work.

Defined results: rows without conv_id belong to no conversation and are left out; null roles and texts are empty; turns are ordered by
turn, null first, ties by digest, and repeated rows are repeated turns. Texts of any length are read once, where they lie. An
empty table has no nodes, not even a root. Other columns of any name are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Turns whose digests lie in one row.
SEGMENT = 256
#: Width of the ranges of ids that are joined to one text before they are hashed.
RANGE = 1024
ROOT = b"\x00"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 0), digest, n_words of every turn. Rows are dealt in ranges of the whole order, so a long conversation lies in many."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    rows = turns.filter(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
        F.pmod(F.monotonically_increasing_id(), F.lit(1024)).alias("salt"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = stored(rows.repartitionByRange("conv_id", *order, "salt").drop("salt").withColumn("part", F.spark_partition_id()), "turns")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1
    return dealt.withColumn("place", place).join(before, ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("before")).alias("pos"), "digest", "n_words")


def rebuilt(own: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations with their n turns) where the first h turns of each conversation are those of conversation c - c % group; h = crc32(c) % most."""
    key = F.col("conv_id")
    lengths = stored(own.groupBy("conv_id").agg(F.count("*").alias("n_own")), "lengths")
    known = lengths.select("conv_id", "n_own", (F.crc32(key.cast("string").cast("binary")) % most).alias("h"), (key - key % group).alias("first_of"))
    there = lengths.select(key.alias("first_of"), F.col("n_own").alias("n_first"))
    convs = known.join(there, "first_of", "left").withColumn("taken", F.least("h", F.coalesce("n_first", F.lit(0))))
    heads = own.filter((F.col("pos") < most - 1) & (key % group == 0)).select(key.alias("first_of"), "pos", "digest", "n_words")
    lent = heads.join(convs.select("conv_id", "first_of", "taken"), "first_of").filter(F.col("pos") < F.col("taken"))
    rest = own.join(convs.select("conv_id", "h", "taken"), "conv_id").filter(F.col("pos") >= F.col("h")).withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    cols = ["conv_id", "pos", "digest", "n_words"]
    return lent.select(cols).unionByName(rest.select(cols)), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n"))


def prefixes(turns: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, int]:
    """(conv_id, seg, digests of every prefix that ends in the segment, n_words, digest of the prefix before it; the last segment's number)."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "digest", "n_words")))
    grouped = turns.groupBy("conv_id", F.floor(F.col("pos") / segment).alias("seg")).agg(rows.alias("rows"))
    start = F.struct(F.lit(b"").alias("last"), F.array().cast("array<binary>").alias("all"))

    def link(state, row):
        now = F.unhex(F.sha2(F.concat(state["last"], row["digest"]), 256))
        return F.transform(F.array(now), lambda d: F.struct(d.alias("last"), F.array_append(state["all"], d).alias("all")))[0]

    inner = stored(grouped.select("conv_id", "seg", F.aggregate("rows", start, link, lambda s: s["all"]).alias("digests"), F.col("rows.n_words").alias("n_words")), "segments")
    last = inner.agg(F.max("seg")).first()[0] or 0
    if not last:
        return inner.withColumn("before", F.lit(None).cast("binary")), 0
    full = inner.filter(F.size("digests") == segment)
    outer, _ = prefixes(full.select("conv_id", F.col("seg").alias("pos"), F.element_at("digests", -1).alias("digest"), F.lit(0).alias("n_words")), segment)
    chain = outer.select("conv_id", F.posexplode("digests").alias("at", "carried"), "seg").select("conv_id", (F.col("seg") * segment + F.col("at") + 1).alias("seg"), "carried")
    both = F.transform("digests", lambda d: F.unhex(F.sha2(F.concat(F.col("carried"), d), 256)))
    whole = inner.join(chain, ["conv_id", "seg"], "left").withColumn("digests", F.when(F.col("carried").isNull(), F.col("digests")).otherwise(both)).drop("carried")
    ends = whole.filter(F.size("digests") == segment).select("conv_id", (F.col("seg") + 1).alias("seg"), F.element_at("digests", -1).alias("before"))
    return stored(whole.join(ends, ["conv_id", "seg"], "left"), "prefixes"), last


def _owned(probes: DataFrame, minima: DataFrame, how: str) -> DataFrame:
    """probes (conv_id, probe, ...) that meet a prefix they own: equal digest and equal conversation."""
    own = minima.select(F.col("digest").alias("probe"), F.col("first").alias("conv_id"), F.lit(True).alias("own"))
    return probes.join(own, ["probe", "conv_id"], how)


def first_owned(segments: DataFrame, last: int, minima: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, first (the least depth that it owns), before (the digest one turn shorter; null at depth 1) of conversations that own a node."""
    ends = _owned(segments.withColumn("probe", F.element_at("digests", -1)), minima, "inner").drop("probe", "own")
    if last:
        ends = ends.join(ends.groupBy("conv_id").agg(F.min("seg").alias("seg")), ["conv_id", "seg"])
    cols = ["conv_id", "seg", "digests", "before", "low", "high"]
    open_ = stored(ends.select("conv_id", "seg", "digests", "before", F.lit(0).alias("low"), (F.size("digests") - 1).alias("high")), "search")
    longest = open_.agg(F.max("high")).first()[0] or 0
    done = []
    for _ in range(int(longest).bit_length()):
        done.append(open_.filter("low = high"))
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        probes = open_.filter("low < high").withColumn("middle", middle).withColumn("probe", F.get("digests", F.col("middle")))
        met = _owned(probes, minima, "left")
        owns = F.col("own").isNotNull()
        open_ = stored(met.withColumn("high", F.when(owns, F.col("middle")).otherwise(F.col("high"))).withColumn("low", F.when(owns, F.col("low")).otherwise(F.col("middle") + 1)).select(cols), "search")
    for d in done:
        open_ = open_.unionByName(d)
    shorter = F.when(F.col("low") == 0, F.col("before")).otherwise(F.get("digests", F.col("low") - 1))
    return open_.select("conv_id", (F.col("seg") * segment + F.col("low") + 1).alias("first"), shorter.alias("before"))


def gathered(chains: DataFrame) -> DataFrame:
    """chains (conv_id, up, saved, leaves), each sum over the chain and all chains below it; log2(height) rounds."""
    while not chains.filter("up is not null").isEmpty():
        given = chains.filter("up is not null").groupBy("up").agg(F.sum("saved").alias("more"), F.sum("leaves").alias("ends")).withColumnRenamed("up", "conv_id")
        above = chains.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        moved = chains.filter("up is not null").join(above, "up").select("conv_id", F.col("next").alias("up"), "saved", "leaves")
        every = moved.unionByName(chains.filter("up is null")).join(given, "conv_id", "left")
        add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
        chains = stored(every.select("conv_id", "up", add("saved", "more").alias("saved"), add("leaves", "ends").alias("leaves")), "chains")
    return chains.drop("up")


def _hashes(ends: DataFrame) -> DataFrame:
    """digest, ends_sha256 of rows (digest, conv_id): ids meet in ranges first; a digest's ranges are hashed in order, one at a time."""
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    ranges = ends.groupBy("digest", F.floor(F.col("conv_id") / RANGE).alias("range")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out: list[tuple[bytes, str]] = []
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state = digest, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], names=["digest", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["digest", "ends_sha256"])

    return ranges.repartition("digest").sortWithinPartitions("digest", "range").select("digest", "ids").mapInArrow(run, "digest binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The nodes (NODES) of turns (conv_id, pos, digest, n_words) and all their conversations (conv_id, n), which may have no turn."""
    spark = turns.sparkSession
    convs = stored(convs, "conversations")
    least, every = convs.agg(F.min("conv_id"), F.count("*")).first()
    if not every:
        return spark.createDataFrame([], NODES)
    segments, last = prefixes(turns, segment)
    # Digests of all prefixes, with the words of the last turn.
    each = segments.select("conv_id", "seg", F.posexplode(F.arrays_zip("digests", "n_words")).alias("at", "x")).select("conv_id", (F.col("seg") * segment + F.col("at") + 1).alias("depth"), F.col("x.digests").alias("digest"), F.col("x.n_words").alias("n_words"))
    minima = stored(each.groupBy("digest").agg(F.min("conv_id").alias("first"), F.count("*").alias("n_convs")), "minima")

    found = first_owned(segments, last, minima, segment).filter(F.col("conv_id") != least)
    owners = minima.select(F.col("digest").alias("before"), F.col("first").alias("up"))
    hung = found.filter("before is not null").join(owners, "before").select("conv_id", "first", "up").unionByName(found.filter("before is null").select("conv_id", "first", F.lit(least).cast("long").alias("up")))
    top = convs.filter(F.col("conv_id") == least).select("conv_id", F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("up"))
    chains = stored(hung.unionByName(top).join(convs, "conv_id"), "hung")

    shared = minima.select("digest", F.col("first").alias("conv_id"), "n_convs")
    deep = each.join(chains.select("conv_id", "first", "up"), "conv_id").filter(F.col("depth") >= F.col("first")).join(shared, ["digest", "conv_id"])
    root = spark.createDataFrame([(least, 0, bytearray(ROOT), 0, 0, None, every)], "conv_id long, depth long, digest binary, n_words long, first long, up long, n_convs long")
    nodes = stored(deep.select(root.columns).unionByName(root).withColumn("own", F.col("n_words") * (F.col("n_convs") - 1)), "nodes")

    forks = chains.filter("up is not null").select(F.col("up").alias("conv_id"), (F.col("first") - 1).alias("depth"), F.col("conv_id").alias("branch"))
    at_end = forks.groupBy("conv_id", F.col("depth").alias("n")).agg(F.lit(0).alias("no_leaf"))
    weights = chains.join(nodes.groupBy("conv_id").agg(F.sum("own").alias("saved")), "conv_id").join(at_end, ["conv_id", "n"], "left").select("conv_id", "up", "saved", F.coalesce("no_leaf", F.lit(1)).cast("long").alias("leaves"))
    sums = gathered(stored(weights, "chains"))

    branches = forks.join(sums.select(F.col("conv_id").alias("branch"), "saved", "leaves"), "branch").groupBy("conv_id", "depth").agg(F.count("*").alias("n_branches"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    joined = nodes.join(branches, ["conv_id", "depth"], "left").fillna(0, ["n_branches", "saved", "leaves"]).join(chains.select("conv_id", "n"), "conv_id")
    ended = (F.col("depth") == F.col("n")) & (F.col("n_branches") == 0)
    own = joined.withColumn("saved", F.col("saved") + F.col("own")).withColumn("leaves", F.col("leaves") + F.when(ended, 1).otherwise(0)).withColumn("seg", F.floor(F.col("depth") / segment))
    below = Window.partitionBy("conv_id", "seg").orderBy(F.col("depth").desc())
    own = own.withColumn("saved", F.sum("saved").over(below)).withColumn("leaves", F.sum("leaves").over(below))
    if last:
        further = Window.partitionBy("conv_id").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
        # A segment's least depth has its whole sum.
        carried = own.groupBy("conv_id", "seg").agg(F.max("saved").alias("s"), F.max("leaves").alias("l")).select("conv_id", "seg", F.coalesce(F.sum("s").over(further), F.lit(0)).alias("s"), F.coalesce(F.sum("l").over(further), F.lit(0)).alias("l"))
        own = own.join(carried, ["conv_id", "seg"]).withColumn("saved", F.col("saved") + F.col("s")).withColumn("leaves", F.col("leaves") + F.col("l"))

    tails = segments.join(convs, "conv_id").filter(F.col("seg") == F.floor((F.col("n") - 1) / segment)).select(F.element_at("digests", -1).alias("digest"), "conv_id")
    hashes = _hashes(tails.unionByName(convs.filter("n = 0").select(F.lit(bytearray(ROOT)).alias("digest"), "conv_id")))
    parent = F.when(F.col("depth") == F.col("first"), F.col("up")).otherwise(F.col("conv_id"))
    return own.join(hashes, "digest", "left").select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", (F.col("n_branches") + F.when(F.col("depth") < F.col("n"), 1).otherwise(0)).alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
