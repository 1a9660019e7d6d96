"""Best-fit packing with conflicts.

Documents are cut in pieces of at most `capacity` words (a separator after each piece counts as one), dealt by a hash over
shards, and packed shard by shard in falling size. Open bins are ordered by what is left in them; the search starts at the
smallest remainder that fits and goes on to the next until a bin is compatible: its source bitmap and its duplicate-cluster
bitmap must not hold the piece's bits. So no bin holds two pieces of one source, or two copies of one text.

The number of shards is that of all pieces over `SHARD`, so a shard has about `SHARD` pieces whatever source, group or text is
large; the tightest compatible bin is sought within a shard. Pieces are dealt by a hash of their row's place, so repeated
rows are spread too.

Defined results: words are separated by white space; a null, empty or blank text is one piece of no words; a null source, or a text
without words, conflicts with nothing; repeated rows are packed row by row; a text longer than a bin is cut in pieces, which
conflict with each other by their source; pieces of equal size are packed by id, then place; no rows give no bins. Only the named columns are
read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

CAPACITY, SHARD = 2048, 4096


def best_fit(sizes: list[int], sources: list[int | None], clusters: list[int | None], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; items in the order given."""
    source_bit: dict = {}
    cluster_bit: dict = {}
    bit = lambda seen, x: 0 if x is None else 1 << seen.setdefault(x, len(seen))
    by_left: list[tuple[int, int]] = []  # (remainder, bin), ascending
    held: list[list[int]] = []  # per bin: source bitmap, cluster bitmap, words used
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = bit(source_bit, source), bit(cluster_bit, cluster)
        k = bisect_left(by_left, (size, -1))
        while k < len(by_left) and (held[by_left[k][1]][0] & s or held[by_left[k][1]][1] & c):
            k += 1
        if k < len(by_left):
            left, b = by_left.pop(k)
        else:
            left, b = capacity, len(held)
            held.append([0, 0, 0])
        own = held[b]
        out.append((b, own[2]))
        own[0] |= s
        own[1] |= c
        own[2] += size
        if left > size:
            insort(by_left, (left - size, b))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, with_text: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, first_word, n_words, bin_shard, bin, bin_offset; with_text: and text, the piece itself.

    cluster_col names what makes duplicates, such as a near-duplicate class; without it, texts that are equal are.
    The pieces' texts of a document, one after the other, are its text from the first word on.
    """
    room = capacity - 1
    # A token is a word with the white space after it.
    tokens = F.filter(F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"^\s+", ""), r"(?<=\s)(?=\S)"), lambda x: x != "")
    cluster = F.xxhash64(cluster_col or text_col)
    n_pieces = F.greatest(F.ceil(F.col("n") / room), F.lit(1)).cast("int")
    told = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(source_col).alias("s"), F.col(source_col).isNull().alias("no_s"), cluster.alias("c"), F.col(cluster_col or text_col).isNull().alias("no_c"), tokens.alias("t")).withColumn("n", F.size("t"))
    # The pieces' texts are cut before the rows are multiplied: a long text is not copied for each of its pieces.
    part = F.transform(F.sequence(F.lit(0), n_pieces - 1), lambda p: F.array_join(F.slice("t", p * room + 1, F.lit(room)), "") if with_text else F.lit(None).cast("string"))
    told = stored(told.withColumn("no_c", F.col("no_c") | (F.col("n") == 0)).withColumn("rid", F.monotonically_increasing_id()).withColumn("parts", part).drop("t"), "sizes")
    total = told.agg(F.coalesce(F.sum(n_pieces), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard))
    pieces = told.select("doc_id", "s", "no_s", "c", "no_c", "n", "rid", F.posexplode("parts").alias("piece", "text"))
    pieces = pieces.withColumn("first_word", F.col("piece") * room).withColumn("n_words", F.least(F.col("n") - F.col("first_word"), F.lit(room)))
    dealt = pieces.select("doc_id", "piece", "first_word", "n_words", F.pmod(F.xxhash64("rid", "piece"), F.lit(shards)).cast("int").alias("bin_shard"), "s", "no_s", "c", "no_c", "rid", *(["text"] if with_text else []))
    out = ["doc_id", "piece", "first_word", "n_words", "bin_shard"]

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "doc_id", "piece", "rid"], ascending=[False, True, True, True], kind="stable")
        sources = [None if no else x for x, no in zip(pdf["s"].tolist(), pdf["no_s"].tolist(), strict=True)]
        clusters = [None if no else (x, p) for x, no, p in zip(pdf["c"].tolist(), pdf["no_c"].tolist(), pdf["piece"].tolist(), strict=True)]
        at = best_fit([n + 1 for n in pdf["n_words"].tolist()], sources, clusters, capacity)
        placed = pdf[out].assign(bin=[b for b, _ in at], bin_offset=[o for _, o in at])
        return placed.assign(text=pdf["text"]) if with_text else placed

    kind = dict(told.dtypes)["doc_id"]
    return dealt.groupBy("bin_shard").applyInPandas(packed, f"doc_id {kind}, piece int, first_word int, n_words int, bin_shard int, bin int, bin_offset int" + (", text string" if with_text else ""))
