"""Line dedup by chunks of lines that overlap.

A text is cut in lines: after a line break, after a sentence end, and after a clause mark; but only where no other mark of
the kind stands in the 16 (clauses: 40) characters before, so that a line is no mere word. Lines keep their breaks. Cuts depend on the few characters before them alone, so a passage is cut alike wherever it stands. A rolling
hash over `WINDOW` line hashes (of lines without their breaks) gives each chunk's key. A chunk that occurred before
anywhere in the corpus (smaller doc_id, then place) is removed with all its lines, after its bytes were compared with those of
all other chunks of its key. Each removal points to an earlier place, so one copy of a line stays.

Departure from the method: rolling hashes choose no boundaries; a chunk begins at every line. With boundaries at a share of the
lines, a passage is found only if both ends of a chunk fall inside it, which loses most passages of 50 to 100 words.

Defined results. Null text stays null and empty text empty; a text of one line stays. Documents with a null doc_id are left as
they are. Rows that share a doc_id are one place in the order: what first occurs under that id stays in all of them. Repeated
rows are treated alike. A repeat of a single line is never removed; of a repeat that begins or ends inside a line that part
stays. Very long texts are cut like others. n_chunks_removed counts the lines that went. Columns of docs may have any names; a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, release, small, stored

#: Lines of a chunk.
WINDOW = 2
#: What ends a line; a break is a line break or blank of which these hold. Both patterns name the same breaks.
#: The short look-behinds come first: most blanks follow a letter and need no long one.
_MARKED = r"(?:(?<=\n)(?<=[^\n]{15}[^\n\x20]\n)|(?<=[.!?]\x20)(?<=[^.!?\n]{16}[.!?]\x20)|(?<=[,;:]\x20)(?<=[^.!?,;:\n]{40}[,;:]\x20))"
BREAK, AFTER_BREAK = r"[\n\x20]" + _MARKED, r"(?<=[\n\x20])" + _MARKED


def bare(text: Column) -> Column:
    """The lines without their breaks: array<string>. What follows a last break is a line only if there is something."""
    return let(F.split(text, BREAK), lambda p: F.slice(p, F.lit(1), F.size(p) - F.when(F.element_at(p, -1) == "", 1).otherwise(0)))


def keys_of(pieces: Column) -> Column:
    """The rolling hash of every chunk, by its first line, from the hashes of its lines."""
    none = F.expr("cast(array() as array<bigint>)")
    pair = lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - 1), F.slice(h, F.lit(2), F.size(h) - 1), lambda x, y: F.xxhash64(x, y))
    return F.when(F.size(pieces) >= WINDOW, let(F.transform(pieces, lambda y: F.xxhash64(y)), pair)).otherwise(none)


def repeats(keyed: DataFrame) -> DataFrame:
    """(rid, marks): of each row of keyed (rid, doc_id, keys) with a repeated key, array<struct<key, place, first>>, sorted.

    Only ids and hashes are read and shuffled, no texts. `first`: the least doc_id that holds the key.
    """
    every = keyed.select("rid", "doc_id", F.posexplode("keys").alias("place", "key"))
    again = stored(every.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1").select("key", "first"), "repeated")
    return every.drop("doc_id").join(again, "key").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("key", "place", "first"))).alias("marks"))


def unequal(met: DataFrame) -> DataFrame:
    """(doc_id, text_key, place): marked chunks whose bytes are not the least of their key, though their hashes agree; from (doc_id, text_key, pieces, marks).

    All bytes of a key are compared by their least and greatest, which combine before the shuffle; a key where these differ
    is settled chunk by chunk.
    """
    shown = let(F.struct("pieces", "marks"), lambda r: F.transform(r["marks"], lambda m: F.struct(m["place"].alias("place"), m["key"].alias("key"), F.concat_ws("\n", F.get(r["pieces"], m["place"]), F.get(r["pieces"], m["place"] + 1)).alias("chunk"))))
    marked = met.filter(F.col("marks").isNotNull()).select("doc_id", "text_key", F.explode(shown).alias("m")).select("doc_id", "text_key", "m.*")
    unsafe = stored(marked.groupBy("key").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most")).filter("least <> most").select("key", "least"), "unsafe")
    return stored(marked.join(small(unsafe, unsafe.count()), "key").filter("chunk <> least").select("doc_id", "text_key", "place").distinct(), "unequal")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines of repeated chunks taken out of text_col, and two columns more: n_chunks_removed, n_chars_removed (long).

    All other columns of docs keep names, values and order. Texts are shuffled once, to meet their marks.
    """
    # Rows without an id meet nothing; their key is spread, so that they are no hot key.
    key = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(text_col))
    own = F.struct(*[F.col(c) for c in docs.columns if c != text_col])
    told = docs.select(own.alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), key.alias("text_key"))
    of_text = let(bare(F.coalesce("text", F.lit(""))), keys_of)
    keyed = stored(told.filter(F.col("doc_id").isNotNull()).select("doc_id", "text_key", of_text.alias("keys")).filter(F.size("keys") > 0).withColumn("rid", F.monotonically_increasing_id()), "keys")
    # Repeated rows have one place, and marks once. Keys and their shuffles are gone before texts are shuffled.
    marks = stored(keyed.select("rid", F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key")).join(repeats(keyed), "rid").dropDuplicates(["m_id", "m_key"]).drop("rid"), "marks")
    release(keyed)
    met = stored(told.join(marks, (F.col("doc_id") == F.col("m_id")) & (F.col("text_key") == F.col("m_key")), "left").select("row", "doc_id", "text_key", "text", "marks"), "met")
    release(marks)
    wrong = unequal(met.withColumn("pieces", F.when(F.col("marks").isNotNull(), bare(F.col("text")))))
    n_wrong = wrong.count()
    cut = met.withColumn("pieces", F.when(F.col("marks").isNotNull(), F.split("text", AFTER_BREAK)))
    # Marks are sorted by key, then place: of the chunks that a document holds first, the first place of each key stays.
    earlier = lambda m, i: (i > 0) & F.coalesce((F.get("marks", i - 1)["key"] == m["key"]) & (F.get("marks", i - 1)["place"] < m["place"]), F.lit(False))
    at = F.transform(F.filter("marks", lambda m, i: (m["first"] != F.col("doc_id")) | earlier(m, i)), lambda m: m["place"])
    if n_wrong:
        wrong = wrong.groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("wrong"))
        cut = cut.join(small(wrong, n_wrong), ["doc_id", "text_key"], "left")
        at = F.array_except(at, F.coalesce("wrong", F.expr("cast(array() as array<int>)")))
    gone = F.array_distinct(F.flatten(F.transform(at, lambda k: F.sequence(k, k + WINDOW - 1))))
    cut = cut.withColumn("gone", F.coalesce(gone, F.expr("cast(array() as array<int>)")))
    some = F.size("gone") > 0
    left = F.when(some, let(F.struct("pieces", "gone"), lambda r: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(r["pieces"]) - 1), r["gone"]), lambda i: F.get(r["pieces"], i)), ""))).otherwise(F.col("text"))
    # In steps, or names of docs like those used here would be taken for them inside the lambdas.
    cut = cut.select("row", "text", left.alias("left"), F.size("gone").cast("long").alias("n")).withColumn("some", F.col("n") > 0).select("row", "left", "n", F.when(F.col("some"), F.char_length("text") - F.char_length("left")).otherwise(0).cast("long").alias("lost"))
    kept = [F.col("left").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return cut.select(*kept, F.col("n").alias("n_chunks_removed"), F.col("lost").alias("n_chars_removed"))


def stage(docs: DataFrame) -> DataFrame:
    """The documents without their repeated chunks, with their own columns; a text of which nothing is left goes."""
    cut = dedup(docs)
    names = [f"c{k}" for k in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    kept = cut.toDF(*names, "n_gone", "n_lost").filter((F.col("n_gone") == 0) | (F.trim(F.coalesce(text, F.lit(""))) != ""))
    return kept.select(*names).toDF(*docs.columns)
