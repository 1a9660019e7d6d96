"""Benchmark decontamination by a distributed positional inverted index.

The index holds one posting (term, text, pos) per occurrence of an indexed term. Each window of a benchmark item is
looked up from its rarest terms: their postings, moved back by the term's offset in the item, must meet on one start
(the "diagonal") of one text. Starts on which the lists meet are then compared word by word with the text: exact phrase
matches. Where two rare terms of an item miss a common start by at most `NEAR` words, the item is a proximity match.

Defined results. Null or empty text: no words, no hit, not contaminated. Items without words never occur. An item_id that
appears twice counts once; a null item_id counts as ''. Documents that share a doc_id, or have none, are judged row by row:
postings are kept by a hash of the whole text, and the words are compared row by row. Very long texts are compared whole.
Only the named columns are read, whatever else docs has; clean() returns all columns of docs as they are. Tables without
rows give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, own_columns, small, stored, words

WINDOW, SHARE = 13, 20
#: Words by which two rare terms may miss a common start in a proximity match.
NEAR = 4
#: Rarest terms of a window whose posting lists are intersected.
RAREST = 2


def tokens(texts: DataFrame) -> DataFrame:
    """(key, pos, term): every word of every text of (key, text), pos from 0."""
    return texts.select("key", F.posexplode(words(F.col("text"))).alias("pos", "term"))


def build_index(texts: DataFrame, vocabulary: DataFrame | None = None, n_terms: int = 1 << 62) -> DataFrame:
    """The positional inverted index of (key, text), stored: (term, key, pos). vocabulary (term): index these terms only."""
    postings = tokens(texts)
    if vocabulary is not None:
        postings = postings.join(small(vocabulary.select("term"), n_terms), "term")
    return stored(postings.select("term", "key", "pos"), "postings")


def phrase_matches(index: DataFrame, phrase: list[str]) -> DataFrame:
    """(key, start) of the exact phrase, from a full index: offset-adjusted lists that meet in every term. An empty phrase is nowhere."""
    wanted = index.sparkSession.createDataFrame([(t, i) for i, t in enumerate(phrase)], "term string, shift int")
    met = index.join(F.broadcast(wanted), "term").groupBy("key", (F.col("pos") - F.col("shift")).alias("start"))
    return met.agg(F.count_distinct("shift").alias("n")).filter(F.col("n") == len(phrase)).select("key", "start")


def proximity_matches(index: DataFrame, first: str, second: str, within: int) -> DataFrame:
    """(key, pos_a, pos_b) where two terms stand at most `within` words apart. Postings meet in blocks of that many positions, so no text's lists are multiplied out."""
    a = index.filter(F.col("term") == first).select("key", F.col("pos").alias("pos_a"), F.expr(f"explode(transform(array(-1, 0, 1), k -> k + pos div {within + 1}))").alias("block"))
    b = index.filter(F.col("term") == second).select("key", F.col("pos").alias("pos_b"), F.expr(f"pos div {within + 1}").cast("bigint").alias("block"))
    return a.join(b, ["key", "block"]).filter((F.abs(F.col("pos_a") - F.col("pos_b")) <= within) & (F.col("pos_a") != F.col("pos_b"))).select("key", "pos_a", "pos_b")


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return (
        benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), words(F.col(text_col)).alias("item_words"))
        .filter(F.size("item_words") > 0)
        .distinct()
        .withColumn("item_key", F.xxhash64("item_id", F.concat_ws(" ", "item_words")))
    )


def _seeds(items: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """(term, item_key, shift, need): for each window its rarest terms; need: lists that must meet on a start."""
    spread = items.select("item_key", F.posexplode("item_words").alias("shift", "term")).join(frequency, "term", "left")
    ranked = spread.groupBy("item_key").agg(F.array_sort(F.collect_list(F.struct("shift", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("at"))

    def rarest(start: Column) -> Column:
        part = F.slice("at", start + 1, F.least(F.size("at"), F.lit(window)))
        ordered = F.array_sort(F.transform(part, lambda x: F.struct(x["n"].alias("n"), x["shift"].alias("shift"), x["term"].alias("term"))))
        return F.slice(ordered, 1, RAREST)

    chosen = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size("at") - window, F.lit(0))), rarest))
    return ranked.select("item_key", F.least(F.size("at"), F.lit(RAREST)).alias("need"), F.explode(F.array_distinct(chosen)).alias("s")).select("s.term", "item_key", "s.shift", "need")


#: item_id and words of an item, the starts at which its rare terms meet, and whether some nearly do.
CANDIDATES = "array<struct<item_id:string,item_words:array<string>,starts:array<int>,near:boolean>>"


def _candidates(texts: DataFrame, items: DataFrame, n_terms: int, window: int) -> DataFrame:
    """(key, candidates) of the texts in which rare terms of an item meet, or nearly do. An item's words stand there once, however many starts it has."""
    vocabulary = items.select(F.explode("item_words").alias("term")).distinct()
    frequency = tokens(texts).select("term").join(small(vocabulary, n_terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    seeds = stored(_seeds(items, frequency, window), "seeds")
    index = build_index(texts, seeds.select("term").distinct(), n_terms)
    at = F.sort_array(F.collect_set(F.struct((F.col("pos") - F.col("shift")).alias("start"), "shift")))
    met = index.join(small(seeds, n_terms * RAREST), "term").groupBy("key", "item_key").agg(at.alias("at"), F.first("need").alias("need"))
    after = lambda i, field: F.get("at", i + 1)[field]
    same = F.filter("at", lambda x, i: (F.col("need") < RAREST) | F.coalesce(after(i, "start") == x["start"], F.lit(False)))
    near = F.exists(F.filter("at", lambda x, i: F.coalesce((after(i, "start") - x["start"]).between(1, NEAR) & (after(i, "shift") != x["shift"]), F.lit(False))), lambda x: x.isNotNull())
    found = met.select("key", "item_key", F.array_distinct(F.transform(same, lambda x: x["start"])).alias("starts"), near.alias("near")).filter(F.col("near") | (F.size("starts") > 0))
    return found.join(small(items, n_terms), "item_key").groupBy("key").agg(F.collect_list(F.struct("item_id", "item_words", "starts", "near")).cast(CANDIDATES).alias("candidates"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items (sorted ids), hit_spans (word start and end), n_near (items with a proximity match), contaminated.

    contaminated: n_hit > 0 and share * n_hit >= n_words.
    """
    return _scanned(docs, benchmark, window, share, id_col, text_col, item_col, item_text_col).drop("row", "text")


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, share: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    docs = docs.select(own_columns(docs, text_col), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    items = stored(_items(benchmark, item_col, item_text_col), "items")
    n_items, n_terms = items.agg(F.count("*"), F.coalesce(F.sum(F.size("item_words")), F.lit(0))).first()
    if not n_items:
        return _verified(docs.withColumn("candidates", F.expr(f"cast(array() as {CANDIDATES})")), window, share)
    return _verified(docs.join(_candidates(docs.select("key", "text"), items, n_terms, window), "key", "left"), window, share)


def _verified(found: DataFrame, window: int, share: int) -> DataFrame:
    """Compares each candidate with the words of its text and sums up the windows that truly occur."""

    def occurring(text: Column, item: Column, start: Column) -> Column:
        n = F.size(item)
        length = F.least(n, F.lit(window))
        same = F.transform(item, lambda w, i: F.coalesce(F.get(text, start + i) == w, F.lit(False)))
        return let(same, lambda m: F.filter(F.sequence(F.lit(0), n - length), lambda s: F.forall(F.slice(m, s + 1, length), lambda x: x)))

    candidates = F.coalesce("candidates", F.expr(f"cast(array() as {CANDIDATES})"))
    of_item = lambda text, c: F.struct(c["item_id"].alias("item_id"), F.flatten(F.transform(c["starts"], lambda at: F.transform(occurring(text, c["item_words"], at), lambda s: s + at))).alias("starts"), F.least(F.size(c["item_words"]), F.lit(window)).alias("length"))
    hits = lambda text: F.filter(F.transform(candidates, lambda c: of_item(text, c)), lambda h: F.size(h["starts"]) > 0)
    spans = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(h["starts"], lambda s: F.struct(s.alias("start"), (s + h["length"]).alias("end")))))))
    covered = F.aggregate(
        "hit_spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end")),
    )["n"]
    own = ["row", "doc_id", "text"]
    near = F.size(F.array_distinct(F.transform(F.filter(candidates, lambda c: c["near"]), lambda c: c["item_id"]))).cast("long").alias("n_near")
    return (
        found.select(*own, near, let(words(F.col("text")), lambda text: F.struct(F.size(text).cast("long").alias("n_words"), hits(text).alias("hits"))).alias("of"))
        .select(*own, "n_near", "of.n_words", "of.hits")
        .select(*own, "n_near", "n_words", F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"]))).alias("items"), spans.alias("hit_spans"))
        .select(*own, "n_words", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hit_spans", "n_near")
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    )


def digest(scanned: DataFrame) -> DataFrame:
    """The report's columns: the items as one sha-256."""
    return scanned.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows that are not contaminated, with their own columns; each row is judged by itself."""
    kept = _scanned(docs, benchmark, window, share, id_col, text_col, item_col, item_text_col).filter(~F.col("contaminated"))
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)])
