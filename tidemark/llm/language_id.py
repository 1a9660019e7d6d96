"""Language identification by Bayesian evidence fusion.

For each row, the logarithm of a language's posterior is the sum of: the text's likelihood under byte-pair counts of that
language, scaled to `TEXT_WEIGHT` so that dependent pairs don't count as independent; the likelihood of the language that
the markup declares; that of the address suffix; and the prior of the row's host. Host priors are shares by text alone,
smoothed towards those of the host's domain, those towards the suffix's, and those towards all rows' - each a grouped
aggregation over all rows. Declared and suffix likelihoods are measured the same way, by grouped counts.

The byte-pair model is fitted on a bounded sample (`SAMPLE` documents a language, by hash of the id). Documents have no
markup or address: their source is their host. Defined results: null or empty text leaves the decision to the other
evidence, at worst to the overall prior; a null host has the overall prior; without labelled rows lang is null; of languages
that tie the first by name wins; repeated rows are judged row by row, each a part of its host's prior; no rows give none. Very
long texts are counted whole. Id columns must not bear the names of the other columns (text,
declared, suffix, domain, host) or of those that are made on the way (such as p, w, q1, d, meets, n_host): Spark then reports a name that exists already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, stored

SAMPLE, FEATURES, TEXT_WEIGHT, SMOOTHING = 500, 4096, 20.0, 5.0
#: Rows a language, in multiples of the sample, among which the sample is sought.
MARGIN = 4
#: Keys over which rows without one are dealt.
NONE_KEYS = 4096


def counted(text: str | None) -> np.ndarray:
    b = np.frombuffer((text or "").lower().encode(), dtype=np.uint8).astype(np.int64)
    return np.bincount((b[:-1] * 257 + b[1:] * 7) % FEATURES, minlength=FEATURES) if len(b) > 1 else np.zeros(FEATURES, dtype=np.int64)


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their smoothed log-probabilities of byte pairs."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    sizes = stored(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    # The least hashes lie below this share of all hashes, but for a chance of nearly none; so few rows meet in a language's task.
    share = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    few = labelled.join(small(sizes, sizes.count()), "lang").filter(share <= MARGIN * sample / F.col("n")).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    place = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = stored(few.withColumn("k", F.row_number().over(place)).filter(F.col("k") <= sample).select("doc_id", "lang"), "sample")
    n_ids = ids.count()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[lang] = total.get(lang, 0) + counted(t)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.astype(np.int64).tobytes() for v in total.values()], pa.binary())], names=["lang", "x"])

    # One text an id, however often the id stands in docs; texts outside the sample are not shuffled.
    texts = docs.select("doc_id", "text").join(small(ids, n_ids), "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = texts.select("lang", "text").mapInArrow(counts, "lang string, x binary").collect()
    langs = sorted({r.lang for r in rows})
    x = np.array([sum(np.frombuffer(r.x, dtype=np.int64) for r in rows if r.lang == k) for k in langs], dtype=float).reshape(len(langs), FEATURES) + 0.5
    return langs, np.log(x / x.sum(1, keepdims=True))


def visible(html: Column) -> Column:
    """The text of a page: scripts, styles, comments and tags out."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>|&\w+;", " ")


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """rows (id columns, text, declared, suffix, domain, host): the ids with lang and probability."""
    langs, table = model
    ids = [c for c in rows.columns if c not in ("text", "declared", "suffix", "domain", "host")]
    if not langs:
        return rows.select(*ids, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    sent = rows.sparkSession.sparkContext.broadcast(table)
    kept = [*ids, "declared", "suffix", "domain", "host"]
    kinds = dict(rows.dtypes)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(len(kept)).to_pylist():
                c = counted(t)
                at = sent.value @ c * (min(TEXT_WEIGHT, c.sum()) / max(c.sum(), 1))
                p = np.exp(at - at.max())
                out.append((p / p.sum()).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(out, pa.list_(pa.float64()))], names=[*kept, "p"])

    told = stored(rows.select(*kept, "text").mapInArrow(likelihood, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", p array<double>"), "likelihoods")
    n = len(langs)
    sums = lambda key: told.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(f"n_{key}"), F.array(*[F.sum(F.get("p", i)) for i in range(n)]).alias(f"s_{key}"))
    overall = told.agg(F.count("*"), *[F.coalesce(F.sum(F.get("p", i)), F.lit(0.0)) for i in range(n)]).first()
    base = F.array(*[F.lit((overall[i + 1] + 1) / (overall[0] + n)) for i in range(n)])
    met = told
    # Rows without a key are dealt over many keys that no group has: they meet nothing, and are no hot key.
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*ids), F.lit(NONE_KEYS)).cast("string"))
    for key in ("suffix", "domain", "host", "declared"):
        met = met.withColumn("meets", F.coalesce(F.col(key), spread)).join(sums(key).withColumnRenamed(key, "meets"), "meets", "left").drop("meets")
    smooth = lambda key, prior: F.when(F.col(f"n_{key}").isNull(), prior).otherwise(F.zip_with(f"s_{key}", prior, lambda s, q: (s + SMOOTHING * q) / (F.col(f"n_{key}") + SMOOTHING)))
    at = met.withColumn("q1", smooth("suffix", base)).withColumn("q2", smooth("domain", F.col("q1"))).withColumn("q3", smooth("host", F.col("q2"))).withColumn("d", smooth("declared", base))
    # The declared language's likelihood is its posterior share over the overall prior.
    fused = at.withColumn("w", F.transform("p", lambda p, i: p * F.get("q3", i) * F.get("d", i) / F.get(base, i)))
    whole = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    best = fused.withColumn("probability", F.array_max("w") / whole).withColumn("lang", F.get(F.array(*map(F.lit, langs)), (F.array_position("w", F.array_max("w")) - 1).cast("int")))
    return best.select(*ids, "lang", "probability")


def evidence(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents and pages as one table of evidence: kind, doc_id, page_id, text, declared, suffix, domain, host."""
    none = F.lit(None).cast("string")
    of_docs = docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("page_id"), "text", none.alias("declared"), none.alias("suffix"), none.alias("domain"), F.concat(F.lit("source:"), F.col("source")).alias("host"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://([^/:?#]+)", 1))
    of_pages = pages.select(
        F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long"), visible(F.col("html")).alias("text"),
        F.nullif(F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?i)<html[^>]*\blang=["']?([a-z]{2,3})""", 1)), F.lit("")).alias("declared"),
        F.nullif(F.substring_index(host, ".", -1), F.lit("")).alias("suffix"), F.nullif(F.substring_index(host, ".", -3), F.lit("")).alias("domain"), F.nullif(host, F.lit("")).alias("host"),
    )
    return of_docs.unionByName(of_pages)
