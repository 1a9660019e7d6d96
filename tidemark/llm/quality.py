"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's features are its byte pairs, log-weighted. A bounded sample of labelled rows (`SAMPLE`, by hash of the id) gives
inverse document frequencies and, by singular value decomposition, the latent space. The sample's vectors (at most
SAMPLE x DIMENSIONS floats) are broadcast; every document's cosines with all of them are computed exactly, in blocks, and
its `NEIGHBOURS` nearest vote with their labels, weighted by similarity.

Defined results: null counts as empty; an empty text, near to nothing, scores the sample's share of label 1. Without
labelled rows every score is 0.5, and no rows give no scores. Equal texts score alike whatever their ids, so repeated rows do;
neighbours that tie at the last place are taken by their place in the sample, ordered by id. Byte pairs of very long texts
are counted whole. doc_id may be of any type that labels shares; columns of docs beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, FEATURES, DIMENSIONS, NEIGHBOURS, CUT, FOLDS = 4000, 2048, 48, 25, 0.3, 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def counted(text: str | None) -> np.ndarray:
    """How often each of FEATURES classes of byte pairs occurs, digits and letter case kept apart."""
    b = np.frombuffer((text or "").encode(), dtype=np.uint8).astype(np.int64)
    return np.bincount((b[:-1] * 131 + b[1:] * 31) % FEATURES, minlength=FEATURES) if len(b) > 1 else np.zeros(FEATURES, dtype=np.int64)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted, unit-length rows in single precision: one array of their own, no more at a time."""
    x = counts.astype(np.float32)
    x *= 1000 / np.maximum(x.sum(1, keepdims=True), 1)
    np.log1p(x, out=x)
    x *= idf.astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model from at most `sample` labelled rows outside the held-out fold; their byte-pair counts come to the driver, sparse."""
    chosen = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [(c, np.flatnonzero(c)) for c in map(counted, b.column(2).to_pylist())]
            at = pa.array([k.astype(np.uint16).tobytes() for _, k in seen], pa.binary())
            n = pa.array([c[k].astype(np.int32).tobytes() for c, k in seen], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), at, n], names=["doc_id", "quality", "at", "n"])

    kind = dict(docs.dtypes)["doc_id"]

    # One text an id, however often the id stands in either table: the bound holds.
    told = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"), F.min("text").alias("text"))
    rows = told.mapInArrow(counts, f"doc_id {kind}, quality int, at binary, n binary").toPandas().sort_values("doc_id")
    if not len(rows):
        return {"share": 0.5, "vectors": None}
    x = np.zeros((len(rows), FEATURES), dtype=np.int32)
    for row, at, n in zip(x, rows["at"], rows["n"], strict=True):
        row[np.frombuffer(at, dtype=np.uint16)] = np.frombuffer(n, dtype=np.int32)
    idf = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))) + 0.1
    weighted = _weighted(x, idf)
    del x
    _, basis = np.linalg.eigh((weighted.T @ weighted).astype(float))
    basis = np.ascontiguousarray(basis[:, ::-1][:, :DIMENSIONS], dtype=np.float32)
    latent = weighted @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    y = rows["quality"].to_numpy(dtype=np.float32)
    return {"share": float(y.mean()), "vectors": latent.astype(np.float32), "labels": y, "idf": idf, "basis": basis}


def votes(model: dict, texts: list[str | None]) -> np.ndarray:
    """The score of each text."""
    out = np.full(len(texts), model["share"])
    if model["vectors"] is None:
        return out
    k = min(NEIGHBOURS, len(model["vectors"]))
    for at in range(0, len(texts), 256):
        counts = np.stack([counted(t) for t in texts[at : at + 256]])
        q = _weighted(counts, model["idf"]) @ model["basis"]
        q = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        cosine = q @ model["vectors"].T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(float) ** 4
        total = weight.sum(1)
        score = (weight * model["labels"][near]).sum(1) / np.maximum(total, 1e-12)
        known = (counts.sum(1) > 0) & (total > 1e-9)
        out[at : at + 256] = np.where(known, score, model["share"])
    return np.clip(out, 0, 1)


def scored(docs: DataFrame, model: dict, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(votes(sent.value, b.column(2).to_pylist()), pa.float64())], names=["doc_id", "held_out", "score"])

    told = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return told.mapInArrow(score, f"doc_id {dict(told.dtypes)['doc_id']}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= cut).cast("int"))


def stage(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows that are not rejected, with their own columns. Each row is judged by its own text, and nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(votes(sent.value, b.column(at).to_pylist()) >= cut))

    return docs.mapInArrow(kept, docs.schema)
