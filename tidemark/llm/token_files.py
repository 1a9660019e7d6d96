"""Token ids in files of fixed-width bits.

A file set is a folder of two Parquet tables, written by Spark. `blocks`: one row per block of whole documents, with the block's own offset
(`start`, ids of its shard before it), the ids and lengths of its documents, and `packed`: every id in as many bits as
the largest id of the vocabulary needs, the lowest bit first, eight ids to `bits` bytes, so any range of ids is found by arithmetic and
unpacked by numpy. `shards`: one row per shard with its `base`, the ids of all shards before it, and `bits`. Shards are ranges of
the documents in ascending order of their ids, so base + start + the lengths before it in its block is a document's place among all.

Texts are cut at blanks and line feeds where `cuts_at_blanks` finds that the vocabulary allows it (white space is dropped, nothing
reaches over it); a worker remembers the ids of parts, about `REMEMBERED` bytes of those met last, from task to task. New parts of plain letters are encoded
together and told apart by the tokens that end a word, all others one by one. Other vocabularies encode whole texts.

Defined results: null text is empty and has the end id alone. Documents without an id come first. Repeated ids stay, in
the order of their texts' hashes; equal rows are alike, so their order is of no account. Very long texts are rows like any other: a block ends
with the document that fills it. An empty table gives files without rows. Other columns of any name are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, stored

#: Ids after which a block ends, bytes of packed ids a shard is meant to have, bytes of parts that a worker remembers.
BLOCK, SHARD_BYTES, REMEMBERED = 16_384, 16_000_000, 240_000_000
#: Characters of texts that are encoded together, and parts of plain letters that are.
GROUP, TOGETHER = 12_000_000, 10_000
WHOLE = (8, 16, 32)
#: Parts that are one word of the pre-tokenizer, or two with the signs at their end: letters whose lower case is one letter each.
PLAIN = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+([!-&(-/:;=?@\\[-`{}~]{1,8})?")


def width(spec: str, end_id: int) -> int:
    """Bits that the largest id needs."""
    told = json.loads(spec)
    return max(1, max([end_id, *told["model"]["vocab"].values(), *[t["id"] for t in told["added_tokens"]]]).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids (below 2^bits, bits up to 32) as ceil(n / 8) * bits bytes."""
    if bits in WHOLE:  # the layout of little-endian numbers
        return np.append(ids, np.zeros(-len(ids) % 8, int)).astype(f"<u{bits // 8}").tobytes()
    groups = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(groups), bits), np.uint8)
    for k in range(8):
        first, shift = divmod(k * bits, 8)
        moved = groups[:, k] << np.uint64(shift)
        for b in range(first, (k * bits + bits + 7) // 8):
            out[:, b] |= (moved >> np.uint64(8 * (b - first))).astype(np.uint8)
    return out.tobytes()


def unpack(packed: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """n ids from place `first` on, as uint32; only their bytes are read."""
    if bits in WHOLE:
        return np.frombuffer(packed, f"<u{bits // 8}", n, first * bits // 8).astype(np.uint32)
    low, high = first // 8, -(-(first + n) // 8)
    rows = np.frombuffer(packed, np.uint8, (high - low) * bits, low * bits).reshape(-1, bits).astype(np.uint64)
    out = np.zeros((len(rows), 8), np.uint64)
    for k in range(8):
        at, shift = divmod(k * bits, 8)
        for b in range(at, (k * bits + bits + 7) // 8):
            out[:, k] |= rows[:, b] << np.uint64(8 * (b - at))
        out[:, k] >>= np.uint64(shift)
    ids = (out & np.uint64(2**bits - 1)).astype(np.uint32).reshape(-1)
    return ids[first - 8 * low : first - 8 * low + n]


def cuts_at_blanks(spec: str) -> bool:
    """Whether a text's ids are those of its parts between blanks: words without white space, nothing added, nothing that looks over it."""
    told = json.loads(spec)
    steps = lambda x, many: [] if x is None else x[many] if x["type"] == "Sequence" else [x]
    split, model = steps(told.get("pre_tokenizer"), "pretokenizers"), told["model"]
    words = bool(split) and split[0] == {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
    bytes_ = all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in split[1:])
    plain = all(n["type"] in ("NFC", "Lowercase") or n == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for n in steps(told.get("normalizer"), "normalizers"))
    tokens = told.get("added_tokens") or []
    return words and bytes_ and plain and told.get("post_processor") is None and model["type"] == "BPE" and not model.get("dropout") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in tokens)


class Encoder:
    """Texts to ids as uint32; the ids of parts are remembered as bytes."""

    def __init__(self, spec: str, room: int = REMEMBERED) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cuts, self.room, self.size = cuts_at_blanks(spec), room, 0
        #: Parts met since the older ones were set aside, and those.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        told = json.loads(spec)
        suffix, vocabulary = told["model"].get("end_of_word_suffix"), told["model"]["vocab"]
        self.ends = np.zeros(1 + max([*vocabulary.values(), *[t["id"] for t in told["added_tokens"]]]), bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """The ids of words, encoded as one text and cut where a word ends; one by one if the ends don't add up."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(words):
            return self._each(words)
        cuts, raw = [0, *(4 * ends + 4).tolist()], ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _take(self, texts: list[str], encode) -> None:
        for k in range(0, len(texts), TOGETHER):
            some = texts[k : k + TOGETHER]
            self.known.update(zip(some, encode(some), strict=True))
        # An entry takes about 250 bytes beside a long text.
        self.size += 250 * len(texts) + sum(8 * len(t) for t in texts if len(t) > 32)

    def _learn(self, parts: list[str]) -> list[bytes]:
        """The ids of parts that are not known. Those set aside come back; a word with signs, or with capitals, has the ids of the plain word and of its signs."""
        known, older, match = self.known, self.older, PLAIN.fullmatch
        plain: list[tuple[str, str, str]] = []
        other: list[str] = []
        for p in parts:
            if (ids := older.pop(p, None)) is not None:
                known[p] = ids
                self.size += 250
            elif m := match(p):
                sign = m[1]
                plain.append((p, p[: -len(sign)].lower(), sign) if sign else (p, p.lower(), ""))
            else:
                other.append(p)
        self._take(list({w for _, w, _ in plain if w not in known}), self._together if self.ends.any() else self._each)
        self._take(list({s for _, _, s in plain}.difference(known)), self._each)
        self._take(other, self._each)
        for p, w, s in plain:
            if p != w:
                known[p] = known[w] + known[s] if s else known[w]
        self.size += 250 * len(plain)
        return [known[p] for p in parts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids. Equal parts are found, and their ids put in their places, by whole columns."""
        if not self.cuts:
            return [np.frombuffer(x, "<u4") for x in self._each(texts)]
        if self.size > self.room / 2:
            self.older, self.known, self.size = self.known, {}, 0
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        told = lists.flatten().dictionary_encode()
        parts = told.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, parts))
        if missed := [k for k, i in enumerate(ids) if i is None]:
            for k, i in zip(missed, self._learn([parts[k] for k in missed]), strict=True):
                ids[k] = i
        of = told.indices.to_numpy()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts, each = np.cumsum(sizes) - sizes, sizes[of]
        ends = np.cumsum(each)
        place = np.repeat(starts[of] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)
        every, bounds = np.frombuffer(b"".join(ids), "<u4")[place], np.append(0, ends)[lists.offsets.to_numpy()]
        return [every[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def groups(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each text's ids, encoded in groups of about GROUP characters."""
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size > GROUP:
                yield from self.encode(held)
                held, size = [], 0
        if held:
            yield from self.encode(held)


def encoder_of(spec: str) -> Encoder:
    """The worker's encoder of a vocabulary: it outlives a task, so the next one finds parts remembered. One vocabulary is kept at a time."""
    import sys

    kept = vars(sys).setdefault("_tidemark_encoder", {})
    key = zlib.crc32(spec.encode()), len(spec)
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(spec)
    return kept[key]


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes every text, appends end_id, and writes the file set. The vocabulary (a few MB) is broadcast from the driver.

    Texts are encoded where they lie; only packed ids are shuffled, in ranges of (id, hash of text) so that one id with many rows is many tasks.
    """
    text = Path(tokenizer_path).read_text(encoding="utf-8")
    bits = width(text, end_id)
    spec = docs.sparkSession.sparkContext.broadcast(text)
    end = np.array([end_id], "<u4")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(spec.value)
        for batch in batches:
            n, packed = [], []
            for found in encoder.groups(batch.column(1).to_pylist()):
                ids = np.concatenate([found, end])
                n.append(len(ids))
                packed.append(pack(ids, bits))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "fp", "salt", "n_tokens", "packed"])

    given = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = dict(given.dtypes)["doc_id"]
    keyed = given.select("doc_id", "text", F.xxhash64("text").alias("fp"), F.pmod(F.monotonically_increasing_id(), F.lit(1024)).alias("salt"))
    rows = stored(keyed.mapInArrow(encoded, f"doc_id {kind}, fp long, salt long, n_tokens long, packed binary"), "encoded")
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.col("fp"), F.col("salt")]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, size, number = 0, 0, 0
        ids: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            columns = [pa.array([number], pa.int64()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(kind_of)), pa.array([lengths], pa.list_(pa.int64())), pa.array([pack(np.concatenate(held), bits)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "start", "n_ids", "doc_ids", "n_tokens", "packed"])

        for batch in batches:
            kind_of = batch.schema.field(0).type
            for doc, n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids.append(doc)
                lengths.append(n)
                held.append(unpack(packed.as_buffer(), bits, 0, n))
                size += n
                if size >= block:
                    yield row()
                    start, number, size = start + size, number + 1, 0
                    ids, lengths, held = [], [], []
        if ids:
            yield row()

    sorted_ = rows.repartitionByRange(max(1, -(-total * bits // (8 * shard_bytes))), *order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "packed")
    made = sorted_.mapInArrow(blocks, f"block long, start long, n_ids long, doc_ids array<{kind}>, n_tokens array<long>, packed binary")
    made.withColumn("shard", F.spark_partition_id()).write.option("parquet.block.size", 8_000_000).option("compression", "zstd").parquet(f"{folder}/blocks")
    release(rows)
    spark = docs.sparkSession
    sizes = spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    # As many rows as there are shards.
    base = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.select("shard", base.alias("base"), "n_ids", F.lit(bits).alias("bits")).write.parquet(f"{folder}/shards")


def blocks_of(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks with `first`, their place among all ids, and bits."""
    return spark.read.parquet(f"{folder}/blocks").join(spark.read.parquet(f"{folder}/shards").select("shard", "base", "bits"), "shard").withColumn("first", F.col("base") + F.col("start"))


def documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document, from the files."""
    files = blocks_of(spark, folder).select("first", "bits", "doc_ids", "n_tokens", "packed")
    kind = dict(files.dtypes)["doc_ids"][6:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, bits, docs, lengths, packed in zip(*[batch.column(k).to_pylist() for k in range(4)], batch.column(4), strict=True):
                ids = unpack(packed.as_buffer(), bits, 0, sum(lengths)).astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(docs, batch.schema.field(2).type.value_type), pa.array(starts + first, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return files.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def ids_at(spark: SparkSession, folder: str, first: int, n: int) -> np.ndarray:
    """n ids (a bounded number: they come to the driver) from place `first` among all on: only the blocks that hold them are read."""
    shards = spark.read.parquet(f"{folder}/shards").filter((F.col("base") < first + n) & (F.col("base") + F.col("n_ids") > first))
    found = []
    for s in shards.orderBy("shard").toLocalIterator():
        low, high = max(0, first - s.base), min(s.n_ids, first + n - s.base)
        rows = spark.read.parquet(f"{folder}/blocks").filter((F.col("shard") == s.shard) & (F.col("start") < high) & (F.col("start") + F.col("n_ids") > low))
        for r in rows.select("start", "n_ids", "packed").orderBy("start").toLocalIterator():
            a, b = max(low, r.start) - r.start, min(high, r.start + r.n_ids) - r.start
            found.append(unpack(r.packed, s.bits, a, b - a))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)
