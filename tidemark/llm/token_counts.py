"""Token counts by overlap resynchronisation.

Where the vocabulary splits words before single spaces (`splits_at_blanks`), a short text falls apart at every blank that
follows a non-blank, and the counts of parts that come again are remembered by each worker, up to `REMEMBERED` bytes; with
other vocabularies short texts are encoded whole. A text over `CHUNK` characters is encoded in overlapping chunks; in the
overlap the chunks are spliced where a word of the pre-tokenizer ends in both. What follows such a place is split alike whatever came before
it, and a place `margin` characters before a chunk's end cannot be moved by text beyond it, so the spliced tokens are those
of the whole text. Where no such place is found, the next chunk starts further back, at worst where the last one did, with
a longer reach. Tokens are never truncated, padded or added.

Defined results: null text counts as empty, 0 bytes and 0 tokens. Rows are independent: repeated ids stay repeated, also null ones.
Texts of any length are counted whole; no two rows are compared, so nothing ties. A table without rows gives none; only the id and the text are read, so other
columns may have any names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, LIMIT = 65_536, 2_048, 512
#: Characters of short texts that are encoded together.
BATCH = 1_000_000
#: Bytes, about, of pieces of text whose token counts a worker remembers.
REMEMBERED = 64_000_000
#: A blank after a non-blank. No word of the byte-level pre-tokenizer holds one but as its first character, and no word's
#: end depends on what follows such a place, so the text may be cut before it. (The class of blanks here is the wider one.)
BLANK = re.compile(r"\x20(?<=\S\x20)")


def splits_at_blanks(spec: str) -> bool:
    """Whether a text cut at BLANK has the tokens of its parts: a plain byte-level split, nothing that changes texts or reaches over blanks."""
    told = json.loads(spec)
    split = told.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    model = told.get("model") or {}
    added = told.get("added_tokens") or []
    return bool(
        plain
        and told.get("normalizer") is None
        and told.get("post_processor") is None
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in added)
    )


class Remembered:
    """Token counts of the parts between BLANKs: a part that comes a second time is encoded by itself and then remembered."""

    def __init__(self, tokenizer, room: int = REMEMBERED) -> None:
        self.tokenizer, self.room = tokenizer, room
        #: By what stands after the blank that a part begins with.
        self.known: dict[str, int] = {}
        self.once: set[str] = set()
        self.known_size = self.once_size = 0

    def _learn(self, parts: list[str]) -> None:
        self.known.update(zip(parts, map(len, self.tokenizer.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)), strict=True))
        self.once.difference_update(parts)

    def reduced(self, text: str) -> tuple[int, str]:
        """The tokens of the parts that are remembered, and a text of all other parts, in their order, which has the rest."""
        # An entry takes about 150 bytes beside its text.
        if self.known_size > self.room:
            self.known.clear()
            self.known_size = 0
        if self.once_size > self.room:
            self.once.clear()
            self.once_size = 0
        head, *parts = BLANK.split(text)
        counts = list(map(self.known.get, parts))
        if None not in counts:
            return sum(counts), head
        missed = [p for p, n in zip(parts, counts, strict=True) if n is None]
        if again := list(self.once.intersection(missed)):
            self._learn(again)
            self.known_size += sum(map(len, again)) + 150 * len(again)
            self.once_size -= sum(map(len, again)) + 150 * len(again)
            counts = list(map(self.known.get, parts))
            missed = [p for p, n in zip(parts, counts, strict=True) if n is None]
        new = set(missed)
        self.once |= new
        self.once_size += sum(map(len, new)) + 150 * len(new)
        return sum(filter(None, counts)), " ".join([head, *missed])


def word_ends(encoding, text: str) -> dict[int, int]:
    """Place in the text after each pre-tokenizer word -> tokens up to there."""
    out: dict[int, int] = {}
    ids, offsets = encoding.word_ids, encoding.offsets
    for k in range(1, len(ids)):
        if ids[k] != ids[k - 1]:
            out[offsets[k][0]] = k
    out[len(text)] = len(ids)
    return out


def chunk_starts(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = 64) -> Iterator[tuple[int, int, int]]:
    """(start, end, tokens) of spans that splice to the whole text."""
    start = 0
    reach = chunk
    while start < len(text):
        piece = text[start : start + reach]
        if start + reach >= len(text):
            yield start, len(text), len(tokenizer.encode(piece, add_special_tokens=False).ids)
            return
        ends = word_ends(tokenizer.encode(piece, add_special_tokens=False), piece)
        wide, at = overlap, None
        while at is None and wide < reach:
            back = max(0, len(piece) - wide)
            other = text[start + back : start + reach + chunk]
            same = {back + p for p in word_ends(tokenizer.encode(other, add_special_tokens=False), other)} & ends.keys()
            at = max((p for p in same if back < p <= len(piece) - margin), default=None)
            wide *= 2
        if at is None:
            reach *= 2
            continue
        yield start, start + at, ends[at]
        start, reach = start + at, chunk


def count(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    margin = 64 + max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)
    return sum(n for _, _, n in chunk_starts(tokenizer, text, chunk, overlap, margin))


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. The vocabulary (its file is a few MB) is broadcast from the driver."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec.value)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        remembered = Remembered(tokenizer) if splits_at_blanks(spec.value) else None
        for batch in rows:
            texts = batch.column(1).to_pylist()
            n = [0] * len(texts)
            held: list[int] = []
            left: list[str] = []
            size = 0

            def flush(n=n, held=held, left=left) -> None:
                for i, e in zip(held, tokenizer.encode_batch_fast(left, add_special_tokens=False), strict=True):
                    n[i] += len(e)
                held.clear()
                left.clear()

            for i, text in enumerate(texts):
                if len(text) > chunk:
                    n[i] = count(tokenizer, text, chunk)
                elif text:
                    if remembered is not None:
                        n[i], text = remembered.reduced(text)
                    held.append(i)
                    left.append(text)
                    size += len(text)
                    if size > BATCH:
                        flush()
                        size = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    told = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(told.dtypes)["doc_id"]
    out = told.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(batches, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
