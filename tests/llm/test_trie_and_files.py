"""The conversation trie and the token files against plain definitions."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import prefix_trie, queries, token_files

SF = "/root/testdata/sf0.001"


def plain_trie(convs):
    """{conv_id: [(turn's name, words)]} to node rows, by walking every prefix."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * p[-1][1] if p else 0
        saved[p] = own + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
    return {(m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()}


def nodes(df):
    return [tuple(r) for r in df.select([c.split()[0] for c in prefix_trie.NODES.split(", ")]).collect()]


def test_trie_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.execute("select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from (" + queries.ORACLES["op11_conversation_trie"] + ")").fetchall()
    assert sorted(map(repr, nodes(queries.op11_conversation_trie(spark, SF)))) == sorted(map(repr, want))


@pytest.mark.parametrize("segment", [2, 3, 256])
def test_trie_of_any_depth(spark, segment):
    """Nested chains, copies, one long conversation and turnless ones; segments so short that digests are chained over several levels."""
    rng = random.Random(segment)
    convs = {c: [] for c in (3, 40)}
    for c in range(5, 30):
        kin = convs[rng.choice(sorted(convs))]
        convs[c] = kin[: rng.randint(0, len(kin))] + [(f"t{rng.randint(0, 2)}", rng.randint(0, 4)) for _ in range(rng.randint(0, 4))]
    convs[1] = [(f"t{k % 2}", k % 3) for k in range(40)]
    convs[60] = convs[1][:25] + [("other", 7)]
    rows = [(c, k, hashlib.sha256(repr(x).encode()).digest(), x[1]) for c, v in convs.items() for k, x in enumerate(v)]
    turns = spark.createDataFrame(rows, "conv_id long, pos long, digest binary, n_words long")
    got = nodes(prefix_trie.trie(turns, spark.createDataFrame([(c, len(v)) for c, v in convs.items()], "conv_id long, n long"), segment))
    assert len(got) == len(set(got)) and set(got) == plain_trie(convs)


def test_trie_of_odd_conversations(spark):
    """Nulls in every column, ties, repeated rows, a turnless rebuilt conversation, clashing columns, no rows."""
    rows = [(20, None, "a", "null turn first"), (20, 1, None, "x y z"), (20, 2, "a", None), (21, 0, "u", "own"), (22, 5, "u", "twice"), (22, 5, "u", "twice"), (22, 5, "u", "and a tie"), (None, 0, "u", "of none"), (7, 0, "u", "w " * 50_000), (8, 0, "u", None), (9, 0, "", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit(1).alias(c) for c in ("pos", "digest", "n", "part", "place", "before", "seg", "first", "up")])
    own = prefix_trie.numbered(df)
    assert {(r.conv_id, r.pos): r.n_words for r in own.collect()}[7, 0] == 50_000 and own.count() == len(rows) - 1
    turns, convs = prefix_trie.rebuilt(own)
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            digest = hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
            said[c].append((turn is not None, turn or 0, digest, len([w for w in t.replace("\n", " ").split(" ") if w])))
    plain = {c: [(d, n) for _, _, d, n in sorted(v)] for c, v in said.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in plain}
    want = {c: plain.get(c - c % 20, [])[: h[c]] + v[h[c] :] for c, v in plain.items()}
    assert {r.conv_id: r.n for r in convs.collect()} == {c: len(v) for c, v in want.items()} and [] in want.values()
    got = nodes(prefix_trie.trie(turns, convs))
    assert len(got) == len(set(got)) and set(got) == plain_trie(want)
    assert nodes(prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered(df.limit(0))))) == []


ODD = ["", " ", "a", " a  b\tc\nd\n\n e f g", "don't  WON'T 's ' s", "e ́ é ̈́x", "<|endoftext|> a<|startoftext|>b <|end of|>", "\x1c\x1d\u0085x y", "Ωmega ΣΑΣ ΟΔΟΣ. İI", "123 4 5٠ ½", "x" * 3000 + " " + "y" * 300, "日本語 テキスト\n改行", "​﻿ a\u0000b"]


def plain_ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_packed_bits():
    rng = np.random.default_rng(1)
    for bits in (1, 3, 5, 8, 11, 16, 17, 24, 31, 32):
        for n in (0, 1, 7, 8, 9, 1000):
            ids = rng.integers(0, 2**bits, n, dtype=np.uint64)
            packed = token_files.pack(ids, bits)
            assert len(packed) == -(-n // 8) * bits
            low = int(rng.integers(0, n + 1))
            some = int(rng.integers(0, n - low + 1))
            assert (token_files.unpack(packed, bits, 0, n) == ids).all() and (token_files.unpack(packed, bits, low, some) == ids[low : low + some]).all()
    # The layout itself: ids of three bits, the lowest bit first.
    assert token_files.pack(np.array([1, 2, 3]), 3) == (1 | 2 << 3 | 3 << 6).to_bytes(3, "little")


@pytest.mark.parametrize("name,cuts", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_equals_library(name, cuts):
    path = public_tokenizers.path(name)
    tokenizer, spec = Tokenizer.from_file(path), open(path, encoding="utf-8").read()
    encoder = token_files.Encoder(spec, room=500)
    assert encoder.cuts == cuts and token_files.width(spec, 1) == 16
    rng = random.Random(2)
    signs = ["a", "B", "'", "s", "t", " ", " ", "\n", "\t", " ", "́", "é", "1", "½", ".", "<|endoftext|>", "\x1c", "Σ", "　"]
    letters = [chr(c) for c in range(0xC0, 0x250)]
    texts = [*ODD, *["".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(3000)], *["".join(rng.choices([*letters, "e", ".", ",", " "], k=12)) for _ in range(3000)], *letters, *[f"Word{a}{b} ABC{a} x{b}y{a}" for a in map(chr, range(33, 127)) for b in "'<|.$s"]]
    for k in range(0, len(texts), 50):
        some = texts[k : k + 50]
        assert [x.tolist() for x in encoder.groups(some)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    assert not cuts or encoder._together(["one", "ünd"]) == encoder._each(["one", "ünd"]) and encoder._together(["one.", "two"]) == encoder._each(["one.", "two"])


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(ODD)] + [(-5, None), (7, "again"), (7, "again"), (None, "no id"), (20_000, "long text, " * 40_000)], "doc_id long, text string")
    rows = docs.union(odd).select("*", *[F.lit(1).alias(c) for c in ("fp", "salt", "packed", "shard", "n_tokens", "ids")])
    folder = f"{tmp_path}/set"
    token_files.write(rows, path, folder, end_id=1, block=512, shard_bytes=50_000)
    blocks = spark.read.parquet(f"{folder}/blocks")
    assert blocks.select("shard").distinct().count() > 3 and blocks.filter("n_ids - element_at(n_tokens, -1) >= 512").count() == 0
    got = sorted(token_files.documents(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    given = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in rows.collect()))
    assert [r.doc_id for r in got] == [d if known else None for known, d, _ in given]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in got) == sorted((k, d, plain_ids(tokenizer, t).tolist()) for k, d, t in given)
    start = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        start += r.n_tokens
    whole = np.concatenate([r.ids for r in got])
    for first, n in ((0, 1), (511, 3), (1000, 5000), (start - 5, 50), (0, start), (start, 4)):
        assert (token_files.ids_at(spark, folder, first, n) == whole[first : first + n]).all()
    none = f"{tmp_path}/none"
    token_files.write(rows.limit(0), path, none, end_id=1)
    assert token_files.documents(spark, none).count() == 0


def test_token_files_query(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = plain_ids(tokenizer, r.text)
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in queries.op12_token_files(spark, SF).orderBy("doc_id").collect()] == want
