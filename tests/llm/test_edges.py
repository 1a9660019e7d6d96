"""Odd rows, clashing names and empty tables for every operator, and the pipeline from end to end."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontamination, language_id, license_scan, line_dedup, near_dedup, packing, quality, queries, secret_scan, token_counts
from tidemark.llm.common import shared_folder

SF = "/root/testdata/sf0.001"
ROWS = [(1, None), (2, ""), (3, "Plain words only."), (3, "Plain words only."), (None, "No id here, but a text."), (4, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" Released under the MIT License.'), (5, "x " * 30000), (6, "\n\n \t")]
#: Names that the operators use inside.
CLASH = ["row", "key", "n", "words", "fp", "h", "hits", "found", "score", "c0", "c1", "candidates", "text_key", "marks", "t", "a", "k", "at", "item_id", "bad_id", "keep_id", "piece", "bin", "of", "meets", "p", "rid", "parts", "base", "x"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i, t, "s" if i != 5 else None) for i, t in ROWS], "doc_id long, text string, source string")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def operators(spark, table):
    import public_tokenizers

    model = quality.fit(table("documents"), table("labels"))
    langs = language_id.fit(table("documents"))
    return {
        "license": license_scan.scan,
        "decontamination": lambda d: decontamination.digest(decontamination.scan(d, table("benchmark"))),
        "secrets": lambda d: secret_scan.digest(secret_scan.scan(d)),
        "lines": line_dedup.dedup,
        "tokens": lambda d: token_counts.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
        "language": lambda d: language_id.identify(language_id.evidence(d, table("pages").limit(0)), langs),
        "quality": lambda d: quality.scored(d, model),
        "near": near_dedup.classes,
    }


@pytest.fixture(scope="module")
def got(operators, odd):
    return {name: run(odd).collect() for name, run in operators.items()}


def test_every_operator_takes_odd_rows(odd, got):
    assert {name: len(rows) for name, rows in got.items()} == dict.fromkeys(got, len(ROWS))
    assert packing.pack(odd).select("doc_id").distinct().count() == 7


def test_every_operator_takes_no_rows(odd, operators):
    none = odd.limit(0)
    assert not any(run(none).take(1) for run in operators.values())
    assert not packing.pack(none).take(1)


def test_defined_results_of_odd_rows(got):
    tokens = {r.doc_id: (r.n_bytes, r.n_tokens) for r in got["tokens"]}
    assert tokens[1] == tokens[2] == (0, 0) and tokens[5][0] == 60000
    found = {r.doc_id: [x.family for x in r.found] for r in got["license"]}
    assert found[4] == ["MIT"] and not any(v for k, v in found.items() if k != 4)
    spans = {r.doc_id: r.spans for r in got["secrets"]}
    assert spans[4].startswith("assign:0:") and spans[1] == spans[2] == ""
    words = {r.doc_id: (r.n_words, r.contaminated) for r in got["decontamination"]}
    assert words[1] == words[2] == words[6] == (0, False) and words[5] == (30000, False)
    classes = {r.doc_id: r.class_id for r in got["near"]}
    assert classes[1] == classes[2] == classes[6] == 1 and classes[3] == 3


def test_language_without_labels_and_with_declared_markup(spark, table):
    docs = table("documents")
    none = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang for r in language_id.identify(language_id.evidence(docs.limit(5), table("pages").limit(5)), none).collect()} == {None}
    # By hand: a row with no evidence at all has the likeliest language of all rows.
    langs, _ = model = language_id.fit(docs)
    rows = spark.createDataFrame([(1, None, None, None)], "doc_id long, text string, lang string, source string")
    got = language_id.identify(language_id.evidence(rows.select("doc_id", "text", "source"), table("pages").limit(0)), model).first()
    assert got.lang in langs and 0 < got.probability <= 1


def test_stages_keep_columns(odd, table):
    for stage in (line_dedup.stage, near_dedup.stage, lambda d: quality.stage(d, table("labels")), lambda d: decontamination.clean(d, table("benchmark"))):
        kept = stage(odd)
        assert kept.columns == odd.columns and {r.text for r in kept.select("text").collect()} <= {t for _, t in ROWS}


def test_pipeline_end_to_end(spark, table):
    """Each stage's written rows, and the packed rows against the last stage's documents."""
    docs, shared = table("documents"), Path(shared_folder(spark))
    before = set(shared.glob("pipeline-*"))
    out = corpus_pipeline.run(spark, SF).toPandas()
    (folder,) = set(shared.glob("pipeline-*")) - before
    written = [spark.read.parquet(str(p)) for p in sorted(folder.iterdir())]
    assert len(written) == len(corpus_pipeline.STAGES) and all(w.columns == docs.columns for w in written[:-1])
    n = [docs.count(), *[w.count() for w in written[:-1]]]
    assert n == sorted(n, reverse=True) and n[-1] > 0.5 * n[0]
    kept = written[-2]
    assert kept.groupBy(F.lower("text")).count().filter("count > 1").count() == 0
    assert decontamination.scan(kept, table("benchmark")).filter("contaminated").count() == 0
    whole = {r.doc_id: (r.text or "").lstrip() for r in kept.collect()}
    assert out.sort_values(["doc_id", "piece"]).groupby("doc_id").text.agg("".join).to_dict() == whole
    bins = out.groupby(["bin_shard", "bin"])
    assert (bins.n_words.sum() + bins.size() <= packing.CAPACITY).all()


def test_queries_are_all_there():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 13)} and {*queries.QUERIES, "pipeline"} <= names.keys()
    assert set(entry.oracle_sql()) <= set(names)
