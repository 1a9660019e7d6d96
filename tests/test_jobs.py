"""The jobs: reruns, growing input, a replayed batch, command lines and SQL."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import queries, text_watch, training_set
from tidemark.sources.shared import shared_folder

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_equals_sql(spark, name, monkeypatch):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    small = name == "job2_text_watch"  # no document of so few is over three standard deviations off
    if small:
        monkeypatch.setattr(text_watch.run, "__defaults__", (1.5, None))
    want = con.execute(queries.ORACLES[name].replace("> 3", "> 1.5") if small else queries.ORACLES[name]).df()
    before = set(Path(shared_folder(spark)).glob("job*"))
    got = queries.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) > 0
    plain = lambda df: sorted(map(repr, ([float(x) + 0.0 if isinstance(x, float) else str(x) for x in r] for r in df[cols].itertuples(index=False))))
    assert plain(got) == plain(want)
    assert len(set(Path(shared_folder(spark)).glob("job*")) - before) == 1  # the files stay


def test_training_set_of_one_mission(spark, tmp_path):
    """One mission's rebuild replaces its own partitions only; the whole set's leaves nothing else behind."""
    whole = rows(training_set.run(spark, SF, f"{tmp_path}/all"))
    out = f"{tmp_path}/set"
    training_set.run(spark, SF, out, sigma=1.0)
    clipped = rows(training_set.read(spark, out))
    mission = training_set.read(spark, out).agg(F.min("mission")).first()[0]
    assert clipped != whole
    mixed = training_set.run(spark, SF, out, mission=mission)
    assert rows(mixed.filter(F.col("mission") == mission)) == [r for r in whole if f"mission='{mission}'" in r]
    assert rows(mixed.filter(F.col("mission") != mission)) == [r for r in clipped if f"mission='{mission}'" not in r]
    assert rows(training_set.run(spark, SF, out)) == whole
    assert not training_set.run(spark, SF, f"{tmp_path}/large", window=10_000).take(1)


def watched(parts, threshold):
    """Alerts of files that come one batch after the other, by plain Python."""
    seen, out = {}, set()
    for batch, part in enumerate(parts):
        sizes = [(d, s, m, v) for d, s, t in part for m, v in (("chars", len(t or "")), ("words", len((t or "").split())), ("lines", t.count("\n") + 1 if t else 0))]
        for _, s, m, v in sizes:
            seen.setdefault((s, m), []).append(v)
        for d, s, m, v in sizes:
            x = seen[s, m]
            mean = sum(x) / len(x)
            std = max(sum(y * y for y in x) / len(x) - mean * mean, 0) ** 0.5
            if std > 1e-6 and abs(v - mean) / std > threshold:
                out.add((batch, d, s, m, v, round((v - mean) / std, 6)))
    return out


def alerts(df):
    return {(r.batch, r.doc_id, r.source, r.measure, r.value, round(r.z, 6)) for r in df.collect()}


def test_watch_takes_only_what_is_new(spark, tmp_path):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    docs = [(d, s if d % 7 else None, None if d % 11 == 0 else " ".join((t or "").split())) for d, s, t in docs]
    parts, folder, out = [docs[:90], docs[90:150], docs[150:]], tmp_path / "docs.parquet", f"{tmp_path}/out"
    folder.mkdir()

    def add(k):
        spark.createDataFrame(parts[k], "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        (file,) = (tmp_path / f"part{k}").glob("part-*.parquet")
        shutil.copy(file, folder / f"{k}.parquet")

    add(0)
    first = alerts(text_watch.run(spark, str(folder), out, 2.0))
    assert first == watched(parts[:1], 2.0) and first
    kept = {p: p.read_bytes() for p in Path(out).glob("alerts/batch=0/**/*.parquet")}
    assert alerts(text_watch.run(spark, str(folder), out, 2.0)) == first  # nothing new
    add(1)
    assert alerts(text_watch.run(spark, str(folder), out, 2.0)) == watched(parts[:2], 2.0)
    add(2)
    want = watched(parts, 2.0)
    assert alerts(text_watch.run(spark, str(folder), out, 2.0)) == want and len({a[0] for a in want}) == 3
    assert kept == {p: p.read_bytes() for p in Path(out).glob("alerts/batch=0/**/*.parquet")}
    # A batch whose end was not noted, as when the driver dies, is taken again and counts once.
    for p in Path(out).glob("checkpoint/commits/*2*"):
        p.unlink()
    assert alerts(text_watch.run(spark, str(folder), out, 2.0)) == want
    assert spark.read.schema(text_watch.STATE).parquet(f"{out}/state").filter("batch = 2 and measure = 'chars'").agg(F.sum("n")).first()[0] == len(docs)


def test_watch_of_one_file_at_a_time(spark, tmp_path):
    parts = [[(k * 10 + i, "s", "x " * (5 if i else 50 * k)) for i in range(12)] for k in range(3)]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "doc_id long, source string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    got = text_watch.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", files_a_batch=1)
    assert {r.batch for r in got.select("batch").distinct().collect()} <= {0, 1, 2} and got.count() > 0
    assert len(list(Path(f"{tmp_path}/out/state").glob("batch=*"))) == 3
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    none.write.parquet(f"{tmp_path}/none")
    assert text_watch.run(spark, f"{tmp_path}/none", f"{tmp_path}/none-out").count() == 0


@pytest.mark.parametrize("job,paths", [("training_set", {"tables": SF}), ("text_watch", {"documents": f"{SF}/documents.parquet"})])
def test_command_line(spark, tmp_path, job, paths):
    settings = json.loads((REPO / f"jobs/{job}.json").read_text()) | ({"window": 40} if job == "training_set" else {"threshold": 4.0})
    (tmp_path / "own.json").write_text(json.dumps(settings))
    args = [x for k, v in (paths | {"out": f"{tmp_path}/out", "config": f"{tmp_path}/own.json"}).items() for x in (f"--{k}", v)]
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *args], cwd=REPO, capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr or "written" in done.stderr
    if job == "training_set":
        assert rows(training_set.read(spark, f"{tmp_path}/out")) == rows(training_set.run(spark, SF, f"{tmp_path}/same", window=40))
    else:
        assert alerts(text_watch.read(spark, f"{tmp_path}/out")) == alerts(text_watch.run(spark, f"{SF}/documents.parquet", f"{tmp_path}/same", threshold=4.0))
