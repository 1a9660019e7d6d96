"""The jobs over the test tables: each runs twice into one new folder, whose files stay, and returns its whole output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.queries import _CAT, _LC, _WIN
from tidemark.sources.shared import shared_folder

from . import text_watch, training_set


def _folder(spark: SparkSession, job: str) -> str:
    return f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def job1_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job1")
    training_set.run(spark, sf_dir, out)
    return _rounded(training_set.run(spark, sf_dir, out))


def job2_text_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job2")
    text_watch.run(spark, f"{sf_dir}/documents.parquet", out)
    return _rounded(text_watch.run(spark, f"{sf_dir}/documents.parquet", out))


QUERIES = {f.__name__: f for f in (job1_training_set, job2_text_watch)}

_WINDOW_STATISTICS = "m as (select *, median(flux) over (partition by series_id, window_id) as md, avg(flux) over (partition by series_id, window_id) as mu from win)"
ORACLES = {
    "job1_training_set": f"""with {_LC.replace("lc as (", "lc0 as (", 1)}, {_CAT},
clipped as (select * from (select *, median(flux) over (partition by series_id) as md, stddev_pop(flux) over (partition by series_id) as sd from lc0 where n >= 10) where abs(flux - md) < 5 * sd),
phased as (select *, (((time - epoch) % period) + period) % period / period as phase, duration_hours / 24 / period / 2 as h from clipped left join cat on series_id = target_id),
lc as (select series_id, (flux - avg(flux) over (partition by series_id)) / nullif(stddev_samp(flux) over (partition by series_id), 0) as flux, coalesce((phase < h or phase > 1 - h)::int, 0) as label,
  row_number() over (partition by series_id order by idx) - 1 as idx, count(*) over (partition by series_id) as n from phased), {_WIN}, {_WINDOW_STATISTICS},
w as (select series_id, window_id, max(label) as label, round(avg(flux), 4) + 0 as mean, round(stddev_pop(flux), 4) as std, round(min(flux), 4) as min, round(max(flux), 4) as max, round(max(flux) - min(flux), 4) as ptp,
  round(avg((flux - mu) ** 3) / avg((flux - mu) ** 2) ** 1.5, 4) as skewness, round(kurtosis_pop(flux), 4) as kurtosis, round(sqrt(avg(flux * flux)), 4) as rms, round(median(flux), 4) as median, round(median(abs(flux - md)), 4) as mad from m group by 1, 2)
select w.*, mission, case when period is not null then 'transit' else 'normal' end as label_type from w join cat on series_id = target_id""",
    "job2_text_watch": r"""with d as (select doc_id, source, coalesce(text, '') as t from documents),
m as (select doc_id, source, 'chars' as measure, length(t)::bigint as value from d union all select doc_id, source, 'words', len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::bigint from d
  union all select doc_id, source, 'lines', (case when t = '' then 0 else 1 + length(t) - length(replace(t, chr(10), '')) end)::bigint from d),
s as (select source, measure, sum(value)::double / count(*) as mean, sqrt(greatest(sum(value::hugeint * value)::double / count(*) - (sum(value)::double / count(*)) * (sum(value)::double / count(*)), 0)) as std from m group by 1, 2)
select m.doc_id, m.source, m.value, round(mean, 4) as mean, round(std, 4) as std, round((value - mean) / std, 4) as z, 0::bigint as batch, m.measure
from m join s on m.source is not distinct from s.source and m.measure = s.measure where std > 0 and abs((value - mean) / std) > 3""",
}
