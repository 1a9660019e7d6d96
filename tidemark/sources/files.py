"""Curves from files and back: delimited text and FITS tables, each file parsed in one task, many files at once."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.clean import clean

#: Delimiters in the order in which they are tried, and the names of columns.
DELIMITERS = [",", "\t", " ", ";"]
TIME, FLUX, ERROR = ["TIME", "time", "JD", "MJD", "BJD", "BTJD"], ["FLUX", "flux", "SAP_FLUX", "PDCSAP_FLUX"], ["FLUX_ERR", "flux_err", "SAP_FLUX_ERR", "PDCSAP_FLUX_ERR", "ERROR"]
#: Bytes that a file may have.
MOST_BYTES = 100 * 1024 * 1024
SCHEMA = "series_id string, place int, time double, flux double, flux_err double, label int, error string"


def parse_text(data: bytes) -> pd.DataFrame:
    """time, flux and, where there, flux_err and label: the first delimiter that gives two columns or more; columns by name, in any case, or else the first three."""
    text = data.decode("utf-8-sig", "replace")
    for sign in DELIMITERS:
        rows = [r for r in csv.reader(io.StringIO(text), delimiter=sign) if any(c.strip() for c in r)]
        if rows and len(rows[0]) >= 2 and all(len(r) <= len(rows[0]) for r in rows):
            break
    else:
        raise ValueError("no delimiter gives two columns")
    found = [c.strip().lower() for c in rows[0]]
    if not {"time", "flux"} <= set(found):
        found[: min(3, len(found))] = ["time", "flux", "flux_err"][: min(3, len(found))]
    out = {}
    for name in ("time", "flux", "flux_err", "label"):
        if name in found:
            k = found.index(name)
            out[name] = pd.to_numeric(pd.Series([r[k].strip() if k < len(r) else None for r in rows[1:]], dtype=object), errors="coerce")
    return pd.DataFrame(out)


def _header(data: bytes, at: int) -> tuple[dict, int]:
    """The cards of a FITS header, and where what follows it begins."""
    cards: dict = {}
    while at + 2880 <= len(data):
        block = data[at : at + 2880].decode("ascii", "replace")
        at += 2880
        for k in range(0, 2880, 80):
            card = block[k : k + 80]
            key, value = card[:8].strip(), card[10:].strip()
            if key == "END":
                return cards, at
            if card[8:10] == "= ":
                if value.startswith("'"):
                    cards[key] = value[1 : value.index("'", 1)].strip()
                else:
                    cards[key] = value.split("/")[0].strip()
    raise ValueError("a FITS header without an end")


#: The binary forms of FITS columns.
FORMS = {"L": "i1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S", "C": ">c8", "M": ">c16", "X": "u1", "P": ">i4", "Q": ">i8"}


def fits_tables(data: bytes) -> tuple[dict, list[tuple[str, np.ndarray, dict]]]:
    """The first header, and (name, rows as stored, header) of every binary table."""
    first: dict = {}
    tables, at = [], 0
    while at < len(data):
        cards, at = _header(data, at)
        first = first or cards
        n = int(cards.get("NAXIS", 0))
        size = abs(int(cards.get("BITPIX", 8))) // 8 * int(np.prod([int(cards[f"NAXIS{k}"]) for k in range(1, n + 1)])) if n else 0
        if cards.get("XTENSION") == "BINTABLE":
            fields = []
            for k in range(1, int(cards["TFIELDS"]) + 1):
                form = cards[f"TFORM{k}"]
                digits = form[: len(form) - len(form.lstrip("0123456789"))]
                n_of, kind = int(digits or 1), form[len(digits)]
                n_of, kind = (-(-n_of // 8), kind) if kind == "X" else (n_of * 2, kind) if kind in "PQ" else (n_of, kind)
                name = cards.get(f"TTYPE{k}", f"col{k}")
                fields.append((name, f"S{n_of}") if kind == "A" else (name, FORMS[kind], (n_of,)) if n_of != 1 else (name, FORMS[kind]))
            tables.append((cards.get("EXTNAME", ""), np.frombuffer(data, dtype=np.dtype(fields), count=int(cards["NAXIS2"]), offset=at), cards))
        size += int(cards.get("PCOUNT", 0))
        at += -(-size // 2880) * 2880
    return first, tables


def fits_column(rows: np.ndarray, name: str, cards: dict) -> np.ndarray:
    """A column's values: NaN where TNULLn stands, else TZEROn + TSCALn x what is stored."""
    k = list(rows.dtype.names).index(name) + 1
    stored = rows[name]
    out = stored.astype(float)
    if f"TSCAL{k}" in cards or f"TZERO{k}" in cards:
        out = float(cards.get(f"TZERO{k}", 0)) + float(cards.get(f"TSCAL{k}", 1)) * out
    if f"TNULL{k}" in cards and stored.dtype.kind in "iu":
        out[stored == int(cards[f"TNULL{k}"])] = np.nan
    return out


def parse_fits(data: bytes) -> tuple[pd.DataFrame, dict[str, str]]:
    """time, flux and, where there, flux_err of the table LIGHTCURVE, else of the first; and what the first header says of the object."""
    head, tables = fits_tables(data)
    if not tables:
        raise ValueError("no table in the file")
    _, rows, cards = next((t for t in tables if t[0] == "LIGHTCURVE"), tables[0])
    out = {}
    for name, known in (("time", TIME), ("flux", FLUX), ("flux_err", ERROR)):
        column = next((c for c in known if c in rows.dtype.names), None)
        if column is not None:
            out[name] = fits_column(rows, column, cards)
    if not {"time", "flux"} <= set(out):
        raise ValueError(f"time and flux are not among {list(rows.dtype.names)}")
    return pd.DataFrame(out), {k: head.get(c, "Unknown") for k, c in (("object_name", "OBJECT"), ("telescope", "TELESCOP"), ("instrument", "INSTRUME"))}


def read_curves(spark: SparkSession, path: str, checked: bool = True) -> DataFrame:
    """series_id, time, flux, flux_err, label (null without one), ord of all .csv, .txt, .dat, .fits and .fit files of a path.

    series_id is the file's name without its suffix; names that several files have are told apart by their paths below `path`, with suffix.
    Suffixes may be of any case. A file that cannot be read, is of another kind or is over MOST_BYTES has no rows here:
    unreadable() tells. checked: cleaned, as every series is before use.
    """
    good = _parsed(spark, path).filter("error is null")
    curves = good.select("series_id", "time", "flux", "flux_err", "label", F.struct("time", "place").alias("ord"))
    if not checked:
        return curves
    # A file without errors gets one hundredth of its spread.
    return _with_errors(clean(curves))


def from_columns(df: DataFrame, time: str = "time", flux: str = "flux", flux_err: str | None = None, series_id: str | None = None, label: str | None = None) -> DataFrame:
    """Curves out of any table by the names of its columns: series_id, time, flux, flux_err, label, ord, cleaned as curves from files are.

    Without series_id all rows are one series, "all"; without errors each series gets one hundredth of its spread.
    """
    missing = [c for c in (time, flux, flux_err, series_id, label) if c is not None and c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {df.columns}")
    told = lambda c, kind: F.lit(None).cast(kind) if c is None else F.col(f"`{c}`").cast(kind)
    key = F.lit("all") if series_id is None else F.col(f"`{series_id}`")
    curves = df.select(key.alias("series_id"), told(time, "double").alias("time"), told(flux, "double").alias("flux"), told(flux_err, "double").alias("flux_err"), told(label, "int").alias("label"))
    return _with_errors(clean(curves.withColumn("ord", F.struct("time", "flux"))))


def _with_errors(kept: DataFrame) -> DataFrame:
    usual = 0.01 * F.stddev_samp("flux").over(_by_series())
    return kept.withColumn("flux_err", F.when(F.count("flux_err").over(_by_series()) == 0, usual).otherwise(F.col("flux_err")))


def _by_series():
    from tidemark.operators.clean import series

    return series()


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """series_id and error of the files that read_curves() leaves out."""
    return _parsed(spark, path).filter("error is not null").select("series_id", "error")


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, series_id, size, data in zip(pdf["file"], pdf["series_id"], pdf["length"], pdf["content"], strict=True):
                suffix = own.rsplit(".", 1)[-1].lower()
                rows, error = pd.DataFrame({"time": [None]}, dtype=float), None
                try:
                    if size > MOST_BYTES:
                        raise ValueError("too large")
                    if suffix not in ("csv", "txt", "dat", "fits", "fit"):
                        raise ValueError(f"unsupported format .{suffix}")
                    rows = parse_fits(bytes(data))[0] if suffix.startswith("fit") else parse_text(bytes(data))
                except Exception as e:  # noqa: BLE001  (one bad file must not stop the others; it is reported)
                    error = str(e)
                full = rows.reindex(columns=["time", "flux", "flux_err", "label"])
                yield full.assign(series_id=series_id, place=np.arange(len(full), dtype=np.int32), error=error, label=full["label"].astype("Int32"))[["series_id", "place", "time", "flux", "flux_err", "label", "error"]]

    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no file {path}") from None
        raise
    file = F.element_at(F.split("path", "/"), -1)
    bare = F.when(file.contains("."), F.regexp_extract(file, r"^(.*)\.[^.]*$", 1)).otherwise(file)
    # Names first, from the listing alone: contents are not read for it. A list of names that clash is short.
    clashes = files.select(bare.alias("bare")).groupBy("bare").agg(F.count("*").alias("n")).filter("n > 1").select("bare", F.lit(True).alias("clash"))
    below = F.regexp_replace("path", "^.*?" + re.escape(path.rstrip("/").split(":", 1)[-1]) + "/", "")
    named = files.withColumns({"file": file, "bare": bare}).join(clashes, "bare", "left").withColumn("series_id", F.when(F.col("clash"), below).otherwise(F.col("bare")))
    # Contents over the limit are not read into a row.
    small = named.select("file", "series_id", "length", F.when(F.col("length") <= MOST_BYTES, F.col("content")).otherwise(F.lit(b"")).alias("content"))
    return small.mapInPandas(parse, SCHEMA)


def write_dataset(points: DataFrame, metadata: DataFrame, folder: str) -> None:
    """One CSV folder a target under lightcurves/ (series_id=...), and metadata.csv."""
    points.repartition("series_id").sortWithinPartitions("series_id", "time").write.mode("overwrite").option("header", True).partitionBy("series_id").csv(f"{folder}/lightcurves")
    metadata.write.mode("overwrite").option("header", True).csv(f"{folder}/metadata.csv")


def read_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(points of the targets that the metadata names, with its columns; the targets named there that have no curve)."""
    metadata = spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/metadata.csv").withColumn("target_id", F.col("target_id").cast("string"))
    points = spark.read.option("header", True).schema("time double, flux double, flux_err double, label int, series_id string").csv(f"{folder}/lightcurves")
    return points.join(metadata.withColumnRenamed("target_id", "series_id"), "series_id"), metadata.join(points.select(F.col("series_id").alias("target_id")).distinct(), "target_id", "left_anti")


def write_results(points: DataFrame, path: str) -> None:
    """time, flux, flux_err, is_anomaly as CSV with a header."""
    points.select("time", "flux", "flux_err", "is_anomaly").write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def latex_table(rows: list[dict], metrics: list[str], caption: str = "", name: str = "model") -> str:
    """A table of mean ± std by model (columns <metric>_mean and <metric>_std), the best mean bold, -- where there is none."""
    best = {m: max((r[f"{m}_mean"] for r in rows if r.get(f"{m}_mean") is not None and r[f"{m}_mean"] == r[f"{m}_mean"]), default=None) for m in metrics}

    def cell(r: dict, m: str) -> str:
        mean, std = r.get(f"{m}_mean"), r.get(f"{m}_std")
        if mean is None or mean != mean:
            return "--"
        text = f"{mean:.3f} $\\pm$ {std:.3f}" if std is not None and std == std else f"{mean:.3f}"
        return f"\\textbf{{{text}}}" if mean == best[m] else text

    lines = [" & ".join([str(r[name]).replace("_", r"\_"), *[cell(r, m) for m in metrics]]) + r" \\" for r in rows]
    head = " & ".join([name.title(), *[m.replace("_", r"\_") for m in metrics]]) + r" \\"
    return "\n".join([r"\begin{table}[h]", r"\centering", rf"\caption{{{caption}}}", rf"\begin{{tabular}}{{l{'c' * len(metrics)}}}", r"\hline", head, r"\hline", *lines, r"\hline", r"\end{tabular}", r"\end{table}"])
