"""Curves from files and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import files


def card(key, value):
    return f"{key:<8}= {value}".ljust(80)


def fits(names, forms, rows, extname="LIGHTCURVE", head=(), more=()):
    block = lambda cards: ("".join(cards) + "END".ljust(80)).ljust(-(-(len("".join(cards)) + 80) // 2880) * 2880).encode()
    out = block([card("SIMPLE", "T"), card("BITPIX", "8"), card("NAXIS", "0"), *[card(k, f"'{v}'") for k, v in head]])
    cards = [card("XTENSION", "'BINTABLE'"), card("BITPIX", "8"), card("NAXIS", "2"), card("NAXIS1", str(rows.dtype.itemsize)), card("NAXIS2", str(len(rows))), card("PCOUNT", "0"), card("GCOUNT", "1"), card("TFIELDS", str(len(names))), card("EXTNAME", f"'{extname}'")]
    cards += [card(f"TTYPE{k}", f"'{n}'") for k, n in enumerate(names, 1)] + [card(f"TFORM{k}", f"'{f}'") for k, f in enumerate(forms, 1)] + [card(k, v) for k, v in more]
    data = rows.tobytes()
    return out + block(cards) + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def curve(n=12, dtype=((">f8"), (">f4"), (">f4"))):
    rows = np.zeros(n, dtype=[("TIME", dtype[0]), ("SAP_FLUX", dtype[1]), ("QUALITY", ">i4", (2,)), ("SAP_FLUX_ERR", dtype[2])])
    rows["TIME"], rows["SAP_FLUX"], rows["SAP_FLUX_ERR"] = np.arange(n) / 2, 100 + np.arange(n), 0.5
    return rows


@pytest.mark.parametrize("sign", [",", "\t", " ", ";"])
def test_delimiters_and_headers(sign):
    text = "\n".join(sign.join(r) for r in [["Time", "FLUX", "label"], *[[str(k), str(k * 2), "1"] for k in range(3)]])
    got = files.parse_text(text.encode())
    assert got["time"].tolist() == [0, 1, 2] and got["flux"].tolist() == [0, 2, 4] and got["label"].tolist() == [1, 1, 1]
    other = files.parse_text(text.replace("Time", "jd").encode())
    assert other["time"].tolist() == [0, 1, 2] and other["flux_err"].tolist() == [1, 1, 1]


def test_text_without_columns():
    with pytest.raises(ValueError):
        files.parse_text(b"a\n1\n2\n")


def test_fits_table():
    got, head = files.parse_fits(fits(["TIME", "SAP_FLUX", "QUALITY", "SAP_FLUX_ERR"], ["D", "E", "2J", "E"], curve(), head=[("OBJECT", "A star"), ("TELESCOP", "Glass")]))
    assert got["time"].tolist() == [k / 2 for k in range(12)] and got["flux"].tolist() == [100.0 + k for k in range(12)] and head == {"object_name": "A star", "telescope": "Glass", "instrument": "Unknown"}
    with pytest.raises(ValueError):
        files.parse_fits(fits(["A", "B", "C", "D"], ["D", "E", "2J", "E"], curve()))


def test_fits_scaling_and_nulls():
    rows = np.zeros(4, dtype=[("TIME", ">f8"), ("FLUX", ">i2"), ("ERROR", ">i4")])
    rows["TIME"], rows["FLUX"], rows["ERROR"] = np.arange(4), [0, 1, -99, 3], [5, 6, 7, -1]
    more = [("TSCAL2", "0.5"), ("TZERO2", "1000.0"), ("TNULL2", "-99"), ("TNULL3", "-1"), ("TSCAL1", "2.0")]
    got, _ = files.parse_fits(fits(["TIME", "FLUX", "ERROR"], ["D", "I", "J"], rows, more=more))
    assert got["time"].tolist() == [0, 2, 4, 6]
    assert np.array_equal(got["flux"], [1000, 1000.5, np.nan, 1001.5], equal_nan=True) and np.array_equal(got["flux_err"], [5, 6, 7, np.nan], equal_nan=True)


def test_names_that_clash(spark, tmp_path):
    for name in ("a/x.csv", "b/x.csv", "b/y.csv", "c.d/z.v2.csv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("time,flux\n" + "".join(f"{k},{k}\n" for k in range(15)))
    (tmp_path / "b/x.fits").write_bytes(fits(["TIME", "SAP_FLUX", "QUALITY", "SAP_FLUX_ERR"], ["D", "E", "2J", "E"], curve()))
    got = {r.series_id: r["count"] for r in files.read_curves(spark, str(tmp_path)).groupBy("series_id").count().collect()}
    assert got == {"a/x.csv": 15, "b/x.csv": 15, "b/x.fits": 12, "y": 15, "z.v2": 15}


def test_columns_by_name_and_missing_paths(spark, tmp_path):
    rows = [("a", 20.0 - k, float(k), None) for k in range(12)] + [("a", float("nan"), 1.0, None), ("b", 1.0, 2.0, 0.5)]
    df = spark.createDataFrame(rows, "star string, t double, `f.x` double, e double")
    got = files.from_columns(df, "t", "f.x", "e", "star").toPandas().sort_values("time")
    assert set(got.series_id) == {"a"} and got.time.tolist() == [float(k) for k in range(9, 21)] and got.flux.iloc[0] == 11
    assert got.flux_err.iloc[0] == pytest.approx(0.01 * np.std(np.arange(12), ddof=1))
    assert files.from_columns(df, "t", "f.x").count() == 13
    with pytest.raises(ValueError):
        files.from_columns(df, "t", "flux")
    with pytest.raises(FileNotFoundError):
        files.read_curves(spark, f"{tmp_path}/none")


def test_folder_of_curves(spark, tmp_path):
    (tmp_path / "one.CSV").write_text("time,flux\n" + "".join(f"{20 - k},{k}\n" for k in range(20)) + "inf,1\n3,nan\n")
    (tmp_path / "two.fits").write_bytes(fits(["TIME", "SAP_FLUX", "QUALITY", "SAP_FLUX_ERR"], ["D", "E", "2J", "E"], curve(), "OTHER"))
    (tmp_path / "short.csv").write_text("time,flux\n1,2\n")
    (tmp_path / "bad.fits").write_bytes(b"no table")
    (tmp_path / "picture.png").write_bytes(b"x")
    got = files.read_curves(spark, str(tmp_path)).toPandas()
    assert got.groupby("series_id").size().to_dict() == {"one": 20, "two": 12}
    one = got[got.series_id == "one"]
    assert one.flux_err.iloc[0] == pytest.approx(0.01 * np.std(np.arange(20), ddof=1)) and (got[got.series_id == "two"].flux_err == 0.5).all()
    assert sorted(r.series_id for r in files.unreadable(spark, str(tmp_path)).collect()) == ["bad", "picture"]
    raw = files.read_curves(spark, str(tmp_path), checked=False)
    assert raw.filter("series_id = 'short'").count() == 1


def test_dataset_and_results(spark, tmp_path):
    points = spark.createDataFrame([("a 1", float(k), 1.0 + k, 0.1, k % 2) for k in range(5)], "series_id string, time double, flux double, flux_err double, label int")
    metadata = spark.createDataFrame([("a 1", "transit"), ("lost", "normal")], "target_id string, label_type string")
    files.write_dataset(points, metadata, str(tmp_path / "set"))
    got, missing = files.read_dataset(spark, str(tmp_path / "set"))
    assert got.count() == 5 and set(got.columns) >= {"time", "flux", "label", "label_type"} and [r.target_id for r in missing.collect()] == ["lost"]
    files.write_results(points.withColumn("is_anomaly", F.col("label") == 1), str(tmp_path / "results"))
    assert spark.read.option("header", True).csv(str(tmp_path / "results")).columns == ["time", "flux", "flux_err", "is_anomaly"]
    files.write_json(metadata, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_latex():
    got = files.latex_table([{"model": "a_b", "f1_mean": 0.5, "f1_std": 0.1}, {"model": "c", "f1_mean": float("nan"), "f1_std": None}], ["f1"], "Models")
    assert r"a\_b & \textbf{0.500 $\pm$ 0.100} \\" in got and r"c & -- \\" in got
