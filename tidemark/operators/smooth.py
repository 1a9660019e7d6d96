"""Gap filling, differences, running means and polynomial smoothing, all by windows over a series' points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .clean import by_part, index_points, normalize, own_only, series, sigma_clip


def _indexed(df: DataFrame) -> DataFrame:
    return df if "idx" in df.columns else index_points(df)


def fill_gaps(df: DataFrame, max_gap: float | None = None, limit: int = 5, cols: tuple[str, ...] = ("flux",)) -> DataFrame:
    """Nulls as the straight line by position between the values around them, at most `limit` after the last value; after the
    series' last value, that value. Leading nulls stay. With max_gap, series whose steps in time are all under it stay as they are. No rows are added.
    A part's last nulls take the first value of the parts after it."""
    points, parts = by_part(_indexed(df), limit)
    order = parts.orderBy("idx")
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    long = "__own" in points.columns
    # The next value by one look ahead: a frame up to the end would be read again for every point.
    ahead = F.expr(f"lead(__at, 1) ignore nulls over (partition by series_id{', __in' if long else ''} order by idx)")
    if max_gap is None:
        points = points.withColumn("__fill", F.lit(True))
    else:
        points = points.withColumn("__dt", F.col("time") - F.lag("time").over(order))
        if long:
            widest = own_only(points).groupBy("series_id").agg(F.max("__dt").alias("__widest"))
            points = points.join(widest, "series_id").withColumn("__fill", F.coalesce(F.col("__widest") >= max_gap, F.lit(False))).drop("__dt", "__widest")
        else:
            points = points.withColumn("__fill", F.coalesce(F.max("__dt").over(series()) >= max_gap, F.lit(False))).drop("__dt")
    for c in cols:
        at = F.when(F.col(c).isNotNull(), F.struct("idx", F.col(c).alias("v")))
        points = points.withColumn("__at", at).withColumn("__a", F.last("__at", ignorenulls=True).over(back)).withColumn("__b", ahead)
        if long:
            later = Window.partitionBy("series_id").orderBy("__in").rowsBetween(1, Window.unboundedFollowing)
            firsts = points.filter("__own").groupBy("series_id", "__in").agg(F.min(at).alias("__f"))
            points = points.join(firsts.select("series_id", "__in", F.first("__f", ignorenulls=True).over(later).alias("__later")), ["series_id", "__in"], "left").withColumn("__b", F.coalesce("__b", "__later")).drop("__later")
        run = F.col("idx") - F.col("__a.idx")
        line = F.col("__a.v") + F.coalesce((F.col("__b.v") - F.col("__a.v")) * run / (F.col("__b.idx") - F.col("__a.idx")), F.lit(0.0))
        points = points.withColumn(c, F.when(F.col(c).isNull() & F.col("__fill") & (run <= limit), line).otherwise(F.col(c)))
    return own_only(points.drop("__at", "__a", "__b", "__fill"))


def preprocess(df: DataFrame, sigma: float = 5.0, max_gap: float | None = None) -> DataFrame:
    """Clip, normalise, fill."""
    return fill_gaps(normalize(sigma_clip(df, sigma)), max_gap)


def differences(df: DataFrame) -> DataFrame:
    """diff: flux less the flux before; null at a series' start."""
    points, parts = by_part(_indexed(df), 1)
    return own_only(points.withColumn("diff", F.col("flux") - F.lag("flux").over(parts.orderBy("idx"))))


def running_mean(df: DataFrame, most: int = 50, share: int = 10) -> DataFrame:
    """running_mean over least(most, n // share) points around each (an even window has one more before it); null where it is not full.

    Series of most x share points and more have one width and take a frame of that many rows. In shorter ones widths differ, so sums are taken
    from running totals, over few points.
    """
    points, parts = by_part(_indexed(df), most)
    order = parts.orderBy("idx")
    points = points.withColumn("__w", F.least(F.lit(most), F.floor(F.col("n") / share)).cast("int"))
    short = F.col("__w") < most
    frame = F.sum("flux").over(order.rowsBetween(-(most // 2), most - 1 - most // 2))
    points = points.withColumn("__sum", F.sum(F.when(short, F.col("flux"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.col("idx") - F.floor(F.col("__w") / 2), F.col("idx") + F.col("__w") - 1 - F.floor(F.col("__w") / 2)
    # Sums at the window's two ends stand at most `most` rows away.
    near = F.collect_list(F.when(short, F.struct("idx", "__sum"))).over(order.rowsBetween(-most, most))
    at = lambda place: F.get(F.filter("__near", lambda x: x["idx"] == place), F.lit(0))["__sum"]
    total = F.when(short, at(last) - F.when(first == 0, 0.0).otherwise(at(first - 1))).otherwise(F.col("__frame"))
    full = (F.col("__w") > 0) & (first >= 0) & (last < F.col("n"))
    return own_only(points.withColumn("__near", near).withColumn("__frame", frame).withColumn("running_mean", F.when(full, total / F.col("__w"))).drop("__w", "__sum", "__near", "__frame"))


def _cubic(near: Column, centre: Column, m: Column, u: Column) -> Column:
    """The cubic least-squares value at place u of the 2 m + 1 places around centre, from four sums over the points near (idx, flux)
    and orthogonal polynomials."""
    zero = F.struct(*[F.lit(0.0).alias(f"s{k}") for k in range(4)])

    def add(t: Column, x: Column) -> Column:
        v = (x["idx"] - centre).cast("double")
        inside = F.when(F.abs(v) <= m, x["flux"]).otherwise(0.0)
        return F.struct((t["s0"] + inside).alias("s0"), (t["s1"] + inside * v).alias("s1"), (t["s2"] + inside * v * v).alias("s2"), (t["s3"] + inside * v * v * v).alias("s3"))

    two, three, odd = m * (m + 1) / 3, (3 * m * m + 3 * m - 1) / 5, 2 * m + 1
    norms = [odd, m * (m + 1) * odd / 3, m * (m + 1) * (2 * m - 1) * odd * (2 * m + 3) / 45, (m - 1) * m * (m + 1) * (m + 2) * (2 * m - 1) * odd * (2 * m + 3) / 175]
    places = [F.lit(1.0), u, u * u - two, u * u * u - u * three]
    sums = lambda t: [t["s0"], t["s1"], t["s2"] - two * t["s0"], t["s3"] - three * t["s1"]]
    return F.aggregate(near, zero, add, lambda t: sum((s * p / n for s, p, n in zip(sums(t), places, norms, strict=True)), F.lit(0.0)))


def savgol(df: DataFrame, length: int = 21) -> DataFrame:
    """smooth: cubic Savitzky-Golay. Points within half a window of an end take the polynomial of the outermost window. Series
    shorter than the window take the greatest odd length they have; those under five points stay as they are.

    Inner points are one weighted sum of their window, with weights that are the same everywhere; only points near an end gather theirs."""
    half = length // 2
    points, parts = by_part(_indexed(df), length - 1)
    order = parts.orderBy("idx")
    size = F.when(F.col("n") >= length, F.lit(length)).otherwise(F.col("n") - F.when(F.col("n") % 2 == 0, 1).otherwise(0))
    points = points.withColumn("__m", ((size - 1) / 2).cast("int")).withColumn("__low", F.greatest(F.lit(0), F.least(F.col("idx") - F.col("__m"), F.col("n") - 2 * F.col("__m") - 1)).cast("long"))
    inner = (F.col("idx") >= half) & (F.col("idx") < F.col("n") - half)
    outer = (F.col("idx") < length) | (F.col("idx") >= F.col("n") - length)
    near = F.collect_list(F.when(outer, F.struct("idx", "flux"))).over(order.rowsBetween(1 - length, length - 1))
    norm = (2 * half + 1) * (2 * half - 1) * (2 * half + 3) / 3
    weight = lambda k: (3 * half * half + 3 * half - 1 - 5 * k * k) / norm  # noqa: E731  the cubic fit's value at the centre
    flux = lambda k: F.lead("flux", k).over(order) if k > 0 else F.lag("flux", -k).over(order) if k < 0 else F.col("flux")
    middle = sum((weight(k) * flux(k) for k in range(-half, half + 1)), F.lit(0.0))
    m, centre = F.col("__m").cast("double"), F.col("__low") + F.col("__m")
    value = _cubic(F.col("__near"), centre, m, (F.col("idx") - centre).cast("double"))
    smooth = F.when(inner & (F.col("n") >= length), F.col("__middle")).when(F.col("__m") >= 2, value).otherwise(F.col("flux"))
    return own_only(points.withColumn("__near", near).withColumn("__middle", middle).withColumn("smooth", smooth).drop("__m", "__low", "__near", "__middle"))


def sequences(windows: DataFrame, columns: list[str], length: int = 10) -> DataFrame:
    """series_id, start, rows: every run of `length` windows, in order; a series with fewer is one run, filled up with zeros."""
    order = series().orderBy("window_id")
    row = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    at = windows.withColumn("start", F.row_number().over(order) - 1).withColumn("__n", F.count("*").over(series())).withColumn("rows", F.collect_list(row).over(order.rowsBetween(0, length - 1)))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), len(columns)), F.lit(length) - F.size("rows"))
    return at.filter((F.col("start") == 0) | (F.col("start") + length <= F.col("__n"))).select("series_id", "start", F.concat("rows", zeros).alias("rows"))


def sequence_scores(errors: DataFrame, windows: DataFrame, length: int = 10) -> DataFrame:
    """series_id, place, score: for each window (by place in its series) the mean error of the runs that cover it, negated; errors: series_id, start, error."""
    place = windows.select("series_id", (F.row_number().over(series().orderBy("window_id")) - 1).alias("place"))
    covered = errors.select("series_id", "error", F.explode(F.sequence(F.col("start"), F.col("start") + length - 1)).alias("place"))
    means = covered.groupBy("series_id", "place").agg(F.avg("error").alias("mean"))
    return place.join(means, ["series_id", "place"], "left").select("series_id", "place", (-F.coalesce("mean", F.lit(0.0))).alias("score"))
