"""Rasters as pixel tables ``(raster_id, r, c, value...)``; null is nodata."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence
from types import ModuleType

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.scale import exact_stats, first_per, sent
from geoloom.session import cut_lineage

KEY = "raster_id"


def ndvi(red: Column, nir: Column) -> Column:
    """F14. Null where the sum is not positive."""
    return F.when(nir + red > 0, (nir - red) / (nir + red))


def raster_profile(px: DataFrame, value: str, nodata: float | None = None, bands: Sequence[str] | None = None, geo: DataFrame | None = None,
                   overviews: DataFrame | None = None) -> DataFrame:
    """A7. Size, type, nodata, bands and value range per raster; bounds and resolution where ``geo`` has its corner and pixel size.

    ``geo``: ``raster_id west north dx dy`` in degrees. ``overviews``: a
    pyramid's ``raster_id level``; a raster with a level above 0 is cloud
    optimised (``is_cog``), and its format is ``cog`` instead of ``geotiff``.
    """
    names = list(bands or [value])
    v = F.col(value)
    valid = v if nodata is None else F.when(v != nodata, v)
    got = px.groupBy(KEY).agg(
        (F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"),
        F.count(F.lit(1)).alias("n_pixels"), F.count(valid).alias("n_valid"),
        F.min(valid).alias("min_value"), F.max(valid).alias("max_value"),
    ).withColumns({"bands": F.lit(len(names)), "band_names": F.lit(",".join(names)), "dtype": F.lit(px.schema[value].dataType.simpleString()),
                   "nodata": F.lit(nodata).cast("double")})
    if overviews is not None:
        seen = overviews.groupBy(KEY).agg((F.max("level") > 0).alias("is_cog"))
        got = got.join(seen, KEY, "left").withColumn("is_cog", F.coalesce("is_cog", F.lit(False)))
        got = got.withColumn("format", F.when(F.col("is_cog"), "cog").otherwise("geotiff"))
    if geo is None:
        return got
    return (got.join(geo.select(KEY, "west", "north", "dx", "dy"), KEY)
            .withColumns({"east": F.col("west") + F.col("width") * F.col("dx"), "south": F.col("north") - F.col("height") * F.col("dy")})
            .withColumnsRenamed({"dx": "res_x", "dy": "res_y"}))


def raster_size(px: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    return px.groupBy(*keys).agg((F.max("r") + 1).cast("int").alias("height"),
                                 (F.max("c") + 1).cast("int").alias("width"))


def valid_pixels(px: DataFrame, bands: Sequence[str], nodata: float | None = None) -> DataFrame:
    """B5. Drop a pixel if a band is close to nodata; without a nodata value, if a
    band is NaN or missing or all bands are 0."""
    arr = F.array(*[F.col(b).cast("double") for b in bands])
    if nodata is not None:
        tol = 1e-8 + 1e-5 * abs(nodata)
        return px.where(~F.coalesce(F.exists(arr, lambda x: F.abs(x - nodata) <= tol), F.lit(True)))
    gone = F.exists(arr, lambda x: x.isNull() | F.isnan(x)) | F.forall(arr, lambda x: x == 0)
    return px.where(~gone)


def reflectance_checks(px: DataFrame, keys: Sequence[str], bands: Sequence[str],
                       low: float = -1100.0, high: float = 40000.0) -> DataFrame:
    """B6. The first failed input rule per raster, or ``ok``."""
    cols = [F.col(b).cast("double") for b in bands]

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    fine = [F.when(~bad(x), x) for x in cols]
    n_bad = sum((F.sum(bad(x).cast("bigint")) for x in cols[1:]), F.sum(bad(cols[0]).cast("bigint")))
    out = px.groupBy(*keys).agg(
        n_bad.alias("n_bad"),
        F.min(F.least(*fine) if len(fine) > 1 else fine[0]).alias("vmin"),
        F.max(F.greatest(*fine) if len(fine) > 1 else fine[0]).alias("vmax"),
    )
    return out.withColumn("status",
        F.when(F.col("n_bad") > 0, "non_finite")
        .when((F.col("vmin") < low) | (F.col("vmax") > high), "outside_dn_range")
        .when(F.col("vmax") < 1e-3, "all_zero")
        .when(F.col("vmax") < 1.5, "pre_normalized").otherwise("ok"))


def decode_classes(counts: DataFrame, classes: DataFrame, on: str) -> DataFrame:
    """C4. Names and colours of known codes; unknown codes are dropped."""
    return counts.join(classes, on)


def with_legend(px: DataFrame, legend: DataFrame, on: str = "class_id", grey: str = "#888888",
                num_classes: int | None = None) -> DataFrame:
    """C5. Legend columns, with a grey and a ``class_i`` name where it has none.

    With ``num_classes`` a legend of any other length is not trusted and left out.
    """
    if num_classes is not None:
        size = legend.agg(F.count(F.lit(1)).alias("n")).scalar()
        legend = legend.where(size == num_classes)
    return (px.join(legend, on, "left")
            .withColumn("color", F.coalesce("color", F.lit(grey)))
            .withColumn("name", F.coalesce("name", F.concat(F.lit("class_"), F.col(on)))))


def source_index(i: Column, src: Column, dst: Column | int) -> Column:
    """E6. Index into an axis of ``src`` cells for cell ``i`` of ``dst``."""
    return F.least(F.greatest(F.floor(i * src / dst), F.lit(0)), src - 1).cast("int")


def resample_nearest(px: DataFrame, height: int, width: int) -> DataFrame:
    """E6. Every raster at ``height x width``, each cell from its source pixel."""
    # every source pixel knows which target cells read it, so no grid join is needed
    def targets(i: str, src: str, dst: int) -> Column:
        lo = F.ceil(F.col(i) * dst / F.col(src)).cast("int")
        hi = (F.ceil((F.col(i) + 1) * dst / F.col(src)) - 1).cast("int")
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    sized = px.join(raster_size(px), KEY)
    rest = [x for x in px.columns if x not in ("r", "c")]
    return (sized.select(*rest, "c", "width", F.explode(targets("r", "height", height)).alias("_r"))
            .select(*rest, F.col("_r").alias("r"), F.explode(targets("c", "width", width)).alias("c")))


def upsample(px: DataFrame, k: int) -> DataFrame:
    """E7. Every patch as ``k x k`` pixels."""
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    return (px.withColumn("_dr", F.explode(steps)).withColumn("_dc", F.explode(steps))
            .withColumn("r", F.col("r") * k + F.col("_dr")).withColumn("c", F.col("c") * k + F.col("_dc"))
            .drop("_dr", "_dc"))


def window_grid(px: DataFrame, keys: Sequence[str], bands: Sequence[str], win: int) -> DataFrame:
    """E10. Whole windows only; all-zero windows are marked; a raster with none left is an error."""
    size = raster_size(px, keys)
    top = F.greatest(*[F.abs(F.col(b)) for b in bands]) if len(bands) > 1 else F.abs(F.col(bands[0]))
    # the window maximum is combined before the shuffle
    wins = (px.withColumn("wr", F.floor(F.col("r") / win).cast("int"))
            .withColumn("wc", F.floor(F.col("c") / win).cast("int"))
            .groupBy(*keys, "wr", "wc").agg(F.max(top).alias("vmax"), F.count(F.lit(1)).alias("n_pixels"))
            .join(size, list(keys))
            .where(((F.col("wr") + 1) * win <= F.col("height")) & ((F.col("wc") + 1) * win <= F.col("width"))))
    return wins.select(*keys, "wr", "wc", "n_pixels", (F.col("vmax") == 0).alias("skipped"))


def window_status(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """E10. Per raster: windows, skipped windows and an error when all are skipped."""
    return (windows.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_windows"), F.count_if("skipped").alias("n_skipped"))
            .withColumn("status", F.when(F.col("n_windows") == F.col("n_skipped"), "all_windows_empty")
                        .otherwise("ok")))


def _loaded(name: str, load):
    """What ``load`` gives, made once per worker and name; the worker's module table outlives a task."""
    held = sys.modules.setdefault("geoloom_models", ModuleType("geoloom_models")).__dict__
    if name not in held:
        held[name] = load()
    return held[name]


def score_windows(px: DataFrame, keys: Sequence[str], win: int, scorer, schema: str, batch: int = 8, load=None) -> DataFrame:
    """K19. Run a model over every window, many windows at a time.

    ``scorer`` takes a pandas frame with the pixels of up to ``batch * batch``
    windows, told apart by ``wr`` and ``wc``, and gives one row per window. As
    ``(r, c)`` is unique within a raster, a call sees at most
    ``(batch * win) ** 2`` pixels, whatever the size of the raster. A model that
    is dear to make is given as ``load``, a function that makes the scorer on
    the worker; ``scorer`` is then the name it is kept under, and each worker makes it once.
    """
    tagged = (px.withColumn("wr", F.floor(F.col("r") / win).cast("int"))
              .withColumn("wc", F.floor(F.col("c") / win).cast("int")))

    # Spark counts the arguments of a function, which an object with __call__ is not
    def run(pdf):
        return (scorer if load is None else _loaded(scorer, load))(pdf)

    return tagged.groupBy(*keys, F.floor(F.col("wr") / batch).alias("_br"), F.floor(F.col("wc") / batch).alias("_bc")).applyInPandas(run, schema)


def score_windows_linear(px: DataFrame, keys: Sequence[str], win: int, bands: Sequence[str], weights: Sequence[Sequence[float]],
                         bias: Sequence[float]) -> DataFrame:
    """K19 for a linear head over mean-pooled bands: ``class_id score`` of the best row of the head per window.

    Means are combined before the shuffle and the head is an expression (F11),
    so no pixel leaves the JVM. Ties go to the lower class.
    """
    from geoloom.functions.vector import argmax, linear_head

    means = (px.withColumn("wr", F.floor(F.col("r") / win).cast("int")).withColumn("wc", F.floor(F.col("c") / win).cast("int"))
             .groupBy(*keys, "wr", "wc").agg(*[F.avg(b).alias(b) for b in bands]))
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in weights])
    scored = means.withColumn("_s", linear_head(F.array(*[F.col(b) for b in bands]), rows, F.array(*[F.lit(float(x)) for x in bias])))
    return scored.select(*keys, "wr", "wc", argmax(F.col("_s")).cast("int").alias("class_id"), F.array_max("_s").alias("score"))


def land_cover(px: DataFrame, classes: DataFrame, year: int = 2021, fallback: int = 2020) -> DataFrame:
    """D1. Percent per known class of all pixels that are not 0, from the wanted
    year, or from the fallback year for areas that lack it."""
    counts = (px.where((F.col("code") != 0) & F.col("year").isin(year, fallback))
              .groupBy("aoi_id", "year", "code").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("aoi_id", "year").agg(F.sum("n").alias("total"))
    items = px.where(F.col("year") == year).select("aoi_id").distinct()
    have = items.withColumn("_has", F.lit(True))
    pick = totals.join(have, "aoi_id", "left").where(
        (F.col("year") == year) | F.col("_has").isNull()).drop("_has")
    return (decode_classes(counts.join(pick, ["aoi_id", "year"]), classes, "code")
            .withColumn("percent", F.round(F.col("n") / F.col("total") * 100, 1)))


def class_histogram(px: DataFrame, num_classes: int, top_n: int | None = None) -> DataFrame:
    """D2, G5. Classes by pixel count with rank and percent; ids outside the range do not count."""
    counts = (px.where((F.col("class_id") >= 0) & (F.col("class_id") < num_classes))
              .groupBy(KEY, "class_id").agg(F.count(F.lit(1)).alias("n_pixels")))
    totals = counts.groupBy(KEY).agg(F.sum("n_pixels").alias("total_pixels"),
                                     F.count(F.lit(1)).alias("n_present"))
    ranked = first_per(counts, [KEY], [F.desc("n_pixels"), F.asc("class_id")],
                       top_n or num_classes, rank="rank")
    return (ranked.join(totals, KEY)
            .withColumn("percent", F.round(F.col("n_pixels") / F.col("total_pixels") * 100, 2)))


def scalar_stats(px: DataFrame, value: str, value_range: tuple[float, float] | None = None,
                 digits: int = 3) -> DataFrame:
    """D3. Count, mean, extremes and deciles, scaled back to the unit range when one is given."""
    got = exact_stats(px, [KEY], value, {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    lo, hi = value_range or (0.0, 1.0)
    return got.select(KEY, F.col("n").alias("valid_pixels"), *[
        F.round(F.col(x) * (hi - lo) + lo, digits).alias(x)
        for x in ("mean", "min", "max", "p10", "p50", "p90")])


def month_spine(aois: DataFrame, anchor: Column, months: int) -> DataFrame:
    """The last whole months before the anchor's month, one row per area and month."""
    n = max(1, months)
    first = F.trunc(anchor, "month")
    return aois.withColumn("month", F.explode(
        F.sequence(F.add_months(first, -n), F.add_months(first, -1), F.expr("interval 1 month"))))


_SERIES = {"ndvi_median": 0.5, "ndvi_p10": 0.1, "ndvi_p90": 0.9}


def _series(px: DataFrame, scenes: DataFrame, spine: DataFrame, max_cloud: float,
            mask: Callable[[DataFrame], DataFrame] | None, empty: str, totals: bool = False) -> DataFrame:
    """``mask`` adds ``in_class`` to the pixels of the chosen scenes; only those are masked and read again."""
    best = first_per(scenes, ["aoi_id", "month"], [F.asc("cloud_cover"), F.asc("scene_id")])
    base = cut_lineage(spine.join(best, ["aoi_id", "month"], "left"))
    usable = sent(base.where(F.col("cloud_cover") <= max_cloud).select("aoi_id", "month", "scene_id"), 64)
    seen = px.join(usable, ["aoi_id", "month", "scene_id"])
    keep = F.lit(True) if mask is None else F.col("in_class")
    value = (seen if mask is None else mask(seen)).select("aoi_id", "month", F.when(
        keep & (F.col("b04") > 0) & (F.col("b08") > 0), ndvi(F.col("b04"), F.col("b08"))).alias("ndvi"))
    # three columns of the chosen scenes, written because the passes below read them several times
    value = cut_lineage(value)
    stats = exact_stats(value, ["aoi_id", "month"], "ndvi", _SERIES).withColumnsRenamed(
        {"n": "n_pixels", "mean": "ndvi_mean"}).drop("min", "max")
    out = base.join(stats, ["aoi_id", "month"], "left")
    if totals:
        n = value.groupBy("aoi_id", "month").agg(F.count(F.lit(1)).alias("total_pixels"))
        out = out.join(n, ["aoi_id", "month"], "left").withColumn(
            "total_pixels", F.coalesce("total_pixels", F.lit(0)).cast("bigint"))
    hazy = F.format_string(f"scene cloud cover %.1f%% exceeds {max_cloud:.0f}%% threshold", F.col("cloud_cover"))
    return (out.withColumn("status",
                           F.when(F.col("scene_id").isNull(), "no_scene")
                           .when(F.col("cloud_cover") > max_cloud, "too_cloudy")
                           .when(F.col("n_pixels").isNull(), empty).otherwise("ok"))
            .withColumn("detail", F.when(F.col("status") == "no_scene", "no scene in this month")
                        .when(F.col("status") == "too_cloudy", hazy)
                        .when(F.col("status") == "no_class_pixels", "no pixel of the chosen classes this month"))
            .withColumn("n_pixels", F.coalesce("n_pixels", F.lit(0)).cast("bigint")))


def ndvi_timeseries(px: DataFrame, scenes: DataFrame, aois: DataFrame, anchor: Column,
                    months: int = 12, max_cloud: float = 40.0) -> DataFrame:
    """D4. Vegetation statistics of the least cloudy scene per area and month.

    Every month of the spine comes back, with a status instead of numbers
    where there is no scene, too much cloud or no valid pixel.
    """
    spine = month_spine(aois, anchor, months)
    return _series(px, scenes, spine, max_cloud, None, "empty")


def mask_by_class(px: DataFrame, class_px: DataFrame, keep: Sequence[int], height: int, width: int) -> DataFrame:
    """C6. Mark the pixels whose nearest class-raster cell holds a wanted class.

    The class raster is resampled by index arithmetic, so this is an equi-join
    on ``(raster_id, r, c)``, and only the wanted cells take part.
    """
    size = raster_size(class_px)
    cells = (class_px.where(F.col("class_id").isin(list(keep)))
             .select(KEY, F.col("r").alias("_cr"), F.col("c").alias("_cc")).distinct().withColumn("_in", F.lit(True)))
    at = (px.join(size, KEY, "left")
          .withColumn("_cr", source_index(F.col("r"), F.col("height"), height))
          .withColumn("_cc", source_index(F.col("c"), F.col("width"), width)))
    return (at.join(cells, [KEY, "_cr", "_cc"], "left")
            .withColumn("in_class", F.coalesce("_in", F.lit(False)))
            .drop("_cr", "_cc", "_in", "height", "width"))


def ndvi_masked(px: DataFrame, class_px: DataFrame, scenes: DataFrame, aois: DataFrame, anchor: Column,
                keep: Sequence[int], grid: tuple[int, int], months: int = 12, max_cloud: float = 40.0) -> DataFrame:
    """D5. D4 over the pixels of chosen classes of the area's class raster."""
    def mask(seen: DataFrame) -> DataFrame:
        return mask_by_class(seen.withColumn(KEY, F.col("aoi_id")), class_px, keep, *grid).drop(KEY)

    spine = month_spine(aois, anchor, months)
    return _series(px, scenes, spine, max_cloud, mask, "no_class_pixels", totals=True)


def timeseries_summary(ts: DataFrame) -> DataFrame:
    """D6."""
    def n(s: str) -> Column:
        return F.count_if(F.col("status") == s)

    return (ts.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("months_requested"), n("ok").alias("months_with_data"),
                                     n("too_cloudy").alias("months_too_cloudy"), n("no_scene").alias("months_no_scene"))
            .withColumn("status", F.when(F.col("months_with_data") > 0, "ok").otherwise("empty")))


def present_classes(px: DataFrame, limit: int | None = None) -> DataFrame:
    """D16. Sorted distinct valid ids per raster; the first ``limit`` where one is given."""
    ids = px.where(F.col("class_id") >= 0).select(KEY, "class_id").distinct()
    return ((ids if limit is None else first_per(ids, [KEY], [F.asc("class_id")], limit))
            .groupBy(KEY).agg(F.array_sort(F.collect_list("class_id")).alias("class_ids")))


def class_rows(classes: DataFrame, scores: DataFrame, by: str = "score") -> DataFrame:
    """D28. Every legend class with its score, present ones first, in display order."""
    rows = classes.join(scores, "class_id", "left").withColumn("present", F.col("score").isNotNull())
    order = [F.desc("present"), F.desc_nulls_last("score") if by == "score" else F.asc("name"), F.asc("class_id")]
    return rows.orderBy(*order)


def band_stretch_bounds(px: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """D22. 2nd and 98th percentile per raster and band; a flat band gets ``hi = lo + 1``.

    All bands go through one pass as rows, and every valid pixel counts.
    """
    long = px.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in bands])))
    got = exact_stats(long.where(F.col("v") != 0), [*keys, "band"], "v", {"lo": 0.02, "hi": 0.98})
    return got.select(*keys, "band", "lo",
                      F.when(F.col("hi") - F.col("lo") < 1e-9, F.col("lo") + 1).otherwise(F.col("hi")).alias("hi"))


def regression_mean(px: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    """D23. Mean prediction per raster and the mean of the values scaled to the unit range."""
    v = F.col(value)
    unit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - lo) / (hi - lo)))
    return px.groupBy(KEY).agg(F.avg(v).alias("prediction"), F.avg(unit).alias("unit_mean"))


def raster_patch(px: DataFrame, boxes: DataFrame, value: str, size: int) -> DataFrame:
    """A22. Each box as a ``size x size`` patch: nearest pixel, 0 outside the raster,
    2/98 stretch to 0..255. ``boxes`` holds ``raster_id r0 c0 r1 c1`` in pixels."""
    steps = F.sequence(F.lit(0), F.lit(size - 1))

    def src(i: str, lo: str, hi: str) -> Column:
        return (F.col(lo) + F.floor((F.col(i) + 0.5) * (F.col(hi) - F.col(lo)) / size)).cast("int")

    grid = (boxes.withColumn("pr", F.explode(steps)).withColumn("pc", F.explode(steps))
            .withColumn("r", src("pr", "r0", "r1")).withColumn("c", src("pc", "c0", "c1"))
            .select(KEY, "pr", "pc", "r", "c"))
    cells = (grid.join(px.select(KEY, "r", "c", F.col(value).cast("double").alias("v")), [KEY, "r", "c"], "left")
             .withColumn("v", F.coalesce("v", F.lit(0.0))))
    bounds = exact_stats(cells, [KEY], "v", {"lo": 0.02, "hi": 0.98}).select(KEY, "lo", "hi")
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    scaled = F.least(F.lit(255.0), F.greatest(F.lit(0.0), (v - lo) * 255 / (hi - lo)))
    return (cells.join(bounds, KEY)
            .select(KEY, "pr", "pc", F.when(hi > lo, scaled).otherwise(v).cast("int").alias("level")))


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    x = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    return w / w.sum()


def smooth_raster(px: DataFrame, values: Sequence[str], sigma: float = 1.5, block: int = 256) -> DataFrame:
    """G6. Gaussian blur per value column; nodata counts as 0 and stays null.

    Pixels go to their block and to the neighbours whose margin they are in, so
    one shuffle serves both axes and a task holds one block, whatever the
    size of the raster. Edges mirror, as the margin never passes the edge block.
    """
    if sigma <= 0:
        return px
    kernel = gaussian_kernel(sigma)
    rad = len(kernel) // 2
    block = max(block, rad)
    values = list(values)

    def spread(i: str, n: str) -> Column:
        last = F.floor((F.col(n) - 1) / block)
        lo = F.greatest(F.lit(0), F.floor((F.col(i) - rad) / block))
        return F.sequence(lo, F.least(last, F.floor((F.col(i) + rad) / block)))

    placed = (px.select(KEY, "r", "c", *[F.col(v).cast("double").alias(v) for v in values])
              .join(raster_size(px), KEY)
              .withColumn("_br", F.explode(spread("r", "height")))
              .withColumn("_bc", F.explode(spread("c", "width"))))

    def blur(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
        r0, c0 = int(pdf["_br"].iloc[0]) * block, int(pdf["_bc"].iloc[0]) * block
        r1, c1 = min(h, r0 + block), min(w, c0 + block)
        ra, rb, ca, cb = max(0, r0 - rad), min(h, r1 + rad), max(0, c0 - rad), min(w, c1 + rad)
        rr, cc = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        own = (rr >= r0) & (rr < r1) & (cc >= c0) & (cc < c1)
        out = pdf.loc[own, [KEY, "r", "c"]].copy()
        pad = ((rad - (r0 - ra), rad - (rb - r1)), (rad - (c0 - ca), rad - (cb - c1)))
        for name in values:
            grid = np.zeros((rb - ra, cb - ca))
            raw = pdf[name].to_numpy(dtype=float)
            grid[rr - ra, cc - ca] = np.nan_to_num(raw)
            big = np.pad(grid, pad, mode="symmetric")
            rows = sum(k * big[i:i + r1 - r0, :] for i, k in enumerate(kernel))
            done = sum(k * rows[:, i:i + c1 - c0] for i, k in enumerate(kernel))
            got = done[rr[own] - r0, cc[own] - c0]
            out[name] = np.where(np.isnan(raw[own]), np.nan, got)
        return out

    schema = f"{KEY} int, r int, c int, " + ", ".join(f"{v} double" for v in values)
    done = placed.groupBy(KEY, "_br", "_bc").applyInPandas(blur, schema)
    return done.select(KEY, "r", "c", *[F.nanvl(v, F.lit(None).cast("double")).alias(v) for v in values])


def stitch(chunks: DataFrame, grid: DataFrame, gsd: float) -> DataFrame:
    """I1. Chunk rasters pasted by whole-pixel offsets; clipped to the grid; a later chunk wins.

    Only pixels where the extents of two chunks meet are shuffled; the others
    stay where they are. A chunk has each of its pixels once.

    ``chunks``: ``raster_id chunk_id top left r c value``; ``grid``: ``raster_id top left height width``.
    """
    g = grid.select(KEY, F.col("top").alias("_gt"), F.col("left").alias("_gl"), "height", "width")
    moved = (chunks.join(g, KEY)
             .withColumn("r", (F.col("r") + F.bround((F.col("_gt") - F.col("top")) / gsd)).cast("int"))
             .withColumn("c", (F.col("c") + F.bround((F.col("left") - F.col("_gl")) / gsd)).cast("int"))
             .where((F.col("r") >= 0) & (F.col("r") < F.col("height"))
                    & (F.col("c") >= 0) & (F.col("c") < F.col("width"))))
    moved = moved.select(KEY, "chunk_id", "r", "c", "value")
    boxes = overlap_boxes(moved)
    at = F.exists("_boxes", lambda b: F.col("r").between(b["r0"], b["r1"]) & F.col("c").between(b["c0"], b["c1"]))
    marked = moved.join(boxes, [KEY, "chunk_id"], "left").withColumn("_shared", F.coalesce(at, F.lit(False)))
    alone = marked.where(~F.col("_shared")).select(KEY, "r", "c", "value", "chunk_id")
    shared = marked.where("_shared").groupBy(KEY, "r", "c").agg(F.max_by("value", "chunk_id").alias("value"), F.max("chunk_id").alias("chunk_id"))
    return alone.unionByName(shared)


def overlap_boxes(px: DataFrame, cell: int = 1024) -> DataFrame:
    """``raster_id chunk_id _boxes``: where a chunk's extent meets those of others, so that only these pixels need settling.

    Extents are one row per chunk. They meet on cells of ``cell`` pixels, which
    bounds the pairs looked at by the neighbours of a chunk.
    """
    ext = px.groupBy(KEY, "chunk_id").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    steps = [F.explode(F.sequence(F.floor(F.col(f"{i}0") / cell), F.floor(F.col(f"{i}1") / cell))).alias(f"_{i}") for i in "rc"]
    placed = ext.select("*", steps[0]).select("*", steps[1])
    other = placed.select(KEY, "_r", "_c", *[F.col(x).alias(f"o_{x}") for x in ("chunk_id", "r0", "r1", "c0", "c1")])
    box = F.struct(F.greatest("r0", "o_r0").alias("r0"), F.least("r1", "o_r1").alias("r1"), F.greatest("c0", "o_c0").alias("c0"), F.least("c1", "o_c1").alias("c1"))
    met = placed.join(other, [KEY, "_r", "_c"]).where(F.col("chunk_id") != F.col("o_chunk_id")).withColumn("b", box)
    met = met.where((F.col("b.r0") <= F.col("b.r1")) & (F.col("b.c0") <= F.col("b.c1")))
    return met.groupBy(KEY, "chunk_id").agg(F.collect_set("b").alias("_boxes"))


def tile_cells(geo: DataFrame, zoom: int, tile_px: int, *also: str) -> DataFrame:
    """The pixels ``z x y py px`` of all tiles over the rasters of ``geo``, each with the raster's nearest ``r c``, null if ``outside``."""
    from geoloom.functions.geo import lonlat_to_rc, lonlat_to_tile

    n = 2.0 ** zoom
    lt = lonlat_to_tile("west", "north", zoom)
    rb = lonlat_to_tile(F.col("west") + F.col("dx") * F.col("width"),
                        F.col("north") - F.col("dy") * F.col("height"), zoom)
    steps = F.sequence(F.lit(0), F.lit(tile_px - 1))
    tiles = (geo.withColumn("x", F.explode(F.sequence(lt["x"], rb["x"]))).withColumn("y", F.explode(F.sequence(lt["y"], rb["y"])))
             .repartition(KEY, "x", "y"))
    return (tiles.withColumn("py", F.explode(steps)).withColumn("px", F.explode(steps))
            .withColumn("_lon", (F.col("x") + (F.col("px") + 0.5) / tile_px) / n * 360 - 180)
            .withColumn("_lat", F.degrees(F.atan(F.sinh(
                math.pi * (1 - 2 * (F.col("y") + (F.col("py") + 0.5) / tile_px) / n)))))
            # pixel centres carry whole row and column numbers
            .withColumn("_at", lonlat_to_rc(
                "_lon", "_lat", F.col("west") + F.col("dx") / 2, F.col("north") - F.col("dy") / 2,
                "dx", "dy", "height", "width"))
            .select(KEY, F.lit(zoom).alias("z"), "x", "y", "py", "px", *also, F.col("_at.outside").alias("outside"),
                    F.when(~F.col("_at.outside"), F.col("_at.r")).alias("r"), F.when(~F.col("_at.outside"), F.col("_at.c")).alias("c")))


def render_tiles(px: DataFrame, geo: DataFrame, zoom: int, tile_px: int = 256) -> DataFrame:
    """K17. Nearest-sampled XYZ tile pixels of every raster, those outside it with null values.

    ``geo`` holds ``raster_id west north dx dy height width`` in degrees. Tiles
    are listed per raster and spread over the cluster before their pixels are
    made, so one large raster is not one task; pixels meet the raster on
    ``(raster_id, r, c)``. Colours follow from ``class_rgba``, ``colormap_rgba``
    or ``rgb_rgba``. Far out, ``pyramids.render_overviews`` reads less.
    """
    return tile_cells(geo, zoom, tile_px).join(px, [KEY, "r", "c"], "left")


def stretch_uint8(px: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """J4. Bands of each raster as whole numbers of 0 to 255.

    A raster whose largest value is 1 or less is scaled by 255; any other from
    the 2nd to the 98th percentile of its positive values, all bands together.
    """
    keys = list(keys)
    top = px.groupBy(*keys).agg(F.max(F.greatest(*[F.col(b) for b in bands]) if len(bands) > 1 else F.col(bands[0])).alias("_top"))
    long = px.select(*keys, F.explode(F.array(*[F.col(b).cast("double") for b in bands])).alias("_v")).where("_v > 0")
    cut = exact_stats(long, keys, "_v", {"_lo": 0.02, "_hi": 0.98}).select(*keys, "_lo", "_hi")
    met = px.join(top, keys).join(cut, keys, "left")
    lo, hi = F.coalesce("_lo", F.lit(0.0)), F.coalesce("_hi", F.lit(255.0))

    def level(b: str) -> Column:
        spread = F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.col(b) - lo) / (hi - lo + 1e-8) * 255))
        return F.when(F.col("_top") <= 1, F.col(b) * 255).otherwise(spread).cast("int")

    return met.withColumns({b: level(b) for b in bands}).drop("_top", "_lo", "_hi")
