"""Scene catalogs: search, choice of scenes per area and period, providers and bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geo import bbox_intersects
from geoloom.operators.scale import cell_join, first_per

BOX = ("west", "south", "east", "north")


def search_scenes(scenes: DataFrame, bbox: tuple, start, end, collections: Sequence[str],
                  max_cloud: float | None = 20.0, limit: int = 10, max_limit: int | None = None) -> DataFrame:
    """B1. Scenes that touch a box in a date range, newest first.

    ``max_limit`` is for a service that wants to bound what its callers ask for.
    All tests are on flat columns, so they reach the parquet scan. The number
    of matches is counted on its own, not by a window over all of them.
    """
    hits = scenes.where(
        bbox_intersects(BOX, bbox) & F.col("dt").between(start, end) & F.col("collection").isin(list(collections)))
    if max_cloud is not None:
        hits = hits.where(F.col("cloud_cover") < max_cloud)
    n = max(1, limit if max_limit is None else min(limit, max_limit))
    matched = hits.agg(F.count(F.lit(1)).alias("matched"))
    page = hits.orderBy(F.desc("dt"), F.asc("scene_id")).limit(n)
    if "assets" in scenes.columns:
        page = page.withColumns({"assets": F.array_sort("assets"), "n_assets": F.size("assets")})
    return page.withColumn("matched", matched.scalar())


def scenes_for_aois(aois: DataFrame, scenes: DataFrame, cell_deg: float = 5.0) -> DataFrame:
    """C1. Footprints that touch each area; scene columns come out as ``r_*``."""
    return cell_join(aois, scenes, cell_deg)


def least_cloudy(scenes: DataFrame, keys: Sequence[str], max_cloud: float | None = None) -> DataFrame:
    """G2. The clearest scene per group under the cap, the lowest id on ties."""
    ok = scenes if max_cloud is None else scenes.where(F.col("cloud_cover") < max_cloud)
    return first_per(ok, keys, [F.asc("cloud_cover"), F.asc("scene_id")])


def scenes_for_periods(periods: DataFrame, scenes: DataFrame, days: int,
                       max_cloud: float | None = None) -> DataFrame:
    """C2. The clearest scene per area and period; periods without one stay, as skipped.

    ``periods``: ``aoi_id t start end`` of equal length ``days``, half open;
    ``scenes``: ``aoi_id scene_id dt cloud_cover``. A date meets the one or two
    day buckets its period covers, so this is an equi-join on the bucket.
    """
    def bucket(d: Column) -> Column:
        return F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / days)

    spread = periods.withColumn("_b", F.explode(F.sequence(bucket(F.col("start")), bucket(F.date_sub("end", 1)))))
    # scenes are cut to the best per area and day before they meet the periods
    ok = scenes if max_cloud is None else scenes.where(F.col("cloud_cover") < max_cloud)
    daily = first_per(ok, ["aoi_id", "dt"], [F.asc("cloud_cover"), F.asc("scene_id")])
    hits = (spread.join(daily.withColumn("_b", bucket(F.col("dt"))), ["aoi_id", "_b"])
            .where((F.col("dt") >= F.col("start")) & (F.col("dt") < F.col("end"))))
    best = first_per(hits, ["aoi_id", "t"], [F.asc("cloud_cover"), F.asc("scene_id")])
    return (periods.join(best.select("aoi_id", "t", "scene_id", "dt", "cloud_cover"), ["aoi_id", "t"], "left")
            .withColumn("skipped", F.col("scene_id").isNull()))


def latest_scene(periods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """B9. The most recent period of each group that has a scene."""
    return periods.groupBy(*keys).agg(
        F.max_by("scene_id", F.when(F.col("scene_id").isNotNull(), F.col("t"))).alias("scene_id"))


def provider_fallback(primary: DataFrame, secondary: DataFrame, key: str, forced: str | None = None) -> DataFrame:
    """C3. One answer per request: the secondary's only where the primary failed.

    An answer that found nothing is still an answer. ``forced`` takes one
    provider whatever happened. Both sides: ``key status scene_id``.
    """
    s = secondary.select(key, F.col("status").alias("_s"), F.col("scene_id").alias("_id"))
    both = primary.join(s, key, "left")
    use = {"primary": F.lit(False), "secondary": F.lit(True)}.get(forced, F.col("status") == "error")
    return both.select(
        key, F.when(use, "secondary").otherwise("primary").alias("provider"),
        F.when(use, F.coalesce("_s", F.lit("error"))).otherwise(F.col("status")).alias("status"),
        F.when(use, F.col("_id")).otherwise(F.col("scene_id")).alias("scene_id"))


def rename_bands(assets: DataFrame, names: DataFrame) -> DataFrame:
    """C19. Provider band names to ``B0X``; names without an entry are left out."""
    return assets.join(names, "asset").drop("asset")


def complete_scenes(assets: DataFrame, bands: Sequence[str]) -> DataFrame:
    """B7, I4. Per scene: the wanted bands it lacks and whether it is usable."""
    # one flag per wanted band stays in the hash aggregate; a set per scene would not
    flags = assets.groupBy("scene_id").agg(*[F.bool_or(F.col("band") == b).alias(f"_{b}") for b in bands])
    lacks = F.array_compact(F.array(*[F.when(~F.coalesce(f"_{b}", F.lit(False)), b) for b in sorted(bands)]))
    return flags.select("scene_id", lacks.alias("missing")).withColumn("usable", F.size("missing") == 0)


def merge_providers(parts: dict[str, DataFrame]) -> DataFrame:
    """I3. One catalog with the provider's name on each row."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("provider", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def cache_stem(scene: Column, box: Sequence[Column], gsd: Column, version: str) -> Column:
    """A20. What the keys of a scene's bands have in common, made once per scene; numbers with six places."""
    def six(x: Column) -> Column:
        return x.cast("decimal(18,6)").cast("string")

    return F.concat_ws("|", F.lit(version), scene.cast("string"), *[six(b) for b in box], six(gsd))


def cache_key(stem: Column, band: Column) -> Column:
    """A20. Key of one cached band window."""
    return F.substring(F.sha2(F.concat_ws("|", stem, band), 256), 1, 16)


def cache_plan(needed: DataFrame, cached: DataFrame) -> DataFrame:
    """A20. Per scene: bands in the cache and not, and full, partial or none."""
    seen = cached.select("cache_key").distinct().withColumn("_hit", F.lit(True))
    return (needed.join(seen, "cache_key", "left").groupBy("scene_id")
            .agg(F.count_if(F.col("_hit").isNotNull()).alias("n_hit"), F.count_if(F.col("_hit").isNull()).alias("n_miss"))
            .withColumn("state", F.when(F.col("n_miss") == 0, "full").when(F.col("n_hit") == 0, "none")
                        .otherwise("partial")))


def dedupe_jobs(requests: DataFrame, finished: DataFrame) -> DataFrame:
    """I5. One row per job id that no finished job answers; stub results do not count."""
    done = finished.where(F.col("kind") != "stub").select("job_id").distinct()
    first = requests.groupBy("job_id").agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("n_requests"))
    return first.join(done, "job_id", "left_anti")
