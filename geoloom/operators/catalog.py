"""Registries, artifacts, model catalogs, dispatch and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.text import quote_keep_comma, spec_id
from geoloom.operators.scale import first_per


def latest(log: DataFrame, key: str, at: str) -> DataFrame:
    """A13. The registry behind an append-only log: the last entry per key, unless it deletes it.

    ``log`` carries ``op``: ``upsert`` or ``delete``.
    """
    return first_per(log, [key], [F.desc(at), F.desc("version")]).where(F.col("op") != "delete").drop("op")


def newest_first(registry: DataFrame, at: str, key: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A13, H3. Listing, newest first."""
    out = registry.orderBy(F.desc(at), F.asc(key)).offset(offset)
    return out if limit is None else out.limit(limit)


def upsert_projects(old: DataFrame, new: DataFrame) -> DataFrame:
    """A14. New rows replace old ones by id and keep their creation time."""
    o = old.select("id", *[F.col(c).alias(f"_o_{c}") for c in old.columns if c != "id"])
    n = new.withColumn("_new", F.lit(True))
    both = o.join(n, "id", "full_outer")

    def side(c: str) -> Column:
        if c == "created_at":
            return F.coalesce("_o_created_at", "created_at").alias(c)
        return F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_o_{c}")).alias(c)

    return both.select("id", *[side(c) for c in old.columns if c != "id"])


def search_projects(projects: DataFrame, text: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A14. Projects whose name has the text, whatever its case, newest first."""
    hits = projects.where(F.lower("name").contains(text.lower()))
    return newest_first(hits, "updated_at", "id", limit, offset)


def delete_rows(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A13, A14."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def project_state(text: Column, schema: str) -> Column:
    """S13. JSON text to a struct; missing or blank text is the empty object."""
    return F.from_json(F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "{}").otherwise(text), schema)


def safe_name(name: Column) -> Column:
    """A19."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def sweep(index: DataFrame, files: DataFrame, now: float, ttl: float) -> DataFrame:
    """A19. What to remove: indexed files past their age, then files without an entry past it.

    ``index``: ``artifact_id filename created_at``; ``files``: ``filename mtime size``.
    """
    old = now - ttl
    gone = (index.where(F.col("created_at") < old).join(files.select("filename", "size"), "filename", "left")
            .select("filename", F.lit("expired").alias("why"), F.coalesce("size", F.lit(0)).cast("bigint").alias("size")))
    stray = (files.join(index.select("filename").distinct(), "filename", "left_anti").where(F.col("mtime") < old)
             .select("filename", F.lit("orphan").alias("why"), F.col("size").cast("bigint").alias("size")))
    return gone.unionByName(stray)


def sweep_totals(removed: DataFrame) -> DataFrame:
    return removed.groupBy("why").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def catalog_merge(live: DataFrame, static: DataFrame, key: str = "repo_id") -> DataFrame:
    """A21. Live entries completed from the static ones; the static list when nothing is live."""
    extra = [c for c in static.columns if c != key]
    s = static.select(key, *[F.col(c).alias(f"_s_{c}") for c in extra])
    merged = live.join(s, key, "left").select(
        *[c for c in live.columns if c not in extra],
        *[F.coalesce(*([F.col(c)] if c in live.columns else []), F.col(f"_s_{c}")).alias(c) for c in extra],
        F.lit("live").alias("origin"))
    any_live = live.select(F.lit(1).alias("x")).limit(1).agg(F.count("x").alias("n")).scalar()
    fall = static.where(any_live == 0).withColumn("origin", F.lit("static"))
    return merged.unionByName(fall, allowMissingColumns=True)


def find_feature(requests: DataFrame, features: DataFrame) -> DataFrame:
    """B8. The feature a key names: by ``id`` or ``polygon_id``, else by its position.

    Every name a feature answers to becomes a row, so the look-up is one
    equi-join. A key that names nothing gives ``found = false``.
    """
    def named(col: str, rank: int) -> DataFrame:
        return features.select(F.col(col).cast("string").alias("key"), F.lit(rank).alias("_p"), F.col("pos"), F.col("id"))

    names = named("id", 0).unionByName(named("polygon_id", 0)).unionByName(named("pos", 1))
    # several features may share a name: the first of them stands for it
    first = first_per(names.where(F.col("key").isNotNull()), ["key"], [F.asc("_p"), F.asc("pos")])
    return requests.join(first.drop("_p"), "key", "left").withColumn("found", F.col("pos").isNotNull())


def task_dispatch(jobs: DataFrame, heads: DataFrame) -> DataFrame:
    """B10. The route of each job from its head's input needs and its event date."""
    pre_post, radar = F.coalesce("pre_post_split", F.lit(False)), F.coalesce("s1_required", F.lit(False))
    dated, many = F.col("event_date").isNotNull(), F.coalesce("n_periods", F.lit(1)) > 1
    return jobs.join(heads, "head", "left").withColumn(
        "route", F.when(pre_post & dated & ~radar, "pre_post").when(many & ~radar & ~pre_post, "temporal")
        .otherwise("single_scene")).withColumn(
        "warning", F.when(pre_post & ~dated, "event date is missing").when(radar, "radar input is missing"))


# Words of a failure, what to do about it, and the parameters of the next run.
NO_DATA = ["empty", "all-zero", "no scenes", "no sentinel", "sentinelfetcherror", "pre-normalized"]
WRONG_RANGE = ["outside", "dn range"]
NOT_FINITE = ["non-finite", "nan"]
WIDER_DATES = '{"date_range":"2024-03-01/2024-09-30"}'
ONE_WINDOW = '{"sliding_window":false}'
SMALLER = '{"max_size_px":128}'


def suggest_retries(failures: DataFrame) -> DataFrame:
    """B11. Ways to run a failed request again, from the text of the failure."""
    r = F.lower(F.coalesce("reason", F.lit("")))

    def has(words: Sequence[str]) -> Column:
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(r, w))

    def option(action: str, params: str) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(params).alias("params"))

    known = F.array_compact(F.array(
        F.when(has(NO_DATA), option("widen_dates", WIDER_DATES)),
        F.when(has(NO_DATA) & F.coalesce("sliding_window", F.lit(False)), option("one_window", ONE_WINDOW)),
        F.when(has(WRONG_RANGE), option("other_area_or_dates", "{}")),
        F.when(has(NOT_FINITE), option("retry_once", "{}"))))
    options = F.when(F.size(known) > 0, known).otherwise(F.array(option("smaller_input", SMALLER)))
    return failures.withColumn("_o", F.explode(options)).select(
        *failures.columns, F.col("_o.action").alias("action"), F.col("_o.params").alias("params"))


def first_match(task: Column, keywords: Sequence[tuple[str, str]]) -> Column:
    """G7. The model of the first keyword the task has; the order of the list decides."""
    t = F.lower(F.trim(F.coalesce(task, F.lit(""))))
    return F.coalesce(*[F.when(t.contains(k), F.lit(m)) for k, m in keywords])


GRAM = 4  # characters of the pieces by which a text is looked up inside others


def _grams(text: Column, size: Column) -> Column:
    """The different pieces of ``size`` characters of a text that has as many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, size)))


def texts_inside(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """``needle text``: which of the different ``needles`` (``needle``) occur in which of the different ``texts`` (``text``).

    A text gives its pieces of ``GRAM`` characters, as many as it has characters,
    and shorter pieces only for the lengths of needles that are shorter. A
    needle looks for the one of its pieces that fewest texts have, and what it
    meets there is compared directly. Empty needles are in no text.
    """
    needles, texts = needles.select("needle").where("needle <> ''").distinct(), texts.select("text").where("text <> ''").distinct()
    size = F.least(F.length("needle"), F.lit(GRAM))
    sizes = [r.s for r in needles.select(size.alias("s")).distinct().collect()]  # GRAM different ones at most
    pieces = texts.select("text", F.explode(F.array(*[F.lit(s) for s in sizes]).cast("array<int>")).alias("_s")).where(F.length("text") >= F.col("_s"))
    pieces = pieces.select("text", F.explode(_grams(F.col("text"), F.col("_s"))).alias("_g"))
    held = pieces.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    own = needles.select("needle", F.explode(_grams(F.col("needle"), size)).alias("_g")).join(held, "_g", "left")
    # a piece that no text has means that no text has the needle
    rare = own.groupBy("needle").agg(F.min_by("_g", F.coalesce("_n", F.lit(0))).alias("_g"), F.min(F.coalesce("_n", F.lit(0))).alias("_n")).where("_n > 0").drop("_n")
    return pieces.join(rare, "_g").where(F.contains("text", "needle")).select("needle", "text")


def recommend_model(tasks: DataFrame, catalog: DataFrame, aliases: Sequence[tuple[str, str]],
                    size_preference: str = "medium", fallback: str = "base") -> DataFrame:
    """G8. A model per task: matching head, alias, encoder of the size, any encoder, fallback.

    ``catalog``: ``repo_id type task_key task size_tier pos``. A head matches if
    its key is in the task, or the task in its key or name; texts inside texts
    are found by their rarest piece (``texts_inside``), for each different task
    once, so neither side is held whole. Of the aliases in the task the first whose
    model is in the catalog counts.
    """
    task = F.lower(F.trim(F.coalesce("task", F.lit(""))))
    each = tasks.select(task.alias("_t")).where("_t <> ''").distinct()
    heads = catalog.where("type = 'fine-tuned'").select(
        "pos", "repo_id", F.lower("task_key").alias("_key"), F.lower(F.coalesce("task", F.lit(""))).alias("_human")).where("_key <> ''")
    keys = texts_inside(heads.select(F.col("_key").alias("needle")), each.select(F.col("_t").alias("text"))).toDF("_key", "_t")
    names = heads.select(F.col("_key").alias("text")).union(heads.select("_human"))
    about = texts_inside(each.select(F.col("_t").alias("needle")), names).toDF("_t", "_name")
    found = keys.join(heads, "_key").select("_t", "pos", "repo_id")
    for name in ("_key", "_human"):
        found = found.unionByName(about.join(heads.withColumn("_name", F.col(name)), "_name").select("_t", "pos", "repo_id"))
    head = found.groupBy("_t").agg(F.min_by("repo_id", F.struct("pos", "repo_id")).alias("_head"))
    hits = F.array_compact(F.array(*[F.when(F.contains("_t", F.lit(k)), F.struct(F.lit(i).alias("i"), F.lit(m).alias("repo_id"))) for i, (k, m) in enumerate(aliases)]))
    known = (each.select("_t", F.explode(hits).alias("_a")).select("_t", "_a.*").join(catalog.select("repo_id").distinct(), "repo_id", "left_semi")
             .groupBy("_t").agg(F.min_by("repo_id", "i").alias("_known")))
    encoders = catalog.where("type = 'encoder'")
    sized = encoders.where(F.col("size_tier") == size_preference).agg(F.min_by("repo_id", "pos").alias("m")).scalar()
    out = (tasks.withColumn("_t", task).join(head, "_t", "left").join(known, "_t", "left")
           .withColumn("_size", sized).withColumn("_any", encoders.agg(F.min_by("repo_id", "pos").alias("m")).scalar()))
    return out.select(
        *tasks.columns, F.coalesce("_head", "_known", "_size", "_any", F.lit(fallback)).alias("repo_id"),
        F.when(F.col("_head").isNotNull(), "task").when(F.col("_known").isNotNull(), "alias")
        .when(F.col("_size").isNotNull(), "size").when(F.col("_any").isNotNull(), "any_encoder")
        .otherwise("fallback").alias("reason"))


# Bands and stretch per image collection.
COLLECTION_DEFAULTS = {
    "sentinel-2-l2a": (["B04", "B03", "B02"], "0,3000", "Gamma RGB 3.5 Saturation 1.5"),
    "landsat-c2-l2": (["red", "green", "blue"], "7500,40000", "Gamma RGB 2.7 Saturation 1.4"),
    "naip": (["image"], None, None),
}


def composite_url(specs: DataFrame, base: str) -> DataFrame:
    """S8. Tile URL of a least-cloudy mosaic.

    ``specs``: ``search_id collection assets rescale color_formula``; nulls take
    the collection's defaults; a collection without bands is an error row.
    """
    def default(i: int, kind: str) -> Column:
        out = None
        for name, d in COLLECTION_DEFAULTS.items():
            v = d[i]
            lit = F.lit(None).cast(kind) if v is None else F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
            out = F.when(F.col("collection") == name, lit) if out is None else out.when(F.col("collection") == name, lit)
        return out

    s = (specs.withColumn("_b", F.coalesce("assets", default(0, "array<string>")))
         .withColumn("_r", F.coalesce("rescale", default(1, "string")))
         .withColumn("_c", F.coalesce("color_formula", default(2, "string"))))

    def part(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"{key}="), quote_keep_comma(value))

    query = F.concat_ws("&", F.transform("_b", lambda b: part("assets", b)),
                        F.when(F.col("_r") != "", part("rescale", F.col("_r"))),
                        F.when(F.col("_c") != "", part("color_formula", F.col("_c"))), part("collection", F.col("collection")))
    bad = F.coalesce(F.size("_b"), F.lit(0)) <= 0
    url = F.concat(F.lit(f"{base}/mosaic/"), F.col("search_id"), F.lit("/tiles/{z}/{x}/{y}@2x?"), query)
    return s.withColumn("tile_url", F.when(~bad, url)).withColumn("error", F.when(bad, "no_assets")).drop("_b", "_r", "_c")


# The wording of the fact lines.
HISTOGRAM_HEAD = ("PIXEL HISTOGRAM OVER THE AOI (ground truth from the rendered raster; %d total pixels, "
                  "%d classes present out of %d):")
HISTOGRAM_LINE = "- %s (id=%d): %s%% (%d pixels)"
STATS_HEAD = "SCALAR STATS OVER THE AOI (ground truth from the rendered raster; %d valid pixels):"
STATS_LINES = [("mean", "mean"), ("min", "min"), ("p10", "p10"), ("p50 (median)", "p50"), ("p90", "p90"), ("max", "max")]


def histogram_block(hist: DataFrame, names: DataFrame, num_classes: int) -> DataFrame:
    """S12. A class histogram as lines of text per raster; ``hist`` is the output of D2."""
    named = (hist.join(names, "class_id", "left")
             .withColumn("name", F.coalesce("name", F.concat(F.lit("class_"), F.col("class_id")))))
    line = F.format_string(HISTOGRAM_LINE, "name", "class_id", F.col("percent").cast("string"), "n_pixels")
    # at most top_n lines per raster
    got = named.groupBy("raster_id", "total_pixels", "n_present").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l"))
    head = F.format_string(HISTOGRAM_HEAD, "total_pixels", "n_present", F.lit(num_classes))
    return got.select("raster_id", F.concat_ws("\n", head, F.transform("_l", lambda x: x["line"])).alias("block"))


def stats_block(stats: DataFrame, units: str) -> DataFrame:
    """S12. Scalar statistics as lines of text per raster; ``stats`` is the output of D3."""
    lines = [F.concat(F.lit(f"- {label}: "), F.col(c).cast("string"), F.lit(f" {units}")) for label, c in STATS_LINES]
    return stats.select("raster_id", F.concat_ws("\n", F.format_string(STATS_HEAD, "valid_pixels"), *lines).alias("block"))


def demo_catalog(pairs: DataFrame) -> DataFrame:
    """K21. Each pair as two requests with id, tile URL and the box that shows both.

    ``pairs``: ``pair_id a b`` with ``struct(model, date, west, south, east, north)``.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("spec")) for s in ("a", "b")]))
    fit = [F.least("a.west", "b.west").alias("fit_west"), F.least("a.south", "b.south").alias("fit_south"),
           F.greatest("a.east", "b.east").alias("fit_east"), F.greatest("a.north", "b.north").alias("fit_north")]
    job = spec_id(model=F.col("s.spec.model"), date=F.col("s.spec.date"), bbox=F.concat_ws(",", *[
        F.format_string("%.6f", F.col(f"s.spec.{k}")) for k in ("west", "south", "east", "north")]))
    out = pairs.select("pair_id", sides.alias("s"), *fit).withColumn("job_id", job)
    return out.select("pair_id", F.col("s.side").alias("side"), "job_id",
                      F.concat(F.lit("/infer-tile/"), F.col("job_id"), F.lit("/{z}/{x}/{y}.png")).alias("tile_url"),
                      "fit_west", "fit_south", "fit_east", "fit_north")


def aoi_report(areas: DataFrame, cover: DataFrame, coverage: DataFrame, models: DataFrame) -> DataFrame:
    """D25. One row per area: size, land cover, overlapping regions and a model.

    ``cover``: ``aoi_id name percent`` (a short legend per area); ``coverage``:
    ``aoi_id region``; ``models``: ``aoi_id repo_id``.
    """
    lc = cover.groupBy("aoi_id").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("percent")).alias("o"), "name", "percent"))).alias("_lc"))
    cov = coverage.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n_regions"), F.min("region").alias("first_region"))
    return (areas.join(lc, "aoi_id", "left").join(cov, "aoi_id", "left").join(models, "aoi_id", "left")
            .withColumn("land_cover", F.transform("_lc", lambda x: F.struct(x["name"].alias("name"), x["percent"].alias("percent"))))
            .withColumn("n_regions", F.coalesce("n_regions", F.lit(0)).cast("bigint")).drop("_lc"))
