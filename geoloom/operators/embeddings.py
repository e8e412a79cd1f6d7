"""Embedding rasters ``(raster_id, r, c, embedding)``; a vector of zeros is nodata."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import vector as V
from geoloom.functions.geo import lonlat_to_rc, tile_positions, window_weight
from geoloom.operators.rasters import smooth_raster
from geoloom.operators.scale import first_per

KEY = "raster_id"


def with_nodata(emb: DataFrame) -> DataFrame:
    return emb.withColumn("nodata", V.is_nodata(F.col("embedding")))


def labels_to_patches(labels: DataFrame, emb: DataFrame, geo: DataFrame) -> DataFrame:
    """C9. The patch under each labelled point; points outside or on nodata are dropped.

    ``labels``: ``raster_id class_id lon lat``; ``geo``: ``raster_id west north dx dy height width``.
    """
    at = (labels.join(geo, KEY)
          .withColumn("_a", lonlat_to_rc("lon", "lat", "west", "north", "dx", "dy", "height", "width"))
          .where(~F.col("_a.outside"))
          .select(KEY, "class_id", "lon", "lat", F.col("_a.r").alias("r"), F.col("_a.c").alias("c")))
    valid = emb.where(~V.is_nodata(F.col("embedding"))).select(KEY, "r", "c", "embedding")
    return at.join(valid, [KEY, "r", "c"])


def lost_classes(labels: DataFrame, matched: DataFrame) -> DataFrame:
    """C9. Classes of a raster that lost all their points; a caller treats a row as an error."""
    return (labels.select(KEY, "class_id").distinct()
            .join(matched.select(KEY, "class_id").distinct(), [KEY, "class_id"], "left_anti"))


def prototypes(matched: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """D17. Mean vector per raster and class, with the points used and given."""
    out = matched.groupBy(KEY, "class_id").agg(
        V.mean_vector(F.col("embedding")).alias("prototype"), F.count(F.lit(1)).alias("points_used"))
    if labels is None:
        return out
    given = labels.groupBy(KEY, "class_id").agg(F.count(F.lit(1)).alias("points_given"))
    return out.join(given, [KEY, "class_id"])


def pool_tokens(tokens: DataFrame) -> DataFrame:
    """D18. One vector per patch: the mean over its time steps and band sets."""
    return tokens.groupBy(KEY, "r", "c").agg(V.mean_vector(F.col("embedding")).alias("embedding"))


def _gathered(protos: DataFrame) -> DataFrame:
    """The prototypes of a raster as one array in order of class; as long as the raster's legend, as are the scores of a patch."""
    return protos.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("class_id", "prototype"))).alias("_p"))


def score_prototypes(emb: DataFrame, protos: DataFrame) -> DataFrame:
    """C10. Cosine of every patch with every prototype of its raster, as an array column.

    The patches meet one row per raster by key; the classes stay inside the
    row, so the patch table is neither multiplied nor shuffled when the
    prototypes are small enough for Spark to send them out.
    """
    return (emb.join(_gathered(protos), KEY)
            .withColumn("class_ids", F.transform("_p", lambda p: p["class_id"]))
            .withColumn("cosines", F.transform("_p", lambda p: V.cosine(F.col("embedding"), p["prototype"])))
            .drop("_p"))


def few_shot(emb: DataFrame, protos: DataFrame, min_similarity: float | None = None) -> DataFrame:
    """K5. Nearest-prototype class and confidence; nodata patches get -1 and 0.

    Rasters with fewer than two classes cannot be told apart and raise an error.
    """
    s = score_prototypes(emb, protos)
    best, gone = F.array_max("cosines"), V.is_nodata(F.col("embedding"))
    few = F.size("cosines") < 2
    cls = F.get("class_ids", V.argmax(F.col("cosines")))
    if min_similarity is not None:
        cls = F.when(best >= min_similarity, cls).otherwise(-1)
    cls = F.when(few, F.raise_error(F.lit("few-shot needs at least two classes")).cast("int")).otherwise(cls)
    return s.select(KEY, "r", "c", F.when(gone, -1).otherwise(cls).alias("class_id"),
                    F.when(gone, 0.0).otherwise((best + 1) / 2).alias("confidence"))


def _logistic(x: np.ndarray, y: np.ndarray, k: int, reg: float, rounds: int = 500, enough: float = 1e-6) -> np.ndarray:
    """Weights ``k x (d + 1)`` of least mean log loss plus ``reg / 2`` times the squared slopes, by limited-memory BFGS."""
    a = np.column_stack((x, np.ones(len(x))))
    want = np.eye(k)[y]
    damp = np.full((k, a.shape[1]), reg)
    damp[:, -1] = 0

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = a @ w.reshape(k, -1).T
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        p = e / e.sum(1, keepdims=True)
        m = w.reshape(k, -1)
        value = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean() + (damp * m * m).sum() / 2
        return value, ((p - want).T @ a / len(a) + damp * m).ravel()

    w = np.zeros(k * a.shape[1])
    value, g = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(g).max() < enough:
            break
        q, alphas = g.copy(), []
        for s, d, rho in reversed(steps):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * d
        if steps:
            s, d, _ = steps[-1]
            q *= (s @ d) / (d @ d)
        for (s, d, rho), alpha in zip(steps, reversed(alphas)):
            q += s * (alpha - rho * (d @ q))
        t = 1.0
        while True:
            new = w - t * q
            v, h = loss(new)
            if v <= value - 1e-4 * t * (g @ q) or t < 1e-10:
                break
            t /= 2
        s, d = new - w, h - g
        if s @ d > 1e-14:
            steps = [*steps[-9:], (s, d, 1 / (s @ d))]
        w, value, g = new, v, h
    return w.reshape(k, -1)


def logistic_models(matched: DataFrame, reg: float = 0.01) -> DataFrame:
    """K6. ``raster_id class_ids weights`` of each raster with labelled patches of two classes or more.

    A model is fitted to the labelled patches of one raster, which people have
    set by hand, and to nothing else. The scaling is folded into the weights,
    so they apply to the vectors as they are; the last weight is the intercept.
    """
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["class_id", "r", "c"])
        x = np.stack(pdf["embedding"].to_numpy()).astype(float)
        classes, y = np.unique(pdf["class_id"].to_numpy(), return_inverse=True)
        if len(classes) < 2:
            return pd.DataFrame({KEY: [], "class_ids": [], "weights": []}, dtype=object)
        mean, dev = x.mean(0), x.std(0)
        dev[dev == 0] = 1
        w = _logistic((x - mean) / dev, y, len(classes), reg)
        w[:, :-1] /= dev
        w[:, -1] -= w[:, :-1] @ mean
        return pd.DataFrame({KEY: pdf[KEY].iloc[:1], "class_ids": [classes.tolist()], "weights": [[r.tolist() for r in w]]})

    return (matched.select(KEY, "r", "c", F.col("class_id").cast("int").alias("class_id"), "embedding").groupBy(KEY)
            .applyInPandas(fit, f"{KEY} int, class_ids array<int>, weights array<array<double>>"))


def logistic_probs(emb: DataFrame, models: DataFrame) -> DataFrame:
    """Patches with ``class_ids`` and ``probs`` of their raster's model, in the JVM."""
    vector = V.doubles(F.col("embedding"))
    met = emb.join(models, KEY).withColumn("_e", F.concat(vector, F.array(F.lit(1.0))))
    logits = F.transform("weights", lambda w: F.aggregate(F.zip_with(w, F.col("_e"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    return met.withColumn("_z", logits).withColumn("probs", V.softmax(F.col("_z"), 1.0)).drop("_z", "_e", "weights")


def few_shot_logistic(emb: DataFrame, matched: DataFrame, reg: float = 0.01) -> DataFrame:
    """K6. Class of every patch by its own raster's logistic model; nodata patches get -1."""
    got = logistic_probs(emb, logistic_models(matched, reg))
    best = F.get("class_ids", V.argmax(F.col("probs")))
    return got.select(KEY, "r", "c", F.when(V.is_nodata(F.col("embedding")), -1).otherwise(best).alias("class_id"))


def embedding_query(emb: DataFrame, geo: DataFrame, lon: Column | None = None, lat: Column | None = None,
                    window: int = 3) -> DataFrame:
    """K1. Query vector per raster: the mean of the valid patches in a window around a
    point, the raster's centre by default; the mean of all valid patches if none is there."""
    half = window // 2
    if lon is None or lat is None:
        def middle(n: str) -> Column:
            return F.least(F.bround(F.col(n) / 2), F.col(n) - 1).cast("int")

        at = geo.select(KEY, F.struct(middle("height").alias("r"), middle("width").alias("c")).alias("_a"))
    else:
        at = geo.select(KEY, lonlat_to_rc(lon, lat, "west", "north", "dx", "dy", "height", "width").alias("_a"))
    valid = emb.where(~V.is_nodata(F.col("embedding")))
    near = valid.join(at, KEY).where(
        (F.abs(F.col("r") - F.col("_a.r")) <= half) & (F.abs(F.col("c") - F.col("_a.c")) <= half))
    local = near.groupBy(KEY).agg(V.mean_vector(F.col("embedding")).alias("_l"), F.count(F.lit(1)).alias("n_window"))
    whole = valid.groupBy(KEY).agg(V.mean_vector(F.col("embedding")).alias("_g"))
    return (whole.join(local, KEY, "left")
            .select(KEY, F.coalesce("_l", "_g").alias("query"), F.coalesce("n_window", F.lit(0)).alias("n_window")))


def similarity(emb: DataFrame, query: DataFrame, sigma: float = 1.5, block: int = 256) -> DataFrame:
    """K2. Scaled cosine of each patch with its raster's query vector, then a blur across seams."""
    s = emb.join(query.select(KEY, "query"), KEY).select(
        KEY, "r", "c", V.is_nodata(F.col("embedding")).alias("nodata"),
        V.cosine01(F.col("embedding"), F.col("query")).alias("similarity"))
    if sigma <= 0:
        return s.drop("nodata")
    masked = s.select(KEY, "r", "c", F.when(~F.col("nodata"), F.col("similarity")).alias("similarity"))
    return smooth_raster(masked, ["similarity"], sigma, block).withColumn(
        "similarity", F.coalesce("similarity", F.lit(0.0)))


def most_similar(emb: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """H5. The ``k`` patches nearest the query in each raster."""
    return first_per(similarity(emb, query, 0), [KEY], [F.desc("similarity"), F.asc("r"), F.asc("c")], k, rank="rank")


def concat_pre_post(pre: DataFrame, post: DataFrame) -> DataFrame:
    """C12. Vectors of the two dates end to end; a patch without both is left out."""
    a = pre.where(~V.is_nodata(F.col("embedding"))).select(KEY, "r", "c", F.col("embedding").alias("_a"))
    b = post.where(~V.is_nodata(F.col("embedding"))).select(KEY, "r", "c", F.col("embedding").alias("_b"))
    return a.join(b, [KEY, "r", "c"]).select(KEY, "r", "c", F.concat("_a", "_b").alias("embedding"))


def change_map(before: DataFrame, after: DataFrame, threshold: float = 0.1) -> DataFrame:
    """C11, F9, K7. Cosine distance of two dates per patch; null where either is nodata."""
    a = before.select(KEY, "r", "c", F.col("embedding").alias("_a"))
    b = after.select(KEY, "r", "c", F.col("embedding").alias("_b"))
    gone = V.is_nodata(F.col("_a")) | V.is_nodata(F.col("_b"))
    d = F.when(~gone, V.cosine_distance(F.col("_a"), F.col("_b")))
    return (a.join(b, [KEY, "r", "c"]).select(KEY, "r", "c", d.alias("distance"))
            .withColumn("changed", F.col("distance") > threshold))


def embedding_export(chunks: DataFrame, grid: DataFrame, gsd: float) -> DataFrame:
    """K8. Stitch chunk embeddings, mark nodata and quantise to signed bytes."""
    from geoloom.operators.rasters import stitch

    whole = stitch(chunks.withColumnRenamed("embedding", "value"), grid, gsd)
    return whole.select(KEY, "r", "c", V.quantize_int8(F.col("value"), V.is_nodata(F.col("value"))).alias("bands"))


def principal_axes(emb: DataFrame, k: int) -> DataFrame:
    """Mean vector and top ``k`` axes per raster, from the valid patches.

    Every task adds up the product matrix of its rows (with a leading 1, so that
    counts and sums are in it), and only these matrices are shuffled, row by row.
    Axis signs are fixed by making the largest part of each axis positive.
    """
    valid = emb.where(~V.is_nodata(F.col("embedding"))).select(KEY, V.doubles(F.col("embedding")).alias("v"))

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            for rid, g in pdf.groupby(KEY):
                x = np.stack(g["v"].to_numpy())
                x1 = np.hstack([np.ones((len(x), 1)), x])
                got = x1.T @ x1
                sums[rid] = sums.get(rid, 0) + got
                if len(sums) > 64:  # keep the task's memory flat
                    yield _moment_rows(sums)
                    sums = {}
        if sums:
            yield _moment_rows(sums)

    parts = valid.mapInPandas(partial, f"{KEY} int, i int, m array<double>")
    total = parts.groupBy(KEY, "i").agg(vector_to_array(Summarizer.sum(array_to_vector("m"))).alias("m"))

    def axes(pdf: pd.DataFrame) -> pd.DataFrame:
        full = np.stack(pdf.sort_values("i")["m"].to_numpy())
        n = full[0, 0]
        mean = full[0, 1:] / n
        cov = full[1:, 1:] / n - np.outer(mean, mean)
        val, vec = np.linalg.eigh(cov)
        top = np.argsort(val)[::-1][:k]
        vec = vec[:, top].T
        vec *= np.sign(vec[np.arange(len(top)), np.abs(vec).argmax(axis=1)])[:, None]
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "mean": [mean], "axes": [list(vec)],
                             "variance": [val[top]]})

    return total.groupBy(KEY).applyInPandas(
        axes, f"{KEY} int, mean array<double>, axes array<array<double>>, variance array<double>")


def _moment_rows(sums: dict) -> pd.DataFrame:
    """One row per raster and row of its matrix."""
    return pd.concat([pd.DataFrame({KEY: np.int32(rid), "i": np.arange(len(m), dtype=np.int32), "m": list(m)})
                      for rid, m in sums.items()])


def project(emb: DataFrame, axes: DataFrame, k: int) -> DataFrame:
    """Coordinates ``pc0..`` of the valid patches; null for nodata; 0 beyond the vector's length."""
    gone = V.is_nodata(F.col("embedding"))
    centred = F.zip_with(V.doubles(F.col("embedding")), F.col("mean"), lambda x, m: x - m)
    at = emb.join(axes, KEY).withColumn("_x", centred)
    return at.select(KEY, "r", "c", *[
        F.when(~gone, F.coalesce(V.dot(F.col("_x"), F.get("axes", F.lit(i))), F.lit(0.0))).alias(f"pc{i}")
        for i in range(k)])


def _min_max(px: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each column scaled to the unit range within its raster; a flat column becomes 0."""
    ext = px.groupBy(KEY).agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    out = px.join(ext, KEY)
    for c in cols:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        out = out.withColumn(c, F.when(F.col(c).isNotNull() & (hi - lo < 1e-9), 0.0)
                             .otherwise((F.col(c) - lo) / F.greatest(hi - lo, F.lit(1e-9))))
    return out.select(*px.columns)


def pca_scalar(emb: DataFrame) -> DataFrame:
    """K3. First component scaled to the unit range."""
    return _min_max(project(emb, principal_axes(emb, 1), 1), ["pc0"]).withColumnRenamed("pc0", "value")


def pca_rgb(emb: DataFrame, sigma: float = 1.5, block: int = 256) -> DataFrame:
    """K4. Top three components, blurred, as 0..255 colours; nodata is black."""
    pcs = project(emb, principal_axes(emb, 3), 3)
    unit = _min_max(smooth_raster(pcs, ["pc0", "pc1", "pc2"], sigma, block), ["pc0", "pc1", "pc2"])
    return unit.select(KEY, "r", "c", *[
        F.coalesce((F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(p))) * 255).cast("int"), F.lit(0)).alias(name)
        for p, name in (("pc0", "red"), ("pc1", "green"), ("pc2", "blue"))])


def zero_shot(patches: DataFrame, anchors: DataFrame, scale: float) -> DataFrame:
    """K12. Class of each patch by softmax over its cosines with the class text vectors.

    ``anchors``: ``raster_id class_id prototype``, normalised text vectors.
    """
    probs = score_prototypes(patches, anchors).withColumn("probs", V.softmax(F.col("cosines"), scale))
    return probs.select(KEY, "r", "c", F.get("class_ids", V.argmax(F.col("probs"))).alias("class_id"),
                        F.array_max("probs").alias("confidence"), "class_ids", "probs")


def zero_shot_image(whole: DataFrame, anchors: DataFrame, scale: float) -> DataFrame:
    """K12. Class of each raster as a whole, by softmax over the cosines of its one vector.

    ``whole``: ``raster_id embedding``, the image-level vector, or the mean of its patches where a model has none.
    """
    probs = score_prototypes(whole, anchors).withColumn("probs", V.softmax(F.col("cosines"), scale))
    return probs.select(KEY, F.get("class_ids", V.argmax(F.col("probs"))).alias("class_id"), F.array_max("probs").alias("confidence"), "class_ids", "probs")


def zero_shot_summary(labelled: DataFrame, low: float = 0.3) -> DataFrame:
    """D20. Share, mean confidence and count per class, with the raster's totals."""
    per = labelled.groupBy(KEY, "class_id").agg(
        F.count(F.lit(1)).alias("pixel_count"), F.sum("confidence").alias("_s"), F.count_if(F.col("confidence") < low).alias("_low"))
    whole = per.groupBy(KEY).agg(F.sum("pixel_count").alias("_n"), F.sum("_s").alias("_ts"), F.sum("_low").alias("_tl"))
    return per.join(whole, KEY).select(
        KEY, "class_id", "pixel_count", F.round(F.col("pixel_count") / F.col("_n") * 100, 1).alias("percentage"),
        F.round(F.col("_s") / F.col("pixel_count"), 3).alias("avg_confidence"),
        F.round(F.col("_ts") / F.col("_n"), 3).alias("global_confidence"),
        F.round(F.col("_tl") / F.col("_n") * 100, 1).alias("needs_review_pct"))


def text_anchors(prompts: DataFrame) -> DataFrame:
    """S14. Class vector: mean of the normalised vectors of its prompts, normalised again.

    ``prompts``: ``class_id embedding``, one row per template.
    """
    unit = prompts.withColumn("embedding", V.l2_normalize(F.col("embedding")))
    mean = unit.groupBy("class_id").agg(V.mean_vector(F.col("embedding")).alias("_m"), F.count(F.lit(1)).alias("n_prompts"))
    return mean.select("class_id", "n_prompts", V.l2_normalize(F.col("_m")).alias("prototype"))


def _argmax_rows(scored: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """The best class per group; scores equal to 12 places are a tie, which the lower id wins.

    Sums of doubles differ in their last place with the order of the rows, so
    without the rounding a tie would fall differently from run to run.
    """
    best = F.max(F.struct(F.round(score, 12).alias("s"), (-F.col("class_id")).alias("k")))
    return (scored.groupBy(*keys).agg(best.alias("_b"))
            .select(*keys, (-F.col("_b.k")).alias("class_id"), F.col("_b.s").alias("confidence")))


def merge_overlaps(tiles: DataFrame, keys: Sequence[str] = ("r", "c")) -> DataFrame:
    """D19. Weighted mean probability per pixel and class over overlapping tiles, then the best class."""
    num = tiles.groupBy(*keys, "class_id").agg(F.sum(F.col("prob") * F.col("w")).alias("_s"), F.sum("w").alias("_w"))
    scored = num.withColumn("p", F.col("_s") / F.greatest(F.col("_w"), F.lit(1e-6)))
    return _argmax_rows(scored, keys, "p")


def scale_average(probs: DataFrame, keys: Sequence[str] = ("r", "c")) -> DataFrame:
    """D21. Mean probability per pixel and class over image scales, then the best class."""
    mean = probs.groupBy(*keys, "class_id").agg(F.avg("prob").alias("p"))
    return _argmax_rows(mean, keys, "p")


def tile_pixels(size: DataFrame, tile: int, overlap: float) -> DataFrame:
    """E1, F19. Every pixel of every overlapping tile with its weight; ``size``: ``raster_id height width``."""
    steps = F.sequence(F.lit(0), F.lit(tile - 1))
    return (size.withColumn("r0", F.explode(tile_positions("height", tile, overlap)))
            .withColumn("c0", F.explode(tile_positions("width", tile, overlap)))
            .withColumn("y", F.explode(steps)).withColumn("x", F.explode(steps))
            .withColumn("r", F.col("r0") + F.col("y")).withColumn("c", F.col("c0") + F.col("x"))
            .where((F.col("r") < F.col("height")) & (F.col("c") < F.col("width")))
            .select(KEY, "r0", "c0", "r", "c", window_weight("y", "x", tile).alias("w")))


def zero_shot_tiled(patches: DataFrame, anchors: DataFrame, size: DataFrame, tile: int, overlap: float,
                    scale: float) -> DataFrame:
    """K13. Zero-shot probabilities per tile, blended by weight where tiles overlap.

    ``patches``: ``raster_id r0 c0 r c embedding``: a patch vector depends on the tile it was made in.
    """
    probs = zero_shot_probs(patches, anchors, scale)
    weighted = probs.join(tile_pixels(size, tile, overlap), [KEY, "r0", "c0", "r", "c"])
    return merge_overlaps(weighted, [KEY, "r", "c"])


def zero_shot_probs(patches: DataFrame, anchors: DataFrame, scale: float) -> DataFrame:
    rows = score_prototypes(patches, anchors).withColumn("_z", F.explode(F.arrays_zip(
        F.col("class_ids").alias("class_id"), V.softmax(F.col("cosines"), scale).alias("prob"))))
    return rows.select(KEY, "r0", "c0", "r", "c", F.col("_z.class_id").alias("class_id"), F.col("_z.prob").alias("prob"))
