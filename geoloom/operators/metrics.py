"""Accuracy metrics over reference and predicted labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(pred: DataFrame, ignore: Sequence[int] = (0,)) -> DataFrame:
    """D13. Counts per ``(ref, pred)``; ignored references and unmapped rows are left out."""
    ok = pred.where(F.col("ref").isNotNull() & F.col("pred").isNotNull() & ~F.col("ref").isin(list(ignore)))
    return ok.groupBy("ref", "pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(conf: DataFrame, classes: Sequence[int]) -> DataFrame:
    """D13. One row per reference class, one column per predicted class."""
    wide = conf.groupBy("ref").pivot("pred", list(classes)).agg(F.sum("n"))
    return wide.na.fill(0).select("ref", *[F.col(str(c)).alias(f"pred_{c}") for c in classes])


def class_totals(conf: DataFrame) -> DataFrame:
    """Hits, reference and prediction totals per class, in one pass over the small matrix."""
    side = F.explode(F.array(
        F.struct(F.col("ref").alias("class_id"), F.col("n").alias("ref_n"), F.lit(0).cast("bigint").alias("pred_n"),
                 F.when(F.col("ref") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("pred").alias("class_id"), F.lit(0).cast("bigint").alias("ref_n"), F.col("n").alias("pred_n"),
                 F.lit(0).cast("bigint").alias("hit"))))
    return (conf.select(side.alias("s")).groupBy("s.class_id")
            .agg(F.sum("s.hit").alias("tp"), F.sum("s.ref_n").alias("ref_n"), F.sum("s.pred_n").alias("pred_n")))


def _with_total(rows: DataFrame, mean_of: str, mean_as: str, only: Column | None = None) -> DataFrame:
    """Attach the mean of a column over the classes and the overall accuracy.

    There is one row per class here, so the window over all rows is small.
    """
    chosen = F.col(mean_of) if only is None else F.when(only, F.col(mean_of))
    classes = Window.partitionBy()
    return (rows.withColumn(mean_as, F.avg(chosen).over(classes))
            .withColumn("accuracy", F.sum("tp").over(classes) / F.sum("ref_n").over(classes)))


def iou_metrics(conf: DataFrame, every_class: bool = False) -> DataFrame:
    """D14. Intersection over union per class, its mean over the classes that appear
    in the reference (or over all), and the overall accuracy."""
    t = class_totals(conf)
    union = F.col("ref_n") + F.col("pred_n") - F.col("tp")
    rows = t.withColumn("iou", F.when(union > 0, F.col("tp") / union).otherwise(0.0))
    return _with_total(rows, "iou", "miou", None if every_class else F.col("ref_n") > 0)


def prf_metrics(conf: DataFrame) -> DataFrame:
    """D15. Precision, recall, F1 and support per class, macro F1 and accuracy."""
    t, tiny = class_totals(conf), F.lit(1e-9)
    p = F.col("tp") / F.greatest(F.col("pred_n"), tiny)
    r = F.col("tp") / F.greatest(F.col("ref_n"), tiny)
    rows = (t.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), tiny))
            .withColumnRenamed("ref_n", "support"))
    got = rows.withColumn("ref_n", F.col("support"))
    return _with_total(got, "f1", "macro_f1").drop("ref_n", "pred_n", "tp")


def worst_best_classes(iou: DataFrame, k: int) -> DataFrame:
    """H4. The lowest and the highest classes by IoU among those that appear."""
    seen = iou.where(F.col("ref_n") > 0).select("class_id", "iou")
    low = seen.orderBy(F.asc("iou"), F.asc("class_id")).limit(k).withColumn("side", F.lit("worst"))
    high = seen.orderBy(F.desc("iou"), F.asc("class_id")).limit(k).withColumn("side", F.lit("best"))
    return low.unionByName(high)


def stable_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """H1. ``n`` rows by a salted hash of their key: the same ones whatever the row order."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)))
    return df.withColumn("_d", draw).orderBy("_d", key).limit(n).drop("_d")


def eval_labels(points: DataFrame, tiles: DataFrame, anchors: list[tuple[int, int, int, int]], n: int, zoom: int,
                tile_px: int = 256, seed: int = 0, ignore: Sequence[int] = (0,)) -> DataFrame:
    """K20. Rendered tiles judged at ``n`` reference points, the same ones for a seed.

    ``points``: ``pid lon lat ref``; ``tiles``: ``x y px py red green blue``. A
    point takes the colour of its tile pixel (C17), the colour its nearest
    legend class (C18), and the pairs give precision, recall, F1 and IoU per
    class (D13-D15). Points without a pixel are counted as ``n_unmapped`` and judged no further.
    """
    from geoloom.operators.grids import nearest_color_class, sample_pixels_at

    seen = sample_pixels_at(stable_sample(points, "pid", n, seed), tiles, zoom, tile_px)
    pred = nearest_color_class(seen, anchors).withColumn("pred", F.when(F.col("red").isNotNull(), F.col("class_id")))
    conf = confusion(pred, ignore)
    counts = pred.agg(F.count(F.lit(1)).alias("n_sampled"), F.count_if(F.col("pred").isNull()).alias("n_unmapped"))
    rows = prf_metrics(conf).join(iou_metrics(conf).select("class_id", "iou", "miou"), "class_id")
    return rows.withColumns({"n_sampled": counts.select("n_sampled").scalar(), "n_unmapped": counts.select("n_unmapped").scalar()})
