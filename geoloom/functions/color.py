"""Colour expressions. A gradient is a list of ``(hex, position)`` stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default scalar gradient, the palette of clusters, the colours of the default tags and the palette of others.
DEFAULT_STOPS = [("#440154", 0.0), ("#3b528b", 0.25), ("#21918c", 0.5), ("#5ec962", 0.75), ("#fde725", 1.0)]
CLUSTER_COLORS = ["#228b22", "#f0e68c", "#808080", "#1e90ff", "#90ee90", "#d2b48c", "#5f9ea0", "#e0f0ff"]
TAG_COLORS = {"Forest": "#228b22", "Cropland": "#f0e68c", "Urban": "#808080", "Water": "#1e90ff", "Grassland": "#90ee90",
              "Barren": "#d2b48c", "Wetland": "#5f9ea0", "Snow/Ice": "#f0f8ff"}
OTHER_TAGS = ["#e11d48", "#7c3aed", "#0891b2", "#16a34a", "#ea580c", "#db2777", "#0ea5e9", "#65a30d"]
# Label and stops of the gradient of each kind of task.
COLORMAPS = {
    "flammability": ("Live fuel moisture (% — low → high)", [("#dc2626", 0.0), ("#f59e0b", 0.5), ("#16a34a", 1.0)]),
    "mangrove": ("Mangrove softmax score (uncalibrated)", [("#0f172a", 0.0), ("#0891b2", 0.5), ("#67e8f9", 1.0)]),
    "landuse": ("Southern-Kenya land-use class (argmax)", [("#ca8a04", 0.0), ("#65a30d", 0.5), ("#0891b2", 1.0)]),
    "forestloss": ("Forest-loss driver (argmax class)", [("#16a34a", 0.0), ("#facc15", 0.5), ("#dc2626", 1.0)]),
    "ecosystem": ("Ecosystem type (argmax of 110 classes)", [("#6366f1", 0.0), ("#ec4899", 0.5), ("#f59e0b", 1.0)]),
    "embedding": ("Encoder feature magnitude (PCA 1st component)", [("#0f172a", 0.0), ("#6366f1", 0.5), ("#f59e0b", 1.0)]),
    "similarity": ("Cosine similarity to query (0=opposite, 0.5=unrelated, 1=identical)",
                   [("#0f172a", 0.0), ("#312e81", 0.5), ("#f59e0b", 0.75), ("#fef3c7", 1.0)]),
}
ALPHA = 210
RGB_ALPHA = 230


def rgb_of(hex_color: str) -> tuple[int, int, int]:
    h = hex_color.lstrip("#")
    return int(h[0:2], 16), int(h[2:4], 16), int(h[4:6], 16)


def hex_to_rgb(h: Column) -> Column:
    """J1."""
    body = F.regexp_replace(h, "^#", "")

    def part(start: int) -> Column:
        return F.conv(F.substring(body, start, 2), 16, 10).cast("int")

    return F.struct(part(1).alias("red"), part(3).alias("green"), part(5).alias("blue"))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.format_string("#%02x%02x%02x", r, g, b))


def gradient(t: Column, stops=None, clamp: bool = True) -> Column:
    """J2. Piecewise-linear colour as ``struct(red, green, blue, alpha)``.

    Null or NaN is transparent; without ``clamp`` so is a value outside the stops.
    """
    stops = stops or DEFAULT_STOPS
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)) if clamp else t
    missing = t.isNull() | F.isnan(t)

    def channel(k: int) -> Column:
        out = F.when(missing, 0)
        for (c0, p0), (c1, p1) in zip(stops, stops[1:]):
            a, b = rgb_of(c0)[k], rgb_of(c1)[k]
            frac = (x - p0) / (p1 - p0) if p1 > p0 else F.lit(0.0)
            out = out.when((x >= p0) & (x <= p1), (a + frac * (b - a)).cast("int"))
        return out.otherwise(rgb_of(stops[-1][0])[k] if clamp else 0)

    inside = ~missing if clamp else ~missing & (x >= stops[0][1]) & (x <= stops[-1][1])
    return F.struct(channel(0).alias("red"), channel(1).alias("green"), channel(2).alias("blue"),
                    F.when(inside, ALPHA).otherwise(0).alias("alpha"))


def class_rgba(class_id: Column, palette: list[str]) -> Column:
    """J3. Palette colour; negative or null is transparent, beyond the end is the last colour."""
    rgbs = [rgb_of(p) for p in palette] or [(0, 0, 0)]
    idx = F.least(class_id, F.lit(len(rgbs) - 1))
    gone = class_id.isNull() | (class_id < 0)

    def channel(k: int) -> Column:
        table = F.array(*[F.lit(p[k]) for p in rgbs])
        return F.when(gone, 0).otherwise(F.get(table, idx))

    return F.struct(channel(0).alias("red"), channel(1).alias("green"), channel(2).alias("blue"),
                    F.when(gone, 0).otherwise(ALPHA).alias("alpha"))


def stretch(v: Column, lo: Column, hi: Column) -> Column:
    """J4. Linear stretch to 0..255, cut to whole numbers."""
    t = (v - lo) / F.greatest(F.lit(1e-9), hi - lo)
    return (F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)) * 255).cast("int")


def colormap_rgba(key: Column, t: Column) -> Column:
    """J2. The gradient of a task's colour map, that of embeddings where the key is unknown."""
    out = None
    for name, (_, stops) in COLORMAPS.items():
        out = F.when(key == name, gradient(t, stops)) if out is None else out.when(key == name, gradient(t, stops))
    return out.otherwise(gradient(t, COLORMAPS["embedding"][1]))


def rgb_rgba(red: Column, green: Column, blue: Column) -> Column:
    """K17. Three channels passed through; transparent where one is missing."""
    gone = red.isNull() | green.isNull() | blue.isNull()
    return F.struct(*[F.when(gone, 0).otherwise(c.cast("int")).alias(n) for c, n in ((red, "red"), (green, "green"), (blue, "blue"))],
                    F.when(gone, 0).otherwise(RGB_ALPHA).alias("alpha"))


def fade_to_white(channel: Column, conf: Column) -> Column:
    """J5."""
    return (channel * conf + 255 * (1 - conf)).cast("int")


def tag_hash(name: Column) -> Column:
    """J7. 31-hash of the UTF-16 text, wrapped to 32 unsigned bits."""
    codes = F.transform(F.split(name, ""), lambda ch: F.ascii(ch).cast("bigint"))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, x: F.pmod(h * 31 + x, F.lit(4294967296)))


def tag_color(name: Column, custom: list[str] | None = None) -> Column:
    """J7. The fixed colour of a default tag; custom tags take the other palette in turn, any other tag by its hash."""
    palette = F.array(*[F.lit(p) for p in OTHER_TAGS])
    known = dict(TAG_COLORS)
    for i, tag in enumerate(custom or []):
        known.setdefault(tag, OTHER_TAGS[i % len(OTHER_TAGS)])
    fixed = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(fixed[name], F.get(palette, F.pmod(tag_hash(name), F.lit(len(OTHER_TAGS))).cast("int")))


def class_legend(heads: DataFrame, colormap: str, num_classes: str, published: str) -> DataFrame:
    """J6. A row per class of each head: the published colour, or where there is none the head's gradient at the class."""
    n = F.col(num_classes)
    rows = heads.withColumn("index", F.explode(F.sequence(F.lit(0), n - 1)))
    g = colormap_rgba(F.col(colormap), F.col("index") / F.greatest(F.lit(1), n - 1))
    rows = rows.withColumn("_g", g)
    own = F.when(F.col("index") < F.size(published), F.get(F.col(published), F.col("index")))
    return rows.withColumn("color", F.coalesce(own, rgb_to_hex(F.col("_g.red"), F.col("_g.green"), F.col("_g.blue")))).drop("_g")


def regression_legend(heads: DataFrame, colormap: str) -> DataFrame:
    """J6. Label and stops of each head's colour map beside its ``units`` and ``value``."""
    def of(i: int) -> Column:
        known = {k: v[0] if i == 0 else ", ".join(f"{c} {p}" for c, p in v[1]) for k, v in COLORMAPS.items()}
        return F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col(colormap)], F.lit(known["embedding"]))

    return heads.withColumns({"label": of(0), "stops": of(1)})
