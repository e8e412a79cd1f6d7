"""Embedding queries. Vectors come out one row per element, or as a checksum."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.fixtures import Tables, values_sql
from geoloom.functions import vector as V
from geoloom.operators import embeddings as M
from geoloom.operators import rasters as R
from geoloom.plans.rasters import r6
from geoloom.registry import query

DIM = 64


def patches(t: Tables):
    """The embedding raster with zeros where a patch is missing."""
    blank = F.transform("embedding", lambda x: F.lit(0.0).cast("float"))
    return t.fx_grid.select("raster_id", "r", "c", F.when(F.col("nodata"), blank).otherwise(F.col("embedding")).alias("embedding"),
                            "label", "vec_id")


_G = "g AS (SELECT *, embedding::DOUBLE[] AS e FROM fx_grid)"
_NORM = "sqrt(list_dot_product({0}, {0}))"


def cos_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / ((sqrt(list_dot_product({a}, {a})) + 1e-9) * (sqrt(list_dot_product({b}, {b})) + 1e-9))"


def mean_sql(rel: str, keys: str, out: str) -> str:
    """Element-wise mean of ``e`` over ``rel`` by ``keys`` as a list."""
    return f"""(SELECT {keys}, list(m ORDER BY i) AS {out} FROM (SELECT {keys}, i, avg(x) AS m FROM
      (SELECT {keys}, unnest(e) AS x, unnest(range(len(e))) AS i FROM {rel}) GROUP BY ALL) GROUP BY {keys})"""


def elements(df, col: str, *keys: str):
    return df.select(*keys, F.posexplode(col).alias("i", "v")).select(*keys, "i", F.round("v", 6).alias("v"))


@query("F7", "l2_normalize", f"WITH {_G}, u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM g) "
       "SELECT vec_id, CAST(unnest(range(len(e))) AS INT) AS i, round(unnest(e) / (n + 1e-9), 6) AS v FROM u")
def l2_normalize(t: Tables):
    return elements(t.fx_grid.withColumn("u", V.l2_normalize(F.col("embedding"))), "u", "vec_id")


_LABELS = "lb AS (SELECT raster_id, label % 3 AS class_id, r, c, vec_id, nodata, e FROM g)"
_USED = "us AS (SELECT * FROM lb WHERE NOT nodata)"
_PROTO = f"pr AS {mean_sql('us', 'raster_id, class_id', 'p')}"


def geo(t: Tables):
    return (R.raster_size(t.fx_grid).withColumn("west", F.col("raster_id") * 1.0).withColumn("north", F.lit(50.0))
            .withColumn("dx", F.lit(0.01)).withColumn("dy", F.lit(0.02)))


def labels(t: Tables):
    """A labelled point near the middle of each patch."""
    return t.fx_grid.select(
        "raster_id", (F.col("label") % 3).alias("class_id"), "vec_id",
        (F.col("raster_id") + F.col("c") * 0.01 + 0.003).alias("lon"), (50 - F.col("r") * 0.02 - 0.006).alias("lat"))


def _matched(t: Tables):
    return M.labels_to_patches(labels(t), patches(t), geo(t))


@query("C9", "labels_to_patches", f"WITH {_G}, {_LABELS}, {_USED} SELECT raster_id, class_id, r, c FROM us")
def labels_to_patches(t: Tables):
    return _matched(t).select("raster_id", "class_id", "r", "c")


@query("C9", "lost_classes", f"""WITH {_G}, lb AS (SELECT raster_id, vec_id % 40 AS class_id, nodata FROM g)
SELECT raster_id, class_id FROM lb GROUP BY ALL HAVING bool_and(nodata OR class_id % 5 = 0)""")
def lost_classes(t: Tables):
    lab = t.fx_grid.select("raster_id", (F.col("vec_id") % 40).alias("class_id"),
                           (F.col("raster_id") + F.col("c") * 0.01 + F.when(F.col("vec_id") % 5 == 0, 9.0).otherwise(0.0)).alias("lon"),
                           (50 - F.col("r") * 0.02).alias("lat"))
    return M.lost_classes(lab, M.labels_to_patches(lab, patches(t), geo(t)))


def _protos(t: Tables):
    return M.prototypes(_matched(t), labels(t))


@query("D17", "prototypes", f"""WITH {_G}, {_LABELS}, {_USED}, {_PROTO},
n AS (SELECT raster_id, class_id, count(*) AS points_given, count(*) FILTER (WHERE NOT nodata) AS points_used FROM lb GROUP BY ALL)
SELECT raster_id, class_id, points_used, points_given, CAST(unnest(range(len(p))) AS INT) AS i, round(unnest(p), 6) AS v FROM pr JOIN n USING (raster_id, class_id)""")
def prototypes(t: Tables):
    return elements(_protos(t), "prototype", "raster_id", "class_id", "points_used", "points_given")


@query("D18", "pool_tokens", f"""WITH {_G}, tk AS (SELECT raster_id, r, CAST(floor(c / 5.0) AS INT) AS c, e FROM g),
m AS {mean_sql('tk', 'raster_id, r, c', 'p')} SELECT raster_id, r, c, CAST(unnest(range(len(p))) AS INT) AS i, round(unnest(p), 6) AS v FROM m""")
def pool_tokens(t: Tables):
    tokens = t.fx_grid.withColumn("c", F.floor(F.col("c") / 5).cast("int"))
    return elements(M.pool_tokens(tokens), "embedding", "raster_id", "r", "c")


_SCORES = f"sc AS (SELECT g.raster_id, r, c, nodata, class_id, {cos_sql('e', 'p')} AS cosine FROM g JOIN pr ON pr.raster_id = g.raster_id)"


@query("C10", "score_prototypes", f"WITH {_G}, {_LABELS}, {_USED}, {_PROTO}, {_SCORES} SELECT raster_id, r, c, class_id, round(cosine, 6) AS cosine FROM sc WHERE NOT nodata")
def score_prototypes(t: Tables):
    s = M.score_prototypes(patches(t).where(~V.is_nodata(F.col("embedding"))), _protos(t))
    z = F.explode(F.arrays_zip(F.col("class_ids").alias("k"), F.col("cosines").alias("v"))).alias("z")
    return s.select("raster_id", "r", "c", z).select("raster_id", "r", "c", F.col("z.k").alias("class_id"), F.round("z.v", 6).alias("cosine"))


@query("K5", "few_shot", f"""WITH {_G}, {_LABELS}, {_USED}, {_PROTO}, {_SCORES},
b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY raster_id, r, c ORDER BY cosine DESC, class_id) = 1)
SELECT raster_id, r, c, CASE WHEN nodata THEN -1 ELSE class_id END AS class_id, CASE WHEN nodata THEN 0 ELSE round((cosine + 1) / 2, 6) END AS confidence FROM b""")
def few_shot(t: Tables):
    return M.few_shot(patches(t), _protos(t)).select("raster_id", "r", "c", "class_id", *r6("confidence"))


@query("K6", "few_shot_logistic", f"""WITH {_G}, {_LABELS}, {_USED}, n AS (SELECT raster_id, class_id, count(*) AS n_points FROM us GROUP BY ALL),
p AS (SELECT raster_id, count(*) AS n_patches, count(*) FILTER (WHERE nodata) AS n_nodata FROM g GROUP BY 1)
SELECT raster_id, class_id, n_points, CAST(n_points AS DOUBLE) AS expected, n_patches, n_nodata, true AS better_than_chance FROM n JOIN p USING (raster_id)""")
def few_shot_logistic(t: Tables):
    """Where the loss is least, the probabilities of a class over the labelled patches add up to its number of points."""
    matched = _matched(t)
    probs = M.logistic_probs(matched, M.logistic_models(matched))
    z = F.explode(F.arrays_zip(F.col("class_ids").alias("k"), F.col("probs").alias("p"))).alias("z")
    sums = (probs.select("raster_id", "class_id", z).groupBy("raster_id", F.col("z.k").alias("class_id")).agg(
                F.count_if(F.col("class_id") == F.col("z.k")).alias("n_points"), F.round(F.sum("z.p"), 1).alias("expected")))
    said = M.few_shot_logistic(patches(t), matched)
    right = said.join(matched.select("raster_id", "r", "c", F.col("class_id").alias("own")), ["raster_id", "r", "c"], "left")
    per = right.groupBy("raster_id").agg(F.count(F.lit(1)).alias("n_patches"), F.count_if(F.col("class_id") == -1).alias("n_nodata"),
                                         (F.count_if(F.col("own") == F.col("class_id")) / F.count("own") > 0.4).alias("better_than_chance"))
    return sums.join(per, "raster_id")


_CENTRE = """ctr AS (SELECT raster_id, CAST(round_even((max(r) + 1) / 2.0, 0) AS INT) AS r0, CAST(round_even((max(c) + 1) / 2.0, 0) AS INT) AS c0 FROM g GROUP BY 1),
wn AS (SELECT g.* FROM g JOIN ctr USING (raster_id) WHERE NOT nodata AND abs(r - r0) <= 1 AND abs(c - c0) <= 1), vd AS (SELECT * FROM g WHERE NOT nodata)"""
_QUERY = f"""{_CENTRE}, lq AS {mean_sql('wn', 'raster_id', 'l')}, gq AS {mean_sql('vd', 'raster_id', 'q0')},
nq AS (SELECT raster_id, count(*) AS n_window FROM wn GROUP BY 1),
q AS (SELECT raster_id, coalesce(l, q0) AS q, coalesce(n_window, 0) AS n_window FROM gq LEFT JOIN lq USING (raster_id) LEFT JOIN nq USING (raster_id))"""


def _query(t: Tables):
    return M.embedding_query(patches(t), geo(t))


@query("K1", "embedding_query", f"WITH {_G}, {_QUERY} SELECT raster_id, n_window, CAST(unnest(range(len(q))) AS INT) AS i, round(unnest(q), 6) AS v FROM q")
def embedding_query(t: Tables):
    return elements(_query(t), "query", "raster_id", "n_window")


_SIM = f"sm AS (SELECT g.raster_id, r, c, label, nodata, CASE WHEN nodata THEN 0 ELSE ({cos_sql('e', 'q')} + 1) / 2 END AS s FROM g JOIN q USING (raster_id))"


@query("K2", "similarity", f"WITH {_G}, {_QUERY}, {_SIM} SELECT raster_id, r, c, round(s, 6) AS similarity FROM sm")
def similarity(t: Tables):
    return M.similarity(patches(t), _query(t), 0).withColumn("similarity", F.round("similarity", 6))


_BLUR = """k0 AS (SELECT CAST(i AS INT) AS k, exp(-0.5 * (i / 1.5) * (i / 1.5)) AS g FROM range(-6, 7) t(i)), kn AS (SELECT k, g / (SELECT sum(g) FROM k0) AS g FROM k0),
dm AS (SELECT raster_id, max(r) + 1 AS h, max(c) + 1 AS w FROM g GROUP BY 1),
hz AS (SELECT a.raster_id, a.r, a.c, h, a.nodata, sum(kn.g * b.s) AS s FROM sm a JOIN dm USING (raster_id) CROSS JOIN kn JOIN sm b ON b.raster_id = a.raster_id AND b.r = a.r
  AND b.c = CASE WHEN ((a.c + k) % (2 * w) + 2 * w) % (2 * w) < w THEN ((a.c + k) % (2 * w) + 2 * w) % (2 * w) ELSE 2 * w - 1 - ((a.c + k) % (2 * w) + 2 * w) % (2 * w) END GROUP BY ALL)
SELECT a.raster_id, a.r, a.c, CASE WHEN a.nodata THEN 0 ELSE round(sum(kn.g * b.s), 6) END AS similarity FROM hz a CROSS JOIN kn JOIN hz b ON b.raster_id = a.raster_id AND b.c = a.c
  AND b.r = CASE WHEN ((a.r + k) % (2 * a.h) + 2 * a.h) % (2 * a.h) < a.h THEN ((a.r + k) % (2 * a.h) + 2 * a.h) % (2 * a.h) ELSE 2 * a.h - 1 - ((a.r + k) % (2 * a.h) + 2 * a.h) % (2 * a.h) END GROUP BY a.raster_id, a.r, a.c, a.nodata"""


@query("K2", "similarity_smooth", f"WITH {_G}, {_QUERY}, {_SIM}, {_BLUR}")
def similarity_smooth(t: Tables):
    return M.similarity(patches(t), _query(t), 1.5).withColumn("similarity", F.round("similarity", 6))


@query("F8", "cosine01", f"""WITH {_G}, q AS (SELECT raster_id, e AS q, nodata AS qn FROM g WHERE r = 0 AND c = 1)
SELECT g.raster_id, r, c, CASE WHEN nodata THEN 0 WHEN qn THEN 0.5 ELSE round(({cos_sql('e', 'q')} + 1) / 2, 6) END AS s FROM g JOIN q USING (raster_id)""")
def cosine01(t: Tables):
    q = patches(t).where("r = 0 AND c = 1").select("raster_id", F.col("embedding").alias("q"))
    return patches(t).join(q, "raster_id").select("raster_id", "r", "c", F.round(V.cosine01(F.col("embedding"), F.col("q")), 6).alias("s"))


@query("H5", "most_similar", f"""WITH {_G}, {_QUERY}, {_SIM} SELECT raster_id, r, c, round(s, 6) AS similarity,
  CAST(row_number() OVER (PARTITION BY raster_id ORDER BY s DESC, r, c) AS INT) AS rank FROM sm QUALIFY rank <= 10""")
def most_similar(t: Tables):
    return M.most_similar(patches(t), _query(t), 10).withColumn("similarity", F.round("similarity", 6))


def _shifted(t: Tables):
    """A second date: each patch takes the vector one column to its left."""
    return patches(t).withColumn("c", F.col("c") + 1)


_TWO = f"{_G}, ch AS (SELECT a.raster_id, a.r, a.c, a.nodata OR b.nodata AS gone, a.e AS ea, b.e AS eb, {cos_sql('a.e', 'b.e')} AS cosine FROM g a JOIN g b ON b.raster_id = a.raster_id AND b.r = a.r AND b.c = a.c - 1)"


@query("C11", "change_join", f"WITH {_TWO} SELECT raster_id, r, c, CASE WHEN NOT gone THEN round(1 - cosine, 6) END AS distance FROM ch")
def change_join(t: Tables):
    return M.change_map(patches(t), _shifted(t)).select("raster_id", "r", "c", *r6("distance"))


@query("K7", "change_map", f"WITH {_TWO} SELECT raster_id, r, c, CASE WHEN NOT gone THEN 1 - cosine > 0.9::DOUBLE END AS changed FROM ch")
def change_map(t: Tables):
    return M.change_map(patches(t), _shifted(t), 0.9).select("raster_id", "r", "c", "changed")


@query("F9", "cosine_distance", f"WITH {_TWO} SELECT raster_id, count(*) AS n, round(sum(1 - cosine) FILTER (WHERE NOT gone), 5) AS total FROM ch GROUP BY 1")
def cosine_distance(t: Tables):
    return M.change_map(patches(t), _shifted(t)).groupBy("raster_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("distance"), 5).alias("total"))


@query("C12", "concat_pre_post", f"WITH {_TWO}, x AS (SELECT raster_id, r, c, list_concat(ea, eb) AS v FROM ch WHERE NOT gone) "
       "SELECT raster_id, r, c, CAST(unnest(range(len(v))) AS INT) AS i, round(unnest(v), 6) AS v FROM x")
def concat_pre_post(t: Tables):
    got = M.concat_pre_post(patches(t), _shifted(t))
    return elements(got.withColumn("embedding", V.doubles(F.col("embedding"))), "embedding", "raster_id", "r", "c")


# A sample linear head of four classes, given by a rule.
HEAD_W = [[((k + 1) * (i % 7) - 3 * k) / 10 for i in range(DIM)] for k in range(4)]
HEAD_B = [0.1, -0.2, 0.3, 0.0]
_HEAD = f"""hd AS (SELECT k, w, b FROM (SELECT CAST(kk AS INT) AS k, list(CAST(((kk + 1) * (i % 7) - 3 * kk) AS DOUBLE) / 10 ORDER BY i) AS w
   FROM range(4) a(kk), range({DIM}) z(i) GROUP BY kk) JOIN {values_sql(list(enumerate(HEAD_B)))} v(k2, b) ON k2 = k),
lg AS (SELECT vec_id, k, list_dot_product(e, w) + b AS logit FROM g, hd)"""


def _logits(t: Tables):
    w = F.array(*[F.array(*[F.lit(x) for x in row]) for row in HEAD_W])
    b = F.array(*[F.lit(x) for x in HEAD_B])
    return t.fx_grid.select("vec_id", V.linear_head(F.col("embedding"), w, b).alias("logits"))


@query("F11", "linear_head", f"WITH {_G}, {_HEAD} SELECT vec_id, k AS i, round(logit, 6) AS v FROM lg")
def linear_head(t: Tables):
    return elements(_logits(t), "logits", "vec_id")


@query("F10", "softmax", f"""WITH {_G}, {_HEAD}, mx AS (SELECT vec_id, max(logit) AS m FROM lg GROUP BY 1),
s AS (SELECT vec_id, k, exp((logit - m) * 2) AS x FROM lg JOIN mx USING (vec_id)), p AS (SELECT vec_id, k, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM s)
SELECT vec_id, CAST(arg_max(k, p) AS INT) AS class_id, round(max(p), 6) AS prob FROM p GROUP BY vec_id""")
def softmax(t: Tables):
    return (_logits(t).withColumn("p", V.softmax(F.col("logits"), 2.0))
            .select("vec_id", V.argmax(F.col("p")).alias("class_id"), F.round(F.array_max("p"), 6).alias("prob")))


@query("F12", "normalize_range", """SELECT raster_id, r, c, round(least(1, greatest(0, (scalar - 1000) / 600)), 6) AS unit,
 round(least(1, greatest(0, (scalar - 1000) / 600)) * 600 + 1000, 6) AS back FROM fx_class""")
def normalize_range(t: Tables):
    u = V.normalize_range(F.col("scalar"), 1000.0, 1600.0)
    return t.fx_class.select("raster_id", "r", "c", F.round(u, 6).alias("unit"),
                             F.round(V.denormalize(u, 1000.0, 1600.0), 6).alias("back"))


_QUANT = f"""{_G}, x AS (SELECT raster_id, r, c, nodata, unnest(e) AS x, CAST(unnest(range(len(e))) AS INT) AS i FROM g),
qz AS (SELECT raster_id, r, c, i, nodata, CASE WHEN nodata THEN -128 ELSE CAST(least(127, greatest(-127, round_even(sign(x) * sqrt(abs(x)) * 127, 0))) AS INT) END AS q FROM x)"""


@query("F13", "quantize_int8", f"""WITH {_QUANT} SELECT raster_id, r, c, i, q, CASE WHEN NOT nodata THEN round(sign(q) * pow(q / 127.0::DOUBLE, 2), 6) END AS back FROM qz""")
def quantize_int8(t: Tables):
    q = patches(t).withColumn("q", V.quantize_int8(F.col("embedding"), V.is_nodata(F.col("embedding"))))
    back = F.coalesce(V.dequantize_int8(F.col("q")), F.transform("q", lambda x: F.lit(None).cast("double")))
    return (q.select("raster_id", "r", "c", F.posexplode(F.arrays_zip("q", back.alias("back"))).alias("i", "z"))
            .select("raster_id", "r", "c", "i", F.col("z.q").cast("int").alias("q"), F.round("z.back", 6).alias("back")))


@query("K8", "embedding_export", f"WITH {_QUANT} SELECT raster_id, r, c, i, q FROM qz")
def embedding_export(t: Tables):
    p = patches(t)
    chunks = p.select("raster_id", F.floor(F.col("c") / 8).cast("int").alias("chunk_id"), F.lit(0.0).alias("top"),
                      (F.floor(F.col("c") / 8) * 80.0).alias("left"), "r", (F.col("c") % 8).alias("c"), "embedding")
    grid = R.raster_size(p).withColumn("top", F.lit(0.0)).withColumn("left", F.lit(0.0))
    got = M.embedding_export(chunks, grid, 10.0)
    return got.select("raster_id", "r", "c", F.posexplode("bands").alias("i", "q")).withColumn("q", F.col("q").cast("int"))


_VAR = f"""WITH {_G}, vd AS (SELECT * FROM g WHERE NOT nodata), el AS (SELECT raster_id, unnest(e) AS x, unnest(range(len(e))) AS i FROM vd),
vr AS (SELECT raster_id, i, var_pop(x) AS v FROM el GROUP BY ALL), tr AS (SELECT raster_id, round(sum(v), 6) AS trace, round(max(v), 6) AS widest FROM vr GROUP BY 1),
n AS (SELECT raster_id, count(*) AS n_patches, count(*) FILTER (WHERE nodata) AS n_nodata FROM g GROUP BY 1)"""


def _axis_facts(t: Tables, k: int):
    """Per raster: is each axis a unit eigenvector of the patches' covariance, worked out anew from the patches, and are they at right angles and in order?"""
    emb = patches(t)
    axes = M.principal_axes(emb, k)
    valid = emb.where(~V.is_nodata(F.col("embedding"))).select("raster_id", V.doubles(F.col("embedding")).alias("x"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)

    met = valid.join(axes, "raster_id").withColumn("d", F.zip_with("x", "mean", lambda p, q: p - q))
    each = met.select("raster_id", "axes", "variance", "d", F.posexplode("axes").alias("k", "axis")).withColumn("pc", dot(F.col("d"), F.col("axis")))
    long = each.select("raster_id", "k", "pc", "axis", F.get("variance", F.col("k")).alias("lam"), F.posexplode("d").alias("i", "di"))
    image = long.groupBy("raster_id", "k", "i").agg(F.avg(F.col("pc") * F.col("di")).alias("ca"), F.first("lam").alias("lam"), F.first(F.get("axis", F.col("i"))).alias("ai"))
    eigen = image.groupBy("raster_id").agg((F.max(F.abs(F.col("ca") - F.col("lam") * F.col("ai"))) < 1e-6).alias("eigen"))
    spread = valid.select("raster_id", F.posexplode("x").alias("i", "v")).groupBy("raster_id", "i").agg(F.var_pop("v").alias("v")).groupBy("raster_id").agg(
        F.round(F.sum("v"), 6).alias("trace"), F.round(F.max("v"), 6).alias("widest"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    unit = F.lit(True)
    for i, j in pairs:
        unit = unit & (F.abs(dot(F.get("axes", F.lit(i)), F.get("axes", F.lit(j))) - (1.0 if i == j else 0.0)) < 1e-9)
    order = F.lit(True)
    for i in range(k - 1):
        order = order & (F.get("variance", F.lit(i)) >= F.get("variance", F.lit(i + 1)))
    facts = axes.join(eigen, "raster_id").join(spread, "raster_id")
    top = F.get("variance", F.lit(0))
    return facts.select("raster_id", unit.alias("orthonormal"), order.alias("in_order"), "eigen", "trace", "widest",
                        ((top >= F.col("widest") - 1e-6) & (top <= F.col("trace") + 1e-6)).alias("widest_or_more"))


@query("K3", "pca_scalar", f"""{_VAR} SELECT raster_id, true AS orthonormal, true AS in_order, true AS eigen, trace, widest, true AS widest_or_more, n_patches, n_nodata,
  CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high FROM tr JOIN n USING (raster_id)""")
def pca_scalar(t: Tables):
    got = M.pca_scalar(patches(t)).groupBy("raster_id").agg(
        F.count(F.lit(1)).alias("n_patches"), F.count_if(F.col("value").isNull()).alias("n_nodata"), F.min("value").alias("low"), F.max("value").alias("high"))
    return _axis_facts(t, 1).join(got, "raster_id")


@query("K4", "pca_rgb", f"""{_VAR} SELECT raster_id, true AS orthonormal, true AS in_order, true AS eigen, trace, widest, true AS widest_or_more, n_patches, n_nodata, 0 AS low, 255 AS high
FROM tr JOIN n USING (raster_id)""")
def pca_rgb(t: Tables):
    channels = ("red", "green", "blue")
    got = M.pca_rgb(patches(t), 1.5).join(patches(t).select("raster_id", "r", "c", V.is_nodata(F.col("embedding")).alias("gone")), ["raster_id", "r", "c"])
    black = F.greatest(*channels) == 0
    facts = got.groupBy("raster_id").agg(F.count(F.lit(1)).alias("n_patches"), F.count_if(F.col("gone") & black).alias("n_nodata"),
                                         F.min(F.least(*channels)).alias("low"), F.max(F.greatest(*channels)).alias("high"))
    return _axis_facts(t, 3).join(facts, "raster_id")


_ANCHOR = f"an AS (SELECT raster_id, class_id, list_transform(p, lambda z: z / (sqrt(list_dot_product(p, p)) + 1e-9)) AS p FROM pr)"
_PROB = f"""sc AS (SELECT g.raster_id, g.r, g.c, class_id, {cos_sql('e', 'p')} AS cosine FROM g JOIN an ON an.raster_id = g.raster_id),
mx AS (SELECT raster_id, r, c, max(cosine) AS m FROM sc GROUP BY ALL), ex AS (SELECT sc.*, exp((cosine - m) * 20) AS x FROM sc JOIN mx USING (raster_id, r, c)),
pb AS (SELECT raster_id, r, c, class_id, x / sum(x) OVER (PARTITION BY raster_id, r, c) AS prob FROM ex),
zs AS (SELECT * FROM pb QUALIFY row_number() OVER (PARTITION BY raster_id, r, c ORDER BY prob DESC, class_id) = 1)"""


def anchors(t: Tables):
    return _protos(t).select("raster_id", "class_id", V.l2_normalize(F.col("prototype")).alias("prototype"))


def _zero_shot(t: Tables):
    return M.zero_shot(t.fx_grid, anchors(t), 20.0)


@query("K12", "zero_shot", f"WITH {_G}, {_LABELS}, {_USED}, {_PROTO}, {_ANCHOR}, {_PROB} SELECT raster_id, r, c, class_id, round(prob, 6) AS confidence FROM zs")
def zero_shot(t: Tables):
    return _zero_shot(t).select("raster_id", "r", "c", "class_id", *r6("confidence"))


@query("K12", "zero_shot_image", f"""WITH {_G}, {_LABELS}, {_USED}, {_PROTO}, {_ANCHOR}, vd AS (SELECT * FROM g WHERE NOT nodata), w AS {mean_sql('vd', 'raster_id', 'e')},
sc AS (SELECT w.raster_id, class_id, {cos_sql('e', 'p')} AS cosine FROM w JOIN an ON an.raster_id = w.raster_id),
ex AS (SELECT *, exp((cosine - max(cosine) OVER (PARTITION BY raster_id)) * 20) AS x FROM sc), pb AS (SELECT raster_id, class_id, x / sum(x) OVER (PARTITION BY raster_id) AS prob FROM ex)
SELECT raster_id, class_id, round(prob, 6) AS confidence FROM pb QUALIFY row_number() OVER (PARTITION BY raster_id ORDER BY prob DESC, class_id) = 1""")
def zero_shot_image(t: Tables):
    whole = t.fx_grid.where("not nodata").groupBy("raster_id").agg(V.mean_vector(F.col("embedding")).alias("embedding"))
    return M.zero_shot_image(whole, anchors(t), 20.0).select("raster_id", "class_id", *r6("confidence"))


@query("D20", "zeroshot_summary", f"""WITH {_G}, {_LABELS}, {_USED}, {_PROTO}, {_ANCHOR}, {_PROB}
SELECT raster_id, class_id, count(*) AS pixel_count, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER w * 100, 1) AS percentage,
 round(avg(prob), 3) AS avg_confidence, round(sum(sum(prob)) OVER w / sum(count(*)) OVER w, 3) AS global_confidence,
 round(CAST(sum(count(*) FILTER (WHERE prob < 0.4::DOUBLE)) OVER w AS DOUBLE) / sum(count(*)) OVER w * 100, 1) AS needs_review_pct
FROM zs GROUP BY raster_id, class_id WINDOW w AS (PARTITION BY raster_id)""")
def zeroshot_summary(t: Tables):
    return M.zero_shot_summary(_zero_shot(t), 0.4)


_TILES = """tp AS (SELECT raster_id, r0, c0, CAST(r0 + y AS INT) AS r, CAST(c0 + x AS INT) AS c,
   least(1, greatest(0.1::DOUBLE, cos((y * 2 / 7.0::DOUBLE - 1) * pi() / 2) * cos((x * 2 / 7.0::DOUBLE - 1) * pi() / 2))) AS w
 FROM (SELECT DISTINCT raster_id FROM g), (VALUES (0), (2)) a(r0), (VALUES (0), (4), (8), (12), (16), (17)) b(c0), range(8) m(y), range(8) n(x))"""


@query("K13", "zero_shot_tiled", f"""WITH {_G}, {_LABELS}, {_USED}, {_PROTO}, {_ANCHOR}, {_TILES},
te AS (SELECT tp.raster_id, r0, c0, tp.r, tp.c, w, g.e AS e FROM tp JOIN g ON g.raster_id = tp.raster_id AND g.r = tp.r AND g.c = (tp.c + tp.c0) % 25),
sc AS (SELECT te.raster_id, r0, c0, r, c, w, class_id, {cos_sql('e', 'p')} AS cosine FROM te JOIN an ON an.raster_id = te.raster_id),
ex AS (SELECT *, exp((cosine - max(cosine) OVER v) * 20) AS x FROM sc WINDOW v AS (PARTITION BY raster_id, r0, c0, r, c)),
pb AS (SELECT *, x / sum(x) OVER (PARTITION BY raster_id, r0, c0, r, c) AS prob FROM ex),
mg AS (SELECT raster_id, r, c, class_id, sum(prob * w) / greatest(sum(w), 1e-6) AS p FROM pb GROUP BY ALL)
SELECT raster_id, r, c, class_id, round(p, 6) AS confidence FROM mg QUALIFY row_number() OVER (PARTITION BY raster_id, r, c ORDER BY p DESC, class_id) = 1""")
def zero_shot_tiled(t: Tables):
    size = R.raster_size(t.fx_grid)
    spots = M.tile_pixels(size, 8, 0.5).drop("w")
    # the vector of a patch differs by tile: here it is that of a shifted column
    emb = t.fx_grid.select("raster_id", "r", F.col("c").alias("_c"), "embedding")
    made = spots.withColumn("_c", F.pmod(F.col("c") + F.col("c0"), F.lit(25))).join(emb, ["raster_id", "r", "_c"]).drop("_c")
    return M.zero_shot_tiled(made, anchors(t), size, 8, 0.5, 20.0).withColumn("confidence", F.round("confidence", 6))


@query("D19", "merge_overlaps", """
WITH m AS (SELECT r, c, class_id, sum(prob * w) / greatest(sum(w), 1e-6) AS p FROM fx_prob GROUP BY ALL)
SELECT r, c, class_id, round(p, 6) AS confidence FROM m QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY round(p, 12) DESC, class_id) = 1""")
def merge_overlaps(t: Tables):
    return M.merge_overlaps(t.fx_prob).select("r", "c", "class_id", *r6("confidence"))


@query("D21", "scale_average", """
WITH m AS (SELECT r, c, class_id, avg(prob) AS p FROM fx_prob GROUP BY ALL)
SELECT r, c, class_id, round(p, 6) AS confidence FROM m QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY round(p, 12) DESC, class_id) = 1""")
def scale_average(t: Tables):
    mean = M.scale_average(t.fx_prob)
    return mean.select("r", "c", "class_id", *r6("confidence"))


# The classes a caller brings: id, name and colour.
USER_CLASSES = [(0, "Orchard", "#7fbf7b"), (1, "Quarry", "#a6611a"), (2, "Pond", "#2c7bb6")]


@query("U2", "user_classes", f"""WITH {_G}, {_LABELS}, {_USED}, {_PROTO}, {_ANCHOR}, {_PROB}
SELECT raster_id, name, color, count(*) AS pixel_count, round(avg(prob), 3) AS avg_confidence
FROM zs JOIN {values_sql(USER_CLASSES)} uc(class_id, name, color) ON uc.class_id = zs.class_id GROUP BY ALL""")
def user_classes(t: Tables):
    named = t.values("class_id, name, color", USER_CLASSES)
    got = M.zero_shot_summary(_zero_shot(t)).join(named, "class_id")
    return got.select("raster_id", "name", "color", "pixel_count", "avg_confidence")


# The prompt templates.
TEMPLATES = ["itap of a {}.", "a bad photo of a {}.", "a origami {}.", "a photo of the large {}.", "a {} in a video game.",
             "art of the {}.", "a photo of the small {}.", "a photo of many {}.", "a photo of {}s."]


@query("S14", "template_prompts", f"""
SELECT p_partkey, i AS template, replace(tpl, '{{}}', p_name) AS prompt FROM part, {values_sql(list(enumerate(TEMPLATES)))} v(i, tpl)""")
def template_prompts(t: Tables):
    arr = F.array(*[F.lit(x) for x in TEMPLATES])
    return t.part.select("p_partkey", "p_name", F.posexplode(arr).alias("template", "tpl")).select(
        "p_partkey", "template", F.replace(F.col("tpl"), F.lit("{}"), F.col("p_name")).alias("prompt"))


@query("S14", "text_anchors", f"""WITH {_G}, u AS (SELECT label AS class_id, list_transform(e, lambda z: z / (sqrt(list_dot_product(e, e)) + 1e-9)) AS e FROM g),
m AS {mean_sql('u', 'class_id', 'p')}, n AS (SELECT class_id, count(*) AS n_prompts FROM u GROUP BY 1)
SELECT class_id, n_prompts, CAST(unnest(range(len(p))) AS INT) AS i, round(unnest(list_transform(p, lambda z: z / (sqrt(list_dot_product(p, p)) + 1e-9))), 6) AS v FROM m JOIN n USING (class_id)""")
def text_anchors(t: Tables):
    prompts = t.fx_grid.select(F.col("label").alias("class_id"), "embedding")
    return elements(M.text_anchors(prompts), "prototype", "class_id", "n_prompts")
