"""Operators by name, with the arguments each needs, and the check of a table of calls."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators import catalog, grids, labels, polygons, rasters, scenes, vectorize


# How a JSON value of each argument type looks to Spark.
JSON_TYPES = {"string": "^STRING", "number": "^(BIGINT|DOUBLE|DECIMAL|FLOAT)", "integer": "^BIGINT", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT"}


@dataclass(frozen=True)
class Tool:
    run: Callable[..., DataFrame]
    required: Mapping[str, str]
    optional: Mapping[str, str] = field(default_factory=dict)

    def schema(self) -> dict:
        """JSON schema of the arguments, as a caller of a service sees them: tables go by name."""
        every = {**self.required, **self.optional}
        return {"type": "object", "properties": {k: {"type": v} for k, v in every.items()}, "required": list(self.required)}


# U1. Names a caller may use. In Python a table is a DataFrame; in a call as JSON it is a name.
TOOLS: Mapping[str, Tool] = {
    "search_imagery": Tool(scenes.search_scenes, {"scenes": "string", "bbox": "array", "start": "string", "end": "string", "collections": "array"},
                           {"max_cloud": "number", "limit": "integer"}),
    "composite_tile_url": Tool(catalog.composite_url, {"specs": "string", "base": "string"}),
    "query_polygon": Tool(catalog.find_feature, {"requests": "string", "features": "string"}),
    "query_polygon_stats": Tool(polygons.polygon_stats, {"rings": "string"}),
    "query_ndvi_timeseries": Tool(rasters.ndvi_timeseries, {"px": "string", "scenes": "string", "aois": "string", "anchor": "string"},
                                  {"months": "integer", "max_cloud": "number"}),
    "query_ndvi_masked": Tool(rasters.ndvi_masked, {"px": "string", "class_px": "string", "scenes": "string", "aois": "string", "anchor": "string", "keep": "array", "grid": "array"},
                              {"months": "integer", "max_cloud": "number"}),
    "query_raster_histogram": Tool(rasters.class_histogram, {"px": "string", "num_classes": "integer"}, {"top_n": "integer"}),
    "query_raster_scalar_stats": Tool(rasters.scalar_stats, {"px": "string", "value": "string"}, {"value_range": "array", "digits": "integer"}),
    "score_windows": Tool(rasters.score_windows, {"px": "string", "keys": "array", "win": "integer", "scorer": "string", "schema": "string"}, {"batch": "integer"}),
    "vectorize": Tool(vectorize.connected_regions, {"px": "string"}, {"block": "integer"}),
    "validate_features": Tool(labels.validate_features, {"features": "string", "neighbors": "string", "evidence": "object"}, {"threshold": "number"}),
    "plan_chunks": Tool(grids.plan_chunks, {"aois": "string"}, {"size_m": "number"}),
}


def call(name: str, **args) -> DataFrame:
    """Run one tool; an unknown name or a missing argument is an error."""
    if name not in TOOLS:
        raise KeyError(f"unknown tool {name!r}; known: {sorted(TOOLS)}")
    missing = [a for a in TOOLS[name].required if a not in args]
    if missing:
        raise TypeError(f"{name} needs {missing}")
    return TOOLS[name].run(**args)


def check_calls(calls: DataFrame, tools: Mapping[str, Tool] = TOOLS) -> DataFrame:
    """U1. Status of each requested call: ok, unknown tool or bad arguments, with what is missing and what has the wrong type.

    ``calls``: ``call_id name args`` with the arguments as JSON text. The
    registry is a list in the plan; nothing is joined.
    """
    known = F.lit(None).cast("boolean")
    missing = wrong = F.lit(None).cast("array<string>")
    got = calls.withColumn("_v", F.try_parse_json("args"))

    def kind(arg: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("_v", f"$.{arg}", "variant"))

    def names(of: Mapping[str, str], bad: Callable[[str, str], Column]) -> Column:
        marks = [F.when(bad(a, t), F.lit(a)) for a, t in of.items()]
        return F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")

    for name, tool in tools.items():
        mine = F.col("name") == name
        every = {**tool.required, **tool.optional}
        known = F.when(mine, True).otherwise(known)
        missing = F.when(mine, names(tool.required, lambda a, t: kind(a).isNull() | kind(a).isin("VOID"))).otherwise(missing)
        wrong = F.when(mine, names(every, lambda a, t: kind(a).isNotNull() & ~kind(a).isin("VOID") & ~kind(a).rlike(JSON_TYPES[t]))).otherwise(wrong)
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    got = got.withColumns({"_known": F.coalesce(known, F.lit(False)), "_object": is_object,
                           "missing": F.when(is_object, F.array_join(missing, ",")), "wrong_type": F.when(is_object, F.array_join(wrong, ","))})
    return got.withColumn("status", F.when(~F.col("_known"), "unknown_tool")
                          .when(~F.col("_object") | (F.col("missing") != "") | (F.col("wrong_type") != ""), "bad_arguments").otherwise("ok")
                          ).drop("_v", "_known", "_object")
