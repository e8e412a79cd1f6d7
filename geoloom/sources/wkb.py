"""Well-known binary geometries, read and written batch by batch over Arrow buffers.

All seven kinds, both byte orders, and Z and M by ISO codes (1001, 2001, 3001)
and by the flag bits of the extended form, whose SRID is read over. A geometry is
``parts``: a list of parts, each a list of rings or lines, each a list of positions,
each its ordinates. A point is one part of one ring of one position.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds by their code.
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
CODES = {name: code for code, name in KINDS.items()}
MEMBER = {4: 1, 5: 2, 6: 3}  # what a Multi kind is made of
DIMS = ("XY", "XYZ", "XYM", "XYZM")
PARTS = "array<array<array<array<double>>>>"

Parts = list[list[np.ndarray]]


def parse(buf: bytes, at: int = 0, depth: int = 0) -> tuple[str, str, Parts, int]:
    """Kind, dimensions, parts, and where the geometry ends; positions are rows of an array. Raises on anything else."""
    if depth > 16:
        raise ValueError("collections nested too deep")
    if buf[at] > 1:
        raise ValueError("byte order is neither 0 nor 1")
    order = "<" if buf[at] else ">"
    (code,) = struct.unpack_from(order + "I", buf, at + 1)
    at += 5
    z, m = bool(code & 0x80000000), bool(code & 0x40000000)
    if code & 0x20000000:
        at += 4
    iso, kind = divmod(code & 0x0FFFFFFF, 1000)
    if kind not in KINDS or iso > 3:
        raise ValueError(f"unknown geometry code {code}")
    z, m = z or iso in (1, 3), m or iso in (2, 3)
    width = 2 + z + m

    def count() -> int:
        nonlocal at
        (n,) = struct.unpack_from(order + "I", buf, at)
        at += 4
        return n

    def positions(n: int) -> np.ndarray:
        nonlocal at
        if at + 8 * width * n > len(buf):
            raise ValueError("geometry is cut off")
        got = np.frombuffer(buf, order + "f8", width * n, at).reshape(n, width)
        at += 8 * width * n
        return got

    parts: Parts = []
    if kind == 1:
        point = positions(1)
        parts = [] if np.isnan(point[0, :2]).all() else [[point]]
    elif kind == 2:
        line = positions(count())
        parts = [[line]] if len(line) else []
    elif kind == 3:
        rings = [positions(count()) for _ in range(count())]
        parts = [rings] if rings else []
    else:
        for _ in range(count()):
            name, _, own, at = parse(buf, at, depth + 1)
            if kind in MEMBER and name != KINDS[MEMBER[kind]]:
                raise ValueError(f"{name} inside a {KINDS[kind]}")
            parts += own
    return KINDS[kind], DIMS[z + 2 * m], parts, at


def _nested(rows: list[Parts | None]) -> pa.Array:
    """Rows' parts as one nested list over a single array of ordinates."""
    parts = [p for r in rows if r is not None for p in r]
    rings = [g for p in parts for g in p]
    widths = np.concatenate([np.full(len(g), g.shape[1], np.int32) for g in rings]) if rings else np.empty(0, np.int32)
    flat = np.concatenate([np.ascontiguousarray(g, "f8").ravel() for g in rings]) if rings else np.empty(0)

    def listed(sizes, child: pa.Array, missing: np.ndarray | None = None) -> pa.Array:
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int32))).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, child, mask=None if missing is None else pa.array(missing))

    out = listed(widths, pa.array(flat))
    for sizes in ([len(g) for g in rings], [len(p) for p in parts]):
        out = listed(np.array(sizes, np.int32), out)
    return listed(np.array([0 if r is None else len(r) for r in rows], np.int32), out, np.array([r is None for r in rows]))


def _points(column: pa.Array) -> pa.Array | None:
    """The parts of a batch of plain little-endian points, taken at once; None if a row is anything else."""
    if column.null_count or not len(column):
        return None
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], "i8", len(column) + 1, 8 * column.offset)
    if not (np.diff(offsets) == 21).all():
        return None
    data = np.frombuffer(column.buffers()[2], "u1")[offsets[0] : offsets[-1]].reshape(-1, 21)
    if not (data[:, :5] == np.frombuffer(struct.pack("<BI", 1, 1), "u1")).all():
        return None
    xy = np.ascontiguousarray(data[:, 5:]).view("<f8").ravel()
    if np.isnan(xy).any():
        return None
    out = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(column) + 1, 2, dtype=np.int32)), pa.array(xy))
    one = pa.array(np.arange(len(column) + 1, dtype=np.int32))
    for _ in range(3):
        out = pa.ListArray.from_arrays(one, out)
    return out


def decode_wkb(df: DataFrame, col: str = "geometry") -> DataFrame:
    """A6. ``geometry_type dims parts rings geometry_error`` in place of the WKB column ``col``.

    ``rings`` are all parts' rings or lines in one list. A null geometry is null
    in all of them; one that can't be read has its reason in ``geometry_error``
    and nulls elsewhere. An empty geometry has no parts. Of a collection, ``parts``
    are those of its members.
    """
    at = df.columns.index(col)
    rest = [f for f in df.schema if f.name != col]
    made = T.StructType.fromDDL(f"geometry_type string, dims string, parts {PARTS}, geometry_error string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(at)
            n = b.num_rows
            parts = _points(column)
            if parts is not None:
                told = [pa.array(["Point"] * n, pa.string()), pa.array(["XY"] * n, pa.string()), parts, pa.nulls(n, pa.string())]
            else:
                kinds, dims, own, errors = [], [], [], []
                for buf in column.to_pylist():
                    kind = dim = geometry = error = None
                    if buf is not None:
                        try:
                            kind, dim, geometry, end = parse(buf)
                            if end != len(buf):
                                kind, dim, geometry, error = None, None, None, "bytes after the geometry"
                        except (ValueError, IndexError, struct.error) as e:
                            error = str(e) or type(e).__name__
                    for out, v in ((kinds, kind), (dims, dim), (own, geometry), (errors, error)):
                        out.append(v)
                told = [pa.array(kinds, pa.string()), pa.array(dims, pa.string()), _nested(own), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), *told], [f.name for f in [*rest, *made]])

    got = df.mapInArrow(run, T.StructType([*rest, *made]))
    return got.withColumn("rings", F.flatten("parts")).select(*[f.name for f in rest], "geometry_type", "dims", "parts", "rings", "geometry_error")


def _packed(kind: int, parts: list, iso: int) -> bytes:
    head = struct.pack("<BI", 1, kind + 1000 * iso)
    width = 2 + (iso in (1, 3)) + (iso in (2, 3))
    if kind == 1:
        return head + (struct.pack(f"<{width}d", *parts[0][0][0]) if parts else struct.pack("<d", float("nan")) * width)

    def line(ring: list) -> bytes:
        return struct.pack("<I", len(ring)) + np.array([list(p) for p in ring], "<f8").tobytes()

    if kind == 2:
        return head + (line(parts[0][0]) if parts else struct.pack("<I", 0))
    if kind == 3:
        rings = parts[0] if parts else []
        return head + struct.pack("<I", len(rings)) + b"".join(map(line, rings))
    return head + struct.pack("<I", len(parts)) + b"".join(_packed(MEMBER[kind], [p], iso) for p in parts)


def encode_wkb(geometry_type: str | Column, dims: str | Column, parts: str | Column) -> Column:
    """Little-endian WKB of a kind other than a collection, from what ``decode_wkb`` gives; null if anything is null."""
    def pack(kinds: pd.Series, dim: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([None if k is None or d is None or p is None else _packed(CODES[k], [[list(g) for g in part] for part in p], DIMS.index(d)) for k, d, p in zip(kinds, dim, own)])

    return F.pandas_udf(pack, T.BinaryType())(geometry_type, dims, parts)
