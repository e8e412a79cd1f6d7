"""Every kind of geometry, byte order and dimension, and what can't be read."""

import struct

import pytest

from geoloom.sources.wkb import CODES, decode_wkb, encode_wkb


def plain(kind, parts, order, extra, flags):
    """One geometry as bytes, written out number by number; ``extra`` is the ISO thousand, or with ``flags`` the bits."""
    bits = {0: 0, 1: 0x80000000, 2: 0x40000000, 3: 0xC0000000}[extra]
    code = CODES[kind] | bits | (0x20000000 if flags else 0) if flags else CODES[kind] + 1000 * extra
    head = struct.pack(order + "BI", 1 if order == "<" else 0, code) + (struct.pack(order + "I", 4326) if flags else b"")

    def line(ring):
        return struct.pack(order + "I", len(ring)) + b"".join(struct.pack(order + "d", x) for p in ring for x in p)

    if kind == "Point":
        return head + b"".join(struct.pack(order + "d", x) for x in parts[0][0][0])
    if kind == "LineString":
        return head + line(parts[0][0])
    if kind == "Polygon":
        return head + struct.pack(order + "I", len(parts[0])) + b"".join(map(line, parts[0]))
    other = ">" if order == "<" else "<"  # a member has a byte order of its own
    if kind == "GeometryCollection":
        return head + struct.pack(order + "I", 2) + plain("Point", parts[:1], other, extra, flags) + plain("Polygon", parts[1:], order, extra, flags)
    return head + struct.pack(order + "I", len(parts)) + b"".join(plain(kind[5:], [p], other, extra, flags) for p in parts)


def shapes(width):
    def p(*v):
        return [float(x) for x in (*v, 7, 9)[:width]]

    square = [p(0, 0), p(4, 0), p(4, 4), p(0, 0)]
    hole = [p(1, 1), p(2, 1), p(2, 2), p(1, 1)]
    return {"Point": [[[p(1, 2)]]], "LineString": [[square]], "Polygon": [[square, hole]], "MultiPoint": [[[p(1, 2)]], [[p(3, 4)]]],
            "MultiLineString": [[square], [hole]], "MultiPolygon": [[square, hole], [hole]], "GeometryCollection": [[[p(1, 2)]], [square, hole]]}


@pytest.mark.parametrize("flags", [False, True])
def test_all_kinds(spark, flags):
    rows, want = [], {}
    for order in "<>":
        for extra, (dims, width) in enumerate((("XY", 2), ("XYZ", 3), ("XYM", 3), ("XYZM", 4))):
            for kind, parts in shapes(width).items():
                want[len(rows)] = (kind, dims, parts, None)
                rows.append((len(rows), bytearray(plain(kind, parts, order, extra, flags)), "x"))
    rows.append((len(rows), None, "y"))
    df = spark.createDataFrame(rows, "id int, geometry binary, dims_of string").repartition(3)
    got = decode_wkb(df)
    found = {r.id: (r.geometry_type, r.dims, r.parts, r.geometry_error) for r in got.collect()}
    assert found.pop(len(rows) - 1) == (None,) * 4 and found == want
    back = got.where("geometry_type <> 'GeometryCollection'").withColumn("geometry", encode_wkb("geometry_type", "dims", "parts"))
    again = {r.id: (r.geometry_type, r.dims, r.parts, r.geometry_error) for r in decode_wkb(back.select("id", "geometry")).collect()}
    assert again == {k: v for k, v in want.items() if v[0] != "GeometryCollection"}


def test_a_batch_of_points_is_taken_at_once(spark):
    df = spark.createDataFrame([(i, bytearray(struct.pack("<BIdd", 1, 1, i, -i))) for i in range(5000)], "id int, geometry binary")
    assert {r.id: r.rings for r in decode_wkb(df).collect()} == {i: [[[float(i), float(-i)]]] for i in range(5000)}


def test_what_cannot_be_read_says_so(spark):
    good = struct.pack("<BIdd", 1, 1, 1.0, 2.0)
    bad = [b"", good[:-1], b"\x05" + good[1:], struct.pack("<BI", 1, 99), good + b"x", struct.pack("<BII", 1, 2, 1 << 30), struct.pack("<BII", 1, 4, 1) + struct.pack("<BII", 1, 2, 0)]
    empty = [struct.pack("<BIdd", 1, 1, float("nan"), float("nan")), struct.pack("<BII", 1, 2, 0), struct.pack("<BII", 1, 6, 0)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate([*bad, *empty, good])], "id int, geometry binary")
    got = {r.id: r for r in decode_wkb(df).collect()}
    assert all(got[i].geometry_error and got[i].geometry_type is None and got[i].parts is None for i in range(len(bad)))
    assert [(got[i].geometry_type, got[i].parts) for i in range(len(bad), len(bad) + 3)] == [("Point", []), ("LineString", []), ("MultiPolygon", [])]
    assert got[len(bad) + 3].rings == [[[1.0, 2.0]]] and decode_wkb(df.limit(0)).count() == 0
