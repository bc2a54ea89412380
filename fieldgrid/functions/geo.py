"""Equal-area projection, cells and points as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84, and the standard parallel of the global equal-area grid (EPSG:6933).
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
STANDARD_PARALLEL = 30.0

E2 = 2 * FLATTENING - FLATTENING**2
E = math.sqrt(E2)
K0 = math.cos(math.radians(STANDARD_PARALLEL)) / math.sqrt(1 - E2 * math.sin(math.radians(STANDARD_PARALLEL)) ** 2)


def project_x(lon: Column) -> Column:
    """Easting in metres of the cylindrical equal-area projection."""
    return F.radians(lon) * (SEMI_MAJOR * K0)


def project_y(lat: Column) -> Column:
    """Northing in metres; null beyond the poles, where the latitude is null before anything is computed from it."""
    s = F.sin(F.radians(F.when(F.abs(lat) <= 90, lat)))
    q = (s / (1 - E2 * s * s) - F.log((1 - E * s) / (1 + E * s)) / (2 * E)) * (1 - E2)
    return q * SEMI_MAJOR / (2 * K0)


def square(x: Column, y: Column, size: float) -> Column:
    """The five vertices of a closed square cell, counter-clockwise from the lower left."""
    h = size / 2
    at = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    return F.array(at(-h, -h), at(h, -h), at(h, h), at(-h, h), at(-h, -h))


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("x"), lat.alias("y"))


def _double_bytes(value: Column) -> Column:
    """Eight bytes of a double, lowest first, from its sign, exponent and fraction.

    Exact for normal numbers and zero, which is all that coordinates in metres can be."""
    size = F.abs(value)
    power = F.floor(F.log2(size))
    power = F.when(F.pow(F.lit(2.0), power) > size, power - 1).when(F.pow(F.lit(2.0), power + 1) <= size, power + 1).otherwise(power)
    fraction = ((size / F.pow(F.lit(2.0), power) - 1) * float(1 << 52)).cast("long")
    bits = F.when(size == 0, F.lit(0).cast("long")).otherwise((power.cast("long") + 1023) * F.lit(1 << 52) + fraction)
    high = F.lpad(F.hex(bits), 16, "0")
    top = F.conv(F.substring(high, 1, 2), 16, 10).cast("int") + F.when(value < 0, 128).otherwise(0)
    signed = F.concat(F.lpad(F.hex(top.cast("long")), 2, "0"), F.substring(high, 3, 14))
    return F.concat(*[F.substring(signed, k, 2) for k in range(15, 0, -2)])


def _head(count: int) -> str:
    """Byte order, kind, one ring and its number of vertices, as hexadecimal text."""
    return "01" + b"".join(n.to_bytes(4, "little") for n in (3, 1, count)).hex()


def well_known_binary(ring: Column, count: int = 5) -> Column:
    """Little-endian WKB of a polygon of one ring with ``count`` vertices."""
    parts = [c for k in range(count) for c in (_double_bytes(ring[k]["x"]), _double_bytes(ring[k]["y"]))]
    return F.unhex(F.concat(F.lit(_head(count)), *parts))


def square_binary(x: Column, y: Column, size: float) -> Column:
    """``well_known_binary`` of ``square``, a batch of rows at once."""
    head, h = np.frombuffer(bytes.fromhex(_head(5)), np.uint8), size / 2

    @F.arrow_udf("binary")
    def made(x: pa.Array, y: pa.Array) -> pa.Array:
        east, north = (v.fill_null(0.0).to_numpy(zero_copy_only=False) for v in (x, y))
        left, right, low, high = east - h, east + h, north - h, north + h
        ring = np.stack([left, low, right, low, right, high, left, high, left, low], axis=1).astype("<f8")
        out = np.concatenate([np.broadcast_to(head, (len(ring), len(head))), ring.view(np.uint8)], axis=1)
        places = np.arange(len(out) + 1, dtype=np.int32) * np.int32(out.shape[1])
        found = pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(out))])
        return pc.if_else(pc.and_(x.is_valid(), y.is_valid()), found, pa.scalar(None, pa.binary()))

    return made(x, y)


def vertices(wkb: Column) -> Column:
    """The vertices of a little-endian WKB polygon of one ring, as ``square`` gives them; null for any
    other geometry and for a value whose length is not that of its vertices. A batch of rows at once."""
    head = np.frombuffer(bytes.fromhex(_head(0))[:9], np.uint8)

    @F.arrow_udf("array<struct<x: double, y: double>>")
    def read(wkb: pa.Array) -> pa.Array:
        wkb = wkb.cast(pa.large_binary())
        _, places, data = wkb.buffers()
        at = np.frombuffer(places, np.int64)[wkb.offset : wkb.offset + len(wkb) + 1]
        data = np.frombuffer(data if data is not None else b"", np.uint8)
        begin, length = at[:-1], np.diff(at)
        fine = wkb.is_valid().to_numpy(zero_copy_only=False) & (length >= 13)
        count = np.zeros(len(wkb), np.int64)
        known = begin[fine]
        count[fine] = data[known[:, None] + np.arange(9, 13)].copy().view("<u4")[:, 0]
        fine[fine] = (data[known[:, None] + np.arange(9)] == head).all(axis=1)
        fine &= (count > 0) & (length == 13 + 16 * count)
        count[~fine] = 0
        ends = np.concatenate([[0], np.cumsum(count)])
        point = np.repeat(begin + 13, count) + 16 * (np.arange(ends[-1]) - np.repeat(ends[:-1], count))
        xy = data[point[:, None] + np.arange(16)].copy().view("<f8")
        points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), points, mask=pa.array(~fine))

    return read(wkb)
