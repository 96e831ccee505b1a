"""Routing: FNV-1a 64, the splitmix64 finaliser, and slots of a generation.

Two forms of the same hash. ``logical_slot`` hashes whole Arrow columns in numpy, one pass per byte position.
``logical_slot_native`` stays in the JVM: Spark raises on 64-bit overflow, so it multiplies in halves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the two hash functions.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB


def _check(size: int) -> None:
    if size <= 0 or size & (size - 1):
        raise ValueError("a generation's size is a positive power of two")


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def fnv1a64(ids: pa.Array) -> np.ndarray:
    """FNV-1a of each id's UTF-8 bytes; a null is hashed as the empty string."""
    ids = ids.cast(pa.large_string()).fill_null("")
    n = len(ids)
    at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + n + 1]
    raw = ids.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    start, length = at[:-1], np.diff(at)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    h = np.full(n, FNV_OFFSET, np.uint64)
    for i in range(int(length[0]) if n else 0):
        k = int(np.searchsorted(-length, -i, "left"))  # ids of more than i bytes
        h[:k] = (h[:k] ^ data[start[:k] + i]) * np.uint64(FNV_PRIME)
    out = np.empty(n, np.uint64)
    out[order] = h
    return out


def logical_slot(ids: Column | str, size: int) -> Column:
    """Slot 0 to size - 1 of each id."""
    _check(size)

    @F.arrow_udf("int")
    def route(ids: pa.Array) -> pa.Array:
        return pa.array((mix64(fnv1a64(ids)) & np.uint64(size - 1)).astype(np.int32))

    return route(ids)


def _bind(value: Column, f) -> Column:
    """f(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _with(f, *rest):
    """f(x, *rest) as a function of x alone, which is what Spark asks of a lambda."""
    return lambda x: f(x, *rest)


_LOW = 0xFFFFFFFF


def _multiply(x: Column, by: int) -> Column:
    """x * by modulo 2 ** 64 from products of a 32-bit half and a 16-bit part, none of which overflows."""
    low, high = x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32)
    part = [by >> 16 * i & 0xFFFF for i in range(4)]

    def add(a: Column, b: Column) -> Column:
        """a + b modulo 2 ** 64."""
        s = a.bitwiseAND(F.lit(_LOW)) + b.bitwiseAND(F.lit(_LOW))
        t = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(s, 32)
        return F.shiftleft(t.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(s.bitwiseAND(F.lit(_LOW)))

    out = low * F.lit(part[0])
    for term in (F.shiftleft(low * F.lit(part[1]), 16), F.shiftleft(low * F.lit(part[2]), 32), F.shiftleft(low * F.lit(part[3]), 48), F.shiftleft(high * F.lit(part[0]), 32), F.shiftleft(high * F.lit(part[1]), 48)):
        out = _bind(out, _with(add, term))
    return out


def fnv1a64_native(ids: Column) -> Column:
    """FNV-1a as a LONG of the same 64 bits."""
    code = lambda i: F.ascii(F.decode(F.substr(F.encode(ids, "UTF-8"), i, F.lit(1)), "ISO-8859-1"))
    n = F.octet_length(ids)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def step(h: Column, i: Column) -> Column:
        def prime(x: Column) -> Column:  # the prime is 2 ** 40 + 435
            low, high = x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32)
            up = high * 435 + F.shiftleft(low, 8) + F.shiftrightunsigned(low * 435, 32)
            return F.shiftleft(up.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR((low * 435).bitwiseAND(F.lit(_LOW)))

        return _bind(h.bitwiseXOR(code(i).cast("long")), prime)

    return F.aggregate(places, F.lit(FNV_OFFSET - (1 << 64)).cast("long"), step)


def logical_slot_native(ids: Column, size: int) -> Column:
    _check(size)
    x = fnv1a64_native(F.coalesce(ids, F.lit("")))

    def mixed(v: Column, shift: int, by: int) -> Column:
        return _bind(v.bitwiseXOR(F.shiftrightunsigned(v, shift)), _with(_multiply, by))

    for shift, by in ((30, MIX_A), (27, MIX_B)):
        x = _bind(x, _with(mixed, shift, by))
    return _bind(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 31)).bitwiseAND(F.lit(size - 1))).cast("int")


def physical_slot(logical: Column, base: int) -> Column:
    return logical + F.lit(base)


def logical_of(physical: Column, base: int, size: int) -> Column:
    """Slots outside the segment stay as they are."""
    return F.when((physical >= base) & (physical < base + size), physical - base).otherwise(physical)


def slot_for_aggregate(ids: Column | str, base: int, size: int) -> Column:
    """base + logical slot; -1 where no generation is served (size 0 or less)."""
    return F.lit(-1) if size <= 0 else logical_slot(ids, size) + F.lit(base)


def segment_of(slot: Column) -> Column:
    """The generation of a physical slot, floor(log2(slot)); null for slots of 0 or less."""
    return F.when(slot > 0, F.length(F.bin(slot.cast("long"))) - 1)
