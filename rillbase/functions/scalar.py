"""Scalar rules over names, sizes, addresses and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slot_group(name: Column, slot_count: int = 2048) -> Column:
    """(gen, base, size, epoch) of g0 to g10, in any case, trimmed, with or without the g; null if it is none or doesn't fit."""
    digits = F.regexp_extract(F.lower(F.trim(name)), "^g?([0-9]{1,9})$", 1)
    gen = F.when(digits != "", digits.cast("int"))
    size = F.call_function("shiftleft", F.lit(1), gen)
    return F.when((gen <= 10) & (size <= slot_count // 2), F.struct(gen.alias("gen"), size.alias("base"), size.alias("size"), F.lit(1).alias("epoch")))


def replica_digits(policy: Column) -> Column:
    """A plain decimal factor; 0 for anything else and for factors past 2 ** 20."""
    plain = policy.rlike("^[0-9]+$")
    short = F.regexp_replace(policy, "^0+", "")
    value = F.when(plain & (F.length(short) <= 7) & (short != ""), short.cast("long")).otherwise(0)
    return F.when(value > 1 << 20, 0).otherwise(value)


def replica_count(policy: Column, members: Column) -> Column:
    """Copies a policy asks for, no more than there are members."""
    digits = replica_digits(policy)
    want = F.when(policy == "low", 1).when(policy == "high", 3).when(digits > 0, digits).otherwise(2)
    return F.least(want.cast("long"), F.greatest(members.cast("long"), F.lit(1)))


def normal_policy(policy: Column, default: str = "medium") -> Column:
    """Canonical policy; null for an unknown one."""
    digits = replica_digits(policy)
    return F.when(policy == "", F.lit(default)).when(digits > 0, digits.cast("string")).when(policy.isin("low", "medium", "high"), policy)


def normal_address(address: Column) -> Column:
    return F.when((address == "") | F.contains(address, F.lit("://")), address).otherwise(F.concat(F.lit("http://"), address))


def host_port(address: Column) -> Column:
    """What follows the first ``://``, or all."""
    at = F.instr(address, "://")
    return F.when(at > 0, F.substr(address, at + 3, F.length(address))).otherwise(address)


def byte_size(text: Column) -> Column:
    """Bytes of texts such as 64KiB or 3 MB; null for what is none."""
    t = F.trim(text)
    number = F.regexp_extract(t, r"(?i)^\+?(-?[0-9]{1,18})\s*(KiB|MiB|GiB|TiB|KB|MB|GB)?$", 1)
    unit = F.lower(F.regexp_extract(t, r"(?i)^\+?-?[0-9]{1,18}\s*(KiB|MiB|GiB|TiB|KB|MB|GB)?$", 1))
    factor = F.lit(1).cast("long")
    for name, n in (("kib", 1 << 10), ("mib", 1 << 20), ("gib", 1 << 30), ("tib", 1 << 40), ("kb", 1000), ("mb", 1000**2), ("gb", 1000**3)):
        factor = F.when(unit == name, F.lit(n).cast("long")).otherwise(factor)
    value = F.when(number != "", F.try_multiply(number.cast("long"), factor))
    return F.when(value >= 0, value)


def human_bytes(n: Column) -> Column:
    """Whole GiB or MiB where it is a multiple, else the number."""
    gib, mib = 1 << 30, 1 << 20
    return F.when((n >= gib) & (n % gib == 0), F.concat(F.floor(n / gib).cast("string"), F.lit("GiB"))).when((n >= mib) & (n % mib == 0), F.concat(F.floor(n / mib).cast("string"), F.lit("MiB"))).otherwise(n.cast("string"))


def display_bytes(n: Column) -> Column:
    """For people: below 1024 in B, else one decimal (none from 100 on) in KiB to TiB; - for a negative or null."""
    out = F.lit(None).cast("string")
    for power, unit in ((40, "TiB"), (30, "GiB"), (20, "MiB"), (10, "KiB")):
        v = n / float(1 << power)
        shown = F.when(v >= 100, F.format_string("%.0f", v)).otherwise(F.format_string("%.1f", v))
        out = F.when(out.isNull() & (n >= 1 << power), F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return F.when(n.isNull() | (n < 0), F.lit("-")).when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def utc_stamp(seconds: Column) -> Column:
    """YYYY-MM-DD HH:mm:ss in UTC; - for 0, less or null. Needs a UTC session."""
    return F.when(seconds > 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("-"))


def age_seconds(now_s: Column, at_s: Column) -> Column:
    return F.when(at_s == 0, F.lit(-1.0)).otherwise((now_s - at_s).cast("double"))


def retry_delay_s(n: Column, base: int = 2, cap: int = 60) -> Column:
    """Doubles with each attempt, up to the cap."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2), F.least(F.greatest(n, F.lit(1)) - 1, F.lit(30))).cast("long")).cast("long")


def is_gzip(body: Column) -> Column:
    return F.coalesce(F.substring(body, 1, 2) == F.lit(b"\x1f\x8b"), F.lit(False))


def encoded_size(aggregate_id: Column, command_id: Column, events: Column) -> Column:
    """Bytes of a record's frame."""
    parts = F.aggregate(events, F.lit(0).cast("long"), lambda a, e: a + 6 + F.octet_length(e["type"]) + F.octet_length(e["body"]))
    return F.lit(23).cast("long") + F.octet_length(aggregate_id) + F.octet_length(command_id) + parts


def same_members(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def replace_member(members: Column, old: Column, new: Column) -> Column:
    return F.transform(members, lambda x: F.when(x == old, new).otherwise(x))
